import math
import unicodedata
from collections import Counter, defaultdict

import pytest

from tallyweave.llm import quality as ql


def fold(c):
    for k, letters in ql.SHARED.items():
        if c in letters:
            return k
    if "a" <= c <= "z":
        return 2 + ord(c) - 97
    kind = unicodedata.category(c)
    if ord(c) > 65535:
        return ql.REST
    if kind in ("Lu", "Lt"):
        return ql.UPPER
    return {"L": ql.LETTER, "N": ql.DIGIT, "P": ql.MARK, "S": ql.MARK, "Z": ql.SPACE}.get(kind[0], ql.REST)


def grams(text):
    c = [ql.LINE] * 3 + [fold(x) for x in text]
    return [tuple(c[i : i + 4]) for i in range(len(text))]


class Model:
    """Interpolated modified Kneser-Ney over dictionaries, one gram at a time."""

    def __init__(self, texts):
        self.levels = {4: Counter(g for t in texts for g in grams(t))}
        for k in (3, 2, 1):
            self.levels[k] = Counter(g[1:] for g in self.levels[k + 1])
        self.taken, self.total, self.held = {}, {}, {}
        for k, counts in self.levels.items():
            n = [sum(c == i for c in counts.values()) for i in range(5)]
            if all(n[1:]):
                y = n[1] / (n[1] + 2 * n[2])
                d = [min(max(i - (i + 1) * y * n[i + 1] / n[i], 0.05), i - 0.05) for i in (1, 2, 3)]
            else:
                d = [0.5, 0.75, 0.9]
            self.taken[k] = d
            self.total[k], self.held[k] = defaultdict(int), defaultdict(float)
            for g, c in counts.items():
                self.total[k][g[:-1]] += c
                self.held[k][g[:-1]] += d[min(c, 3) - 1]

    def p(self, g):
        k = len(g)
        below = self.p(g[1:]) if k > 1 else 1 / ql.CLASSES
        total = self.total[k].get(g[:-1])
        if not total:
            return below
        c = self.levels[k][g]
        own = (c - self.taken[k][min(c, 3) - 1]) / total if c else 0.0
        return own + self.held[k][g[:-1]] / total * below

    def logp(self, text):
        return sum(math.log(self.p(g)) for g in grams(text))


def brute_keep(docs, good, quantile=0.995, margin=1.5, prior=40):
    """docs: (id, text, lang); good: ids that are trusted."""
    model = Model([t or "" for i, t, _ in docs if i in good])
    logs = [(i, lang, len(t or ""), model.logp(t or "") if t else 0.0) for i, t, lang in docs]
    sums = defaultdict(lambda: [0.0, 0])
    for i, lang, n, lp in logs:
        if i in good and n:
            for key in (("lang", lang), "all"):
                sums[key][0] += lp
                sums[key][1] += n
    mean = {k: s / n for k, (s, n) in sums.items()}

    def ppl(lang, n, lp):
        m = mean.get(("lang", lang), mean.get("all", 0.0))
        return math.exp(-(lp + prior * m) / (n + prior))

    by = defaultdict(list)
    for i, lang, n, lp in logs:
        if i in good and n:
            by[("lang", lang)].append(ppl(lang, n, lp))
            by["all"].append(ppl(lang, n, lp))
    limit = {k: sorted(v)[max(0, math.ceil(quantile * len(v)) - 1)] * margin for k, v in by.items()}
    return [(i, ppl(lang, n, lp), ppl(lang, n, lp) <= limit.get(("lang", lang), limit.get("all", math.inf))) for i, lang, n, lp in logs]


def test_against_a_plain_model(spark, small_dir):
    docs = spark.read.parquet(f"{small_dir}/documents.parquet")
    labels = spark.read.parquet(f"{small_dir}/labels.parquet")
    good = {r.doc_id for r in labels.where("quality = 1").collect()}
    want = {i: (p, k) for i, p, k in brute_keep([(r.doc_id, r.text, r.lang) for r in docs.collect()], good)}
    got = ql.score(docs, labels).collect()
    assert len(got) == len(want)
    for r in got:
        assert r.perplexity == pytest.approx(want[r.id][0], rel=1e-4)
        assert r.keep == want[r.id][1]


def test_held_out_accuracy(spark):
    d = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{d}/{t}.parquet") for t in ("documents", "labels"))
    got = ql.score(docs, labels.where("doc_id % 2 = 0")).join(labels.where("doc_id % 2 = 1").withColumnRenamed("doc_id", "id"), "id").collect()
    clean, junk = [r.keep for r in got if r.quality == 1], [r.keep for r in got if r.quality == 0]
    assert sum(clean) / len(clean) >= 0.99 and sum(junk) / len(junk) <= 0.2


def test_odd_rows(nasty, empty, labels):
    got = ql.score(nasty, labels).collect()
    assert len(got) == nasty.count() and all(r.keep for r in got if r.n_grams == 0)
    assert ql.score(empty, labels).count() == 0
    assert all(r.keep for r in ql.score(nasty, labels.limit(0)).collect())  # no trusted text: all stay
    kept = ql.keep_good(nasty, labels)
    assert kept.columns == nasty.columns and kept.where("doc_id IS NULL").count() == 2
