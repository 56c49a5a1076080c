from pyspark.sql import functions as F

from tallyweave.llm import urls as ur

CASES = [
    ("http://Example.COM/en/1", "example.com", "/en/1", "example.com/en/", "block"),
    ("https://www.example.com/en/1?x", "www.example.com", "/en/1", "www.example.com/en/", "allow"),
    ("https://a.www.example.com/en/#t", "a.www.example.com", "/en/", "www.example.com/en/", "allow"),
    ("http://notexample.com/en/", "notexample.com", "/en/", "com/", "allow"),
    ("http://x.net/es/1", "x.net", "/es/1", "net/es/", "block"),
    ("http://x.net/fr/1", "x.net", "/fr/1", "net/fr/", "block"),
    ("http://x.net/de/1", "x.net", "/de/1", None, None),
    ("http://x.com?q=/", "x.com", "", None, None),
    ("http://x.com", "x.com", "", None, None),
    ("x.com/en/", "", "", None, None),
    (None, "", "", None, None),
    ("://", "", "", None, None),
    ("http://a.com/b://c.net/es/", "a.com", "/b://c.net/es/", "com/", "allow"),
    ("http://ÇA.COM/en/", "Ça.com", "/en/", "com/", "allow"),
]


def test_hosts_paths_and_rules(spark):
    df = spark.createDataFrame([(i, c[0]) for i, c in enumerate(CASES)], "i int, url string")
    host, path = ur.host_and_path(F.col("url"))
    got = df.select("i", host.alias("h"), path.alias("p")).withColumn("m", ur.matched_rule(F.col("h"), F.col("p"))).orderBy("i").collect()
    for r, (_, h, p, rule, verdict) in zip(got, CASES, strict=True):
        assert (r.h, r.p, r.m and r.m.rule, r.m and r.m.verdict) == (h, p, rule, verdict)


def best_cut(run, counts, total):
    import math

    def cost(w):
        n = counts.get(w, 0)
        return math.log(n / total) if n else math.log(10 / total) - len(w) * math.log(10)

    cuts = [[run]] + [[run[:i], *rest] for i in range(1, len(run)) for rest in all_cuts(run[i:])]
    return max(cuts, key=lambda ws: sum(map(cost, ws)))


def all_cuts(s):
    return [[s]] + [[s[:i], *r] for i in range(1, len(s)) for r in all_cuts(s[i:])]


def test_segmentation_is_the_best_cut(spark):
    counts = {"casino": 5, "win": 40, "the": 900, "he": 100, "then": 30, "spam": 3, "farm": 3, "in": 500, "a": 700}
    model = spark.createDataFrame(list(counts.items()), "word string, n bigint")
    runs = ["casinowin", "spamfarm", "thenhe", "winthe", "xyzzy", "a" * 80]
    got = {r.run: r.words for r in ur.segment(spark.createDataFrame([(r,) for r in runs], "run string"), model).collect()}
    for r in runs[:-1]:
        assert got[r] == best_cut(r, counts, sum(counts.values())), r
    assert got["casinowin"] == ["casino", "win"] and got["a" * 80] == ["a"] * 80


def tokens(words, path):
    import re

    return [*words, *("/" + re.sub("[0-9]+", "0", w) for w in re.split("[^a-z0-9]+", path.lower()) if w)]


def test_scores_against_plain_naive_bayes(spark):
    """Log-odds and verdicts from plain counts over the same words; tokens do not share places here."""
    import math
    import zlib
    from collections import Counter

    got = ur.judge(spark.read.parquet("/root/testdata/sf0.01/pages.parquet")).collect()
    out = lambda r: zlib.crc32(str(r.id).encode()) % 5 == 0
    taught = [(r.verdict == "block", tokens(r.words, r.path)) for r in got if r.rule and not out(r)]
    counts = {bad: Counter(t for b, ts in taught if b == bad for t in ts) for bad in (True, False)}
    known = set(counts[True]) | set(counts[False])
    total = {bad: sum(c.values()) + 0.05 * len(known) for bad, c in counts.items()}
    bads = sum(b for b, _ in taught)
    prior = math.log((bads + 1) / (len(taught) - bads + 1))
    for r in got:
        odds = prior + sum(math.log((counts[True][t] + 0.05) / total[True]) - math.log((counts[False][t] + 0.05) / total[False]) for t in tokens(r.words, r.path) if t in known)
        assert abs(r.log_odds - odds) < 1e-6 and r.held_out == bool(r.rule and out(r))
        assert r.rule or r.verdict == ("block" if odds > 0 else "allow")


def test_agrees_with_rules_it_has_not_seen(spark):
    got = ur.query(spark, "/root/testdata/sf0.1").where("held_out").collect()
    agree = sum((r.log_odds > 0) == (r.verdict == "block") for r in got) / len(got)
    assert len(got) > 100 and agree >= 0.85, agree


def test_odd_rows(spark):
    rows = [(i, c[0], "<p>the casino</p>") for i, c in enumerate(CASES)] + [(None, None, None), (3, "http://x.net/de", None), (3, "http://x.net/de", None), (4, "http://" + "q" * 5000 + ".net/" + "p/" * 5000, "")]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string").selectExpr("*", "'c' AS host", "'c' AS id", "'c' AS words", "'c' AS path")
    got = ur.judge(df).collect()
    assert len(got) == len(rows) and all(r.verdict in ("allow", "block") for r in got)
    assert ur.judge(df.limit(0)).count() == 0
