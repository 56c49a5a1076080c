import hashlib
import re
from collections import defaultdict

import pytest

from tallyweave.llm import mixing as mx


def fill(budget, children):
    """Water-filling by rounds: children (weight, room) to amounts."""
    got, open_ = {}, dict(children)
    while open_:
        total = sum(w for w, _ in open_.values())
        if total == 0:
            got.update({c: 0.0 for c in open_})
            break
        level = budget / total
        full = {c: r for c, (w, r) in open_.items() if w > 0 and r <= w * level + 1e-9}
        if not full:
            got.update({c: w * level for c, (w, _) in open_.items()})
            break
        for c, r in full.items():
            got[c] = r
            budget -= r
            del open_[c]
    return got


def brute(rows, share, epochs, weights, seed, domain):
    n = {}
    docs = []
    for i, t, lang, source in rows:
        path = (domain(source or ""), lang or "", source or "")
        tokens = len(re.findall(r"[^ \t\n\x0b\f\r]+", t or ""))
        docs.append((i, path, tokens))
        n[path] = n.get(path, 0) + tokens
    w = lambda depth, name: weights.get(mx.LEVELS[depth], {}).get(name, 1)

    def down(prefix, budget, out):
        depth = len(prefix)
        if depth == 3:
            out[prefix] = budget
            return
        rooms = defaultdict(int)
        for p, tokens in n.items():
            if p[:depth] == prefix:
                rooms[p[depth]] += tokens * epochs
        for name, b in fill(budget, {c: (w(depth, c), r) for c, r in rooms.items()}).items():
            down((*prefix, name), b, out)

    budgets = {}
    down((), float(int(sum(n.values()) * share)), budgets)
    copies = {}
    for path in n:
        budget = int(budgets[path] + 1e-6)
        whole = budget // n[path] if n[path] else 0
        key = lambda d: hashlib.md5(f"{seed}:{whole}:{'' if d[0] is None else d[0]}".encode()).hexdigest()  # noqa: E731, B023
        upto = 0
        for d in sorted((d for d in docs if d[1] == path), key=lambda d: (key(d), d[2])):
            upto += d[2]
            copies.setdefault((d[0], path), []).append(whole + (whole < epochs and upto <= budget - whole * n[path]))
    return sorted(((i, p, c) for (i, p), cs in copies.items() for c in cs), key=str)


def run(df, **kw):
    from pyspark.sql import functions as F

    got = mx.mix(df, domain=F.when(F.col("source") < "s3", "low").otherwise("high"), **kw).collect()
    return sorted(((r.id, (r.domain, r.lang, r.source), r.copies) for r in got), key=str)


@pytest.mark.parametrize(("share", "epochs"), [(0.5, 1), (0.9, 3), (2.5, 2), (0.0, 1), (1.0, 1)])
def test_against_brute_force(spark, share, epochs):
    rows = [(i, "w " * (i * 7 % 40), ["en", "de", "fr"][i % 3 if i % 5 else 0], f"s{0 if i % 3 else i % 7}") for i in range(200)]
    weights = {"domain": {"low": 3}, "lang": {"en": 1, "de": 5, "fr": 0}, "source": {"s4": 7}}
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string")
    want = brute(rows, share, epochs, weights, 17, lambda s: "low" if s < "s3" else "high")
    assert run(df, share=share, max_epochs=epochs, weights=weights) == want


def test_shortage_goes_to_siblings_first(spark):
    leaves = [("a", "x", "1", 10), ("a", "x", "2", 500), ("a", "y", "1", 500), ("b", "x", "1", 500)]
    df = spark.createDataFrame(leaves, "domain string, lang string, source string, tokens bigint")
    got = {(r.domain, r.lang, r.source): r.budget for r in mx.budgets(df, 400 / 1510, 1, {}).collect()}
    assert got[("a", "x", "1")] == 10 and got[("a", "x", "2")] == 90  # the sibling takes the shortage
    assert got[("a", "y", "1")] == 100 and got[("b", "x", "1")] == 200


def test_odd_rows(nasty, empty):
    got = mx.mix(nasty).collect()
    assert len(got) == nasty.count() and all(0 <= r.copies <= 3 for r in got)
    assert mx.mix(empty).count() == 0
    with pytest.raises(ValueError):
        mx.mix(nasty, weights={"lang": {"en": -1}})


def test_hot_leaves_are_split(spark, monkeypatch):
    """Rows are dealt by leaf and slice; the join with a long table of leaves is salted and gives the same."""
    rows = [(i, "w " * (i % 9), "en", "s0") for i in range(120)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string")
    mixed = mx.mix(df)
    plan = mixed._jdf.queryExecution().executedPlan().toString()
    within = plan[plan.index("sum(n_tokens") :]
    assert "hashpartitioning(domain" in within and "slice" in within.split("hashpartitioning(", 1)[1].split(")", 1)[0]
    want = sorted(map(tuple, mixed.collect()))
    monkeypatch.setattr(mx, "MOST_SENT", 0)
    salted = mx.mix(df)
    assert "salt" in salted._jdf.queryExecution().toString() and sorted(map(tuple, salted.collect())) == want


def test_no_python_in_the_plan(nasty):
    plan = mx.mix(nasty)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan
