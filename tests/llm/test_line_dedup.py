import hashlib
from collections import defaultdict

from tallyweave.llm import line_dedup as ld

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, min_chars=40, min_docs=5):
    key = lambda s: s.strip(" \t\n\x0b\x0c\r").translate(LOWER)
    held = defaultdict(set)
    for i, t in rows:
        if i is not None:
            for s in (t or "").split("\n"):
                if len(key(s)) >= min_chars:
                    held[key(s)].add(i)
    keeper = {k: max(d) for k, d in held.items() if len(d) >= min_docs}
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [s for s in lines if i is None or keeper.get(key(s), i) <= i]
        out.append((i, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out, key=str)


def run(df, **kw):
    from pyspark.sql import functions as F

    got = ld.dedup_lines(df, **kw).select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept_text").cast("binary"), 256))
    return sorted(map(tuple, got.collect()), key=str)


def test_against_brute_force(spark, nasty, empty):
    base = "Ein Satz, der lang genug ist, um als Zeile zu zählen %d"
    rows = [(i, "\n".join([base % (k % 7) if k % 3 else f"  {(base % (k % 7)).upper()}\t" for k in range(i % 5, i % 5 + 4)] + [f"own {i}"] * 70 + [base % 1])) for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert run(df) == brute(rows)
    assert run(df, min_docs=2, min_chars=3) == brute(rows, 3, 2)
    assert run(nasty.select("doc_id", "text")) == brute([(r.doc_id, r.text) for r in nasty.collect()])
    assert run(nasty, min_docs=1, min_chars=1) == brute([(r.doc_id, r.text) for r in nasty.collect()], 1, 1)
    assert run(empty) == []


def test_hot_and_other_keys_agree(spark, monkeypatch):
    """Verdicts that are sent to the lines and verdicts that meet them by hash are the same."""
    rows = [(i, "\n".join([f"a line that everybody has, long enough to count {k}" for k in range(i % 4 + 1)])) for i in range(30)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    for hot in (1, 3, 4096):
        monkeypatch.setattr(ld, "HOT", hot)
        assert run(df) == brute(rows)


def test_bitmaps_are_sparse(spark):
    rows = [(i, "\n".join([f"{i} {k}" for k in range(200)] + ["a line that everybody has, long enough to count"])) for i in range(6)]
    maps = ld.drop_bitmaps(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert len(maps) == 5 and all([(w.word, w.bits) for w in m.words] == [(3, 1 << 8)] for m in maps)


def test_no_python_in_the_plan(nasty):
    plan = ld.dedup_lines(nasty)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan
