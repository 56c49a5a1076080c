import hashlib

import pytest
from pyspark.sql import functions as F

from tallyweave.llm import sketch as sk


def shingles(t, k=sk.WORDS):
    w = (t or "").lower().split()
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def likeness(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def test_edits_and_estimates(spark, small_dir):
    docs = spark.read.parquet(f"{small_dir}/documents.parquet").select("doc_id", "text")
    rows = sorted((r.doc_id, r.text or "") for r in docs.collect())
    got = {r.doc_id: r for r in sk.query(spark, small_dir).collect()}
    off = []
    for n, (i, t) in enumerate(rows):
        after = rows[(n + 1) % len(rows)][1]
        half = len(t) // 2
        edit = t[: len(t) - half] + after[:half]
        g = got[i]
        assert g.n_chars == len(t) and g.edited_sha256 == hashlib.sha256(edit.encode()).hexdigest()
        off.append(abs(g.near_edited - likeness(shingles(t), shingles(edit))))
        assert 0 <= g.near_next <= 1 and 0 <= g.near_edited <= 1
    assert sum(off) / len(off) < 0.06


def test_equal_texts_have_equal_fingerprints(spark):
    rows = [(1, "a b c d e f g"), (2, "a b c d e f g"), (3, "a b c d e f h")]
    got = {r.doc_id: r.f for r in spark.createDataFrame(rows, "doc_id int, text string").select("doc_id", sk.fingerprint(sk.sketch(F.col("text"))).alias("f")).collect()}
    assert got[1] == got[2] != got[3]


def test_merge_and_containment(spark):
    a, b = " ".join(f"w{i}" for i in range(3000)), " ".join(f"w{i}" for i in range(1000, 1500))
    row = spark.createDataFrame([(a, b)], "a string, b string").select(sk.sketch(F.col("a")).alias("a"), sk.sketch(F.col("b")).alias("b"))
    got = row.select(sk.containment(F.col("b"), F.col("a")).alias("in"), sk.containment(F.col("a"), F.col("b")).alias("out"), sk.likeness(sk.merge(F.col("a"), F.col("b")), F.col("a")).alias("m")).first()
    assert got["in"] == 1.0 and got["out"] == pytest.approx(496 / 2996, abs=0.05) and got.m == 1.0


@pytest.mark.parametrize(("m", "n"), [(100, 100), (100, 5000), (1, 3), (0, 4), (0, 0), (1, 1)])
def test_merging_is_sketching_all(spark, m, n):
    """The merge of two sketches is the sketch of both texts' shingles, whatever their sizes."""
    a, b = " ".join(f"a{i}" for i in range(m + 4 * (m > 0))), " ".join(f"b{i}" for i in range(n + 4 * (n > 0)))
    row = spark.createDataFrame([(a, b)], "a string, b string")
    both = sk.kept(F.concat(sk.shingle_hashes(F.col("a")), sk.shingle_hashes(F.col("b"))))
    got = row.select(sk.merge(sk.sketch(F.col("a")), sk.sketch(F.col("b"))).alias("merged"), both.alias("both")).first()
    assert got.merged == got.both and (len(got.both) > 0) == (m + n > 0)


def test_odd_rows(nasty, empty, spark):
    got = sk.fingerprints(nasty).collect()
    assert len(got) == nasty.count()
    rows = sorted(((r.doc_id is not None, r.doc_id or 0), r.text or "") for r in nasty.collect())
    assert sorted(r.n_chars for r in got) == sorted(len(t) for _, t in rows)
    assert sk.fingerprints(empty).count() == 0
    one = sk.fingerprints(spark.createDataFrame([(1, "abcdef")], "doc_id bigint, text string")).first()
    assert one.edited == "abcabc"  # the only document follows itself


def test_no_python_in_the_plan(spark, small_dir):
    plan = sk.query(spark, small_dir)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan
