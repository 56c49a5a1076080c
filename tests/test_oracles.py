import sys; sys.path.insert(0, str(__import__("pathlib").Path(__file__).parent))
import pytest

from oracle import bags, connect
from tallyweave.plans import registry

TWINS, QUERIES = registry.oracle_sql(), registry.queries()


@pytest.fixture(scope="module")
def con(small_dir):
    return connect(small_dir)


@pytest.mark.parametrize("name", sorted(TWINS))
def test_twin(name, spark, small_dir, con):
    got, want = bags(QUERIES[name], TWINS[name], spark, small_dir, con)
    assert got == want


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(TWINS)))
def test_runs_without_twin(name, spark, small_dir):
    assert QUERIES[name](spark, small_dir).count() > 0


def test_label_lines_with_long_numbers(spark, tmp_path):
    # a number of the prose is no amount, whatever its length; the amount set at a line's end is one
    texts = [(1, "Sh. Ndth. 4644348398010899\nAra toplam 1.250,00"), (2, "a b\nc d\n5000 e f")]
    spark.createDataFrame(texts, "doc_id bigint, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got, want = bags(QUERIES["p4_text_lines"], TWINS["p4_text_lines"], spark, str(tmp_path), connect(str(tmp_path)))
    assert got == want and len(got) > 1


def test_suppliers_alike_are_ranked_once(spark, tmp_path):
    # 400 suppliers of six kinds, one without a balance, one without a nation, one key with two rows
    from tallyweave.plans import linking

    suppliers = [(i, i % 2, 250.0 + 500 * (i % 3)) for i in range(400)] + [(900, 1, None), (901, None, 10.0), (902, 0, 100.0), (902, 1, 100.0)]
    customers = [(i, i % 3, 13.0 * (i * 37 % 120)) for i in range(90)] + [(500, 0, None)]
    spark.createDataFrame(suppliers, "s_suppkey bigint, s_nationkey int, s_acctbal double").write.parquet(str(tmp_path / "supplier.parquet"))
    spark.createDataFrame(customers, "c_custkey bigint, c_nationkey int, c_acctbal double").write.parquet(str(tmp_path / "customer.parquet"))
    assert linking._ranked(spark, str(tmp_path)).count() < 10 * len(customers)
    for name in ("t5_rank_fusion", "k1_top_k_and_anchors", "k7_best_twin_rank", "t11_recall_at_5"):
        got, want = bags(QUERIES[name], TWINS[name], spark, str(tmp_path), connect(str(tmp_path)))
        assert got == want, name


def test_lines_without_a_top(spark, tmp_path):
    # a line whose part is missing has no top: it lies in the last block, as in SQL; lines alike share one
    rows = [(1, 1, 5), (1, 3, 5), (1, 2, None), (2, None, 7), (2, 1, 7), (2, 4, 7), (2, 4, 7), (3, 1, None), (None, 1, 3), (None, 5, 3)]
    spark.createDataFrame(rows, "l_orderkey bigint, l_linenumber int, l_partkey bigint").write.parquet(str(tmp_path / "lineitem.parquet"))
    got, want = bags(QUERIES["w14_heading_blocks"], TWINS["w14_heading_blocks"], spark, str(tmp_path), connect(str(tmp_path)))
    assert got == want and len(got) == 7


def test_dense_over_tiles(spark, tmp_path, monkeypatch):
    # many tiles, equal vectors in all of them, a vector without length and one that is missing
    import numpy as np
    from pyspark.sql import functions as F

    from tallyweave.operators import linking as lk

    rng = np.random.default_rng(8)
    vecs = [rng.standard_normal(8).round(1).tolist() for _ in range(300)]
    rows = [(i, vecs[7] if i % 3 == 0 else vecs[i]) for i in range(300)] + [(320, vecs[1]), (321, None)]
    spark.createDataFrame(rows, "vec_id bigint, embedding array<float>").write.parquet(str(tmp_path / "embeddings.parquet"))
    monkeypatch.setattr(lk, "TILE_VECTORS", 40)
    monkeypatch.setattr(lk, "TILE_QUERIES", 5)
    got, want = bags(QUERIES["t4_dense_top5"], TWINS["t4_dense_top5"], spark, str(tmp_path), connect(str(tmp_path)))
    assert got == want and len(got) == 80
    e = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 0.0]), (2, None), (3, [1.0, 1.0])], "id bigint, vec array<double>")
    near = lk.nearest_vectors(e.where("id IN (0, 2)"), e).orderBy("q_id", "rank").select("q_id", "vec_id").collect()
    assert [tuple(r) for r in near] == [(0, 1), (0, 0), (0, 3), (0, 2), (2, 0), (2, 1), (2, 2), (2, 3)]


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
