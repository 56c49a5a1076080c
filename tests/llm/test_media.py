import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyweave.llm import media as md


def images(spark, n=30, edit=False):
    draw = np.random.default_rng(4)
    rows = [(i, md.picture(draw.normal(size=32))) for i in range(n)]
    return spark.createDataFrame([(i, md.to_pgm(md.edited(p, i * 20) if edit else p)) for i, p in rows], "id bigint, image binary")


def test_copies_are_found(spark):
    known = images(spark).unionByName(images(spark).where("id = 3").withColumn("id", F.lit(99).cast("bigint")))
    got = md.find_copies(images(spark, edit=True), known).collect()
    assert {r.query_id: r.class_id for r in got} == {i: i for i in range(30)} and len(got) == 30
    assert next(r for r in got if r.query_id == 3).class_size == 2
    for r in got:  # the move is the crop's corner
        n = r.query_id * 20
        assert abs(r.dy - n // 20 % 17) <= 1.5 and abs(r.dx - n // 60 % 17) <= 1.5 and r.zoom == 1.0


def test_close_pairs_against_brute_force(spark):
    draw = np.random.default_rng(1)
    base = draw.integers(0, 1 << 62, (40, 2))
    rows = [(int(k), 0.0, 0.0, 1.0, 0.0, int(a ^ (1 << int(draw.integers(0, 62)))), int(b ^ sum(1 << int(x) for x in draw.integers(0, 62, k % 7)))) for k in range(40) for a, b in [base[k % 20]]]
    df = spark.createDataFrame(rows, "id bigint, y double, x double, scale double, angle double, d0 bigint, d1 bigint")
    got = sorted((r.a_id, r.b_id) for r in md.close_pairs(df, df).collect())
    want = sorted((a[0], b[0]) for a in rows for b in rows if (a[5] ^ b[5]).bit_count() + (a[6] ^ b[6]).bit_count() <= md.MOST_BITS)
    assert got == want and len(got) > 40
    with pytest.raises(ValueError):
        md.close_pairs(df, df, md.MOST_BITS + 1)


def test_recall_over_a_table(spark):
    got = md.query(spark, "/root/testdata/sf0.01").collect()
    own = [r.vec_id for r in got if r.best_class == r.vec_id]
    assert len(got) == 25 and len(own) >= 0.9 * len(got) and sum(r.n_classes for r in got) <= 1.1 * len(got)


def test_turned_and_darkened(spark):
    p = md.picture(np.random.default_rng(9).normal(size=32))
    turned = np.rot90(p).copy()
    df = lambda i, x: spark.createDataFrame([(i, md.to_pgm(x))], "id bigint, image binary")
    got = md.find_copies(df(1, turned), df(2, p)).first()
    assert got.class_id == 2


def test_one_id_with_several_images(spark):
    """Images that share an id are described, asked for and found each by itself, once."""
    draw = np.random.default_rng(12)
    a, b, c = (md.picture(draw.normal(size=32)) for _ in range(3))
    schema = "id bigint, image binary"
    known = spark.createDataFrame([(5, md.to_pgm(a)), (5, md.to_pgm(b)), (7, md.to_pgm(c)), (8, md.to_pgm(a))], schema)
    asked = spark.createDataFrame([(1, md.to_pgm(md.edited(a, 40))), (2, md.to_pgm(md.edited(b, 60))), (3, md.to_pgm(md.edited(c, 80))), (3, md.to_pgm(md.edited(b, 100)))], schema)
    got = sorted((r.query_id, r.class_id, r.class_size) for r in md.find_copies(asked, known).collect())
    assert got == [(1, 5, 2), (2, 5, 1), (3, 5, 1), (3, 7, 1)]


def test_rescaled_copies(spark):
    """A copy of half the size, and one of twice, are found across scales."""
    draw = np.random.default_rng(21)
    big = [np.kron(md.picture(draw.normal(size=32))[::2, ::2], np.ones((4, 4), np.uint8)) for _ in range(4)]
    half = [((p[::2, ::2].astype(int) + p[1::2, ::2] + p[::2, 1::2] + p[1::2, 1::2]) // 4).astype(np.uint8) for p in big]
    as_df = lambda ps: spark.createDataFrame([(i, md.to_pgm(p)) for i, p in enumerate(ps)], "id bigint, image binary")
    for asked, known, zoom in ((half, big, 2.0), (big, half, 0.5)):
        got = md.find_copies(as_df(asked), as_df(known)).collect()
        assert [(r.query_id, r.class_id, r.zoom) for r in sorted(got, key=lambda r: r.query_id)] == [(i, i, zoom) for i in range(4)]


def test_odd_images(spark):
    flat = md.to_pgm(np.full((90, 90), 7, np.uint8))
    rows = [(1, None), (2, b""), (3, b"P5 9 9 255\nshort"), (4, flat), (5, flat), (6, md.to_pgm(np.zeros((3, 3), np.uint8))), (None, flat), (4, flat)]
    df = spark.createDataFrame(rows, "id bigint, image binary").selectExpr("*", "'c' AS y", "'c' AS votes")
    got = {r.query_id: r.class_id for r in md.find_copies(df, df).collect()}
    assert got == {1: 1, 2: 1, 3: 3, 4: 4, 5: 4, 6: 6}  # identical bytes only
    assert md.find_copies(df.limit(0), df).count() == 0
    assert all(r.class_id is None for r in md.find_copies(df, df.limit(0)).collect())
    assert md.describe(md.from_pgm(flat)) == [] and md.from_pgm(None) is None
    assert md.picture(np.zeros(0)).shape == (md.GRID * md.SQUARE,) * 2


def test_empty_and_null_vectors(spark):
    df = spark.createDataFrame([(0, None), (20, []), (40, [1.0, float("nan")])], "vec_id bigint, embedding array<float>")
    assert md.pictures(df).count() == 3 and md.pictures(df, edit=True).count() == 3
