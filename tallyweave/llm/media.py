"""Media columns: local image descriptors that find cropped or edited copies.

Images are binary grey maps (PGM, P5) in a column.  Corners are found at several scales by the smaller
eigenvalue of the gradient matrix; each is described by 124 brightness tests in a disc turned to its
orientation, so equal detail gives equal bits whatever its place, brightness or rotation.  The bits are cut into
four tables of 31; descriptors that differ in at most three bits agree in one table at least, so joining
the tables finds every such pair.  Matches vote for the move that takes one image to the other, and a
pair counts as a copy when enough of them agree.

Identical images are described and searched once; a result names the smallest id of its class.  An image is
told by its ``CORNERS`` strongest corners a scale, as its signature: the number bounds what an image sends.

Contract for odd input: a null, empty or broken image, or one smaller than a disc, has no corners and
matches only identical bytes, if any; flat images have no corners; an empty table gives an empty
result; rows without an id are not searched for or found; rows that share an id and have different images are searched
and found as the images they are; other columns are never read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyweave.llm.common import materialize, small_batches, table

HEADER = re.compile(rb"\AP5\s+(?:#.*\n\s*)*(\d+)\s+(\d+)\s+255\s", re.A)
#: Corners of an image, strongest first; radius of the disc; scales by halving.
CORNERS, RADIUS, SCALES = 32, 19, 2
TABLES, TABLE_BITS = 4, 31
TESTS = TABLES * TABLE_BITS
#: Descriptors of a pair differ in at most this many bits: one less than there are tables.
MOST_BITS = TABLES - 1


def to_pgm(pixels: np.ndarray) -> bytes:
    return b"P5 %d %d 255\n" % (pixels.shape[1], pixels.shape[0]) + pixels.astype(np.uint8).tobytes()


def from_pgm(data: bytes | None) -> np.ndarray | None:
    if not data or not (m := HEADER.match(data)):
        return None
    w, h = int(m[1]), int(m[2])
    body = data[m.end() : m.end() + w * h]
    return np.frombuffer(body, np.uint8).reshape(h, w) if w and h and len(body) == w * h else None


def _box(a: np.ndarray, r: int) -> np.ndarray:
    """Sums over squares of radius ``r``; the border is left out as zero."""
    n = 2 * r + 1
    c = np.zeros((a.shape[0] + 1, a.shape[1] + 1))
    c[1:, 1:] = a.cumsum(0).cumsum(1)
    out = np.zeros(a.shape)
    out[r : a.shape[0] - r, r : a.shape[1] - r] = c[n:, n:] - c[:-n, n:] - c[n:, :-n] + c[:-n, :-n]
    return out


@cache
def _tests() -> np.ndarray:
    """End points (y, x) of each test within the disc, from a fixed seed."""
    draw = np.random.default_rng(41)
    ends = np.clip(draw.normal(0, RADIUS / 2.2, (TESTS, 2, 2)), -RADIUS * 0.68, RADIUS * 0.68)
    return ends


@cache
def _disc() -> tuple[np.ndarray, np.ndarray]:
    y, x = np.mgrid[-RADIUS : RADIUS + 1, -RADIUS : RADIUS + 1]
    inside = y * y + x * x <= RADIUS * RADIUS
    return y[inside], x[inside]


def _corners(a: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(y, x, strength) of local maxima far enough from the border."""
    gy, gx = np.zeros(a.shape), np.zeros(a.shape)
    gy[1:-1], gx[:, 1:-1] = a[2:] - a[:-2], a[:, 2:] - a[:, :-2]
    yy, xx, xy = _box(gy * gy, 2), _box(gx * gx, 2), _box(gx * gy, 2)
    strength = (yy + xx) / 2 - np.sqrt(((yy - xx) / 2) ** 2 + xy * xy)
    strength = np.round(strength, 3)
    edge = RADIUS + 1
    inner = strength[edge:-edge, edge:-edge]
    top = np.ones(inner.shape, bool)
    for dy in range(-3, 4):
        for dx in range(-3, 4):
            if dy or dx:
                near = strength[edge + dy : strength.shape[0] - edge + dy, edge + dx : strength.shape[1] - edge + dx]
                top &= (inner > near) if (dy, dx) > (0, 0) else (inner >= near)
    y, x = np.nonzero(top & (inner > 500))
    return y + edge, x + edge, inner[y, x]


def describe(image: np.ndarray | None) -> list[tuple[float, float, float, float, int, int]]:
    """``(y, x, scale, angle, bits 0-61, bits 62-123)`` of the strongest corners, in full-size pixels."""
    if image is None:
        return []
    found: list[tuple[float, float, float, float, float, int, int]] = []
    level = image.astype(float)
    for octave in range(SCALES):
        if min(level.shape) < 2 * RADIUS + 6:
            break
        y, x, strength = _corners(level)
        if len(y):
            by = np.argsort(-strength, kind="stable")[:CORNERS]
            y, x, strength = y[by], x[by], strength[by]
            dy, dx = _disc()
            patch = level[y[:, None] + dy, x[:, None] + dx]
            patch = patch - patch.mean(1, keepdims=True)
            angle = np.arctan2(patch @ dy, patch @ dx)
            turn = np.round(angle / (np.pi / 16)) * (np.pi / 16)
            c, s = np.cos(turn)[:, None, None], np.sin(turn)[:, None, None]
            ends = _tests()
            ty = np.rint(ends[:, :, 0] * c + ends[:, :, 1] * s).astype(int) + y[:, None, None]
            tx = np.rint(ends[:, :, 1] * c - ends[:, :, 0] * s).astype(int) + x[:, None, None]
            smooth = _box(level, 1)
            light = smooth[ty, tx]
            bits = light[:, :, 0] > light[:, :, 1] + 9
            half = TESTS // 2
            weight = 1 << np.arange(half, dtype=np.int64)
            low, high = bits[:, :half] @ weight, bits[:, half:] @ weight
            scale = 2.0**octave
            found += zip(strength * scale, (y + 0.5) * scale, (x + 0.5) * scale, [scale] * len(y), turn, low, high, strict=True)
        h, w = level.shape[0] // 2 * 2, level.shape[1] // 2 * 2
        level = (level[:h:2, :w:2] + level[1:h:2, :w:2] + level[:h:2, 1:w:2] + level[1:h:2, 1:w:2]) / 4
    return [(float(y), float(x), float(s), float(t), int(a), int(b)) for _, y, x, s, t, a, b in found]


def descriptors(images: DataFrame) -> DataFrame:
    """``id, y, x, scale, angle, d0, d1`` from rows of (id, image)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(i, *d) for i, data in zip(batch["id"], batch["image"], strict=True) for d in describe(from_pgm(data))]
            yield pd.DataFrame(rows, columns=["id", "y", "x", "scale", "angle", "d0", "d1"])

    return small_batches(images).select("id", "image").mapInPandas(run, "id bigint, y double, x double, scale double, angle double, d0 bigint, d1 bigint")


def _chunk(d0: Column, d1: Column, t: int) -> Column:
    return F.shiftright(d0 if t < TABLES // 2 else d1, TABLE_BITS * (t % (TABLES // 2))).bitwiseAND((1 << TABLE_BITS) - 1)


def close_pairs(left: DataFrame, right: DataFrame, most_bits: int = MOST_BITS) -> DataFrame:
    """All pairs of descriptors within ``most_bits``, each once: found in the first table they share."""
    if most_bits > MOST_BITS:
        raise ValueError(f"the tables find pairs within {MOST_BITS} bits")

    def tabled(df: DataFrame, prefix: str) -> DataFrame:
        keys = F.array(*[_chunk(F.col("d0"), F.col("d1"), t) for t in range(TABLES)])
        df = df.select(F.posexplode(keys).alias("t", "key"), "*")
        return df.select("t", "key", *[F.col(c).alias(prefix + c) for c in ("id", "y", "x", "scale", "angle", "d0", "d1")])

    pairs = tabled(left, "a_").join(tabled(right, "b_"), ["t", "key"])
    x0, x1 = F.col("a_d0").bitwiseXOR(F.col("b_d0")), F.col("a_d1").bitwiseXOR(F.col("b_d1"))
    first = F.lit(True)
    for t in range(TABLES - 1):
        first = first & ((F.col("t") <= t) | (_chunk(x0, x1, t) != 0))
    return pairs.where(first & (F.bit_count(x0) + F.bit_count(x1) <= most_bits))


def agreeing(pairs: DataFrame, least_votes: int = 1, reach: float = 4.0) -> DataFrame:
    """``a_id, b_id, votes, dy, dx, zoom``: the move most of a pair's matches agree on.

    Each match tells zoom and turn, and with them where the first image's origin comes to lie.  A move's
    votes are the corners whose matches put it within ``reach`` pixels.  A pair of images has at most as
    many matches as pairs of corners, which bounds the list that is compared with itself.
    """
    zoom = F.col("b_scale") / F.col("a_scale")
    turn = F.col("b_angle") - F.col("a_angle")
    oy = F.col("b_y") - zoom * (F.col("a_y") * F.cos(turn) + F.col("a_x") * F.sin(turn))
    ox = F.col("b_x") - zoom * (F.col("a_x") * F.cos(turn) - F.col("a_y") * F.sin(turn))
    move = F.struct("a_y", "a_x", F.round(F.log2(zoom)).cast("int").alias("z"), F.pmod(F.round(turn / (np.pi / 6)).cast("int"), F.lit(12)).alias("r"), oy.alias("oy"), ox.alias("ox"))
    lists = pairs.groupBy("a_id", "b_id").agg(F.collect_list(move).alias("m")).where(F.size("m") >= least_votes)

    def told(p: Column) -> Column:
        near = F.filter("m", lambda q: (q["z"] == p["z"]) & (q["r"] == p["r"]) & (F.abs(q["oy"] - p["oy"]) <= reach) & (F.abs(q["ox"] - p["ox"]) <= reach))
        votes = F.size(F.array_distinct(F.transform(near, lambda q: F.struct(q["a_y"], q["a_x"]))))
        return F.struct(votes.cast("long").alias("votes"), (-F.abs(p["z"])).alias("still"), F.round(p["oy"], 1).alias("dy"), F.round(p["ox"], 1).alias("dx"), p["z"].alias("z"))

    best = lists.select("a_id", "b_id", F.array_max(F.transform("m", told)).alias("t"))
    return best.select("a_id", "b_id", "t.votes", "t.dy", "t.dx", F.pow(F.lit(2.0), F.col("t.z")).alias("zoom"))


def find_copies(queries: DataFrame, images: DataFrame, least_votes: int = 6) -> DataFrame:
    """``query_id, class_id, class_size, votes, dy, dx, zoom``: one row for each class of identical images a
    query is a copy of; a query that is no copy of any has one row of nulls.  Inputs: rows of (id, image)."""
    known, classes = _classes(images, "class_id")
    asked, asked_classes = _classes(queries, "ask_id")
    # Of identical images one is described, under its class: classes go by bytes, never by id alone.
    one = known.select("bytes", "image").join(classes.select("bytes", F.col("class_no").alias("id")), "bytes").dropDuplicates(["bytes"]).select("id", "image")
    ask = asked.select("bytes", "image").join(asked_classes.select("bytes", F.col("class_no").alias("id")), "bytes").dropDuplicates(["bytes"]).select("id", "image")
    moves = agreeing(close_pairs(materialize(descriptors(ask)), materialize(descriptors(one))), least_votes).where(F.col("votes") >= least_votes)
    same = asked_classes.join(classes.select("bytes", F.col("class_no").alias("b_no")), "bytes").select(F.col("class_no").alias("a_id"), F.col("b_no").alias("b_id"), F.lit(True).alias("same"))
    found = classes.select(F.col("class_no").alias("b_id"), "class_id", "class_size")
    hits = moves.join(same, ["a_id", "b_id"], "full").join(found, "b_id").withColumnRenamed("a_id", "class_no")
    members = asked.select(F.col("id").alias("query_id"), "bytes").join(asked_classes.select("bytes", "class_no"), "bytes")
    out = members.join(hits, "class_no", "left")
    return out.select("query_id", "class_id", "class_size", F.coalesce("votes", F.lit(0).cast("long")).alias("votes"), "dy", "dx", "zoom", F.coalesce("same", F.lit(False)).alias("identical"))


def _classes(images: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
    """The rows with an id and their ``bytes`` digest; and per digest ``class_no``, smallest id and size.

    ``class_no`` is a hash of the digest: two images that share an id stay two classes.
    """
    rows = images.where("id IS NOT NULL").withColumn("bytes", F.sha2(F.coalesce("image", F.lit(b"")), 256))
    classes = rows.groupBy("bytes").agg(F.min("id").alias(name), F.count("*").alias("class_size"))
    return rows, materialize(classes.withColumn("class_no", F.xxhash64("bytes")))


# --- the production query's images ----------------------------------------------------------------------

#: A vector's picture: GRID by GRID squares of SQUARE pixels, each square's brightness a fixed random
#: projection of the vector.
GRID, SQUARE = 16, 8


@cache
def _projection(length: int) -> np.ndarray:
    return np.random.default_rng(97).normal(size=(GRID * GRID, length))


def picture(vector: np.ndarray) -> np.ndarray:
    v = np.nan_to_num(np.asarray(vector, float))
    cells = _projection(len(v)) @ v if len(v) else np.zeros(GRID * GRID)
    spread = np.abs(cells).max() or 1.0
    grey = np.rint(127.5 + 120 * cells / spread).astype(np.uint8)
    return np.kron(grey.reshape(GRID, GRID), np.ones((SQUARE, SQUARE), np.uint8))


def edited(image: np.ndarray, number: int) -> np.ndarray:
    """A crop of at least three quarters of each side, darkened, with a caption bar; all by ``number``."""
    h, w = image.shape
    top, left = number // 20 % (h // 8 + 1), number // 60 % (w // 8 + 1)
    out = image[top : h - number // 7 % (h // 8 + 1), left : w - number // 11 % (w // 8 + 1)].copy()
    out = np.rint(out * 0.85 + 10).astype(np.uint8)
    out[-8:, : out.shape[1] // 2] = 250
    return out


def pictures(vectors: DataFrame, edit: bool = False, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``id, image``: each vector drawn; with ``edit``, a cropped and edited copy of it."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            drawn = [picture(v if v is not None else np.zeros(0)) for v in batch["v"]]
            yield pd.DataFrame({"id": batch["id"], "image": [to_pgm(edited(p, int(i)) if edit and p.size else p) for i, p in zip(batch["id"], drawn, strict=True)]})

    return vectors.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v")).mapInPandas(run, "id bigint, image binary")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edited copies of every twentieth picture, searched for among all pictures; one row for each query.

    ``class_ids`` and ``class_votes`` hold all classes that were found, best first.
    """
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    hits = find_copies(pictures(vectors.where("vec_id % 20 = 0"), edit=True), pictures(vectors))
    found = F.filter(F.sort_array(F.collect_list(F.struct("votes", (-F.col("class_id")).alias("c"), "class_size", "dy", "dx", "zoom")), asc=False), lambda x: x["c"].isNotNull())
    best = F.get("found", F.lit(0))
    out = hits.groupBy(F.col("query_id").alias("vec_id")).agg(found.alias("found"))
    return out.select(
        "vec_id",
        F.size("found").cast("long").alias("n_classes"),
        (-best["c"]).alias("best_class"),
        best["votes"].alias("best_votes"),
        *[best[c].alias(c) for c in ("dy", "dx", "zoom")],
        F.transform("found", lambda x: -x["c"]).alias("class_ids"),
        F.transform("found", lambda x: x["votes"]).alias("class_votes"),
        F.aggregate("found", F.lit(0).cast("long"), lambda a, x: a + x["class_size"]).alias("n_members"),
    )
