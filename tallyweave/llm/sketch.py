"""Document fingerprints: threshold-scaled sketches of word shingles, in DataFrame functions only.

A sketch keeps every distinct shingle hash below one fixed fraction of the hash space, whatever the text's
length, so sketches merge by union and compare without bias even when one text is far longer.  The
smallest hash is kept too where it is not below: so texts that are too short to have one below still have a sketch,
and it merges as well (the smallest of a union is the smallest of the smallest).  Only hashes below the
fraction are counted when two sketches are compared, but where both have none their smallest are.

Contract for odd input: a null text is empty; a text of fewer words than a shingle is one shingle, one
without words has an empty sketch; two empty sketches are alike (1.0), an empty and a filled one are not
(0.0); documents follow one another by id (nulls first) and then by a hash of their text, and identical
rows are one document whose result is repeated; other columns are never read.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyweave.llm.common import materialize, pieces, table

#: Words in a shingle; one hash in SCALE is kept.
WORDS, SCALE = 5, 4
#: Hashes are signed: kept ones lie in the lowest part of their range.
LIMIT = -(1 << 63) + (1 << 64) // SCALE


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once however often it is used."""
    return F.transform(F.array(value), use)[0]


def shingle_hashes(text: Column, k: int = WORDS) -> Column:
    """Hash of each run of ``k`` words, with repeats; fewer words make one."""
    words = F.filter(F.split(F.lower(text), r"\s+"), lambda w: w != "")

    def runs(h: Column) -> Column:
        several = F.transform(F.sequence(F.lit(0), F.size(h) - k), lambda i: F.xxhash64(*[F.get(h, i + j) for j in range(k)]))
        return F.when(F.size(h) >= k, several).when(F.size(h) > 0, F.array(F.xxhash64(h))).otherwise(F.expr("cast(array() as array<bigint>)"))

    return let(F.transform(words, lambda w: F.xxhash64(w)), runs)


def sketch(text: Column, k: int = WORDS) -> Column:
    """Array of the kept hashes, distinct and ascending."""
    return let(shingle_hashes(text, k), kept)


def kept(hashes: Column) -> Column:
    """Of hashes those below the limit, or the smallest alone."""

    def or_least(low: Column) -> Column:
        return F.when((F.size(low) > 0) | (F.size(hashes) == 0), F.sort_array(F.array_distinct(low))).otherwise(F.array(F.array_min(hashes)))

    return let(below(hashes), or_least)


def below(hashes: Column) -> Column:
    return F.filter(hashes, lambda x: x < LIMIT)


def merge(a: Column, b: Column) -> Column:
    """The sketch of the shingles of two texts together."""
    return let(F.array_union(a, b), kept)


def _shared(a: Column, b: Column, use: Callable[[Column, Column, Column], Column]) -> Column:
    """``use(size of a, size of b, size of both)``, over hashes below the limit where either has any."""
    low = F.struct(below(a).alias("x"), below(b).alias("y"))
    whole = F.struct(a.alias("x"), b.alias("y"))
    sides = let(low, lambda s: F.when((F.size(s["x"]) > 0) | (F.size(s["y"]) > 0), s).otherwise(whole))
    sizes = let(sides, lambda s: F.struct(F.size(s["x"]).alias("x"), F.size(s["y"]).alias("y"), F.size(F.array_intersect(s["x"], s["y"])).alias("both")))
    return let(sizes, lambda s: use(s["x"], s["y"], s["both"]))


def likeness(a: Column, b: Column) -> Column:
    """Estimated share of shingles in both among those in either."""
    return _shared(a, b, lambda x, y, both: F.when(x + y == 0, 1.0).otherwise(both / (x + y - both)))


def containment(a: Column, b: Column) -> Column:
    """Estimated share of ``a``'s shingles that are in ``b``."""
    return _shared(a, b, lambda x, y, both: F.when(x == 0, (y == 0).cast("double")).otherwise(both / x))


def fingerprint(s: Column) -> Column:
    """A sketch as text: its parameters, then its hashes."""
    return F.concat(F.lit(f"s{WORDS}/{SCALE}:"), F.array_join(F.transform(s, lambda x: F.hex(x)), "."))


def neighbours(keys: DataFrame) -> DataFrame:
    """Each of the distinct ``keys`` with ``next_key, next_key2``, in order of (doc_id, key), the last followed by the first.

    Keys are range-partitioned; each partition looks ahead within itself, and only one row for each
    partition is compared across partitions.
    """
    ranged = keys.repartitionByRange(pieces(keys, 4 << 20), "doc_id", "key", "key2").withColumn("part", F.spark_partition_id())
    ranged = materialize(ranged)
    me = F.struct("doc_id", "key", "key2")
    starts = ranged.groupBy("part").agg(F.min(me).alias("start"))
    ends = starts.withColumn("after", F.coalesce(F.lead("start").over(Window.orderBy("part")), F.first("start").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))))
    ahead = F.lead(me).over(Window.partitionBy("part").orderBy("doc_id", "key", "key2"))
    rows = ranged.withColumn("ahead", ahead).join(ends.select("part", "after"), "part").withColumn("ahead", F.coalesce("ahead", "after"))
    return rows.select("key", "key2", "n_chars", F.col("ahead.key").alias("next_key"), F.col("ahead.key2").alias("next_key2"))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """For each document its sketch, its edited text, that text's sketch and the next document's sketch.

    The edited text has the last half of a document's characters replaced by the first as many of the
    next document.  Texts are shuffled once, and at most half of each once more.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.withColumns({"key": F.xxhash64("doc_id", "text"), "key2": F.hash("text", "doc_id")})
    links = neighbours(rows.select("doc_id", "key", "key2", F.length("text").alias("n_chars")).distinct()).hint("shuffle_merge")
    # The same shuffle of texts serves both joins, and sketches are made behind it; identical rows are one
    # document to the one before them.
    once = rows.withColumn("nth", F.count("*").over(Window.partitionBy("key", "key2").orderBy("doc_id").rowsBetween(Window.unboundedPreceding, 0))).where("nth = 1")
    heads = once.alias("o").join(links.alias("l"), (F.col("o.key") == F.col("l.next_key")) & (F.col("o.key2") == F.col("l.next_key2")))
    heads = heads.select(F.col("l.key"), F.col("l.key2"), F.expr("substring(o.text, 1, l.n_chars div 2)").alias("head"), sketch(F.col("o.text")).alias("next_sketch"))
    both = rows.alias("t").join(heads.alias("h"), (F.col("t.key") == F.col("h.key")) & (F.col("t.key2") == F.col("h.key2")))
    edited = F.concat(F.expr("substring(t.text, 1, length(t.text) - length(t.text) div 2)"), F.col("h.head"))
    out = both.select(F.col("t.doc_id"), F.length("t.text").cast("long").alias("n_chars"), sketch(F.col("t.text")).alias("sketch"), F.col("h.next_sketch"), edited.alias("edited"))
    return out.withColumn("edited_sketch", sketch(F.col("edited")))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = fingerprints(table(spark, sf_dir, "documents"))
    mine, changed, after = F.col("sketch"), F.col("edited_sketch"), F.col("next_sketch")
    return got.select(
        "doc_id",
        "n_chars",
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        fingerprint(mine).alias("fingerprint"),
        fingerprint(changed).alias("edited_fingerprint"),
        likeness(mine, changed).alias("near_edited"),
        likeness(mine, after).alias("near_next"),
        containment(mine, changed).alias("held_by_edited"),
    )
