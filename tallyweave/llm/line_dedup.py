"""Line de-duplication across documents, in DataFrame functions only.

Hashes of line keys are range-partitioned on (key, document), so even a key that a third of all lines
share is spread over many tasks, and sorted by document and position inside each partition.  Each
partition streams through its keys and hands on one partial count and its largest holder for each; the
small partials meet by key, and the verdicts go back to the lines: those of the few hot keys to where
the lines are, the others by hash.  What comes back for a document is a sparse bitmap of its lines, never text.

Contract for odd input: a null or empty text is one empty line; rows without an id keep all lines and
hold none for others; rows that repeat an id are one document, each row keeping its own lines; lines
may be of any length; other columns are never read; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyweave.llm.common import materialize, pieces, table

BLANKS = " \t\n\x0b\x0c\r"
#: Keys of more than one HOT-th of the repeated lines are hot; there can be fewer than HOT of them.
HOT = 4096
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased and nothing else; plain ASCII takes the fast function."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def split_lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def keyed_lines(docs: DataFrame, min_chars: int, id_col: str, text_col: str) -> DataFrame:
    """``h1, h2`` (a 96-bit hash of the key), ``id``, ``tag`` (tells rows of one id apart), ``pos``."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where("id IS NOT NULL")
    lines = rows.select("id", F.hash("text").alias("tag"), F.posexplode(split_lines(F.col("text"))).alias("pos", "line"))
    key = lines.withColumn("line", F.btrim("line", F.lit(BLANKS))).where(F.length("line") >= min_chars).withColumn("line", ascii_lower(F.col("line")))
    return key.select(F.xxhash64("line").alias("h1"), F.hash("line").alias("h2"), "id", "tag", "pos")


def drop_bitmaps(docs: DataFrame, min_chars: int = 40, min_docs: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, tag, n_dropped, words``: for each document that loses lines a sparse bitmap of them.

    ``words`` is an array of (index, bits), 64 lines to a word; words without a lost line are left out.
    A key found in ``min_docs`` documents keeps its lines in the largest id alone.
    """
    lines = materialize(keyed_lines(docs, min_chars, id_col, text_col))  # hashed once, for sampling and dealing
    ranged = lines.repartitionByRange(pieces(docs, 8 << 20), "h1", "h2", "id")
    # The range partitioning serves the grouping by key and document: sorted rows stream through it.
    streamed = ranged.sortWithinPartitions("h1", "h2", "id", "pos")
    holders = streamed.groupBy("h1", "h2", "id").agg(F.count("*").alias("n_lines"))
    shared = holders.groupBy("h1", "h2").agg(F.count("*").alias("n_docs"), F.sum("n_lines").alias("n_lines"), F.max("id").alias("keeper")).where(F.col("n_docs") >= min_docs)
    shared = materialize(shared.select("h1", "h2", "keeper", "n_lines"))
    # A key with more than a HOT-th of these lines is hot: there are fewer than HOT, so they are sent to the lines
    # where they are.  No other key's lines are more than a HOT-th of all, and they meet their verdict by hash.
    total = shared.agg(F.sum("n_lines").alias("n")).first()["n"] or 0
    hot = F.broadcast(shared.where(F.col("n_lines") * HOT > total).select(F.col("h1").alias("hot1"), F.col("h2").alias("hot2"), F.col("keeper").alias("hot_keeper")))
    marked = ranged.join(hot, (F.col("h1") == F.col("hot1")) & (F.col("h2") == F.col("hot2")), "left")
    lost_hot = marked.where(F.col("id") < F.col("hot_keeper"))
    cold = shared.where(F.col("n_lines") * HOT <= total).select("h1", "h2", "keeper")
    lost_cold = marked.where("hot_keeper IS NULL").join(cold, ["h1", "h2"]).where(F.col("id") < F.col("keeper"))
    lost = lost_hot.select("id", "tag", "pos").unionByName(lost_cold.select("id", "tag", "pos"))
    words = lost.groupBy("id", "tag", F.expr("pos div 64").cast("int").alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, pos % 64)")).alias("bits"))
    return words.groupBy("id", "tag").agg(
        F.sum(F.bit_count("bits")).cast("long").alias("n_dropped"),
        F.sort_array(F.collect_list(F.struct("word", "bits"))).alias("words"),
    )


def dense(words: Column) -> Column:
    """The sparse bitmap as an array of 64-bit words up to the last one with a lost line."""
    return F.aggregate(
        words,
        F.expr("cast(array() as array<bigint>)"),
        lambda out, w: F.concat(out, F.array_repeat(F.lit(0).cast("bigint"), w["word"] - F.size(out)), F.array(w["bits"])),
    )


def dedup_lines(docs: DataFrame, min_chars: int = 40, min_docs: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with ``kept_text``, ``n_lines`` and ``n_dropped`` added."""
    maps = drop_bitmaps(docs, min_chars, min_docs, id_col, text_col).select("id", "tag", "n_dropped", dense(F.col("words")).alias("bitmap"))
    text = F.col(f"d.`{text_col}`")
    joined = docs.alias("d").join(maps.alias("m"), (F.col(f"d.`{id_col}`") == F.col("m.id")) & (F.hash(text) == F.col("m.tag")), "left")
    lines = split_lines(text)
    bitmap = F.col("m.bitmap")
    stays = F.filter(lines, lambda _, i: F.coalesce(F.expr("0L") + F.get(bitmap, F.floor(i / 64).cast("int")), F.lit(0).cast("bigint")).bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("bigint"), i % 64)) == 0)
    return joined.select(
        "d.*",
        F.when(F.col("m.id").isNull(), F.coalesce(text, F.lit(""))).otherwise(F.array_join(stays, "\n")).alias("kept_text"),
        F.size(lines).cast("long").alias("n_lines"),
        F.coalesce(F.col("m.n_dropped"), F.lit(0).cast("long")).alias("n_dropped"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return dedup_lines(docs).select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


ORACLE = """
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents
), keyed AS (
  SELECT doc_id, pos, line, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM lines
), shared AS (
  SELECT key, max(doc_id) AS keeper FROM keyed WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5
), judged AS (
  SELECT k.doc_id, k.pos, k.line, coalesce(k.doc_id < s.keeper, false) AS lost FROM keyed k LEFT JOIN shared s ON k.key = s.key
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE lost) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT lost), '')) AS kept_sha256
FROM judged GROUP BY doc_id
"""
