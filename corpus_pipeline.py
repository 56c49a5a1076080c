"""From raw documents to token ids: filter, clean, de-duplicate, mix, encode.

``STAGES`` lists the stages in order; each takes (spark, docs, sf_dir) and works on all rows the one
before kept.  All but the last return the columns of ``documents``.

1. quality      drops documents whose perplexity under a model of words is beyond their language's limit
2. line_dedup   drops lines that five or more documents share, but for the largest id that holds them
3. near_dups    keeps the smallest id of each class of near-duplicates (five-word shingles, 0.8)
4. mixing       takes each source's seeded token-prefix under the target weights, each document at most once
5. bpe          encodes what is left

Odd input follows the operators' contracts; rows without an id pass the stages that go by id.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyweave.llm import bpe, jaccard, line_dedup, mixing, word_quality
from tallyweave.llm.common import checkpoint_dir, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Share of the incoming tokens that the mix takes.
MIX_SHARE = 0.8


def stage_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Null and empty texts, and rows without an id, stay; an id goes only if every row of it is rejected."""
    docs = docs.select(*COLUMNS)
    return word_quality.keep_good(docs, table(spark, sf_dir, "labels"))


def stage_line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row stays; a null text becomes the empty one, and rows without an id keep all lines."""
    cleaned = line_dedup.dedup_lines(docs.select(*COLUMNS))
    text = F.col("kept_text")
    return cleaned.select("doc_id", text.alias("text"), "lang", "source", F.length(text).cast("long").alias("n_chars"))


def stage_near_dups(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows without words or an id stay; rows that share an id stay or go together."""
    return jaccard.keep_one(docs.select(*COLUMNS), k=5, percent=80)


def stage_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Null languages and sources are the empty one; rows that share an id stay if one of them is taken."""
    docs = docs.select(*COLUMNS)
    taken = mixing.mix(docs, share=MIX_SHARE, max_epochs=1).where("copies > 0")
    return docs.join(taken.select(F.col("id").alias("taken_id")).distinct(), F.col("doc_id").eqNullSafe(F.col("taken_id")), "left_semi")


def stage_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row for each row; a null or empty text has no ids."""
    spec = bpe.tokenizer_spec(bpe.default_tokenizer())
    return bpe.encode(docs, spec, carry=("lang", "source")).drop("decoded")


STAGES = [
    ("quality", stage_quality),
    ("line_dedup", stage_line_dedup),
    ("near_dups", stage_near_dups),
    ("mixing", stage_mixing),
    ("bpe", stage_bpe),
]

#: The first stage's model and the last one's merges are beyond SQL; a brute-force twin stands in tests.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result but the last is written as Parquet and read again.

    A written result is deleted once the next one stands; the last one written feeds what is returned.
    """
    docs = table(spark, sf_dir, "documents")
    place = f"{checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    written = None
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            before, written = written, f"{place}/{k}-{name}"
            docs.write.parquet(written)
            docs = spark.read.parquet(written)
            if before:
                path = spark._jvm.org.apache.hadoop.fs.Path(before)
                path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    return docs
