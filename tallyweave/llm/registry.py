"""Queries of the corpus operators and their DuckDB twins."""

from __future__ import annotations

from collections.abc import Callable

import corpus_pipeline
from pyspark.sql import DataFrame, SparkSession

from tallyweave.llm import bpe, chat, jaccard, line_dedup, media, mixing, sketch, toxicity, urls, word_quality

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {
    "op1_toxicity": toxicity.query,
    "op2_jaccard": jaccard.query,
    "op3_sketch": sketch.query,
    "op4_line_dedup": line_dedup.query,
    "op5_urls": urls.query,
    "op6_quality": word_quality.query,
    "op7_media": media.query,
    "op8_mixing": mixing.query,
    "op9_chat": chat.query,
    "op10_bpe": bpe.query,
    "pipeline": corpus_pipeline.run,
}

ORACLES: dict[str, str] = {
    **({} if corpus_pipeline.ORACLE_SQL is None else {"pipeline": corpus_pipeline.ORACLE_SQL}),
    "op2_jaccard": jaccard.ORACLE,
    "op4_line_dedup": line_dedup.ORACLE,
    "op8_mixing": mixing.ORACLE,
    "op9_chat": chat.ORACLE,
}


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
