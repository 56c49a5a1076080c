"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features are presences of hashed words, word pairs and skip pairs in a fixed space of 2^20 places.
Training keeps a per-coordinate rate, and L1 makes most weights exactly zero, so the model is a short
list of (place, weight): at most ``MAX_WEIGHTS`` entries are ever sent to the executors.

Learning uses a bounded sample of labelled rows (``train_rows``, those with the smallest id hash, as far as
their features come to ``train_bytes``); scoring reads every whole text once, without a shuffle.

Contract for odd input: a null or empty text scores the bias alone; a null id counts as held out; labels
that are null are not learnt from, and an id with several labels counts as toxic if any says so; with no
usable labels every score is 0.5; repeated rows give repeated rows; other columns are never read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyweave.llm.common import give_back, materialize, small_batches, table, typed, worded

WORDS = re.compile(r"\w+")
BITS = 20
PLACES = 1 << BITS
#: The most weights a model may hold: the whole feature space, 12 bytes each.
MAX_WEIGHTS = PLACES
#: Words whose hash a worker remembers before it starts afresh.
CACHE_WORDS = 300_000
#: Odd multipliers that tell the feature families apart.
UNIT, PAIR, SKIP = (np.uint64(m) for m in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))


class Hasher:
    """Places of a text's features."""

    def __init__(self) -> None:
        self.known: dict[str, int] = {}

    def words(self, text: str) -> np.ndarray:
        known = self.known
        if len(known) > CACHE_WORDS:
            known.clear()
        found = WORDS.findall(text.lower())
        try:
            return np.fromiter(map(known.__getitem__, found), np.uint64, len(found))
        except KeyError:
            for w in found:
                if w not in known:
                    known[w] = xxhash.xxh64_intdigest(w)
            return np.fromiter(map(known.__getitem__, found), np.uint64, len(found))

    def places(self, text: str) -> np.ndarray:
        """Places with repeats: words, neighbours, and words one apart."""
        h = self.words(text)
        mixed = [h * UNIT]
        if len(h) > 1:
            mixed.append((h[:-1] * PAIR) ^ (h[1:] * UNIT))
        if len(h) > 2:
            mixed.append((h[:-2] * SKIP) ^ (h[2:] * UNIT))
        return (np.concatenate(mixed) >> np.uint64(64 - BITS)).astype(np.int32)


def sigmoid(x: float) -> float:
    return float(1 / (1 + np.exp(-np.clip(x, -35, 35))))


def train(rows: list[tuple[np.ndarray, int]], epochs: int = 6, alpha: float = 3.0, beta: float = 1.0, l1: float = 4.0, l2: float = 0.1) -> tuple[np.ndarray, np.ndarray, float]:
    """FTRL-proximal over (places, label) rows: the non-zero (places, weights) and the bias."""
    z, n = np.zeros(PLACES + 1), np.zeros(PLACES + 1)
    order = np.random.default_rng(7)

    def weights(at: np.ndarray | slice) -> np.ndarray:
        za = z[at]
        return np.where(np.abs(za) <= l1, 0.0, (np.sign(za) * l1 - za) / ((beta + np.sqrt(n[at])) / alpha + l2))

    for _ in range(epochs):
        for i in order.permutation(len(rows)):
            at, label = rows[i]
            w = weights(at)
            bias = -z[PLACES] / ((beta + np.sqrt(n[PLACES])) / alpha)
            g = sigmoid(w.sum() + bias) - label
            if abs(g) < 1e-3:
                continue
            grown = n[at] + g * g
            z[at] += g - (np.sqrt(grown) - np.sqrt(n[at])) / alpha * w
            n[at] = grown
            z[PLACES] += g - (np.sqrt(n[PLACES] + g * g) - np.sqrt(n[PLACES])) / alpha * bias
            n[PLACES] += g * g
    w = weights(slice(0, PLACES))
    at = np.flatnonzero(w)
    return at.astype(np.int32), w[at], float(-z[PLACES] / ((beta + np.sqrt(n[PLACES])) / alpha))


def held_out_column(id_col: str) -> F.Column:
    """crc32 of the id as text, modulo 5, is 0; so is a null id."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 5 == 0


def training_rows(docs: DataFrame, labels: DataFrame, train_rows: int, train_bytes: int, id_col: str, text_col: str, label_col: str) -> list[tuple[np.ndarray, int]]:
    """Features of the bounded sample; texts stay on the executors."""
    usable = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label")).where("id IS NOT NULL AND label IS NOT NULL").where(~held_out_column("id"))
    sample = usable.groupBy("id").agg(F.max("label").alias("label")).orderBy(F.xxhash64("id"), "id").limit(train_rows)
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(sample), "id")

    def features(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hasher = Hasher()
        for batch in batches:
            yield pd.DataFrame({"id": batch["id"], "label": batch["label"], "places": [np.unique(hasher.places(t if isinstance(t, str) else "")).astype("<i4").tobytes() for t in batch["text"]]})

    told = materialize(small_batches(texts).mapInPandas(features, f"id {dict(texts.dtypes)['id']}, label int, places binary"))
    # Only ids and sizes are summed in one task, at most train_rows of them and their copies.
    first = told.groupBy("id").agg(F.min("places").alias("places")).withColumn("n", F.octet_length("places"))
    upto = F.sum("n").over(Window.orderBy(F.xxhash64("id"), "id").rowsBetween(Window.unboundedPreceding, 0))
    fits = first.select("id", "n").withColumn("upto", upto).where((F.col("upto") <= train_bytes) | (F.col("upto") == F.col("n"))).select("id")
    got = told.join(fits, "id", "left_semi").groupBy("id", "label").agg(F.min("places").alias("places")).toPandas().sort_values("id")
    return [(np.frombuffer(p, "<i4"), int(y > 0)) for p, y in zip(got["places"], got["label"], strict=True)]


def score(docs: DataFrame, model: tuple[np.ndarray, np.ndarray, float], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, ``held_out``, ``score``, ``predicted`` for every row."""
    places, weights, bias = model
    if len(places) > MAX_WEIGHTS:
        raise ValueError("more weights than feature places")
    shared = docs.sparkSession.sparkContext.broadcast((places, weights, bias))
    rows = docs.select(F.col(id_col), held_out_column(id_col).alias("held_out"), F.col(text_col).alias("__text"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, w, b = shared.value
        dense = np.zeros(PLACES)
        dense[at] = w
        hasher = Hasher()
        for batch in batches:
            out = []
            for text in batch["__text"]:
                found = hasher.places(text) if isinstance(text, str) and text else np.zeros(0, np.int32)
                found = found[dense[found] != 0]
                out.append(sigmoid(dense[np.unique(found)].sum() + b))
            yield pd.DataFrame({id_col: batch[id_col], "held_out": batch["held_out"], "score": out})
        give_back()

    scored = small_batches(worded(rows, id_col)).mapInPandas(run, f"`{id_col}` string, held_out boolean, score double")
    return typed(scored, rows, id_col).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def classify(docs: DataFrame, labels: DataFrame, train_rows: int = 10_000, train_bytes: int = 64 << 20, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> DataFrame:
    return score(docs, train(training_rows(docs, labels, train_rows, train_bytes, id_col, text_col, label_col)), id_col, text_col)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
