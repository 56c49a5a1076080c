"""Quality classifier: an interpolated modified Kneser-Ney n-gram model of trusted text.

The model is over characters folded to 48 classes, four to a gram, so every table it needs is bounded by
48^4 entries whatever the corpus holds.  Grams are counted over all trusted texts, and all grams of the
corpus are gathered; both are summed per task before they are shuffled.  Discounts, context totals and
lower orders are joined to the grams by context, sharded by gram code, and give each gram of the corpus
its log-probability.  A second pass sums them per document.

A document's perplexity is drawn towards its language's mean by ``prior_chars`` characters, so that a
few words cannot look strange by chance.  A language's limit is a quantile of its trusted documents
times a margin.

Contract for odd input: a null or empty text has no grams, takes the mean and is kept; a null language
is a language of its own; a language without trusted documents takes the limit over all trusted ones,
and without any trusted documents everything is kept; an id with several labels is trusted if any
label says so; repeated rows give repeated rows; clashing column names are harmless, as only id, text
and language are read.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import cache, reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyweave.llm.common import give_back, materialize, small_batches, typed, worded

CLASSES, ORDER = 48, 4
GRAMS = CLASSES**ORDER
SPACE, LINE, UPPER, DIGIT, LETTER, MARK, REST = 0, 1, 28, 29, 38, 46, 47
#: Characters that share a class, by class.
SHARED = {
    SPACE: " \t\xa0", LINE: "\n\r\x0b\x0c", 30: "àáâãä", 31: "ç", 32: "èéêë", 33: "ìíîï", 34: "ñ", 35: "òóôõö", 36: "ùúûü", 37: "ß",
    39: ".", 40: ",", 41: "!?", 42: "'\"-’“”«»–", 43: "()[]{}", 44: "|", 45: "$%&*#@+=~^<>/\\_",
}
CHUNK = 2_000_000


@cache
def class_table() -> np.ndarray:
    """Class of each code point of the basic plane."""
    by_kind = {"Lu": UPPER, "Lt": UPPER, "L": LETTER, "N": DIGIT, "P": MARK, "S": MARK, "Z": SPACE}
    out = np.full(65536, REST, np.int64)
    for c in range(65536):
        kind = unicodedata.category(chr(c))
        out[c] = by_kind.get(kind, by_kind.get(kind[0], REST))
    out[97:123] = np.arange(2, 28)
    for k, letters in SHARED.items():
        out[[ord(x) for x in letters]] = k
    return out


def grams(text: str) -> np.ndarray:
    """Gram code at each character; the text starts after three line breaks."""
    points = np.frombuffer(text.encode("utf-32-le", "replace"), "<u4")
    c = class_table()[np.minimum(points, 65535)]
    c = np.concatenate([np.full(ORDER - 1, LINE), c])
    n = len(points)
    return reduce(lambda code, k: code * CLASSES + c[k : k + n], range(1, ORDER), c[:n])


def _batched(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[pd.DataFrame, np.ndarray, np.ndarray]]:
    """Slices of rows with their grams, about CHUNK characters at a time, and each row's gram count."""
    for batch in batches:
        texts = [t if isinstance(t, str) else "" for t in batch["text"]]
        at = 0
        while at < len(texts):
            end, size = at, 0
            while end < len(texts) and (end == at or size + len(texts[end]) <= CHUNK):
                size += len(texts[end])
                end += 1
            codes = [grams(t) for t in texts[at:end]]
            yield batch.iloc[at:end], np.concatenate(codes), np.array([len(c) for c in codes])
            at = end


def gram_counts(docs: DataFrame) -> DataFrame:
    """``code, trusted, seen`` from rows of (text, trusted); each task sums its own before the shuffle."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        trusted, seen = np.zeros(GRAMS, np.int64), np.zeros(GRAMS, bool)
        for rows, codes, sizes in _batched(batches):
            seen[codes] = True
            mine = codes[np.repeat(rows["trusted"].to_numpy(bool), sizes)]
            if len(mine):
                trusted += np.bincount(mine, minlength=GRAMS)
        at = np.flatnonzero(seen)
        for k in range(0, len(at), 100_000):
            part = at[k : k + 100_000]
            yield pd.DataFrame({"code": part, "trusted": trusted[part]})
        del trusted, seen
        give_back()

    return small_batches(docs).select("text", "trusted").mapInPandas(run, "code bigint, trusted bigint").groupBy("code").agg(F.sum("trusted").alias("c"))


def discounts(counts: DataFrame) -> tuple[float, float, float]:
    """Modified Kneser-Ney discounts for counts of one, two, three and more."""
    n = counts.agg(*[F.count_if(F.col("c") == k).alias(f"n{k}") for k in (1, 2, 3, 4)]).first()
    if not all(n):
        return 0.5, 0.75, 0.9  # too few grams for an estimate
    y = n.n1 / (n.n1 + 2 * n.n2)
    return tuple(min(max(k - (k + 1) * y * n[k] / n[k - 1], 0.05), k - 0.05) for k in (1, 2, 3))


def _discounted(counts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(code, own): the discounted share of each seen gram; (context, rest): the mass left to shorter grams."""
    d1, d2, d3 = discounts(counts)
    c = F.col("c")
    taken = F.when(c == 1, d1).when(c == 2, d2).otherwise(d3)
    rows = counts.select("code", c, F.expr(f"code div {CLASSES}").alias("context"), taken.alias("taken"))
    totals = rows.groupBy("context").agg(F.sum("c").alias("total"), F.sum("taken").alias("held"))
    own = rows.join(totals, "context").select("code", ((c - F.col("taken")) / F.col("total")).alias("own"))
    return own, totals.select("context", (F.col("held") / F.col("total")).alias("rest"))


def gram_logs(counts: DataFrame) -> DataFrame:
    """``code, logp`` for every gram of the corpus, by joins sharded on code and context.

    Orders go from one character up: p(gram) = own + rest(context) * p(gram without its first character).
    """
    trusted = counts.where("c > 0")
    levels = [trusted]
    for k in range(ORDER - 1, 0, -1):  # continuation counts: how many grams one longer end in it
        levels.append(levels[-1].groupBy(F.expr(f"code % {CLASSES**k}").alias("code")).agg(F.count("*").alias("c")))
    wanted = counts.select("code")
    p = wanted.select(F.expr(f"code % {CLASSES}").alias("code")).distinct().withColumn("p", F.lit(1.0 / CLASSES))
    for k, level in enumerate(reversed(levels), start=1):
        own, rest = _discounted(level)
        mine = wanted.select(F.expr(f"code % {CLASSES**k}").alias("code")).distinct()
        shorter = p.withColumnRenamed("code", "tail").withColumnRenamed("p", "below")
        tail = F.expr(f"code % {CLASSES ** (k - 1)}") if k > 1 else F.col("code")
        rows = mine.withColumn("tail", tail).withColumn("context", F.expr(f"code div {CLASSES}")).join(shorter, "tail")
        rows = rows.join(own, "code", "left").join(rest, "context", "left")
        p = rows.select("code", (F.coalesce("own", F.lit(0.0)) + F.coalesce("rest", F.lit(1.0)) * F.col("below")).alias("p"))
    return p.select("code", F.log("p").cast("float").alias("logp"))


def document_logs(docs: DataFrame, logs: DataFrame) -> DataFrame:
    """``docs`` with ``n_grams`` and ``logp``, the sum over its grams.

    The table of logs has at most 48^4 rows of 8 bytes, which bounds what is sent to executors.
    """
    got = logs.toPandas()
    order = np.argsort(got["code"].to_numpy())
    shared = docs.sparkSession.sparkContext.broadcast((got["code"].to_numpy(np.int32)[order], got["logp"].to_numpy(np.float32)[order]))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        code, logp = shared.value
        dense = np.full(GRAMS, np.float32(-20))
        dense[code] = logp
        for rows, codes, sizes in _batched(batches):
            ends = np.concatenate([[0.0], np.cumsum(dense[codes], dtype=np.float64)])
            edge = np.concatenate([[0], np.cumsum(sizes)])
            yield rows.drop(columns="text").assign(n_grams=sizes, logp=ends[edge[1:]] - ends[edge[:-1]])
        give_back()

    kept = [c for c in docs.columns if c != "text"]
    schema = ", ".join([*(f"`{c}` string" for c in kept), "n_grams bigint, logp double"])
    return typed(small_batches(worded(docs, *kept)).mapInPandas(run, schema), docs, *kept)


def judged(told: DataFrame, basis: DataFrame, quantile: float, margin: float, prior: int) -> DataFrame:
    """``id, lang, trusted, n_grams, perplexity, threshold, keep`` from rows with ``n_grams`` and ``logp``; the rows of ``basis`` set means and limits."""
    # One small row for each language, and one for all.
    means = basis.groupBy("lang").agg((F.sum("logp") / F.sum("n_grams")).alias("mean"))
    all_mean = basis.agg((F.sum("logp") / F.sum("n_grams")).alias("all_mean"))
    mean = F.coalesce("mean", "all_mean", F.lit(0.0))

    def perplexity(df: DataFrame) -> DataFrame:
        near = means.withColumnRenamed("lang", "mean_lang")
        df = df.join(near, F.col("lang").eqNullSafe(F.col("mean_lang")), "left").join(F.broadcast(all_mean))
        return df.withColumn("perplexity", F.exp(-(F.col("logp") + prior * mean) / (F.col("n_grams") + prior)))

    high = F.percentile_approx("perplexity", F.lit(quantile), F.lit(10_000)) * margin
    limits = perplexity(basis).groupBy("lang").agg(high.alias("limit")).withColumnRenamed("lang", "limit_lang")
    all_limit = perplexity(basis).agg(high.alias("all_limit"))
    limit: Column = F.coalesce("limit", "all_limit")
    out = perplexity(told).join(limits, F.col("lang").eqNullSafe(F.col("limit_lang")), "left").join(F.broadcast(all_limit))
    return out.select("id", "lang", "trusted", "n_grams", "perplexity", limit.alias("threshold"), F.coalesce(F.col("perplexity") <= limit, F.lit(True)).alias("keep"))


def score(docs: DataFrame, labels: DataFrame, quantile: float = 0.995, margin: float = 1.5, prior_chars: int = 40, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """``id, lang, trusted, n_grams, perplexity, threshold, keep`` for every row."""
    good = labels.where((F.col("quality") == 1) & F.col(id_col).isNotNull()).select(F.col(id_col).alias("good_id")).distinct()
    rows = docs.select(F.col(id_col).alias("id"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))

    def marked(df: DataFrame, good: DataFrame = good) -> DataFrame:
        return df.join(good, F.col("id") == F.col("good_id"), "left").withColumn("trusted", F.col("good_id").isNotNull()).drop("good_id")

    # Texts meet the labels once, to be counted; scores meet them as small rows.  The texts are shuffled at
    # every size: whether the labels would fit a broadcast must not change what the job costs.
    logs = gram_logs(materialize(gram_counts(marked(rows, good.hint("shuffle_merge")))))
    told = materialize(marked(document_logs(rows, logs)))
    return judged(told, told.where("trusted AND n_grams > 0"), quantile, margin, prior_chars)


def without_rejected(docs: DataFrame, scored: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` that ``scored`` keeps; only ids of rejected rows are joined to them."""
    bad = scored.where(~F.col("keep")).select("id", "perplexity")
    # An id goes only if every row of it is rejected.
    rows = docs.groupBy(id_col).agg(F.count("*").alias("rows"))
    gone = bad.groupBy("id").agg(F.count("*").alias("bad")).join(rows, F.col("id") == F.col(id_col)).where("bad = rows").select(F.col("id").alias("gone_id"))
    return docs.join(gone, F.col(id_col) == F.col("gone_id"), "left_anti")


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The rows of ``docs`` that :func:`score` keeps."""
    return without_rejected(docs, score(docs, labels, id_col=id_col, text_col=text_col, lang_col=lang_col), id_col)
