"""Quality classifier over words: an interpolated modified Kneser-Ney model of trusted texts.

Words are runs without ASCII white space, as written; a text starts after ``order - 1`` start marks and
ends in an end mark.  Every gram of the learnt texts is counted; nothing is pruned.  Counts meet context
totals and lower orders by sharded joins.

Interpolation is written as a sum: the log-probability of a word is a constant plus a weight for each
gram that ends in it (what the gram adds to its shorter one) and for each gram before it (the mass its
context leaves to shorter grams).  A gram that no learnt text holds weighs nothing.  A document's
log-probability is thus a sum over its grams, and it comes from a join of its grams with the weights,
sharded by gram.  Before that join a task adds the weights of the most frequent grams itself (a bounded
table) and drops most grams without a weight (a bitmap of fixed size, which may let some through but
drops none that has one).  Weights are whole multiples of 1/SCALE, so sums do not depend on order.

Half of the trusted ids (crc32 of the id as text odd) are learnt from.  The others set a language's mean
and limit: a text the model has counted looks far better to it than an unseen one.

Contract for odd input: as in :mod:`tallyweave.llm.quality`; without a trusted text in the unlearnt half
everything is kept.  Words and rows are told apart by 64-bit hashes.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyweave.llm.common import checkpoint_dir, give_back, let_go, materialize, small_batches, table
from tallyweave.llm.quality import discounts, judged, without_rejected

ORDER = 2
START, END = np.int64(1), np.int64(2)
SCALE = 1 << 20
#: Words of a slice of rows in a Python worker.
CHUNK = 500_000
#: Most frequent grams that are sent to executors, at most; bits of the bitmaps of ids and of grams.
HOT, ID_BITS, GRAM_BITS = 1 << 19, 1 << 24, 1 << 27
#: Joins of grams are done for this many parts of their rows, one after the other: only one part's shuffle is on disk.
PARTS = 4

P1, P2, P3, P4, P5 = (np.uint64(p) for p in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))


def hashed(values: np.ndarray, seeds: np.ndarray | int = 42) -> np.ndarray:
    """Spark's xxhash64 of whole numbers; with hashes as seeds, that of one column more."""

    def turn(x: np.ndarray, k: int) -> np.ndarray:
        return (x << np.uint64(k)) | (x >> np.uint64(64 - k))

    seeds = np.asarray(seeds, np.int64).view(np.uint64)
    with np.errstate(over="ignore"):
        h = seeds + P5 + np.uint64(8)
        h = turn(h ^ (turn(values.view(np.uint64) * P2, 31) * P1), 27) * P1 + P4
        h = (h ^ (h >> np.uint64(33))) * P2
        h = (h ^ (h >> np.uint64(29))) * P3
        return (h ^ (h >> np.uint64(32))).view(np.int64)


def word_hashes(text: Column) -> Column:
    """The hash of each word, in order."""
    return F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"([^\x20\x09-\x0D]+)")), lambda w: F.xxhash64(w))


def in_learnt_half(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 2 == 1


class Shelf:
    """Tables of one run as compressed Parquet in the checkpoint folder: a checkpoint's rows are not compressed."""

    def __init__(self, spark: SparkSession):
        self.spark, self.place = spark, f"{checkpoint_dir(spark)}/words-{uuid.uuid4().hex}"

    def put(self, name: str, *parts: DataFrame) -> DataFrame:
        for df in parts:
            df.write.mode("append").option("compression", "zstd").parquet(f"{self.place}/{name}")
            let_go(self.spark)
        return self.spark.read.parquet(f"{self.place}/{name}")

    def drop(self, *names: str) -> None:
        for path in (f"{self.place}/{n}" for n in names) if names else [self.place]:
            at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(at, True)


def by_part(df: DataFrame, *cols: str) -> list[DataFrame]:
    """``df`` in PARTS parts, by a hash of the columns."""
    return [df.where(F.pmod(F.xxhash64(*cols, F.lit(7)), F.lit(PARTS)) == j) for j in range(PARTS)]


def bitmap(keys: DataFrame, bits: int) -> np.ndarray:
    """``bits`` bits, in bytes, two of them set for a key (:func:`held_in` reads them); summed per task, of fixed size."""
    rows = keys.select(F.explode(F.expr(f"array(pmod(key, {bits}L) + 1, pmod(shiftright(key, 27), {bits}L) + 1)")).alias("at"))
    at = F.col("at")
    rows = rows.select(F.bitmap_bucket_number(at).alias("part"), F.bitmap_bit_position(at).alias("at")).groupBy("part").agg(F.bitmap_construct_agg("at").alias("held"))
    out = np.zeros(bits // 8, np.uint8)
    for r in rows.collect():
        out[(r.part - 1) * 4096 : r.part * 4096] = np.frombuffer(r.held, np.uint8)
    return out


def held_in(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    def on(at: np.ndarray) -> np.ndarray:
        at = at & np.int64(len(bits) * 8 - 1)
        return (bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1

    out = on(keys)
    out[out] = on(keys[out] >> 27)
    return out


def learnt_texts(rows: DataFrame, good: DataFrame) -> DataFrame:
    """``words`` of the trusted rows of (id, text) in the learnt half.

    The join shuffles texts at every size; a bitmap of the ids keeps most other texts out of it.
    """
    ids = good.where(in_learnt_half(F.col("good_id")))
    bits = bitmap(ids.select(F.xxhash64("good_id").alias("key")), ID_BITS)
    shared = rows.sparkSession.sparkContext.broadcast(bits)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch[held_in(shared.value, batch["key"].to_numpy(np.int64))]

    own = small_batches(rows.where(in_learnt_half(F.col("id")))).select(F.xxhash64("id").alias("key"), F.col("id").cast("string").alias("id"), "text")
    near = own.mapInPandas(run, "key bigint, id string, text string")
    return near.join(ids.select(F.col("good_id").cast("string").alias("id")).hint("shuffle_merge"), "id", "left_semi").select(word_hashes(F.col("text")).alias("words"))


def _slices(batches: Iterator[pd.DataFrame], order: int) -> Iterator[tuple[pd.DataFrame, np.ndarray, np.ndarray, np.ndarray]]:
    """Slices of rows with their marked words laid end to end, each one's row, and its place in that row."""
    for batch in batches:
        sizes = np.array([0 if w is None else len(w) for w in batch["words"]], np.int64)
        ends = np.cumsum(sizes)
        at = 0
        while at < len(batch):
            end = max(at + 1, int(np.searchsorted(ends, ends[at] - sizes[at] + CHUNK, "right")))
            part, n = batch.iloc[at:end], sizes[at:end]
            marked = np.where(n > 0, n + order, 0)
            row = np.repeat(np.arange(len(n)), marked)
            place = np.arange(marked.sum()) - np.repeat(np.cumsum(marked) - marked, marked)
            flat = np.full(len(row), START, np.int64)
            inner = (place >= order - 1) & (place < marked[row] - 1)
            flat[place == marked[row] - 1] = END
            if n.any():
                flat[inner] = np.concatenate([np.asarray(w, np.int64) for w, k in zip(part["words"], n, strict=True) if k])
            yield part, flat, row, place
            at = end


def gram_counts(docs: DataFrame, order: int) -> DataFrame:
    """``w1 .. wn, c`` from rows of ``words``: how often each gram occurs."""
    names = [f"w{k}" for k in range(1, order + 1)]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for _, flat, _, place in _slices(batches, order):
            last = np.flatnonzero(place >= order - 1)
            words = [flat[last - order + k] for k in range(1, order + 1)]
            key = hashed(words[0])
            for w in words[1:]:
                key = hashed(w, key)
            _, first, count = np.unique(key, return_index=True, return_counts=True)
            yield pd.DataFrame({n: w[first] for n, w in zip(names, words, strict=True)} | {"c": count})
        give_back()

    return small_batches(docs).mapInPandas(run, ", ".join(f"{n} bigint" for n in [*names, "c"])).groupBy(*names).agg(F.sum("c").alias("c"))


def gram_weights(counts: DataFrame, order: int, shelf: Shelf) -> tuple[float, DataFrame]:
    """The constant of a word, and ``key, weight, often`` of every gram and context of the learnt texts.

    ``counts`` is on the shelf as level ``order``; a table leaves it once the next one stands.
    """
    names = [f"w{k}" for k in range(1, order + 1)]

    def scaled(x: Column) -> Column:
        return F.round(x * SCALE).cast("int").alias("weight")

    levels = {order: counts}
    for k in range(order - 1, 0, -1):  # continuation counts: how many grams one longer end in it
        levels[k] = shelf.put(f"level{k}", levels[k + 1].groupBy(*[F.col(names[i + 1]).alias(names[i]) for i in range(k)]).agg(F.count("*").alias("c")))
    base, low, parts = 0.0, None, []
    for k in range(1, order + 1):
        mine, context = names[:k], names[: k - 1]
        d1, d2, d3 = discounts(levels[k])
        c = F.col("c")
        rows = levels.pop(k).withColumn("taken", F.when(c == 1, d1).when(c == 2, d2).otherwise(d3))
        sums = [F.sum("c").alias("total"), F.sum("taken").alias("held"), F.count("*").alias("kinds")]
        own = c - F.col("taken")
        if k == 1:
            whole = rows.agg(*sums).first()
            if not whole.kinds:  # nothing was learnt
                return 0.0, rows.selectExpr("0L AS key", "0 AS weight", "0L AS often").limit(0)
            left = whole.held / whole.total / (whole.kinds + 1)  # one word more for all unknown ones
            base = math.log(left)
            low = rows.select(*mine, "c", (own / float(whole.total) + left).alias("p"))
            parts.append(low.select(F.xxhash64(*mine).alias("key"), scaled(F.log(F.col("p") / left)), F.col("c").alias("often")))
            continue
        totals = shelf.put(f"totals{k}", rows.groupBy(*context).agg(*sums).drop("kinds"))
        rest = F.col("held") / F.col("total")
        parts.append(totals.select(F.xxhash64(*context).alias("key"), scaled(F.log(rest)), F.col("total").alias("often")))
        # What a gram gains over its shorter one is own / (held * p of the shorter one).
        more = [] if k == order else [names[0], (own / F.col("total")).alias("share"), rest.alias("rest")]
        cols = [*names[1:k], *more, F.xxhash64(*mine).alias("key"), "c", (own / F.col("held")).cast("float").alias("gain")]
        both = zip(by_part(rows, *context), by_part(totals, *context), strict=True)
        gains = shelf.put(f"gains{k}", *[a.join(b, context).select(*cols) for a, b in both])
        shelf.drop(f"level{k}")
        below = low.select(*[F.col(names[i]).alias(names[i + 1]) for i in range(k - 1)], F.col("p").alias("below"))
        more = [] if k == order else [*mine, (F.col("share") + F.col("rest") * F.col("below")).alias("p")]
        cols = [*more, "key", scaled(F.log1p(F.col("gain") / F.col("below"))), F.col("c").alias("often")]
        both = zip(by_part(gains, *names[1:k]), by_part(below, *names[1:k]), strict=True)
        low = shelf.put(f"weights{k}", *[a.join(b, names[1:k]).select(*cols) for a, b in both])
        shelf.drop(f"gains{k}")
        if k < order:
            parts.append(low.select("key", "weight", "often"))
    if order == 1:
        return base, parts[0]
    shorter = parts[0]
    for part in parts[1:]:
        shorter = shorter.unionByName(part)
    shorter = shelf.put("shorter", shorter.groupBy("key").agg(F.sum("weight").cast("int").alias("weight"), F.max("often").alias("often")))
    shelf.drop("level1", *[f"totals{k}" for k in range(2, order + 1)], *[f"weights{k}" for k in range(2, order)])
    return base, shorter.unionByName(low.select("key", "weight", "often"))


def hottest(weights: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Keys and weights of the most frequent grams, all from some power of two on and at most HOT."""
    steps = {r.step: r.n for r in weights.groupBy(F.floor(F.log2("often")).alias("step")).agg(F.count("*").alias("n")).collect()}
    held, least = 0, 64
    for step in sorted(steps, reverse=True):
        if (held := held + steps[step]) > HOT:
            break
        least = step
    got = weights.where(F.floor(F.log2("often")) >= least).select("key", "weight").toPandas()
    order = np.argsort(got["key"].to_numpy())
    return got["key"].to_numpy(np.int64)[order], got["weight"].to_numpy(np.int64)[order]


def document_logs(rows: DataFrame, base: float, weights: DataFrame, order: int, shelf: Shelf) -> DataFrame:
    """``id, lang, n_grams, logp`` for every row of (id, lang, text)."""
    keyed = rows.select("id", "lang", F.xxhash64("id", "lang", "text", *[F.col(x).isNull() for x in ("id", "lang", "text")]).alias("row"), "text")
    hot, bits = hottest(weights), bitmap(weights.select("key"), GRAM_BITS)
    shared = rows.sparkSession.sparkContext.broadcast((*hot, bits))
    del hot, bits
    let_go(rows.sparkSession)  # what the bitmap's tasks shuffled need not lie beside the first part's grams

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hot_keys, hot_weights, bits = shared.value
        mask = np.int64(4 * HOT - 1 if HOT else 0)
        # One gram a slot is found at once; those that share a slot with it go the way of all others.
        slot_key, slot_weight = np.zeros(mask + 1, np.int64), np.zeros(mask + 1, np.int64)
        slot_key[hot_keys & mask], slot_weight[hot_keys & mask] = hot_keys, hot_weights
        for part, flat, row, place in _slices(batches, order):
            n = len(part)
            own, keys, holders, key = np.zeros(n, np.int64), [], [], None
            for k in range(1, order + 1):
                key = hashed(flat) if k == 1 else np.concatenate([flat[:1], hashed(flat[1:], key[:-1])])
                use = place >= max(order - 2, k - 1)
                mine, where = key[use], row[use]
                at = mine & mask
                found = slot_key[at] == mine
                np.add.at(own, where[found], slot_weight[at[found]])
                rest = ~found
                rest[rest] = held_in(bits, mine[rest])
                keys.append(mine[rest])
                holders.append(where[rest])
            keys, holders = np.concatenate(keys), np.concatenate(holders)
            by = np.lexsort((keys, holders))
            keys, holders = keys[by], holders[by]
            new = np.flatnonzero(np.concatenate([[True], (keys[1:] != keys[:-1]) | (holders[1:] != holders[:-1])])) if len(keys) else np.zeros(0, np.int64)
            times = np.diff(np.append(new, len(keys)))
            ids = part["row"].to_numpy(np.int64)
            sizes = np.array([len(w) + 1 if len(w) else 0 for w in part["words"]], np.int64)
            # A row's own line comes with no gram: its key only spreads it.
            none = np.zeros(len(new), np.int64)
            yield pd.DataFrame({"row": np.concatenate([ids, ids[holders[new]]]), "key": np.concatenate([ids, keys[new]]), "n": np.concatenate([np.zeros(n, np.int64), times]), "own": np.concatenate([own, none]), "size": np.concatenate([sizes, none])})
        give_back()

    def logs(keyed: DataFrame) -> DataFrame:
        asked = small_batches(keyed).select("row", word_hashes(F.col("text")).alias("words")).mapInPandas(run, "row bigint, key bigint, n bigint, own bigint, size bigint")
        told = asked.join(weights.select("key", "weight").hint("shuffle_merge"), "key", "left")
        got = F.col("own") + F.coalesce(F.col("n") * F.col("weight"), F.lit(0).cast("bigint"))
        # Equal rows ask alike: their sums are that many times one row's.
        sums = told.groupBy("row").agg(F.sum(got).alias("got"), F.sum("size").alias("size"), F.sum(F.when(F.col("n") == 0, 1).otherwise(0)).alias("alike"))
        n = F.expr("size div alike")
        return keyed.drop("text").join(sums, "row").select("id", "lang", n.alias("n_grams"), (F.expr("got div alike") / float(SCALE) + n * base).alias("logp"))

    out = shelf.put("logs", *[logs(part) for part in by_part(keyed, "row")])
    shared.destroy()
    return out


def score(docs: DataFrame, labels: DataFrame, order: int = ORDER, quantile: float = 0.995, margin: float = 1.5, prior_words: int = 8, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """``id, lang, trusted, n_grams, perplexity, threshold, keep`` for every row."""
    of_docs = dict(docs.dtypes)[id_col]
    good = materialize(labels.where((F.col("quality") == 1) & F.col(id_col).isNotNull()).select(F.col(id_col).cast(of_docs).alias("good_id")).distinct())
    rows = docs.select(F.col(id_col).alias("id"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    shelf = Shelf(docs.sparkSession)
    base, weights = gram_weights(shelf.put(f"level{order}", gram_counts(learnt_texts(rows, good), order)), order, shelf)
    told = document_logs(rows, base, weights, order, shelf).join(good, F.col("id") == F.col("good_id"), "left").withColumn("trusted", F.col("good_id").isNotNull()).drop("good_id")
    told = materialize(told)
    shelf.drop()
    return judged(told, told.where("trusted AND n_grams > 0").where(~in_learnt_half(F.col("id"))), quantile, margin, prior_words)


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The rows of ``docs`` that :func:`score` keeps."""
    return without_rejected(docs, score(docs, labels, id_col=id_col, text_col=text_col, lang_col=lang_col), id_col)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).withColumnRenamed("id", "doc_id")
