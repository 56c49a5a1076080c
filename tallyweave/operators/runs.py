"""Analytics over stored runs: enrichment, diffs, queues, expected cost, scoring against a reference.

Runs are DataFrames of relations, cells, rows, tables and checks keyed by stable ids; diffs are full outer
joins with null-safe comparison, everything else aggregation.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyweave.functions.scoring import p_star

UNKNOWN, UNLABELLED = "?", "(etiketsiz toplam)"
CURVE_STEPS = 20


def relation_key(*cols: str) -> Column:
    return F.concat_ws("|", *[F.col(c).cast("string") for c in cols])


def enrich(df: DataFrame, rows: DataFrame, tables: DataFrame, row_col: str, prefix: str = "") -> DataFrame:
    """``df`` with the label and page of the row it names; unknown rows and blank labels get stand-ins."""
    r = rows.select(F.col("row_id").alias("__r"), "table_id", "label_raw")
    t = tables.select(F.col("table_id").alias("__t"), "page")
    out = df.join(r, F.col(row_col) == F.col("__r"), "left").join(t, F.col("table_id") == F.col("__t"), "left")
    label = F.when(F.col("__r").isNull(), UNKNOWN).when(F.coalesce("label_raw", F.lit("")) == "", UNLABELLED).otherwise(F.col("label_raw"))
    return out.withColumns({f"{prefix}label": label, f"{prefix}page": F.col("page")}).drop("__r", "__t", *([] if prefix == "" else ["page"]), "table_id", "label_raw")


def diff(a: DataFrame, b: DataFrame, keys: Sequence[str], compare: Sequence[str]) -> DataFrame:
    """Full outer diff: ``side`` (both, only_a, only_b), both values and ``<col>_changed`` for each column."""
    keys = list(keys)
    left = a.select(*keys, *[F.col(c).alias(f"{c}_a") for c in compare], F.lit(True).alias("__a"))
    right = b.select(*keys, *[F.col(c).alias(f"{c}_b") for c in compare], F.lit(True).alias("__b"))
    met = left.join(right, keys, "full")
    side = F.when(F.col("__a").isNotNull() & F.col("__b").isNotNull(), "both").when(F.col("__a").isNotNull(), "only_a").otherwise("only_b")
    changed = {f"{c}_changed": ~F.col(f"{c}_a").eqNullSafe(F.col(f"{c}_b")) for c in compare}
    return met.withColumn("side", side).withColumns(changed).drop("__a", "__b")


def remap_scopes(checks: DataFrame, relations: DataFrame) -> DataFrame:
    """Checks on a relation id move to the relation's stable key, as ids shift between runs."""
    ids = relations.select(F.col("relation_id").alias("__id"), F.col("key").alias("__key"))
    return checks.join(ids, F.col("scope") == F.col("__id"), "left").withColumn("scope", F.coalesce("__key", "scope")).drop("__id", "__key")


def review_order() -> list[Column]:
    """Flagged first, then the wider interval, then the lower confidence."""
    return [F.coalesce("low_confidence", F.lit(False)).desc(), F.coalesce("va_width", F.lit(0.0)).desc(), F.coalesce("confidence", F.lit(1.0)).asc()]


def cell_queue(cells: DataFrame, limit: float = 0.5) -> DataFrame:
    return cells.where((F.coalesce("confidence", F.lit(1.0)) <= limit) | F.coalesce("repaired", F.lit(False)))


def needs_review(threshold: Column | float) -> Column:
    return (F.coalesce("confidence", F.lit(0.0)) < threshold) | F.coalesce("low_confidence", F.lit(False))


def expected_cost(relations: DataFrame, keys: Sequence[str], c_review: float, c_miss: float) -> DataFrame:
    """Per key: how many to review at p*, and the expected cost at p*, of reviewing all, of none."""
    review = needs_review(p_star(c_review, c_miss))
    risk = (1 - F.coalesce("confidence", F.lit(0.0))) * c_miss
    return relations.groupBy(*keys).agg(
        F.count_if(review).alias("review"),
        F.sum(F.when(review, F.lit(float(c_review))).otherwise(risk)).alias("at_p_star"),
        (F.count("*") * float(c_review)).alias("review_all"),
        F.sum(risk).alias("review_none"),
    )


def threshold_curve(relations: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``keys, step, review``: how many need review at step/20; one pass, a counter for each step."""
    counts = relations.groupBy(*keys).agg(*[F.count_if(needs_review(i / CURVE_STEPS)).alias(f"s{i}") for i in range(CURVE_STEPS + 1)])
    steps = F.array(*[F.struct(F.lit(i).alias("step"), F.col(f"s{i}").alias("review")) for i in range(CURVE_STEPS + 1)])
    return counts.select(*keys, F.explode(steps).alias("p")).select(*keys, "p.*")


def accepted_precision(labelled: DataFrame, keys: Sequence[str], threshold: float) -> DataFrame:
    """What reviewers said of the accept set; precision is null without a verdict."""
    accept = ~needs_review(threshold)
    said = lambda *v: F.col("label").isin(*v)
    out = labelled.groupBy(*keys).agg(F.count_if(accept & said("accept", "reject")).alias("n"), F.count_if(accept & said("accept")).alias("ok"), F.count_if(accept & said("reject")).alias("rejects"), F.count_if(~accept & said("accept")).alias("accepts_in_review"))
    return out.withColumn("precision", F.when(F.col("n") > 0, F.col("ok") / F.col("n"))).drop("ok")


def precision_recall(predicted: DataFrame, gold: DataFrame, on: Sequence[str]) -> DataFrame:
    """One row: tp, fp, fn, precision, recall over distinct edges; empty sides divide by one."""
    p, g = predicted.select(*on).distinct().withColumn("p", F.lit(1)), gold.select(*on).distinct().withColumn("g", F.lit(1))
    met = p.join(g, list(on), "full").agg(F.count_if(F.col("p").isNotNull() & F.col("g").isNotNull()).alias("tp"), F.count_if(F.col("g").isNull()).alias("fp"), F.count_if(F.col("p").isNull()).alias("fn"))
    one = F.lit(1)
    return met.withColumns({"precision": F.col("tp") / F.greatest(one, F.col("tp") + F.col("fp")), "recall": F.col("tp") / F.greatest(one, F.col("tp") + F.col("fn"))})


def best_match(scored: DataFrame, keys: Sequence[str], candidate: str, least: float) -> DataFrame:
    """For each key the candidate of the best (score, overlap); the first candidate wins ties."""
    best = F.max(F.struct("score", "overlap", (-F.col(candidate)).alias("__c")))
    out = scored.groupBy(*keys).agg(best.alias("b"))
    return out.select(*keys, (-F.col("b.__c")).alias(candidate), F.col("b.score").alias("score"), F.col("b.overlap").alias("overlap")).where(F.col("score") >= least)


def cell_buckets() -> list[Column]:
    """Counters over gold cells joined to extracted ones (state, raw against got_state, got_raw)."""
    found, same_state = F.col("got_state").isNotNull(), F.col("got_state") == F.col("state")
    number = F.col("state") == "number"
    return [
        F.count("*").alias("total"),
        F.count_if(found & same_state & (~number | (F.col("got_raw") == F.col("raw")))).alias("correct"),
        F.count_if(found & same_state & number & (F.col("got_raw") != F.col("raw"))).alias("wrong_value"),
        F.count_if(found & ~same_state).alias("wrong_state"),
        F.count_if(~found & F.col("row_found")).alias("missing_cell"),
        F.count_if(~found & ~F.col("row_found")).alias("missing_row"),
    ]


def status_counts(df: DataFrame, keys: Sequence[str], by: str, values: Sequence[str]) -> DataFrame:
    """A count for each value: the values are named, so no pass is spent to find them."""
    return df.groupBy(*keys).agg(*[F.count_if(F.col(by) == v).alias(v) for v in values])


def geometry_fallback(rows: DataFrame, cells: DataFrame, tables: DataFrame) -> DataFrame:
    """Row boxes: their own, else the union of their cells', with the table's width."""
    union = cells.groupBy("row_id").agg(F.min("cy0").alias("cy0"), F.max("cy1").alias("cy1"))
    out = rows.join(union, "row_id", "left").join(tables.select("table_id", "tx0", "tx1"), "table_id", "left")
    return out.select("row_id", F.coalesce("x0", "tx0").alias("x0"), F.coalesce("y0", "cy0").alias("y0"), F.coalesce("x1", "tx1").alias("x1"), F.coalesce("y1", "cy1").alias("y1"))


def inferred_rotation(boxes: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Boxes that leave the page tell that it was read on its side."""
    top = boxes.groupBy(*keys).agg(F.max("x1").alias("mx"), F.max("y1").alias("my"), F.first("width").alias("w"), F.first("height").alias("h"))
    return top.select(*keys, F.when((F.col("mx") > F.col("w")) & (F.col("my") <= F.col("w")), 90).otherwise(0).alias("rotation"))
