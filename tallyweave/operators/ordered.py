"""Ordered operators: ranks, islands, gap clusters, running repairs, nearest and as-of matches.

All are windows or joins over named columns.  Every order is total, so results do not depend on how
rows were dealt out.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

Keys = Sequence[str]
BEFORE = (Window.unboundedPreceding, -1)
UPTO = (Window.unboundedPreceding, 0)
AFTER = (1, Window.unboundedFollowing)


def stable_rank(df: DataFrame, keys: Keys, score: str, ordinal: str, name: str = "rank") -> DataFrame:
    """1..n by falling score; equal scores keep the order of ``ordinal``."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(F.col(score).desc(), F.col(ordinal))))


def gap_islands(df: DataFrame, keys: Keys, value: str, gap: float | Column, order: Keys = (), name: str = "island") -> DataFrame:
    """Numbers runs of values; a new run begins where a value lies more than ``gap`` above the one before.

    Rows without a value come last, as in SQL, and begin no run.
    """
    w = Window.partitionBy(*keys).orderBy(*[F.col(c).asc_nulls_last() for c in (value, *order)])
    new = (F.col(value) - F.lag(value).over(w) > gap).cast("int")
    return df.withColumn("__new", F.coalesce(new, F.lit(0))).withColumn(name, F.sum("__new").over(w.rowsBetween(*UPTO))).drop("__new")


def gap_clusters(df: DataFrame, keys: Keys, value: str, gap: float | Column) -> DataFrame:
    """One row for each cluster: its number from the left, centre, extent and size."""
    runs = gap_islands(df.select(*keys, value), keys, value, gap, name="cluster")
    return runs.groupBy(*keys, "cluster").agg(F.avg(value).alias("center"), F.min(value).alias("low"), F.max(value).alias("high"), F.count("*").alias("size"))


def broken_islands(df: DataFrame, keys: Keys, seq: str, kind: str, member: str = "data", breaker: str = "prose", hole: int = 2) -> DataFrame:
    """Islands of ``member`` rows: up to ``hole`` other rows may lie between, no ``breaker`` may."""
    w = Window.partitionBy(*keys).orderBy(seq)
    marked = df.withColumn("__breaks", F.sum((F.col(kind) == breaker).cast("int")).over(w.rowsBetween(*UPTO)))
    members = marked.where(F.col(kind) == member)
    new = (F.col(seq) - F.lag(seq).over(w) > hole + 1) | (F.col("__breaks") != F.lag("__breaks").over(w))
    members = members.withColumn("__new", F.coalesce(new.cast("int"), F.lit(0)))
    return members.withColumn("island", F.sum("__new").over(w.rowsBetween(*UPTO))).drop("__new", "__breaks")


def consecutive_runs(df: DataFrame, keys: Keys, number: str, name: str = "run") -> DataFrame:
    """Rows whose numbers follow one another share a run."""
    return df.withColumn(name, F.col(number) - F.row_number().over(Window.partitionBy(*keys).orderBy(number)))


def monotone_repair(df: DataFrame, keys: Keys, order: Keys, value: str, name: str = "repaired") -> DataFrame:
    """Values below an earlier one are dropped; a dropped value never exceeds the running maximum."""
    top = F.max(value).over(Window.partitionBy(*keys).orderBy(*order).rowsBetween(*BEFORE))
    return df.withColumn(name, F.when(F.col(value) >= F.coalesce(top, F.col(value)), F.col(value)))


def neighbour_bounds(df: DataFrame, keys: Keys, order: Keys, value: str, default_low: int, default_high: int) -> DataFrame:
    """``low``: the largest value before; ``high``: the smallest after."""
    w = Window.partitionBy(*keys).orderBy(*order)
    low, high = F.max(value).over(w.rowsBetween(*BEFORE)), F.min(value).over(w.rowsBetween(*AFTER))
    return df.withColumns({"low": F.coalesce(low, F.lit(default_low)), "high": F.coalesce(high, F.lit(default_high))})


def forward_fill(df: DataFrame, keys: Keys, order: Keys, value: str, name: str) -> DataFrame:
    """The last value seen so far."""
    return df.withColumn(name, F.last(value, ignorenulls=True).over(Window.partitionBy(*keys).orderBy(*order).rowsBetween(*UPTO)))


def nearest(points: DataFrame, targets: DataFrame, keys: Keys, at: str, center: str, number: str, tolerance: float | Column) -> DataFrame:
    """Each point with its nearest target of the same key, within ``tolerance``; ties go to the lower number.

    Targets of a key are few (columns of a table), so they meet a point as one short list: the join adds no rows.
    """
    lists = targets.groupBy(*keys).agg(F.collect_list(F.struct(F.col(center).alias("c"), F.col(number).alias("k"))).alias("__targets"))
    best = F.array_min(F.transform("__targets", lambda t: F.struct(F.abs(F.col(at) - t["c"]).alias("distance"), t["k"].alias("k"))))
    met = points.join(lists, list(keys)).withColumn("__best", best)
    return met.select(*points.columns, F.col("__best.distance").alias("distance"), F.col("__best.k").alias(number)).where(F.col("distance") <= tolerance)


def last_smaller(df: DataFrame, keys: Keys, order: str, level: str, row_id: str, name: str = "parent") -> DataFrame:
    """As-of: the last earlier row with a smaller level.

    Rows from the top hold a stack of open levels, each with its last row: a fold over a table's rows that drops
    what is not smaller.  One shuffle by key, no self join, any number of levels.
    """
    kind = dict(df.dtypes)
    mine = F.struct(F.col(order).alias("o"), F.col(level).alias("l"), F.col(row_id).alias("r"), F.struct(*df.columns).alias("row"))
    tables = df.groupBy(*[F.col(k).alias(f"__{k}") for k in keys]).agg(F.sort_array(F.collect_list(mine)).alias("all"))
    entry = f"struct<l:{kind[level]},r:{kind[row_id]}>"
    start = F.struct(F.array().cast(f"array<{entry}>").alias("open"), F.array().cast(f"array<{kind[row_id]}>").alias("told"))

    def add(acc: Column, x: Column) -> Column:
        smaller = F.filter(acc["open"], lambda e: e["l"] < x["l"])
        here = F.struct(x["l"].alias("l"), x["r"].alias("r")).cast(entry)
        return F.struct(F.concat(smaller, F.array(here)).alias("open"), F.concat(acc["told"], F.array(F.get(smaller, F.size(smaller) - 1)["r"])).alias("told"))

    told = tables.withColumn("told", F.aggregate("all", start, add, lambda acc: acc["told"]))
    return told.select(F.posexplode("all").alias("at", "x"), "told").select("x.row.*", F.get("told", F.col("at")).alias(name))


def position_quartile(df: DataFrame, keys: Keys, order: Keys, parts: int = 4, name: str = "part") -> DataFrame:
    """Part j holds positions [j*n//parts, (j+1)*n//parts): unlike ntile, later parts are the larger."""
    w = Window.partitionBy(*keys).orderBy(*order)
    pos, n = F.row_number().over(w) - 1, F.count("*").over(Window.partitionBy(*keys))
    return df.withColumns({"__pos": pos, "__n": n}).withColumn(name, F.expr(f"(({parts} * (__pos + 1) - 1) div __n)").cast("int")).drop("__pos", "__n")


def last_write_wins(df: DataFrame, keys: Keys, order: Keys) -> DataFrame:
    """The newest row of each key."""
    newest = F.row_number().over(Window.partitionBy(*keys).orderBy(*[F.col(c).desc() for c in order]))
    return df.withColumn("__nth", newest).where("__nth = 1").drop("__nth")


def running_total(df: DataFrame, order: str, value: str, name: str = "upto", buckets: int = 4096) -> DataFrame:
    """``df``, one row for each number ``order``, with the sum of ``value`` up to and with it.

    Rows are summed within equal stretches of the numbers' range, and a stretch starts from the total of
    those before it: no task takes all rows, and what is sent to them is a row for each stretch.
    """
    at = F.col(order).cast("double")
    ends = df.agg(F.min(at).alias("__low"), F.max(at).alias("__high"))
    share = F.coalesce(F.try_divide(at - F.col("__low"), F.col("__high") - F.col("__low")), F.lit(0.0))
    dealt = df.crossJoin(F.broadcast(ends)).withColumn("__part", F.floor(share * buckets).cast("int")).drop("__low", "__high")
    totals = dealt.groupBy("__part").agg(F.sum(value).alias("__sum"))
    before = totals.select("__part", F.coalesce(F.sum("__sum").over(Window.orderBy("__part").rowsBetween(*BEFORE)), F.lit(0)).alias("__before"))
    within = F.sum(value).over(Window.partitionBy("__part").orderBy(order).rowsBetween(*UPTO))
    return dealt.join(F.broadcast(before), "__part").withColumn(name, F.col("__before") + within).drop("__part", "__before")
