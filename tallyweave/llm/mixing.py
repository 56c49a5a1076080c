"""Mixing sources to target weights, in DataFrame functions only.

Leaves are the paths domain / language / source.  A token budget goes down the tree by weight; a child
that cannot use its share leaves the rest to its siblings first, and only what a whole subtree cannot
use reaches its parent's siblings.  Each leaf then takes whole epochs, and of one more epoch the longest
prefix of documents, in that epoch's seeded order, whose tokens fit.

Prefix sums are taken in two steps, over 4096 slices of the order and within a slice: rows are dealt out by
leaf and slice, so a leaf that holds a third of all documents is spread over as many tasks.  The table of
leaves is sent to the rows while it is short; beyond that, rows meet it by leaf and salt.

Contract for odd input: null domain, language or source is the empty string; null or empty texts have no
tokens and are taken when their place in the order lies in the prefix; weights that are not given are 1
and must not be negative; rows with equal ids are ordered by their tokens and otherwise
interchangeable; other columns are carried along only where named.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyweave.llm.common import materialize, table

LEVELS = ("domain", "lang", "source")
#: Leaves up to which their budgets are broadcast (some hundred bytes each); salts of the join beyond that.
MOST_SENT, SALTS = 50_000, 64
Weights = Mapping[str, Mapping[str, int]]
#: Names of the domains that the production query sorts sources into.
DOMAINS = ("web", "books", "forum", "reference")
PRODUCTION: Weights = {"domain": {"web": 4, "books": 3, "forum": 1, "reference": 2}, "lang": {"en": 6, "de": 2, "fr": 2, "es": 2}}


def count_tokens(text: Column) -> Column:
    """Runs of characters other than white space."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^ \t\n\x0b\f\r]+")), F.lit(0)).cast("long")


def _weight(level: str, weights: Weights) -> Column:
    out = F.lit(1)
    for name, w in weights.get(level, {}).items():
        if w < 0:
            raise ValueError("weights must not be negative")
        out = F.when(F.col(level) == name, w).otherwise(out)
    return out


def budgets(leaves: DataFrame, share: float, max_epochs: int, weights: Weights) -> DataFrame:
    """``leaves`` (levels and ``tokens``) with each leaf's ``budget``: water-filling, level by level.

    Children of a node are taken in order of capacity over weight; those that fill up before the level
    of the rest are full, the rest share what is left by weight.
    """
    parents = leaves.agg(F.floor(F.sum("tokens") * share).cast("double").alias("budget"))
    up: list[str] = []
    for level in LEVELS:
        path = [*up, level]
        nodes = leaves.groupBy(*path).agg((F.sum("tokens") * max_epochs).alias("room"), F.sum("tokens").alias("tokens")).withColumn("w", _weight(level, weights))
        nodes = nodes.join(parents, up) if up else nodes.crossJoin(F.broadcast(parents))
        order = Window.partitionBy(*up).orderBy(F.try_divide("room", "w").asc_nulls_last(), level)
        all_of = Window.partitionBy(*up)
        upto = order.rowsBetween(Window.unboundedPreceding, 0)
        line = F.try_divide(F.col("budget") - (F.sum("room").over(upto) - F.col("room")), F.sum("w").over(all_of) - (F.sum("w").over(upto) - F.col("w")))
        nodes = nodes.withColumn("full", (F.col("w") > 0) & (F.col("room") <= F.col("w") * F.coalesce(line, F.lit(0.0))))
        left = F.col("budget") - F.sum(F.when(F.col("full"), F.col("room")).otherwise(0)).over(all_of)
        open_w = F.sum(F.when(F.col("full"), 0).otherwise(F.col("w"))).over(all_of)
        got = F.when(F.col("full"), F.col("room").cast("double")).otherwise(F.coalesce(F.try_divide(F.col("w") * left, open_w), F.lit(0.0)))
        parents = nodes.select(*path, got.alias("budget"), "tokens")
        up = path
        if level != LEVELS[-1]:
            parents = parents.drop("tokens")
    return parents.withColumn("budget", F.floor(F.col("budget") + 1e-6).cast("long"))


def mix(docs: DataFrame, share: float = 0.6, max_epochs: int = 3, weights: Weights = PRODUCTION, seed: int = 17, id_col: str = "doc_id", text_col: str = "text", domain: Column | None = None) -> DataFrame:
    """``id, domain, lang, source, n_tokens, budget, copies`` for every row of ``docs``.

    The budget is ``share`` of the corpus' tokens; no document is taken more than ``max_epochs`` times.
    """
    source = F.coalesce(F.col("source"), F.lit(""))
    if domain is None:
        domain = F.element_at(F.array(*map(F.lit, DOMAINS)), (F.crc32(source.cast("binary")) % len(DOMAINS) + 1).cast("int"))
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(domain, F.lit("")).alias("domain"), F.coalesce("lang", F.lit("")).alias("lang"), source.alias("source"), count_tokens(F.col(text_col)).alias("n_tokens"))
    rows = materialize(rows)  # small rows; the texts are read once
    leaves = rows.groupBy(*LEVELS).agg(F.sum("n_tokens").alias("tokens"))
    plan = materialize(budgets(leaves, share, max_epochs, weights))
    whole = F.when(F.col("tokens") > 0, F.expr("budget div tokens")).otherwise(F.lit(0).cast("long"))
    placed = _with_budget(rows, plan).withColumn("epochs", whole)
    key = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("epochs").cast("string"), F.coalesce(F.col("id").cast("string"), F.lit(""))).cast("binary"))
    placed = placed.withColumn("place", key).withColumn("slice", F.substring("place", 1, 3)).repartition(*LEVELS, "slice")
    # A slice's place among its sixteen, and theirs among the leaf's 256: no task sums more than 256 rows of a leaf.
    sums = placed.groupBy(*LEVELS, "slice").agg(F.sum("n_tokens").alias("in_slice")).withColumn("coarse", F.substring("slice", 1, 2))
    fine = Window.partitionBy(*LEVELS, "coarse").orderBy("slice").rowsBetween(Window.unboundedPreceding, 0)
    sums = sums.withColumn("fine", F.sum("in_slice").over(fine) - F.col("in_slice"))
    coarse = sums.groupBy(*LEVELS, "coarse").agg(F.sum("in_slice").alias("in_coarse"))
    leaf = Window.partitionBy(*LEVELS).orderBy("coarse").rowsBetween(Window.unboundedPreceding, 0)
    coarse = coarse.select(*LEVELS, "coarse", (F.sum("in_coarse").over(leaf) - F.col("in_coarse")).alias("ahead"))
    slices = sums.join(coarse, [*LEVELS, "coarse"]).select(*LEVELS, "slice", (F.col("ahead") + F.col("fine")).alias("before"))
    within = Window.partitionBy(*LEVELS, "slice").orderBy("place", "n_tokens").rowsBetween(Window.unboundedPreceding, 0)
    placed = placed.withColumn("within", F.sum("n_tokens").over(within)).join(slices, [*LEVELS, "slice"])
    fits = (F.col("epochs") < max_epochs) & (F.col("before") + F.col("within") <= F.col("budget") - F.col("epochs") * F.col("tokens"))
    return placed.select("id", *LEVELS, "n_tokens", "budget", (F.col("epochs") + fits.cast("long")).alias("copies"))


def _with_budget(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """Rows with their leaf's budget and tokens; no task gets a leaf's rows as a whole."""
    if plan.limit(MOST_SENT + 1).count() <= MOST_SENT:
        return rows.join(F.broadcast(plan), list(LEVELS))
    salted = plan.select("*", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    return rows.withColumn("salt", F.pmod(F.xxhash64("id", "n_tokens"), F.lit(SALTS)).cast("int")).join(salted, [*LEVELS, "salt"]).drop("salt")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def _level_sql(level: str, up: tuple[str, ...], weights: Weights, max_epochs: int) -> str:
    path = [*up, level]
    cases = " ".join(f"WHEN {level} = '{n}' THEN {w}" for n, w in weights.get(level, {}).items())
    weight = f"CASE {cases} ELSE 1 END" if cases else "1"
    part = f"PARTITION BY {', '.join(up)}" if up else ""
    parent, join = (f"got_{up[-1]}", f"JOIN got_{up[-1]} USING ({', '.join(up)})") if up else ("total", "CROSS JOIN total")
    return f"""
node_{level} AS (SELECT n.*, budget FROM (SELECT {", ".join(path)}, sum(tokens)::BIGINT * {max_epochs} AS room, sum(tokens)::BIGINT AS tokens, {weight} AS w FROM leaves GROUP BY {", ".join(path)}) n {join}),
line_{level} AS (SELECT *, w > 0 AND room <= w * ((budget - (sum(room) OVER o - room)) / (sum(w) OVER ({part}) - (sum(w) OVER o - w))) AS is_full FROM node_{level} WINDOW o AS ({part} ORDER BY room / w, {level} ROWS UNBOUNDED PRECEDING)),
got_{level} AS (SELECT {", ".join(path)}, tokens AS tokens_{level}, CASE WHEN is_full THEN room::DOUBLE
  WHEN sum(CASE WHEN is_full THEN 0 ELSE w END) OVER ({part}) > 0 THEN w * (budget - sum(CASE WHEN is_full THEN room ELSE 0 END) OVER ({part})) / sum(CASE WHEN is_full THEN 0 ELSE w END) OVER ({part}) ELSE 0 END AS budget FROM line_{level})"""


def oracle(share: float = 0.6, max_epochs: int = 3, weights: Weights = PRODUCTION, seed: int = 17) -> str:
    """The production query's twin.  crc32 is spelt out by source name, as SQL here has none."""
    import zlib

    domains = " ".join(f"WHEN 'src{i}' THEN '{DOMAINS[zlib.crc32(f'src{i}'.encode()) % len(DOMAINS)]}'" for i in range(64))
    steps = ",".join(_level_sql(level, LEVELS[:i], weights, max_epochs) for i, level in enumerate(LEVELS))
    return rf"""
WITH docs AS (
  SELECT doc_id, CASE coalesce(source, '') {domains} END AS domain, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         len(regexp_extract_all(coalesce(text, ''), '[^ \t\n\x0b\f\r]+'))::BIGINT AS n_tokens FROM documents
), leaves AS (SELECT domain, lang, source, sum(n_tokens)::BIGINT AS tokens FROM docs GROUP BY ALL
), total AS (SELECT floor(sum(tokens) * {share})::DOUBLE AS budget FROM leaves),{steps},
plan AS (SELECT domain, lang, source, tokens_source AS tokens, floor(budget + 1e-6)::BIGINT AS budget FROM got_source
), placed AS (SELECT *, CASE WHEN tokens > 0 THEN budget // tokens ELSE 0 END AS epochs FROM docs JOIN plan USING (domain, lang, source)
), summed AS (SELECT *, sum(n_tokens) OVER (PARTITION BY domain, lang, source ORDER BY md5('{seed}:' || epochs || ':' || doc_id), n_tokens ROWS UNBOUNDED PRECEDING) AS upto FROM placed)
SELECT doc_id, domain, lang, source, n_tokens, budget, epochs + CASE WHEN epochs < {max_epochs} AND upto <= budget - epochs * tokens THEN 1 ELSE 0 END AS copies FROM summed
"""


ORACLE = oracle()
