"""Queries of calibration and confidence, with their DuckDB twins."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from tallyweave.functions import scoring as sc
from tallyweave.operators import calibration as cal
from tallyweave.operators import ordered as o
from tallyweave.plans.scalar import AGREE, DECISIONS, decisions
from tallyweave.sources.tables import table

ALL: dict[str, tuple] = {}


def query(twin: str | None):
    def add(f):
        ALL[f.__name__] = (f, twin)
        return f

    return add


FUSED = "0.4 * ce + 0.4 * b_score + 0.2 * lex"


def _fused():
    return sc.fused_score(F.col("ce"), F.col("b_score"), F.col("lex"))


@query(f"WITH {DECISIONS} SELECT l_orderkey, l_linenumber, round({FUSED}, 6) AS fused FROM decisions")
def c1_fused_score(spark, sf):
    return decisions(spark, sf).select("l_orderkey", "l_linenumber", F.round(_fused(), 6).alias("fused"))


@query(f"WITH {DECISIONS} SELECT l_orderkey, l_linenumber, CASE WHEN (a_acc OR b_acc OR c_acc) AND recon = 'pass' THEN 1 WHEN NOT (a_acc OR b_acc OR c_acc) AND NOT d THEN 0 END AS pool FROM decisions")
def c2_control_pools(spark, sf):
    any_ = F.col("a_acc") | F.col("b_acc") | F.col("c_acc")
    return decisions(spark, sf).select("l_orderkey", "l_linenumber", cal.control_pool(any_, F.col("d"), F.col("recon")).alias("pool"))


# Control points: quality labels, with a score that overlaps between the classes.
POINTS = "pts AS (SELECT doc_id, 0.5 * quality + (doc_id % 100) / 100.0::DOUBLE * 0.6 AS x, quality AS y FROM labels)"


def _points(spark, sf):
    return table(spark, sf, "labels").select("doc_id", (0.5 * F.col("quality") + F.col("doc_id") % 100 / 100 * 0.6).alias("x"), F.col("quality").alias("y"))


_NEWTON = f"""
{POINTS}, n AS (SELECT count(*) FILTER (WHERE y = 1) AS np, count(*) FILTER (WHERE y = 0) AS nn FROM pts),
tgt AS (SELECT x, CASE WHEN y = 1 THEN (np + 1.0::DOUBLE) / (np + 2) ELSE 1.0::DOUBLE / (nn + 2) END AS t FROM pts, n),
it(k, a, b) AS (SELECT 0, 4.0::DOUBLE, -2.0::DOUBLE UNION ALL
  SELECT k + 1, a - (hbb * ga - hab * gb) / (haa * hbb - hab * hab), b - (haa * gb - hab * ga) / (haa * hbb - hab * hab) FROM (
    SELECT k, a, b, sum((p - t) * x) AS ga, sum(p - t) AS gb, sum(p * (1 - p) * x * x) AS haa, sum(p * (1 - p) * x) AS hab, sum(p * (1 - p)) AS hbb
    FROM (SELECT k, a, b, x, t, 1 / (1 + exp(-(a * x + b))) AS p FROM it, tgt WHERE k < 14) GROUP BY k, a, b))"""


@query(f"WITH RECURSIVE {_NEWTON} SELECT round(a, 5) AS a, round(b, 5) AS b FROM it WHERE k = 14")
def c3_platt_fit(spark, sf):
    a, b = cal.fit_global(_points(spark, sf)) or cal.FALLBACK
    return spark.range(1).select(F.round(F.lit(a), 5).alias("a"), F.round(F.lit(b), 5).alias("b"))


@query("SELECT s_suppkey, round(1 / (1 + exp(-(6 * (s_suppkey % 11 / 10.0::DOUBLE) - 3))), 6) AS p FROM supplier")
def c4_fallback_map(spark, sf):
    a, b = cal.FALLBACK
    return table(spark, sf, "supplier").select("s_suppkey", F.round(sc.sigmoid(a * (F.col("s_suppkey") % 11 / 10) + b), 6).alias("p"))


def _nation_points(spark, sf):
    c = table(spark, sf, "customer")
    y = (F.col("c_acctbal") > 4000).cast("int")
    return c.select("c_nationkey", F.col("c_custkey").alias("id"), (0.4 * y + F.col("c_custkey") % 97 / 97 * F.when(F.col("c_nationkey") % 3 == 0, 0.3).otherwise(0.7)).alias("x"), y.alias("y"))


@query("WITH p AS (SELECT c_nationkey, CASE WHEN c_acctbal > 4000 THEN 1 ELSE 0 END AS y, 0.4 * CASE WHEN c_acctbal > 4000 THEN 1 ELSE 0 END + (c_custkey % 97) / 97.0::DOUBLE * CASE WHEN c_nationkey % 3 = 0 THEN 0.3 ELSE 0.7 END AS x FROM customer) SELECT c_nationkey, max(x) FILTER (WHERE y = 0) < min(x) FILTER (WHERE y = 1) AS separated FROM p GROUP BY c_nationkey")
def c5_separation(spark, sf):
    return cal.separated(_nation_points(spark, sf), ["c_nationkey"])


@query(None)
def c6_jackknife(spark, sf):
    got = cal.calibrate_groups(_nation_points(spark, sf), "c_nationkey")
    return got.select("c_nationkey", "fitted", F.round("loo_max_dp", 6).alias("loo_max_dp"), "loo_degenerate")


_VA = """
p AS (SELECT c_nationkey, c_custkey AS id, CASE WHEN c_acctbal > 4000 THEN 1 ELSE 0 END AS y, 0.4 * CASE WHEN c_acctbal > 4000 THEN 1 ELSE 0 END + (c_custkey % 97) / 97.0::DOUBLE * CASE WHEN c_nationkey % 3 = 0 THEN 0.3 ELSE 0.7 END AS x FROM customer)"""


@query(
    f"WITH {_VA}, ok AS (SELECT c_nationkey FROM p GROUP BY 1 HAVING sum(y) >= 3 AND sum(1 - y) >= 3), "
    """q AS (SELECT DISTINCT c_nationkey, 0.25 AS x FROM p), lab AS (SELECT 0 AS l UNION ALL SELECT 1),
allp AS (SELECT q.c_nationkey, l, p.x, p.y::DOUBLE AS y FROM q JOIN p USING (c_nationkey), lab UNION ALL SELECT c_nationkey, l, x, l::DOUBLE FROM q, lab),
t AS (SELECT c_nationkey, l, x, sum(y) AS s, count(*) AS n FROM allp GROUP BY ALL),
cum AS (SELECT *, sum(s) OVER w AS cs, sum(n) OVER w AS cn FROM t WINDOW w AS (PARTITION BY c_nationkey, l ORDER BY x)),
lo AS (SELECT a.c_nationkey, a.l, a.x, a.cs - a.s AS s0, a.cn - a.n AS n0 FROM cum a WHERE a.x <= 0.25),
hi AS (SELECT c_nationkey, l, x, cs, cn FROM cum WHERE x >= 0.25),
m AS (SELECT lo.c_nationkey, lo.l, lo.x, min((hi.cs - s0) / (hi.cn - n0)) AS v FROM lo JOIN hi ON lo.c_nationkey = hi.c_nationkey AND lo.l = hi.l GROUP BY ALL),
iso AS (SELECT c_nationkey, l, max(v) AS v FROM m GROUP BY ALL)
SELECT c_nationkey, CASE WHEN EXISTS (SELECT 1 FROM ok WHERE ok.c_nationkey = iso.c_nationkey) THEN round(min(v), 6) END AS p0, CASE WHEN EXISTS (SELECT 1 FROM ok WHERE ok.c_nationkey = iso.c_nationkey) THEN round(max(v), 6) END AS p1 FROM iso GROUP BY c_nationkey"""
)
def c7_venn_abers(spark, sf):
    points = _nation_points(spark, sf)
    tests = points.select("c_nationkey").distinct().select("c_nationkey", F.lit(-1).cast("bigint").alias("id"), F.lit(0.25).alias("x"))
    return cal.venn_abers_groups(points, tests, "c_nationkey").select("c_nationkey", F.round("p0", 6).alias("p0"), F.round("p1", 6).alias("p1"))


CONF = f"CASE recon WHEN 'pass' THEN 1 - 0.85 * (1 - p) WHEN 'fail' THEN 0.6 * p ELSE 0.9 * p END"


@query(f"WITH {DECISIONS}, s AS (SELECT *, 1 / (1 + exp(-(10.5 * ({FUSED}) - 3.7))) AS p FROM decisions) SELECT l_orderkey, l_linenumber, round({CONF}, 6) AS confidence FROM s")
def c8_final_confidence(spark, sf):
    return decisions(spark, sf).select("l_orderkey", "l_linenumber", F.round(sc.relation_confidence(_fused(), F.col("recon"), 10.5, -3.7), 6).alias("confidence"))


@query(f"WITH {DECISIONS}, s AS (SELECT *, 1 / (1 + exp(-(10.5 * ({FUSED}) - 3.7))) AS p FROM decisions) SELECT l_orderkey, l_linenumber, round(ce, 4) AS cross_encoder, round(b_score, 4)::DOUBLE AS value_rules, round(lex, 4)::DOUBLE AS lexical, round({FUSED}, 4)::DOUBLE AS fused, CASE recon WHEN 'pass' THEN 1.0 WHEN 'fail' THEN 0.0 ELSE 0.5 END::DOUBLE AS reconciliation, round(({CONF}) / p, 4)::DOUBLE AS validation_factor FROM s")
def c8_components(spark, sf):
    parts = sc.confidence_components(F.col("ce"), F.col("b_score"), F.col("lex"), F.col("recon"), 10.5, -3.7)
    return decisions(spark, sf).select("l_orderkey", "l_linenumber", parts.alias("c")).select("l_orderkey", "l_linenumber", "c.*").drop("venn_abers_p0", "venn_abers_p1")


@query(f"WITH {DECISIONS}, s AS (SELECT *, 1 / (1 + exp(-(10.5 * ({FUSED}) - 3.7))) AS p, {AGREE} AS agreement FROM decisions) SELECT l_orderkey, l_linenumber, round({CONF}, 6) < 0.5 OR l_orderkey % 10 = 0 OR agreement = 'd_only' OR l_orderkey % 13 = 0 AS low FROM s")
def c9_low_confidence(spark, sf):
    p = F.round(sc.relation_confidence(_fused(), F.col("recon"), 10.5, -3.7), 6)
    agreement = sc.agreement(F.col("a_acc"), F.col("b_acc"), F.col("c_acc"), F.col("d"))
    low = sc.low_confidence(p, F.col("l_orderkey") % 10 != 0, agreement == "d_only", F.col("l_orderkey") % 13 != 0)
    return decisions(spark, sf).select("l_orderkey", "l_linenumber", low.alias("low"))


_READ = "r AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, 1 - l_discount * 5 AS conf, l_quantity::INT::VARCHAR AS own, CASE WHEN l_partkey % 3 = 0 THEN NULL WHEN l_partkey % 3 = 1 THEN l_quantity::INT::VARCHAR ELSE (l_quantity::INT + 1)::VARCHAR END AS other, l_linenumber % 4 <> 0 AS eligible FROM lineitem)"


def _reads(spark, sf):
    q = F.col("l_quantity").cast("int")
    other = F.when(F.col("l_partkey") % 3 == 1, q.cast("string")).when(F.col("l_partkey") % 3 == 2, (q + 1).cast("string"))
    cells = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", (1 - F.col("l_discount") * 5).alias("conf"), q.cast("string").alias("own"), (F.col("l_linenumber") % 4 != 0).alias("eligible"))
    reads = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", other.alias("other")).where("other IS NOT NULL")
    return cells.join(reads, ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"], "left")


@query(f"WITH {_READ} SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(CASE WHEN eligible AND other IS NOT NULL THEN CASE WHEN own = other THEN least(1.0, conf * 1.05) ELSE least(conf, 0.4) END ELSE conf END, 6)::DOUBLE AS conf FROM r")
def c10_engine_update(spark, sf):
    checked = F.col("eligible") & F.col("other").isNotNull()
    conf = F.when(checked, sc.engine_update(F.col("conf"), F.col("own") == F.col("other"))).otherwise(F.col("conf"))
    return _reads(spark, sf).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.round(conf, 6).alias("conf"))


@query(f"WITH {_READ} SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN NOT eligible OR other IS NULL THEN 'skipped' WHEN own = other THEN 'agree' ELSE 'disagree' END AS verdict FROM r")
def j22_second_reads(spark, sf):
    verdict = F.when(~F.col("eligible") | F.col("other").isNull(), "skipped").when(F.col("own") == F.col("other"), "agree").otherwise("disagree")
    return _reads(spark, sf).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", verdict.alias("verdict"))


@query(f"WITH {_READ} SELECT l_orderkey % 25 AS page, count(*) FILTER (WHERE eligible AND other IS NOT NULL) AS checked, count(*) FILTER (WHERE eligible AND own = other) AS agree, count(*) FILTER (WHERE eligible AND own <> other) AS disagree, count(*) FILTER (WHERE NOT eligible OR other IS NULL) AS skipped FROM r GROUP BY 1")
def a17_engine_stats(spark, sf):
    ok = F.col("eligible") & F.col("other").isNotNull()
    return _reads(spark, sf).groupBy((F.col("l_orderkey") % 25).alias("page")).agg(F.count_if(ok).alias("checked"), F.count_if(ok & (F.col("own") == F.col("other"))).alias("agree"), F.count_if(ok & (F.col("own") != F.col("other"))).alias("disagree"), F.count_if(~ok).alias("skipped"))


# Bisection on the binomial tail: forty halvings of both ends.
_ENDS = """
h AS (SELECT c_nationkey, count(*) FILTER (WHERE c_acctbal > 0) AS k, count(*) AS n FROM customer GROUP BY 1),
e AS (SELECT *, unnest([0, 1]) AS hi FROM h),
it(c_nationkey, k, n, hi, step, a, z) AS (SELECT c_nationkey, k, n, hi, 0, 0.0::DOUBLE, 1.0::DOUBLE FROM e UNION ALL
  SELECT c_nationkey, k, n, hi, step + 1, CASE WHEN right_ THEN m ELSE a END, CASE WHEN right_ THEN z ELSE m END FROM (
    SELECT *, CASE WHEN hi = 0 THEN t < 0.025 ELSE 1 - t > 0.025 END AS right_ FROM (
      SELECT *, (a + z) / 2 AS m, list_sum(list_transform(range(k + hi, n + 1), lambda i: exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln((a + z) / 2) + (n - i) * ln(1 - (a + z) / 2)))) AS t FROM it WHERE step < 40)))"""


@query(f"WITH RECURSIVE {_ENDS} SELECT c_nationkey, k, n, round(max(CASE WHEN hi = 0 THEN CASE WHEN k = 0 THEN 0 ELSE (a + z) / 2 END END), 6)::DOUBLE AS low, round(max(CASE WHEN hi = 1 THEN CASE WHEN k = n THEN 1 ELSE (a + z) / 2 END END), 6)::DOUBLE AS high FROM it WHERE step = 40 GROUP BY ALL")
def c11_clopper_pearson(spark, sf):
    # hits among a nation's customers: counts are aggregated, intervals need one number pair each
    hits = table(spark, sf, "customer").groupBy("c_nationkey").agg(F.count_if(F.col("c_acctbal") > 0).alias("k"), F.count("*").alias("n"))
    ends = F.pandas_udf(lambda k, n: pd.Series([[round(x, 6) for x in sc.clopper_pearson(*kn)] for kn in zip(k, n, strict=True)]), "array<double>")
    return hits.withColumn("ends", ends("k", "n")).select("c_nationkey", "k", "n", F.col("ends")[0].alias("low"), F.col("ends")[1].alias("high"))


@query("WITH h AS (SELECT c_nationkey, count(*) FILTER (WHERE c_acctbal > 0 AND c_custkey % 2 = 0) AS b, count(*) FILTER (WHERE c_acctbal <= 0 AND c_custkey % 2 = 1) AS c FROM customer GROUP BY 1), t AS (SELECT *, b + c AS n, unnest(range(least(b, c) + 1)) AS i FROM h) SELECT c_nationkey, b, c, round(least(1.0, 2 * sum(exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) - n * ln(2)))), 6)::DOUBLE AS p_value FROM t GROUP BY ALL")
def c12_mcnemar(spark, sf):
    pairs = table(spark, sf, "customer").groupBy("c_nationkey").agg(F.count_if((F.col("c_acctbal") > 0) & (F.col("c_custkey") % 2 == 0)).alias("b"), F.count_if((F.col("c_acctbal") <= 0) & (F.col("c_custkey") % 2 == 1)).alias("c"))
    p = F.pandas_udf(lambda b, c: pd.Series([round(sc.mcnemar_exact(*bc), 6) for bc in zip(b, c, strict=True)]), "double")
    return pairs.select("c_nationkey", "b", "c", p("b", "c").alias("p_value"))


@query(None)
def c13_loo_brier(spark, sf):
    return cal.calibrate_groups(_nation_points(spark, sf), "c_nationkey").select("c_nationkey", F.round("loo_brier", 6).alias("loo_brier"))


@query(f"WITH {POINTS}, s AS (SELECT doc_id, 1 / (1 + exp(-(6 * x - 3))) AS p, y FROM pts), q AS (SELECT *, row_number() OVER (ORDER BY p, doc_id) - 1 AS pos, count(*) OVER () AS n FROM s) SELECT CASE WHEN pos >= 3 * n // 4 THEN 3 WHEN pos >= 2 * n // 4 THEN 2 WHEN pos >= n // 4 THEN 1 ELSE 0 END AS part, count(*) AS points, round(avg(p), 6) AS mean_p, round(avg(y), 6) AS share FROM q GROUP BY 1")
def c13_reliability(spark, sf):
    p = _points(spark, sf).withColumns({"p": sc.sigmoid(6 * F.col("x") - 3), "all": F.lit(1)})
    parts = o.position_quartile(p, ["all"], ["p", "doc_id"])
    return parts.groupBy("part").agg(F.count("*").alias("points"), F.round(F.avg("p"), 6).alias("mean_p"), F.round(F.avg("y"), 6).alias("share"))


@query(None)
def c14_leave_self_out(spark, sf):
    points = _nation_points(spark, sf)
    return cal.venn_abers_groups(points, points.select("c_nationkey", "id", "x"), "c_nationkey", leave_self_out=True).select("c_nationkey", "id", F.round("p0", 6).alias("p0"), F.round("p1", 6).alias("p1"))


@query(f"WITH {POINTS} SELECT round(avg((1 / (1 + exp(-(6 * x - 3))) - y) ** 2), 6) AS brier FROM pts")
def a15_brier(spark, sf):
    return _points(spark, sf).agg(F.round(cal.brier(sc.sigmoid(6 * F.col("x") - 3), F.col("y")), 6).alias("brier"))


@query(f"WITH {POINTS}, r AS (SELECT y, x, rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2.0 AS r FROM pts) SELECT round((sum(r) FILTER (WHERE y = 1) - count(*) FILTER (WHERE y = 1) * (count(*) FILTER (WHERE y = 1) + 1) / 2.0) / (count(*) FILTER (WHERE y = 1) * count(*) FILTER (WHERE y = 0)), 6)::DOUBLE AS auc FROM r")
def c15_auc(spark, sf):
    """Rank-sum form over counts by score: ties are pooled, so the ranked rows are distinct scores."""
    by = _points(spark, sf).groupBy("x").agg(F.count_if(F.col("y") == 1).alias("pos"), F.count_if(F.col("y") == 0).alias("neg"))
    won = o.running_total(by, "x", "neg").withColumn("won", F.col("pos") * (F.col("upto") - F.col("neg") / 2))
    return won.agg(F.round(F.sum("won") / (F.sum("pos") * F.sum("neg")), 6).alias("auc"))


@query(f"WITH {POINTS}, r AS (SELECT rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2.0 AS rx, rank() OVER (ORDER BY doc_id % 7) + (count(*) OVER (PARTITION BY doc_id % 7) - 1) / 2.0 AS ry FROM pts) SELECT round(corr(rx, ry), 6) AS rho FROM r")
def c15_spearman(spark, sf):
    return cal.spearman(_points(spark, sf).withColumn("z", F.col("doc_id") % 7), "x", "z").select(F.round("rho", 6).alias("rho"))
