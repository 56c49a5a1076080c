"""Queries of run analytics, filters, sets and scoring, with their DuckDB twins.

Run a and run b are two takes of the order lines: lines come and go, confidences and verdicts move.
"""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyweave.functions import grammar as g
from tallyweave.operators import assembly as asm
from tallyweave.operators import ordered as o
from tallyweave.operators import pages as pg
from tallyweave.operators import runs as rn
from tallyweave.plans.layout import STATEMENT, statement_words
from tallyweave.sources.tables import table

ALL: dict[str, tuple] = {}


def query(twin: str | None):
    def add(f):
        ALL[f.__name__] = (f, twin)
        return f

    return add


KEY = ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")
K = ", ".join(KEY)


def rels(spark, sf, run):
    li = table(spark, sf, "lineitem")
    li = li.where("l_linenumber <= 5" if run == "a" else "l_linenumber >= 2")
    conf = F.round(1 - F.col("l_discount") * 8, 4)
    if run == "b":
        conf = F.round(conf - F.when(F.col("l_suppkey") % 10 == 0, 0.05).otherwise(0.0), 4)
    agreement = F.when(F.col("l_returnflag") == "R", "consensus").when(F.col("l_returnflag") == "A", "b_only").otherwise("a_only")
    if run == "b":
        agreement = F.when(F.col("l_partkey") % 20 == 0, "none").otherwise(agreement)
    width = F.when(F.col("l_linenumber") % 3 > 0, F.round(F.col("l_tax") * 2, 4))
    out = li.select(*KEY, "l_quantity", "l_tax", "l_linestatus", conf.alias("confidence"), agreement.alias("agreement"), width.alias("va_width"))
    return out.withColumn("low_confidence", F.col("confidence") < 0.5)


def _run(r):
    conf = "round(1 - l_discount * 8, 4)"
    conf = conf if r == "a" else f"round({conf} - CASE WHEN l_suppkey % 10 = 0 THEN 0.05 ELSE 0.0 END, 4)"
    agree = "CASE WHEN l_returnflag = 'R' THEN 'consensus' WHEN l_returnflag = 'A' THEN 'b_only' ELSE 'a_only' END"
    agree = agree if r == "a" else f"CASE WHEN l_partkey % 20 = 0 THEN 'none' ELSE {agree} END"
    return f"rel_{r} AS (SELECT {K}, l_quantity, l_tax, l_linestatus, {conf} AS confidence, {agree} AS agreement, CASE WHEN l_linenumber % 3 > 0 THEN round(l_tax * 2, 4) END AS va_width, {conf} < 0.5 AS low_confidence FROM lineitem WHERE {'l_linenumber <= 5' if r == 'a' else 'l_linenumber >= 2'})"


A, B = _run("a"), _run("b")


@query("SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, CASE WHEN c_custkey IS NULL THEN '?' WHEN c_custkey % 7 = 0 THEN '(etiketsiz toplam)' ELSE c_name END AS label, n_regionkey AS page FROM lineitem LEFT JOIN customer ON c_custkey = l_partkey LEFT JOIN nation ON n_nationkey = c_nationkey")
def j13_enrich(spark, sf):
    rows = table(spark, sf, "customer").select(F.col("c_custkey").alias("row_id"), F.col("c_nationkey").alias("table_id"), F.when(F.col("c_custkey") % 7 == 0, "").otherwise(F.col("c_name")).alias("label_raw"))
    tables = table(spark, sf, "nation").select(F.col("n_nationkey").alias("table_id"), F.col("n_regionkey").alias("page"))
    return rn.enrich(table(spark, sf, "lineitem").select(*KEY), rows, tables, "l_partkey")


@query(f"WITH {A}, lab AS (SELECT doc_id, CASE WHEN toxic = 1 THEN 'reject' WHEN quality = 1 THEN 'accept' ELSE 'unsure' END AS label FROM labels) SELECT {K}, label, CASE WHEN confidence < 0.8 OR low_confidence THEN 'review' ELSE 'accept' END AS decision FROM rel_a JOIN lab ON doc_id = l_orderkey")
def j14_label_export(spark, sf):
    lab = F.when(F.col("toxic") == 1, "reject").when(F.col("quality") == 1, "accept").otherwise("unsure")
    labels = table(spark, sf, "labels").select(F.col("doc_id").alias("l_orderkey"), lab.alias("label"))
    return rels(spark, sf, "a").join(labels, "l_orderkey").select(*KEY, "label", F.when(rn.needs_review(0.8), "review").otherwise("accept").alias("decision"))


_MET = f"{A}, {B}, met AS (SELECT coalesce(a.l_orderkey, b.l_orderkey) AS l_orderkey, coalesce(a.l_partkey, b.l_partkey) AS l_partkey, coalesce(a.l_suppkey, b.l_suppkey) AS l_suppkey, coalesce(a.l_linenumber, b.l_linenumber) AS l_linenumber, CASE WHEN a.confidence IS NOT NULL AND b.confidence IS NOT NULL THEN 'both' WHEN a.confidence IS NOT NULL THEN 'only_a' ELSE 'only_b' END AS side, a.confidence AS ca, b.confidence AS cb, a.agreement AS aa, b.agreement AS ab, a.low_confidence AS la, b.low_confidence AS lb FROM rel_a a FULL JOIN rel_b b ON a.l_orderkey = b.l_orderkey AND a.l_partkey = b.l_partkey AND a.l_suppkey = b.l_suppkey AND a.l_linenumber = b.l_linenumber)"


def _diff(spark, sf):
    return rn.diff(rels(spark, sf, "a"), rels(spark, sf, "b"), KEY, ["confidence", "agreement", "low_confidence"])


@query(f"WITH {_MET} SELECT {K}, side, round(cb - ca, 4) AS delta, aa IS DISTINCT FROM ab AS agreement_changed, la IS DISTINCT FROM lb AS flag_changed FROM met")
def j15_run_diff(spark, sf):
    return _diff(spark, sf).select(*KEY, "side", F.round(F.col("confidence_b") - F.col("confidence_a"), 4).alias("delta"), "agreement_changed", F.col("low_confidence_changed").alias("flag_changed"))


@query(f"WITH {_MET} SELECT l_suppkey, count(*) FILTER (WHERE side = 'only_a') AS only_base, count(*) FILTER (WHERE side = 'only_b') AS only_here, round(coalesce(max(abs(round(cb - ca, 4))) FILTER (WHERE side = 'both'), 0), 4)::DOUBLE AS max_abs_delta, count(*) FILTER (WHERE side = 'both' AND la <> lb) AS flags_changed FROM met GROUP BY l_suppkey")
def a9_run_headline(spark, sf):
    both = F.col("side") == "both"
    delta = F.abs(F.round(F.col("confidence_b") - F.col("confidence_a"), 4))
    return _diff(spark, sf).groupBy("l_suppkey").agg(F.count_if(F.col("side") == "only_a").alias("only_base"), F.count_if(F.col("side") == "only_b").alias("only_here"), F.round(F.coalesce(F.max(F.when(both, delta)), F.lit(0.0)), 4).alias("max_abs_delta"), F.count_if(both & F.col("low_confidence_changed")).alias("flags_changed"))


@query("WITH r AS (SELECT o_orderkey, 'rel' || row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS relation_id, o_custkey || '|' || o_orderkey AS key, o_custkey FROM orders), c AS (SELECT o_custkey, CASE WHEN o_orderkey % 3 = 0 THEN 'page1' ELSE relation_id END AS scope, o_orderkey FROM r) SELECT c.o_orderkey, coalesce(r.key, c.scope) AS scope FROM c LEFT JOIN r ON r.relation_id = c.scope AND r.o_custkey = c.o_custkey")
def j16_remap_scopes(spark, sf):
    od = table(spark, sf, "orders").withColumn("n", F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")))
    rid = F.concat(F.col("o_custkey").cast("string"), F.lit("/rel"), F.col("n").cast("string"))
    relations = od.select(rid.alias("relation_id"), rn.relation_key("o_custkey", "o_orderkey").alias("key"))
    checks = od.select("o_orderkey", F.when(F.col("o_orderkey") % 3 == 0, "page1").otherwise(rid).alias("scope"))
    return rn.remap_scopes(checks, relations).select("o_orderkey", "scope")


@query("WITH g AS (SELECT o_custkey, o_orderkey, floor(o_totalprice / 50000)::INT AS v FROM orders), t AS (SELECT a.o_custkey, a.o_orderkey AS gold, b.o_orderkey AS cand, 100 - abs(a.v - b.v) * 10 AS score, CASE WHEN a.v = b.v THEN 1 ELSE 0 END AS overlap FROM g a JOIN g b ON a.o_custkey = b.o_custkey AND a.o_orderkey <> b.o_orderkey), r AS (SELECT *, row_number() OVER (PARTITION BY gold ORDER BY score DESC, overlap DESC, cand) AS rn FROM t) SELECT gold, cand, score, overlap FROM r WHERE rn = 1 AND score >= 55")
def j19_best_row_match(spark, sf):
    """Also j17's second pass and j18: the best candidate by similarity, then by shared values."""
    v = table(spark, sf, "orders").select("o_custkey", "o_orderkey", F.floor(F.col("o_totalprice") / 50000).cast("int").alias("v"))
    a, b = v.select("o_custkey", F.col("o_orderkey").alias("gold"), F.col("v").alias("gv")), v.select("o_custkey", F.col("o_orderkey").alias("cand"), "v")
    pairs = a.join(b, "o_custkey").where("gold <> cand").select("gold", "cand", (100 - F.abs(F.col("gv") - F.col("v")) * 10).alias("score"), (F.col("gv") == F.col("v")).cast("int").alias("overlap"))
    return rn.best_match(pairs, ["gold"], "cand", 55).select("gold", "cand", "score", "overlap")


@query("WITH t AS (SELECT l_orderkey, l_suppkey % 4 AS tbl, list_distinct(list(l_quantity::INT)) AS vals FROM lineitem GROUP BY ALL), gold AS (SELECT l_orderkey, list_distinct(list(l_quantity::INT) FILTER (WHERE l_returnflag = 'R')) AS gv FROM lineitem GROUP BY 1), s AS (SELECT t.l_orderkey, tbl, len(list_intersect(vals, gv)) AS n FROM t JOIN gold USING (l_orderkey) WHERE len(gv) > 0), r AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY n DESC, tbl) AS rn FROM s) SELECT l_orderkey, tbl, n AS overlap FROM r WHERE rn = 1")
def j18_table_by_overlap(spark, sf):
    li = table(spark, sf, "lineitem").select("l_orderkey", (F.col("l_suppkey") % 4).alias("tbl"), F.col("l_quantity").cast("int").alias("q"), "l_returnflag")
    sets = li.groupBy("l_orderkey", "tbl").agg(F.collect_set("q").alias("vals"))
    gold = li.where("l_returnflag = 'R'").groupBy("l_orderkey").agg(F.collect_set("q").alias("gv"))
    scored = sets.join(gold, "l_orderkey").select("l_orderkey", "tbl", F.size(F.array_intersect("vals", "gv")).alias("score"), F.lit(0).alias("overlap"))
    return rn.best_match(scored, ["l_orderkey"], "tbl", 0).select("l_orderkey", "tbl", F.col("score").alias("overlap"))


@query("WITH gp AS (SELECT c_custkey, unnest(['2012', '2011']) AS gid, unnest([0, 1]) AS gi FROM customer), ep AS (SELECT c_custkey, unnest(CASE WHEN c_custkey % 3 = 0 THEN ['col0', 'col1'] ELSE ['y2011', 'y2012'] END) AS pid, unnest([0, 1]) AS ei FROM customer), m AS (SELECT gp.c_custkey, gid, gi, max(pid) FILTER (WHERE contains(pid, gid)) AS named, max(pid) FILTER (WHERE ei = gi) AS placed FROM gp JOIN ep USING (c_custkey) GROUP BY ALL) SELECT c_custkey, gid, coalesce(named, placed) AS pid FROM m")
def j20_period_map(spark, sf):
    c = table(spark, sf, "customer").select("c_custkey")
    gold = c.select("c_custkey", F.posexplode(F.array(F.lit("2012"), F.lit("2011"))).alias("gi", "gid"))
    got = c.select("c_custkey", F.posexplode(F.when(F.col("c_custkey") % 3 == 0, F.array(F.lit("col0"), F.lit("col1"))).otherwise(F.array(F.lit("y2011"), F.lit("y2012")))).alias("ei", "pid"))
    met = gold.join(got, "c_custkey").groupBy("c_custkey", "gid", "gi").agg(F.max(F.when(F.contains("pid", F.col("gid")), F.col("pid"))).alias("named"), F.max(F.when(F.col("ei") == F.col("gi"), F.col("pid"))).alias("placed"))
    return met.select("c_custkey", "gid", F.coalesce("named", "placed").alias("pid"))


@query("WITH reg AS (SELECT n_nationkey AS id, n_name AS title FROM nation), st AS (SELECT c_nationkey AS id, count(*) AS relations, count(*) FILTER (WHERE c_acctbal < 0) AS low FROM customer WHERE c_nationkey % 4 <> 0 GROUP BY 1), base AS (SELECT relations AS base FROM st WHERE id = 1) SELECT id, title, CASE WHEN relations IS NULL THEN 'absent' ELSE 'done' END AS state, relations, low, relations - base AS vs_baseline FROM reg LEFT JOIN st USING (id) LEFT JOIN base ON true")
def j23_scenario_matrix(spark, sf):
    """Also y4's matrix: the registry with what is stored for each scenario and how it differs from one."""
    reg = table(spark, sf, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("title"))
    st = table(spark, sf, "customer").where("c_nationkey % 4 <> 0").groupBy(F.col("c_nationkey").alias("id")).agg(F.count("*").alias("relations"), F.count_if(F.col("c_acctbal") < 0).alias("low"))
    base = st.where("id = 1").agg(F.max("relations").alias("base"))
    out = reg.join(st, "id", "left").crossJoin(F.broadcast(base))
    return out.select("id", "title", F.when(F.col("relations").isNull(), "absent").otherwise("done").alias("state"), "relations", "low", (F.col("relations") - F.col("base")).alias("vs_baseline"))


@query("WITH r AS (SELECT o_orderkey AS row_id, o_custkey AS table_id, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_orderkey % 100 END AS y0 FROM orders), c AS (SELECT l_orderkey AS row_id, min(l_linenumber * 10) AS cy0, max(l_linenumber * 10 + 8) AS cy1 FROM lineitem GROUP BY 1) SELECT r.row_id, table_id % 50 AS x0, coalesce(r.y0, cy0) AS y0, table_id % 50 + 500 AS x1, coalesce(r.y0 + 8, cy1) AS y1 FROM r LEFT JOIN c ON c.row_id = r.row_id")
def j24_geometry_fallback(spark, sf):
    y0 = F.when(F.col("o_orderkey") % 3 != 0, F.col("o_orderkey") % 100)
    none = F.lit(None).cast("bigint")
    rows = table(spark, sf, "orders").select(F.col("o_orderkey").alias("row_id"), F.col("o_custkey").alias("table_id"), none.alias("x0"), y0.alias("y0"), none.alias("x1"), (y0 + 8).alias("y1"))
    cells = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("row_id"), (F.col("l_linenumber") * 10).alias("cy0"), (F.col("l_linenumber") * 10 + 8).alias("cy1"))
    tables = table(spark, sf, "customer").select(F.col("c_custkey").alias("table_id"), (F.col("c_custkey") % 50).alias("tx0"), (F.col("c_custkey") % 50 + 500).alias("tx1"))
    return rn.geometry_fallback(rows, cells, tables)


@query("SELECT e.event_id, c_custkey AS run FROM events e JOIN customer ON sha256('doc' || c_custkey) = sha256('doc' || (e.user_id * 2))")
def j25_annotation_runs(spark, sf):
    sha = lambda c: F.sha2(F.concat(F.lit("doc"), c.cast("string")).cast("binary"), 256)
    notes = table(spark, sf, "events").select("event_id", sha(F.col("user_id") * 2).alias("sha"))
    return notes.join(table(spark, sf, "customer").select(F.col("c_custkey").alias("run"), sha(F.col("c_custkey")).alias("sha")), "sha").select("event_id", "run")


@query("WITH i AS (SELECT user_id, event_id, epoch(date_trunc('second', ts))::BIGINT AS s FROM events), r AS (SELECT * FROM i WHERE event_id % 3 = 0), l AS (SELECT * FROM i WHERE event_id % 3 <> 0) SELECT l.event_id FROM l WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.user_id = l.user_id AND l.s < r.s + 7200 AND l.s + 600 > r.s)")
def j9_interval_anti_join(spark, sf):
    s = F.expr("timestampdiff(SECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts)")
    i = table(spark, sf, "events").select("user_id", "event_id", s.alias("s"))
    r = i.where("event_id % 3 = 0").select("user_id", F.col("s").alias("r0"), (F.col("s") + 7200).alias("r1"))
    lines = i.where("event_id % 3 <> 0")
    return lines.join(r, (lines["user_id"] == r["user_id"]) & (F.col("s") < F.col("r1")) & (F.col("s") + 600 > F.col("r0")), "left_anti").select("event_id")


@query("WITH i AS (SELECT user_id, event_id, epoch(date_trunc('second', ts))::BIGINT AS s FROM events) SELECT l.event_id, count(*) AS windows FROM i l JOIN i r ON r.user_id = l.user_id AND r.event_id % 5 = 0 AND l.s BETWEEN r.s - 3600 AND r.s + 3600 GROUP BY 1")
def j10_point_in_window(spark, sf):
    s = F.expr("timestampdiff(SECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts)")
    i = table(spark, sf, "events").select("user_id", "event_id", s.alias("s"))
    r = i.where("event_id % 5 = 0").select("user_id", F.col("s").alias("c"))
    return i.join(r, "user_id").where(F.col("s").between(F.col("c") - 3600, F.col("c") + 3600)).groupBy("event_id").agg(F.count("*").alias("windows"))


# --- aggregates ----------------------------------------------------------------------------------------


_CONF_ROWS = """rw AS (SELECT l_orderkey, l_linenumber, any_value(CASE WHEN l_linenumber % 3 = 0 THEN '' ELSE 'Kalem' END) AS label, avg(1 - l_discount) FILTER (WHERE l_linenumber % 4 <> 0) AS m FROM lineitem GROUP BY ALL),
rc AS (SELECT *, coalesce(greatest(0, least(1, m * (1 - CASE WHEN label = '' THEN 0.15::DOUBLE ELSE 0 END))), 0.3) AS c FROM rw)"""


@query(f"WITH {_CONF_ROWS} SELECT l_orderkey, round(avg(c) * (0.7 + 0.3 * CASE WHEN l_orderkey % 5 = 0 THEN 1.0::DOUBLE ELSE (l_orderkey % 3) / 2.0::DOUBLE END), 10)::DOUBLE AS table_conf FROM rc GROUP BY l_orderkey")
def a6_row_table_confidence(spark, sf):
    li = table(spark, sf, "lineitem")
    rows = li.select("l_orderkey", "l_linenumber", F.when(F.col("l_linenumber") % 3 == 0, "").otherwise("Kalem").alias("label")).distinct()
    cells = li.where("l_linenumber % 4 <> 0").select("l_orderkey", "l_linenumber", (1 - F.col("l_discount")).alias("conf"))
    rated = asm.row_confidence(cells, rows, ["l_orderkey", "l_linenumber"])
    counted = rated.withColumns({"columns": F.when(F.col("l_orderkey") % 5 == 0, 0).otherwise(2), "periods": (F.col("l_orderkey") % 3).cast("int")})
    return asm.table_confidence(counted, ["l_orderkey"]).select("l_orderkey", F.round("table_conf", 10).alias("table_conf"))


@query(f"WITH {A} SELECT l_linestatus, count(*) FILTER (WHERE agreement = 'consensus') AS consensus, count(*) FILTER (WHERE agreement = 'a_only') AS a_only, count(*) FILTER (WHERE agreement = 'b_only') AS b_only FROM rel_a GROUP BY 1")
def a7_status_counts(spark, sf):
    return rn.status_counts(rels(spark, sf, "a"), ["l_linestatus"], "agreement", ["consensus", "a_only", "b_only"])


@query("SELECT o_orderkey, regexp_extract('mode=' || lower(o_orderpriority) || ' n=' || o_custkey, 'mode=([a-z0-9-]+)', 1) AS mode FROM orders")
def a8_mode_from_detail(spark, sf):
    detail = F.concat(F.lit("mode="), F.lower("o_orderpriority"), F.lit(" n="), F.col("o_custkey").cast("string"))
    return table(spark, sf, "orders").select("o_orderkey", F.regexp_extract(detail, "mode=([a-z0-9-]+)", 1).alias("mode"))


@query("SELECT quality, count(*) FILTER (WHERE toxic = 1) AS reject, count(*) FILTER (WHERE toxic = 0) AS accept FROM labels GROUP BY quality")
def a10_label_summary(spark, sf):
    lab = table(spark, sf, "labels").select("quality", F.when(F.col("toxic") == 1, "reject").otherwise("accept").alias("label"))
    return rn.status_counts(lab, ["quality"], "label", ["reject", "accept"])


_REVIEW = "(confidence < 0.95 OR low_confidence)"


@query(f"WITH {A} SELECT l_suppkey, count(*) FILTER (WHERE {_REVIEW}) AS review, round(sum(CASE WHEN {_REVIEW} THEN 1.0 ELSE (1 - confidence) * 20 END), 4)::DOUBLE AS at_p_star, count(*)::DOUBLE AS review_all, round(sum((1 - confidence) * 20), 4)::DOUBLE AS review_none FROM rel_a GROUP BY 1")
def a11_expected_cost(spark, sf):
    got = rn.expected_cost(rels(spark, sf, "a"), ["l_suppkey"], 1.0, 20.0)
    return got.select("l_suppkey", "review", F.round("at_p_star", 4).alias("at_p_star"), "review_all", F.round("review_none", 4).alias("review_none"))


@query(f"WITH {A}, s AS (SELECT unnest(range(21))::INT AS step) SELECT step, count(*) FILTER (WHERE confidence < step / 20.0::DOUBLE OR low_confidence) AS review FROM rel_a, s GROUP BY step")
def a11_threshold_curve(spark, sf):
    return rn.threshold_curve(rels(spark, sf, "a").withColumn("all", F.lit(1)), ["all"]).select("step", "review")


@query(f"WITH {A}, lab AS (SELECT doc_id, CASE WHEN toxic = 1 THEN 'reject' WHEN quality = 1 THEN 'accept' ELSE 'unsure' END AS label FROM labels), j AS (SELECT l_linestatus, label, confidence < 0.8 OR low_confidence AS rev FROM rel_a JOIN lab ON doc_id = l_orderkey) SELECT l_linestatus, count(*) FILTER (WHERE NOT rev AND label <> 'unsure') AS n, count(*) FILTER (WHERE NOT rev AND label = 'reject') AS rejects, count(*) FILTER (WHERE rev AND label = 'accept') AS accepts_in_review, round(count(*) FILTER (WHERE NOT rev AND label = 'accept') / nullif(count(*) FILTER (WHERE NOT rev AND label <> 'unsure'), 0)::DOUBLE, 6) AS precision FROM j GROUP BY 1")
def a12_reviewer_precision(spark, sf):
    lab = F.when(F.col("toxic") == 1, "reject").when(F.col("quality") == 1, "accept").otherwise("unsure")
    labels = table(spark, sf, "labels").select(F.col("doc_id").alias("l_orderkey"), lab.alias("label"))
    got = rn.accepted_precision(rels(spark, sf, "a").join(labels, "l_orderkey"), ["l_linestatus"], 0.8)
    return got.withColumn("precision", F.round("precision", 6))


_CELLS = "g AS (SELECT l_suppkey, CASE WHEN l_linenumber % 5 = 0 THEN 'dash' ELSE 'number' END AS state, l_quantity::INT::VARCHAR AS raw, l_partkey % 13 > 0 AS row_found, CASE WHEN l_partkey % 13 = 0 OR l_partkey % 11 = 0 THEN NULL WHEN l_partkey % 7 = 0 THEN 'empty' WHEN l_linenumber % 5 = 0 THEN 'dash' ELSE 'number' END AS got_state, CASE WHEN l_partkey % 9 = 0 THEN 'x' ELSE l_quantity::INT::VARCHAR END AS got_raw FROM lineitem)"


@query(f"WITH {_CELLS} SELECT l_suppkey, count(*) AS total, count(*) FILTER (WHERE got_state = state AND (state <> 'number' OR got_raw = raw)) AS correct, count(*) FILTER (WHERE got_state = state AND state = 'number' AND got_raw <> raw) AS wrong_value, count(*) FILTER (WHERE got_state <> state) AS wrong_state, count(*) FILTER (WHERE got_state IS NULL AND row_found) AS missing_cell, count(*) FILTER (WHERE got_state IS NULL AND NOT row_found) AS missing_row FROM g GROUP BY 1")
def a13_cell_buckets(spark, sf):
    dash, pk = F.col("l_linenumber") % 5 == 0, F.col("l_partkey")
    state = F.when(dash, "dash").otherwise("number")
    raw = F.col("l_quantity").cast("int").cast("string")
    got = F.when((pk % 13 == 0) | (pk % 11 == 0), None).when(pk % 7 == 0, "empty").otherwise(state)
    cells = table(spark, sf, "lineitem").select("l_suppkey", state.alias("state"), raw.alias("raw"), (pk % 13 > 0).alias("row_found"), got.alias("got_state"), F.when(pk % 9 == 0, "x").otherwise(raw).alias("got_raw"))
    return cells.groupBy("l_suppkey").agg(*rn.cell_buckets())


@query(f"WITH {A}, {B}, p AS (SELECT DISTINCT {K} FROM rel_a), g AS (SELECT DISTINCT {K} FROM rel_b), n AS (SELECT (SELECT count(*) FROM (SELECT * FROM p INTERSECT SELECT * FROM g)) AS tp, (SELECT count(*) FROM (SELECT * FROM p EXCEPT SELECT * FROM g)) AS fp, (SELECT count(*) FROM (SELECT * FROM g EXCEPT SELECT * FROM p)) AS fn) SELECT tp, fp, fn, round(tp / greatest(1, tp + fp)::DOUBLE, 6) AS precision, round(tp / greatest(1, tp + fn)::DOUBLE, 6) AS recall FROM n")
def a14_precision_recall(spark, sf):
    got = rn.precision_recall(rels(spark, sf, "a"), rels(spark, sf, "b"), KEY)
    return got.select("tp", "fp", "fn", F.round("precision", 6).alias("precision"), F.round("recall", 6).alias("recall"))


@query("WITH e AS (SELECT o_custkey, CASE WHEN o_orderkey % 7 = 0 THEN NULL WHEN o_orderkey % 5 = 0 THEN 99 ELSE row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) END AS parsed, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS place FROM orders) SELECT o_custkey, count(parsed) > 0 AND count(*) FILTER (WHERE parsed = place) * 10 >= count(parsed) * 6 AS renumber FROM e GROUP BY 1")
def a16_majority_agreement(spark, sf):
    place = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))
    e = table(spark, sf, "orders").select("o_custkey", "o_orderkey", place.alias("place"))
    e = e.withColumn("parsed", F.when(F.col("o_orderkey") % 7 != 0, F.when(F.col("o_orderkey") % 5 == 0, 99).otherwise(F.col("place"))))
    return e.groupBy("o_custkey").agg(((F.count("parsed") > 0) & (F.count_if(F.col("parsed") == F.col("place")) * 10 >= F.count("parsed") * 6)).alias("renumber"))


@query("SELECT substr(l_shipdate::DATE::VARCHAR, 1, 4) AS yr, sum(l_linenumber) AS cells, sum(CASE WHEN l_discount > 0.05 THEN 1 ELSE 0 END) AS mismatch FROM lineitem GROUP BY 1")
def a18_merged_stats(spark, sf):
    return table(spark, sf, "lineitem").groupBy(F.substring(F.col("l_shipdate").cast("string"), 1, 4).alias("yr")).agg(F.sum("l_linenumber").alias("cells"), F.sum((F.col("l_discount") > 0.05).cast("int")).alias("mismatch"))


@query("WITH s AS (SELECT l_orderkey, list_distinct(list(l_quantity::INT) FILTER (WHERE l_linenumber <= 3)) AS a, list_distinct(list(l_quantity::INT) FILTER (WHERE l_linenumber > 3)) AS b FROM lineitem GROUP BY 1) SELECT l_orderkey, coalesce(len(list_intersect(a, b)), 0) AS overlap FROM s")
def a19_value_overlap(spark, sf):
    q = F.col("l_quantity").cast("int")
    s = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.collect_set(F.when(F.col("l_linenumber") <= 3, q)).alias("a"), F.collect_set(F.when(F.col("l_linenumber") > 3, q)).alias("b"))
    return s.select("l_orderkey", F.size(F.array_intersect("a", "b")).alias("overlap"))


@query("SELECT o_custkey, CASE WHEN bool_or(o_totalprice > 300000) THEN 'pass' WHEN bool_and(o_totalprice < 100000) THEN 'fail' ELSE 'not_evaluable' END AS verdict FROM orders GROUP BY 1")
def a20_verdict_votes(spark, sf):
    p = F.col("o_totalprice")
    return table(spark, sf, "orders").groupBy("o_custkey").agg(F.when(F.bool_or(p > 300000), "pass").when(F.bool_and(p < 100000), "fail").otherwise("not_evaluable").alias("verdict"))


@query("WITH b AS (SELECT l_orderkey, max(l_partkey % 1000 * (1 + l_orderkey % 2)) AS mx, max(l_suppkey % 500) AS my FROM lineitem GROUP BY 1) SELECT l_orderkey, CASE WHEN mx > 1000 AND my <= 1000 THEN 90 ELSE 0 END AS rotation FROM b")
def a21_rotation(spark, sf):
    boxes = table(spark, sf, "lineitem").select("l_orderkey", (F.col("l_partkey") % 1000 * (1 + F.col("l_orderkey") % 2)).alias("x1"), (F.col("l_suppkey") % 500).alias("y1"), F.lit(1000).alias("width"), F.lit(1400).alias("height"))
    return rn.inferred_rotation(boxes, ["l_orderkey"])


@query("SELECT c_nationkey AS page, count(*) FILTER (WHERE c_mktsegment = 'BUILDING') AS summary, count(*) FILTER (WHERE c_mktsegment <> 'BUILDING') AS footnote FROM customer GROUP BY 1")
def a22_tables_per_page(spark, sf):
    s = F.col("c_mktsegment") == "BUILDING"
    return table(spark, sf, "customer").groupBy(F.col("c_nationkey").alias("page")).agg(F.count_if(s).alias("summary"), F.count_if(~s).alias("footnote"))


# --- order, limits, filters, sets ----------------------------------------------------------------------


@query(f"WITH {A} SELECT {K}, 'rel' || (row_number() OVER (PARTITION BY l_orderkey ORDER BY l_partkey, l_suppkey, l_linenumber) - 1) AS relation_id FROM rel_a")
def k2_ordered_decisions(spark, sf):
    n = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_partkey", "l_suppkey", "l_linenumber")) - 1
    return rels(spark, sf, "a").select(*KEY, F.concat(F.lit("rel"), n.cast("string")).alias("relation_id"))


@query(f"WITH {A} SELECT {K}, row_number() OVER (PARTITION BY l_suppkey ORDER BY low_confidence DESC, coalesce(va_width, 0) DESC, confidence, l_orderkey, l_partkey, l_linenumber) AS place FROM rel_a")
def k3_review_queue(spark, sf):
    w = Window.partitionBy("l_suppkey").orderBy(*rn.review_order(), "l_orderkey", "l_partkey", "l_linenumber")
    return rels(spark, sf, "a").select(*KEY, F.row_number().over(w).alias("place"))


@query(f"WITH {A} SELECT {K}, row_number() OVER (PARTITION BY l_suppkey ORDER BY confidence, l_orderkey, l_partkey, l_linenumber) AS place FROM rel_a WHERE confidence <= 0.5 OR l_partkey % 17 = 0")
def k4_cell_queue(spark, sf):
    """Also p8: unsure or repaired cells, the least sure first."""
    q = rn.cell_queue(rels(spark, sf, "a").withColumn("repaired", F.col("l_partkey") % 17 == 0))
    w = Window.partitionBy("l_suppkey").orderBy("confidence", "l_orderkey", "l_partkey", "l_linenumber")
    return q.select(*KEY, F.row_number().over(w).alias("place"))


@query("SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) AS place FROM orders")
def k5_newest_first(spark, sf):
    w = Window.partitionBy("o_custkey").orderBy(F.col("o_orderdate").desc(), "o_orderkey")
    return table(spark, sf, "orders").select("o_orderkey", F.row_number().over(w).alias("place"))


@query("WITH t AS (SELECT o_custkey, o_orderkey, o_orderpriority, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS rn FROM orders) SELECT o_custkey, min_by(o_orderkey, rn) AS first_hit FROM t WHERE rn <= 6 AND o_orderpriority = '1-URGENT' GROUP BY 1")
def k6_first_match(spark, sf):
    top = table(spark, sf, "orders").withColumn("rn", F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))).where("rn <= 6")
    return top.where("o_orderpriority = '1-URGENT'").groupBy("o_custkey").agg(F.min_by("o_orderkey", "rn").alias("first_hit"))


@query("SELECT l_orderkey, count(*) AS n FROM lineitem WHERE l_linenumber BETWEEN 2 AND 4 OR l_linenumber IN (6, 7) GROUP BY 1")
def p1_page_range(spark, sf):
    ln = F.col("l_linenumber")
    return table(spark, sf, "lineitem").where(ln.between(2, 4) | ln.isin(6, 7)).groupBy("l_orderkey").agg(F.count("*").alias("n"))


@query("WITH r AS (SELECT o_custkey, list(o_orderkey % 30) AS refs FROM orders GROUP BY 1) SELECT o_custkey FROM r WHERE list_contains(refs, 11)")
def p2_rows_with_ref(spark, sf):
    r = table(spark, sf, "orders").groupBy("o_custkey").agg(F.collect_list(F.col("o_orderkey") % 30).alias("refs"))
    return r.where(F.array_contains("refs", F.lit(11).cast("bigint"))).select("o_custkey")


# A row for each line of an order; its cells stand in columns, none for every third line.
@query("WITH r AS (SELECT l_orderkey, l_linenumber, any_value(CASE WHEN l_linenumber % 5 = 0 THEN 'Faiz oranı' ELSE 'Kalem' END) AS label, CASE WHEN l_linenumber % 3 = 0 THEN [] WHEN l_orderkey % 2 = 0 THEN [l_linenumber % 2] ELSE list_distinct(list(l_suppkey % 3)) END AS cols FROM lineitem GROUP BY l_orderkey, l_linenumber), t AS (SELECT l_orderkey, count(*) AS n, count(*) FILTER (WHERE contains(label, 'oran')) AS rates, count(*) FILTER (WHERE len(cols) >= 2) AS several FROM r GROUP BY 1), u AS (SELECT l_orderkey, max(n) AS used FROM (SELECT l_orderkey, c, count(*) AS n FROM (SELECT l_orderkey, unnest(cols) AS c FROM r) GROUP BY ALL) GROUP BY 1) SELECT t.l_orderkey FROM t LEFT JOIN u USING (l_orderkey) WHERE rates >= 2 OR CASE WHEN several = 0 THEN n >= 3 AND coalesce(used, 0) >= 3 ELSE several >= 2 OR n >= 3 END")
def p5_coherent_tables(spark, sf):
    li = table(spark, sf, "lineitem")
    label = F.when(F.col("l_linenumber") % 5 == 0, "Faiz oranı").otherwise("Kalem")
    seen = F.transform(F.collect_set(F.col("l_suppkey") % 3), lambda c: F.struct(c.alias("col")))
    one = F.array(F.struct((F.col("l_linenumber") % 2).cast("bigint").alias("col")))
    rows = li.groupBy("l_orderkey", "l_linenumber").agg(seen.alias("seen"))
    cells = F.when(F.col("l_linenumber") % 3 == 0, F.slice("seen", 1, 0)).when(F.col("l_orderkey") % 2 == 0, one).otherwise(F.col("seen"))
    tables = rows.groupBy("l_orderkey").agg(F.collect_list(F.struct(label.alias("label"), cells.alias("cells"))).alias("rows"))
    return tables.where(pg.coherent(F.col("rows"))).select("l_orderkey")


@query(f"WITH {STATEMENT}, r AS (SELECT doc_id, line, text, (x0 + x1) / 2 AS c FROM statement WHERE regexp_matches(text, '^[0-9]{{1,2}}$')) SELECT doc_id, line, text AS ref, c BETWEEN 1000 AND 1015 AS phantom FROM r")
def p6_phantom_refs(spark, sf):
    r = statement_words(spark, sf).where(g.is_small_ref(F.col("text")))
    return r.select("doc_id", "line", F.col("text").alias("ref"), ((F.col("x0") + F.col("x1")) / 2).between(1000, 1015).alias("phantom"))


@query(f"WITH {A} SELECT {K} FROM rel_a WHERE agreement <> 'a_only' OR confidence > 0.7")
def p7_emitted_relations(spark, sf):
    accepted = F.exists(F.array(F.col("agreement") != "a_only", F.col("confidence") > 0.7), lambda x: x)
    return rels(spark, sf, "a").where(accepted).select(*KEY)


@query("SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber FROM lineitem WHERE CASE WHEN l_linenumber % 2 = 0 THEN 1 - l_tax ELSE 1.0 END < 1.0")
def p9_engine_disagreements(spark, sf):
    m = F.when(F.col("l_linenumber") % 2 == 0, F.create_map(F.lit("engine_agreement"), 1 - F.col("l_tax"))).otherwise(F.create_map(F.lit("ocr"), F.lit(0.5).cast("double")))
    return table(spark, sf, "lineitem").where(F.coalesce(F.try_element_at(m, F.lit("engine_agreement")), F.lit(1.0)) < 1.0).select(*KEY)


@query("SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_nationkey = 3) OR contains(o_orderpriority, 'URG') AND o_orderstatus = 'F'")
def p10_page_slice(spark, sf):
    on = table(spark, sf, "customer").where("c_nationkey = 3").select(F.col("c_custkey").alias("o_custkey")).withColumn("hit", F.lit(True))
    return table(spark, sf, "orders").join(on, "o_custkey", "left").where(F.col("hit").isNotNull() | (F.contains("o_orderpriority", F.lit("URG")) & (F.col("o_orderstatus") == "F"))).select("o_orderkey")


@query("SELECT event_id FROM events WHERE contains(lower(props), '\"k\": 7')")
def p11_line_search(spark, sf):
    return table(spark, sf, "events").where(F.contains(F.lower("props"), F.lit('"k": 7'))).select("event_id")


@query(f"WITH {A} SELECT {K}, confidence < 0.8 OR low_confidence AS review FROM rel_a")
def p13_review_split(spark, sf):
    return rels(spark, sf, "a").select(*KEY, rn.needs_review(0.8).alias("review"))


@query(f"WITH {A}, {B} SELECT l_orderkey, count(*) AS n FROM (SELECT {K} FROM rel_a UNION ALL SELECT {K} FROM rel_b) GROUP BY 1")
def u1_union(spark, sf):
    return rels(spark, sf, "a").select(*KEY).unionByName(rels(spark, sf, "b").select(*KEY)).groupBy("l_orderkey").agg(F.count("*").alias("n"))


@query(f"WITH {A}, {B} SELECT role, count(*) AS n FROM (SELECT 'main' AS role, {K} FROM rel_a UNION ALL SELECT 'control', {K} FROM rel_b WHERE l_linenumber > 5) GROUP BY 1")
def u2_control_union(spark, sf):
    """Also x10: control decisions join the fit and never the output."""
    a = rels(spark, sf, "a").select(F.lit("main").alias("role"), *KEY)
    return a.unionByName(rels(spark, sf, "b").where("l_linenumber > 5").select(F.lit("control").alias("role"), *KEY)).groupBy("role").agg(F.count("*").alias("n"))


@query(f"WITH {A}, {B} SELECT {K} FROM rel_a INTERSECT SELECT {K} FROM rel_b")
def u3_intersect(spark, sf):
    return rels(spark, sf, "a").select(*KEY).intersect(rels(spark, sf, "b").select(*KEY))


@query(f"WITH {_MET} SELECT side, count(*) AS n FROM met GROUP BY 1")
def u4_key_union(spark, sf):
    return _diff(spark, sf).groupBy("side").agg(F.count("*").alias("n"))


@query("SELECT s_suppkey, 'a b c ' || s_suppkey AS kept FROM supplier")
def u5_ordered_distinct(spark, sf):
    a = F.array(F.lit("a"), F.lit("b"), F.lit("a"), F.lit("c"), F.col("s_suppkey").cast("string"), F.lit("b"))
    return table(spark, sf, "supplier").select("s_suppkey", F.array_join(F.array_distinct(a), " ").alias("kept"))


@query("WITH s AS (SELECT DISTINCT l_orderkey, list_sort(list_distinct(list(l_returnflag))) AS members FROM lineitem GROUP BY l_orderkey, l_linestatus) SELECT l_orderkey, count(*) AS sets FROM s GROUP BY 1")
def u6_distinct_sets(spark, sf):
    s = table(spark, sf, "lineitem").groupBy("l_orderkey", "l_linestatus").agg(F.sort_array(F.collect_set("l_returnflag")).alias("members"))
    return s.dropDuplicates(["l_orderkey", "members"]).groupBy("l_orderkey").agg(F.count("*").alias("sets"))


@query(f"WITH {A}, {B} SELECT {K} FROM rel_b WHERE low_confidence EXCEPT SELECT {K} FROM rel_a WHERE low_confidence")
def u7_new_failures(spark, sf):
    return rels(spark, sf, "b").where("low_confidence").select(*KEY).join(rels(spark, sf, "a").where("low_confidence").select(*KEY), list(KEY), "left_anti")


# --- ordered searches ----------------------------------------------------------------------------------


@query("WITH r AS (SELECT o_custkey, o_orderkey, o_orderpriority LIKE '1%' AS stone FROM orders) SELECT o_custkey, o_orderkey, sum(stone::INT) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS segment FROM r")
def w12_milestone_segments(spark, sf):
    stone = F.col("o_orderpriority").startswith("1").cast("int")
    w = Window.partitionBy("o_custkey").orderBy("o_orderkey").rowsBetween(*o.BEFORE)
    return table(spark, sf, "orders").select("o_custkey", "o_orderkey", F.sum(stone).over(w).alias("segment"))


@query("WITH v AS (SELECT o_custkey, o_orderkey, floor(o_totalprice / 100000)::BIGINT AS v, sum(floor(o_totalprice / 100000)::BIGINT) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS upto FROM orders) SELECT a.o_custkey, a.o_orderkey, min(b.o_orderkey) AS closes_at FROM v a JOIN v b ON a.o_custkey = b.o_custkey AND b.o_orderkey > a.o_orderkey AND b.upto - a.upto = a.v WHERE a.v > 0 GROUP BY ALL")
def w10_run_until_equal(spark, sf):
    """Where the rows after one first add up to it: an equi-join on prefix sums."""
    v = table(spark, sf, "orders").select("o_custkey", "o_orderkey", F.floor(F.col("o_totalprice") / 100000).alias("v"))
    v = v.withColumn("upto", F.sum("v").over(Window.partitionBy("o_custkey").orderBy("o_orderkey").rowsBetween(*o.UPTO)))
    a = v.where("v > 0").select("o_custkey", "o_orderkey", (F.col("upto") + F.col("v")).alias("goal"))
    b = v.select("o_custkey", F.col("o_orderkey").alias("at"), F.col("upto").alias("goal"))
    return a.join(b, ["o_custkey", "goal"]).where("at > o_orderkey").groupBy("o_custkey", "o_orderkey").agg(F.min("at").alias("closes_at"))


@query(f"WITH {A} SELECT l_linestatus, count(*) AS relations, count(*) FILTER (WHERE low_confidence) AS low, round(avg(confidence), 6) AS mean_confidence, count(DISTINCT l_orderkey) AS documents FROM rel_a GROUP BY 1")
def y1_run_summary(spark, sf):
    return rels(spark, sf, "a").groupBy("l_linestatus").agg(F.count("*").alias("relations"), F.count_if("low_confidence").alias("low"), F.round(F.avg("confidence"), 6).alias("mean_confidence"), F.count_distinct("l_orderkey").alias("documents"))


@query(f"WITH {A} SELECT 's6' AS stage, 'pairs' AS fact, count(*) AS value FROM rel_a UNION ALL SELECT 's7', agreement, count(*) FROM rel_a GROUP BY agreement UNION ALL SELECT 's8', 'low', count(*) FILTER (WHERE low_confidence) FROM rel_a UNION ALL SELECT 's1b', 'disagree', count(*) FILTER (WHERE l_tax > 0.05) FROM rel_a UNION ALL SELECT 's9', l_linestatus, count(*) FROM rel_a GROUP BY l_linestatus")
def y2_walkthrough(spark, sf):
    """One pass over a run for the facts of every stage."""
    r = rels(spark, sf, "a")
    facts = F.array(
        F.struct(F.lit("s6").alias("stage"), F.lit("pairs").alias("fact"), F.lit(1).alias("v")),
        F.struct(F.lit("s7").alias("stage"), F.col("agreement").alias("fact"), F.lit(1).alias("v")),
        F.struct(F.lit("s8").alias("stage"), F.lit("low").alias("fact"), F.col("low_confidence").cast("int").alias("v")),
        F.struct(F.lit("s1b").alias("stage"), F.lit("disagree").alias("fact"), (F.col("l_tax") > 0.05).cast("int").alias("v")),
        F.struct(F.lit("s9").alias("stage"), F.col("l_linestatus").alias("fact"), F.lit(1).alias("v")),
    )
    return r.select(F.explode(facts).alias("f")).groupBy("f.stage", "f.fact").agg(F.sum("f.v").alias("value"))


@query(f"WITH {A}, lab AS (SELECT doc_id, CASE WHEN toxic = 1 THEN 'reject' ELSE 'accept' END AS label FROM labels) SELECT {K}, label, confidence < 0.95 OR low_confidence AS review FROM rel_a LEFT JOIN lab ON doc_id = l_orderkey WHERE low_confidence OR va_width > 0.1")
def y3_triage(spark, sf):
    labels = table(spark, sf, "labels").select(F.col("doc_id").alias("l_orderkey"), F.when(F.col("toxic") == 1, "reject").otherwise("accept").alias("label"))
    q = rels(spark, sf, "a").where("low_confidence OR va_width > 0.1").join(labels, "l_orderkey", "left")
    return q.select(*KEY, "label", rn.needs_review(0.95).alias("review"))


@query(f"WITH {A}, {B}, x AS (SELECT {K}, confidence, agreement FROM rel_a), y AS (SELECT {K}, confidence, agreement FROM rel_b) SELECT (SELECT count(*) FROM (SELECT * FROM x EXCEPT ALL SELECT * FROM y)) AS gone, (SELECT count(*) FROM (SELECT * FROM y EXCEPT ALL SELECT * FROM x)) AS come")
def y9_determinism(spark, sf):
    cols = [*KEY, "confidence", "agreement"]
    x, y = (rels(spark, sf, r).select(*cols) for r in "ab")
    n = lambda df, name: df.agg(F.count("*").alias(name))
    return n(x.exceptAll(y), "gone").crossJoin(n(y.exceptAll(x), "come"))
