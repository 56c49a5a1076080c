"""Queries of the validation checks, with their DuckDB twins.

The ledger: a table for each customer; its orders are the flows, the account balance the opening, and
the closing is derived and then perturbed, so that all three verdicts occur.  Amounts are whole cents.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyweave.operators import checks as ck
from tallyweave.operators import filing as fl
from tallyweave.plans.calibration import _reads
from tallyweave.plans.scalar import DECISIONS, PARSED, decisions, tokens
from tallyweave.functions import grammar as g
from tallyweave.sources.tables import table

ALL: dict[str, tuple] = {}


def query(twin: str | None):
    def add(f):
        ALL[f.__name__] = (f, twin)
        return f

    return add


def ledger(spark, sf):
    c, od = table(spark, sf, "customer"), table(spark, sf, "orders")
    cents = lambda col: F.round(F.col(col) * 100).cast("bigint")
    key, pri = F.col("o_orderkey"), F.col("o_orderpriority")
    # flows: some dashes, a few unreadable numbers, some repaired, some declared as expenses
    state = F.when(key % 9 == 0, "dash").otherwise("number")
    value = F.when((key % 9 == 0) | (key % 101 == 0), None).when(pri == "5-LOW", -cents("o_totalprice")).otherwise(cents("o_totalprice"))
    flows = od.select(F.col("o_custkey").alias("table_id"), (key + 1).alias("row_ord"), F.concat(F.lit("r"), key.cast("string")).alias("row_id"), F.when(pri == "5-LOW", "Giderler (-)").otherwise("Alımlar").alias("label"), F.lit("flow").alias("role"), (key % 2).cast("int").alias("indent"), value.alias("v"), state.alias("state"), (key % 50 == 7).alias("repaired"), F.when(key % 2 == 1, F.concat(F.lit("p"), (key % 3).cast("string"))).alias("parent_row_id"))
    sums = flows.groupBy("table_id").agg(F.sum("v").alias("f"))
    frame = c.select(F.col("c_custkey").alias("table_id"), cents("c_acctbal").alias("o")).join(sums, "table_id", "left")
    closing = F.col("o") + F.coalesce("f", F.lit(0)) + F.when(F.col("table_id") % 5 == 0, 100).otherwise(0)
    ends = F.array(
        F.struct(F.lit(0).cast("bigint").alias("row_ord"), F.lit("open").alias("row_id"), F.lit("1 Ocak açılış bakiyesi").alias("label"), F.lit("opening").alias("role"), F.col("o").alias("v")),
        F.struct(F.lit(10**9).cast("bigint").alias("row_ord"), F.lit("close").alias("row_id"), F.lit("31 Aralık kapanış bakiyesi").alias("label"), F.lit("closing").alias("role"), closing.alias("v")),
    )
    ends = frame.select("table_id", F.explode(ends).alias("e")).where("e.row_id = 'open' OR table_id % 8 <> 3")
    edge = ends.select("table_id", "e.row_ord", "e.row_id", "e.label", "e.role", F.lit(0).alias("indent"), "e.v", F.lit("number").alias("state"), F.lit(False).alias("repaired"), F.lit(None).cast("string").alias("parent_row_id"))
    both = flows.unionByName(edge)
    periods = F.array(F.struct(F.lit("y2012").alias("period"), F.lit(0).alias("p_ord"), F.col("v").alias("value")), F.struct(F.lit("toplam").alias("period"), F.lit(1).alias("p_ord"), (F.col("v") + F.when(F.col("row_ord") % 4 == 1, 1).otherwise(0)).alias("value")))
    return both.select("table_id", "row_ord", "row_id", "label", "role", "indent", "state", "repaired", "parent_row_id", F.explode(periods).alias("p")).select("table_id", "row_ord", "row_id", "label", "role", "indent", "state", "repaired", "parent_row_id", "p.*")


LEDGER = """
flows AS (SELECT o_custkey AS table_id, o_orderkey + 1 AS row_ord, 'r' || o_orderkey AS row_id, CASE WHEN o_orderpriority = '5-LOW' THEN 'Giderler (-)' ELSE 'Alımlar' END AS label, 'flow' AS role, (o_orderkey % 2)::INT AS indent,
  CASE WHEN o_orderkey % 9 = 0 OR o_orderkey % 101 = 0 THEN NULL WHEN o_orderpriority = '5-LOW' THEN -round(o_totalprice * 100)::BIGINT ELSE round(o_totalprice * 100)::BIGINT END AS v,
  CASE WHEN o_orderkey % 9 = 0 THEN 'dash' ELSE 'number' END AS state, o_orderkey % 50 = 7 AS repaired, CASE WHEN o_orderkey % 2 = 1 THEN 'p' || (o_orderkey % 3) END AS parent_row_id FROM orders),
frame AS (SELECT c_custkey AS table_id, round(c_acctbal * 100)::BIGINT AS o, f FROM customer LEFT JOIN (SELECT table_id, sum(v)::BIGINT AS f FROM flows GROUP BY 1) s ON s.table_id = c_custkey),
edges AS (SELECT table_id, 0 AS row_ord, 'open' AS row_id, '1 Ocak açılış bakiyesi' AS label, 'opening' AS role, o AS v FROM frame
 UNION ALL SELECT table_id, 1000000000, 'close', '31 Aralık kapanış bakiyesi', 'closing', o + coalesce(f, 0) + CASE WHEN table_id % 5 = 0 THEN 100 ELSE 0 END FROM frame WHERE table_id % 8 <> 3),
both_ AS (SELECT * FROM flows UNION ALL SELECT table_id, row_ord, row_id, label, role, 0, v, 'number', false, NULL FROM edges),
ledger AS (SELECT *, 'y2012' AS period, 0 AS p_ord, v AS value FROM both_ UNION ALL SELECT *, 'toplam', 1, v + CASE WHEN row_ord % 4 = 1 THEN 1 ELSE 0 END FROM both_)"""


@query(f"""WITH {LEDGER}, c AS (SELECT table_id, period, min_by(value, row_ord) FILTER (WHERE role = 'opening') AS o, min_by(value, row_ord) FILTER (WHERE role = 'closing') AS c, coalesce(sum(value) FILTER (WHERE role = 'flow'), 0) AS f,
 coalesce(bool_or(role = 'flow' AND value IS NULL AND state = 'number'), false) AS unread, bool_or(role = 'opening') AND bool_or(role = 'closing') AND bool_or(role = 'flow') AS has FROM ledger GROUP BY ALL)
SELECT DISTINCT table_id::VARCHAR AS scope, 'not_evaluable' AS status FROM c WHERE NOT has
UNION ALL SELECT table_id || '.' || period, CASE WHEN o IS NULL OR c IS NULL OR unread THEN 'not_evaluable' WHEN o + f = c THEN 'pass' ELSE 'fail' END FROM c WHERE has""")
def fin_rollforward(spark, sf):
    return ck.rollforward(ledger(spark, sf)).select("scope", "status")


@query(f"WITH {LEDGER}, r AS (SELECT table_id, row_id, max(value) FILTER (WHERE period = 'toplam') AS t, sum(value) FILTER (WHERE period <> 'toplam') AS s, bool_or(period <> 'toplam' AND value IS NULL AND state = 'number') AS unread FROM ledger GROUP BY ALL) SELECT table_id || '.' || row_id AS scope, CASE WHEN unread THEN 'not_evaluable' WHEN coalesce(s, 0) = t THEN 'pass' ELSE 'fail' END AS status FROM r WHERE t IS NOT NULL")
def fin_row_sum(spark, sf):
    return ck.row_sums(ledger(spark, sf), "toplam").select("scope", "status")


_FAULTS = f"""{LEDGER}, faulty AS (SELECT 'none' AS fault, * FROM ledger
 UNION ALL SELECT 'opening', * REPLACE (CASE WHEN role = 'opening' AND period = 'y2012' AND state = 'number' THEN value + 1000000 ELSE value END AS value) FROM ledger
 UNION ALL SELECT 'member', * REPLACE (CASE WHEN role = 'flow' AND period = 'y2011' AND state = 'number' THEN value + 7 ELSE value END AS value) FROM ledger),
c AS (SELECT fault, table_id, period, min_by(value, row_ord) FILTER (WHERE role = 'opening') AS o, min_by(value, row_ord) FILTER (WHERE role = 'closing') AS c, coalesce(sum(value) FILTER (WHERE role = 'flow'), 0) AS f,
 coalesce(bool_or(role = 'flow' AND value IS NULL AND state = 'number'), false) AS unread, bool_or(role = 'opening') AND bool_or(role = 'closing') AND bool_or(role = 'flow') AS has FROM faulty GROUP BY ALL),
r AS (SELECT fault, table_id, row_id, max(value) FILTER (WHERE period = 'toplam') AS t, sum(value) FILTER (WHERE period <> 'toplam') AS s, bool_or(period <> 'toplam' AND value IS NULL AND state = 'number') AS unread FROM faulty GROUP BY ALL),
failed AS (SELECT fault, 'FIN_ROLLFORWARD' AS check_id, table_id || '.' || period AS scope FROM c WHERE has AND o IS NOT NULL AND c IS NOT NULL AND NOT unread AND o + f <> c
 UNION ALL SELECT fault, 'FIN_ROW_SUM', table_id || '.' || row_id FROM r WHERE t IS NOT NULL AND NOT unread AND coalesce(s, 0) <> t)"""


@query(f"WITH {_FAULTS} SELECT fault, check_id, count(*) AS new_failures FROM failed WHERE fault <> 'none' AND (check_id, scope) NOT IN (SELECT check_id, scope FROM failed WHERE fault = 'none') GROUP BY ALL")
def y8_mutations(spark, sf):
    """Planted faults and the checks that notice: failures that a clean run does not have."""
    clean = ledger(spark, sf)
    faults = {"opening": ((F.col("role") == "opening") & (F.col("period") == "y2012"), 1000000), "member": ((F.col("role") == "flow") & (F.col("period") == "y2011"), 7)}

    def judged(led):
        return ck.rollforward(led).unionByName(ck.row_sums(led, "toplam"))

    found = [fl.new_failures(judged(clean), judged(fl.inject(clean, *fault))).withColumn("fault", F.lit(name)) for name, fault in faults.items()]
    return found[0].unionByName(found[1]).groupBy("fault", "check_id").agg(F.count("*").alias("new_failures"))


# Parents: one for each residue of the children's keys, exact for most customers.
_PARENTS = """
kids AS (SELECT table_id, parent_row_id, sum(v)::BIGINT AS s FROM flows WHERE parent_row_id IS NOT NULL GROUP BY ALL),
par AS (SELECT table_id, 0 AS row_ord, parent_row_id AS row_id, 'Grup' AS label, 'item' AS role, 0 AS indent, coalesce(s, 0) + CASE WHEN table_id % 6 = 0 THEN 1 ELSE 0 END AS value, 'number' AS state, false AS repaired FROM kids)"""


def _with_parents(spark, sf):
    led = ledger(spark, sf).where("period = 'y2012'")
    kids = led.where("parent_row_id IS NOT NULL").groupBy("table_id", "parent_row_id").agg(F.coalesce(F.sum("value"), F.lit(0)).alias("s"))
    par = kids.select("table_id", F.lit(0).cast("bigint").alias("row_ord"), F.col("parent_row_id").alias("row_id"), F.lit("Grup").alias("label"), F.lit("item").alias("role"), F.lit(0).alias("indent"), F.lit("number").alias("state"), F.lit(False).alias("repaired"), F.lit(None).cast("string").alias("parent_row_id"), F.lit("y2012").alias("period"), F.lit(0).alias("p_ord"), (F.col("s") + F.when(F.col("table_id") % 6 == 0, 1).otherwise(0)).alias("value"))
    return led.where("parent_row_id IS NOT NULL").unionByName(par)


@query(f"WITH {LEDGER}, {_PARENTS}, k AS (SELECT table_id, parent_row_id, count(DISTINCT row_id) AS n, coalesce(sum(v), 0) AS s, bool_or(v IS NULL AND state = 'number') AS unread, bool_or(repaired) AS rep FROM flows WHERE parent_row_id IS NOT NULL GROUP BY ALL) SELECT p.table_id || '.' || p.row_id || '.y2012' AS scope, CASE WHEN rep THEN 'not_evaluable' WHEN k.s = p.value THEN 'pass' ELSE 'fail' END AS status FROM par p JOIN k ON k.table_id = p.table_id AND k.parent_row_id = p.row_id WHERE n >= 2 AND NOT unread")
def fin_parent_sum(spark, sf):
    return ck.parent_sums(_with_parents(spark, sf)).select("scope", "status")


@query(f"WITH {LEDGER}, {_PARENTS}, k AS (SELECT DISTINCT table_id, parent_row_id, row_id FROM flows WHERE parent_row_id IS NOT NULL) SELECT table_id, parent_row_id, count(*) AS children FROM k GROUP BY ALL")
def j12_children(spark, sf):
    return _with_parents(spark, sf).where("parent_row_id IS NOT NULL").groupBy("table_id", "parent_row_id").agg(F.count_distinct("row_id").alias("children"))


@query(None)
def fin_grand_total(spark, sf):
    led = ledger(spark, sf)
    totals = led.groupBy("table_id", "period", "p_ord").agg((F.sum(F.when((F.col("indent") == 0) & (F.col("role") != "closing"), F.col("value"))) + F.when(F.col("table_id") % 4 == 0, 1).otherwise(0)).alias("value"))
    row = totals.select("table_id", F.lit(10**9 - 1).cast("bigint").alias("row_ord"), F.lit("grand").alias("row_id"), F.lit("TOPLAM").alias("label"), F.lit("total").alias("role"), F.lit(0).alias("indent"), F.lit("number").alias("state"), F.lit(False).alias("repaired"), F.lit(None).cast("string").alias("parent_row_id"), "period", "p_ord", "value")
    return ck.grand_totals(led.where("role <> 'closing'").unionByName(row)).select("scope", "status")


@query(None)
def fin_flow_cascade(spark, sf):
    led = ledger(spark, sf).withColumn("label", F.when(F.col("row_ord") % 5 == 0, "BRÜT KAR").otherwise(F.col("label")))
    return ck.flow_cascades(led).select("scope", "status")


@query(f"WITH {DECISIONS} SELECT l_orderkey || '-' || l_linenumber AS scope, recon AS status, count(*) AS n FROM decisions WHERE a_acc OR b_acc OR c_acc GROUP BY ALL")
def fin_reconcile(spark, sf):
    d = decisions(spark, sf).where("a_acc OR b_acc OR c_acc").withColumn("relation_id", F.concat_ws("-", "l_orderkey", "l_linenumber"))
    return ck.reconciliation(d).groupBy("scope", "status").agg(F.count("*").alias("n"))


@query(f"WITH {LEDGER} SELECT table_id || '.' || row_id || '.' || period AS scope, CASE WHEN value <= 0 THEN 'pass' ELSE 'fail' END AS status FROM ledger WHERE label LIKE '%(-)' AND value IS NOT NULL")
def fmt_sign_legality(spark, sf):
    return ck.sign_legality(ledger(spark, sf)).select("scope", "status")


@query(f"WITH {LEDGER} SELECT table_id::VARCHAR AS scope, CASE WHEN count(*) FILTER (WHERE repaired) = 0 THEN 'pass' ELSE 'fail' END AS status FROM ledger GROUP BY table_id")
def fmt_repaired_cells(spark, sf):
    return ck.repaired_cells(ledger(spark, sf)).select("scope", "status")


@query(f"WITH {LEDGER} SELECT table_id::VARCHAR AS scope, CASE WHEN count(*) FILTER (WHERE CASE WHEN row_ord % 97 = 0 AND row_ord > 0 THEN 'blank' ELSE state END NOT IN ('number', 'dash', 'empty')) = 0 THEN 'pass' ELSE 'fail' END AS status FROM ledger GROUP BY table_id")
def fmt_three_state(spark, sf):
    led = ledger(spark, sf).withColumn("state", F.when((F.col("row_ord") % 97 == 0) & (F.col("row_ord") > 0), "blank").otherwise(F.col("state")))
    return ck.three_states(led).select("scope", "status")


@query(f"WITH {PARSED} SELECT l_orderkey || '-' || l_linenumber AS scope, CASE WHEN value BETWEEN 0 AND 100 AND (value_high IS NULL OR (value <= value_high AND value_high <= 100)) THEN 'pass' ELSE 'fail' END AS status, count(*) AS n FROM parsed WHERE kind IN ('percent', 'percent_range') GROUP BY ALL")
def fmt_percent_bounds(spark, sf):
    cells = tokens(spark, sf).select(F.concat_ws("-", "l_orderkey", "l_linenumber").alias("cell_id"), g.parse_number(F.col("token")).alias("n")).select("cell_id", "n.*")
    return ck.percent_bounds(cells).groupBy("scope", "status").agg(F.count("*").alias("n"))


_AGREE = "r AS (SELECT l_orderkey % 25 AS doc_id, count(*) FILTER (WHERE l_linenumber % 4 <> 0 AND l_partkey % 3 = 2) AS disagree FROM lineitem GROUP BY 1)"


@query(f"WITH {_AGREE} SELECT doc_id::VARCHAR AS scope, CASE WHEN doc_id % 7 = 0 THEN 'not_evaluable' WHEN disagree = 0 THEN 'pass' ELSE 'fail' END AS status FROM r")
def fmt_engine_agreement(spark, sf):
    ok = F.col("eligible") & F.col("other").isNotNull()
    stats = _reads(spark, sf).groupBy((F.col("l_orderkey") % 25).alias("doc_id")).agg(F.count_if(ok & (F.col("own") != F.col("other"))).alias("disagree"))
    return ck.engine_agreement(stats.withColumn("available", F.col("doc_id") % 7 != 0)).select("scope", "status")


@query("WITH s AS (SELECT l_suppkey AS doc_id, count(*) FILTER (WHERE l_suppkey % 3 <> 0) AS cells, count(*) FILTER (WHERE l_suppkey % 3 = 1 AND l_discount > 0.09) AS mismatch FROM lineitem GROUP BY 1) SELECT doc_id::VARCHAR AS scope, CASE WHEN cells = 0 THEN 'not_evaluable' WHEN mismatch = 0 THEN 'pass' ELSE 'fail' END AS status FROM s")
def fmt_percent_rescue(spark, sf):
    s = table(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("doc_id")).agg(F.count_if(F.col("l_suppkey") % 3 != 0).alias("cells"), F.count_if((F.col("l_suppkey") % 3 == 1) & (F.col("l_discount") > 0.09)).alias("mismatch"))
    return ck.percent_rescue(s).select("scope", "status")


@query("WITH p AS (SELECT c_custkey AS table_id, unnest([0, 1, 2]) AS p_ord, unnest([CASE WHEN c_custkey % 4 = 0 THEN 'col0' ELSE '2012' END, CASE WHEN c_custkey % 3 = 0 THEN '2013' ELSE '2011' END, CASE WHEN c_custkey % 2 = 0 THEN 'Toplam' ELSE '2010' END]) AS label FROM customer), y AS (SELECT table_id, list(TRY_CAST(label AS INT) ORDER BY p_ord) FILTER (WHERE regexp_matches(label, '^[0-9]+$')) AS years FROM p GROUP BY 1) SELECT table_id, CASE WHEN len(years) >= 2 THEN CASE WHEN years = list_reverse_sort(years) THEN 'pass' ELSE 'fail' END ELSE 'not_evaluable' END AS status FROM y")
def str_period_order(spark, sf):
    k = F.col("c_custkey")
    labels = F.array(F.when(k % 4 == 0, "col0").otherwise("2012"), F.when(k % 3 == 0, "2013").otherwise("2011"), F.when(k % 2 == 0, "Toplam").otherwise("2010"))
    p = table(spark, sf, "customer").select(k.alias("table_id"), F.posexplode(labels).alias("p_ord", "label"))
    return ck.period_order(p).select(F.col("scope").alias("table_id"), "status")


@query("SELECT l_orderkey AS table_id, CASE WHEN count(*) FILTER (WHERE l_suppkey % 140 NOT BETWEEN 1 AND 99) = 0 THEN 'pass' ELSE 'fail' END AS status FROM lineitem GROUP BY 1")
def str_ref_range(spark, sf):
    rows = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("table_id"), F.array(F.col("l_suppkey") % 140).alias("refs"))
    return ck.ref_range(rows).select(F.col("scope").alias("table_id"), "status")


@query("SELECT c_custkey AS table_id, CASE WHEN c_acctbal > 0 THEN 'pass' ELSE 'fail' END AS status FROM customer WHERE c_custkey % 3 <> 0")
def str_footnote_heading(spark, sf):
    t = table(spark, sf, "customer").select(F.col("c_custkey").alias("table_id"), F.when(F.col("c_custkey") % 3 != 0, F.col("c_acctbal") > 0).alias("verified"))
    return ck.heading_verified(t).select(F.col("scope").alias("table_id"), "status")


@query("WITH p AS (SELECT unnest(range(40)) AS page), t AS (SELECT c_nationkey AS page, count(*) AS n FROM customer GROUP BY 1) SELECT 'page' || page AS scope, CASE WHEN coalesce(n, 0) > 0 THEN 'pass' ELSE 'fail' END AS status FROM p LEFT JOIN t USING (page)")
def str_summary_range(spark, sf):
    tables = table(spark, sf, "customer").select(F.col("c_nationkey").cast("bigint").alias("page"))
    return ck.pages_have_tables(spark.range(40).withColumnRenamed("id", "page"), tables).select("scope", "status")


@query("SELECT l_orderkey::VARCHAR AS scope, CASE WHEN count(*) FILTER (WHERE l_suppkey % 10 = 3) > 0 THEN 'pass' ELSE 'fail' END AS status FROM lineitem GROUP BY 1")
def str_footnote_refs_present(spark, sf):
    rows = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.array(F.col("l_suppkey") % 10).alias("refs"))
    return ck.refs_present(rows, F.lit(3).cast("bigint")).select("scope", "status")


@query("SELECT c_nationkey::VARCHAR AS scope, CASE WHEN count(*) FILTER (WHERE c_acctbal > 6000) >= 3 AND count(*) FILTER (WHERE c_acctbal < 0) >= 3 THEN 'pass' ELSE 'not_evaluable' END AS status FROM customer GROUP BY 1")
def str_calibration_controls(spark, sf):
    n = table(spark, sf, "customer").groupBy(F.col("c_nationkey").alias("doc_id")).agg(F.count_if(F.col("c_acctbal") > 6000).alias("n_pos"), F.count_if(F.col("c_acctbal") < 0).alias("n_neg"))
    return ck.calibration_controls(n.withColumn("fitted", (F.col("n_pos") >= 3) & (F.col("n_neg") >= 3))).select("scope", "status")


@query("SELECT c_custkey::VARCHAR AS scope, CASE WHEN count(o_orderkey) > 0 THEN 'pass' ELSE 'fail' END AS status, count(o_orderkey)::VARCHAR AS detail FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_orderstatus = 'F' GROUP BY c_custkey")
def rel_coverage(spark, sf):
    """Also j21: referencing rows without a relation are told, with a count of zero."""
    rows = table(spark, sf, "customer").select(F.col("c_custkey").alias("row_id"))
    rels = table(spark, sf, "orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("row_id"))
    return ck.coverage(rows, rels).select("scope", "status", "detail")
