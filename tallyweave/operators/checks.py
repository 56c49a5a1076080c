"""Validation checks over a ledger in long form.

A ledger row is (table_id, row_ord, row_id, label, role, indent, period, p_ord, value, state, repaired,
parent_row_id).  Dash, empty and zero differ: a dash adds nothing, a number without a value makes a sum
not evaluable, and a missing operand is never zero.  Every check returns (check_id, grp, scope, status,
detail); status is pass, fail or not_evaluable.  All are aggregations; the two searches over runs of
members fold one small table's rows, held as an array.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyweave.functions import grammar as g

RESULT = ("check_id", "grp", "scope", "status", "detail")
TOTAL_PREFIX = "TOPLAM"
MILESTONE_SHARE = 0.6


def results(df: DataFrame, check_id: str, group: str, scope: Column, status: Column, detail: Column | None = None) -> DataFrame:
    return df.select(F.lit(check_id).alias("check_id"), F.lit(group).alias("grp"), scope.alias("scope"), status.alias("status"), (F.lit("") if detail is None else detail).cast("string").alias("detail"))


def passes(ok: Column) -> Column:
    return F.when(ok, "pass").otherwise("fail")


def dotted(*parts: str) -> Column:
    return F.concat_ws(".", *[F.col(p).cast("string") for p in parts])


#: A number that could not be read: present, but not summable.
def unreadable() -> Column:
    return F.col("value").isNull() & (F.col("state") == "number")


# --- structural ----------------------------------------------------------------------------------------


def period_order(periods: DataFrame) -> DataFrame:
    """(table_id, p_ord, label): two or more numeric labels must fall."""
    years = F.transform(F.filter(F.transform(F.array_sort(F.collect_list(F.struct("p_ord", "label"))), lambda p: p["label"]), lambda v: v.rlike("^[0-9]+$")), lambda v: v.cast("int"))
    t = periods.groupBy("table_id").agg(years.alias("years"))
    falling = F.col("years") == F.reverse(F.array_sort("years"))
    return results(t, "STR_PERIOD_ORDER", "structural", F.col("table_id"), F.when(F.size("years") < 2, "not_evaluable").otherwise(passes(falling)), F.col("years").cast("string"))


def ref_range(rows: DataFrame) -> DataFrame:
    """(table_id, refs): note references lie in 1..99."""
    bad = rows.groupBy("table_id").agg(F.sum(F.size(F.filter("refs", lambda r: ~r.between(1, 99)))).alias("bad"))
    return results(bad, "STR_REF_RANGE", "structural", F.col("table_id"), passes(F.col("bad") <= 0), F.col("bad"))


def heading_verified(tables: DataFrame) -> DataFrame:
    """(table_id, verified): footnote tables only; null elsewhere."""
    return results(tables.where("verified IS NOT NULL"), "STR_FOOTNOTE_HEADING", "structural", F.col("table_id"), passes(F.col("verified")))


def pages_have_tables(pages: DataFrame, tables: DataFrame) -> DataFrame:
    """Each configured page yields a table."""
    n = pages.join(tables.groupBy("page").agg(F.count("*").alias("n")), "page", "left")
    return results(n, "STR_SUMMARY_RANGE", "structural", F.concat(F.lit("page"), F.col("page").cast("string")), passes(F.coalesce("n", F.lit(0)) > 0), F.coalesce("n", F.lit(0)))


def refs_present(rows: DataFrame, note: Column) -> DataFrame:
    """(doc_id, refs): some row of a document references its note."""
    n = rows.groupBy("doc_id").agg(F.count_if(F.array_contains("refs", note)).alias("n"))
    return results(n, "STR_FOOTNOTE_REFS_PRESENT", "structural", F.col("doc_id").cast("string"), passes(F.col("n") > 0), F.col("n"))


def calibration_controls(fits: DataFrame) -> DataFrame:
    """(doc_id, fitted, n_pos, n_neg)."""
    return results(fits, "STR_CALIBRATION_CONTROLS", "structural", F.col("doc_id").cast("string"), F.when(F.col("fitted"), "pass").otherwise("not_evaluable"), F.concat_ws("/", "n_pos", "n_neg"))


def coverage(referencing: DataFrame, relations: DataFrame) -> DataFrame:
    """Each referencing row has a relation; rows without one are told with a count of zero."""
    n = referencing.join(relations.groupBy("row_id").agg(F.count("*").alias("n")), "row_id", "left")
    return results(n, "REL_COVERAGE", "structural", F.col("row_id").cast("string"), passes(F.coalesce("n", F.lit(0)) > 0), F.coalesce("n", F.lit(0)))


# --- format --------------------------------------------------------------------------------------------


def percent_bounds(cells: DataFrame) -> DataFrame:
    """(cell_id, kind, value, value_high): percents lie in 0..100, ranges rise."""
    p = cells.where((F.col("state") == "number") & F.col("kind").isin("percent", "percent_range"))
    ok = F.col("value").between(0, 100) & F.coalesce((F.col("value") <= F.col("value_high")) & (F.col("value_high") <= 100), F.lit(True))
    return results(p, "FMT_PERCENT_BOUNDS", "format", F.col("cell_id").cast("string"), passes(ok))


def repaired_cells(ledger: DataFrame) -> DataFrame:
    n = ledger.groupBy("table_id").agg(F.count_if("repaired").alias("n"))
    return results(n, "FMT_REPAIRED_CELLS", "format", F.col("table_id").cast("string"), passes(F.col("n") == 0), F.col("n"))


def three_states(ledger: DataFrame) -> DataFrame:
    n = ledger.groupBy("table_id").agg(F.count_if(~F.col("state").isin("number", "dash", "empty")).alias("n"))
    return results(n, "FMT_THREE_STATE", "format", F.col("table_id").cast("string"), passes(F.col("n") == 0), F.col("n"))


def engine_agreement(stats: DataFrame) -> DataFrame:
    """(doc_id, available, disagree)."""
    return results(stats, "FMT_ENGINE_AGREEMENT", "format", F.col("doc_id").cast("string"), F.when(~F.col("available"), "not_evaluable").otherwise(passes(F.col("disagree") == 0)), F.col("disagree"))


def percent_rescue(stats: DataFrame) -> DataFrame:
    """(doc_id, cells, mismatch)."""
    return results(stats, "FMT_PERCENT_RESCUE", "format", F.col("doc_id").cast("string"), F.when(F.col("cells") == 0, "not_evaluable").otherwise(passes(F.col("mismatch") == 0)), F.col("cells"))


def sign_legality(ledger: DataFrame) -> DataFrame:
    """A row whose label ends in ``(-)`` has no positive amounts."""
    rows = ledger.where(F.rtrim("label").endswith("(-)") & F.col("value").isNotNull())
    return results(rows, "FMT_SIGN_LEGALITY", "format", dotted("table_id", "row_id", "period"), passes(F.col("value") <= 0))


# --- financial -----------------------------------------------------------------------------------------


def rollforward(ledger: DataFrame) -> DataFrame:
    """First opening + flows = first closing, for each period of a table."""
    of = lambda role: F.min_by(F.struct("value"), F.when(F.col("role") == role, F.col("row_ord")))["value"]
    flow = F.col("role") == "flow"
    cols = ledger.groupBy("table_id", "period").agg(
        of("opening").alias("o"),
        of("closing").alias("c"),
        F.sum(F.when(flow, F.col("value"))).alias("f"),
        F.coalesce(F.bool_or(flow & unreadable()), F.lit(False)).alias("unread"),
        F.count_if(F.col("role") == "opening").alias("n_o"),
        F.count_if(F.col("role") == "closing").alias("n_c"),
        F.count_if(flow).alias("n_f"),
    )
    whole = cols.groupBy("table_id").agg(*[(F.max(n) > 0).alias(f"has_{n}") for n in ("n_o", "n_c", "n_f")]).withColumn("has", F.col("has_n_o") & F.col("has_n_c") & F.col("has_n_f"))
    lacking = results(whole.where(~F.col("has")), "FIN_ROLLFORWARD", "financial", F.col("table_id").cast("string"), F.lit("not_evaluable"), F.lit("missing opening, closing or flows"))
    full = cols.join(whole.where("has").select("table_id"), "table_id")
    flows = F.coalesce("f", F.lit(0))
    status = F.when(F.col("o").isNull() | F.col("c").isNull() | F.col("unread"), "not_evaluable").otherwise(passes(F.col("o") + flows == F.col("c")))
    return lacking.unionByName(results(full, "FIN_ROLLFORWARD", "financial", dotted("table_id", "period"), status, (F.col("o") + flows - F.col("c"))))


def row_sums(ledger: DataFrame, total: str) -> DataFrame:
    """The other periods of a row add to its ``total`` column."""
    parts = F.col("period") != total
    rows = ledger.groupBy("table_id", "row_id").agg(F.max(F.when(~parts, F.col("value"))).alias("t"), F.sum(F.when(parts, F.col("value"))).alias("s"), F.coalesce(F.bool_or(parts & unreadable()), F.lit(False)).alias("unread"), F.count_if(parts).alias("n"))
    rows = rows.where("t IS NOT NULL AND n > 0")
    return results(rows, "FIN_ROW_SUM", "financial", dotted("table_id", "row_id"), F.when(F.col("unread"), "not_evaluable").otherwise(passes(F.coalesce("s", F.lit(0)) == F.col("t"))))


def parent_sums(ledger: DataFrame) -> DataFrame:
    """A row with two or more children is their sum; unevaluable ones are passed over in silence."""
    kids = ledger.where("parent_row_id IS NOT NULL").select("table_id", F.col("parent_row_id").alias("row_id"), F.col("row_id").alias("kid"), "period", "value", "state", "repaired")
    n = kids.groupBy("table_id", "row_id").agg(F.count_distinct("kid").alias("n")).where("n >= 2")
    sums = kids.groupBy("table_id", "row_id", "period").agg(F.sum("value").alias("s"), F.bool_or(unreadable()).alias("unread"), F.bool_or("repaired").alias("kid_repaired"))
    met = ledger.where("value IS NOT NULL").select("table_id", "row_id", "period", "value", "repaired").join(n, ["table_id", "row_id"]).join(sums, ["table_id", "row_id", "period"], "left")
    met = met.where(~F.coalesce("unread", F.lit(False)))
    repaired = F.col("repaired") | F.coalesce("kid_repaired", F.lit(False))
    return results(met, "FIN_PARENT_SUM", "financial", dotted("table_id", "row_id", "period"), F.when(repaired, "not_evaluable").otherwise(passes(F.coalesce("s", F.lit(0)) == F.col("value"))))


def reconciliation(decisions: DataFrame) -> DataFrame:
    """(relation_id, recon) of accepted relations."""
    return results(decisions, "FIN_RECONCILE", "financial", F.col("relation_id").cast("string"), F.col("recon"))


def is_milestone(label: Column, indent: Column) -> Column:
    return F.coalesce((indent == 0) & (g.upper_share(label) >= MILESTONE_SHARE), F.lit(False))


# --- searches over one table's rows ---------------------------------------------------------------------

AMOUNT = "decimal(38,6)"


def _sums(values: Column) -> Column:
    """``array<struct<sum, gaps>>`` of the leading 0, 1, 2, ... values; a gap adds nothing and is counted."""
    zero = F.struct(F.lit(0).cast(AMOUNT).alias("sum"), F.lit(0).alias("gaps"))

    def add(acc: Column, v: Column) -> Column:
        last = F.get(acc, F.size(acc) - 1)
        return F.concat(acc, F.array(F.struct((last["sum"] + F.coalesce(v, F.lit(0))).cast(AMOUNT).alias("sum"), (last["gaps"] + v.isNull().cast("int")).alias("gaps"))))

    return F.aggregate(values, F.array(zero), add)


def _run_end(sums: Column, start: Column, target: Column) -> Column:
    """Where the shortest run of values from ``start`` that adds to ``target`` ends (exclusive); null for none.  A gap ends the search."""
    before = F.get(sums, start)
    ends = F.transform(sums, lambda s, j: F.when((j > start) & (s["gaps"] == before["gaps"]) & (s["sum"] - before["sum"] == target), j))
    return F.array_min(ends)


def _walk(values: Column, step) -> Column:
    """Positions that stay when, from the left, ``step(position, value, sums)`` tells where to go on and whether to keep."""

    def walk(sums: Column) -> Column:
        start = F.struct(F.lit(0).alias("next"), F.expr("cast(array() as array<int>)").alias("kept"))

        def one(acc: Column, at: Column) -> Column:
            def go(told: Column) -> Column:
                return F.struct(told["next"].alias("next"), F.when(told["keep"], F.concat(acc["kept"], F.array(at))).otherwise(acc["kept"]).alias("kept"))

            return F.when(at < acc["next"], acc).otherwise(g.let(step(at, F.get(values, at), sums), go))

        return F.aggregate(F.transform(values, lambda _, i: i), start, one, lambda acc: acc["kept"])

    return g.let(_sums(values), walk)


def without_parts(values: Column) -> Column:
    """Positions left when the run of followers that adds up to a value is dropped after it."""

    def step(at: Column, value: Column, sums: Column) -> Column:
        return F.struct(F.coalesce(_run_end(sums, at + 1, value), at + 1).alias("next"), F.lit(True).alias("keep"))

    return _walk(values, step)


def without_restated(values: Column, base: Column) -> Column:
    """Positions of a cascade segment without repeats of ``base``: the value itself, or a run of two or more that adds to it."""

    def step(at: Column, value: Column, sums: Column) -> Column:
        end = _run_end(sums, at, base)
        return F.struct(F.coalesce(end, at + 1).alias("next"), end.isNull().alias("keep"))

    return _walk(values, step)


def picked(values: Column, positions: Column) -> Column:
    return F.transform(positions, lambda i: F.get(values, i))


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0).cast(AMOUNT), lambda a, v: (a + F.coalesce(v, F.lit(0))).cast(AMOUNT))


def _unread(rows: Column) -> Column:
    return F.exists(rows, lambda r: r["value"].isNull() & (r["state"] == "number"))


def _whole(v: Column) -> Column:
    return v.isNull() | (v == F.floor(v))


def _by_period(ledger: DataFrame) -> DataFrame:
    """``table_id, period, rows, parents, stones``: a table's rows of a period from the top, in one shuffle by table."""
    is_total = (F.col("role") == "total") | F.upper(F.coalesce("label", F.lit(""))).startswith(TOTAL_PREFIX)
    row = F.struct("row_ord", "row_id", "period", "p_ord", F.col("value").cast(AMOUNT).alias("value"), "state", "indent", F.col("parent_row_id").alias("parent"), F.coalesce(is_total, F.lit(False)).alias("total"), is_milestone(F.col("label"), F.col("indent")).alias("milestone"))
    tables = ledger.groupBy("table_id").agg(F.array_sort(F.collect_list(row)).alias("all"))
    parents = F.array_distinct(F.array_compact(F.transform("all", lambda r: r["parent"])))
    stones = F.array_distinct(F.transform(F.filter("all", lambda r: r["milestone"] & r["value"].isNotNull()), lambda r: r["row_ord"]))
    one = tables.select("table_id", "all", parents.alias("parents"), stones.alias("stones"), F.explode(F.array_distinct(F.transform("all", lambda r: r["period"]))).alias("period"))
    return one.select("table_id", "period", F.filter("all", lambda r: r["period"] == F.col("period")).alias("rows"), "parents", "stones")


def grand_totals(ledger: DataFrame) -> DataFrame:
    """A total against three member sets of the rows before it at its indent: all, those with children, and
    all without the parts of members that are sums themselves.  Any agreement passes."""
    t = _by_period(ledger).select("table_id", "period", "rows", "parents", F.posexplode("rows").alias("at", "r")).where("r.total AND r.value IS NOT NULL")
    peers = F.filter(F.slice("rows", 1, F.col("at")), lambda x: (x["indent"] == F.col("r.indent")) & ~x["total"])

    def judge(peers: Column) -> Column:
        nested = F.filter(peers, lambda x: F.array_contains("parents", x["row_id"]))
        heads = picked(peers, without_parts(F.transform(peers, lambda x: x["value"])))
        sets = F.array_distinct(F.filter(F.array(peers, nested, heads), lambda s: F.size(s) > 0))
        verdict = lambda s: F.when(_unread(s), "missing").when(~F.forall(s, lambda x: _whole(x["value"])), "mixed").when(_total(F.transform(s, lambda x: x["value"])) == F.col("r.value"), "agree").otherwise("differ")
        return F.transform(sets, verdict)

    t = t.withColumn("peers", peers).select("table_id", "period", "r.row_id", g.let(F.col("peers"), judge).alias("told")).where(F.size("told") > 0)
    count = lambda word: F.size(F.filter("told", lambda x: x == word))
    status = F.when(count("agree") > 0, "pass").when(count("differ") > 0, "fail").otherwise("not_evaluable")
    detail = F.format_string("%d/%d sets agree, %d missing, %d mixed", count("agree"), count("agree") + count("differ"), count("missing"), count("mixed"))
    return results(t, "FIN_GRAND_TOTAL", "financial", dotted("table_id", "row_id", "period"), status, detail)


def flow_cascades(ledger: DataFrame) -> DataFrame:
    """Each milestone is the milestone before it plus the rows between, restatements aside."""
    t = _by_period(ledger).where(F.size("stones") >= 2)
    stone = lambda r: F.array_contains("stones", r["row_ord"])
    places = F.array_compact(F.transform("rows", lambda r, i: F.when(stone(r), i)))
    t = t.withColumn("places", places).select("table_id", "period", "rows", "places", F.posexplode("places").alias("nth", "at"))
    before = F.when(F.col("nth") > 0, F.get("places", F.col("nth") - 1))
    base = F.when(before.isNull(), F.lit(0).cast(AMOUNT)).otherwise(F.get("rows", before)["value"])
    start = F.coalesce(before + 1, F.lit(0))
    t = t.select("table_id", "period", F.get("rows", F.col("at")).alias("goal"), base.alias("base"), F.filter(F.slice("rows", start + 1, F.col("at") - start), lambda r: r["parent"].isNull()).alias("between")).where("goal.value IS NOT NULL AND base IS NOT NULL")

    def segment(amounts: Column) -> Column:
        return g.let(picked(amounts, without_restated(amounts, F.col("base"))), lambda kept: _total(picked(kept, without_parts(kept))))

    amounts = F.filter(F.transform("between", lambda r: r["value"]), lambda v: v.isNotNull() & _whole(v))
    t = t.select("table_id", "period", "goal", "base", _unread(F.col("between")).alias("unread"), g.let(amounts, segment).alias("segment"))
    goal = F.col("goal.value")
    status = F.when(F.col("unread"), "not_evaluable").otherwise(passes(F.col("base") + F.col("segment") == goal))
    detail = F.when(F.col("unread"), "").otherwise(F.format_string("%s + %s = %s", F.col("base").cast("string"), F.col("segment").cast("string"), goal.cast("string")))
    return results(t.withColumn("row_id", F.col("goal.row_id")), "FIN_FLOW_CASCADE", "financial", dotted("table_id", "row_id", "period"), status, detail)
