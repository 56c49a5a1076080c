"""One document run from words to checks: tables, sides, candidates, decisions, confidences, verdicts.

Every step is an operator of this package; all documents go through at once, keyed by ``doc_id``, and ids
carry the document, so nothing meets across documents.  Outside scores (a cross-encoder's, a language
model's) come as a table or not at all.
"""

from __future__ import annotations

import tempfile
from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyweave.functions import grammar as g
from tallyweave.functions import scoring as sc
from tallyweave.operators import assembly as asm
from tallyweave.operators import calibration as cal
from tallyweave.operators import checks as ck
from tallyweave.operators import linking as lk
from tallyweave.operators import ordered as o
from tallyweave.operators import pages as pg
from tallyweave.sources import stores

AMOUNT = "decimal(38,6)"
INDENT = 0.004
CHANNELS: Mapping[str, float] = {"lexical": 1.0, "anchor": 3.0}


@dataclass(frozen=True)
class Run:
    """The collections of one run; ``map`` is the fitted calibration."""

    rows: DataFrame
    cells: DataFrame
    relations: DataFrame
    checks: DataFrame
    map: tuple[float, float]

    def store(self, root: str, run_id: str, meta: Mapping[str, object]) -> None:
        parts = {"rows": self.rows, "cells": self.cells, "relations": self.relations, "checks": self.checks}
        stores.write_run(root, run_id, parts, {**meta, "a": self.map[0], "b": self.map[1]})


def settled(df: DataFrame) -> DataFrame:
    """``df`` computed once, into the folder that ``spark.checkpoint.dir`` names; only a local session may do without."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        place = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if place is None and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a shared folder")
        sc.setCheckpointDir(place or tempfile.mkdtemp(prefix="tallyweave-"))
    return df.checkpoint()


def tables_of(words: DataFrame, width: float) -> tuple[DataFrame, DataFrame]:
    """``rows`` with roles, levels, ids and parents, and ``cells`` by ``row_id``; ids start with the document.

    Both are computed once: candidates, amounts, ledger and output read them some ten times.
    """
    tables = settled(pg.titled_tables(words, width))
    rows = pg.rows_of(tables)
    levels = o.gap_clusters(rows.select(*asm.TABLE, "x0").distinct(), list(asm.TABLE), "x0", INDENT * width).select(*asm.TABLE, F.col("cluster").alias("level"), "center")
    leveled = o.nearest(rows, levels, list(asm.TABLE), "x0", "center", "level", width).drop("distance")
    named = asm.assign_ids(asm.assign_roles(leveled), asm.TABLE)
    whole = {c: F.concat_ws("/", F.col("doc_id").cast("string"), c) for c in ("table_id", "row_id")}
    rows = settled(named.withColumns({**whole, "parent_row_id": F.when(F.col("parent_row_id").isNotNull(), F.concat_ws("/", F.col("doc_id").cast("string"), "parent_row_id"))}))
    cells = pg.cells_of(tables).join(rows.select(*asm.TABLE, "row_no", "row_id", "table_id"), [*asm.TABLE, "row_no"])
    return rows, settled(cells.withColumn("value", F.col("value").cast(AMOUNT)))


def label_likeness(a: Column, b: Column) -> Column:
    """Jaccard of two labels' character n-grams; 0 when either has none."""
    grams = lambda label: F.array_distinct(lk.char_grams(F.lower(label)))

    def share(p: Column) -> Column:
        both, all_ = F.size(F.array_intersect(p["a"], p["b"])), F.size(p["a"]) + F.size(p["b"])
        return g.let(both, lambda n: F.try_divide(n.cast("double"), (all_ - n).cast("double")))

    return F.coalesce(g.let(F.struct(grams(a).alias("a"), grams(b).alias("b")), share), F.lit(0.0))


def decisions(rows: DataFrame, cells: DataFrame, main: Column, scores: DataFrame | None = None, top_k: int = 8) -> DataFrame:
    """A decision for each kept pair of a row of the ``main`` side and one of the other, within a document.

    Candidates are the ``top_k`` of a row by fused rank, and every pair that an amount anchors.
    """
    sided = rows.where(~F.col("section") & (F.col("n_cells") > 0)).withColumn("main", main)
    left = sided.where("main").select("doc_id", F.col("row_id").alias("l_id"), F.col("label").alias("l_label"))
    right = sided.where("NOT main").select("doc_id", F.col("row_id").alias("r_id"), F.col("label").alias("r_label"), "role", "duration")
    amounts = cells.where("state = 'number'").select("doc_id", F.col("row_id").alias("id"), "period", F.col("col").alias("p_ord"), "value")
    mine, other = (amounts.join(s.select(F.col(i).alias("id")), "id", "left_semi") for s, i in ((left, "l_id"), (right, "r_id")))
    met = lk.value_anchors(mine, other, "doc_id")
    pairs = left.join(right, "doc_id").join(met, ["doc_id", "l_id", "r_id"], "left")
    pairs = pairs.withColumns({"lexical": label_likeness(F.col("l_label"), F.col("r_label")), "anchor": F.col("anchors").isNotNull().cast("int")})
    kept = lk.keep_candidates(lk.rank_fusion(pairs, ["doc_id", "l_id"], "r_id", CHANNELS), ["doc_id", "l_id"], "r_id", F.col("anchor") > 0, top_k)
    kept = lk.provided_scores(kept, scores, ["l_id", "r_id"]).withColumnRenamed("score", "ce")
    anchored = F.col("anchor") > 0
    flow = F.col("duration") & (F.col("role") == "flow")
    b = sc.accept_value_rules(anchored, F.col("role"), flow)
    told = kept.withColumns({"a_acc": F.col("available") & sc.accept_cross_encoder(F.col("ce"), F.col("place")), "b_acc": b, "b_score": sc.value_rules_score(anchored, b), "c_acc": sc.accept_lexical(F.col("lexical"))})
    told = told.withColumns({"agreement": sc.agreement(F.col("a_acc"), F.col("b_acc"), F.col("c_acc")), "relation_type": sc.relation_type(F.col("role"), anchored), "period_scope": sc.period_scope(F.coalesce("anchors", F.array().cast(dict(kept.dtypes)["anchors"])))})
    told = told.withColumn("fused_score", sc.fused_score(F.col("ce"), F.col("b_score"), F.col("lexical")))
    return lk.reconcile(told.drop("anchors"), mine, other, "doc_id")


def run(words: DataFrame, width: float, main: Column, scores: DataFrame | None = None, control: DataFrame | None = None) -> Run:
    """Words (doc_id, page, line, text, x0, y0, x1, y1, conf) to a run; ``main`` tells a row's side by its columns.

    ``control`` holds decisions of other pages: they join the fit and never the output.  Documents without
    tables, and rows without amounts, give no relations; an empty table gives empty collections.
    """
    rows, cells = tables_of(words, width)
    decided = settled(decisions(rows, cells, main, scores))
    fitted = decided.select("fused_score", "a_acc", "b_acc", "c_acc", "recon")
    fitted = fitted if control is None else fitted.unionByName(control.select(*fitted.columns))
    any_ = F.col("a_acc") | F.col("b_acc") | F.col("c_acc")
    pool = cal.control_pool(any_, F.lit(False), F.col("recon"))
    ab = cal.fit_global(fitted.select(F.col("fused_score").alias("x"), pool.alias("y")).where("y IS NOT NULL"))
    a, b = ab or cal.FALLBACK
    emitted = decided.where(any_)
    conf = F.round(sc.relation_confidence(F.col("fused_score"), F.col("recon"), a, b), 4)
    parts = sc.confidence_components(F.col("ce"), F.col("b_score"), F.col("lexical"), F.col("recon"), a, b)
    relations = emitted.withColumns({"relation_id": F.concat_ws("~", "l_id", "r_id"), "confidence": conf, "components": parts})
    relations = relations.withColumn("low_confidence", sc.low_confidence(F.col("confidence"), F.lit(ab is not None), F.lit(False), F.col("available")))
    relations = relations.select("doc_id", "relation_id", F.col("l_id").alias("summary_row_id"), F.col("r_id").alias("footnote_row_id"), "relation_type", "period_scope", "agreement", "recon", "confidence", "low_confidence", "components")
    ledger = rows.select("table_id", "row_id", "parent_row_id").join(cells.select("row_id", "period", "value", "state", "repaired"), "row_id", "left")
    checks = ck.reconciliation(relations).unionByName(ck.parent_sums(ledger))
    return Run(rows, cells, relations, checks, (a, b))


def new_failures(clean: DataFrame, faulty: DataFrame) -> DataFrame:
    """(check_id, scope) that fail in ``faulty`` and not in ``clean``."""
    failed = lambda c: c.where("status = 'fail'").select("check_id", "scope")
    return failed(faulty).join(failed(clean), ["check_id", "scope"], "left_anti")


def inject(ledger: DataFrame, where: Column, delta: Column | int) -> DataFrame:
    """``ledger`` with ``delta`` added to the numbers of the rows that ``where`` picks: a planted fault."""
    hit = where & (F.col("state") == "number") & F.col("value").isNotNull()
    kind = dict(ledger.dtypes)["value"]
    return ledger.withColumn("value", F.when(F.coalesce(hit, F.lit(False)), F.col("value") + delta).otherwise(F.col("value")).cast(kind))
