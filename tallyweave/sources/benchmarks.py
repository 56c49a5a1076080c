"""Benchmark tables: read, check, and converters from JSON, logs and Markdown.

A converter is a query over lines or parsed JSON that gives typed rows; what it cannot parse becomes a
note, never an invented value.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# Fixed values of the format.
SCOPES = ("this document", "other documents", "offline refit", "colab")
RESERVED = ("id", "label", "role", "source")
KIND_TYPES = {"text": ("string",), "bool": ("boolean",), "number": ("int", "bigint", "double", "float"), "pct": ("int", "bigint", "double", "float"), "seconds": ("int", "bigint", "double", "float")}
SUMMARY_LINE = r"^tables=(\d+) rows=(\d+) cells=(\d+) relations=(\d+) \(low_conf=(\d+)\) checks: (\d+) pass / (\d+) fail / (\d+) not_evaluable"
EXIT_LINE = r"^# \S+ run exit=(\d+) wall=(\d+)s"
METRIC_LINE = r"^\s*\[(AGREE|DISAGREE)\]\s+(.+?)\s*:\s*claimed\s+(.+?)\s*;\s*recomputed\s+(.+?)\s*$"
SECTION_LINE = r"^==+\s*(.+?)\s*==+$"


def problems(columns: Sequence[tuple[str, str]], rows: DataFrame, baseline: str | None) -> list[str]:
    """What is wrong with a benchmark of (key, kind) columns and its rows; empty when nothing is."""
    keys = [k for k, _ in columns]
    out = ["duplicate column key"] if len(set(keys)) < len(keys) else []
    out += [f"column {k} clashes with a row field" for k in keys if k in RESERVED]
    kinds = dict(rows.dtypes)
    out += [f"column {k} is not {kind}" for k, kind in columns if k in kinds and kinds[k] not in KIND_TYPES[kind]]
    if not rows.groupBy("id").count().where("count > 1").isEmpty():
        out.append("duplicate row id")
    if baseline is not None and rows.where(F.col("id") == baseline).isEmpty():
        out.append("baseline is no row")
    return out


def listing(benchmarks: DataFrame) -> DataFrame:
    """In order of scope, then id."""
    place = F.array_position(F.array(*map(F.lit, SCOPES)), F.col("scope"))
    return benchmarks.withColumn("place", F.row_number().over(Window.orderBy(place, "id")))


def variant_rows(variants: DataFrame, fields: Mapping[str, str]) -> DataFrame:
    """(name, body JSON) to a row for each variant: a null fit is rejected, the shipped one is told apart."""
    get = lambda path: F.get_json_object("body", f"$.{path}")
    failed = F.contains("body", F.lit('"fit":null')) | F.contains("body", F.lit('"fit": null'))
    role = F.when(failed, "rejected").when(F.col("name") == "shipped", "shipped").otherwise("measured")
    return variants.select(F.col("name").alias("id"), role.alias("role"), *[F.when(~failed, get(path).try_cast("double")).alias(k) for k, path in fields.items()])


def pivot_counts(detected: DataFrame, pages: Sequence[int]) -> DataFrame:
    """(method, page, tables, gold) to a row for each method with a column for each page and totals."""
    per = [F.sum(F.when(F.col("page") == p, F.col("tables"))).alias(f"p{p:02d}") for p in pages]
    return detected.groupBy("method").agg(*per, F.sum("tables").alias("total"), F.sum("gold").alias("gold"))


def log_facts(lines: DataFrame) -> DataFrame:
    """(file, text) of run logs to one row a file; a log without its summary line has null counts and a note."""
    g = lambda pattern, i: F.max(F.when(F.col("text").rlike(pattern), F.regexp_extract("text", pattern, i)))
    names = ("tables", "rows", "cells", "relations", "flagged", "passed", "failed", "not_evaluable")
    facts = [g(SUMMARY_LINE, i).cast("int").alias(n) for i, n in enumerate(names, start=1)]
    out = lines.groupBy("file").agg(*facts, g(EXIT_LINE, 1).cast("int").alias("exit"), g(EXIT_LINE, 2).cast("double").alias("wall_s"))
    return out.withColumn("note", F.when(F.col("tables").isNull(), "parse_error: no summary line"))


def markdown_table(lines: DataFrame, heading: str) -> DataFrame:
    """(file, line_no, text): the cells of the first table after a heading, ``file, line_no, cells``."""
    w = Window.partitionBy("file").orderBy("line_no")
    seen = F.max((F.col("text") == heading).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, -1))
    after = lines.withColumn("after", F.coalesce(seen, F.lit(0))).where("after = 1").withColumn("bar", F.col("text").startswith("|"))
    run = F.sum((F.col("bar") & ~F.coalesce(F.lag("bar").over(w), F.lit(False))).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0))
    rows = after.withColumn("run", run).where("bar AND run = 1")
    cells = F.transform(F.split(F.btrim(F.trim("text"), F.lit("|")), r"\|"), lambda c: F.trim(c))
    return rows.select("file", "line_no", cells.alias("cells"))


def sectioned(lines: DataFrame) -> DataFrame:
    """(file, line_no, text): metric lines with the section they stand in."""
    w = Window.partitionBy("file").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    head = F.when(F.col("text").rlike(SECTION_LINE), F.regexp_extract("text", SECTION_LINE, 1))
    group = F.last(head, ignorenulls=True).over(w)
    m = lambda i: F.regexp_extract("text", METRIC_LINE, i)
    rows = lines.withColumn("grp", F.coalesce(group, F.lit(""))).where(F.col("text").rlike(METRIC_LINE))
    return rows.select("file", "line_no", "grp", m(2).alias("label"), m(3).alias("claimed"), m(4).alias("recomputed"), (m(1) == "AGREE").alias("agree"))


def tagged_join(scores: DataFrame, runs: DataFrame, diffs: DataFrame, order: Sequence[str]) -> DataFrame:
    """Three logs joined on ``tag``, in a given order of tags."""
    place = F.array_position(F.array(*map(F.lit, order)), F.col("tag"))
    return scores.join(runs, "tag", "full").join(diffs, "tag", "full").withColumn("place", place)


def agreement_share(agree: Column, cells: Column) -> Column:
    return F.round(100 * agree / cells, 1)
