"""Stores and sinks: runs, relations, labels, annotations, fingerprints, reports.

Everything is a table in a folder that Spark reads and writes; a store is one folder of Parquet, newest
row wins.  Nothing here opens a path itself, so any file system that Spark knows will do.
"""

from __future__ import annotations

import contextlib
import html
import json
import platform
import time
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from tallyweave.functions.scoring import conf_color
from tallyweave.operators.ordered import last_write_wins

COLLECTIONS = ("rows", "cells", "tables", "relations", "checks")
LABELS, KINDS = ("accept", "reject", "unsure"), ("relation", "cell")
LABEL_SCHEMA = "run_id string, kind string, key string, label string, note string, ts timestamp"
NOTE_SCHEMA = "annotation_id string, doc_sha string, page int, kind string, object_ids array<string>, note string, ts timestamp"


def write_run(root: str, run_id: str, parts: Mapping[str, DataFrame], meta: Mapping[str, object]) -> None:
    """The five collections and one row of meta, partitioned by run; a rerun replaces its own partition."""
    for name in COLLECTIONS:
        if name in parts:
            parts[name].write.mode("overwrite").parquet(f"{root}/{name}/run_id={run_id}")
    spark = next(iter(parts.values())).sparkSession
    spark.createDataFrame([tuple(str(v) for v in meta.values())], ", ".join(f"{k} string" for k in meta)).write.mode("overwrite").parquet(f"{root}/meta/run_id={run_id}")


class Busy(RuntimeError):
    """Another run holds the lock."""


@contextlib.contextmanager
def running(spark: SparkSession, root: str, run_id: str, overrides: Mapping[str, object] | None = None):
    """One run at a time: holds ``root``'s lock and keeps the run's state (running, then done or error), time and settings.

    The lock is a file that only one caller can create, on whatever file system holds the store.
    """
    lock = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/lock")
    fs = lock.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.createNewFile(lock):
        raise Busy(run_id)
    start = time.time()
    told = {"platform": platform.platform(), "overrides": json.dumps(overrides or {}, sort_keys=True)}

    def tell(state: str, error: str = "") -> None:
        row = {"run_id": run_id, "state": state, "started": start, "duration_s": round(time.time() - start, 3), "error": error, **told}
        meta = spark.createDataFrame([tuple(str(v) for v in row.values())], ", ".join(f"{k} string" for k in row))
        meta.write.mode("overwrite").parquet(f"{root}/status/of={run_id}")

    try:
        tell("running")
        yield
        tell("done")
    except BaseException as error:
        tell("error", f"{type(error).__name__}: {error}")
        raise
    finally:
        fs.delete(lock, False)


def status(spark: SparkSession, root: str, run_id: str) -> str:
    """running, done or error; absent for a run that never began."""
    try:
        return spark.read.parquet(f"{root}/status/of={run_id}").first().state
    except AnalysisException:
        return "absent"


def batch(spark: SparkSession, root: str, runs: Mapping[str, Callable[[], None]]) -> dict[str, str]:
    """Runs what is not done yet, in order; one that fails does not stop the rest."""
    for run_id, work in runs.items():
        if status(spark, root, run_id) == "done":
            continue
        with contextlib.suppress(Exception), running(spark, root, run_id):
            work()
    return {run_id: status(spark, root, run_id) for run_id in runs}


def read_run(spark: SparkSession, root: str, name: str, run_id: str) -> DataFrame | None:
    """One collection of a run, or None when it was never stored."""
    try:
        return spark.read.parquet(f"{root}/{name}/run_id={run_id}")
    except AnalysisException:
        return None


def relation_lines(relations: DataFrame, rows: DataFrame) -> DataFrame:
    """``value``: a JSON line for each relation, with the labels of both its rows; a missing row has none."""

    def named(prefix: str) -> DataFrame:
        return rows.select(F.col("row_id").alias(f"{prefix}_row_id"), F.col("label_raw").alias(f"{prefix}_label"))

    out = relations.join(named("summary"), "summary_row_id", "left").join(named("footnote"), "footnote_row_id", "left")
    out = out.withColumns({c: F.coalesce(c, F.lit("")) for c in ("summary_label", "footnote_label")})
    return out.select(F.to_json(F.struct(*[F.col(c) for c in [*relations.columns, "summary_label", "footnote_label"]])).alias("value"))


def report_html(relations: DataFrame, checks: DataFrame, most: int = 1000) -> str:
    """A page for people: the ``most`` relations of least confidence (a report's limit) and check counts."""
    shown = relations.withColumn("band", conf_color(F.col("confidence"))).orderBy("confidence", "relation_id").limit(most).collect()
    counts = checks.groupBy("grp", "status").count().orderBy("grp", "status").collect()
    cell = lambda v: f"<td>{html.escape('' if v is None else str(v))}</td>"
    rel = "".join(f"<tr class='{r['band']}'>{cell(r['relation_id'])}{cell(r['agreement'])}{cell(r['confidence'])}</tr>" for r in shown)
    chk = "".join(f"<tr>{cell(r['grp'])}{cell(r['status'])}{cell(r['count'])}</tr>" for r in counts)
    return f"<html><body><table>{rel}</table><table>{chk}</table></body></html>"


def table_grid(rows: DataFrame, cells: DataFrame, periods: Sequence[str]) -> DataFrame:
    """A table's rows with a column for each period."""
    return rows.join(cells, "row_id", "left").groupBy("table_id", "row_id", "label").pivot("period", list(periods)).agg(F.first("raw"))


# --- labels and annotations -----------------------------------------------------------------------------


def put_label(spark: SparkSession, root: str, run_id: str, kind: str, key: str, label: str | None, note: str = "") -> None:
    """Sets a reviewer's label, or clears it with None; the store only grows, the newest row wins."""
    if kind not in KINDS or (label is not None and label not in LABELS):
        raise ValueError("unknown kind or label")
    row = spark.createDataFrame([(run_id, kind, key, label, note)], "run_id string, kind string, key string, label string, note string")
    row.withColumn("ts", F.current_timestamp()).write.mode("append").parquet(f"{root}/labels")


def read_labels(spark: SparkSession, root: str) -> DataFrame:
    try:
        stored = spark.read.schema(LABEL_SCHEMA).parquet(f"{root}/labels")
    except AnalysisException:
        return spark.createDataFrame([], LABEL_SCHEMA)
    return current_labels(stored)


def current_labels(stored: DataFrame) -> DataFrame:
    """The newest label of each key; a cleared one is gone."""
    return last_write_wins(stored, ["run_id", "kind", "key"], ["ts"]).where("label IS NOT NULL")


def put_annotations(root: str, notes: DataFrame) -> None:
    """Appends annotations after checking them: known columns, an id, a page from 1."""
    if missing := {c.split()[0] for c in NOTE_SCHEMA.split(", ")} - set(notes.columns):
        raise ValueError(f"columns missing: {sorted(missing)}")
    if not notes.where("annotation_id IS NULL OR page IS NULL OR page < 1").isEmpty():
        raise ValueError("annotations need an id and a page from 1")
    notes.write.mode("append").parquet(f"{root}/annotations")


def flat_annotations(notes: DataFrame) -> DataFrame:
    """For CSV: object ids joined by semicolons."""
    return notes.withColumn("object_ids", F.array_join("object_ids", ";"))


def export(df: DataFrame, path: str, kind: str) -> None:
    if kind not in ("csv", "json"):
        raise ValueError("kind is csv or json")
    getattr(df.write.mode("overwrite").option("header", "true"), kind)(path)


# --- fingerprints ---------------------------------------------------------------------------------------


def fingerprints(spark: SparkSession, path: str) -> DataFrame:
    """``path, length, sha256`` of every file under a path."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select("path", "length", F.sha2("content", 256).alias("sha256"))


def drift(stored: DataFrame, derived: DataFrame) -> DataFrame:
    """(file, line_no, text) of both sides: each file's first line that differs."""
    a, b = stored.withColumnRenamed("text", "stored"), derived.withColumnRenamed("text", "derived")
    off = a.join(b, ["file", "line_no"], "full").where(~F.col("stored").eqNullSafe(F.col("derived")))
    return off.groupBy("file").agg(F.min(F.struct("line_no", "stored", "derived")).alias("d")).select("file", "d.*")


def gold_cells(doc: DataFrame) -> DataFrame:
    """Reference cells from nested JSON: tables[] of rows[] with a map of values by period."""
    t = doc.select(F.explode("tables").alias("t")).select("t.id", F.col("t.pdf_page").alias("page"), F.explode("t.rows").alias("r"))
    return t.select(F.col("id").alias("table_id"), "page", "r.row_id", "r.label_raw", F.explode("r.values").alias("period", "v")).select("table_id", "page", "row_id", "label_raw", "period", "v.state", "v.value", "v.value_raw")
