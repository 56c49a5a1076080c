"""Assembly of table rows: roles, parents, ids, period ids and confidences, over all tables at once.

Input rows are (doc_id, page, table_no, row_no, label, section, level, n_cells), as page assembly gives
them; every rule is a window over a table or an aggregate of it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyweave.functions import grammar as g
from tallyweave.operators.ordered import last_smaller

# Fixed values.
NO_LABEL_PENALTY, EMPTY_ROW, EMPTY_TABLE = 0.15, 0.3, 0.2
TABLE = ("doc_id", "page", "table_no")


def assign_roles(rows: DataFrame, duration: str = "duration", keys: Sequence[str] = TABLE) -> DataFrame:
    """``role``: sections head groups; totals by label or by an unlabelled last line with cells; without any
    movement in the table, what would be a flow is an item, or a subitem when indented."""
    # columns of their own below the windows, or the folds would be written out wherever they are used
    rows = rows.withColumn("__label", g.clean_label(F.col("label"))).withColumn("__own", g.row_role(F.col("__label")))
    label, own = F.col("__label"), F.col("__own")
    table = Window.partitionBy(*keys)
    last = F.lead("row_no").over(table.orderBy("row_no")).isNull()
    moves = F.col(duration) | F.max(own.isin("opening", "closing", "closing_equiv")).over(table)
    first = F.when(F.col("section"), "group_header").when((own == "flow") & F.upper(label).startswith("TOPLAM"), "total").otherwise(own)
    named = F.when((label == "") & last & (F.col("n_cells") > 0), "total").otherwise(first)
    return rows.withColumns({"__named": named, "__moves": moves}).withColumn("role", F.when((F.col("__named") == "flow") & ~F.col("__moves"), F.when(F.col("level") > 0, "subitem").otherwise("item")).otherwise(F.col("__named"))).drop("__label", "__own", "__named", "__moves")


def assign_ids(rows: DataFrame, keys: Sequence[str] = TABLE) -> DataFrame:
    """``row_id`` and ``parent_row_id``: the last row above with a smaller level."""
    table_id = F.format_string("p%02d.t%02d", F.col("page").cast("int"), F.col("table_no").cast("int"))
    named = rows.withColumn("table_id", table_id).withColumn("row_id", F.concat(F.col("table_id"), F.format_string(".r%03d", F.col("row_no").cast("int"))))
    return last_smaller(named, keys, "row_no", "level", "row_id", "parent_row_id")


def period_ids(headers: DataFrame, keys: Sequence[str] = TABLE) -> DataFrame:
    """(keys, col, label) with ``period_id``: y-years where all labels are years, else slugs; twins get their column."""
    table = Window.partitionBy(*keys)
    years = F.min(F.trim(F.coalesce("label", F.lit(""))).rlike("^[0-9]+$").cast("int")).over(table) == 1
    label = F.coalesce("label", F.concat(F.lit("col"), F.col("col").cast("string")))
    made = headers.withColumn("period_id", F.when(years, F.concat(F.lit("y"), F.trim(label))).otherwise(g.slug(label)))
    twin = F.row_number().over(Window.partitionBy(*keys, "period_id").orderBy("col")) > 1
    return made.withColumn("period_id", F.when(twin, F.concat_ws("_", "period_id", F.col("col").cast("string"))).otherwise(F.col("period_id")))


def row_confidence(cells: DataFrame, rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Mean of a row's cells, less a penalty without a label; rows without cells have a fixed one."""
    means = cells.groupBy(*keys).agg(F.avg("conf").alias("mean"))
    penalty = F.when(F.coalesce("label", F.lit("")) == "", NO_LABEL_PENALTY).otherwise(0.0)
    out = rows.join(means, list(keys), "left")
    return out.withColumn("row_conf", F.coalesce(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("mean") * (1 - penalty))), F.lit(EMPTY_ROW))).drop("mean")


def table_confidence(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Mean of the rows' confidence, weighed by the share of columns whose period is known."""
    complete = F.when(F.first("columns") > 0, F.first("periods") / F.first("columns")).otherwise(1.0)
    return rows.groupBy(*keys).agg(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.avg("row_conf") * (0.7 + 0.3 * complete))).alias("table_conf"))
