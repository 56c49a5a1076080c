"""Finding notes in documents: contents lines, folios, headings, and the run of pages of a note."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyweave.functions import grammar as g
from tallyweave.operators.ordered import consecutive_runs, monotone_repair

# Fixed patterns of the document class.
TOC_NUMBER = r"^NOT\s*([0-9lIİiOoSB.,]{1,4})\s+"
TOC_PAGE = r"[ .]([0-9lIO]{1,3})(?:-[0-9lIO]{1,3})?\s*$"
TOC_LINE = r"^NOT\s*([0-9lIİiOoSB.,]{1,4})\s+(.{3,80})$"
TOC_END = r"(?:\s|\.)([0-9lIO]{1,3})(?:-[0-9lIO]{1,3})?\s*$"
TITLE_REST = r"[^A-ZÇĞİÖŞÜa-zçğıöşü)\s].*$"
ALONE = r"^\s*([0-9lIİiOo]{1,3})\s*[.\-]?\s*$"
WITH_TEXT = r"^\s*([0-9lIİiOo]{1,3})\s*[.\-]\s+\S"


def toc_fields(lines: DataFrame) -> DataFrame:
    """The number and first page that a contents line prints, as printed."""
    return lines.where(F.col("text").rlike(TOC_NUMBER)).withColumns({"number": F.regexp_extract("text", TOC_NUMBER, 1), "page": F.regexp_extract("text", TOC_PAGE, 1)})


def contents(lines: DataFrame) -> DataFrame:
    """A table of contents, (doc_id, line_no, text) to ``doc_id, place, number, title, page``.

    Where three fifths of the numbers that can be read are their line's place, places are the numbers; else
    lines without one go.  Pages that fall back behind an earlier one are dropped.
    """
    text = F.replace(F.replace(g.strip(F.col("text")), F.lit("NOTI"), F.lit("NOT 1")), F.lit("NOT1"), F.lit("NOT 1"))
    hits = lines.withColumn("text", text).where(F.col("text").rlike(TOC_LINE))
    rest = F.regexp_extract("text", TOC_LINE, 2)
    digits = F.translate(F.regexp_extract(rest, TOC_END, 1), g.LOOKALIKES, g.LOOKALIKE_DIGITS)
    heading = F.btrim(F.regexp_replace(F.regexp_replace(rest, TOC_END, ""), TITLE_REST, ""), F.lit(" ."))
    doc = Window.partitionBy("doc_id")
    place = F.row_number().over(doc.orderBy("line_no"))
    made = hits.select("doc_id", place.alias("place"), g.note_number(F.regexp_extract("text", TOC_LINE, 1)).alias("read"), heading.alias("title"), F.when(digits.rlike("^[0-9]+$"), digits.cast("int")).alias("page"))
    known, agree = F.count("read").over(doc), F.count_if(F.col("read") == F.col("place")).over(doc)
    made = made.withColumn("counted", (known > 0) & (agree >= 0.6 * known))
    made = made.where("counted OR read IS NOT NULL").withColumn("number", F.when(F.col("counted"), F.col("place")).otherwise(F.col("read")))
    return monotone_repair(made, ["doc_id"], ["place"], "page").select("doc_id", "place", "number", "title", F.col("repaired").alias("page"))


def first_page_with(pages: DataFrame, key: str, word: str, upto: int) -> DataFrame:
    """The first of the leading pages whose folded text holds a word."""
    return pages.where((F.col("page") <= upto) & F.contains(g.fold(F.col("text")), F.lit(word))).groupBy(key).agg(F.min("page").alias("page"))


def folios(lines: DataFrame, key: str, last: int = 4) -> DataFrame:
    """(key, line, n, text): the lowest of the last lines that is one short number."""
    short = lines.where((F.col("line") > F.col("n") - last) & F.col("text").rlike("^[0-9]{1,3}$"))
    return short.groupBy(key).agg(F.max_by("text", "line").cast("int").alias("folio"))


def heading_notes(lines: DataFrame, key: str, first: int = 6) -> DataFrame:
    """The first of the leading lines that looks like a note heading decides, even if its number is none."""
    digits = F.when(F.col("text").rlike(ALONE), F.regexp_extract("text", ALONE, 1)).when(F.col("text").rlike(WITH_TEXT), F.regexp_extract("text", WITH_TEXT, 1))
    heads = lines.where(F.col("line") <= first).withColumn("digits", digits).where("digits IS NOT NULL")
    return heads.groupBy(key).agg(F.min_by("digits", "line").alias("digits")).select(key, g.note_number(F.col("digits")).alias("note"))


def locate(marks: DataFrame, note: int, low: int, high: int, scan_from: int) -> DataFrame:
    """(doc_id, page, note) marks to the run of pages of a note.

    The window that the contents allow is searched first, then the pages from ``scan_from`` on; documents
    without a hit have no row.  The run goes both ways from the hit.
    """
    mine = marks.where(F.col("note") == note)
    bounded = F.min(F.when(F.col("page").between(low, high), F.col("page")))
    later = F.min(F.when(F.col("page") >= scan_from, F.col("page")))
    target = mine.groupBy("doc_id").agg(F.coalesce(bounded, later).alias("target")).where("target IS NOT NULL")
    runs = consecutive_runs(mine.select("doc_id", "page"), ["doc_id"], "page")
    spans = runs.groupBy("doc_id", "run").agg(F.min("page").alias("first_page"), F.max("page").alias("last_page"), F.count("*").alias("pages"))
    return spans.join(target, "doc_id").where(F.col("target").between(F.col("first_page"), F.col("last_page"))).select("doc_id", "first_page", "last_page", "pages")


def missing_lines(lines: DataFrame, rows: DataFrame, key: str, height: int, up: int, down: int) -> DataFrame:
    """Lines (key, y0) in a table's band of rows (k, r0) that overlap none of them."""
    band = rows.groupBy("k").agg(F.min("r0").alias("lo"), F.max(F.col("r0") + height).alias("hi"))
    near = lines.join(band, F.col(key) == F.col("k")).where(F.col("y0").between(F.col("lo") - up * height, F.col("hi") + down * height)).drop("k", "lo", "hi")
    over = (F.col(key) == F.col("k")) & (F.col("y0") < F.col("r0") + height) & (F.col("y0") + height > F.col("r0"))
    return near.join(rows, over, "left_anti")
