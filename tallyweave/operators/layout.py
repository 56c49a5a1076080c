"""Page layout: words to lines, line kinds, columns, segments.  Column expressions and windows only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyweave.functions import grammar as g
from tallyweave.operators import ordered as o

LINE = ("doc_id", "page", "line")


def lines_of(words: DataFrame) -> DataFrame:
    """``doc_id, page, line, text, x0, y0, x1, y1, n_words``: words joined from left to right."""
    word = F.struct("x0", "pos", "text")
    made = words.groupBy(*LINE).agg(F.array_sort(F.collect_list(word)).alias("w"), F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"), F.count("*").alias("n_words"))
    return made.select(*LINE, F.array_join(F.transform("w", lambda x: x["text"]), " ").alias("text"), "x0", "y0", "x1", "y1", "n_words")


def line_kinds(words: DataFrame, width: float) -> DataFrame:
    """data: an amount in the right half and at most nine words; prose: ten words or more; other."""
    money, ref = g.is_money(F.col("text")), g.is_small_ref(F.col("text"))
    seen = words.withColumns({"m": money, "r": ref})
    counts = seen.groupBy(*LINE).agg(F.count_if(F.col("m") & (F.col("x1") > width / 2)).alias("right_money"), F.count_if(~F.col("m") & ~F.col("r")).alias("text_words"))
    kind = F.when((F.col("right_money") > 0) & (F.col("text_words") <= 9), "data").when(F.col("text_words") >= 10, "prose").otherwise("other")
    return counts.select(*LINE, kind.alias("kind"))


def label_lines(words: DataFrame, width: float, money: Column | None = None) -> DataFrame:
    """Lines that may label rows: two lettered words or more, eight words at most, on the left, not in brackets, no amount.

    ``money`` tells amounts where the words' source knows them; without it the grammar does, which takes any long number for one.
    """
    money = g.is_money(F.col("text")) if money is None else money
    told = words.groupBy(*LINE).agg(F.count_if(F.col("text").rlike(r"\p{L}")).alias("worded"), F.count_if(money).alias("moneys"))
    lines = lines_of(words).join(told, list(LINE))
    return lines.where((F.col("worded") >= 2) & (F.col("n_words") <= 8) & (F.col("x0") < width / 2) & ~F.col("text").startswith("(") & (F.col("moneys") == 0))


def years_explain(head: Column) -> Column:
    """Aggregate over a table's columns: whether years head half of them or more; else their words name them."""
    year = F.rtrim(head, F.lit("."))
    dated = year.rlike("^[0-9]{1,9}$") & year.try_cast("int").between(*g.YEARS)
    return 2 * F.count_if(F.coalesce(dated, F.lit(False))) >= F.count("*")


def bbox(df: DataFrame, keys: o.Keys) -> DataFrame:
    return df.groupBy(*keys).agg(F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"))


def upper_median(value: Column) -> Column:
    """The element at n div 2 of the sorted values: the upper one of two middles."""
    sorted_ = F.sort_array(F.collect_list(value))
    return F.element_at(sorted_, (F.size(sorted_) / 2).cast("int") + 1)


def page_profile(pages: DataFrame) -> DataFrame:
    """Per document: native_text (all pages have text), mixed (some), image_only (none), and page counts by shape."""
    n = F.count("*")
    text = F.count_if("has_text")
    kind = F.when(text == n, "native_text").when(text > 0, "mixed").otherwise("image_only")
    size = F.concat_ws("x", F.round("width", 1).cast("string"), F.round("height", 1).cast("string"))
    by_size = pages.groupBy("doc_id", size.alias("size")).agg(F.count("*").alias("n")).groupBy("doc_id").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("size", "n")))).alias("dimensions"))
    whole = pages.groupBy("doc_id").agg(
        n.alias("pages"),
        kind.alias("source_kind"),
        text.alias("text_pages"),
        F.count_if("has_image").alias("image_pages"),
        F.count_if(F.col("rotation") % 360 != 0).alias("rotated"),
        F.count_if(F.col("width") > F.col("height")).alias("landscape"),
    )
    return whole.join(by_size, "doc_id")


def best_orientation(reads: DataFrame, keys: o.Keys, enough: int = 30) -> DataFrame:
    """Per page the angle whose read has most long, sure words; an earlier probe wins a tie.

    Upright pages with ``enough`` such words need no other probe, so later ones do not count for them.
    """
    quality = F.count_if((F.col("conf") >= 60) & (F.length("text") >= 3))
    scored = reads.groupBy(*keys, "probe", "angle").agg(quality.alias("quality"))
    upright = scored.where((F.col("probe") == 0) & (F.col("quality") >= enough)).select(*keys)
    best = F.min(F.struct((-F.col("quality")).alias("q"), "probe", "angle"))
    rest = scored.join(upright, list(keys), "left_anti").groupBy(*keys).agg(best.alias("b")).select(*keys, F.col("b.angle").alias("angle"), (-F.col("b.q")).alias("quality"))
    done = scored.where(F.col("probe") == 0).join(upright, list(keys), "left_semi").select(*keys, "angle", "quality")
    return done.unionByName(rest)


def scan_words(tsv: DataFrame, line_col: str = "line") -> DataFrame:
    """Word rows of an OCR table (tab-separated, twelve fields): blank texts and unsure rows (conf < 0) go."""
    f = F.split(F.col(line_col), "\t")
    num = lambda i, kind="double": F.get(f, F.lit(i)).try_cast(kind)
    made = tsv.where(F.size(f) >= 12).withColumns({"text": F.get(f, F.lit(11)), "conf": num(10), "x0": num(6), "y0": num(7), "w": num(8), "h": num(9)})
    kept = made.where((g.strip(F.col("text")) != "") & (F.col("conf") >= 0))
    return kept.withColumns({"x1": F.col("x0") + F.col("w"), "y1": F.col("y0") + F.col("h"), "block": num(2, "int"), "par": num(3, "int"), "line_no": num(4, "int")}).drop("w", "h")
