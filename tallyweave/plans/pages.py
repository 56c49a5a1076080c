"""Queries of page assembly, note location, sources and streams, with their DuckDB twins."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyweave.functions import fuzzy
from tallyweave.functions import grammar as g
from tallyweave.functions import tokens as tk
from tallyweave.operators import assembly as asm
from tallyweave.operators import checks as ck
from tallyweave.operators import filing as fl
from tallyweave.operators import locate as lc
from tallyweave.operators import matching as mt
from tallyweave.operators import pages as pg
from tallyweave.plans.layout import STATEMENT, WIDTH, statement_words
from tallyweave.plans.runs import A, K, KEY, rels
from tallyweave.sources import benchmarks as bm
from tallyweave.sources import config, stores
from tallyweave.sources.tables import table
from tallyweave.streaming import monitor

ALL: dict[str, tuple] = {}


def query(twin: str | None):
    def add(f):
        ALL[f.__name__] = (f, twin)
        return f

    return add


# --- page assembly -------------------------------------------------------------------------------------


def _pages(spark, sf):
    return statement_words(spark, sf).select("doc_id", F.col("page").cast("int").alias("page"), "line", "text", "x0", "y0", "x1", "y1", "conf")


@query(None)
def x1_extract_tables(spark, sf):
    """Every row of every table of every page: kinds, segments, columns, cells, wrapped labels, coherence."""
    return pg.page_rows(_pages(spark, sf), WIDTH).select("doc_id", "page", "table_no", "row_no", "row_id", "label", "section", F.array_join(F.col("refs").cast("array<string>"), " ").alias("refs"), "n_cells")


@query(None)
def x3_assemble_cells(spark, sf):
    """Also j5 and j6: ghost duplicates and free columns are settled while cells are placed."""
    return pg.page_cells(_pages(spark, sf), WIDTH)


def filing_words(spark, sf):
    """Statements with a note page each, which repeats every other line in new wording."""
    words = _pages(spark, sf)
    label = F.concat(F.col("text"), F.lit(" "), F.lit("toplami"))
    note = words.where("line % 2 = 1").withColumns({"page": F.lit(1), "text": F.when(F.col("text").startswith("Kalem") & (F.col("line") % 4 == 1), label).otherwise(F.col("text"))})
    return words.unionByName(note)


@query(None)
def run_filings(spark, sf):
    """Words to relations in one run: tables, sides, candidates, decisions, fit, confidences."""
    done = fl.run(filing_words(spark, sf), WIDTH, F.col("page") == 0)
    return done.relations.drop("components")


@query(None)
def run_filing_checks(spark, sf):
    """The same run's checks."""
    return fl.run(filing_words(spark, sf), WIDTH, F.col("page") == 0).checks


_HEAD = "h AS (SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN (c_custkey % 30 + 1) || '. YATIRIM ' || c_mktsegment ELSE 'KONSOLIDE ' || c_mktsegment || ' TABLOSU' END AS title FROM customer)"


def _titled(spark, sf):
    c = table(spark, sf, "customer")
    title = F.when(F.col("c_custkey") % 4 == 0, F.concat((F.col("c_custkey") % 30 + 1).cast("string"), F.lit(". YATIRIM "), F.col("c_mktsegment"))).otherwise(F.concat(F.lit("KONSOLIDE "), F.col("c_mktsegment"), F.lit(" TABLOSU")))
    lines = F.array(F.struct(F.lit(0).alias("line"), F.lit("(bin TL)").alias("text")), F.struct(F.lit(1).alias("line"), title.alias("text")))
    lines = c.select(F.col("c_custkey").alias("doc_id"), F.explode(lines).alias("l")).select("doc_id", "l.line", F.posexplode(F.split("l.text", " ")).alias("pos", "text"))
    y0 = (100 + 200 * F.col("line")).cast("double")
    return lines.select("doc_id", F.lit(0).alias("page"), F.col("line").cast("bigint").alias("line"), "text", (100.0 + 300 * F.col("pos")).alias("x0"), y0.alias("y0"), (100.0 + 300 * F.col("pos") + 20 * F.length("text")).alias("x1"), (y0 + 30).alias("y1"), F.lit(90.0).alias("conf"))


@query(f"WITH {_HEAD} SELECT c_custkey AS doc_id, title FROM h")
def x2_titles(spark, sf):
    tops = table(spark, sf, "customer").select(F.col("c_custkey").alias("doc_id"), F.lit(0).alias("page"), F.lit(600.0).alias("y0"))
    return pg.titles(pg.page_lines(_titled(spark, sf), WIDTH), tops).select("doc_id", "title")


@query(f"WITH {STATEMENT}, t AS (SELECT DISTINCT doc_id, line, y0 FROM statement), n AS (SELECT *, CASE WHEN abs(y0 - line % 2 * 50 - lag(y0 - line % 2 * 50) OVER w) < 15 THEN 0 ELSE 1 END AS new FROM (SELECT doc_id, line, y0 FROM t) WINDOW w AS (PARTITION BY doc_id ORDER BY line)) SELECT doc_id, sum(new) AS lines FROM n GROUP BY doc_id")
def a2_baseline_merge(spark, sf):
    # odd lines move up to nearly meet the line above
    moved = F.col("line") % 2 * 50
    words = _pages(spark, sf).withColumns({"y0": F.col("y0") - moved, "y1": F.col("y1") - moved})
    return pg.merged_lines(pg.page_lines(words, WIDTH)).select("doc_id", F.size("merged").cast("bigint").alias("lines"))


@query("WITH r AS (SELECT o_custkey, o_orderkey, o_orderstatus = 'F' AS bare, CASE WHEN o_orderkey % 2 = 0 THEN 20 ELSE 0 END AS x FROM orders), n AS (SELECT *, max(CASE WHEN NOT bare THEN o_orderkey END) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS later FROM r) SELECT o_custkey, count(*) FILTER (WHERE NOT bare) AS rows, count(*) FILTER (WHERE bare AND later IS NULL) AS dropped FROM n GROUP BY o_custkey")
def w8_wrapped_labels(spark, sf):
    """Rows without cells wait for the next one with a cell; what waits at the end is left out."""
    key, bare = F.col("o_orderkey"), F.col("o_orderstatus") == "F"
    some = F.array(F.lit(None).cast(pg.CELL))
    x0 = F.when(key % 2 == 0, 20.0).otherwise(0.0)
    row = F.struct(key.cast("string").alias("label"), x0.alias("x0"), key.cast("double").alias("y0"), key.cast("double").alias("y1"), F.lit(False).alias("section"), F.array().cast("array<int>").alias("refs"), F.when(bare, F.slice(some, 1, 0)).otherwise(some).alias("cells")).cast(pg.ROW)
    rows = table(spark, sf, "orders").groupBy("o_custkey").agg(F.transform(F.array_sort(F.collect_list(F.struct(key, row.alias("row")))), lambda x: x["row"]).alias("rows"))
    merged = rows.withColumn("merged", pg.wrapped(F.col("rows"), 10.0))
    used = F.aggregate("merged", F.lit(0), lambda n, r: n + F.size(F.split(r["label"], " ")))
    return merged.select("o_custkey", F.size(F.filter("merged", lambda r: F.size(r["cells"]) > 0)).cast("bigint").alias("rows"), (F.size("rows") - used).cast("bigint").alias("dropped"))


@query(None)
def w11_segment_dedupe(spark, sf):
    """A customer's amounts without restatements of the first, and without the parts of sums among them."""
    v = F.floor(F.col("o_totalprice") / 100000).cast(ck.AMOUNT)
    amounts = table(spark, sf, "orders").groupBy("o_custkey").agg(F.transform(F.array_sort(F.collect_list(F.struct("o_orderkey", v.alias("v")))), lambda x: x["v"]).alias("v"))
    kept = amounts.withColumn("rest", ck.picked(F.col("v"), ck.without_restated(F.col("v"), F.get("v", F.lit(0)))))
    return kept.select("o_custkey", F.size("rest").cast("bigint").alias("kept"), F.size(ck.without_parts(F.col("rest"))).cast("bigint").alias("heads"))


@query("WITH l AS (SELECT l_orderkey, l_linenumber, l_partkey, 'Kalem oranı' AS label, l_suppkey % 40 * 30 AS y0 FROM lineitem WHERE l_returnflag = 'R'), box AS (SELECT l_orderkey, min(l_linenumber * 60) AS lo, max(l_linenumber * 60 + 30) AS hi FROM lineitem WHERE l_returnflag <> 'R' GROUP BY 1) SELECT l.l_orderkey, l_linenumber, l_partkey FROM l JOIN box ON box.l_orderkey = l.l_orderkey AND y0 BETWEEN lo - 90 AND hi + 150 WHERE NOT EXISTS (SELECT 1 FROM lineitem d WHERE d.l_orderkey = l.l_orderkey AND d.l_returnflag <> 'R' AND l.y0 < d.l_linenumber * 60 + 30 AND l.y0 + 30 > d.l_linenumber * 60)")
def x9_missing_rate_rows(spark, sf):
    """The window form: rate lines in a table's band that overlap none of its rows."""
    li = table(spark, sf, "lineitem")
    lines = li.where("l_returnflag = 'R'").select("l_orderkey", "l_linenumber", "l_partkey", (F.col("l_suppkey") % 40 * 30).alias("y0"))
    rows = li.where("l_returnflag <> 'R'").select(F.col("l_orderkey").alias("k"), (F.col("l_linenumber") * 60).alias("r0"))
    return lc.missing_lines(lines, rows, "l_orderkey", height=30, up=3, down=5).select("l_orderkey", "l_linenumber", "l_partkey")


@query("WITH r AS (SELECT l_orderkey, l_linenumber, l_partkey, l_quantity::INT AS q, l_suppkey FROM lineitem WHERE l_returnflag = 'R'), v AS (SELECT *, CASE WHEN l_suppkey % 3 = 0 THEN 'exact' WHEN l_suppkey % 3 = 1 THEN 'suffix' ELSE 'mismatch' END AS vote FROM r) SELECT l_orderkey, count(*) AS cells, count(*) FILTER (WHERE vote = 'exact') AS exact, count(*) FILTER (WHERE vote = 'suffix') AS suffix, count(*) FILTER (WHERE vote = 'mismatch') AS mismatch FROM v GROUP BY 1")
def x8_rate_rescue(spark, sf):
    """Also s6: the vote of the primary reader's digits on a second read of a rate cell."""
    r = table(spark, sf, "lineitem").where("l_returnflag = 'R'")
    q = F.col("l_quantity").cast("int")
    other = F.when(F.col("l_suppkey") % 3 == 0, q.cast("string")).when(F.col("l_suppkey") % 3 == 1, F.concat(F.lit("7"), q.cast("string"))).otherwise((q + 1).cast("string"))
    vote = g.digit_vote(g.digits_of(F.concat(F.lit("%"), q.cast("string"))), other)
    counts = [F.count_if(F.col("vote") == v).alias(v) for v in ("exact", "suffix", "mismatch")]
    return r.select("l_orderkey", vote.alias("vote")).groupBy("l_orderkey").agg(F.count("*").alias("cells"), *counts)


# --- matching ------------------------------------------------------------------------------------------


@query(None)
def j17_gold_match(spark, sf):
    """Gold rows to extracted rows of a page: exact labels first, then the best ratio of 55 or more, in gold order."""
    p = table(spark, sf, "part")
    gold = p.where("p_partkey % 2 = 0").select((F.col("p_partkey") % 64).alias("page"), F.col("p_partkey").alias("gold_id"), "p_name")
    got = p.where("p_partkey % 2 = 1").select((F.col("p_partkey") % 64).alias("page"), F.col("p_partkey").alias("row_id"), "p_name")
    got = got.withColumn("page", F.col("page") - 1)
    return mt.greedy_match(gold.withColumnRenamed("p_name", "label"), got.withColumnRenamed("p_name", "label"), "page")


# --- notes ---------------------------------------------------------------------------------------------

_TOC = "toc AS (SELECT n_regionkey AS doc_id, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS line_no, 'NOT ' || row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) || ' ' || n_name || ' .... ' || (n_nationkey % 7 + 10) AS text FROM nation)"


def _toc(spark, sf):
    n = table(spark, sf, "nation").withColumn("line_no", F.row_number().over(Window.partitionBy("n_regionkey").orderBy("n_nationkey")))
    return n.select(F.col("n_regionkey").alias("doc_id"), "line_no", F.concat(F.lit("NOT "), F.col("line_no").cast("string"), F.lit(" "), F.col("n_name"), F.lit(" .... "), (F.col("n_nationkey") % 7 + 10).cast("string")).alias("text"))


@query(rf"WITH {_TOC} SELECT doc_id, line_no, regexp_extract(text, '^NOT\s*([0-9lIİiOoSB.,]{{1,4}})\s+', 1) AS number, regexp_extract(text, '[ .]([0-9lIO]{{1,3}})\s*$', 1) AS page FROM toc")
def f9_toc_fields(spark, sf):
    return lc.toc_fields(_toc(spark, sf)).select("doc_id", "line_no", "number", "page")


@query(f"WITH {_TOC}, p AS (SELECT doc_id, line_no AS note_no, regexp_extract(text, '([0-9]+)$', 1)::INT AS page FROM toc) SELECT doc_id, note_no::INT AS note_no, CASE WHEN page >= coalesce(max(page) OVER (PARTITION BY doc_id ORDER BY note_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), page) THEN page END AS page FROM p")
def x6_parse_toc(spark, sf):
    return lc.contents(_toc(spark, sf)).select("doc_id", F.col("number").alias("note_no"), "page")


_MARKED = "m AS (SELECT o_custkey AS doc_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey)::INT AS page, (o_orderkey % 5 + 9)::INT AS note FROM orders)"


def _marks(spark, sf):
    page = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))
    return table(spark, sf, "orders").select(F.col("o_custkey").alias("doc_id"), page.alias("page"), (F.col("o_orderkey") % 5 + 9).cast("int").alias("note"))


@query(f"WITH {_MARKED}, hit AS (SELECT doc_id, coalesce(min(page) FILTER (WHERE note = 11 AND page BETWEEN 3 AND 6), min(page) FILTER (WHERE note = 11 AND page >= 7), NULL) AS target FROM m GROUP BY 1), runs AS (SELECT doc_id, page, page - row_number() OVER (PARTITION BY doc_id ORDER BY page) AS run FROM m WHERE note = 11), r AS (SELECT h.doc_id, runs.run FROM hit h JOIN runs ON runs.doc_id = h.doc_id AND runs.page = h.target) SELECT r.doc_id, min(page) AS first_page, max(page) AS last_page, count(*) AS pages FROM r JOIN runs USING (doc_id, run) GROUP BY 1")
def x7_locate_note(spark, sf):
    """Bounded window first, then a scan behind it, then the contiguous run around the hit (also w7)."""
    return lc.locate(_marks(spark, sf), note=11, low=3, high=6, scan_from=7)


@query("WITH l AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS page, o_orderpriority FROM orders) SELECT o_custkey, min(page) AS toc_page FROM l WHERE page <= 8 AND contains(lower(o_orderpriority), 'urgent') GROUP BY 1")
def x5_find_toc(spark, sf):
    p = table(spark, sf, "orders").withColumn("page", F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")))
    return lc.first_page_with(p.withColumnRenamed("o_orderpriority", "text"), "o_custkey", "urgent", upto=8).withColumnRenamed("page", "toc_page")


_LINES = "t AS (SELECT o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS line, count(*) OVER (PARTITION BY o_custkey) AS n, CASE o_orderkey % 4 WHEN 0 THEN (o_orderkey % 200)::VARCHAR WHEN 1 THEN (o_orderkey % 30) || '. Baslik' WHEN 2 THEN 'metin' ELSE 'l' || (o_orderkey % 9) || '.' END AS text FROM orders)"


def _lines(spark, sf):
    k = F.col("o_orderkey")
    text = F.when(k % 4 == 0, (k % 200).cast("string")).when(k % 4 == 1, F.concat((k % 30).cast("string"), F.lit(". Baslik"))).when(k % 4 == 2, "metin").otherwise(F.concat(F.lit("l"), (k % 9).cast("string"), F.lit(".")))
    w = Window.partitionBy("o_custkey")
    return table(spark, sf, "orders").select("o_custkey", F.row_number().over(w.orderBy("o_orderkey")).alias("line"), F.count("*").over(w).alias("n"), text.alias("text"))


@query(f"WITH {_LINES} SELECT o_custkey, max_by(text, line)::INT AS folio FROM t WHERE line > n - 4 AND regexp_matches(text, '^[0-9]{{1,3}}$') GROUP BY 1")
def f10_folio(spark, sf):
    return lc.folios(_lines(spark, sf), "o_custkey")


@query(rf"WITH {_LINES}, h AS (SELECT o_custkey, line, CASE WHEN regexp_matches(text, '^\s*[0-9lIİiOo]{{1,3}}\s*[.\-]?\s*$') THEN regexp_extract(text, '^\s*([0-9lIİiOo]{{1,3}})', 1) WHEN regexp_matches(text, '^\s*[0-9lIİiOo]{{1,3}}\s*[.\-]\s+\S') THEN regexp_extract(text, '^\s*([0-9lIİiOo]{{1,3}})', 1) END AS d FROM t WHERE line <= 6), f AS (SELECT o_custkey, min_by(translate(d, 'lIİiOo', '111100'), line) AS d FROM h WHERE d IS NOT NULL GROUP BY 1) SELECT o_custkey, CASE WHEN d::INT BETWEEN 1 AND 99 THEN d::INT END AS note FROM f")
def f11_heading_note(spark, sf):
    return lc.heading_notes(_lines(spark, sf), "o_custkey")


# --- sources and sinks ---------------------------------------------------------------------------------


@query("SELECT n_nationkey, CASE n_nationkey % 3 WHEN 0 THEN 0.5 WHEN 1 THEN 0.8 ELSE 0.2 END::DOUBLE AS accept_threshold, CASE WHEN n_nationkey % 2 = 0 THEN 8 ELSE 2 END AS top_k FROM nation")
def s7_settings(spark, sf):
    """Also f29 and y5: scenario overlays on the defaults, one row for each combination."""
    rows = []
    for i, (link, cand) in enumerate([(a, b) for a in ("baseline", "strict-linker", "lenient-linker") for b in ("baseline", "narrow-candidates")]):
        s = config.settings(config.overlay(config.SCENARIOS[link], config.SCENARIOS[cand]), env={})
        rows.append((i // 2, i % 2, float(s["linking"]["accept_threshold"]), int(s["candidates"]["top_k"])))
    combos = spark.createDataFrame(rows, "a int, b int, accept_threshold double, top_k int")
    n = table(spark, sf, "nation")
    return n.join(F.broadcast(combos), (F.col("n_nationkey") % 3 == F.col("a")) & (F.col("n_nationkey") % 2 == F.col("b"))).select("n_nationkey", "accept_threshold", "top_k")


@query("SELECT o_orderkey, '{\"relation_id\":\"rel' || o_orderkey || '\",\"summary_row_id\":\"' || o_custkey || '\",\"footnote_row_id\":\"x' || o_custkey || '\",\"summary_label\":\"' || coalesce(c_name, '') || '\",\"footnote_label\":\"\"}' AS line FROM orders LEFT JOIN customer ON c_custkey = o_custkey AND c_custkey % 3 > 0")
def s9_relation_lines(spark, sf):
    rel = table(spark, sf, "orders").select(F.concat(F.lit("rel"), F.col("o_orderkey").cast("string")).alias("relation_id"), F.col("o_custkey").cast("string").alias("summary_row_id"), F.concat(F.lit("x"), F.col("o_custkey").cast("string")).alias("footnote_row_id"))
    rows = table(spark, sf, "customer").where("c_custkey % 3 > 0").select(F.col("c_custkey").cast("string").alias("row_id"), F.col("c_name").alias("label_raw"))
    lines = stores.relation_lines(rel, rows)
    return lines.select(F.regexp_extract("value", 'rel([0-9]+)"', 1).cast("bigint").alias("o_orderkey"), F.col("value").alias("line"))


@query("SELECT c_custkey, count(*) FILTER (WHERE o_orderstatus = 'F')::BIGINT AS f, count(*) FILTER (WHERE o_orderstatus = 'O')::BIGINT AS o FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1")
def s10_report_grid(spark, sf):
    """The report's pivot: a row's cells by period."""
    rows = table(spark, sf, "customer").select(F.lit(1).alias("table_id"), F.col("c_custkey").alias("row_id"), F.col("c_name").alias("label"))
    cells = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("row_id"), F.col("o_orderstatus").alias("period")).agg(F.count("*").alias("raw"))
    grid = stores.table_grid(rows, cells, ["F", "O"])
    return grid.select(F.col("row_id").alias("c_custkey"), F.coalesce("F", F.lit(0)).alias("f"), F.coalesce("O", F.lit(0)).alias("o"))


@query("SELECT c_custkey, sha256('m1' || chr(10) || c_name) AS key FROM customer")
def s11_cache_key(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", F.sha2(F.concat(F.lit("m1\n"), F.col("c_name")).cast("binary"), 256).alias("key"))


@query("WITH r AS (SELECT user_id, event_type, CASE WHEN value > 40 THEN NULL ELSE CASE WHEN value > 20 THEN 'accept' ELSE 'reject' END END AS label, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id DESC) AS rn FROM events) SELECT user_id, event_type, label FROM r WHERE rn = 1 AND label IS NOT NULL")
def s14_label_store(spark, sf):
    label = F.when(F.col("value") > 40, None).otherwise(F.when(F.col("value") > 20, "accept").otherwise("reject"))
    e = table(spark, sf, "events").select(F.lit("r").alias("run_id"), F.col("event_type").alias("kind"), F.col("user_id").alias("key"), label.alias("label"), F.col("event_id").alias("ts"))
    return stores.current_labels(e).select(F.col("key").alias("user_id"), F.col("kind").alias("event_type"), "label")


@query("SELECT user_id, string_agg(event_id, ';' ORDER BY event_id) AS object_ids FROM events GROUP BY 1")
def s16_annotation_export(spark, sf):
    """Also s15: annotations with their object ids joined for CSV."""
    notes = table(spark, sf, "events").groupBy("user_id").agg(F.transform(F.sort_array(F.collect_list("event_id")), lambda x: x.cast("string")).alias("object_ids"))
    return stores.flat_annotations(notes).select("user_id", "object_ids")


@query(f"WITH {A}, lab AS (SELECT doc_id, CASE WHEN toxic = 1 THEN 'reject' ELSE 'accept' END AS label FROM labels) SELECT {K}, label, confidence FROM rel_a JOIN lab ON doc_id = l_orderkey")
def s17_label_export(spark, sf):
    labels = table(spark, sf, "labels").select(F.col("doc_id").alias("l_orderkey"), F.when(F.col("toxic") == 1, "reject").otherwise("accept").alias("label"))
    return rels(spark, sf, "a").join(labels, "l_orderkey").select(*KEY, "label", "confidence")


@query("SELECT page_id, substr(sha256(html), 1, 12) AS doc_id FROM pages")
def s18_upload_ids(spark, sf):
    return table(spark, sf, "pages").select("page_id", F.substring(F.sha2(F.col("html").cast("binary"), 256), 1, 12).alias("doc_id"))


_SCOPED = "b AS (SELECT n_nationkey AS id, list_extract(['this document', 'other documents', 'offline refit', 'colab'], n_regionkey % 4 + 1) AS scope, n_regionkey % 4 AS o FROM nation)"


@query(f"WITH {_SCOPED} SELECT id, scope, row_number() OVER (ORDER BY o, id) AS place FROM b")
def s20_benchmark_listing(spark, sf):
    """Also s29."""
    scope = F.get(F.array(*map(F.lit, bm.SCOPES)), (F.col("n_regionkey") % 4).cast("int"))
    return bm.listing(table(spark, sf, "nation").select(F.col("n_nationkey").alias("id"), scope.alias("scope")))


@query("SELECT n_nationkey::VARCHAR AS id, CASE WHEN n_nationkey % 5 = 0 THEN 'rejected' WHEN n_nationkey = 1 THEN 'shipped' ELSE 'measured' END AS role, CASE WHEN n_nationkey % 5 <> 0 THEN n_nationkey / 2.0 END::DOUBLE AS a FROM nation")
def s21_variant_rows(spark, sf):
    """The JSON converters: variants with their fields; a null fit is rejected."""
    k = F.col("n_nationkey")
    body = F.when(k % 5 == 0, '{"fit": null}').otherwise(F.concat(F.lit('{"fit": "ok", "a": '), (k / 2).cast("string"), F.lit("}")))
    got = bm.variant_rows(table(spark, sf, "nation").select(F.when(k == 1, "shipped").otherwise(k.cast("string")).alias("name"), body.alias("body")), {"a": "a"})
    return got.select(F.when(F.col("id") == "shipped", "1").otherwise(F.col("id")).alias("id"), "role", "a")


@query("SELECT c_mktsegment AS method, sum(n) FILTER (WHERE page = 5) AS p05, sum(n) FILTER (WHERE page = 6) AS p06, sum(n) AS total, sum(g) AS gold FROM (SELECT c_mktsegment, c_nationkey AS page, count(*) AS n, count(*) FILTER (WHERE c_acctbal > 0) AS g FROM customer GROUP BY ALL) GROUP BY 1")
def s21_page_pivot(spark, sf):
    d = table(spark, sf, "customer").groupBy(F.col("c_mktsegment").alias("method"), F.col("c_nationkey").alias("page")).agg(F.count("*").alias("tables"), F.count_if(F.col("c_acctbal") > 0).alias("gold"))
    return bm.pivot_counts(d, [5, 6])


@query("SELECT n_nationkey, CASE WHEN n_nationkey % 4 > 0 THEN n_nationkey END AS tables, CASE WHEN n_nationkey % 4 > 0 THEN 7 END AS passed, n_nationkey % 2 AS exit, CASE WHEN n_nationkey % 4 = 0 THEN 'parse_error: no summary line' END AS note FROM nation")
def s23_log_facts(spark, sf):
    k = F.col("n_nationkey").cast("string")
    summary = F.concat(F.lit("tables="), k, F.lit(" rows=2 cells=3 relations=4 (low_conf=1) checks: 7 pass / 0 fail / 1 not_evaluable"))
    text = F.array(F.when(F.col("n_nationkey") % 4 > 0, summary).otherwise("nothing"), F.concat(F.lit("# doc run exit="), (F.col("n_nationkey") % 2).cast("string"), F.lit(" wall=12s")))
    lines = table(spark, sf, "nation").select(F.col("n_nationkey").alias("file"), F.explode(text).alias("text"))
    return bm.log_facts(lines).select(F.col("file").alias("n_nationkey"), "tables", "passed", "exit", "note")


@query("SELECT n_nationkey AS file, 2 AS rows, 'a/' || n_name AS cells FROM nation")
def s22_markdown_table(spark, sf):
    text = F.array(F.lit("intro"), F.lit("| x |"), F.lit("## Results"), F.lit(""), F.lit("| k | v |"), F.concat(F.lit("| a | "), F.col("n_name"), F.lit(" |")), F.lit("after"), F.lit("| z |"))
    lines = table(spark, sf, "nation").select(F.col("n_nationkey").alias("file"), F.posexplode(text).alias("line_no", "text"))
    got = bm.markdown_table(lines, "## Results")
    return got.groupBy("file").agg(F.count("*").cast("int").alias("rows"), F.array_join(F.max_by("cells", "line_no"), "/").alias("cells"))


@query("SELECT n_nationkey AS file, 'part ' || (n_nationkey % 3) AS grp, 'm' AS label, n_nationkey % 2 = 0 AS agree FROM nation")
def s21_sectioned_log(spark, sf):
    """The sectioned-log converter: each metric line takes the section above it."""
    k = F.col("n_nationkey")
    metric = F.concat(F.lit("["), F.when(k % 2 == 0, "AGREE").otherwise("DISAGREE"), F.lit("] m : claimed 1 ; recomputed 2"))
    text = F.array(F.concat(F.lit("== part "), (k % 3).cast("string"), F.lit(" ==")), F.lit("noise"), metric)
    lines = table(spark, sf, "nation").select(k.alias("file"), F.posexplode(text).alias("line_no", "text"))
    return bm.sectioned(lines).select("file", "grp", "label", "agree")


@query("SELECT n_regionkey AS file, min(n_nationkey) AS line_no FROM nation WHERE n_nationkey % 3 = 0 GROUP BY 1")
def s24_drift(spark, sf):
    n = table(spark, sf, "nation").select(F.col("n_regionkey").alias("file"), F.col("n_nationkey").alias("line_no"), F.col("n_name").alias("text"))
    changed = n.withColumn("text", F.when(F.col("line_no") % 3 == 0, F.lower("text")).otherwise(F.col("text")))
    return stores.drift(n, changed).select("file", "line_no")


@query("SELECT doc_id, sha256(text) AS sha FROM documents")
def s25_fingerprints(spark, sf):
    """Also y10: content hashes, as a run's proof holds them."""
    return table(spark, sf, "documents").select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("sha"))


@query("SELECT c_custkey AS table_id, 'r' || c_custkey AS row_id, 'y2012' AS period, 'number' AS state FROM customer")
def s28_gold_cells(spark, sf):
    value = F.struct(F.lit("number").alias("state"), F.lit("1").alias("value"), F.lit("1").alias("value_raw"))
    row = F.struct(F.concat(F.lit("r"), F.col("c_custkey").cast("string")).alias("row_id"), F.col("c_name").alias("label_raw"), F.create_map(F.lit("y2012"), value).alias("values"))
    t = F.struct(F.col("c_custkey").alias("id"), F.lit(1).alias("pdf_page"), F.array(row).alias("rows"))
    doc = table(spark, sf, "customer").select(F.array(t).alias("tables"))
    return stores.gold_cells(doc).select("table_id", "row_id", "period", "state")


@query("SELECT date_trunc('hour', ts)::VARCHAR AS start, count(*) AS events, count(*) FILTER (WHERE event_type = 'error') AS bad, round(sum(value), 4) AS value FROM events GROUP BY 1")
def stream_hourly_rates(spark, sf):
    """The streaming monitor's plan over the whole table; tests run it as a stream."""
    got = monitor.rates(table(spark, sf, "events"), every="1 hour")
    return got.select(F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "events", "bad", F.round("value", 4).alias("value"))


# --- assembly ------------------------------------------------------------------------------------------

_ROWS = "rows_ AS (SELECT o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS row_no, CASE o_orderkey % 6 WHEN 0 THEN '' WHEN 1 THEN 'Toplam varlıklar' WHEN 2 THEN 'Alımlar' WHEN 3 THEN 'Kasa (*)' WHEN 4 THEN CASE WHEN o_custkey % 4 = 0 THEN 'açılış bakiyesi' ELSE 'Banka' END ELSE 'BORÇLAR' END AS label, o_orderkey % 11 = 5 AS section, (o_orderkey % 3)::INT AS level, (o_orderkey % 4)::INT AS n_cells, o_custkey % 7 = 0 AS duration FROM orders)"


def _assembly_rows(spark, sf):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    label = F.when(k % 6 == 0, "").when(k % 6 == 1, "Toplam varlıklar").when(k % 6 == 2, "Alımlar").when(k % 6 == 3, "Kasa (*)").when(k % 6 == 4, F.when(c % 4 == 0, "açılış bakiyesi").otherwise("Banka")).otherwise("BORÇLAR")
    no = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")) - 1
    return table(spark, sf, "orders").select("o_custkey", no.alias("row_no"), label.alias("label"), (k % 11 == 5).alias("section"), (k % 3).cast("int").alias("level"), (k % 4).cast("int").alias("n_cells"), (c % 7 == 0).alias("duration"))


_OWN = "CASE WHEN label = 'açılış bakiyesi' THEN 'opening' WHEN label LIKE 'Toplam%' THEN 'total' ELSE 'flow' END"


@query(f"WITH {_ROWS}, o AS (SELECT *, {_OWN} AS own, lead(row_no) OVER (PARTITION BY o_custkey ORDER BY row_no) IS NULL AS last, duration OR bool_or({_OWN} = 'opening') OVER (PARTITION BY o_custkey) AS moves FROM rows_), n AS (SELECT *, CASE WHEN label = '' AND last AND n_cells > 0 THEN 'total' WHEN section THEN 'group_header' ELSE own END AS named FROM o) SELECT o_custkey, row_no, CASE WHEN named = 'flow' AND NOT moves THEN CASE WHEN level > 0 THEN 'subitem' ELSE 'item' END ELSE named END AS role FROM n")
def x4_role_overrides(spark, sf):
    return asm.assign_roles(_assembly_rows(spark, sf), keys=["o_custkey"]).select("o_custkey", "row_no", "role")


@query(f"WITH {_ROWS} SELECT a.o_custkey, 'p01.t' || lpad((a.o_custkey % 90)::VARCHAR, 2, '0') || '.r' || lpad(a.row_no::VARCHAR, 3, '0') AS row_id, 'p01.t' || lpad((a.o_custkey % 90)::VARCHAR, 2, '0') || '.r' || lpad((SELECT max(b.row_no) FROM rows_ b WHERE b.o_custkey = a.o_custkey AND b.row_no < a.row_no AND b.level < a.level)::VARCHAR, 3, '0') AS parent_row_id FROM rows_ a")
def x3_row_ids(spark, sf):
    rows = _assembly_rows(spark, sf).withColumns({"page": F.lit(1), "table_no": F.col("o_custkey") % 90})
    return asm.assign_ids(rows, ["o_custkey"]).select("o_custkey", "row_id", "parent_row_id")


@query("WITH h AS (SELECT c_custkey, unnest([0, 1, 2]) AS col, unnest(CASE WHEN c_custkey % 3 = 0 THEN ['2012', '2011', '2010'] ELSE ['Arazi ve Arsalar', 'Binalar', CASE WHEN c_custkey % 2 = 0 THEN 'BINALAR' END] END) AS label FROM customer), s AS (SELECT c_custkey, col, CASE WHEN c_custkey % 3 = 0 THEN 'y' || label ELSE trim(regexp_replace(replace(lower(translate(coalesce(label, 'col' || col), 'İI', 'iı')), chr(775), ''), '[^a-z0-9çğıöşü]+', '_', 'g'), '_') END AS p FROM h) SELECT c_custkey, col, p || CASE WHEN row_number() OVER (PARTITION BY c_custkey, p ORDER BY col) > 1 THEN '_' || col ELSE '' END AS period_id FROM s")
def x3_period_ids(spark, sf):
    c = F.col("c_custkey")
    labels = F.when(c % 3 == 0, F.array(F.lit("2012"), F.lit("2011"), F.lit("2010"))).otherwise(F.array(F.lit("Arazi ve Arsalar"), F.lit("Binalar"), F.when(c % 2 == 0, "BINALAR")))
    heads = table(spark, sf, "customer").select("c_custkey", F.posexplode(labels).alias("col", "label"))
    return asm.period_ids(heads, ["c_custkey"]).select("c_custkey", "col", "period_id")
