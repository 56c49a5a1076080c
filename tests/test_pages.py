import random

import pytest
from pyspark.sql import functions as F

from tallyweave.operators import locate as lc
from tallyweave.operators import matching as mt
from tallyweave.operators import ordered as o
from tallyweave.operators import pages as pg


WORDS = "doc_id bigint, page int, line bigint, text string, x0 double, y0 double, x1 double, y1 double, conf double"


def word(text, x0, y0, x1=None, conf=90.0):
    return (text, float(x0), float(y0), float(x0 + 20 * len(text) if x1 is None else x1), float(y0 + 30), float(conf))


def line(text, x0, y0):
    out, x = [], x0
    for t in text.split():
        out.append(word(t, x, y0))
        x += 20 * len(t) + 10
    return out


def amounts(label, values, y0, x0=100, refs=()):
    ws = line(label, x0, y0) if label else []
    ws += [word(str(r), 1000, y0) for r in refs]
    return ws + [word(v, right - 20 * len(v), y0) for right, v in zip((1800, 2300), values, strict=False) if v is not None]


def words_of(spark, *pages):
    """Each page is a list of lines; pages become documents 0, 1, ..."""
    return spark.createDataFrame([(d, 0, n, *w) for d, lines in enumerate(pages) for n, ws in enumerate(lines) for w in ws], WORDS)


def statement():
    return [
        line("11. YATIRIM AMAÇLI GAYRİMENKULLER", 100, 100),
        line("1 Ocak 31 Aralık", 1500, 200),
        amounts("", ["2012", "2011"], 260),
        amounts("Alımlar", ["1.234", "2.000"], 320, refs=[7]),
        line("Uzun bir kalem", 100, 380),
        amounts("adı", ["3.000", "-"], 440, x0=118),
        amounts("Toplam", ["4.234", "2.000"], 500),
        line("düz metin burada biter", 100, 900),
    ]


def test_tables(spark):
    section = [line("VARLIKLAR", 100, 200), amounts("Kasa", ["1.000", "2.000"], 260), amounts("Banka", ["3.000", "4.000"], 320)]
    ghosts = [[*amounts("Kasa", [None, "5.000"], 0), word("1000", 1720, 0, 1800, 95), word("1.000", 1700, 0, 1800, 80)], [*amounts("Banka", [None, "6.000"], 60), word("1.000", 1700, 60, 1800, 80), word("9.000", 1701, 60, 1801, 95)]]
    lead = [line("devam eden uzun etiket", 100, 200), amounts("satırı", ["1.000", "2.000"], 260), amounts("Banka", ["3.000", "4.000"], 320)]
    loose = [amounts("Kasa", ["1.000"], 200), amounts("Banka", ["2.000"], 260)]
    holes = [amounts("A", ["1.000", "2.000"], 0), amounts("B", ["1.000", "2.000"], 60), *[line("x", 100, 120 + 60 * i) for i in range(3)], amounts("C", ["3.000", "4.000"], 300), amounts("D", ["3.000", "4.000"], 360)]
    names = [[word("Arazi", 1700, 100), word("Bina", 2230, 100)], amounts("Kasa", ["1.000", "2.000"], 260), amounts("Banka", ["3.000", "-"], 320)]
    dashes = [amounts("Kasa", ["1.000", "2.000"], 260), [*line("Banka", 100, 320), word("-", 1740, 320), word("-", 1760, 320), word("-", 2000, 320)], amounts("Diğer", ["5.000", "6.000"], 380)]
    got = {(r.doc_id, r.table_no): r for r in pg.page_tables(words_of(spark, statement(), section, ghosts, lead, loose, holes, names, dashes), 2480.0).collect()}
    t = got[0, 0]
    assert t.periods == ["2012", "2011"] and t.duration and t.columns == [1800, 2300]
    assert [r.label for r in t.rows] == ["Alımlar", "Uzun bir kalem adı", "Toplam"]
    assert t.rows[0].refs == [7] and t.rows[1].cells[1].state == "dash" and t.rows[1].x0 == 100
    assert got[1, 0].rows[0].section and got[1, 0].rows[0].label == "VARLIKLAR"
    first = {r.label: r.cells[0].raw for r in got[2, 0].rows}
    assert first == {"Kasa": "1.000", "Banka": "9.000"}  # equal digits: the well-formed read; else the surer one
    assert [r.label for r in got[3, 0].rows] == ["devam eden uzun etiket satırı", "Banka"]
    assert (4, 0) not in got  # two rows of one cell do not make a table
    assert [[r.label for r in got[5, n].rows] for n in (0, 1)] == [["A", "B"], ["C", "D"]]
    assert got[6, 0].periods == ["Arazi", "Bina"]
    assert [c.state for c in got[7, 0].rows[0].cells] == ["number", "number"] and len(got) == 8
    assert pg.page_tables(words_of(spark, statement()).limit(0), 2480.0).count() == 0


def settle(spark, rows, indent=10.0):
    made = [(label, x0, float(i), float(i), section, [], [None] * cells) for i, (label, x0, cells, section) in enumerate(rows)]
    df = spark.createDataFrame([(made,)], f"rows array<{pg.ROW}>")
    return [(r.label, r.section) for r in df.select(pg.wrapped(F.col("rows"), indent).alias("r")).first().r]


def test_wrapped_labels(spark):
    assert settle(spark, [("Uzun", 327.0, 0, False), ("devam", 345.0, 1, False)]) == [("Uzun devam", False)]
    assert settle(spark, [("Grup", 302.0, 0, False), ("kalem", 301.0, 1, False)]) == [("Grup", True), ("kalem", False)]
    assert settle(spark, [("son", 1.0, 0, False)]) == []
    assert settle(spark, [("KAP", 0.0, 0, True), ("a", 5.0, 0, False), ("b", 5.0, 0, False), ("c", 30.0, 1, False), ("d", 0.0, 0, False)]) == [("KAP", True), ("a", True), ("b c", False)]


def test_titles(spark):
    company = line("ACME HOLDİNG A.Ş.", 100, 40)
    block = [line("BAĞIMSIZ DENETİMDEN GEÇMİŞ", 100, 100), line("KONSOLİDE BİLANÇO", 100, 140)]
    pages = [[company, *block], [line("11.", 100, 100), line("YATIRIM AMAÇLI", 200, 104)], [line("düz bir cümle burada yazılı", 100, 100)], block, [*block, line("BAŞKA BİR BAŞLIK", 100, 400)]]
    tops = spark.createDataFrame([(d, 0, 50.0 if d == 3 else 600.0) for d in range(6)], "doc_id bigint, page int, y0 double")
    got = {r.doc_id: r.title for r in pg.titles(pg.page_lines(words_of(spark, *pages), 2480.0), tops, "ACME HOLDİNG A.Ş.").collect()}
    whole = "BAĞIMSIZ DENETİMDEN GEÇMİŞ KONSOLİDE BİLANÇO"
    assert got == {0: whole, 1: "11. YATIRIM AMAÇLI", 2: "", 3: "", 4: whole, 5: ""}


def test_rates(spark):
    rows = [(1, "number", "percent", "%90", 0.9, "12", 0.9, "12"), (2, "number", "percent", "%80", 0.9, "%81", 0.99, "7"), (3, None, None, None, None, "%86,6", 0.9, "0866"), (4, "number", "int", "7", 0.9, "%5", 0.9, "5"), (5, None, None, None, None, None, None, None), (6, None, None, None, None, "%4", 0.2, "4")]
    df = spark.createDataFrame(rows, "k int, state string, kind string, raw string, ocr double, read string, score double, other string")
    got = {r.k: (r.vote, r.raw, r.ocr) for r in pg.rescued_rates(df, ["k"]).collect()}
    assert got == {1: ("exact", "12", 0.9), 2: ("mismatch", "%81", 0.4), 3: ("suffix", "%86,6", pytest.approx(0.873)), 4: (None, "7", 0.9), 5: (None, None, None), 6: ("exact", "%4", 0.5)}
    windows = spark.range(1).select(pg.value_windows(F.array(F.lit(1800.0), F.lit(2000.0)), 1000.0).alias("w")).first().w
    assert [tuple(w) for w in windows] == [(1695.0, 1816.0), (1900.0, 2016.0)]


def test_contents_and_marks(spark):
    toc = ["İçindekiler", "NOT 1 GENEL BİLGİ .... 10", "NOTI YANLIŞ ... 12", "NOT 3 STOKLAR .... 9", "NOT 4 KASA .... 20"]
    odd = ["NOT 7 A.B. .... 3", "NOT xx yok", "NOT 9 KASA"]
    lines = spark.createDataFrame([(d, i, t) for d, ts in ((1, toc), (2, odd)) for i, t in enumerate(ts)], "doc_id int, line_no int, text string")
    got = lc.contents(lines).orderBy("doc_id", "place").collect()
    assert [(e.number, e.page) for e in got if e.doc_id == 1] == [(1, 10), (2, 12), (3, None), (4, 20)]
    assert [e.number for e in got if e.doc_id == 2] == [7, 9] and got[0].title == "GENEL BİLGİ"
    heads = spark.createDataFrame([(1, 1, 2, "l1."), (1, 2, 2, "12. Baslik"), (2, 1, 2, "metin burada"), (2, 2, 2, "54"), (3, 1, 1, "12345")], "k int, line int, n int, text string")
    assert {r.k: r.note for r in lc.heading_notes(heads.where("k < 2"), "k").collect()} == {1: 11}
    assert {r.k: r.folio for r in lc.folios(heads, "k").collect()} == {2: 54}


def test_pages_as_a_dataframe(spark):
    df = words_of(spark, statement())
    rows = pg.page_rows(df, 2480.0).orderBy("row_no").collect()
    assert [r.row_id for r in rows] == ["p00.t00.r000", "p00.t00.r001", "p00.t00.r002"] and rows[0].title == "11. YATIRIM AMAÇLI GAYRİMENKULLER"
    cells = pg.page_cells(df, 2480.0).where("state = 'number'").collect()
    assert {(c.row_no, c.period, float(c.value)) for c in cells} == {(0, "2012", 1234), (0, "2011", 2000), (1, "2012", 3000), (2, "2012", 4234), (2, "2011", 2000)}
    assert pg.page_rows(df.limit(0), 2480.0).count() == 0
    plan = pg.page_cells(df, 2480.0)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and plan.count("Exchange hashpartitioning") == 1


def loop_islands(kinds, hole=2):
    """Island of each data line, walking the page."""
    out, no, since = {}, -1, None
    for i, kind in enumerate(kinds):
        if kind == "prose":
            since = None
        elif kind == "data":
            no += since is None or since > hole
            out[i], since = no, 0
        elif since is not None:
            since += 1
    return out


def test_islands_against_the_loop(spark):
    rng, rows, want = random.Random(5), [], {}
    for page in range(200):
        kinds = [rng.choice(["data", "data", "other", "prose"]) for _ in range(rng.randint(1, 20))]
        rows += [(page, i, k) for i, k in enumerate(kinds)]
        want.update({(page, i): no for i, no in loop_islands(kinds).items()})
    got = o.broken_islands(spark.createDataFrame(rows, "page int, line int, kind string"), ["page"], "line", "kind").collect()
    assert {(r.page, r.line): r.island for r in got} == want


def test_clusters_against_the_loop(spark):
    rng = random.Random(6)
    rows = [(k, float(rng.randint(0, 300))) for k in range(50) for _ in range(rng.randint(1, 12))]
    got = o.gap_clusters(spark.createDataFrame(rows, "k int, x double"), ["k"], "x", 12.0).orderBy("k", "cluster").toPandas()
    for k, part in got.groupby("k"):
        xs = sorted(x for j, x in rows if j == k)
        cuts = [0, *(i for i in range(1, len(xs)) if xs[i] - xs[i - 1] > 12), len(xs)]
        want = [sum(xs[a:b]) / (b - a) for a, b in zip(cuts, cuts[1:], strict=False)]
        assert part["center"].tolist() == pytest.approx(want)
        assert spark.range(1).select(pg.run_centers(F.array(*map(F.lit, xs)), 12.0).alias("c")).first().c == pytest.approx(want) if k < 3 else True


def test_locate(spark):
    marks = spark.createDataFrame([(1, p, 11 if p in (8, 9, 12) else 5) for p in range(1, 15)] + [(2, 1, 4)], "doc_id int, page int, note int")
    assert [tuple(r) for r in lc.locate(marks, 11, 3, 6, 7).collect()] == [(1, 8, 9, 2)]
    assert [tuple(r) for r in lc.locate(marks, 11, 11, 13, 14).collect()] == [(1, 12, 12, 1)]


def test_greedy_match():
    gold, got = [(1, "kasa"), (2, "kasa banka"), (3, "diger")], [(10, "kasa banka"), (11, "kasa"), (12, "xyz")]
    assert mt.match_page(gold, got) == [(1, 11, 100.0), (2, 10, 100.0)]
    assert mt.match_page([(1, "kasalar")], [(10, "kasa"), (11, "kasa")]) == [(1, 10, pytest.approx(72.727, abs=0.01))]
    assert mt.match_page([], [(1, "a")]) == []
