import pytest

from pyspark.sql import functions as F

from tallyweave.operators import filing as fl
from tallyweave.sources import stores

WIDTH = 2480.0
WORDS = "doc_id bigint, page int, line bigint, text string, x0 double, y0 double, x1 double, y1 double, conf double"


def page(doc, no, lines):
    """Lines of (label, amounts): labels on the left, amounts ending at two columns."""
    out = []
    for k, (label, *amounts) in enumerate(lines):
        y = 200.0 + 60 * k
        words = [(t, 100.0 + 200 * i) for i, t in enumerate(label.split())]
        words += [(a, 1800.0 + 500 * i - 20 * len(a)) for i, a in enumerate(amounts)]
        out += [(doc, no, k, t, x, y, x + 20 * len(t), y + 30, 90.0) for t, x in words]
    return out


MAIN = [("Nakit ve benzerleri", "1.250", "1.100"), ("Ticari alacaklar", "7.400", "6.900"), ("Stoklar", "3.333", "2.222")]
NOTE = [("Kasa ve banka", "1.400", "1.300"), ("Toplam ticari alacaklar", "7.400", "6.900"), ("Kapanış bakiyesi", "3.333", "2.222")]


@pytest.fixture(scope="module")
def done(spark):
    words = spark.createDataFrame(page(1, 0, MAIN) + page(1, 1, NOTE) + page(2, 0, MAIN), WORDS)
    return fl.run(words, WIDTH, F.col("page") == 0)


def test_amounts_link_rows_of_one_document(done):
    got = {(r.summary_row_id, r.footnote_row_id): r for r in done.relations.collect()}
    assert set(got) >= {("1/p00.t00.r002", "1/p01.t00.r002")}
    assert all(r.doc_id == 1 and r.recon == "pass" for r in got.values() if r.agreement == "b_only")
    closing = got["1/p00.t00.r002", "1/p01.t00.r002"]
    assert closing.relation_type == "balance_reconciliation" and closing.agreement == "b_only"
    # no model and no fit: the fixed map, and every relation is flagged
    assert done.map == (6.0, -3.0) and closing.low_confidence
    p = closing.components.validation_factor
    assert p > 1 and closing.components.reconciliation == 1.0


def test_checks_and_store(done, spark, tmp_path):
    status = {r.scope: r.status for r in done.checks.where("check_id = 'FIN_RECONCILE'").collect()}
    assert set(status.values()) <= {"pass", "fail", "not_evaluable"} and len(status) == done.relations.count()
    done.store(str(tmp_path), "r1", {"state": "done"})
    assert stores.read_run(spark, str(tmp_path), "relations", "r1").count() == done.relations.count()


def test_same_run_twice(done, spark):
    words = spark.createDataFrame((page(1, 0, MAIN) + page(1, 1, NOTE) + page(2, 0, MAIN))[::-1], WORDS)
    again = fl.run(words, WIDTH, F.col("page") == 0)
    assert sorted(map(str, again.relations.collect())) == sorted(map(str, done.relations.collect()))


def test_rows_and_cells_are_computed_once(done):
    for part in (done.rows, done.cells):
        plan = part._jdf.queryExecution().optimizedPlan().toString()
        assert not any(step in plan for step in ("Window", "Join", "Aggregate"))


def test_lines_are_made_once(spark):
    # tables and their titles read one set of lines, dealt out once
    from tallyweave.operators import pages as pg

    words = spark.createDataFrame(page(1, 0, [("11. NAKİT VARLIKLAR",), *MAIN]) + page(1, 1, NOTE), WORDS)
    tables = pg.titled_tables(words, WIDTH)
    assert tables._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    apart = pg.titles(pg.page_lines(words, WIDTH), pg.page_tables(words, WIDTH))
    got = sorted(map(str, tables.select(*apart.columns).collect()))
    assert got == sorted(map(str, apart.collect())) and any("NAKİT VARLIKLAR" in t for t in got)


def test_amounts_meet_within_a_document(spark):
    # equal amounts of other documents, zeros among them, are no work: as many documents, as many times the pairs
    from tallyweave.operators import linking as lk

    kind = "doc_id bigint, id string, period string, p_ord int, value decimal(38,6)"
    left = spark.createDataFrame([(d, f"{d}/l{i}", "p", 0, v) for d in range(30) for i, v in enumerate((0, 5, None))], kind.replace("decimal(38,6)", "int"))
    right = spark.createDataFrame([(d, f"{d}/r", "p", 0, 5 * (d % 2)) for d in range(30)], kind.replace("decimal(38,6)", "int"))
    decided = spark.createDataFrame([(d, f"{d}/l{i}", f"{d}/r") for d in range(30) for i in range(3)], "doc_id bigint, l_id string, r_id string")
    got = lk.reconcile(decided, left, right, "doc_id")
    want = {(f"{d}/l{i}"): "not_evaluable" if i == 2 else "pass" if i == d % 2 else "fail" for d in range(30) for i in range(3)}
    assert {r.l_id: r.recon for r in got.collect()} == want and got.count() == 90
    assert sorted(map(str, lk.reconcile(decided, left, right).select(*got.columns).collect())) == sorted(map(str, got.collect()))
    rows = spark.createDataFrame([], "doc_id bigint, row_id string, label string, section boolean, n_cells int, role string, duration boolean, page int")
    cells = spark.createDataFrame([], "doc_id bigint, row_id string, period string, col int, value decimal(38,6), state string")
    plan = fl.decisions(rows, cells, F.col("page") == 0)._jdf.queryExecution().analyzed().toString()
    on = [step for step in plan.splitlines() if "Join Inner" in step and "amount#" in step]
    assert len(on) == 2 and all("doc_id#" in step for step in on)


def test_no_words(spark):
    empty = fl.run(spark.createDataFrame([], WORDS), WIDTH, F.col("page") == 0)
    assert empty.relations.count() == empty.checks.count() == 0


def test_planted_fault(spark):
    led = spark.createDataFrame([("t", "a", "number", 5), ("t", "b", "number", None), ("t", "c", "dash", 1)], "table_id string, row_id string, state string, value bigint")
    assert [r.value for r in fl.inject(led, F.col("row_id") != "z", 7).orderBy("row_id").collect()] == [12, None, 1]


def test_one_run_at_a_time(spark, tmp_path):
    root = str(tmp_path)
    with stores.running(spark, root, "a", {"k": 1}):
        assert stores.status(spark, root, "a") == "running"
        with pytest.raises(stores.Busy), stores.running(spark, root, "b"):
            pass
    assert stores.batch(spark, root, {"a": lambda: 1 / 0, "b": lambda: 1 / 0, "c": lambda: None}) == {"a": "done", "b": "error", "c": "done"}
    assert stores.status(spark, root, "z") == "absent"
