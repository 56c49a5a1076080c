from decimal import Decimal

import pytest

from pyspark.sql import functions as F

from tallyweave.operators import checks as ck

SCHEMA = "table_id string, row_ord int, row_id string, label string, role string, indent int, period string, p_ord int, value decimal(38,6), state string, repaired boolean, parent_row_id string"


def ledger(spark, rows, period="c"):
    """rows: (label, role, value) with 'dash' and 'lost' standing for a dash and an unreadable number."""
    out = []
    for i, (label, role, value, *more) in enumerate(rows):
        parent, repaired = (more + [None, False])[:2] if more else (None, False)
        state = "dash" if value == "dash" else "number"
        v = None if value in ("dash", "lost") else Decimal(str(value))
        out.append(("t", i, f"r{i}", label, role, 0, period, 0, v, state, bool(repaired), parent))
    return spark.createDataFrame(out, SCHEMA)


def verdicts(df):
    return [r.status for r in df.orderBy("scope").collect()]


@pytest.mark.parametrize(("flow", "closing", "want"), [(20, 120, "pass"), (20, 121, "fail"), ("dash", 100, "pass"), ("lost", 100, "not_evaluable")])
def test_rollforward(spark, flow, closing, want):
    assert verdicts(ck.rollforward(ledger(spark, [("a", "opening", 100), ("f", "flow", flow), ("k", "closing", closing)]))) == [want]


def test_rollforward_lacks_roles(spark):
    assert verdicts(ck.rollforward(ledger(spark, [("a", "opening", 100), ("k", "closing", 100)]))) == ["not_evaluable"]


def test_row_sum(spark):
    df = ledger(spark, [("x", "item", 3)], "a").unionByName(ledger(spark, [("x", "item", 4)], "b")).unionByName(ledger(spark, [("x", "item", 7)], "toplam"))
    assert verdicts(ck.row_sums(df, "toplam")) == ["pass"]


def test_parent_sum(spark):
    rows = [("p", "item", 100), ("k", "item", 60, "r0"), ("k", "item", 41, "r0")]
    assert verdicts(ck.parent_sums(ledger(spark, rows))) == ["fail"]
    rows[2] = ("k", "item", 40, "r0")
    assert verdicts(ck.parent_sums(ledger(spark, rows))) == ["pass"]
    rows[2] = ("k", "item", 40, "r0", True)
    assert verdicts(ck.parent_sums(ledger(spark, rows))) == ["not_evaluable"]
    rows[2] = ("k", "item", "lost", "r0")
    assert verdicts(ck.parent_sums(ledger(spark, rows))) == []  # passed over in silence


def test_grand_total(spark):
    rows = [("a", "item", 10), ("b", "item", 30), ("c", "item", 20), ("d", "item", 10), ("TOPLAM", "total", 40)]
    assert verdicts(ck.grand_totals(ledger(spark, rows))) == ["pass"]  # 30 is 20 + 10
    assert verdicts(ck.grand_totals(ledger(spark, [*rows[:-1], ("TOPLAM", "total", 41)]))) == ["fail"]
    assert verdicts(ck.grand_totals(ledger(spark, [("a", "item", "lost"), ("TOPLAM", "total", 5)]))) == ["not_evaluable"]


def test_flow_cascade(spark):
    rows = [("HASILAT", "item", 100), ("maliyet", "flow", -40), ("BRÜT KAR", "item", 60), ("gider", "flow", -10), ("NET KAR", "item", 50)]
    assert verdicts(ck.flow_cascades(ledger(spark, rows))) == ["fail", "pass", "pass"]  # the first has nothing before it
    flipped = [rows[0], ("maliyet", "flow", 40), *rows[2:]]
    assert verdicts(ck.flow_cascades(ledger(spark, flipped))) == ["fail", "fail", "pass"]
    broken = [("x", "flow", 30), ("y", "flow", 70), ("HASILAT", "item", 100), ("pay", "flow", 0.058), ("gider", "flow", -20), ("NET KAR", "item", 80)]
    assert verdicts(ck.flow_cascades(ledger(spark, broken))) == ["pass", "pass"]


def test_sign_legality(spark):
    assert verdicts(ck.sign_legality(ledger(spark, [("Giderler (-)", "flow", 40), ("Giderler (-)", "flow", -40), ("x", "flow", 1), ("y (-)", "flow", "dash")]))) == ["fail", "pass"]


def test_percent_bounds(spark):
    cells = spark.createDataFrame([("1", "number", "percent", 86.6, None), ("2", "number", "percent", 486.6, None), ("3", "number", "percent_range", 2.0, 4.0), ("4", "number", "percent_range", 5.0, 4.0), ("5", "number", "int", 500.0, None)], "cell_id string, state string, kind string, value double, value_high double")
    assert verdicts(ck.percent_bounds(cells)) == ["pass", "fail", "pass", "fail"]


def first_prefix(values, target):
    run = 0
    for n, v in enumerate(values, start=1):
        if v is None:
            return 0
        run += v
        if run == target:
            return n
    return 0


def plain_parts(values):
    out, at = [], 0
    while at < len(values):
        out.append(at)
        at += 1 + (first_prefix(values[at + 1 :], values[at]) if values[at] is not None else 0)
    return out


def plain_restated(values, base):
    out, at = [], 0
    while at < len(values):
        n = first_prefix(values[at:], base)
        if not n:
            out.append(at)
        at += n or 1
    return out


def test_searches_against_loops(spark):
    import random

    draw = random.Random(3)
    rows = [([], 1), ([30, 20, 10, 5], 50), ([7, 3, 4, 1], 7), ([None], 0), ([0, 0, 0], 0)]
    rows += [([draw.choice([None, *range(-3, 6)]) for _ in range(draw.randint(0, 14))], draw.randint(-3, 9)) for _ in range(150)]
    df = spark.createDataFrame([([None if v is None else Decimal(v) for v in vs], Decimal(b)) for vs, b in rows], f"v array<{ck.AMOUNT}>, b {ck.AMOUNT}")
    got = df.select("v", "b", ck.without_parts(F.col("v")).alias("parts"), ck.without_restated(F.col("v"), F.col("b")).alias("rest")).collect()
    for r in got:
        v = [None if x is None else int(x) for x in r.v]
        assert r.parts == plain_parts(v) and r.rest == plain_restated(v, int(r.b)), (v, r.b)


def test_empty_ledger(spark):
    empty = spark.createDataFrame([], SCHEMA)
    for check in (ck.rollforward, ck.parent_sums, ck.grand_totals, ck.flow_cascades, ck.repaired_cells, ck.three_states, ck.sign_legality):
        assert check(empty).count() == 0
