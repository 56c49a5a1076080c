from decimal import Decimal

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tallyweave.functions import fuzzy
from tallyweave.functions import grammar as g
from tallyweave.functions import tokens as tk

NUMBERS = [
    ("373.992.222", "number", "int", Decimal(373992222), None, False, 1.0),
    ("(72.681.523)", "number", "int", Decimal(-72681523), None, False, 1.0),
    ("0,058", "number", "decimal", Decimal("0.058"), None, False, 1.0),
    ("%86,6", "number", "percent", Decimal("86.6"), None, False, 1.0),
    ("%2-%4", "number", "percent_range", Decimal(2), Decimal(4), False, 1.0),
    ("-", "dash", None, None, None, False, 1.0),
    ("", "empty", None, None, None, False, 1.0),
    ("0", "number", "int", Decimal(0), None, False, 1.0),
    ("196262.178", "number", "int", Decimal(196262178), None, True, 0.7),
    ("12345", "number", "int", Decimal(12345), None, True, 0.5),
]


def one(spark, rows, **cols):
    return spark.createDataFrame([(r,) for r in rows], "t string").select("t", *[c.alias(k) for k, c in cols.items()]).collect()


def test_number_grammar(spark):
    got = {r.t: r.n for r in one(spark, [n[0] for n in NUMBERS] + ["-1.234", "abc"], n=g.parse_number(F.col("t")))}
    for raw, state, kind, value, high, repaired, conf in NUMBERS:
        n = got[raw]
        assert (n.state, n.kind, n.value, n.value_high, n.repaired, n.parse_conf) == (state, kind, value, high, repaired, conf)
        v = tk.parse(raw)
        assert (v.state, v.kind, v.value, v.high, v.repaired, v.parse_conf) == (state, kind, value, high, repaired, conf)
    assert got["-1.234"] is None and got["abc"] is None and tk.parse("-1.234") is None


def test_both_grammars_agree(spark):
    raws = ["1.234,5", "(1,5)", "%5", "2012", "(2012)", "1999.", "%", "()", "( 12 )", "0.123", "12.34", "–", "~", "1.2345", "%1,5-%2", "(%5)"]
    for r in one(spark, raws, n=g.parse_number(F.col("t")), m=g.is_money(F.col("t"))):
        v = tk.parse(r.t)
        assert (r.n is None) == (v is None), r.t
        if v is not None:
            assert (r.n.state, r.n.kind, r.n.value, r.n.repaired) == (v.state, v.kind, v.value, v.repaired), r.t
        assert r.m == tk.is_money(r.t), r.t


def test_folding_and_labels(spark):
    got = {r.t: r for r in one(spark, ["İLİŞKİN", "İLİŞKİN", "YATIRIM", "İskonto oranı (©)", "Doluluk oranı (90)(*)", "Kira artış oranı (0)", "Karşılıklar (net)"], f=g.fold(F.col("t")), n=g.norm_label(F.col("t")))}
    assert got["İLİŞKİN"].f == got["İLİŞKİN"].f == "ilişkin" and got["YATIRIM"].f == "yatırım"
    assert got["İskonto oranı (©)"].n == "iskonto oranı"
    assert got["Doluluk oranı (90)(*)"].n == "doluluk oranı"
    assert got["Kira artış oranı (0)"].n == "kira artış oranı"
    assert got["Karşılıklar (net)"].n == "karşılıklar (net)"


def test_roles_and_votes(spark):
    roles = {"1 Ocak 2012 itibari ile açılış bakiyesi": "opening", "31 Aralık 2012 itibari ile kapanış bakiyesi": "closing", "Binalar net defter değeri": "closing_equiv", "Toplam": "total", "Alımlar": "flow"}
    assert {r.t: r.r for r in one(spark, list(roles), r=g.row_role(F.col("t")))} == roles
    votes = [("9", "9", "exact"), ("9", "49", "suffix"), ("866", "0866", "suffix"), ("105", "7105", "suffix"), ("9", "3", "mismatch"), ("", "3", "mismatch")]
    df = spark.createDataFrame([v[:2] for v in votes], "a string, b string")
    assert [r.v for r in df.select(g.digit_vote(F.col("a"), F.col("b")).alias("v")).collect()] == [v[2] for v in votes]


def test_deny_scan(spark):
    got = one(spark, ["mail a.b@c.org or +90 212 555 12 34", "clean", "/home/someone/x"], m=g.deny_matches(F.col("t")))
    assert [[(m.kind, m.match) for m in r.m] for r in got] == [[("email", "a.b@c.org"), ("phone", "+90 212 555 12 34")], [], [("home_path", "/home/someone")]]


def slow_common(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        old = row[:]
        for j, y in enumerate(b):
            row[j + 1] = old[j] + 1 if x == y else max(old[j + 1], row[j])
    return row[-1]


@given(st.text("abcç", max_size=20), st.text("abcç", max_size=20))
def test_common_length(a, b):
    assert fuzzy.common_length(a, b) == slow_common(a, b)


def test_ratios(spark):
    assert fuzzy.ratio("", "") == 100 and fuzzy.ratio("a", "") == 0
    assert fuzzy.token_set_ratio("a b", "b a c") == 100.0 and fuzzy.token_set_ratio("", "a") == 0.0
    assert fuzzy.partial_ratio("abc", "xxabcxx") == 100.0
    df = spark.createDataFrame([("ab", "ab"), (None, "a")], "a string, b string")
    assert [r[0] for r in df.select(fuzzy.ratio_udf("a", "b")).collect()] == [100.0, None]


@pytest.mark.parametrize(("token", "want"), [("1l", 11), ("I2.", 12), ("B", 8), ("0", None), ("199", None), ("x1", None)])
def test_note_numbers(spark, token, want):
    assert tk.note_number(token) == want
    assert one(spark, [token], n=g.note_number(F.col("t")))[0].n == want
