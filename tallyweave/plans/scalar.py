"""Queries of the scalar functions and filters, with their DuckDB twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyweave.functions import grammar as g
from tallyweave.functions import scoring as sc
from tallyweave.sources import config
from tallyweave.sources.tables import table

#: name -> (query, twin)
ALL: dict[str, tuple] = {}


def query(twin: str | None):
    def add(f):
        ALL[f.__name__] = (f, twin)
        return f

    return add


# Printed amounts of all shapes, made from order lines.
def tokens(spark: SparkSession, sf: str) -> DataFrame:
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_discount", F.round(F.col("l_extendedprice") * 100).cast("bigint").alias("cents"))
    li = li.withColumns({"shape": ((F.col("l_orderkey") + F.col("l_linenumber")) % 12).cast("int"), "whole": F.expr("cents div 100"), "frac": F.lpad((F.col("cents") % 100).cast("string"), 2, "0")})
    grouped = F.translate(F.format_number("whole", 0), ",", ".")
    ln = F.col("l_linenumber").cast("string")
    token = (
        F.when(F.col("shape") == 0, F.concat(grouped, F.lit(","), "frac"))
        .when(F.col("shape") == 1, grouped)
        .when(F.col("shape") == 2, F.concat(F.lit("("), grouped, F.lit(")")))
        .when(F.col("shape") == 3, F.concat(F.lit("%"), F.col("l_quantity").cast("int").cast("string"), F.lit(","), ln))
        .when(F.col("shape") == 4, F.concat(F.lit("%"), ln, F.lit("-%"), (F.col("l_linenumber") + 2).cast("string")))
        .when(F.col("shape") == 5, F.lit(" - "))
        .when(F.col("shape") == 6, F.lit(""))
        .when(F.col("shape") == 7, F.concat(F.col("whole").cast("string"), F.lit(".0"), "frac"))
        .when(F.col("shape") == 8, F.col("whole").cast("string"))
        .when(F.col("shape") == 9, F.concat(F.lit("x"), F.col("whole").cast("string")))
        .when(F.col("shape") == 10, F.concat(F.lit("("), grouped, F.lit(","), F.col("frac"), F.lit(")")))
        .otherwise(F.when(F.col("l_linenumber") % 2 == 0, "0").otherwise((F.col("whole") % 250 + 1900).cast("string")))
    )
    return li.select("l_orderkey", "l_linenumber", "shape", "whole", "frac", token.alias("token"))


TOKENS = """
li AS (SELECT l_orderkey, l_linenumber, l_quantity, round(l_extendedprice * 100)::BIGINT AS cents FROM lineitem),
lw AS (SELECT *, ((l_orderkey + l_linenumber) % 12)::INT AS shape, cents // 100 AS whole, lpad((cents % 100)::VARCHAR, 2, '0') AS frac FROM li),
tokens AS (SELECT l_orderkey, l_linenumber, shape, whole, frac, CASE shape
  WHEN 0 THEN replace(format('{:,}', whole), ',', '.') || ',' || frac
  WHEN 1 THEN replace(format('{:,}', whole), ',', '.')
  WHEN 2 THEN '(' || replace(format('{:,}', whole), ',', '.') || ')'
  WHEN 3 THEN '%' || l_quantity::INT || ',' || l_linenumber
  WHEN 4 THEN '%' || l_linenumber || '-%' || (l_linenumber + 2)
  WHEN 5 THEN ' - ' WHEN 6 THEN ''
  WHEN 7 THEN whole || '.0' || frac
  WHEN 8 THEN whole::VARCHAR
  WHEN 9 THEN 'x' || whole
  WHEN 10 THEN '(' || replace(format('{:,}', whole), ',', '.') || ',' || frac || ')'
  ELSE CASE WHEN l_linenumber % 2 = 0 THEN '0' ELSE (whole % 250 + 1900)::VARCHAR END END AS token FROM lw)"""
PARSED = (
    TOKENS
    + r""",
cores AS (SELECT *, trim(token) AS t, trim(token) LIKE '(%' AND trim(token) LIKE '%)' AS neg FROM tokens),
cored AS (SELECT *, CASE WHEN neg THEN trim(t[2:-2]) ELSE t END AS core FROM cores),
kinds AS (SELECT *, CASE WHEN t = '' THEN 'empty' WHEN t IN ('-', '–', '—', '~') THEN 'dash'
  WHEN regexp_matches(core, '^%[0-9]+(,[0-9]+)?-%[0-9]+(,[0-9]+)?$') THEN 'percent_range'
  WHEN regexp_matches(core, '^%[0-9]+(,[0-9]+)?$') THEN 'percent'
  WHEN regexp_matches(core, '^[0-9]{1,3}(\.[0-9]{3})*,[0-9]+$') THEN 'decimal'
  WHEN regexp_matches(core, '^[0-9]{1,3}(\.[0-9]{3})+$|^[0-9]{1,3}$') THEN 'int'
  WHEN regexp_matches(core, '^[0-9]+(\.[0-9]{3})+$') THEN 'int_lost'
  WHEN regexp_matches(core, '^[0-9]{4,}$') THEN 'int_bare' END AS k FROM cored),
parsed AS (SELECT *, CASE WHEN k IN ('empty', 'dash') THEN k WHEN k IS NOT NULL THEN 'number' END AS state,
  CASE WHEN k LIKE 'int%' THEN 'int' WHEN k IN ('empty', 'dash') THEN NULL ELSE k END AS kind,
  CASE WHEN neg AND k <> 'percent_range' THEN -1 ELSE 1 END * CASE WHEN k IN ('empty', 'dash') OR k IS NULL THEN NULL
    WHEN k = 'percent_range' THEN replace(split_part(substr(core, 2), '-', 1), ',', '.')
    ELSE replace(replace(replace(core, '%', ''), '.', ''), ',', '.') END::DOUBLE AS value,
  CASE WHEN k = 'percent_range' THEN replace(split_part(core, '-%', 2), ',', '.')::DOUBLE END AS value_high,
  CASE WHEN k IS NOT NULL THEN k IN ('int_lost', 'int_bare') END AS repaired,
  CASE k WHEN 'int_lost' THEN 0.7 WHEN 'int_bare' THEN 0.5 ELSE CASE WHEN k IS NOT NULL THEN 1.0 END END::DOUBLE AS parse_conf FROM kinds)"""
)

# Labels with every role and the usual damage, made from customers.
_LABELS = (
    "1 Ocak 2012 itibari ile AÇILIŞ BAKİYESİ", "31 Aralık 2012 itibari ile kapanış bakiyesi", "Binalar NET DEFTER DEĞERİ", "TOPLAM", "Toplam varlıklar",
    "- Alımlar (*)", "İskonto oranı (©)", "Kira artış oranı (0)", "Karşılıklar (net)", " . Diğer  giderler (-) (**) :",
)


def labels_of(spark: SparkSession, sf: str) -> DataFrame:
    pick = F.get(F.array(*map(F.lit, _LABELS)), (F.col("c_custkey") % len(_LABELS)).cast("int"))
    tail = F.when(F.col("c_custkey") % 3 == 0, F.concat(F.lit(" "), F.col("c_mktsegment"))).otherwise("")
    return table(spark, sf, "customer").select("c_custkey", F.concat(pick, tail).alias("label"))


LABELS = f"""
labels_of AS (SELECT c_custkey, list_extract([{", ".join("'" + x + "'" for x in _LABELS)}], (c_custkey % {len(_LABELS)})::INT + 1)
  || CASE WHEN c_custkey % 3 = 0 THEN ' ' || c_mktsegment ELSE '' END AS label FROM customer)"""
FOLD = "replace(lower(translate({}, 'İI', 'iı')), chr(775), '')"
CLEAN = r"trim(regexp_replace({}, '\(\*+\)', '', 'g'), ' .:')"
SP = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"


@query(f"WITH {LABELS} SELECT c_custkey, {FOLD.format('label')} AS folded FROM labels_of")
def f1_tr_lower(spark, sf):
    return labels_of(spark, sf).select("c_custkey", g.fold(F.col("label")).alias("folded"))


@query(f"WITH {PARSED} SELECT l_orderkey, l_linenumber, state, kind, value, value_high, repaired, parse_conf FROM parsed")
def f2_parse_number(spark, sf):
    p = tokens(spark, sf).select("l_orderkey", "l_linenumber", g.parse_number(F.col("token")).alias("n"))
    return p.select("l_orderkey", "l_linenumber", "n.state", "n.kind", F.col("n.value").cast("double").alias("value"), F.col("n.value_high").cast("double").alias("value_high"), "n.repaired", "n.parse_conf")


@query(rf"WITH {TOKENS} SELECT l_orderkey, l_linenumber, regexp_matches(trim(token), '^\(?[%0-9][0-9.,%()\-]*\)?$') AS numeric_token FROM tokens")
def f3_is_numeric_token(spark, sf):
    return tokens(spark, sf).select("l_orderkey", "l_linenumber", g.is_numeric_token(F.col("token")).alias("numeric_token"))


@query(rf"WITH {LABELS} SELECT c_custkey, {CLEAN.format('label')} AS cleaned, array_to_string(regexp_extract_all(label, '\((\*+)\)', 1), ' ') AS marks FROM labels_of")
def f4_clean_label(spark, sf):
    return labels_of(spark, sf).select("c_custkey", g.clean_label(F.col("label")).alias("cleaned"), F.array_join(g.label_marks(F.col("label")), " ").alias("marks"))


NORM = r"regexp_replace(trim(regexp_replace(trim(ltrim({}, '-')), '\s*\([%©®°0-9o]{{1,2}}\)\s*$', '')), '\s+', ' ', 'g')".format(FOLD.format(CLEAN.format("label")))


@query(f"WITH {LABELS} SELECT c_custkey, {NORM} AS norm FROM labels_of")
def f5_norm_label(spark, sf):
    return labels_of(spark, sf).select("c_custkey", g.norm_label(F.col("label")).alias("norm"))


ROLE = "CASE WHEN contains(fl, 'açılış bakiyesi') THEN 'opening' WHEN contains(fl, 'kapanış bakiyesi') THEN 'closing' WHEN contains(fl, 'net defter değeri') THEN 'closing_equiv' WHEN trim(fl) = 'toplam' OR fl LIKE 'toplam %' THEN 'total' ELSE 'flow' END"


@query(f"WITH {LABELS}, x AS (SELECT c_custkey, {FOLD.format('label')} AS fl FROM labels_of) SELECT c_custkey, {ROLE} AS role FROM x")
def f6_row_role(spark, sf):
    return labels_of(spark, sf).select("c_custkey", g.row_role(F.col("label")).alias("role"))


SLUG = "trim(regexp_replace({}, '[^a-z0-9çğıöşü]+', '_', 'g'), '_')".format(FOLD.format("label"))


@query(f"WITH {LABELS}, x AS (SELECT c_custkey, {SLUG} AS s FROM labels_of) SELECT c_custkey, CASE WHEN s = '' THEN 'col' ELSE s END AS slug FROM x")
def f7_slug(spark, sf):
    return labels_of(spark, sf).select("c_custkey", g.slug(F.col("label")).alias("slug"))


NOTE_MARKS = ("1l", "I2.", "B", "oS", "0", "12", "199", "x1", " 3, ")


@query("WITH x AS (SELECT o_orderkey, list_extract(['1l', 'I2.', 'B', 'oS', '0', '12', '199', 'x1', ' 3, '], (o_orderkey % 9)::INT + 1) AS t FROM orders), y AS (SELECT o_orderkey, translate(rtrim(trim(t), '.,'), 'lIİiOoSB', '11110058') AS d FROM x) SELECT o_orderkey, CASE WHEN regexp_matches(d, '^[0-9]+$') AND d::INT BETWEEN 1 AND 99 THEN d::INT END AS note_no FROM y")
def f8_note_number(spark, sf):
    t = F.get(F.array(*map(F.lit, NOTE_MARKS)), (F.col("o_orderkey") % 9).cast("int"))
    return table(spark, sf, "orders").select("o_orderkey", g.note_number(t).alias("note_no"))


IS_MONEY = r"""CASE WHEN t IN ('-', '–', '—', '~') THEN true WHEN NOT regexp_matches(t, '^\(?[%0-9][0-9.,%()\-]*\)?$') OR state IS DISTINCT FROM 'number' THEN false
  WHEN kind IN ('percent', 'percent_range', 'decimal') THEN true WHEN NOT contains(t, '.') AND trunc(value) BETWEEN 1900 AND 2100 AND NOT starts_with(t, '(') THEN false
  ELSE contains(t, '.') OR contains(t, '(') OR abs(trunc(value)) >= 1000 OR t = '0' END"""


@query(f"WITH {PARSED} SELECT l_orderkey, l_linenumber, {IS_MONEY} AS money FROM parsed")
def f12_is_money(spark, sf):
    return tokens(spark, sf).select("l_orderkey", "l_linenumber", g.is_money(F.col("token")).alias("money"))


@query(f"WITH {TOKENS} SELECT l_orderkey, l_linenumber, regexp_matches(trim(token), '^[0-9]{{1,2}}$') AS small_ref FROM tokens")
def f13_is_small_ref(spark, sf):
    return tokens(spark, sf).select("l_orderkey", "l_linenumber", g.is_small_ref(F.col("token")).alias("small_ref"))


@query(f"WITH {LABELS} SELECT c_custkey, contains({FOLD.format('label')}, 'oran') AS rate FROM labels_of")
def f15_is_rate_row(spark, sf):
    return labels_of(spark, sf).select("c_custkey", g.is_rate_label(F.col("label")).alias("rate"))


VOTE = "CASE WHEN a = '' OR b = '' THEN 'mismatch' WHEN a = b THEN 'exact' WHEN a LIKE '%' || b OR b LIKE '%' || a THEN 'suffix' ELSE 'mismatch' END"
_VOTES = "x AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber = 7 THEN '' ELSE l_quantity::INT::VARCHAR END AS a, CASE l_linenumber % 3 WHEN 0 THEN l_quantity::INT::VARCHAR WHEN 1 THEN '7' || l_quantity::INT ELSE (l_quantity::INT + 1)::VARCHAR END AS b FROM lineitem)"


def _readings(spark, sf):
    q = F.col("l_quantity").cast("int")
    a = F.when(F.col("l_linenumber") == 7, "").otherwise(q.cast("string"))
    b = F.when(F.col("l_linenumber") % 3 == 0, q.cast("string")).when(F.col("l_linenumber") % 3 == 1, F.concat(F.lit("7"), q.cast("string"))).otherwise((q + 1).cast("string"))
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_discount", a.alias("a"), b.alias("b"))


@query(f"WITH {_VOTES} SELECT l_orderkey, l_linenumber, {VOTE} AS vote FROM x")
def f16_digit_vote(spark, sf):
    return _readings(spark, sf).select("l_orderkey", "l_linenumber", g.digit_vote(F.col("a"), F.col("b")).alias("vote"))


@query(f"WITH {TOKENS} SELECT l_orderkey, l_linenumber, regexp_replace(token, '[^0-9]', '', 'g') AS digits FROM tokens")
def f17_digits_of(spark, sf):
    return tokens(spark, sf).select("l_orderkey", "l_linenumber", g.digits_of(F.col("token")).alias("digits"))


_AMOUNT = "CASE WHEN c < 0 THEN '(' ELSE '' END || replace(format('{:,}', abs(c) // 100), ',', '.') || CASE WHEN abs(c) % 100 = 0 THEN '' ELSE ',' || lpad((abs(c) % 100)::VARCHAR, 2, '0') END || CASE WHEN c < 0 THEN ')' ELSE '' END"


@query(f"WITH x AS (SELECT c_custkey, c_name, round(c_acctbal * 100)::BIGINT AS c FROM customer) SELECT c_custkey, c_name || ' | ' || {_AMOUNT} || ' ; ' || replace({_AMOUNT}, ' ', '') AS pair FROM x")
def f18_pair_text(spark, sf):
    amount = g.amount_text(F.round(F.col("c_acctbal") * 100).cast("decimal(20,0)") / F.lit(100).cast("decimal(3,0)"))
    return table(spark, sf, "customer").select("c_custkey", g.pair_text(F.col("c_name"), F.array(amount, amount)).alias("pair"))


# One link decision for each order line: scores and verdicts spread over all cases.
def decisions(spark, sf):
    li = table(spark, sf, "lineitem")
    ce, lex = F.col("l_quantity") / 50, (F.col("l_suppkey") % 101) / 100
    anchored = F.col("l_linenumber") % 2 == 0
    role = F.get(F.array(*map(F.lit, ("opening", "closing", "closing_equiv", "total", "flow", "item"))), (F.col("l_partkey") % 6).cast("int"))
    d = li.select("l_orderkey", "l_linenumber", ce.alias("ce"), lex.alias("lex"), anchored.alias("anchored"), role.alias("role"), (F.col("l_returnflag") == "R").alias("is_flow"), (F.col("l_orderkey") % 7 == 0).alias("d"), F.when(F.col("l_linestatus") == "F", "pass").when(F.col("l_partkey") % 3 == 0, "fail").otherwise("not_evaluable").alias("recon"))
    b = sc.accept_value_rules(F.col("anchored"), F.col("role"), F.col("is_flow"))
    return d.withColumns({"a_acc": sc.accept_cross_encoder(F.col("ce"), F.col("l_linenumber")), "b_acc": b, "b_score": sc.value_rules_score(F.col("anchored"), b), "c_acc": sc.accept_lexical(F.col("lex"))})


DECISIONS = """
d0 AS (SELECT l_orderkey, l_linenumber, l_quantity / 50 AS ce, (l_suppkey % 101)::DOUBLE / 100 AS lex, l_linenumber % 2 = 0 AS anchored,
  list_extract(['opening', 'closing', 'closing_equiv', 'total', 'flow', 'item'], (l_partkey % 6)::INT + 1) AS role, l_returnflag = 'R' AS is_flow, l_orderkey % 7 = 0 AS d,
  CASE WHEN l_linestatus = 'F' THEN 'pass' WHEN l_partkey % 3 = 0 THEN 'fail' ELSE 'not_evaluable' END AS recon FROM lineitem),
d1 AS (SELECT *, ce >= 0.5 OR (l_linenumber = 1 AND ce >= 0.2) AS a_acc, anchored AND CASE WHEN is_flow THEN role = 'flow' ELSE role IN ('opening', 'closing', 'closing_equiv', 'total') END AS b_acc, lex >= 0.75 AS c_acc FROM d0),
decisions AS (SELECT *, CASE WHEN b_acc THEN 1.0 WHEN anchored THEN 0.5 ELSE 0.0 END::DOUBLE AS b_score FROM d1)"""


@query(f"WITH {DECISIONS} SELECT l_orderkey, l_linenumber, CASE WHEN NOT anchored THEN 'semantic' WHEN role IN ('opening', 'closing', 'closing_equiv') THEN 'balance_reconciliation' WHEN role = 'total' THEN 'total_reconciliation' ELSE 'flow_match' END AS relation_type FROM decisions")
def f19_relation_type(spark, sf):
    return decisions(spark, sf).select("l_orderkey", "l_linenumber", sc.relation_type(F.col("role"), F.col("anchored")).alias("relation_type"))


AGREE = "CASE WHEN a_acc AND b_acc THEN 'consensus' WHEN a_acc THEN 'a_only' WHEN b_acc THEN 'b_only' WHEN c_acc THEN 'baseline_only' WHEN d THEN 'd_only' ELSE 'none' END"


@query(f"WITH {DECISIONS} SELECT l_orderkey, l_linenumber, {AGREE} AS agreement FROM decisions")
def f20_agreement(spark, sf):
    return decisions(spark, sf).select("l_orderkey", "l_linenumber", sc.agreement(F.col("a_acc"), F.col("b_acc"), F.col("c_acc"), F.col("d")).alias("agreement"))


@query("WITH x AS (SELECT l_orderkey, list('y' || year(l_shipdate) ORDER BY l_linenumber) FILTER (WHERE l_returnflag = 'R') AS p FROM lineitem GROUP BY l_orderkey) SELECT l_orderkey, CASE WHEN len(list_distinct(p)) > 1 THEN 'both' WHEN len(p) > 0 THEN p[1] ELSE 'unscoped' END AS period_scope FROM x")
def f21_period_scope(spark, sf):
    sp = F.when(F.col("l_returnflag") == "R", F.concat(F.lit("y"), F.year("l_shipdate").cast("string")))
    anchors = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", sp.alias("sp")).groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.when(F.col("sp").isNotNull(), F.struct("l_linenumber", "sp")))).alias("a"))
    return anchors.select("l_orderkey", sc.period_scope(F.col("a")).alias("period_scope"))


@query("SELECT c_custkey, round(1 / (1 + exp(-c_acctbal / 1000)), 6) AS p FROM customer")
def f22_sigmoid(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", F.round(sc.sigmoid(F.col("c_acctbal") / 1000), 6).alias("p"))


@query("SELECT l_orderkey, l_linenumber, round(greatest(0.0, least(1.0, (1.1 - l_discount) * CASE l_linenumber % 3 WHEN 0 THEN 1.0 WHEN 1 THEN 0.7 ELSE 0.5 END)), 6)::DOUBLE AS conf FROM lineitem")
def f23_cell_confidence(spark, sf):
    parse = F.when(F.col("l_linenumber") % 3 == 0, 1.0).when(F.col("l_linenumber") % 3 == 1, 0.7).otherwise(0.5)
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.round(sc.cell_confidence(1.1 - F.col("l_discount"), parse), 6).alias("conf"))


@query(f"WITH {_VOTES.replace('FROM lineitem', ', l_discount FROM lineitem')}, y AS (SELECT *, {VOTE} AS vote, least(0.95, greatest(0.5, 1 - l_discount * 6)) AS c FROM x) SELECT l_orderkey, l_linenumber, round(CASE vote WHEN 'suffix' THEN c * 0.97 WHEN 'mismatch' THEN least(c, 0.4) ELSE c END, 6)::DOUBLE AS conf FROM y")
def f24_rescue_confidence(spark, sf):
    vote = g.digit_vote(F.col("a"), F.col("b"))
    return _readings(spark, sf).select("l_orderkey", "l_linenumber", F.round(sc.rescue_confidence(1 - F.col("l_discount") * 6, vote), 6).alias("conf"))


@query("SELECT s_suppkey, round(greatest(0.0, least(1.0, 1 - (s_suppkey % 25)::DOUBLE / 20)), 6)::DOUBLE AS p_star FROM supplier")
def f25_p_star(spark, sf):
    stars = F.create_map(*[F.lit(x) for i in range(25) for x in (i, sc.p_star(float(i), 20.0))])
    return table(spark, sf, "supplier").select("s_suppkey", F.round(stars[(F.col("s_suppkey") % 25).cast("int")], 6).alias("p_star"))


@query("SELECT l_orderkey, l_linenumber, CASE WHEN 1 - l_tax * 8 >= 0.8 THEN 'high' WHEN 1 - l_tax * 8 >= 0.5 THEN 'middle' ELSE 'low' END AS band FROM lineitem")
def f26_conf_color(spark, sf):
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", sc.conf_color(1 - F.col("l_tax") * 8).alias("band"))


@query(f"WITH {LABELS}, x AS (SELECT c_custkey, label, len(regexp_extract_all(label, '\\p{{L}}')) AS n, len(regexp_extract_all(label, '\\p{{Lu}}')) AS u FROM labels_of) SELECT c_custkey, n > 0 AND u * 10 >= n * 6 AND c_custkey % 2 = 0 AND c_custkey % 5 <> 0 AS milestone FROM x")
def f27_milestone(spark, sf):
    up = g.upper_share(F.col("label"))
    return labels_of(spark, sf).select("c_custkey", F.coalesce((up >= 0.6) & (F.col("c_custkey") % 2 == 0) & (F.col("c_custkey") % 5 != 0), F.lit(False)).alias("milestone"))


@query(f"WITH {LABELS} SELECT c_custkey, trim(regexp_replace(regexp_replace({FOLD.format('label')}, '[''\"’“”.,:;()*-]', ' ', 'g'), '\\s+', ' ', 'g')) AS low FROM labels_of")
def f28_scorer_fold(spark, sf):
    bare = F.regexp_replace(g.fold(F.col("label")), "['\"’“”.,:;()*-]", " ")
    return labels_of(spark, sf).select("c_custkey", F.trim(F.regexp_replace(bare, r"\s+", " ")).alias("low"))


@query("SELECT o_orderkey, strftime(try_strptime(CASE WHEN o_orderkey % 5 = 0 THEN '2012-13-40' ELSE strftime(o_orderdate, '%Y-%m-%d') END, '%Y-%m-%d'), '%Y-%m-%d') AS period_end, upper(trim('  ' || list_extract(['tl', 'eur', 'us 1', 'usd_old_x'], (o_orderkey % 4)::INT + 1) || ' ')) AS currency, (o_orderkey % 4) < 2 AS currency_ok FROM orders")
def f30_upload_fields(spark, sf):
    date = F.when(F.col("o_orderkey") % 5 == 0, "2012-13-40").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd"))
    cur = F.upper(F.trim(F.concat(F.lit("  "), F.get(F.array(*map(F.lit, ("tl", "eur", "us 1", "usd_old_x"))), (F.col("o_orderkey") % 4).cast("int")), F.lit(" "))))
    return table(spark, sf, "orders").select("o_orderkey", F.date_format(F.try_to_date(date, "yyyy-MM-dd"), "yyyy-MM-dd").alias("period_end"), cur.alias("currency"), cur.rlike(f"^{config.CURRENCY}$").alias("currency_ok"))


@query(f"WITH {LABELS}, x AS (SELECT c_custkey, label, len(regexp_extract_all(label, '\\p{{L}}')) AS n, len(regexp_extract_all(label, '\\p{{Lu}}')) AS u FROM labels_of) SELECT c_custkey, n >= 8 AND len(string_split(label, ' ')) >= 2 AND u * 4 >= n * 3 AS title_like, n > 0 AND length(label) <= 24 AND u * 10 >= n * 9 AS section_like FROM x")
def f31_title_tests(spark, sf):
    up, n = g.upper_share(F.col("label")), g.letters(F.col("label"))
    title = (n >= 8) & (F.size(F.split("label", " ")) >= 2) & (F.coalesce(up, F.lit(0.0)) >= 0.75)
    return labels_of(spark, sf).select("c_custkey", title.alias("title_like"), ((n > 0) & (F.length("label") <= 24) & (F.coalesce(up, F.lit(0.0)) >= 0.9)).alias("section_like"))


@query("SELECT event_id, TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) IS NOT NULL AS int_kind, event_type <> '' AS text_kind FROM events")
def f32_value_kinds(spark, sf):
    return table(spark, sf, "events").select("event_id", F.get_json_object("props", "$.k").try_cast("bigint").isNotNull().alias("int_kind"), (F.col("event_type") != "").alias("text_kind"))


_DENY = "SELECT doc_id, pos, '{}' AS kind, unnest(regexp_extract_all(line, '{}')) AS match FROM lines"


@query("WITH lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos FROM documents) " + " UNION ALL ".join(_DENY.format(k, p) for k, p in g.DENY))
def f33_deny_scan(spark, sf):
    lines = table(spark, sf, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    found = lines.select("doc_id", F.col("pos").cast("bigint").alias("pos"), F.explode(g.deny_matches(F.col("line"))).alias("m"))
    return found.select("doc_id", "pos", "m.kind", "m.match")
