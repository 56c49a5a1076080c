"""Chat formatting in token-budgeted windows, in DataFrame functions only.

A window is the system turn, a limited tail of the span before, and a span of new turns; all of it counts
towards the budget.  Prefix sums of turn tokens choose the spans: what system turn and history leave is
halved, a turn longer than a half is a span of its own, and other turns belong to the half in which their
first token falls.  So spans are turn-aligned, fit by construction and need no sequential packing, and only
a turn that does not fit beside the system turn makes a window over budget, alone with it.  Only assistant
turns of the span carry loss; whatever is repeated is masked.

Template: ``<|role|n|>text</s>`` for a turn seen for the first time, ``<|role|r|>text</s>`` for a
repeated one.  Inside roles and texts ``& < [ |`` become ``&a; &l; &s; &p;`` (``|`` in roles only), so
no control string can occur in them and the escape is undone exactly.

Contract for odd input: null role or text is empty; turns are ordered by (turn, role, text), nulls
first, and repeated rows are repeated turns; rows without a conversation id form one conversation;
a turn longer than the budget makes a window of its own size, without history; a conversation's turns are
sorted and summed by one task, which streams them; other columns are never read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyweave.llm.common import table

END = "</s>"
#: Tokens that a turn's marks count for.
MARK_TOKENS = 4


def escape(text: Column) -> Column:
    for raw, safe in (("&", "&a;"), ("<", "&l;"), ("[", "&s;")):
        text = F.replace(text, F.lit(raw), F.lit(safe))
    return text


def unescape(text: Column) -> Column:
    for raw, safe in (("|", "&p;"), ("[", "&s;"), ("<", "&l;"), ("&", "&a;")):
        text = F.replace(text, F.lit(safe), F.lit(raw))
    return text


def count_tokens(text: Column) -> Column:
    """Words of a text, and the marks around it."""
    return F.regexp_count(text, F.lit(r"\S+")).cast("long") + MARK_TOKENS


def format_windows(turns: DataFrame, budget: int = 512, history: int = 128, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """``conv_id, window, formatted, loss`` (array of (start, length) in code points, start from 1), ``n_tokens``.

    A window holds at most ``budget`` tokens, of which up to ``history`` (and a quarter of what the system turn
    leaves) are turns repeated from the window before.  One shuffle, by conversation; prefix sums stream over sorted rows.
    """
    if not 0 <= history <= budget:
        raise ValueError("history must be between 0 and budget")
    text, role = F.coalesce(F.col(text_col), F.lit("")), F.coalesce(F.col(role_col), F.lit(""))
    rows = turns.select(F.col(conv_col).alias("conv_id"), F.col(turn_col).alias("turn"), role.alias("role"), text.alias("text"))
    rows = rows.withColumn("n", count_tokens(F.col("text")))
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("pos", F.row_number().over(order)).withColumn("system", (F.col("pos") == 1) & (F.col("role") == "system"))
    rows = rows.withColumn("held", F.first(F.when(F.col("system"), F.col("n")).otherwise(0)).over(upto))
    own = F.when(F.col("system"), 0).otherwise(F.col("n"))
    rows = rows.withColumn("start", F.sum(own).over(upto) - own)
    room = F.greatest(F.lit(budget) - F.col("held"), F.lit(1))
    tail_room = F.least(F.lit(history), F.expr(f"greatest({budget} - held, 1) div 4"))
    rows = rows.withColumn("tail_room", tail_room).withColumn("room", room).withColumn("half", F.expr("greatest((room - tail_room) div 2, 1)"))
    rows = rows.withColumn("long", ~F.col("system") & (F.col("n") > F.col("half")))
    # A span is told by the long turns before it, whether it is one, and its half.
    rows = rows.withColumn("longs", F.sum(F.col("long").cast("int")).over(upto) - F.col("long").cast("int"))
    rows = rows.withColumn("told", F.struct("longs", "long", F.when(F.col("long"), 0).otherwise(F.expr("start div half")).alias("half")))
    begins = (~F.col("told").eqNullSafe(F.lag("told").over(order))).cast("int")
    rows = rows.withColumn("begins", begins).withColumn("window", F.sum("begins").over(upto) - 1)
    entry = F.struct("pos", "start", F.replace(escape(F.col("role")), F.lit("|"), F.lit("&p;")).alias("role"), escape(F.col("text")).alias("text"), "n", (F.col("role") == "assistant").alias("learn"), "system")
    spans = rows.groupBy("conv_id", "window").agg(F.sort_array(F.collect_list(entry)).alias("span"), F.first("held").alias("held"), F.first("tail_room").alias("tail_room"), F.sum("n").alias("new"))
    by_window = Window.partitionBy("conv_id").orderBy("window")
    first = F.first(F.filter(F.slice("span", 1, 1), lambda t: t["system"])).over(by_window.rowsBetween(Window.unboundedPreceding, 0))
    before = F.lag("span").over(by_window)
    spans = spans.select("conv_id", "window", "span", first.alias("head"), before.alias("before"), F.greatest(F.lit(0), F.least("tail_room", F.lit(budget) - F.col("held") - F.col("new"))).alias("again"))
    none = F.filter("span", lambda _: F.lit(False))
    tail = F.filter("before", lambda t: ~t["system"] & (t["start"] >= F.col("span")[0]["start"] - F.col("again")))
    again = F.concat(F.when(F.col("window") > 0, F.coalesce("head", none)).otherwise(none), F.coalesce(tail, none))
    spans = spans.select("conv_id", "window", F.concat(F.transform(again, lambda t: _marked(t, "r")), F.transform("span", lambda t: _marked(t, "n"))).alias("turns"))
    ended = F.lit(END)
    # (place of the next turn, loss spans so far)
    start = F.struct(F.lit(1).alias("at"), F.expr("cast(array() as array<struct<start:int,length:int>>)").alias("loss"))

    def lay(acc: Column, t: Column) -> Column:
        begin = acc["at"] + F.length(t["head"])
        here = F.array(F.struct(begin.alias("start"), F.length(t["body"]).alias("length")))
        return F.struct((begin + F.length(t["body"]) + len(END)).alias("at"), F.when(t["learn"], F.concat(acc["loss"], here)).otherwise(acc["loss"]).alias("loss"))

    return spans.select(
        "conv_id",
        "window",
        F.array_join(F.transform("turns", lambda t: F.concat(t["head"], t["body"], ended)), "").alias("formatted"),
        F.aggregate("turns", start, lay, lambda acc: acc["loss"]).alias("loss"),
        F.aggregate("turns", F.lit(0).cast("long"), lambda a, t: a + t["n"]).alias("n_tokens"),
    )


def _marked(turn: Column, mark: str) -> Column:
    head = F.concat(F.lit("<|"), turn["role"], F.lit(f"|{mark}|>"))
    return F.struct(head.alias("head"), turn["text"].alias("body"), (turn["learn"] if mark == "n" else F.lit(False)).alias("learn"), turn["n"].alias("n"))


def read_back(windows: DataFrame) -> DataFrame:
    """Per conversation what its formatted windows say: turns, learnt text, length."""
    pieces = F.filter(F.split("formatted", END), lambda p: F.length(p) > 0)
    fresh = F.filter(pieces, lambda p: F.substring_index(F.substring_index(p, "|>", 1), "|", -1) == "n")

    def turn(p: Column) -> Column:
        head = F.substring_index(p, "|>", 1)
        body = F.substring(p, F.length(head) + 3, F.length(p))
        return F.concat(unescape(F.substring(head, F.lit(3), F.length(head) - 4)), F.lit("\n"), unescape(body), F.lit("\n"))

    learnt = F.array_join(F.transform("loss", lambda s: unescape(F.substring(F.col("formatted"), s["start"], s["length"]))), "")
    read = windows.select("conv_id", "window", F.size(fresh).cast("long").alias("n"), F.array_join(F.transform(fresh, turn), "").alias("told"), learnt.alias("learnt"), F.length("formatted").cast("long").alias("chars"))
    whole = read.groupBy("conv_id").agg(F.sum("n").alias("n_turns"), F.sort_array(F.collect_list(F.struct("window", "told", "learnt"))).alias("w"), F.sum("chars").alias("formatted_chars"))
    told, learnt = F.array_join("w.told", ""), F.array_join("w.learnt", "")
    return whole.select("conv_id", "n_turns", told.alias("told"), learnt.alias("learnt"), "formatted_chars").select(
        "conv_id",
        "n_turns",
        F.sha2(F.col("told").cast("binary"), 256).alias("turns_sha256"),
        F.length("learnt").cast("long").alias("loss_chars"),
        F.sha2(F.col("learnt").cast("binary"), 256).alias("loss_sha256"),
        "formatted_chars",
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit("</s>[INST] ok [/INST]").alias("text"))
    return read_back(format_windows(told.unionByName(probe)))


ORACLE = r"""
WITH rows_ AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), sized AS (
  SELECT *, len(regexp_extract_all(text, '[^ \t\n\x0b\f\r]+')) + 4 AS n,
         4 + length(replace(replace(replace(replace(role, '&', '&a;'), '<', '&l;'), '[', '&s;'), '|', '&p;')) + 2
           + length(replace(replace(replace(text, '&', '&a;'), '<', '&l;'), '[', '&s;')) + 4 AS chars
  FROM rows_
), placed AS (
  SELECT *, row_number() OVER w AS pos FROM sized WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)
), headed AS (
  SELECT *, pos = 1 AND role = 'system' AS sys, max(CASE WHEN pos = 1 AND role = 'system' THEN n ELSE 0 END) OVER (PARTITION BY conv_id) AS held FROM placed
), roomed AS (
  SELECT *, greatest(512 - held, 1) AS room, least(128, greatest(512 - held, 1) // 4) AS tail_room,
         sum(CASE WHEN sys THEN 0 ELSE n END) OVER (PARTITION BY conv_id ORDER BY pos) - CASE WHEN sys THEN 0 ELSE n END AS start FROM headed
), halved AS (SELECT *, greatest((room - tail_room) // 2, 1) AS half FROM roomed
), flagged AS (SELECT *, NOT sys AND n > half AS long FROM halved
), told AS (
  SELECT *, sum(long::INT) OVER (PARTITION BY conv_id ORDER BY pos) - long::INT AS longs, CASE WHEN long THEN 0 ELSE start // half END AS bin FROM flagged
), spans AS (SELECT *, dense_rank() OVER (PARTITION BY conv_id ORDER BY longs, long, bin) AS k FROM told
), firsts AS (
  SELECT conv_id, k, min(start) AS first_start, greatest(0, least(any_value(tail_room), 512 - any_value(held) - sum(n))) AS room FROM spans GROUP BY conv_id, k
), again AS (
  SELECT s.conv_id, sum(s.chars) AS chars FROM spans s JOIN firsts f ON f.conv_id = s.conv_id AND (
    (s.sys AND f.k > 1) OR (NOT s.sys AND f.k = s.k + 1 AND s.start >= f.first_start - f.room))
  GROUP BY s.conv_id
)
SELECT s.conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY pos)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY pos) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       sum(s.chars) + coalesce(any_value(a.chars), 0) AS formatted_chars
FROM spans s LEFT JOIN again a ON a.conv_id = s.conv_id GROUP BY s.conv_id
"""
