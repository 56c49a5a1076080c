"""URL filters: host and path rules, and naive Bayes over segmented host words for the rest.

Letter runs of host labels are split into words by the most likely path through a unigram model, counted
over the words of all pages' text and URLs.  The model is never sent anywhere whole: the substrings of
the distinct runs are joined to it, and each run is decided from its own substrings' counts.
Host words and path tokens then feed a multinomial naive Bayes model over 2^16 hashed places.  It learns
from the URLs that the rules decide, so it carries the rule list's verdicts on to URLs that no rule fits;
a fifth of those URLs, told by the id, is held out to measure the agreement.

Contract for odd input: a null url, or one without ``://``, has empty host and path, fits no rule and is
judged by the class prior alone; where the rules decide no URL all others are allowed; hosts of any length
are segmented, into words of up to ``LONGEST_WORD`` letters where known; a null id is never held out;
repeated rows give repeated rows; other columns are never read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyweave.llm.common import materialize, small_batches, table, typed, worded
from tallyweave.llm.line_dedup import ascii_lower

#: (host, path, verdict)
Rule = tuple[str, str, str]
RULES: tuple[Rule, ...] = (
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
)
#: Letters of the longest word the unigram model knows; and of those short words that are sent to every
#: substring, as there are at most 26 + 26^2 + 26^3 of them.
LONGEST_WORD, SHORT_WORD = 24, 3
PLACES = 1 << 16


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"\A[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), r"\A[^?#]*", 0)
    return ascii_lower(host), path


def matched_rule(host: Column, path: Column, rules: Sequence[Rule] = RULES) -> Column:
    """``struct<rule, verdict>`` of the longest rule that fits, else null.

    A rule list is part of the query, so it is written out as one expression, longest rules first.
    """
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for h, p, verdict in sorted(rules, key=lambda r: (len(r[0]) + len(r[1]), r)):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        out = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def letter_runs(text: Column) -> Column:
    return F.filter(F.split(text, r"[^a-z]+"), lambda w: w != "")


def unigrams(pages: DataFrame) -> DataFrame:
    """``word, n`` over the text of pages; a letter run of a URL counts once, however often it is linked.

    So a name that is often linked does not become a word by that, and ``casinowin`` falls apart if
    ``casino`` and ``win`` are known from elsewhere.
    """
    text = F.regexp_replace(F.coalesce("html", F.lit("")), r"<[^>]*>|&[a-z]+;", " ")
    words = pages.select(F.explode(letter_runs(F.lower(text))).alias("word"))
    told = words.groupBy("word").agg(F.count("*").alias("n"))
    linked = pages.select(F.explode(letter_runs(F.lower("url"))).alias("word")).distinct().withColumn("n", F.lit(1).cast("long"))
    return told.unionByName(linked).where(F.length("word") <= LONGEST_WORD).groupBy("word").agg(F.sum("n").alias("n"))


def _viterbi(run: str, found: dict[tuple[int, int], int], total: int) -> list[str]:
    """The likeliest words; an unknown word's chance falls tenfold with each letter (all in logs)."""
    best = [0.0] + [-math.inf] * len(run)
    back = [0] * (len(run) + 1)
    for end in range(1, len(run) + 1):
        for start in range(max(0, end - LONGEST_WORD), end):
            n = found.get((start, end), 0)
            chance = math.log(n / total) if n else math.log(10 / total) - (end - start) * math.log(10)
            if best[start] + chance > best[end]:
                best[end], back[end] = best[start] + chance, start
    out, end = [], len(run)
    while end:
        out.append(run[back[end] : end])
        end = back[end]
    return out[::-1]


def segment(runs: DataFrame, model: DataFrame) -> DataFrame:
    """``run, words`` for distinct ``run``s: each asks the model for its own substrings alone."""
    total = model.agg(F.coalesce(F.sum("n"), F.lit(1)).alias("t")).first()["t"] or 1
    cuts = runs.select("run", F.explode(F.sequence(F.lit(0), F.length("run") - 1)).alias("start"))
    cuts = cuts.select("run", "start", F.explode(F.sequence(F.col("start") + 1, F.least(F.length("run"), F.col("start") + LONGEST_WORD))).alias("end"))
    cuts = cuts.withColumn("word", F.expr("substring(run, start + 1, end - start)"))
    # Short substrings are the hot ones, and their words are few; long ones meet the model by hash.
    is_short = F.length("word") <= SHORT_WORD
    known = cuts.where(is_short).join(F.broadcast(model.where(is_short)), "word").unionByName(cuts.where(~is_short).join(model.where(~is_short), "word"))
    known = known.groupBy("run").agg(F.collect_list(F.struct("start", "end", "n")).alias("found"))

    def run_all(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            words = [_viterbi(r, {(x["start"], x["end"]): x["n"] for x in (f if f is not None else [])}, total) for r, f in zip(batch["run"], batch["found"], strict=True)]
            yield pd.DataFrame({"run": batch["run"], "words": words})

    return runs.join(known, "run", "left").mapInPandas(run_all, "run string, words array<string>")


def host_words(hosts: DataFrame, model: DataFrame) -> DataFrame:
    """``host, words`` for distinct ``host``s."""
    cut = hosts.select("host", F.posexplode_outer(letter_runs(F.col("host"))).alias("pos", "run"))
    words = segment(cut.where("run IS NOT NULL").select("run").distinct(), model)
    joined = cut.join(words, "run", "left")
    ordered = joined.groupBy("host").agg(F.sort_array(F.collect_list(F.struct("pos", "words"))).alias("w"))
    return ordered.select("host", F.flatten(F.transform(F.filter("w", lambda x: x["words"].isNotNull()), lambda x: x["words"])).alias("words"))


def place(token: Column) -> Column:
    return F.pmod(F.xxhash64(token), F.lit(PLACES)).cast("int")


def held_out(id_col: str = "id") -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def learn(urls: DataFrame, smoothing: float = 0.05) -> np.ndarray:
    """Log-odds of blocked against allowed from rows of (blocked, tokens): one for each place, the prior last.

    At most 2^16 rows reach the driver.
    """
    rows = urls.select(F.col("blocked").cast("int").alias("bad"), "tokens")
    prior = rows.agg(F.sum("bad").alias("b"), F.count("*").alias("n")).first()
    counts = rows.select("bad", F.explode("tokens").alias("t")).groupBy(place(F.col("t")).alias("place")).agg(F.sum("bad").alias("b"), F.count("*").alias("n")).toPandas()
    b, n = np.zeros(PLACES), np.zeros(PLACES)
    b[counts["place"]], n[counts["place"]] = counts["b"], counts["n"]
    g = n - b
    more = smoothing * max(1, len(counts))
    odds = np.where(n > 0, np.log((b + smoothing) / (b.sum() + more)) - np.log((g + smoothing) / (g.sum() + more)), 0.0)
    bad_n, all_n = prior.b or 0, prior.n or 0
    return np.append(odds, math.log((bad_n + 1) / (all_n - bad_n + 1)) if all_n else -1.0)


def judge(pages: DataFrame, rules: Sequence[Rule] = RULES, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``id, host, path, rule, verdict, words, log_odds, held_out`` for every page."""
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    host, path = host_and_path(F.col("url"))
    urls = rows.select("id", host.alias("host"), path.alias("path")).withColumn("hit", matched_rule(F.col("host"), F.col("path"), rules))
    words = materialize(host_words(urls.select("host").distinct(), materialize(unigrams(rows))))
    # A host's pages meet its words: a hot host's rows are split by AQE, its words are one small row.
    urls = urls.join(words, "host", "left").withColumn("words", F.coalesce("words", F.expr("cast(array() as array<string>)")))
    parts = F.filter(F.split(F.lower("path"), r"[^a-z0-9]+"), lambda w: w != "")
    shape = F.transform(parts, lambda w: F.concat(F.lit("/"), F.regexp_replace(w, r"[0-9]+", "0")))
    urls = urls.withColumn("tokens", F.concat("words", shape))
    taught = urls.where("hit.rule IS NOT NULL").where(~held_out()).withColumn("blocked", F.col("hit.verdict") == "block")
    shared = pages.sparkSession.sparkContext.broadcast(learn(taught))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        odds = shared.value
        for batch in batches:
            batch["log_odds"] = [float(odds[np.asarray(p, np.int64)].sum() + odds[-1]) for p in batch["places"]]
            yield batch.drop(columns="places")

    coded = urls.select("id", "host", "path", "words", F.transform("tokens", place).alias("places"))
    scored = small_batches(worded(coded, "id")).mapInPandas(run, "id string, host string, path string, words array<string>, log_odds double")
    scored = typed(scored, coded, "id")
    out = scored.withColumn("hit", matched_rule(F.col("host"), F.col("path"), rules))
    verdict = F.coalesce(F.col("hit.verdict"), F.when(F.col("log_odds") > 0, "block").otherwise("allow"))
    return out.select("id", "host", "path", F.col("hit.rule").alias("rule"), verdict.alias("verdict"), "words", "log_odds", (F.col("hit.rule").isNotNull() & held_out()).alias("held_out"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = judge(table(spark, sf_dir, "pages"))
    return got.select(F.col("id").alias("page_id"), "host", "path", "rule", "verdict", F.array_join("words", " ").alias("host_words"), "log_odds", "held_out")
