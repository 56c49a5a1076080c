import pytest

#: Names that operators use inside; a table may bring them along.
CLASHES = ("id", "key", "key2", "n", "words", "word", "label", "sketch", "tag", "pos", "line", "score", "places", "trusted", "h1", "bits", "copies", "tokens", "budget", "shared", "digest", "__text", "quality", "toxic", "n_tokens", "ids", "perplexity", "gid")

TEXTS = [
    None,
    "",
    " \t\n ",
    "one",
    "one two three",
    "The quick brown fox jumps over the lazy dog again and again today",
    "The quick brown fox jumps over the lazy dog again and again today",
    "THE quick brown fox jumps over the lazy dog again and again today",
    "a line that is long enough to be a key of its own here\nand a short one",
    "x" * 60_000,
    "word " * 30_000,
    "\n" * 500,
    "Ünïcödé ÇÀÑ ß İstanbul \U0001f600 �",
    "<|endoftext|> </s>[INST] &amp; & <",
]


@pytest.fixture(scope="session")
def nasty(spark):
    """Nulls in every column, empty and long texts, ties, repeated rows, clashing extra columns."""
    rows = [(i, t, ["en", None, ""][i % 3], [None, "s", ""][i % 3], None) for i, t in enumerate(TEXTS)]
    rows += [rows[5], rows[5], (None, "no id here at all but some words", "en", "s", 3), (None, None, None, None, None), (7, "another text under the id seven, quite unlike", "en", "s", 1)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    for c in CLASHES:
        df = df.selectExpr("*", f"'clash' AS `{c}`")
    return df


@pytest.fixture(scope="session")
def labels(spark):
    rows = [(i, i % 2, i % 3 == 0) for i in range(14)] + [(None, 1, True), (3, None, None), (3, 1, True)]
    return spark.createDataFrame([(i, q, None if t is None else int(t)) for i, q, t in rows], "doc_id bigint, quality int, toxic int").selectExpr("*", "'clash' AS text", "'clash' AS lang")


@pytest.fixture(scope="session")
def empty(nasty):
    return nasty.limit(0)
