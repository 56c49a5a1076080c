import random

import numpy as np
import pytest
from tokenizers import Tokenizer

from tallyweave.llm import bpe


@pytest.fixture(scope="module")
def spec():
    return bpe.tokenizer_spec(bpe.default_tokenizer())


def texts():
    out = [f"a{chr(c)}b{chr(c)}{chr(c)} " for c in range(0x3000) if not 0xD800 <= c < 0xE000]
    out += [f"{chr(c)}x" for c in range(0x3000, 0x20000, 7) if not 0xD800 <= c < 0xE000]
    draw = random.Random(1)
    out += ["".join(draw.choice("abcdefghijklmnoprstuvwxyz'éèßΣσİ1 ́̈") for _ in range(draw.randint(1, 40))) for _ in range(4000)]
    return [*out, *("a" * n for n in range(1, 50)), "ab" * 3000, "x" * 20000, "<|endoftext|>a<|startoftext|", "<|ENDOFTEXT|>", "ΑΣ ΟΔΟΣ Σ", "", "don't we'll it's"]


def test_equals_the_library(spec):
    mine, lib, given = bpe.WordBpe(spec), Tokenizer.from_str(spec), texts()
    want = lib.encode_batch(given, add_special_tokens=False)
    got = mine.encode_batch(given)
    assert [np.frombuffer(b, "<u4").tolist() for b in got] == [e.ids for e in want]
    assert [mine.decode(b) for b in got] == [lib.decode(e.ids, skip_special_tokens=False) for e in want]


def test_speculation_is_checked(spec):
    mine = bpe.WordBpe(spec)
    words = ["thththat", "ouonsh", "hello", "erereat"]
    mine.learn(words)
    for w in words:
        assert np.frombuffer(mine.cache[w], "<u4").tolist() == mine.merge(mine.symbols(w))
    assert mine.merged_exactly < len(words)  # some proposals stand


def test_cache_starts_afresh(spec, monkeypatch):
    monkeypatch.setattr(bpe, "CACHE_WORDS", 3)
    mine = bpe.WordBpe(spec)
    first = mine.encode_batch(["one two three four five"])
    assert mine.encode_batch(["six"]) and mine.encode_batch(["one two three four five"]) == first


def test_words_met_lately_are_kept(spec, monkeypatch):
    """A full cache forgets what was not met lately; a word of every batch is learnt once."""
    mine = bpe.WordBpe(spec)
    monkeypatch.setattr(bpe, "CACHE_WORDS", 8)
    learnt = []
    learn = mine.learn
    monkeypatch.setattr(mine, "learn", lambda words: learn(learnt.extend(w := list(words)) or w))
    for k in range(20):
        mine.encode_batch([f"thththat {' '.join(f'w{chr(97 + k)}{c}' for c in 'abcde')}"])
        assert len(mine.cache) <= 16
    assert learnt.count("thththat") == 1 and len(learnt) == 101


def test_side_by_side_is_one_by_one(spec):
    mine, draw = bpe.WordBpe(spec), random.Random(2)
    words = ["".join(draw.choice("abcdefghinorstuéßщ語'") for _ in range(draw.randint(1, 40))) for _ in range(3000)]
    words += ["thththat", "the", "a", "\u00e9", *(mine.names[i].removesuffix(bpe.WORD_END) for i in range(1000, 40000, 97) if mine.names[i].isascii())]
    raw = [w.encode() for w in words]
    flat, sizes = mine.propose_side_by_side(np.frombuffer(b"".join(raw), np.uint8).astype(np.int64), np.array([len(w) for w in raw]))
    assert [p.tolist() for p in np.split(flat, np.cumsum(sizes)[:-1])] == [mine.propose(mine.symbols(w)) for w in words]
    assert [np.frombuffer(b, "<u4").tolist() for b in mine.merge_side_by_side(words)] == [mine.merge(mine.symbols(w)) for w in words]


def test_odd_rows(nasty, empty, spec):
    got = bpe.encode_digest(nasty, spec).collect()
    assert len(got) == nasty.count()
    assert all(r.n_tokens == 0 for r in got if r.doc_id in (0, 1, 2, 11))
    assert bpe.encode(empty, spec, carry=("lang",)).count() == 0


def test_large_ids_beside_nulls(spark, spec):
    from tallyweave.llm import quality, toxicity, urls

    ids = [2**62 + 1, None, 2**53 + 1]
    df = spark.createDataFrame([(i, "some text", "en", "s") for i in ids], "doc_id bigint, text string, lang string, source string").coalesce(1)
    labels = spark.createDataFrame([(2**62 + 1, 1, 0)], "doc_id bigint, quality int, toxic int")
    pages = df.selectExpr("doc_id AS page_id", "'http://a.org/x' AS url", "text AS html")
    found = (bpe.encode(df, spec), toxicity.classify(df, labels), quality.score(df, labels), urls.judge(pages))
    assert all({r[0] for r in got.collect()} == set(ids) for got in found)
