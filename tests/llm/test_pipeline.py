"""The stages against plain versions of themselves, each on what the one before kept."""

import numpy as np
import pytest
import test_jaccard as plain_jaccard
import test_mixing as plain_mixing
import test_quality as plain_quality
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline as cp
from tallyweave.llm import bpe, mixing
from tallyweave.llm import registry as corpus

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_lines(rows, min_chars=40, min_docs=5):
    key = lambda s: s.strip(" \t\n\x0b\x0c\r").translate(LOWER)
    held = {}
    for r in rows:
        for s in {key(s) for s in (r[1] or "").split("\n")}:
            if len(s) >= min_chars:
                held.setdefault(s, set()).add(r[0])
    keeper = {k: max(d) for k, d in held.items() if len(d) >= min_docs}
    out = []
    for i, t, lang, source, _ in rows:
        text = "\n".join(s for s in (t or "").split("\n") if keeper.get(key(s), i) <= i)
        out.append((i, text, lang, source, len(text)))
    return out


def plain_pipeline(rows, good):
    keep = {i for i, _, k in plain_quality.brute_keep([(r[0], r[1], r[2]) for r in rows], good) if k}
    rows = [r for r in rows if r[0] in keep]
    stages = [rows]
    rows = plain_lines(rows)
    stages.append(rows)
    classes = {i: c for i, _, c in plain_jaccard.brute([(r[0], r[1]) for r in rows], 5, 80)}
    rows = [r for r in rows if classes[r[0]] == r[0]]
    stages.append(rows)
    import zlib

    domain = lambda s: mixing.DOMAINS[zlib.crc32(s.encode()) % len(mixing.DOMAINS)]
    taken = {i for i, _, c in plain_mixing.brute([r[:4] for r in rows], cp.MIX_SHARE, 1, mixing.PRODUCTION, 17, domain) if c}
    rows = [r for r in rows if r[0] in taken]
    stages.append(rows)
    lib = Tokenizer.from_file(bpe.default_tokenizer())
    stages.append([(r[0], lib.encode(r[1], add_special_tokens=False).ids) for r in rows])
    return stages


def test_every_stage(spark, small_dir, tmp_path):
    docs = spark.read.parquet(f"{small_dir}/documents.parquet").select(*cp.COLUMNS)
    good = {r.doc_id for r in spark.read.parquet(f"{small_dir}/labels.parquet").where("quality = 1").collect()}
    want = plain_pipeline([tuple(r) for r in docs.collect()], good)
    assert len(want[0]) < docs.count() and len(want[2]) < len(want[1]) and len(want[3]) < len(want[2])  # decisions take effect
    for k, (name, stage) in enumerate(cp.STAGES):
        stage(spark, docs, small_dir).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        if k < 4:
            assert tuple(docs.columns) == cp.COLUMNS
            assert sorted(tuple(r) for r in docs.collect()) == sorted(want[k]), name
    got = {r.doc_id: np.frombuffer(r.ids, "<u4").tolist() for r in docs.collect()}
    assert got == dict(want[4])
    assert sorted(r.doc_id for r in cp.run(spark, small_dir).collect()) == sorted(got)


@pytest.mark.parametrize("k", range(5))
def test_odd_rows(spark, nasty, empty, small_dir, k):
    stage = cp.STAGES[k][1]
    got = stage(spark, nasty, small_dir)
    assert 0 < got.count() <= nasty.count()
    assert stage(spark, empty, small_dir).count() == 0
    if k < 4:
        assert tuple(got.columns) == cp.COLUMNS


def test_registry(spark):
    names = set(corpus.queries())
    assert {n.split("_")[0] for n in names} == {*(f"op{i}" for i in range(1, 11)), "pipeline"}
    assert set(corpus.oracle_sql()) <= names
    assert spark.range(1).select(F.lit(1)).count() == 1


@pytest.mark.parametrize("name", sorted(corpus.oracle_sql()))
def test_twins(name, spark, small_dir):
    import sys
    from pathlib import Path

    sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
    from oracle import bags, connect

    got, want = bags(corpus.queries()[name], corpus.oracle_sql()[name], spark, small_dir, connect(small_dir))
    assert got == want
