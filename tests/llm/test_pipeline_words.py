"""The pipeline's first stage is the word model of op6, and the later stages work on what it keeps."""

import numpy as np
import test_pipeline
import test_word_quality

import corpus_pipeline as cp


def test_quality_stage_goes_by_words(spark, small_dir):
    """Document 96 says one good word over and over: its characters are those of good texts, its words are not."""
    docs = spark.read.parquet(f"{small_dir}/documents.parquet")
    good = {r.doc_id for r in spark.read.parquet(f"{small_dir}/labels.parquet").where("quality = 1").collect()}
    plain = test_word_quality.brute([(r.doc_id, r.text, r.lang) for r in docs.collect()], good, 2)
    got = sorted(tuple(r) for r in cp.stage_quality(spark, docs, small_dir).collect())
    assert got == sorted(tuple(r) for r in docs.select(*cp.COLUMNS).collect() if plain[r.doc_id][1])
    assert not plain[96][1] and 96 not in {r[0] for r in got}


def test_every_stage_after_words(spark, small_dir, tmp_path, monkeypatch):
    """The stages against plain versions of themselves, the first one's being the plain model of words."""

    def words(rows, good):
        return [(i, p, k) for i, (p, k) in test_word_quality.brute(rows, good, 2).items()]

    monkeypatch.setattr(test_pipeline.plain_quality, "brute_keep", words)
    docs = spark.read.parquet(f"{small_dir}/documents.parquet").select(*cp.COLUMNS)
    good = {r.doc_id for r in spark.read.parquet(f"{small_dir}/labels.parquet").where("quality = 1").collect()}
    want = test_pipeline.plain_pipeline([tuple(r) for r in docs.collect()], good)
    for k, (name, stage) in enumerate(cp.STAGES):
        stage(spark, docs, small_dir).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        if k < 4:
            assert sorted(tuple(r) for r in docs.collect()) == sorted(want[k]), name
    got = {r.doc_id: np.frombuffer(r.ids, "<u4").tolist() for r in docs.collect()}
    assert got == dict(want[4])
    assert sorted(r.doc_id for r in cp.run(spark, small_dir).collect()) == sorted(got)
