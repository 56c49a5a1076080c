import math
import random
import re
import zlib

import numpy as np
import xxhash

from tallyweave.llm import toxicity as tx


def test_held_out_accuracy(spark):
    d = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{d}/labels.parquet")
    got = tx.classify(spark.read.parquet(f"{d}/documents.parquet"), labels).join(labels, "doc_id").where("held_out").collect()
    toxic, clean = [r.score for r in got if r.toxic], [r.score for r in got if not r.toxic]
    wins = sum((a > b) + (a == b) / 2 for a in toxic for b in clean)
    assert wins / (len(toxic) * len(clean)) > 0.8 and sum(s >= 0.5 for s in clean) <= 0.05 * len(clean)


def test_folds_and_scores(spark, small_dir):
    got = tx.query(spark, small_dir).collect()
    for r in got:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5)


def test_held_out_labels_are_not_learnt(spark, small_dir):
    docs = spark.read.parquet(f"{small_dir}/documents.parquet")
    labels = spark.read.parquet(f"{small_dir}/labels.parquet")
    flipped = labels.withColumn("toxic", tx.F.when(tx.held_out_column("doc_id"), 1 - labels.toxic).otherwise(labels.toxic))
    a, b = (sorted(map(tuple, tx.classify(docs, x).collect())) for x in (labels, flipped))
    assert a == b


def plain_places(text):
    h = [xxhash.xxh64_intdigest(w) for w in re.findall(r"\w+", text.lower())]
    whole = (1 << 64) - 1
    mixed = [x * int(tx.UNIT) & whole for x in h]
    mixed += [(a * int(tx.PAIR) & whole) ^ (b * int(tx.UNIT) & whole) for a, b in zip(h, h[1:], strict=False)]
    mixed += [(a * int(tx.SKIP) & whole) ^ (b * int(tx.UNIT) & whole) for a, b in zip(h, h[2:], strict=False)]
    return {m >> 64 - tx.BITS for m in mixed}


def plain_ftrl(rows, epochs=6, alpha=3.0, beta=1.0, l1=4.0, l2=0.1):
    """One coordinate at a time, in dictionaries; -1 is the bias, which is not regularised."""
    z, n = {}, {}

    def weight(i):
        zi, ni = z.get(i, 0.0), n.get(i, 0.0)
        if i == -1:
            return -zi / ((beta + math.sqrt(ni)) / alpha)
        return 0.0 if abs(zi) <= l1 else (math.copysign(l1, zi) - zi) / ((beta + math.sqrt(ni)) / alpha + l2)

    order = np.random.default_rng(7)
    for _ in range(epochs):
        for k in order.permutation(len(rows)):
            places, label = rows[k]
            w = {i: weight(i) for i in (*places, -1)}
            g = 1 / (1 + math.exp(-sum(w.values()))) - label
            if abs(g) < 1e-3:
                continue
            for i, wi in w.items():
                before = n.get(i, 0.0)
                z[i] = z.get(i, 0.0) + g - (math.sqrt(before + g * g) - math.sqrt(before)) / alpha * wi
                n[i] = before + g * g
    return {i: weight(i) for i in z if i >= 0 and weight(i)}, weight(-1)


def test_weights_and_scores_against_plain_ftrl(spark):
    draw = random.Random(5)
    texts = [" ".join(draw.choice(["sun", "sea", "fool", "hill", "Idiot", "tree", "go", "away"]) for _ in range(draw.randint(0, 12))) for _ in range(160)]
    docs = [(i, t, int("idiot" in t.lower())) for i, t in enumerate(texts)]
    df = spark.createDataFrame(docs, "doc_id bigint, text string, toxic int")
    rows = [(plain_places(t), y) for i, t, y in docs if zlib.crc32(str(i).encode()) % 5]
    weights, bias = plain_ftrl(rows)
    at, w, b = tx.train(tx.training_rows(df.select("doc_id", "text"), df.select("doc_id", "toxic"), 10_000, 1 << 20, "doc_id", "text", "toxic"))
    assert weights and dict(zip(at.tolist(), w.tolist(), strict=True)) == {i: tx_close(x) for i, x in weights.items()} and abs(b - bias) < 1e-9
    got = {r.doc_id: r.score for r in tx.classify(df.select("doc_id", "text"), df.select("doc_id", "toxic")).collect()}
    for i, t, _ in docs:
        assert abs(got[i] - 1 / (1 + math.exp(-(bias + sum(weights.get(p, 0.0) for p in plain_places(t)))))) < 1e-9


def tx_close(x):
    import pytest

    return pytest.approx(x, rel=1e-9, abs=1e-12)


def test_the_sample_is_bounded_in_bytes(spark):
    df = spark.createDataFrame([(i, " ".join(f"w{i}x{k}" for k in range(100)), i % 2) for i in range(60)], "doc_id bigint, text string, toxic int")
    whole = tx.training_rows(df, df, 10_000, 1 << 20, "doc_id", "text", "toxic")
    few = tx.training_rows(df, df, 10_000, 12_000, "doc_id", "text", "toxic")
    assert len(few) < len(whole) and 10_000 < sum(p.nbytes for p, _ in few) <= 12_000


def test_training_is_sparse_and_learns():
    hasher = tx.Hasher()
    rows = [(tx.np.unique(hasher.places(f"calm words number {i} and {i * 7} here" + (" idiot" if i % 4 == 0 else ""))), int(i % 4 == 0)) for i in range(400)]
    at, w, bias = tx.train(rows)
    dense = tx.np.zeros(tx.PLACES)
    dense[at] = w
    hit = sum((tx.sigmoid(dense[p].sum() + bias) >= 0.5) == y for p, y in rows)
    assert hit >= 395 and len(at) < 200


def test_odd_rows(nasty, empty, labels):
    got = tx.classify(nasty, labels).collect()
    assert len(got) == nasty.count() and len({r.score for r in got if r.doc_id in (0, 1, 2)}) == 1
    assert all(r.held_out for r in got if r.doc_id is None)
    assert tx.classify(empty, labels).count() == 0
    assert all(r.score == 0.5 for r in tx.classify(nasty, labels.limit(0)).collect())
