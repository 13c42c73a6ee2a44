"""The trained operators against plain definitions, and the blocks that bound their memory."""

import math
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from thermotrack.llm import hashing, minhash, quality, toxicity

SF = "/root/testdata/sf0.001"


def plain_toxicity(text, model):
    product = 1.0
    for sentence in re.split(r"[.!?\n]", (text or "").lower()):
        words = set(re.findall(r"[^\W_]+", sentence))
        if words:
            features = toxicity._Features()
            z = model.bias + sum(model.weights.get(f, 0.0) for w in words for f in features[w])
            product *= 1 - 1 / (1 + math.exp(-z))
    return 1 - product


def test_noisy_or_of_every_document(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    model = toxicity.fit_toxicity(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    rows = toxicity.score_toxicity(docs, model).collect()
    assert len(rows) == 200 and any(r.is_toxic for r in rows)
    for r in rows:
        assert r.toxicity == pytest.approx(plain_toxicity(r.text, model), abs=1e-9)
        for s in r.toxic_spans:
            assert plain_toxicity(r.text[s.begin : s.end], model) == pytest.approx(s.score, abs=1e-9)


def test_gradient_of_the_likelihood():
    r = np.random.default_rng(5)
    sentences = np.array([2, 1, 3, 1])
    counts = r.integers(1, 5, sentences.sum())
    place = r.integers(0, 6, counts.sum()).astype(np.int32)
    labels, weights, bias = np.array([1.0, 0, 1, 0]), r.normal(size=6), -0.4
    importance = np.array([0.3, 0.7])

    def loss(w, b):
        total, at, sentence = 0.0, 0, 0
        for y, n in zip(labels, sentences, strict=True):
            keep = 1.0
            for _ in range(n):
                z = b + w[place[at : at + counts[sentence]]].sum()
                keep *= 1 - 1 / (1 + math.exp(-z))
                at += counts[sentence]
                sentence += 1
            total -= importance[int(y)] * math.log(1 - keep if y else keep)
        return total

    got = toxicity.block_gradient((labels, place, counts, sentences), weights, bias, importance)
    eps = 1e-6
    for k in range(6):
        step = np.eye(6)[k] * eps
        assert got[k] == pytest.approx((loss(weights + step, bias) - loss(weights - step, bias)) / (2 * eps), abs=1e-6)
    assert got[6] == pytest.approx((loss(weights, bias + eps) - loss(weights, bias - eps)) / (2 * eps), abs=1e-6)


def test_training_blocks_give_the_same_model(spark, monkeypatch):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    whole = toxicity.fit_toxicity(docs, labels)
    monkeypatch.setattr(toxicity, "BLOCK_FEATURES", 2000)
    monkeypatch.setattr(toxicity, "BLOCK_BYTES", 1 << 12)
    blocked = toxicity.fit_toxicity(docs, labels)
    assert blocked.bias == pytest.approx(whole.bias, abs=1e-4) and len(blocked.weights) > 10
    texts = [r.text for r in docs.select("text").collect()]
    a, b = ([plain_toxicity(t, m) for t in texts] for m in (whole, blocked))
    assert a == pytest.approx(b, abs=1e-3)


def test_discriminant(spark):
    """Class means and shrunk covariances of all learned rows, and the difference of their log-densities."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    known = {r.doc_id: r.quality for r in labels.collect()}
    features = quality.document_statistics(docs)
    rows = {r.doc_id: np.array(r.features) for r in features.collect()}
    learned = [(rows[i], y) for i, y in known.items() if i in rows and zlib.crc32(str(i).encode()) % 4 != 2]
    x, y = np.array([f for f, _ in learned]), np.array([c for _, c in learned])
    parts = [x[y == c] for c in (0, 1)]
    means = [p.mean(axis=0) for p in parts]
    own = [np.cov(p.T, bias=True) for p in parts]
    pooled = sum(len(p) * c for p, c in zip(parts, own, strict=True)) / len(x)
    unit = np.sqrt(np.maximum(np.diag(pooled), 1e-8))
    s = quality.SHRINKAGE

    def log_density(f, c):
        scaled = (1 - s) * own[c] / np.outer(unit, unit) + s * (0.5 * pooled / np.outer(unit, unit) + 0.5 * np.eye(len(unit)))
        d = (f - means[c]) / unit
        return math.log(len(parts[c]) / len(x)) - 0.5 * np.linalg.slogdet(scaled)[1] - 0.5 * d @ np.linalg.solve(scaled, d)

    got = {r.doc_id: r.quality for r in quality.quality_of(docs, labels).collect()}
    for i, f in rows.items():
        gap = log_density(f, 0) - log_density(f, 1)
        want = 1 / (1 + math.exp(min(max(gap, -500), 500)))
        assert got[i] == pytest.approx(want, abs=1e-6)


def test_models_of_repeated_ids_and_odd_rows(spark):
    docs = spark.createDataFrame([(1, "a bad text. more"), (1, "a bad text. more"), (1, "other"), (None, "x"), (2, None), (3, "")],
                                 "doc_id bigint, text string").withColumn("quality", F.lit("mine")).withColumn("toxicity", F.lit("own"))
    labels = spark.createDataFrame([(1, 1, 1), (1, 0, 0), (2, 0, 0), (None, 1, 1)], "doc_id bigint, quality int, toxic int")
    assert quality.quality_of(docs, labels).count() == 6
    model = toxicity.ToxicityModel()
    assert toxicity.score_toxicity(docs, model).count() == 6
    assert quality.quality_of(docs.limit(0), labels).count() == 0


def test_counts_of_templated_pages_are_bounded(monkeypatch):
    """Many small sets that share most of their shingles: counted in blocks, with the same links."""
    r = np.random.default_rng(6)
    base = r.integers(0, 2**62, 3)
    sets = [np.sort(np.concatenate([base, r.integers(0, 40, 2)])).tolist() for _ in range(300)]
    table = pa.table({"set_id": pa.array([str(n).zfill(4).encode() for n in range(300)], pa.binary()),
                      "root": pa.array([str(n).zfill(4).encode() for n in range(300)], pa.binary()),
                      "shingles": pa.array([sorted(set(s)) for s in sets], pa.list_(pa.int64()))})
    strays, others = table.slice(0, 200), table.slice(200)
    want = minhash._links_between(strays, others, 75)
    cells = []
    zeros = np.zeros

    def counted(shape, *a, **k):
        if isinstance(shape, tuple) and len(shape) == 2:
            cells.append(math.prod(shape))
        return zeros(shape, *a, **k)

    monkeypatch.setattr(minhash, "BLOCK_CELLS", 1000)
    monkeypatch.setattr(minhash.np, "zeros", counted)
    assert minhash._links_between(strays, others, 75) == want and len(want[0]) > 50
    assert max(cells) <= 1000 and len(cells) == 20


def test_tasks_remember_few_words():
    words = [f"w{i}" for i in range(2 * hashing.REMEMBERED)]
    weights = toxicity._Weights(toxicity.ToxicityModel(-6.0, {toxicity._Features()["w7"][0]: 2.0}))
    hashes = hashing.WordHashes()
    for word in words:
        weights[word], hashes[word.encode()]
    assert max(map(len, (weights, weights.features, hashes))) <= hashing.REMEMBERED + 4 <= 1 << 17
    assert weights["w7"] == 2.0 and weights["."] == float("inf")
    assert hashes[b"w7"] == hashing.WordHashes()[b"w7"]


def test_released_keeps_the_batches():
    assert list(hashing.released(lambda batches: (b + 1 for b in batches))([1, 2, 3])) == [2, 3, 4]
