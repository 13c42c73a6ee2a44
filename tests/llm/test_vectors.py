"""Vector codes and plane clustering: exactness, nulls, ties, repeats, empty tables, clashing names."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from thermotrack.llm.codes import Balls, books_digest, vector_codes, with_group_error
from thermotrack.llm.planes import nearest_planes, pack_planes, plane_kmeans, unpack_planes

KIND = "vec_id bigint, embedding array<double>, label string, codes string, error string, row string, cluster string"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, lab, "c", "e", "r", "k") for i, v, lab in rows], KIND)


def nearest(x, book):
    squares = ((x[:, None, :] - book[None]) ** 2).sum(axis=2)
    return squares.argmin(axis=1), squares.min(axis=1)


def lloyd(x, book, rounds):
    book = book.copy()
    for _ in range(rounds):
        best, _ = nearest(x, book)
        for e in set(best.tolist()):
            book[e] = x[best == e].sum(axis=0) // (best == e).sum()
    return *nearest(x, book), book


@pytest.mark.parametrize("kind", [np.float64, np.int64])
def test_balls_equal_plain_search(kind):
    r = np.random.default_rng(1)
    x = (r.normal(size=(3000, 6)) * 40 + r.integers(0, 9, (3000, 1)) * 150).astype(np.int64)
    x[:200] = x[200:400]  # ties
    book = x[:60].copy()
    book[31] = book[7]  # equal entries: the lower wins
    codes, moved, computed = np.zeros(len(x), np.int64), np.ones(60, bool), []
    for _ in range(12):
        codes, own, n = Balls(book.astype(kind), moved).assign(x.astype(kind), codes)
        best, least = nearest(x, book)
        assert (codes == best).all() and (own == least).all()
        computed.append(n)
        before = book.copy()
        for e in set(codes.tolist()):
            book[e] = x[codes == e].sum(axis=0) // (codes == e).sum()
        moved = (book != before).any(axis=1)
    assert computed[-1] < 0.3 * len(x) * 60  # rings and cores leave most distances out
    still = Balls(book.astype(kind), np.zeros(60, bool))
    codes = nearest(x, book)[0]
    assert still.assign(x.astype(kind), codes)[2] == len(x)  # nothing moved: only the own distances


def test_codes(spark):
    r = np.random.default_rng(2)
    v = r.normal(size=(400, 8)).round(2)
    rows = [(i, v[i].tolist(), "hot" if i % 3 else None) for i in range(400)]
    rows += [(3, v[3].tolist(), "a"), (None, v[5].tolist(), "a"), (900, None, "a"), (901, [1.0, None] * 4, "a"),
             (902, [float("nan")] * 8, "a"), (903, [float("inf")] * 8, "a"), (904, [1.0] * 4, "a"), (905, [], "a")]
    coded, books = vector_codes(frame(spark, rows), parts=4, entries=16, rounds=3, keep=["label", "row", "cluster"])
    got = with_group_error(coded).collect()
    used = sorted((r for r in rows if r[1] and len(r[1]) == 8 and all(c is not None and np.isfinite(c) for c in r[1])),
                  key=lambda r: (r[0] is None, r[0], r[1]))
    assert len(got) == len(used) == 402
    x = np.floor(1024 * np.array([r[1] for r in used])).astype(np.int64)
    want, errors = [], np.zeros(len(x), np.int64)
    for p in range(4):
        best, least, book = lloyd(x[:, 2 * p : 2 * p + 2], x[:16, 2 * p : 2 * p + 2], 3)
        assert (books[p] == book).all()
        want.append(best)
        errors += least
    by_id = {}
    for n, row in enumerate(used):
        by_id.setdefault(row[0], []).append((tuple(w[n] for w in want), errors[n], row[2]))
    for g in got:
        assert (tuple(g.codes), g.error, g.label) in by_id[g.vec_id]
        assert g.label_error == sum(errors[n] for n, row in enumerate(used) if row[2] == g.label)
        assert g.row == "r" and g.cluster == "k"
    assert books_digest(books) == hashlib.sha256(",".join(str(c) for c in books.ravel()).encode()).hexdigest()


def test_codes_of_little(spark):
    empty = frame(spark, [])
    coded, books = vector_codes(empty, keep=["label"])
    assert with_group_error(coded).collect() == [] and books.shape == (4, 0, 0)
    one, books = vector_codes(frame(spark, [(1, [0.5, -0.5, 0.0, 2.0], "a")]))
    assert [(r.codes, r.error) for r in one.collect()] == [([0, 0, 0, 0], 0)]
    assert books.ravel().tolist() == [512, -512, 0, 2048]
    large, _ = vector_codes(frame(spark, [(i, [1e3 * i, 1e5, -1e5 - i, 0.0] * 4, "a") for i in range(40)]), entries=4)
    assert large.count() == 40  # beyond the doubles' exact range
    with pytest.raises(ValueError, match="too large"):
        vector_codes(frame(spark, [(1, [1e300] * 4, "a")]))


def test_sums_of_many_labels_are_shuffled(spark, monkeypatch):
    monkeypatch.setattr("thermotrack.llm.codes.BROADCAST_BYTES", 0)
    rows = [(i, [float(i % 5)] * 4, None if i % 2 else "a") for i in range(20)]
    coded, _ = vector_codes(frame(spark, rows), entries=2, keep=["label"])
    joined = with_group_error(coded)
    assert "SortMergeJoin" in joined._jdf.queryExecution().toString()
    assert {r.label: r.label_error for r in joined.collect()} == {
        r["label"]: r["e"] for r in coded.groupBy("label").agg(F.sum("error").alias("e")).collect()}


def test_planes():
    r = np.random.default_rng(3)
    x = r.integers(0, 300, (50, 64))
    packed = pack_planes(x, 9)
    assert (unpack_planes(packed) == x).all()
    best, squares = nearest_planes(packed, packed[:7])
    want, least = nearest(x, x[:7])
    assert (best == want).all() and (squares == least).all()


def test_plane_kmeans(spark):
    r = np.random.default_rng(4)
    v = r.normal(size=(300, 64)).round(2)
    rows = [(i, v[i].tolist(), "a") for i in range(300)]
    rows += [(7, v[7].tolist(), "a"), (7, v[8].tolist(), "a"), (None, v[9].tolist(), "a"), (900, None, "a"),
             (901, [None] + [1.0] * 63, "a"), (902, [float("nan")] * 64, "a"), (903, [1.0] * 63, "a"), (904, [], "a")]
    got = plane_kmeans(frame(spark, rows), k=5, rounds=3)
    used = sorted(rows[:303], key=lambda r: (hashlib.sha256(f"1:{'null' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))
    x = np.floor(64 * np.array([r[1] for r in used])).astype(np.int64)
    best, least, book = lloyd(x, x[:5], 3)
    want = sorted(((r[0] is None, r[0] or 0), best[n], least[n], least[best == best[n]].sum(), least.sum(), book[best[n]].tolist())
                  for n, r in enumerate(used))
    found = got.collect()
    assert sorted(((r.vec_id is None, r.vec_id or 0), r.cluster, r.distance, r.cluster_inertia, r.inertia, r.centroid) for r in found) == want
    assert {(r.codes, r.error, r.row) for r in found} == {("c", "e", "r")}


def test_plane_kmeans_of_little(spark):
    assert plane_kmeans(frame(spark, [])).collect() == []
    same = plane_kmeans(frame(spark, [(i, [0.25] * 64, "a") for i in range(30)])).collect()
    assert {(r.cluster, r.distance, r.inertia) for r in same} == {(0, 0, 0)}
    with pytest.raises(ValueError, match="too far apart"):
        plane_kmeans(frame(spark, [(1, [0.0] * 64, "a"), (2, [1e9] * 64, "a")]))
