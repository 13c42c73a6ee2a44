"""Thin triangles, hot cells, and stations that report often: work per task and exact rows."""

import datetime as dt
import math
import random

import pytest
from pyspark.sql import functions as F

import thermotrack as tt
from thermotrack.operators.interpolation import _maybe_wanted
from thermotrack.operators.leaves import DEEPEST, LEAF_KEY, STEP, TriangleLeaves
from thermotrack.plans import sided_join

T0 = dt.datetime(2025, 6, 28, 10, 3, 0)
CORNERS = "id_triangle long, a struct<station:long,x:double,y:double>, b struct<station:long,x:double,y:double>, c struct<station:long,x:double,y:double>"


def strip(n, turn):
    """2n slivers, a thousand times longer than wide, side by side and turned by an angle."""
    def corner(i, top):
        x, y = i * 0.01, 10.0 * top
        return (2 * i + top + 1, x * math.cos(turn) - y * math.sin(turn), x * math.sin(turn) + y * math.cos(turn))

    rows = []
    for i in range(n):
        rows += [[corner(i, 0), corner(i + 1, 0), corner(i, 1)], [corner(i + 1, 0), corner(i, 1), corner(i + 1, 1)]]
    return [(k, *sorted(r)) for k, r in enumerate(rows, 1)]


def fan(n):
    """Triangles that all meet in one vertex."""
    rim = [(k + 2, math.cos(k / n), math.sin(k / n)) for k in range(n + 1)]
    return [(k + 1, (1, 0.0, 0.0), rim[k], rim[k + 1]) for k in range(n)]


def holds(triangle, x, y):
    (_, ax, ay), (_, bx, by), (_, cx, cy) = triangle[1:]
    signs = [(vx - ux) * (y - uy) - (vy - uy) * (x - ux) for ux, uy, vx, vy in ((ax, ay, bx, by), (bx, by, cx, cy), (cx, cy, ax, ay))]
    return min(signs) >= 0 or max(signs) <= 0


def wide(rows, spark):
    t = spark.createDataFrame(rows, CORNERS)
    t = t.select("id_triangle", *[F.col(f"{v}.{f}").alias(f"{n}_{v}") for v in "abc" for f, n in (("station", "sta"), ("x", "x"), ("y", "y"))])
    return t.withColumn("twice", F.expr("(x_b - x_a) * (y_c - y_a) - (y_b - y_a) * (x_c - x_a)"))


@pytest.mark.parametrize(("turn", "limit"), [(0.0, "157286400"), (math.pi / 6, "157286400"), (0.3, "0")])
def test_slivers(spark, turn, limit):
    rows = strip(80, turn)
    spark.conf.set(sided_join.BROADCAST_SETTING, limit)
    try:
        leaves = TriangleLeaves(wide(rows, spark), len(rows), 10.0, 16)
        assert leaves.pieces.groupBy(*LEAF_KEY).count().agg(F.max("count")).first()[0] <= 16
        assert leaves.pieces.count() == leaves.rows
        r = random.Random(1)
        inner = [(r.random() * 0.79, r.random() * 9.99) for _ in range(400)] + [(0.5, 5.0), (0.4, 0.0), (5.0, 5.0)]
        spots = [(k, x * math.cos(turn) - y * math.sin(turn), x * math.sin(turn) + y * math.cos(turn)) for k, (x, y) in enumerate(inner)]
        points = spark.createDataFrame(spots, "id long, lon double, lat double")
        assert leaves.with_leaf(points, "lon", "lat").count() == len(spots)
        got = {(p.id, p.id_triangle) for p in tt.locate_in_triangles(points, spark.createDataFrame(rows, CORNERS)).collect()}
        want = {(k, t[0]) for k, x, y in spots for t in rows if holds(t, x, y)}
        assert {k for k, _ in got} == set(range(402))
        assert {g for g in got if g[0] < 400} == {w for w in want if w[0] < 400}  # random points: none on an edge
        assert all(got & {w for w in want if w[0] == k} for k in (400, 401))
    finally:
        spark.conf.unset(sided_join.BROADCAST_SETTING)


def test_many_triangles_at_one_vertex(spark):
    rows = fan(100)
    leaves = TriangleLeaves(wide(rows, spark), len(rows), 1.0, 16)
    full = leaves.pieces.groupBy(*LEAF_KEY).count().filter("count > 16").collect()
    assert {f.leaf_level for f in full} == {leaves.first - DEEPEST // STEP * STEP}
    assert max(f["count"] for f in full) == 100 and max(math.hypot(f.leaf_x, f.leaf_y) for f in full) < 40  # beside the vertex
    spots = [(k, 0.3 * math.cos((k + 0.5) / 100), 0.3 * math.sin((k + 0.5) / 100)) for k in range(100)] + [(100, 0.0, 0.0)]
    points = spark.createDataFrame(spots, "id long, lon double, lat double")
    got = tt.locate_in_triangles(points, spark.createDataFrame(rows, CORNERS)).select("id", "id_triangle").collect()
    assert sorted(tuple(g) for g in got if g.id < 100) == [(k, k + 1) for k in range(100)]
    assert sum(g.id == 100 for g in got) == 100


def test_no_triangles(spark):
    none = spark.createDataFrame([], CORNERS)
    points = spark.createDataFrame([(1, 0.0, 0.0), (2, None, 1.0)], "id long, lon double, lat double")
    assert tt.locate_in_triangles(points, none).count() == 0
    one = spark.createDataFrame(strip(1, 0.0), CORNERS)
    assert tt.locate_in_triangles(points, one).count() == 1


def test_hot_key_is_spread_and_cold_keys_are_not_copied(spark):
    spark.conf.set(sided_join.BROADCAST_SETTING, "0")
    try:
        large = spark.range(20_000).select("id", F.when(F.col("id") % 10 != 0, 7).otherwise(F.col("id") % 97).alias("cell"))
        small = spark.range(97).select(F.col("id").alias("cell"), (F.col("id") * 2).alias("value"))
        left, right = sided_join.salted(large, small, ["cell"], "id")
        assert left.count() == 20_000
        assert left.groupBy("cell", "_salt").count().agg(F.max("count")).first()[0] < 1.5 * 20_000 / 8
        copies = {r["cell"]: r["count"] for r in right.groupBy("cell").count().collect()}
        assert copies.pop(7) == 8 and set(copies.values()) == {1}
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        joined = sided_join.join_on_cell(large, small, ["cell"], "id", 97)
        assert joined.count() == 20_000 and joined.filter("value <> 2 * cell").count() == 0
        tasks = joined.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]
        assert tasks < 0.5 * 20_000
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        spark.conf.unset(sided_join.BROADCAST_SETTING)


@pytest.mark.parametrize("limit", ["157286400", "0"])
def test_reports_every_second(spark, limit):
    """All reports of the window, and the latest of them, from stations that report once a second."""
    triangle = spark.createDataFrame([(1, (1, 0.0, 0.0), (2, 2.0, 0.0), (3, 0.0, 2.0))], CORNERS)
    times = [T0 + dt.timedelta(seconds=s) for s in (0, 200, 359, 360, 1000)]
    points = spark.createDataFrame([(k, 0.5, 0.5, t) for k, t in enumerate(times)], "id long, lon double, lat double, timestamp timestamp")
    rows = [(s, T0 + dt.timedelta(seconds=k), float(k), 0.0) for s in (1, 2) for k in range(-400, 400)]
    rows += [(1, T0, 0.5, 1.0), (1, T0, 0.5, None), (4, T0, 9.0, 9.0), (None, T0, 9.0, 9.0), (1, None, 9.0, 9.0)]
    obs = spark.createDataFrame(rows, "numer_sta int, date timestamp, t_ground_0 double, delta_t double")
    located = tt.locate_in_triangles(points, triangle)
    spark.conf.set(sided_join.BROADCAST_SETTING, limit)
    try:
        every = tt.join_station_observations(located, obs, latest_only=False).collect()
        latest = {r.id: r for r in tt.join_station_observations(located, obs).collect()}
    finally:
        spark.conf.unset(sided_join.BROADCAST_SETTING)
    for k, t in enumerate(times):
        want = sorted((r[0], r[2], r[3] is None, r[3] or 0, (t - r[1]).total_seconds() / 360) for r in rows
                      if r[0] in (1, 2) and r[1] and t - dt.timedelta(minutes=6) < r[1] <= t)
        got = sorted((r.station, r.t_ground_0, r.delta_t is None, r.delta_t or 0, r.time_interp_weight) for r in every if r.id == k)
        assert [g[:4] for g in got] == [w[:4] for w in want]
        assert [g[4] for g in got] == pytest.approx([w[4] for w in want])
        if not want:
            assert k not in latest
            continue
        assert latest[k].obs_c is None
        for station, said in ((1, latest[k].obs_a), (2, latest[k].obs_b)):
            last = max((r[1], r[2], -1 if r[3] is None else r[3]) for r in rows if r[0] == station and r[1] and r[1] <= t)
            assert (said.t_ground_0, said.delta_t) == last[1:]
    assert {(r.vertex, r.station) for r in every} == {("a", 1), ("b", 2)}
    assert {round(r.weight, 9) for r in every} == {0.5, 0.25}


@pytest.mark.parametrize(("most", "buckets"), [(1 << 20, 40), (64, 5_000), (2, 40), (1, 3_000_000)])
def test_reports_that_no_pair_wants_are_left_out_before_the_join(spark, most, buckets):
    r = random.Random(most)
    asked = {(r.choice((3, 5, None, 8)), r.randrange(-buckets, buckets)) for _ in range(60)}
    wanted = spark.createDataFrame(sorted(asked, key=str), "_station long, _report_bucket long")
    others = {(s, r.randrange(-buckets, buckets)) for s in range(200) for _ in range(5)}
    reports = spark.createDataFrame(sorted(asked | others, key=str), "_station long, _report_bucket long")
    left = {tuple(row) for row in _maybe_wanted(reports.union(reports), wanted, most).collect()}
    assert asked <= left
    assert left <= asked | others
    if most == 1 << 20:
        assert left == asked
    twice = _maybe_wanted(reports.union(reports), wanted, most).filter("_station = 3").count()
    assert twice == 2 * len({k for k in left if k[0] == 3})
