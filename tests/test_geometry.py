import datetime as dt
import math
import random

import pytest
from pyspark.sql import functions as F

import thermotrack as tt
from thermotrack.functions.delaunay import _curve_order, local_delaunay
from thermotrack.functions.overlap import buffer_area
from thermotrack.operators import landcover, triangulation
from thermotrack.plans import sided_join

T0 = dt.datetime(2025, 6, 28, 10, 3, 0)


def stations(spark, places):
    rows = [(k, float(x), float(y)) for k, (x, y) in places.items()]
    return spark.createDataFrame(rows, "numer_insee long, lon double, lat double")


def triples(triangles):
    return sorted((r["a"]["station"], r["b"]["station"], r["c"]["station"]) for r in triangles.collect())


def spots(kind, n):
    rng = random.Random(n)
    if kind == "random":
        return {k: (rng.random(), rng.random()) for k in range(n)}
    if kind == "grid":
        side = int(math.sqrt(n))
        order = rng.sample(range(side * side), side * side)
        return {i: (float(k % side), float(k // side)) for i, k in enumerate(order)}
    dense = n // 3
    return {
        k: (0.3 + rng.random() * 1e-4, 0.6 + rng.random() * 1e-4) if k < dense else (rng.random(), rng.random())
        for k in range(n)
    }


@pytest.mark.parametrize("kind", ["random", "grid", "dense"])
def test_tiles_give_the_same_triangles(spark, kind):
    df = stations(spark, spots(kind, 300))
    whole = triples(tt.delaunay_triangles(df, tile_points=1000))
    tiled = tt.delaunay_triangles(df, tile_points=40)
    assert triples(tiled) == whole
    assert sorted(r[0] for r in tiled.select("id_triangle").collect()) == list(range(1, len(whole) + 1))


@pytest.mark.parametrize("kind", ["arc", "circle", "dense"])
def test_no_tile_over_all(spark, monkeypatch, kind):
    """The largest tile, halo included, stays small where all stations see each other or lie in one town."""
    rounds = []
    whole = triangulation.TileRounds.triangles
    monkeypatch.setattr(triangulation.TileRounds, "triangles", lambda self: rounds.append(self) or whole(self))
    turn = {"arc": 1 / 300, "circle": 2.1}.get(kind)
    n = 160 if turn else 300
    places = {k: (math.cos(k * turn), math.sin(k * turn)) for k in range(n)} if turn else spots("dense", n)
    got = triples(tt.delaunay_triangles(stations(spark, places), tile_points=15))
    local, _ = local_delaunay(list(places), *zip(*places.values(), strict=True))
    assert got == sorted(tuple(sorted(t)) for t in local)
    sizes = [m.groupBy("leaf", "tx", "ty").count().agg(F.count("*"), F.max("count")).first() for m in rounds[0].members]
    assert sizes[0][0] >= 8
    assert max(most for _, most in sizes) <= 15 + 16 + 8 * math.sqrt(15) + 25


def test_default_tiles_follow_the_number_of_stations(spark, monkeypatch):
    rounds = []
    whole = triangulation.TileRounds.triangles
    monkeypatch.setattr(triangulation.TileRounds, "triangles", lambda self: rounds.append(self) or whole(self))
    tt.delaunay_triangles(stations(spark, spots("random", 100)))
    assert rounds[0].members[0].select("leaf", "tx", "ty").distinct().count() >= 8


def test_stations_in_line_and_alone(spark):
    """Tiles of one station, and tiles whose stations lie in line."""
    rng = random.Random(2)
    cross = {k: (k - 20.0, 0.0) if k < 40 else (0.5, k - 60.25) for k in range(80)}
    far = {k: (10.0 ** rng.randrange(6) * rng.random(), 10.0 ** rng.randrange(6) * rng.random()) for k in range(60)}
    for places, tile in ((cross, 4), (far, 1)):
        local, _ = local_delaunay(list(places), *zip(*places.values(), strict=True))
        got = triples(tt.delaunay_triangles(stations(spark, places), tile_points=tile))
        assert got == sorted(tuple(sorted(t)) for t in local)


def test_square_grid_is_covered_once(spark):
    triangles = tt.delaunay_triangles(stations(spark, spots("grid", 100)))
    area = sum(
        abs((r["b"]["x"] - r["a"]["x"]) * (r["c"]["y"] - r["a"]["y"]) - (r["b"]["y"] - r["a"]["y"]) * (r["c"]["x"] - r["a"]["x"])) / 2
        for r in triangles.collect()
    )
    assert area == pytest.approx(81.0) and triangles.count() == 2 * 100 - 2 - 36


def test_few_or_collinear_stations(spark):
    assert tt.delaunay_triangles(stations(spark, {1: (0, 0), 2: (1, 1)})).count() == 0
    assert tt.delaunay_triangles(stations(spark, {k: (k, 2 * k) for k in range(6)})).count() == 0
    doubled = {3: (0, 0), 1: (0, 0), 5: (1, 0), 7: (0, 1)}
    assert triples(tt.delaunay_triangles(stations(spark, doubled))) == [(1, 5, 7)]


SQUARE = {1: (0, 0), 2: (1, 0), 3: (0, 1), 4: (1.0, 1.1)}


def sensor(spark, places):
    rows = [(k, x, y, T0, 20.0, 100.0) for k, (x, y) in enumerate(places)]
    return spark.createDataFrame(
        rows, "id long, lon double, lat double, timestamp timestamp, temperature double, elevation double"
    )


def observations(spark, rows):
    return spark.createDataFrame(rows, "numer_sta int, date timestamp, t_ground_0 double, delta_t double")


def test_vertices_and_station_ids(spark):
    triangles = tt.delaunay_triangles(stations(spark, SQUARE))
    vertices = tt.triangle_vertices(triangles, closed=True)
    assert vertices.filter("id_pt = 1").count() == 2 and vertices.filter("id_pt = 4").count() == 2
    again = tt.attach_station_id(vertices, stations(spark, SQUARE))
    assert again.select(*vertices.columns).exceptAll(vertices).count() == 0


@pytest.mark.parametrize("limit", [1_000_000, -1])
def test_shared_edges_and_vertices(spark, monkeypatch, limit):
    monkeypatch.setattr(sided_join, "BROADCAST_BYTES", limit)
    triangles = tt.delaunay_triangles(stations(spark, SQUARE))
    points = sensor(spark, [(0.5, 0.5), (1.0, 0.0), (0.2, 0.2), (0.0, 0.5), (2.0, 2.0), (0.9, 0.9)])
    every = tt.locate_in_triangles(points, triangles)
    counts = {r["id"]: r["count"] for r in every.groupBy("id").count().collect()}
    assert counts == {0: 2, 1: 2, 2: 1, 3: 1, 5: 1}
    picked = {r["id"]: r["id_triangle"] for r in tt.pick_one_per_id(every).collect()}
    single = tt.locate_in_triangles(points, triangles, one_per_point=True).collect()
    assert {r["id"]: r["id_triangle"] for r in single} == picked and len(single) == 5


def test_plane_window_and_missing_reports(spark):
    triangles = tt.delaunay_triangles(stations(spark, {1: (0, 0), 2: (2, 0), 3: (0, 2)}))
    points = sensor(spark, [(0.5, 0.5)])
    at = T0 - dt.timedelta(seconds=180)

    def run(rows):
        return tt.interpolate_temperature(points, triangles, observations(spark, rows)).collect()

    plane = [(1, at, 10.0, 1.0), (2, at, 14.0, 1.0), (3, at, 12.0, 3.0)]
    value = 10 + 2 * 0.5 + 1 * 0.5 + 0.5 * (1 + 0.5) - 0.65
    assert run(plane)[0]["t_inter"] == pytest.approx(value)
    assert run(plane)[0]["diff_temperature"] == pytest.approx(20 - value)
    older = [(s, T0 - dt.timedelta(seconds=300), 99.0, 9.0) for s in (1, 2, 3)]
    assert run(plane + older)[0]["t_inter"] == pytest.approx(value)
    too_old = [(s, T0 - dt.timedelta(seconds=360), 5.0, 0.0) for s in (1, 2, 3)]
    future = [(s, T0 + dt.timedelta(seconds=1), 5.0, 0.0) for s in (1, 2, 3)]
    assert run(too_old + future) == []
    assert run(plane[:2])[0]["t_inter"] is None
    now = [(s, T0, 7.0, 50.0) for s in (1, 2, 3)]
    assert run(now)[0]["t_inter"] == pytest.approx(7 - 0.65)


def polygons(spark, shapes):
    rows = [(k, c, [[(float(x), float(y)) for x, y in ring] for ring in rings]) for k, c, rings in shapes]
    return spark.createDataFrame(
        rows, "poly_id long, lcz_primary int, rings_3857 array<array<struct<x: double, y: double>>>"
    )


def box(x0, y0, x1, y1):
    return [(x0, y0), (x1, y0), (x1, y1), (x0, y1), (x0, y0)]


def centre(spark, places):
    rows = [(k, float(x), float(y), 1.0) for k, (x, y) in enumerate(places)]
    return spark.createDataFrame(rows, "id long, x3857 double, y3857 double, temperature double")


def inside(ring, x, y):
    hit = False
    for (ax, ay), (bx, by) in zip(ring, ring[1:] + ring[:1], strict=True):
        if (ay > y) != (by > y) and x < (bx - ax) * (y - ay) / (by - ay) + ax:
            hit = not hit
    return hit


def in_buffer(x, y, quad_segs):
    if quad_segs is None:
        return x * x + y * y <= 1e4
    step = math.pi / 2 / quad_segs
    mid = (math.floor(math.atan2(y, x) / step) + 0.5) * step
    return x * math.cos(mid) + y * math.sin(mid) <= 100 * math.cos(step / 2)


CONCAVE = [(-70, -150), (180, -60), (20, 10), (150, 130), (-20, 60), (-160, 140), (-60, -10)]


@pytest.mark.parametrize("quad_segs", [8, None, 2])
@pytest.mark.parametrize("turned", [False, True])
def test_concave_polygon_with_hole(spark, quad_segs, turned):
    hole = [(-40, -60), (30, -50), (0, -5)]
    rings = [CONCAVE[::-1] if turned else CONCAVE, hole]
    got = tt.overlap_fraction(centre(spark, [(0, 0)]), polygons(spark, [(1, 3, rings)]), quad_segs=quad_segs)
    step = 0.5
    n = int(100 / step)
    grid = [((i + 0.5) * step, (j + 0.5) * step) for i in range(-n, n) for j in range(-n, n)]
    hits = sum(in_buffer(x, y, quad_segs) and inside(CONCAVE, x, y) and not inside(hole, x, y) for x, y in grid)
    assert got.first()["lcz_fraction"] == pytest.approx(hits * step * step / buffer_area(100, quad_segs), abs=2e-3)


@pytest.mark.parametrize("quad_segs", [8, None])
def test_full_tiling_sums_to_one(spark, quad_segs):
    rng = random.Random(3)
    xs = sorted({-700.0, 700.0, *[rng.uniform(-600, 600) for _ in range(9)]})
    shapes = [
        (10 * i + j, 1 + (i + j) % 5, [box(xs[i], xs[j], xs[i + 1], xs[j + 1])])
        for i in range(len(xs) - 1)
        for j in range(len(xs) - 1)
    ]
    points = centre(spark, [(rng.uniform(-500, 500), rng.uniform(-500, 500)) for _ in range(40)] + [(xs[3], xs[4])])
    rows = tt.lcz_fractions(points, polygons(spark, shapes), ["temperature"], quad_segs=quad_segs).collect()
    assert len(rows) == 41
    for r in rows:
        assert sum(r[f"lcz_{c}"] for c in landcover.LCZ_CLASSES) == pytest.approx(1.0, abs=1e-9)
        assert r["lcz_urban"] == pytest.approx(1.0, abs=1e-9)


def test_ties_touch_and_unlisted_class(spark):
    shapes = [
        (1, 102, [box(-300, -300, 0, 300)]),
        (2, 5, [box(0, -300, 300, 300)]),
        (3, 7, [box(1100, -300, 1300, 300)]),
        (4, 300, [box(2000, -300, 2300, 300)]),
        (5, 8, [box(2150, 0, 2300, 300)]),
    ]
    points = centre(spark, [(0, 0), (1000, 0), (2150, 0), (9000, 0)])
    rows = {r["id"]: r for r in tt.lcz_fractions(points, polygons(spark, shapes), ["temperature"]).collect()}
    assert set(rows) == {0, 2}
    assert (rows[0]["lcz_primary_max"], rows[0]["lcz_primary_max_2"]) == (5, 102)
    assert rows[0]["lcz_vegetation"] == pytest.approx(0.5) and rows[0]["lcz_5"] == pytest.approx(0.5)
    assert (rows[2]["lcz_primary_max"], rows[2]["lcz_primary_max_2"]) == (300, 8)
    assert rows[2]["lcz_urban"] == pytest.approx(0.25)


@pytest.mark.parametrize("change", ["shuffled", "many classes"])
def test_other_ways_give_the_same_fractions(spark, monkeypatch, change):
    rng = random.Random(8)
    shapes = [
        (k, rng.choice([1, 2, 101, 106, 107, 400]), [box(x, y, x + rng.uniform(20, 300), y + rng.uniform(20, 300))])
        for k, (x, y) in enumerate((rng.uniform(-500, 500), rng.uniform(-500, 500)) for _ in range(60))
    ]
    points = centre(spark, [(rng.uniform(-600, 600), rng.uniform(-600, 600)) for _ in range(50)])
    layer = polygons(spark, shapes)

    def run():
        rows = tt.lcz_fractions(points, layer, ["temperature"]).collect()
        return {r["id"]: [round(v, 9) if isinstance(v, float) else v for v in r] for r in rows}

    expected = run()
    if change == "shuffled":
        monkeypatch.setattr(sided_join, "BROADCAST_BYTES", -1)
        assert run() == expected
    else:
        overlaps = tt.overlap_fraction(points, layer)
        steps = tt.pivot_classes(tt.rank_classes(tt.fraction_by_class(overlaps)))
        rows = points.select("id", "x3857", "y3857", "temperature").join(steps, "id").collect()
        assert {r["id"]: [round(v, 9) if isinstance(v, float) else v for v in r] for r in rows} == expected


def test_degrees_are_projected(spark):
    half = 1000 / 6378137 * 180 / math.pi
    rows = [(1, 4, [[(2 - half, 0.0), (2.0, 0.0), (2.0, half), (2 - half, half)]])]
    layer = spark.createDataFrame(rows, "poly_id long, lcz_primary int, rings array<array<struct<x: double, y: double>>>")
    points = spark.createDataFrame([(1, 2.0, 0.0, 3.5)], "id long, lon double, lat double, temperature double")
    row = tt.lcz_fractions(points, layer, ["temperature"]).first()
    assert row["lcz_4"] == pytest.approx(0.25) and (row["lon"], row["temperature"]) == (2.0, 3.5)


def test_required_arguments(spark):
    points, layer = centre(spark, [(0, 0)]), polygons(spark, [(1, 1, [box(0, 0, 1, 1)])])
    for bad in ((None, layer, ["temperature"]), (points, None, ["temperature"]), (points, layer, [])):
        with pytest.raises(ValueError):
            tt.lcz_fractions(*bad)


def test_leaves_follow_density(spark):
    """A third of the stations in one small place is cut into tiles of its own."""
    df = stations(spark, spots("dense", 600)).select(F.col("lon").alias("x"), F.col("lat").alias("y"), F.col("numer_insee").alias("id"))
    extent = df.agg(F.count("*").alias("n"), F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1")).first()
    sizes = triangulation.leaf_tiles(df, extent, 50).groupBy("leaf", "cx", "cy").count()
    assert triangulation.leaf_tiles(df, extent, 50).agg(F.max("leaf")).first()[0] > 8
    assert sizes.agg(F.max("count")).first()[0] <= 50


@pytest.mark.parametrize("quad_segs", [8, None])
def test_polygons_that_only_touch(spark, quad_segs):
    far = [(-900, -900), (900, -900), (900, 900), (-900, 900)]
    slanted = 100 * math.cos(math.pi / 32) if quad_segs else 100.0  # a corner on a side of the buffer, or its circle
    corner = (slanted * math.cos(5.5 * math.pi / 16), slanted * math.sin(5.5 * math.pi / 16))
    shapes = [
        (1, 1, [box(100, -50, 300, 50)]),  # by an edge
        (2, 2, [box(-300, 0, -100, 10)]),  # by a corner of the buffer
        (3, 3, [box(100.001, -50, 300, 50)]),
        (4, 4, [far, box(-100, -100, 100, 100)]),  # the buffer fills its hole
        (5, 5, [far, box(-101, -101, 101, 101)]),  # and lies inside this one
        (6, 6, [[corner, (500, 600), (400, 700)]]),
        (7, 7, [[(corner[0] + 0.001, corner[1]), (500, 600), (500, 601)]]),
        (8, 8, [[(-500, 150), (500, 150), (500, 900), (400, 900), (400, 160), (-400, 160), (-400, 900), (-500, 900)]]),
        (9, 9, [box(-5, -5, 5, 5)]),
        (10, 10, [far]),
        (11, None, [box(-100, -300, 100, -100)]),
    ]
    points, layer = centre(spark, [(0, 0), (5000, 0)]), polygons(spark, shapes)
    pairs = {(r.id, r.poly_id) for r in tt.intersecting_polygons(points, layer, quad_segs=quad_segs, touch=None).collect()}
    assert pairs == {(0, k) for k in (1, 2, 4, 6, 9, 10, 11)}
    shares = {r.poly_id: r.lcz_fraction for r in tt.overlap_fraction(points, layer, quad_segs=quad_segs, touch=None).collect()}
    assert all(shares[k] == pytest.approx(0, abs=1e-12) and shares[k] >= 0 for k in (1, 2, 6, 11))
    assert shares[4] == pytest.approx(0, abs=1e-9)
    assert {r.poly_id for r in tt.intersecting_polygons(points, layer, quad_segs=quad_segs).collect()} == {9, 10}


def test_touching_polygons_count_for_points_without_others(spark):
    shapes = [(1, 102, [box(100, -50, 300, 50)]), (2, 5, [box(900, -50, 1050, 50)]), (3, 7, [box(1100, -5, 1200, 5)])]
    points, layer = centre(spark, [(0, 0), (1000, 0), (5000, 0)]), polygons(spark, shapes)
    rows = {r["id"]: r for r in tt.lcz_fractions(points, layer, ["temperature"], touch=None).collect()}
    assert set(rows) == {0, 1}
    assert (rows[0]["lcz_primary_max"], rows[0]["lcz_primary_max_2"]) == (102, None)
    assert rows[0]["lcz_102"] == pytest.approx(0, abs=1e-12)
    assert (rows[1]["lcz_primary_max"], rows[1]["lcz_primary_max_2"]) == (5, 7)
    assert {r["id"] for r in tt.lcz_fractions(points, layer, ["temperature"]).collect()} == {1}


@pytest.mark.parametrize("quad_segs", [8, None])
def test_large_ring_is_cut_in_halves(spark, quad_segs):
    """A ring of 10**5 corners, a coast with bays: no row keeps more than its cell's share of it."""
    n, size = 100_000, 20_000.0
    ring = [
        (size * (1 + 0.2 * math.sin(40 * a)) * math.cos(a), size * (1 + 0.2 * math.sin(40 * a)) * math.sin(a))
        for a in (2 * math.pi * k / n for k in range(n))
    ]
    layer = polygons(spark, [(1, 3, [ring, box(-500, -500, 500, 500)])])
    turned = layer.select("poly_id", "lcz_primary", F.explode("rings_3857").alias("ring"))
    pieces = landcover._cell_pieces(turned, ("poly_id", "lcz_primary"), 200.0, 100, 100.1)
    pieces = pieces.withColumn("task", F.spark_partition_id())
    most, tasks = pieces.agg(F.max(F.size("ring")), F.count_distinct("task")).first()
    assert most < 2000 and tasks > 1
    a = 0.7853
    at = size * (1 + 0.2 * math.sin(40 * a))
    points = centre(spark, [(1000, 1000), (0, 0), (at * math.cos(a), at * math.sin(a)), (40_000, 0)])
    got = {r.id: r.lcz_fraction for r in tt.overlap_fraction(points, layer, quad_segs=quad_segs).collect()}
    assert set(got) == {0, 2} and got[0] == pytest.approx(1.0)
    x, y = at * math.cos(a), at * math.sin(a)
    near = [p for p in ring if math.hypot(p[0] - x, p[1] - y) < 1000]
    grid = [(i * 4.0 + 2, j * 4.0 + 2) for i in range(-25, 25) for j in range(-25, 25)]
    inner = [(u, v) for u, v in grid if in_buffer(u, v, quad_segs)]
    hits = sum(inside([*near, (0.0, 0.0)], x + u, y + v) for u, v in inner)
    assert got[2] == pytest.approx(hits / len(inner), abs=0.02)


@pytest.mark.parametrize("limit", ["157286400", "0"])
def test_tasks_of_land_cover_follow_the_number_of_points(spark, monkeypatch, limit):
    square = [(0.0, 0.0), (900.0, 0.0), (900.0, 900.0), (0.0, 900.0), (0.0, 0.0)]
    polygons = spark.createDataFrame([(1, 3, [square])], "poly_id long, lcz_primary int, rings_3857 array<array<struct<x:double,y:double>>>")
    points = spark.range(600).select("id", (F.col("id") % 30 * 30.0).alias("x3857"), (F.col("id") * 1.5).alias("y3857"))
    spark.conf.set(sided_join.BROADCAST_SETTING, limit)
    try:
        whole = sorted(tt.overlap_fraction(points, polygons).collect())
        monkeypatch.setattr(landcover, "TASK_POINTS", 20)
        areas = landcover._areas(points, polygons, 100.0, 8)
        per_task = areas.select("id", F.spark_partition_id().alias("task")).distinct().groupBy("task").count()
        assert per_task.agg(F.max("count")).first()[0] <= 150
        assert per_task.count() > int(spark.conf.get("spark.sql.shuffle.partitions"))
        dealt = sorted(tt.overlap_fraction(points, polygons).collect())
    finally:
        spark.conf.unset(sided_join.BROADCAST_SETTING)
    assert [r[:3] for r in dealt] == [r[:3] for r in whole]
    assert [r[3] for r in dealt] == pytest.approx([r[3] for r in whole], abs=1e-12)


def test_look_up_and_tasks_stay_small_where_tiles_are_large(spark, monkeypatch):
    monkeypatch.setattr(triangulation, "LOOKUP_POINTS", 20)
    places = spots("random", 400)
    points = stations(spark, places).select(F.col("numer_insee").alias("id"), F.col("lon").alias("x"), F.col("lat").alias("y"))
    extent = points.agg(*[f(c).alias(f"{c}{k}") for c in "xy" for k, f in enumerate((F.min, F.max))]).first()
    rounds = triangulation.TileRounds(points, extent, 150)
    assert rounds.lookup.groupBy(*triangulation.TILE).count().agg(F.max("count")).first()[0] <= 20
    assert rounds.stations.groupBy(*triangulation.TILE).count().agg(F.max("count")).first()[0] > 20
    got = sorted((r["sa"], r["sb"], r["sc"]) for r in rounds.triangles().collect())
    local, _ = local_delaunay(list(places), *zip(*places.values(), strict=True))
    assert got == sorted(tuple(sorted(t)) for t in local)


def test_order_of_insertion_stays_local_beside_far_stations():
    near = {k: (k % 30 + 0.1 * (k % 7), k // 30 + 0.1 * (k % 5)) for k in range(900)}
    order = _curve_order(near | {900: (1e6, 1e6), 901: (-1e6, -1e6)})
    steps = [math.dist(near[a], near[b]) for a, b in zip(order, order[1:], strict=False) if a < 900 and b < 900]
    assert sorted(order) == list(range(902))
    assert sum(steps) < 6 * len(steps)
