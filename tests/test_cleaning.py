import datetime as dt
import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

import thermotrack as tt
from thermotrack.functions.geo import distance_m
from thermotrack.functions.keys import track_key
from thermotrack.plans.slices import ascending, time_slice, with_halo
from thermotrack.sources.schemas import METEO_RAW, MOBILE_RAW

T0 = dt.datetime(2025, 6, 28, 10, 0, 0)


def mobile(spark, rows):
    """rows of (id, seconds, lon, lat, overrides)"""
    base = {
        "temperature": 20.0,
        "humidity": 50.0,
        "accuracy": 5.0,
        "sensor_name": "s",
        "id_track": 1,
        "thermo_name": "t",
        "elevation": 10.0,
    }
    names = [part.split()[0] for part in MOBILE_RAW.split(", ")]
    full = []
    for i, seconds, lon, lat, *more in rows:
        values = {**base, "id": i, "timestamp": T0 + dt.timedelta(seconds=seconds)}
        values |= {"lon": lon, "lat": lat, **(more[0] if more else {})}
        full.append(tuple(values[n] for n in names))
    return spark.createDataFrame(full, MOBILE_RAW)


def ids(df):
    return sorted(r["id"] for r in df.select("id").collect())


def test_first_point_is_dropped_and_standstill_too(spark):
    raw = mobile(spark, [(1, 0, 0.0, 48.0), (2, 10, 0.0, 48.0), (3, 20, 0.001, 48.0), (4, 30, 0.002, 48.0)])
    assert ids(tt.clean_mobile(raw)) == [3, 4]
    assert ids(tt.clean_mobile(raw, keep_first=True)) == [1, 3, 4]


def test_speeds(spark):
    raw = mobile(spark, [(k, 10 * k, 0.001 * k * k, 48.0) for k in range(9)])
    rows = tt.clean_mobile(raw).orderBy("timestamp").collect()
    assert rows[0]["speed_m_s"] is None and rows[0]["speed_m_s_smooth"] is None
    speeds = [r["speed_m_s"] for r in rows]
    for k, row in enumerate(rows):
        known = [s for s in speeds[max(0, k - 4) : k + 1] if s is not None]
        if known:
            assert row["speed_m_s_smooth"] == pytest.approx(sum(known) / len(known))


def test_track_longer_than_a_slice_with_gaps(spark):
    """Slices must not show: same speeds as plain windows over whole tracks."""
    rng = random.Random(5)
    rows, now = [], 0
    for k in range(400):
        now += rng.choice([1, 30, 900, 4000, 20000])
        rows.append((k, now, round(rng.random() * 0.01, 3), 48.0, {"id_track": rng.choice([1, 2])}))
    moved = tt.drop_stationary(
        tt.point_speed(tt.drop_duplicates_by_position(tt.aggregate_by_second(mobile(spark, rows))))
    ).withColumn("unique_id_track", track_key())
    whole = Window.partitionBy("unique_id_track").orderBy("timestamp")
    seconds = F.unix_timestamp("timestamp") - F.unix_timestamp(F.lag("timestamp").over(whole))
    metres = distance_m(F.col("lon"), F.col("lat"), F.lag("lon").over(whole), F.lag("lat").over(whole))
    plain = moved.withColumn("speed_m_s", metres / seconds).withColumn(
        "speed_m_s_smooth", F.avg("speed_m_s").over(whole.rowsBetween(-4, 0))
    )
    expected = {r["id"]: (r["speed_m_s"], r["speed_m_s_smooth"]) for r in plain.collect()}
    for result in (tt.clean_mobile(mobile(spark, rows)), tt.smooth_speed(tt.recompute_speed(moved))):
        got = {r["id"]: (r["speed_m_s"], r["speed_m_s_smooth"]) for r in result.collect()}
        assert got.keys() == expected.keys()
        for key, (speed, smooth) in expected.items():
            assert got[key][0] == (None if speed is None else pytest.approx(speed))
            assert got[key][1] == (None if smooth is None else pytest.approx(smooth))


@pytest.mark.parametrize("before", [1, 3, 5])
def test_halo_gives_exact_frames(spark, before):
    rng = random.Random(before)
    rows = [(k, rng.choice(["a", None]), rng.randrange(0, 60)) for k in range(300)]
    df = spark.createDataFrame(rows, "id long, k string, v long").withColumn(
        "timestamp", F.timestamp_seconds(F.col("id") * 700 + F.col("v") * F.col("v"))
    )
    plain = Window.partitionBy("k").orderBy("timestamp", "id").rowsBetween(-before, 0)
    expected = {r["id"]: r["s"] for r in df.withColumn("s", F.sum("v").over(plain)).collect()}
    sliced = df.withColumn("_slice", time_slice(F.col("timestamp"))).repartition("k", "_slice")
    both = with_halo(sliced, ("k",), ("timestamp", "id"), "_slice", before, ("k", "_slice"))
    window = Window.partitionBy("k", "_slice").orderBy(*ascending(("timestamp", "id")))
    got = both.withColumn("s", F.sum("v").over(window.rowsBetween(-before, 0))).filter("not _halo")
    assert {r["id"]: r["s"] for r in got.collect()} == expected


def test_halo_union_shuffles_rows_once(spark):
    df = tt.clean_mobile(mobile(spark, [(k, 900 * k, 0.001 * k, 48.0) for k in range(50)]))
    assert len(df.collect()) == 49
    plan = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    shuffles = [x for x in plan.splitlines() if "Exchange hashpartitioning(unique_id_track" in x]
    reused = [x for x in shuffles if "ReusedExchange" in x]
    written = [x for x in shuffles if "REPARTITION_BY_COL" in x and x not in reused]
    # one shuffle of the rows, read several times, and one for each of the two sets of copies
    assert len(reused) >= 2 and len(written) == 3


def test_duplicates_keep_lowest_id(spark):
    raw = mobile(
        spark,
        [(1, 0, 0.0, 48.0), (2, 9, 0.1, 48.0), (5, 9, 0.1, 48.0, {"id_track": 7}), (3, 20, 0.2, 48.0)],
    )
    assert ids(tt.drop_duplicates_by_position(tt.aggregate_by_second(raw))) == [1, 2, 3]


def test_filters_and_accents(spark):
    raw = mobile(
        spark,
        [
            (1, 0, 0.0, 48.0, {"accuracy": 25.0}),
            (2, 1, 0.0, 48.0, {"accuracy": 25.1}),
            (3, 2, 0.0, 48.0, {"thermo_name": "Site REFERENCE"}),
            (4, 3, 0.0, 48.0, {"thermo_name": "Référence"}),
            (5, 4, 0.0, 48.0, {"thermo_name": None}),
            (6, 5, 0.0, 48.0, {"temperature": None}),
        ],
    )
    assert ids(tt.aggregate_by_second(raw)) == [1, 4]
    assert ids(tt.clean_reference(raw)) == [3]


def test_key_is_null_with_a_null_part(spark):
    df = spark.createDataFrame(
        [(1, "s", "t"), (None, "s", "t"), (1, None, "t")],
        "id_track int, sensor_name string, thermo_name string",
    )
    keys = [r[0] for r in df.select(track_key()).collect()]
    assert keys[1:] == [None, None]
    assert len(keys[0]) == 32 and keys[0] == keys[0].lower()


def test_null_keys_form_one_track_for_the_second_speed(spark):
    rows = [(k, 10 * k, 0.001 * k, 48.0, {"sensor_name": None, "id_track": k % 2}) for k in range(8)]
    result = tt.clean_mobile(mobile(spark, rows)).orderBy("timestamp").collect()
    assert [r["id"] for r in result] == [2, 3, 4, 5, 6, 7]
    assert [r["speed_m_s"] is None for r in result] == [True] + [False] * 5


def test_meteo_bounds_and_speed(spark):
    names = [part.split()[0] for part in METEO_RAW.split(", ")]
    base = dict.fromkeys(names, 1.0) | {"id_track": 1, "thermo_name": "t", "sensor_name": "s"}
    start = dt.datetime(2025, 6, 27, 4, 0, 0)
    end = dt.datetime(2025, 7, 3, 21, 0, 0)
    second = dt.timedelta(seconds=1)
    cases = [
        (1, start, 10.0, "t"),
        (2, start + second, 10.0, "t"),
        (3, end, 10.0, "t"),
        (4, end - second, 10.0, "t"),
        (5, T0, 3.6, "t"),
        (6, T0 + second, 3.5, "t"),
        (7, T0 + 2 * second, 10.0, "Saint-Jean La Poterie"),
        (8, T0 + 3 * second, 10.0, None),
    ]
    rows = [base | {"id": i, "timestamp": ts, "vitesse": v, "thermo_name": n} for i, ts, v, n in cases]
    df = spark.createDataFrame([tuple(r[n] for n in names) for r in rows], METEO_RAW)
    cleaned = tt.clean_meteo(df)
    assert ids(cleaned) == [2, 4, 5]
    assert cleaned.filter("id = 5").first()["speed_m_s"] == pytest.approx(1.0)


def test_distance(spark):
    df = spark.createDataFrame([(2.0, 48.0, 2.01, 48.0), (179.999, 10.0, -179.999, 10.0)], "a double, b double, c double, d double")
    got = [r[0] for r in df.select(distance_m(F.col("a"), F.col("b"), F.col("c"), F.col("d"))).collect()]
    assert got[0] == pytest.approx(746.06, abs=0.5)
    assert got[1] == pytest.approx(219.3, abs=0.5)
