import datetime as dt
from decimal import Decimal

import pytest

import thermotrack as tt
from thermotrack.operators.profiles import DIFFERENCE_COLOURS


def timed(spark, rows, schema="timestamp timestamp, temperature double"):
    return spark.createDataFrame(rows, schema)


def day(n, hour=12):
    return dt.datetime(2025, 7, n, hour)


def test_index_skips_missing_days_and_edges(spark):
    rows = [(day(n, h), t) for n, low, high in ((1, 10, 20), (2, 12, 24), (5, 14, 30)) for h, t in ((4, float(low)), (15, float(high)))]
    result = tt.biometeo_index(timed(spark, rows)).orderBy("day").collect()
    assert [r["ibm"] for r in result] == [Decimal("16.50"), Decimal("18.33"), Decimal("20.00")]
    summary = tt.index_summary(tt.biometeo_index(timed(spark, rows))).first()
    assert summary["nb_jours"] == 3 and summary["ibm_moyen"] == Decimal("18.28")
    assert summary["tn_min"] == 10 and summary["tx_max"] == 30


def test_index_rounds_fifteen_digits_half_up(spark):
    rows = [(day(1), 22.245), (day(2), 22.244999999999997)]
    values = [r["ibm"] for r in tt.biometeo_index(timed(spark, rows)).collect()]
    assert values == [Decimal("22.25")] * 2


def test_index_day_depends_on_zone(spark):
    rows = [(day(1, 23), 10.0), (day(2, 1), 20.0)]
    assert tt.biometeo_index(timed(spark, rows)).count() == 2
    assert tt.biometeo_index(timed(spark, rows), tz="Europe/Paris").count() == 1


def test_union_needs_columns(spark):
    df = timed(spark, [(day(1), 1.0)])
    assert tt.union_sources(df, df).count() == 2
    with pytest.raises(ValueError):
        tt.union_sources(df.drop("temperature"))


def test_range_over_midnight_and_positive_columns(spark):
    # Europe/Paris is two hours ahead of UTC in July
    rows = [
        (dt.datetime(2025, 7, 1, 3, 59), 1.0, 5.0),
        (dt.datetime(2025, 7, 1, 4, 0), 2.0, 6.0),
        (dt.datetime(2025, 7, 1, 19, 0), 3.0, -1.0),
        (dt.datetime(2025, 7, 1, 22, 30), None, 0.0),
    ]
    df = timed(spark, rows, "timestamp timestamp, temperature double, temperature_top double")
    row = tt.hour_amplitude(tt.hour_range_stats(df, ["temperature", "temperature_top"], [(21, 6)])).first()
    assert row["count_21h_06h"] == 3
    assert (row["min_temperature_21h_06h"], row["max_temperature_21h_06h"]) == (1.0, 3.0)
    assert row["avg_temperature_top_21h_06h"] == 5.0
    assert (row["nombre_jours"], row["heure_min"], row["heure_max"]) == (2, 0, 21)
    assert row["amplitude_horaire"] == 22


@pytest.mark.parametrize("bad", [(5, 5), (-1, 4), (3, 25)])
def test_bad_ranges(spark, bad):
    df = timed(spark, [(day(1), 1.0)])
    with pytest.raises(ValueError):
        tt.hour_range_stats(df, ["temperature"], [bad])
    with pytest.raises(ValueError):
        tt.hour_range_stats(df, ["unknown"], [(0, 24)])
    with pytest.raises(ValueError):
        tt.hour_range_stats(df, [], [(0, 24)])


SCHEMA = "id long, thermo_name string, timestamp timestamp, temperature double, diff_temperature double, elevation double"


def test_split_row_is_in_both_zones(spark):
    rows = [(k, "t", dt.datetime(2025, 6, 30, 20, k), 20.0 + k, 1.0, 5.0) for k in range(5)]
    rows.append((9, "t", dt.datetime(2025, 6, 30, 20, 9), None, 1.0, 5.0))
    df = timed(spark, rows, SCHEMA)
    profile = tt.transect_profile(df, "2025-06-30 22:02:00", thermo="t")
    zones = sorted((r["zone"], r["id"]) for r in profile.collect())
    assert zones == [("Campagne", 2), ("Campagne", 3), ("Campagne", 4), ("Ville", 0), ("Ville", 1), ("Ville", 2)]
    summary = {r["zone"]: r for r in tt.transect_summary(profile).collect()}
    assert summary["Ville"]["mid_timestamp"] == rows[1][2]
    assert summary["Campagne"]["mid_timestamp"] == rows[3][2]
    assert summary["Campagne"]["zone_temperature_min"] == 22.0
    assert (summary["Ville"]["temperature_min"], summary["Ville"]["temperature_max"]) == (20.0, 24.0)


def test_summary_middle_row_over_many_slices(spark):
    rows = [(k, None, dt.datetime(2025, 6, 1) + dt.timedelta(minutes=37 * k), 1.0, 1.0, 5.0) for k in range(101)]
    profile = tt.transect_profile(timed(spark, rows, SCHEMA), "2030-01-01 00:00:00")
    only = tt.transect_summary(profile).collect()
    assert [(r["zone_rows"], r["mid_timestamp"]) for r in only] == [(101, rows[50][2])]


def test_difference_classes(spark):
    values = [-11.0, -10.0, -5.0, -0.5, 0.0, 2.999, 3.0, 4.0, 9.0, None]
    df = spark.createDataFrame([(v,) for v in values], "diff_temperature double")
    rows = tt.classify_difference(df).collect()
    classes = [r["diff_class"] for r in rows]
    assert classes == [0, 0, 1, 5, 6, 8, 9, 9, 9, None]
    assert [r["diff_colour"] for r in rows] == [None if c is None else DIFFERENCE_COLOURS[c] for c in classes]


def minute(n):
    return dt.datetime(2025, 7, 1, 23, 58) + dt.timedelta(minutes=n)


def test_minute_grid_and_fill(spark):
    rows = [("t", minute(0), 10.0, None), ("t", minute(1), 11.0, 1.0), ("t", minute(5), 15.0, 5.0), ("t", minute(5), 17.0, 5.0), ("t", minute(7), 20.0, None), (None, minute(3), 1.0, 1.0)]
    df = timed(spark, rows, "thermo_name string, timestamp timestamp, temperature double, t_inter double")
    grid = tt.minute_profile(df)
    t = sorted((r["timestamp"], r["sensor_t"], r["meteofrance_t"]) for r in grid.filter("thermo_name = 't'").collect())
    assert [r[1] for r in t] == [10.0, 11.0, None, None, None, 16.0, None, 20.0]
    assert grid.filter("thermo_name is null").count() == 1
    for seconds in (60, 120, 86400):
        filled = tt.fill_linear(grid, ("sensor_t", "meteofrance_t"), slice_seconds=seconds)
        t = sorted((r["timestamp"], r["sensor_t"], r["meteofrance_t"]) for r in filled.filter("thermo_name = 't'").collect())
        assert [r[1] for r in t] == [10.0, 11.0, 12.25, 13.5, 14.75, 16.0, 18.0, 20.0]
        assert [r[2] for r in t] == [None, 1.0, 2.0, 3.0, 4.0, 5.0, 5.0, 5.0]


def test_select_thermo(spark):
    df = timed(spark, [("b", minute(2)), ("a", minute(1)), ("b", minute(0))], "thermo_name string, timestamp timestamp")
    assert [r["timestamp"] for r in tt.select_thermo(df, "b").collect()] == [minute(0), minute(2)]
