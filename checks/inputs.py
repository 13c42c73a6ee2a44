"""Sensor, station and land-cover tables derived from the given Parquet tables.

Each table is one SQL text for both engines; `spark_sql` and `duckdb_sql` fill in the few words in
which the dialects differ. All rows of the source tables are used.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SOURCES = {
    "mobile_raw": ("events",),
    "meteo_raw": ("events",),
    "stations": ("supplier",),
    "station_obs": ("supplier",),
    "lcz_points": ("events",),
    "lcz_rects": ("part",),
}

_SQL = {
    "mobile_raw": """
select event_id*3+k as id,
 cast(date_trunc('second', ts) as {NTZ}) + interval '1' second * (0.4e0*k) as {TS},
 case when event_id%50=0 then null else 10e0 + floor(value)%25 + k*0.5e0 end as temperature,
 30e0 + event_id%60 as humidity,
 -1.3e0 + (user_id%14)*0.22e0 + (event_id%4)*0.001e0 as lon,
 47.1e0 + (user_id%9)*0.22e0 + (floor(value)%3)*0.001e0 as lat,
 cast(event_id%30 as double) as accuracy, event_type as sensor_name,
 cast(user_id%10 + case when k=2 and event_id%21=1 then 100 else 0 end as int) as id_track,
 case when user_id%4=3 then 'Site REFERENCE' when user_id%4=2 then 'Saint-Jean La Poterie'
      else concat('Thermo ', cast(user_id%4 as {STR})) end as thermo_name,
 cast(event_id%120 as double) as elevation
from events {EACH3}""",
    "meteo_raw": """
select event_id*2+k as id, ts as {TS}, cast(user_id%10 as int) as id_track,
 event_type as sensor_name,
 case when user_id%4=2 then 'Saint-Jean La Poterie'
      else concat('Thermo ', cast(user_id%4 as {STR})) end as thermo_name,
 -1.3e0 + (user_id%14)*0.22e0 + (event_id%4)*0.001e0 as lon,
 47.1e0 + (user_id%9)*0.22e0 + (floor(value)%3)*0.001e0 as lat,
 20e0 + event_id%70 as altitude, cast(floor(value)%12 + k as double) as vitesse,
 cast(event_id%360 as double) as direction, 10e0 + floor(value)%25 as temperature,
 30e0 + event_id%60 as humidite, 990e0 + event_id%40 as pression,
 floor(value)%25 - 2e0 as temperature_bot, floor(value)%25 - 1e0 as temperature_top,
 1e0 + event_id%9 + k*0.5e0 as pm_1_ug_m3, 2e0 + event_id%11 as pm_2_5_ug_m3,
 3e0 + event_id%13 as pm_10_ug_m3, 40e0 + event_id%45 as niveau_sonore_db_a,
 cast(event_id%150 as double) as distancegauche, cast(event_id%210 as double) as distancedroite,
 cast(event_id%120 as double) as elevation
from events {EACH2}""",
    "stations": """
select s_suppkey as numer_insee, s_name as nom_station,
 -1.5e0 + 3.2e0*(s_suppkey*0.7548776662466927e0 + s_suppkey*s_suppkey*0.0137e0
   - floor(s_suppkey*0.7548776662466927e0 + s_suppkey*s_suppkey*0.0137e0)) as lon,
 47.0e0 + 2.2e0*(s_suppkey*0.5698402909980532e0 + s_suppkey*s_suppkey*0.0291e0
   - floor(s_suppkey*0.5698402909980532e0 + s_suppkey*s_suppkey*0.0291e0)) as lat,
 cast((s_suppkey*7)%150 as double) as elevation
from supplier""",
    "station_obs": """
select s_suppkey as numer_sta,
 timestamp{NTZ_LITERAL} '2024-01-01 00:00:00' + interval '1' second * (360*k) as {DATE},
 15e0 + (s_suppkey%20)*0.25e0 + k%11 as t_ground_0, (s_suppkey%3)*0.1e0 as delta_t
from supplier {STEPS}""",
    "lcz_points": """
select event_id as id, (event_id*37)%7700 - 100e0 as x3857,
 event_id*0.6e0 - 100e0 + (event_id*91)%200 as y3857, value as temperature, ts as {TS}
from events""",
    # 150 m squares in rows of 50, some with a hole, some without a class; `part` 0 is the shell and 1 the hole
    "lcz_rects": """
select p_partkey as poly_id, k as part,
 cast(case when p_partkey%29=7 then null when p_partkey%23=5 then 200 when p_partkey%17<10 then p_partkey%17+1
      else p_partkey%17+91 end as int) as lcz_primary,
 (p_partkey%50)*150e0 + k*40e0 as x0, floor(p_partkey/50.0e0)*150e0 + k*30e0 as y0,
 (p_partkey%50)*150e0 + 150e0 - k*40e0 as x1, floor(p_partkey/50.0e0)*150e0 + 150e0 - k*60e0 as y1
from part {HOLES}""",
}


def _each(engine: str, n: int) -> str:
    if engine == "spark":
        return f"lateral view explode(sequence(0, {n - 1})) kk as k"
    return f"cross join (select unnest(range({n})) as k) kk"


def _tokens(engine: str) -> dict[str, str]:
    spark = engine == "spark"
    return {
        "NTZ": "timestamp_ntz" if spark else "timestamp",
        "STR": "string" if spark else "varchar",
        "NTZ_LITERAL": "_ntz" if spark else "",
        "TS": "`timestamp`" if spark else '"timestamp"',
        "DATE": "`date`" if spark else '"date"',
        "EACH2": _each(engine, 2),
        "EACH3": _each(engine, 3),
        "STEPS": _each(engine, 7200),
        "HOLES": "lateral view explode(case when p_partkey%7=3 then array(0, 1) else array(0) end)"
        " kk as k"
        if spark
        else ", unnest(case when p_partkey%7=3 then [0, 1] else [0] end) as kk(k)",
    }


def duckdb_sql(name: str) -> str:
    return _SQL[name].format(**_tokens("duckdb"))


def spark_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The derived table as a lazy DataFrame."""
    sources = {s: spark.read.parquet(f"{sf_dir}/{s}.parquet") for s in SOURCES[name]}
    text = _SQL[name].format(**_tokens("spark"))
    if name == "station_obs":  # one small file becomes many rows: spread it first
        tasks = spark.sparkContext.defaultParallelism
        sources = {s: df.repartition(tasks, "s_suppkey") for s, df in sources.items()}
    for source in sources:
        text = text.replace(f"from {source}", f"from {{{source}}}")
    return spark.sql(text, **sources)


def lcz_polygons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lcz_rects as polygons with rings, shell first."""

    def ring(row):
        return F.array(
            *[
                F.struct(row[x].alias("x"), row[y].alias("y"))
                for x, y in (("x0", "y0"), ("x1", "y0"), ("x1", "y1"), ("x0", "y1"), ("x0", "y0"))
            ]
        )

    parts = spark_table(spark, sf_dir, "lcz_rects")
    sorted_parts = F.sort_array(F.collect_list(F.struct("part", "x0", "y0", "x1", "y1")))
    return (
        parts.groupBy("poly_id", "lcz_primary")
        .agg(sorted_parts.alias("parts"))
        .select("poly_id", "lcz_primary", F.transform("parts", ring).alias("rings_3857"))
    )
