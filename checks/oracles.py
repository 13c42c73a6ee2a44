"""SQL for DuckDB that states each result from its definition, apart from the Spark code.

Doubles are rounded to 6 decimals on both sides, as sums differ in their last bits by order.
"""

from checks.inputs import duckdb_sql

DIGITS = 6
CLEAN_START = "2024-01-03T06:00:00+02:00"
CLEAN_END = "2024-01-28T23:00:00+02:00"
SPLIT = "2024-01-15 12:00:00"
RADIUS = 100
# Class codes and their groups.
CLASSES = (1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 101, 102, 103, 104, 105, 106, 107)
GROUPS = {
    "lcz_urban": "1,2,3,4,5,6,7,8,9,10,105",
    "lcz_vegetation": "101,102,103,104",
    "lcz_bare": "106",
    "lcz_water": "107",
}
# Measures of the bike table.
METEO = (
    "lon",
    "lat",
    "altitude",
    "vitesse",
    "direction",
    "temperature",
    "humidite",
    "pression",
    "temperature_bot",
    "temperature_top",
    "pm_1_ug_m3",
    "pm_2_5_ug_m3",
    "pm_10_ug_m3",
    "niveau_sonore_db_a",
    "distancegauche",
    "distancedroite",
    "elevation",
    "speed_m_s",
)
TRACK = "sensor_name, thermo_name, id_track"
KEY = "md5(cast(id_track as varchar) || '|' || sensor_name || '|' || thermo_name)"


def _r(*columns: str) -> str:
    """Rounded columns; adding zero turns -0.0 into 0.0."""
    return ", ".join(f"round({c}, {DIGITS}) + 0e0 as {c}" for c in columns)


def _with(*steps: tuple[str, str]) -> str:
    return "with " + ",\n".join(f"{name} as ({sql})" for name, sql in steps)


def _raw(*names: str):
    return [(name, duckdb_sql(name)) for name in names]


def _distance(a: str, b: str) -> str:
    """Metres along the two principal radii at the mean latitude of rows a and b."""
    mid = f"radians(({a}.lat + {b}.lat) / 2)"
    a_axis, e2 = "6378137e0", "0.0066943799901413165e0"
    w = f"sqrt(1e0 - {e2} * sin({mid}) * sin({mid}))"
    north = f"({a_axis} * (1e0 - {e2}) / ({w} * {w} * {w}) * radians({b}.lat - {a}.lat))"
    east = f"({a_axis} / {w} * cos({mid}) * radians({b}.lon - {a}.lon))"
    return f"sqrt({north} * {north} + {east} * {east})"


def _per_second(where: str) -> str:
    means = ", ".join(
        f"avg({c}) as {c}" for c in ("temperature", "humidity", "lon", "lat", "accuracy", "elevation")
    )
    return f"""select max(id) as id, {TRACK}, date_trunc('second', "timestamp") as "timestamp", {means}
 from mobile_raw where {where} group by {TRACK}, date_trunc('second', "timestamp")"""


_SECONDS = (
    "per_second",
    _per_second(
        "accuracy <= 25 and thermo_name not ilike '%reference%' and temperature is not null"
    ),
)
_UNIQUE = (
    "uniq",
    """select a.* from per_second a join (select sensor_name, thermo_name, lon, lat, "timestamp",
 min(id) as id from per_second group by all) b using (id)""",
)


def _ranked(source: str, keys: str) -> str:
    return f"""select *, row_number() over (partition by {keys} order by "timestamp", id) as rn
 from {source}"""


def _speed_join(source: str, keys: str) -> str:
    """Speed by an explicit self-join on row number."""
    on = " and ".join(f"a.{k.strip()} = b.{k.strip()}" for k in keys.split(","))
    dt = '(epoch_us(b."timestamp") - epoch_us(a."timestamp")) / 1e6'
    return f"""select b.*, a.lon as prev_lon, a.lat as prev_lat,
 case when {dt} > 0 then {_distance("a", "b")} / ({dt}) end as speed_m_s
 from {source} b left join {source} a on {on} and a.rn = b.rn - 1"""


_MOBILE = [
    *_raw("mobile_raw"),
    _SECONDS,
    _UNIQUE,
    ("ranked", _ranked("uniq", TRACK)),
    ("speeds", _speed_join("ranked", TRACK)),
    (
        "moving",
        f"""select id, {TRACK}, "timestamp", temperature, humidity, lon, lat, accuracy, elevation,
 {KEY} as unique_id_track from speeds where lon <> prev_lon or lat <> prev_lat""",
    ),
    ("ranked2", _ranked("moving", "unique_id_track")),
    ("speeds2", _speed_join("ranked2", "unique_id_track")),
    (
        "mobile",
        """select a.id, a.sensor_name, a.thermo_name, a.id_track, a."timestamp", a.temperature,
 a.humidity, a.lon, a.lat, a.accuracy, a.elevation, a.unique_id_track, a.speed_m_s,
 avg(b.speed_m_s) as speed_m_s_smooth from speeds2 a join speeds2 b
 on a.unique_id_track = b.unique_id_track and b.rn between a.rn - 4 and a.rn group by all""",
    ),
]
_MOBILE_DOUBLES = ("temperature", "humidity", "lon", "lat", "accuracy", "elevation")
_REFERENCE = [
    *_raw("mobile_raw"),
    ("merged", _per_second("thermo_name ilike '%reference%' and temperature is not null")),
    ("reference", f"select *, {KEY} as unique_id_track from merged"),
]
_METEO_MEANS = ", ".join(f"avg({c}) as {c}" for c in METEO if c != "speed_m_s")
_METEO = [
    *_raw("meteo_raw"),
    (
        "meteo",
        f"""select max(id) as id, {TRACK}, "timestamp", {_METEO_MEANS},
 avg(vitesse) / 3.6e0 as speed_m_s, {KEY} as unique_id_track from meteo_raw
 where vitesse / 3.6e0 >= 1 and "timestamp" > timestamp '2024-01-03 04:00:00'
 and "timestamp" < timestamp '2024-01-28 21:00:00' and thermo_name <> 'Saint-Jean La Poterie'
 group by "timestamp", {TRACK}""",
    ),
]

# Delaunay by definition: triples of stations whose circumcircle holds no other station.
_TRIANGLES = [
    *_raw("stations"),
    ("s", "select numer_insee as n, lon as x, lat as y from stations"),
    (
        "triples",
        """select a.n as na, a.x as xa, a.y as ya, b.n as nb, b.x as xb, b.y as yb,
 c.n as nc, c.x as xc, c.y as yc,
 2 * ((b.x-a.x)*(c.y-a.y) - (b.y-a.y)*(c.x-a.x)) as d
 from s a join s b on a.n < b.n join s c on b.n < c.n""",
    ),
    (
        "circles",
        """select *, ox - xa as rx, oy - ya as ry from (select *,
 xa + ((yc-ya)*((xb-xa)*(xb-xa)+(yb-ya)*(yb-ya)) - (yb-ya)*((xc-xa)*(xc-xa)+(yc-ya)*(yc-ya))) / d as ox,
 ya + ((xb-xa)*((xc-xa)*(xc-xa)+(yc-ya)*(yc-ya)) - (xc-xa)*((xb-xa)*(xb-xa)+(yb-ya)*(yb-ya))) / d as oy
 from triples where d <> 0)""",
    ),
    (
        "tri",
        """select row_number() over (order by na, nb, nc) as id_triangle, * from circles
 where not exists (select 1 from s where n <> na and n <> nb and n <> nc
 and (x-ox)*(x-ox) + (y-oy)*(y-oy) < (rx*rx + ry*ry) * (1 - 1e-11))""",
    ),
]


def _side(u: str, v: str) -> str:
    return f"((x{v}-x{u})*(p.lat-y{u}) - (y{v}-y{u})*(p.lon-x{u}))"


def _located(source: str, columns: str) -> str:
    """Points on the inner side of all three edges."""
    same = " and ".join(f"{_side(u, v)} * d >= 0" for u, v in (("a", "b"), ("b", "c"), ("c", "a")))
    return f"select {columns}, t.* from {source} p join tri t on {same}"


_REPORTS = (
    "reports",
    """select l.id, l.id_triangle, v.k as k, v.n as n, v.x as x, v.y as y,
 max_by(o.t_ground_0, o."date") as t0, max_by(o.delta_t, o."date") as dt,
 (epoch_us(any_value(l."timestamp")) - max(epoch_us(o."date"))) / 360e6 as weight
 from located l, unnest([{'k': 1, 'n': na, 'x': xa, 'y': ya}, {'k': 2, 'n': nb, 'x': xb, 'y': yb},
 {'k': 3, 'n': nc, 'x': xc, 'y': yc}]) as u(v)
 join station_obs o on o.numer_sta = v.n and o."date" > l."timestamp" - interval '6 minutes'
 and o."date" <= l."timestamp" group by l.id, l.id_triangle, v""",
)


def _plane(value: str) -> str:
    """Height at the point of the plane z = z1 + p (x - x1) + q (y - y1), by Cramer's rule."""
    z = [f"max(case when r.k = {k} then {value} end)" for k in (1, 2, 3)]
    x1, y1, x2, y2, x3, y3 = (f"any_value(l.{c})" for c in ("xa", "ya", "xb", "yb", "xc", "yc"))
    u1, v1, u2, v2 = f"({x2}-{x1})", f"({y2}-{y1})", f"({x3}-{x1})", f"({y3}-{y1})"
    det = f"({u1}*{v2} - {u2}*{v1})"
    p = f"((({z[1]}-{z[0]})*{v2} - ({z[2]}-{z[0]})*{v1}) / {det})"
    q = f"(({u1}*({z[2]}-{z[0]}) - {u2}*({z[1]}-{z[0]})) / {det})"
    return f"({z[0]} + {p}*(any_value(l.lon)-{x1}) + {q}*(any_value(l.lat)-{y1}))"


def _interpolated(source: str, carry: tuple[str, ...]):
    columns = ", ".join(
        f'p."{c}"'
        for c in dict.fromkeys(("id", "timestamp", "temperature", "lon", "lat", "elevation", *carry))
    )
    t_inter = f"{_plane('r.t0')} + {_plane('r.dt')} * max(r.weight) - 0.0065e0 * any_value(l.elevation)"
    kept = ", ".join(
        f'any_value(l."{c}") as "{c}"'
        for c in dict.fromkeys(("timestamp", "temperature", "lon", "lat", *carry))
    )
    return [
        *_raw("station_obs"),
        *_TRIANGLES,
        ("located", _located(source, columns)),
        _REPORTS,
        (
            "inter",
            f"""select l.id, l.id_triangle, {kept}, {t_inter} as t_inter
 from located l join reports r using (id, id_triangle) group by l.id, l.id_triangle""",
        ),
    ]


_MOBILE_CARRY = ("elevation", "speed_m_s", "thermo_name", "sensor_name", "unique_id_track")
_METEO_CARRY = (*_MOBILE_CARRY, "temperature_bot", "temperature_top")
_MOBILE_INTER = [*_MOBILE, *_interpolated("mobile", _MOBILE_CARRY)]
_METEO_INTER = [*_METEO, *_interpolated("meteo", _METEO_CARRY)]
_REFERENCE_INTER = [*_REFERENCE, *_interpolated("reference", ("thermo_name", "sensor_name", "unique_id_track"))]


def _inter_select(carry: tuple[str, ...]) -> str:
    doubles = [c for c in carry if c in ("elevation", "speed_m_s", "temperature_bot", "temperature_top")]
    names = [c for c in carry if c not in doubles]
    return f"""select id, "timestamp", id_triangle, {", ".join(names)},
 {_r("temperature", "t_inter", "lon", "lat", *doubles)},
 round(temperature - t_inter, {DIGITS}) + 0e0 as diff_temperature from inter"""


# Buffer and rectangle. A 32-sided buffer: integral over its 16 upper edges of the clamped heights
# of the edge and of its mirror image. A disc: areas of the disc left of x and below y.
def _clamp_integral(u: str) -> str:
    return f"""case when {u} < b0 then b0*({u}-b0) when {u} <= b1 then ({u}*{u}-b0*b0)/2
 else (b1*b1-b0*b0)/2 + b1*({u}-b1) end"""


_GON = (
    "gon",
    f"""select *, (yb-ya)/(xb-xa) as m from (select
 {RADIUS}e0*cos((k+1)*pi()/16) as xa, {RADIUS}e0*sin((k+1)*pi()/16) as ya,
 {RADIUS}e0*cos(k*pi()/16) as xb, {RADIUS}e0*sin(k*pi()/16) as yb
 from (select unnest(range(16)) as k))""",
)
_NEAR = (
    "near",
    f"""select p.id, r.poly_id, r.lcz_primary, case when r.part = 0 then 1e0 else -1e0 end as sgn,
 r.x0 - p.x3857 as a0, r.x1 - p.x3857 as a1, r.y0 - p.y3857 as b0, r.y1 - p.y3857 as b1
 from lcz_points p join lcz_rects r on p.x3857 > r.x0 - {RADIUS} and p.x3857 < r.x1 + {RADIUS}
 and p.y3857 > r.y0 - {RADIUS} and p.y3857 < r.y1 + {RADIUS}""",
)
_STRIPS = (
    "strips",
    """select id, poly_id, lcz_primary, sgn, b0, b1, m, ya + m*(greatest(a0, xa) - xa) as u,
 ya + m*(least(a1, xb) - xa) as v from near join gon on greatest(a0, xa) < least(a1, xb)""",
)
_OVERLAP_32 = (
    "overlap",
    f"""select id, poly_id, lcz_primary, sum(sgn * (({_clamp_integral("v")}) - ({_clamp_integral("u")})
 + ({_clamp_integral("(-v)")}) - ({_clamp_integral("(-u)")})) / m)
 / (16e0 * {RADIUS}e0 * {RADIUS}e0 * sin(pi()/16)) as lcz_fraction
 from strips group by id, poly_id, lcz_primary""",
)


def _half_disc(h: str) -> str:
    c = f"greatest(-1e0, least(1e0, {h}))"
    return f"(pi()/2 + {c}*sqrt(1-{c}*{c}) + asin({c}))"


def _corner(x: str, y: str) -> str:
    """Area of the unit disc left of x and below y."""
    return f"""case when {x}*{x}+{y}*{y} < 1
 then pi()/4 + ({x}*sqrt(1-{x}*{x})+asin({x}))/2 + ({y}*sqrt(1-{y}*{y})+asin({y}))/2 + {x}*{y}
 when {x} <= 0 and {y} <= 0 then 0e0 when {x} <= 0 then {_half_disc(x)}
 when {y} <= 0 then {_half_disc(y)} else {_half_disc(x)} + {_half_disc(y)} - pi() end"""


_UNIT = (
    "unit",
    "select id, poly_id, lcz_primary, sgn, "
    + ", ".join(f"{c}/{RADIUS}e0 as {c}" for c in ("a0", "a1", "b0", "b1"))
    + " from near",
)
_OVERLAP_DISC = (
    "overlap",
    f"""select id, poly_id, lcz_primary, sum(sgn * (({_corner("a1", "b1")}) - ({_corner("a0", "b1")})
 - ({_corner("a1", "b0")}) + ({_corner("a0", "b0")}))) / pi() as lcz_fraction
 from unit group by id, poly_id, lcz_primary""",
)
_LCZ_32 = [*_raw("lcz_points", "lcz_rects"), _NEAR, _GON, _STRIPS, _OVERLAP_32]
_LCZ_DISC = [*_raw("lcz_points", "lcz_rects"), _NEAR, _UNIT, _OVERLAP_DISC]
_BY_CLASS = [
    (
        "by_class",
        """select id, lcz_primary, sum(lcz_fraction) as lcz_fraction_sum from overlap
 where lcz_fraction > 1e-9 group by id, lcz_primary""",
    ),
    (
        "class_ranks",
        """select *, row_number() over (partition by id order by round(lcz_fraction_sum, 9) desc,
 lcz_primary nulls last) as rn from by_class""",
    ),
]
# Whether a closed buffer meets a square with a hole: no side of the buffer has the square beyond it,
# and the buffer doesn't lie inside the hole.
_SIDES = (
    "sides",
    f"""select cos((k+0.5)*pi()/16) as nx, sin((k+0.5)*pi()/16) as ny, {RADIUS}e0*cos(pi()/32)*(1+1e-12) as reach
 from (select unnest(range(32)) as k)""",
)
_AROUND = (
    "around",
    f"""select p.id, r.poly_id, r.lcz_primary, r.x0 - p.x3857 as a0, r.x1 - p.x3857 as a1,
 r.y0 - p.y3857 as b0, r.y1 - p.y3857 as b1 from lcz_points p join lcz_rects r on r.part = 0
 and p.x3857 >= r.x0 - {RADIUS} and p.x3857 <= r.x1 + {RADIUS}
 and p.y3857 >= r.y0 - {RADIUS} and p.y3857 <= r.y1 + {RADIUS}
 left join lcz_rects h on h.part = 1 and h.poly_id = r.poly_id
 and h.x0 < p.x3857 - {RADIUS} and h.x1 > p.x3857 + {RADIUS}
 and h.y0 < p.y3857 - {RADIUS} and h.y1 > p.y3857 + {RADIUS} where h.poly_id is null""",
)
_MEETING = (
    "meeting",
    """select id, poly_id, lcz_primary from around where not exists (select 1 from sides
 where least(nx*a0, nx*a1) + least(ny*b0, ny*b1) > reach)""",
)
_MEETING_DISC = (
    "meeting",
    f"""select id, poly_id, lcz_primary from around
 where pow(greatest(a0, 0, -a1), 2) + pow(greatest(b0, 0, -b1), 2) <= {RADIUS}e0*{RADIUS}e0*(1+1e-12)""",
)
_BY_CLASS_TOUCHING = [
    _SIDES,
    _AROUND,
    _MEETING,
    (
        "by_class",
        """select m.id, m.lcz_primary, sum(greatest(coalesce(o.lcz_fraction, 0), 0)) as lcz_fraction_sum
 from meeting m left join overlap o on m.id = o.id and m.poly_id = o.poly_id group by m.id, m.lcz_primary""",
    ),
    _BY_CLASS[1],
]
_WIDE = ", ".join(
    [
        "max(case when rn = 1 then lcz_primary end) as lcz_primary_max",
        "max(case when rn = 2 then lcz_primary end) as lcz_primary_max_2",
        *[
            f"round(coalesce(sum(lcz_fraction_sum) filter (where lcz_primary in ({codes})), 0), "
            f"{DIGITS}) + 0e0 as {name}"
            for name, codes in [*[(f"lcz_{c}", str(c)) for c in CLASSES], *GROUPS.items()]
        ],
    ]
)
_LCZ_ROW = f"""select id, round(any_value(x3857), {DIGITS}) + 0e0 as x3857,
 round(any_value(y3857), {DIGITS}) + 0e0 as y3857,
 any_value("timestamp") as "timestamp", round(any_value(temperature), {DIGITS}) as temperature, {_WIDE}
 from class_ranks join lcz_points using (id) group by id"""


def _heat(source: str, by: str) -> list[tuple[str, str]]:
    """Neighbours of a day by self-join on the day's rank."""
    part = f"partition by {by}" if by else ""
    on = f"a.{by} = b.{by} and " if by else ""
    key = f"{by}, " if by else ""
    named = f"a.{by}, " if by else ""
    return [
        (
            "daily",
            f"""select {key}cast("timestamp" as date) as day, min(temperature) as tn,
 max(temperature) as tx from {source} group by all""",
        ),
        ("days", f"select *, row_number() over ({part} order by day) as rn from daily"),
        (
            "heat",
            f"""select {named}a.day, a.tn, a.tx,
 round(cast(printf('%.14e', avg((b.tn + b.tx) / 2)) as decimal(38,15)), 2) as ibm
 from days a join days b on {on}b.rn between a.rn - 1 and a.rn + 1 group by all""",
        ),
    ]


_BOTH = (
    "both_sources",
    """select temperature, "timestamp" from mobile union all
 select temperature, "timestamp" from meteo""",
)


def _stats(source: str, columns, ranges) -> str:
    local = "((\"timestamp\" at time zone 'UTC') at time zone 'Europe/Paris')"
    parts = [
        f"count(distinct cast({local} as date)) as nombre_jours",
        f"cast(min(hour({local})) as int) as heure_min",
        f"cast(max(hour({local})) as int) as heure_max",
        f"cast(max(hour({local})) - min(hour({local})) + 1 as int) as amplitude_horaire",
    ]
    for start, end in ranges:
        glue = "and" if start < end else "or"
        inside = f"(hour({local}) >= {start} {glue} hour({local}) < {end})"
        label = f"{start:02d}h_{end:02d}h"
        for c in columns:
            cond = f"{inside} and {c} > 0" if c.startswith("temperature_") else inside
            parts += [
                f"round({f}({c}) filter (where {cond}), {DIGITS}) + 0e0 as {f}_{c}_{label}"
                for f in ("max", "min", "avg")
            ]
        parts.append(f"count(*) filter (where {inside}) as count_{label}")
    return _with(*_raw(source)) + f" select {', '.join(parts)} from {source}"


_PROFILE = [
    *_MOBILE_INTER,
    (
        "profile",
        f"""select *, temperature - t_inter as diff_temperature, zone,
 timezone('Europe/Paris', timezone('UTC', "timestamp")) as local_timestamp
 from inter, unnest(['Ville', 'Campagne']) as z(zone)
 where temperature is not null and t_inter is not null and elevation is not null
 and case when zone = 'Ville' then timezone('Europe/Paris', timezone('UTC', "timestamp")) <= timestamp '{SPLIT}'
 else timezone('Europe/Paris', timezone('UTC', "timestamp")) >= timestamp '{SPLIT}' end""",
    ),
]
_MINUTES = [
    *_MOBILE_INTER,
    (
        "minutes",
        """select thermo_name, date_trunc('minute', "timestamp") as "timestamp",
 avg(temperature) as sensor_t, avg(t_inter) as meteofrance_t from inter group by all""",
    ),
    (
        "grid",
        """select thermo_name, unnest(generate_series(min("timestamp"), max("timestamp"),
 interval '1 minute')) as "timestamp" from minutes group by thermo_name""",
    ),
    (
        "profile",
        """select thermo_name, "timestamp", sensor_t, meteofrance_t
 from grid left join minutes using (thermo_name, "timestamp")""",
    ),
    (
        "placed",
        'select *, row_number() over (partition by thermo_name order by "timestamp") as pos from profile',
    ),
]


def _fill(c: str) -> str:
    return f"""case when p.{c} is not null then p.{c} when lo_{c}.v is null then null
 when hi_{c}.v is null then lo_{c}.v
 else lo_{c}.v + (hi_{c}.v - lo_{c}.v) * (p.pos - lo_{c}.pos) / (hi_{c}.pos - lo_{c}.pos) end"""


def _known(c: str) -> str:
    return f"(select thermo_name, pos, {c} as v from placed where {c} is not null)"


_FILLED = f"""select p.thermo_name, p."timestamp",
 {", ".join(f"round({_fill(c)}, {DIGITS}) + 0e0 as {c}" for c in ("sensor_t", "meteofrance_t"))}
 from placed p """ + " ".join(
    f"""asof left join {_known(c)} lo_{c} on p.thermo_name = lo_{c}.thermo_name and p.pos >= lo_{c}.pos
 asof left join {_known(c)} hi_{c} on p.thermo_name = hi_{c}.thermo_name and p.pos <= hi_{c}.pos"""
    for c in ("sensor_t", "meteofrance_t")
)
# Bounds of the difference classes and their colours.
_BOUNDS = (-10, -5, -4, -3, -2, -1, 0, 1, 2, 3, 4)
_COLOURS = (
    "#30123b",
    "#455bcd",
    "#3e9cfe",
    "#18d7cb",
    "#48f882",
    "#a4fc3c",
    "#fea331",
    "#ef5911",
    "#c22403",
    "#7a0403",
)


def _class_case(value) -> str:
    inner = " ".join(
        f"when diff < {_BOUNDS[k + 1]} then {value(k)}" for k in range(9)
    )
    return f"case when diff is null then null {inner} else {value(9)} end"


_LOCATED = [*_MOBILE, *_TRIANGLES, ("located", _located("mobile", "p.id, p.lon, p.lat"))]
_PER_DEGREE = "111319.49079327358e0"


_FILLED_RAW = (
    "placed",
    """select thermo_name, id, date_trunc('minute', "timestamp") as "timestamp",
 case when id % 3 <> 0 then temperature end as temperature,
 row_number() over (partition by thermo_name order by date_trunc('minute', "timestamp"), id) as pos
 from inter""",
)
_DENSE = (
    "dense",
    """select numer_sta, "date", t_ground_0, delta_t from station_obs
 union all select numer_sta, "date" + interval '90 seconds', t_ground_0 + 1, delta_t from station_obs
 where numer_sta % 2 = 0
 union all select numer_sta, "date", t_ground_0, delta_t + 2 from station_obs where numer_sta % 5 = 0""",
)


def _share(u: str, v: str) -> str:
    """Area of the point and two vertices over that of the triangle, half of |d|."""
    return f"2*((x{u}-lon)*(y{v}-lat) - (x{v}-lon)*(y{u}-lat)) / d"


_MATCHES = (
    "matches",
    f"""select l.id, l.id_triangle, v.n as station, v.w as weight, o."date" as seen, o.t_ground_0, o.delta_t,
 (epoch_us(l."timestamp") - epoch_us(o."date")) / 360e6 as time_interp_weight
 from located l, unnest([{{'n': na, 'w': {_share("b", "c")}}}, {{'n': nb, 'w': {_share("c", "a")}}},
 {{'n': nc, 'w': {_share("a", "b")}}}]) as u(v)
 join dense o on o.numer_sta = v.n and o."date" > l."timestamp" - interval '6 minutes'
 and l."timestamp" >= o."date" """,
)
_SHUFFLED = (
    "locate_in_triangles",
    "join_station_observations",
    "join_station_observations_all",
    "overlap_fraction",
    "lcz_fractions",
    "transect_summary",
    "fill_linear",
)


def oracle_sql() -> dict[str, str]:
    found = _statements()
    found["delaunay_triangles_tiled"] = found["delaunay_triangles"]
    return found | {f"{name}_shuffled": found[name] for name in _SHUFFLED}


def _statements() -> dict[str, str]:
    cleaned = _r(*_MOBILE_DOUBLES)
    return {
        "hour_range_stats_mobile": _stats(
            "mobile_raw", ("temperature", "humidity", "accuracy"), ((0, 24), (12, 18), (18, 24), (21, 6))
        ),
        "hour_range_stats_meteo": _stats(
            "meteo_raw",
            ("temperature", "humidite", "vitesse", "temperature_bot", "temperature_top"),
            ((12, 18), (18, 24), (21, 6)),
        ),
        "clean_meteo": _with(*_METEO)
        + f' select id, {TRACK}, "timestamp", unique_id_track, {_r(*METEO)} from meteo',
        "aggregate_by_second": _with(*_raw("mobile_raw"), _SECONDS)
        + f' select id, {TRACK}, "timestamp", {cleaned} from per_second',
        "drop_duplicates_by_position": _with(*_raw("mobile_raw"), _SECONDS, _UNIQUE)
        + f' select id, {TRACK}, "timestamp", {cleaned} from uniq',
        "point_speed": _with(*_MOBILE[:5])
        + f' select id, {TRACK}, "timestamp", {_r("lon", "lat", "prev_lon", "prev_lat", "speed_m_s")} from speeds',
        "drop_stationary": _with(*_MOBILE[:5])
        + f""" select id, {TRACK}, "timestamp", {_r("lon", "lat", "speed_m_s")} from speeds
 where lon <> prev_lon or lat <> prev_lat""",
        "recompute_speed": _with(*_MOBILE[:8])
        + f' select id, unique_id_track, "timestamp", {_r("speed_m_s")} from speeds2',
        "smooth_speed": _with(*_MOBILE)
        + f' select id, unique_id_track, "timestamp", {_r("speed_m_s_smooth")} from mobile',
        "clean_mobile": _with(*_MOBILE)
        + f""" select id, {TRACK}, "timestamp", unique_id_track,
 {_r(*_MOBILE_DOUBLES, "speed_m_s", "speed_m_s_smooth")} from mobile""",
        "clean_reference": _with(*_REFERENCE)
        + f' select id, {TRACK}, "timestamp", unique_id_track, {cleaned} from reference',
        "track_keys": _with(*_raw("mobile_raw"))
        + f" select {TRACK}, {KEY} as unique_id_track, count(*) as points from mobile_raw group by all",
        "union_sources": _with(*_raw("mobile_raw", "meteo_raw"))
        + """ select round(temperature, 6) as temperature, "timestamp" from mobile_raw
 union all select round(temperature, 6), "timestamp" from meteo_raw""",
        "biometeo_index": _with(*_MOBILE, *_METEO, _BOTH, *_heat("both_sources", ""))
        + " select day, round(tn, 6) as tn, round(tx, 6) as tx, cast(ibm as double) as ibm from heat",
        "biometeo_index_by_thermo": _with(*_MOBILE, *_heat("mobile", "thermo_name"))
        + """ select thermo_name, day, round(tn, 6) as tn, round(tx, 6) as tx,
 cast(ibm as double) as ibm from heat""",
        "index_summary": _with(*_METEO, *_heat("meteo", ""))
        + """ select count(*) as nb_jours, round(min(tn), 2) as tn_min, round(max(tx), 2) as tx_max,
 cast(round(avg(cast(ibm as decimal(18,2))), 2) as double) as ibm_moyen,
 cast(min(ibm) as double) as ibm_min, cast(max(ibm) as double) as ibm_max from heat""",
        "delaunay_triangles": _with(*_TRIANGLES)
        + f""" select id_triangle, na as sta_a, nb as sta_b, nc as sta_c,
 {_r("xa", "ya", "xb", "yb", "xc", "yc")} from tri""",
        "triangle_vertices": _with(*_TRIANGLES)
        + f""" select id_triangle, v.k as id_pt, v.n as numer_insee, round(v.x, 6) as lon,
 round(v.y, 6) as lat from tri, unnest([{{'k': 1, 'n': na, 'x': xa, 'y': ya}},
 {{'k': 2, 'n': nb, 'x': xb, 'y': yb}}, {{'k': 3, 'n': nc, 'x': xc, 'y': yc}}]) as u(v)""",
        "attach_station_id": _with(
            *_TRIANGLES,
            (
                "corners",
                """select id_triangle, unnest([1, 2, 3, 4]) as id_pt, unnest([xa, xb, xc, xa]) as x,
 unnest([ya, yb, yc, ya]) as y from tri""",
            ),
        )
        + """ select id_triangle, id_pt, n as numer_insee, round(c.x, 6) as lon, round(c.y, 6) as lat
 from corners c left join s on c.x = s.x and c.y = s.y""",
        "locate_in_triangles": _with(*_LOCATED)
        + f""" select id, id_triangle, na as sta_a, nb as sta_b, nc as sta_c,
 {_r("lon", "lat")} from located""",
        "pick_one_per_id": _with(*_LOCATED)
        + " select id, min(id_triangle) as id_triangle from located group by id",
        "interpolate_plane": _with(*_MOBILE_INTER)
        + f' select id, id_triangle, {_r("t_inter")} from inter',
        "join_station_observations": _with(*_MOBILE_INTER)
        + """ select id, id_triangle, n as numer_sta, round(t0, 6) as t_ground_0,
 round(dt, 6) as delta_t, round(weight, 6) + 0e0 as time_interp_weight from reports""",
        "join_station_observations_all": _with(*_MOBILE_INTER, _DENSE, _MATCHES)
        + f" select id, id_triangle, station, {_r('t_ground_0', 'delta_t', 'time_interp_weight', 'weight')} from matches",
        "join_station_observations_dense": _with(
            *_MOBILE_INTER,
            _DENSE,
            _MATCHES,
            (
                "last",
                """select id, id_triangle, station, max(row(seen, t_ground_0, delta_t, time_interp_weight)) as r
 from matches group by id, id_triangle, station""",
            ),
        )
        + """ select id, id_triangle, station as numer_sta, round(r[2], 6) as t_ground_0,
 round(r[3], 6) as delta_t, round(r[4], 6) + 0e0 as time_interp_weight from last""",
        "interpolate_mobile": _with(*_MOBILE_INTER) + " " + _inter_select(_MOBILE_CARRY),
        "interpolate_meteo": _with(*_METEO_INTER) + " " + _inter_select(_METEO_CARRY),
        "interpolate_reference": _with(*_REFERENCE_INTER)
        + " "
        + _inter_select(("thermo_name", "sensor_name", "unique_id_track")),
        "project_points_3857": _with(*_raw("mobile_raw"))
        + """ select id, round(lon * 20037508.342789244e0 / 180e0, 3) as x3857,
 round(6378137e0 * asinh(tan(radians(lat))), 3) as y3857 from mobile_raw""",
        "project_rings_3857": _with(
            *_raw("lcz_rects"),
            (
                "corners",
                """select poly_id, part, unnest([1, 2, 3, 4, 5]) as corner,
 unnest([x0, x1, x1, x0, x0]) as x, unnest([y0, y0, y1, y1, y0]) as y from lcz_rects""",
            ),
        )
        + f""" select poly_id, cast(part as int) as part, cast(corner as int) as corner,
 round(x, 3) as x3857, round(6378137e0 * asinh(tan(radians(y / {_PER_DEGREE}))), 3) + 0e0 as y3857
 from corners""",
        "intersecting_polygons": _with(*_LCZ_32)
        + " select id, poly_id, lcz_primary from overlap where lcz_fraction > 1e-9",
        "intersecting_polygons_touching": _with(*_raw("lcz_points", "lcz_rects"), _SIDES, _AROUND, _MEETING)
        + " select * from meeting",
        "intersecting_polygons_touching_disc": _with(*_raw("lcz_points", "lcz_rects"), _AROUND, _MEETING_DISC)
        + " select * from meeting",
        "fraction_by_class": _with(*_LCZ_32, *_BY_CLASS)
        + f' select id, lcz_primary, {_r("lcz_fraction_sum")} from by_class',
        "pivot_classes": _with(*_LCZ_32, *_BY_CLASS)
        + f" select id, {_WIDE} from class_ranks group by id",
        "overlap_fraction": _with(*_LCZ_32)
        + f""" select id, poly_id, lcz_primary, {_r("lcz_fraction")} from overlap
 where lcz_fraction > 1e-9""",
        "overlap_fraction_disc": _with(*_LCZ_DISC)
        + f""" select id, poly_id, lcz_primary, {_r("lcz_fraction")} from overlap
 where lcz_fraction > 1e-9""",
        "rank_classes": _with(*_LCZ_32, *_BY_CLASS)
        + f' select id, lcz_primary, cast(rn as int) as rn, {_r("lcz_fraction_sum")} from class_ranks',
        "lcz_fractions": _with(*_LCZ_32, *_BY_CLASS) + " " + _LCZ_ROW,
        "lcz_fractions_touching": _with(*_LCZ_32, *_BY_CLASS_TOUCHING) + " " + _LCZ_ROW,
        "lcz_fractions_disc": _with(*_LCZ_DISC, *_BY_CLASS) + " " + _LCZ_ROW,
        "transect_profile": _with(*_PROFILE)
        + f""" select id, thermo_name, zone, "timestamp", local_timestamp,
 {_r("temperature", "diff_temperature", "elevation")} from profile""",
        "transect_summary": _with(
            *_PROFILE,
            (
                "numbered",
                """select *, row_number() over (partition by thermo_name, zone order by "timestamp", id) - 1
 as pos, count(*) over (partition by thermo_name, zone) as n from profile""",
            ),
            (
                "zones",
                """select thermo_name, zone, count(*) as zone_rows,
 max(case when pos = n // 2 then "timestamp" end) as mid_timestamp,
 min(temperature) as zone_temperature_min from numbered group by all""",
            ),
            (
                "series",
                """select thermo_name, min(temperature) as temperature_min,
 max(temperature) as temperature_max, min("timestamp") as timestamp_min,
 max("timestamp") as timestamp_max from profile group by all""",
            ),
        )
        + f""" select thermo_name, zone, zone_rows, mid_timestamp, timestamp_min, timestamp_max,
 {_r("zone_temperature_min", "temperature_min", "temperature_max")}
 from zones join series using (thermo_name)""",
        "classify_difference": _with(
            *_MOBILE_INTER,
            ("d", "select id, temperature - t_inter as diff from inter"),
        )
        + f""" select id, round(diff, 6) + 0e0 as diff_temperature, {_class_case(str)} as diff_class,
 {_class_case(lambda k: repr(_COLOURS[k]))} as diff_colour from d""",
        "minute_profile": _with(*_MINUTES)
        + f""" select thermo_name, "timestamp", {_r("sensor_t", "meteofrance_t")} from profile""",
        "fill_linear": _with(*_MINUTES) + " " + _FILLED,
        "fill_linear_raw": _with(*_MOBILE_INTER, _FILLED_RAW)
        + f""" select p.thermo_name, p.id, p."timestamp",
 round({_fill("temperature")}, {DIGITS}) + 0e0 as temperature from placed p
 asof left join {_known("temperature")} lo_temperature
 on p.thermo_name = lo_temperature.thermo_name and p.pos >= lo_temperature.pos
 asof left join {_known("temperature")} hi_temperature
 on p.thermo_name = hi_temperature.thermo_name and p.pos <= hi_temperature.pos""",
        "replace_table": _with(*_REFERENCE)
        + f' select id, {TRACK}, "timestamp", unique_id_track, {cleaned} from reference',
        "replace_table_from_itself": _with(
            *_REFERENCE,
            ("moved", "select * replace (temperature + id % 2 as temperature) from reference"),
        )
        + f' select id, {TRACK}, "timestamp", unique_id_track, {cleaned} from moved',
        "drop_table": _with(*_METEO)
        + """ select count(distinct cast("timestamp" as date)) as days,
 count(distinct cast("timestamp" as date)) as saved_days, true as named, false as left_over from meteo""",
        "select_thermo": _with(*_MOBILE)
        + f""" select id, "timestamp", {_r("temperature", "humidity")} from mobile
 where thermo_name = 'Thermo 1'""",
    }
