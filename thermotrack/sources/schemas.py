"""Column types of the input tables, points being (lon, lat) in degrees."""

# Names and types of the input tables.
MOBILE_RAW = (
    "id bigint, timestamp timestamp, temperature double, humidity double, lon double, lat double, "
    "accuracy double, sensor_name string, id_track int, thermo_name string, elevation double"
)
METEO_RAW = (
    "id bigint, timestamp timestamp, id_track int, lon double, lat double, altitude double, "
    "vitesse double, direction double, temperature double, humidite double, pression double, "
    "temperature_bot double, temperature_top double, pm_1_ug_m3 double, pm_2_5_ug_m3 double, "
    "pm_10_ug_m3 double, niveau_sonore_db_a double, distancegauche double, "
    "distancedroite double, thermo_name string, sensor_name string, elevation double"
)
STATIONS = (
    "id int, numer_insee bigint, nom_station string, lon double, lat double, elevation double, "
    "zone int"
)
STATION_OBSERVATIONS = (
    "delta_t double, date timestamp, numer_sta bigint, dd int, ff double, t double, u int, "
    "ray_glo01 int, elevation double, t_ground_0 double"
)
LCZ_POLYGONS = (
    "poly_id bigint, lcz_primary int, rings array<array<struct<x: double, y: double>>>"
)
