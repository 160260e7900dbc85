"""Explicit schemas of landed files and loaded tables."""

from pyspark.sql import types as T

_LONG, _INT, _DBL, _STR, _TS, _BOOL = (
    T.LongType(), T.IntegerType(), T.DoubleType(), T.StringType(), T.TimestampType(), T.BooleanType())


def _schema(*groups) -> T.StructType:
    return T.StructType([T.StructField(name, kind, True) for kind, names in groups for name in names.split()])


# Landed records keep text for anything that must be coerced rather than fail the read.
SESSION_RECORDS = _schema(
    (_LONG, "year meeting_key session_key"), (_STR, "session_name session_type date_start date_end gmt_offset"),
    (_LONG, "circuit_key"), (_STR, "circuit_short_name location country_name country_code"), (_LONG, "country_key"))

LAP_RECORDS = _schema(
    (_STR, "meeting_key session_key driver_number lap_number lap_duration date_start is_pit_out_lap"),
    (_STR, "duration_sector_1 duration_sector_2 duration_sector_3 st_speed i1_speed i2_speed"))

DRIVER_RECORDS = _schema(
    (_INT, "driver_number"),
    (_STR, "full_name broadcast_name name_acronym first_name last_name country_code team_name team_colour headshot_url"),
    (_LONG, "session_key"))

WEATHER_RECORDS = _schema(
    (_STR, "year month day hour"), (_STR, "temp rhum pres wspd wdir prcp cldc"))

STATIONS = _schema((_STR, "id country"), (_DBL, "latitude longitude elevation"))
STATION_NAMES = _schema((_STR, "station name language"))
OVERRIDES = _schema((_LONG, "circuit_key"), (_INT, "chosen_candidate_rank"))
PAGE_CIRCUITS = _schema(
    (_STR, "circuit_name circuit_url locality country"), (_DBL, "latitude longitude"), (_STR, "scraped_at_utc"))

SESSIONS_SCOPE = _schema(
    (_LONG, "year meeting_key session_key"), (_STR, "session_name session_type"), (_TS, "date_start date_end"),
    (_STR, "gmt_offset"), (_LONG, "circuit_key"), (_STR, "circuit_short_name location country_name country_code"),
    (_LONG, "country_key"), (_TS, "session_start_hour_utc"))

# Star schema.
DIM_CIRCUITS = _schema(
    (_INT, "circuit_key"),
    (_STR, "circuit_short_name location country_name country_code wikipedia_circuit_url station_id"))
DIM_DRIVERS = _schema(
    (_INT, "driver_number"),
    (_STR, "full_name broadcast_name name_acronym first_name last_name country_code team_name team_colour headshot_url"))
DIM_SESSIONS = _schema(
    (_INT, "session_key meeting_key year"), (_STR, "session_name session_type"), (_TS, "date_start date_end"),
    (T.DayTimeIntervalType(), "gmt_offset"), (_INT, "circuit_key"))
FACT_LAPS = _schema(
    (_INT, "meeting_key session_key driver_number lap_number year circuit_key"), (_TS, "lap_hour_utc"),
    (T.DecimalType(10, 2), "st_speed i1_speed i2_speed"),
    (T.DecimalType(10, 3), "duration_sector_1 duration_sector_2 duration_sector_3"),
    (T.DecimalType(10, 2), "temp rhum pres wspd wdir prcp cldc"),
    (T.DecimalType(10, 3), "lap_duration"), (_STR, "source_file"))

STAR = {"dim_circuits": DIM_CIRCUITS, "dim_drivers": DIM_DRIVERS, "dim_sessions": DIM_SESSIONS, "fact_laps": FACT_LAPS}
STAR_KEYS = {
    "dim_circuits": ["circuit_key"], "dim_drivers": ["driver_number"], "dim_sessions": ["session_key"],
    "fact_laps": ["meeting_key", "session_key", "driver_number", "lap_number"]}
STAR_NOT_NULL = {
    "dim_circuits": ["circuit_key"], "dim_drivers": ["driver_number"],
    "dim_sessions": ["session_key", "meeting_key", "year"],
    "fact_laps": ["meeting_key", "session_key", "driver_number", "lap_number", "year", "circuit_key", "lap_duration"]}
STAR_REFERENCES = [
    # (table, column, parent)
    ("dim_sessions", "circuit_key", "dim_circuits"),
    ("fact_laps", "session_key", "dim_sessions"),
    ("fact_laps", "driver_number", "dim_drivers"),
    ("fact_laps", "circuit_key", "dim_circuits"),
]
STAR_LENGTHS = {
    "dim_circuits": {"circuit_short_name": 100, "location": 200, "country_name": 100, "country_code": 10,
                     "station_id": 20},
    "dim_drivers": {"full_name": 200, "broadcast_name": 200, "name_acronym": 5, "first_name": 100,
                    "last_name": 100, "country_code": 10, "team_name": 200, "team_colour": 10},
    "dim_sessions": {"session_name": 100, "session_type": 50},
    "fact_laps": {"source_file": 200},
}
