"""Column names, limits and defaults that results depend on."""

TARGET = "lap_duration"

LAP_KEY = ["meeting_key", "session_key", "driver_number", "lap_number"]
ID_COLS = ["year", "meeting_key", "session_key", "circuit_key", "driver_number", "lap_number"]
SPEED_COLS = ["st_speed", "i1_speed", "i2_speed"]
SECTOR_COLS = ["duration_sector_1", "duration_sector_2", "duration_sector_3"]
SPORT_COLS = SPEED_COLS + SECTOR_COLS
WEATHER_COLS = ["temp", "rhum", "pres", "wspd", "wdir", "prcp", "cldc"]

SCOPE_COLS = [
    "year", "meeting_key", "session_key", "session_name", "session_type", "date_start", "date_end",
    "gmt_offset", "circuit_key", "circuit_short_name", "location", "country_name", "country_code",
    "country_key",
]
CONTEXT_COLS = [
    "session_name", "session_type", "location", "country_name", "gmt_offset", "date_start_session",
    "date_end_session", "lap_hour_utc", "station_id", "wikipedia_circuit_url",
]
SOURCE_FILE = "__source_file"
DATASET_COLS = ID_COLS + CONTEXT_COLS + SPORT_COLS + WEATHER_COLS + [TARGET]

# Columns a model must not see: keys, labels, values of the lap itself, and weak features.
EXCLUDED_FEATURES = [
    "meeting_key", "session_key", "session_name", "session_type", "location", "country_name",
    "date_start_session", "date_end_session", "wikipedia_circuit_url", "station_id", "gmt_offset",
    "__source_file", "lap_hour_utc", "lap_duration", "duration_sector_1", "duration_sector_2",
    "duration_sector_3", "total_sector_time", "sector_1_ratio", "sector_2_ratio", "prcp", "wspd",
    "cldc", "wdir", "weather_severity", "year_avg_laptime", "driver_avg_laptime",
]
MODEL_FEATURES = [
    "year", "circuit_key", "driver_number", "lap_number", "st_speed", "i1_speed", "i2_speed",
    "temp", "rhum", "pres", "circuit_avg_laptime", "avg_speed", "lap_progress", "driver_perf_score",
]
DRIFT_FEATURES = [
    "driver_number", "circuit_key", "st_speed", "i1_speed", "i2_speed", "temp", "rhum", "pres",
    "lap_number", "year",
]

LAP_PAGE_COLS = LAP_KEY + ["year", "circuit_key", TARGET] + SPORT_COLS + ["temp", "rhum", "pres"]
CIRCUIT_COLS = ["circuit_key", "circuit_short_name", "location", "country_name", "country_code"]
DRIVER_COLS = [
    "driver_number", "full_name", "name_acronym", "team_name", "team_colour", "country_code",
    "headshot_url",
]
SESSION_COLS = [
    "session_key", "meeting_key", "year", "session_name", "session_type", "circuit_key", "date_start",
]

# Cleaning.
QUANTILE_LOW, QUANTILE_HIGH, QUANTILE_MIN_ROWS = 0.01, 0.99, 20

# Serving defaults.
DEFAULT_YEAR = 2025
DEFAULT_CIRCUIT_AVG = 90.0
DEFAULT_MAX_LAP = 70
DEFAULT_TEMP, DEFAULT_RHUM, DEFAULT_PRES, DEFAULT_LAP_NUMBER = 25.0, 50.0, 1013.0, 1
DEFAULT_PROFILE = {"lap_duration": 90.0, "st_speed": 310.0, "i1_speed": 295.0, "i2_speed": 285.0}
PROFILE_LAPS = 100
MAX_PAGE_SIZE, MAX_SESSION_LIMIT, MAX_LAP_LIMIT = 1000, 500, 1000

# Inclusive bounds of a scoring request; None means open.
REQUEST_BOUNDS = {
    "driver_number": (1, 99), "circuit_key": (1, None), "st_speed": (0, 400), "i1_speed": (0, 400),
    "i2_speed": (0, 400), "temp": (-20, 60), "rhum": (0, 100), "pres": (900, 1100),
    "lap_number": (1, None), "circuit_avg_laptime": (60, 150),
}
REQUEST_OPTIONAL = ["circuit_avg_laptime", "driver_perf_score", "year"]

# Match weights: (left text, right text, weight).
MATCH_WEIGHTS = [
    ("short", "name", 0.55), ("loc", "locality", 0.25), ("short", "locality", 0.10), ("loc", "name", 0.10),
]

EARTH_RADIUS_KM = 6371.0
BOX_DEGREES, WIDE_BOX_DEGREES = 5.0, 15.0

# Retention in days by data category.
RETENTION_DAYS = {"raw": 730, "transform": 365, "dataset": 365, "model": 730, "log": 90, "metric": 1095}

# Monitoring.
LATENCY_BUCKETS = [0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0, 10.0]
PREDICTION_BUCKETS = [0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1.0, 2.5]
QUERY_BUCKETS = [0.001, 0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1.0, 2.0]
HISTOGRAMS = {"latency": LATENCY_BUCKETS, "prediction": PREDICTION_BUCKETS, "query": QUERY_BUCKETS}
ALERT_RULES = {
    # name: (measure, comparison, limit, minutes the condition must hold)
    "HighPredictionLatency": ("p95_prediction_seconds", ">", 1.0, 5),
    "HighPredictionErrorRate": ("prediction_error_rate", ">", 0.05, 5),
    "ModelNotLoaded": ("model_loaded", "=", 0.0, 1),
    "HighAPIErrorRate": ("http_5xx_ratio", ">", 0.01, 5),
    "APIDown": ("api_up", "=", 0.0, 1),
    "DatabaseConnectionIssues": ("database_connected", "=", 0.0, 2),
    "SlowDatabaseQueries": ("p95_query_seconds", ">", 2.0, 5),
}

# Training.
SEED = 42
TRAIN_YEARS, TEST_YEAR, TEST_SIZE = [2023, 2024], 2025, 0.2
CV_FOLDS, GRID_FOLDS = 5, 3
BASELINE = {
    "random_forest": {"numTrees": 300, "maxDepth": 15, "minInstancesPerNode": 2, "featureSubsetStrategy": "all"},
    "boosted_trees": {"maxIter": 300, "maxDepth": 7, "stepSize": 0.05, "subsamplingRate": 0.8,
                      "featureSubsetStrategy": "0.8"},
}
GRID = {
    "random_forest": {"numTrees": [150, 200], "maxDepth": [15, 20], "minInstancesPerNode": [1, 2],
                      "featureSubsetStrategy": ["sqrt", "0.7"]},
    "boosted_trees": {"maxIter": [100, 200, 300], "maxDepth": [7, 10], "stepSize": [0.05, 0.1],
                      "minInstancesPerNode": [1, 3]},
}
# Held for every point of a grid.
FIXED = {"random_forest": {}, "boosted_trees": {"subsamplingRate": 0.75, "featureSubsetStrategy": "0.75"}}
OVERFIT_LIMIT, CLOSE_MAE, GOOD_MAE = 5.0, 0.01, 1.5
