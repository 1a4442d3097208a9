"""Fixed values.

Everything here has to equal what existing users of the analysis rely on:
index tables, validation limits, names, formats and thresholds.
"""

# --- Fixed values: air-quality index bands -------------------------------
# (concentration low, concentration high, index low, index high), both ends closed.
PM25_BANDS = [
    (0.0, 12.0, 0, 50),
    (12.1, 35.4, 51, 100),
    (35.5, 55.4, 101, 150),
    (55.5, 150.4, 151, 200),
    (150.5, 250.4, 201, 300),
    (250.5, 500.4, 301, 500),
]
PM10_BANDS = [
    (0, 54, 0, 50),
    (55, 154, 51, 100),
    (155, 254, 101, 150),
    (255, 354, 151, 200),
    (355, 424, 201, 300),
    (425, 604, 301, 500),
]
O3_BANDS = [
    (0.000, 0.054, 0, 50),
    (0.055, 0.070, 51, 100),
    (0.071, 0.085, 101, 150),
    (0.086, 0.105, 151, 200),
    (0.106, 0.200, 201, 300),
]
# Index given to a concentration above the last band.
PM25_ABOVE = 500
PM10_ABOVE = 500
O3_ABOVE = 300

# (highest index of the category, category, colour); above the last: HAZARDOUS.
AQI_CATEGORIES = [
    (50, "Good", "green"),
    (100, "Moderate", "yellow"),
    (150, "Unhealthy for Sensitive Groups", "orange"),
    (200, "Unhealthy", "red"),
    (300, "Very Unhealthy", "purple"),
]
HAZARDOUS = ("Hazardous", "maroon")
UNKNOWN = ("Unknown", "gray")

# WHO 24 h guideline for PM2.5, µg/m³.
WHO_PM25_24H = 15.0

# --- Fixed values: validation rules ---------------------------------------
# parameter: (lowest, highest) allowed value, both ends allowed.
PARAMETER_RANGES = {
    "pm1": (0, 1000),
    "pm25": (0, 1000),
    "pm10": (0, 2000),
    "o3": (0, 500),
    "no2": (0, 500),
    "so2": (0, 500),
    "co": (0, 50000),
    "temperature": (-50, 60),
    "humidity": (0, 100),
    "pressure": (800, 1100),
}
REQUIRED_FIELDS = ["value", "parameter", "period", "locationId"]
MAX_AGE_DAYS = 5 * 365
MIN_QUALITY_SCORE = 90.0
FIRST_ERRORS = 10
FIRST_RESULTS = 5

# Message texts.
MISSING_FIELD = "Missing required field: "
PARAMETER_NOT_OBJECT = "'parameter' must be a dictionary"
PARAMETER_INCOMPLETE = "'parameter' must have 'id' and 'name' fields"
PERIOD_NOT_OBJECT = "'period' must be a dictionary"
PERIOD_INCOMPLETE = "'period' must have 'datetimeFrom' field"
VALUE_NOT_NUMERIC = "Value is not numeric: "
TIME_IN_FUTURE = "Timestamp is in the future: "
TIME_TOO_OLD = "Timestamp is older than 5 years: "
TIME_INVALID = "Invalid timestamp format: "

# --- Fixed values: locations ----------------------------------------------
LOCATION_NAMES = {
    6142174: "Ranibari (SC-43 GD Labs)",
    6093549: "Golfutar",
}
DENIED_LOCATIONS = [3459]
LOCATION_LABEL = "Location "
UNKNOWN_PARAMETER = "unknown"

# --- Fixed values: charts --------------------------------------------------
SCATTER_PAIRS = [
    ("pm25", "pm1"),
    ("pm25", "temperature"),
    ("relativehumidity", "temperature"),
    ("pm25", "relativehumidity"),
    ("pm1", "temperature"),
    ("pm1", "relativehumidity"),
]
HISTOGRAM_BINS = 50
MONTH_ABOVE_DAYS = 365
WEEK_ABOVE_DAYS = 60
BOX_PERIODS = 30
VIOLIN_PERIODS = 20
HEATMAP_DATES = 60
AXIS_TICKS = 20
PERIOD_DAYS = 15
WHISKER_REACH = 1.5
DENSITY_POINTS = 100
DENSITY_CUT = 2.0

# --- Fixed values: runs and alerts ------------------------------------------
RUNS_KEPT = 100
MAX_CONSECUTIVE_FAILURES = 3
MIN_RECORDS_PER_LOCATION = 1
MAX_RESPONSE_SECONDS = 60
PM25_ALERT = 150.0
ERROR_RATE_ALERT = 0.10
HOTSPOTS = 5
LATEST_RECORDS = 10
RUN_COUNTERS = [
    "total_records_fetched",
    "total_records_deduplicated",
    "total_locations_processed",
    "successful_locations",
    "failed_locations",
    "duration_seconds",
]
