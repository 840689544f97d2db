"""Column contracts, presets and fixed values shared by the operators."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

# --- fixed values: column names -------------------------------------------

PICKUP = "tpep_pickup_datetime"
DROPOFF = "tpep_dropoff_datetime"
TARGET = "fare_amount"

RAW_TRIP_SCHEMA = T.StructType(
    [
        T.StructField("VendorID", T.LongType()),
        T.StructField(PICKUP, T.TimestampNTZType()),
        T.StructField(DROPOFF, T.TimestampNTZType()),
        T.StructField("passenger_count", T.DoubleType()),
        T.StructField("trip_distance", T.DoubleType()),
        T.StructField("RatecodeID", T.DoubleType()),
        T.StructField("store_and_fwd_flag", T.StringType()),
        T.StructField("PULocationID", T.LongType()),
        T.StructField("DOLocationID", T.LongType()),
        T.StructField("payment_type", T.LongType()),
        T.StructField("fare_amount", T.DoubleType()),
        T.StructField("extra", T.DoubleType()),
        T.StructField("mta_tax", T.DoubleType()),
        T.StructField("tip_amount", T.DoubleType()),
        T.StructField("tolls_amount", T.DoubleType()),
        T.StructField("improvement_surcharge", T.DoubleType()),
        T.StructField("total_amount", T.DoubleType()),
        T.StructField("congestion_surcharge", T.DoubleType()),
        T.StructField("Airport_fee", T.DoubleType()),
    ]
)

REQUIRED_COLUMNS = [
    PICKUP,
    DROPOFF,
    "passenger_count",
    "trip_distance",
    "PULocationID",
    "DOLocationID",
    "payment_type",
    "fare_amount",
    "tip_amount",
    "total_amount",
]

CRITICAL_COLUMNS = [
    PICKUP,
    DROPOFF,
    "trip_distance",
    "fare_amount",
    "PULocationID",
    "DOLocationID",
]

BASIC_FEATURES = [
    "trip_distance",
    "passenger_count",
    "PULocationID",
    "DOLocationID",
    "pickup_hour",
    "pickup_dayofweek",
    "pickup_month",
    "is_weekend",
    "trip_duration_minutes",
]

NUMERICAL_FEATURES = [
    "trip_distance",
    "passenger_count",
    "trip_duration_minutes",
    "avg_speed_mph",
    "pickup_hour",
    "pickup_dayofweek",
    "pickup_month",
    "hour_sin",
    "hour_cos",
    "dow_sin",
    "dow_cos",
]
CATEGORICAL_FEATURES = ["PULocationID", "DOLocationID", "VendorID"]
BINARY_FEATURES = ["is_weekend", "is_rush_hour", "same_location", "has_tolls"]
ALL_FEATURES = NUMERICAL_FEATURES + CATEGORICAL_FEATURES + BINARY_FEATURES

DRIFT_FEATURES = ["trip_distance", "passenger_count", "pickup_hour", "pickup_dayofweek"]
STATS_FEATURES = DRIFT_FEATURES + ["fare_amount"]
HISTOGRAM_FEATURES = ["trip_distance", "passenger_count", "pickup_hour"]
CORRELATION_COLUMNS = [
    "passenger_count",
    "trip_distance",
    "fare_amount",
    "tip_amount",
    "total_amount",
    "pickup_hour",
    "pickup_dayofweek",
    "trip_duration_minutes",
]
TRANSFORMER_NUMERICAL = [
    "trip_distance",
    "passenger_count",
    "pickup_hour",
    "pickup_dayofweek",
    "trip_duration_minutes",
]
TRANSFORMER_CATEGORICAL = ["PULocationID", "DOLocationID"]

ZONE_SCHEMA = T.StructType(
    [
        T.StructField("LocationID", T.LongType()),
        T.StructField("Borough", T.StringType()),
        T.StructField("Zone", T.StringType()),
        T.StructField("service_zone", T.StringType()),
    ]
)

LOG_INPUTS = T.StructType(
    [
        T.StructField("trip_distance", T.DoubleType()),
        T.StructField("passenger_count", T.LongType()),
        T.StructField("PULocationID", T.LongType()),
        T.StructField("DOLocationID", T.LongType()),
        T.StructField("pickup_hour", T.LongType()),
        T.StructField("pickup_dayofweek", T.LongType()),
        T.StructField("pickup_month", T.LongType()),
        T.StructField("is_weekend", T.LongType()),
        T.StructField("trip_duration_minutes", T.DoubleType()),
        T.StructField("VendorID", T.LongType()),
    ]
)

# Both spellings of the nested record occur in stored logs.
LOG_SCHEMA = T.StructType(
    [
        T.StructField("timestamp", T.StringType()),
        T.StructField("inputs", LOG_INPUTS),
        T.StructField("input", LOG_INPUTS),
        T.StructField("prediction", T.DoubleType()),
    ]
)

# --- fixed values: rules ---------------------------------------------------

FARE_RANGE = (2.5, 500.0)
DISTANCE_RANGE = (0.1, 100.0)
PASSENGER_RANGE = (1.0, 6.0)
TOTAL_RANGE = (2.5, 1000.0)
DURATION_RANGE = (1.0, 180.0)
SERVING_SPEED_RANGE = (1.0, 60.0)

# Names and conditions of the quality report, and of the anomaly counts.
QUALITY_ISSUES = {
    "Missing passenger_count": "passenger_count IS NULL",
    "Zero/Negative fare": "fare_amount <= 0",
    "Fare > $500": "fare_amount > 500",
    "Zero trip distance": "trip_distance = 0",
    "Distance > 100 miles": "trip_distance > 100",
    "Zero passenger count": "passenger_count = 0",
    "Negative duration": "trip_duration_minutes < 0",
    "Duration > 3 hours": "trip_duration_minutes > 180",
}
ANOMALIES = {
    "zero distance": "trip_distance = 0",
    "distance > 50": "trip_distance > 50",
    "distance > 100": "trip_distance > 100",
    "zero passengers": "passenger_count = 0",
    "passengers > 6": "passenger_count > 6",
    "negative duration": "trip_duration_minutes < 0",
    "zero duration": "trip_duration_minutes = 0",
    "duration > 60": "trip_duration_minutes > 60",
    "duration > 120": "trip_duration_minutes > 120",
}
# Limits of the evaluation verdicts: r2 above, MAPE below, gap of the MAE below, MAE above; factors
# of the MAE for high fares and for the alert level.
VERDICT_R2, VERDICT_MAPE, VERDICT_GAP, VERDICT_MAE = 0.8, 20, 0.5, 2.5
VERDICT_HIGH_FARES, VERDICT_ALERT = 1.5, 1.2

DAY_NAMES = ["Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday"]
PAYMENT_LABELS = {1: "Credit Card", 2: "Cash", 3: "No Charge", 4: "Dispute"}

TIME_OF_DAY_EDGES = [0, 6, 12, 18, 24]
TIME_OF_DAY_LABELS = ["night", "morning", "afternoon", "evening"]
DISTANCE_CATEGORY_EDGES = [0, 1, 3, 5, 10, 100]
DISTANCE_CATEGORY_LABELS = ["very_short", "short", "medium", "long", "very_long"]
FARE_BIN_EDGES = [0, 10, 20, 30, 50, 100, float("inf")]
FARE_BIN_LABELS = ["$0-10", "$10-20", "$20-30", "$30-50", "$50-100", "$100+"]
DISTANCE_BIN_EDGES = [0, 1, 3, 5, 10, 20, float("inf")]
DISTANCE_BIN_LABELS = ["0-1 mi", "1-3 mi", "3-5 mi", "5-10 mi", "10-20 mi", "20+ mi"]
ERROR_BUCKETS = [
    (0.0, 1.0, "Excellent"),
    (1.0, 2.0, "Good"),
    (2.0, 5.0, "Acceptable"),
    (5.0, 10.0, "Poor"),
    (10.0, float("inf"), "Very Poor"),
]
ERROR_PERCENTILES = [50, 75, 90, 95, 99]

DEFAULT_ROUTE_MILES = 3.0
NETWORK_SPEED_MPH = 11.0
FALLBACK_SPEED_MPH = 12.0

DRIFT_THRESHOLD = 0.3
DRIFT_SHARE = 0.5
MEAN_SHIFT_PCT = 10.0
MIN_LOG_ROWS = 30
RECENT_LOG_ROWS = 100
LOG_RETENTION = 1000
REFERENCE_SAMPLE_ROWS = 10_000
SAMPLE_SEED = 42

ALERT_LIMITS = {"mae_increase_pct": 15.0, "max_mae": 3.5, "r2_decrease": 0.05}

# --- cleaning presets --------------------------------------------------------


@dataclass(frozen=True)
class CleaningPreset:
    """One of the two cleaning policies.

    ``strict`` keeps the required columns and drops every row with a null;
    ``impute`` drops nulls in the critical columns only, fills the passenger
    count, and cleans on duration and speed as well.
    """

    name: str
    null_subset: tuple[str, ...] | None
    fill: tuple[tuple[str, float], ...]
    max_speed: float


STRICT = CleaningPreset("strict", None, (), 60.0)
IMPUTE = CleaningPreset("impute", tuple(CRITICAL_COLUMNS), (("passenger_count", 1.0),), 70.0)
PRESETS = {p.name: p for p in (STRICT, IMPUTE)}
