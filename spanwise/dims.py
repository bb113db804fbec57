"""Fixed dimension values."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Span operation to the deployment that serves it.
OPERATION_SERVICE = {
    "HTTP GET /hotels": "frontend-deployment",
    "HTTP GET /recommendations": "frontend-deployment",
    "HTTP POST /user": "frontend-deployment",
    "HTTP POST /reservation": "frontend-deployment",
    "MakeReservation": "srv-reservation",
    "CheckAvailability": "srv-reservation",
    "memcached_get_profile": "memcached-profile-deployment",
    "memcached_capacity_get_multi_number": "memcached-reservation-deployment",
    "memcached_reserve_get_multi_number": "memcached-reservation-deployment",
    "memcached_get_multi_rate": "memcached-rate-deployment",
    "memcached_reservation_get": "memcached-reservation-deployment",
    "memcached_capacity_get": "memcached-reservation-deployment",
    "memcached_reservation_set_multi": "memcached-reservation-deployment",
    "/profile.Profile/GetProfiles": "srv-profile",
    "/search.Search/Nearby": "srv-search",
    "/user.User/CheckUser": "srv-user",
    "/geo.Geo/Nearby": "srv-geo",
    "/recommendation.Recommendation/GetRecommendations": "srv-recommendation",
    "/rate.Rate/GetRates": "srv-rate",
    "/reservation.Reservation/CheckAvailability": "srv-reservation",
    "/reservation.Reservation/MakeReservation": "srv-reservation",
    "mongodb_reservation_find": "mongodb-reservation-deployment",
    "mongodb_capacity_get": "mongodb-reservation-deployment",
    "mongodb_reservation_insert": "mongodb-reservation-deployment",
    "mongodb_capacity_get_multi_number": "mongodb-reservation-deployment",
    "mongo_rate": "mongodb-rate-deployment",
    "mongo_user": "mongodb-user-deployment",
    "mongo_profile": "mongodb-profile-deployment",
    "mongo_geo": "mongodb-geo-deployment",
    "mongo_reservation": "mongodb-reservation-deployment",
}

# Pod name prefix to service.
POD_PREFIX_SERVICE = {
    "memcached-reservation": "memcached-reserve",
    "memcached-profile": "memcached-profile",
    "memcached-rate": "memcached-rate",
    "memcached-reserve": "memcached-reserve",
    "mongodb-reservation": "mongodb-reservation",
    "mongodb-profile": "mongodb-profile",
    "mongodb-rate": "mongodb-rate",
    "mongodb-user": "mongodb-user",
    "mongodb-geo": "mongodb-geo",
    "srv-recommendation": "srv-recommendation",
    "srv-reservation": "srv-reservation",
    "srv-profile": "srv-profile",
    "srv-recommend": "srv-recommendation",
    "srv-search": "srv-search",
    "srv-rate": "srv-rate",
    "srv-user": "srv-user",
    "srv-geo": "srv-geo",
    "frontend": "frontend",
}

# Cache and database workloads that carry no configuration label.
EXTRA_WORKLOAD_PREFIX = {
    "memcached-profile": "memcached-profile",
    "memcached-rate": "memcached-rate",
    "memcached-reserv": "memcached-reserve",
    "mongodb-rate": "mongodb-rate",
    "mongodb-user": "mongodb-user",
    "mongodb-reservation": "mongodb-reservation",
    "mongodb-profile": "mongodb-profile",
    "mongodb-geo": "mongodb-geo",
}

# Service in pod health to the key of its configuration.
CONFIG_KEY_ALIAS = {
    "memcached-reserve": "memcached-reservation-deployment",
    "memcached-rate": "memcached-rate-deployment",
    "memcached-profile": "memcached-profile-deployment",
    "frontend": "frontend-deployment",
    "mongodb-rate": "mongodb-rate-deployment",
    "mongodb-user": "mongodb-user-deployment",
    "mongodb-reservation": "mongodb-reservation-deployment",
    "mongodb-profile": "mongodb-profile-deployment",
    "mongodb-geo": "mongodb-geo-deployment",
}

# Services whose replica count stays at one.
FIXED_REPLICA_SERVICES = (
    "mongodb-rate", "mongodb-user", "mongodb-reservation", "mongodb-profile", "mongodb-geo",
    "mongodb-rate-deployment", "mongodb-user-deployment", "mongodb-reservation-deployment",
    "mongodb-profile-deployment", "mongodb-geo-deployment",
)

# Parameter bounds (name, key, low, high, minimum, note). Durations keep their suffix.
PARAMETER_BOUNDS = (
    ("min_scale", "autoscaling.knative.dev/min-scale", None, None, "0", "Integer; 0 allows scale-to-zero"),
    ("max_scale", "autoscaling.knative.dev/max-scale", None, None, "0", "Integer; 0 means unlimited"),
    ("scale_down_delay", "autoscaling.knative.dev/scale-down-delay", "0s", "1h", None, None),
    ("stable_window", "autoscaling.knative.dev/window", "6s", "1h", None, None),
    ("panic_window_percentage", "autoscaling.knative.dev/panic-window-percentage", "1.0", "100.0", None, None),
    ("panic_threshold_percentage", "autoscaling.knative.dev/panic-threshold-percentage", "110.0", "1000.0", None,
     None),
    ("max_scale_up_rate", "max-scale-up-rate", None, None, None, None),
    ("max_scale_down_rate", "max-scale-down-rate", None, None, None, None),
)


def mapping_table(spark: SparkSession, mapping: dict[str, str], key: str, value: str) -> DataFrame:
    """A fixed mapping as a two-column table."""
    return spark.createDataFrame(sorted(mapping.items()), f"{key} string, {value} string")


def bounds_table(spark: SparkSession) -> DataFrame:
    rows = [(i, *row) for i, row in enumerate(PARAMETER_BOUNDS)]
    return spark.createDataFrame(
        rows, "pos int, name string, key string, low string, high string, minimum string, note string")
