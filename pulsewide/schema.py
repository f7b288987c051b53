"""Names, types and domain values shared by every module."""

from __future__ import annotations

from pyspark.sql import types as T

# ---------------------------------------------------------------------------
# Column names, codes and lists given by the input data and the
# published analysis. Results depend on them being exactly these.
# ---------------------------------------------------------------------------

ID_COLS = ["sourceId", "sourceUniqueId", "npsDate"]
SCORE_COL = "npsScore"
KEY_COL = "driverKey"
VALUE_COL = "value"
CLASS_COL = "nps_class"
META_COLS = ["sourceId", "sourceUniqueId", "npsDate", "npsScore", "nps_class"]

SCORE_TO_CLASS = {0: 0, 7: 1, 10: 2}
UNKNOWN_CLASS = -1
DETRACTOR, PASSIVE, PROMOTER = 0, 1, 2
CLASS_CODES = [0, 1, 2]
MULTI_LABELS = {0: "Detractor", 1: "Passive", 2: "Promoter"}
BINARY_LABELS = {0: "Non-Detractor", 1: "Detractor"}

NUMERIC, CATEGORICAL, MULTI_CATEGORICAL = "numeric", "categorical", "multi_categorical"

TOKEN_SEPARATOR = "||"
NULL_TOKEN = "NO_OPTIONS"
UNNAMED_TOKEN = "UNK"
DEFAULT_VOCABULARY_SIZE = 5

DELAY_COL = "transactionalTravelTripAverageDelayDurationV0Last30d"
SEVERE_FLAG_COL = "is_severe_delay_10m_plus"
SEVERE_THRESHOLD = 10.0

# bracket column -> numeric column that carries the same information
SEMANTIC_REDUNDANCIES = {
    "transactionalTravelTripDelayDurationBracketV0Last30d":
        "transactionalTravelTripAverageDelayDurationV0Last30d",
    "transactionalLastTicketPricePositionV0":
        "transactionalLastTicketPriceInEurosV0",
    "transactionalAverageSectionOccupancyLevelV0Last30d":
        "transactionalAveragePassengerCountPerSectionV0Last30d",
}

PRIORITY_LEVERS = [
    "transactionalTravelTripAverageDelayDurationV0Last30d",
    "transactionalTravelTripAverageRealDurationV0Last30d",
]

KEY_NUMERIC = [
    "transactionalTravelTripAverageDelayDurationV0Last30d",
    "transactionalPercentageOfTicketTripWithDelayV0Last30d",
    "transactionalAverageTravelTicketPricePerOrderV1Last30d",
    "transactionalSumVoucherAmountV0Last30d",
]
KEY_CATEGORICAL = [
    "transactionalTravelTripDelayDurationBracketV0Last30d",
    "userProfileAgeGroupV0",
    "transactionalLastPurchasedTravelTicketTypeV0",
]
SHIFT_FEATURES = [
    "transactionalTravelTripAverageDelayDurationV0Last30d",
    "transactionalAverageTravelTicketPricePerOrderV1Last30d",
]
SPOT_CHECK_COLS = [
    "sourceId",
    "transactionalTravelTripAverageDelayDurationV0Last30d",
    "is_severe_delay_10m_plus",
    "transactionalLastPaymentMethodUsedV0Last30d",
    "transactionalAverageTotalAmountInCurrencyV0Last30d",
    "transactionalAverageTravelTicketPricePerOrderV1Last30d",
    "transactionalTravelTripAveragePlannedDurationV0Last30d",
    "transactionalPercentageOfOrdersCanceledOrRefundedV0Last30d",
]
WINDOW_SUFFIX = "Last30d"
TRAVEL_KEYWORDS = ["Travel", "Trip", "Delay", "Occupancy", "Duration", "TicketTrip"]

INTERVENTION_COLS = [
    "transactionalTravelTripAverageDelayDurationV0Last30d",
    "is_severe_delay_10m_plus",
]

# ordered (search, replacement) pairs that shorten a driver name for display
SHORT_NAME_RULES = [
    ("transactional", ""),
    ("userProfile", ""),
    ("V0Last30d", " (30d)"),
    ("V1Last30d", " (30d)"),
    ("V0Last180d", " (180d)"),
    ("V0", ""),
]
SHORT_LABEL_RULES = [
    ("transactional", ""),
    ("userProfile", ""),
    ("V0Last30d", " 30d"),
    ("V1Last30d", " 30d"),
    ("V0Last180d", " 180d"),
    ("V0", ""),
]
SHORT_LABEL_WIDTH = 40

# frozen outcome of the published parameter search
BEST_PARAMS_MULTI = {
    "learning_rate": 0.017534,
    "num_leaves": 20,
    "min_child_samples": 74,
    "colsample_bytree": 0.862550,
}
BEST_PARAMS_BINARY = {
    "learning_rate": 0.051900,
    "num_leaves": 79,
    "min_child_samples": 68,
    "colsample_bytree": 0.855189,
}

# ---------------------------------------------------------------------------
# Input schemas
# ---------------------------------------------------------------------------


def strings(*names: str) -> T.StructType:
    return T.StructType([T.StructField(n, T.StringType()) for n in names])


TRAIN_EAV = strings("sourceId", "sourceUniqueId", "npsDate", "npsScore", "driverKey", "value")
LIVE_EAV = strings("sourceId", "sourceUniqueId", "npsDate", "driverKey", "value")


def is_numeric(field: T.StructField) -> bool:
    return isinstance(field.dataType, T.NumericType)
