"""Column layouts of the inputs and the result tables (fixed values)."""

from __future__ import annotations

from pyspark.sql.types import (
    DoubleType,
    LongType,
    StringType,
    StructField,
    StructType,
)

from rankflow.functions.scalars import QUANTILES, quantile_columns

TAXI_FIELDS = (
    "medallion", "hack_license", "vendor_id", "pickup_datetime", "payment_type",
    "fare_amount", "surcharge", "mta_tax", "tip_amount", "tolls_amount", "total_amount",
)
TAXI_NUMBERS = TAXI_FIELDS[5:]

POWER_FIELDS = (
    "Date", "Time", "Global_active_power", "Global_reactive_power", "Voltage",
    "Global_intensity", "Sub_metering_1", "Sub_metering_2", "Sub_metering_3",
)

#: Stream name -> field that holds the value.
VALUE_FIELDS = {
    "taxi": "total_amount",
    "power": "Global_active_power",
    "pareto": "pareto_value",
    "uniform": "uniform_value",
}

#: Stream name -> short form used in result names.
SHORT_NAMES = {"taxi": "nyt", "power": "power", "pareto": "synp", "uniform": "synu"}

#: Taxi columns kept after parsing.
TAXI_NARROW = (
    "total_amount", "vendor_id", "pickup_datetime", "payment_type", "fare_amount",
    "event_time", "fake",
)

#: Methods whose results carry the number of retained items.
RETAINED_METHODS = ("kll", "req")


def _struct(strings=(), numbers=()) -> StructType:
    return StructType(
        [StructField(c, StringType()) for c in strings]
        + [StructField(c, DoubleType()) for c in numbers]
    )


TAXI = _struct(TAXI_FIELDS[:5], TAXI_NUMBERS)
POWER = _struct(POWER_FIELDS[:2], POWER_FIELDS[2:])
TAXI_EVENT = _struct([*TAXI_FIELDS, "event_time"])


def value_event(field: str) -> StructType:
    return _struct([field, "event_time"])


def sample(column: str = "sampled_val") -> StructType:
    return StructType([StructField("index", LongType()), StructField(column, DoubleType())])


def _result(first: str, doubles, longs=()) -> StructType:
    return StructType(
        [StructField(first, LongType())]
        + [StructField(c, DoubleType()) for c in doubles]
        + [StructField(c, LongType()) for c in longs]
    )


EXACT_RESULTS = _result("window_id", quantile_columns(QUANTILES), ("win_size", "slack_events"))


def sketch_results(method: str) -> StructType:
    longs = ("num_retained",) if method in RETAINED_METHODS else ()
    return _result("window_id", [*quantile_columns(QUANTILES), "query_time"], longs)


METHOD_COLUMNS = ("Moments", "DDS", "KLL", "REQ", "UDDS")


def op_times(kind: str) -> StructType:
    """Layout of a time or accuracy table with a header line."""
    if kind in ("query", "insert"):
        return _result("Data Size", METHOD_COLUMNS)
    if kind == "merge":
        return _result("Num Sketches", METHOD_COLUMNS)
    if kind == "kurtosis":
        return _struct(["Data Set"], ["Kurtosis", "Actual", *METHOD_COLUMNS])
    if kind == "adaptability":
        return _result("Run ID", ["Quantile", "Actual", *METHOD_COLUMNS])
    raise ValueError(f"unknown table {kind!r}")
