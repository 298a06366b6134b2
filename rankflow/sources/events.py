"""JSON events: encoding, reading and parsing."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rankflow.functions import scalars
from rankflow.sources import schemas


def read_json_events(spark: SparkSession, source: str, fmt: str = "text",
                     **options: str) -> DataFrame:
    """Stream of JSON event texts in a column ``value``.

    ``fmt`` is ``text`` (a folder that grows by files of one event per line) or
    ``kafka`` (``source`` is the topic; pass ``kafka.bootstrap.servers``).
    """
    reader = spark.readStream.options(**options)
    if fmt == "kafka":
        stream = (
            reader.format("kafka").option("subscribe", source)
            .option("startingOffsets", "earliest").load()
        )
        return stream.select(F.col("value").cast("string").alias("value"))
    return reader.format("text").load(source)


def json_has_key(text: str | Column, key: str) -> Column:
    """Whether the object has the key, whatever its value (also JSON null)."""
    keys = F.json_object_keys(scalars.as_column(text))
    return F.coalesce(F.array_contains(keys, key), F.lit(False))


def _require(parsed: str, fields: Sequence[str]) -> dict[str, Column]:
    """Parsed fields that raise when the event lacks them.

    Spark drops columns that a query does not use, and their checks with them, so the
    event time, which every query uses, checks all fields.
    """
    columns = {f: F.col(f"{parsed}.`{f}`") for f in fields}

    def checked(value: Column, names: Sequence[str]) -> Column:
        lacking = F.coalesce(*[F.when(columns[f].isNull(), F.lit(f)) for f in names])
        error = F.raise_error(F.concat(F.lit("event without field "), lacking)).cast("string")
        return F.when(lacking.isNotNull(), error).otherwise(value)

    return {f: checked(c, fields if f == "event_time" else [f]) for f, c in columns.items()}


def parse_taxi_event(df: DataFrame, text: str = "value", strict: bool = True) -> DataFrame:
    """JSON to the 11 taxi fields, event time, ingestion time and ``fake``.

    A required field that is missing raises; with ``strict`` off it is NULL.
    """
    return _parse(df, text, schemas.TAXI_EVENT, strict).withColumn(
        "fake", json_has_key("_text", "fake")
    ).drop("_text")


def parse_value_event(df: DataFrame, field: str, text: str = "value",
                      strict: bool = True) -> DataFrame:
    """JSON to (value field, event time, ingestion time)."""
    return _parse(df, text, schemas.value_event(field), strict).drop("_text")


def _parse(df: DataFrame, text: str, schema, strict: bool) -> DataFrame:
    parsed = df.select(F.from_json(text, schema).alias("_e"), F.col(text).alias("_text"))
    names = [f.name for f in schema]
    fields = _require("_e", names) if strict else {n: F.col(f"_e.`{n}`") for n in names}
    return parsed.select(
        *[c.alias(n) for n, c in fields.items()],
        scalars.ingestion_time().alias("ingestion_time"), "_text",
    )


def project_taxi(df: DataFrame) -> DataFrame:
    """The seven taxi columns the window query keeps."""
    return df.select(*schemas.TAXI_NARROW)


def assign_event_time(df: DataFrame, ms: str = "event_time", ts: str = "ts") -> DataFrame:
    return df.withColumn(ts, scalars.event_time(ms))


def watermark(df: DataFrame, ts: str = "ts", delay: str = "0 seconds") -> DataFrame:
    return df.withWatermark(ts, delay)


def to_json_events(df: DataFrame, columns: Sequence[str], event_ms: str | Column) -> DataFrame:
    """Rows as JSON events, all fields text; the same text is key and value."""
    fields = [F.col(c).cast("string").alias(c) for c in columns]
    event = F.to_json(F.struct(*fields, scalars.as_column(event_ms).cast("string")
                               .alias("event_time")))
    return df.select(event.alias("key")).select("key", F.col("key").alias("value"))


def write_json_events(events: DataFrame, target: str, fmt: str = "text",
                      **options: str) -> None:
    """Append events to a folder, one per line, or (``kafka``) to a topic."""
    if fmt == "kafka":
        writer = events.select("key", "value").write.format("kafka").options(**options)
        writer.option("topic", target).save()
    else:
        events.select("value").write.mode("append").text(target)
