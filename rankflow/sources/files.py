"""Delimited-file scans and result writers.  Every scan has a fixed schema."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rankflow.scratch import hint_broadcast, is_small, stage
from rankflow.sources import schemas


def _csv(spark: SparkSession, path: str | list[str], schema, header: bool = False, sep: str = ",",
         strict: bool = True) -> DataFrame:
    mode = "FAILFAST" if strict else "PERMISSIVE"
    return (
        spark.read.schema(schema).option("header", header).option("sep", sep)
        .option("mode", mode).option("enforceSchema", True).csv(path)
    )


def scan_taxi_csv(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    """Headerless, comma-separated, 11 columns; the value is ``total_amount``."""
    return _csv(spark, path, schemas.TAXI, strict=strict)


def scan_power_csv(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    """Headerless, ``;``-separated, 9 columns; the value is ``Global_active_power``."""
    return _csv(spark, path, schemas.POWER, sep=";", strict=strict)


def scan_sample_csv(spark: SparkSession, path: str, column: str = "sampled_val") -> DataFrame:
    """``index,value`` with one header line."""
    return _csv(spark, path, schemas.sample(column), header=True)


def scan_results(spark: SparkSession, path: str | list[str], method: str) -> DataFrame:
    """Headerless window results of a sketch method, or of ``exact``."""
    schema = schemas.EXACT_RESULTS if method == "exact" else schemas.sketch_results(method)
    return _csv(spark, path, schema)


def scan_op_times(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """Query, insert, merge, kurtosis or adaptability table with a header.

    The columns are taken by name, so their order in the file is free.
    """
    schema = schemas.op_times(kind)
    raw = spark.read.option("header", True).csv(path)
    return raw.select(*[F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in schema])


def write_result_table(df: DataFrame, path: str, header: bool = False) -> None:
    """Overwrite a CSV result table."""
    df.write.mode("overwrite").option("header", header).csv(path)


def write_window_results(df: DataFrame, path: str, fmt: str = "csv") -> None:
    """Overwrite the results of a batch run, one line per window."""
    df.write.mode("overwrite").format(fmt).save(path)


def result_name(dataset: str, method: str) -> str:
    return f"results-{schemas.SHORT_NAMES[dataset]}-{method}"


def export_sample(df: DataFrame, id_col: str, value: str, path: str,
                  column: str = "sampled_val") -> None:
    """Write ``index,value`` lines with a header."""
    out = df.select(F.col(id_col).cast("bigint").alias("index"),
                    F.col(value).cast("double").alias(column))
    out.write.mode("overwrite").option("header", True).csv(path)


def row_cap(df: DataFrame, n: int) -> DataFrame:
    """The first ``n`` rows of a file scan, by file name and then by place in the file.

    A scan reads a file in blocks, each of them in one task and in order.  The rows of each block are
    counted, the counts are added up in the order of the blocks, and a block then knows how many of
    its rows are wanted, so the rows are the same however the files are split and whatever runs
    first.  ``df`` must be a scan of files, or a projection of one.
    """
    if n < 0:
        raise ValueError("a cap cannot be negative")
    block = {"_file": F.col("_metadata.file_path"), "_from": F.col("_metadata.file_block_start")}
    rows = df.select("*", *[c.alias(k) for k, c in block.items()],
                     F.monotonically_increasing_id().alias("_nth"))
    counts = rows.groupBy(*block).agg(F.count(F.lit(1)).alias("_rows"), F.min("_nth").alias("_first"))
    # One row per block of a file, some million at 100 TB.
    before = Window.orderBy(*block).rowsBetween(Window.unboundedPreceding, -1)
    wanted = stage(counts.withColumn("_before", F.coalesce(F.sum("_rows").over(before), F.lit(0))).where(
        F.col("_before") < n).select(*[F.col(c).alias(f"_w{c}") for c in block], "_first", "_before"),
        "blocks")
    here = (F.col("_file") == F.col("_w_file")) & (F.col("_from") == F.col("_w_from"))
    joined = rows.join(hint_broadcast(wanted, is_small(wanted)), here)
    return joined.where(F.col("_before") + F.col("_nth") - F.col("_first") < n).select(*df.columns)
