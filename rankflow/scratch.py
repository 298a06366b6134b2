"""Stage tables: small results written once and read back by later jobs.

A stage table ends the lineage of what produced it, survives the loss of any
executor because it lies in shared storage, and has a size Spark knows when it
plans the next join.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Most rows a side may have to be broadcast (about 100 bytes per row).
BROADCAST_ROWS = 200_000

_local_dir: str | None = None


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors can reach, from ``spark.checkpoint.dir``."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    master = spark.conf.get("spark.master", "")
    if not master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    global _local_dir
    if _local_dir is None:
        _local_dir = tempfile.mkdtemp(prefix="rankflow-")
    return _local_dir


def new_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def stage(df: DataFrame, label: str = "stage") -> DataFrame:
    """Write ``df`` to the shared folder and return the written table."""
    spark = df.sparkSession
    path = new_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def is_small(staged: DataFrame, rows: int = BROADCAST_ROWS) -> bool:
    """Whether a stage table is within the broadcast bound (counts footers)."""
    return staged.count() <= rows


def hint_broadcast(df: DataFrame, small: bool) -> DataFrame:
    """Broadcast a side whose size was checked, else leave the join to AQE."""
    return F.broadcast(df) if small else df


def join_groups(rows: DataFrame, groups: DataFrame, keys: Sequence[str],
                how: str = "inner") -> DataFrame:
    """Attach per-group columns to rows; NULL keys match, as in GROUP BY.

    Without keys ``groups`` has one row (or none), which is read as a scalar subquery.
    """
    if not keys:
        return _attach_row(rows, groups, how)
    renamed = groups.withColumnsRenamed({k: f"_g_{k}" for k in keys})
    cond = F.lit(True)
    for k in keys:
        cond = cond & F.col(k).eqNullSafe(F.col(f"_g_{k}"))
    return rows.join(renamed, cond, how).drop(*[f"_g_{k}" for k in keys])


def _attach_row(rows: DataFrame, one: DataFrame, how: str) -> DataFrame:
    if how not in ("inner", "left"):
        raise ValueError(f"a {how} join needs keys")
    row = one.select(F.struct(*one.columns).alias("_row")).scalar()
    joined = rows.withColumn("_row", row)
    if how == "inner":
        joined = joined.where(F.col("_row").isNotNull())
    return joined.select(*rows.columns, *[F.col(f"_row.{c}").alias(c) for c in one.columns])
