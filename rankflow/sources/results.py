"""Window results of a stream as one table, with every batch in it exactly once.

The lines of a batch are written to a folder of their own name, which nobody reads yet.  Then one
record, ``commits/batch=k``, names the folder, and readers take the folders that are named.  A
batch that fails between the two leaves a folder without a name; the batch that runs again
names its own.  A batch that fails after the record replaces it by one of the same lines.
``compact`` puts the lines of all batches in one folder, whose record then stands for theirs.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from rankflow.sources import schemas

_COMMIT = "folder string, since bigint"


def result_lines(wide: DataFrame, method: str) -> DataFrame:
    """Quantiles per window in the columns of a result file; what is not known is NULL."""
    schema = schemas.EXACT_RESULTS if method == "exact" else schemas.sketch_results(method)
    known = {"win_size": "n", **{c: c for c in wide.columns}}
    return wide.select(*[
        (F.col(known[f.name]) if known.get(f.name) in wide.columns else F.lit(None)).cast(f.dataType)
        .alias(f.name) for f in schema])


@dataclass(frozen=True)
class ResultTable:
    path: str
    fmt: str = "csv"

    def append(self, rows: DataFrame, batch: int) -> None:
        """Add the lines of a batch, in place of what an earlier attempt of it added."""
        self._commit(rows.sparkSession, self._write(rows, batch), batch, batch)

    def _write(self, rows: DataFrame, batch: int) -> str:
        folder = f"data/{batch}-{uuid.uuid4().hex}"
        rows.write.format(self.fmt).save(f"{self.path}/{folder}")
        return folder

    def _commit(self, spark: SparkSession, folder: str, since: int, batch: int) -> None:
        spark.createDataFrame([(folder, since)], _COMMIT).coalesce(1).write.mode("overwrite").parquet(
            f"{self.path}/commits/batch={batch}")

    def _commits(self, spark: SparkSession) -> DataFrame | None:
        """The records that count: those that no later one stands for."""
        try:
            found = spark.read.schema(f"{_COMMIT}, batch bigint").parquet(f"{self.path}/commits")
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            return None
        whole = found.where("since < batch").agg(F.max_by(F.struct("since", "batch"), "batch")).first()[0]
        if whole is None:
            return found
        return found.where(~F.col("batch").between(whole.since, whole.batch - 1))

    def folders(self, spark: SparkSession) -> list[str]:
        """The folders that hold the table, one per batch since it was last compacted."""
        commits = self._commits(spark)
        return [] if commits is None else [
            f"{self.path}/{r.folder}" for r in commits.orderBy("batch").collect()]

    def read(self, spark: SparkSession, schema: StructType) -> DataFrame:
        folders = self.folders(spark)
        if not folders:
            return spark.createDataFrame([], schema)
        return spark.read.schema(schema).format(self.fmt).load(folders)

    def compact(self, spark: SparkSession, schema: StructType) -> None:
        """Bring the lines of all batches together in one folder."""
        commits = self._commits(spark)
        bounds = None if commits is None else commits.agg(F.min("since"), F.max("batch")).first()
        if bounds is None or bounds[0] is None or bounds[0] == bounds[1]:
            return
        self._commit(spark, self._write(self.read(spark, schema), bounds[1]), bounds[0], bounds[1])
