"""A streaming source of generated events: numbered rows that fall due at a rate.

The source only hands out ids.  Its offset is the number of the next one, so a range of offsets is
a set of rows, the same for every attempt and after a restart.  A batch's range is cut into
partitions that tasks make on their own.  Arrival and event times, and values, are column
expressions on the ids (``functions.uniform``), as on tables.
"""

from __future__ import annotations

import math
import time
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from rankflow.functions import uniform

FORMAT = "generated-ids"
#: Ids of one partition, and of one Arrow batch.
IDS_PER_TASK = 1_000_000
IDS_PER_BATCH = 65_536


@dataclass
class IdRange(InputPartition):
    """Ids from ``first`` up to but not including ``end``."""

    first: int
    end: int


class GeneratedIds(DataSource):
    """``id BIGINT`` from 0 on.

    Options: ``rows`` (how many there are), ``idsPerTask``; ``startMs`` and ``idsPerMs`` make ids fall
    due by the clock from that epoch millisecond on; without them all are due at once.
    """

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return "id bigint"

    def streamReader(self, schema) -> DataSourceStreamReader:
        return IdReader(self.options)


class IdReader(DataSourceStreamReader):
    def __init__(self, options):
        self.rows = int(options["rows"])
        self.per_task = int(options.get("idsPerTask", IDS_PER_TASK))
        self.start_ms = options.get("startMs")
        self.per_ms = float(options.get("idsPerMs", 1))

    def initialOffset(self) -> dict:
        return {"id": 0}

    def latestOffset(self) -> dict:
        if self.start_ms is None:
            return {"id": self.rows}
        passed = max(0.0, time.time() * 1000 - int(self.start_ms))
        return {"id": min(self.rows, math.floor(passed * self.per_ms))}

    def partitions(self, start: dict, end: dict) -> list[IdRange]:
        return [IdRange(a, min(a + self.per_task, end["id"]))
                for a in range(start["id"], end["id"], self.per_task)]

    def read(self, partition: IdRange) -> Iterator[pa.RecordBatch]:
        for first in range(partition.first, partition.end, IDS_PER_BATCH):
            ids = range(first, min(first + IDS_PER_BATCH, partition.end))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64())], names=["id"])


def read_event_stream(spark: SparkSession, rows: int, base_ms: int, throughput: float,
                      mean_delay_ms: float | None = None, paced: bool = False,
                      ids_per_task: int = IDS_PER_TASK) -> DataFrame:
    """A stream of ``id, arrival_ms, event_ms``: what ``gen_event_stream`` gives for a table of ids.

    ``paced`` lets ids fall due at ``throughput`` per second from ``base_ms`` on, else all of
    the ``rows`` ids are due at once.
    """
    spark.dataSource.register(GeneratedIds)
    reader = spark.readStream.format(FORMAT).option("rows", rows).option("idsPerTask", ids_per_task)
    if paced:
        # Ids that thinning will leave out fall due as well, one a millisecond.
        reader = reader.option("startMs", base_ms).option("idsPerMs", max(1, math.ceil(throughput / 1000)))
    return uniform.gen_event_stream(reader.load(), "id", base_ms, throughput, mean_delay_ms)
