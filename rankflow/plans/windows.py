"""Tumbling-window quantiles on tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame

from rankflow.functions.scalars import QUANTILES, window_id
from rankflow.operators import exact
from rankflow.plans.methods import method
from rankflow.sources import schemas

#: Streams whose values the moments sketch sees through a logarithm.
LOG_STREAMS = ("pareto", "power")


def tumbling_window_sketches(df: DataFrame, value: str | Column, name: str,
                             window_seconds: float, ts: str = "ts",
                             keys: Sequence[str] = (), log: bool = False,
                             **params) -> DataFrame:
    """One sketch per (window, keys) of a table."""
    rows = df.withColumn("window_id", window_id(ts, window_seconds))
    return method(name, log, **params).build(rows, value, ["window_id", *keys])


def tumbling_window_quantiles(df: DataFrame, value: str | Column, name: str,
                              window_seconds: float, ts: str = "ts",
                              keys: Sequence[str] = (), ps: Sequence[float] = QUANTILES,
                              log: bool = False, **params) -> DataFrame:
    """``window_id, keys, n, pct_..`` per tumbling window of a table."""
    rows = df.withColumn("window_id", window_id(ts, window_seconds))
    groups = ["window_id", *keys]
    if name == "exact":
        return exact.exact_quantiles(rows, value, groups, ps)
    return method(name, log, **params).run(rows, value, groups, ps)


def uses_log(dataset: str, name: str) -> bool:
    return name == "moments" and dataset in LOG_STREAMS


def dataset_window_quantiles(df: DataFrame, dataset: str, name: str, window_seconds: float,
                             ts: str = "ts", **params) -> DataFrame:
    """The window query of one dataset and method, over its table."""
    field = schemas.VALUE_FIELDS[dataset]
    return tumbling_window_quantiles(
        df, field, name, window_seconds, ts, log=uses_log(dataset, name), **params
    )
