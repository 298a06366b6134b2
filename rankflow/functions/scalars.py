"""Column expressions shared by the operators and the reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The nine ranks every window result carries.
QUANTILES = (0.01, 0.05, 0.25, 0.50, 0.75, 0.90, 0.95, 0.98, 0.99)


def quantile_column(p: float) -> str:
    """``0.05`` -> ``pct_05``, ``0.999`` -> ``pct_99_9``."""
    text = f"{p * 100:.6f}".rstrip("0").rstrip(".")
    whole, _, part = text.partition(".")
    return f"pct_{int(whole):02d}" + (f"_{part}" if part else "")


def quantile_columns(ps: Sequence[float] = QUANTILES) -> list[str]:
    return [quantile_column(p) for p in ps]


def as_column(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def event_time(ms: str | Column) -> Column:
    """Epoch milliseconds (number or text) to a timestamp."""
    return F.timestamp_millis(as_column(ms).cast("bigint"))


def epoch_ms(ts: str | Column) -> Column:
    """Timestamp (with or without zone) to epoch milliseconds."""
    return F.unix_millis(as_column(ts).cast("timestamp"))


def window_id(ts: str | Column, window_seconds: float) -> Column:
    """Number of the tumbling window a timestamp falls into."""
    width = int(round(window_seconds * 1000))
    return F.floor(epoch_ms(ts) / F.lit(width)).cast("bigint")


def ingestion_time() -> Column:
    """Wall clock in milliseconds; one value per batch."""
    return F.unix_millis(F.current_timestamp())


def round4(c: str | Column) -> Column:
    """Half-up rounding to four places."""
    return F.round(as_column(c), 4)


def value_as_double(c: str | Column, strict: bool = True) -> Column:
    """Text to double; bad text raises unless ``strict`` is off."""
    c = as_column(c)
    return c.cast("double") if strict else c.try_cast("double")


def value_as_float(c: str | Column, strict: bool = True) -> Column:
    """Text to 32-bit float, the precision KLL and REQ work in."""
    c = as_column(c)
    return c.cast("float") if strict else c.try_cast("float")


def log_transform(c: str | Column) -> Column:
    return F.ln(as_column(c))


def exp_back(c: str | Column) -> Column:
    return F.exp(as_column(c))


def arcsinh_compress(c: str | Column) -> Column:
    return F.asinh(as_column(c))


def relative_error(approx: str | Column, real: str | Column) -> Column:
    """``|approx - real| / real``; the denominator keeps its sign, 0 gives NULL."""
    approx, real = as_column(approx), as_column(real)
    return F.abs(approx - real) / F.nullif(real, F.lit(0.0))


def run_id(window: str | Column) -> Column:
    """The first four digits of the decimal window id."""
    return F.substring(as_column(window).cast("string"), 1, 4)


def missing_pct(slack_events: str | Column, win_size: str | Column) -> Column:
    return as_column(slack_events) / as_column(win_size) * F.lit(100.0)


def to_millions(c: str | Column) -> Column:
    return F.floor(as_column(c) / F.lit(1_000_000)).cast("bigint")


def quantile_band(p: str | Column) -> Column:
    """1 for the median, 0 for every other quantile."""
    return F.when(as_column(p) == 0.5, F.lit(1)).otherwise(F.lit(0))


def tick_label(kurtosis: str | Column, dataset: str | Column) -> Column:
    """Kurtosis, line break, dataset in brackets."""
    return F.concat(
        as_column(kurtosis).cast("string"), F.lit("\n("), as_column(dataset), F.lit(")")
    )


def filter_missing(df: DataFrame, pct: str = "missing_pct") -> DataFrame:
    return df.where(F.col(pct) > 0)


def filter_extreme_quantiles(df: DataFrame, quantile: str = "quantile") -> DataFrame:
    return df.where(~F.col(quantile).isin(0.01, 0.99))


def per_item_time(
    df: DataFrame, columns: Sequence[str], divisor: str | Column, places: int | None = None
) -> DataFrame:
    """Divide each time column by ``divisor``, rounding half-even if asked."""
    d = F.nullif(as_column(divisor).cast("double"), F.lit(0.0))
    out = {c: F.col(c) / d for c in columns}
    if places is not None:
        out = {c: F.bround(x, places) for c, x in out.items()}
    return df.withColumns(out)


def melt_quantiles(df: DataFrame, keys: Sequence[str], ps: Sequence[float] = QUANTILES,
                   value: str = "value") -> DataFrame:
    """One row per quantile from a wide result: keys, ``quantile``, value."""
    pairs = [
        F.struct(F.lit(float(p)).alias("quantile"), F.col(quantile_column(p)).alias(value))
        for p in ps
    ]
    return df.select(*keys, F.inline(F.array(*pairs)))
