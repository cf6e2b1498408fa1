"""Time units and bins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUND_S = 900


def elapsed_seconds(ts: Column, origin: Column) -> Column:
    return (F.unix_micros(ts.cast("timestamp")) - F.unix_micros(origin.cast("timestamp"))) / F.lit(1e6)


def with_units(df: DataFrame, seconds: str = "time") -> DataFrame:
    """Hours and days, and the same of the quarter of an hour that the time is in."""
    t = F.col(seconds).cast("double")
    r = F.floor(t / ROUND_S) * ROUND_S
    return df.withColumns({"time_hours": t / 3600.0, "time_days": t / 86400.0, "round_time": r.cast("bigint"), "round_time_hours": r / 3600.0, "round_time_days": r / 86400.0})


def time_bin(hours: str, minutes: int) -> Column:
    """P5: hours at the start of a bin of so many minutes."""
    return (F.floor(F.col(hours) * 60.0 / minutes) * minutes / 60.0).cast("double")


def with_time_bins(df: DataFrame, hours: str = "round_time_hours") -> DataFrame:
    return df.withColumns({f"time_bin_{m}min": time_bin(hours, m) for m in (30, 15)})
