"""Frame sets that keep arriving: the stateless steps over a stream of files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trackfold.operators.timebin import with_time_bins, with_units


def measurements(spark: SparkSession, folder: str, schema, files_per_trigger: int = 100) -> DataFrame:
    """Rows of Parquet files as they land in a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def binned(stream: DataFrame, seconds: str = "time") -> DataFrame:
    """P4 and P5 on a stream; no state is kept."""
    return with_time_bins(with_units(stream, seconds))


def windows(stream: DataFrame, ts: str, value: str, width: str = "15 minutes", late: str = "1 hour") -> DataFrame:
    """Counts and means in tumbling windows; rows later than the watermark are dropped."""
    w = F.window(F.col(ts), width)
    return stream.withWatermark(ts, late).groupBy(w).agg(F.count("*").alias("n"), F.avg(value).alias("mean")).select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), "n", "mean")


def sessions(stream: DataFrame, key: str, ts: str, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """W10 on a stream: runs of a key's rows without a gap."""
    return stream.withWatermark(ts, late).groupBy(F.session_window(F.col(ts), gap), key).agg(F.count("*").alias("n")).select(key, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")
