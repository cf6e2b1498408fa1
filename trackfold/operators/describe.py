"""Joins of fine measurements to their owners, and full descriptions of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

STATS = ("count", "mean", "std", "min", "p25", "p50", "p75", "max")


def described(metric: str) -> list[Column]:
    """A1: eight statistics of a column, its missing values left out; quartiles are interpolated."""
    x = F.when(~F.isnan(F.col(metric).cast("double")), F.col(metric).cast("double"))
    q = F.percentile(x, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    return [
        F.count(x).alias(f"{metric}_count"), F.avg(x).alias(f"{metric}_mean"), F.stddev_samp(x).alias(f"{metric}_std"), F.min(x).alias(f"{metric}_min"),
        F.get(q, F.lit(0)).alias(f"{metric}_p25"), F.get(q, F.lit(1)).alias(f"{metric}_p50"), F.get(q, F.lit(2)).alias(f"{metric}_p75"), F.max(x).alias(f"{metric}_max"),
    ]


def describe(df: DataFrame, by: list[str], metrics: list[str]) -> DataFrame:
    return df.groupBy(*by).agg(*[c for m in metrics for c in described(m)])


def describe_owned(owners: DataFrame, parts: DataFrame, on: list[str], metrics: list[str]) -> DataFrame:
    """Owners with the statistics of their parts and `<first metric>_total`. Parts are described before the join, so it moves one row for each owner; owners without parts have count 0 and nulls."""
    d = describe(parts.select(*on, *metrics), on, metrics)
    out = owners.join(d, on, "left")
    out = out.withColumns({f"{m}_count": F.coalesce(f"{m}_count", F.lit(0)) for m in metrics})
    return out.withColumn(f"{metrics[0]}_total", F.col(f"{metrics[0]}_mean") * F.col(f"{metrics[0]}_count"))


def zipped(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """Positions that both sides have."""
    return left.join(right, on)


def contents_by_group(df: DataFrame, by: list[str], order: list[str], value: str, name: str) -> DataFrame:
    """A10: a group's values in order."""
    return df.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct(*order, F.col(value).alias("_v")))), lambda s: s["_v"]).alias(name))


def duplicates(df: DataFrame, key: str, position: str) -> DataFrame:
    """Values that occur more than once, with their positions."""
    return df.groupBy(key).agg(F.array_sort(F.collect_list(position)).alias("positions")).where(F.size("positions") > 1)


def plane(df: DataFrame, by: list[str], x: str, y: str, z: str) -> DataFrame:
    """Least-squares plane z = a x + b y + c from sums; fewer than three points give a flat plane at the mean, none gives no row."""
    d = df.where(F.col(z).isNotNull())
    s = {n: F.sum(e.cast("double")) for n, e in {"n": F.lit(1), "x": F.col(x), "y": F.col(y), "z": F.col(z), "xx": F.col(x) * F.col(x), "yy": F.col(y) * F.col(y), "xy": F.col(x) * F.col(y), "xz": F.col(x) * F.col(z), "yz": F.col(y) * F.col(z)}.items()}
    g = d.groupBy(*by).agg(*[v.alias(f"_{k}") for k, v in s.items()])
    c = {k: F.col(f"_{k}") for k in s}
    sxx, syy, sxy = c["xx"] - c["x"] * c["x"] / c["n"], c["yy"] - c["y"] * c["y"] / c["n"], c["xy"] - c["x"] * c["y"] / c["n"]
    sxz, syz = c["xz"] - c["x"] * c["z"] / c["n"], c["yz"] - c["y"] * c["z"] / c["n"]
    det = sxx * syy - sxy * sxy
    flat = (c["n"] < 3) | (det == 0)
    a = F.when(flat, 0.0).otherwise(F.try_divide(sxz * syy - syz * sxy, det))
    b = F.when(flat, 0.0).otherwise(F.try_divide(syz * sxx - sxz * sxy, det))
    g = g.withColumn("a", a).withColumn("b", b)
    return g.select(*by, "a", "b", ((F.col("_z") - F.col("a") * F.col("_x") - F.col("b") * F.col("_y")) / F.col("_n")).alias("c"))
