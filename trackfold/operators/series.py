"""Window operators over series of rows in time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def termination(df: DataFrame, series: list[str], order: list[str], flag: str) -> DataFrame:
    """`terminates` on the row before the first one whose flag is set; not where the first row's own flag is set alone."""
    w = Window.partitionBy(*series).orderBy(*order)
    ahead = F.coalesce(F.lead(flag).over(w), F.lit(False))
    first = F.min(F.when(F.col("_ahead"), F.col("_row"))).over(Window.partitionBy(*series))
    return df.withColumn("_ahead", ahead).withColumn("_row", F.row_number().over(w)).withColumn("terminates", F.coalesce(F.col("_row") == first, F.lit(False))).drop("_ahead", "_row")


def last_row(df: DataFrame, series: list[str], order: list[str]) -> DataFrame:
    """W2 (first half): `is_last` on the last row of each series."""
    w = Window.partitionBy(*series).orderBy(*[F.desc(c) for c in order])
    return df.withColumn("is_last", F.row_number().over(w) == 1)


def edges(df: DataFrame, series: list[str], order: str, value: str) -> DataFrame:
    """A row per series: order and value of the first row, the last row, and the first row of the greatest value."""
    v = F.when(~F.isnan(F.col(value)), F.col(value))
    key = F.struct(v.alias("v"), (-F.col(order)).alias("o"))
    return df.groupBy(*series).agg(F.min(order).alias("first_at"), F.max(order).alias("last_at"), F.min_by(value, order).alias("first_value"), F.max_by(value, order).alias("last_value"), (-F.max(F.when(v.isNotNull(), key))["o"]).alias("max_at"), F.max(v).alias("max_value"))


def with_group(df: DataFrame, by: list[str], **aggregates: Column) -> DataFrame:
    """A group's aggregates on each of its rows."""
    return df.withColumns({k: a.over(Window.partitionBy(*by)) for k, a in aggregates.items()})


def present_duration(df: DataFrame, series: list[str], hours: str) -> DataFrame:
    """A5."""
    w = Window.partitionBy(*series)
    return df.withColumn("present_for_duration", F.max(hours).over(w) - F.min(hours).over(w))


def cumulative(df: DataFrame, series: list[str], order: list[str], columns: list[str]) -> DataFrame:
    """Running sums `cumulative_<c>` of the rows before each row; 0 on the first."""
    w = Window.partitionBy(*series).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumns({f"cumulative_{c}": F.coalesce(F.sum(c).over(w), F.lit(0)) for c in columns})


def nth(df: DataFrame, series: list[str], order: list[str], value: str, n: int) -> DataFrame:
    """W9."""
    w = Window.partitionBy(*series).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return df.withColumn(f"{value}_nth", F.nth_value(value, n).over(w))


def stack_depth(df: DataFrame, series: list[str], order: list[str], time: str, check: int | None = None) -> DataFrame:
    """Gaps and islands. A step is short if under 2.5 times the least step; the depth is one more than the rounded mean length of runs of short steps, the last run left out; start_index is 0 if the first step is short, else 1."""
    w = Window.partitionBy(*series).orderBy(*order)
    d = df.withColumn("_n", F.row_number().over(w))
    d = d.where(F.col("_n") <= check) if check else d
    d = d.withColumn("_dt", F.col(time) - F.lag(time).over(w)).where(F.col("_dt").isNotNull())
    d = d.withColumn("_short", F.col("_dt") < 2.5 * F.min("_dt").over(Window.partitionBy(*series)))
    turn = F.when(F.lag("_short").over(w) == F.col("_short"), 0).otherwise(1)
    d = d.withColumn("_island", turn)
    d = d.withColumn("_island", F.sum("_island").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    runs = d.groupBy(*series, "_island", "_short").agg(F.count("*").alias("length"))
    first = runs.where("_island = 1").select(*series, F.when(F.col("_short"), 0).otherwise(1).alias("start_index"))
    short = runs.where("_short").withColumn("_last", F.max("_island").over(Window.partitionBy(*series)))
    depth = short.where("_island < _last").groupBy(*series).agg((F.round(F.avg("length")) + 1).cast("bigint").alias("depth"))
    return first.join(depth, series, "left").select(*series, "start_index", F.coalesce("depth", F.lit(1)).alias("depth"))


def local_maxima(df: DataFrame, series: list[str], order: list[str], value: str, height: float) -> DataFrame:
    """Rows above both neighbours (a missing neighbour is lower) of at least a height."""
    w = Window.partitionBy(*series).orderBy(*order)
    low = F.lit(float("-inf"))
    v = F.col(value).cast("double")
    up = (v > F.coalesce(F.lag(v).over(w), low)) & (v > F.coalesce(F.lead(v).over(w), low)) & (v >= height)
    return df.withColumn("is_peak", F.coalesce(up, F.lit(False)))


def turning(points: Column) -> Column:
    """Turning angles along a closed contour, an array of struct x, y."""
    n = F.size(points)
    p = lambda i: F.get(points, F.pmod(i, n))
    heading = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.atan2((p(i + 1).y - p(i).y).cast("double"), (p(i + 1).x - p(i).x).cast("double")))
    two_pi = 2 * 3.141592653589793
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.pmod(F.get(heading, i) - F.get(heading, F.pmod(i - 1, n)) + F.lit(two_pi / 2), F.lit(two_pi)) - F.lit(two_pi / 2)))


def slopes(df: DataFrame, by: list[str], y: Column, x: Column, name: str = "slope") -> DataFrame:
    """A13."""
    return df.groupBy(*by).agg(F.regr_slope(y, x).alias(name))


def growth_summary(df: DataFrame, by: list[str], time: str, area: str) -> DataFrame:
    """Points, span, first and last area, doubling time in hours of log2(area / first) over seconds (-1 with ten points or fewer), growth rate ln 2 / doubling."""
    first = F.min_by(area, time)
    d = df.where(F.col(area) > 0).groupBy(*by).agg(F.count("*").alias("tracking_count"), (F.max(time) - F.min(time)).alias("tracking_time"), first.alias("area_first"), F.max_by(area, time).alias("area_last"), F.regr_slope(F.log2(area), F.col(time)).alias("_s"))
    doubling = F.when(F.col("tracking_count") > 10, F.try_divide(F.lit(1.0), F.col("_s")) / 3600.0).otherwise(-1.0)
    return d.withColumn("doubling_time", doubling).withColumn("growth_rate", F.when(F.col("doubling_time") != -1.0, F.lit(0.6931471805599453) / F.col("doubling_time")).otherwise(-1.0)).drop("_s")


def projected_steps(df: DataFrame, index: str, start: int, stop: int, step: int) -> DataFrame:
    """A slice by position."""
    return df.where((F.col(index) >= start) & (F.col(index) < stop) & (F.pmod(F.col(index) - start, F.lit(step)) == 0))


def first_rows(df: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """The first row of each group by an order (give `desc` columns as strings with a leading minus)."""
    keys = [F.desc(c[1:]) if c.startswith("-") else F.asc(c) for c in order]
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy(*keys))).where("_n = 1").drop("_n")


def normal_range(df: DataFrame, by: list[str], value: str, low: float, high: float) -> DataFrame:
    """Values clipped to two percentiles of their group."""
    w = Window.partitionBy(*by)
    q = F.percentile(F.col(value).cast("double"), F.array(F.lit(low / 100), F.lit(high / 100))).over(w)
    return df.withColumn("_q", q).withColumn(f"{value}_clipped", F.least(F.greatest(F.col(value).cast("double"), F.get("_q", F.lit(0))), F.get("_q", F.lit(1)))).drop("_q")


def best(df: DataFrame, by: list[str], score: str, choice: str) -> DataFrame:
    """The candidate of the greatest score in each group, the least candidate of equals."""
    top = F.max(F.struct(F.col(score).alias("s"), (-F.col(choice)).alias("c")))
    return df.groupBy(*by).agg(top.alias("_t")).select(*by, (-F.col("_t.c")).alias(choice), F.col("_t.s").alias(score))


def positioned(df: DataFrame, order: str, name: str = "position") -> DataFrame:
    """Rows numbered from 0 by a column, across the whole table. Quantiles of the column cut it into ranges, which are numbered each in a task of its own and moved by the rows of the ranges before; equal values share a range."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cuts = df.select(F.percentile_approx(order, [i / n for i in range(1, n)], 10_000)).first()[0] if n > 1 else []
    cuts = sorted(set(cuts or []))
    bucket = F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: c < F.col(order))) if cuts else F.lit(0)
    d = df.withColumn("_b", bucket)
    sums = d.groupBy("_b").agg(F.count("*").alias("_n"))  # a row for each range
    before = sums.select("_b", F.coalesce(F.sum("_n").over(Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_n"))
    own = F.row_number().over(Window.partitionBy("_b").orderBy(order)) - 1
    return d.withColumn(name, own).join(F.broadcast(before), "_b").withColumn(name, F.col(name) + F.col("_n")).drop("_b", "_n")
