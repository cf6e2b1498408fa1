"""Growth of series: smoothing and Gaussian-process rates (W13, W14, K1-K9). One task holds a series, never a table."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trackfold.functions.kernels import filters, gp

LEAST_SMOOTH, LEAST_GROWTH = 7, 6


def _grouped(df: DataFrame, series: list[str], run, extra: list[tuple[str, T.DataType]]) -> DataFrame:
    schema = T.StructType([*df.schema.fields, *[T.StructField(n, t) for n, t in extra]])
    return df.groupBy(*series).applyInPandas(run, schema)


def smoothed(df: DataFrame, series: list[str], time: str, column: str) -> DataFrame:
    """A positive column filtered in log2 along time; the values before are kept as `<column>_raw`. Series of fewer than seven rows, or with a value that has no logarithm, get null."""
    df = df.withColumn(column, F.col(column).cast("double")).withColumn(f"{column}_raw", F.col(column))

    def run(pdf):
        pdf = pdf.sort_values(time, kind="stable")
        x = pdf[column].to_numpy(float)
        ok = ~np.isnan(x)
        out = np.full(len(x), np.nan)
        if ok.sum() >= LEAST_SMOOTH and (x[ok] > 0).all():
            out[ok] = np.exp2(filters.low_pass(np.log2(x[ok])))
        pdf[column] = out
        return pdf

    out = df.groupBy(*series).applyInPandas(run, df.schema)
    return out.withColumn(column, F.when(~F.isnan(column), F.col(column)))


#: Points squared, summed over the series that are fitted together.
TOGETHER = 6_000_000


def _whole(batches, turn: str):
    """Arrow batches of rows that stand by series, numbered within it, as tables of whole series: as many as are fitted together, or one that is longer."""
    ready, last, work = [], [], 0
    for b in batches:
        place = b.column(turn).to_numpy()
        first = np.flatnonzero(place == 1)
        if not len(first):
            last.append(b)
            continue
        ready += [*last, b.slice(0, first[-1])]
        work += 2 * sum(int(x.column(turn).to_numpy().sum()) for x in last) + 2 * int(place[: first[-1]].sum())
        last = [b.slice(first[-1])]
        if work >= TOGETHER:
            yield pa.Table.from_batches(ready)
            ready, work = [], 0
    if ready or last:
        yield pa.Table.from_batches([*ready, *last])


def growth_rates(df: DataFrame, series: list[str], hours: str, columns: list[str], kernel: str = "sqexp", runs: int = 5) -> DataFrame:
    """`<c>_growth_rate` and `<c>_growth_rate_var`, the derivative of the logarithm in hours and its variance. Series of fewer than six rows, or that cannot be fitted, get nulls. Starts are drawn from a seed that the series' key gives, so reruns agree. A task fits many series together, which changes no digit of a result."""
    extra = [(f"{c}_growth_rate{v}", T.DoubleType()) for c in columns for v in ("", "_var")]
    turn, numbers = "_growth_turn", ["_growth_hours", *[f"_growth_{i}" for i in range(len(columns))]]
    names = df.columns

    def run(batches):
        for table in _whole(batches, turn):
            start = np.flatnonzero(table.column(turn).to_numpy() == 1)
            end = [*start[1:], len(table)]
            t, *ys = (table.column(n).to_numpy() for n in numbers)
            keys = zip(*(table.column(n).take(start).to_pylist() for n in series))
            fit = [(a, b, zlib.crc32(repr(tuple(map(str, k))).encode())) for a, b, k in zip(start, end, keys) if b - a >= LEAST_GROWTH]
            out = table.select(names)
            for i, y in enumerate(ys):
                rate, var = np.full(len(table), np.nan), np.full(len(table), np.nan)
                work = np.cumsum([(b - a) ** 2 for a, b, _ in fit]) // TOGETHER
                for part in np.split(np.arange(len(fit)), np.flatnonzero(np.diff(work)) + 1):
                    some = [fit[k] for k in part]
                    for (a, b, _), found in zip(some, gp.slopes([(t[a:b], y[a:b]) for a, b, _ in some], kernel, runs, [k for *_, k in some])):
                        if found:
                            rate[a:b], var[a:b] = found
                for k, v in enumerate((rate, var)):
                    out = out.append_column(extra[2 * i + k][0], pa.array(v))
            yield from out.to_batches()

    spark = df.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism)
    each = Window.partitionBy(*series).orderBy(numbers[0])
    df = df.withColumns(dict(zip(numbers, (F.col(c).cast("double") for c in (hours, *columns)))))
    # the number is given, as a few small partitions, joined by their size, would leave cores without work
    numbered = df.repartition(parts, *series).withColumn(turn, F.row_number().over(each))
    out = numbered.mapInArrow(run, T.StructType([*[df.schema[n] for n in names], *[T.StructField(n, t) for n, t in extra]]))
    return out.withColumns({n: F.when(~F.isnan(n), F.col(n)) for n, _ in extra})


def fitted(df: DataFrame, series: str, hours: str, value: str, kernel: str = "sqexp") -> DataFrame:
    """F, df, ddf and their variances at each point of a series."""
    names = ("f", "f_var", "df", "df_var", "ddf", "ddf_var")

    def run(key, pdf):
        pdf = pdf.sort_values(hours, kind="stable")
        try:
            r = gp.derivatives(pdf[hours].to_numpy(float), pdf[value].to_numpy(float), kernel, seed=zlib.crc32(str(key[0]).encode()))
        except (ValueError, np.linalg.LinAlgError):
            r = {n: np.full(len(pdf), np.nan) for n in names}
        return pdf.assign(**r)

    return _grouped(df, [series], run, [(n, T.DoubleType()) for n in names])


def fit_statistics(df: DataFrame, series: str, hours: str, value: str, draws: int = 100) -> DataFrame:
    """Of each series, statistics over posterior draws."""
    keys = [f"{k}_{n}" for k in ("max_df", "max_df_time", "doubling_time", "max_f", "lag_time") for n in ("mean", "var", "std", "stderr")]

    def run(key, pdf):
        import pandas as pd

        pdf = pdf.sort_values(hours, kind="stable")
        try:
            r = gp.statistics(pdf[hours].to_numpy(float), pdf[value].to_numpy(float), draws, zlib.crc32(str(key[0]).encode()))
        except (ValueError, np.linalg.LinAlgError):
            r = dict.fromkeys(keys)
        return pd.DataFrame([{series: key[0]} | {k: r[k] for k in keys}])

    return df.groupBy(series).applyInPandas(run, T.StructType([df.schema[series], *[T.StructField(k, T.DoubleType()) for k in keys]]))
