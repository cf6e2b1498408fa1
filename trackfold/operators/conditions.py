"""Conditions, replicates and repeats of an experiment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def joined(df: DataFrame, few: DataFrame, keys: list[str]) -> DataFrame:
    """df with the other columns of few, which has a row for each combination of the keys; null equals null."""
    r = few.select(*[F.col(f"`{c}`").alias(f"_{i}") for i, c in enumerate(keys)], *[c for c in few.columns if c not in keys])
    on = F.lit(True)
    for i, c in enumerate(keys):
        on = on & F.col(f"`{c}`").eqNullSafe(F.col(f"_{i}"))
    return df.join(r, on, "left").drop(*[f"_{i}" for i in range(len(keys))])


def matches(**values) -> Column:
    """P10: a predicate of equalities in which null equals null."""
    out = F.lit(True)
    for k, v in values.items():
        out = out & F.col(k).eqNullSafe(F.lit(v))
    return out


def replaced_name(df: DataFrame, old: str, new: str) -> DataFrame:
    """A column under a new name, values of that name first."""
    if old not in df.columns:
        return df
    return df.withColumn(new, F.coalesce(new, old) if new in df.columns else F.col(old)).drop(old)


def dominant(df: DataFrame, columns: list[str], name: str = "antibiotic", amount: str = "concentration") -> DataFrame:
    """The first word of the column of the greatest value (the first of equals), and that value; missing values are left out."""
    clean = {c: F.when(~F.isnan(F.col(f"`{c}`").cast("double")), F.col(f"`{c}`").cast("double")) for c in columns}
    most = F.greatest(*clean.values()) if len(columns) > 1 else clean[columns[0]]
    which = F.coalesce(*[F.when(v == F.col(amount), F.lit(c.split(" ")[0])) for c, v in clean.items()])
    return df.withColumn(amount, most).withColumn(name, which)


def split_controls(df: DataFrame, column: str = "col", control: int = 12) -> tuple[DataFrame, DataFrame]:
    """P9."""
    return df.where(F.col(column) == control), df.where(F.col(column) != control)


def repeats(df: DataFrame, text: list[str], numeric: list[str], key: str, name: str = "repeat") -> DataFrame:
    """The rank of each key among the keys of its group of text keys, from 1, nulls last; ranks of the last numeric key that a row has count, and without numeric keys all rows do. Distinct keys are ranked, and joined back: a group may hold any share of the rows."""
    has = {f"_has{i}": F.col(n).isNotNull() & ~F.isnan(F.col(n).cast("double")) for i, n in enumerate(numeric)}
    df = df.withColumns(has) if has else df.withColumn("_has0", F.lit(True))
    ranks = []
    for i in reversed(range(max(1, len(numeric)))):
        one = df.where(f"_has{i}").select(*text, key).distinct().withColumn(f"_rank{i}", F.dense_rank().over(Window.partitionBy(*text).orderBy(F.asc_nulls_last(key))))
        df = joined(df, one, [*text, key])
        ranks.append(F.when(F.col(f"_has{i}"), F.col(f"_rank{i}")))
    out = df.withColumn(name, F.coalesce(*ranks).cast("bigint"))
    return out.drop(*[c for i in range(max(1, len(numeric))) for c in (f"_has{i}", f"_rank{i}")])


def replicates(df: DataFrame, condition: list[str], pad: str, order: str, name: str = "replicate") -> DataFrame:
    """Pads of a condition numbered from 1 by first appearance."""
    first = df.groupBy(*condition, pad).agg(F.min(order).alias("_first"))
    first = first.withColumn(name, F.row_number().over(Window.partitionBy(*condition).orderBy("_first")).cast("bigint")).drop("_first")
    return joined(df, first, [*condition, pad])


def repeats_beside_control(df: DataFrame, experiment: str, row: str, col: str, control: int = 12, name: str = "repeat") -> DataFrame:
    """Rows of a plate are repeats, numbered on through the experiments in order; controls are dealt over their experiment's repeats in turn."""
    d = df.withColumn("_control", F.col(col) == control)
    rows = d.select(experiment, "_control", row).distinct().withColumn("_rank", F.dense_rank().over(Window.partitionBy(experiment, "_control").orderBy(row)))
    per = rows.groupBy(experiment).agg(F.max(F.when(~F.col("_control"), F.col("_rank"))).alias("_n")).where("_n is not null")
    per = per.withColumn("_offset", F.coalesce(F.sum("_n").over(Window.orderBy(experiment).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))  # a row per experiment
    out = joined(joined(d, rows, [experiment, "_control", row]), per, [experiment])
    rank = F.col("_rank")
    value = F.when(F.col("_control"), F.pmod(rank - 1, F.col("_n"))).otherwise(rank - 1) + 1 + F.col("_offset")
    return out.withColumn(name, value.cast("bigint")).drop("_n", "_offset", "_rank", "_control")


def normalised(df: DataFrame, key: str, by: list[str], concentration: str, name: str | None = None) -> DataFrame:
    """A3: a value over the mean at concentration 0 within its group."""
    base = df.where(F.col(concentration) == 0).groupBy(*by).agg(F.avg(key).alias("_base"))
    return joined(df, base, by).withColumn(name or f"{key}_normalised", F.try_divide(F.col(key), F.col("_base"))).drop("_base")


def normalised_to_self(df: DataFrame, key: str, by: list[str], bin_: str, name: str | None = None) -> DataFrame:
    """A4: a value over the mean in its group's second time bin; null with fewer than two bins."""
    means = df.groupBy(*by, bin_).agg(F.avg(key).alias("_m"))
    second = means.withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy(bin_))).where("_n = 2").select(*by, "_m")
    return df.join(second, by, "left").withColumn(name or f"{key}_to_self", F.try_divide(F.col(key), F.col("_m"))).drop("_m")


def partitions(df: DataFrame, key: str) -> list[tuple[object, DataFrame]]:
    """A table for each value of a key, null being one. For keys of few values."""
    return [(r[0], df.where(F.col(key).eqNullSafe(F.lit(r[0])))) for r in df.select(key).distinct().orderBy(F.asc_nulls_last(key)).collect()]


def union(frames: list[DataFrame | None]) -> DataFrame:
    """All rows of tables, columns widened; missing tables are left out, all missing is an error."""
    some = [f for f in frames if f is not None]
    if not some:
        raise ValueError("no table to unite")
    out = some[0]
    for f in some[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out
