"""Row guards, membership and per-object statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def identified(df: DataFrame, id_: str = "id") -> DataFrame:
    """Rows of a number of 0 or more."""
    return df.where(F.col(id_) >= 0)


def with_metadata(df: DataFrame, metadata: DataFrame, on: str = "label") -> DataFrame:
    """What is known of a frame set on each of its rows; rows of an unknown one keep nulls."""
    return df.join(metadata, on, "left")


def present(df: DataFrame, *columns: str) -> DataFrame:
    """Rows that miss none of these columns; NaN is missing."""
    kinds = dict(df.dtypes)
    ok = F.lit(True)
    for c in columns:
        ok = ok & F.col(c).isNotNull()
        if kinds[c] in ("double", "float"):
            ok = ok & ~F.isnan(c)
    return df.where(ok)


def tracked(df: DataFrame, by: list[str], least: int = 20) -> DataFrame:
    """Rows of series with more than `least` rows. Series are counted, not windowed: a long one is no single task."""
    long_ = df.groupBy(*by).agg(F.count("*").alias("_n")).where(F.col("_n") > least).select(*by)
    return df.join(long_, by, "left_semi")


def inside(box: tuple[Column, Column, Column, Column], bound: tuple[float, float, float, float]) -> Column:
    """Whether a box (left, top, width, height) lies strictly inside another."""
    x, y, w, h = box
    left, top, width, height = bound
    return (x > left) & (y > top) & (x + w < left + width) & (y + h < top + height)


def holding(pixels: DataFrame, annotated: DataFrame, place: list[str], id_: str = "id") -> DataFrame:
    """The objects of which any pixel is annotated."""
    return pixels.join(annotated, place, "left_semi").select(id_).distinct()


def keep_rule(area: Column, widest_hit: Column, least: float) -> Column:
    """False for small objects and for those whose widest point is filtered out, null for the others."""
    return F.when((area < least) | widest_hit, F.lit(False))


def widest_point(pixels: DataFrame, by: list[str], distance: str, place: tuple[str, str]) -> DataFrame:
    """Area, and the place of the greatest distance to the edge, the first of equals in reading order."""
    top = F.max(F.struct(F.col(distance), (-F.col(place[0])).alias("r"), (-F.col(place[1])).alias("c"))).alias("_top")
    return pixels.groupBy(*by).agg(F.count("*").alias("area"), top).select(*by, "area", (-F.col("_top.r")).alias(place[0]), (-F.col("_top.c")).alias(place[1]))


def counted(df: DataFrame, frame: str) -> DataFrame:
    """Objects of each frame."""
    return df.groupBy(frame).agg(F.count("*").alias("n"))


def each(values: Column, function) -> Column:
    """A function of each element of each frame's list."""
    return F.transform(values, function)


def pixel_statistics(pixels: DataFrame, by: list[str], value: str) -> DataFrame:
    """Mean and population standard deviation of an object's pixels."""
    return pixels.groupBy(*by).agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"))


def flagged(df: DataFrame, known: DataFrame, on: str, name: str) -> DataFrame:
    """Whether a row's name is not among those known."""
    some = known.select(on).distinct().withColumn("_known", F.lit(True))
    return df.join(some, on, "left").withColumn(name, F.col("_known").isNull()).drop("_known")


def labels(df: DataFrame, column: str, background=0) -> DataFrame:
    """Distinct labels without the background."""
    return df.select(column).distinct().where(F.col(column) != background)


def unmatched(df: DataFrame, other: DataFrame, on: str) -> DataFrame:
    """How many rows have no partner."""
    return df.join(other, on, "left_anti").agg(F.count("*").alias("unmatched"))


def pruned(df: DataFrame, names: list[str]) -> DataFrame:
    """Those of the named columns that there are, in the names' order."""
    return df.select(*[n for n in names if n in df.columns])


def with_keys(df: DataFrame, label: str, number: str, lineage: str) -> DataFrame:
    """`label_number` joins label and number by an underscore, `label_lineage` is the label before the lineage."""
    return df.withColumns({"label_number": F.concat_ws("_", label, F.col(number).cast("string")), "label_lineage": F.concat(label, lineage)})


def tile_levels(pixels: DataFrame, by: list[str], value: str) -> DataFrame:
    """Mean and greatest value of each tile."""
    return pixels.groupBy(*by).agg(F.avg(value).alias("mean"), F.max(value).alias("greatest"))
