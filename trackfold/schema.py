"""Schemas, names and missing values of the tables of tracked objects."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

POINT = T.StructType([T.StructField("x", T.IntegerType()), T.StructField("y", T.IntegerType())])
CENTROID = T.StructType([T.StructField("r", T.IntegerType()), T.StructField("c", T.IntegerType())])
IMAGE = T.StructType([T.StructField("h", T.IntegerType()), T.StructField("w", T.IntegerType()), T.StructField("dtype", T.StringType()), T.StructField("px", T.BinaryType())])
FRAMES = T.StructType([
    T.StructField("label", T.StringType()),
    T.StructField("time_index", T.IntegerType()),
    T.StructField("z_index", T.IntegerType()),
    T.StructField("time_s", T.DoubleType()),
    T.StructField("frame_label", T.StringType()),
    T.StructField("image", IMAGE),
])
#: Measures of a cell, in the order of the describe columns.
CELL_METRICS = ("ss_area", "ss_dist_sums", "ss_length", "ss_width", "ss_max_width", "ss_aspect_ratio", "ss_aspect_ratio_max_width")
COLONIES = T.StructType([
    T.StructField("label", T.StringType()),
    T.StructField("time_index", T.IntegerType()),
    T.StructField("colony_index", T.IntegerType()),
    T.StructField("colony_area", T.DoubleType()),
    T.StructField("colony_arc_length", T.DoubleType()),
    T.StructField("centroid", CENTROID),
    T.StructField("on_border", T.BooleanType()),
    T.StructField("contour", T.ArrayType(POINT)),
])
CELLS = T.StructType([
    T.StructField("label", T.StringType()),
    T.StructField("time_index", T.IntegerType()),
    T.StructField("cell_index", T.IntegerType()),
    *[T.StructField(m, T.DoubleType()) for m in CELL_METRICS],
    T.StructField("centroid", CENTROID),
    T.StructField("contour", T.ArrayType(POINT)),
])

# fixed values: micrometres in a pixel; least areas of a colony and of a cell in square micrometres
UM_PER_PIXEL = 0.112
MIN_COLONY_AREA, MIN_CELL_AREA = 2.0, 0.25

# fixed values: by species, sigma of the blur, threshold of the Laplacian, split factor, least mask in pixels
SPECIES = {
    "Staphylococcus aureus": (2.5, -2000.0, 0.75, 15),
    "Escherichia coli": (1.5, -1000.0, 0.3, 60),
    "Pseudomonas aeruginosa": (1.0, -3000.0, 0.65, 30),
}
DEFAULT_SPECIES = "Escherichia coli"


def species_parameters(name: str | None) -> tuple[float, float, float, int]:
    """P20. Null is the default; an unknown species is an error."""
    if name is None:
        name = DEFAULT_SPECIES
    for known, values in SPECIES.items():
        short = known[0] + ". " + known.split()[1]
        if name.lower() in (known.lower(), short.lower()):
            return values
    raise ValueError(f"no parameters for species {name!r}")


def normal_name(name: str) -> str:
    """A column name without signs that need quoting: `%` counts as percentile, letters are lower case."""
    name = re.sub(r"(\d+)%", r"p\1", name).replace("µ", "u")
    return re.sub(r"_+", "_", re.sub(r"\W", "_", name)).strip("_").lower()


def normal_names(df: DataFrame) -> DataFrame:
    """Case-only differences would clash, so a repeated name gets a number."""
    seen: dict[str, int] = {}
    names = []
    for c in df.columns:
        n = normal_name(c)
        seen[n] = seen.get(n, 0) + 1
        names.append(n if seen[n] == 1 else f"{n}_{seen[n]}")
    return df.toDF(*names)


def null_for_nan(df: DataFrame, *columns: str) -> DataFrame:
    """Not-a-number becomes null in these columns, or in all of floating type."""
    floats = [f.name for f in df.schema if isinstance(f.dataType, T.FloatType | T.DoubleType)]
    return df.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in columns or floats})


def with_species(df: DataFrame, column: str) -> DataFrame:
    """P20 as a join with the three species: sigma, threshold, split_factor, least_mask. Null is the default, full names and short ones are known in any case; another name is an error."""
    rows = [(n.lower(), *v) for k, v in SPECIES.items() for n in (k, k[0] + ". " + k.split()[1])]
    known = df.sparkSession.createDataFrame(rows, "_s string, sigma double, threshold double, split_factor double, least_mask long")
    d = df.withColumn("_s", F.lower(F.coalesce(F.col(column), F.lit(DEFAULT_SPECIES)))).join(F.broadcast(known), "_s", "left")
    wrong = F.raise_error(F.concat(F.lit("no parameters for species "), F.col("_s"))).cast("double")
    return d.withColumn("sigma", F.when(F.col("sigma").isNull(), wrong).otherwise(F.col("sigma"))).drop("_s")
