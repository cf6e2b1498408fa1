"""Well plates: names, centres, points (rows F10-F16, T5)."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Plate:
    name: str
    pitch_x: float
    pitch_y: float
    offset_x: float
    offset_y: float
    last_col: int
    last_row: str
    first_col: int = 1
    first_row: str = "A"

    @property
    def wells(self) -> int:
        return (self.last_col - self.first_col + 1) * (ord(self.last_row) - ord(self.first_row) + 1)


# fixed values: pitch and offset of the first well in micrometres, last column, last row
PLATES = {
    60: Plate("60", 9000.0, 9000.0, -40500.0, -22500.0, 10, "F"),
    96: Plate("96", 9000.0, 9000.0, -49500.0, -31500.0, 12, "H"),
    384: Plate("384", 9000.0, 9000.0, -49500.0, -31500.0, 24, "P"),
}


def parsed(name: str, plate: Plate) -> tuple[str, int]:
    """row and column of a pad such as B10; out of bounds is an error."""
    m = re.fullmatch(r"([A-Z])(\d+)", name)
    if not m or not (plate.first_row <= m[1] <= plate.last_row and plate.first_col <= int(m[2]) <= plate.last_col):
        raise ValueError(f"no pad {name!r} on plate {plate.name}")
    return m[1], int(m[2])


def pads(expression: str, plate: Plate) -> list[str]:
    """a pad, or a rectangle such as A1-B3 or A1:B3, or several parted by commas, in reading order."""
    out = []
    for part in filter(None, re.split(r"\s*,\s*", expression.strip())):
        ends = re.split(r"\s*[-:]\s*", part)
        (r0, c0), (r1, c1) = parsed(ends[0], plate), parsed(ends[-1], plate)
        out += [f"{chr(r)}{c}" for r in range(min(ord(r0), ord(r1)), max(ord(r0), ord(r1)) + 1) for c in range(min(c0, c1), max(c0, c1) + 1)]
    return list(dict.fromkeys(out))


def with_pad(df: DataFrame, name: str, plate: Plate) -> DataFrame:
    """row, col, row_index and whether the pad is on the plate."""
    row, col = F.regexp_extract(name, r"^([A-Z])(\d+)$", 1), F.regexp_extract(name, r"^([A-Z])(\d+)$", 2).try_cast("int")
    ok = (row >= plate.first_row) & (row <= plate.last_row) & col.between(plate.first_col, plate.last_col)
    return df.withColumns({"row": F.when(ok, row), "col": F.when(ok, col), "row_index": F.when(ok, F.ascii(row) - ord(plate.first_row)), "on_plate": F.coalesce(ok, F.lit(False))})


def center(row_index: Column, col: Column, plate: Plate) -> tuple[Column, Column]:
    """micrometres."""
    return (col - plate.first_col) * plate.pitch_x + plate.offset_x, row_index * plate.pitch_y + plate.offset_y


def pad_at(x: Column, y: Column, plate: Plate, flipped: bool = False) -> Column:
    """the name of the pad nearest to a point; the fraction is cut off after adding a half, and places beyond the edge are the edge's. flipped: x runs the other way."""
    x = -x if flipped else x
    col = F.least(F.greatest(((x - plate.offset_x) / plate.pitch_x + 1.5).cast("int"), F.lit(plate.first_col)), F.lit(plate.last_col))
    row = F.least(F.greatest(((y - plate.offset_y) / plate.pitch_y + 0.5).cast("int"), F.lit(0)), F.lit(ord(plate.last_row) - ord(plate.first_row)))
    return F.concat(F.char(row + ord(plate.first_row)), col.cast("string"))


def traversal(df: DataFrame, row_index: str, col: str) -> DataFrame:
    """T5: row by row, every second row backwards; `position` from 1 within the table. For a plate's pads, not for large tables."""
    from pyspark.sql import Window

    order = Window.orderBy(row_index, F.when(F.col(row_index) % 2 == 1, -F.col(col)).otherwise(F.col(col)))
    return df.withColumn("position", F.row_number().over(order).cast("bigint"))


def table(spark: SparkSession) -> DataFrame:
    """A row for each plate."""
    rows = [(p.name, p.wells, p.pitch_x, p.pitch_y, p.offset_x, p.offset_y, p.first_col, p.last_col, p.first_row, p.last_row) for p in PLATES.values()]
    return spark.createDataFrame(rows, "plate string, well_count int, grid_pitch_x double, grid_pitch_y double, feducial_offset_x double, feducial_offset_y double, first_col int, last_col int, first_row string, last_row string")
