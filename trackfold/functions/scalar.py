"""Scalar functions over columns (F rows of the inventory)."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def is_float(c: Column) -> Column:
    """text that is a finite number."""
    x = c.try_cast("double")
    return F.coalesce(x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))), F.lit(False))


def two_figures(c: Column) -> Column:
    """a number rounded to two significant figures; text that is none stays."""
    x = c.try_cast("double")
    own = F.when((x != 0) & (F.abs(x) < F.lit(float("inf"))), x)
    digits = F.lit(1) - F.floor(F.log10(F.abs(own))).cast("int")
    scale = F.pow(F.lit(10.0), digits)
    r = F.when(x == 0, F.lit(0.0)).otherwise(F.round(own * scale) / scale)
    return F.when(r.isNull(), c.cast("string")).otherwise(F.regexp_replace(r.cast("string"), r"\.0$", ""))


def to_text(value) -> str:
    """F2 for one value."""
    try:
        x = float(value)
    except (TypeError, ValueError):
        return str(value)
    if not math.isfinite(x):
        return str(value)
    x = round(x, 1 - math.floor(math.log10(abs(x)))) if x else 0.0
    return str(int(x)) if x == int(x) else str(x)


def listify(value) -> list:
    """F3."""
    if value is None:
        return []
    if isinstance(value, str) or not hasattr(value, "__iter__"):
        return [value]
    return list(value)


def group(df: DataFrame, keys):
    """grouped by those keys that are columns; none gives one group."""
    return df.groupBy(*[k for k in listify(keys) if k in df.columns])


def min_max(c: str) -> list[Column]:
    """F5."""
    return [F.min(c).alias(f"{c}_min"), F.max(c).alias(f"{c}_max")]


def pad_label(c: Column) -> Column:
    """a_b_c as "Pad c, a-b"."""
    s = F.split(c, "_")
    return F.format_string("Pad %s, %s-%s", F.try_element_at(s, F.lit(3)), F.try_element_at(s, F.lit(1)), F.try_element_at(s, F.lit(2)))


def condition_label(text_keys: list[str], text_values: list[str], numeric_key: str | list | None = None) -> str:
    """F7, for axis labels. First the numeric key up to its "concentration"; then the keys whose value is a number ("key=value" to two significant figures, the key alone at 1), then the others ("key=value", without those that are 'nan'). If no key is left, all of them in lower case, values too unless they are in capitals. The first letter is a small one."""

    def number(v) -> bool:
        try:
            return math.isfinite(float(v))
        except ValueError:
            return False

    pairs = list(zip(text_keys, text_values, strict=False))
    out = [k if float(v) == 1.0 else f"{k}={to_text(v)}" for k, v in pairs if number(v)]
    out += [f"{k}={v}" for k, v in pairs if not number(v) and v != "nan"]
    if not out:
        out = [f"{k.lower()}={v if v.isupper() else v.lower()}" for k, v in pairs]
    if isinstance(numeric_key, str):
        numeric_key = numeric_key.split("concentration")[0].strip()
    label = ", ".join([*listify(numeric_key), *out]).strip()
    return label[:1].lower() + label[1:]


def safe_filename(c: Column) -> Column:
    """F8: without / % * : < > | \" ', spaces as underscores."""
    return F.translate(c, " /%*:<>|\"'", "_")


def row_letter(n: Column) -> Column:
    """F10."""
    return F.char(n + 65)


def row_number(letter: Column) -> Column:
    return F.ascii(letter) - 65


def ring_distance(i: Column, j: Column, n: Column) -> Column:
    """F17."""
    return F.least(F.abs(i - j), n - F.abs(i - j))


def to_um(pixels: Column, per_pixel: float = 0.112, power: int = 1) -> Column:
    """F18."""
    return pixels * F.lit(per_pixel**power)


def clock(seconds: Column) -> Column:
    """F21."""
    s = F.floor(seconds).cast("bigint")
    return F.format_string("%02d:%02d:%02d", F.floor(s / 3600).cast("bigint"), F.floor(F.pmod(s, F.lit(3600)) / 60).cast("bigint"), F.pmod(s, F.lit(60)))


def mask_key(file: Column) -> Column:
    """F20."""
    return F.split(file, "_x").getItem(0)


def circularity(perimeter: Column, area: Column) -> Column:
    """A21."""
    return F.try_divide(perimeter * perimeter, area * F.lit(4 * 3.141592653589793))


def contour_area(points: Column) -> Column:
    """The shoelace formula over an array of struct x, y."""
    n = F.size(points)
    term = lambda i: F.get(points, i).x * F.get(points, F.pmod(i + 1, n)).y - F.get(points, F.pmod(i + 1, n)).x * F.get(points, i).y
    return F.when(n > 0, F.abs(F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0.0), lambda a, i: a + term(i).cast("double"))) / 2)


def arc_length(points: Column) -> Column:
    n = F.size(points)
    d = lambda i: F.hypot((F.get(points, F.pmod(i + 1, n)).x - F.get(points, i).x).cast("double"), (F.get(points, F.pmod(i + 1, n)).y - F.get(points, i).y).cast("double"))
    return F.when(n > 0, F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0.0), lambda a, i: a + d(i)))


def bounding_box(points: Column) -> Column:
    """Left, top, width, height."""
    x, y = F.transform(points, lambda p: p.x), F.transform(points, lambda p: p.y)
    return F.struct(F.array_min(x).alias("x"), F.array_min(y).alias("y"), (F.array_max(x) - F.array_min(x) + 1).alias("w"), (F.array_max(y) - F.array_min(y) + 1).alias("h"))


def on_border(box: Column, height: int, width: int, inset: int = 15) -> Column:
    """The box is not strictly inside the frame less an inset."""
    return ~((box.x > inset) & (box.y > inset) & (box.x + box.w < width - inset) & (box.y + box.h < height - inset))


def moved(points: Column, dx: Column, dy: Column) -> Column:
    """I24."""
    return F.transform(points, lambda p: F.struct((p.x + dx).cast("int").alias("x"), (p.y + dy).cast("int").alias("y")))


def ring_profile_peak(profile: Column) -> Column:
    """A colony's edge profile rises before it falls, by enough."""
    hi, lo = F.array_max(profile), F.array_min(profile)
    return (F.array_position(profile, hi) < F.array_position(profile, lo)) & (hi > 0.05) & (hi - lo > 0.1)


def cell_measures(area: Column, edt_sum: Column, edt_max: Column, u: float = 0.112) -> dict[str, Column]:
    """Measures of a cell from its area A, its distance sum E and its largest distance, in micrometres."""
    w = 4 * edt_sum / area
    length = area / w + w * (1 - 3.141592653589793 / 4)
    return {"ss_area": area * u**2, "ss_dist_sums": edt_sum * u**3, "ss_length": length * u, "ss_width": w * u, "ss_max_width": 2 * edt_max * u, "ss_aspect_ratio": length / w, "ss_aspect_ratio_max_width": length / (2 * edt_max)}




def versioned(directory: str, name: str, version: str) -> str:
    """A result's place."""
    return f"{directory.rstrip('/')}/{name}/version={version}"
