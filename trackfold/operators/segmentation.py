"""Frames to objects, by array kernels inside Arrow functions (I1-I20, J3, J4). A frame, or a label's contours, is what one task holds; pixels are not shuffled."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trackfold import schema
from trackfold.functions.kernels import morph, register, segment
from trackfold.operators.lineage import fold

OBJECTS = T.StructType([
    T.StructField("label", T.StringType()), T.StructField("time_index", T.IntegerType()), T.StructField("kind", T.StringType()), T.StructField("object_index", T.IntegerType()),
    T.StructField("area", T.DoubleType()), T.StructField("arc_length", T.DoubleType()), T.StructField("edt_sum", T.DoubleType()), T.StructField("edt_max", T.DoubleType()),
    T.StructField("centroid", schema.CENTROID), T.StructField("inner", schema.POINT), T.StructField("on_border", T.BooleanType()), T.StructField("edge_distance", T.DoubleType()), T.StructField("contour", T.ArrayType(schema.POINT)),
    T.StructField("height", T.IntegerType()), T.StructField("width", T.IntegerType()),
])


def array_of(image: dict) -> np.ndarray:
    return np.frombuffer(image["px"], dtype=np.dtype(image["dtype"]).newbyteorder("<")).reshape(image["h"], image["w"]).astype(image["dtype"])


def image_of(a: np.ndarray) -> dict:
    return {"h": a.shape[0], "w": a.shape[1], "dtype": a.dtype.name, "px": np.ascontiguousarray(a.astype(a.dtype.newbyteorder("<"))).tobytes()}


def _object(label, t, kind, i, c, shape, edge=None) -> dict:
    m = np.pad(morph.mask_of(c), 1)
    d = morph.distance(m)
    r, k = morph.centroid(c)
    lo, hi = c.min(axis=0), c.max(axis=0)
    inset = 15
    y, x = np.unravel_index(int(d.argmax()), d.shape)
    inner = (int(x - 1 + lo[0]), int(y - 1 + lo[1]))
    inside = lo[0] > inset and lo[1] > inset and hi[0] + 1 < shape[1] - inset and hi[1] + 1 < shape[0] - inset
    at = None if edge is None else float(edge[min(max(r, 0), shape[0] - 1), min(max(k, 0), shape[1] - 1)] * schema.UM_PER_PIXEL)
    return {"label": label, "time_index": t, "kind": kind, "object_index": i, "area": morph.area(c), "arc_length": morph.arc_length(c), "edt_sum": float(d.sum()), "edt_max": float(d.max()), "centroid": {"r": r, "c": k}, "inner": {"x": inner[0], "y": inner[1]}, "on_border": bool(not inside), "edge_distance": at, "contour": [{"x": int(p), "y": int(q)} for p, q in c], "height": shape[0], "width": shape[1]}


def objects(frames: DataFrame, species: str | None = None) -> DataFrame:
    """A row for each colony and each cell of each frame (label, time_index, image). Each frame is a task's work of its own."""
    values = schema.species_parameters(species)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for r in b.itertuples():
                a = array_of(r.image if isinstance(r.image, dict) else r.image.asDict())
                _, colony, cell = segment.segment(a, *values)
                whole = np.zeros(a.shape, dtype=bool)
                for c in colony:
                    whole |= morph.mask_of(c, a.shape)
                edge = morph.distance(whole) if whole.any() else np.zeros(a.shape)
                rows = [_object(r.label, r.time_index, "colony", i, c, a.shape) for i, c in enumerate(colony)] + [_object(r.label, r.time_index, "cell", i, c, a.shape, edge) for i, c in enumerate(cell)]
                if rows:
                    yield pd.DataFrame(rows, columns=OBJECTS.names)

    return frames.select("label", "time_index", "image").mapInPandas(run, OBJECTS)


def cells(found: DataFrame, um: float = schema.UM_PER_PIXEL) -> DataFrame:
    """Measures of cells, as plain columns over area and distances."""
    from trackfold.functions.scalar import cell_measures

    c = found.where("kind = 'cell' and edt_sum > 0")
    return c.select("label", "time_index", F.col("object_index").alias("cell_index"), *[v.alias(k) for k, v in cell_measures(F.col("area"), F.col("edt_sum"), F.col("edt_max"), um).items()], "centroid", F.col("edge_distance").alias("ss_distance_from_colony_edge"), "inner", "contour")


def lineages(found: DataFrame) -> DataFrame:
    """Registration, J4 and J3 of each label: rows label, time_index, kind, object_index, colony_num, lineage, colony_name. A cell's colony_num is its owner's, -1 without. The last frame has none. Labels of two frames or fewer are left out (P16). Contours only enter the group."""
    out = T.StructType([T.StructField("label", T.StringType()), T.StructField("time_index", T.IntegerType()), T.StructField("kind", T.StringType()), T.StructField("object_index", T.IntegerType()), T.StructField("colony_num", T.IntegerType()), T.StructField("lineage", T.StringType()), T.StructField("colony_name", T.StringType())])

    def run(key, pdf: pd.DataFrame) -> pd.DataFrame:
        times = sorted(pdf["time_index"].unique())
        if len(times) <= 2:
            return pd.DataFrame(columns=out.names)
        shape = (int(pdf["height"].iloc[0]), int(pdf["width"].iloc[0]))
        points = lambda c: np.array([(p["x"], p["y"]) for p in c], dtype=np.int64)
        get = lambda t, kind: pdf[(pdf["time_index"] == t) & (pdf["kind"] == kind)].sort_values("object_index")
        colony = [get(t, "colony") for t in times]
        centre = [np.array([(c["c"], c["r"]) for c in f["centroid"]], dtype=float).reshape(-1, 2) for f in colony]
        shifts, total = [(0, 0)], np.zeros(2, dtype=np.int64)
        for a, b in zip(centre, centre[1:], strict=False):
            total = total + np.array(register.offset(a, b, (shape[1], shape[0])))
            shifts.append(tuple(total))
        # places in the first frame's system
        placed = [[points(c) - np.array(s) for c in f["contour"]] for f, s in zip(colony, shifts, strict=True)]
        inner = [[(p["x"] - s[0], p["y"] - s[1]) for p in f["inner"]] for f, s in zip(colony, shifts, strict=True)]
        painted: dict[tuple[int, int], int] = {}

        def paint(into, contours, ids):
            for c, i in zip(contours, ids, strict=True):
                if i >= 0:
                    m = morph.mask_of(c)
                    lo = c.min(axis=0)
                    for y, x in zip(*np.nonzero(m), strict=True):
                        into[int(x + lo[0]), int(y + lo[1])] = i

        def look(t, after):
            # without ids yet, the last frame's colonies are their own roots
            paint(painted, placed[t + 1], after)
            return [painted.get(p, -1) for p in inner[t]]

        ids, paths, names = fold([len(f) for f in colony], look)
        rows = []
        for k, t in enumerate(times[:-1]):
            own: dict[tuple[int, int], int] = {}
            paint(own, placed[k], ids[k])
            for i, n in zip(colony[k]["object_index"], ids[k], strict=True):
                rows.append((key[0], int(t), "colony", int(i), n, paths[n], names[n]))
            f = get(t, "cell")
            for i, p in zip(f["object_index"], f["inner"], strict=True):
                n = own.get((p["x"] - shifts[k][0], p["y"] - shifts[k][1]), -1)
                rows.append((key[0], int(t), "cell", int(i), n, paths[n] if n >= 0 else None, names.get(n)))
        return pd.DataFrame(rows, columns=out.names)

    return found.select("label", "time_index", "kind", "object_index", "centroid", "inner", "contour", "height", "width").groupBy("label").applyInPandas(run, out)


def flattened(stacks: DataFrame, large_backlash: bool = False) -> DataFrame:
    """Frames (label, time_index, z_index, image) to one focused image for each label and time."""
    out = T.StructType([T.StructField("label", T.StringType()), T.StructField("time_index", T.IntegerType()), T.StructField("image", schema.IMAGE)])

    def run(key, pdf: pd.DataFrame) -> pd.DataFrame:
        a = np.stack([array_of(x if isinstance(x, dict) else x.asDict()) for x in pdf.sort_values("z_index")["image"]])
        return pd.DataFrame([(key[0], key[1], image_of(segment.flatten(a, large_backlash)))], columns=out.names)

    return stacks.select("label", "time_index", "z_index", "image").groupBy("label", "time_index").applyInPandas(run, out)


def sharpest(stacks: DataFrame) -> DataFrame:
    """Of each stack the depth of the greatest sharpness."""

    def run(batches):
        for b in batches:
            yield pd.DataFrame({"label": b["label"], "time_index": b["time_index"], "z_index": b["z_index"], "score": [segment.sharpness(array_of(x if isinstance(x, dict) else x.asDict()).astype(float)) for x in b["image"]]})

    s = stacks.select("label", "time_index", "z_index", "image").mapInPandas(run, "label string, time_index int, z_index int, score double")
    return s.groupBy("label", "time_index").agg(F.max(F.struct("score", (-F.col("z_index")).alias("z"))).alias("_b")).select("label", "time_index", (-F.col("_b.z")).alias("z_index"), F.col("_b.score").alias("score"))


def contours_of_labels(raster: np.ndarray) -> dict[int, np.ndarray]:
    """S22."""
    return {int(k): max(morph.contours(raster == k), key=morph.area) for k in np.unique(raster) if k}


def label_mask(shape: tuple[int, int], contours: list[np.ndarray]) -> np.ndarray:
    """Pixels of the i-th contour are i + 1; later ones cover earlier ones."""
    out = np.zeros(shape, dtype=np.uint16)
    for i, c in enumerate(contours):
        out[morph.mask_of(c, shape)] = i + 1
    return out
