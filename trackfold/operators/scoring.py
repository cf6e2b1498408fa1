"""Segmentations scored against annotations. All measures come from one contingency table of label pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def contingency(pixels: DataFrame, by: str = "img", pred: str = "pred", gt: str = "gt") -> DataFrame:
    """Pixels n of each pair of labels; 0 is background."""
    return pixels.groupBy(by, F.col(pred).alias("pred"), F.col(gt).alias("gt")).agg(F.count("*").alias("n"))


def _n(cond: Column, weight: Column | None = None) -> Column:
    return F.coalesce(F.sum(F.when(cond, F.col("n") if weight is None else weight)), F.lit(0)).cast("double")


def compare(ct: DataFrame, by: str = "img", labelled_sum: bool = False) -> DataFrame:
    """B1-B5, B11. labelled_sum: sizes of masks in Dice and the false-negative rate add up label values."""
    p, g = F.col("pred") != 0, F.col("gt") != 0
    both, either = _n(p & g), _n(p | g)
    tp, fp, fn, tn = both, _n(p & ~g), _n(~p & g), _n(~p & ~g)
    sp = _n(p, F.col("n") * F.col("pred")) if labelled_sum else _n(p)
    sg = _n(g, F.col("n") * F.col("gt")) if labelled_sum else _n(g)
    zero = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    return ct.groupBy(by).agg(
        F.try_divide(both, either).alias("iou"), zero(2 * both, sp + sg).alias("dice"), zero(tp, tp + fp).alias("precision"), zero(tp, tp + fn).alias("recall"),
        F.try_divide(_n(F.col("pred") == F.col("gt")), F.sum("n").cast("double")).alias("accuracy"), zero(fp, fp + tn).alias("fpr"), zero(fn, fn + sg).alias("fnr"),
        F.count_distinct(F.when(p, F.col("pred"))).alias("n_pred"), F.count_distinct(F.when(g, F.col("gt"))).alias("n_gt"),
    )


def _areas(ct: DataFrame, by: str, side: str) -> DataFrame:
    return ct.where(F.col(side) != 0).groupBy(by, side).agg(F.sum("n").alias(f"{side}_area"))


def areas(ct: DataFrame, by: str = "img", side: str = "gt") -> DataFrame:
    """The area of every label from 1 to the largest, 0 where it is missing."""
    a = _areas(ct, by, side)
    every = a.groupBy(by).agg(F.max(side).alias("_m")).select(by, F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("_m").cast("bigint"))).alias(side))
    return every.join(a.withColumn(side, F.col(side).cast("bigint")), [by, side], "left").select(by, side, F.coalesce(f"{side}_area", F.lit(0)).alias("area"))


def matched_iou(ct: DataFrame, by: str = "img", least: float = 0.5) -> DataFrame:
    """Of each annotated label the best overlapping prediction (the smaller label of equals); mean of those of at least `least`, 0 if none."""
    o = ct.where((F.col("pred") != 0) & (F.col("gt") != 0)).join(_areas(ct, by, "pred"), [by, "pred"]).join(_areas(ct, by, "gt"), [by, "gt"])
    o = o.withColumn("iou", F.col("n") / (F.col("pred_area") + F.col("gt_area") - F.col("n")))
    best = o.withColumn("_r", F.row_number().over(Window.partitionBy(by, "gt").orderBy(F.desc("iou"), "pred"))).where("_r = 1")
    return ct.select(by).distinct().join(best.where(F.col("iou") >= least).groupBy(by).agg(F.avg("iou").alias("matched_iou")), by, "left").select(by, F.coalesce("matched_iou", F.lit(0.0)).alias("matched_iou"))


def errors_per_label(ct: DataFrame, by: str = "img", least: float = 0.75) -> DataFrame:
    """B7 by annotated label: predictions of which at least `least` lies on it are its matches; none is one error, k are k - 1."""
    m = ct.where((F.col("pred") != 0) & (F.col("gt") != 0)).join(_areas(ct, by, "pred"), [by, "pred"]).where(F.col("n") / F.col("pred_area") >= least)
    k = _areas(ct, by, "gt").join(m.groupBy(by, "gt").agg(F.count("*").alias("_k")), [by, "gt"], "left")
    return k.select(by, "gt", F.when(F.col("_k").isNull(), 1).otherwise(F.col("_k") - 1).cast("bigint").alias("errors"))


def errors(ct: DataFrame, by: str = "img", least: float = 0.75) -> DataFrame:
    """Errors in all, predictions without a match among them, and a map of the labels' own."""
    m = ct.where((F.col("pred") != 0) & (F.col("gt") != 0)).join(_areas(ct, by, "pred"), [by, "pred"]).where(F.col("n") / F.col("pred_area") >= least)
    lone = _areas(ct, by, "pred").join(m.select(by, "pred").distinct(), [by, "pred"], "left_anti").groupBy(by).agg(F.count("*").alias("_lone"))
    per = errors_per_label(ct, by, least).groupBy(by).agg(F.sum("errors").alias("_sum"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("gt", "errors")))).alias("errors_per_label"))
    out = ct.select(by).distinct().join(per, by, "left").join(lone, by, "left")
    return out.select(by, (F.coalesce("_sum", F.lit(0)) + F.coalesce("_lone", F.lit(0))).alias("errors"), F.coalesce("_lone", F.lit(0)).alias("unmatched"), "errors_per_label")


def metrics(ct: DataFrame, by: str = "img") -> DataFrame:
    """Errors, overlap, counts of labels and lists of areas."""
    count = lambda side: ct.groupBy(by).agg(F.max(side).cast("bigint").alias(f"{side}_count"))
    lists = lambda side: areas(ct, by, side).groupBy(by).agg(F.transform(F.array_sort(F.collect_list(F.struct(side, "area"))), lambda s: s["area"]).alias(f"{side}_areas"))
    out = errors(ct, by).join(compare(ct, by).select(by, "iou"), by)
    for side in ("pred", "gt"):
        out = out.join(count(side), by, "left").join(lists(side), by, "left")
    return out


def results(m: DataFrame, by: str = "img") -> DataFrame:
    """Species is the first word before `_`; mean errors and areas; the area error is found over annotated less 1."""
    mean = lambda c: F.try_divide(F.aggregate(c, F.lit(0).cast("bigint"), lambda a, x: a + x).cast("double"), F.size(c))
    d = m.withColumn("species", F.substring_index(by, "_", 1)).withColumn("cell_count", F.size("errors_per_label").cast("bigint")).withColumn("mean_errors", mean(F.map_values("errors_per_label")))
    d = d.withColumn("mean_pred_area", mean(F.col("pred_areas"))).withColumn("mean_gt_area", mean(F.col("gt_areas")))
    return d.select(by, "species", "cell_count", "mean_errors", "mean_pred_area", "mean_gt_area", (F.try_divide("mean_pred_area", "mean_gt_area") - 1).alias("area_error"))


def colony_errors(ct: DataFrame, cells: DataFrame, by: str = "img") -> DataFrame:
    """B8 by intent: annotated colonies with and without an annotated cell. cells: by, colony."""
    has = cells.select(by, F.col("colony").alias("gt")).distinct().withColumn("_c", F.lit(1))
    return _areas(ct, by, "gt").join(has, [by, "gt"], "left").groupBy(by).agg(F.count("_c").alias("with_cells"), F.count_if(F.col("_c").isNull()).alias("without_cells"))
