"""Decline events of series (lysis)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

LATE_H, EARLY_H = 4.0, 0.2


def with_lysis(df: DataFrame, label: str = "label", series: str = "series_key", lineage: str = "lineage", index: str = "time_index", hours: str = "time_hours", round_hours: str = "round_time_hours", area: str = "colony_area", count: str = "ss_area_count", area_rate: str = "ss_area_total_growth_rate", count_rate: str = "ss_area_count_growth_rate", fixed: bool = False) -> DataFrame:
    """W15. A series declines unless its greatest area is in its last row. Series that do not decline, or end early, are projected to the label's end by their mean rates; as in the measures this follows, the projected count starts from the projected area, with `fixed` from the count. Decline spreads to series whose path names a declined one."""
    s = Window.partitionBy(label, series)
    clean = lambda c: F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double"))
    first_max = F.max(F.when(clean(area).isNotNull(), F.struct(clean(area).alias("a"), (-F.col(index)).alias("i"), F.col(count).cast("double").alias("n"), F.col(round_hours).cast("double").alias("t")))).over(s)
    d = df.withColumn("_end", F.max(round_hours).over(Window.partitionBy(label)).cast("double")).withColumn("_m", first_max)
    d = d.withColumn("_last", F.max(F.struct(F.col(index), F.col(hours).alias("h"))).over(s)).withColumn("_first", F.min(F.struct(F.col(index), F.col(hours).alias("h"))).over(s))
    d = d.withColumn("_ra", F.avg(clean(area_rate)).over(s)).withColumn("_rc", F.avg(clean(count_rate)).over(s))
    d = d.withColumn("cmax_time_index", -F.col("_m.i")).withColumn("cmax_at_eop", F.col("cmax_time_index") == F.col(f"_last.{index}"))
    d = d.withColumn("present_at_end", F.col("_last.h") >= LATE_H).withColumn("present_at_start", F.col("_first.h") < EARLY_H)
    d = d.withColumn("_lysis", ~F.col("cmax_at_eop"))
    project = ~(F.col("_lysis") & F.col("present_at_end"))
    left = F.col("_end") - F.col("_m.t")
    d = d.withColumn("cmax_colony_area", F.when(project, F.col("_ra") * left + F.col("_m.a")).otherwise(F.col("_m.a")))
    start = F.col("_m.n") if fixed else F.col("cmax_colony_area")
    d = d.withColumn("cmax_cell_count", F.when(project, F.col("_rc") * left + start).otherwise(F.col("_m.n")))
    d = d.withColumn("cmax_time", F.when(project, F.col("_end")).otherwise(F.col("_m.t")))
    d = d.withColumn("label_lineage", F.concat(F.col(label).cast("string"), F.col(lineage)))
    lysed = d.where("_lysis").select(label, F.col("label_lineage").alias("_t")).distinct()
    named = d.select(label, "label_lineage").distinct().withColumn("_t", F.explode(F.split("label_lineage", r"\.")))
    struck = named.join(lysed, [label, "_t"], "left_semi").select(label, "label_lineage").distinct().withColumn("_struck", F.lit(True))
    d = d.join(struck, [label, "label_lineage"], "left")
    d = d.withColumn("colony_lysis", F.coalesce(F.col("_lysis"), F.lit(False)) | F.coalesce("_struck", F.lit(False)))
    return d.drop("_end", "_m", "_last", "_first", "_ra", "_rc", "_lysis", "_struck")
