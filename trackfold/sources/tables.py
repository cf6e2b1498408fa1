"""Readers and writers of tables."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

PLATE_READER = r"^-?\d+(?:\.\d+)$"


def plate_reader_tokens(texts: DataFrame, content: str = "content") -> DataFrame:
    """the second line less its last sign, split at spaces: path, pos, token, is_text. A number needs a decimal point."""
    line = F.expr("substring(_l, 1, char_length(_l) - 1)")
    d = texts.withColumn("_l", F.get(F.split(F.col(content), "\n"), F.lit(1)))
    return d.select("path", F.posexplode(F.split(line, " ")).alias("pos", "token")).where("token <> ''").withColumn("is_text", ~F.col("token").rlike(PLATE_READER))


def plate_reader(texts: DataFrame, experiment: str, content: str = "content", limit: int | None = None) -> DataFrame:
    """The long table of optical densities. The first text after numbers opens a series, further texts beside it are passed over; `t` holds times, `C` temperatures, the others are wells. The columns round_time* hold the times as they are."""
    w = Window.partitionBy("path").orderBy("pos")
    d = plate_reader_tokens(texts, content)
    d = d.withColumn("_open", F.col("is_text") & ~F.coalesce(F.lag("is_text").over(w), F.lit(False)))
    d = d.withColumn("_series", F.sum(F.col("_open").cast("int")).over(w))
    title = F.max(F.when(F.col("_open"), F.col("token"))).over(Window.partitionBy("path", "_series"))
    v = d.withColumn("title", title).where("not is_text and _series > 0")
    v = v.withColumn("at", F.row_number().over(Window.partitionBy("path", "_series").orderBy("pos"))).withColumn("value", F.col("token").try_cast("double"))
    v = v.where(F.col("at") <= limit) if limit else v
    times = v.where("title = 't'").select("path", "at", F.col("value").alias("time"))
    od = v.where("title not in ('t', 'C')").select("path", "at", "title", F.col("value").alias("OD600")).join(times, ["path", "at"])
    row, col = F.substring("title", 1, 1), F.substring("title", 2, 10).try_cast("int")
    return od.select("path", F.lit(experiment).alias("experiment"), (F.col("time") / 86400).alias("time_days"), (F.col("time") / 86400).alias("round_time_days"), F.col("time").alias("round_time"), (F.col("time") / 3600).alias("round_time_hours"), "time", row.alias("row"), col.alias("col"), "OD600", F.col("title").alias("pad_name"), F.concat(F.lit(experiment + "_"), "title").alias("labelid"))


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("content"))


def read_json_folder(spark: SparkSession, path: str, schema) -> DataFrame:
    """All JSON files of a folder; what cannot be read is kept in `_corrupt_record`."""
    from pyspark.sql import types as T

    s = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    return spark.read.schema(s.add("_corrupt_record", T.StringType())).option("multiLine", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt_record").json(path)


def load(spark: SparkSession, path: str) -> DataFrame | None:
    """A stored result, or None if there is none."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e) or "UNABLE_TO_INFER_SCHEMA" in str(e):
            return None
        raise


def store(df: DataFrame, path: str, by: str | None = "label", form: str = "parquet") -> None:
    """Overwrite a stored result, partitioned by label; only labels that df holds are replaced."""
    w = df.write.mode("overwrite").format(form)
    w = w.partitionBy(by).option("partitionOverwriteMode", "dynamic") if by else w
    w.save(path)


def pending(work: DataFrame, done: DataFrame | None, label: str = "label") -> DataFrame:
    """Work whose labels are not stored yet."""
    return work if done is None else work.join(done.select(label).distinct(), label, "left_anti")


def store_fit(df: DataFrame, path: str, separator: str = ",", by_rows: bool = False) -> None:
    """A fit as text, a row for each point, or with `by_rows` a row for each quantity and a column for each point."""
    if by_rows:
        names = [c for c in df.columns if c != "at"]
        df = df.unpivot("at", [F.col(c).cast("double").alias(c) for c in names], "quantity", "value").groupBy("quantity").pivot("at").agg(F.first("value"))
    df.coalesce(1).write.mode("overwrite").option("header", True).option("sep", separator).csv(path)
