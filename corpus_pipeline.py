"""The corpus pipeline: five stages over `documents`, each calling one operator.

STAGES lists (name, function); a function takes (spark, docs, sf_dir) and returns the
next stage's documents, the last the token ids. run() applies them one after another,
writing each stage's rows as Parquet in the shared checkpoint folder and reading them
again, so that a lost executor costs one stage's tasks at most.

Defined results: decisions on documents go by doc_id, so rows of a repeated doc_id share
them; a null doc_id is never rejected; an empty table gives no rows; columns beyond
those of documents are dropped at the first stage.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trackfold.llm import bpe, jaccard, mixing, substring, toxicity
from trackfold.llm.common import bloom, checkpointed, may_hold, parts, shared, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Of a row in the mix: 128 bits of its contents.
KEYS = ("key1", "key2")
#: Words that a task of the last stage holds; its executors have run four stages before.
BLOCK_WORDS = 1_500_000
#: A stage scores with a model, so SQL cannot express the rows.
ORACLE_SQL = None


def _documents(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", "lang", "source", F.col("n_chars").cast("bigint").alias("n_chars"))


def without(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """docs whose doc_id is not in ids. Only rows that a filter of fixed size takes for rejected move to the join."""
    ids = checkpointed(ids.select("doc_id").where("doc_id is not null").distinct())
    filter_ = bloom(ids, "doc_id")
    return may_hold(docs, "doc_id", filter_, False).unionByName(may_hold(docs, "doc_id", filter_).join(ids, "doc_id", "left_anti"))


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity operator rejects go."""
    docs = _documents(docs)
    return without(docs, toxicity.scored(docs, table(spark, sf_dir, "labels")).where("predicted = 1"))


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near duplicates the document of the smallest id stays."""
    docs = _documents(docs)
    return without(docs, jaccard.joined(docs).where("component_id <> doc_id"))


def cut(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated passages go; texts without any stay as they are."""
    out = substring.factored(_documents(docs), whole=True)
    return out.select("doc_id", F.col("kept").alias("text"), "rest.lang", "rest.source", F.char_length("kept").cast("bigint").alias("n_chars"))


def _keyed(docs: DataFrame) -> DataFrame:
    """docs with KEYS, which tell rows apart that differ in any column; null ids and repeated ids included."""
    flags = [F.col(c).isNull() for c in COLUMNS]
    return docs.select("*", *[F.xxhash64(F.lit(i), *flags, *COLUMNS).alias(k) for i, k in enumerate(KEYS)])


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each time the mix takes a document, in the order of the schedule: its text, or the words that are taken where a source's target ends within it."""
    docs = _keyed(_documents(docs))
    placed, pieces = mixing.mixed(docs, also=KEYS)
    taken = pieces.groupBy("rank", "at", "epoch").agg(F.min("first").alias("first"), F.sum("n").alias("n"), F.min("slot").alias("slot"))
    taken = taken.join(placed.where("size > 0").select("rank", "at", "size", *KEYS), ["rank", "at"]).select("size", "first", "n", "slot", *KEYS)
    # equal rows are one here, as each of them has rows of its own in taken
    many = checkpointed(placed.groupBy(*KEYS).agg(F.count("*").alias("m")).where("m > 1").select(*KEYS))
    if not many.isEmpty():
        filter_ = bloom(many, KEYS[0])
        docs = may_hold(docs, KEYS[0], filter_, False).unionByName(may_hold(docs, KEYS[0], filter_).dropDuplicates(list(KEYS)))
    both = taken.join(docs, list(KEYS))
    some = F.array_join(F.slice(F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0)), (F.col("first") + 1).cast("int"), F.col("n").cast("int")), " ")
    text = F.when(F.col("n") == F.col("size"), F.col("text")).otherwise(some)
    out = both.select("slot", "doc_id", text.alias("text"), "lang", "source", F.char_length(text).cast("bigint").alias("n_chars"))
    return out.repartitionByRange(parts(spark), "slot").sortWithinPartitions("slot").drop("slot")


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids, n_tokens."""
    out = bpe.encode(docs.select("doc_id", "text"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, BLOCK_WORDS)
    return out.withColumn("n_tokens", F.size("ids").cast("bigint"))


STAGES = [("toxicity", clean), ("near duplicates", distinct), ("substring dedup", cut), ("mixing", mix), ("tokens", tokens)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    place = f"{shared(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{place}/{k}")
        docs = spark.read.parquet(f"{place}/{k}")
    return docs
