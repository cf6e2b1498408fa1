"""Mixing sources to target weights (operator 3).

A golden-ratio sequence u_k = frac(k * phi) is mapped through the cumulative
weights of the sources (their targets, in whole blocks), so that every stretch of the
schedule holds each source in proportion; the slots of a source are ranked, and slot r
takes block r of the source's shuffled documents, laid end to end (twice where the target
asks for it) and cut into blocks of equal word counts. What the mix takes is what its
slots name: a block without a slot is not in it. The schedule is lengthened until each
source has a slot for every block up to its target, whose last block is cut there.

No step gathers a source in one task: ranks and running sums are formed in two
levels, within hash or range buckets and over the buckets' totals.

Defined results: a null or empty text has size 0 and is never taken; a null source
is a source, the last; equal rows are separate documents; an empty table gives no
rows; reruns agree, as the shuffle is a hash of the document; other columns are
ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trackfold.llm.common import checkpointed, parts, table

PHI = 0.6180339887498949
#: Words in a block.
BLOCK = 1024
#: Buckets of a source's documents or slots, over which totals are summed.
BUCKETS = 4096
#: Cells of the unit interval, the equi-join key between slots and sources.
CELLS = 4096
#: Sources up to this many are broadcast; more are joined by a shuffle.
BROADCAST_SOURCES = 10_000
WEIGHTS = (3.0, 1.0, 2.0)


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("bigint")


def ordered(df: DataFrame, by: Column, weight: Column | None = None) -> DataFrame:
    """df with `rank` (from 0) by a global order and `before`, the sum of `weight` over lower ranks: a range sort, and offsets over the sorted partitions' totals."""
    n = parts(df.sparkSession)
    s = df.withColumn("_w", (weight if weight is not None else F.lit(1)).cast("bigint")).repartitionByRange(n, by).sortWithinPartitions(by).withColumn("_i", F.monotonically_increasing_id())
    s = checkpointed(s.withColumn("_p", F.shiftright("_i", 33)).withColumn("_i", F.col("_i").bitwiseAND(F.lit((1 << 33) - 1))))
    over = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    sums = s.groupBy("_p").agg(F.count("*").alias("_n"), F.sum("_w").alias("_s"))
    sums = sums.select("_p", F.coalesce(F.sum("_n").over(over), F.lit(0)).alias("_n"), F.coalesce(F.sum("_s").over(over), F.lit(0)).alias("_s"))
    inner = Window.partitionBy("_p").orderBy("_i").rowsBetween(Window.unboundedPreceding, -1)
    s = s.join(F.broadcast(sums), "_p")  # a row for each partition
    return s.withColumn("rank", F.col("_n") + F.col("_i")).withColumn("before", F.col("_s") + F.coalesce(F.sum("_w").over(inner), F.lit(0))).drop("_w", "_i", "_p", "_n", "_s")


def running(df: DataFrame, group: str, bucket: Column, order: list[str], weight: Column, name: str) -> DataFrame:
    """df with `name`: the sum of weight over the group's rows that come earlier. Rows of a group are spread over buckets in their order."""
    d = df.withColumn("_b", bucket).withColumn("_w", weight.cast("bigint"))
    total = d.groupBy(group, "_b").agg(F.sum("_w").alias("_t"))
    total = total.select(group, "_b", F.coalesce(F.sum("_t").over(Window.partitionBy(group).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_o"))
    inner = Window.partitionBy(group, "_b").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    d = d.withColumn("_in", F.coalesce(F.sum("_w").over(inner), F.lit(0)))
    return d.join(total, [group, "_b"]).withColumn(name, F.col("_o") + F.col("_in")).drop("_b", "_w", "_in", "_o")


def targets(sources: DataFrame, share: float, most: float) -> DataFrame:
    """sources: rank, size. target double: share of the total by WEIGHTS, no target above most * size; the excess is shared again until none is above. One aggregate a round, on the level at which sources fill up."""
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.col("rank") % len(WEIGHTS) + 1).cast("int"))
    s = sources.withColumn("weight", weight).withColumn("cap", F.col("size") * F.lit(most))
    whole = (s.agg(F.sum("size")).first()[0] or 0) * share
    full, level = -1, 0.0
    while True:
        hit = F.col("cap") <= F.col("weight") * F.lit(level)
        n, filled, left = s.agg(F.count_if(hit), F.coalesce(F.sum(F.when(hit, F.col("cap"))), F.lit(0.0)), F.coalesce(F.sum(F.when(~hit, F.col("weight"))), F.lit(0.0))).first()
        if n == full or not left:
            break
        full, level = n, max(level, (whole - filled) / left)
    return s.withColumn("target", F.least("cap", F.col("weight") * F.lit(level))).drop("cap", "weight")


def mixed(docs: DataFrame, share: float = 1.5, most: float = 2.0, block: int = BLOCK, seed: int = 17, also: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """(documents, pieces). documents: doc_id, source, rank (of the source), size, source_size, target, at (its first word in the source's stream), and the columns `also`, which order documents of one id and size. pieces, in mix order by slot: rank, block, slot, at, epoch, doc_id, first (word of the document), n."""
    spark = docs.sparkSession
    sized = checkpointed(docs.select("doc_id", "source", words(F.col("text")).alias("size"), *also))
    sources = ordered(sized.groupBy("source").agg(F.sum("size").alias("size")), F.col("source").asc_nulls_last()).drop("before")
    sources = targets(sources, share, most)
    sources = ordered(sources.withColumnRenamed("rank", "_rank"), F.col("_rank"), F.round("target")).drop("_rank").withColumn("length", F.round("target").cast("bigint"))
    sources = checkpointed(sources.withColumnRenamed("size", "source_size"))
    n, whole = sources.agg(F.count("*"), F.coalesce(F.sum("length"), F.lit(0))).first()
    small = F.broadcast if n <= BROADCAST_SOURCES else (lambda x: x)
    placed = sized.join(small(sources.withColumnRenamed("source", "_s")), F.col("source").eqNullSafe(F.col("_s"))).drop("_s", "before")
    placed = placed.withColumn("_h", F.shiftrightunsigned(F.xxhash64(F.lit(seed), "doc_id", "size"), 1))
    placed = checkpointed(running(placed, "rank", F.shiftright("_h", 51), ["_h", "doc_id", *also], F.col("size"), "at").drop("_h"))  # 4096 buckets

    # the schedule: the least weight is a block's share, which three times as many slots as blocks are sure to meet
    sources = ordered(sources.drop("before").withColumn("blocks", F.ceil(F.col("length") / block)).withColumnRenamed("rank", "_rank"), F.col("_rank"), F.col("blocks")).drop("_rank")
    sources = checkpointed(sources)
    blocks = sources.agg(F.coalesce(F.sum("blocks"), F.lit(0))).first()[0]
    lo, hi = F.col("before") / F.lit(float(blocks or 1)), (F.col("before") + F.col("blocks")) / F.lit(float(blocks or 1))
    spans = sources.where("blocks > 0").select("rank", "blocks", lo.alias("lo"), hi.alias("hi"), F.explode(F.sequence(F.floor(lo * CELLS), F.least(F.floor(hi * CELLS), F.lit(CELLS - 1).cast("bigint")))).alias("cell"))

    def schedule(slots: int) -> DataFrame:
        size = max(1, -(-slots // BUCKETS))
        k = spark.range(slots, numPartitions=parts(spark)).select(F.col("id").alias("slot"), F.expr(f"pmod(id * {PHI!r}D, 1D)").alias("u")).withColumn("cell", F.floor(F.col("u") * CELLS))
        k = k.join(small(spans), "cell").where("lo <= u and u < hi").select("slot", "rank", "blocks")
        return checkpointed(running(k, "rank", F.floor(F.col("slot") / size), ["slot"], F.lit(1), "block").where("block < blocks").select("rank", "block", "slot"))

    slots = 3 * blocks + 64 if blocks else 0
    k = schedule(slots)
    while k.count() < blocks:
        slots *= 2
        k = schedule(slots)

    twice = placed.where("size > 0").withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(max(0, -(-int(most * 1000) // 1000) - 1)))))
    twice = twice.withColumn("from", F.col("epoch") * F.col("source_size") + F.col("at")).withColumn("to", F.least(F.col("from") + F.col("size"), "length")).where("to > from")
    cut = twice.withColumn("block", F.explode(F.sequence(F.floor(F.col("from") / block), F.floor((F.col("to") - 1) / block))))
    a, z = F.greatest("from", F.col("block") * block), F.least("to", (F.col("block") + 1) * block)
    pieces = cut.select("rank", "block", "at", "epoch", "doc_id", (a - F.col("from")).alias("first"), (z - a).alias("n"))
    return placed, pieces.join(k, ["rank", "block"])


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed, pieces = mixed(table(spark, sf_dir, "documents"))
    taken = pieces.groupBy("rank", "at").agg(F.sum("n").alias("taken"), F.min("slot").alias("slot"))  # one document of a size over 0 starts at a place
    both = placed.join(taken, ["rank", "at"], "left")
    return both.select("doc_id", "size", "source_size", "target", F.when(F.col("size") > 0, F.coalesce("taken", F.lit(0))).otherwise(0).cast("bigint").alias("taken"), "source", "slot")
