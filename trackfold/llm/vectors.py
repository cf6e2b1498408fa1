"""Embedding near-dedup (operator 5): an epsilon grid order join.

Unit vectors of cosine c are sqrt(2 - 2c) apart, so the threshold is a distance,
epsilon. Vectors are rotated to principal directions, whose leading coordinates can
only shrink distances, and sorted by grid cells of width epsilon on these. The
sequence is cut into blocks; the join starts from whole sequences and halves
intervals of blocks, dropping each pair of intervals whose bounding boxes are provably
farther apart than epsilon. What is left is compared block by block in double precision.

Equal vectors of a label are one vector with a weight, aggregated before the shuffle, so
copies cost nothing further. Block pairs are dealt by cells of CELL by CELL blocks; a block
moves once to a cell, not once for each pair. A cell gives counts and a spanning forest of
its links, never the pairs themselves, so a large group of near-equal vectors costs rows in
proportion to it.

Defined results: vectors that are null, empty, zero or hold null or non-finite
components, and those of a null label or vec_id, link with nothing; vectors of different
lengths never link; rows of a repeated vec_id are separate vectors of one name: their
links are in one component, and n_links is the largest of theirs; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trackfold.llm.common import checkpointed, components, parts, table

COSINE = 0.98
#: Leading principal directions that order and bound.
LEAD = 6
BLOCK = 256
#: Blocks of a cell's side, as a power of two.
CELL = 4
#: At most about this many vectors fit the directions; any rotation gives the same links.
FIT_ROWS = 4096


def directions(valid: DataFrame, dim: int, rows: int) -> np.ndarray:
    some = valid.where((F.size("v") == dim) & (F.pmod(F.xxhash64("vec_id"), F.lit(1 << 20)) < max(1, int(min(1.0, FIT_ROWS / max(rows, 1)) * (1 << 20))))).select("v").limit(2 * FIT_ROWS).collect()
    if not some:
        return np.eye(dim)[:, :LEAD]
    x = np.array([r.v for r in some], dtype=np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)  # very small and very large ones keep their direction
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    x -= x.mean(axis=0)
    return np.linalg.eigh(x.T @ x)[1][:, ::-1][:, :LEAD]


def linked(vectors: DataFrame, cosine: float = COSINE) -> tuple[DataFrame, DataFrame]:
    """vectors: vec_id, embedding, label. (vectors that links were looked for: vec_id, rep, the least vec_id of an equal vector, and n, the others linked; edges a, b between reps that connect what is linked)"""
    spark = vectors.sparkSession
    eps = math.sqrt(2 - 2 * cosine) + 1e-9
    v = F.transform("embedding", lambda x: x.cast("double"))
    good = F.col("label").isNotNull() & F.col("vec_id").isNotNull() & (F.size("embedding") > 0) & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists("embedding", lambda x: x != 0)
    valid = vectors.where(F.coalesce(good, F.lit(False))).select("vec_id", F.col("label").cast("string").alias("label"), v.alias("v"), F.xxhash64(v).alias("h1"), F.xxhash64(F.lit(1), v).alias("h2"))
    single = vectors.schema["embedding"].dataType.elementType.typeName() == "float"
    kind = np.float32 if single else np.float64  # what moves; compared in double precision
    same = ["label", "h1", "h2"]
    one = valid.groupBy(*same).agg(F.min("vec_id").alias("vec_id"), F.count("*").alias("m"), F.first("v").alias("v"))
    dims = {r["d"]: r["n"] for r in valid.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).collect()}
    axes = {d: directions(valid, d, n) for d, n in dims.items()}

    def cells(batches):
        for b in batches:
            lists = b.column("v")
            size = np.diff(lists.offsets.to_numpy())
            flat = lists.flatten().to_numpy(zero_copy_only=False)
            out = np.zeros((len(b), LEAD))
            scale = np.zeros(len(b))
            offsets = np.concatenate([[0], np.cumsum(size)])
            for d in np.unique(size):
                at = np.flatnonzero(size == d)
                x = flat[offsets[at][:, None] + np.arange(d)]
                top = np.abs(x).max(axis=1)
                y = x / top[:, None]
                scale[at] = np.linalg.norm(y, axis=1)
                y /= scale[at][:, None]
                p = y @ axes[int(d)]
                out[at, : p.shape[1]] = p
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("label"), lists, pa.array(size, pa.int32()), pa.FixedSizeListArray.from_arrays(pa.array(out.ravel()), LEAD).cast(pa.list_(pa.float64())), pa.FixedSizeListArray.from_arrays(pa.array(np.floor(out / eps).ravel().astype(np.int64)), LEAD).cast(pa.list_(pa.int64()))], names=["vec_id", "label", "v", "dim", "p", "cell"]).append_column("m", b.column("m")).append_column("h1", b.column("h1")).append_column("h2", b.column("h2"))

    placed = one.mapInArrow(cells, "vec_id long, label string, v array<double>, dim int, p array<double>, cell array<long>, m long, h1 long, h2 long")
    keys = [F.col("label"), F.col("dim"), F.col("cell")]
    line = checkpointed(placed).repartitionByRange(parts(spark), *keys).sortWithinPartitions(*keys, "vec_id")

    def blocks(batches):
        from pyspark import TaskContext

        place = TaskContext.get().partitionId()
        number = 0
        held: list[dict] = []

        def block():
            nonlocal number
            p = np.array([r["p"] for r in held])
            x = np.array([r["v"] for r in held], dtype=kind)
            names = [np.array([r[c] for r in held], dtype=np.int64).tobytes() for c in ("vec_id", "m", "h1", "h2")]
            out = {"label": [held[0]["label"]], "dim": [held[0]["dim"]], "place": [place], "number": [number], "lo": [p.min(axis=0).tolist()], "hi": [p.max(axis=0).tolist()], "ids": [b"".join(names)], "x": [x.tobytes()]}
            number += 1
            return pa.RecordBatch.from_pydict(out, schema=pa.schema([("label", pa.string()), ("dim", pa.int32()), ("place", pa.int64()), ("number", pa.int64()), ("lo", pa.list_(pa.float64())), ("hi", pa.list_(pa.float64())), ("ids", pa.binary()), ("x", pa.binary())]))

        for b in batches:
            for r in b.select(["vec_id", "label", "v", "dim", "p", "m", "h1", "h2"]).to_pylist():
                if held and (len(held) >= BLOCK or (r["label"], r["dim"]) != (held[0]["label"], held[0]["dim"])):
                    yield block()
                    held = []
                held.append(r)
        if held:
            yield block()

    cut = checkpointed(line.mapInArrow(blocks, "label string, dim int, place long, number long, lo array<double>, hi array<double>, ids binary, x binary"))
    last = cut.agg(F.max("number"), F.max("place")).first()
    low = int(last[0] or 0).bit_length()
    levels = low + int(last[1] or 0).bit_length()
    cut = cut.withColumn("at", F.shiftleft("place", low) + F.col("number")).drop("place", "number")
    boxes = cut.select("label", "dim", "at", "lo", "hi")

    def level(k: int) -> DataFrame:
        sides = [F.array(*[f(F.get(c, i)) for i in range(LEAD)]).alias(c) for c, f in (("lo", F.min), ("hi", F.max))]
        return boxes.groupBy("label", "dim", F.shiftright("at", k).alias("at")).agg(*sides)

    near = F.aggregate(F.zip_with(F.zip_with("lo", "hi2", lambda a, b: a - b), F.zip_with("lo2", "hi", lambda a, b: a - b), lambda a, b: F.greatest(a, b, F.lit(0.0))), F.lit(0.0), lambda s, x: s + x * x) <= eps * eps
    pair = level(levels).select("label", "dim", F.col("at").alias("a"), F.col("at").alias("b"))
    for k in range(levels - 1, -1, -1):
        box = checkpointed(level(k)) if k % 4 == 0 else level(k)
        left = box.select("label", "dim", F.shiftright("at", 1).alias("a"), F.col("at").alias("a1"), "lo", "hi")
        right = box.select("label", "dim", F.shiftright("at", 1).alias("b"), F.col("at").alias("b1"), F.col("lo").alias("lo2"), F.col("hi").alias("hi2"))
        pair = pair.join(left, ["label", "dim", "a"]).join(right, ["label", "dim", "b"]).where((F.col("a1") <= F.col("b1")) & near).select("label", "dim", F.col("a1").alias("a"), F.col("b1").alias("b"))
        if k % 4 == 0:
            pair = checkpointed(pair)
    # a cell's pairs, at most 4 ** CELL, go with each of its blocks
    cell = [F.shiftright("a", CELL).alias("ca"), F.shiftright("b", CELL).alias("cb")]
    x = pair.groupBy("label", "dim", *cell).agg(F.collect_list(F.struct("a", "b")).alias("pairs"))
    x = x.withColumn("at", F.explode(F.array_distinct(F.flatten(F.transform("pairs", lambda p: F.array(p.a, p.b))))))
    x = x.join(cut.select("label", "dim", "at", "ids", "x"), ["label", "dim", "at"]).repartition(parts(spark), "label", "dim", "ca", "cb")  # comparing costs more than moving
    x = x.sortWithinPartitions("label", "dim", "ca", "cb").select("label", "dim", "ca", "cb", "at", "pairs", "ids", "x")

    def compared(blocks_, pairs):
        """Of one cell: rows, their links, edges (places), vec_ids."""
        at = {k: i for i, k in enumerate(sorted(blocks_))}
        ids, m, unit, begin = [], [], [], [0]
        for k in at:
            name, y = blocks_[k]
            ids.append(name[0])
            m.append(name[1])
            y = y.astype(np.float64)
            y = y / np.abs(y).max(axis=1, keepdims=True)
            unit.append((y, np.sqrt((y * y).sum(axis=1))))
            begin.append(begin[-1] + len(y))
        n = [np.zeros(len(x), dtype=np.int64) for x in ids]
        up = np.arange(begin[-1])
        for a, b in pairs:
            i, j = at[a], at[b]
            (xa, na), (xb, nb) = unit[i], unit[j]
            hit = (xa @ xb.T) / (na[:, None] * nb[None, :]) >= cosine
            if i == j:
                np.fill_diagonal(hit, False)
            if not hit.any():
                continue
            n[i] += hit @ m[j]
            if i != j:
                n[j] += hit.T @ m[i]
            # the least label reachable within the pair, spread until nothing changes
            ra, rb = slice(begin[i], begin[i + 1]), slice(begin[j], begin[j + 1])
            while True:
                la, lb = up[ra], up[rb]
                a2 = np.minimum(la, np.where(hit, lb[None, :], begin[-1]).min(axis=1))
                b2 = np.minimum(lb, np.where(hit, a2[:, None], begin[-1]).min(axis=0))
                if (a2 == la).all() and (b2 == lb).all():
                    break
                up[ra], up[rb] = a2, b2
                if i == j:
                    up[ra] = np.minimum(a2, b2)
        ids = np.concatenate(ids)
        row = np.concatenate([(k << 9) + np.arange(len(x)) for k, x in zip(at, n, strict=True)])
        n = np.concatenate(n)
        on = n > 0
        return pa.RecordBatch.from_pydict({"row": pa.array(row[on]), "n": pa.array(n[on]), "a": pa.array(ids[on]), "b": pa.array(ids[up[on]])})

    def compare(batches):
        now, blocks_, pairs = None, {}, []
        for b in batches:
            for r in b.to_pylist():
                key = r["label"], r["dim"], r["ca"], r["cb"]
                if key != now:
                    if blocks_:
                        yield compared(blocks_, pairs)
                    now, blocks_, pairs = key, {}, [(p["a"], p["b"]) for p in r["pairs"]]
                blocks_[r["at"]] = np.frombuffer(r["ids"], np.int64).reshape(4, -1), np.frombuffer(r["x"], kind).reshape(-1, r["dim"])
        if blocks_:
            yield compared(blocks_, pairs)

    found = checkpointed(x.mapInArrow(compare, "row long, n long, a long, b long"))

    def named(batches):
        for b in batches:
            for label, at, ids in zip(*(b.column(c).to_pylist() for c in ("label", "at", "ids")), strict=True):
                ids, m, h1, h2 = np.frombuffer(ids, np.int64).reshape(4, -1)
                yield pa.RecordBatch.from_pydict({"label": pa.array([label] * len(ids), pa.string()), "h1": pa.array(h1), "h2": pa.array(h2), "rep": pa.array(ids), "m": pa.array(m), "row": pa.array((at << 9) + np.arange(len(ids)))})

    rows = cut.select("label", "at", "ids").mapInArrow(named, "label string, h1 long, h2 long, rep long, m long, row long")
    links = found.groupBy("row").agg(F.sum("n").alias("n"))
    rows = rows.join(links, "row", "left").select(*same, "rep", (F.coalesce("n", F.lit(0)) + F.col("m") - 1).alias("n"))
    return valid.select("vec_id", *same).join(rows, same).select("vec_id", "rep", "n"), found.select("a", "b")


def deduped(vectors: DataFrame, cosine: float = COSINE) -> DataFrame:
    """A row per vector: vec_id, n_links, component_id, kept."""
    vectors = vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), "embedding", "label")
    rows, edges = linked(vectors, cosine)
    rows = checkpointed(rows)
    again = rows.groupBy("vec_id").agg(F.count("*").alias("m")).where("m > 1").select("vec_id")
    again = rows.join(again, "vec_id").select(F.col("vec_id").alias("a"), F.col("rep").alias("b"))
    comp = components(edges.where("a <> b").union(again).distinct())
    rows = rows.join(comp.withColumnRenamed("id", "rep"), "rep", "left")
    found = rows.groupBy("vec_id").agg(F.max("n").alias("n_links"), F.min(F.coalesce("component", "rep")).alias("component"))
    out = vectors.select("vec_id").join(found, "vec_id", "left")
    component = F.coalesce("component", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"), component.alias("component_id"), F.coalesce(component == F.col("vec_id"), F.lit(True)).alias("kept"))


def op5_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deduped(table(spark, sf_dir, "embeddings"))


OP5_SQL = r"""
with recursive v as (select vec_id, label, embedding::double[] as e from embeddings),
ok as (select * from v where label is not null and e is not null and len(e) > 0 and len(list_filter(e, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(e, lambda x: x <> 0)) > 0),
l as (select a.vec_id as a, b.vec_id as b from ok a join ok b on a.label = b.label and a.vec_id <> b.vec_id and len(a.e) = len(b.e) where list_cosine_similarity(a.e, b.e) >= 0.98),
r as (select a as id, a as x from l union select r.id, l.b from r join l on r.x = l.a),
c as (select id, min(x) as m from r group by id),
n as (select a, count(*) as n from l group by a)
select v.vec_id, coalesce(n.n, 0)::bigint as n_links, least(v.vec_id, coalesce(c.m, v.vec_id)) as component_id, least(v.vec_id, coalesce(c.m, v.vec_id)) = v.vec_id as kept
from v left join n on n.a = v.vec_id left join c on c.id = v.vec_id
"""
