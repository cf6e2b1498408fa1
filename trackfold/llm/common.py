"""What the operators share: tables, checkpoints, and numpy kernels over batches of texts."""

from __future__ import annotations

import contextlib
import ctypes
import re
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Text bytes that one numpy step works on; a longer document makes a step of its own.
STEP_BYTES = 1 << 19
#: Bits of a Bloom filter that is broadcast: its size never follows the data.
BLOOM_BITS = 1 << 26

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_RECORDS = "spark.sql.execution.arrow.maxRecordsPerBatch"
_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"
#: Bytes of a batch that goes to Python, beyond which no further row is added.
BATCH_BYTES = 4 << 20
_R = 0x9E3779B97F4A7C15 | 1
_powers: dict[str, np.ndarray] = {}  # within a task


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table to read. Batches that go to Python are kept small from here on, unless the session says otherwise: a row can be a long text."""
    if spark.conf.get(_RECORDS, "10000") == "10000":
        spark.conf.set(_RECORDS, "1000")
    if spark.conf.get(_BYTES, None) is None:
        spark.conf.set(_BYTES, str(BATCH_BYTES))
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def parts(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def dealt(n: int) -> list[int]:
    """For each of n partitions a number that repartition(n, number) deals to it: the 32-bit Murmur3 hash that Spark deals by, so that no two of n keys meet in one partition."""

    def turn(x, k):
        return (x << np.uint32(k)) | (x >> np.uint32(32 - k))

    v = np.arange(64 * n + 1024, dtype=np.uint32)
    h = np.uint32(42) ^ turn(v * np.uint32(0xCC9E2D51), 15) * np.uint32(0x1B873593)
    h = (turn(h, 13) * np.uint32(5) + np.uint32(0xE6546B64)) ^ np.uint32(4)
    for shift, by in ((16, 0x85EBCA6B), (13, 0xC2B2AE35)):
        h = (h ^ (h >> np.uint32(shift))) * np.uint32(by)
    part = (h ^ (h >> np.uint32(16))).view(np.int32).astype(np.int64) % n
    found, first = np.unique(part, return_index=True)
    out = dict(zip(found.tolist(), first.tolist(), strict=True))
    return [out.get(i, i) for i in range(n)]


def shared(spark: SparkSession) -> str:
    """The shared folder of spark.checkpoint.dir. Where that is unset: one of our own on a single machine, an error on a cluster, whose executors would not see it."""
    place = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if place is None:
        if not re.fullmatch(r"local(\[[^]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        place = tempfile.mkdtemp(prefix="trackfold-checkpoint-")
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(place)
    return place


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage in the shared folder."""
    shared(df.sparkSession)
    return df.checkpoint(eager=True)


def trimmed() -> None:
    """Give memory that a step has freed back to the system; a worker lives on beside others."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def ended() -> None:
    """Forget what a task has kept."""
    _powers.clear()
    trimmed()


def frugal(run: Callable) -> Callable:
    """run, a function of batches; when it is through, the worker keeps nothing of it."""

    def whole(batches):
        yield from run(batches)
        ended()

    return whole


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """r**i and r**-i modulo 2**64 for i < n."""
    if "up" not in _powers or len(_powers["up"]) < n:
        size = max(n, STEP_BYTES + (1 << 16))
        for name, base in (("up", _R), ("down", pow(_R, -1, 1 << 64))):
            x = np.full(size, base, dtype=np.uint64)
            x[0] = 1
            _powers[name] = np.multiply.accumulate(x)
    return _powers["up"], _powers["down"]


class Rolling:
    """Polynomial hashes of any stretch of a sequence of 64-bit values."""

    def __init__(self, values: np.ndarray):
        up, self.down = powers(len(values) + 1)
        self.sums = np.zeros(len(values) + 1, dtype=np.uint64)
        np.cumsum(values.astype(np.uint64, copy=False) * up[: len(values)], out=self.sums[1:])

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix((self.sums[ends] - self.sums[starts]) * self.down[starts] + (ends - starts).astype(np.uint64))

    def every(self, k: int) -> np.ndarray:
        """Of the stretches of length k at 0, 1, 2, ..."""
        n = max(0, len(self.sums) - k)
        return mix((self.sums[k:] - self.sums[:n]) * self.down[:n] + np.uint64(k))


def texts_of(batch: pa.RecordBatch, name: str = "text") -> list[bytes]:
    """UTF-8 bytes; null is empty."""
    x = batch.column(name)
    x = x.cast(pa.large_string()) if not pa.types.is_large_string(x.type) else x
    return x.fill_null("").cast(pa.large_binary()).to_pylist()


def steps(sizes: Iterable[int], most: int = STEP_BYTES) -> Iterator[tuple[int, int]]:
    """Cut a batch into ranges of rows that hold about `most` bytes."""
    begin, total, i = 0, 0, -1
    for i, n in enumerate(sizes):
        if total and total + n > most:
            yield begin, i
            begin, total = i, 0
        total += n + 1
    if i >= begin:
        yield begin, i + 1


class Words:
    """The words [^\\x20\\x09-\\x0D]+ of some texts: bytes `buf`, where words start and end, and the first word of each text (bounds, one more than texts)."""

    def __init__(self, texts: list[bytes], lower: bool = False):
        buf = np.frombuffer(b" " + b" ".join(texts) + b" ", dtype=np.uint8)
        self.buf = _LOWER[buf] if lower else buf
        space = _SPACE[buf]
        turn = space[1:] != space[:-1]
        at = np.flatnonzero(turn) + 1
        self.starts, self.ends = at[::2], at[1::2]
        begins = np.concatenate([[1], 1 + np.cumsum([len(t) + 1 for t in texts])]).astype(np.int64)
        self.bounds = np.searchsorted(self.starts, begins)

    def hashes(self) -> np.ndarray:
        return Rolling(self.buf).of(self.starts, self.ends)


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices starts[0], starts[0]+1, ... of every stretch, one after another."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, dtype=np.int64)
    before = np.cumsum(lengths) - lengths
    return np.arange(total, dtype=np.int64) + np.repeat(starts - before, lengths)


def bloom(ids: DataFrame, column: str):
    """A broadcast Bloom filter of the 64-bit column `column`: BLOOM_BITS bits whatever the number of ids. It only spares shuffling rows: those it lets through wrongly are dropped by the join that follows."""
    spark = ids.sparkSession
    words = BLOOM_BITS // 8

    def build(batches):
        bits = np.zeros(words, dtype=np.uint8)
        some = False
        for b in batches:
            h = mix(b.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64))
            some |= len(h) > 0
            for k in (0, 21):
                at = (h >> np.uint64(k)) % np.uint64(BLOOM_BITS)
                np.bitwise_or.at(bits, (at >> np.uint64(3)).astype(np.int64), (1 << (at & np.uint64(7))).astype(np.uint8))
        if some:
            import zstandard

            piece = words // 64
            for i in range(64):
                x = bits[i * piece : (i + 1) * piece]
                if x.any():
                    yield pa.RecordBatch.from_pydict({"piece": pa.array([i], pa.int32()), "bits": pa.array([zstandard.compress(x.tobytes())], pa.binary())})

    def join(batches):
        import zstandard

        got: dict[int, np.ndarray] = {}
        for b in batches:
            for i, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                y = np.frombuffer(zstandard.decompress(x), dtype=np.uint8)
                got[i] = got[i] | y if i in got else y
        for i, x in got.items():
            yield pa.RecordBatch.from_pydict({"piece": pa.array([i], pa.int32()), "bits": pa.array([zstandard.compress(x.tobytes())], pa.binary())})

    schema = "piece int, bits binary"
    rows = ids.select(F.col(column).cast("bigint").alias("id")).where("id is not null").mapInArrow(frugal(build), schema).repartition(min(64, parts(spark)), "piece").mapInArrow(frugal(join), schema).collect()
    return spark.sparkContext.broadcast((uuid.uuid4().hex, {r.piece: bytes(r.bits) for r in rows}))


def in_bloom(filter_, ids: np.ndarray) -> np.ndarray:
    import zstandard

    key, pieces = filter_.value
    if _powers.get("bloom_key") != key:  # a task has many batches
        bits = np.zeros(BLOOM_BITS // 8, dtype=np.uint8)
        piece = len(bits) // 64
        for i, x in pieces.items():
            bits[i * piece : (i + 1) * piece] = np.frombuffer(zstandard.decompress(x), dtype=np.uint8)
        _powers["bloom_key"], _powers["bloom_bits"] = key, bits
    bits = _powers["bloom_bits"]
    h = mix(ids.astype(np.int64).view(np.uint64))
    out = np.ones(len(h), dtype=bool)
    for k in (0, 21):
        at = (h >> np.uint64(k)) % np.uint64(BLOOM_BITS)
        out &= (bits[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 > 0
    return out


def may_hold(df: DataFrame, column: str, filter_, want: bool = True) -> DataFrame:
    """The rows of df that the filter lets through, or the others."""

    def run(batches):
        for b in batches:
            ids = b.column(column)
            ok = in_bloom(filter_, ids.fill_null(0).to_numpy(zero_copy_only=False)) if len(b) else np.zeros(0, bool)
            yield b.filter(pa.array(ok == want))

    return df.mapInArrow(frugal(run), df.schema)


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Connected components of undirected edges: (id, component), component being the least id reachable. Large-star and small-star rounds: every round is two grouped minima over edges, so a hub's edges are pre-aggregated before the shuffle; the lineage is cut in each round."""
    e = checkpointed(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct())
    if e.isEmpty():
        return e.select(F.col("u").alias("id"), F.col("v").alias("component"))
    last = None
    while True:
        both = e.union(e.select(F.col("v"), F.col("u")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        e = checkpointed(small)
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.count_distinct("u")).first()
        if now == last or now[0] == now[2] and e.join(e.select(F.col("u").alias("v")), "v", "left_semi").isEmpty():
            return e.select(F.col("u").alias("id"), F.col("v").alias("component"))
        last = now
