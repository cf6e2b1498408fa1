"""Exact repeats of a fixed length across documents: what operators 4 and 6 share.

A document is a sequence of units (bytes or words). A window is `width` consecutive
units of one document; it is repeated if it also starts in a document with a smaller
id. The task is to mark each repeated window, without shuffling every window.

1. Parse. A rolling hash runs over grams of `gram` units, and the trigger of a window
   is its least gram, the leftmost of equals: it depends on the window's content
   alone, and every window has one. Consecutive windows of one trigger form a phrase,
   so that each window belongs to one phrase of its document. Equal windows have equal
   triggers, at equal places.
2. Dictionary. Phrases meet by trigger. Of each distinct phrase the first document
   is kept; its other documents hold nothing but repeated windows there, and are done.
   Within one map step copies are settled before anything is shuffled, which is what
   a passage in a third of all documents comes down to.
3. Search. Only where different phrases share a trigger, the first documents' phrases
   are brought together in blocks, each with all phrases of its triggers, and an operator's
   own search finds the windows there that an earlier document holds: operator 4 puts the
   suffixes in order to the depth of a window, operator 6 factors each phrase against
   the block.
4. Marks go back to their documents. A Bloom filter of fixed size spares documents
   without marks the shuffle; what it lets through wrongly finds no marks in the join.

Phrase hashes hold 48 bits beside the trigger's 56; step 3 compares units.

A row is known by its doc_id, which orders, and a key: 0, or a hash of its text where the
doc_id is null or repeated, so that rows of one id with different texts have marks of
their own. Equal rows share a key and their marks.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trackfold.llm.common import Rolling, bloom, checkpointed, dealt, frugal, in_bloom, mix, parts, ragged, steps, texts_of

_ROWS = 60_000
#: Stands for a null doc_id, so that it joins and counts as the smallest.
_NULL = -(1 << 63)
#: Entries that a task holds before it sends them.
_HELD = 600_000
#: Blocks that a task searches one after another.
_PIECES = 16
#: Bytes of phrases that a task holds before it sends them.
_CONTENT = 16 << 20


@dataclass(frozen=True)
class Shape:
    """units(texts) gives the values of all texts, one after another, and the bounds of the texts. search(values, sizes, docs, width) gives, for each window of a block's phrases, whether it starts in a phrase of a smaller document too."""

    units: Callable[[list[bytes]], tuple[np.ndarray, np.ndarray]]
    width: int
    gram: int
    search: Callable[[np.ndarray, np.ndarray, np.ndarray, int], np.ndarray]


@dataclass
class Phrases:
    """Per phrase: doc, number in its document, trigger, hash; windows [lo, hi] (places in the values)."""

    doc: np.ndarray
    number: np.ndarray
    trigger: np.ndarray
    hash: np.ndarray
    lo: np.ndarray
    hi: np.ndarray


def parse(values: np.ndarray, bounds: np.ndarray, shape: Shape) -> Phrases:
    """The phrases of some texts."""
    none = np.zeros(0, dtype=np.int64)
    w, k = shape.width, shape.gram
    m = len(values) - w + 1
    if m <= 0:
        return Phrases(none, none, none.view(np.uint64), none.view(np.uint64), none, none)
    roll = Rolling(values)
    gram = roll.every(k)
    low, reach, need = gram, 1, w - k + 1
    while reach < need:
        s = min(reach, need - reach)
        low = np.minimum(low[s:], low[:-s])
        reach += s
    low = low[:m]
    counts = np.maximum(np.diff(bounds) - w + 1, 0)  # windows of each text
    valid = np.zeros(m + 1, dtype=np.int8)
    has = counts > 0
    np.add.at(valid, bounds[:-1][has], 1)
    np.add.at(valid, bounds[:-1][has] + counts[has], -1)
    valid = np.cumsum(valid[:m]).astype(bool)
    turn = np.ones(m, dtype=bool)
    # the trigger changes with the least gram, and where it was the window's first gram
    turn[1:] = (low[1:] != low[:-1]) | (gram[: m - 1] == low[:-1]) | ~valid[:-1]
    turn[bounds[:-1][has]] = True
    lo = np.flatnonzero(turn & valid)
    if not len(lo):
        return Phrases(none, none, none.view(np.uint64), none.view(np.uint64), none, none)
    end = np.flatnonzero(valid & np.r_[turn[1:] | ~valid[1:], True])
    doc = np.searchsorted(bounds, lo, "right") - 1
    first = np.r_[True, doc[1:] != doc[:-1]]
    number = np.arange(len(lo)) - np.flatnonzero(first)[np.cumsum(first) - 1]
    return Phrases(doc, number, low[lo], roll.of(lo, end + w), lo, end)


_T56, _H48 = np.uint64((1 << 56) - 1), np.uint64((1 << 48) - 1)
_ENTRY = np.dtype([("t", "<u8"), ("h", "<u8"), ("doc", "<i8"), ("k", "<i8"), ("n", "<u4")])


def _part(t: np.ndarray, n: int) -> np.ndarray:
    """Of n parts, in the order of t."""
    return (((t >> np.uint64(24)) * np.uint64(n)) >> np.uint64(32)).astype(np.int64)


def _numbered(doc: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct rows (doc_ids, keys), and which of them each is."""
    if not key.any():
        docs, which = np.unique(doc, return_inverse=True)
        return docs, np.zeros(len(docs), np.int64), which
    order = np.lexsort((key, doc))
    new = np.r_[True, (doc[order][1:] != doc[order][:-1]) | (key[order][1:] != key[order][:-1])]
    which = np.empty(len(doc), dtype=np.int64)
    which[order] = np.cumsum(new) - 1
    return doc[order][new], key[order][new], which


def _planes(x: np.ndarray, used: int) -> bytes:
    return x.view(np.uint8).reshape(len(x), -1)[:, :used].T.tobytes()


def _pack(x: np.ndarray) -> bytes:
    """x by ascending t. Differences of t, 48 bits of h, rows as places in a list, numbers."""
    docs, keys, which = _numbered(x["doc"], x["k"])
    t = x["t"].copy()
    t[1:] -= x["t"][:-1]
    wide, long_ = len(docs) > 65536, int(x["n"].max()) > 65535
    head = np.array([len(x), len(docs), wide, long_], dtype=np.int64)
    body = _planes(t, 7) + _planes(np.ascontiguousarray(x["h"]), 6) + docs.astype(np.int64).tobytes() + keys.astype(np.int64).tobytes() + _planes(which.astype(np.uint32), 4 if wide else 2) + _planes(x["n"].astype(np.uint32), 4 if long_ else 2)
    return zstandard.compress(head.tobytes() + body, 1)


def _unpack(blob: bytes) -> np.ndarray:
    raw = zstandard.decompress(blob)
    m, d, wide, long_ = np.frombuffer(raw, np.int64, 4)
    o = 32

    def planes(used, kind):
        nonlocal o
        out = np.zeros((m, np.dtype(kind).itemsize), dtype=np.uint8)
        out[:, :used] = np.frombuffer(raw, np.uint8, used * m, o).reshape(used, m).T
        o += used * m
        return out.view(kind).ravel()

    out = np.empty(m, dtype=_ENTRY)
    out["t"] = np.cumsum(planes(7, "<u8"), dtype=np.uint64)
    out["h"] = planes(6, "<u8")
    docs = np.frombuffer(raw, np.int64, d, o)
    keys = np.frombuffer(raw, np.int64, d, o + 8 * d)
    o += 16 * d
    which = planes(4 if wide else 2, "<u4")
    out["doc"], out["k"] = docs[which], keys[which]
    out["n"] = planes(4 if long_ else 2, "<u4")
    return out


def _by_row(doc: np.ndarray, key: np.ndarray, marks: np.ndarray) -> pa.RecordBatch:
    """Marks (unsigned 32 bits) as one binary value for each row."""
    docs, keys, which = _numbered(doc, key)
    order = np.argsort(which, kind="stable")
    marks = np.ascontiguousarray(marks[order].astype("<u4"))
    cuts = np.searchsorted(which[order], np.arange(len(docs) + 1))
    value = pa.Array.from_buffers(pa.binary(), len(docs), [None, pa.py_buffer((cuts * 4).astype(np.int32)), pa.py_buffer(marks)])
    return pa.RecordBatch.from_pydict({"doc_id": pa.array(docs), "key": pa.array(keys), "marks": value})


def _bucketed(doc: np.ndarray, key: np.ndarray, marks: np.ndarray, n: int) -> list[tuple[int, bytes]]:
    """Marks dealt by row into n buckets: a packed row for each bucket, however many documents it has."""
    if not len(doc):
        return []
    bucket = (mix(doc.view(np.uint64) ^ mix(key.view(np.uint64))) % np.uint64(n)).astype(np.int64)
    order = np.lexsort((key, doc, bucket))
    doc, key, marks, bucket = doc[order], key[order], marks[order].astype("<u4"), bucket[order]
    cuts = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1], True])
    deal = dealt(n)
    out = []
    for a, z in zip(cuts[:-1], cuts[1:], strict=True):
        step = np.diff(doc[a:z], prepend=0)
        out.append((deal[int(bucket[a])], zstandard.compress(_planes(step, 8) + _planes(key[a:z], 8) + _planes(marks[a:z], 4), 1)))
    return out


def _gathered(rows: DataFrame, name: str) -> DataFrame:
    """rows: bucket, blob. A row for each row of documents: doc_id, key and its marks."""

    def run(batches):
        doc, key, marks = [], [], []
        for b in batches:
            for blob in b.column("blob").to_pylist():
                raw = zstandard.decompress(blob)
                m = len(raw) // 20
                planes = lambda o, n: np.frombuffer(raw, np.uint8, n * m, o * m).reshape(n, m).T.copy()  # noqa: B023, E731
                doc.append(np.cumsum(planes(0, 8).view(np.int64).ravel()))
                key.append(planes(8, 8).view(np.int64).ravel())
                marks.append(planes(16, 4).view("<u4").ravel())
        if doc:
            out = _by_row(*(np.concatenate(x) for x in (doc, key, marks)))
            for i in range(0, len(out), 10_000):
                yield out.slice(i, 10_000).rename_columns(["doc_id", "key", name])

    return rows.repartition(parts(rows.sparkSession), "bucket").mapInArrow(frugal(run), f"doc_id long, key long, {name} binary")


def _stepped(batches, shape: Shape):
    """(batch slice, texts, values, bounds), a few MB of text at a time."""
    for b in batches:
        texts = texts_of(b) if "text" in b.schema.names else _unpacked(b)
        for i in range(0, len(texts), _ROWS):
            for a, z in steps(len(t) for t in texts[i : i + _ROWS]):
                some = texts[i + a : i + z]
                yield b.slice(i + a, z - a), some, *shape.units(some)


def packed(docs: DataFrame, filter_, want: bool = True) -> DataFrame:
    """Documents that a filter lets through (or the others), texts compressed for a shuffle."""
    schema = T.StructType([T.StructField("packed", T.BinaryType()) if f.name == "text" else f for f in docs.schema])

    def run(batches):
        z = zstandard.ZstdCompressor(level=3)
        for b in batches:
            ok = in_bloom(filter_, _ids(b)) if len(b) else np.zeros(0, bool)
            b = b.filter(pa.array(ok == want))
            at = b.schema.get_field_index("text")
            yield b.set_column(at, "packed", pa.array([z.compress(t) for t in texts_of(b)], pa.binary()))

    return docs.mapInArrow(frugal(run), schema)


def _unpacked(b: pa.RecordBatch) -> list[bytes]:
    z = zstandard.ZstdDecompressor()
    return [z.decompress(x) for x in b.column("packed").to_pylist()]


def _same(x: np.ndarray, *names: str) -> np.ndarray:
    """For sorted x: whether a row equals the one before in these fields."""
    out = np.zeros(len(x), dtype=bool)
    if len(x):
        out[1:] = np.logical_and.reduce([x[c][1:] == x[c][:-1] for c in names])
    return out


def _ids(b: pa.RecordBatch) -> np.ndarray:
    return b.column("doc_id").to_numpy()


def _keys(b: pa.RecordBatch) -> np.ndarray:
    return b.column("key").to_numpy()


#: A mark of step 2 is a phrase's number, doubled, and 1 if its windows are still open.
def dictionary(docs: DataFrame, shape: Shape) -> DataFrame:
    """Steps 1 and 2: doc_id, key, marks."""
    n_parts = parts(docs.sparkSession)
    deal = np.array(dealt(n_parts))

    def send(held):
        x = np.concatenate(held)
        order = np.argsort(x["t"])
        x = x[order]
        near = x["t"][1:] == x["t"][:-1]
        shared = np.flatnonzero(np.r_[False, near] | np.r_[near, False])
        x[shared] = x[shared[np.lexsort((x["n"][shared], x["k"][shared], x["doc"][shared], x["h"][shared], x["t"][shared]))]]
        again = _same(x, "t", "h")
        first = x["doc"][np.maximum.accumulate(np.where(again, 0, np.arange(len(x))))]
        done = x["doc"] > first
        settled, x = x[done], x[~done]
        part = _part(x["t"], n_parts)
        cuts = np.flatnonzero(np.r_[True, part[1:] != part[:-1], True])
        blobs = [_pack(x[a:z]) for a, z in zip(cuts[:-1], cuts[1:], strict=True)]
        yield pa.RecordBatch.from_pydict({"part": pa.array(deal[part[cuts[:-1]]], pa.int32()), "settled": pa.array([False] * len(blobs)), "blob": pa.array(blobs, pa.binary())})
        if rows := _bucketed(np.ascontiguousarray(settled["doc"]), np.ascontiguousarray(settled["k"]), settled["n"] << np.uint32(1), n_parts):
            yield pa.RecordBatch.from_pydict({"part": pa.array([r[0] for r in rows], pa.int32()), "settled": pa.array([True] * len(rows)), "blob": pa.array([r[1] for r in rows], pa.binary())})

    def phrases(batches):
        held, size = [], 0
        for b, _, values, bounds in _stepped(batches, shape):
            p = parse(values, bounds, shape)
            x = np.empty(len(p.lo), dtype=_ENTRY)
            x["t"], x["h"], x["doc"], x["k"], x["n"] = p.trigger & _T56, p.hash & _H48, _ids(b)[p.doc], _keys(b)[p.doc], p.number
            held.append(x)
            size += len(x)
            if size > _HELD:
                yield from send(held)
                held, size = [], 0
        if size:
            yield from send(held)

    def meet(batches):
        held = []
        for b in batches:
            own = b.column("settled")
            if (settled := b.filter(own)).num_rows:
                yield pa.RecordBatch.from_pydict({"bucket": settled.column("part"), "blob": settled.column("blob")})
            held += [_unpack(x) for x in b.filter(pc.invert(own)).column("blob").to_pylist()]
        if not held:
            return
        x = np.concatenate(held)
        del held
        # most triggers occur once: only the others are sorted in full
        order = np.argsort(x["t"])
        t = x["t"][order]
        same = t[1:] == t[:-1]
        x = x[order[np.r_[False, same] | np.r_[same, False]]]
        x = x[np.lexsort((x["doc"], x["h"], x["t"]))]
        index = np.arange(len(x))
        start = np.maximum.accumulate(np.where(_same(x, "t", "h"), 0, index))
        first = x["doc"][start]  # of the phrase
        over = _same(x, "t")
        groups = np.cumsum(~over) - 1 if len(x) else index
        begin = np.flatnonzero(~over)
        least = np.minimum.reduceat(first, begin)[groups] if len(x) else first
        most = np.maximum.reduceat(first, begin)[groups] if len(x) else first
        covered = x["doc"] > first
        several = np.maximum.reduceat(start, begin)[groups] > begin[groups] if len(x) else covered
        still = ~covered & several & (least != most)
        marks = (x["n"] << np.uint32(1)) | still
        some = covered | still
        if rows := _bucketed(x["doc"][some], x["k"][some], marks[some], n_parts):
            yield pa.RecordBatch.from_pydict({"bucket": pa.array([r[0] for r in rows], pa.int32()), "blob": pa.array([r[1] for r in rows], pa.binary())})

    sent = docs.select("doc_id", "key", "text").mapInArrow(frugal(phrases), "part int, settled boolean, blob binary")
    return _gathered(sent.repartition(n_parts, "part").mapInArrow(frugal(meet), "bucket int, blob binary"), "marks")


def _marks(b: pa.RecordBatch, name: str) -> list[np.ndarray]:
    return [np.frombuffer(x, "<u4") if x else np.zeros(0, "<u4") for x in b.column(name).to_pylist()]


def _picked(marks: list[np.ndarray], p: Phrases, bounds_of: np.ndarray) -> np.ndarray:
    """Places in p of the numbered phrases of each document, one document after another."""
    n = np.array([len(m) for m in marks])
    return (np.concatenate(marks) if len(marks) else np.zeros(0, "<u4")).astype(np.int64) + np.repeat(bounds_of, n)


def ranks(values: np.ndarray, width: int) -> np.ndarray:
    """Suffix order to a depth of `width`: equal numbers for equal stretches, in the order of their content. Prefix doubling: the order by 2n units comes from the orders by n at both halves. Stretches over the end are padded."""
    if values.dtype == np.uint8:
        pad = np.concatenate([values, np.zeros(8, np.uint8)])
        key = np.zeros(len(values), dtype=np.uint64)
        for i in range(8):
            key = (key << np.uint64(8)) | pad[i : i + len(values)]
        depth = 8
    else:
        key, depth = values, 1
    rank = np.unique(key, return_inverse=True)[1].astype(np.uint64)
    while depth < width:
        s = min(depth, width - depth)
        ahead = np.zeros_like(rank)
        ahead[:-s or None] = rank[s:]
        rank = np.unique((rank << np.uint64(32)) | ahead, return_inverse=True)[1].astype(np.uint64)
        depth += s
    return rank


def by_order(values: np.ndarray, size: np.ndarray, doc: np.ndarray, width: int) -> np.ndarray:
    """The search of operator 4: equal windows have one rank, and the first document of each rank is known."""
    windows = size - width + 1
    r = ranks(values, width)[ragged(np.cumsum(size) - size, windows)].astype(np.int64)
    owner = np.repeat(doc, windows)
    first = np.full(int(r.max()) + 1, np.iinfo(np.int64).max)
    np.minimum.at(first, r, owner)
    return owner > first[r]


def searched(open_: DataFrame, shape: Shape) -> DataFrame:
    """Step 3. open_: doc_id, key, text, marks. doc_id, key, late: the places of windows that start in an earlier document too."""
    n_parts = parts(open_.sparkSession)
    pieces = n_parts * _PIECES

    def send(held):
        part, doc, key, lo, size, text = (np.concatenate(x) for x in zip(*held, strict=True))
        order = np.argsort(part, kind="stable")
        text = text[ragged((np.cumsum(size) - size)[order], size[order])]
        part, doc, key, lo, size = part[order], doc[order], key[order], lo[order], size[order]
        end = np.concatenate([[0], np.cumsum(size)])
        cuts = np.flatnonzero(np.r_[True, part[1:] != part[:-1], True])
        blobs = []
        for a, z in zip(cuts[:-1], cuts[1:], strict=True):
            own = text[end[a] : end[z]]
            head = np.array([z - a, len(own), own.dtype.itemsize], dtype=np.int64)
            blobs.append(zstandard.compress(head.tobytes() + doc[a:z].tobytes() + key[a:z].tobytes() + lo[a:z].tobytes() + size[a:z].tobytes() + own.tobytes(), 1))
        return pa.RecordBatch.from_pydict({"part": pa.array(part[cuts[:-1]], pa.int32()), "blob": pa.array(blobs, pa.binary())})

    def contents(batches):
        held, units = [], 0
        for b, _, values, bounds in _stepped(batches, shape):
            p = parse(values, bounds, shape)
            marks = [m[m & 1 > 0] >> 1 for m in _marks(b, "marks")]
            at = _picked(marks, p, np.searchsorted(p.doc, np.arange(len(bounds) - 1)))
            if not len(at):
                continue
            size = p.hi[at] - p.lo[at] + shape.width
            part = _part(p.trigger[at] & _T56, pieces)
            held.append((part, _ids(b)[p.doc[at]], _keys(b)[p.doc[at]], p.lo[at] - bounds[p.doc[at]], size, values[ragged(p.lo[at], size)]))
            units += int(size.sum())
            if units * values.itemsize > _CONTENT:
                yield send(held)
                held, units = [], 0
        if held:
            yield send(held)

    def blocks(batches):
        blobs: dict[int, list[bytes]] = {}
        for b in batches:
            for part, blob in zip(b.column("part").to_pylist(), b.column("blob").to_pylist(), strict=True):
                blobs.setdefault(part, []).append(blob)
        found = []
        while blobs:
            found.append(block(blobs.popitem()[1]))
        if found and (rows := _bucketed(*(np.concatenate(x) for x in zip(*found, strict=True)), n_parts)):
            yield pa.RecordBatch.from_pydict({"bucket": pa.array([r[0] for r in rows], pa.int32()), "blob": pa.array([r[1] for r in rows], pa.binary())})

    def block(blobs):
        doc, key, lo, size, text = [], [], [], [], []
        for blob in blobs:
            raw = zstandard.decompress(blob)
            m, n, item = np.frombuffer(raw, np.int64, 3)
            doc.append(np.frombuffer(raw, np.int64, m, 24))
            key.append(np.frombuffer(raw, np.int64, m, 24 + 8 * m))
            lo.append(np.frombuffer(raw, np.int64, m, 24 + 16 * m))
            size.append(np.frombuffer(raw, np.int64, m, 24 + 24 * m))
            text.append(np.frombuffer(raw, np.uint8 if item == 1 else np.uint64, n, 24 + 32 * m))
        doc, key, lo, size, text = map(np.concatenate, (doc, key, lo, size, text))
        windows = size - shape.width + 1
        late = shape.search(text, size, doc, shape.width)
        return np.repeat(doc, windows)[late], np.repeat(key, windows)[late], ragged(lo, windows)[late]

    found = open_.mapInArrow(frugal(contents), "part int, blob binary").repartition(n_parts, "part").mapInArrow(frugal(blocks), "bucket int, blob binary")
    return _gathered(found, "late")


def keyed(docs: DataFrame) -> DataFrame:
    """docs: doc_id (not null), text, rest; with key. Which doc_ids are repeated is counted on that column alone."""
    again = checkpointed(docs.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id"))
    if again.isEmpty():
        return docs.withColumn("key", F.lit(0).cast("bigint"))
    filter_ = bloom(again, "doc_id")
    hashed = docs.withColumn("key", F.xxhash64("text"))  # a row that the filter lets through wrongly keeps its hash, which does no harm

    def run(batches):
        for b in batches:
            some = in_bloom(filter_, _ids(b)) if len(b) else np.zeros(0, bool)
            yield b.set_column(b.schema.get_field_index("key"), "key", pa.array(np.where(some, _keys(b), 0)))

    return hashed.mapInArrow(frugal(run), hashed.schema)


def repeated(docs: DataFrame, shape: Shape, schema: str, finish: Callable) -> DataFrame:
    """docs: doc_id, text. finish(batch, texts, values, bounds, windows) makes a record batch of documents; windows is a boolean for each value: a repeated window starts there. The batch has doc_id, text and `rest`, a struct of the other columns."""
    rest = [c for c in docs.columns if c.lower() not in ("doc_id", "text")]
    docs = keyed(docs.select(F.coalesce(F.col("doc_id").cast("bigint"), F.lit(_NULL)).alias("doc_id"), "text", F.struct(*[F.col(f"`{c}`") for c in rest] or [F.lit(True).alias("none")]).alias("rest")))
    found = checkpointed(dictionary(docs, shape))

    def is_open(batches):
        for b in batches:
            ok = [bool((m & 1).any()) for m in _marks(b, "marks")]
            yield b.filter(pa.array(ok, pa.bool_()))

    open_ = found.mapInArrow(frugal(is_open), found.schema)
    ids = bloom(open_, "doc_id")

    def unmarked(batches):
        for b in batches:
            ok = in_bloom(any_, _ids(b)) if len(b) else np.zeros(0, bool)
            yield b.filter(pa.array(~ok))

    held = packed(docs.select("doc_id", "key", "text"), ids)
    late = checkpointed(searched(held.join(open_, ["doc_id", "key"]), shape))
    both = found.join(late, ["doc_id", "key"], "left")
    any_ = bloom(found, "doc_id")

    def run(batches):
        for b, texts, values, bounds in _stepped(batches, shape):
            windows = np.zeros(len(values) + 1, dtype=np.int32)
            if "marks" in b.schema.names:
                marks = [m[m & 1 == 0] >> 1 for m in _marks(b, "marks")]
                if any(map(len, marks)):
                    p = parse(values, bounds, shape)
                    at = _picked(marks, p, np.searchsorted(p.doc, np.arange(len(bounds) - 1)))
                    np.add.at(windows, p.lo[at], 1)
                    np.add.at(windows, p.hi[at] + 1, -1)
                windows = np.cumsum(windows)[:-1] > 0
                late_ = _marks(b, "late")
                windows[_picked(late_, None, bounds[:-1])] = True
            else:
                windows = windows[:-1] > 0
            ids = b.column("doc_id").to_numpy()
            b = b.set_column(b.schema.get_field_index("doc_id"), "doc_id", pa.array(ids, mask=ids == _NULL))
            yield finish(b, texts, values, bounds, windows)

    plain = docs.mapInArrow(frugal(lambda x: run(unmarked(x))), schema)
    marked = packed(docs, any_).join(both, ["doc_id", "key"], "left").mapInArrow(frugal(run), schema)
    return plain.unionByName(marked)


def covered(windows: np.ndarray, bounds: np.ndarray, width: int) -> np.ndarray:
    """Units that a marked window covers."""
    edge = np.zeros(len(windows) + 1, dtype=np.int32)
    at = np.flatnonzero(windows)
    np.add.at(edge, at, 1)
    np.add.at(edge, np.minimum(at + width, len(windows)), -1)
    return np.cumsum(edge)[:-1] > 0


def spans(gone: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of True within each text: text, start, end (places in the values)."""
    if not len(gone):
        none = np.zeros(0, dtype=np.int64)
        return none, none, none
    start = gone.copy()
    start[1:] &= ~gone[:-1]
    inner = bounds[:-1][(bounds[:-1] < len(gone)) & (np.diff(bounds) > 0)]
    start[inner] = gone[inner]
    end = gone.copy()
    end[:-1] &= ~gone[1:]
    lasts = bounds[1:][np.diff(bounds) > 0] - 1
    end[lasts] = gone[lasts]
    a, z = np.flatnonzero(start), np.flatnonzero(end) + 1
    return np.searchsorted(bounds, a, "right") - 1, a, z

