"""N-gram Jaccard join (operator 8): a grouped prefix join, exact.

A document's set is its distinct 5-word shingles, as 64-bit hashes. Shingles have one
global order, rare ones first; two sets that reach the threshold share one of their
first n - ceil(t * n) + 1. Documents of equal prefix and size form a group.

1. Groups meet under prefix shingles. Sizes and the shingle's places bound the overlap
   that two groups can reach; groups without a partner under a shingle leave its run.
2. Runs that overlap are joined into clusters, by the member of least hash: copies of
   one text meet under each of their shingles, and their texts are to move once.
3. Groups are expanded to their sets, whose texts move to the clusters, compressed. A
   cluster of more than CHUNK sets is dealt in chunks, each pair of chunks to a task.
4. In a cluster sets are searched breadth first: a set that is reached is compared with
   those not reached yet. Parity sketches bound the difference of two sets from below;
   pairs that survive are verified in full. The links found span each class.

Classes need connectivity, so pairs within a class that is linked already are not
verified, and a document's links are not counted. No step writes pairs: a cluster of m
sets gives at most m - 1 links.

The order's frequencies are counted over all documents in SLOTS hashed slots, a fixed
size: slots may be shared, which costs candidates and never a link.

Defined results: lower case means A-Z; fewer than five words are one shingle; without
words (null, empty) a set is empty, links with nothing and is its own class; equal
sets are linked; all rows of a repeated doc_id are one class, whatever their texts; a
row of a null doc_id links with nothing and has a null class; an empty table gives no
rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trackfold.llm.common import Rolling, Words, bloom, checkpointed, components, frugal, in_bloom, mix, parts, ragged, steps, table, texts_of

WORDS = 5
#: The threshold as a fraction: inter * DEN >= union * NUM.
NUM, DEN = 3, 4
SLOTS = 1 << 20
#: Members of a run beyond which all are taken for candidates, as filtering would try all pairs.
LONG_RUN = 4096
#: Runs of one key are one cluster up to so many members; beyond, those that overlap by half are.
SMALL = 256
#: Sets of a cluster that are compared in one task.
CHUNK = 8192
#: Entries of prefix shingles that a task holds before it sends them on.
HELD = 750_000
#: Text bytes of clusters that are compared in one step; a larger cluster makes a step of its own.
TOGETHER = 1 << 20
_ROWS = 60_000


def shingle_sets(texts: list[bytes], k: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of each text in ascending order, one text after another, and the bounds of the texts."""
    w = Words(texts, lower=True)
    words = w.hashes()
    count = np.diff(w.bounds)
    rolling = Rolling(words)
    n = np.where(count >= k, count - k + 1, (count > 0).astype(count.dtype))
    doc = np.repeat(np.arange(len(texts), dtype=np.uint16), n)
    before = np.cumsum(n) - n
    at = np.arange(int(n.sum())) + np.repeat(w.bounds[:-1] - before, n)
    h = rolling.of(at, np.minimum(at + k, w.bounds[1:][doc]))
    order = np.argsort(h)
    order = order[np.argsort(doc[order], kind="stable")]
    h, doc = h[order], doc[order]
    first = np.ones(len(h), dtype=bool)
    first[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    h, doc = h[first], doc[first]
    return h, np.searchsorted(doc, np.arange(len(texts) + 1))


def _batches(batches, k):
    """(batch slice, shingles, bounds), a few MB of text at a time."""
    for b in batches:
        texts = texts_of(b)
        for i in range(0, len(texts), _ROWS):
            for a, z in steps(len(t) for t in texts[i : i + _ROWS]):
                yield b.slice(i + a, z - a), *shingle_sets(texts[i + a : i + z], k)


def frequencies(docs: DataFrame, k: int) -> np.ndarray:
    """Class (log2 of the count) of each slot, over all documents."""
    piece = SLOTS // 64

    def count(batches):
        total = np.zeros(SLOTS, dtype=np.int64)
        for _, h, _ in _batches(batches, k):
            total += np.bincount((h % np.uint64(SLOTS)).astype(np.int64), minlength=SLOTS)
        if total.any():
            yield pa.RecordBatch.from_pydict({"piece": pa.array(range(64), pa.int32()), "counts": pa.array([zstandard.compress(total[i * piece : (i + 1) * piece].tobytes()) for i in range(64)], pa.binary())})

    def add(batches):
        got: dict[int, np.ndarray] = {}
        for b in batches:
            for i, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                y = np.frombuffer(zstandard.decompress(x), dtype=np.int64)
                got[i] = got[i] + y if i in got else y
        for i, x in got.items():
            yield pa.RecordBatch.from_pydict({"piece": pa.array([i], pa.int32()), "counts": pa.array([zstandard.compress(np.log2(x + 1).astype(np.uint8).tobytes())], pa.binary())})

    schema = "piece int, counts binary"
    rows = docs.select("text").mapInArrow(frugal(count), schema).repartition(min(64, parts(docs.sparkSession)), "piece").mapInArrow(frugal(add), schema).collect()
    out = np.zeros(SLOTS, dtype=np.uint8)
    for r in rows:
        out[r.piece * piece : (r.piece + 1) * piece] = np.frombuffer(zstandard.decompress(bytes(r.counts)), dtype=np.uint8)
    return out


def prefix_length(n: np.ndarray) -> np.ndarray:
    return np.where(n > 0, n - -(-n * NUM // DEN) + 1, 0)


def _prefixes(h, bounds, classes):
    """Of each set the first shingles in the global order: values, their sets, their places."""
    n = np.diff(bounds)
    v = (classes[(h % np.uint64(SLOTS)).astype(np.int64)].astype(np.uint64) << np.uint64(58)) | (h >> np.uint64(6))
    doc = np.repeat(np.arange(len(n), dtype=np.uint16), n)
    order = np.argsort(v)
    order = order[np.argsort(doc[order], kind="stable")]
    v = v[order]
    place = np.arange(len(v)) - np.repeat(bounds[:-1], n)
    keep = place < np.repeat(prefix_length(n), n)
    return v[keep], doc[keep].astype(np.int64), place[keep], n


def _sum_by(values, doc, n):
    out = np.zeros(n, dtype=np.uint64)
    np.add.at(out, doc, values)
    return out


def signatures(docs: DataFrame, classes, k: int) -> DataFrame:
    """A row per document: doc_id, n_shingles, set1, set2 (of equal sets equal), grp (of equal prefix and size equal)."""

    def run(batches):
        for b, h, bounds in _batches(batches, k):
            v, doc, _, n = _prefixes(h, bounds, classes.value)
            all_ = np.repeat(np.arange(len(n)), n)
            s1, s2 = _sum_by(mix(h ^ np.uint64(0x5851F42D4C957F2D)), all_, len(n)), _sum_by(mix(h + np.uint64(0x14057B7EF767814F)), all_, len(n))
            g = mix(_sum_by(mix(v ^ np.uint64(0x2545F4914F6CDD1D)), doc, len(n)) + n.astype(np.uint64))
            yield pa.RecordBatch.from_pydict({"doc_id": b.column("doc_id").cast(pa.int64()), "n_shingles": pa.array(n, pa.int64()), "set1": pa.array(s1.view(np.int64)), "set2": pa.array(s2.view(np.int64)), "grp": pa.array(g.view(np.int64))})

    return docs.select("doc_id", "text").mapInArrow(frugal(run), "doc_id long, n_shingles long, set1 long, set2 long, grp long")


_ENTRY = np.dtype([("token", ">u8"), ("grp", "<i8"), ("n", "<i4"), ("at", "<i4")])


def _pack(x: np.ndarray) -> bytes:
    """Columns after one another, then zstd; tokens ascend, so their differences are small."""
    x = x[np.argsort(x["token"])]
    groups, which = np.unique(x["grp"], return_inverse=True)
    sizes = np.zeros(len(groups), dtype=np.int32)
    sizes[which] = x["n"]
    t = x["token"].astype(np.uint64)
    t[1:] -= t[:-1].copy()
    which = which.astype(np.uint16 if len(groups) < 65536 else np.uint32)
    share = (x["at"].astype(np.int64) * 255 // np.maximum(x["n"], 1)).astype(np.uint8)
    planes = t.view(np.uint8).reshape(-1, 8).T.copy()
    head = np.array([len(x), len(groups), which.itemsize], dtype=np.int64)
    return zstandard.compress(head.tobytes() + planes.tobytes() + groups.astype(np.int64).tobytes() + sizes.tobytes() + which.tobytes() + share.tobytes(), 1)


def _unpack(blob: bytes) -> np.ndarray:
    raw = zstandard.decompress(blob)
    m, g, width = np.frombuffer(raw, np.int64, 3)
    o = 24
    t = np.cumsum(np.frombuffer(raw, np.uint8, 8 * m, o).reshape(8, -1).T.copy().view(np.uint64).ravel())
    o += 8 * m
    groups = np.frombuffer(raw, np.int64, g, o)
    o += 8 * g
    sizes = np.frombuffer(raw, np.int32, g, o)
    o += 4 * g
    which = np.frombuffer(raw, np.uint16 if width == 2 else np.uint32, m, o)
    o += width * m
    out = np.empty(m, dtype=_ENTRY)
    out["token"], out["grp"], out["n"] = t, groups[which], sizes[which]
    out["at"] = np.frombuffer(raw, np.uint8, m, o).astype(np.int64) * out["n"] // 255  # a lower bound of the place
    return out


def runs(docs: DataFrame, classes, k: int) -> DataFrame:
    """Prefix shingles that at least two groups hold, packed: rows of one column `run`."""
    n_parts = parts(docs.sparkSession)

    def emit(held):
        x = np.concatenate(held)
        x = x[np.unique(x[["token", "grp"]], return_index=True)[1]] if len(held) > 1 else x
        part = (mix(x["token"].astype(np.uint64)) % np.uint64(n_parts)).astype(np.int64)
        order = np.argsort(part, kind="stable")
        x, part = x[order], part[order]
        cuts = np.flatnonzero(np.r_[True, part[1:] != part[:-1], True])
        return pa.RecordBatch.from_pydict({"part": pa.array(part[cuts[:-1]], pa.int32()), "blob": pa.array([_pack(x[a:z]) for a, z in zip(cuts[:-1], cuts[1:], strict=True)], pa.binary())})

    def shingles(batches):
        held, size = [], 0
        for _, h, bounds in _batches(batches, k):
            v, doc, place, n = _prefixes(h, bounds, classes.value)
            g = mix(_sum_by(mix(v ^ np.uint64(0x2545F4914F6CDD1D)), doc, len(n)) + n.astype(np.uint64)).view(np.int64)
            x = np.empty(len(v), dtype=_ENTRY)
            x["token"], x["grp"], x["n"], x["at"] = v, g[doc], n[doc], place
            _, first = np.unique(g, return_index=True)  # equal groups in the step are one
            x = x[np.isin(doc, first)]
            held.append(x)
            size += len(x)
            if size > HELD:
                yield emit(held)
                held, size = [], 0
        if size:
            yield emit(held)

    def gather(batches):
        blobs = [_unpack(x) for b in batches for x in b.column("blob").to_pylist()]
        if not blobs:
            return
        x = np.concatenate(blobs)
        del blobs
        order = np.argsort(x["token"].astype(np.uint64))
        t = x["token"][order]
        same = t[1:] == t[:-1]
        shared = np.r_[False, same] | np.r_[same, False]
        x = x[order[shared]]
        if len(x):
            x = x[np.unique(x[["token", "grp"]], return_index=True)[1]]
            same = x["token"][1:] == x["token"][:-1]
            x = x[np.r_[False, same] | np.r_[same, False]]
        for a in range(0, len(x), 1 << 20):  # pieces end where a run ends
            z = a + (1 << 20)
            lo = a if a == 0 else int(np.searchsorted(x["token"], x["token"][a], "right")) if x["token"][a] == x["token"][a - 1] else a
            hi = len(x) if z >= len(x) else int(np.searchsorted(x["token"], x["token"][z], "right")) if x["token"][z] == x["token"][z - 1] else z
            if hi > lo:
                yield pa.RecordBatch.from_pydict({"run": pa.array([_pack(x[lo:hi])], pa.binary())})

    packed = docs.select("text").mapInArrow(frugal(shingles), "part int, blob binary").repartition(n_parts, "part")
    return packed.mapInArrow(frugal(gather), "run binary")


def _can(n1, at1, n2, at2):
    """Whether two sets may reach the threshold, of which this shingle is the first common one."""
    need = -(-NUM * (n1 + n2) // (NUM + DEN))
    return (np.minimum(n1 - at1, n2 - at2) >= need) & (np.minimum(n1, n2) * DEN >= np.maximum(n1, n2) * NUM)


def _partnered(x: np.ndarray) -> np.ndarray:
    """x: entries by token and size. Those that can reach the threshold with another one under their token."""
    n, at, token = x["n"].astype(np.int64), x["at"].astype(np.int64), x["token"].astype(np.uint64)
    ends = np.searchsorted(token, token, "right")
    begins = np.searchsorted(token, token, "left")
    out = ends - begins > LONG_RUN
    live = np.flatnonzero(~out)
    step = 1
    while len(live):  # by ascending size: a partner's size is at most n * DEN / NUM
        live = live[live + step < ends[live]]
        live = live[n[live + step] * NUM <= n[live] * DEN]
        ok = live[_can(n[live], at[live], n[live + step], at[live + step])]
        out[ok] = out[ok + step] = True
        step += 1
    return out


def _merged(runs_: list[np.ndarray]) -> list[np.ndarray]:
    """Runs of one key, as clusters."""
    whole = np.unique(np.concatenate(runs_))
    if len(whole) <= SMALL:
        return [whole]
    out: list[set] = []
    for r in sorted({x.tobytes(): x for x in runs_}.values(), key=len, reverse=True):
        own = set(r.tolist())
        for c in out:
            if 2 * len(own & c) >= len(own):
                c |= own
                break
        else:
            out.append(own)
    return [np.array(sorted(c), dtype=np.int64) for c in out]


def clusters(run: DataFrame) -> DataFrame:
    """run: packed runs. Rows cluster, grp: every two groups that can reach the threshold are in a cluster together."""
    n_parts = parts(run.sparkSession)

    def keyed(batches):
        for b in batches:
            for blob in b.column("run").to_pylist():
                x = _unpack(blob)
                x = x[np.lexsort((x["n"], x["token"]))]
                x = x[_partnered(x)]
                if not len(x):
                    continue
                grp = np.ascontiguousarray(x["grp"].astype(np.int64))
                x = x[np.lexsort((mix(grp.view(np.uint64)), x["token"]))]
                grp, new = x["grp"].astype(np.int64), np.r_[True, x["token"][1:] != x["token"][:-1]]
                at = np.flatnonzero(new)
                size = np.diff(np.r_[at, len(x)])
                key = grp[at]
                part = (mix(key.view(np.uint64)) % np.uint64(n_parts)).astype(np.int64)
                order = np.argsort(part, kind="stable")
                at, size, key, part = at[order], size[order], key[order], part[order]
                cuts = np.flatnonzero(np.r_[True, part[1:] != part[:-1], True])
                blobs = [zstandard.compress(np.int64(z - a).tobytes() + size[a:z].tobytes() + grp[ragged(at[a:z], size[a:z])].tobytes(), 1) for a, z in zip(cuts[:-1], cuts[1:], strict=True)]
                yield pa.RecordBatch.from_pydict({"part": pa.array(part[cuts[:-1]], pa.int32()), "blob": pa.array(blobs, pa.binary())})

    def gather(batches):
        from pyspark import TaskContext

        place, number = TaskContext.get().partitionId() << 33, 0
        held: dict[int, dict[bytes, np.ndarray]] = {}
        for b in batches:
            for blob in b.column("blob").to_pylist():
                raw = np.frombuffer(zstandard.decompress(blob), np.int64)
                size = raw[1 : 1 + raw[0]]
                members, end = raw[1 + raw[0] :], np.cumsum(size)
                for a, z in zip((end - size).tolist(), end.tolist(), strict=True):
                    m = members[a:z]
                    held.setdefault(int(m[0]), {}).setdefault(m.tobytes(), m)  # the first of a run has the least hash
        ids, groups = [], []
        for found in held.values():
            for c in _merged(list(found.values())):
                ids.append(np.full(len(c), place + number))
                groups.append(c)
                number += 1
        if ids:
            ids, groups = np.concatenate(ids), np.concatenate(groups)
            for i in range(0, len(ids), _ROWS):
                yield pa.RecordBatch.from_pydict({"cluster": pa.array(ids[i : i + _ROWS]), "grp": pa.array(groups[i : i + _ROWS])})

    return run.mapInArrow(frugal(keyed), "part int, blob binary").repartition(n_parts, "part").mapInArrow(frugal(gather), "cluster long, grp long")


class _Sets:
    """Shingle sets of some texts with parity sketches: bit b of a sketch says whether the set has an odd number of shingles that fall on b, so two sets differ in no fewer shingles than their sketches in bits."""

    def __init__(self, texts: list[bytes], k: int):
        h, self.bounds = shingle_sets_of(texts, k)
        self.n = np.diff(self.bounds)
        self.sign = _sum_by(mix(h ^ np.uint64(0x5851F42D4C957F2D)), np.repeat(np.arange(len(texts)), self.n), len(texts)).view(np.int64)
        most = int(self.n.max()) if len(self.n) else 0
        width = min(4096, max(256, 1 << (4 * most).bit_length()))
        self.sketch = np.zeros((len(texts), width // 64), dtype=np.uint64)
        per = max(1, (1 << 23) // width)
        for a in range(0, len(texts), per):
            z = min(a + per, len(texts))
            own = h[self.bounds[a] : self.bounds[z]]
            at = np.repeat(np.arange(z - a) * width, self.n[a:z]) + (own % np.uint64(width)).astype(np.int64)
            odd = np.bincount(at, minlength=(z - a) * width).astype(np.uint8) & 1
            self.sketch[a:z] = np.packbits(odd.reshape(z - a, width), axis=1).view(np.uint64)
        self.ids = np.unique(h, return_inverse=True)[1].astype(np.int64)
        self.span = int(self.ids.max()) + 1 if len(self.ids) else 1
        self.keys = np.repeat(np.arange(len(texts)), self.n) * self.span + self.ids

    def likely(self, i, j) -> np.ndarray:
        n, m = self.n[i], self.n[j]
        ok = np.minimum(n, m) * DEN >= np.maximum(n, m) * NUM
        differ = np.bitwise_count(self.sketch[i] ^ self.sketch[j]).sum(axis=-1, dtype=np.int64)
        return ok & (differ * (DEN + NUM) <= (n + m) * (DEN - NUM))

    def near(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Whether the sets of each pair reach the threshold, counted in full."""
        out = np.zeros(len(i), dtype=bool)
        size = self.n[i]
        for a, z in steps((8 * size).tolist(), 1 << 24):
            own = ragged(self.bounds[i[a:z]], size[a:z])
            want = np.repeat(j[a:z], size[a:z]) * self.span + self.ids[own]
            at = np.minimum(np.searchsorted(self.keys, want), len(self.keys) - 1)
            both = np.bincount(np.repeat(np.arange(z - a), size[a:z]), weights=self.keys[at] == want, minlength=z - a).astype(np.int64)
            out[a:z] = both * DEN >= (size[a:z] + self.n[j[a:z]] - both) * NUM
        return out


def shingle_sets_of(texts: list[bytes], k: int) -> tuple[np.ndarray, np.ndarray]:
    """shingle_sets of any number of texts."""
    found, bounds = [np.zeros(0, np.uint64)], [np.zeros(1, np.int64)]
    for i in range(0, len(texts), _ROWS):
        for a, z in steps(len(t) for t in texts[i : i + _ROWS]):
            h, at = shingle_sets(texts[i + a : i + z], k)
            bounds.append(at[1:] + bounds[-1][-1])
            found.append(h)
    return np.concatenate(found), np.concatenate(bounds)


def _spanning(sets: _Sets, members: np.ndarray) -> list[tuple[int, int]]:
    """Links that span each class among members, breadth first."""
    out = []
    left = members
    while len(left):
        reached, left = [int(left[0])], left[1:]
        while reached and len(left):
            i = reached.pop()
            may = np.flatnonzero(sets.likely(i, left))
            hit = may[sets.near(left[may], np.full(len(may), i))] if len(may) else may
            if len(hit):
                found = left[hit].tolist()
                out += [(i, j) for j in found]
                reached += found
                left = np.delete(left, hit)
    return out


def linked(asked: DataFrame, docs: DataFrame, k: int) -> DataFrame:
    """asked: cell, a (doc_id), set1 (of its set). Pairs (a, b) of sets in one cell that reach the threshold, enough of them to span the classes of the cell."""
    asked = checkpointed(asked)
    filter_ = bloom(asked, "a")

    def pack(batches):
        z = zstandard.ZstdCompressor(level=3)
        for b in batches:
            b = b.filter(pa.array(in_bloom(filter_, b.column("doc_id").to_numpy()) if len(b) else np.zeros(0, bool)))
            yield pa.RecordBatch.from_pydict({"a": b.column("doc_id"), "packed": pa.array([z.compress(t) for t in texts_of(b)], pa.binary())})

    rows = asked.join(docs.mapInArrow(frugal(pack), "a long, packed binary"), "a").repartition(parts(docs.sparkSession), "cell").sortWithinPartitions("cell")

    def compare(batches):
        z = zstandard.ZstdDecompressor()
        held: list[tuple[int, int, int, bytes]] = []
        total = 0

        def found():
            at: dict[tuple[int, bytes], int] = {}
            cells: dict[int, set[int]] = {}
            own = [(cell, at.setdefault((a, text), len(at)), want) for cell, a, want, text in held]
            sets = _Sets([text for _, text in at], k)
            ids = [a for a, _ in at]
            for cell, i, want in own:
                if sets.sign[i] == want and sets.n[i]:  # a repeated doc_id has other texts too
                    cells.setdefault(cell, set()).add(i)
            links = [p for c in cells.values() if len(c) > 1 for p in _spanning(sets, np.array(sorted(c)))]
            return pa.RecordBatch.from_pydict({"a": pa.array([ids[i] for i, _ in links], pa.int64()), "b": pa.array([ids[j] for _, j in links], pa.int64())})

        for b in batches:
            for cell, a, want, blob in zip(*(b.column(c).to_pylist() for c in ("cell", "a", "set1", "packed")), strict=True):
                if total > TOGETHER and cell != held[-1][0]:
                    yield found()
                    held, total = [], 0
                held.append((cell, a, want, z.decompress(blob)))
                total += len(held[-1][3])
        if held:
            yield found()

    return rows.select("cell", "a", "set1", "packed").mapInArrow(frugal(compare), "a long, b long")


def joined(docs: DataFrame, k: int = WORDS) -> DataFrame:
    """docs: doc_id, text. A row per document: doc_id, n_shingles, component_id."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    classes = spark.sparkContext.broadcast(frequencies(docs, k))  # SLOTS bytes
    sig = checkpointed(signatures(docs, classes, k))
    known = docs.where("doc_id is not null")
    sets = checkpointed(sig.where("n_shingles > 0 and doc_id is not null").groupBy("set1", "set2", "n_shingles", "grp").agg(F.min("doc_id").alias("rep")))
    found = clusters(runs(known, classes, k))
    # a group of several sets is a cluster too, as no shingle need be shared with another group
    several = sets.groupBy("grp").agg(F.count("*").alias("m")).where("m > 1").select((-F.shiftrightunsigned(F.xxhash64("grp"), 1) - 1).alias("cluster"), "grp")
    asked = checkpointed(found.union(several).join(sets.select("grp", F.col("rep").alias("a"), "set1"), "grp").select("cluster", "a", "set1"))
    large = asked.groupBy("cluster").agg(F.ceil(F.count("*") / CHUNK).cast("int").alias("chunks")).where("chunks > 1")
    asked = asked.join(large, "cluster", "left").withColumn("mine", F.pmod(F.xxhash64("a", "set1"), F.coalesce("chunks", F.lit(1))))
    asked = asked.withColumn("other", F.explode(F.sequence(F.lit(0), F.coalesce("chunks", F.lit(1)) - 1)))
    asked = asked.select(F.when(F.col("chunks").isNull(), F.col("cluster")).otherwise(F.xxhash64("cluster", F.least("mine", "other"), F.greatest("mine", "other"))).alias("cell"), "a", "set1")
    links = checkpointed(linked(asked, known, k))
    # rows of one doc_id: it is linked with the representative of each of its sets
    again = sig.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("m")).where("m > 1").select("doc_id")
    again = checkpointed(sig.join(again, "doc_id").join(sets, ["set1", "set2", "n_shingles"]).select(F.col("rep").alias("a"), F.col("doc_id").alias("b")).distinct())
    comp = components(links.union(again))
    classes.unpersist()
    named = sets.join(comp.withColumnRenamed("id", "rep"), "rep", "left").select("set1", "set2", F.col("n_shingles").alias("_n"), F.coalesce("component", "rep").alias("component_id"))
    # a class is named by the smallest member, which is a representative or has a repeated doc_id
    same = sig.join(named, (sig.set1 == named.set1) & (sig.set2 == named.set2) & (sig.n_shingles == named._n), "left").select("doc_id", sig.n_shingles, "component_id")
    class_of = again.select("b").distinct().join(comp, F.col("b") == F.col("id")).select(F.col("b").alias("doc_id"), F.col("component").alias("_c"))
    same = same.join(class_of, "doc_id", "left")
    return same.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("_c", "component_id", "doc_id")).alias("component_id"))


def op8_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joined(table(spark, sf_dir, "documents"))


OP8_SQL = r"""
with recursive w as (
  select doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') as w from documents),
s as (
  select doc_id, case when len(w) = 0 then [] when len(w) < 5 then [array_to_string(w, ' ')]
    else list_distinct([array_to_string(w[i:i+4], ' ') for i in range(1, len(w) - 3)]) end as s from w),
e as (select doc_id, len(s) as n, unnest(s) as g from s),
p as (select a.doc_id as a, b.doc_id as b, count(*) as c, any_value(a.n) as na, any_value(b.n) as nb
  from e a join e b on a.g = b.g and a.doc_id <> b.doc_id group by all),
l as (select a, b from p where 100 * c >= 75 * (na + nb - c)),
r as (select a as id, a as x from l union select r.id, l.b from r join l on r.x = l.a),
c as (select id, min(x) as m from r group by id)
select s.doc_id, len(s.s)::bigint as n_shingles, least(s.doc_id, coalesce(c.m, s.doc_id)) as component_id
from s left join c on c.id = s.doc_id
"""
