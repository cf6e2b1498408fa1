"""Byte-level BPE encoding and decoding (operator 1).

Encoding folds ranked merges over the bytes of distinct words with higher-order
functions; pair ranks come from a literal table. A task cuts its texts into words,
numbers the distinct ones and keeps each text as numbers; the distinct words of all
tasks meet by hash, are folded once, and the ids go back to the tasks' texts. Only
word lists, ids and numbers move. Decoding concatenates the ids' byte pieces.

The rank table: each id has a base. A pair (a, b) of ids that merges has its entry at
place base[a] + b: a, the rank (which is the new id) and the new id's base, so that a
wrong place is noticed and the next look-up needs no second table.
The table enters the plan as a scalar subquery over one row, which is a constant of each
task: as a literal its half a million numbers would be printed into each description of
the plan that Spark keeps.

A fold's steps grow with the square of a word, so words over PIECE bytes are folded in
pieces that overlap, and put together where two pieces have a token in common. That is
exact: a sequence of tokens is a word's encoding if each two neighbours encode to
themselves, and each two are neighbours in some piece. Words whose pieces have no token
in common, which takes a token that repeats at a period no stride fits, are merged whole.

Defined results: a null text is empty and has no ids; special tokens are ordinary
text; rows of a repeated doc_id are separate documents; an empty table gives no rows;
other columns are ignored. The word pattern's classes are those of Java's Unicode tables.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import heapq
import random

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trackfold.llm.common import dealt, frugal, parts, ragged, table, trimmed

#: Words a task holds before it sends a block on.
BLOCK_WORDS = 6_000_000
#: Words whose numbers move in one row, beyond which a batch of texts makes the next.
STREAM_WORDS = 500_000
#: Words that are put together at a time.
TOGETHER = 100_000
#: Words in one row of the fold.
FOLD_ROWS = 4096
#: Bytes of a long word's pieces, and between their starts.
PIECE, STRIDE = 288, 192
# a table's entry: the first id, the rank (17 bits each) and the base of the new id (19 bits); a code is the last two
_ID, _BASE = 17, 19
_CODE = 1 << (_ID + _BASE)
_SIZE = 1 << _BASE
_EMPTY = (1 << (2 * _ID + _BASE)) - 1
_FAR = 1 << 54


@functools.cache
def vocabulary(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


@functools.cache
def rank_table(path: str) -> tuple[np.ndarray, np.ndarray]:
    """The code of each id (and of one past the last, which merges with nothing), and the table."""
    ranks = vocabulary(path)
    last = max(ranks.values()) + 1
    rows: dict[int, list[tuple[int, int]]] = {}
    for token, rank in ranks.items():
        for k in range(1, len(token)):
            a, b = ranks.get(token[:k]), ranks.get(token[k:])
            if a is not None and b is not None:
                rows.setdefault(a, []).append((b, rank))
    if last >= (1 << _ID) - 1 or 2.2 * sum(map(len, rows.values())) + last > _SIZE:
        raise ValueError("the vocabulary needs a larger table")
    taken = np.zeros(_SIZE, dtype=bool)
    base = np.zeros(last + 1, dtype=np.int64)
    draw = random.Random(1)
    for a in sorted(rows, key=lambda x: (-len(rows[x]), x)):
        b = np.array([x for x, _ in rows[a]])
        while True:
            at = draw.randrange(_SIZE - last)
            if not taken[at + b].any():
                break
        taken[at + b] = True
        base[a] = at
    codes = (np.arange(last + 1) << _BASE) | base
    out = np.full(_SIZE, _EMPTY, dtype=np.int64)
    for a, row in rows.items():
        b, r = np.array(row).T
        out[base[a] + b] = (a << (_ID + _BASE)) | codes[r]
    return codes, out


@functools.cache
def odd_tokens(path: str) -> dict[str, int]:
    """Words that are a token but that merging by ranks would not put together. A vocabulary with such tokens is refused."""
    ranks = vocabulary(path)
    odd = {}
    for token, rank in ranks.items():
        parts_ = [bytes([x]) for x in token]
        while len(parts_) > 1:
            best = min(range(len(parts_) - 1), key=lambda i: ranks.get(parts_[i] + parts_[i + 1], _FAR))
            if parts_[best] + parts_[best + 1] not in ranks:
                break
            parts_[best : best + 2] = [parts_[best] + parts_[best + 1]]
        if len(parts_) > 1:
            try:
                odd[token.decode()] = rank
            except UnicodeDecodeError:
                pass
    return odd


def merged(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """ids of a word by a heap of pairs."""
    n = len(word)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    end = list(range(1, n + 1))
    rank = lambda i: ranks.get(word[i : end[after[i]]]) if after[i] < n else None
    heap = [(r, i, end[after[i]]) for i in range(n) if (r := rank(i)) is not None]
    heapq.heapify(heap)
    gone = [False] * n
    while heap:
        r, i, z = heapq.heappop(heap)
        if gone[i] or after[i] >= n or end[after[i]] != z or rank(i) != r:
            continue
        j = after[i]
        gone[j], end[i], after[i] = True, end[j], after[j]
        if after[i] < n:
            before[after[i]] = i
        for k in (before[i], i):
            if k >= 0 and (r := rank(k)) is not None:
                heapq.heappush(heap, (r, k, end[after[k]]))
    return [ranks[word[i : end[i]]] for i in range(n) if not gone[i]]


def joined(pieces_: list[np.ndarray], lengths: np.ndarray) -> np.ndarray | None:
    """ids of a word from those of its pieces, which start STRIDE apart; lengths: bytes of each id. None if two pieces have no token in common."""
    ids = pieces_[0]
    place = np.concatenate([[0], np.cumsum(lengths[ids])])
    out, done = [], 0  # ids before done are settled
    for k, more in enumerate(pieces_[1:], 1):
        at = k * STRIDE + np.concatenate([[0], np.cumsum(lengths[more])])
        both = np.intersect1d((place[done:-1] << 10) + np.diff(place[done:]), (at[:-1] << 10) + np.diff(at))
        if not len(both):
            return None
        end = (both[0] >> 10) + (both[0] & 1023)
        out.append(ids[done : int(np.searchsorted(place, end))])
        done = int(np.searchsorted(at, end))
        ids, place = more, at
    out.append(ids[done:])
    return np.concatenate(out)


def _let(value: Column, body) -> Column:
    return F.get(F.transform(F.array(value), body), F.lit(0))


def encoded(word: Column, places: Column) -> Column:
    """ids of a word: an array<int> column. word: the codes of its bytes, between two of the id that merges with nothing; places: the rank table."""

    def rank(a: Column, b: Column) -> Column:
        """The code of the pair's id; _CODE or more: the pair does not merge."""
        at = a.bitwiseAND(F.lit(_SIZE - 1)) + F.shiftright(b, _BASE)
        return F.pmod(F.get(places, at.cast("int")) - F.shiftleft(F.shiftright(a, _BASE), _ID + _BASE), F.lit(_FAR))

    def step(s: Column, _: Column) -> Column:
        def merge(new: Column) -> Column:
            def at(p: Column) -> Column:
                ids = F.concat(F.slice(s.ids, F.lit(1), p - 1), F.array(new), F.slice(s.ids, p + 2, F.lit(1 << 30)))
                ranks = F.concat(F.slice(s.ranks, F.lit(1), p - 2), F.array(rank(F.get(s.ids, p - 2), new), rank(new, F.get(s.ids, p + 1))), F.slice(s.ranks, p + 2, F.lit(1 << 30)))
                return F.struct(ids.alias("ids"), ranks.alias("ranks"))

            return F.when(new >= _CODE, s).otherwise(_let(F.array_position(s.ranks, new).cast("int"), at))

        return _let(F.array_min(s.ranks), merge)

    ranks = F.transform(F.sequence(F.lit(0), F.size(word) - 2), lambda i: rank(F.get(word, i), F.get(word, i + 1)))
    start = F.struct(word.alias("ids"), ranks.alias("ranks"))
    return F.aggregate(F.slice(word, F.lit(3), F.size(word) - 3), start, step, lambda s: F.transform(F.slice(s.ids, F.lit(2), F.size(s.ids) - 2), lambda c: F.shiftright(c, _BASE).cast("int")))


def _zip(*arrays: np.ndarray) -> bytes:
    """Arrays of unsigned or signed numbers, each as byte planes."""
    head = np.array([len(arrays), *[v for x in arrays for v in (len(x), x.itemsize)]], dtype=np.int64)
    return zstandard.compress(head.tobytes() + b"".join(x.view(np.uint8).reshape(len(x), x.itemsize).T.tobytes() if len(x) else b"" for x in arrays), 3)


def _unzip(blob: bytes) -> list[np.ndarray]:
    raw = zstandard.decompress(blob)
    n = int(np.frombuffer(raw, np.int64, 1)[0])
    shape = np.frombuffer(raw, np.int64, 2 * n, 8).reshape(n, 2)
    o, out = 8 + 16 * n, []
    for size, item in shape.tolist():
        x = np.frombuffer(raw, np.uint8, size * item, o).reshape(item, size).T
        out.append(np.ascontiguousarray(x).view(f"<i{item}" if item > 1 else np.uint8).reshape(size))
        o += size * item
    return out


def tokenized(docs: DataFrame, path: str, pattern: str, schema: str, finish, block_words: int = BLOCK_WORDS) -> DataFrame:
    """docs: doc_id, text. block_words: what a task holds before it sends a block on; less takes less memory and more shuffle. finish(doc_ids, bounds, ids, word_bounds) makes a record batch of documents: bounds in words, word_bounds in ids."""
    spark = docs.sparkSession
    n_parts = parts(spark)
    deal = dealt(n_parts)
    cut = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit("(?U)" + pattern), F.lit(0)).alias("words"))

    def block(batches):
        """Rows: kind 0, some of a block's texts as numbers; kind 1, words that a block asks a part for."""
        from pyspark import TaskContext

        place, number = TaskContext.get().partitionId(), 0
        texts, held = [], 0  # of each batch doc_ids, which are null, words of each text, words

        def rows(out):
            kinds = [pa.int32(), pa.int64(), pa.int32(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=["kind", "block", "part", "blob"])

        def send():
            """Rows of the block. Texts are numbered and leave the memory some at a time."""
            key = (place << 32) | number
            enc = pa.chunked_array([w.dictionary.cast(pa.large_string()) for *_, w in texts]).combine_chunks()
            enc = enc.dictionary_encode()
            enc = enc.combine_chunks() if isinstance(enc, pa.ChunkedArray) else enc
            names, ends = enc.dictionary, np.cumsum([len(w.dictionary) for *_, w in texts])
            number_of = np.split(enc.indices.to_numpy(), ends[:-1])  # of each batch's words, which are distinct
            del enc
            freq = np.zeros(len(names), dtype=np.int64)
            for (*_, w), own in zip(texts, number_of, strict=True):
                freq[own] += np.bincount(w.indices.to_numpy(), minlength=len(own))
            order = np.argsort(-freq, kind="stable")
            place_of = np.empty(len(order), dtype=np.int32)
            place_of[order] = np.arange(len(order), dtype=np.int32)
            names = names.take(pa.array(order))
            some, n = [], 0
            for own in number_of:
                ids, null, counts, w = texts.pop(0)
                some.append((ids, null.astype(np.uint8), counts.astype(np.int32), place_of[own][w.indices.to_numpy()]))
                n += len(w)
                if n > STREAM_WORDS or not texts:
                    yield rows([(0, key, deal[key % n_parts], _zip(*(np.concatenate(x) for x in zip(*some, strict=True))))])
                    some, n = [], 0
            if not len(names):
                return
            part = np.empty(len(names), dtype=np.int64)
            for i in range(0, len(names), FOLD_ROWS):
                part[i : i + FOLD_ROWS] = [hash_of(w) % n_parts for w in names.slice(i, FOLD_ROWS).to_pylist()]
            by = np.argsort(part, kind="stable")
            cuts = np.flatnonzero(np.r_[True, part[by][1:] != part[by][:-1], True])
            out = []
            for a, z in zip(cuts[:-1], cuts[1:], strict=True):
                at = by[a:z]
                text = names.take(pa.array(at)).cast(pa.large_binary())
                size = pc.binary_length(text).to_numpy()
                out.append((1, key, deal[int(part[at[0]])], _zip(np.diff(at, prepend=0).astype(np.int32), size.astype(np.int32), np.frombuffer(b"".join(text.to_pylist()), np.uint8))))
            yield rows(out)

        import xxhash

        hash_of = lambda w: xxhash.xxh3_64_intdigest(w)
        for b in batches:
            lists = b.column("words")
            n = np.diff(lists.offsets.to_numpy())
            flat = lists.flatten()
            texts.append((b.column("doc_id").fill_null(0).to_numpy(), b.column("doc_id").is_null().to_numpy(zero_copy_only=False), n, flat.dictionary_encode()))
            held += len(flat)
            del b, lists, flat
            if held > block_words:
                yield from send()
                held, number = 0, number + 1
                trimmed()
        if texts:
            yield from send()

    sent = cut.mapInArrow(frugal(block), "kind int, block long, part int, blob binary").repartition(n_parts, "part")

    codes = rank_table(path)[0]
    of_byte = codes[[vocabulary(path)[bytes([i])] for i in range(256)]]
    none = codes[-1]
    odd = odd_tokens(path)
    if odd:
        raise ValueError(f"{len(odd)} tokens of {path} do not merge by ranks")

    def meet(batches):
        """Rows: distinct words, and which of them each block asked for. Texts as numbers pass on."""
        held = []
        names_of = ["kind", "block", "words", "asked"]
        for b in batches:
            ask = pc.equal(b.column("kind"), 1)
            if (on := b.filter(pc.invert(ask))).num_rows:
                yield pa.RecordBatch.from_arrays([on.column("kind"), on.column("block"), pa.array([[]] * len(on), pa.list_(pa.list_(pa.int64()))), on.column("blob")], names=names_of)
            b = b.filter(ask)
            for key, blob in zip(b.column("block").to_pylist(), b.column("blob").to_pylist(), strict=True):
                step, size, raw = _unzip(blob)
                text = pa.Array.from_buffers(pa.large_string(), len(size), [None, pa.py_buffer(np.concatenate([[0], np.cumsum(size)]).astype(np.int64)), pa.py_buffer(raw)])
                held.append((key, np.cumsum(step, dtype=np.int32), text))
        if not held:
            return
        enc = pa.chunked_array([t for _, _, t in held]).combine_chunks().dictionary_encode()
        enc = enc.combine_chunks() if isinstance(enc, pa.ChunkedArray) else enc
        names, index = enc.dictionary, enc.indices.to_numpy().astype(np.int64)
        key = np.repeat(np.array([k for k, _, _ in held], dtype=np.int64), [len(x) for _, x, _ in held])
        local = np.concatenate([x for _, x, _ in held])
        order = np.lexsort((local, key, index // FOLD_ROWS))
        key, local, index = key[order], local[order], index[order]
        cuts = np.searchsorted(index // FOLD_ROWS, np.arange(-(-len(names) // FOLD_ROWS) + 1))
        for i, (a, z) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
            w = names.slice(i * FOLD_ROWS, FOLD_ROWS).cast(pa.large_binary())
            size = pc.binary_length(w).to_numpy().astype(np.int64)
            # a long word is several pieces
            n = 1 + -(-np.maximum(size - PIECE, 0) // STRIDE)
            owner = np.repeat(np.arange(len(w)), n)
            from_ = (np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)) * STRIDE
            length = np.minimum(size[owner] - from_, PIECE)
            text = np.frombuffer(b"".join(w.to_pylist()), np.uint8)
            ids = np.full(int(length.sum()) + 2 * len(owner), none)
            at = np.cumsum(length + 2) - length - 2
            ids[ragged(at + 1, length)] = of_byte[text[ragged((np.cumsum(size) - size)[owner] + from_, length)]]
            lists = pa.ListArray.from_arrays(pa.array(np.append(at, len(ids)), pa.int32()), pa.array(ids))
            long_ = text[np.repeat(size > PIECE, size)]
            yield pa.RecordBatch.from_arrays([pa.array([1], pa.int32()), pa.array([0], pa.int64()), pa.ListArray.from_arrays(pa.array([0, len(lists)], pa.int32()), lists), pa.array([_zip(key[a:z], local[a:z], (index[a:z] % FOLD_ROWS).astype(np.int16), size.astype(np.int32), long_)], pa.binary())], names=names_of)

    asked = sent.mapInArrow(frugal(meet), "kind int, block long, words array<array<bigint>>, asked binary")
    constant = spark.createDataFrame(pa.table({"t": pa.array([rank_table(path)[1]], pa.list_(pa.int64()))})).scalar()
    asked = asked.withColumn("t", F.when(F.col("kind") == 1, constant))
    folded = asked.select("kind", "block", F.transform("words", lambda w: encoded(w, F.col("t"))).alias("ids"), "asked")

    sizes = np.diff(pieces(path)[1])

    def whole(o, ids, bytes_, text):
        """Words for their pieces."""
        n = 1 + -(-np.maximum(bytes_.astype(np.int64) - PIECE, 0) // STRIDE)
        last = np.cumsum(n)
        found, at = [], 0
        for a, z, k in zip(o[last - n].tolist(), o[last].tolist(), range(len(n)), strict=True):
            if n[k] == 1:
                found.append(ids[a:z])
                continue
            cuts = o[last[k] - n[k] : last[k] + 1]
            one = joined([ids[p:q] for p, q in zip(cuts[:-1], cuts[1:], strict=True)], sizes)
            found.append(np.array(merged(text[at : at + bytes_[k]].tobytes(), vocabulary(path)), dtype=np.int32) if one is None else one)
            at += int(bytes_[k])
        return np.concatenate([[0], np.cumsum([len(x) for x in found])]), np.concatenate(found)

    def answer(batches):
        for b in batches:
            done = pc.equal(b.column("kind"), 0)
            if (on := b.filter(done)).num_rows:
                yield pa.RecordBatch.from_arrays([on.column("kind"), on.column("block"), on.column("asked")], names=["kind", "block", "blob"])
            b = b.filter(pc.invert(done))
            for i in range(len(b)):
                key, local, at, bytes_, text = _unzip(b.column("asked")[i].as_py())
                lists = b.column("ids")[i].values
                o = lists.offsets.to_numpy().astype(np.int64)
                ids = lists.values.to_numpy(zero_copy_only=False)
                if len(text):
                    o, ids = whole(o, ids, bytes_, text)
                size = np.diff(o)
                cuts = np.flatnonzero(np.r_[True, key[1:] != key[:-1], True])
                out = []
                for a, z in zip(cuts[:-1], cuts[1:], strict=True):
                    q = at[a:z]
                    out.append((2, int(key[a]), _zip(np.diff(local[a:z], prepend=0).astype(np.int32), size[q].astype(np.int32), ids[ragged(o[q], size[q])].astype(np.int32))))
                kinds = [pa.int32(), pa.int64(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=["kind", "block", "blob"])

    answers = folded.mapInArrow(frugal(answer), "kind int, block long, blob binary")
    # a block's answers come before its texts, which can go one row after another
    both = answers.repartition(n_parts, F.get(F.lit(deal), F.pmod("block", F.lit(n_parts)).cast("int"))).sortWithinPartitions("block", F.desc("kind"))

    def assemble(batches):
        got, known, now = [], None, None

        def gathered():
            if not got:
                return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)
            local, size, flat = (np.concatenate(x) for x in zip(*got, strict=True))
            begin, length = np.zeros(len(local), dtype=np.int64), np.zeros(len(local), dtype=np.int64)
            begin[local] = np.cumsum(size, dtype=np.int64) - size
            length[local] = size
            return begin, length, flat

        def finished(ids, null, counts, index):
            begin, length, flat = known
            ids = pa.array(ids, pa.int64(), mask=null > 0)
            bounds = np.concatenate([[0], np.cumsum(counts, dtype=np.int64)])
            a = 0
            while a < len(ids):  # some words at a time
                z = max(a + 1, int(np.searchsorted(bounds, bounds[a] + TOGETHER, "right")) - 1)
                w = index[bounds[a] : bounds[z]]
                n = length[w]
                yield finish(ids[a:z], bounds[a : z + 1] - bounds[a], flat[ragged(begin[w], n)], np.concatenate([[0], np.cumsum(n)]))
                a = z

        for b in batches:
            for i in range(len(b)):
                kind, key, blob = (b.column(c)[i] for c in ("kind", "block", "blob"))
                if key.as_py() != now:
                    got, known, now = [], None, key.as_py()
                if kind.as_py() == 2:
                    step, size, flat = _unzip(blob.as_buffer())
                    got.append((np.cumsum(step, dtype=np.int32), size, flat))
                    continue
                if known is None:
                    known, got = gathered(), []
                yield from finished(*_unzip(blob.as_buffer()))

    return both.mapInArrow(frugal(assemble), schema)


def pieces(path: str) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all tokens one after another, and where each id's begin (one more than ids)."""
    ranks = vocabulary(path)
    by_id = [b""] * (max(ranks.values()) + 1)
    for token, rank in ranks.items():
        by_id[rank] = token
    return np.frombuffer(b"".join(by_id), dtype=np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in by_id])]).astype(np.int64)


def decoded(ids: np.ndarray, piece: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of ids, and the bounds of each id's bytes."""
    text, at = piece
    size = at[ids + 1] - at[ids]
    return text[ragged(at[ids], size)], np.concatenate([[0], np.cumsum(size)])


def encode(docs: DataFrame, path: str, pattern: str, block_words: int = BLOCK_WORDS) -> DataFrame:
    """A row per document: doc_id, ids."""

    def finish(doc_ids, bounds, ids, word_bounds):
        return pa.RecordBatch.from_arrays([doc_ids, pa.ListArray.from_arrays(pa.array(word_bounds[bounds], pa.int32()), pa.array(ids, pa.int32()))], names=["doc_id", "ids"])

    return tokenized(docs, path, pattern, "doc_id long, ids array<int>", finish, block_words)


def decode(rows: DataFrame, path: str) -> DataFrame:
    """rows: doc_id, ids. doc_id, bytes (binary: a piece may end within a character)."""
    piece = pieces(path)

    def run(batches):
        for b in batches:
            lists = b.column("ids")
            o = lists.offsets.to_numpy()
            text, at = decoded(lists.flatten().to_numpy(zero_copy_only=False), piece)
            raw, bounds = text.tobytes(), at[o - o[0]]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([raw[p:q] for p, q in zip(bounds[:-1], bounds[1:], strict=True)], pa.binary())], names=["doc_id", "bytes"])

    return rows.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("ids", F.array().cast("array<int>")).alias("ids")).mapInArrow(frugal(run), "doc_id long, bytes binary")


def digests(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """A row per document: doc_id, n_tokens, ids_sha256, decoded_sha256. Ids are hashed and decoded where they are put together."""
    piece = pieces(path)

    def finish(doc_ids, bounds, ids, word_bounds):
        raw = ids.astype("<u4").tobytes()
        text, at = decoded(ids, piece)
        text = text.tobytes()
        o = word_bounds[bounds]
        one = [hashlib.sha256(raw[4 * p : 4 * q]).hexdigest() for p, q in zip(o[:-1], o[1:], strict=True)]
        two = [hashlib.sha256(text[at[p] : at[q]]).hexdigest() for p, q in zip(o[:-1], o[1:], strict=True)]
        return pa.RecordBatch.from_arrays([doc_ids, pa.array(np.diff(o), pa.int64()), pa.array(one, pa.string()), pa.array(two, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return tokenized(docs, path, pattern, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string", finish)


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
