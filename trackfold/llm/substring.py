"""Substring dedup (operator 6): repeated passages of words.

Relative Lempel-Ziv parsing over words. The reference is the corpus itself, in blocks: a
block holds all different phrases (runs of windows of one trigger, see `repeats`) of
its triggers, with an index of their windows, and as equal windows have equal triggers,
no other block can hold a factor of a phrase. A phrase that an earlier document holds
as a whole is one factor, found by its hash before anything is moved. Every other phrase
whose trigger occurs again goes to its block and is factored greedily: at a cursor the
index names the least document with the window that starts there, and the factor grows
word by word as long as both agree. Factors of a window or more become duplicate spans.
At a factor's boundary the windows that lie across it are looked up by themselves, so
that a passage goes on in another document; a window without a source is a literal, and
the cursor moves by one word. Words within removed spans go, the words between are kept.

Defined results: a null text has no words; a text shorter than a window keeps all its
words; of rows with one doc_id, whatever their texts, none removes from the other, as no id is smaller; a
null doc_id counts as the smallest; an empty table gives no rows; other columns are
ignored. Words are compared by 64-bit hashes; the index holds 64 bits of a window, and a
factor counts only as far as its words agree.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trackfold.llm.common import Rolling, Words, ragged, table
from trackfold.llm.repeats import Shape, covered, repeated, spans

WIDTH, GRAM = 13, 5


def word_units(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    w = Words(texts)
    return w.hashes(), w.bounds.astype(np.int64)


def agreed(values: np.ndarray, own: np.ndarray, source: np.ndarray, reach: np.ndarray) -> np.ndarray:
    """How many units from each place in own agree with those from its place in source, reach at the most."""
    out = reach.copy()
    live, n = np.flatnonzero(reach > 0), 0
    while len(live):
        same = values[own[live] + n] == values[source[live] + n]
        out[live[~same]] = n
        n += 1
        live = live[same & (reach[live] > n)]
    return out


def by_factors(values: np.ndarray, size: np.ndarray, doc: np.ndarray, width: int) -> np.ndarray:
    """The block's phrases (sizes, documents) factored against its index: for each window, whether a factor holds it. All phrases move their cursors at once."""
    windows = size - width + 1
    begin = np.cumsum(size) - size
    end = begin + size
    at = ragged(begin, windows)
    phrase = np.repeat(np.arange(len(size)), windows)
    # the index: of each window, that of the least document
    h = Rolling(values).every(width)[at]
    order = np.lexsort((doc[phrase], h))
    new = np.r_[True, h[order][1:] != h[order][:-1]]
    source = np.empty(len(at), dtype=np.int64)
    source[order] = order[np.flatnonzero(new)[np.cumsum(new) - 1]]
    held = np.zeros(len(at), dtype=bool)
    last = np.cumsum(windows)
    cursor = last - windows
    live = np.flatnonzero(windows > 0)
    while len(live):
        here = cursor[live]
        from_ = source[here]
        length = np.zeros(len(live), dtype=np.int64)
        hit = np.flatnonzero(doc[phrase[from_]] < doc[live])
        own, ref = at[here[hit]], at[from_[hit]]
        length[hit] = agreed(values, own, ref, np.minimum(end[live[hit]] - own, end[phrase[from_[hit]]] - ref))
        # a factor's windows, then the first across its end; after a literal the next word
        inner = np.maximum(length - width + 1, 0)
        held[ragged(here, inner)] = True
        cursor[live] = here + np.maximum(inner, 1)
        live = live[cursor[live] < last[live]]
    return held


def factored(docs: DataFrame, width: int = WIDTH, gram: int = GRAM, whole: bool = False) -> DataFrame:
    """doc_id, kept (text), n_words, n_removed, starts and ends (in words) of the factors that are removed, and with `whole` also rest, a struct of the other columns. Kept are words joined by one space; with `whole` a text of which nothing is removed stays as it is."""
    docs = docs if whole else docs.select("doc_id", "text")

    def finish(batch, texts, values, bounds, windows):
        w = Words(texts)
        gone = covered(windows, bounds, width)
        doc, a, z = spans(gone, bounds)
        at = np.searchsorted(doc, np.arange(len(texts) + 1))
        keep = np.flatnonzero(~gone)
        first = np.searchsorted(keep, bounds)
        # each kept word and the byte after it, that byte made a space
        size = w.ends[keep] - w.starts[keep] + 1
        out = w.buf[ragged(w.starts[keep], size)]
        end = np.cumsum(size)
        out[end - 1] = 0x20
        raw = out.tobytes()
        end = np.concatenate([[0], end])
        kept = [raw[end[p] : end[q] - 1].decode() if q > p else "" for p, q in zip(first[:-1], first[1:], strict=True)]
        n = np.diff(bounds)
        if whole:
            same = n == np.diff(first)
            kept = [t.decode() if s else k for t, s, k in zip(texts, same.tolist(), kept, strict=True)]
        lists = lambda x: pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(x - bounds[doc], pa.int64()))
        out = {"doc_id": batch.column("doc_id"), "kept": pa.array(kept, pa.string()), "n_words": pa.array(n, pa.int64()), "n_removed": pa.array(n - np.diff(first), pa.int64()), "starts": lists(a), "ends": lists(z)}
        return pa.RecordBatch.from_pydict(out | ({"rest": batch.column("rest")} if whole else {}))

    schema = T.StructType.fromDDL("doc_id long, kept string, n_words long, n_removed long, starts array<long>, ends array<long>")
    if whole:
        schema = schema.add("rest", T.StructType([f for f in docs.schema if f.name.lower() not in ("doc_id", "text")]))
    return repeated(docs, Shape(word_units, width, gram, by_factors), schema, finish)


def op6_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = factored(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


OP6_SQL = r"""
with d as (select doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') as w from documents),
w as (select doc_id, i, array_to_string(w[i:i+12], ' ') as g from (select doc_id, w, unnest(range(1, (len(w) - 11)::bigint)) as i from d where len(w) >= 13)),
m as (select g, min(doc_id) as f from w group by g having count(*) > 1),
r as (select w.doc_id, w.i from w join m on w.g = m.g where w.doc_id > m.f),
c as (select distinct doc_id, i + k as p from r, (select unnest(range(0, 13)) as k)),
b as (select doc_id, p, w[p] as h from (select doc_id, w, unnest(range(1, (len(w) + 1)::bigint)) as p from d)),
k as (select b.doc_id, string_agg(h, ' ' order by p) as h from b anti join c on b.doc_id = c.doc_id and b.p = c.p group by b.doc_id),
s as (select doc_id, count(*) as n from c group by doc_id)
select d.doc_id, len(w)::bigint as n_words, coalesce(s.n, 0)::bigint as n_removed, sha256(coalesce(k.h, '')) as kept_sha256
from d left join s on s.doc_id = d.doc_id left join k on k.doc_id = d.doc_id
"""
