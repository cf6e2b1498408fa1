"""Suffix-array dedup (operator 4) by prefix-free parsing.

Texts are parsed as UTF-8 bytes: a rolling hash sets triggers, triggers cut phrases, a
dictionary holds distinct phrases, the parse says which document has which, and the
suffix order of dictionary phrases, to the depth of a window, puts equal windows side
by side (`repeats` has the steps). The trigger is the least gram of a window instead
of a fixed residue, so that no window is without one and every repeat is found.

Defined results: a null text is empty; a text shorter than a window keeps all its
bytes; of rows with one doc_id, whatever their texts, none removes from the other, as no id is smaller; a
null doc_id counts as the smallest; an empty table gives no rows; other columns are
ignored. Cut bytes can end within a UTF-8 sequence; the kept bytes are exact.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trackfold.llm.common import table
from trackfold.llm.repeats import Shape, by_order, covered, repeated, spans

WIDTH, GRAM = 50, 24


def byte_units(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(b"".join(texts), dtype=np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)


def deduped(docs: DataFrame, width: int = WIDTH, gram: int = GRAM) -> DataFrame:
    """doc_id, kept (binary), n_bytes, n_removed, starts and ends of the removed runs."""

    def finish(batch, texts, values, bounds, windows):
        gone = covered(windows, bounds, width)
        doc, a, z = spans(gone, bounds)
        at = np.searchsorted(doc, np.arange(len(texts) + 1))
        kept = []
        for i, t in enumerate(texts):
            p, q = at[i], at[i + 1]
            kept.append(t if p == q else values[bounds[i] : bounds[i + 1]][~gone[bounds[i] : bounds[i + 1]]].tobytes())
        n = np.diff(bounds)
        removed = n - np.array([len(k) for k in kept])
        lists = lambda x: pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(x - bounds[doc], pa.int64()))
        return pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "kept": pa.array(kept, pa.binary()), "n_bytes": pa.array(n, pa.int64()), "n_removed": pa.array(removed, pa.int64()), "starts": lists(a), "ends": lists(z)})

    return repeated(docs.select("doc_id", "text"), Shape(byte_units, width, gram, by_order), "doc_id long, kept binary, n_bytes long, n_removed long, starts array<long>, ends array<long>", finish)


def op4_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = deduped(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", F.size("starts").cast("bigint").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


OP4_SQL = r"""
with d as (select doc_id, hex(encode(coalesce(text, ''))) as x from documents),
w as (select doc_id, i, substr(x, 2 * i - 1, 100) as g from (select doc_id, x, unnest(range(1, (length(x) // 2 - 48)::bigint)) as i from d where length(x) >= 100)),
m as (select g, min(doc_id) as f from w group by g having count(*) > 1),
r as (select w.doc_id, w.i from w join m on w.g = m.g where w.doc_id > m.f),
c as (select distinct doc_id, i + k as p from r, (select unnest(range(0, 50)) as k)),
s as (select doc_id, count(*) as n_removed, count(*) filter (where p - 1 is distinct from l) as n_spans from (select doc_id, p, lag(p) over (partition by doc_id order by p) as l from c) group by doc_id),
b as (select doc_id, p, substr(x, 2 * p - 1, 2) as h from (select doc_id, x, unnest(range(1, length(x) // 2 + 1)) as p from d where doc_id in (select doc_id from s))),
k as (select b.doc_id, string_agg(h, '' order by p) as h from b anti join c on b.doc_id = c.doc_id and b.p = c.p group by b.doc_id)
select d.doc_id, (length(x) // 2)::bigint as n_bytes, coalesce(n_removed, 0)::bigint as n_removed, coalesce(n_spans, 0)::bigint as n_spans,
  sha256(unhex(case when s.doc_id is null then x else coalesce(k.h, '') end)) as kept_sha256
from d left join s on s.doc_id = d.doc_id left join k on k.doc_id = d.doc_id
"""
