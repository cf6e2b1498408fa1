"""Document fingerprints (operator 7): canonical exact digests.

A text's canonical form is NFKC, case folded, NFKC again, with white space folded to
single spaces; its fingerprint is the 128-bit xxhash of that form in UTF-8. Where
documents share a digest, their canonical bytes are compared; digests found to stand
for different bytes are told apart by a suffix. Fingerprints of an exact digest
are alike (1) or not (0).

The next document is found after a range partition by doc_id: texts move once, and the
first document of every range is also sent to the range before it.

Defined results: a null text is empty; rows of a repeated doc_id are separate
documents, ordered by text; a null doc_id comes first; the next of a single document
is itself; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import unicodedata

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trackfold.llm.common import bloom, checkpointed, in_bloom, parts, table

_LEAST = np.iinfo(np.int64).min


def canonical(text: str) -> bytes:
    if text.isascii():
        return " ".join(text.lower().split()).encode()
    t = unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", text).casefold())
    return " ".join(t.split()).encode()


def _first_half(digests: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(d[:8] for d in digests), dtype="<i8")


def with_next(docs: DataFrame) -> DataFrame:
    """Rows bucket, ahead, doc_id, text, dealt by bucket and sorted: in a bucket each row's next document follows it."""
    spark = docs.sparkSession
    n = parts(spark)
    docs = docs.select(F.coalesce(F.col("doc_id").cast("bigint"), F.lit(_LEAST)).alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    bounds = np.unique(np.array(docs.stat.approxQuantile("doc_id", [i / (4 * n) for i in range(1, 4 * n)], 0.25 / n), dtype=np.float64))

    def bucket(ids: np.ndarray) -> np.ndarray:
        return np.searchsorted(bounds, ids.astype(np.float64), "right").astype(np.int32)

    def least(batches):
        for b in batches:
            ids = b.column(0).to_numpy()
            yield pa.RecordBatch.from_pydict({"bucket": pa.array(bucket(ids)), "doc_id": b.column(0)})

    # a row for each bucket, at most four times the partitions
    firsts = docs.select("doc_id").mapInArrow(least, "bucket int, doc_id long").groupBy("bucket").agg(F.min("doc_id").alias("first")).orderBy("bucket").collect()
    before = {r.first: firsts[i - 1].bucket for i, r in enumerate(firsts)}  # of the first bucket: the last

    def deal(batches):
        for b in batches:
            ids = b.column("doc_id").to_numpy()
            yield pa.RecordBatch.from_arrays([pa.array(bucket(ids)), pa.array(np.zeros(len(ids), np.int8)), b.column("doc_id"), b.column("text")], names=["bucket", "ahead", "doc_id", "text"])
            at = [i for i, x in enumerate(ids.tolist()) if x in before]
            if at:
                c = b.take(pa.array(at))
                yield pa.RecordBatch.from_arrays([pa.array([before[x] for x in ids[at].tolist()], pa.int32()), pa.array(np.ones(len(at), np.int8)), c.column("doc_id"), c.column("text")], names=["bucket", "ahead", "doc_id", "text"])

    return docs.mapInArrow(deal, "bucket int, ahead byte, doc_id long, text string").repartition(n, "bucket").sortWithinPartitions("bucket", "ahead", "doc_id", "text")


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited (sha256), digest, sha, edited_digest, edited_canon_sha, near_edited, near_next; digests are binary."""

    def run(batches):
        last = None  # bucket, doc_id, text, canonical
        done_ahead = None
        for b in batches:
            out = []
            for bucket, ahead, doc_id, text in zip(*(b.column(c).to_pylist() for c in ("bucket", "ahead", "doc_id", "text")), strict=True):
                if ahead and done_ahead == bucket:
                    continue  # more rows of that document
                form = canonical(text)
                if last is not None:
                    out.append((*last[1:], text, form))
                    last = None
                if ahead:
                    done_ahead = bucket
                else:
                    last = bucket, doc_id, text, form
            rows = []
            for doc_id, text, form, next_text, next_form in out:
                k = len(text) // 4
                edited = text[: len(text) - k] + next_text[:k]
                edited_form = canonical(edited) if edited != text else form
                rows.append((None if doc_id == _LEAST else doc_id, len(text), hashlib.sha256(edited.encode()).digest(), xxhash.xxh3_128_digest(form), hashlib.sha256(form).digest(), xxhash.xxh3_128_digest(edited_form), hashlib.sha256(edited_form).digest(), float(edited_form == form), float(next_form == form)))
            if rows:
                kinds = [pa.int64(), pa.int64(), *[pa.binary()] * 5, pa.float64(), pa.float64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["doc_id", "n_chars", "edited", "digest", "sha", "edited_digest", "edited_canon_sha", "near_edited", "near_next"])

    return with_next(docs).mapInArrow(run, "doc_id long, n_chars long, edited binary, digest binary, sha binary, edited_digest binary, edited_canon_sha binary, near_edited double, near_next double")


def clashing(docs: DataFrame, shared: DataFrame) -> DataFrame:
    """Of the digests in `shared` (half: their first 8 bytes as a number) those that stand for different canonical bytes. Only documents that a fixed-size filter lets through send their bytes; the least and the greatest bytes of a digest are formed before the shuffle too."""
    filter_ = bloom(shared, "half")

    def forms(batches):
        for b in batches:
            f = [canonical(t or "") for t in b.column(0).to_pylist()]
            d = [xxhash.xxh3_128_digest(x) for x in f]
            at = np.flatnonzero(in_bloom(filter_, _first_half(d))) if d else []
            yield pa.RecordBatch.from_pydict({"digest": pa.array([d[i] for i in at], pa.binary()), "form": pa.array([zstandard.compress(f[i], 1) for i in at], pa.binary())})

    each = docs.select("text").mapInArrow(forms, "digest binary, form binary").groupBy("digest").agg(F.min("form").alias("lo"), F.max("form").alias("hi"))
    return each.where("lo <> hi").select("digest")


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next."""
    found = checkpointed(digests(docs))
    shared = found.groupBy("digest").agg(F.count("*").alias("n")).where("n > 1")

    def halves(batches):
        for b in batches:
            yield pa.RecordBatch.from_pydict({"half": pa.array(_first_half(b.column(0).to_pylist()))})

    clash = checkpointed(clashing(docs, shared.select("digest").mapInArrow(halves, "half long")))
    if clash.isEmpty():
        name, other = F.lower(F.hex("digest")), F.lower(F.hex("edited_digest"))
    else:
        found = found.join(clash.withColumn("c", F.lit(True)), "digest", "left").join(clash.select(F.col("digest").alias("edited_digest"), F.lit(True).alias("ec")), "edited_digest", "left")
        tail = lambda c, s: F.when(F.col(c), F.concat(F.lit("-"), F.lower(F.hex(s)))).otherwise("")
        name, other = F.concat(F.lower(F.hex("digest")), tail("c", "sha")), F.concat(F.lower(F.hex("edited_digest")), tail("ec", "edited_canon_sha"))
    return found.select("doc_id", "n_chars", F.lower(F.hex("edited")).alias("edited_sha256"), name.alias("fingerprint"), other.alias("edited_fingerprint"), "near_edited", "near_next")


def op7_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(table(spark, sf_dir, "documents"))
