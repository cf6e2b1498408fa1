"""Language ID (operator 10): a linear-chain conditional random field over words.

A word's features are its hash (the lexicon), its beginnings and ends and its byte
n-grams, hashed into a table of weights; transitions between labels are learned too.
Training maximises the conditional likelihood of word labels, every word of a training
document bearing the document's language; forward-backward gives each word's label
probabilities, so that a text that switches languages is labelled word by word. A
document's score for a language is the mean of its words' probabilities.

Words are put through in chunks: products of transfer matrices within chunks first,
then what enters each chunk, then the words, so that one long text costs no long loop. A
text of more than STEP_BYTES is several chains, cut between words (within a word only if
that is longer still), which bounds the memory of a step; its score is over all its words.

Defined results: null, and texts without a letter, are `und` with score 0; so is every
text if nothing was learned; every language of a training row is learned; ties go to the first language by code point; equal rows are separate;
an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trackfold.llm.common import STEP_BYTES, Rolling, ragged, steps, table, texts_of

#: Training takes about TRAIN_DOCS documents of each language, and of each one stretch of TRAIN_CHARS, which starts at a place that a hash draws. All labelled rows are counted.
TRAIN_DOCS, TRAIN_CHARS = 200, 4_000
BITS = 18
CHUNK = 32
SEGMENT = 48
_GRAMS = (2, 3, 4)
_AFFIXES = (2, 3, 4, 5)

# ASCII bytes that are not letters part words
_PART = np.array([i < 128 and not chr(i).isalpha() for i in range(256)])


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


class Tokens:
    """Words of some texts, the distinct ones among them and their features."""

    def __init__(self, texts: list[bytes]):
        raw = (b" " + b" ".join(t.decode().lower().encode() for t in texts) + b" ") if texts else b"  "
        buf = np.frombuffer(raw, dtype=np.uint8)
        part = _PART[buf]
        buf = np.where(part, np.uint8(0x20), buf)
        lengths = np.array([len(t.decode().lower().encode()) if not t.isascii() else len(t) for t in texts], dtype=np.int64)
        at = np.flatnonzero(part[1:] != part[:-1]) + 1
        starts, ends = at[::2], at[1::2]
        begins = np.concatenate([[1], 1 + np.cumsum(lengths + 1)]).astype(np.int64)
        self.bounds = np.searchsorted(starts, begins)
        roll = Rolling(buf)
        h = roll.of(starts, ends)
        _, first, self.which = np.unique(h, return_index=True, return_inverse=True)
        s, e, self.word = starts[first], ends[first], h[first]
        size = e - s
        found = [(self.word ^ np.uint64(0xA5A5), np.arange(len(s)))]
        spaced = size + 2  # a word with the byte on either side
        for n in _GRAMS:
            grams = roll.every(n)
            m = np.maximum(spaced - n + 1, 0)
            found.append((grams[ragged(s - 1, m)], np.repeat(np.arange(len(s)), m)))
        for n in _AFFIXES:
            ok = np.flatnonzero(size >= n)
            found.append((roll.of(s[ok], s[ok] + n) ^ np.uint64(0x1F1F), ok))
            found.append((roll.of(e[ok] - n, e[ok]) ^ np.uint64(0xE7E7), ok))
        slot = np.concatenate([(f >> np.uint64(64 - BITS)).astype(np.int32) for f, _ in found])
        owner = np.concatenate([o for _, o in found])
        order = np.argsort(owner, kind="stable")
        self.slot, owner = slot[order], owner[order]
        self.first = np.searchsorted(owner, np.arange(len(s)))

    def emissions(self, weights: np.ndarray) -> np.ndarray:
        """Of each distinct word, for each label."""
        if not len(self.first):
            return np.zeros((0, weights.shape[1]))
        return np.add.reduceat(weights[self.slot], self.first, axis=0).astype(np.float64)


def _scaled(x: np.ndarray, axes) -> np.ndarray:
    return x / np.maximum(x.max(axis=axes, keepdims=True), 1e-300)


def posteriors(emissions: np.ndarray, bounds: np.ndarray, transitions: np.ndarray) -> np.ndarray:
    """Label probabilities of each word by forward-backward. emissions: words by labels; bounds: of the texts, in words."""
    labels = emissions.shape[1]
    phi = np.exp(emissions - emissions.max(axis=1, keepdims=True)) if len(emissions) else emissions
    a = np.exp(transitions - transitions.max())
    counts = np.diff(bounds)
    chunks = -(-counts // CHUNK)
    total = int(chunks.sum())
    if not total:
        return np.zeros((0, labels))
    first = np.cumsum(chunks) - chunks
    doc = np.repeat(np.arange(len(counts)), chunks)
    inner = np.arange(total) - first[doc]
    begin = bounds[:-1][doc] + inner * CHUNK
    size = np.minimum(CHUNK, counts[doc] - inner * CHUNK)
    # what a chunk does to a row vector that enters it; a text's first word has no transition into it
    move = np.broadcast_to(np.eye(labels), (total, labels, labels)).copy()
    for t in range(CHUNK):
        on = np.flatnonzero(size > t)
        step = np.broadcast_to(a, (len(on), labels, labels)) if t else np.where((inner[on] == 0)[:, None, None], np.eye(labels), a)
        move[on] = _scaled((move[on] @ step) * phi[begin[on] + t][:, None, :], (1, 2))
    enter = np.ones((total, labels))
    leave = np.ones((total, labels))
    for j in range(1, int(chunks.max())):
        at = first[chunks > j] + j
        enter[at] = _scaled((enter[at - 1][:, None, :] @ move[at - 1])[:, 0, :], 1)
        end = first[chunks > j] + chunks[chunks > j] - j
        leave[end - 1] = _scaled((move[end] @ leave[end][:, :, None])[:, :, 0], 1)
    out = np.empty((len(emissions), labels))
    f = enter
    for t in range(CHUNK):
        on = np.flatnonzero(size > t)
        g = f[on] @ a
        if t == 0:
            g[inner[on] == 0] = 1.0
        f[on] = _scaled(g * phi[begin[on] + t], 1)
        out[begin[on] + t] = f[on]
    b = leave
    for t in range(CHUNK - 1, -1, -1):
        on = np.flatnonzero(size > t)
        w = begin[on] + t
        out[w] *= b[on]
        b[on] = _scaled((b[on] * phi[w]) @ a.T, 1)
    return out / np.maximum(out.sum(axis=1, keepdims=True), 1e-300)


def train(texts: list[bytes], labels: np.ndarray, n: int, epochs: int = 4, rate: float = 0.3, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """Weights (2**BITS by labels) and transitions, by steps along the gradient of the conditional likelihood, scaled as in Adagrad."""
    tokens = Tokens(texts)
    w = np.zeros((1 << BITS, n), dtype=np.float32)
    grown = np.full((1 << BITS, n), 1e-2, dtype=np.float32)
    a = np.zeros((n, n))
    a_grown = np.full((n, n), 1e-2)
    count = np.diff(tokens.bounds)
    pieces = [(p, min(p + SEGMENT, z), labels[i]) for i, (s, z) in enumerate(zip(tokens.bounds[:-1], tokens.bounds[1:], strict=True)) for p in range(s, z, SEGMENT)]
    if not pieces or not count.sum():
        return w, a
    rng = np.random.default_rng(seed)
    last = np.append(tokens.first[1:], len(tokens.slot))
    for _ in range(epochs):
        order = rng.permutation(len(pieces))
        for k in range(0, len(order), 256):
            some = [pieces[i] for i in order[k : k + 256]]
            size = np.array([z - s for s, z, _ in some])
            at = ragged(np.array([s for s, _, _ in some]), size)
            y = np.repeat([label for _, _, label in some], size)
            words, which = np.unique(tokens.which[at], return_inverse=True)
            span = last[words] - tokens.first[words]
            slots = tokens.slot[ragged(tokens.first[words], span)]
            e = np.add.reduceat(w[slots], np.cumsum(span) - span, axis=0).astype(np.float64)
            bounds = np.concatenate([[0], np.cumsum(size)])
            p = posteriors(e[which], bounds, a)
            # gradient of the emissions, gathered by distinct word, then by slot
            d = -p
            d[np.arange(len(y)), y] += 1
            by_word = np.zeros((len(words), n))
            np.add.at(by_word, which, d)
            slot, owner = np.unique(slots, return_inverse=True)
            g = np.zeros((len(slot), n), dtype=np.float32)
            np.add.at(g, owner, np.repeat(by_word, span, axis=0).astype(np.float32))
            g -= 1e-3 * w[slot]
            grown[slot] += g * g
            w[slot] += rate * g / np.sqrt(grown[slot])
            # of the transitions: pairs seen, less pairs expected
            inside = np.ones(len(y), dtype=bool)
            inside[bounds[1:] - 1] = False
            i = np.flatnonzero(inside)
            joint = p[i][:, :, None] * np.exp(a - a.max())[None] * p[i + 1][:, None, :]
            joint /= np.maximum(joint.sum(axis=(1, 2), keepdims=True), 1e-300)
            ga = np.bincount(y[i] * n + y[i + 1], minlength=n * n).reshape(n, n) - joint.sum(axis=0) - 1e-2 * a
            a_grown += ga * ga
            a += rate * ga / np.sqrt(a_grown)
    return w, a


def learn(docs: DataFrame) -> tuple[list[str], np.ndarray, np.ndarray]:
    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id")))
    counts = known.groupBy("lang").agg(F.count("*").alias("n")).orderBy("lang").collect()
    langs = sorted(r.lang for r in counts)
    if not langs:
        return [], np.zeros((1 << BITS, 1), np.float32), np.zeros((1, 1))
    share = F.create_map(*[F.lit(x) for r in counts for x in (r.lang, int(min(1.0, TRAIN_DOCS / r.n) * (1 << 20)) + 1)])
    start = F.pmod(F.xxhash64("doc_id", F.lit(5)), F.greatest(F.lit(1), F.char_length("text") - TRAIN_CHARS + 1)).cast("int")
    rows = known.select(F.substring("text", start + 1, F.lit(TRAIN_CHARS)).alias("text"), "lang", F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(1 << 20)).alias("h")).where(F.col("h") < F.try_element_at(share, F.col("lang"))).orderBy("h", "text").limit(2 * TRAIN_DOCS * len(langs)).collect()
    at = {x: i for i, x in enumerate(langs)}
    return langs, *train([r.text.encode() for r in rows], np.array([at[r.lang] for r in rows], dtype=np.int64), len(langs))


def chains(text: bytes, most: int = STEP_BYTES) -> list[bytes]:
    """text in stretches of at most `most` bytes that end at a space, or else between characters."""
    out, a = [], 0
    while len(text) - a > most:
        z = text.rfind(b" ", a + 1, a + most)
        if z < 0:
            z = a + most
            while z > a + 1 and text[z] & 0xC0 == 0x80:
                z -= 1
        out.append(text[a:z])
        a = z
    return [*out, text[a:]]


def labelled(docs: DataFrame, langs: list[str], weights: np.ndarray, transitions: np.ndarray) -> DataFrame:
    """docs: doc_id, text. doc_id, lang_pred, score, shares (mean probability of each language)."""
    model = docs.sparkSession.sparkContext.broadcast((weights, transitions))  # 2**BITS rows whatever the data

    def run(batches):
        w, a = model.value
        for b in batches:
            texts, letter = texts_of(b), b.column("letter").to_pylist()
            sums, count = np.zeros((len(texts), len(langs))), np.zeros(len(texts))
            pieces = [(i, x) for i, t in enumerate(texts) for x in chains(t)]
            for s, z in steps(len(x) for _, x in pieces) if langs else ():
                t = Tokens([x for _, x in pieces[s:z]])
                if len(t.which):
                    owner = np.repeat([i for i, _ in pieces[s:z]], np.diff(t.bounds))
                    p = posteriors(t.emissions(w)[t.which], t.bounds, a)
                    first = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
                    sums[owner[first]] += np.add.reduceat(p, first, axis=0)
                    count += np.bincount(owner, minlength=len(texts))
            mean = sums / np.maximum(count, 1)[:, None]
            best = mean.argmax(axis=1) if langs else np.zeros(len(texts), dtype=int)
            named = [bool(langs) and bool(x) for x in letter]
            yield pa.RecordBatch.from_pydict(
                {
                    "doc_id": b.column("doc_id"),
                    "lang_pred": pa.array([langs[k] if ok else "und" for k, ok in zip(best.tolist(), named, strict=True)], pa.string()),
                    "score": pa.array([min(1.0, max(0.0, float(mean[j, k]))) if ok else 0.0 for j, (k, ok) in enumerate(zip(best.tolist(), named, strict=True))], pa.float64()),
                    "shares": pa.array(mean.tolist(), pa.list_(pa.float64())),
                }
            )

    letter = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", letter.alias("letter")).mapInArrow(run, "doc_id long, lang_pred string, score double, shares array<double>")


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = labelled(docs, *learn(docs.select("doc_id", "text", "lang")))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
