"""Operators against brute force, round trips and held-out rows, with the awkward cases: nulls, empty and long texts, ties, repeated rows, empty tables, columns of clashing names."""

import hashlib
import itertools
import random
import re
import unicodedata

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from trackfold.llm import bpe, chat, common, fingerprint, jaccard, language, mixing, repeats, substring, suffix, toxicity, vectors

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, marks string, late string, packed string, part int, rest string, size long, rank long"
WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def sentences(seed, n, words=60):
    rng = random.Random(seed)
    return [" ".join(rng.choice("alpha beta gamma delta epsilon zeta eta theta iota kappa lamda my ny xi".split()) for _ in range(words)) for _ in range(n)]


def corpus():
    a, b, c = sentences(1, 3)
    texts = [a, b, a, None, "", "   ", "short", b.replace("alpha", "ALPHA"), a + " " + c, c[:150] + " new end " + b[50:], "x" * 120, "y" + "x" * 130, "été " * 40, "été " * 41, "word " * 3000 + a, "   odd\u0085 spaces\n\n\tand 🎉🎉 signs!!! don't 12345"]
    again = [(None, b), (2, a), (2, b + " tail " + c), (2, "short"), (None, c + " of a null id"), (None, "z" * 90), (7, a[:200]), (9, c + " " + b)]  # ids that repeat, with equal and with other texts
    return [(i, t) for i, t in enumerate(texts)] + again


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, ["en", "de", None][k % 3], [None, "s1", "s2", "s0"][k % 4], len(t or ""), "m", "l", "p", k, "r", 1, 1) for k, (i, t) in enumerate(corpus())]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def brute_windows(seqs, width):
    """seqs: (id, sequence); a null id is the least. Marks of units that an earlier document's window covers."""
    key = lambda i: -(10**18) if i is None else i
    first = {}
    for i, s in seqs:
        for p in range(len(s) - width + 1):
            w = s[p : p + width]
            first[w] = min(first.get(w, key(i)), key(i))
    out = []
    for i, s in seqs:
        gone = [False] * len(s)
        for p in range(len(s) - width + 1):
            if first[s[p : p + width]] < key(i):
                gone[p : p + width] = [True] * width
        out.append((i, s, gone))
    return out


def test_suffix_against_brute_force(docs, empty):
    got = sorted((str(r.doc_id), r.n_bytes, r.n_removed, len(r.starts), bytes(r.kept)) for r in suffix.deduped(docs).collect())
    want = []
    for i, s, gone in brute_windows([(i, (t or "").encode()) for i, t in corpus()], 50):
        runs = sum(1 for k, _ in itertools.groupby(gone) if k)
        want.append((str(i), len(s), sum(gone), runs, bytes(b for b, g in zip(s, gone, strict=True) if not g)))
    assert got == sorted(want)
    assert suffix.deduped(empty).count() == 0


def test_substring_against_brute_force(docs, empty):
    got = sorted((str(r.doc_id), r.n_words, r.n_removed, r.kept) for r in substring.factored(docs).collect())
    want = [(str(i), len(s), sum(gone), " ".join(w for w, g in zip(s, gone, strict=True) if not g)) for i, s, gone in brute_windows([(i, tuple(WORDS.findall(t or ""))) for i, t in corpus()], 13)]
    assert got == sorted(want)
    assert substring.factored(empty).count() == 0
    whole = {(r.doc_id, r.kept) for r in substring.factored(docs, whole=True).collect()}
    assert (4, "") in whole and (5, "   ") in whole and "lang" in substring.factored(docs, whole=True).select("rest.*").columns


@pytest.mark.parametrize("width,gram", [(50, 24), (6, 2), (13, 5)])
def test_phrases_hold_each_window_once(width, gram):
    rng = np.random.default_rng(width)
    values = rng.integers(0, 3, 4000).astype(np.uint8)
    bounds = np.array([0, 0, 5, 5 + width, 900, 4000])
    p = repeats.parse(values, bounds, repeats.Shape(suffix.byte_units, width, gram, repeats.by_order))
    seen = np.zeros(len(values), int)
    for lo, hi in zip(p.lo, p.hi, strict=True):
        seen[lo : hi + 1] += 1
    want = np.zeros(len(values), int)
    for a, z in itertools.pairwise(bounds):
        want[a : max(a, z - width + 1)] = 1
    assert (seen == want).all()


def test_ranks_are_suffix_order():
    v = np.random.default_rng(0).integers(0, 2, 300).astype(np.uint8)
    r = repeats.ranks(v, 20)
    s = [bytes(v[i : i + 20]) for i in range(281)]
    assert all((s[i] < s[j]) == (r[i] < r[j]) and (s[i] == s[j]) == (r[i] == r[j]) for i in range(0, 281, 7) for j in range(281))


@pytest.mark.parametrize("search", [repeats.by_order, substring.by_factors])
@pytest.mark.parametrize("letters,width", [(2, 13), (4, 5), (1, 3)])
def test_searches_find_each_window_of_an_earlier_document(search, letters, width):
    rng = np.random.default_rng(letters)
    size = rng.integers(width, 3 * width, 300)
    doc = rng.integers(0, 90, 300)
    doc[:3] = -(1 << 63)
    text = rng.integers(0, letters, int(size.sum())).astype(np.uint64)
    ends = np.cumsum(size)
    first, want = {}, []
    seqs = [(int(d), tuple(text[z - n : z].tolist())) for d, n, z in zip(doc, size, ends, strict=True)]
    windows = [(d, s[p : p + width]) for d, s in seqs for p in range(len(s) - width + 1)]
    for d, w in windows:
        first[w] = min(first.get(w, d), d)
    want = [first[w] < d for d, w in windows]
    assert search(text, size, doc, width).tolist() == want


def test_factors_grow_to_the_first_word_that_differs():
    v = np.array([1, 2, 3, 4, 9, 1, 2, 3, 5, 9, 9], dtype=np.uint64)
    assert substring.agreed(v, np.array([5, 4, 10, 0]), np.array([0, 9, 4, 0]), np.array([4, 2, 1, 0])).tolist() == [3, 1, 1, 0]


def brute_components(ids, links):
    up = {i: i for i in ids}

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, b in links:
        x, y = sorted((find(a), find(b)))
        up[y] = x
    return {i: find(i) for i in ids}


def test_jaccard_against_brute_force(spark, empty):
    rng = random.Random(3)
    base = sentences(5, 6, 40)
    texts = [None, "", "one two three", "ONE two three", "a b"]
    for b in base:
        for _ in range(7):
            w = b.split()
            for _ in range(rng.randrange(4)):
                w[rng.randrange(len(w))] = "edit%d" % rng.randrange(5)
            texts.append(" ".join(w))
    rows = [(i, t) for i, t in enumerate(texts)]
    sets = {}
    for i, t in rows:
        w = WORDS.findall((t or "").translate({k: k + 32 for k in range(65, 91)}))
        sets[i] = {tuple(w)} if 0 < len(w) < 5 else {tuple(w[k : k + 5]) for k in range(len(w) - 4)}
    links = [(a, b) for a, b in itertools.combinations(sets, 2) if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    want = brute_components(sets, links)
    assert len(set(want.values())) < len(want) - 5
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.joined(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    assert got == {i: (len(sets[i]), want[i]) for i in sets}
    assert jaccard.joined(empty).count() == 0


def test_jaccard_takes_awkward_rows(docs):
    assert jaccard.joined(docs).count() == len(corpus())


def test_jaccard_in_chunks_with_repeated_ids_and_long_texts(spark, monkeypatch):
    """Clusters over several tasks; rows of one doc_id join the classes of all their texts."""
    monkeypatch.setattr(jaccard, "CHUNK", 4)
    a, b = sentences(8, 2, 80)
    long_ = " ".join(sentences(9, 900, 60))
    rows = [(i, " ".join([f"lead{i}", *a.split()])) for i in range(1, 20)] + [(30, a), (31, a), (31, b), (32, b), (40, long_), (41, long_ + " and more"), (42, None)]
    got = {}
    for r in jaccard.joined(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect():
        got.setdefault(r.doc_id, set()).add(r.component_id)
    assert got == {**{i: {1} for i in range(1, 20)}, 30: {1}, 31: {1}, 32: {1}, 40: {40}, 41: {40}, 42: {42}}


def test_sets_are_compared_exactly():
    rng = random.Random(6)
    texts = [" ".join(rng.choice(["a", "b", "c"]) for _ in range(rng.randrange(1, 40))).encode() for _ in range(60)] + [b"", b"a b"]
    sets = jaccard._Sets(texts, 5)
    own = []
    for t in texts:
        w = t.decode().split()
        own.append({tuple(w)} if 0 < len(w) < 5 else {tuple(w[k : k + 5]) for k in range(len(w) - 4)})
    i, j = (np.array(x) for x in zip(*itertools.combinations(range(len(texts)), 2), strict=True))
    want = np.array([4 * len(own[p] & own[q]) >= 3 * len(own[p] | own[q]) for p, q in zip(i, j, strict=True)])
    some = (sets.n[i] > 0) & (sets.n[j] > 0)
    assert (sets.near(i[some], j[some]) == want[some]).all() and sets.likely(i[some & want], j[some & want]).all()


def test_runs_of_a_key_become_clusters(monkeypatch):
    monkeypatch.setattr(jaccard, "SMALL", 3)
    runs = [np.array(x) for x in ([1, 2, 3, 4], [1, 2, 3, 5], [1, 2, 3, 4], [1, 8, 9])]
    got = jaccard._merged(runs)
    assert [c.tolist() for c in got] == [[1, 2, 3, 4, 5], [1, 8, 9]] and [c.tolist() for c in jaccard._merged(runs[3:])] == [[1, 8, 9]]


def test_components(spark):
    e = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (7, 7)], "a long, b long")
    got = {r.id: r.component for r in common.components(e).collect()}
    assert got == {**{i: 0 for i in range(1, 41)}, 101: 100}
    assert common.components(e.limit(0)).count() == 0


def test_filter_lets_all_members_through(spark):
    f = common.bloom(spark.range(0, 1000, 7), "id")
    assert {r.id for r in common.may_hold(spark.range(1000), "id", f).collect()} >= set(range(0, 1000, 7))
    g = common.bloom(spark.range(1, 2), "id")
    assert common.may_hold(spark.range(1000), "id", g).count() < 10


def test_vectors_against_brute_force(spark):
    rng = np.random.default_rng(1)
    centre = rng.normal(size=(12, 16))
    v = [(centre[i % 12] + rng.normal(size=16) * rng.choice([0.01, 0.2])).tolist() for i in range(300)]
    rows = [(i, x, i % 2) for i, x in enumerate(v)] + [(900, None, 1), (901, [0.0] * 16, 1), (902, [float("nan")] * 16, 1), (903, v[0], None), (904, [], 0), (905, [1.0, None], 0), (906, [x * 1e-200 for x in v[0]], 0)]
    rows += [(1000 + k, v[4], 0) for k in range(700)]  # copies
    x = np.array(v + [v[0]] + [v[4]] * 700)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    ids = [*range(300), 906, *range(1000, 1700)]
    label = [i % 2 for i in range(300)] + [0] * 701
    cos = x @ x.T
    links = [(ids[a], ids[b]) for a in range(1001) for b in range(a + 1, 1001) if label[a] == label[b] and cos[a, b] >= 0.98]
    want = brute_components([r[0] for r in rows], links)
    n = {r[0]: 0 for r in rows}
    for a, b in links:
        n[a] += 1
        n[b] += 1
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in vectors.deduped(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").repartition(3)).collect()}
    assert got == {i: (n[i], want[i], want[i] == i) for i in n}
    assert vectors.deduped(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0


def test_vectors_of_repeated_ids_and_clashing_columns(spark):
    schema = "vec_id long, embedding array<float>, label string, h1 long, rep long, row long, at long, component long"
    a, b, c = [1.0, 0.0, 0.0], [0.0, 1.0, 0.0], [0.0, 0.0, 1.0, 0.0]
    rows = [(1, a, "x"), (2, a, "x"), (2, b, "x"), (3, b, "x"), (4, c, "x"), (5, a, "y"), (None, a, "x"), (6, [2.0, 0.0, 0.0], "x")]
    got = sorted({(r.vec_id, r.n_links, r.component_id, r.kept) for r in vectors.deduped(spark.createDataFrame([(*r, 1, 2, 3, 4, 5) for r in rows], schema)).collect() if r.vec_id})
    assert got == [(1, 2, 1, True), (2, 2, 1, False), (3, 1, 1, False), (4, 0, 4, True), (5, 0, 5, True), (6, 2, 1, False)]


def test_fingerprints(docs, empty):
    got = sorted((str(r.doc_id), r.n_chars, r.edited_sha256, r.near_edited, r.near_next) for r in fingerprint.fingerprints(docs).collect())
    rows = sorted(((i if i is not None else -(10**18), t or "") for i, t in corpus()))
    want = []
    for k, (i, t) in enumerate(rows):
        nxt = rows[(k + 1) % len(rows)][1]
        q = len(t) // 4
        e = t[: len(t) - q] + nxt[:q]
        want.append((str(i) if i >= 0 else "None", len(t), hashlib.sha256(e.encode()).hexdigest(), float(fingerprint.canonical(t) == fingerprint.canonical(e)), float(fingerprint.canonical(t) == fingerprint.canonical(nxt))))
    assert got == sorted(want)
    by = {(r.doc_id, r.n_chars): r.fingerprint for r in fingerprint.fingerprints(docs).collect()}
    assert by[1, len(corpus()[1][1])] == by[7, len(corpus()[7][1])]  # case folds
    assert fingerprint.fingerprints(empty).count() == 0
    one = docs.where("doc_id = 6").coalesce(1)
    assert fingerprint.fingerprints(one).first().near_next == 1.0


def test_canonical_form():
    assert fingerprint.canonical("ﬁ  ﬁ\tSTRASSE") == fingerprint.canonical("fi fi  straße")
    assert fingerprint.canonical(unicodedata.normalize("NFD", "é")) == fingerprint.canonical("É")


def test_bpe_as_tiktoken(docs, empty, spark):
    public_tokenizers = pytest.importorskip("public_tokenizers")
    tiktoken = pytest.importorskip("tiktoken")
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.vocabulary(path), special_tokens={})
    more = [(60, "哈" * 700 + "你好" * 90), (61, "abcab" * 99), (62, "x" * 289), (-(2**63), "least"), (50, "=" * 700 + " " * 300 + "\n" * 9 + "word"), (51, "𝔘nicode ١٢٣ ½ ǅ ़ा"), (52, "<|endoftext|> isn't 'special'")]
    rows = corpus() + more
    d = docs.select("doc_id", "text").union(spark.createDataFrame(more, "doc_id long, text string"))
    ids = bpe.encode(d, path, public_tokenizers.PATTERN)
    assert sorted((str(r.doc_id), list(r.ids)) for r in ids.collect()) == sorted((str(i), enc.encode_ordinary(t or "")) for i, t in rows)
    assert sorted((str(r.doc_id), bytes(r.bytes)) for r in bpe.decode(ids, path).collect()) == sorted((str(i), (t or "").encode()) for i, t in rows)
    assert bpe.encode(empty, path, public_tokenizers.PATTERN).count() == 0
    want = [(str(i), len(e), hashlib.sha256(b"".join(x.to_bytes(4, "little") for x in e)).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()) for i, t in rows for e in [enc.encode_ordinary(t or "")]]
    assert sorted((str(r.doc_id), r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.digests(d, path, public_tokenizers.PATTERN).collect()) == sorted(want)


def test_bpe_puts_a_block_together_in_small_steps(spark):
    """A block of more words than one row of numbers holds; no step holds more than a part of them."""
    public_tokenizers = pytest.importorskip("public_tokenizers")
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    text = lambda i: f"n{i} " + "a bc def " * (i % 7 * 300) + f"z{i % 3}"
    docs = spark.createDataFrame([(i, text(i)) for i in range(300)], "doc_id long, text string").coalesce(1)

    def finish(doc_ids, bounds, ids, word_bounds):
        parts = [ids[a:z].astype("<i4").tobytes() for a, z in zip(word_bounds[bounds[:-1]], word_bounds[bounds[1:]], strict=True)]
        return pa.RecordBatch.from_pydict({"doc_id": doc_ids, "ids": pa.array(parts, pa.binary()), "n": pa.array(np.diff(bounds)), "step": pa.array([int(bounds[-1])] * len(doc_ids))})

    records = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(records)
    spark.conf.set(records, "10")
    try:
        got = bpe.tokenized(docs, path, public_tokenizers.PATTERN, "doc_id long, ids binary, n long, step long", finish).collect()
    finally:
        spark.conf.set(records, before)
    assert sum(r.n for r in got) > 700_000 and max(r.step for r in got) <= 110_000
    piece = bpe.pieces(path)
    assert {r.doc_id: bpe.decoded(np.frombuffer(r.ids, "<i4"), piece)[0].tobytes().decode() for r in got} == {i: text(i) for i in range(300)}


def test_batches_that_go_to_python_are_bounded_by_bytes(spark, tmp_path):
    spark.range(48).selectExpr("id as doc_id", "repeat('long text ', 50000) as text").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    docs = common.table(spark, str(tmp_path), "documents")
    sizes = docs.mapInArrow(lambda batches: (pa.RecordBatch.from_pydict({"n": [b.num_rows], "size": [b.nbytes]}) for b in batches), "n long, size long").collect()
    assert sum(r.n for r in sizes) == 48 and max(r.size for r in sizes) < 8_000_000


def test_a_task_leaves_no_tables_in_its_worker(spark):
    def run(batches):
        for b in batches:
            common.Rolling(np.arange(9, dtype=np.uint64))
            yield b

    def left(batches):
        for _ in common.frugal(run)(batches):
            assert common._powers
        yield pa.RecordBatch.from_pydict({"id": [len(common._powers)]})

    assert [r.id for r in spark.range(1, numPartitions=1).mapInArrow(left, "id long").collect()] == [0]


def test_a_word_is_merged_and_joined_as_tiktoken_does():
    public_tokenizers = pytest.importorskip("public_tokenizers")
    tiktoken = pytest.importorskip("tiktoken")
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    ranks = bpe.vocabulary(path)
    enc = tiktoken.Encoding("own", pat_str=r"(?s).+", mergeable_ranks=ranks, special_tokens={})
    sizes = np.diff(bpe.pieces(path)[1])
    rng = random.Random(3)
    for letters in ("ab", "aab", "theing", "=-", "哈你"):
        word = "".join(rng.choice(letters) for _ in range(700)).encode()
        want = enc.encode_ordinary(word.decode())
        assert bpe.merged(word, ranks) == want
        cut = [word[k : k + bpe.PIECE] for k in range(0, len(word) - bpe.PIECE + bpe.STRIDE, bpe.STRIDE)]
        one = bpe.joined([np.array(bpe.merged(x, ranks)) for x in cut], sizes)
        assert one is None or one.tolist() == want


def test_mixing(docs, empty, spark):
    rows = [(i, "w " * random.Random(i).randrange(1, 400), ["big", "mid", None, "zero"][0 if i % 3 else i % 4]) for i in range(400)] + [(999, None, "zero"), (1000, "", "none")]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)

    def run():
        placed, pieces = mixing.mixed(d, block=64)
        taken = pieces.groupBy("rank", "at").agg(F.sum("n").alias("taken"))
        return placed.join(taken, ["rank", "at"], "left").select("doc_id", "source", "size", "source_size", "target", F.when(F.col("size") > 0, F.coalesce("taken", F.lit(0))).otherwise(0).alias("taken")).collect(), pieces

    out, pieces = run()
    assert len(out) == len(rows) and all(r.taken <= 2 * r.size for r in out)
    size, took, target = {}, {}, {}
    for r in out:
        size[r.source] = size.get(r.source, 0) + r.size
        took[r.source] = took.get(r.source, 0) + r.taken
        target[r.source] = r.target
    assert all(abs(took[s] - target[s]) <= 1 and target[s] <= 2 * size[s] + 1e-6 for s in size)
    assert sum(target.values()) == pytest.approx(1.5 * sum(size.values()))
    assert sorted(map(tuple, out), key=str) == sorted(map(tuple, run()[0]), key=str)
    # every long stretch of the schedule holds the sources in proportion
    slots = pieces.where("slot is not null").select("rank", "slot").distinct().collect()
    half = max(r.slot for r in slots) / 2
    n = {s: (sum(1 for r in slots if r.rank == s and r.slot <= half), sum(1 for r in slots if r.rank == s)) for s in {r.rank for r in slots}}
    assert all(abs(a - b / 2) <= 4 for a, b in n.values())
    placed, pieces = mixing.mixed(empty)
    assert placed.count() == 0 and pieces.count() == 0
    placed, _ = mixing.mixed(docs)
    assert placed.count() == len(corpus())


def test_targets_fill_up(spark):
    s = spark.createDataFrame([(0, 10), (1, 1000), (2, 1000)], "rank long, size long")
    got = {r.rank: r.target for r in mixing.targets(s, 1.5, 2.0).collect()}
    assert got[0] == 20 and got[1] + got[2] == pytest.approx(1.5 * 2010 - 20) and got[2] == pytest.approx(2 * got[1])


def test_toxicity(spark, docs, empty):
    rng = random.Random(2)
    clean = "we walk by the river and talk about the weather in spring with friends near town".split()
    rows, labels = [], []
    for i in range(1200):
        w = [rng.choice(clean) for _ in range(30)]
        y = i % 4 == 0
        if y:
            for _ in range(2):
                w[rng.randrange(30)] = rng.choice(["badwort", "badwortlich", "scumbag", "sсumbag", "5cumbag"])
        elif i % 9 == 0:
            w[5:7] = ["scumbag", "beetle"]
        rows.append((i, " ".join(w)))
        labels.append((i, int(y)))
    rows += [(5000, None), (5001, ""), (5002, "SCUMBAG " * 3)]
    out = {r.doc_id: r for r in toxicity.scored(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")).collect()}
    held = [r for i, r in out.items() if r.held_out and i < 5000]
    assert len(held) > 150 and np.mean([r.predicted == (r.doc_id % 4 == 0) for r in held]) > 0.97
    assert all(0 <= r.score <= 1 for r in out.values()) and out[5000].score == out[5001].score and out[5002].predicted == 1
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert {r.score for r in toxicity.scored(docs, none).collect()} == {0.0}
    assert toxicity.scored(empty, none).count() == 0


def test_exceptions_spare_matches():
    m = toxicity.Matcher({" scum": 3.0, " scum ": 2.0, " loser ": 1.0}, [" pond scum "])
    assert m.starts(" pond scum loser ") == {10: 1.0} and m.starts(" scums scum ") == {0: 3.0, 6: 3.0}


def test_language(spark, docs, empty):
    rng = random.Random(4)
    stock = {"aa": ["lorem", "ipsum", "dolor", "amet"], "bb": ["żółw", "gęś", "łoś", "miś"], "cc": ["der", "dachs", "dickicht", "durch"]}
    rows = [(i, " ".join(rng.choice(stock[x]) + rng.choice(["", "en", "us"]) for _ in range(25)), x) for i in range(300) for x in [sorted(stock)[i % 3]]]
    rows += [(900, None, "aa"), (901, "", "aa"), (902, "123 — 456", None), (903, "١ —", "bb")]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    out = {r.doc_id: r for r in language.labelled(d, *language.learn(d)).collect()}
    assert np.mean([out[i].lang_pred == x for i, _, x in rows[:300]]) > 0.99
    assert all(out[i].lang_pred == "und" and out[i].score == 0 for i in (900, 901, 902, 903))
    mixed = spark.createDataFrame([(1, " ".join(stock["aa"] * 6 + stock["bb"] * 3))], "doc_id long, text string")
    langs, w, a = language.learn(d)
    r = language.labelled(mixed, langs, w, a).first()
    assert r.lang_pred == "aa" and 0.2 < r.shares[1] < 0.45
    assert language.labelled(empty, *language.learn(empty)).count() == 0 and {x.lang_pred for x in language.labelled(docs, *language.learn(empty)).collect()} == {"und"}


def test_long_texts_are_several_chains():
    text = ("grüß " * 50 + "é" * 90 + " end").encode()
    for most in (7, 40, 1000):
        got = language.chains(text, most)
        assert b"".join(got) == text and all(0 < len(x) <= most and x.decode() for x in got)


def test_forward_backward():
    rng = np.random.default_rng(0)
    e, a, bounds = rng.normal(size=(75, 3)), rng.normal(size=(3, 3)), np.array([0, 0, 1, 75])
    p = language.posteriors(e.copy(), bounds, a)
    # the short text has no neighbour; of the long one, the first words by enumeration over a cut copy
    assert p[0] == pytest.approx(np.exp(e[0]) / np.exp(e[0]).sum())
    q = language.posteriors(e[1:6].copy(), np.array([0, 5]), a)
    z = np.zeros((5, 3))
    for path in itertools.product(range(3), repeat=5):
        s = np.exp(sum(e[1 + t, y] for t, y in enumerate(path)) + sum(a[x, y] for x, y in itertools.pairwise(path)))
        for t, y in enumerate(path):
            z[t, y] += s
    assert q == pytest.approx(z / z.sum(axis=1, keepdims=True)) and p.sum(axis=1) == pytest.approx(np.ones(75))


def test_reply_trees(spark):
    m = spark.createDataFrame([(1, None, "user", "q", 0.0), (2, 1, "assistant", "low", 1.0), (3, 1, "assistant", "high", 2.0), (4, 3, "user", "then", 0.0), (5, 4, "assistant", "a", 1.0), (6, 4, "assistant", "b", 1.0), (7, 99, "user", "lone", None), (8, 9, "x", "loop", 1.0), (9, 8, "x", "loop", 1.0)], "node long, parent long, role string, text string, score double")
    p = chat.paths(m, keep=2)
    best = {(r.root, r.branch): r.leaf for r in p.select("root", "branch", "leaf").distinct().collect()}
    assert best == {(1, 1): 5, (1, 2): 6, (7, 1): 7}
    assert [r.node for r in p.where("root = 1 and branch = 1").orderBy("depth").collect()] == [1, 3, 4, 5]
    f = chat.formatted(p).where("root = 1 and branch = 1").first()
    assert f.formatted == "### user: q</turn>\n### assistant: high</turn>\n### user: then</turn>\n### assistant: a</turn>\n"
    assert [f.formatted[s.start : s.start + s.length] for s in f.spans] == ["high", "a"]


def test_chat_reads_back_what_it_wrote(spark):
    odd = ["", "&amp; & &lt;", "### user: x</turn>\n", "\\### Assistant: </turn> ok", "🎉<#:", None]
    rows = [(1, i, "a: b" if i == 0 else "assistant", t) for i, t in enumerate(odd)] + [(1, None, None, "first"), (2, 0, "assistant", "same"), (2, 0, "assistant", "same"), (None, 0, "user", "no id")]
    p = chat.paths(chat.chained(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")))
    out = {r.conv: r for r in chat.formatted(p).select(F.col("leaf.conv").alias("conv"), "formatted", "spans", chat.unescaped(F.lit("&amp;lt;")).alias("u")).collect()}
    assert out[1].u == "&lt;"
    un = lambda s: s.replace("&lt;", "<").replace("&num;", "#").replace("&colon;", ":").replace("&amp;", "&")
    turns = out[1].formatted.split("</turn>\n")[:-1]
    assert [un(t[4:].split(": ", 1)[1]) for t in turns] == ["first", *[t or "" for t in odd]] and un(turns[1][4:].split(": ", 1)[0]) == "a: b"
    assert [un(out[1].formatted[s.start : s.start + s.length]) for s in out[1].spans] == [t or "" for t in odd[1:]]
    assert len(out[2].spans) == 2 and None in out
