"""Toxicity (operator 2): a weighted lexicon matched by Aho-Corasick.

Texts are folded first: lower case, full-width letters and look-alike Cyrillic and
Greek letters to Latin, digits and signs that stand for letters to letters,
invisible characters dropped, all but letters and digits to single spaces.

The lexicon is learned: words and word beginnings whose share among toxic documents
exceeds their share among the others by more than chance. A word's support counts
distinct neighbourhoods, so that many copies of one document count once. Exception
phrases, given or learned, are word pairs around a match that clean documents use;
matches inside them do not count. The weights found, in proportion to the text's
length and in all, enter a logistic score.

Defined results: null and empty texts score as texts without a match; documents
without a label train nothing; of several labels of a document the largest counts;
without both labels in the training rows every score is the share of toxic rows
(0 without rows); an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trackfold.llm.common import checkpointed, frugal, table

#: At most about this many labelled rows train the lexicon and the score (a hash of doc_id chooses).
TRAIN_ROWS = 100_000
#: Least neighbourhoods and documents of an entry, and the least lower bound of its log odds.
SUPPORT, ODDS = 8, 1.5
PREFIXES = (4, 5, 6)

# fixed values: look-alike letters, and digits and signs that stand for letters
_ALIKE = {
    "а": "a", "в": "b", "г": "r", "е": "e", "ё": "e", "і": "i", "ї": "i", "ј": "j", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p", "с": "c", "ѕ": "s", "т": "t", "у": "y", "х": "x", "һ": "h", "ԁ": "d", "ԛ": "q", "ԝ": "w", "ӏ": "l",
    "α": "a", "β": "b", "ε": "e", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ω": "w", "ı": "i",
}
_DIGITS, _AS = "013457890@$€", "oieastbgoase"
_GONE = "\u00ad\u200b\u200c\u200d\u2060\ufeff"


def _tables() -> tuple[str, str]:
    """For translate: what is replaced, by what; what has no partner is dropped."""
    digits = dict(zip(_DIGITS, _AS, strict=True))
    wide = {chr(0xFF41 + i): chr(97 + i) for i in range(26)} | {chr(0xFF10 + i): digits.get(str(i), str(i)) for i in range(10)}
    pairs = _ALIKE | wide | digits
    return "".join(pairs) + _GONE, "".join(pairs.values())


def folded(text: Column) -> Column:
    """Words apart by one space, one space before the first and after the last."""
    a, b = _tables()
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(F.translate(F.lower(F.coalesce(text, F.lit(""))), a, b), r"[^\p{L}\p{M}\p{N}]+", " ")), F.lit(" "))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def lexicon(train: DataFrame) -> dict[str, float]:
    """train: doc_id, folded, toxic. Patterns that begin at a word's start (and end with it, where they end in a space) to weights."""
    words = F.split(F.trim("folded"), " ")
    rows = train.select("doc_id", "toxic", F.concat(F.array(F.lit("")), words, F.array(F.lit(""))).alias("w"))
    around = F.transform(F.sequence(F.lit(1), F.size("w") - 2), lambda i: F.struct(F.get("w", i).alias("word"), F.xxhash64(F.get("w", i - 1), F.get("w", i + 1)).alias("near")))
    bad = rows.where("toxic = 1").select("doc_id", F.explode(around).alias("x")).select("doc_id", "x.word", "x.near").groupBy("word").agg(F.count_distinct("near").alias("n"), F.count_distinct("doc_id").alias("d"))
    bad = bad.select("word", F.least("n", "d").alias("bad"), F.lit(0).cast("bigint").alias("good"))
    good = rows.where("toxic = 0").select(F.explode(F.array_distinct("w")).alias("word")).groupBy("word").agg(F.count("*").alias("good")).select("word", F.lit(0).cast("bigint").alias("bad"), "good")
    both = checkpointed(bad.union(good).where("word <> ''").groupBy("word").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good")))
    begins = [F.when(F.char_length("word") > n, F.concat(F.lit(" "), F.substring("word", 1, n))) for n in PREFIXES]
    each = both.select("bad", "good", F.explode(F.array_compact(F.array(F.concat(F.lit(" "), "word", F.lit(" ")), *begins))).alias("pattern")).groupBy("pattern").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))
    n1, n0 = both.agg(F.coalesce(F.sum("bad"), F.lit(0)), F.coalesce(F.sum("good"), F.lit(0))).first()
    odds = F.log((F.col("bad") + 0.5) / (F.col("good") + 0.5)) + F.lit(math.log((n0 + 1) / (n1 + 1)))
    # as the training rows are bounded, so are these
    each = each.where(F.col("bad") >= SUPPORT).withColumn("odds", odds).withColumn("least", odds - 2 * F.sqrt(1 / (F.col("bad") + 0.5) + 1 / (F.col("good") + 0.5))).where(F.col("least") > ODDS)
    return {r.pattern: float(r.least) for r in each.orderBy(F.desc("least"), "pattern").select("pattern", "least").collect()}


def exceptions(train: DataFrame, lex: dict[str, float]) -> list[str]:
    """Pairs of words, a match among them, that at least SUPPORT clean and no toxic training documents hold."""
    if not lex:
        return []

    def pairs(batches):
        match = Matcher(lex, [])
        for b in batches:
            out, bad = [], []
            for text, y in zip(b.column("folded").to_pylist(), b.column("toxic").to_pylist(), strict=True):
                got = set()
                for at in match.starts(text):
                    end = text.index(" ", at + 1)
                    before = text.rfind(" ", 0, at)
                    after = text.find(" ", end + 1)
                    got |= ({text[before : end + 1]} if before >= 0 else set()) | ({text[at : after + 1]} if after > 0 else set())
                out += got
                bad += [y] * len(got)
            yield pa.RecordBatch.from_pydict({"phrase": pa.array(out, pa.string()), "toxic": pa.array(bad, pa.int32())})

    p = train.select("folded", F.col("toxic").cast("int").alias("toxic")).mapInArrow(frugal(pairs), "phrase string, toxic int")
    p = p.groupBy("phrase").agg(F.sum("toxic").alias("bad"), F.count("*").alias("n")).where((F.col("bad") == 0) & (F.col("n") >= SUPPORT))
    return [r.phrase for r in p.orderBy(F.desc("n"), "phrase").collect()]


class Matcher:
    def __init__(self, lex: dict[str, float], excepted: list[str]):
        import ahocorasick

        self.machine = ahocorasick.Automaton()
        for p, w in lex.items():
            self.machine.add_word(p, (len(p), w))
        for p in excepted:
            self.machine.add_word(p, (len(p), lex.get(p, 0.0), True))
        self.any = bool(lex)
        if self.any:
            self.machine.make_automaton()

    def starts(self, text: str) -> dict[int, float]:
        """The most a pattern weighs that begins at a word, by the place of the space before it; not inside an exception phrase."""
        found: dict[int, float] = {}
        spared = []
        if self.any:
            for end, m in self.machine.iter(text):
                at = end - m[0] + 1
                if len(m) > 2:
                    spared.append((at, end))
                elif m[1] > found.get(at, 0.0):
                    found[at] = m[1]
        for a, z in spared:
            for at in [x for x in found if a <= x < z]:
                del found[at]
        return found


def features(docs: DataFrame, lex: dict[str, float], excepted: list[str]) -> DataFrame:
    """docs: doc_id, text. total: the weights found; n: the matches; words: the words of the folded text."""

    def run(batches):
        match = Matcher(lex, excepted)
        for b in batches:
            total, n, words = [], [], []
            for text in b.column("folded").to_pylist():
                got = match.starts(text)
                total.append(float(sum(got.values())))
                n.append(len(got))
                words.append(max(0, text.count(" ") - 1))
            yield pa.RecordBatch.from_pydict({"doc_id": b.column("doc_id"), "total": pa.array(total, pa.float64()), "n": pa.array(n, pa.int64()), "words": pa.array(words, pa.int64())})

    return docs.select("doc_id", folded(F.col("text")).alias("folded")).mapInArrow(frugal(run), "doc_id long, total double, n long, words long")


def _x(total: np.ndarray, n: np.ndarray, words: np.ndarray) -> np.ndarray:
    return np.stack([np.ones(len(n)), np.log1p(total), total / (words + 10.0), np.log1p(n)], axis=1)


def fit(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Logistic regression by Newton steps."""
    w = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(x.shape[1])
        w += np.linalg.solve(h, x.T @ (y - p) - ridge * w)
    return w


def scored(docs: DataFrame, labels: DataFrame, excepted: list[str] | None = None) -> DataFrame:
    """docs: doc_id, text; labels: doc_id, toxic. Rows doc_id, held_out, score, predicted, total, n, words."""
    label = labels.where("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic")).where(~held_out(F.col("doc_id")))
    rows = label.count()
    chosen = label.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int(min(1.0, TRAIN_ROWS / max(rows, 1)) * (1 << 20)))
    chosen = F.broadcast(checkpointed(chosen))  # at most about TRAIN_ROWS rows of two numbers
    train = docs.select("doc_id", "text").join(chosen, "doc_id").select("doc_id", "toxic", folded(F.col("text")).alias("folded"))
    lex = lexicon(train)
    found = checkpointed(features(docs, lex, [*(excepted or []), *exceptions(train, lex)]))
    # of rows of a repeated doc_id the one that weighs most, so that there are at most about TRAIN_ROWS
    t = found.join(chosen, "doc_id").groupBy("doc_id", "toxic").agg(F.max(F.struct("total", "n", "words")).alias("x")).select("x.total", "x.n", "x.words", "toxic").toArrow().to_pandas()
    y = t["toxic"].to_numpy(float)
    if len(y) and 0 < y.sum() < len(y):
        w = fit(_x(t["total"].to_numpy(), t["n"].to_numpy(), t["words"].to_numpy()), y)
        z = F.lit(float(w[0])) + float(w[1]) * F.log1p("total") + float(w[2]) * F.col("total") / (F.col("words") + 10.0) + float(w[3]) * F.log1p("n")
        score = 1 / (1 + F.exp(-z))
    else:
        score = F.lit(float(y.mean()) if len(y) else 0.0)
    out = found.withColumn("score", score)
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"), "total", "n", "words")


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
