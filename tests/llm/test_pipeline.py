"""The pipeline's stages on a small corpus."""

from collections import Counter

import pytest

import corpus_pipeline
from trackfold.llm import entry, jaccard

PLACE = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{PLACE}/documents.parquet")
    before = docs.count()
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, PLACE).write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        if k < 4:
            assert set(docs.columns) == set(corpus_pipeline.COLUMNS), name
        if k < 3:
            assert docs.count() == docs.select("doc_id").distinct().count() <= before
    assert set(docs.columns) == {"doc_id", "ids", "n_tokens"} and docs.count() > 0


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long, extra int")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, PLACE)
        assert docs.count() == 0


def test_without_drops_only_the_ids(spark):
    docs = spark.createDataFrame([(i, f"t{i}", "l", "s", 2) for i in range(50)] + [(None, "n", "l", "s", 1)], "doc_id long, text string, lang string, source string, n_chars long")
    out = corpus_pipeline.without(docs, spark.range(0, 50, 3).withColumnRenamed("id", "doc_id"))
    assert {r.doc_id for r in out.collect()} == {None, *(i for i in range(50) if i % 3)}


@pytest.mark.parametrize("name", sorted(entry.QUERIES))
def test_names(name):
    assert name == "pipeline" or name.split("_")[0] in {f"op{n}" for n in range(1, 11)}


def test_null_and_repeated_ids(spark):
    """No stage loses a row of a null id that it does not reject, or multiplies equal rows."""
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    text = lambda k, n=60: " ".join(f"w{k}x{i}" for i in range(n))
    near = text(1) + " other"
    rows = [(i, text(i), "l", "s", 1) for i in range(1, 9)] + [(None, near, "l", "s", 1), (None, text(50), "l", "s", 1), (None, text(50) + " other", "l", "s", 1), (None, None, "l", "s", 1)]
    rows += [(20, text(20), "l", "s", 1)] * 3 + [(21, text(21), "l", "s", 1), (21, text(22), "l", "s", 1)]
    docs = spark.createDataFrame(rows, schema).repartition(3)

    got = jaccard.joined(docs.unionByName(spark.createDataFrame([(30, near, "l", "s", 1), (30, text(31), "l", "s", 1), (30, "", "l", "s", 1)], schema))).collect()
    classes = {}
    for r in got:
        classes.setdefault(r.doc_id, set()).add(r.component_id)
    assert len(got) == len(rows) + 3 and classes == {None: {None}, 30: {1}, **{i: {i} for i in (*range(1, 9), 20, 21)}}

    stay = corpus_pipeline.distinct(spark, docs, PLACE)
    assert sorted(map(repr, stay.collect())) == sorted(map(repr, docs.collect()))
    cut = corpus_pipeline.cut(spark, docs, PLACE)
    assert cut.count() == len(rows) and cut.where("doc_id is null").count() == 4

    # one source at a share of 1.5: each document once or twice, and half of the words again
    out = corpus_pipeline.mix(spark, docs, PLACE).collect()
    n = Counter((r.doc_id, r.text) for r in out if len(r.text.split()) >= 60)
    have = Counter((r.doc_id, r.text) for r in docs.collect() if r.text)
    assert sum(len(r.text.split()) for r in out) == round(1.5 * sum(len((r[1] or "").split()) for r in rows))
    assert all(have[x] <= n[x] <= 2 * have[x] for x in have) and set(n) <= set(have)
