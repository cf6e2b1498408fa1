"""Queries of this subpackage and their SQL; each operator's module holds both."""

from __future__ import annotations

from trackfold.llm import bpe, chat, fingerprint, jaccard, language, mixing, substring, suffix, toxicity, vectors


def pipeline(spark, sf_dir):
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    "pipeline": pipeline,
    "op1_bpe": bpe.op1_bpe,
    "op2_toxicity": toxicity.op2_toxicity,
    "op3_mixing": mixing.op3_mixing,
    "op4_suffix": suffix.op4_suffix,
    "op5_vectors": vectors.op5_vectors,
    "op6_substring": substring.op6_substring,
    "op7_fingerprint": fingerprint.op7_fingerprint,
    "op8_jaccard": jaccard.op8_jaccard,
    "op9_chat": chat.op9_chat,
    "op10_language": language.op10_language,
}
SQL = {"op4_suffix": suffix.OP4_SQL, "op5_vectors": vectors.OP5_SQL, "op6_substring": substring.OP6_SQL, "op8_jaccard": jaccard.OP8_SQL, "op9_chat": chat.OP9_SQL}
