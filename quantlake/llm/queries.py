"""The registered queries of this subpackage, and SQL for those that SQL can express on whole tables."""

from __future__ import annotations

from quantlake.llm import centroids, debruijn, hmm, infill, language, minhash, mixing, pieces, quality, rules, suffixes, vectors, warc

QUERIES = {
    "op1_mixing": mixing.op1_mixing,
    "op2_vectors": vectors.op2_vectors,
    "op3_language": language.op3_language,
    "op4_warc": warc.op4_warc,
    "op5_suffixes": suffixes.op5_suffixes,
    "op6_hmm": hmm.op6_hmm,
    "op7_pieces": pieces.op7_pieces,
    "op8_quality": quality.op8_quality,
    "op9_rules": rules.op9_rules,
    "op10_minhash": minhash.op10_minhash,
    "op11_infill": infill.op11_infill,
    "op12_debruijn": debruijn.op12_debruijn,
    "op13_centroids": centroids.op13_centroids,
}
ORACLE_SQL = {"op2_vectors": vectors.OP2_SQL, "op10_minhash": minhash.OP10_SQL, "op4_warc": warc.OP4_SQL, "op5_suffixes": suffixes.OP5_SQL, "op11_infill": infill.OP11_SQL, "op12_debruijn": debruijn.OP12_SQL, "op13_centroids": centroids.OP13_SQL}


def pipeline(spark, sf_dir: str):
    """The whole corpus pipeline of corpus_pipeline.py."""
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES["pipeline"] = pipeline
