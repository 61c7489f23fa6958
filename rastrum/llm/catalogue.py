"""Queries of the corpus operators, and their SQL where SQL can express them (the pipeline has none)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from rastrum.llm.ann import op4_ann
from rastrum.llm.bpe import op6_bpe
from rastrum.llm.hnsw import op9_near_embeddings
from rastrum.llm.jaccard import OP5_SQL, op5_jaccard_join
from rastrum.llm.lines import OP1_SQL, op1_line_dedup
from rastrum.llm.lm import op3_lm_scoring
from rastrum.llm.merkle import OP13_SQL, op13_merkle_manifest
from rastrum.llm.packing import op8_packing
from rastrum.llm.passages import op10_substring_dedup
from rastrum.llm.quality import op7_quality
from rastrum.llm.resample import OP11_SQL, op11_importance_resampling
from rastrum.llm.shards import OP2_SQL, op2_sharding
from rastrum.llm.warc import OP12_SQL, op12_warc


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages of corpus_pipeline.py, which lies at the top of the repository and is asked for when they run."""
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    "op1_line_dedup": op1_line_dedup,
    "op2_sharding": op2_sharding,
    "op3_lm_scoring": op3_lm_scoring,
    "op4_ann": op4_ann,
    "op5_jaccard_join": op5_jaccard_join,
    "op6_bpe": op6_bpe,
    "op7_quality": op7_quality,
    "op8_packing": op8_packing,
    "op9_near_embeddings": op9_near_embeddings,
    "op10_substring_dedup": op10_substring_dedup,
    "op11_importance_resampling": op11_importance_resampling,
    "op12_warc": op12_warc,
    "op13_merkle_manifest": op13_merkle_manifest,
    "pipeline": pipeline,
}

ORACLES = {"op1_line_dedup": OP1_SQL, "op2_sharding": OP2_SQL, "op5_jaccard_join": OP5_SQL, "op11_importance_resampling": OP11_SQL, "op12_warc": OP12_SQL, "op13_merkle_manifest": OP13_SQL}
