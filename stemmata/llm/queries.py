"""The queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from stemmata.llm.byte_bpe import op11_byte_bpe
from stemmata.llm.compact_windows import op9_compact_windows
from stemmata.llm.decontaminate import op1_decontaminate, op1_sql
from stemmata.llm.hard_negatives import op12_hard_negatives, op12_sql
from stemmata.llm.line_dedup import op6_line_dedup, op6_sql
from stemmata.llm.packing import op4_best_fit_packing
from stemmata.llm.quality_rules import op8_quality_rules
from stemmata.llm.sharding import op7_sharding, op7_sql
from stemmata.llm.simhash import op10_simhash
from stemmata.llm.substring_suffix import op3_suffix_dedup
from stemmata.llm.toxicity import op5_toxicity
from stemmata.llm.url_filter import op2_sql, op2_url_filter
from stemmata.llm.vector_codes import op13_sql, op13_vector_codes


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """corpus_pipeline.run(); the module lies beside the package and is imported when it runs."""
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    "op1_decontaminate": op1_decontaminate,
    "op2_url_filter": op2_url_filter,
    "op3_suffix_dedup": op3_suffix_dedup,
    "op4_best_fit_packing": op4_best_fit_packing,
    "op5_toxicity": op5_toxicity,
    "op6_line_dedup": op6_line_dedup,
    "op7_sharding": op7_sharding,
    "op8_quality_rules": op8_quality_rules,
    "op9_compact_windows": op9_compact_windows,
    "op10_simhash": op10_simhash,
    "op11_byte_bpe": op11_byte_bpe,
    "op12_hard_negatives": op12_hard_negatives,
    "op13_vector_codes": op13_vector_codes,
    "pipeline": pipeline,
}


def oracle_sql() -> dict[str, str]:
    return {"op1_decontaminate": op1_sql(), "op2_url_filter": op2_sql(), "op6_line_dedup": op6_sql(), "op7_sharding": op7_sql(), "op12_hard_negatives": op12_sql(), "op13_vector_codes": op13_sql()}
