"""The subpackage's queries and their DuckDB SQL, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from echotrace.llm.byte_bpe import op3_byte_bpe
from echotrace.llm.exact_digest import op4_exact_digest
from echotrace.llm.importance import op13_importance_resampling
from echotrace.llm.mixing import OP12_SQL, op12_source_mix
from echotrace.llm.page_templates import op5_page_templates
from echotrace.llm.packing import op7_best_fit_packing
from echotrace.llm.prefix_forest import op9_prefix_forest
from echotrace.llm.quality import op1_quality_classifier
from echotrace.llm.shards import op10_size_tiered_shards
from echotrace.llm.simhash import op2_simhash_near_dedup
from echotrace.llm.spelling import op11_spelling_variants
from echotrace.llm.token_frames import op6_token_frames
from echotrace.llm.toxicity import op8_toxicity_cnn

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality_classifier": op1_quality_classifier,
    "op2_simhash_near_dedup": op2_simhash_near_dedup,
    "op3_byte_bpe": op3_byte_bpe,
    "op4_exact_digest": op4_exact_digest,
    "op5_page_templates": op5_page_templates,
    "op6_token_frames": op6_token_frames,
    "op7_best_fit_packing": op7_best_fit_packing,
    "op8_toxicity_cnn": op8_toxicity_cnn,
    "op9_prefix_forest": op9_prefix_forest,
    "op10_size_tiered_shards": op10_size_tiered_shards,
    "op11_spelling_variants": op11_spelling_variants,
    "op12_source_mix": op12_source_mix,
    "op13_importance_resampling": op13_importance_resampling,
}

SQL: dict[str, str] = {"op12_source_mix": OP12_SQL}
