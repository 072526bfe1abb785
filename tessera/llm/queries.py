"""The registered queries of this subpackage, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessera.llm.alignment import op13_token_alignment
from tessera.llm.html import op9_html_extraction
from tessera.llm.lempel_ziv import op4_lempel_ziv
from tessera.llm.media import op2_media_columns
from tessera.llm.merkle import OP11_SQL, op11_merkle_manifest
from tessera.llm.mixing import OP7_SQL, op7_poisson_mixing
from tessera.llm.packing import op3_best_fit_packing
from tessera.llm.pii import op8_pii
from tessera.llm.quality import op10_quality
from tessera.llm.simhash import op1_simhash_near_dedup
from tessera.llm.suffix_dedup import op12_suffix_dedup
from tessera.llm.token_counts import op6_token_counts
from tessera.llm.toxicity import op5_toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_simhash_near_dedup": op1_simhash_near_dedup,
    "op2_media_columns": op2_media_columns,
    "op3_best_fit_packing": op3_best_fit_packing,
    "op4_lempel_ziv": op4_lempel_ziv,
    "op5_toxicity": op5_toxicity,
    "op6_token_counts": op6_token_counts,
    "op7_poisson_mixing": op7_poisson_mixing,
    "op8_pii": op8_pii,
    "op9_html_extraction": op9_html_extraction,
    "op10_quality": op10_quality,
    "op11_merkle_manifest": op11_merkle_manifest,
    "op12_suffix_dedup": op12_suffix_dedup,
    "op13_token_alignment": op13_token_alignment,
}

ORACLES: dict[str, str] = {"op7_poisson_mixing": OP7_SQL, "op11_merkle_manifest": OP11_SQL}
