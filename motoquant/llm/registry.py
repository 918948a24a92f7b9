"""Registered queries of this package and their SQL."""

from __future__ import annotations

from motoquant.llm import decontamination, line_dedup, substring_dedup
from motoquant.llm.cotraining import op9_cotraining
from motoquant.llm.decontamination import op4_decontamination
from motoquant.llm.jaccard_join import op2_jaccard_join
from motoquant.llm.language_id import op12_language_id
from motoquant.llm.line_dedup import op7_line_dedup
from motoquant.llm.packing import op10_best_fit_packing
from motoquant.llm.quality import op1_quality_rules
from motoquant.llm.sharding import op8_sharding
from motoquant.llm.spelling import op11_spelling_variants
from motoquant.llm.substring_dedup import op6_substring_dedup
from motoquant.llm.toxicity import op5_toxicity
from motoquant.llm.url_rules import op3_url_rules
from motoquant.llm.whitening import op13_embedding_whitening

QUERIES = {
    "op1_quality_rules": op1_quality_rules,
    "op2_jaccard_join": op2_jaccard_join,
    "op3_url_rules": op3_url_rules,
    "op4_decontamination": op4_decontamination,
    "op5_toxicity": op5_toxicity,
    "op6_substring_dedup": op6_substring_dedup,
    "op7_line_dedup": op7_line_dedup,
    "op8_sharding": op8_sharding,
    "op9_cotraining": op9_cotraining,
    "op10_best_fit_packing": op10_best_fit_packing,
    "op11_spelling_variants": op11_spelling_variants,
    "op12_language_id": op12_language_id,
    "op13_embedding_whitening": op13_embedding_whitening,
}

ORACLES: dict[str, str] = {
    "op4_decontamination": decontamination.ORACLE,
    "op6_substring_dedup": substring_dedup.ORACLE,
    "op7_line_dedup": line_dedup.ORACLE,
}
