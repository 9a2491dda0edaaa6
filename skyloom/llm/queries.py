"""Queries and oracle SQL of the training-data operators, by registered name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from skyloom.llm.align import op12_alignment
from skyloom.llm.decontaminate import ORACLE as OP7_ORACLE, op7_decontamination
from skyloom.llm.interaction import ORACLE as OP13_ORACLE, op13_interaction_audit
from skyloom.llm.katz import op10_katz
from skyloom.llm.language import op5_language
from skyloom.llm.media import op3_media
from skyloom.llm.ngram_join import ORACLE as OP1_ORACLE, op1_ngram_join
from skyloom.llm.packing import op6_packing
from skyloom.llm.pii import op2_pii
from skyloom.llm.quality import op4_quality
from skyloom.llm.rollup import op8_token_counts
from skyloom.llm.rules import ORACLE as OP11_ORACLE, op11_quality_rules
from skyloom.llm.toxicity import op9_toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_ngram_join": op1_ngram_join,
    "op2_pii": op2_pii,
    "op3_media": op3_media,
    "op4_quality": op4_quality,
    "op5_language": op5_language,
    "op6_packing": op6_packing,
    "op7_decontamination": op7_decontamination,
    "op8_token_counts": op8_token_counts,
    "op9_toxicity": op9_toxicity,
    "op10_katz": op10_katz,
    "op11_quality_rules": op11_quality_rules,
    "op12_alignment": op12_alignment,
    "op13_interaction_audit": op13_interaction_audit,
}

ORACLES: dict[str, str] = {
    "op1_ngram_join": OP1_ORACLE,
    "op7_decontamination": OP7_ORACLE,
    "op11_quality_rules": OP11_ORACLE,
    "op13_interaction_audit": OP13_ORACLE,
}
