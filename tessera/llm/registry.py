"""Queries of the corpus operators and, where SQL can express one, its SQL."""

from __future__ import annotations

from tessera.llm.brown import op7_brown_scores
from tessera.llm import collocations
from tessera.llm.collocations import op12_collocations
from tessera.llm.cross_tokenizer import op11_cross_tokenizer
from tessera.llm.decontaminate import op1_decontamination
from tessera.llm.html_text import op2_html_text
from tessera.llm.language import op6_language_id
from tessera.llm.minhash import op10_minhash
from tessera.llm.packing import op8_packing
from tessera.llm.pii import op5_pii
from tessera.llm.pu_quality import op4_quality_classifier
from tessera.llm.quality_rules import op9_quality_rules
from tessera.llm.substrings import op3_repeated_substrings
from tessera.llm.toxicity import op13_toxicity


def queries() -> dict:
    """Query name to function of (spark, sf_dir)."""
    found = [op1_decontamination, op2_html_text, op3_repeated_substrings, op4_quality_classifier, op5_pii, op6_language_id, op7_brown_scores, op8_packing, op10_minhash, op9_quality_rules, op11_cross_tokenizer, op12_collocations, op13_toxicity]
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    """Query name to DuckDB SQL."""
    return {"op12_collocations": collocations.ORACLE_SQL}
