"""Queries of this subpackage, one for each operator, and the SQL of those that SQL can express."""

from __future__ import annotations

from laddersmith.llm import chat, decontaminate, merkle, near_dup, negatives
from laddersmith.llm.bpe import op7_byte_bpe
from laddersmith.llm.chat import op13_chat_format
from laddersmith.llm.decontaminate import op9_decontaminate
from laddersmith.llm.html_text import op2_html_text
from laddersmith.llm.license_scan import op8_license_scan
from laddersmith.llm.merkle import op11_merkle_manifest
from laddersmith.llm.near_dup import op3_minhash_near_dup
from laddersmith.llm.negatives import op12_hard_negatives
from laddersmith.llm.ppm import op5_ppm_lm
from laddersmith.llm.quality import op10_quality
from laddersmith.llm.suffix_dedup import op6_suffix_array_dedup
from laddersmith.llm.token_count import op4_token_counts
from laddersmith.llm.toxicity import op1_toxicity


def pipeline(spark, sf_dir):
    """The whole corpus pipeline (corpus_pipeline.py at the repository's top)."""
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


_QUERIES = [
    op1_toxicity,
    op2_html_text,
    op3_minhash_near_dup,
    op4_token_counts,
    op5_ppm_lm,
    op6_suffix_array_dedup,
    op7_byte_bpe,
    op8_license_scan,
    op9_decontaminate,
    op10_quality,
    op11_merkle_manifest,
    op12_hard_negatives,
    op13_chat_format,
    pipeline,
]
_SQL = {"op3_minhash_near_dup": near_dup.SQL, "op9_decontaminate": decontaminate.SQL, "op11_merkle_manifest": merkle.SQL, "op12_hard_negatives": negatives.SQL, "op13_chat_format": chat.SQL}


def queries() -> dict:
    return {f.__name__: f for f in _QUERIES}


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
