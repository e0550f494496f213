"""The registered queries of this subpackage, and SQL for those that have it."""

from __future__ import annotations

from factloom.llm.bpe import op2_byte_level_bpe
from factloom.llm.fingerprint import op3_document_fingerprints
from factloom.llm.html import op7_html_extraction
from factloom.llm.mixing import op4_mixing_to_targets
from factloom.llm.negatives import OP11_SQL, op11_hard_negatives
from factloom.llm.neighbours import op8_nearest_neighbours
from factloom.llm.quality import op5_quality_classifier
from factloom.llm.simhash import op10_simhash_near_dedup
from factloom.llm.spelling import OP12_SQL, op12_spelling_variants
from factloom.llm.substring import OP1_SQL, op1_substring_dedup
from factloom.llm.tokenfiles import op9_token_files
from factloom.llm.toxicity import op6_toxicity
from factloom.llm.urls import op13_url_filters

QUERIES = {
    "op1_substring_dedup": op1_substring_dedup,
    "op2_byte_level_bpe": op2_byte_level_bpe,
    "op3_document_fingerprints": op3_document_fingerprints,
    "op4_mixing_to_targets": op4_mixing_to_targets,
    "op5_quality_classifier": op5_quality_classifier,
    "op6_toxicity": op6_toxicity,
    "op7_html_extraction": op7_html_extraction,
    "op8_nearest_neighbours": op8_nearest_neighbours,
    "op9_token_files": op9_token_files,
    "op10_simhash_near_dedup": op10_simhash_near_dedup,
    "op11_hard_negatives": op11_hard_negatives,
    "op12_spelling_variants": op12_spelling_variants,
    "op13_url_filters": op13_url_filters,
}


def pipeline(spark, sf_dir):
    """The corpus pipeline, which lies at the top of the repository."""
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES["pipeline"] = pipeline

SQL: dict[str, str] = {"op1_substring_dedup": OP1_SQL, "op11_hard_negatives": OP11_SQL, "op12_spelling_variants": OP12_SQL}
