"""The queries of this subpackage by name, and their SQL where SQL can express them."""

from __future__ import annotations

import corpus_pipeline

from . import decontaminate, exact_dedup, line_dedup, mixing, quality, simhash, substring_dedup, token_counts, url_filter, warc


def queries() -> dict:
    return {
        "op1_token_counts": token_counts.op1_token_counts,
        "op2_exact_dedup": exact_dedup.op2_exact_dedup,
        "op3_substring_dedup": substring_dedup.op3_substring_dedup,
        "op4_quality_classifier": quality.op4_quality_classifier,
        "op5_simhash": simhash.op5_simhash,
        "op6_mixing": mixing.op6_mixing,
        "op7_warc": warc.op7_warc,
        "op8_url_filters": url_filter.op8_url_filters,
        "op9_decontaminate": decontaminate.op9_decontaminate,
        "op10_line_dedup": line_dedup.op10_line_dedup,
        "pipeline": corpus_pipeline.run,
    }


def oracle_sql() -> dict:
    return {"op2_exact_dedup": exact_dedup.SQL, "op8_url_filters": url_filter.SQL, "op9_decontaminate": decontaminate.SQL, "op10_line_dedup": line_dedup.SQL}
