"""The registered queries over text corpora and, where SQL can state them, the SQL."""

from __future__ import annotations

import corpus_pipeline

from . import bpe, exact, licenses, lines, near, packing, quality, suffixtree, toxicity, urls


def queries() -> dict:
    return {
        "op1_line_dedup": lines.op1_line_dedup,
        "op2_packing": packing.op2_packing,
        "op3_url_filter": urls.op3_url_filter,
        "op4_near_dedup": near.op4_near_dedup,
        "op5_lm_score": suffixtree.op5_lm_score,
        "op6_exact_dedup": exact.op6_exact_dedup,
        "op7_byte_bpe": bpe.op7_byte_bpe,
        "op8_license_scan": licenses.op8_license_scan,
        "op9_quality_rules": quality.op9_quality_rules,
        "op9_rule_ablations": quality.op9_rule_ablations,
        "op10_toxicity": toxicity.op10_toxicity,
        "pipeline": corpus_pipeline.run,
    }


def oracle_sql() -> dict:
    found = {"op3_url_filter": urls.OP3_SQL, "op6_exact_dedup": exact.OP6_SQL, "op8_license_scan": licenses.OP8_SQL, "op9_quality_rules": quality.OP9_SQL, "op9_rule_ablations": quality.OP9_ABLATIONS_SQL}
    if corpus_pipeline.ORACLE_SQL:
        found["pipeline"] = corpus_pipeline.ORACLE_SQL
    return found
