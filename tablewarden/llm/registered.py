"""The queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

import corpus_pipeline

from . import decontamination, jaccard, licenses, lines, mixing, negatives, packing, quality, ranking, sharding, suffixes, toxicity, vectors


def queries():
    return {
        "op1_license_scan": licenses.op1,
        "op2_sharding": sharding.op2,
        "op3_mixing": mixing.op3,
        "op4_packing": packing.op4,
        "op5_suffix_dedup": suffixes.op5,
        "op6_line_dedup": lines.op6,
        "op7_quality_rules": quality.op7,
        "op8_jaccard_join": jaccard.op8,
        "op9_toxicity": toxicity.op9,
        "op10_embedding_dedup": vectors.op10,
        "op11_lexical_search": ranking.op11,
        "op12_hard_negatives": negatives.op12,
        "op13_decontamination": decontamination.op13,
        "pipeline": corpus_pipeline.run,
    }


def oracle_sql():
    return {
        "op7_quality_rules": quality.ORACLE,
        "op11_lexical_search": ranking.ORACLE,
        "op12_hard_negatives": negatives.ORACLE,
        "op13_decontamination": decontamination.ORACLE,
    }
