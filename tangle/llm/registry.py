"""The queries of this subpackage, with SQL where SQL can express them."""

from __future__ import annotations

import corpus_pipeline

from . import fertility, htmltext, mixing, packing, quality, simhash, substrings, topk, toxicity, urlrules


def queries() -> dict:
    return {
        "pipeline": corpus_pipeline.run,
        "op1_substrings": substrings.op1,
        "op2_toxicity": toxicity.op2,
        "op3_mixing": mixing.op3,
        "op4_fertility": fertility.op4,
        "op5_packing": packing.op5,
        "op6_quality": quality.op6,
        "op7_topk": topk.op7,
        "op8_host_reputation": urlrules.op8,
        "op9_main_text": htmltext.op9,
        "op10_simhash": simhash.op10,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_substrings": substrings.ORACLE_SQL, "op7_topk": topk.ORACLE_SQL, "op8_host_reputation": urlrules.ORACLE_SQL}
