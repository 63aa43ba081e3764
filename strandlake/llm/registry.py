"""Queries of this package and, where SQL can express them, their SQL."""

from __future__ import annotations

import corpus_pipeline

from . import chat, metric_join, mixing, packing, quality, repeats, secrets, simhash, topk, warc


def queries() -> dict:
    return {
        "op1_topk": topk.op1_topk,
        "op2_chat": chat.op2_chat,
        "op3_secrets": secrets.op3_secrets,
        "op4_packing": packing.op4_packing,
        "op5_warc": warc.op5_warc,
        "op6_metric_join": metric_join.op6_metric_join,
        "op7_quality": quality.op7_quality,
        "op8_mixing": mixing.op8_mixing,
        "op9_repeats": repeats.op9_repeats,
        "op10_simhash": simhash.op10_simhash,
        "pipeline": corpus_pipeline.run,
    }


def oracle_sql() -> dict:
    found = {"op1_topk": topk.OP1_SQL, "op2_chat": chat.OP2_SQL, "op3_secrets": secrets.OP3_SQL, "op5_warc": warc.OP5_SQL, "op6_metric_join": metric_join.OP6_SQL}
    return found | ({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})
