"""The queries of this package and, where SQL can express them, their oracles."""

from __future__ import annotations

from . import bpe, chat, mixing, near_dup, pii, quality, topk, urls, vectors, warc

QUERIES = {
    "op1_warc": warc.op1_warc,
    "op2_urls": urls.op2_urls,
    "op3_quality": quality.op3_quality,
    "op4_pii": pii.op4_pii,
    "op5_near_dup": near_dup.op5_near_dup,
    "op6_chat": chat.op6_chat,
    "op7_bpe": bpe.op7_bpe,
    "op8_mixing": mixing.op8_mixing,
    "op9_vectors": vectors.op9_vectors,
    "op10_topk": topk.op10_topk,
    "pii_base": pii.pii_base,
}

ORACLES = {
    "op1_warc": warc.OP1_SQL,
    "op2_urls": urls.OP2_SQL,
    "op5_near_dup": near_dup.OP5_SQL,
    "pii_base": pii.PII_BASE_SQL,
    "op6_chat": chat.OP6_SQL,
    "op8_mixing": mixing.OP8_SQL,
    "op9_vectors": vectors.OP9_SQL,
    "op10_topk": topk.OP10_SQL,
}
