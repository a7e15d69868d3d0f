"""The queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from marlstone.llm import bpe, chat, fixity, licenses, maxent, mixing, ngram_join, popcount, quality, secrets, sharding, topk, vector_codes

QUERIES = {
    "op1_bpe": bpe.op1_bpe,
    "op2_sharding": sharding.op2_sharding,
    "op3_ngram_join": ngram_join.op3_ngram_join,
    "op4_mixing": mixing.op4_mixing,
    "op5_topk": topk.op5_topk,
    "op6_fixity": fixity.op6_fixity,
    "op7_quality": quality.op7_quality,
    "op8_maxent": maxent.op8_maxent,
    "op9_secrets": secrets.op9_secrets,
    "op10_licenses": licenses.op10_licenses,
    "op11_chat": chat.op11_chat,
    "op12_popcount": popcount.op12_popcount,
    "op13_vector_codes": vector_codes.op13_vector_codes,
}

ORACLE = {
    "op3_ngram_join": ngram_join.ORACLE_SQL,
    "op4_mixing": mixing.ORACLE_SQL,
    "op5_topk": topk.ORACLE_SQL,
    "op6_fixity": fixity.ORACLE_SQL,
    "op7_quality": quality.ORACLE_SQL,
    "op11_chat": chat.ORACLE_SQL,
    "op12_popcount": popcount.ORACLE_SQL,
    "op13_vector_codes": vector_codes.ORACLE_SQL,
}
