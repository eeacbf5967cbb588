"""Registered queries of this folder and their DuckDB oracles."""

from __future__ import annotations

from seqlab.llm import (
    chat, collocations, decontaminate, fingerprint, fixity, langid, lmscore, mixing, neardup, passages, reshard, tokencount, veccodes,
)

QUERIES = {
    "op1_lm_score": lmscore.op1_lm_score,
    "op2_fixity_audit": fixity.op2_fixity_audit,
    "op4_token_counts": tokencount.op4_token_counts,
    "op3_repeated_passages": passages.op3_repeated_passages,
    "op5_decontaminate": decontaminate.op5_decontaminate,
    "op6_fingerprint": fingerprint.op6_fingerprint,
    "op7_language_id": langid.op7_language_id,
    "op8_near_duplicates": neardup.op8_near_duplicates,
    "op9_chat_windows": chat.op9_chat_windows,
    "op10_mix_sources": mixing.op10_mix_sources,
    "op11_reshard": reshard.op11_reshard,
    "op12_collocations": collocations.op12_collocations,
    "op13_vector_codes": veccodes.op13_vector_codes,
}

ORACLES = {
    "op1_lm_score": lmscore.OP1_SQL_3,
    "op2_fixity_audit": fixity.OP2_SQL,
    "op9_chat_windows": chat.OP9_SQL,
    "op10_mix_sources": mixing.OP10_SQL,
    "op11_reshard": reshard.OP11_SQL,
    "op12_collocations": collocations.OP12_SQL,
    "op13_vector_codes": veccodes.OP13_SQL,
}
