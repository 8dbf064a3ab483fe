"""The queries of this folder, and the SQL of those that SQL can express."""

from __future__ import annotations

from rowloom.llm import chat, jaccard, langid, linededup, mixing, packing, quality, sharding, topk, toxicity

QUERIES = {
    "op1_chat_format": chat.op1_chat_format,
    "op2_pack_windows": packing.op2_pack_windows,
    "op3_line_dedup": linededup.op3_line_dedup,
    "op4_language_id": langid.op4_language_id,
    "op5_quality_rules": quality.op5_quality_rules,
    "op6_exact_topk": topk.op6_exact_topk,
    "op7_kd_shards": sharding.op7_kd_shards,
    "op8_jaccard_join": jaccard.op8_jaccard_join,
    "op9_mix_sources": mixing.op9_mix_sources,
    "op10_toxicity": toxicity.op10_toxicity,
}
SQL = {
    "op1_chat_format": chat.OP1_SQL,
    "op3_line_dedup": linededup.OP3_SQL,
    "op5_quality_rules": quality.OP5_SQL,
    "op6_exact_topk": topk.OP6_SQL,
    "op8_jaccard_join": jaccard.OP8_SQL,
    "op9_mix_sources": mixing.OP9_SQL,
}
