"""Queries of the training-data operators and their SQL, by name; __spark_entry__ adds them to its own."""

from __future__ import annotations

from redactum.llm import chat, decontaminate, language_id, packing, quality, secrets, simhash, token_counts, token_store, topk

QUERIES = {
    "op1_token_store": token_store.op1_token_store,
    "op2_chat_links": chat.op2_chat_links,
    "op3_quality": quality.op3_quality,
    "op4_packing": packing.op4_packing,
    "op5_simhash": simhash.op5_simhash,
    "op6_token_counts": token_counts.op6_token_counts,
    "op7_secret_scan": secrets.op7_secret_scan,
    "op8_decontaminate": decontaminate.op8_decontaminate,
    "op9_language_id": language_id.op9_language_id,
    "op10_topk": topk.op10_topk,
}

ORACLE_SQL: dict[str, str] = {
    "op2_chat_links": chat.OP2_SQL,
    "op8_decontaminate": decontaminate.OP8_SQL,
    "op10_topk": topk.OP10_SQL,
}
