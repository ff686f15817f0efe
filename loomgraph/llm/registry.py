"""The contract queries of this subpackage and their DuckDB twins."""

from __future__ import annotations

from . import bpe, chat, exact_dedup, html_text, media, mixing, sharding, simhash, suffix_dedup, toxicity

QUERIES = {
    "op1_exact_dedup": exact_dedup.op1_exact_dedup,
    "op2_bpe": bpe.op2_bpe,
    "op3_simhash": simhash.op3_simhash,
    "op4_html": html_text.op4_html,
    "op5_media": media.op5_media,
    "op6_toxicity": toxicity.op6_toxicity,
    "op7_chat": chat.op7_chat,
    "op8_suffix_dedup": suffix_dedup.op8_suffix_dedup,
    "op9_mixing": mixing.op9_mixing,
    "op10_sharding": sharding.op10_sharding,
}

ORACLES: dict[str, str] = {
    "op1_exact_dedup": exact_dedup.OP1_SQL,
    "op7_chat": chat.OP7_SQL,
}
