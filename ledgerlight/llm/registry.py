"""The queries of the training-data operators and their SQL."""

from __future__ import annotations

from ledgerlight.llm import embeddings, html, lines, media, mixing, packing, quality, shards, simhash, toxicity

QUERIES = {
    "op1_mix": mixing.op1_mix,
    "op2_quality": quality.op2_quality,
    "op3_embeddings": embeddings.op3_embeddings,
    "op4_html": html.op4_html,
    "op5_shards": shards.op5_shards,
    "op6_gif": media.op6_gif,
    "op7_simhash": simhash.op7_simhash,
    "op8_toxicity": toxicity.op8_toxicity,
    "op9_lines": lines.op9_lines,
    "op10_pack": packing.op10_pack,
}
ORACLES: dict[str, str] = {
    "op9_lines": lines.SQL,
}
