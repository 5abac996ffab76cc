"""The queries of this subpackage and, where SQL can express one, its SQL for the same tables."""

from __future__ import annotations

from . import chat, conversation_repair, embedding_join, exact_dedup, html_extract, merkle, ngram_join, packing, pieces, quality, token_file, toxicity, warc

QUERIES = {
    "op1_html_extract": html_extract.op1_html_extract,
    "op2_sentencepiece": pieces.op2_sentencepiece,
    "op3_best_fit_packing": packing.op3_best_fit_packing,
    "op4_embedding_dedup": embedding_join.op4_embedding_dedup,
    "op5_warc": warc.op5_warc,
    "op6_chat_format": chat.op6_chat_format,
    "op7_ngram_join": ngram_join.op7_ngram_join,
    "op8_token_file": token_file.op8_token_file,
    "op9_quality": quality.op9_quality,
    "op10_exact_dedup": exact_dedup.op10_exact_dedup,
    "op11_toxicity": toxicity.op11_toxicity,
    "op12_conversation_repair": conversation_repair.op12_conversation_repair,
    "op13_merkle_manifest": merkle.op13_merkle_manifest,
}

ORACLES = {
    "op5_warc": warc.ORACLE,
    "op6_chat_format": chat.ORACLE,
    "op7_ngram_join": ngram_join.ORACLE,
    "op10_exact_dedup": exact_dedup.ORACLE,
    "op12_conversation_repair": conversation_repair.ORACLE,
    "op13_merkle_manifest": merkle.ORACLE,
}
