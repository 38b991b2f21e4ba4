"""Queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

import corpus_pipeline

from . import bpe, chat, contamination, embeddings, html, lines, minhash, negatives, quality, records, secrets, spans, vafile

QUERIES = {
    "op1_chat_formatting": chat.op1_chat_formatting,
    "op2_embedding_near_dedup": embeddings.op2_embedding_near_dedup,
    "op3_minhash_near_dedup": minhash.op3_minhash_near_dedup,
    "op4_benchmark_decontamination": contamination.op4_benchmark_decontamination,
    "op5_secret_scan": secrets.op5_secret_scan,
    "op6_quality_classifier": quality.op6_quality_classifier,
    "op7_substring_dedup": spans.op7_substring_dedup,
    "op8_bpe_encoding": bpe.op8_bpe_encoding,
    "op9_token_records": records.op9_token_records,
    "op10_html_extraction": html.op10_html_extraction,
    "op11_line_dedup": lines.op11_line_dedup,
    "op12_centroid_clustering": vafile.op12_centroid_clustering,
    "op13_hard_negatives": negatives.op13_hard_negatives,
    "pipeline": corpus_pipeline.run,
}

ORACLE_SQL: dict[str, str] = {
    "op1_chat_formatting": chat.OP1_SQL,
    "op4_benchmark_decontamination": contamination.OP4_SQL,
    "op5_secret_scan": secrets.OP5_SQL,
    "op11_line_dedup": lines.OP11_SQL,
    "op12_centroid_clustering": vafile.OP12_SQL,
    "op13_hard_negatives": negatives.OP13_SQL,
}
