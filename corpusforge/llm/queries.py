"""The queries of this subpackage and their SQL: what __spark_entry__ registers."""

from __future__ import annotations

from . import bpe, centroids, decontaminate, filter_audit, hnsw, html_extract, minhash, quality, secret_scan, sentence_piece, substring, suffix, toxicity

QUERIES = {
    "op1_html_extraction": html_extract.op1_html_extraction,
    "op2_secret_scan": secret_scan.op2_secret_scan,
    "op3_byte_bpe": bpe.op3_byte_bpe,
    "op4_substring_dedup": substring.op4_substring_dedup,
    "op5_decontamination": decontaminate.op5_decontamination,
    "op6_suffix_dedup": suffix.op6_suffix_dedup,
    "op7_quality": quality.op7_quality,
    "op8_minhash": minhash.op8_minhash,
    "op9_embedding_dedup": hnsw.op9_embedding_dedup,
    "op10_toxicity": toxicity.op10_toxicity,
    "op11_centroids": centroids.op11_centroids,
    "op12_sentence_piece": sentence_piece.op12_sentence_piece,
    "op13_filter_audit": filter_audit.op13_filter_audit,
}

ORACLES = {
    "op4_substring_dedup": substring.ORACLE,
    "op5_decontamination": decontaminate.ORACLE,
    "op6_suffix_dedup": suffix.ORACLE,
    "op8_minhash": minhash.ORACLE,
    "op11_centroids": centroids.ORACLE,
    "op13_filter_audit": filter_audit.ORACLE,
}
