"""The subpackage's queries and their SQL."""

from __future__ import annotations

import corpus_pipeline

from . import bpe, decontam, embed_dedup, fingerprint, html_extract, langid, line_dedup, lm_score, near_dup, prefix_trie, token_align, toxicity, warc


def queries() -> dict:
    return {
        "op1_html_extraction": html_extract.op1_html_extraction,
        "op2_decontamination": decontam.op2_decontamination,
        "op3_bpe": bpe.op3_bpe,
        "op4_toxicity": toxicity.op4_toxicity,
        "op5_embedding_dedup": embed_dedup.op5_embedding_dedup,
        "op6_line_dedup": line_dedup.op6_line_dedup,
        "op7_lm_score": lm_score.op7_lm_score,
        "op8_warc": warc.op8_warc,
        "op9_langid": langid.op9_langid,
        "op10_minhash": near_dup.op10_minhash,
        "op11_token_alignment": token_align.op11_token_alignment,
        "op12_prefix_trie": prefix_trie.op12_prefix_trie,
        "op13_fingerprint": fingerprint.op13_fingerprint,
        "pipeline": corpus_pipeline.run,
    }


def oracle_sql() -> dict[str, str]:
    return {**decontam.ORACLE, **embed_dedup.ORACLE, **line_dedup.ORACLE, **warc.ORACLE, **near_dup.ORACLE, **prefix_trie.ORACLE, **fingerprint.ORACLE}
