"""The queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from startline.llm import op01_substring_dedup as op1
from startline.llm import op02_warc as op2
from startline.llm import op03_hmm as op3
from startline.llm import op04_exact_dedup as op4
from startline.llm import op05_decontaminate as op5
from startline.llm import op06_mixture as op6
from startline.llm import op07_toxicity as op7
from startline.llm import op08_language_id as op8
from startline.llm import op09_token_ids as op9
from startline.llm import op10_simhash as op10
from startline.llm import op11_ngram_join as op11
from startline.llm import op12_merkle as op12
from startline.llm import op13_filter_audit as op13


def queries() -> dict:
    import corpus_pipeline

    return {
        "op1_substring_dedup": op1.op1_substring_dedup,
        "op2_warc": op2.op2_warc,
        "op3_hmm_score": op3.op3_hmm_score,
        "op4_exact_dedup": op4.op4_exact_dedup,
        "op5_decontaminate": op5.op5_decontaminate,
        "op6_mix_sources": op6.op6_mix_sources,
        "op7_toxicity": op7.op7_toxicity,
        "op8_language_id": op8.op8_language_id,
        "op9_token_ids": op9.op9_token_ids,
        "op10_simhash": op10.op10_simhash,
        "op11_ngram_join": op11.op11_ngram_join,
        "op12_merkle": op12.op12_merkle,
        "op13_filter_audit": op13.op13_filter_audit,
        "pipeline": corpus_pipeline.run,
    }


def oracle_sql() -> dict[str, str]:
    import corpus_pipeline

    found = {"op1_substring_dedup": op1.SQL, "op2_warc": op2.SQL, "op4_exact_dedup": op4.SQL, "op5_decontaminate": op5.SQL, "op12_merkle": op12.SQL, "op13_filter_audit": op13.SQL, "pipeline": corpus_pipeline.ORACLE_SQL}
    return {k: v for k, v in found.items() if v}
