"""Queries of this subpackage and their DuckDB SQL, as `__spark_entry__` registers them."""

from __future__ import annotations

import corpus_pipeline
from lexspan.llm import bpe, decontaminate, divergence, fim, html_extract, jaccard, licenses, line_dedup, media, mixing, tokens, toxicity, warc


def queries() -> dict:
    return {
        "op1_ngram_jaccard": jaccard.op1_ngram_jaccard,
        "op2_decontaminate": decontaminate.op2_decontaminate,
        "op3_line_dedup": line_dedup.op3_line_dedup,
        "op4_media": media.op4_media,
        "op5_toxicity": toxicity.op5_toxicity,
        "op6_html_text": html_extract.op6_html_text,
        "op7_warc_revisits": warc.op7_warc_revisits,
        "op8_token_ids": tokens.op8_token_ids,
        "op9_mixing": mixing.op9_mixing,
        "op10_licenses": licenses.op10_licenses,
        "op11_divergence": divergence.op11_divergence,
        "op12_bpe": bpe.op12_bpe,
        "op13_fim": fim.op13_fim,
        "pipeline": corpus_pipeline.run,
    }


def oracle_sql() -> dict:
    return {
        "op1_ngram_jaccard": jaccard.BRUTE_SQL,
        "op2_decontaminate": decontaminate.ORACLE_SQL,
        "op3_line_dedup": line_dedup.ORACLE_SQL,
        "op7_warc_revisits": warc.ORACLE_SQL,
        "op9_mixing": mixing.ORACLE_SQL,
        "op11_divergence": divergence.ORACLE_SQL,
        "op13_fim": fim.ORACLE_SQL,
    }
