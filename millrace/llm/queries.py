"""The registered queries of the training-data operators and their SQL."""

from __future__ import annotations

from millrace.llm import chat, decontam, html_text, line_dedup, packing, quality, simhash, token_files, url_lm, warc
from millrace.llm._shared import Query


def queries() -> dict[str, Query]:
    return {
        "op1_token_files": token_files.query,
        "op2_warc_salvage": warc.query,
        "op3_html_text": html_text.query,
        "op4_quality_repetition": quality.query,
        "op5_line_dedup": line_dedup.query,
        "op6_best_fit_packing": packing.query,
        "op7_simhash": simhash.query,
        "op8_url_language_model": url_lm.query,
        "op9_decontamination": decontam.query,
        "op10_chat_format": chat.query,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op2_warc_salvage": warc.ORACLE_SQL,
        "op3_html_text": html_text.ORACLE_SQL,
        "op4_quality_repetition": quality.ORACLE_SQL,
        "op5_line_dedup": line_dedup.ORACLE_SQL,
        "op8_url_language_model": url_lm.ORACLE_SQL,
        "op9_decontamination": decontam.ORACLE_SQL,
        "op10_chat_format": chat.ORACLE_SQL,
    }
