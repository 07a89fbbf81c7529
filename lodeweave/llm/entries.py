"""The corpus queries and their SQL, by name."""

from __future__ import annotations

from . import decontaminate, html, langid, lm, neardup, packing, pii, quality, secrets, sentences

QUERIES = {f.__name__: f for f in (
    secrets.op1_secret_scan, quality.op2_quality_rules, decontaminate.op3_decontamination, packing.op4_packing, html.op5_html_extraction,
    neardup.op6_near_duplicates, langid.op7_language_id, sentences.op8_sentence_spans, lm.op9_lm_scoring, pii.op10_personal_data,
)}
ORACLE_SQL = {"op8_sentence_spans": sentences.ORACLE}
