"""Explicit schemas of what is read."""

from __future__ import annotations

LAW = (
    "name string, nature string, url string, last_amended string, effective_date string, abolished string, "
    "articles array<struct<no:string,chapter:string,content:string>>"
)
UNIT = (
    "unit_idx long, doc_id string, doc_title string, article_no string, chapter string, text string, "
    "source_path string, source_url string, last_amended string, effective_date string"
)
QUESTION = "qid string, question string, answer string, sources array<struct<doc:string,article:string>>, answerable boolean, q_type string"
UNIT_COLUMNS = [c.split()[0] for c in UNIT.split(", ")]
