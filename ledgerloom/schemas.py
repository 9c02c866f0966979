"""Schemas of the inputs and records."""

from __future__ import annotations

_TEXTS = "array<string>"

RECENT = (
    f"accessionNumber {_TEXTS}, filingDate {_TEXTS}, reportDate {_TEXTS}, acceptanceDateTime {_TEXTS}, act {_TEXTS}, form {_TEXTS}, "
    f"fileNumber {_TEXTS}, filmNumber {_TEXTS}, items {_TEXTS}, size array<bigint>, isXBRL array<int>, isXRBL array<int>, "
    f"isInlineXBRL array<int>, isInlineXRBL array<int>, primaryDocument {_TEXTS}, primaryDocDescription {_TEXTS}"
)

#: A company's submissions: its description and its recent filings as parallel arrays.
SUBMISSIONS = (
    "cik string, entityType string, sic string, sicDescription string, name string, tickers array<string>, exchanges array<string>, "
    f"filings struct<recent:struct<{', '.join(x.strip().replace(' ', ':', 1) for x in RECENT.split(','))}>>"
)

FILING = "cik string, accession_number string, form_type string, acceptance_date timestamp, primary_document string, is_xbrl boolean"
TICKER_MAP = "ticker string, cik string"
CHUNK = "doc_id string, chunk_pos int, start_index int, text string"
SUMMARY_INPUT = "symbol string, chunk string, search_term string"
POINT = "id string, vector array<float>, source string, symbol string, keyword string, text string"
