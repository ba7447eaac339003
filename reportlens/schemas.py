"""Schemas of every table that crosses a file or a stream. Nothing is inferred."""

from __future__ import annotations

METRIC = "struct<value:double,unit:string,page:int,source:string>"
METRICS = f"array<{METRIC}>"
EVIDENCE = (
    "struct<has_target_year:boolean,target_year:int,has_numeric_data:boolean,numeric_count:int,"
    "has_commitment_language:boolean,commitment_words:array<string>,key_phrases:array<string>>"
)
CLAIM_METRICS = f"struct<scope1:{METRICS},scope2:{METRICS},scope3:{METRICS},generic:{METRICS}>"

REPORT_PAGES = (
    "document_id string, company string, year int, page int, text string, "
    "tables array<array<array<string>>>"
)
PAGE_METRICS = (
    "document_id string, company string, year int, page int, "
    f"scope1 {METRICS}, scope2 {METRICS}, scope3 {METRICS}, total {METRICS}, generic {METRICS}"
)
CLAIMS = (
    "document_id string, company string, year int, page int, keyword_ord int, claim string, "
    f"target_year int, context string, evidence {EVIDENCE}, metrics {CLAIM_METRICS}"
)
UPLOADS = "id string, filename string, company string, year int, uploaded_at timestamp"
REVIEW = "struct<claim:string,page:int,score:double,reason:string,citations:array<int>>"
AUDIT = f"struct<overall_score:double,overall_summary:string,claim_reviews:array<{REVIEW}>>"
AUDIT_RESPONSES = "document_id string, raw_text string, error string"
ANSWER = (
    "struct<answer:string,citations:array<struct<company:string,year:int,page:int,quote:string>>,"
    "confidence:string>"
)
CHUNKS = (
    "chunk_id string, document_id string, company string, year int, page int, chunk_index int, "
    "content string, embedding array<float>, metadata map<string,string>"
)
ERRORS = "document_id string, error_type string, message string, worker string, timestamp timestamp"
