"""Model answers: finding, checking and replacing their JSON."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schemas import ANSWER, AUDIT
from .patterns import SPACE
from .text import let, strip

FENCED = rf"(?s)```(?:json)?[{SPACE}]*(\{{.*?\}})[{SPACE}]*```"
BRACED = r"(?s)\{.*\}"
FENCES = rf"```json[{SPACE}]*|[{SPACE}]*```"

# Texts that stand in for an answer.
NO_ANSWER = "I couldn't find relevant information to answer your question."
NOTHING_FOUND = "No relevant information found in the database."
ANSWER_ERROR = "Sorry, I encountered an error processing your request."
PARSE_FAILED = "Failed to parse AI response"
NO_CLAIMS = "No sustainability claims found in document"
AUDIT_FAILED = "Audit failed: "
RETRIES = "Max retries exceeded"
NO_CANDIDATES = "No response candidates"
REVIEW_FAILED = "Could not evaluate due to processing error"


def is_json(c: Column) -> Column:
    """True where the text is JSON. `from_json` alone cannot tell: it returns a struct of nulls."""
    return F.try_parse_json(c).isNotNull()


def json_text(raw: Column) -> Column:
    """The JSON inside an answer: the whole text, else a fenced block, else the outermost braces."""
    def first_valid(text: Column) -> Column:
        fenced, braced = F.regexp_extract(text, FENCED, 1), F.regexp_extract(text, BRACED, 0)
        return (
            F.when(is_json(text), text)
            .when((fenced != "") & is_json(fenced), fenced)
            .when((braced != "") & is_json(braced), braced)
        )
    return let(strip(raw), first_valid)


def parse_audit(raw: Column) -> Column:
    """Audit struct, or null where no JSON object with a score and reviews is found."""
    def build(j: Column) -> Column:
        keys = F.json_object_keys(j)
        complete = F.array_contains(keys, "overall_score") & F.array_contains(keys, "claim_reviews")
        return F.when(F.coalesce(complete, F.lit(False)), F.from_json(j, AUDIT, {"mode": "PERMISSIVE"}))
    return let(json_text(raw), build)


def is_valid_audit(audit: Column) -> Column:
    """Overall score 1 to 5, and every review names a claim and a score 1 to 5."""
    reviews_ok = F.forall(audit["claim_reviews"], lambda r: F.coalesce(
        r["claim"].isNotNull() & r["score"].between(1, 5), F.lit(False)))
    return F.coalesce(audit["overall_score"].between(1, 5) & reviews_ok, F.lit(False))


def fallback_reviews(claims: Column) -> Column:
    """One unscored review per claim (`claims` is an array of structs with claim and page)."""
    return F.transform(claims, lambda c: F.struct(
        F.coalesce(c["claim"], F.lit("Unknown")).alias("claim"), c["page"].alias("page"),
        F.lit(None).cast("double").alias("score"), F.lit(REVIEW_FAILED).alias("reason"),
        F.array().cast("array<int>").alias("citations")))


def audit_struct(score: Column, summary: Column, reviews: Column) -> Column:
    return F.struct(
        score.alias("overall_score"), summary.alias("overall_summary"), reviews.alias("claim_reviews")).cast(AUDIT)


def parse_answer(raw: Column) -> Column:
    """Answer struct; a text that is no JSON object gives a fixed low-confidence answer."""
    failed = F.struct(
        F.lit(ANSWER_ERROR).alias("answer"),
        F.array().cast("array<struct<company:string,year:int,page:int,quote:string>>").alias("citations"),
        F.lit("low").alias("confidence")).cast(ANSWER)
    clean = strip(F.regexp_replace(strip(raw), FENCES, ""))
    return let(clean, lambda t: F.when(
        F.coalesce(F.json_object_keys(t).isNotNull() & is_json(t), F.lit(False)),
        F.from_json(t, ANSWER, {"mode": "PERMISSIVE"})).otherwise(failed))
