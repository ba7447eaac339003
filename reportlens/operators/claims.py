"""Claims: detection on pages, evidence, scoring and selection per report."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import taxonomy as tx
from ..functions.text import claim_contexts, each, evidence, evidence_signals, let, normalize_unit_py, raw_sentences, with_known
from .extract import no_metrics


def present_keywords(text: Column, keywords: list[str], word_boundary: bool = False) -> Column:
    """Keywords contained in the text with their 0-based position.

    The text is lower-cased once per page and every keyword is a literal, so this is one pass
    over the page in its own task: pages are never joined with the taxonomy. Words that keywords
    share are sought first, since most pages hold few of them.
    """
    groups = tx.keyword_structs(keywords)

    def located(lower: Column) -> Column:
        likely = F.flatten(F.transform(F.filter(groups, lambda g: lower.contains(g["word"])), lambda g: g["keywords"]))
        hits = F.transform(
            F.sort_array(F.filter(likely, lambda k: lower.contains(k["needle"]))),
            lambda k: F.struct(
                k["keyword_ord"].alias("keyword_ord"), k["claim"].alias("claim"), k["needle"].alias("needle"),
                k["base"].alias("base"), (F.instr(lower, k["needle"]) - 1).alias("at")))
        if not word_boundary:
            return hits
        return F.filter(hits, lambda k: F.rlike(
            lower, F.concat(F.lit(r"(?<![\p{L}\p{N}])\Q"), k["needle"], F.lit(r"\E(?![\p{L}\p{N}])"))))
    return let(F.lower(text), located)


def first_per_base(hits: Column) -> Column:
    """Of the keywords on one page keep the first per base form; at most one entry per keyword."""
    return let(F.transform(hits, lambda k: k["base"]), lambda bases: F.filter(
        hits, lambda k, i: F.array_position(bases, k["base"]) == i + 1))


def page_hits(keywords: list[str], distinct_base: bool = False, word_boundary: bool = False) -> Column:
    """Keywords on the page of the row; with `distinct_base` the first per base form."""
    hits = present_keywords(F.coalesce("text", F.lit("")), keywords, word_boundary)
    return let(hits, first_per_base) if distinct_base else hits


def claim_keywords_on_pages(pages: DataFrame, keywords: list[str] | None = None,
                            distinct_base: bool = False, word_boundary: bool = False) -> DataFrame:
    """One row per (page, keyword), the page's columns kept."""
    words = tx.claim_keywords() if keywords is None else keywords
    return (
        pages.withColumn("_hit", each(page_hits(words, distinct_base, word_boundary))).where(F.col("_hit").isNotNull())
        .select("*", "_hit.keyword_ord", "_hit.claim", "_hit.needle", "_hit.base", "_hit.at")
        .drop("_hit")
    )


def detect_claims(pages: DataFrame, keywords: list[str] | None = None,
                  distinct_base: bool = False, word_boundary: bool = False) -> DataFrame:
    """One claim per (page, keyword) with context, target year and evidence; `text` is dropped.

    `distinct_base` applies `similar_claim_dedup` inside the page, before contexts are built. Claims of a page that
    lie in the same sentences have the same context, whose evidence is read once per page.
    """
    return claims_read(pages, evidence, keywords, distinct_base, word_boundary).withColumn("target_year", F.col("evidence.target_year"))


def claims_read(pages: DataFrame, read: Callable[[Column], Column], keywords: list[str] | None = None,
                distinct_base: bool = False, word_boundary: bool = False) -> DataFrame:
    """Claims with their context and, as `evidence`, what `read` finds there."""
    return (
        pages.withColumn("_claims", page_claims(read, keywords, distinct_base, word_boundary)).drop("text", "tables")
        .withColumn("_claim", each("_claims")).where(F.col("_claim").isNotNull()).drop("_claims")
        .select("*", "_claim.hit.keyword_ord", "_claim.hit.claim", "_claim.hit.base", "_claim.at.context", "_claim.at.evidence")
        .drop("_claim")
    )


def page_claims(read: Callable[[Column], Column], keywords: list[str] | None = None,
                distinct_base: bool = False, word_boundary: bool = False) -> Column:
    """Claims on the page of the row, each `hit` beside its context and evidence (`at`)."""
    text, words = F.coalesce("text", F.lit("")), tx.claim_keywords() if keywords is None else keywords

    def with_evidence(found: Column) -> Column:
        return with_known(found, lambda x: x["context"], read, lambda x, k: F.struct(x["hit"].alias("hit"), F.struct(
            x["context"].alias("context"), k.alias("evidence")).alias("at")))

    def in_context(hits: Column) -> Column:
        return let(raw_sentences(text), lambda sentences: claim_contexts(text, sentences, hits))
    return let(let(page_hits(words, distinct_base, word_boundary), in_context), with_evidence)


def best_claims(pages: DataFrame, n: int = 20) -> DataFrame:
    """One claim per base keyword and page, best `n` per report: `top_claims` of the scored claims of `detect_claims`.

    Scores need three signals of the evidence; the whole of it is read for the claims that are picked.
    """
    found = claims_read(pages, evidence_signals, distinct_base=True)
    picked = top_claims(score_claims(claim_metrics_choice(found)), n)
    return picked.withColumn("evidence", evidence(F.col("context"))).withColumn("target_year", F.col("evidence.target_year"))


def allowed_units(claim: Column) -> Column:
    """Normalised units a generic figure may have for this claim; empty for unknown claims."""
    pairs = []
    for name, units in tx.CLAIM_UNITS.items():
        pairs += [F.lit(name), F.array(*[F.lit(normalize_unit_py(u)) for u in units])]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), claim), F.array().cast("array<string>"))


def claim_unit_filter(generic: Column, claim: Column) -> Column:
    """Figures without unit, or with a unit the claim allows."""
    return let(allowed_units(claim), lambda ok: F.filter(
        generic, lambda m: (F.coalesce(m["unit"], F.lit("")) == "") | F.array_contains(ok, m["unit"])))


def is_emissions_claim(claim: Column) -> Column:
    return claim.isin(*tx.EMISSIONS_CLAIMS)


def claim_metrics_choice(claims: DataFrame) -> DataFrame:
    """Attach scope figures to emissions claims and unit-filtered generic ones to the rest.

    Expects the page's metric arrays on the row; they are replaced by one `metrics` struct.
    """
    return claims.withColumn("metrics", chosen_metrics(F.col("claim"))).drop(*tx.METRIC_KINDS)


def chosen_metrics(claim: Column) -> Column:
    """Figures of the row's page that this claim may have."""
    emission = is_emissions_claim(claim)
    return F.struct(
        *[F.when(emission, F.col(k)).otherwise(no_metrics()).alias(k) for k in ("scope1", "scope2", "scope3")],
        F.when(emission, no_metrics()).otherwise(claim_unit_filter(F.col("generic"), claim)).alias("generic"),
    )


def tier(claim: Column, fold_case: bool = False) -> Column:
    """`high`, `medium`, `low` or `other`."""
    names, lower = tx.tier_of(fold_case), F.lower(claim)
    found = F.lit("other")
    for name in tx.TIER_POINTS:
        found = F.when(lower.isin([k for k, of in names.items() if of == name]), name).otherwise(found)
    return found


def claim_score(claim: Column, evidence: Column, context: Column, has_scope: Column,
                has_generic: Column, fold_case: bool = False) -> Column:
    """0 to 100: tier, then evidence, then length of context, then figures."""
    t = tier(claim, fold_case)
    points = F.lit(tx.OTHER_POINTS)
    for name, value in tx.TIER_POINTS.items():
        points = F.when(t == name, value).otherwise(points)
    length = F.length(F.coalesce(context, F.lit("")))
    return (
        points
        + F.when(evidence["has_target_year"], 15).otherwise(0)
        + F.when(evidence["has_numeric_data"], 10).otherwise(0)
        + F.when(evidence["has_commitment_language"], 5).otherwise(0)
        + F.when(length > 200, 20).when(length > 100, 10).when(length > 50, 5).otherwise(0)
        + F.when(has_scope, 10).when(has_generic, 5).otherwise(0)
    ).cast("int")


def score_claims(claims: DataFrame, fold_case: bool = False) -> DataFrame:
    return claims.withColumn("score", score_with_metrics(F.col("claim"), F.col("evidence"), F.col("context"), F.col("metrics"), fold_case))


def score_with_metrics(claim: Column, evidence: Column, context: Column, m: Column, fold_case: bool = False) -> Column:
    has_scope = (F.size(m["scope1"]) > 0) | (F.size(m["scope2"]) > 0)
    return claim_score(claim, evidence, context, has_scope, F.size(m["generic"]) > 0, fold_case)


def base_of(claim: Column) -> Column:
    lower = F.lower(claim)
    return F.trim(F.replace(F.replace(lower, F.lit(" emissions"), F.lit("")), F.lit(" target"), F.lit("")))


def similar_claim_dedup(claims: DataFrame) -> DataFrame:
    """First claim per (report, page, base keyword) in keyword order, for a stored claims table.

    A key has at most one row per keyword, so no key can grow large.
    """
    w = Window.partitionBy("document_id", "page", "_base").orderBy("keyword_ord")
    return (
        claims.withColumn("_base", base_of(F.col("claim")))
        .withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn", "_base")
    )


def top_claims(scored: DataFrame, n: int = 20) -> DataFrame:
    """Best `n` claims per report by score, then page and keyword order; adds `claim_rank`.

    The rank filter becomes a group limit before the shuffle, so a report with very many claims
    sends at most `n` rows per task.
    """
    w = Window.partitionBy("document_id").orderBy(F.desc("score"), "page", "keyword_ord")
    return scored.withColumn("claim_rank", F.row_number().over(w)).where(F.col("claim_rank") <= n)


def simple_top_claims(claims: DataFrame, more_than: int = 20, n: int = 15) -> DataFrame:
    """Alternative picker: reports with over `more_than` claims keep `n` by a short priority list.

    Small reports keep all claims, so the first `more_than` claims per report are enough either
    way; the report's size comes from a partial aggregate.
    """
    prio = F.lit(tx.SIMPLE_PRIORITY_OTHER)
    for name, value in tx.SIMPLE_PRIORITY.items():
        prio = F.when(F.col("claim") == name, value).otherwise(prio)
    ranked = claims.withColumn("_prio", prio)
    # A report that is not reduced keeps its own order; its rank only serves as the bound.
    w = Window.partitionBy("document_id").orderBy("_prio", "page", "keyword_ord")
    first = ranked.withColumn("claim_rank", F.row_number().over(w)).where(F.col("claim_rank") <= max(more_than, n))
    sizes = claims.groupBy("document_id").agg(F.count("*").alias("_claims"))
    return (
        first.join(sizes, "document_id")
        .where((F.col("_claims") <= more_than) | (F.col("claim_rank") <= n))
        .drop("_prio", "_claims")
    )


def priority_mix(selected: DataFrame, fold_case: bool = False) -> DataFrame:
    """How many selected claims per report are of high, medium and any other priority."""
    t = tier(F.col("claim"), fold_case)
    return selected.groupBy("document_id").agg(
        F.count_if(t == "high").alias("high"),
        F.count_if(t == "medium").alias("medium"),
        F.count_if(~t.isin("high", "medium")).alias("other"),
    )
