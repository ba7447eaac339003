"""Scalar functions: expected values written by hand, quirks included."""

import pytest
from pyspark.sql import functions as F

from reportlens import taxonomy as tx
from reportlens.functions import answers as A
from reportlens.functions import text as X
from reportlens.operators import extract as ex


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values))
    return df.select(column.alias("v")).first().v


@pytest.mark.parametrize("raw,want", [
    ("1,234.5", 1234.5), ("12 345.", 12345.0), ("12d", None), ("", None), (None, None), ("1\n200", None), ("5.\n", 5.0),
    (".5", 0.5), ("1e3", 1000.0), ("-7", -7.0), ("1_000", 1000.0), (",", None), ("n/a", None), ("inf", float("inf"))])
def test_parse_number(spark, raw, want):
    assert one(spark, X.parse_number(F.col("x")), x=raw) == want


@pytest.mark.parametrize("raw,want", [
    ("tCO2e", "tCO2e"), ("tonnes CO2", "tonnes"), ("tonnes CO2e", "tCO2e"), ("t  CO2", "t  co2"), ("Percent", "%"), ("m³", "m3"), ("ml", "ML"),
    ("Liters", "liters"), ("T", "tonnes"), (" kWh ", "kWh"), (None, ""), ("", "")])
def test_normalize_unit(spark, raw, want):
    assert one(spark, X.normalize_unit(F.col("x")), x=raw) == want


@pytest.mark.parametrize("raw,want", [
    ("Net zero by 2045", 2045), ("by 2010 we aim; target year: 2030", 2030), ("by 2010, later by 2050", None),
    ("we reach it in\n2030", None), ("our goal: halve by half until 2035", 2035), ("nothing", None), ("pledge 2099 / 2101", 2099)])
def test_target_year(spark, raw, want):
    assert one(spark, X.target_year(F.col("x")), x=raw) == want


def generic(spark, text, fixed=False):
    df = spark.createDataFrame([(text, 1)], "text string, page int")
    row = df.select(ex.generic_figures(F.col("text"), F.col("page"), fixed).alias("g")).first()
    return [(m.value, m.unit) for m in row.g]


def test_number_quirks(spark):
    assert generic(spark, "2024") == [(202.0, ""), (4.0, "")]
    assert generic(spark, "12345") == [(123.0, ""), (45.0, "")]
    assert generic(spark, "5 large") == [(5.0, "l")]
    assert generic(spark, "3 tonnes CO2 and 0 kg") == [(3.0, "tonnes")]
    assert generic(spark, "1,\n200 m3") == [(1.0, ""), (200.0, "m3")]
    assert generic(spark, "4\xa0500 kWh") == []  # matched as one number, not parsed as one
    assert generic(spark, "in 2024 we used 12,345.5 kWh", fixed=True) == [(2024.0, ""), (12345.5, "kWh")]


def scope(spark, text, kind, strict=False):
    df = spark.createDataFrame([(text, 3)], "text string, page int")
    return [m.value for m in ex.scope_metrics_from_text(df, strict).select(kind).first()[0]]


def test_scope_text(spark):
    text = "Scope 1: 1,200 tCO2e. Indirect emissions: 30. Scope 1 in FY2024: 77\n| Scope 1 | 5 |"
    # The last figure is found by the FY pattern and again by the year pattern.
    assert scope(spark, text, "scope1") == [1200.0, 30.0, 5.0, 77.0, 77.0]
    assert scope(spark, text, "scope1", strict=True) == [1200.0, 5.0, 77.0, 77.0]
    assert scope(spark, text, "scope2") == [30.0]
    assert scope(spark, "SCOPE 3 emissions: 9; Business travel emissions 4.5", "scope3") == [9.0, 4.5]
    assert scope(spark, "Total GHG emissions: 12. Gross emissions 3", "total") == [12.0, 3.0]
    assert scope(spark, "450 tCO2 (Scope 1) and 12 tonnes CO2e (Scope 1)", "scope1") == [450.0, 12.0]
    assert scope(spark, "Scope 1\n77", "scope1") == [77.0]  # newline becomes a space before any pattern runs


def test_scope_patterns_keep_their_literals():
    for kind, patterns in tx.SCOPE_PATTERNS.items():
        for literals, pattern in patterns:
            bare = pattern.lower().replace(r"\s*", "").replace(r"\s+", "").replace("\\n", "\n").replace("\\", "")
            for w in literals:
                assert w in bare or w.strip("(") in bare, (kind, w, pattern)


def test_tables(spark):
    tables = [
        [["Category", "Scope 1", "Scope 2"], ["Total", "1,000", None], ["Direct emissions", "5", "x", "7"], None, []],
        [["Scope 1", "99"]],
        [["a", "3"], ["Value chain", "4", "0"]],
    ]
    df = spark.createDataFrame([(tables, 2)], "tables array<array<array<string>>>, page int")
    row = ex.scope_metrics_from_tables(df).first()
    assert [(m.value, m.source) for m in row.scope1] == [
        (1000.0, "table_0_col_1"), (5.0, "table_0_col_1"), (5.0, "table_0_label"), (7.0, "table_0_label")]
    assert row.scope2 == [] and row.total == []
    assert [(m.value, m.source) for m in row.scope3] == [(4.0, "table_2_label")]


def test_page_dedup_keeps_first(spark):
    df = spark.createDataFrame([([(1.0, "t", 1, "a"), (2.0, "t", 1, "b"), (1.0, "t", 1, "c")],)], f"m {ex.METRICS}")
    assert [m.source for m in df.select(ex.page_metric_dedup(F.col("m")).alias("m")).first().m] == ["a", "b"]


def test_context(spark):
    text = "One. Two! Three? The net zero plan is here. Five. Six. Seven. Eight."
    def at(t): return X.sentence_context(F.col("t"), X.raw_sentences(F.col("t")), F.lit(t.lower().find("net zero")), F.lit("net zero"))
    assert one(spark, at(text), t=text) == "One. Two! Three? The net zero plan is here. Five. Six. Seven."
    long = "x" * 600 + " net zero."
    assert one(spark, at(long), t=long) == "x" * 500 + "..."
    gap = "A.          net zero"  # offsets drift past the text: characters instead
    assert one(spark, at(gap), t=gap) == "A.          net zero"


def test_evidence(spark):
    e = one(spark, X.evidence(F.col("x")), x="We are committed to reach net zero by 2040. We plan and invest. Short 1.")
    assert (e.has_target_year, e.target_year, e.has_numeric_data, e.numeric_count) == (True, 2040, True, 3)
    assert e.commitment_words == ["committed", "plan", "invest"]
    assert e.key_phrases == ["We are committed to reach net zero by 2040"]


@pytest.mark.parametrize("raw,want", [
    ("a  b\n\tc", "a b c"), ("Intro Page 3 of 12 end", "Intro  end"), ("  123 ", "123"), ("123 ", ""), ("12 apples", "12 apples")])
def test_clean_text(spark, raw, want):
    assert one(spark, X.clean_text(F.col("x")), x=raw) == want


@pytest.mark.parametrize("raw,want", [
    ("3m & co.", "3M Co"), ("ACME (Pte) LTD", "Acme Pte Ltd"), ("", "Unknown"), (None, "Unknown"), ("?!", "Unknown"), ("o2 x1y", "O2 X1Y")])
def test_normalize_company(spark, raw, want):
    assert one(spark, X.normalize_company(F.col("x")), x=raw) == want


@pytest.mark.parametrize("raw,want", [
    ("2023_SGX_Sustainability_Report.pdf", ("Sgx", 2023)), ("Keppel-ESG-Report-2022.PDF", ("Keppel", 2022)),
    ("DBS 2021 annual report v2.pdf", ("Dbs V2", 2021)), ("report.pdf", ("Unknown", 1999)), ("", ("Unknown", 1999))])
def test_company_year_from_filename(spark, raw, want):
    assert tuple(one(spark, X.company_year_from_filename(F.col("x"), 1999), x=raw)) == want


@pytest.mark.parametrize("raw,want", [
    ("SGX_Group_2025.pdf", ("SGX Group", 2025)), ("noyear.pdf", ("noyear.pdf", 0)), ("a_b.pdf", ("a_b.pdf", 0))])
def test_company_year_rsplit(spark, raw, want):
    assert tuple(one(spark, X.company_year_rsplit(F.col("x")), x=raw)) == want


@pytest.mark.parametrize("raw,score", [
    ('{"overall_score": 4, "claim_reviews": []}', 4.0),
    ('text ```json\n{"overall_score": 3, "claim_reviews": []}\n``` more', 3.0),
    ('so {"overall_score": 2.5, "claim_reviews": []} ok', 2.5), ("{broken", None), ('{"overall_score": 4}', None), ("[1]", None)])
def test_parse_audit(spark, raw, score):
    a = one(spark, A.parse_audit(F.col("x")), x=raw)
    assert (a.overall_score if a else None) == score


@pytest.mark.parametrize("raw,ok", [
    ('{"overall_score": 4, "claim_reviews": [{"claim": "a", "score": 1}]}', True),
    ('{"overall_score": 6, "claim_reviews": []}', False), ('{"overall_score": "4", "claim_reviews": []}', False),
    ('{"overall_score": 4, "claim_reviews": [{"claim": "a"}]}', False), ('{"overall_score": 4, "claim_reviews": {}}', False)])
def test_valid_audit(spark, raw, ok):
    assert one(spark, A.is_valid_audit(A.parse_audit(F.col("x"))), x=raw) is ok


def test_taxonomy():
    words = tx.claim_keywords()
    assert len(words) == len(set(words)) == 122 and words == sorted(words)
    assert {k: len(v) for k, v in tx.PRIORITY_TIERS.items()} == {"high": 36, "medium": 21, "low": 19}
    assert "ghg emissions" not in tx.tier_of() and tx.tier_of(True)["ghg emissions"] == "high"
    assert len(tx.EMISSIONS_CLAIMS) == 18
    assert {k: len(v) for k, v in tx.SCOPE_PATTERNS.items()} == {"scope1": 15, "scope2": 17, "scope3": 13, "total": 6}
