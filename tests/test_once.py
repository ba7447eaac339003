"""Texts and matches that are built once."""

import pytest
from pyspark.sql import functions as F

from reportlens import taxonomy as tx
from reportlens.functions import text as X
from reportlens.functions.patterns import ignore_case
from reportlens.operators import chunks as ch
from reportlens.operators import extract as ex
from reportlens.plans import tables as t
from reportlens.plans.queries import REGISTRY

from test_growth import optimized


def test_chunk_texts_are_written_once(spark, sf):
    """A filter on the length of a text wrote it once more."""
    chunks = ch.claim_chunks(t.reports(spark, sf))
    assert optimized(chunks).count("Sustainability Claim: ") == 1
    assert optimized(chunks.select("document_id", "content")).count("Sustainability Claim: ") == 1


def test_numbers_of_a_text_are_searched_once(spark):
    odd = ["12 345 kWh, 7 large sites and 1,\n200 m3", "5 % of 1.5 T CO2e. 3 Tonnes  CO2", "a1b22c333d4444 ML", "٣ kg 7 ", "1 ", "9L 8 l", "", None]
    df = spark.createDataFrame([(x,) for x in odd], "t string")
    for fixed, pattern in ((False, tx.NUMERIC_PATTERN), (True, tx.NUMERIC_PATTERN_FIXED)):
        found = df.select("t", ex.generic_figures(F.col("t"), F.lit(1), fixed).alias("g"))
        assert optimized(found).count("regexp_extract_all") == 1
        n, u = (F.regexp_extract_all("t", F.lit(ignore_case(pattern)), F.lit(i)) for i in (1, 2))
        both = F.filter(F.arrays_zip(F.transform(n, X.parse_number).alias("v"), F.transform(u, X.normalize_unit).alias("u")), lambda p: p["v"] > 0)
        for r in found.select("t", F.transform("g", lambda m: F.struct(m["value"], m["unit"])).alias("g"), both.alias("want")).collect():
            assert [tuple(x) for x in r.g or []] == [tuple(x) for x in r.want or []], r.t


@pytest.mark.parametrize("text,number", [
    ("12", 12.0), ("1.5", 1.5), ("1,200.", 1200.0), (" 7 ", 7.0), ("-5", -5.0), ("1e3", 1000.0), ("1_000", 1000.0), (".5", 0.5), ("12d", None),
    ("i nf", float("inf")), ("Infinity", float("inf")), ("-INF", float("-inf")), ("n/a", None), ("", None), (None, None), ("12\n", 12.0), ("12\u0085", 12.0), ("٣", None)])
def test_numbers_told_early(spark, text, number):
    assert spark.createDataFrame([(text,)], "t string").select(X.parse_number(F.col("t")).alias("n")).first().n == number


def test_requests_rank_pages_that_are_dealt_out(spark, sf, monkeypatch):
    """Pages came in partitions of a size in bytes, which hold more pages the larger the input is."""
    t.extracted(spark, sf)
    asked = []
    monkeypatch.setattr(t, "page_parts", lambda *a: asked.append(a) or 3)
    for name in ("audit_requests", "json_escape_text"):
        REGISTRY[name](spark, sf)
    assert len(asked) == 2
