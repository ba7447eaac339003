"""Word lists, unit tables and patterns that decide what is extracted.

Everything in this module is a fixed value: results depend on the exact strings
and on their order, so they are written out plainly.
"""

from __future__ import annotations

import re
from collections import Counter

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# --------------------------------------------------------------------------
# Letters outside ASCII that match an ASCII one if case is ignored over Unicode, and that one.
# --------------------------------------------------------------------------
ODD_CASE, ODD_CASE_FOLDED = "\u017f\u0131\u0130\u212a", "siik"

# --------------------------------------------------------------------------
# Claim keywords by category.
# --------------------------------------------------------------------------
KEYWORDS: dict[str, list[str]] = {
    "emissions": [
        "scope 1", "scope 2", "scope 3",
        "scope 1 emissions", "scope 2 emissions", "scope 3 emissions",
        "scope one", "scope two", "scope three",
        "scopes 1 and 2", "scopes 1, 2 and 3",
        "GHG emissions", "greenhouse gas emissions", "greenhouse gas", "GHG protocol",
        "direct emissions", "indirect emissions",
        "operational emissions", "energy indirect emissions",
        "value chain emissions", "supply chain emissions",
        "carbon emissions", "CO2 emissions", "CO2e emissions",
        "carbon dioxide emissions", "carbon footprint",
        "total emissions", "total GHG emissions",
        "absolute emissions", "emissions intensity",
        "methane emissions", "CH4 emissions", "nitrous oxide", "N2O emissions",
        "fluorinated gases", "HFC emissions",
    ],
    "targets": [
        "net zero", "net-zero", "net zero emissions", "net zero by", "net zero target",
        "achieve net zero", "pathway to net zero",
        "carbon neutral", "carbon neutrality", "carbon neutral by", "carbon negative",
        "climate neutral", "climate positive", "zero emissions", "emissions-free",
        "decarbonization", "decarbonisation",
        "science-based targets", "SBTi", "SBT",
        "1.5°C target", "2°C target", "Paris Agreement",
        "science based target initiative",
    ],
    "energy": [
        "renewable energy", "clean energy", "green energy", "solar energy", "wind energy",
        "hydroelectric", "renewable electricity", "renewable power",
        "energy consumption", "energy efficiency", "energy intensity", "total energy use",
        "fossil fuel", "natural gas", "coal", "oil",
        "renewable energy certificate", "REC", "I-REC",
    ],
    "resources": [
        "water consumption", "water usage", "water withdrawal",
        "water intensity", "water stress", "water scarcity",
        "waste generated", "waste recycled", "waste to landfill",
        "circular economy", "recycling rate", "material consumption", "raw materials",
    ],
    "nature": [
        "biodiversity", "ecosystem", "habitat",
        "deforestation", "reforestation", "afforestation",
        "land use", "land degradation", "protected areas", "nature-based solutions",
    ],
    "social": [
        "employee safety", "health and safety", "lost time injury",
        "diversity and inclusion", "gender diversity", "human rights", "labor practices",
        "community engagement", "stakeholder engagement",
    ],
    "standards": [
        "GRI", "TCFD", "CDP", "SASB", "ISSB", "ISO 14001", "ISO 50001",
        "LEED certification", "green building", "B Corp", "carbon disclosure",
    ],
}

# Claims that carry scope figures instead of generic ones.
EMISSIONS_CLAIMS = [
    "scope 1", "scope 2", "scope 3",
    "scope 1 emissions", "scope 2 emissions", "scope 3 emissions",
    "net zero", "carbon neutral", "zero emissions", "carbon footprint", "climate neutral",
    "GHG emissions", "greenhouse gas emissions",
    "direct emissions", "indirect emissions",
    "carbon emissions", "CO2 emissions", "total emissions",
]

# Units a generic figure may have to support a claim.
CLAIM_UNITS: dict[str, list[str]] = {
    "net zero": ["tCO2e", "tCO2", "tonnes CO2e"],
    "carbon neutral": ["tCO2e", "tCO2", "tonnes CO2e"],
    "zero emissions": ["tCO2e", "tCO2", "tonnes CO2e"],
    "carbon footprint": ["tCO2e", "tCO2", "tonnes CO2e"],
    "climate neutral": ["tCO2e", "tCO2", "tonnes CO2e"],
    "GHG emissions": ["tCO2e", "tCO2", "tonnes CO2e"],
    "carbon emissions": ["tCO2e", "tCO2", "tonnes CO2e"],
    "scope 1": ["tCO2e", "tCO2", "tonnes CO2e"],
    "scope 2": ["tCO2e", "tCO2", "tonnes CO2e"],
    "scope 3": ["tCO2e", "tCO2", "tonnes CO2e"],
    "renewable energy": ["MWh", "kWh", "GWh", "%", "percent"],
    "green energy": ["MWh", "kWh", "GWh", "%", "percent"],
    "energy consumption": ["MWh", "kWh", "GWh", "TJ"],
    "emission reduction": ["tCO2e", "tCO2", "%", "percent"],
    "sustainability target": ["tCO2e", "tCO2", "%", "percent"],
    "water consumption": ["m3", "ML", "liters", "gallons"],
    "waste generated": ["tonnes", "kg", "tons"],
    "waste recycled": ["tonnes", "kg", "%", "percent"],
}

# Audit priority of a claim.
PRIORITY_TIERS: dict[str, list[str]] = {
    "high": [
        "scope 1", "scope 1 emissions", "scope 2", "scope 2 emissions",
        "scope 3", "scope 3 emissions",
        "total emissions", "total GHG emissions",
        "GHG emissions", "greenhouse gas emissions",
        "carbon emissions", "CO2 emissions", "CO2e emissions",
        "direct emissions", "indirect emissions",
        "net zero", "net-zero", "net zero by", "net zero emissions",
        "carbon neutral", "carbon neutrality", "carbon neutral by", "climate neutral",
        "science-based targets", "SBTi", "SBT",
        "1.5°C target", "2°C target", "Paris Agreement",
        "science based target initiative",
        "renewable energy", "renewable electricity", "renewable power",
        "clean energy", "solar energy", "wind energy",
    ],
    "medium": [
        "emission reduction", "emissions intensity",
        "decarbonization", "decarbonisation", "carbon footprint",
        "energy consumption", "energy efficiency", "energy intensity",
        "water consumption", "water usage", "water withdrawal",
        "waste generated", "waste recycled", "waste to landfill",
        "circular economy", "recycling rate",
        "biodiversity", "deforestation", "reforestation",
        "green energy", "hydroelectric",
    ],
    "low": [
        "employee safety", "health and safety", "lost time injury",
        "diversity and inclusion", "gender diversity", "human rights", "labor practices",
        "community engagement", "stakeholder engagement",
        "LEED certification", "green building", "B Corp", "ISO 14001", "ISO 50001",
        "GRI", "TCFD", "CDP", "SASB", "ISSB",
    ],
}
TIER_POINTS = {"high": 40, "medium": 20, "low": 5}
OTHER_POINTS = 10

# The short ranking used by the simple claim picker.
SIMPLE_PRIORITY = {"net zero": 1, "carbon neutral": 2, "zero emissions": 3, "renewable energy": 4}
SIMPLE_PRIORITY_OTHER = 99

# Patterns of emission figures per kind, in the order they are tried.
# Each pattern is paired with lower-case literals that every match must contain;
# a page lacking one of them skips the pattern. Group 1 is the figure.
SCOPE_PATTERNS: dict[str, list[tuple[tuple[str, ...], str]]] = {
    "scope1": [
        (("scope",), r"Scope\s*1[:\s]+emissions?[:\s]*([\d,]+(?:\.\d+)?)"),
        (("scope",), r"Scope\s*1[:\s]+([\d,]+(?:\.\d+)?)\s*(tCO2e|tCO2|tonnes?\s*CO2e?)?"),
        (("scope",), r"Scope\s*One[:\s]+emissions?[:\s]*([\d,]+(?:\.\d+)?)"),
        (("direct",), r"Direct\s+emissions[:\s]+([\d,]+(?:\.\d+)?)"),
        (("direct", "ghg"), r"Direct\s+GHG\s+emissions[:\s]+([\d,]+(?:\.\d+)?)"),
        (("stationary",), r"Stationary\s+combustion[:\s]+([\d,]+(?:\.\d+)?)"),
        (("mobile",), r"Mobile\s+combustion[:\s]+([\d,]+(?:\.\d+)?)"),
        (("process",), r"Process\s+emissions[:\s]+([\d,]+(?:\.\d+)?)"),
        (("fugitive",), r"Fugitive\s+emissions[:\s]+([\d,]+(?:\.\d+)?)"),
        (("scope", "\n"), r"Scope\s*1\s*\n\s*([\d,]+(?:\.\d+)?)"),
        (("scope", "|"), r"\|\s*Scope\s*1\s*\|\s*([\d,]+(?:\.\d+)?)"),
        (("(scope", "tco2"), r"([\d,]+(?:\.\d+)?)\s*tCO2e?\s*\(Scope\s*1\)"),
        (("(scope", "tonne"), r"([\d,]+(?:\.\d+)?)\s*tonnes?\s*CO2e?\s*\(Scope\s*1\)"),
        (("scope", "fy"), r"Scope\s*1.*?FY\d{2,4}[:\s]+([\d,]+(?:\.\d+)?)"),
        (("scope", "20"), r"Scope\s*1.*?20\d{2}[:\s]+([\d,]+(?:\.\d+)?)"),
    ],
    "scope2": [
        (("scope",), r"Scope\s*2[:\s]+emissions?[:\s]*([\d,]+(?:\.\d+)?)"),
        (("scope",), r"Scope\s*2[:\s]+([\d,]+(?:\.\d+)?)\s*(tCO2e|tCO2|tonnes?\s*CO2e?)?"),
        (("scope",), r"Scope\s*Two[:\s]+emissions?[:\s]*([\d,]+(?:\.\d+)?)"),
        (("indirect",), r"Indirect\s+emissions[:\s]+([\d,]+(?:\.\d+)?)"),
        (("energy",), r"Energy\s+indirect[:\s]+emissions?[:\s]*([\d,]+(?:\.\d+)?)"),
        (("purchased",), r"Purchased\s+electricity[:\s]+emissions?[:\s]*([\d,]+(?:\.\d+)?)"),
        (("electricity",), r"Electricity\s+consumption[:\s]+emissions?[:\s]*([\d,]+(?:\.\d+)?)"),
        (("location-based",), r"Scope\s*2\s*\(location-based\)[:\s]+([\d,]+(?:\.\d+)?)"),
        (("market-based",), r"Scope\s*2\s*\(market-based\)[:\s]+([\d,]+(?:\.\d+)?)"),
        (("scope", "location"), r"Scope\s*2\s*-\s*Location[:\s]+([\d,]+(?:\.\d+)?)"),
        (("scope", "market"), r"Scope\s*2\s*-\s*Market[:\s]+([\d,]+(?:\.\d+)?)"),
        (("scope", "\n"), r"Scope\s*2\s*\n\s*([\d,]+(?:\.\d+)?)"),
        (("scope", "|"), r"\|\s*Scope\s*2\s*\|\s*([\d,]+(?:\.\d+)?)"),
        (("(scope", "tco2"), r"([\d,]+(?:\.\d+)?)\s*tCO2e?\s*\(Scope\s*2\)"),
        (("(scope", "tonne"), r"([\d,]+(?:\.\d+)?)\s*tonnes?\s*CO2e?\s*\(Scope\s*2\)"),
        (("scope", "fy"), r"Scope\s*2.*?FY\d{2,4}[:\s]+([\d,]+(?:\.\d+)?)"),
        (("scope", "20"), r"Scope\s*2.*?20\d{2}[:\s]+([\d,]+(?:\.\d+)?)"),
    ],
    "scope3": [
        (("scope",), r"Scope\s*3[:\s]+emissions?[:\s]*([\d,]+(?:\.\d+)?)"),
        (("scope",), r"Scope\s*3[:\s]+([\d,]+(?:\.\d+)?)\s*(tCO2e|tCO2|tonnes?\s*CO2e?)?"),
        (("scope",), r"Scope\s*Three[:\s]+emissions?[:\s]*([\d,]+(?:\.\d+)?)"),
        (("value",), r"Value\s+chain\s+emissions[:\s]+([\d,]+(?:\.\d+)?)"),
        (("supply",), r"Supply\s+chain\s+emissions[:\s]+([\d,]+(?:\.\d+)?)"),
        (("upstream",), r"Upstream\s+emissions[:\s]+([\d,]+(?:\.\d+)?)"),
        (("downstream",), r"Downstream\s+emissions[:\s]+([\d,]+(?:\.\d+)?)"),
        (("other", "indirect"), r"Other\s+indirect\s+emissions[:\s]+([\d,]+(?:\.\d+)?)"),
        (("business",), r"Business\s+travel[:\s]+emissions?[:\s]*([\d,]+(?:\.\d+)?)"),
        (("employee",), r"Employee\s+commuting[:\s]+emissions?[:\s]*([\d,]+(?:\.\d+)?)"),
        (("purchased",), r"Purchased\s+goods[:\s]+emissions?[:\s]*([\d,]+(?:\.\d+)?)"),
        (("scope", "\n"), r"Scope\s*3\s*\n\s*([\d,]+(?:\.\d+)?)"),
        (("scope", "|"), r"\|\s*Scope\s*3\s*\|\s*([\d,]+(?:\.\d+)?)"),
    ],
    "total": [
        (("total", "ghg"), r"Total\s+GHG\s+emissions[:\s]+([\d,]+(?:\.\d+)?)"),
        (("total",), r"Total\s+emissions[:\s]+([\d,]+(?:\.\d+)?)"),
        (("total", "carbon"), r"Total\s+carbon\s+emissions[:\s]+([\d,]+(?:\.\d+)?)"),
        (("gross",), r"Gross\s+emissions[:\s]+([\d,]+(?:\.\d+)?)"),
        (("total", "scope"), r"Total\s+Scope\s+1\s+and\s+2[:\s]+([\d,]+(?:\.\d+)?)"),
        (("total", "scope"), r"Total\s+Scopes?\s+1,\s*2\s*(?:and|&)?\s*3[:\s]+([\d,]+(?:\.\d+)?)"),
    ],
}
SCOPE_KINDS = ["scope1", "scope2", "scope3", "total"]
METRIC_KINDS = [*SCOPE_KINDS, "generic"]
SCOPE_UNIT = "tCO2e"
TEXT_SOURCE = "text_extraction"

# Words that mark a table's header row, its scope columns and its row labels.
TABLE_HEADER_WORDS = ["scope", "emissions", "ghg", "category", "type"]
TABLE_COLUMN_WORDS = {
    "scope1": ["scope 1", "scope1"],
    "scope2": ["scope 2", "scope2"],
    "scope3": ["scope 3", "scope3"],
}
TABLE_LABEL_WORDS = {
    "scope1": ["scope 1", "scope1", "direct emission"],
    "scope2": ["scope 2", "scope2", "indirect", "energy indirect"],
    "scope3": ["scope 3", "scope3", "value chain", "supply chain"],
}

# Fixed value: a number with an optional unit.
NUMBER = r"([\d]{1,3}(?:[,\s]?\d{3})*(?:\.\d+)?)"
UNIT = r"\s*(tCO2e|tCO2|tonnes\s+CO2e?|t\s+CO2e?|kg|tonnes?|%|percent|MWh|kWh|GWh|TJ|L|liters?|m3|m³|ML)?"
NUMERIC_PATTERN = NUMBER + UNIT
# Option: plain digit runs are read as one number.
NUMBER_FIXED = r"((?:\d{1,3}(?:[,\s]\d{3})+|\d+)(?:\.\d+)?)"
NUMERIC_PATTERN_FIXED = NUMBER_FIXED + UNIT

# Target-year patterns on lower-cased text, in the order they are tried,
# each with a literal that every match must contain.
TARGET_YEAR_PATTERNS = [
    ("by", r"by\s+(20\d{2})"),
    ("target", r"target\s+year[:\s]+(20\d{2})"),
    ("achieve", r"achieve.*?(20\d{2})"),
    ("reach", r"reach.*?(20\d{2})"),
    ("goal", r"goal.*?(20\d{2})"),
    ("commitment", r"commitment.*?(20\d{2})"),
    ("pledge", r"pledge.*?(20\d{2})"),
]
TARGET_YEAR_RANGE = (2020, 2100)

# Words of commitment; the first five also mark a key phrase.
COMMITMENT_WORDS = [
    "committed", "pledge", "target", "goal", "aim",
    "plan", "strategy", "initiative", "invest", "reduce",
]

# Words dropped from file names.
FILENAME_NOISE = ["sustainability", "report", "esg", "annual", "csr", "corporate", "responsibility"]


def claim_keywords(categories: dict[str, list[str]] | None = None) -> list[str]:
    """Distinct keywords over all categories in code-point order; the position is `keyword_ord`."""
    return sorted({k for words in (categories or KEYWORDS).values() for k in words})


def base_keyword(keyword: str) -> str:
    """Keyword without the suffixes that make two claims look different."""
    return keyword.lower().replace(" emissions", "").replace(" target", "").strip()


def sql_string(text: str) -> str:
    """Spark SQL literal taken verbatim; the fixed texts hold no single quote."""
    return f"r'{text}'"


def keyword_groups(keywords: list[str]) -> list[tuple[str, list[int]]]:
    """Keywords by the word most of them share: a text without that word holds none of its keywords, so it is sought first."""
    words = [re.findall(r"[a-z0-9]{3,}", k.lower()) for k in keywords]
    shared = Counter(w for ws in words for w in set(ws))
    groups: dict[str, list[int]] = {}
    for i, (k, ws) in enumerate(zip(keywords, words)):
        best = max(ws, key=lambda w: (shared[w], len(w)), default=k.lower())
        groups.setdefault(best if shared[best] > 1 else k.lower(), []).append(i)
    return list(groups.items())


def keyword_structs(keywords: list[str]) -> Column:
    """Literal array of (word, keywords with it as (keyword_ord, claim, needle, base)); Catalyst folds it to one constant.

    Parsed from one text: building it call by call would cost a second of driver time per plan.
    """
    def row(i: int) -> str:
        k = keywords[i]
        return (f"struct({i} as keyword_ord, {sql_string(k)} as claim, {sql_string(k.lower())} as needle, "
                f"{sql_string(base_keyword(k))} as base)")
    rows = ", ".join(
        f"struct({sql_string(w)} as word, array({', '.join(map(row, members))}) as keywords)" for w, members in keyword_groups(keywords))
    return F.expr(f"array({rows})")


def tier_of(fold_case: bool = False) -> dict[str, str]:
    """Tier by lower-cased keyword.

    Keywords are lower-cased before the lookup, so tier entries written with capitals
    never match unless `fold_case` lower-cases them too.
    """
    tiers: dict[str, str] = {}
    for tier in ("low", "medium", "high"):
        for k in PRIORITY_TIERS[tier]:
            if fold_case or k == k.lower():
                tiers[k.lower()] = tier
    return tiers


def taxonomy_table(spark: SparkSession) -> DataFrame:
    """Taxonomy as rows: union of the categories, distinct, ordered by code point."""
    rows = [(c, k) for c, words in KEYWORDS.items() for k in words]
    table = spark.createDataFrame(rows, "category string, keyword string")
    order = {k: i for i, k in enumerate(claim_keywords())}
    ords = F.create_map(*[F.lit(x) for pair in order.items() for x in pair])
    return (
        table.groupBy("keyword").agg(F.min("category").alias("category"))
        .withColumn("keyword_ord", F.element_at(ords, F.col("keyword")))
    )
