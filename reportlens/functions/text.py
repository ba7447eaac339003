"""Scalar text functions over string columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import taxonomy as tx
from .patterns import DIGIT, SPACE, UNEVEN_SPACE, WHITESPACE, ignore_case, portable

SENTENCE_GAP = rf"(?<=[.!?])[{SPACE}]+"
NUMBER_SHAPE = r"^[+-]?([0-9]+(_[0-9]+)*(\.([0-9]+(_[0-9]+)*)?)?|\.[0-9]+(_[0-9]+)*)([eE][+-]?[0-9]+(_[0-9]+)*)?$"
#: Texts whose cast is their number, and those that can be one at all: others hold no digit and no infinity, split as it may be.
PLAIN_NUMBER, NUMBER_LIKE = r"^[0-9]+(\.[0-9]+)?\z", r"(?i)[0-9]|i[ ,]*n[ ,]*f"
INFINITY_SHAPE = r"^(?i)[+-]?inf(inity)?$"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Bind `value` once for `body`; a plain reference inside a lambda may be re-evaluated per element.

    The end of an aggregate over nothing: `transform` over a list of one would copy all that `body` gives, at every level.
    """
    return F.aggregate(F.array().cast("array<int>"), value, lambda bound, _: bound, body)


def with_known(entries: Column, key: Callable[[Column], Column], read: Callable[[Column], Column],
               body: Callable[[Column, Column], Column]) -> Column:
    """`body` of every entry and what `read` gives for its key, which is read once for entries with equal keys."""
    def given(known: Column) -> Column:
        return F.transform(entries, lambda x: body(x, F.get(
            F.filter(known, lambda k: k["key"].eqNullSafe(key(x))), F.lit(0))["read"]))
    return let(F.transform(F.array_distinct(F.transform(entries, key)), lambda c: F.struct(c.alias("key"), read(c).alias("read"))), given)


def each(entries: Column | str) -> Column:
    """One row per entry, and an empty one for none, which the caller drops.

    For a plain `explode` the optimizer first filters on the list's size, which builds a computed list three times.
    """
    return F.explode_outer(entries)


def strip(c: Column) -> Column:
    """Without white space at the ends. Trimming a set of characters passes over the whole text, so it is only done where blanks are not all there is."""
    def rest(t: Column) -> Column:
        odd = F.substring(t, 1, 1).isin(*WHITESPACE) | F.substring(t, -1, 1).isin(*WHITESPACE)
        return F.when(odd, F.btrim(t, F.lit(WHITESPACE))).otherwise(t)
    return let(F.trim(c), rest)


def lower_fold(c: Column, lower: Column) -> Column:
    """Lower case as matching that ignores case over Unicode sees it: four letters count as their ASCII pair."""
    odd = contains_any(c, list(tx.ODD_CASE))
    return F.when(odd, F.lower(F.translate(c, tx.ODD_CASE, tx.ODD_CASE_FOLDED))).otherwise(lower)


def squeeze(c: Column) -> Column:
    """White-space runs to one space, ends trimmed."""
    return F.trim(F.regexp_replace(c, UNEVEN_SPACE, " "))


def one_line(c: Column) -> Column:
    return F.replace(c, F.lit("\n"), F.lit(" "))


def contains_any(c: Column, words: list[str]) -> Column:
    cond = F.lit(False)
    for w in words:
        cond = cond | c.contains(w)
    return cond


def parse_number(c: Column) -> Column:
    """Number without thousands separators; null where the text is not one.

    The shape test is needed because a cast alone accepts forms like `12d`. Most texts are plain digits or hold none, so these are told first.
    """
    def spelled(t: Column) -> Column:
        digits = F.btrim(F.rtrim(F.translate(t, ", ", ""), F.lit(".")), F.lit(WHITESPACE))
        return let(digits, lambda d: F.when(
            d.rlike(NUMBER_SHAPE) | d.rlike(INFINITY_SHAPE), F.replace(d, F.lit("_"), F.lit("")).try_cast("double")))
    return let(c, lambda t: F.when(t.rlike(PLAIN_NUMBER), t.try_cast("double")).when(t.rlike(NUMBER_LIKE), spelled(t)))


def normalize_unit(c: Column) -> Column:
    """Unit in its standard spelling; the first rule that applies wins."""
    def rules(u: Column) -> Column:
        return (
            F.when(u == "", u)
            .when(u.contains("tco2") | u.contains("t co2") | u.contains("tonnes co2e"), "tCO2e")
            .when(u.contains("tj"), "TJ")
            .when(u.contains("gwh"), "GWh")
            .when(u.contains("mwh"), "MWh")
            .when(u.contains("kwh"), "kWh")
            .when(u.contains("percent") | (u == "%"), "%")
            .when(u.contains("tonne") | (u == "t"), "tonnes")
            .when(u == "kg", "kg")
            .when((u == "m3") | (u == "m³"), "m3")
            .when(u == "ml", "ML")
            .otherwise(u)
        )
    return let(strip(F.lower(F.coalesce(c, F.lit("")))), rules)


def normalize_unit_py(unit: str) -> str:
    """The same rules for the handful of literal units in the taxonomy."""
    u = unit.lower().strip()
    for words, name in [
        (("tco2", "t co2", "tonnes co2e"), "tCO2e"), (("tj",), "TJ"), (("gwh",), "GWh"),
        (("mwh",), "MWh"), (("kwh",), "kWh"),
    ]:
        if any(w in u for w in words):
            return name
    if "percent" in u or u == "%":
        return "%"
    if "tonne" in u or u == "t":
        return "tonnes"
    return {"m3": "m3", "m³": "m3", "ml": "ML"}.get(u, u)


def target_year(c: Column) -> Column:
    """First pattern whose first match lies in the accepted range."""
    low, high = tx.TARGET_YEAR_RANGE

    def pick(t: Column) -> Column:
        def tried(word: str, pattern: str) -> Column:
            # A pattern is only run where its literals occur: a byte search is far cheaper.
            year = F.when(t.contains(word), F.regexp_extract(t, portable(pattern), 1).try_cast("int"))
            return let(year, lambda v: F.when(v.between(low, high), v))
        return F.when(t.contains("20"), F.coalesce(*[tried(w, p) for w, p in tx.TARGET_YEAR_PATTERNS]))
    return let(F.lower(c), pick)


def raw_sentences(c: Column) -> Column:
    """Pieces between sentence gaps, untrimmed, as they lie in the text."""
    return F.split(c, SENTENCE_GAP)


def split_sentences(c: Column) -> Column:
    return F.filter(F.transform(raw_sentences(c), strip), lambda s: F.length(s) > 0)


def char_context(text: Column, at: Column, keyword: Column, window: int = 300) -> Column:
    """Text within `window` characters of the keyword; `at` is its 0-based position."""
    start = F.greatest(F.lit(0), at - window)
    width = at + F.length(keyword) + window - start
    return strip(one_line(F.substring(text, start + 1, width)))


def sentence_context(text: Column, sentences: Column, at: Column, keyword: Column,
                     around: int = 3, limit: int = 500) -> Column:
    """Sentences around position `at`, cut at `limit` characters.

    Sentence offsets assume one separating character, as the figures to match do, so
    wider gaps drift; a position that no sentence covers falls back to characters.
    """
    start = F.struct(F.lit(0).alias("pos"), F.lit(-1).alias("found"), F.lit(0).alias("i"))

    def step(s: Column, x: Column) -> Column:
        end = s["pos"] + F.length(x)
        here = (s["found"] < 0) & (s["pos"] <= at) & (at < end)
        return F.struct(
            (end + 1).alias("pos"),
            F.when(here, s["i"]).otherwise(s["found"]).alias("found"),
            (s["i"] + 1).alias("i"),
        )

    index = F.aggregate(sentences, start, step, lambda s: s["found"])

    return let(index, lambda i: F.when(i < 0, char_context(text, at, keyword)).otherwise(
        text_around(sentences, i, around, limit)))


def text_around(sentences: Column, i: Column, around: int = 3, limit: int = 500) -> Column:
    """Sentence `i` and those around it as one line, cut at `limit` characters."""
    first = F.greatest(F.lit(0), i - around)
    joined = strip(one_line(F.array_join(F.slice(sentences, first + 1, i + around + 1 - first), " ")))
    return let(joined, lambda j: F.when(
        F.length(j) > limit, F.concat(F.substring(j, 1, limit), F.lit("..."))).otherwise(j))


def claim_context(text: Column, sentences: Column, at: Column, keyword: Column) -> Column:
    """Sentence context, or characters where that is shorter than 50."""
    return let(sentence_context(text, sentences, at, keyword), lambda c: F.when(
        F.length(c) < 50, char_context(text, at, keyword)).otherwise(c))


def claim_contexts(text: Column, sentences: Column, hits: Column) -> Column:
    """Each hit (with `at` and `claim`) beside its `claim_context`. Hits around one sentence share the text around it, which is built once."""
    def found(lengths: Column, at: Column) -> Column:
        """The sentence that holds `at`, else -1. `rest` is what is left of `at` after the sentences before, and -1 once that is settled."""
        def to(rest: Column, i: Column) -> Column:
            return F.struct(rest.alias("rest"), i.alias("i"))
        start = to(at.cast("int"), F.lit(0))
        return F.aggregate(lengths, start, lambda s, n: F.when(s["rest"] < 0, s).when(s["rest"] > n, to(s["rest"] - n - 1, s["i"] + 1)).otherwise(
            to(F.lit(-1), F.when(s["rest"] < n, s["i"]).otherwise(-1))), lambda s: F.when(s["rest"] < 0, s["i"]).otherwise(-1))

    def fill(places: Column) -> Column:
        around = F.transform(F.array_distinct(F.filter(places, lambda i: i >= 0)), lambda i: F.struct(
            i.alias("i"), text_around(sentences, i).alias("context")))
        return let(around, lambda known: F.zip_with(hits, places, lambda h, i: F.struct(h.alias("hit"), let(
            F.get(F.filter(known, lambda k: k["i"] == i), F.lit(0))["context"], lambda c: F.when(
                F.length(c) >= 50, c).otherwise(char_context(text, h["at"], h["claim"]))).alias("context"))))
    places = let(F.transform(sentences, F.length), lambda lengths: F.transform(hits, lambda h: found(lengths, h["at"])))
    return let(places, fill)


def key_phrases(context: Column) -> Column:
    """Up to three phrases over 20 characters that hold a digit or a word of commitment."""
    def telling(s: Column) -> Column:
        return (F.length(s) > 20) & (
            s.rlike(DIGIT) | let(F.lower(s), lambda t: contains_any(t, tx.COMMITMENT_WORDS[:5])))
    pieces = F.transform(F.split(context, "[.!?]"), strip)
    return F.transform(F.slice(F.filter(pieces, telling), 1, 3), lambda s: F.substring(s, 1, 150))


def evidence(context: Column) -> Column:
    """What in the context supports the claim."""
    def build(c: Column) -> Column:
        year = target_year(c)
        numbers = F.size(F.regexp_extract_all(c, F.lit(ignore_case(tx.NUMERIC_PATTERN)), F.lit(0)))
        words = let(F.lower(c), lambda t: F.filter(
            F.array(*[F.lit(w) for w in tx.COMMITMENT_WORDS]), lambda w: t.contains(w)))
        return let(F.struct(year.alias("y"), numbers.alias("n"), words.alias("w")), lambda e: F.struct(
            e["y"].isNotNull().alias("has_target_year"),
            e["y"].alias("target_year"),
            (e["n"] > 0).alias("has_numeric_data"),
            e["n"].alias("numeric_count"),
            (F.size(e["w"]) > 0).alias("has_commitment_language"),
            F.slice(e["w"], 1, 3).alias("commitment_words"),
            key_phrases(c).alias("key_phrases"),
        ))
    return let(context, build)


def evidence_signals(context: Column) -> Column:
    """What of `evidence` a score needs, without the rest of it."""
    return let(context, lambda c: F.struct(
        target_year(c).isNotNull().alias("has_target_year"),
        c.rlike(DIGIT).alias("has_numeric_data"),
        let(F.lower(c), lambda t: contains_any(t, tx.COMMITMENT_WORDS)).alias("has_commitment_language")))


def clean_text(c: Column) -> Column:
    """White space collapsed, page marks dropped, a text of digits only dropped."""
    mark = rf"(?iu)Page {DIGIT}+ of {DIGIT}+"
    unmarked = let(F.regexp_replace(c, UNEVEN_SPACE, " "), lambda flat: F.when(
        F.lower(flat).contains("page "), F.regexp_replace(flat, mark, "")).otherwise(flat))
    return strip(F.regexp_replace(unmarked, rf"^{DIGIT}+[{SPACE}]*$", ""))


def title_case(c: Column) -> Column:
    """Upper case after every non-letter, as in `3m` -> `3M` (for lower-case ASCII input)."""
    runs = F.regexp_extract_all(c, F.lit("[a-z]+|[^a-z]+"), F.lit(0))
    return F.array_join(F.transform(
        runs, lambda r: F.concat(F.upper(F.substring(r, 1, 1)), F.substring(r, 2, 2147483647))), "")


def normalize_company(c: Column) -> Column:
    kept = squeeze(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), rf"[^a-z0-9{SPACE}]", " "))
    return let(title_case(kept), lambda t: F.when(t == "", "Unknown").otherwise(t))


def company_year_from_filename(c: Column, default_year: int | Column) -> Column:
    """Struct of company and year read from a file name; a year is sought at the start, the end, then anywhere."""
    year = r"(19[0-9]{2}|20[0-9]{2})"
    name = F.regexp_replace(c, r"(?i)\.pdf$", "")
    name = F.regexp_replace(name, rf"[^a-zA-Z0-9{SPACE}_-]", " ")
    name = squeeze(F.regexp_replace(name, r"[_\-]+", " "))
    default = default_year if isinstance(default_year, Column) else F.lit(default_year)

    def parts(n: Column) -> Column:
        head = F.regexp_extract(n, rf"^{year} +(.+)$", 1)
        tail = F.regexp_extract(n, rf"^(.+?) +{year}$", 2)
        inner = F.regexp_extract(n, rf"\b{year}\b", 1)
        return (
            F.when(head != "", F.struct(head.alias("y"), F.regexp_extract(n, rf"^{year} +(.+)$", 2).alias("n")))
            .when(tail != "", F.struct(tail.alias("y"), F.regexp_extract(n, rf"^(.+?) +{year}$", 1).alias("n")))
            .when(inner != "", F.struct(inner.alias("y"), F.regexp_replace(
                n, F.concat(F.lit(r"\b"), inner, F.lit(r"\b")), F.lit("")).alias("n")))
            .otherwise(F.struct(F.lit("").alias("y"), n.alias("n")))
        )
    noise = r"(?i)\b(" + "|".join(tx.FILENAME_NOISE) + r")\b"
    parsed = let(let(name, parts), lambda p: F.struct(
        normalize_company(F.regexp_replace(p["n"], noise, "")).alias("company"),
        F.coalesce(p["y"].try_cast("int"), default).alias("year"),
    ))
    return F.when(F.coalesce(c, F.lit("")) == "", F.struct(
        F.lit("Unknown").alias("company"), default.alias("year"))).otherwise(parsed)


def company_year_rsplit(c: Column) -> Column:
    """Struct of company and year split at the last underscore; (file name, 0) where that fails."""
    def parts(n: Column) -> Column:
        year = let(strip(F.substring_index(n, "_", -1)), lambda y: F.when(
            y.rlike(r"^[+-]?[0-9]+$"), y.try_cast("int")))
        head = F.regexp_extract(n, r"(?s)^(.*)_[^_]*$", 1)
        return F.when(n.contains("_") & year.isNotNull(), F.struct(
            F.translate(head, "_", " ").alias("company"), year.alias("year"),
        )).otherwise(F.struct(c.alias("company"), F.lit(0).alias("year")))
    return let(F.replace(c, F.lit(".pdf"), F.lit("")), parts)


def safe_key(company: Column) -> Column:
    """Company as it appears in file names."""
    return F.translate(company, " /", "__")


def rating_band(rating: Column) -> Column:
    return (
        F.when(rating.isNull() | (rating == 0), "N/A")
        .when(rating >= 4, "green").when(rating >= 3, "yellow").otherwise("red")
    )


def claim_preview(context: Column) -> Column:
    return F.when(F.coalesce(context, F.lit("")) != "",
                  F.concat(F.substring(context, 1, 150), F.lit("...")))


def confidence_band(confidence: Column) -> Column:
    level = F.lower(confidence)
    return F.when(level.isin("high", "medium", "low"), level).otherwise("other")


def plain_number(c: Column) -> Column:
    """A score as text: whole numbers without a fraction."""
    return F.when(c == F.floor(c), F.floor(c).cast("string")).otherwise(c.cast("string"))
