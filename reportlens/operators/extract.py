"""Page text and page tables -> figures. Everything here is narrow: no shuffle.

One row holds one page, so removing repeats on a page is an in-row step.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import taxonomy as tx
from ..functions.patterns import ignore_case, lower_case, portable
from ..functions.text import contains_any, each, let, lower_fold, normalize_unit, one_line, parse_number
from ..schemas import METRICS


def no_metrics() -> Column:
    return F.array().cast(METRICS)


def no_text() -> Column:
    return F.array().cast("array<string>")


def metric(value: Column, unit: Column, page: Column, source: Column) -> Column:
    return F.struct(
        value.alias("value"), unit.alias("unit"), page.cast("int").alias("page"), source.alias("source"))


def text_figures(kind: str, folded: str, lower: str, page: Column, strict_scope: bool = False) -> Column:
    """Figures of one kind in pattern order, then match order; positive numbers only.

    `folded` and `lower` name the columns with the one-line text as `lower_fold` and `lower` give it. Figures hold no letter,
    so patterns in lower case find the same ones there, and a pattern that starts with a plain word is sought in strides.
    `strict_scope` asks for a word start, so that "Indirect emissions" no longer counts as direct.
    """
    found = []
    for literals, pattern in tx.SCOPE_PATTERNS[kind]:
        present = " and ".join(f"contains({lower}, {plain(w)})" for w in literals)
        regex = lower_case(pattern)
        if strict_scope and pattern[0].isalpha():
            regex = r"(?<![\p{L}\p{N}_])" + regex
        found.append(
            f"case when {present} then regexp_extract_all({folded}, {tx.sql_string(regex)}, 1) "
            "else cast(array() as array<string>) end")
    matches = F.expr(f"flatten(array({', '.join(found)}))")
    values = F.filter(F.transform(matches, parse_number), lambda v: v > 0)
    return F.transform(values, lambda v: metric(v, F.lit(tx.SCOPE_UNIT), page, F.lit(tx.TEXT_SOURCE)))


def plain(word: str) -> str:
    return "'\\n'" if word == "\n" else tx.sql_string(word)


def scope_metrics_from_text(pages: DataFrame, strict_scope: bool = False) -> DataFrame:
    """Add one metric array per kind (`scope1`, `scope2`, `scope3`, `total`) read from `text`."""
    ready = (
        pages.withColumn("_clean", one_line(F.coalesce("text", F.lit(""))))
        .withColumn("_lower", F.lower("_clean")).withColumn("_folded", lower_fold(F.col("_clean"), F.col("_lower")))
    )
    kinds = {
        k: text_figures(k, "_folded", "_lower", F.col("page"), strict_scope)
        for k in tx.SCOPE_KINDS
    }
    return ready.withColumns(kinds).drop("_clean", "_lower", "_folded")


CELLS = "array<struct<kind:string,value:double,source:string>>"


def table_cells(tables: Column) -> Column:
    """Positive numbers of a page's tables with the scope kind they count for, in one pass.

    Per table the first row with a header word gives the scope columns; every later row gives
    the cells of those columns, then all its cells if its label names the scope. Within a kind
    the order is table, row, columns, label.
    """
    def cell(kind: Column, value: Column, source: Column) -> Column:
        return F.struct(kind.alias("kind"), value.alias("value"), source.alias("source"))

    def row_cells(row: Column, columns: Column, name: Column) -> Column:
        def from_numbers(numbers: Column) -> Column:
            by_column = F.transform(columns, lambda c: cell(
                c["kind"], F.get(numbers, c["j"]), F.concat(name, F.lit("_col_"), c["j"].cast("string"))))
            by_label = let(F.lower(F.coalesce(F.get(row, F.lit(0)), F.lit(""))), lambda label: F.concat(*[
                F.when(contains_any(label, words), F.transform(
                    F.slice(numbers, 2, F.greatest(F.size(numbers), F.lit(1))),
                    lambda v: cell(F.lit(kind), v, F.concat(name, F.lit("_label"))),
                )).otherwise(F.array().cast(CELLS))
                for kind, words in tx.TABLE_LABEL_WORDS.items()]))
            return F.filter(F.concat(by_column, by_label), lambda c: c["value"] > 0)
        return let(F.transform(row, parse_number), from_numbers)

    def scope_columns(header: Column) -> Column:
        marked = F.transform(header, lambda c, j: let(F.lower(c), lambda low: F.array(*[
            F.struct(F.lit(kind).alias("kind"), F.when(contains_any(low, words), j).alias("j"))
            for kind, words in tx.TABLE_COLUMN_WORDS.items()])))
        return F.filter(F.flatten(marked), lambda m: m["j"].isNotNull())

    def one_table(table: Column, i: Column) -> Column:
        is_header = F.transform(table, lambda r: F.coalesce(let(
            F.lower(F.array_join(r, " ", "")), lambda low: contains_any(low, tx.TABLE_HEADER_WORDS)), F.lit(False)))
        # array_position is 0 where no row is a header; then every row is data and no column is known.
        return let(F.array_position(is_header, True).cast("int"), lambda h: let(
            scope_columns(F.coalesce(F.get(table, h - 1), no_text())), lambda columns: F.flatten(F.transform(
                F.filter(F.slice(table, h + 1, F.size(table)), lambda r: F.size(r) > 0),
                lambda r: row_cells(r, columns, F.concat(F.lit("table_"), i.cast("string")))))))

    return F.flatten(F.transform(
        F.coalesce(tables, F.array().cast("array<array<array<string>>>")),
        lambda t, i: F.when(F.size(t) >= 2, one_table(t, i)).otherwise(F.array().cast(CELLS))))


def figures_of(cells: Column, kind: str, page: Column) -> Column:
    return F.transform(
        F.filter(cells, lambda c: c["kind"] == kind),
        lambda c: metric(c["value"], F.lit(tx.SCOPE_UNIT), page, c["source"]))


def scope_metrics_from_tables(pages: DataFrame) -> DataFrame:
    """Add `scope1`, `scope2`, `scope3` read from `tables`; tables never give a `total`."""
    kinds = {k: figures_of(F.col("_cells"), k, F.col("page")) for k in tx.TABLE_COLUMN_WORDS}
    return pages.withColumn("_cells", table_cells(F.col("tables"))).withColumns(
        {**kinds, "total": no_metrics()}).drop("_cells")


def generic_figures(text: Column, page: Column, fixed_numbers: bool = False) -> Column:
    """All positive numbers with their unit, in text order.

    The text is searched once. A match starts with its number, which never gives back what it took, since all after it is optional.
    """
    number, pattern = (tx.NUMBER_FIXED, tx.NUMERIC_PATTERN_FIXED) if fixed_numbers else (tx.NUMBER, tx.NUMERIC_PATTERN)

    def pair(match: Column) -> Column:
        return let(F.regexp_extract(match, "^" + portable(number), 1), lambda n: F.struct(
            parse_number(n).alias("v"), normalize_unit(F.substring(match, F.length(n) + 1, F.length(match))).alias("u")))
    pairs = F.transform(F.regexp_extract_all(text, F.lit(ignore_case(pattern)), F.lit(0)), pair)
    return F.transform(
        F.filter(pairs, lambda p: p["v"] > 0),
        lambda p: metric(p["v"], p["u"], page, F.lit(None).cast("string")))


def generic_metrics(pages: DataFrame, fixed_numbers: bool = False) -> DataFrame:
    return pages.withColumn(
        "generic", generic_figures(F.coalesce("text", F.lit("")), F.col("page"), fixed_numbers))


def first_per_key(metrics: Column, key) -> Column:
    """Keep the first metric per key, in order: sorted by key and place, then back by place, so a page of n figures takes n log n steps."""
    def heads(ordered: Column) -> Column:
        return F.sort_array(F.transform(
            F.filter(ordered, lambda x, j: (j == 0) | (F.get(ordered, j - 1)["key"] != x["key"])), lambda x: x["at"]))

    def distinct(ms: Column) -> Column:
        keyed = F.sort_array(F.transform(ms, lambda m, i: F.struct(key(m).alias("key"), i.alias("at"))))
        return F.when(F.size(ms) < 2, ms).otherwise(F.transform(let(keyed, heads), lambda at: F.get(ms, at)))
    return let(metrics, distinct)


def value_unit_key(m: Column) -> Column:
    return F.concat_ws("|", m["value"].cast("string"), m["unit"])


def page_metric_dedup(metrics: Column) -> Column:
    """First metric per (value, unit) on a page."""
    return let(metrics, lambda ms: first_per_key(ms, value_unit_key))


def distinct_generic(metrics: Column, page: Column) -> Column:
    """First metric per (value, unit) for figures that carry no source.

    The key holds the whole metric, so `array_distinct` on strings does it in linear time;
    pages with thousands of numbers stay cheap.
    """
    keys = F.array_distinct(F.transform(metrics, value_unit_key))
    return F.transform(keys, lambda k: metric(
        F.substring_index(k, "|", 1).cast("double"), F.substring_index(k, "|", -1), page,
        F.lit(None).cast("string")))


def text_table_union(pages: DataFrame, strict_scope: bool = False) -> DataFrame:
    """Text figures followed by table figures per kind, order kept, repeats kept."""
    both = scope_metrics_from_text(pages, strict_scope).withColumn("_cells", table_cells(F.col("tables")))
    return both.withColumns({
        k: F.concat(F.col(k), figures_of(F.col("_cells"), k, F.col("page"))) for k in tx.TABLE_COLUMN_WORDS
    }).drop("_cells")


def page_metrics(pages: DataFrame, strict_scope: bool = False, fixed_numbers: bool = False) -> DataFrame:
    """All figures of each page, repeats on the page removed; other columns pass through."""
    out = text_table_union(pages, strict_scope)
    out = out.withColumns({k: page_metric_dedup(F.col(k)) for k in tx.SCOPE_KINDS})
    out = generic_metrics(out, fixed_numbers)
    return out.withColumn("generic", distinct_generic(F.col("generic"), F.col("page")))


def metrics_long(page_metrics: DataFrame, kinds: list[str] | None = None) -> DataFrame:
    """One row per figure: kind and position on the page beside the metric's fields."""
    def tag(kind: str) -> Column:
        return F.transform(F.col(kind), lambda m, i: F.struct(
            F.lit(kind).alias("kind"), i.cast("int").alias("ord"), m["value"].alias("value"),
            m["unit"].alias("unit"), m["source"].alias("source")))
    tagged = F.flatten(F.array(*[tag(k) for k in kinds or tx.METRIC_KINDS]))
    keys = ["document_id", "company", "year", "page"]
    return page_metrics.select(*keys, each(tagged).alias("_m")).where(F.col("_m").isNotNull()).select(*keys, "_m.*")
