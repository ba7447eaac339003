"""Page tables, uploads and crawl manifests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..functions.patterns import SPACE
from ..functions.text import company_year_from_filename, let, normalize_company, squeeze, strip

HREF = rf"(?is)<a[{SPACE}](?:[^>]*?[{SPACE}])?href[{SPACE}]*=[{SPACE}]*(\"[^\"]*\"|'[^']*'|[^{SPACE}\"'>]+)"


def page_source(pages: DataFrame) -> DataFrame:
    """Null text to empty, page numbers from 1, blank pages kept."""
    return pages.withColumn("text", F.coalesce("text", F.lit("")))


def read_pages(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """A page table with its schema given; nothing is inferred."""
    return page_source(spark.read.schema(schemas.REPORT_PAGES).format(fmt).load(path))


def line_pages(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Adapter: each line of a document as a page."""
    return documents.select(
        F.col(key).cast("string").alias("document_id"), F.posexplode(F.split(text, "\n")).alias("_i", "text"),
    ).select("document_id", (F.col("_i") + 1).alias("page"), "text")


def upload_intake(uploads: DataFrame) -> DataFrame:
    """PDF names only; company trimmed; the source of the metadata noted."""
    company = F.when(F.coalesce(F.col("company"), F.lit("")) != "", strip(F.col("company")))
    year = F.nullif(F.col("year"), F.lit(0))
    return (
        uploads.where(F.lower("filename").endswith(".pdf"))
        .withColumns({"company": company, "year": year})
        .withColumn("metadata_source", F.when(
            (F.coalesce("company", F.lit("")) != "") & F.col("year").isNotNull(), "api_provided",
        ).otherwise("filename_parsed"))
    )


def metadata_resolve(uploads: DataFrame, default_year: int) -> DataFrame:
    """Company and year of an upload: given values if both are there, else per field from the file name.

    The company is normalised and a year standing in it is dropped.
    """
    parsed = uploads.withColumn("_parsed", company_year_from_filename(F.col("filename"), default_year))
    given = (F.coalesce("company", F.lit("")) != "") & (F.coalesce("year", F.lit(0)) != 0)
    company = normalize_company(F.coalesce(F.nullif(F.col("company"), F.lit("")), F.col("_parsed.company")))
    year = F.coalesce(F.nullif(F.col("year"), F.lit(0)), F.col("_parsed.year"))

    def without_year(both: Column) -> Column:
        bare = squeeze(F.regexp_replace(
            both["c"], F.concat(F.lit(r"\b"), both["y"].cast("string"), F.lit(r"\b")), F.lit("")))
        return let(bare, lambda b: F.struct(
            F.when(b != "", b).otherwise(both["c"]).alias("c"), both["y"].alias("y")))
    return (
        parsed.withColumn("_meta", let(F.struct(company.alias("c"), year.alias("y")), without_year))
        .withColumns({
            "company": F.col("_meta.c"), "year": F.col("_meta.y"),
            "metadata_source": F.when(given, "api_provided").otherwise("filename_parsed")})
        .drop("_parsed", "_meta")
    )


def source_route(manifest: DataFrame, extension: str = ".pdf") -> DataFrame:
    """`direct` for a link to a file, `page` for a page to be scanned."""
    return manifest.withColumn("route", F.when(F.lower("url").endswith(extension), "direct").otherwise("page"))


#: What a browser does not take for markup.
UNSEEN = r"(?is)<!--.*?(?:-->|\z)|<(script|style)\b.*?(?:</\1\s*>|\z)"
#: Entities that stand in link targets; the ampersand comes last, so that nothing is decoded twice.
ENTITIES = {"&lt;": "<", "&gt;": ">", "&quot;": '"', "&#34;": '"', "&apos;": "'", "&#39;": "'", "&#x27;": "'", "&#47;": "/", "&#x2F;": "/", "&#38;": "&", "&amp;": "&"}


def hrefs(html: Column) -> Column:
    """All link targets in document order, without those in comments and scripts; quotes removed, entities decoded."""
    def decoded(h: Column) -> Column:
        h = F.btrim(h, F.lit("\"'"))
        for entity, character in ENTITIES.items():
            h = F.replace(h, F.lit(entity), F.lit(character))
        return h
    return F.transform(F.regexp_extract_all(F.regexp_replace(html, UNSEEN, ""), F.lit(HREF), F.lit(1)), decoded)


#: The five parts of a URI reference: scheme, authority, path, query, fragment.
URI = r"(?s)^(?:([A-Za-z][A-Za-z0-9+.-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?$"
#: Schemes whose references resolve against a path; against others, and to other schemes, a link stays as it is.
HIERARCHICAL = ["", "ftp", "http", "gopher", "nntp", "imap", "wais", "file", "https", "shttp", "mms", "prospero", "rtsp", "rtsps", "rtspu", "sftp", "svn", "svn+ssh", "ws", "wss"]
#: Those of them in which a `;` of the last segment begins parameters.
WITH_PARAMETERS = ["", "ftp", "prospero", "http", "imap", "https", "shttp", "rtsp", "rtsps", "rtspu", "mms", "sftp"]
PARAMETERS = r"(;[^/]*)$"


def _walked(base_path: Column, path: Column) -> Column:
    """The path of a link seen from a page: `.` and `..` segments are taken in turn, `..` above the root stays there."""
    folder = let(F.split(base_path, "/"), lambda p: F.when(F.element_at(p, -1) == "", p).otherwise(F.slice(p, 1, F.size(p) - 1)))
    both = let(F.concat(folder, F.split(path, "/")), lambda p: F.filter(p, lambda x, i: (i == 0) | (i == F.size(p) - 1) | (x != "")))

    def step(acc: Column, p: Column) -> Column:
        return F.when(p == ".", acc).when(p == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.array_append(acc, p))

    def walk(parts: Column) -> Column:
        steps = F.aggregate(parts, F.array().cast("array<string>"), step)
        return F.array_join(F.when(F.element_at(parts, -1).isin(".", ".."), F.array_append(steps, F.lit(""))).otherwise(steps), "/")
    return let(F.when(F.startswith(path, F.lit("/")), F.split(path, "/")).otherwise(both), lambda p: let(walk(p), lambda x: F.when(x == "", "/").otherwise(x)))


def absolute_url(base: str, link: str) -> Column:
    """A link resolved against the address of its page, as an expression; a null or empty one of the two gives the other."""
    def plain(c: str) -> Column:
        return F.regexp_replace(F.regexp_replace(F.coalesce(F.col(c), F.lit("")), r"^[\x00-\x20]+", ""), r"[\t\r\n]", "")

    def parts(x: Column) -> Column:
        return F.struct(*(F.regexp_extract(x, URI, k).alias(n) for k, n in enumerate(("scheme", "authority", "path", "query", "fragment"), 1)))

    def resolved(b: Column, r: Column) -> Column:
        scheme, given = F.lower(b["scheme"]), F.lower(r["scheme"])
        foreign = ((given != "") & (given != scheme)) | ~scheme.isin(HIERARCHICAL)
        # What follows `;` in the last segment is carried along and does not take part in the walk.
        parted = scheme.isin(WITH_PARAMETERS)
        parameters = F.when(parted, F.regexp_replace(F.regexp_extract(r["path"], PARAMETERS, 1), "^;$", "")).otherwise("")
        bare = F.when(parted, F.regexp_replace(r["path"], PARAMETERS, "")).otherwise(r["path"])
        own, same = r["authority"] != "", (bare == "") & (parameters == "")
        page = F.when(parted, F.regexp_replace(b["path"], r"^((?:.*/)?[^/;]*);$", "$1")).otherwise(b["path"])
        path = F.when(own, F.concat(bare, parameters)).when(same, page).otherwise(
            F.concat(_walked(F.when(parted, F.regexp_replace(page, PARAMETERS, "")).otherwise(page), bare), parameters))
        query = F.when(~own & same & (r["query"] == ""), b["query"]).otherwise(r["query"])
        authority = F.when(own, r["authority"]).otherwise(b["authority"])

        def written(p: Column) -> Column:
            rooted = F.startswith(p, F.lit("/"))
            return (
                F.when(authority != "", F.concat(F.lit("//"), authority, F.when((p != "") & ~rooted, "/").otherwise(""), p))
                .when(F.startswith(p, F.lit("//")) | (scheme != "") & ((p == "") | rooted), F.concat(F.lit("//"), p)).otherwise(p))
        whole = F.concat(
            F.when(scheme != "", F.concat(scheme, F.lit(":"))).otherwise(""), let(path, written), F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""),
            F.when(r["fragment"] != "", F.concat(F.lit("#"), r["fragment"])).otherwise(""))
        return F.when(foreign, F.col(link)).otherwise(whole)

    joined = let(parts(plain(base)), lambda b: let(parts(plain(link)), lambda r: resolved(b, r)))
    return F.when(F.coalesce(F.col(base), F.lit("")) == "", F.col(link)).when(F.coalesce(F.col(link), F.lit("")) == "", F.col(base)).otherwise(joined)


def link_extract(pages: DataFrame, extension: str = ".pdf") -> DataFrame:
    """First link of each page whose target contains the extension, made absolute; pages without one drop out."""
    wanted = F.filter(hrefs(F.col("html")), lambda h: F.lower(h).contains(extension))
    return (
        pages.select("page_id", "url", F.get(wanted, F.lit(0)).alias("href")).where(F.col("href").isNotNull())
        .withColumn("link", absolute_url("url", "href"))
    )
