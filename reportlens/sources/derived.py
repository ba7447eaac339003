"""Tables derived from the given ones, so that every query's work grows with them.

Each text runs unchanged in Spark and in DuckDB, except for the list constructor, which the
caller fills in. Nothing is sampled or cut: all rows of the source tables take part.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import spread

SPARK_DIALECT = {"list": "array", "null_text": "cast(null as string)"}
DUCKDB_DIALECT = {"list": "list_value", "null_text": "cast(null as string)"}

# One page per (supplier, shipping year, line number).
REPORT_PAGES_SQL = """
select concat(replace(company, '#', '_'), '_', cast(year as string)) as document_id, company, year, page,
 case when page = 7 and n % 5 = 0 then {null_text} else concat(
  'Scope 1 emissions: ', cast(q as string), ' tCO2e. ',
  'Indirect emissions: ', cast(n as string), '. ',
  'We are committed to net zero by ', cast(2030 + page * 5 as string), '. ',
  case
   when page % 4 = 0 then 'Renewable energy reached 4,500 MWh across our plants.  We plan more solar energy!'
   when page % 4 = 1 then concat('Water consumption fell 12 % this year! Our goal for ', cast(year + 9 as string),
     ' is that waste generated stays under ', cast(n as string), ' tonnes. ')
   when page % 4 = 2 then concat('Scope 3: ', grouped, ' tonnes CO2e and under FY2024: ', cast(n * 7 as string),
     '. Business travel emissions ', cast(n as string), ' and soil kept in an oil-free habitat. ',
     repeat('Our strategy is to invest in people and places near every plant we run. ', 8))
   else concat('In ', cast(year as string), ' the GRI index lists', chr(10), 'Scope 2 (market-based): ', grouped,
     chr(10), 'with 12 345 kWh, 7 large sites and 1,', chr(10), '200 m3?  Energy consumption was ',
     cast(q as string), '.5 GWh. | Scope 1 | ', cast(n as string), ' ')
  end,
  'Total GHG emissions: ', cast(n * 3 as string)) end as text,
 case when page = 5 then null else {list}(
  {list}({list}('Category', 'Scope 1', 'Scope 2'),
   {list}('Total', cast(q as string), cast(n as string)),
   {list}('Direct emissions', cast(n as string), 'n/a', {null_text}),
   {list}('Indirect energy', grouped, '-5'),
   {list}('Scope 3 travel', '1,200.', '0', cast(n as string))),
  {list}({list}('Scope 1', '99')),
  {list}({list}('alpha', '3'), {list}('Value chain', '4', cast(q as string))),
  {list}({list}('Site', 'Area'), {list}('GHG type', 'scope1 (t)', 'Scope 3'), {list}('North', grouped, '12,5'))
 ) end as tables
from page_facts g
"""
PAGE_FACTS_SQL = """
select s.s_name as company, cast(year(l.l_shipdate) as int) as year, cast(l.l_linenumber as int) as page,
 cast(sum(l.l_quantity) as bigint) as q, count(*) as n,
 concat(cast(1 + max(l.l_orderkey) % 9 as string), ',', lpad(cast(sum(l.l_partkey) % 1000 as string), 3, '0')) as grouped
from lineitem l join supplier s on l.l_suppkey = s.s_suppkey
group by s.s_name, year(l.l_shipdate), l.l_linenumber
"""

# One upload per report; a third lacks company and year, some file names are not PDF.
UPLOADS_SQL = """
select document_id as id,
 case
  when year % 3 = 0 then concat(cast(year as string), '_', company, '_Sustainability_Report.pdf')
  when year % 3 = 1 then concat(company, ' ESG annual report ', cast(year as string), '.PDF')
  when pages % 2 = 0 then concat(company, '-', cast(year as string), '-csr.docx')
  else concat('Notes ', cast(year as string), ' of ', company, '.pdf')
 end as filename,
 case when year % 3 = 1 then {null_text} else concat(' ', company, ' ', cast(year as string), ' ') end as company,
 case when year % 3 = 2 then 0 else year end as year
from (
 select concat(replace(s.s_name, '#', '_'), '_', cast(year(l.l_shipdate) as string)) as document_id,
  s.s_name as company, cast(year(l.l_shipdate) as int) as year, count(distinct l.l_linenumber) as pages
 from lineitem l join supplier s on l.l_suppkey = s.s_suppkey
 group by s.s_name, year(l.l_shipdate)
) g
"""

# One model answer per report: valid, fenced, wrapped in prose, broken, out of range, missing.
AUDIT_RESPONSES_SQL = """
select document_id,
 case
  when n % 13 = 0 then {null_text}
  when year % 6 = 0 then concat('{{"overall_score": 4, "overall_summary": "Figures of ', company,
   ' hold up", "claim_reviews": [{{"claim": "scope 1", "page": 1, "score": 5, "reason": "stated on page 1", "citations": [1, 2]}},',
   ' {{"claim": "net zero", "page": 2, "score": 2.5, "reason": "", "citations": []}},',
   ' {{"claim": "scope 1", "page": 1, "score": 1, "reason": "later repeat", "citations": [9]}}]}}')
  when year % 6 = 1 then concat('Here it is:', chr(10), '```json', chr(10),
   '{{"overall_score": ', cast(1 + n % 5 as string), ', "overall_summary": "Mixed", "claim_reviews": []}}', chr(10), '```')
  when year % 6 = 2 then concat('I think {{"overall_score": 3.5, "overall_summary": "Wrapped in prose", "claim_reviews": ',
   '[{{"claim": "GRI", "page": 3, "score": 3, "reason": "index given", "citations": [3]}}]}} is fair')
  when year % 6 = 3 then 'no JSON {{ at all'
  when year % 6 = 4 then '{{"overall_score": 9, "overall_summary": "Out of range", "claim_reviews": []}}'
  else '{{"overall_score": 2, "overall_summary": "Bad review", "claim_reviews": [{{"claim": "scope 1", "score": "high"}}]}}'
 end as raw_text,
 case when n % 11 = 0 then 'quota exceeded' else {null_text} end as error
from (
 select concat(replace(s.s_name, '#', '_'), '_', cast(year(l.l_shipdate) as string)) as document_id,
  s.s_name as company, cast(year(l.l_shipdate) as int) as year, count(*) as n
 from lineitem l join supplier s on l.l_suppkey = s.s_suppkey
 group by s.s_name, year(l.l_shipdate)
) g
"""

# One stored vector per row of `embeddings`.
VECTOR_CHUNKS_SQL = """
select vec_id as chunk_id, concat('Company ', cast(vec_id % 7 as string)) as company,
 cast(2018 + label as int) as year, cast(vec_id % 40 + 1 as int) as page,
 concat('Passage ', cast(vec_id as string)) as content, label, embedding
from embeddings
"""

# Questions are the vectors of all rows whose id is divisible by 100, against all rows.
SEARCH_QUERIES_SQL = """
select vec_id as query_id, concat('Question about passage ', cast(vec_id as string)) as question,
 case when n % 3 = 0 then {null_text} when n % 3 = 1 then 'PANY ' else 'company 3' end as company,
 case when n % 4 = 3 then cast(2018 + label as int) else cast(null as int) end as year, embedding
from (select vec_id, label, embedding, cast(floor(vec_id / 100) as int) as n from embeddings where vec_id % 100 = 0) q
"""

# Pages expected for each question; every fifth stays unjudged.
JUDGEMENTS_SQL = """
select vec_id as query_id,
 case when n % 5 = 4 then 'comparative' when n % 2 = 0 then 'numeric' else 'target' end as category,
 cast(vec_id % 40 + 1 as int) as first_page, cast((vec_id + label * 7) % 40 + 1 as int) as last_page,
 n % 5 <> 4 as judged
from (select vec_id, label, cast(floor(vec_id / 100) as int) as n from embeddings where vec_id % 100 = 0) q
"""

# One timed document per user of the event stream.
TIMINGS_SQL = """
select user_id as document_id, cast(round(sum(value), 4) as double) as total_time,
 cast(case when count(*) % 7 = 0 then null else count(*) % 50 end as int) as pages
from events group by user_id
"""

TEMPLATES = {
    "uploads": UPLOADS_SQL, "audit_responses": AUDIT_RESPONSES_SQL, "vector_chunks": VECTOR_CHUNKS_SQL,
    "search_queries": SEARCH_QUERIES_SQL, "judgement_rows": JUDGEMENTS_SQL, "timings": TIMINGS_SQL,
    "page_facts": PAGE_FACTS_SQL, "report_pages": REPORT_PAGES_SQL,
}
SOURCES = ("lineitem", "supplier", "embeddings", "events")


def duckdb_sql(name: str) -> str:
    """The derived table's text for DuckDB."""
    text = TEMPLATES[name].format(**DUCKDB_DIALECT)
    return text.replace("from page_facts g", f"from ({PAGE_FACTS_SQL}) g")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def bound(spark: SparkSession, text: str, **frames: DataFrame) -> DataFrame:
    """Run SQL text with its tables bound as arguments, so that no view is left behind."""
    text = text.replace("{", "{{").replace("}", "}}")
    for name in frames:
        text = re.sub(rf"\b(from|join) {name}\b", rf"\1 {{{name}}}", text)
    return spark.sql(text, **frames)


def derived(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    text = TEMPLATES[name].format(**SPARK_DIALECT)
    used = [s for s in SOURCES if re.search(rf"\b(from|join) {s}\b", text)]
    return bound(spark, text, **{s: table(spark, sf_dir, s) for s in used})


def texts(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table whose texts need much work per byte."""
    return spread(table(spark, sf_dir, name))


#: Bytes of the facts behind the pages of one task, and behind the least that is worth one.
PART_BYTES, LEAST_BYTES = 2 << 20, 256 << 10


def page_parts(spark: SparkSession, sf_dir: str) -> int:
    """Tasks for the pages. Their number follows the stored bytes of `lineitem`, so a task's work and memory do not grow with the input."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{sf_dir.rstrip('/')}/lineitem.parquet")
    size = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getContentSummary(path).getLength()
    return max(-(-size // PART_BYTES), min(spark.sparkContext.defaultParallelism, -(-size // LEAST_BYTES)), 1)


def report_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Derived pages, dealt out by page before their text is built, since a page is few bytes and much work.

    Partitions of a size in bytes would hold millions of pages. Dealing out single pages also shares out a report of very many pages.
    """
    facts = derived(spark, sf_dir, "page_facts").repartition(page_parts(spark, sf_dir))
    return bound(spark, REPORT_PAGES_SQL.format(**SPARK_DIALECT), page_facts=facts)


def uploads(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = derived(spark, sf_dir, "uploads")
    return out.withColumn("uploaded_at", F.make_timestamp(
        F.lit(2024), F.lit(1), F.lit(1), F.lit(0), F.lit(0), F.lit(0)))


def audit_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derived(spark, sf_dir, "audit_responses")


def judgements(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derived(spark, sf_dir, "judgement_rows").select(
        "query_id", "category",
        F.when(F.col("judged"), F.array("first_page", "last_page")).alias("expected_pages"))
