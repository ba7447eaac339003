"""SQL twins of the registered queries for DuckDB, formulated apart from the Spark operators.

Python only pastes text together here (named subqueries and repeated expressions).
"""

from __future__ import annotations

from .. import taxonomy as tx
from ..functions import answers as A
from ..functions.patterns import DIGIT, SPACE, WHITESPACE, portable
from ..functions.text import NUMBER_SHAPE, normalize_unit_py
from ..sources.derived import duckdb_sql

TWINS: dict[str, str] = {}


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


WS = lit(WHITESPACE)
NUM = lit("(?i)" + portable(tx.NUMERIC_PATTERN))
WORDS = "[" + ", ".join(lit(w) for w in tx.COMMITMENT_WORDS) + "]"
FIRST_WORDS = "[" + ", ".join(lit(w) for w in tx.COMMITMENT_WORDS[:5]) + "]"


def strip(x: str) -> str:
    return f"trim({x}, {WS})"


def squeeze(x: str) -> str:
    return f"trim(regexp_replace({x}, '[{SPACE}]+', ' ', 'g'))"


def number(x: str) -> str:
    d = strip(f"rtrim(replace(replace({x}, ',', ''), ' ', ''), '.')")
    return (f"case when regexp_matches({d}, {lit(NUMBER_SHAPE)}) or regexp_matches({d}, '(?i)^[+-]?inf(inity)?$') "
            f"then try_cast(replace({d}, '_', '') as double) end")


def unit(x: str) -> str:
    u = strip(f"lower(coalesce({x}, ''))")
    return f"""(case when contains({u}, 'tco2') or contains({u}, 't co2') or contains({u}, 'tonnes co2e') then 'tCO2e'
 when contains({u}, 'tj') then 'TJ' when contains({u}, 'gwh') then 'GWh' when contains({u}, 'mwh') then 'MWh'
 when contains({u}, 'kwh') then 'kWh' when contains({u}, 'percent') or {u} = '%' then '%'
 when contains({u}, 'tonne') or {u} = 't' then 'tonnes' when {u} = 'kg' then 'kg'
 when {u} in ('m3', 'm³') then 'm3' when {u} = 'ml' then 'ML' else {u} end)"""


def year_of(x: str) -> str:
    low, high = tx.TARGET_YEAR_RANGE
    picks = []
    for _, p in tx.TARGET_YEAR_PATTERNS:
        y = f"try_cast(regexp_extract(lower({x}), {lit(portable(p))}, 1) as integer)"
        picks.append(f"case when {y} between {low} and {high} then {y} end")
    return "coalesce(" + ", ".join(picks) + ")"


def raw_sentences(x: str) -> str:
    return f"string_split(regexp_replace({x}, '([.!?])[{SPACE}]+', '\\1' || chr(1), 'g'), chr(1))"


def sentences(x: str) -> str:
    return f"list_filter(list_transform({raw_sentences(x)}, lambda s: {strip('s')}), lambda s: length(s) > 0)"


def char_context(text: str = "text", at: str = "pos_", kw: str = "claim") -> str:
    start = f"greatest(0, {at} - 300)"
    return strip(f"replace(substr({text}, {start} + 1, {at} + length({kw}) + 300 - {start}), chr(10), ' ')")


def clean(x: str) -> str:
    flat = f"regexp_replace({x}, '[{SPACE}]+', ' ', 'g')"
    unmarked = f"regexp_replace({flat}, '(?i)Page {DIGIT}+ of {DIGIT}+', '', 'g')"
    return strip(f"regexp_replace({unmarked}, '^{DIGIT}+[{SPACE}]*$', '', 'g')")


def key_phrases(x: str) -> str:
    pieces = f"list_transform(regexp_split_to_array({x}, '[.!?]'), lambda s: {strip('s')})"
    telling = (f"lambda s: length(s) > 20 and (regexp_matches(s, '{DIGIT}') or "
               f"len(list_filter({FIRST_WORDS}, lambda w: contains(lower(s), w))) > 0)")
    return f"list_transform(list_filter({pieces}, {telling})[1:3], lambda s: substr(s, 1, 150))"


def found_words(x: str) -> str:
    return f"list_filter({WORDS}, lambda w: contains(lower({x}), w))"


def numbers(x: str) -> str:
    return f"len(regexp_extract_all({x}, {NUM}))"


def evidence_columns(x: str) -> str:
    return f"""{year_of(x)} is not null as has_target_year, {year_of(x)} as target_year,
 {numbers(x)} > 0 as has_numeric_data, cast({numbers(x)} as integer) as numeric_count,
 len({found_words(x)}) > 0 as has_commitment_language,
 coalesce(array_to_string({found_words(x)}[1:3], ' | '), '') as commitment_words,
 coalesce(array_to_string({key_phrases(x)}, ' | '), '') as key_phrases"""


def words_match(x: str, words: list[str]) -> str:
    return "(" + " or ".join(f"contains({x}, {lit(w)})" for w in words) + ")"


# ---------------------------------------------------------------- named subqueries

PARTS: dict[str, tuple[tuple[str, ...], str]] = {}


def part(name: str, sql: str, *needs: str) -> None:
    PARTS[name] = (needs, sql)


def use(sql: str, *needs: str) -> str:
    """`sql` behind the named subqueries it needs, each once, in order of need."""
    order: list[str] = []

    def visit(n: str) -> None:
        if n not in order:
            for m in PARTS[n][0]:
                visit(m)
            order.append(n)
    for n in needs:
        visit(n)
    ctes = ",\n".join(f"{n} as materialized ({PARTS[n][1]})" for n in order)
    return f"with recursive {ctes}\n{sql}" if ctes else sql


def twin(name: str, sql: str, *needs: str) -> None:
    TWINS[name] = use(sql, *needs)


part("pages_", duckdb_sql("report_pages"))
part("rp", "select * replace (coalesce(text, '') as text), text is null as no_text from pages_", "pages_")
part("up", duckdb_sql("uploads"))
part("resp", duckdb_sql("audit_responses"))
part("vec", duckdb_sql("vector_chunks"))
part("ask", duckdb_sql("search_queries"))
part("judge", "select query_id, category, case when judged then [first_page, last_page] end as expected from ("
     + duckdb_sql("judgement_rows") + ")")
part("timing", duckdb_sql("timings"))

_text_kinds = []
for _kind, _patterns in tx.SCOPE_PATTERNS.items():
    _lists = ", ".join(
        f"regexp_extract_all(replace(text, chr(10), ' '), {lit('(?i)' + portable(p))}, 1)" for _, p in _patterns)
    _text_kinds.append(
        f"select document_id, company, year, page, {lit(_kind)} as kind, "
        f"list_filter(list_transform(flatten([{_lists}]), lambda s: {number('s')}), lambda v: v > 0) as vs from rp")
part("text_lists", " union all ".join(_text_kinds), "rp")
part("text_figs", "select document_id, company, year, page, kind, unnest(vs) as value, "
     "generate_subscripts(vs, 1) - 1 as ord from text_lists", "text_lists")

part("tabs", f"""select document_id, company, year, page, ti, t,
 coalesce(list_position(list_transform(t, lambda r: {words_match("lower(array_to_string(list_transform(r, lambda c: coalesce(c, '')), ' '))", tx.TABLE_HEADER_WORDS)}), true), 0) as h
 from (select document_id, company, year, page, unnest(tables) as t, generate_subscripts(tables, 1) - 1 as ti from rp)
 where len(t) >= 2""", "rp")
part("tab_rows", """select document_id, company, year, page, ti, h, head, r, ri from (
 select *, t[h] as head, unnest(t) as r, generate_subscripts(t, 1) as ri from tabs) where ri > h and len(r) > 0""", "tabs")
part("tab_cells", f"""select * from (select *, unnest(r) as cell, generate_subscripts(r, 1) as ci, lower(coalesce(r[1], '')) as label from tab_rows)""", "tab_rows")
_table_kinds = []
for _kind in tx.TABLE_COLUMN_WORDS:
    _col = words_match("lower(coalesce(head[ci], ''))", tx.TABLE_COLUMN_WORDS[_kind])
    _lab = words_match("label", tx.TABLE_LABEL_WORDS[_kind])
    _table_kinds.append(
        f"select document_id, company, year, page, {lit(_kind)} as kind, ti, ri, 0 as rule, ci, {number('cell')} as value, "
        f"concat('table_', ti, '_col_', ci - 1) as source from tab_cells where h > 0 and {_col}")
    _table_kinds.append(
        f"select document_id, company, year, page, {lit(_kind)} as kind, ti, ri, 1 as rule, ci, {number('cell')} as value, "
        f"concat('table_', ti, '_label') as source from tab_cells where ci >= 2 and {_lab}")
part("table_figs", "select *, row_number() over (partition by document_id, page, kind order by ti, ri, rule, ci) - 1 as ord from ("
     + " union all ".join(_table_kinds) + ") where value > 0", "tab_cells")
part("both_figs", """select *, row_number() over (partition by document_id, page, kind order by place, o) - 1 as ord from (
 select document_id, company, year, page, kind, value, 'text_extraction' as source, 0 as place, ord as o from text_figs
 union all select document_id, company, year, page, kind, value, source, 1, ord from table_figs)""", "text_figs", "table_figs")


def generic_rows(table: str, text: str, keys: str) -> str:
    return f"""select {keys}, value, unit, row_number() over (partition by {keys} order by i) - 1 as ord from (
 select {keys}, i, {number('n')} as value, {unit('u')} as unit from (
  select {keys}, unnest(regexp_extract_all({text}, {NUM}, 1)) as n, unnest(regexp_extract_all({text}, {NUM}, 2)) as u,
   generate_subscripts(regexp_extract_all({text}, {NUM}, 1), 1) as i from {table})) where value > 0"""


part("generic_figs", generic_rows("rp", "text", "document_id, company, year, page"), "rp")
part("figs", """select document_id, company, year, page, kind, value, unit, source,
  row_number() over (partition by document_id, page, kind order by o) - 1 as ord from (
 select document_id, company, year, page, kind, value, 'tCO2e' as unit, source, ord as o,
  row_number() over (partition by document_id, page, kind, value order by ord) as rn from both_figs
 union all select document_id, company, year, page, 'generic', value, unit, null, ord,
  row_number() over (partition by document_id, page, value, unit order by ord) from generic_figs) where rn = 1""",
     "both_figs", "generic_figs")
# Figures of the report level: also distinct by value on each page.
part("rfigs", """select document_id, company, year, page, kind, value, unit,
  row_number() over (partition by document_id, page, kind order by o) - 1 as ord from (
 select *, ord as o, row_number() over (partition by document_id, page, kind, value order by ord) as rn2 from figs where kind <> 'total')
 where rn2 = 1""", "figs")
part("docs_", "select document_id, company, year, count(*) as pages from rp group by all", "rp")
part("totals", "select d.document_id, d.company, d.year, " + ", ".join(
    f"coalesce(sum(value) filter (kind = '{k}'), 0) as {k}_total, cast(count(value) filter (kind = '{k}') as integer) as {k}_count"
    for k in ("scope1", "scope2", "scope3")) + " from docs_ d left join rfigs f using (document_id) group by all", "docs_", "rfigs")

part("kw", "select * from (values " + ", ".join(
    f"({i}, {lit(k)}, {lit(k.lower())}, {lit(tx.base_keyword(k))})" for i, k in enumerate(tx.claim_keywords()))
    + ") v(keyword_ord, claim, needle, base)")
part("cat", "select keyword, min(category) as category from (values " + ", ".join(
    f"({lit(c)}, {lit(k)})" for c, ws in tx.KEYWORDS.items() for k in ws) + ") v(category, keyword) group by keyword")
part("hits_", """select document_id, company, year, page, text, keyword_ord, claim, base, strpos(lower(text), needle) - 1 as pos_
 from rp join kw on contains(lower(text), needle)""", "rp", "kw")


def context_steps(source: str, keys: str) -> str:
    """Sentence context with running offsets; characters where no sentence covers the place."""
    return f"""select {keys}, case when idx is null then {char_context()} when length(j) > 500 then substr(j, 1, 500) || '...' else j end as sent,
 {char_context()} as chars from (
 select *, {strip("replace(array_to_string(s[greatest(1, idx - 3):idx + 3], ' '), chr(10), ' ')")} as j from (
  select *, list_filter(range(1, len(s) + 1), lambda i: st[i] <= pos_ and pos_ < st[i] + length(s[i]))[1] as idx from (
   select *, list_transform(range(1, len(s) + 1), lambda i: coalesce(list_sum(list_transform(s[1:i - 1], lambda x: length(x) + 1)), 0)) as st from (
    select *, {raw_sentences('text')} as s from {source}))))"""


part("claims_", f"""select * exclude (sent, chars), case when length(sent) < 50 then chars else sent end as context from (
 {context_steps('hits_', 'document_id, company, year, page, keyword_ord, claim, base')})""", "hits_")
part("ev", f"select *, {evidence_columns('context')} from claims_", "claims_")

_allowed = []
for _name, _units in tx.CLAIM_UNITS.items():
    for _u in sorted({normalize_unit_py(u) for u in _units}):
        _allowed.append(f"({lit(_name)}, {lit(_u)})")
part("allowed", f"select * from (values {', '.join(_allowed)}) v(claim, unit)")
EMISSION = "claim in (" + ", ".join(lit(c) for c in tx.EMISSIONS_CLAIMS) + ")"
part("figsum", """select document_id, page, """ + ", ".join(
    f"cast(count(*) filter (kind = '{k}') as integer) as {k}" for k in tx.METRIC_KINDS) + " from figs group by all", "figs")
part("kept", """select h.document_id, h.page, h.claim, cast(count(f.value) as integer) as n_kept, coalesce(sum(f.value), 0) as sum_kept
 from hits_ h left join figs f on f.document_id = h.document_id and f.page = h.page and f.kind = 'generic'
  and (f.unit = '' or exists (select 1 from allowed a where a.claim = h.claim and a.unit = f.unit))
 group by all""", "hits_", "figs", "allowed")
part("choice", f"""select k.document_id, k.page, k.claim,
 case when {EMISSION.replace('claim in', 'k.claim in')} then coalesce(s.scope1, 0) else 0 end as n_scope1,
 case when {EMISSION.replace('claim in', 'k.claim in')} then coalesce(s.scope2, 0) else 0 end as n_scope2,
 case when {EMISSION.replace('claim in', 'k.claim in')} then coalesce(s.scope3, 0) else 0 end as n_scope3,
 case when {EMISSION.replace('claim in', 'k.claim in')} then 0 else k.n_kept end as n_generic
 from kept k left join figsum s using (document_id, page)""", "kept", "figsum")


def tier_list(name: str) -> str:
    return ", ".join(lit(k) for k in tx.PRIORITY_TIERS[name])


TIER = f"case when lower(claim) in ({tier_list('high')}) then 'high' when lower(claim) in ({tier_list('medium')}) then 'medium' when lower(claim) in ({tier_list('low')}) then 'low' else 'other' end"
part("scored", f"""select e.*, cast(
  case {TIER.replace('claim)', 'e.claim)')} when 'high' then 40 when 'medium' then 20 when 'low' then 5 else 10 end
  + case when has_target_year then 15 else 0 end + case when has_numeric_data then 10 else 0 end
  + case when has_commitment_language then 5 else 0 end
  + case when length(context) > 200 then 20 when length(context) > 100 then 10 when length(context) > 50 then 5 else 0 end
  + case when c.n_scope1 > 0 or c.n_scope2 > 0 then 10 when c.n_generic > 0 then 5 else 0 end as integer) as score
 from ev e join choice c using (document_id, page, claim)""", "ev", "choice")
part("distinct_claims", """select * exclude (rn) from (select *, row_number() over (
 partition by document_id, page, base order by keyword_ord) as rn from scored) where rn = 1""", "scored")
part("picked", """select * from (select *, cast(row_number() over (
 partition by document_id order by score desc, page, keyword_ord) as integer) as claim_rank from distinct_claims) where claim_rank <= 20""", "distinct_claims")


def json_pick(raw: str) -> str:
    r = strip(raw)
    fenced = f"regexp_extract({r}, {lit(A.FENCED)}, 1)"
    braced = f"regexp_extract({r}, {lit(A.BRACED)}, 0)"
    return f"case when json_valid({r}) then {r} when {fenced} <> '' and json_valid({fenced}) then {fenced} when {braced} <> '' and json_valid({braced}) then {braced} end"


def num_json(path: str, j: str = "j") -> str:
    return f"case when json_type({j}, '{path}') in ('BIGINT', 'UBIGINT', 'DOUBLE') then cast(json_extract_string({j}, '{path}') as double) end"


part("parsed", f"""select document_id, raw_text, error, j, {num_json('$.overall_score')} as overall_score,
 json_extract_string(j, '$.overall_summary') as overall_summary,
 case when json_type(j, '$.claim_reviews') = 'ARRAY' then json_array_length(j, '$.claim_reviews') end as reviews
 from (select document_id, raw_text, error, case when json_type(p) = 'OBJECT' and json_exists(p, '$.overall_score') and json_exists(p, '$.claim_reviews') then p end as j
  from (select *, {json_pick('raw_text')} as p from resp))""", "resp")
part("review_rows", f"""select document_id, i, json_extract_string(r, '$.claim') as claim,
 try_cast(json_extract_string(r, '$.page') as integer) as page, {num_json('$.score', 'r')} as score,
 json_extract_string(r, '$.reason') as reason,
 array_to_string(cast(json_extract_string(r, '$.citations[*]') as varchar[]), ', ') as cited from (
 select document_id, unnest(range(0, cast(reviews as bigint))) as i, json_extract(j, '$.claim_reviews[' || unnest(range(0, cast(reviews as bigint))) || ']') as r
 from parsed where reviews > 0)""", "parsed")
part("bad_reviews", "select distinct document_id from review_rows where claim is null or score is null or not score between 1 and 5", "review_rows")
part("valid", """select p.document_id, overall_score, overall_summary from parsed p where j is not null and overall_score between 1 and 5
 and reviews is not null and document_id not in (select document_id from bad_reviews)""", "parsed", "bad_reviews")
part("n_picked", "select document_id, count(*) as n from picked group by all", "picked")
part("reports", f"""select t.*, coalesce(n.n, 0) as n_claims, 'Sustainability Report' as source,
 case when coalesce(n.n, 0) = 0 then 'no_claims' when p.error is not null then 'error' when p.raw_text is null then 'missing'
  when p.j is null then 'unparsed' when v.document_id is not null then 'valid' else 'invalid' end as status,
 case when coalesce(n.n, 0) > 0 and p.error is null then v.overall_score end as leaf_rating,
 coalesce(case when coalesce(n.n, 0) = 0 then {lit(A.NO_CLAIMS)}
  when p.error is not null then 'Audit failed: API error: ' || p.error when p.raw_text is null then 'Audit failed: No response candidates'
  when p.j is null then {lit(A.PARSE_FAILED)} when v.document_id is not null then v.overall_summary
  else 'Audit failed: Max retries exceeded' end, '') as ai_summary
 from totals t left join n_picked n using (document_id) left join parsed p using (document_id) left join valid v using (document_id)""",
     "totals", "n_picked", "parsed", "valid")
part("reviewed", f"""select p.*, case when r.status = 'valid' then w.score end as r_score,
 case when r.status = 'valid' then w.reason when r.status in ('error', 'missing', 'invalid') then {lit(A.REVIEW_FAILED)} end as r_reason,
 case when r.status = 'valid' then w.cited when r.status in ('error', 'missing', 'invalid') then '' end as r_cited,
 r.status in ('error', 'missing', 'invalid') or w.i is not null and r.status = 'valid' as has_review
 from picked p join reports r using (document_id)
 left join (select *, row_number() over (partition by document_id, claim, page order by i) as rn from review_rows) w
  on w.document_id = p.document_id and w.claim = p.claim and w.page = p.page and w.rn = 1""", "picked", "reports", "review_rows")

HEAD = "concat('Company: ', company, ' (', year, ')')"
SCORE_TEXT = "coalesce(case when r_score = floor(r_score) then cast(cast(r_score as bigint) as varchar) else cast(r_score as varchar) end, 'N/A')"
part("claim_chunks", f"""select * from (select document_id, company, year, page, claim_rank as chunk_index, concat_ws(' | ', {HEAD},
  'Sustainability Claim: ' || claim, 'Target Year: ' || cast(target_year as varchar),
  case when {clean('context')} <> '' then 'Context: ' || {clean('context')} end,
  case when has_review then 'AI Assessment Score: ' || {SCORE_TEXT} || '/5' end,
  case when r_reason <> '' then 'Analysis: ' || r_reason end,
  case when r_cited <> '' then 'Referenced Pages: ' || r_cited end) as content from reviewed) where length(content) >= 100""", "reviewed")
part("summary_chunks", f"""select document_id, company, year, 1 as page, 0 as chunk_index, concat({HEAD}, '. Overall Assessment: ', ai_summary) as content
 from reports where ai_summary <> ''""", "reports")
part("sums", """select r.document_id, r.company, r.year, r.page, coalesce(sum(value) filter (kind = 'scope1'), 0) as scope1_sum,
 coalesce(sum(value) filter (kind = 'scope2'), 0) as scope2_sum, count(*) filter (kind = 'scope1') as c1, count(*) filter (kind = 'scope2') as c2
 from rp r left join figs f on f.document_id = r.document_id and f.page = r.page group by all""", "rp", "figs")
part("em_chunks", f"""select document_id, company, year, page, cast(row_number() over (partition by document_id order by page) - 1 as integer) as chunk_index,
 concat({HEAD}, '. ', case when c1 > 0 then printf('Scope 1 emissions: %.2f tCO2e. ', scope1_sum) else '' end,
  case when c2 > 0 then printf('Scope 2 emissions: %.2f tCO2e. ', scope2_sum) else '' end) as content
 from (select *, row_number() over (partition by document_id order by page) as pn from sums) where pn <= 5 and (c1 > 0 or c2 > 0)""", "sums")

PAIRS = """select a.query_id, v.chunk_id, v.company, v.year, v.page, v.content,
 round(list_cosine_similarity(cast(v.embedding as double[]), cast(a.embedding as double[])), 12) as similarity
 from vec v join ask a on (a.company is null or contains(lower(v.company), lower(a.company))) and (a.year is null or v.year = a.year)"""
part("pairs", f"{PAIRS} where v.embedding is not null", "vec", "ask")


def topk(threshold: float, k: int = 5, source: str = "pairs", op: str = ">") -> str:
    return f"""select * from (select *, cast(row_number() over (partition by query_id order by similarity desc, chunk_id) as integer) as rank
 from {source} where similarity {op} {threshold}) where rank <= {k}"""


part("hits5", topk(0.05), "pairs")
part("judged", """select h.*, j.category, list_contains(j.expected, h.page) as hit from hits5 h join judge j using (query_id) where len(j.expected) > 0""", "hits5", "judge")


def scores(source: str, keys: str = "query_id") -> str:
    return f"""select {keys}, category, cast(count(rank) as integer) as num_results,
 coalesce(count(*) filter (hit and rank <= 5) / nullif(count(*) filter (rank <= 5), 0), 0) as precision,
 coalesce(count(*) filter (hit and rank <= 5) / len(any_value(expected)), 0) as recall, coalesce(1.0 / min(rank) filter (hit), 0) as mrr
 from {source} group by {keys}, category"""


part("score_rows", scores("(select j.query_id, j.category, j.expected, h.rank, coalesce(list_contains(j.expected, h.page), false) as hit from judge j "
                          "left join hits5 h using (query_id) where len(j.expected) > 0)"), "judge", "hits5")
MEANS = "round(avg(precision), 6) as precision, round(avg(recall), 6) as recall, round(avg(mrr), 6) as mrr, round(avg(num_results), 6) as avg_results"

# ---------------------------------------------------------------- sources

twin("page_source", """select cast(doc_id as varchar) as document_id, cast(generate_subscripts(string_split(text, chr(10)), 1) as integer) as page,
 unnest(string_split(text, chr(10))) as text from documents""")
INTAKE = f"""select id, filename, case when coalesce(company, '') <> '' then {strip('company')} end as company, nullif(year, 0) as year,
 case when {strip("coalesce(company, '')")} <> '' and coalesce(year, 0) <> 0 then 'api_provided' else 'filename_parsed' end as metadata_source
 from up where lower(filename) like '%.pdf'"""
part("intake", INTAKE, "up")
twin("upload_intake", "select * from intake", "intake")
twin("source_route", "select page_id, url, case when ends_with(lower(url), '#top') then 'direct' else 'page' end as route from pages")
twin("link_extract", r"""select page_id, href, regexp_extract(url, '^(https?://[^/]+)', 1) || href as link from (
 select page_id, url, list_filter(list_transform(regexp_extract_all(regexp_replace(regexp_replace(html, '(?is)<!--.*?-->', '', 'g'), '(?is)<script.*?</script>', '', 'g'),
  '(?i)<a\s[^>]*href="([^"]*)"', 1), lambda h: replace(h, '&amp;', '&')), lambda h: contains(lower(h), '/th'))[1] as href from pages)
 where href is not null""")
twin("extract_json_sink", """select document_id, translate(company, ' /', '__') as company_key, year,
 concat(translate(company, ' /', '__'), '_', year, '.json') as file_name, scope1_total from totals""", "totals")
twin("extract_json_scan", "select document_id, company, year, scope2_total, scope2_count from totals", "totals")
twin("reports_upsert", """select company, year, document_id, scope1_total from (
 select cast(o_custkey as varchar) as company, cast(year(o_orderdate) as integer) as year, cast(o_orderkey as varchar) as document_id,
  o_totalprice as scope1_total, row_number() over (partition by o_custkey, year(o_orderdate) order by o_orderdate desc, cast(o_orderkey as varchar)) as rn
 from orders) where rn = 1""")
part("lines_", """select doc_id, source as document_id, cast(generate_subscripts(string_split(text, chr(10)), 1) as integer) as page,
 unnest(string_split(text, chr(10))) as content from documents""")
twin("chunks_upsert", """select document_id, page, content from lines_
 except select document_id, page, content from lines_ where doc_id in (select doc_id from labels)""", "lines_")
twin("error_sink", "select document_id, 'audit_error' as error_type, error as message, 'auditor' as worker from resp where error is not null", "resp")
twin("reports_table", TWINS["reports_upsert"])
twin("stream_errors", """select document_id, 'audit' as error_type, case status when 'error' then 'the model service failed' when 'missing' then 'no answer'
 when 'unparsed' then 'the answer is no JSON' else 'the answer fails validation' end as message, 'audit' as worker
 from reports where status in ('error', 'missing', 'unparsed', 'invalid')""", "reports")
twin("distinct_sketches", """select cast(year(o_orderdate) as integer) as year, count(distinct o_custkey) as companies, true as agrees from orders group by 1
 union all select null, count(distinct o_custkey), true from orders""")
twin("report_backfill", """select r.company, r.year, r.source, r.leaf_rating as truth_score, s.scope1_total, s.scope2_total from reports r join (
 select document_id, sum(scope1_sum) as scope1_total, sum(scope2_sum) as scope2_total from sums group by all) s using (document_id)""", "reports", "sums")

# ---------------------------------------------------------------- filters

LISTED = "company, year, leaf_rating, scope1_total, scope2_total"
twin("list_reports", f"select {LISTED} from reports", "reports")
twin("company_filter", f"select {LISTED} from reports where contains(lower(company), lower('IER#00000001'))", "reports")
twin("year_filter", f"select {LISTED} from reports where year = 1997", "reports")
twin("similarity_threshold", """select query_id, count(*) filter (similarity > 0.1) as over, count(*) filter (similarity >= 0.1) as from_,
 count(*) as positive from pairs where similarity > 0 group by query_id""", "pairs")
twin("claim_unit_filter", "select document_id, page, claim, n_kept, round(sum_kept, 6) as sum_kept from kept", "kept")


def packed(text: str) -> str:
    """Sentence packing as a fold over the sentence list: state is closed chunks, open sentences, their length."""
    return f"""select doc_id, {sentences(text)} as s from documents"""


def pack_parts(name: str, text: str) -> None:
    part(f"{name}_s", packed(text))
    suffix = ("list_filter(open, lambda x, i: list_sum(list_transform(open[i:], lambda y: length(y))) <= 100)")
    part(f"{name}_fold", f"""select doc_id, s, 0 as i, cast([] as varchar[]) as done, cast([] as varchar[]) as open, cast(0 as bigint) as len_ from {name}_s
 union all
 select doc_id, s, i + 1,
  case when len_ + length(s[i + 1]) > 500 and len(open) > 0 then list_append(done, array_to_string(open, ' ')) else done end,
  case when len_ + length(s[i + 1]) > 500 and len(open) > 0 then list_append({suffix}, s[i + 1]) else list_append(open, s[i + 1]) end,
  case when len_ + length(s[i + 1]) > 500 and len(open) > 0
   then coalesce(list_sum(list_transform({suffix}, lambda y: length(y))), 0) + length(s[i + 1]) else len_ + length(s[i + 1]) end
 from {name}_fold where i < len(s)""", f"{name}_s")
    part(name, f"""select doc_id, cast(generate_subscripts(c, 1) - 1 as integer) as chunk_index, unnest(c) as content from (
 select doc_id, case when len(open) > 0 then list_append(done, array_to_string(open, ' ')) else done end as c from {name}_fold where i = len(s))""", f"{name}_fold")


pack_parts("packed_raw", "text")
pack_parts("packed_clean", clean("text"))
twin("min_chunk_filter", "select doc_id, chunk_index, cast(length(content) as integer) as chunk_size from packed_raw where length(content) >= 100", "packed_raw")
twin("valid_audit_filter", "select document_id, overall_score from valid", "valid")

# ---------------------------------------------------------------- joins

twin("claim_page_metrics", """select h.document_id, h.page, h.claim, coalesce(s.scope1, 0) as n_scope1, coalesce(s.scope2, 0) as n_scope2,
 coalesce(s.generic, 0) as n_generic from hits_ h left join figsum s using (document_id, page)""", "hits_", "figsum")
twin("claim_metrics_choice", "select * from choice", "choice")
twin("claim_review_join", "select document_id, page, claim, r_score as score, r_reason as reason from reviewed", "reviewed")
twin("status_lookup", """select id as document_id, case when r.document_id is not null then 'completed' else 'processing' end as status
 from up left join (select document_id from reports where status = 'valid') r on r.document_id = up.id""", "up", "reports")
twin("query_chunk_similarity", "select query_id, chunk_id, round(similarity, 6) as similarity from pairs where similarity > 0.05", "pairs")
twin("pages_hit", "select query_id, rank, page, hit from judged", "judged")
twin("threshold_grid", """select query_id, cast(t as double) as threshold, rank, chunk_id from hits5, (select unnest([0.3, 0.4, 0.5, 0.6]) as t)
 where similarity > t""", "hits5")
twin("stage_backlog", """select
 (select count(*) from up where id not in (select document_id from figs where kind = 'scope3')) as pdf_queue,
 (select count(distinct document_id) from figs where kind = 'scope3' and document_id not in (select document_id from reports where status <> 'missing')) as audit_queue,
 (select count(*) from reports where status <> 'missing' and status <> 'valid') as embeddings_queue""", "up", "figs", "reports")
part("requests", """select s_suppkey as request_id, cast(generate_subscripts(l, 1) - 1 as integer) as pos, trim(unnest(l)) as company from (
 select s_suppkey, string_split(concat(s_name, ', Supplier#', lpad(cast(s_suppkey + 1 as varchar), 9, '0'), ',No Such Company ,', s_name), ',') as l from supplier)""")
part("latest", "select * from (select *, row_number() over (partition by company order by year desc) as rn from reports) where rn = 1", "reports")
twin("company_in_list", "select request_id, pos, company, year from requests join latest using (company)", "requests", "latest")

# ---------------------------------------------------------------- aggregates

twin("page_metric_dedup", "select document_id, page, kind, cast(ord as integer) as ord, value, unit, source from figs", "figs")
twin("report_metric_dedup", "select document_id, page, kind, cast(ord as integer) as ord, value, unit from rfigs", "rfigs")
twin("scope_totals", "select * from totals", "totals")
STATS = """sum(pages) as total_pages, sum(fails) as text_extraction_failures, sum(claims) as claims_found, sum(ctx) as claims_with_context,
 sum(evd) as claims_with_evidence, sum(good) as claims_with_good_context, sum(s1) as scope1_found, sum(s2) as scope2_found, sum(s3) as scope3_found"""
part("stat_docs", """select d.document_id, d.company, d.year, d.pages, coalesce(fails, 0) as fails, coalesce(claims, 0) as claims, coalesce(ctx, 0) as ctx,
  coalesce(evd, 0) as evd, coalesce(good, 0) as good, coalesce(s1, 0) as s1, coalesce(s2, 0) as s2, coalesce(s3, 0) as s3
 from docs_ d left join (select document_id, count(*) filter (no_text) as fails from rp group by all) using (document_id)
 left join (select document_id, count(*) as claims, count(*) filter (length(context) > 50) as ctx,
   count(*) filter (has_numeric_data or has_target_year) as evd, count(*) filter (length(context) > 100) as good from ev group by all) using (document_id)
 left join (select document_id, count(*) filter (kind = 'scope1') as s1, count(*) filter (kind = 'scope2') as s2, count(*) filter (kind = 'scope3') as s3 from figs group by all) using (document_id)""",
     "docs_", "rp", "ev", "figs")
_cast_stats = ", ".join(f"cast({c} as bigint) as {c}" for c in (
    "total_pages", "text_extraction_failures", "claims_found", "claims_with_context", "claims_with_evidence",
    "claims_with_good_context", "scope1_found", "scope2_found", "scope3_found"))
twin("extraction_stats", f"select document_id, {_cast_stats} from (select document_id, {STATS} from stat_docs group by document_id)", "stat_docs")
twin("corpus_stats", f"select company, year, documents, {_cast_stats} from (select company, year, count(*) as documents, {STATS} from stat_docs group by rollup (company, year))", "stat_docs")
part("all_chunks", """select document_id, page, chunk_index, content, 'summary' as type from summary_chunks
 union all select document_id, page, chunk_index, content, 'claim' from claim_chunks
 union all select document_id, page, chunk_index, content, 'emissions_data' from em_chunks
  where document_id not in (select document_id from summary_chunks) and document_id not in (select document_id from claim_chunks)""",
     "summary_chunks", "claim_chunks", "em_chunks")
twin("system_stats", """select total_reports, total_chunks, unique_companies, total_chunks / total_reports as avg_chunks_per_report from (
 select (select count(*) from reports) as total_reports, (select count(*) from all_chunks where type <> 'emissions_data') as total_chunks,
 (select count(distinct company) from reports) as unique_companies)""", "reports", "all_chunks")
twin("priority_mix", f"""select document_id, count(*) filter (tier = 'high') as high, count(*) filter (tier = 'medium') as medium,
 count(*) filter (tier not in ('high', 'medium')) as other from (select document_id, {TIER} as tier from picked) group by all""", "picked")
twin("metric_counts_by_kind", """select document_id, kind, count(*) over (partition by document_id, kind) as entries,
 cast(row_number() over (partition by document_id, kind order by page, ord) as integer) as example, page, value from rfigs
 qualify example <= 5""", "rfigs")
twin("throughput_stats", """select round(avg(total_time), 6) as mean_time, round(min(total_time), 6) as min_time, round(max(total_time), 6) as max_time,
 round(list_sort(list(total_time))[count(*) // 2 + 1], 6) as median_time,
 round(avg(total_time / pages) filter (pages > 0), 6) as mean_time_per_page from timing""", "timing")
twin("eval_overall", f"select {MEANS} from score_rows", "score_rows")
twin("eval_by_category", f"select category, count(*) as queries, {MEANS} from score_rows group by category", "score_rows")
twin("eval_threshold_sweep", f"""select threshold, {MEANS} from ({scores('''(select t as threshold, j.query_id, j.category, j.expected, h.rank,
  coalesce(list_contains(j.expected, h.page), false) as hit from judge j cross join (select unnest([0.3, 0.4, 0.5, 0.6]::double[]) as t)
  left join hits5 h on h.query_id = j.query_id and h.similarity > t where len(j.expected) > 0)''', 'threshold, query_id')}) group by threshold""", "judge", "hits5")
twin("eval_diversity", """select j.query_id, j.category, cast(count(h.rank) as integer) as num_results, count(distinct h.company) as companies_found
 from judge j left join hits5 h using (query_id) where j.expected is null group by all""", "judge", "hits5")
twin("page_emission_sums", "select document_id, page, scope1_sum, scope2_sum from sums", "sums")
twin("stage_outcomes", """select stage, document_id, cast(sum(ok) as bigint) as successful, cast(sum(bad) as bigint) as failed from (
 select 'audit' as stage, document_id, case when status = 'valid' then 1 else 0 end as ok, case when status = 'valid' then 0 else 1 end as bad from reports
 union all select 'extract', document_id, case when no_text then 0 else 1 end, case when no_text then 1 else 0 end from rp)
 group by grouping sets ((stage, document_id), (stage))""", "reports", "rp")

# ---------------------------------------------------------------- windows and top-k

twin("similar_claim_dedup", """select document_id, page, claim from (select *, row_number() over (partition by document_id, page, base order by keyword_ord) as rn from hits_)
 where rn = 1""", "hits_")
twin("top_claims", "select document_id, page, claim, claim_rank, score from picked", "picked")
twin("simple_top_claims", """select document_id, page, claim from (select *, count(*) over (partition by document_id) as n,
 row_number() over (partition by document_id order by case claim when 'net zero' then 1 when 'carbon neutral' then 2 when 'zero emissions' then 3
  when 'renewable energy' then 4 else 99 end, page, keyword_ord) as rn from hits_) where n <= 20 or rn <= 15""", "hits_")
part("samples", """select * from (select *, cast(row_number() over (partition by document_id order by page, ord) as integer) as sample_rank from (
  select g.*, row_number() over (partition by document_id, page order by ord) as pn, c.n, c.p from rfigs g
  join (select document_id, count(*) as n, count(distinct page) as p from rfigs where kind = 'generic' group by all) c using (document_id)
  where g.kind = 'generic') where n <= 50 or pn <= greatest(1, 50 // p)) where sample_rank <= 50""", "rfigs")
twin("metric_sample", "select document_id, sample_rank, page, value, unit from samples", "samples")
twin("latest_report", f"select {LISTED} from latest", "latest")
twin("company_history", f"select {LISTED}, ai_summary, cast(count(*) over (partition by company) as integer) as years_covered from reports", "reports")
twin("compare_companies", """select request_id, cast(row_number() over (partition by request_id order by coalesce(scope1_total, 0) desc, pos) as integer) as place,
 company, year, scope1_total from requests join latest using (company)""", "requests", "latest")
HIT = "query_id, rank, chunk_id, company, year, page, round(similarity, 6) as similarity"
twin("vector_topk", f"select {HIT} from hits5", "hits5")
twin("query_chunk_similarity_pruned", "select query_id, chunk_id, round(similarity, 6) as similarity from pairs where similarity > 0.35", "pairs")
# The cap counts chunks without a vector too.
part("capped", f"""select * from (select *, row_number() over (partition by query_id order by chunk_id) as cn from ({PAIRS})) where cn <= 100 and similarity is not null""", "vec", "ask")
twin("vector_topk_capped", f"select {HIT} from ({topk(0.05, source='capped', op='>=')})", "capped")

# ---------------------------------------------------------------- set operations

twin("text_table_union", "select document_id, page, kind, cast(ord as integer) as ord, value, 'tCO2e' as unit from both_figs", "both_figs")
twin("combine_page_metrics", "select document_id, page, kind, cast(ord as integer) as ord, value, unit from figs where kind <> 'total'", "figs")
twin("taxonomy_build", """select keyword, category, kw.keyword_ord as keyword_ord, count(h.claim) as pages from cat join kw on kw.claim = cat.keyword
 left join hits_ h on h.claim = cat.keyword group by keyword, category, kw.keyword_ord""", "cat", "kw", "hits_")

# ---------------------------------------------------------------- scalars

twin("parse_number", f"""select l_orderkey, l_linenumber, raw, {number('raw')} as number from (select l_orderkey, l_linenumber, case l_linenumber
 when 1 then concat(l_orderkey, ',000.50') when 2 then concat(' ', l_orderkey, ' 12.') when 3 then concat(l_orderkey, 'd')
 when 4 then concat('-', l_orderkey, '.25e1') when 5 then concat(l_orderkey, chr(10), '200') when 6 then concat('.', l_orderkey)
 else concat(l_orderkey, '_0') end as raw from lineitem)""")
twin("normalize_unit", f"""select raw, {unit('raw')} as unit, count(*) as n from (select coalesce(unnest(regexp_extract_all(text, {NUM}, 2)), '') as raw from (
 select text from rp union all select text from documents)) group by all""", "rp")
part("texts", """select cast(doc_id as varchar) as id, text from documents union all
 select concat(document_id, '-', page) as id, text from rp""", "rp")
twin("target_year", f"select id, {year_of('text')} as target_year from texts", "texts")
part("doc_hits", "select doc_id, text, claim, strpos(lower(text), claim) - 1 as pos_ from documents join (select unnest(['the', 'aim', 'oil', 'des', 'sch', 'que']) as claim) on contains(lower(text), claim)")
twin("sentence_context", f"select doc_id, claim, sent as context from ({context_steps('doc_hits', 'doc_id, claim')})", "doc_hits")
twin("char_context", f"select doc_id, claim, {char_context()} as context from doc_hits", "doc_hits")
twin("evidence", f"select id, {evidence_columns('text')} from texts", "texts")
twin("key_phrases", f"""select doc_id, cast(generate_subscripts(p, 1) - 1 as integer) as ord, unnest(p) as phrase from (
 select doc_id, {key_phrases('text')} as p from documents)""")
twin("clean_text", f"""select doc_id, {clean("concat('Page 3 of 12', chr(10), text, chr(9), ' PAGE ', doc_id, ' OF 9')")} as clean,
 {clean("concat(doc_id, ' ', chr(10))")} as digits from documents""")
twin("split_sentences", f"""select doc_id, cast(generate_subscripts(s, 1) - 1 as integer) as ord, unnest(s) as sentence from (
 select doc_id, {sentences('text')} as s from documents)""")


def company_name(x: str) -> str:
    kept = squeeze(f"regexp_replace(lower(coalesce({x}, '')), '[^a-z0-9{SPACE}]', ' ', 'g')")
    title = (f"array_to_string(list_transform(regexp_extract_all({kept}, '[a-z]+|[^a-z]+'), "
             f"lambda r: upper(substr(r, 1, 1)) || substr(r, 2)), '')")
    return f"coalesce(nullif({title}, ''), 'Unknown')"


twin("normalize_company", f"""select raw, {company_name('raw')} as company, count(*) as n from (select s_name as raw from supplier
 union all select concat('3m & ', p_name, '  (Pte.) ', p_brand) from part) group by all""")
YEAR = "(19[0-9]{2}|20[0-9]{2})"
NOISE = "|".join(tx.FILENAME_NOISE)


def filename_parts(source: str, keys: str) -> str:
    tidy = squeeze(f"regexp_replace(regexp_replace(regexp_replace(filename, '(?i)\\.pdf$', ''), '[^a-zA-Z0-9{SPACE}_-]', ' ', 'g'), '[_-]+', ' ', 'g')")
    return f"""select {keys}, {company_name(f"regexp_replace(rest, '(?i)\\b({NOISE})\\b', '', 'g')")} as f_company, coalesce(try_cast(y as integer), 2024) as f_year from (
 select *, case when regexp_matches(n, '^{YEAR} +.+$') then regexp_extract(n, '^{YEAR}', 1) when regexp_matches(n, '^.+? +{YEAR}$') then regexp_extract(n, '{YEAR}$', 1)
   else regexp_extract(n, '\\b{YEAR}\\b', 1) end as y,
  case when regexp_matches(n, '^{YEAR} +.+$') then regexp_extract(n, '^{YEAR} +(.+)$', 2) when regexp_matches(n, '^.+? +{YEAR}$') then regexp_extract(n, '^(.+?) +{YEAR}$', 1)
   when regexp_extract(n, '\\b{YEAR}\\b', 1) <> '' then replace(concat(' ', n, ' '), concat(' ', regexp_extract(n, '\\b{YEAR}\\b', 1), ' '), '  ') else n end as rest
 from (select *, {tidy} as n from {source}))"""


part("named", filename_parts("up", "id, filename"), "up")
twin("company_year_from_filename", "select filename, f_company as company, f_year as year from named", "named")
twin("company_year_rsplit", r"""select filename, case when ok then replace(regexp_extract(n, '^(.*)_[^_]*$', 1), '_', ' ') else filename end as company,
 case when ok then cast(regexp_extract(n, '_([^_]*)$', 1) as integer) else 0 end as year from (
 select filename, n, regexp_matches(n, '_[+-]?[0-9]+$') as ok from (select filename, replace(filename, '.pdf', '') as n from (
  select filename from up union all select document_id || '.pdf' from docs_)))""", "up", "docs_")
twin("metadata_resolve", f"""select id, coalesce(nullif({squeeze("regexp_replace(c, concat('\\b', y, '\\b'), '', 'g')")}, ''), c) as company, y as year, metadata_source from (
 select i.id, i.metadata_source, {company_name("coalesce(nullif(i.company, ''), n.f_company)")} as c, coalesce(i.year, n.f_year) as y
 from intake i join named n using (id))""", "intake", "named")
twin("claim_score", "select document_id, page, claim, target_year, score from scored", "scored")
twin("parse_audit_json", """select document_id, j is not null as parsed, overall_score, overall_summary, cast(reviews as integer) as reviews from parsed""", "parsed")
part("answers", f"""select conv_id, turn, case when ok then json_extract_string(t, '$.answer') else {lit(A.ANSWER_ERROR)} end as answer,
 case when ok then json_extract_string(t, '$.confidence') else 'low' end as confidence,
 cast(case when ok then json_array_length(t, '$.citations') else 0 end as integer) as citations from (
 select *, coalesce(json_valid(t) and json_type(try_cast(t as json)) = 'OBJECT', false) as ok from (
 select conv_id, turn, {strip(f"regexp_replace({strip('raw')}, {lit(A.FENCES)}, '', 'g')")} as t from (
  select conv_id, turn, case length(text) % 3 when 0 then concat('```json', chr(10), b, chr(10), '```') when 1 then b else text end as raw from (
   select *, concat('{{"answer": "turn ', turn, '", "citations": [{{"company": "A", "year": 2024, "page": ', turn, ', "quote": "q"}}], "confidence": "High"}}') as b from conversations))))""")
twin("parse_answer_json", "select * from answers", "answers")
twin("claim_chunk_text", "select document_id, page, chunk_index, content from claim_chunks", "claim_chunks")
twin("summary_chunk_text", f"select document_id, concat({HEAD}, '. Overall Assessment: ', ai_summary) as content from reports", "reports")
twin("emissions_chunk_text", "select document_id, page, chunk_index, content from em_chunks", "em_chunks")
twin("cosine_similarity", "select vec_id, round(list_cosine_similarity(cast(embedding as double[]), list_reverse(cast(embedding as double[]))), 6) as similarity from embeddings")
twin("rating_band", """select document_id, case when coalesce(leaf_rating, 0) = 0 then 'N/A' when leaf_rating >= 4 then 'green' when leaf_rating >= 3 then 'yellow'
 else 'red' end as band from reports""", "reports")
twin("claim_preview", "select document_id, claim_rank, case when context <> '' then substr(context, 1, 150) || '...' end as preview from picked", "picked")
twin("confidence_band", "select conv_id, turn, case when lower(confidence) in ('high', 'medium', 'low') then lower(confidence) else 'other' end as band from answers", "answers")

# ---------------------------------------------------------------- generators

twin("scope_metrics_from_text", "select document_id, page, kind, cast(ord as integer) as ord, value, 'tCO2e' as unit from text_figs", "text_figs")
twin("scope_metrics_from_tables", "select document_id, page, kind, cast(ord as integer) as ord, value, source from table_figs", "table_figs")
part("any_text", """select cast(doc_id as varchar) as document_id, 1 as page, text from documents union all select document_id, page, text from rp""", "rp")
twin("generic_metrics", f"""select document_id, page, 'generic' as kind, cast(ord as integer) as ord, value, unit from ({generic_rows('any_text', 'text', 'document_id, page')})""", "any_text")
twin("detect_claims", "select document_id, page, keyword_ord, claim, target_year, context from ev", "ev")
twin("semantic_chunks", "select doc_id, chunk_index, content from packed_clean", "packed_clean")
twin("page_chunks", "select doc_id, chunk_index, content, length(content) as chunk_size from packed_clean where length(content) >= 100", "packed_clean")
twin("report_chunks", "select * from all_chunks", "all_chunks")
twin("flatten_claims", "select company, year, claim, page, score from picked", "picked")
twin("audit_fallback", """select document_id, status as audit_status, ai_summary, leaf_rating,
 cast(case when status in ('error', 'missing', 'invalid') then n_claims else 0 end as integer) as reviews from reports where status <> 'valid'""", "reports")

# ---------------------------------------------------------------- vectors and prompts


def hashed(source: str, text: str, keys: str) -> str:
    return f"""select {keys}, slot, round(cast(cast(w / sqrt(sum(w * w) over (partition by {keys})) as float) as double), 5) as weight from (
 select {keys}, slot, sum(sign_) as w from (
  select {keys}, cast(cast('0x' || substr(h, 1, 8) as bigint) % 64 as integer) as slot, case when substr(h, 9, 1) < '8' then 1.0 else -1.0 end::double as sign_ from (
   select {keys}, md5(unnest(regexp_extract_all(lower({text}), '[a-z0-9]+'))) as h from {source})) group by all) where w <> 0"""


twin("embed_chunks", hashed("documents", "text", "doc_id"))
twin("embed_queries", hashed("(select conv_id, turn, text from conversations where role = 'user')", "text", "conv_id, turn"))
part("entries", "select document_id, " + ", ".join(f"cast(count(*) filter (kind = '{k}') as integer) as {k}_entries" for k in ("scope1", "scope2", "scope3", "generic"))
     + " from rfigs group by all", "rfigs")
twin("audit_requests", """select d.document_id, d.company, d.year, e.* exclude (document_id), cast(s.sampled as integer) as sampled, c.n_claims, c.claims_text from docs_ d
 join entries e using (document_id) left join (select document_id, count(*) as sampled from samples group by all) s using (document_id)
 join (select document_id, cast(count(*) as integer) as n_claims, string_agg(concat('Claim ', claim_rank, ': ''', claim, ''' (Page ', page, ')',
  case when target_year is null then '' else concat(chr(10), '  Target Year: ', target_year) end), chr(10) order by claim_rank) as claims_text from picked group by all) c using (document_id)""",
     "docs_", "entries", "samples", "picked")
twin("json_escape_text", """select document_id, cast(coalesce(s.n, 0) as integer) as figures, c.n as claims, c.named, coalesce(s.total, 0.0) as total
 from (select document_id, cast(count(*) as integer) as n, string_agg(claim, '; ' order by claim_rank) as named from picked group by all) c
 left join (select document_id, count(*) as n, round(sum(value), 4) as total from samples group by all) s using (document_id)""", "samples", "picked")
twin("rag_context", """select query_id, string_agg(concat('[Source: ', company, ' ', year, ' Report, Page ', page, ']', chr(10), content), chr(10) || chr(10) order by rank) as context
 from hits5 group by query_id""", "hits5")
part("hits50", topk(0.5), "pairs")
twin("search_response", f"""select a.query_id, a.question, case when h.n is null then {lit(A.NOTHING_FOUND)} else '' end as answer,
 case when h.n is null then 'none' else 'unknown' end as confidence, coalesce(h.n, 0) as num_sources, coalesce(h.c, '') as citations
 from ask a left join (select query_id, cast(count(*) as integer) as n, string_agg(concat(company, '/', year, '/', page), ' | ' order by rank) as c
  from hits50 group by all) h using (query_id)""", "ask", "hits50")
twin("pr_at_k_mrr", """select query_id, category, num_results, round(precision, 6) as precision, round(recall, 6) as recall, round(mrr, 6) as mrr from score_rows""", "score_rows")

# ---------------------------------------------------------------- streams: the same tables as in batch

twin("stream_extract", "select s.document_id, s.page, " + ", ".join(f"s.{k} as n_{k}" for k in tx.METRIC_KINDS)
     + ", count(*) as claims from hits_ h join figsum s using (document_id, page) group by all", "hits_", "figsum")
twin("stream_audit", f"select {LISTED} from reports", "reports")
twin("stream_chunks", "select document_id, page, chunk_index, content, 64 as dim from all_chunks", "all_chunks")
twin("stream_dedup_uploads", "select id, filename, company, year, metadata_source from intake", "intake")
