"""DuckDB SQL of the queries that SQL can express."""

from __future__ import annotations

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORD = r"[^\x20\x09-\x0D]+"


def words(text: str, fold: bool = True) -> str:
    text = f"coalesce({text}, '')"
    return f"regexp_extract_all({f'''translate({text}, '{UPPER}', '{LOWER}')''' if fold else text}, '{WORD}')"


def near_duplicates(documents: str, n: int, num: int, den: int) -> str:
    """CTEs up to `classes` (doc_id, n_shingles, component_id), without WITH RECURSIVE."""
    return f"""
nd_words as (select doc_id, {words('text')} as ws from {documents}),
nd_places as (select doc_id, ws, unnest(range(1, greatest(len(ws) - {n - 1}, 1) + 1)) as i from nd_words where len(ws) > 0),
nd_grams as (select distinct doc_id, array_to_string(ws[i:i + {n - 1}], ' ') as g from nd_places),
nd_sizes as (select doc_id, count(*) as n from nd_grams group by doc_id),
nd_common as (
  select x.doc_id as a, y.doc_id as b, count(*) as c from nd_grams x join nd_grams y on x.g = y.g and x.doc_id < y.doc_id group by all),
nd_pairs as (
  select a, b from nd_common join nd_sizes s on s.doc_id = a join nd_sizes t on t.doc_id = b
  where {den} * c >= {num} * (s.n + t.n - c)),
nd_links as (select a, b from nd_pairs union all select b, a from nd_pairs),
nd_reach as (select a, b from nd_links union select r.a, l.b from nd_reach r join nd_links l on r.b = l.a),
nd_roots as (select a, min(b) as root from nd_reach group by a),
classes as (
  select d.doc_id, coalesce(s.n, 0) as n_shingles, least(d.doc_id, coalesce(r.root, d.doc_id)) as component_id
  from {documents} d left join nd_sizes s on s.doc_id = d.doc_id left join nd_roots r on r.a = d.doc_id)"""


OP1 = f"""
with recursive {near_duplicates('documents', 3, 85, 100)}
select doc_id, cast(n_shingles as bigint) as n_shingles, component_id, doc_id = component_id as kept from classes"""



def leaks(documents: str, benchmark: str) -> str:
    """CTEs up to `leaks` (doc_id, item_id, start, similarity): all windows of items that share a shingle, compared in full."""
    return f"""
lk_words as (select doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\\p{{L}}\\p{{N}}]+') as ws from {documents}),
lk_grams as (
  select doc_id, p, array_to_string(ws[p:p + 4], ' ') as g
  from (select doc_id, ws, unnest(range(1, len(ws) - 3)) as p from lk_words where len(ws) >= 5)),
lk_items as (
  select item_id, len(ws) - 4 as n, ws, unnest(range(1, len(ws) - 3)) as p
  from (select item_id, regexp_extract_all(lower(coalesce(text, '')), '[\\p{{L}}\\p{{N}}]+') as ws from {benchmark}) where len(ws) >= 5),
lk_own as (select item_id, n, array_to_string(ws[p:p + 4], ' ') as g, count(*) as c from lk_items group by all),
lk_pairs as (select distinct d.doc_id, i.item_id, i.n from lk_grams d join lk_own i on i.g = d.g),
lk_last as (select doc_id, len(ws) - 4 as m from lk_words),
lk_windows as (
  select doc_id, item_id, n, m, unnest(range(1, greatest(m - n, 0) + 2)) as start from lk_pairs join lk_last using (doc_id)),
lk_counts as (
  select w.doc_id, w.item_id, w.start, w.n, w.m, d.g, count(*) as c
  from lk_windows w join lk_grams d on d.doc_id = w.doc_id and d.p >= w.start and d.p < w.start + w.n
  where exists (select 1 from lk_own o where o.item_id = w.item_id and o.g = d.g) group by all),
lk_sums as (
  select doc_id, item_id, start, n, m, sum(least(k.c, o.c)) as c from lk_counts k join lk_own o using (item_id, n, g) group by all),
lk_hits as (
  select doc_id, item_id, start - 1 as start, c / (n + least(n, m) - c) as similarity from lk_sums where 100 * c >= 80 * (n + least(n, m) - c)),
lk_short as (
  select item_id, ws from (select item_id, regexp_extract_all(lower(coalesce(text, '')), '[\\p{{L}}\\p{{N}}]+') as ws from {benchmark}) where len(ws) between 1 and 4),
lk_all as (
  select doc_id, item_id, start, similarity from lk_hits
  union all select doc_id, item_id, p - 1, 1.0 from (select doc_id, ws, unnest(range(1, len(ws) + 1)) as p from lk_words) d join lk_short s on d.ws[p:p + len(s.ws) - 1] = s.ws),
leaks as (
  select doc_id, item_id, start, similarity from (
    select *, row_number() over (partition by doc_id, item_id order by similarity desc, start) as k from lk_all) where k = 1)"""


OP4 = f"""
with {leaks('documents', 'benchmark')}
select doc_id, item_id, cast(start as int) as start, similarity from leaks"""

OP3 = """
with c_turns as (
  select conv_id, row_number() over (partition by conv_id order by turn nulls first, coalesce(role, ''), coalesce(text, '')) as place,
    coalesce(role, '') as role, coalesce(text, '') as text from conversations),
c_whole as (
  select conv_id, count(*) as n, list(concat(length(role), ':', role, length(text), ':', text) order by place) as turns,
    string_agg('<|im_start|>' || replace(role, '<|', '< |') || chr(10) || replace(text, '<|', '< |') || '<|im_end|>' || chr(10), '' order by place) as text
  from c_turns group by conv_id),
c_first as (select turns, min(conv_id) as conv_id from c_whole group by turns),
c_prefixes as (select distinct array_to_string(w.turns[1:k], chr(1)) as p, k from (select turns, n, unnest(range(1, n)) as k from c_whole) w)
select w.conv_id, w.n as n_turns, w.text from c_whole w join c_first f on f.conv_id = w.conv_id
where not exists (select 1 from c_prefixes p where p.k = w.n and p.p = array_to_string(w.turns, chr(1)))"""

def _sum_of_products(a: str, b: str) -> str:
    """Added up from the first entry on, in double precision."""
    return f"list_reduce(list_transform(range(1, len({a}) + 1), lambda k: {a}[k] * {b}[k]), lambda x, y: x + y)"


OP12 = f"""
with nv_rows as (
  select row_number() over () as r, vec_id, list_transform(embedding, lambda x: cast(x as double)) as e from embeddings
  where vec_id is not null and len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
    and len(list_filter(embedding, lambda x: x <> 0)) > 0),
nv_lengths as (select *, sqrt({_sum_of_products('e', 'e')}) as l from nv_rows),
nv_pairs as (
  select q.r, q.vec_id as query_id, c.vec_id, {_sum_of_products('q.e', 'c.e')} / (q.l * c.l) as score
  from nv_lengths q join nv_lengths c on q.r <> c.r and len(q.e) = len(c.e) where q.vec_id % 50 = 0)
select query_id, cast(rank as integer) as rank, vec_id, score
from (select *, row_number() over (partition by r order by score desc, vec_id) as rank from nv_pairs) where rank <= 5"""

#: Forms by leaving out each letter in turn: words that then agree differ by one replaced letter, a word that then is another has one more.
OP13 = f"""
with recursive sp_table as (
  select list_transform(range(256), lambda n: list_reduce(list_prepend(cast(n as bigint), range(8)), lambda c, k:
    case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end)) as t),
sp_runs as (
  select doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[A-Za-zÀ-ÿ]+')) as w from documents),
sp_bytes as (
  select w, hex(encode(concat(coalesce(cast(doc_id as varchar), ''), ':', w))) as x from sp_runs where length(w) >= 7),
sp_sums as (
  select w, xor(list_reduce(list_prepend(cast(4294967295 as bigint), list_transform(range(1, len(x), 2), lambda k: cast('0x' || x[k:k + 1] as bigint))),
    lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) as h from sp_bytes, sp_table),
sp_words as (
  select word, count(*) as n from (
    select case when h % 31 = 0 then concat(left(w, cast(h % length(w) as int)), substr(w, cast(h % length(w) as int) + 2)) else w end as word from sp_sums)
  where length(word) >= 7 group by word having count(*) >= 2),
sp_holes as (
  select word, k, concat(left(word, k - 1), substr(word, k + 1)) as rest
  from (select word, cast(unnest(range(1, length(word) + 1)) as int) as k from sp_words)),
sp_near as (
  select a.word, b.word as v from sp_holes a join sp_holes b on a.k = b.k and a.rest = b.rest and a.word <> b.word
  union select h.word, w.word from sp_holes h join sp_words w on w.word = h.rest
  union select w.word, h.word from sp_holes h join sp_words w on w.word = h.rest),
sp_best as (
  select s.word, count(*) as n_near, arg_min(s.v, (-w.n, s.v)) as v, max(w.n) as v_n from sp_near s join sp_words w on w.word = s.v group by s.word),
sp_forms as (
  select w.word, w.n, coalesce(b.n_near, 0) as n_near, case when b.v_n >= 10 * w.n then b.v end as form, case when b.v_n >= 10 * w.n then b.v_n end as form_n
  from sp_words w left join sp_best b on b.word = w.word),
sp_chain as (
  select word, word as root from sp_forms
  union all select c.word, f.form from sp_chain c join sp_forms f on f.word = c.root where f.form is not null)
select f.word, f.form, c.root, f.n, f.n_near, f.form_n from sp_forms f join sp_chain c on c.word = f.word
join sp_forms e on e.word = c.root where e.form is null"""

ORACLES = {"op1_minhash_dedup": OP1, "op3_chat_format": OP3, "op4_decontaminate": OP4, "op12_nearest": OP12, "op13_spelling": OP13}
