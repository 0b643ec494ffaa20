"""DuckDB SQL of those queries that SQL can express."""

from __future__ import annotations

OP8 = r"""
with recursive w as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as ws
  from documents),
s as (
  select distinct doc_id, unnest(case when len(ws) >= 5 then list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) when len(ws) > 0 then [array_to_string(ws, ' ')] else [] end) as g
  from w),
n as (select doc_id, count(*) as n from s group by doc_id),
sets as (select doc_id, md5(string_agg(g, '|' order by g)) as k from s group by doc_id),
node as (select k, min(doc_id) as d from sets group by k),
ns as materialized (select s.doc_id, s.g, n.n from s join node on s.doc_id = node.d join n on n.doc_id = s.doc_id),
pairs as (
  select a.doc_id as a, b.doc_id as b, count(*) as c, any_value(a.n) as na, any_value(b.n) as nb
  from ns a join ns b on a.g = b.g and a.doc_id <> b.doc_id group by a.doc_id, b.doc_id),
links as materialized (select a, b from pairs where 100 * c >= 80 * (na + nb - c)),
reach as (select d as x, d as y from node union select r.x, l.b from reach r join links l on l.a = r.y),
comp as (select x, min(y) as c from reach group by x)
select d.doc_id, coalesce(n.n, 0)::bigint as n_shingles, coalesce(comp.c, d.doc_id) as component_id
from documents d left join n using (doc_id) left join sets using (doc_id) left join node using (k) left join comp on comp.x = node.d
"""

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_PLAIN = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

# Items of at least five words; the tables' items all are.
OP2 = rf"""
with d as (select doc_id, regexp_extract_all({_LOWER}, '{_PLAIN}') as ws from documents),
i as (select item_id, regexp_extract_all({_LOWER}, '{_PLAIN}') as ws from benchmark),
di as (select distinct doc_id, unnest(list_transform(range(1, len(ws) - 3), lambda k: array_to_string(ws[k:k + 4], ' '))) as g from d),
it as (select distinct item_id, unnest(list_transform(range(1, len(ws) - 3), lambda k: array_to_string(ws[k:k + 4], ' '))) as g from i),
n as (select item_id, count(*) as n_item from it group by item_id)
select doc_id, item_id, count(*) as n_shared, any_value(n_item) as n_item, count(*)::double / any_value(n_item) as containment
from di join it using (g) join n using (item_id) group by doc_id, item_id having 100 * count(*) >= 80 * any_value(n_item)
"""

OP9 = r"""
with d as (
  select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) as size,
    ('0x' || substr(md5('mix-1|' || coalesce(doc_id::varchar, '')), 1, 12))::bigint as draw
  from documents),
q as (select *, length(size::varchar) * 10 + substr(size::varchar, 1, 1)::int as class from d),
r as (select *, draw % ceil(count(*) over (partition by source, class) / 100000)::bigint as slot from q),
s as (select source, sum(size)::hugeint as source_size from r group by source),
w as (select *, [5, 2, 1][(row_number() over (order by source nulls last) - 1) % 3 + 1]::hugeint as weight, 3 * source_size as cap from s),
o as (
  select *, sum(source_size) over () as total,
    coalesce(sum(cap) over (order by cap::double / weight, source nulls last rows between unbounded preceding and 1 preceding), 0) as before,
    sum(weight) over (order by cap::double / weight, source nulls last rows between current row and unbounded following) as rest
  from w),
c as (select *, (total - before) * weight > cap * rest as capped from o),
t as (
  select source, source_size, case when capped then cap::double else (weight * (total - coalesce(sum(case when capped then cap end) over (), 0)))::double
    / (sum(case when not capped then weight end) over ())::double end as target,
    (('0x' || substr(md5('mix-1#' || coalesce(source, chr(0))), 1, 4))::bigint::double + 0.5) / 65536.0::double as u
  from c),
k as (select *, row_number() over (partition by source order by class, slot, size, draw, doc_id) as place from r),
e as (
  select k.doc_id, k.size, t.source_size, t.target, t.u, place, case when t.source_size > 0 then t.target / t.source_size::double else 0 end as rate
  from k join t on k.source is not distinct from t.source)
select doc_id, size::bigint as size, source_size::bigint as source_size, target,
  (floor(u + rate * place) - floor(u + rate * (place - 1)))::bigint * size as taken
from e
"""

OP10 = r"""
with t as (select doc_id, regexp_extract_all(text, '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+[\x20\x09-\x0D]*') as ts, regexp_extract_all(text, '[^\x20\x09-\x0D]+') as ws from documents where text is not null),
d as (select *, list_transform(ws, lambda w: unicode(right(w, 1))::bigint) as cs, len(ws) as n from t where len(ws) >= 30),
l as (select doc_id, n, ws, cs, unnest(list_filter(range(n - 29), lambda i: i = 0 or regexp_matches(chr(cs[i]::int), '[.!?;:…。！？；：؟؛।]') or (cs[i] > 96 and cs[i] % 3 = 0))) as pos from d),
h as (select doc_id, pos, n, ws, cs[pos + 1] * 389 + cs[pos + 2] * 31 + cs[pos + 3] * 257 + cs[pos + 4] * 127 as h from l),
m as (select *, min(h) over (partition by doc_id order by pos rows between current row and 4 following) as least from h),
s as (
  select doc_id, pos, n, ws from (
    select *, max(least) over (partition by doc_id order by pos rows between 4 preceding and current row) as top,
      min(h) over (partition by doc_id order by pos rows between unbounded preceding and current row) as upto, row_number() over (partition by doc_id order by pos) as k
    from m) where top = h or (k < 5 and upto = h)
  union select doc_id, n - 30, n, ws from d),
x as (select doc_id, pos, ws, greatest(30, coalesce(lead(pos) over (partition by doc_id order by pos) - pos, 0)) as k from s),
z as (select doc_id, pos, k, row_number() over (partition by array_to_string(ws[pos + 1:pos + k], ' ') order by doc_id, pos) as nth from x),
g as (select distinct doc_id, unnest(range(pos, pos + k)) as pos from z where nth > 1),
u as (select doc_id, unnest(ts) as word, generate_subscripts(ts, 1) - 1 as pos from t),
k as (
  select u.doc_id, coalesce(string_agg(word, '' order by u.pos) filter (g.pos is null), '') as text, count(g.pos) as n_removed
  from u left join g on u.doc_id = g.doc_id and u.pos = g.pos group by u.doc_id having count(g.pos) > 0)
select o.doc_id, coalesce(k.text, o.text) as text, coalesce(k.n_removed, 0) as n_removed from documents o left join k on o.doc_id = k.doc_id
"""

OP4 = r"""
with a as (select page_id, case when strpos(url, '://') > 0 then substr(url, strpos(url, '://') + 3) else '' end as rest from pages),
b as (
  select page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path
  from (select page_id, coalesce(rest, '') as rest from a)),
r(h, p, v) as (values ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
f as (
  select b.page_id, b.host, b.path, r.h || r.p as rule, r.v, row_number() over (partition by b.page_id, b.host, b.path order by length(r.h) desc, length(r.p) desc) as k
  from b left join r on (b.host = r.h or ends_with(b.host, '.' || r.h)) and starts_with(b.path, r.p))
select page_id, host, path, rule, coalesce(v, case when host = '' then 'block' else 'allow' end) as verdict from f where k = 1
"""

OP7 = r"""
with recursive v as materialized (
  select vec_id, label, embedding::double[] as e from embeddings
  where label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0),
links as materialized (
  select a.vec_id as a, b.vec_id as b from v a join v b on a.label = b.label and a.vec_id <> b.vec_id and len(a.e) = len(b.e)
  where list_cosine_similarity(a.e, b.e) >= 0.93),
reach as (select vec_id as x, vec_id as y from embeddings union select r.x, l.b from reach r join links l on l.a = r.y),
comp as (select x, min(y) as c from reach group by x)
select m.vec_id, count(l.b) as n_links, any_value(comp.c) as component_id, any_value(comp.c) = m.vec_id as kept
from embeddings m join comp on comp.x = m.vec_id left join links l on l.a = m.vec_id group by m.vec_id
"""

BASE_LICENSES = rf"""
with d as (select doc_id, regexp_extract_all({_LOWER}, '{_PLAIN}') as ws from documents),
b as (select *, list_filter(range(1, len(ws) + 1), lambda i: ws[i] = 'cc' and ws[i + 1] = 'by') as cc, list_filter(range(1, len(ws) + 1), lambda i: ws[i] = 'general' and ws[i + 1] = 'public' and ws[i + 2] = 'license') as gpl,
  list_filter(range(1, len(ws) + 1), lambda i: ws[i] = 'all' and ws[i + 1] = 'rights' and ws[i + 2] = 'reserved') as reserved from d)
select doc_id, len(ws) as n_words, len(cc) + len(gpl) + len(reserved) as n_base, coalesce(list_min(list_concat(cc, gpl, reserved)) - 1, -1) as first_word, coalesce(list_max(list_concat(cc, gpl, reserved)) - 1, -1) as last_word,
  array_to_string(list_filter([case when len(cc) > 0 then 'cc-by' end, case when len(gpl) > 0 then 'gpl' end, case when len(reserved) > 0 then 'reserved' end], lambda x: x is not null), ',') as base_labels from b
"""

_SPANS = " union all ".join(
    f"select doc_id, '{kind}' as kind, {n} as ord, regexp_extract_all(coalesce(text, ''), '{rx}') as ms, string_split_regex(coalesce(text, ''), '{rx}') as ps from documents"
    for n, (kind, rx) in enumerate(
        (("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"))
    )
)
BASE_PERSONAL_DATA = rf"""
with m as ({_SPANS}),
e as (select doc_id, kind, ord, ms, ps, unnest(range(1, len(ms) + 1)) as i from m),
s as (
  select doc_id, kind, ord, ms[i] as found, regexp_replace(ms[i], '[^0-9]', '', 'g') as digits,
    (list_sum(list_transform(ps[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(ms[1:i - 1], lambda x: length(x))), 0))::bigint as start from e),
v as (
  select *, kind || ':' || start || ':' || (start + length(found)) as shown from s
  where kind = 'email' or (kind = 'ip' and len(list_filter(string_split(found, '.'), lambda x: length(ltrim(x, '0')) > 3 or coalesce(try_cast(right('000' || x, 3) as int), 0) > 255)) = 0)
    or (kind = 'card' and length(digits) between 14 and 19
      and list_sum(list_transform(range(length(digits)), lambda i: case when i % 2 = 0 then substr(reverse(digits), i + 1, 1)::int else 2 * substr(reverse(digits), i + 1, 1)::int - case when substr(reverse(digits), i + 1, 1)::int > 4 then 9 else 0 end end)) % 10 = 0)
    or (kind = 'phone' and length(digits) between 10 and 15))
select d.doc_id, count(*) filter (kind = 'email') as n_email, count(*) filter (kind = 'ip') as n_ip, count(*) filter (kind = 'card') as n_card, count(*) filter (kind = 'phone') as n_phone,
  sha256(coalesce(string_agg(shown, ',' order by start, ord), '')) as base_sha256 from documents d left join v using (doc_id) group by d.doc_id
"""

OP11 = rf"""
with w as (
  select lang, regexp_extract_all(piece, '[^ \t]+') as ws
  from (select coalesce(lang, 'und') as lang, unnest(string_split_regex({_LOWER}, '[.,;:!?\n\x0b\f\r]')) as piece from documents)),
n as (select lang, sum(len(ws))::bigint as n from w group by lang),
g as (select lang, m, unnest(list_transform(range(1, len(ws) - m + 2), lambda i: array_to_string(ws[i:i + m - 1], ' '))) as phrase from w, range(1, 6) as t(m)),
f as materialized (select lang, m, phrase, count(*) as a from g group by all having count(*) >= 100),
longer as (
  select lang, part, max(a) as most from (select lang, a, unnest([array_to_string(string_split(phrase, ' ')[1:m - 1], ' '), array_to_string(string_split(phrase, ' ')[2:m], ' ')]) as part from f where m > 2) group by all),
c as (
  select f.lang, f.phrase, f.a, n.n, k.k, l.a as l, r.a as r, (1000 * f.a::hugeint * n.n::hugeint) // (l.a::hugeint * r.a::hugeint) as score
  from f join n using (lang) left join longer on longer.lang = f.lang and longer.part = f.phrase join range(1, 5) as k(k) on k.k < f.m
    join f l on l.lang = f.lang and l.m = k.k and l.phrase = array_to_string(string_split(f.phrase, ' ')[1:k.k::int], ' ')
    join f r on r.lang = f.lang and r.m = f.m - k.k and r.phrase = array_to_string(string_split(f.phrase, ' ')[k.k::int + 1:f.m::int], ' ')
  where f.m > 1 and (longer.most is null or 100 * longer.most < 100 * f.a)),
s as (select *, row_number() over (partition by lang, phrase order by score, k) as nth from c)
select lang, row_number() over (partition by lang order by score desc, a desc, phrase) as rank, phrase, a, l, r, n, score::bigint as score from s
where nth = 1 qualify rank <= 2000
"""

# crc32 by its table, made from its rule; all code points of a word are below 256, two bytes from 192 on.
OP13 = r"""
with recursive t(v) as (
  select list(list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: case when c % 2 = 1 then xor(c >> 1, 3988292384) else c >> 1 end) order by i) from (select unnest(range(256))::bigint as i)),
r as (
  select doc_id, translate(w, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as w, count(*) as n
  from (select doc_id, unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-zÀ-ÿ]+')) as w from documents) group by all),
h as (
  select w, n, length(w) as len, xor(4294967295, list_reduce(list_concat([4294967295], flatten(list_transform(string_split(coalesce(doc_id::varchar, '') || ':' || w, ''), lambda c: case when unicode(c) < 128 then [unicode(c)::bigint] else [195, unicode(c)::bigint - 64] end))),
    lambda c, b: xor(v[xor(c, b) % 256 + 1], c >> 8))) as h from r, t),
k as (select case when h % 97 = 0 then substr(w, 1, (h % len)::int) || substr(w, (h % len)::int + 2) else w end as word, n from h),
words as materialized (select word, sum(n)::bigint as n from k where length(word) >= 5 group by word having sum(n) >= 3),
d as materialized (select word, n, length(word) as len, unnest(range(length(word))) as i from words),
e as materialized (select word, n, len, i, substr(word, 1, i) || substr(word, i + 2) as less from d),
pairs as (
  select a.word, b.word as near, b.n as near_n from e a join e b on a.len = b.len and a.i = b.i and a.less = b.less and a.word <> b.word
  union select e.word, w.word, w.n from e join words w on w.word = e.less
  union select w.word, e.word, e.n from e join words w on w.word = e.less),
f as (select word, count(*) as n_near, max(near_n) as most from pairs group by word),
b as (
  select w.word, w.n, coalesce(f.n_near, 0) as n_near, case when f.most >= 2 * w.n then f.most end as form_n,
    case when f.most >= 2 * w.n then (select min(p.near) from pairs p where p.word = w.word and p.near_n = f.most) end as form from words w left join f using (word)),
c(word, last) as (select word, word from b union all select c.word, b.form from c join b on b.word = c.last where b.form is not null)
select b.word, b.form, c.last as root, b.n, b.n_near, b.form_n from b join c on c.word = b.word join b z on z.word = c.last where z.form is null
"""

_CRC = """xor(4294967295, list_reduce(list_concat([4294967295], list_transform(string_split(doc_id::varchar, ''), lambda c: unicode(c)::bigint)), lambda c, b: xor(v[xor(c, b) % 256 + 1], c >> 8)))"""
BASE_WORD_MODEL = rf"""
with t(v) as (
  select list(list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: case when c % 2 = 1 then xor(c >> 1, 3988292384) else c >> 1 end) order by i) from (select unnest(range(256))::bigint as i)),
d as (select doc_id, {_CRC} % 7 = 2 as held_out, list_append(regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+'), ' ') as ws from documents, t),
w as (select doc_id, held_out, unnest(ws) as word from d),
c as (select word, count(*) as c from w where not held_out group by word),
n as (select sum(c)::bigint as n, count(*) as v from c)
select w.doc_id, any_value(held_out) as held_out, count(*) as n_tokens, count(c.c) as n_known, any_value(n.n) as train_tokens, round(sum(log10((coalesce(c.c, 0) + 1) / (n.n + n.v + 1))), 6) as base_score
from w left join c using (word), n group by w.doc_id
"""

ORACLES = {"op2_decontamination": OP2, "op4_urls": OP4, "op7_embeddings": OP7, "op8_jaccard_join": OP8, "op9_mixing": OP9, "op10_line_dedup": OP10, "op11_collocations": OP11, "op13_spelling": OP13, "base_licenses": BASE_LICENSES, "base_personal_data": BASE_PERSONAL_DATA, "base_word_model": BASE_WORD_MODEL}
