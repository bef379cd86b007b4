"""DuckDB SQL of the queries that SQL can express within seconds on whole tables."""

from . import licenses

MIX = r"""
with d as (select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) as size, md5(coalesce(text, '')) as h from documents),
q as (select doc_id, max(1.0 + coalesce(quality, 0)) as q from labels where doc_id is not null group by doc_id),
k as (select d.*, -ln((('0x' || substr(md5(coalesce(d.doc_id::varchar, '') || '|' || h), 1, 12))::bigint + 0.5) / 281474976710656.0) / coalesce(q, 1.0) as key from d left join q on d.doc_id = q.doc_id),
s as (select source, sum(size)::double as ss from d group by source),
w as (select source, ss, ((row_number() over (order by source nulls last) - 1) % 3 + 1)::double as w from s),
c as (select *, 3.0 * ss as cap, sum(ss) over () - coalesce(sum(3.0 * ss) over (order by 3.0 * ss / w, source nulls last rows between unbounded preceding and 1 preceding), 0) as lft,
  sum(w) over (order by 3.0 * ss / w, source nulls last rows between current row and unbounded following) as ws from w),
f as (select lft / ws as share from c where not (lft * w >= cap * ws) order by cap / w, lft / ws limit 1),
t as (select source, ss, case when lft * w >= cap * ws then cap else least(cap, w * share) end as target from c left join f on true),
e as (select source as s, ss, target, case when ss > 0 then floor(target / ss) else 0 end as epochs from t),
r as (select k.*, ss, target, epochs, greatest(0.0, target - epochs * ss) as budget, coalesce(sum(size) over (partition by source order by key, doc_id nulls first, h rows between unbounded preceding and 1 preceding), 0) as upto from k join e on k.source is not distinct from e.s)
select doc_id, size::bigint as size, ss::bigint as source_size, target, (epochs + case when budget > 0 and upto + size / 2.0 <= budget then 1 else 0 end)::bigint * size::bigint as taken from r"""
SUBSTRINGS = r"""
with d as (select row_number() over () as rk, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents),
p as (select rk, i, md5(array_to_string(w[i:i + 34], ' ')) as h from (select rk, w, unnest(generate_series(1, len(w) - 34)) as i from d where len(w) >= 35) x),
m as (select distinct rk, unnest(generate_series(i, i + 34)) as j from (select rk, i, count(*) over (partition by h) as c from p) y where c > 1),
o as (select rk, j, word from (select rk, unnest(generate_series(1, len(w))) as j, unnest(w) as word from d) z),
k as (select o.rk, count(m.j) as gone, coalesce(string_agg(case when m.j is null then word end, ' ' order by o.j), '') as kept from o left join m on m.rk = o.rk and m.j = o.j group by o.rk)
select doc_id, len(w)::bigint as n_words, coalesce(gone, 0)::bigint as n_removed, sha256(coalesce(kept, '')) as kept_sha256 from d left join k using (rk)"""
COLLOCATIONS = r"""
with p as (select coalesce(lang, 'und') as lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) as piece from documents),
w as (select lang, regexp_extract_all(piece, '[^\x20\x09]+') as w from p),
s as (select lang, sum(len(w))::bigint as n from w group by lang),
u as (select lang, len, w[i:i + len - 1] as g from (select lang, w, len, unnest(generate_series(1, len(w) - len + 1)) as i from w, (select unnest([1, 2, 3]) as len) x where len(w) >= len) y),
f as (select lang, len, g, count(*) as f from u group by lang, len, g having count(*) >= 10),
c as (select lang, len, g, f as a, unnest(generate_series(1, len - 1)) as k from f where len > 1),
e as (select c.*, x.f as l, y.f as r, (1000000::hugeint * c.a * c.a) // (x.f::hugeint * y.f) as score from c join f x on x.lang = c.lang and x.g = c.g[1:k] join f y on y.lang = c.lang and y.g = c.g[k + 1:]),
b as (select * from e qualify row_number() over (partition by lang, g order by score, k) = 1),
m as (select lang, g, max(f) as longer from (select lang, unnest([g[1:2], g[2:3]]) as g, f from f where len = 3) z group by lang, g),
o as (select b.lang, array_to_string(b.g, ' ') as phrase, a, l, r, n, score::bigint as score from b join s on s.lang = b.lang left join m on m.lang = b.lang and m.g = b.g where coalesce(longer, 0) * 100 < 50 * a)
select lang, row_number() over (partition by lang order by score desc, a desc, phrase) as rank, phrase, a, l, r, n, score from o qualify rank <= 2000"""
CHAT = r"""
with t as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -7, 0, 'user', '</s>[INST] ok [/INST]' union all select -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
e as (select *, length(regexp_replace(regexp_replace(replace(text, '\', '\\'), '<(/?s>)', '<.\1', 'g'), '\[(/?(INST|SYS|ROLE)\]|/TURN\])', '[.\1', 'g')) as n,
  length(regexp_replace(regexp_replace(replace(role, '\', '\\'), '<(/?s>)', '<.\1', 'g'), '\[(/?(INST|SYS|ROLE)\]|/TURN\])', '[.\1', 'g')) as r from t)
select conv_id, count(*) as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn nulls first, role, text)) as turns_sha256,
  coalesce(sum(length(text)) filter (role = 'assistant'), 0)::bigint as loss_chars, sha256(coalesce(string_agg(text, '' order by turn nulls first, role, text) filter (role = 'assistant'), '')) as loss_sha256,
  (3 + sum(n + case role when 'user' then 15 when 'assistant' then 6 when 'system' then 13 else 24 + r end))::bigint as formatted_chars
from e group by conv_id"""
SQL = {"op1_license_scan": licenses.sql(), "op6_mix": MIX, "op7_substring_dedup": SUBSTRINGS, "op11_collocations": COLLOCATIONS, "op13_chat": CHAT}
