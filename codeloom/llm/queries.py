"""Queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from .decontam import op4_simhash_decontamination
from .htmltext import op10_line_blocks
from .langid import op1_hyperdimensional_langid
from .linefreq import op9_line_frequency
from .lmscore import op3_stupid_backoff
from .neardup import op7_minhash_components
from .pii import op2_feistel_pseudonyms
from .quality import op5_positive_unlabelled_quality
from .sharding import op6_feistel_shards
from .sptokens import op8_shared_prefix_pieces

QUERIES = {
    f.__name__: f
    for f in (
        op1_hyperdimensional_langid,
        op2_feistel_pseudonyms,
        op3_stupid_backoff,
        op4_simhash_decontamination,
        op5_positive_unlabelled_quality,
        op6_feistel_shards,
        op7_minhash_components,
        op8_shared_prefix_pieces,
        op9_line_frequency,
        op10_line_blocks,
    )
}

ORACLES: dict[str, str] = {
    "op9_line_frequency": r"""
with d as (
  select row_number() over () as rid, doc_id, coalesce(source, '') as host, coalesce(text, '') as t from documents
), w as (
  select rid, doc_id, host, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') as ws from d
), g as (
  select rid, i, ws[i : i + 4] as g from w, unnest(range(1, len(ws) - 3)) as u(i) where len(ws) >= 5
), r as (
  select rid, g from g group by all having count(*) > 1
), cov as (
  select rid, count(distinct i + k) as n from g join r using (rid, g), unnest(range(0, 5)) as u(k) group by rid
), l as (
  select rid, host, line from w, unnest(string_split(t, chr(10))) as u(line) where regexp_matches(line, '[^\x20\x09-\x0D]')
), nl as (
  select rid, host, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) as n,
         translate(array_to_string(regexp_extract_all(line, '[^\x20\x09-\x0D]+'), ' '), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as line
  from l
), dl as (
  select distinct rid, host, md5(line)[1:15] as line from nl
), lines as (
  select rid, host, list_sort(list(line))::varchar as document from dl group by all
), f as (
  select host, line from dl join lines using (rid, host) group by host, line having count(distinct document) > 10
), gone as (
  select rid, sum(n) as gone from nl join f on nl.host = f.host and md5(nl.line)[1:15] = f.line group by rid
), dup as (
  select rid, count(*) - count(distinct line) as n from l group by rid
), x as (
  select doc_id, len(ws)::bigint as n_words, length(array_to_string(ws, ''))::bigint as word_chars,
         length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::bigint as n_symbols,
         coalesce(dup.n, 0)::bigint as n_dup_lines, coalesce(cov.n, 0)::bigint as n_repeat_words,
         (len(ws) - coalesce(gone, 0))::bigint as kept_words
  from w left join dup using (rid) left join cov using (rid) left join gone using (rid)
)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       (n_words < 10 or 100 * n_repeat_words > 20 * n_words) as base_failed,
       not (n_words < 10 or 100 * n_repeat_words > 20 * n_words) and kept_words >= 10 and 100 * kept_words >= 25 * n_words as kept,
       kept_words
from x
""",
    "op4_simhash_decontamination": r"""
with d as (
  select doc_id, list_filter(string_split(trim(regexp_replace(lower(text), '[^\p{L}\p{N}]+', ' ', 'g')), ' '), lambda x: x <> '') as w from documents where doc_id is not null
), b as (
  select item_id, list_filter(string_split(trim(regexp_replace(lower(text), '[^\p{L}\p{N}]+', ' ', 'g')), ' '), lambda x: x <> '') as w from benchmark where item_id is not null
), dg as (
  select doc_id, len(w) - 4 as doc_n, i - 1 as pos, w[i : i + 4] as g from d, unnest(range(1, len(w) - 3)) as u(i) where len(w) >= 5
), bg as (
  select item_id, len(w) - 4 as item_n, w[i : i + 4] as g, count(*) as most from b, unnest(range(1, len(w) - 3)) as u(i) where len(w) >= 5 group by all
), a as (
  select doc_id, doc_n, item_id, item_n, least(doc_n, item_n) as n, pos, g, most from dg join bg using (g)
), s as (
  select distinct doc_id, item_id, item_n, n, t as s from a, unnest(range(greatest(0, pos - n + 1), least(pos, doc_n - n) + 1)) as u(t)
), c as (
  select doc_id, item_id, item_n, n, s, g, least(count(*), any_value(most)) as c
  from s join a using (doc_id, item_id, item_n, n) where pos >= s and pos < s + n group by all
), x as (
  select doc_id, item_id, item_n, n, s, sum(c) as shared from c group by all
)
select doc_id, item_id, max(shared)::bigint as shared, max(shared / (n + item_n - shared)) as similarity
from x where 100 * shared >= 80 * (n + item_n - shared) group by doc_id, item_id
""",
    "op7_minhash_components": r"""
with recursive w as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as ws from documents
), s as (
  select doc_id, case when len(ws) >= 3 then list_distinct(list_transform(range(1, len(ws) - 1), lambda i: array_to_string(ws[i : i + 2], ' '))) when len(ws) > 0 then [array_to_string(ws, ' ')] else [] end as g from w
), n as (
  select doc_id, len(g)::bigint as n from s
), e as (
  select doc_id, unnest(g) as g from s
), p as (
  select x.doc_id as a, y.doc_id as b, count(*) as c from e x join e y on x.g = y.g and x.doc_id < y.doc_id group by all
), l as (
  select a, b from p join n x on x.doc_id = a join n y on y.doc_id = b where 100 * c >= 85 * (x.n + y.n - c)
), r as (
  select doc_id, doc_id as c from n union select z.b, r.c from r join (select a, b from l union all select b, a from l) z on r.doc_id = z.a
)
select doc_id, n as n_shingles, min(c) as component_id, min(c) = doc_id as kept from r join n using (doc_id) group by doc_id, n
""",
    "op3_stupid_backoff": r"""
with d as (
  select row_number() over () as rid, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as ws
  from documents
), t as (
  select rid, i, ws[i] as w, case when i > 1 then ws[i - 1] end as v from d, unnest(range(1, len(ws) + 1)) as u(i)
), c1 as (
  select w, count(*) as c from t group by w
), c2 as (
  select v, w, count(*) as c from t where i > 1 group by v, w
), k1 as (
  select rid, w, count(*) as k from t group by rid, w
), k2 as (
  select rid, v, w, count(*) as k from t where i > 1 group by rid, v, w
), n as (
  select count(*) as n from t
), s as (
  select t.rid, sum(case when c2.c > k2.k then ln(c2.c - k2.k) - ln(a.c - ka.k)
    else case when i > 1 then ln(0.4) else 0 end + ln(greatest(b.c - kb.k, 0.5::double)) - ln(greatest(n.n - len(d.ws), 1)) end) as s
  from t cross join n join d on d.rid = t.rid join c1 b on b.w = t.w join k1 kb on kb.rid = t.rid and kb.w = t.w
  left join c1 a on a.w = t.v left join k1 ka on ka.rid = t.rid and ka.w = t.v
  left join c2 on c2.v = t.v and c2.w = t.w left join k2 on k2.rid = t.rid and k2.v = t.v and k2.w = t.w group by t.rid
)
select doc_id, len(ws)::bigint as n_words, round(coalesce(s, 0), 6) as log_score,
       case when len(ws) > 0 then round(round(s, 6) / len(ws), 6) end as mean_log_score
from d left join s using (rid)
""",
}
