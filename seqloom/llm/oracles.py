"""DuckDB SQL for the queries that SQL can express."""

#: Base32 digests are put together from the bits of the hexadecimal ones.
WARC = """with p as (select page_id, coalesce(html, '') as h, sha1(coalesce(html, '')) as hex, octet_length(encode(coalesce(html, ''))) as n from pages),
bits as (select *, list_aggregate(list_transform(string_split(hex, ''), lambda c: substr('0000000100100011010001010110011110001001101010111100110111101111', 4 * instr('0123456789abcdef', c) - 3, 4)), 'string_agg', '') as b, min(page_id) over (partition by hex) as lead from p)
select page_id, cast(n as bigint) as payload_bytes, list_aggregate(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + list_sum(list_transform(range(5), lambda j: cast(substr(b, 5 * i + j + 1, 1) as int) << (4 - j)))::int, 1)), 'string_agg', '') as payload_digest,
case when lead < page_id then 'revisit' else 'response' end as record_type, case when lead < page_id then lead end as refers_to from bits"""

#: Shingle sets, links by their definition, and what is reachable over links.
JACCARD = """with recursive words as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') as w from documents),
sets as (select doc_id, case when len(w) = 0 then [] else list_distinct(list_transform(range(1, greatest(len(w) - 4, 1) + 1), lambda i: array_to_string(w[i:i + 4], ' '))) end as s from words),
items as (select doc_id, len(s) as n, unnest(s) as x from sets),
edges as (select a.doc_id as a, b.doc_id as b from items a join items b on a.x = b.x and a.doc_id <> b.doc_id group by a.doc_id, b.doc_id, a.n, b.n having 100 * count(*) >= 80 * (a.n + b.n - count(*))),
reach(a, b) as (select doc_id, doc_id from documents union select r.a, e.b from reach r join edges e on r.b = e.a)
select doc_id, cast(len(s) as bigint) as n_shingles, c.component_id from sets join (select a as doc_id, min(b) as component_id from reach group by a) c using (doc_id)"""

#: Cuts in code points, and the text put together again from the parts of the output.
FILL_IN_MIDDLE = """with t as (select doc_id, coalesce(text, '') as x, sha256('1:' || coalesce(cast(doc_id as varchar), '')) as s from documents),
h as (select doc_id, x, cast(length(x) as bigint) as n, ('0x' || s[1:8])::ubigint as h1, ('0x' || s[9:16])::ubigint as h2, ('0x' || s[17:24])::ubigint as h3, ('0x' || s[25:32])::ubigint as h4 from t),
c as (select *, least(h1 % (n + 1), h2 % (n + 1))::bigint as a, greatest(h1 % (n + 1), h2 % (n + 1))::bigint as b,
  case when n = 0 or contains(x, '<P>') or contains(x, '<S>') or contains(x, '<M>') or h3 % 100 >= 90 then 'plain' when h4 % 100 < 20 then 'spm' else 'psm' end as form from h),
p as (select *, substring(x, 1, a) as pre, substring(x, a + 1, b - a) as mid, substring(x, b + 1) as suf from c),
o as (select *, case form when 'plain' then x when 'psm' then '<P>' || pre || '<S>' || suf || '<M>' || mid else '<S>' || suf || '<P>' || pre || '<M>' || mid end as out from p),
r as (select *, case form when 'plain' then out when 'psm' then string_split(string_split(out, '<S>')[1], '<P>')[2] || string_split(out, '<M>')[2] || string_split(string_split(out, '<S>')[2], '<M>')[1]
  else string_split(string_split(out, '<P>')[2], '<M>')[1] || string_split(out, '<M>')[2] || string_split(string_split(out, '<P>')[1], '<S>')[2] end as back from o)
select doc_id, n, form, case when form <> 'plain' then a end as prefix_chars, case when form <> 'plain' then b - a end as middle_chars, sha256(out) as output_sha256, sha256(back) as restored_sha256 from r"""

_FIELDS = ", ".join(f"coalesce(octet_length(encode(cast({c} as varchar))) || ':' || cast({c} as varchar), '-')" for c in ("doc_id", "source", "lang", "n_chars"))
_TEXT = "coalesce(octet_length(encode({0})) || ':' || {0}, '-')"
_LOWERED = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

#: Trees by recursion over levels; what stands beside a node in its run; folding by recursion over steps. crc32 by its rule.
MERKLE = f"""with recursive tab as (select list(list_reduce(range(8), lambda c, k: case when c % 2 = 1 then xor(c >> 1, 3988292384) else c >> 1 end, i) order by i) as t from range(256) as r(i)),
d as (select row_number() over () as rid, doc_id, lang, sha256(concat({_FIELDS}, {_TEXT.format("text")})) as leaf, sha256(concat({_FIELDS}, {_TEXT.format(_LOWERED)})) as other,
  xor(list_reduce(list_transform(string_split(cast(doc_id as varchar), ''), lambda x: cast(ascii(x) as bigint)), lambda c, b: xor(c >> 8, t[xor(c, b) % 256 + 1]), 4294967295), 4294967295) as crc from documents, tab),
ranked as (select *, dense_rank() over (order by lang nulls first) - 1 as tree, row_number() over (partition by lang order by doc_id nulls first, leaf) - 1 as idx, count(*) over (partition by lang) as n from d),
m as (select count(distinct tree) as trees from ranked),
low(tree, level, idx, n, h) as (select tree, 0, idx, n, leaf from ranked union all select tree, level + 1, idx // 8, (n + 7) // 8, sha256(string_agg(h, '' order by idx)) from low where n > 1 group by tree, level, idx // 8, n),
subroots as (select tree, h from low where n = 1),
up(tree, level, idx, n, h) as (select -1, 0, tree, trees, h from subroots, m union all select tree, level + 1, idx // 8, (n + 7) // 8, sha256(string_agg(h, '' order by idx)) from up where n > 1 group by tree, level, idx // 8, n),
nodes as (select * from low where n > 1 union all select * from up where n > 1),
beside as (select tree, level, idx, coalesce(string_agg(h, '') over (w rows between unbounded preceding and 1 preceding), '') as l, coalesce(string_agg(h, '') over (w rows between 1 following and unbounded following), '') as r
  from nodes window w as (partition by tree, level, idx // 8 order by idx)),
walk(rid, own, tree, level, idx, n, acc, proof) as (select rid, tree, tree, 0, idx, n, case when crc % 3 = 0 then other else leaf end, '' from ranked
  union all select w.rid, w.own, case when w.n > 1 then w.tree else -1 end, case when w.n > 1 then w.level + 1 else 0 end, case when w.n > 1 then w.idx // 8 else w.own end, case when w.n > 1 then (w.n + 7) // 8 else m.trees end,
    case when w.n > 1 then sha256(b.l || w.acc || b.r) else w.acc end, case when w.n > 1 then w.proof || b.l || b.r else w.proof end
  from walk w cross join m left join beside b on b.tree = w.tree and b.level = w.level and b.idx = w.idx where w.n > 1 or w.tree >= 0)
select doc_id, leaf, s.h as subroot, (select h from up where n = 1) as root, sha256(proof) as proof_sha256, acc as folded_root, acc = (select h from up where n = 1) as verified
from walk w join ranked using (rid) join subroots s on s.tree = w.own where w.tree = -1 and w.n = 1"""
