"""SQL twins of the queries that SQL can express."""

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

OP7 = r"""
with w as (
  select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as words from documents
), k as (
  select doc_id, p, array_to_string(words[p:p + 12], ' ') as gram
  from (select doc_id, words, unnest(range(1, len(words) - 11)) as p from w where len(words) >= 13) g
), low as (
  select gram, min(doc_id) as first_id from k group by gram
), gone as (
  select doc_id, list(distinct i) as gone
  from (select k.doc_id, unnest(range(p, p + 13)) as i from k join low using (gram) where first_id < k.doc_id) h
  group by doc_id
)
select w.doc_id, cast(len(words) as bigint) as n_words, cast(coalesce(len(gone), 0) as bigint) as n_removed,
  sha256(array_to_string([words[i] for i in range(1, len(words) + 1) if not list_contains(coalesce(gone, []), i)], ' ')) as kept_sha256
from w left join gone using (doc_id)
"""

OP9 = rf"""
with d as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as words
  from documents
), b as (
  select item_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as words
  from benchmark
), windows as (
  select distinct item_id, n, array_to_string(words[p:p + n - 1], ' ') as gram
  from (select item_id, words, n, unnest(range(1, len(words) - n + 2)) as p
        from (select item_id, words, least(len(words), 13) as n from b where len(words) > 0) x) y
), k as (
  select doc_id, n, p, array_to_string(words[p:p + n - 1], ' ') as gram
  from (select doc_id, words, n, unnest(range(1, len(words) - n + 2)) as p
        from d, (select distinct n from windows) l where len(words) >= n) g
), hits as (
  select k.doc_id, k.p, k.n, item_id from k join windows using (n, gram)
), words_hit as (
  select doc_id, count(distinct i) as n_hit from (select doc_id, unnest(range(p, p + n)) as i from hits) h group by doc_id
), items as (
  select doc_id, count(*) as n_items, string_agg(item, ',' order by item) as listed
  from (select distinct doc_id, cast(item_id as varchar) as item from hits) h group by doc_id
)
select d.doc_id, cast(len(words) as bigint) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items,
  sha256(coalesce(listed, '')) as items_sha256,
  coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(words) as contaminated
from d left join words_hit using (doc_id) left join items using (doc_id)
"""

OP10 = rf"""
with recursive w as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x20\x09-\x0D]+') as words from documents
), s as (
  select distinct doc_id, array_to_string(words[p:p + 3], ' ') as shingle
  from (select doc_id, words, unnest(range(1, greatest(len(words) - 3, 1) + 1)) as p from w where len(words) > 0) g
), sizes as (
  select doc_id, count(*) as n from s group by doc_id
), pairs as (
  select x.doc_id as a, y.doc_id as b, count(*) as shared
  from s x join s y on x.shingle = y.shingle and x.doc_id < y.doc_id group by all
), links as (
  select a, b from pairs join sizes p on p.doc_id = a join sizes q on q.doc_id = b where 100 * shared >= 80 * (p.n + q.n - shared)
), reach(a, b) as (
  select doc_id, doc_id from w
  union
  select r.a, l.y from reach r join (select a as x, b as y from links union all select b, a from links) l on r.b = l.x
)
select w.doc_id, coalesce(n, 0) as n_shingles, component_id, w.doc_id = component_id as kept
from w left join sizes using (doc_id) join (select a as doc_id, min(b) as component_id from reach group by a) c using (doc_id)
"""

OP13 = r"""
with own as (
  select conv_id, row_number() over (
      partition by conv_id order by turn nulls first,
      sha256(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) - 1 as pos,
    coalesce(role, '') as role, coalesce(text, '') as text
  from conversations where conv_id is not null
), sizes as (
  select conv_id, count(*) as n from own group by conv_id
), crc as (
  select conv_id, n, list_reduce(
      [4294967295::bigint] || flatten(list_transform(string_split(cast(conv_id as varchar), ''),
        lambda c: [ord(c)::bigint, -1, -1, -1, -1, -1, -1, -1, -1])),
      lambda a, x: case when x >= 0 then xor(a, x) else xor(a >> 1, (a & 1) * 3988292384) end) as state
  from sizes
), convs as (
  select conv_id, conv_id - conv_id % 5 as first, xor(state, 4294967295) % 9 as h from crc
), heads as (
  select c.conv_id, c.h, least(c.h, coalesce(s.n, 0)) as n_head from convs c left join sizes s on s.conv_id = c.first
), turns as (
  select c.conv_id, o.pos, o.role, o.text from convs c join own o on o.conv_id = c.first where o.pos < c.h
  union all
  select o.conv_id, o.pos - h.h + h.n_head, o.role, o.text from own o join heads h using (conv_id) where o.pos >= h.h
), prefixes as (
  select conv_id, cast(pos + 1 as bigint) as depth, strlen(text) as bytes, string_agg(sha256(strlen(role) || ':' || role || text), '') over (
    partition by conv_id order by pos rows unbounded preceding) as key
  from turns
  union all
  select conv_id, 0, 0, '' from convs
), nodes as (
  select key, any_value(depth) as depth, any_value(bytes) as bytes, min(conv_id) as conv_id, count(*) as n_convs
  from prefixes group by key
), family as (
  select left(key, length(key) - 64) as key, count(*) as n_children from nodes where key <> '' group by 1
), below as (
  select p.key, sum((u.n_convs - 1) * u.bytes) as saved, count(*) filter (where f.key is null) as n_leaves
  from nodes u left join family f using (key) join prefixes p on p.conv_id = u.conv_id and p.depth <= u.depth
  group by p.key
), ends as (
  select key, string_agg(cast(conv_id as varchar), ',' order by conv_id) as ids
  from (select conv_id, max_by(key, depth) as key from prefixes group by conv_id) group by key
)
select n.conv_id, n.depth, up.conv_id as parent_conv_id, cast(n.n_convs as bigint) as n_convs,
  cast(coalesce(f.n_children, 0) as bigint) as n_children, cast(b.n_leaves as bigint) as n_leaves,
  cast(b.saved as bigint) as saved_tokens, sha256(coalesce(e.ids, '')) as ends_sha256
from nodes n join below b using (key) left join family f using (key) left join ends e using (key)
left join nodes up on n.key <> '' and up.key = left(n.key, length(n.key) - 64)
"""

ORACLES: dict[str, str] = {
    "op7_substring_dedup": OP7,
    "op9_decontamination": OP9,
    "op10_minhash": OP10,
    "op13_prefix_trie": OP13,
}
