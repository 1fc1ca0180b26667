"""DuckDB SQL for the results of operators whose method SQL does not follow."""

from __future__ import annotations

from inlay.llm.op3_sharding import crc
from inlay.llm.queries import ORACLES

# Links between all sets that share a shingle, and their components.
NEAR_DEDUP = r"""
with recursive split as (select doc_id, list_filter(regexp_split_to_array(translate(coalesce("text", ''),
  'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w != '') as words from documents),
sets as (select doc_id, list_sort(list_distinct(case when len(words) < 2 then words
  else list_transform(range(1, len(words)), lambda i: words[i] || ' ' || words[i+1]) end)) as grams from split),
owned as (select doc_id, len(grams)::bigint as n, case when len(grams) > 0 and doc_id is not null then min(doc_id) over (partition by grams) else doc_id end as rep
  from sets),
reps as (select doc_id as rep, unnest(grams) as gram, len(grams) as n from sets join (select distinct rep from owned where n > 0) r on r.rep = doc_id),
links as (select a.rep as x, b.rep as y from reps a join reps b on a.gram = b.gram and a.rep < b.rep
  where 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n) group by a.rep, b.rep, a.n, b.n
  having 100 * count(*) >= 80 * (a.n + b.n - count(*))),
both_ways as (select x, y from links union all select y, x from links),
reach(node, root) as (select rep, rep from (select distinct rep from owned) union select e.y, r.root from reach r join both_ways e on e.x = r.node),
least_of as (select node, min(root) as root from reach group by node)
select doc_id, n as n_shingles, root as component_id, doc_id is not distinct from root as kept
from owned left join least_of on node is not distinct from rep"""

# Every string of 50 bytes by its place, as hex; texts are read in pieces of a thousand places.
SUFFIX_DEDUP = r"""
with texts as (select doc_id, coalesce("text", '') as body, strlen(coalesce("text", ''))::bigint as n_bytes, hex(encode(coalesce("text", ''))) as x from documents),
pieces as (select doc_id, n_bytes, base, substr(x, 2*base + 1, 2098) as p from (select doc_id, n_bytes, x, unnest(range(0, n_bytes - 49, 1000)) as base
  from texts where n_bytes >= 50)),
keyed as (select doc_id, base + j as i, md5_number(substr(p, 2*j - 1, 100)) as k
  from (select doc_id, base, p, unnest(range(1, least(1000, n_bytes - 49 - base) + 1)) as j from pieces)),
starts as (select doc_id, i from (select *, min(doc_id) over (partition by k) as first from keyed) where first < doc_id),
edges as (select doc_id, i, lag(i) over (partition by doc_id order by i) as before from starts),
spans as (select doc_id, min(i) as a, max(i) + 49 as z from (select *, count(*) filter (before is null or i > before + 50)
  over (partition by doc_id order by i) as span from edges) group by doc_id, span),
cuts as (select doc_id, list(struct_pack(a := a, z := z) order by a) as s, sum(z - a + 1)::bigint as n_removed, count(*) as n_spans from spans group by 1)
select t.doc_id, n_bytes, coalesce(n_removed, 0)::bigint as n_removed, coalesce(n_spans, 0)::bigint as n_spans,
  sha256(unhex(case when s is null then x else
    array_to_string(list_transform(range(1, len(s) + 2), lambda k: x[(case when k = 1 then 1 else 2 * s[greatest(k-1,1)].z + 1 end) :
      (case when k > len(s) then 2 * n_bytes else 2 * s[least(k, len(s))].a - 2 end)]), '') end)) as kept_sha256
from texts t left join cuts c on c.doc_id = t.doc_id"""

# Lines by the rarest words that similar sets must share, then by the sets.
LINE_DEDUP = rf"""
with crc_table as (select list(c order by i) as t from (select i, list_reduce(list_prepend(i, range(8)),
  lambda c, k: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end) as c from range(256) r(i))),
docs as (select doc_id, string_split("text", chr(10)) as parts from documents),
line_sets as (select doc_id, at_line - 1 as line, list_sort(list_distinct(list_filter(regexp_split_to_array(translate(part,
  'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w != ''))) as s
  from (select doc_id, unnest(parts) as part, generate_subscripts(parts, 1) as at_line from docs)),
numbered as (select doc_id, line, s, len(s) as n, row_number() over (partition by s order by doc_id, line) as turn,
  first(doc_id) over (partition by s order by doc_id, line) as fd, first(line) over (partition by s order by doc_id, line) as fl
  from line_sets where len(s) > 0),
classes as (select doc_id, line, s, n from numbered where turn = 1),
spots as (select doc_id, line, n, unnest(s) as w from classes),
ranked as (select doc_id, line, n, w, row_number() over (partition by doc_id, line order by held, w) as r
  from spots join (select w, count(*) as held from spots group by w) using (w)),
prefixes as (select doc_id, line, n, w from ranked where r <= n - (80 * n + 99) // 100 + 1),
met as (select distinct a.doc_id, a.line, b.doc_id as ed, b.line as el from prefixes a join prefixes b on a.w = b.w
  and (b.doc_id < a.doc_id or b.doc_id = a.doc_id and b.line < a.line) and 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)),
compared as (select m.doc_id, m.line, x.n + y.n as total, len(list_intersect(x.s, y.s)) as shared from met m
  join classes x on x.doc_id = m.doc_id and x.line = m.line join classes y on y.doc_id = m.ed and y.line = m.el),
gone as (select distinct doc_id as fd, line as fl, true as is_gone from compared where 100 * shared >= 80 * (total - shared)),
removed as (select doc_id, list(line) as lines from numbered left join gone using (fd, fl) where turn > 1 or is_gone group by doc_id),
kept as (select doc_id, coalesce(len(parts), 0) as n_lines, coalesce(len(lines), 0) as n_removed, encode(coalesce(array_to_string(
  list_filter(parts, lambda p, i: not list_contains(coalesce(lines, []), i - 1)), chr(10)), '')) as body
  from docs left join removed using (doc_id))
select doc_id, n_lines::bigint as n_lines, n_removed::bigint as n_removed, {crc("body")} as kept_crc32 from kept, crc_table"""

ORACLES["op1_near_dedup"] = NEAR_DEDUP
ORACLES["op7_suffix_dedup"] = SUFFIX_DEDUP
ORACLES["op4_line_dedup"] = LINE_DEDUP
