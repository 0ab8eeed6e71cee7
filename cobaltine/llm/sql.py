"""The same results in DuckDB SQL, where SQL can express them."""

from __future__ import annotations

#: words of a text, as the operators split it
WORDS = r"list_filter(regexp_split_to_array({}, '[\x20\x09-\x0D]+'), lambda w: w <> '')"
#: ASCII lower case only, as the operators do it
ASCII_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP3 = f"""
with docs as (select doc_id, {WORDS.format("coalesce(text, '')")} as w from documents),
starts as (select doc_id, w, unnest(range(1, len(w) - 11)) as i from docs),
windows as (select doc_id, i, array_to_string(w[i:i + 12], ' ') as s from starts),
judged as (select doc_id, i, min(doc_id) over (partition by s) < doc_id as hit from windows),
hits as (select doc_id, i as a from judged where hit),
places as (select d.doc_id, unnest(d.w) as word, unnest(range(1, len(d.w) + 1)) as i from docs d),
gone as (select distinct doc_id, unnest(range(a, a + 13)) as i from hits),
kept as (
  select p.doc_id, count(*) as n_words, count(g.i) as n_removed,
         string_agg(case when g.i is null then p.word end, ' ' order by p.i) as t
  from places p left join gone g on g.doc_id = p.doc_id and g.i = p.i group by p.doc_id)
select d.doc_id, cast(coalesce(n_words, 0) as bigint) as n_words, cast(coalesce(n_removed, 0) as bigint) as n_removed,
       sha256(coalesce(t, '')) as kept_sha256
from documents d left join kept k on k.doc_id = d.doc_id where d.doc_id is not null
"""

#: texts of one item_id are items of their own, texts of one doc_id documents of their own; the best find of a pair counts
OP8 = f"""
with texts(kind, id, t) as (
  select distinct 'd', doc_id, coalesce(text, '') from documents where doc_id is not null
  union all select distinct 'b', item_id, coalesce(text, '') from benchmark where item_id is not null),
shingled as (select row_number() over () as r, kind, id, {WORDS.format(ASCII_LOWER.format("t"))} as w from texts),
grams as (select distinct r, kind, id, array_to_string(w[i:i + 4], ' ') as s from (select r, kind, id, w, unnest(range(1, len(w) - 3)) as i from shingled)),
sizes as (select r, count(*) as n_shingles from grams where kind = 'b' group by r),
pairs as (select d.r as d, b.r, d.id as doc_id, b.id as item_id, count(*) as n_shared from grams d join grams b on d.s = b.s where d.kind = 'd' and b.kind = 'b' group by all)
select doc_id, item_id, n_shingles, n_shared, n_shared / n_shingles as containment
from pairs join sizes using (r) where n_shared * 100 >= 80 * n_shingles
qualify row_number() over (partition by doc_id, item_id order by n_shared / n_shingles desc, n_shared desc) = 1
"""

OP9 = f"""
with recursive docs as (select doc_id, {WORDS.format(ASCII_LOWER.format("coalesce(text, '')"))} as w from documents),
grams as (
  select distinct doc_id, array_to_string(w[i:i + 2], ' ') as s
  from (select doc_id, w, unnest(range(1, greatest(len(w) - 1, 2))) as i from docs where len(w) > 0)),
sizes as (select doc_id, count(*) as n from grams group by doc_id),
pairs as (select a.doc_id as a, b.doc_id as b, count(*) as shared from grams a join grams b on a.s = b.s and a.doc_id < b.doc_id group by 1, 2),
links as (select a, b from pairs join sizes x on x.doc_id = a join sizes y on y.doc_id = b where 100 * shared >= 85 * (x.n + y.n - shared)),
both_ways as (select a, b from links union select b, a from links),
reach(a, b) as (select a, b from both_ways union select r.a, l.b from reach r join both_ways l on r.b = l.a),
least as (select a as doc_id, min(b) as m from reach group by a)
select d.doc_id, cast(coalesce(n, 0) as bigint) as n_shingles, least(d.doc_id, coalesce(m, d.doc_id)) as component_id,
       d.doc_id <= coalesce(m, d.doc_id) as kept
from documents d left join sizes s on s.doc_id = d.doc_id left join least l on l.doc_id = d.doc_id where d.doc_id is not null
"""

#: every row is a document, so rows are numbered; doc_ids need not be distinct
OP10 = f"""
with lines as (select row_number() over () as r, doc_id, string_split(coalesce(text, ''), chr(10)) as ls from documents),
each as (
  select r, doc_id, unnest(ls) as line, unnest(range(1, len(ls) + 1)) as i,
         {ASCII_LOWER.format("trim(unnest(ls), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))")} as k from lines),
common as (select k from each where k <> '' group by k having count(distinct r) >= 10)
select any_value(e.doc_id) as doc_id, count(*) as n_lines, count(c.k) as n_dropped,
       sha256(coalesce(string_agg(case when c.k is null then e.line end, chr(10) order by e.i), '')) as kept_sha256
from each e left join common c on c.k = e.k group by e.r
"""

def least(*options: str) -> str:
    return f"list_sort([{', '.join(options)}])[1]"


def edited(state: str, initial: str, cost: int | str, line: str = "") -> str:
    """A way to a state: one more edit behind the cheapest way to another one."""
    return f"{{'c': {state}.c + {cost}, 's': {state}.s || '{initial}', 'r': {state}.r{' || ' + line if line else ''}}}"


#: no way
FAR = "{'c': 1000000000, 's': '', 'r': ''}"
KEEP = "chr(10) || role || ':' || text"


def kept(state: str, initial: str) -> str:
    return f"case when kind = '{initial}' and not gone then {edited(state, 'K', 'more', KEEP)} else {FAR} end"


def reroled(state: str, role: str) -> str:
    return f"case when not gone then {edited(state, 'R', '1 + more', f"chr(10) || '{role}:' || text")} else {FAR} end"


def inserted(state: str, role: str) -> str:
    return edited(state, "I", 5, f"chr(10) || '{role}:'")


#: the checksum by its table; then, row by row, the cheapest and least edits and the repaired text for each state (b0 nothing yet, b1 system, b2 user, b3 assistant)
OP12 = f"""
with recursive
crcs as (select list(list_reduce(list_concat([n], range(8)), lambda c, i: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end) order by n) as t from (select unnest(range(256)) as n)),
named as (
  select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text,
         coalesce(cast(conv_id as varchar), ' ') || ':' || coalesce(cast(turn as varchar), ' ') as k from conversations),
summed as (
  select *, xor(list_reduce(list_concat([4294967295], list_transform(string_split(k, ''), lambda x: cast(ascii(x) as bigint))),
                            lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % 20 as damage from named, crcs),
damaged as (
  select conv_id, turn, case when damage = 4 then 'user' else role end as role,
         case damage when 1 then '' when 2 then regexp_replace(text, '[.!?]', '', 'g') else text end as text,
         unnest(range(case when damage = 3 then 2 else 1 end)) as again from summed where damage <> 0),
placed as (
  select *, row_number() over (partition by conv_id, role, text order by i) > 1 as seen
  from (select *, row_number() over (partition by conv_id order by turn nulls first, role, text, again) as i from damaged)),
judged as (
  select *, case when role[1] in ('s', 'u', 'a') then role[1] else 'o' end as kind,
         case when not regexp_matches(text, '[^\x20\x09-\x0D]') then 'blank' when seen then 'duplicate'
              when not regexp_matches(text, '[.!?][\x20\x09-\x0D]*\\z') then 'truncated' else '' end as fault from placed),
rows as (
  select *, fault in ('blank', 'duplicate') as gone, case when fault = 'truncated' then 5 else 0 end as more,
         coalesce(lag(kind) over (partition by conv_id order by i) || kind not in ('su', 'ua', 'au'), false) as odd from judged),
ways as (
  select distinct conv_id, cast(0 as bigint) as i, {{'c': 0, 's': '', 'r': ''}} as b0, {FAR} as b1,
         {{'c': 5, 's': 'I', 'r': chr(10) || 'user:'}} as b2, {{'c': 10, 's': 'II', 'r': chr(10) || 'user:' || chr(10) || 'assistant:'}} as b3 from rows
  union all
  select conv_id, i, b0, b1, u as b2, {least("b3", inserted("u", "assistant"))} as b3 from (
    select *, {least("b2", inserted("b0", "user"), inserted("b1", "user"), inserted("b3", "user"))} as u from (
      select r.conv_id, r.i, {edited("w.b0", "D", 2)} as b0,
             {least(edited("w.b1", "D", 2), kept("w.b0", "s"))} as b1,
             {least(edited("w.b2", "D", 2), *(f(f"w.b{q}", x) for q in (0, 1, 3) for f, x in ((kept, "u"), (reroled, "user"))))} as b2,
             {least(edited("w.b3", "D", 2), kept("w.b2", "a"), reroled("w.b2", "assistant"))} as b3
      from ways w join rows r on r.conv_id is not distinct from w.conv_id and r.i = w.i + 1))),
ends as (select conv_id, {least("b0", "b3")} as best from ways qualify row_number() over (partition by conv_id order by i desc) = 1),
counted as (
  select conv_id, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps, count(*) filter (fault = 'blank') as blank,
         count(*) filter (fault = 'duplicate') as duplicate, count(*) filter (fault = 'truncated') as truncated, count(*) filter (odd) as illegal
  from rows group by conv_id)
select o.conv_id, coalesce(gaps, 0) as gaps, coalesce(blank, 0) as blank, coalesce(duplicate, 0) as duplicate, coalesce(truncated, 0) as truncated,
       coalesce(illegal, 0) as illegal, coalesce(cast(best.c as bigint), 0) as cost, coalesce(best.s, '') as audit, sha256(coalesce(substr(best.r, 2), '')) as repaired_sha256
from (select distinct conv_id from conversations) o
left join counted c on c.conv_id is not distinct from o.conv_id left join ends e on e.conv_id is not distinct from o.conv_id
"""


def op13(k: int = 8, rounds: int = 10) -> str:
    """Each round's assignments and centroids as tables of their own; a mean is rounded down in whole numbers."""
    steps = []
    for i in range(rounds + 1):
        steps.append(
            f"""
d{i} as materialized (select r, j, sum((x - c) * (x - c)) as d from points join c{i} using (i) group by r, j),
a{i} as materialized (select r, arg_min(j, (d, j)) as j, min(d) as d from d{i} group by r)"""
        )
        if i < rounds:
            steps.append(
                f"""
m{i} as materialized (select j, i, cast(sum(x) as bigint) as s, count(*) as n from a{i} join points using (r) group by j, i),
c{i + 1} as materialized (select c.j, c.i, case when n is null then c else (s - (s % n + n) % n) // n end as c from c{i} c left join m{i} m on m.j = c.j and m.i = c.i)"""
            )
    return f"""
with kept as materialized (
  select row_number() over (order by sha256('3:' || vec_id), embedding) as r, vec_id, embedding as v from embeddings
  where len(embedding) = 64 and len(list_filter(embedding, lambda x: x is not null and isfinite(x))) = 64),
points as materialized (select r, unnest(range(1, 65)) as i, unnest(list_transform(v, lambda x: cast(floor(1024 * cast(x as double)) as bigint))) as x from kept),
c0 as materialized (select cast(r - 1 as integer) as j, i, x as c from points where r <= {k}),{",".join(steps)},
digests as (select j, sha256(string_agg(cast(c as varchar), ',' order by i)) as centroid_sha256 from c{rounds} group by j),
inertias as (select j, cast(sum(d) as bigint) as n from a{rounds} group by j)
select vec_id, a.j as cluster, cast(d as bigint) as distance, n as cluster_inertia, cast((select sum(d) from a{rounds}) as bigint) as inertia, centroid_sha256
from a{rounds} a join kept using (r) join digests g on g.j = a.j join inertias s on s.j = a.j
"""


ORACLES = {"op3_substring_dedup": OP3, "op8_decontamination": OP8, "op9_near_duplicates": OP9, "op10_line_dedup": OP10, "op12_conversation_repair": OP12, "op13_centroids": op13()}
