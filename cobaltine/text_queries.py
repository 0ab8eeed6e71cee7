"""Registered queries over texts, names and paths, sheets with a header, presets, and the streams' operators on finished tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from .functions import formula
from .more_queries import W, supplier_sheet
from .operators import catalogue, likeness, markdown, presets, reporting, sheets, texts
from .queries import DAILY, HEADED, TAIL, daily, headed, monthly, query, table
from .streaming import windows

# texts


@query(r"""with t as (select p_partkey as id, case when p_partkey % 9 = 0 then '!?' else ' ' || p_name || ' (' || p_brand || ') -  ' || p_type || '?' end as text from part),
a as (select id, regexp_replace(regexp_replace(regexp_replace(lower(trim(text)), '[^a-z0-9_ -]+', '', 'g'), '[ -]+', '-', 'g'), '^-|-$', '', 'g') as anchor from t) select id, case when anchor = '' then 'section' else anchor end as anchor from a""")
def heading_anchors(spark, d):
    title = F.concat(F.lit(" "), F.col("p_name"), F.lit(" ("), F.col("p_brand"), F.lit(") -  "), F.col("p_type"), F.lit("?"))
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), texts.anchor(F.when(F.col("p_partkey") % 9 == 0, "!?").otherwise(title)).alias("anchor"))


REPLY = "case event_id % 5 when 0 then props when 1 then 'Here: ```json' || chr(10) || props || chr(10) || '``` as asked' when 2 then 'It is ' || props || '.' when 3 then 'none {here' else '```' || props || '``` or {' end"


@query(f"""with r as (select event_id, {REPLY} as t from events), c as (select *, regexp_extract(t, '```(?:json)?\\s*(\\{{.*?\\}})\\s*```', 1, 's') as f, regexp_extract(t, '\\{{.*\\}}', 0, 's') as b from r)
select event_id, case when json_valid(t) then t when f <> '' and json_valid(f) then f when b <> '' and json_valid(b) then b end as found from c""")
def json_in_replies(spark, d):
    p, k = F.col("props"), F.col("event_id") % 5
    reply = F.when(k == 0, p).when(k == 1, F.concat(F.lit("Here: ```json\n"), p, F.lit("\n``` as asked"))).when(k == 2, F.concat(F.lit("It is "), p, F.lit(".")))
    reply = reply.when(k == 3, "none {here").otherwise(F.concat(F.lit("```"), p, F.lit("``` or {")))
    return table(spark, d, "events").select("event_id", texts.json_object(reply).alias("found"))


@query(f"with h as ({HEADED}), s as (select id, string_split(text, chr(10)) as t from h) select id, '- ' || t[1][3:] || chr(10) || '  - ' || t[4][4:] as outline from s")
def heading_outline(spark, d):
    return texts.outline(headed(spark, d), "id", "text")


@query("""with v as (select p_partkey as id, p_name || chr(10) || p_brand || ' ' || p_type as page, case p_partkey % 5 when 0 then p_type when 1 then upper(replace(p_name, ' ', '  ')) when 2 then lower(p_brand) || chr(10) || p_name when 3 then 'x' || p_brand else 'zzzzzzzzzzzz' end as value from part),
s as (select *, regexp_replace(lower(value), '\\s', '', 'g') as fv, regexp_replace(lower(page), '\\s', '', 'g') as fp, list_filter(regexp_split_to_array(page, '\\s+'), lambda w: length(w) > 1) as words from v),
m as (select *, case when contains(page, value) then 'exact' when contains(fp, fv) then 'normalized' when contains(value, chr(10)) then 'lines' when list_max(list_transform(words, lambda w: 100 * (1 - levenshtein(lower(w), fv) / greatest(length(w), length(fv))))) >= 75 then 'fuzzy' else 'missing' end as status from s)
select id, status, case when status = 'lines' then replace(value, chr(10), ' ') when status = 'fuzzy' then list_sort(list_transform(words, lambda w: {'d': levenshtein(lower(w), fv) / greatest(length(w), length(fv)), 'w': w}))[1].w else value end as text from m""")
def values_on_pages(spark, d):
    name, brand, kind, k = F.col("p_name"), F.col("p_brand"), F.col("p_type"), F.col("p_partkey") % 5
    value = F.when(k == 0, kind).when(k == 1, F.upper(F.replace(name, F.lit(" "), F.lit("  ")))).when(k == 2, F.concat(F.lower(brand), F.lit("\n"), name)).when(k == 3, F.concat(F.lit("x"), brand)).otherwise("zzzzzzzzzzzz")
    page = F.concat(name, F.lit("\n"), brand, F.lit(" "), kind)
    return texts.backed(table(spark, d, "part").select(F.col("p_partkey").alias("id"), value.alias("value"), page.alias("page")))


@query("""with n as (select o_orderkey as id, case o_orderkey % 5 when 0 then 'AB_FCST_' || strftime(o_orderdate + interval 30 year, '%Y-%m') || '.xlsx' when 1 then 'plan ' || year(o_orderdate + interval 30 year) || '年' || month(o_orderdate) || '月.xlsx' when 2 then 'FCSTX ' || strftime(o_orderdate + interval 30 year, '%Y%m') || '1.xlsx' when 3 then strftime(o_orderdate + interval 30 year, '%Y/%m') else 'no date FCST' end as name from orders),
p as (select *, regexp_extract(name, '(20\\d{2})[-_/年]?(0?[1-9]|1[0-2])(?:[-_/月]|[^A-Za-z0-9]|$)', ['y', 'm']) as x from n)
select id, case when x.y <> '' then x.y || '-' || lpad(x.m, 2, '0') end as period, regexp_matches(name, '(^|[^A-Za-z0-9])FCST([^A-Za-z0-9]|$)') as is_forecast from p""")
def file_names(spark, d):
    day, k = F.add_months("o_orderdate", 360), F.col("o_orderkey") % 5
    shown = lambda f: F.date_format(day, f)
    name = F.when(k == 0, F.concat(F.lit("AB_FCST_"), shown("yyyy-MM"), F.lit(".xlsx"))).when(k == 1, F.concat(F.lit("plan "), shown("yyyy年M月"), F.lit(".xlsx")))
    name = name.when(k == 2, F.concat(F.lit("FCSTX "), shown("yyyyMM"), F.lit("1.xlsx"))).when(k == 3, shown("yyyy/MM")).otherwise("no date FCST")
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), texts.period_of(name).alias("period"), texts.names_token(name, "FCST").alias("is_forecast"))


@query("""with b as (select p_partkey as id, p_partkey % 6 as k, lower(replace(p_brand, '#', '-')) as b from part)
select id, case k when 3 then 'project-overview' when 4 then 'brand' when 5 then 'misc' else b end as module, case when k = 0 then 'doc' else 'meta' end as kind from b where k <> 2
union all select id, 'brand', 'meta' from b where k = 2""")
def page_kinds(spark, d):
    b, k = F.lower(F.replace(F.col("p_brand"), F.lit("#"), F.lit("-"))), F.col("p_partkey") % 6
    path = F.when(k == 0, F.concat(F.lit("doc/"), b, F.lit("-doc.md"))).when(k == 1, F.concat(F.lit("table/"), b, F.lit(".md"))).when(k == 2, F.concat(F.lit("doc/"), b, F.lit(".md")))
    path = path.when(k == 3, "project-overview.md").when(k == 4, F.concat(F.lit("x/"), b, F.lit(".v1.md"))).otherwise("-a.md")
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), texts.page_kind(path).alias("x")).select("id", "x.module", "x.kind")


#: longest common subsequence of a and b (under 60 letters): a bit a letter of a, and one step a letter of b
LCS = """length(a) - bit_count(list_reduce(list_concat([(1::bigint << length(a)) - 1], list_transform(string_split(b, ''), lambda c: cast(list_sum(list_transform(range(1, length(a) + 1), lambda i: case when a[i] = c then 1::bigint << (i - 1) else 0 end)) as bigint))),
  lambda v, m: ((v + (v & m)) | (v & ~m)) & ((1::bigint << length(a)) - 1)))"""


@query(f"""with t as (select p_partkey as id, left(p_type, 4) || substr(p_type, 6) as value, unnest([p_type, reverse(p_type), upper(replace(p_type, 'A', 'o')), right(p_type, 6) || left(p_type, length(p_type) - 6), left(p_type, length(p_type) - 2)]) as choice, unnest(range(1, 6)) as i from part),
s as (select *, regexp_replace(lower(value), '\\s', '', 'g') as a, regexp_replace(lower(choice), '\\s', '', 'g') as b from t), r as (select *, 200.0::double * ({LCS}) / (length(a) + length(b)) as score from s),
best as (select id, value, arg_max(choice, (score, -abs(length(a) - length(b)), -i)) filter (score >= 75) as text, max(score) filter (score >= 75) as score from r group by id, value) select id, value, text, round(score, 6) as score from best""")
def most_like_types(spark, d):
    kind, n = F.col("p_type"), F.length("p_type")
    value = F.concat(F.left(kind, F.lit(4)), F.substr(kind, F.lit(6)))
    choices = F.array(kind, F.reverse(kind), F.upper(F.replace(kind, F.lit("A"), F.lit("o"))), F.concat(F.right(kind, F.lit(6)), F.left(kind, n - 6)), F.left(kind, n - 2))
    found = table(spark, d, "part").select(F.col("p_partkey").alias("id"), value.alias("value"), likeness.most_like(value, choices).alias("x"))
    return found.select("id", "value", "x.text", F.round("x.score", 6).alias("score"))


@query(f"""with n as (select distinct p_name || ' ' || p_brand as text from part), v as (select distinct left(c, 3) || substr(c, 5) as value from (select p_name || ' ' || p_brand as c from part where p_partkey % 50 = 0)),
p as (select value, text, regexp_replace(lower(value), '\\s', '', 'g') as a, regexp_replace(lower(text), '\\s', '', 'g') as b from v, n), s as (select *, 200.0::double * ({LCS}) / (length(a) + length(b)) as score from p)
select value, arg_max(text, (score, -abs(length(text) - length(value)), text)) as text, round(max(score), 6) as score from s where score >= 75 group by value""")
def alike_names(spark, d):
    parts = table(spark, d, "part").select("p_partkey", F.concat_ws(" ", "p_name", "p_brand").alias("text"))
    c = F.col("text")
    values = parts.filter("p_partkey % 50 = 0").select(F.concat(F.left(c, F.lit(3)), F.substr(c, F.lit(5))).alias("value"))
    return likeness.alike(values, parts).withColumn("score", F.round("score", 6))


def notes(spark, d):
    """Parts described in markdown of four forms: ranks skipped, nested, without a heading, with code and a table."""
    t = lambda *x: F.concat_ws("\n", *[F.lit(v) if isinstance(v, str) else v for v in x])
    name, kind, k = F.col("p_name"), F.col("p_type"), F.col("p_partkey") % 4
    deep = t("before", F.concat(F.lit("## "), name), "a", F.concat(F.lit("#### "), kind), "b", "### c", "## d", "e")
    nested = t(F.concat(F.lit("# "), name), F.concat(F.lit("## "), kind), "x", "### y", "# z")
    coded = t(F.concat(F.lit("# "), name), "```sql", F.concat(F.lit("# "), kind), "", "```", "| a | b |", "|---|---|", "| 1 | 2 |", "| 3 | 4 |", "~~~", "rest")
    text = F.when(k == 0, deep).when(k == 1, nested).when(k == 2, F.concat(F.lit(" only "), name)).otherwise(coded)
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), text.alias("text"))


def node(section: str, level: int, title: str, body: str, *children: str) -> str:
    """A node of a tree as a DuckDB expression of its JSON text; ``title`` and ``body`` are expressions."""
    inner = " || ',' || ".join(children) or "''"
    return f"""'{{"section":{section},"level":{level},"title":' || to_json({title}) || ',"body":' || to_json({body}) || ',"children":[' || {inner} || ']}}'"""


CODED = "'```sql' || chr(10) || '# ' || p_type || chr(10) || chr(10) || '```' || chr(10) || '| a | b |' || chr(10) || '|---|---|' || chr(10) || '| 1 | 2 |' || chr(10) || '| 3 | 4 |' || chr(10) || '~~~' || chr(10) || 'rest'"


@query(f"""select p_partkey as id, case p_partkey % 4 when 2 then '' else p_name end as title, case p_partkey % 4 when 0 then 'before' when 2 then 'only ' || p_name else '' end as summary,
case p_partkey % 4 when 0 then '[' || {node("1", 2, "p_name", "'a'", node("2", 4, "p_type", "'b'"), node("3", 3, "'c'", "''"))} || ',' || {node("4", 2, "'d'", "'e'")} || ']'
  when 1 then '[' || {node("1", 1, "p_name", "''", node("2", 2, "p_type", "'x'", node("3", 3, "'y'", "''")))} || ',' || {node("4", 1, "'z'", "''")} || ']'
  when 2 then '[]' else '[' || {node("1", 1, "p_name", CODED)} || ']' end as sections from part""")
def section_tree(spark, d):
    return markdown.trees(markdown.sections(notes(spark, d), "id", "text"), "id")


@query("""select p_partkey as id, 1 as section, 1 as line, 'sql' as language, '# ' || p_type || chr(10) as content from part where p_partkey % 4 = 3
union all select p_partkey, 1, 9, '', 'rest' from part where p_partkey % 4 = 3""")
def code_in_notes(spark, d):
    return markdown.code_blocks(notes(spark, d), "id", "text")


@query("""select p_partkey as id, case k when 2 then '' else p_name end as title, [4, 4, 0, 1][k + 1]::bigint as section_count, [5, 4, 1, 3][k + 1]::bigint as chunk_count, [0, 0, 0, 2][k + 1]::bigint as table_rows, [0, 0, 0, 2][k + 1]::bigint as code_blocks from (select *, p_partkey % 4 as k from part)""")
def notes_index(spark, d):
    return markdown.index(notes(spark, d), "id", "text")


# sheets, presets, skills, turns


@query(f"with {W} select 's' as sheet, cast(k + 3 as integer) as row, case when k % 10 <> 3 then ' ' || s_name end as name, s_nationkey || '.0' as nation from w")
def sheet_rows(spark, d):
    return sheets.headed(supplier_sheet(spark, d), 2, {"part": "name", "nation": "nation"})


@query("select s_suppkey as series, 'missing' as side from supplier where s_suppkey % 3 = 0 and s_suppkey not in (select l_suppkey from lineitem where l_quantity > 49 and l_returnflag = 'R') union all select distinct l_suppkey, 'extra' from lineitem where l_quantity > 49 and l_returnflag = 'R' and l_suppkey % 3 <> 0")
def plan_gaps(spark, d):
    asked = table(spark, d, "supplier").filter("s_suppkey % 3 = 0").select(F.col("s_suppkey").alias("series"))
    return sheets.set_gaps(asked, table(spark, d, "lineitem").filter("l_quantity > 49 and l_returnflag = 'R'").select(F.col("l_suppkey").alias("series")), "series")


@query(f"with {DAILY}, {TAIL.format(n=14)}, level as (select series, max(ds) as last_ds, round(avg(qty), 2) as qty from tail group by series) select series, cast(last_ds + cast(s as integer) as date) as ds, qty from level, range(1, 15) r(s)")
def preset_by_name(spark, d):
    return presets.forecast(daily(spark, d), " Moving-Average ", window=14)


UNEVEN = """def forecast(points):
    if sum(qty for _, qty in points) % 2 == 1:
        raise ValueError("odd")
    return [0.0, 1.0]
"""


@query(f"with {DAILY}, s as (select series, sum(qty) % 2 = 1 as odd from daily group by series) select count(*) filter (where not odd) as successes, count(*) filter (where odd) as errors from s")
def skill_batch(spark, d):
    return reporting.batch_counts(catalogue.run_python(daily(spark, d), UNEVEN))


@query("select conv_id, turn, role, text from conversations where role in ('user', 'assistant') and trim(text) <> ''")
def shown_turns(spark, d):
    return reporting.shown_turns(table(spark, d, "conversations")).select("conv_id", "turn", "role", "text")


@query(f"""with recursive {DAILY}, m as (select series, sum(qty) as q, row_number() over (partition by series order by date_trunc('month', ds)) as i from daily group by series, date_trunc('month', ds)),
r as (select series, i, round(greatest(0, q - 550), 2) as net, greatest(0, 550 - q) as stock from m where i = 1 union all select m.series, m.i, round(greatest(0, q - 500 - stock), 2), greatest(0, stock + 500 - q) from r join m on m.series = r.series and m.i = r.i + 1)
select series, round(sum(net), 2) as short, round(max(net), 2) as most from r group by series""")
def blended_demand(spark, d):
    q = F.transform(F.sort_array(F.collect_list(F.struct("ds", "qty"))), lambda x: x["qty"])  # months: bounded by the calendar
    arrays = monthly(spark, d).groupBy("series").agg(q.alias("q"))
    net = formula.blended_demand(F.col("q"), F.lit(50.0), F.transform("q", lambda _: F.lit(500.0)))
    return arrays.select("series", F.round(formula.total(net), 2).alias("short"), F.array_max(net).alias("most"))


# the streams' operators on a finished table


@query("select date_trunc('hour', ts) as start, event_type, count(*) as n, round(sum(value), 2) as total from events group by all")
def events_by_hour(spark, d):
    found = windows.tumbling(table(spark, d, "events"))
    return found.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 2).alias("total"))


@query("""with e as (select user_id, ts, case when ts < lag(ts) over (partition by user_id order by ts) + interval 1 hour then 0 else 1 end as new from events),
s as (select *, sum(new) over (partition by user_id order by ts rows unbounded preceding) as k from e) select user_id, min(ts) as start, max(ts) + interval 1 hour as "end", count(*) as n from s group by user_id, k""")
def user_sessions(spark, d):
    return windows.sessions(table(spark, d, "events")).withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("start", "end")})
