"""Registered queries over batches of several skills."""

from __future__ import annotations

from pyspark.sql import functions as F

from .operators import catalogue, evaluation, runs
from .queries import DAILY, daily, query, table
from .streaming import state

#: the days that a batch may see; what follows is what its forecasts are held against
CUT = "1998-01-01"
CODE = """def forecast(points):
    if sum(qty for _, qty in points) % 2 == 1:
        raise ValueError("odd")
    return [points[-1][1], {"date": points[-1][0] + timedelta(days=9), "qty": 1}]
"""
SKILLS = [
    ("average", "preset", "active", "Moving-Average", '{"window": 14}'),
    ("line", "preset", "active", "linear_trend", None),
    ("again", "expression", "active", "transform(slice(reverse(qty), 1, 3), x -> x * 2)", None),
    ("code", "python", "active", CODE, None),
    ("mean", "expression", "active", "try_divide(aggregate(qty, 0D, (s, x) -> s + x), n)", None),
    ("draft", "preset", "draft", "moving_average", None),
    ("typo", "preset", "active", "mooving average", None),
]
NAMES = ("average", "line", "again", "code", "mean", "draft", "typo", "nobody")

#: each supplier asks for one skill, every 16th for the average too
BATCH = f"""{DAILY}, seen as (select * from daily where ds < '{CUT}'),
asked as (select s_suppkey as series, list_extract({list(NAMES)}, cast(s_suppkey % 8 + 1 as int)) as skill_id from supplier union select s_suppkey, 'average' from supplier where s_suppkey % 16 = 3),
tail as (select *, max(ds) over (partition by series) as last_ds, row_number() over (partition by series order by ds desc) as back from seen),
fit as (select series, max(last_ds) as last_ds, count(*) as n, avg(qty) as mean, coalesce(regr_slope(qty, -back), 0) as slope from tail where back <= 30 group by series),
sums as (select series, max(ds) as last_ds, sum(qty) as s, count(*) as n, arg_max(qty, ds) as last from seen group by series),
points as (
  select a.series, skill_id, cast(last_ds + cast(s as integer) as date) as ds, qty from asked a join (select series, max(last_ds) as last_ds, round(avg(qty), 2) as qty from tail where back <= 14 group by series) using (series), range(1, 15) r(s) where skill_id = 'average'
  union all select series, skill_id, cast(last_ds + cast(s as integer) as date), round(greatest(0, mean + slope * (s + (n - 1) / 2.0)), 2) from asked join fit using (series), range(1, 31) r(s) where skill_id = 'line' and s <= n
  union all select series, skill_id, cast(last_ds + cast(back as integer) as date), 2 * qty from asked join tail using (series) where skill_id = 'again' and back <= 3
  union all select series, skill_id, cast(last_ds + cast(x[1] as integer) as date), x[2] from asked join sums using (series), unnest([[1, last], [9, 1]]) as u(x) where skill_id = 'code' and s % 2 <> 1
  union all select series, skill_id, cast(last_ds + 1 as date), s / n from asked join sums using (series) where skill_id = 'mean'),
results as (
  select series, skill_id, ds, qty, null as error from points
  union all select series, skill_id, null, null, case skill_id when 'draft' then 'the skill is draft, not active' when 'nobody' then 'no such skill' when 'typo' then 'LookupError: ''mooving average'' is no preset, the closest is moving_average'
    when 'code' then case when series in (select series from seen) then 'ValueError: odd' else 'no result' end else 'no result' end
  from asked where (series, skill_id) not in (select (series, skill_id) from points))"""


def batch(spark, d):
    supplier = table(spark, d, "supplier").select(F.col("s_suppkey").alias("series"))
    picked = F.element_at(F.array(*map(F.lit, NAMES)), (F.col("series") % 8 + 1).cast("int"))
    asked = supplier.select("series", picked.alias("skill_id")).unionByName(supplier.filter("series % 16 = 3").select("series", F.lit("average").alias("skill_id")))
    skills = spark.createDataFrame(SKILLS, "skill_id string, skill_type string, status string, body string, params string")
    return runs.run(daily(spark, d).filter(F.col("ds") < CUT), asked, skills)


@query(f"with {BATCH} select * from results")
def mixed_batch(spark, d):
    return batch(spark, d)


@query(f"with {BATCH}, e as (select series, skill_id, count(error) > 0 as failed from results group by all) select skill_id, count(*) filter (not failed) as successes, count(*) filter (failed) as errors, count(*) as total from e group by grouping sets ((skill_id), ())")
def mixed_batch_counts(spark, d):
    return runs.counts(batch(spark, d))


@query(f"""with {BATCH}, e as (select p.series, skill_id, abs(p.qty - a.qty) as e, a.qty as a, abs(p.qty) + abs(a.qty) as s from points p left join daily a on a.series = p.series and a.ds = p.ds)
select series, skill_id, round(avg(e), 4) as mae, round(100 * avg(case when a <> 0 then e / abs(a) end), 4) as mape, round(sqrt(avg(e * e)), 4) as rmse, round(avg(case when a is null then null when s = 0 then 0 else 200 * e / s end), 4) as smape, count(a) as data_points from e group by series, skill_id""")
def mixed_batch_accuracy(spark, d):
    return runs.evaluate(batch(spark, d), daily(spark, d))


@query(f"with {DAILY}, t as (select series, list(qty order by ds) as q, max(ds) as last_ds from daily group by series) select series, cast(last_ds + cast(i as integer) as date) as ds, q[len(q) - 7 + i] + i as qty from t, range(1, 8) r(i) where len(q) - 7 + i > 0")
def trial_expression(spark, d):
    return runs.trial(daily(spark, d), "expression", "transform(slice(qty, greatest(n - 6, 1), 7), (x, i) -> x + i + 1)").select("series", "ds", "qty")


@query(f"""with {DAILY}, monthly as (select series, date_trunc('month', ds)::date as ds, sum(qty) as qty from daily group by 1, 2),
p as (select series, round(stddev_pop(qty), 4) as std, round(avg(qty), 4) as mean, count(*) as n from monthly group by series),
s as (select a.series, sum(sign(b.qty - a.qty)) as s from monthly a join monthly b on b.series = a.series and b.ds > a.ds group by a.series),
z as (select series, n, case when mean > 0 then std / mean else 0 end as cv, round(case when coalesce(s, 0) > 0 then (s - 1) / sqrt(n * (n - 1) * (2 * n + 5) / 18.0) when s < 0 then (s + 1) / sqrt(n * (n - 1) * (2 * n + 5) / 18.0) else 0 end, 4) as z from p left join s using (series)),
x as (select series, qty - avg(qty) over (partition by series) as x, row_number() over (partition by series order by ds) as i, count(*) over (partition by series) as n from monthly),
t as (select series, max(n) as n, sum(x * x) as t from x group by series having max(n) >= 14),
acf as (select t.series, k, round(sum(a.x * b.x) / max(t.t), 3) as acf from t, range(1, 15) r(k), x a, x b where a.series = t.series and b.series = t.series and a.i = b.i + k and k <= t.n // 2 group by t.series, k),
best as (select series, arg_max(k, (acf, -k)) as lag, max(acf) > 0.3 as seasonal from acf group by series)
select z.series, cast(case when cv < 0.2 then least(14, n // 2) when cv < 0.5 then least(7, n // 2) else least(3, greatest(1, n // 3)) end as int) as "window", case when abs(z) > 1.96 then 0.5 else 0.2 end as alpha,
  cast(least(n, case when abs(z) > 1.96 then 30 else 14 end) as int) as trend_window, cast(case when seasonal then lag else 7 end as int) as period, cast(case when seasonal then least(14, n // 2) else 7 end as int) as horizon, case when cv > 0.5 then 1.96 else 1.65 end as z
from z left join best using (series) where n >= 4""")
def suggested_parameters(spark, d):
    m = daily(spark, d).groupBy("series", F.trunc("ds", "MM").alias("ds")).agg(F.sum("qty").alias("qty"))
    found = evaluation.suggested(evaluation.profile(m), evaluation.mann_kendall(m), evaluation.best_lag(evaluation.autocorrelation(m)))
    return found.join(m.groupBy("series").agg(F.count("*").alias("months")).filter("months >= 4"), "series").drop("months")


@query("""with s as (select s_suppkey as k from supplier), v as (select 's' || k as id, k, case when k % 3 = 0 then 2 else 1 end as version, case when k % 3 = 0 then 'reviewed' else 'draft' end as status, 'n' || k as name, k % 2 = 1 as python from s),
c as (select 's' || k as id, k, ['activate', 'archive', 'update', 'rollback', 'review'][k % 5 + 1] as action, 'n' || (k + 1) as name from s),
d as (select c.id as skill_id, v.version + 1 as version, v.status as was, c.action, c.name, python, c.k, exists (select 1 from v o where o.name = c.name) as taken from c join v using (id)),
j as (select skill_id, version, case action when 'activate' then 'active' when 'archive' then 'archived' when 'update' then was when 'rollback' then 'draft' else 'reviewed' end as status, case when action = 'rollback' then 'rollback to 2' else action end as action,
  case when action = 'update' and taken then 'the name is taken' when action = 'rollback' and k % 3 <> 0 then 'no such version' when action = 'review' and not python then 'only Python skills are reviewed' when action = 'activate' and python and was <> 'reviewed' then 'a Python skill is reviewed before it becomes active' end as problem from d),
n as (select 'c' || k as skill_id, 'new' || k % 20 as name from s where k % 10 = 0)
select * from j union all select skill_id, 1, 'draft', 'create', case when skill_id > min(skill_id) over (partition by name) then 'the name is taken' end from n""")
def catalogue_changes(spark, d):
    k = F.col("s_suppkey")
    s = table(spark, d, "supplier").select("s_suppkey")
    text = lambda before, n: F.concat(F.lit(before), n.cast("string"))
    kind, tags = F.when(k % 2 == 1, "python").otherwise("preset"), F.array(F.lit("t"))
    version = lambda n, status: s.select(text("s", k).alias("skill_id"), F.lit(n).alias("version"), text("n", k).alias("name"), kind.alias("skill_type"), F.lit(status).alias("status"), F.lit(CODE).alias("body"), tags.alias("tags"), F.lit("x").alias("action"), k.alias("k"))
    versions = version(1, "draft").unionByName(version(2, "reviewed").filter("k % 3 = 0")).drop("k")
    none = lambda kind: F.lit(None).cast(kind)
    action = F.element_at(F.array(*map(F.lit, ("activate", "archive", "update", "rollback", "review"))), (k % 5 + 1).cast("int"))
    asked = s.select(text("s", k).alias("skill_id"), action.alias("action"), F.when(action == "update", text("n", k + 1)).alias("name"), none("string").alias("skill_type"), none("string").alias("body"), none("array<string>").alias("tags"), F.when(action == "rollback", 2).alias("to_version"))
    created = s.filter(k % 10 == 0).select(text("c", k).alias("skill_id"), F.lit("create").alias("action"), text("new", k % 20).alias("name"), F.lit("preset").alias("skill_type"), F.lit("moving_average").alias("body"), tags.alias("tags"), none("int").alias("to_version"))
    return catalogue.decided(versions, asked.unionByName(created)).select("skill_id", "version", "status", "action", "problem")


#: how users may go from one state to another; a pause of six hours starts anew
STEPS = [("signup", "new", "member"), ("view", "member", "looking"), ("click", "looking", "looking"), ("purchase", "looking", "buyer"), ("error", "buyer", "new"), ("error", "looking", "member")]
LEADS = "case action || ' ' || state " + " ".join(f"when '{a} {s}' then '{t}'" for a, s, t in STEPS) + " end"


@query(f"""with recursive e as (select user_id as key, ts, event_type as action, row_number() over (partition by user_id order by ts, event_type) as i, coalesce(ts - lag(ts) over (partition by user_id order by ts, event_type) >= interval 6 hour, false) as anew from events),
r as (select key, ts, action, i, {LEADS.replace("state", "'new'")} is not null as allowed, coalesce({LEADS.replace("state", "'new'")}, 'new') as state from e where i = 1
  union all select key, ts, action, i, {LEADS} is not null, coalesce({LEADS}, state) from (select e.key, e.ts, e.action, e.i, case when e.anew then 'new' else r.state end as state from r join e on e.key = r.key and e.i = r.i + 1))
select key, ts, action, allowed, state from r""")
def user_states(spark, d):
    events = table(spark, d, "events").select(F.col("user_id").alias("key"), "ts", F.col("event_type").alias("action"))
    return state.machine_batch(events, STEPS, "new", 6 * 3_600_000).withColumn("ts", F.col("ts").cast("timestamp_ntz"))


@query("select conv_id, turn, count(*) over w as kept, first_value(turn) over w as oldest, cast(sum(length(coalesce(text, ''))) over w as bigint) as letters from conversations window w as (partition by conv_id order by turn rows 3 preceding)")
def newest_turns(spark, d):
    return state.last_turns_batch(table(spark, d, "conversations"), most=4)
