"""The registered queries and the same results in DuckDB SQL.

The test tables stand in for the business ones: a supplier is a series and its shipped
quantity per day the demand; return flags N, R and A play demand, fixed calls and
deliveries; the customer's market segment is the channel, order status F paid and O open.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import formula
from .operators import catalogue, evaluation, lookup, markdown, models, reporting, retrieval, series, sheets
from .sources.shared import written

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

DAILY = "daily as (select l_suppkey as series, cast(l_shipdate as date) as ds, sum(l_quantity) as qty from lineitem group by 1, 2)"
PARTS = """moves as (select l_suppkey as series, cast(l_shipdate as date) as ds,
  sum(case when l_returnflag = 'N' then l_quantity else 0 end) as demand, sum(case when l_returnflag <> 'N' then l_quantity else 0 end) as supply,
  sum(case when l_returnflag = 'R' then l_quantity else 0 end) as jit, sum(case when l_returnflag = 'A' then l_quantity else 0 end) as pgi from lineitem group by 1, 2)"""


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def daily(spark: SparkSession, d: str) -> DataFrame:
    return series.demand_series(table(spark, d, "lineitem"), "l_suppkey", "l_shipdate", "l_quantity")


def moves(spark: SparkSession, d: str) -> DataFrame:
    of = lambda flags, name: F.sum(F.when(F.col("l_returnflag").isin(*flags), F.col("l_quantity")).otherwise(0.0)).alias(name)
    rows = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("series"), F.to_date("l_shipdate").alias("ds"), "l_returnflag", "l_quantity")
    return series.dealt(rows, "series", "ds").groupBy("series", "ds").agg(of("N", "demand"), of("AR", "supply"), of("R", "jit"), of("A", "pgi"))


def rounded(df: DataFrame, *columns: str, digits: int = 4) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})


@query(f"with {DAILY} select * from daily")
def daily_demand(spark, d):
    return daily(spark, d)


@query(f"with {DAILY} select series, ds, qty, round(avg(qty) over (partition by series order by ds rows 6 preceding), 4) as value from daily")
def moving_average_7(spark, d):
    return rounded(series.moving_average(daily(spark, d), 7), "value")


@query(f"with {DAILY} select series, ds, qty, sum(qty) over (partition by series order by ds rows unbounded preceding) as value from daily")
def cumulative_sum(spark, d):
    return series.cumulative_sum(daily(spark, d))


@query(f"with {DAILY} select series, ds, qty, lag(qty, 1, 0) over (partition by series order by ds) as value from daily")
def shift_1(spark, d):
    return series.lagged(daily(spark, d), 1)


@query(f"with {DAILY} select series, max(ds) as last_ds, round(list_reduce(list(qty order by ds), lambda a, x: 0.3::double * x + 0.7::double * a), 4) as value from daily group by series")
def smoothed_level(spark, d):
    return rounded(series.smoothed(daily(spark, d), 0.3), "value")


TAIL = "tail as (select *, count(*) over (partition by series) as n from (select *, row_number() over (partition by series order by ds desc) as back from daily) where back <= {n})"


@query(f"with {DAILY}, {TAIL.format(n=7)}, level as (select series, max(ds) as last_ds, round(avg(qty), 2) as qty from tail group by series) select series, cast(last_ds + cast(s as integer) as date) as ds, qty from level, range(1, 8) r(s)")
def moving_average_forecast(spark, d):
    return series.flat_average_forecast(daily(spark, d), 7)


@query(f"with {DAILY}, level as (select series, max(ds) as last_ds, round(list_reduce(list(qty order by ds), lambda a, x: 0.3::double * x + 0.7::double * a), 2) as qty from daily group by series) select series, cast(last_ds + cast(s as integer) as date) as ds, qty from level, range(1, 8) r(s)")
def smoothing_forecast(spark, d):
    return series.flat_smoothing_forecast(daily(spark, d))


@query(f"""with {DAILY}, {TAIL.format(n=30)},
fit as (select series, max(ds) as last_ds, max(n) as n, avg(qty) as m, coalesce(regr_slope(qty, n - back), 0) as slope from tail group by series)
select series, cast(last_ds + cast(s as integer) as date) as ds, round(greatest(0, m + slope * (s + (n - 1) / 2.0)), 2) as qty from fit, range(1, 31) r(s) where s <= least(n, 30)""")
def trend_forecast(spark, d):
    return series.trend_forecast(daily(spark, d))


@query(f"""with {DAILY}, placed as (select *, row_number() over (partition by series order by ds) - 1 as i, count(*) over (partition by series) as n, avg(qty) over (partition by series) as m from daily)
select series, cast(i % 7 as integer) as position, round(case when max(m) = 0 then 1.0 else avg(qty) / max(m) end, 4) as value from placed where i < n // 7 * 7 group by series, i % 7""")
def seasonal_index_7(spark, d):
    return rounded(series.seasonal_index(daily(spark, d), 7), "value").withColumn("position", F.col("position").cast("int"))


@query(f"with {PARTS} select series, ds, demand, supply, 100 + sum(supply - demand) over (partition by series order by ds rows unbounded preceding) as balance from moves")
def running_balance(spark, d):
    return series.running_balance(moves(spark, d).drop("jit", "pgi"), 100.0)


@query(f"""with recursive {PARTS}, o as (select *, row_number() over (partition by series order by ds) as i from moves),
r as (select series, ds, demand, supply, i, 100 + supply - demand as raw, greatest(0, 100 + supply - demand) as stock from o where i = 1
  union all select o.series, o.ds, o.demand, o.supply, o.i, stock + o.supply - o.demand, greatest(0, stock + o.supply - o.demand) from r join o on o.series = r.series and o.i = r.i + 1)
select series, ds, demand, supply, stock, raw, greatest(0, -raw) as net from r""")
def clamped_balance(spark, d):
    return series.clamped_balance(moves(spark, d).drop("jit", "pgi"), 100.0)


@query(f"""with {DAILY}, {TAIL.format(n=30)},
level as (select series, max(ds) as last_ds, max(n) as n, avg(qty) as m, stddev_pop(qty) as sd from tail group by series),
days as (select *, greatest(0, 50 - m * (s - 1)) as stock from level, range(1, 31) r(s) where s <= least(n, 30))
select series, cast(last_ds + cast(s as integer) as date) as ds, round(greatest(0, m + 1.65::double * sd - stock), 2) as qty, round(greatest(0, stock - m), 2) as inventory from days""")
def safety_stock_plan(spark, d):
    return series.safety_stock_plan(daily(spark, d), begin=50.0)


#: the first 30 deliveries of each series, by date, play the ones on their way; the SQL is the reference's loop
DELIVERED = """with recursive {parts}, {daily}, {tail}, level as (select series, max(ds) as last_ds, max(n) as n, avg(qty) as m, stddev_pop(qty) as sd from tail group by series),
arriving as (select series, row_number() over (partition by series order by ds) as s, pgi from moves where pgi > 0),
days as (select l.*, s, coalesce(pgi, 0) as p from level l cross join range(1, 31) r(s) left join arriving a using (series, s) where s <= least(n, 30)),
plan as (select series, 0 as s, 50::double as inv, null::double as ship from level
  union all select d.series, d.s, greatest(0, inv + p - m), greatest(0, m + {z}::double * sd - inv - p) from plan join days d on d.series = plan.series and d.s = plan.s + 1)
select series, cast(last_ds + cast(s as integer) as date) as ds, round(ship, 2) as qty, round(inv, 2) as inventory from plan join level using (series) where s > 0"""


def on_their_way(spark, d):
    step = F.row_number().over(series.in_order())
    return moves(spark, d).filter("pgi > 0").select("series", step.alias("step"), F.col("pgi").alias("qty")).filter("step <= 30")


@query(DELIVERED.format(parts=PARTS, daily=DAILY, tail=TAIL.format(n=30), z=1.65))
def safety_stock_plan_delivered(spark, d):
    return series.safety_stock_plan(daily(spark, d), begin=50.0, deliveries=on_their_way(spark, d))


@query(DELIVERED.format(parts=PARTS, daily=DAILY, tail=TAIL.format(n=30), z=1.6448536269514722))
def inventory_optimization_delivered(spark, d):
    return series.inventory_optimization(daily(spark, d), begin=50.0, deliveries=on_their_way(spark, d))


JIT = """with {parts}, placed as (select *, isoyear(ds) as y, week(ds) as w, case when jit > 0 then jit else demand end as fixed from moves),
weeks as (select series, count(distinct (y, w)) as weeks, sum(demand + jit + pgi) as total from placed group by series),
filled as (select p.*, {weekly} - sum(pgi) over k - sum(fixed) over k as rest, sum(case when jit > 0 then 0 else 1 end) over k as free from placed p join weeks using (series) window k as (partition by series, y, w))
select series, ds, round(greatest(0, fixed + case when jit <= 0 and rest > 0 then rest / free else 0 end), 2) as qty from filled"""


def jit_inputs(spark, d):
    days = moves(spark, d).select("series", "ds", "demand", "jit", "pgi")
    return days, days.groupBy("series").agg(F.sum(F.col("demand") + F.col("jit") + F.col("pgi")).alias("total"))


@query(JIT.format(parts=PARTS, weekly="total / weeks"))
def jit_priority_fill(spark, d):
    return series.jit_priority_fill(*jit_inputs(spark, d), divide_by_weeks=True)


@query(JIT.format(parts=PARTS, weekly="total"))
def jit_priority_fill_undivided(spark, d):
    return series.jit_priority_fill(*jit_inputs(spark, d), divide_by_weeks=False)


@query(f"""with {PARTS}, demand as (select series, ds, demand as qty from moves where demand > 0 and day(ds) <= 20),
monthly as (select series, date_trunc('month', ds)::date as month, sum(demand) as forecast from moves group by 1, 2 having sum(demand) > 0),
known as (select series, date_trunc('month', ds)::date as month, sum(qty) as known, count(*) as days from demand group by 1, 2),
fills as (select m.series, m.month, case when day(last_day(m.month)) - coalesce(days, 0) > 0 then (forecast - coalesce(known, 0)) / (day(last_day(m.month)) - coalesce(days, 0)) else 0 end as fill from monthly m left join known k on k.series = m.series and k.month = m.month),
span as (select m.series, least(min(m.month), min(f.first)) as a, last_day(max(m.month)) as b from monthly m left join (select series, min(ds) as first from demand group by series) f on f.series = m.series group by m.series),
calendar as (select series, unnest(generate_series(a::timestamp, b::timestamp, interval 1 day))::date as ds from span),
days as (select c.series, c.ds, coalesce(e.qty, f.fill, 0) as demand, coalesce(s.supply, 0) as supply from calendar c left join demand e on e.series = c.series and e.ds = c.ds
  left join fills f on f.series = c.series and f.month = date_trunc('month', c.ds)::date left join moves s on s.series = c.series and s.ds = c.ds),
summed as (select *, 100 + sum(supply - demand) over (partition by series order by ds rows unbounded preceding) as w from days),
low as (select *, w - least(0, min(w) over (partition by series order by ds rows unbounded preceding)) as stock from summed),
raw as (select *, coalesce(lag(stock) over (partition by series order by ds), 100) + supply - demand as raw from low)
select series, ds, round(greatest(0, -raw), 6) as qty, round(raw, 6) as balance from raw""")
def monthly_daily_blend(spark, d):
    all_moves = written(moves(spark, d), "moves")
    demand = all_moves.filter((F.col("demand") > 0) & (F.day("ds") <= 20)).select("series", "ds", F.col("demand").alias("qty"))
    monthly = all_moves.groupBy("series", F.trunc("ds", "MM").alias("month")).agg(F.sum("demand").alias("forecast")).filter("forecast > 0")
    return series.monthly_daily_blend(demand, monthly, all_moves.select("series", "ds", F.col("supply").alias("qty")), 100.0, digits=6)


@query(f"""with {PARTS}, monthly as (select series, date_trunc('month', ds)::date as month, sum(demand) as forecast from moves group by 1, 2),
first as (select series, min(month) as month, arg_min(forecast, month) as forecast from monthly group by series), delivered as (select series, sum(pgi) as qty from moves where year(ds) < 1993 group by series)
select f.series, cast(month + interval 1 month as date) as month, round(greatest(0, forecast - coalesce(qty, 0)), 2) as qty from first f left join delivered d on d.series = f.series""")
def monthly_split(spark, d):
    m = moves(spark, d)
    monthly = m.groupBy("series", F.trunc("ds", "MM").alias("month")).agg(F.sum("demand").alias("forecast"))
    return series.monthly_split(monthly, m.filter(F.year("ds") < 1993).groupBy("series").agg(F.sum("pgi").alias("qty")))


@query(f"""with {DAILY} select series, 'daily' as type, strftime(ds, '%Y%m%d') as period, sum(qty) as qty from daily group by 1, 3
union all select series, 'monthly', strftime(ds, '%Y%m'), sum(qty) from daily group by 1, 3""")
def daily_monthly_rollup(spark, d):
    return series.daily_monthly_rollup(daily(spark, d))


@query("""with merged as (select l_linenumber, l_suppkey, l_partkey, cast(l_shipdate as date) as ds, sum(l_quantity) as qty from lineitem where month(l_shipdate) <= 6 group by all having sum(l_quantity) > 0),
days as (select strftime(ds, '%Y%m%d') as period, sum(qty) as qty, 'daily' as type from merged group by ds)
select * from days union all select strftime(l_shipdate, '%Y%m'), sum(l_quantity), 'monthly' from lineitem where strftime(l_shipdate, '%Y%m') not in (select substr(period, 1, 6) from days) group by 1""")
def row_merge_freeze(spark, d):
    rows = table(spark, d, "lineitem").select(F.col("l_linenumber").alias("site"), F.col("l_suppkey").alias("vendor"), F.col("l_partkey").alias("part"), F.to_date("l_shipdate").alias("ds"), F.col("l_quantity").alias("qty"))
    monthly = rows.select(F.date_format("ds", "yyyyMM").alias("month"), "qty")
    return series.row_merge_freeze(rows.filter(F.month("ds") <= 6), monthly)


#: from the rule: where the last of all orders is on or past the Sunday, days are their orders and nothing is spread
@query(f"""with {PARTS}, o as (select series, ds, demand as qty from moves where demand > 0), totals as (select series, sum(demand) / 100 as forecast, sum(pgi) / 50 as delivered from moves group by series),
p as (select series, date_trunc('week', min(ds))::date as a, cast(date_trunc('week', min(ds))::date + 6 as date) as b, max(ds) as last, sum(qty) as n from o group by series), days as (select *, cast(a + cast(i as integer) as date) as ds from p join totals using (series), range(0, 7) r(i))
select d.series, d.ds, round(case when last < b and d.ds = b then forecast - delivered - n else coalesce(qty, 0) end, 2) as qty, case when last >= b then 'daily_order' when d.ds = b then 'spread' when qty is not null then 'daily_order' else 'empty' end as type
from days d left join o on o.series = d.series and o.ds = d.ds""")
def order_gap_blend(spark, d):
    m = moves(spark, d)
    totals = m.groupBy("series").agg((F.sum("demand") / 100).alias("forecast"), (F.sum("pgi") / 50).alias("delivered"))
    return series.order_gap_blend(m.filter("demand > 0").select("series", "ds", F.col("demand").alias("qty")), totals)


#: from the rule: series 0 to 39 (mod 40) have their orders of so many days and one, so that some periods are covered and some are not
GAP = """with {parts}, all_orders as (select series, ds, demand as qty from moves where demand > 0), firsts as (select series, min(ds) as f from all_orders group by series),
o as (select a.* from all_orders a join firsts using (series) where ds <= f + cast(series % 40 as integer)), totals as (select series, sum(demand) / 100 as forecast, sum(pgi) / 50 as delivered from moves group by series),
p as (select series, {start} as a, {end} as b, last, n, forecast, delivered from (select series, min(ds) as f, max(ds) as last, sum(qty) as n from o group by series) join totals using (series)),
days as (select *, unnest(generate_series(a::timestamp, b::timestamp, interval 1 day))::date as ds from p)
select d.series, d.ds, round(case when last >= b then coalesce(qty, 0) {spread} else coalesce(qty, 0) end, 2) as qty,
case when last >= b then 'daily_order' when d.ds >= {since} then 'spread' when qty is not null then 'daily_order' else 'empty' end as type from days d left join o on o.series = d.series and o.ds = d.ds"""


def gap_inputs(spark, d):
    m = moves(spark, d)
    orders = m.filter("demand > 0").select("series", "ds", F.col("demand").alias("qty"))
    first = orders.groupBy("series").agg(F.min("ds").alias("first"))
    some = orders.join(first, "series").filter(F.datediff("ds", "first") <= F.col("series") % 40).drop("first")
    return some, m.groupBy("series").agg((F.sum("demand") / 100).alias("forecast"), (F.sum("pgi") / 50).alias("delivered"))


@query(GAP.format(parts=PARTS, start="date_trunc('week', f)::date", end="cast(date_trunc('week', f)::date + 6 as date)", since="b", spread="when d.ds = b then forecast - delivered - n"))
def order_gap_blend_by_week(spark, d):
    return series.order_gap_blend(*gap_inputs(spark, d))


@query(GAP.format(parts=PARTS, start="f", end="last_day(f)", since="last", spread="when d.ds >= last then forecast / (b - last + 1)"))
def order_gap_blend_by_month(spark, d):
    return series.order_gap_blend(*gap_inputs(spark, d), monthly=True)


@query("""select p_brand as part, date_trunc('month', o_orderdate)::date as month, round(sum(l_quantity * (1 - l_discount) * 2), 2) as qty
from lineitem join orders on o_orderkey = l_orderkey join part on p_partkey = l_partkey group by 1, 2""")
def topdown_by_bom(spark, d):
    lines = table(spark, d, "lineitem").join(table(spark, d, "orders"), F.col("o_orderkey") == F.col("l_orderkey"))
    volumes = lines.select(F.col("l_partkey").alias("vehicle"), F.trunc("o_orderdate", "MM").alias("month"), F.col("l_quantity").alias("volume"), (1 - F.col("l_discount")).alias("take_rate"))
    bom = table(spark, d, "part").select(F.col("p_partkey").alias("vehicle"), F.col("p_brand").alias("part"), F.lit(2.0).alias("usage"))
    return rounded(series.topdown_by_bom(volumes, bom), "qty", digits=2)


@query(f"""with {PARTS}, e as (select series, abs(supply - demand) as e, demand as a, supply + demand as s from moves)
select series, round(avg(e), 4) as mae, round(100 * avg(case when a <> 0 then e / a end), 4) as mape, round(sqrt(avg(e * e)), 4) as rmse, round(avg(case when s = 0 then 0 else 200 * e / s end), 4) as smape, count(a) as data_points from e group by series""")
def accuracy(spark, d):
    m = moves(spark, d)
    return evaluation.accuracy(m.select("series", "ds", F.col("supply").alias("qty")), m.select("series", "ds", F.col("demand").alias("qty")))


@query(f"""with {DAILY} select series, round(avg(qty), 4) as mean, round(stddev_pop(qty), 4) as std, round(stddev_pop(qty) / avg(qty), 4) as cv, min(qty) as min, max(qty) as max, sum(qty) as total,
count(*) filter (where qty = 0) as zero_days, count(*) filter (where qty <> 0) as nonzero_days from daily group by series""")
def series_profile(spark, d):
    return evaluation.profile(daily(spark, d))


MONTHLY = "monthly as (select series, date_trunc('month', ds)::date as ds, sum(qty) as qty from daily group by 1, 2)"


def monthly(spark, d):
    return daily(spark, d).groupBy("series", F.trunc("ds", "MM").alias("ds")).agg(F.sum("qty").alias("qty"))


@query(f"""with {DAILY}, {MONTHLY}, s as (select a.series, sum(sign(b.qty - a.qty)) as s from monthly a join monthly b on b.series = a.series and b.ds > a.ds group by a.series),
n as (select series, count(*) as n from monthly group by series),
z as (select n.series, coalesce(s, 0) as s, case when n >= 4 then round(case when s > 0 then (s - 1) / sqrt(n * (n - 1) * (2 * n + 5) / 18.0) when s < 0 then (s + 1) / sqrt(n * (n - 1) * (2 * n + 5) / 18.0) else 0 end, 4) end as z from n left join s on s.series = n.series)
select series, cast(s as bigint) as s, z, case when z > 1.96 then 'rising' when z < -1.96 then 'falling' else 'stable' end as trend from z""")
def mann_kendall(spark, d):
    return evaluation.mann_kendall(monthly(spark, d))


@query(f"""with {DAILY}, {MONTHLY}, x as (select series, ds, qty - avg(qty) over (partition by series) as x, row_number() over (partition by series order by ds) as i, count(*) over (partition by series) as n from monthly),
t as (select series, max(n) as n, sum(x * x) as t from x group by series having max(n) >= 14)
select t.series, cast(k as integer) as lag, round(sum(a.x * b.x) / max(t.t), 3) + 0.0 as acf from t, range(1, 15) r(k), x a, x b where a.series = t.series and b.series = t.series and a.i = b.i + k and k <= t.n // 2 group by t.series, k""")
def autocorrelation(spark, d):
    return evaluation.autocorrelation(monthly(spark, d))


@query()
def mann_kendall_daily(spark, d):
    """Over days the SQL's pairs are too many; tests hold both daily queries against plain loops."""
    return evaluation.mann_kendall(daily(spark, d))


@query()
def autocorrelation_daily(spark, d):
    return evaluation.autocorrelation(daily(spark, d))


def order_rows(spark, d):
    customers = table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_mktsegment").alias("channel"), F.col("c_nationkey").alias("n_nationkey"))
    nations = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", F.col("r_name").alias("region"))
    orders = table(spark, d, "orders").select(F.col("o_orderkey").alias("order_id"), "o_custkey", F.col("o_totalprice").alias("amount"), F.col("o_orderstatus").alias("status"), F.to_date("o_orderdate").alias("day"))
    return orders.join(customers, "o_custkey").join(nations, "n_nationkey")


SUMMARY = """select {dim} as dimension, count(*) as order_count, round(sum(case when o_orderstatus = 'F' then o_totalprice else 0 end), 2) as gmv, round(round(sum(o_totalprice), 2) / count(*), 6) as avg_amount
from orders join customer on c_custkey = o_custkey join nation on n_nationkey = c_nationkey join region on r_regionkey = n_regionkey where o_orderstatus <> 'P' group by 1"""


def summary(name: str, dim: Callable, sql: str) -> None:
    def f(spark, d):
        return reporting.order_summary(order_rows(spark, d), dim(), F.col("status") == "F", F.col("status") == "P")

    f.__name__ = f"order_summary_{name}"
    query(SUMMARY.format(dim=sql))(f)


for _name, _dim, _sql in (
    ("channel", lambda: F.col("channel"), "c_mktsegment"),
    ("region", lambda: F.col("region"), "r_name"),
    ("daily", lambda: F.col("day"), "cast(o_orderdate as date)"),
    ("weekly", lambda: F.date_trunc("week", "day").cast("date"), "date_trunc('week', o_orderdate)::date"),
    ("monthly", lambda: F.trunc("day", "MM"), "date_trunc('month', o_orderdate)::date"),
):
    summary(_name, _dim, _sql)


@query("select o_orderkey as order_id, o_totalprice as amount, o_orderstatus as status from orders order by o_totalprice desc, o_orderkey limit 20 offset 40")
def order_page(spark, d):
    return reporting.order_page(table(spark, d, "orders").select(F.col("o_orderkey").alias("order_id"), F.col("o_totalprice").alias("amount"), F.col("o_orderstatus").alias("status")), offset=40)


EVENTS = "e as (select distinct user_id, cast(ts as date) as day from events), f as (select user_id, min(day) as first_day from e group by user_id)"


def user_days(spark, d):
    return table(spark, d, "events").select("user_id", F.to_date("ts").alias("day"))


@query(f"with {EVENTS} select first_day as day, count(*) as new_users from f group by 1")
def new_users(spark, d):
    return reporting.new_users(user_days(spark, d))


ACTIVE = "with {e}, s as (select distinct user_id, cast(day + cast(i as integer) as date) as day from e, range(0, {n}) r(i)) select day, count(*) as users from s where day <= (select max(day) from e) group by day"


@query(ACTIVE.format(e=EVENTS, n=1))
def daily_active(spark, d):
    return reporting.active_users(user_days(spark, d), 1)


@query(ACTIVE.format(e=EVENTS, n=7))
def weekly_active(spark, d):
    return reporting.active_users(user_days(spark, d), 7)


@query(ACTIVE.format(e=EVENTS, n=30))
def monthly_active(spark, d):
    return reporting.active_users(user_days(spark, d), 30)


@query(f"with {EVENTS} select first_day as day, round(sum(case when e.user_id is null then 0 else 1 end) / count(*), 4) as retention from f left join e on e.user_id = f.user_id and e.day = f.first_day + 7 group by 1")
def retention_7d(spark, d):
    return reporting.retention(user_days(spark, d), 7)


@query(f"with {EVENTS} select first_day as cohort, count(*) filter (where day = first_day) as size, count(*) filter (where day = first_day + 1) as day_1, count(*) filter (where day = first_day + 7) as day_7, count(*) filter (where day = first_day + 30) as day_30 from e join f using (user_id) group by 1")
def cohort_retention(spark, d):
    return reporting.cohorts(user_days(spark, d))


TERMS = "list_transform(regexp_extract_all(coalesce({}, ''), '[A-Za-z0-9_]+|[一-鿿]'), lambda x: lower(x))"


@query(f"""with size as (select count(*) as n, avg(len({TERMS.format("text")})) as m from documents), p as (select doc_id, len(t) as l, unnest(t) as term from (select doc_id, {TERMS.format("text")} as t from documents)),
i as (select doc_id, term, l, count(*) as tf from p group by all), df as (select term, count(*) as df from i group by term), w as (select term, ln(n - df + 0.5) - ln(df + 0.5) as raw from df, size),
idf as (select term, case when raw < 0 then (select avg(raw) * 0.25 from w) else raw end as idf from w), q as (select item_id as query_id, term, count(*) as times from (select item_id, unnest({TERMS.format("text")}) as term from benchmark) group by all),
s as (select query_id, doc_id, sum(times * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * l / m))) as score from q join idf using (term) join i using (term), size group by all)
select query_id, doc_id, round(score, 4) as score, rank from (select *, row_number() over (partition by query_id order by round(score, 6) desc, doc_id) as rank from s where score > 0) where rank <= 10""")
def bm25_top10(spark, d):
    q = table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    return rounded(retrieval.bm25(q, table(spark, d, "documents"), "doc_id", "text", 10), "score")


@query("""select query_id, vec_id, round(distance, 4) as distance, rank from (select *, row_number() over (partition by query_id order by distance, vec_id) as rank from (
select q.vec_id as query_id, v.vec_id, list_sum(list_transform(list_zip(q.embedding, v.embedding), lambda p: (p[1]::double - p[2]::double) * (p[1]::double - p[2]::double))) as distance from embeddings q, embeddings v where q.vec_id % 20 = 0)) where rank <= 10""")
def dense_top10(spark, d):
    v = table(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("vector"))
    return rounded(retrieval.dense(v.filter("vec_id % 20 = 0").withColumnRenamed("vec_id", "query_id"), v, "vec_id", 10), "distance")


URL = r"regexp_replace(regexp_replace(regexp_replace(trim(url), '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*', ''), '[?#].*$', ''), '/+$', '')"


@query(f"select page_id, path, lower(split_part(path, '/', 2)) as module from (select page_id, case when p like '/%' then p else '/' || p end as path from (select page_id, {URL} as p from pages))")
def page_paths(spark, d):
    return table(spark, d, "pages").select("page_id", retrieval.normalize_url(F.col("url")).alias("path"), retrieval.url_module(F.col("url")).alias("module"))


@query(f"""with p as (select page_id, string_split(case when p like '/%' then p else '/' || p end, '/') as s from (select page_id, {URL} as p from pages)), m as (
select page_id, 1 as route_id, 0 as literal from p where len(s) = 3 union all select page_id, 2, 1 from p where len(s) = 3 and s[2] = 'en' union all select page_id, 3, 0 from p where len(s) = 2)
select *, row_number() over (partition by page_id order by literal desc, route_id) as rank from m""")
def route_match(spark, d):
    routes = spark.createDataFrame([(1, "/{lang}/{id}"), (2, "/en/{id}"), (3, "/{top}")], "route_id int, template string")
    found = lookup.route_hits(table(spark, d, "pages").select(F.col("page_id").alias("query_id"), "url"), routes.select(F.col("route_id").alias("chunk_id"), "template"))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("literal"), "chunk_id"))
    return found.select(F.col("query_id").alias("page_id"), F.col("chunk_id").alias("route_id"), "literal", place.alias("rank"))


@query("""with w as (select l_suppkey as id, sum(case when l_returnflag = 'A' then l_quantity end) as A, sum(case when l_returnflag = 'N' then l_quantity end) as N, sum(case when l_returnflag = 'R' then l_quantity end) as R from lineitem group by 1)
select id, name, qty from (unpivot w on A, N, R into name name value qty)""")
def unpivot_wide(spark, d):
    wide = table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("id")).pivot("l_returnflag", ["A", "N", "R"]).agg(F.sum("l_quantity"))
    return sheets.unpivot_columns(wide, ["id"], ["A", "N", "R"])


@query("""select o_orderkey as id, cast(o_orderdate as date) as day from orders""")
def parse_dates(spark, d):
    day = F.to_date("o_orderdate")
    shown = F.when(F.col("o_orderkey") % 4 == 0, F.date_format(day, "yyyy/MM/dd")).when(F.col("o_orderkey") % 4 == 1, F.date_format(day, "yyyyMMdd")).when(F.col("o_orderkey") % 4 == 2, F.date_diff(day, F.lit("1899-12-30").cast("date")).cast("string")).otherwise(F.date_format(day, "yyyy-MM-dd"))
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), sheets.parse_date(shown).alias("day"))


@query("select conv_id, turn, role, back from (select conv_id, turn, role, row_number() over (partition by conv_id order by turn desc) as back from conversations) where back <= 3")
def recent_turns(spark, d):
    return reporting.recent_turns(table(spark, d, "conversations").select("conv_id", "turn", "role"), 3)


@query("select l_suppkey as series, round(sum(l_quantity), 4) as total, round(stddev_pop(l_quantity) * 1.65::double, 4) as stock, round(list_reduce(list(l_quantity order by l_orderkey, l_linenumber, l_quantity), lambda a, x: 0.3::double * x + 0.7::double * a), 4) as level from lineitem group by 1")
def formula_functions(spark, d):
    ordered = F.transform(F.sort_array(F.collect_list(F.struct("l_orderkey", "l_linenumber", "l_quantity"))), lambda x: x["l_quantity"])
    arrays = table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("series")).agg(ordered.alias("q"))
    f = formula.CATALOG
    last = F.element_at(f["exponential_smoothing"][0](F.col("q")), -1)
    return arrays.select("series", F.round(f["sum"][0](F.col("q")), 4).alias("total"), F.round(f["safety_stock"][0](F.col("q")), 4).alias("stock"), F.round(last, 4).alias("level"))


@query()
def holt_winters(spark, d):
    return models.holt_winters(monthly(spark, d), horizon=12, period=12, unit="month")


@query()
def auto_arima(spark, d):
    return models.auto_arima(monthly(spark, d), horizon=12, unit="month")


@query()
def auto_seasonal(spark, d):
    return models.auto_seasonal(daily(spark, d))


@query()
def auto_regressive(spark, d):
    return models.auto_regressive(monthly(spark, d), unit="month")


@query(f"""with {DAILY}, {TAIL.format(n=30)},
fit as (select series, max(ds) as last_ds, max(n) as n, avg(qty) as m, coalesce(regr_slope(qty, n - back), 0) as slope from tail group by series)
select series, cast(last_ds + cast(s as integer) as date) as ds, round(greatest(0, m + slope * (s + (n - 1) / 2.0)), 2) as qty from fit, range(1, 8) r(s) where s <= n""")
def trend_fallback(spark, d):
    return models.trend_fallback(daily(spark, d))


SKILL = """def forecast(points):
    last = [qty for _, qty in points][-7:]
    return [sum(last) / len(last)]
"""


@query(f"""with {DAILY}, {TAIL.format(n=7)} select series, cast(max(ds) + 1 as date) as ds, round(avg(qty), 4) as qty, cast(null as varchar) as error from tail group by series""")
def python_skill(spark, d):
    return rounded(catalogue.run_python(daily(spark, d), SKILL), "qty")


@query("""with v as (select p_type as brand, sum(l_quantity) as volume from lineitem join part on p_partkey = l_partkey group by 1), s as (select p_type as brand, p_brand as product, 0.25 as share from part group by all),
w as (select p_brand as product, cast(p_partkey as varchar) as part, sum(p_size) as qty from part group by all), p as (select p_brand as product, 'new ' || p_brand as part, 6 as month, 100.0 as qty from part group by all),
r as (select product, sum(volume * share) - 100 as rest from v join s using (brand) group by 1), t as (select product, sum(qty) as total from w group by 1),
m as (select product, part, cast(i as integer) as month, rest * qty / total / 12 as qty, 'running' as type from w join r using (product) join t using (product), range(1, 13) x(i) union all select *, 'planned' from p)
select product, part, month, round(qty * case when month = 1 then 0.5::double else 1 end, 2) as qty, type from m""")
def topdown_by_product(spark, d):
    part = table(spark, d, "part")
    product = F.col("p_brand").alias("product")
    volumes = table(spark, d, "lineitem").join(part, F.col("p_partkey") == F.col("l_partkey")).groupBy(F.col("p_type").alias("brand")).agg(F.sum("l_quantity").alias("volume"))
    shares = part.select(F.col("p_type").alias("brand"), product, F.lit(0.25).alias("share")).distinct()
    delivered = part.select(product, F.col("p_partkey").cast("string").alias("part"), F.col("p_size").cast("double").alias("qty"))
    planned = part.select(product, F.concat(F.lit("new "), "p_brand").alias("part"), F.lit(6).alias("month"), F.lit(100.0).alias("qty")).distinct()
    return series.topdown_by_product(volumes, shares, delivered, planned, spark.createDataFrame([(1, 0.5)], "month int, factor double"))


FLAT = r"trim(regexp_replace(coalesce({}, ''), '[ \t\n\x0B\f\r]+', ' ', 'g'))"
CLIPPED = "case when length({x}) <= {n} then {x} else rtrim(substr({x}, 1, {n} - 1)) || '…' end"


@query(f"""with c as (select conv_id, turn, role, text, count(*) over (partition by conv_id) as n, row_number() over (partition by conv_id order by turn desc) as back, trim(coalesce(text, '')) <> '' as spoken from conversations),
a as (select conv_id, min(turn) filter (where back <= 2) as first_kept, count(*) filter (where spoken) as turns, count(*) filter (where spoken and role = 'user') as users, count(*) filter (where spoken and role = 'assistant') as assistants,
arg_min(text, turn) filter (where spoken and role = 'user') as g, arg_max(text, turn) filter (where spoken and role = 'user') as l from c where n > 3 group by 1),
f as (select *, {FLAT.format("g")} as gf, {FLAT.format("l")} as lf from a), s as (select *, {CLIPPED.format(x="gf", n=220)} as goal, {CLIPPED.format(x="lf", n=260)} as latest from f)
select conv_id, turn, role, text from c where n <= 3 or back <= 2 union all
select conv_id, first_kept - 1, 'system', concat_ws(chr(10), format('Turns: {{}}, user: {{}}, assistant: {{}}', turns, users, assistants), case when goal <> '' then 'Goal: ' || goal end, case when latest <> '' and latest <> goal then 'Latest: ' || latest end) from s""")
def compacted_conversations(spark, d):
    return reporting.compacted(table(spark, d, "conversations"), threshold=3, recent=2)


@query("""with v as (select distinct 'c_mktsegment' as field, c_mktsegment as value from customer union select distinct 'c_name', c_name from customer), r as (select *, row_number() over (partition by field order by value) as p from v)
select field, string_agg(value, ', ' order by value) as values from r where p <= 5 group by field""")
def identity_summary(spark, d):
    return reporting.identity_summary(table(spark, d, "customer"), ["c_mktsegment", "c_name"])


HEADED = "select o_orderkey as id, concat_ws(chr(10), '# ' || o_orderpriority, 'status', '', '## ' || o_orderstatus, '| key | price |', '|---|---|', '| ' || o_custkey || ' |', 'end') as text from orders"


def headed(spark, d):
    """Orders shown as markdown texts; the test tables hold none."""
    line = F.concat_ws("\n", F.concat(F.lit("# "), "o_orderpriority"), F.lit("status"), F.lit(""), F.concat(F.lit("## "), "o_orderstatus"), F.lit("| key | price |"), F.lit("|---|---|"), F.concat(F.lit("| "), F.col("o_custkey").cast("string"), F.lit(" |")), F.lit("end"))
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), line.alias("text"))


@query(f"""with h as ({HEADED}), s as (select id, string_split(text, chr(10)) as t from h) select id, 1 as section, 1 as level, t[1][3:] as title, 0 as parent, t[1][3:] as path, 'status' as body from s
union all select id, 2, 2, t[4][4:], 1, t[1][3:] || ' > ' || t[4][4:], array_to_string(t[5:], chr(10)) from s""")
def markdown_sections(spark, d):
    return markdown.sections(headed(spark, d), "id", "text").withColumn("path", F.array_join("path", " > "))


@query("select o_orderkey as id, 2 as section, 6 as line, 'key,price' as headers, o_custkey || ',' as cells from orders")
def markdown_table_rows(spark, d):
    return markdown.table_rows(headed(spark, d), "id", "text").withColumns({c: F.array_join(c, ",") for c in ("headers", "cells")})


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    from . import batch_queries, more_queries, sheet_queries, text_queries  # noqa: F401  register their own

    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    queries()
    return dict(ORACLES)
