"""More registered queries: forecasts by other inputs, reports, sheets, lookups, rank fusion, formula functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from .functions import formula
from .operators import evaluation, lookup, reporting, retrieval, series, sheets
from .queries import DAILY, EVENTS, PARTS, daily, monthly, moves, order_rows, query, rounded, table, user_days
from .sources.shared import written

# forecasts


@query("""with f as (select l_suppkey as series, cast(l_shipdate as date) as ds, l_quantity as qty, l_returnflag as flag, row_number() over (partition by l_suppkey, l_shipdate::date, l_returnflag order by l_orderkey desc, l_linenumber desc, l_extendedprice desc, l_quantity desc) as back from lineitem),
e as (select f.series, abs(f.qty - a.qty) as e, a.qty as a, f.qty + a.qty as s from f left join f a on a.series = f.series and a.ds = f.ds and a.flag = 'A' and a.back = 1 where f.flag = 'N' and f.back = 1)
select series, round(avg(e), 4) as mae, round(100 * avg(case when a <> 0 then e / a end), 4) as mape, round(sqrt(avg(e * e)), 4) as rmse, round(avg(case when a is null then null when s = 0 then 0 else 200 * e / s end), 4) as smape, count(a) as data_points from e group by series""")
def accuracy_last_wins(spark, d):
    rows = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("series"), F.to_date("l_shipdate").alias("ds"), F.col("l_quantity").alias("qty"), "l_returnflag", F.struct("l_orderkey", "l_linenumber", "l_extendedprice", "l_quantity").alias("at"))
    return evaluation.accuracy(rows.filter("l_returnflag = 'N'"), rows.filter("l_returnflag = 'A'"), order="at")


#: series 0, 3, .. have forecasts by month, 1, 4, .. one for the month of their first demand, the others none; every second one has deliveries of its own
BLEND = f"""with {PARTS}, demand as (select series, ds, demand as qty from moves where demand > 0 and day(ds) <= 20),
begun as (select series, date_trunc('month', min(ds))::date as month, avg(qty) as mean from demand group by series),
monthly as (select series, date_trunc('month', ds)::date as month, sum(demand) as forecast from moves where series % 3 = 0 group by 1, 2 having sum(demand) > 0
  union all select b.series, month, case when series % 3 = 1 then 5000 else mean end from begun b where series % 3 <> 0 or series not in (select series from moves group by series having sum(demand) > 0)),
supplies as (select series, ds, jit as supply from moves where series % 2 = 0 union all select series, ds, pgi from moves where series % 2 = 1),
known as (select series, date_trunc('month', ds)::date as month, sum(qty) as known, count(*) as days from demand group by 1, 2),
fills as (select m.series, m.month, case when day(last_day(m.month)) - coalesce(days, 0) > 0 then (forecast - coalesce(known, 0)) / (day(last_day(m.month)) - coalesce(days, 0)) else 0 end as fill from monthly m left join known k on k.series = m.series and k.month = m.month),
span as (select m.series, least(min(m.month), min(f.first)) as a, last_day(max(m.month)) as b from monthly m left join (select series, min(ds) as first from demand group by series) f on f.series = m.series group by m.series),
calendar as (select series, unnest(generate_series(a::timestamp, b::timestamp, interval 1 day))::date as ds from span),
days as (select c.series, c.ds, coalesce(e.qty, f.fill, 0) as demand, coalesce(s.supply, 0) as supply from calendar c left join demand e on e.series = c.series and e.ds = c.ds
  left join fills f on f.series = c.series and f.month = date_trunc('month', c.ds)::date left join supplies s on s.series = c.series and s.ds = c.ds),
summed as (select *, 100 + sum(supply - demand) over (partition by series order by ds rows unbounded preceding) as w from days),
low as (select *, w - least(0, min(w) over (partition by series order by ds rows unbounded preceding)) as stock from summed),
raw as (select *, coalesce(lag(stock) over (partition by series order by ds), 100) + supply - demand as raw from low)
select series, ds, round(greatest(0, -raw), 4) as qty, round(raw, 4) as balance from raw"""


@query(BLEND)
def monthly_daily_blend_inputs(spark, d):
    m = written(moves(spark, d), "moves")
    demand = m.filter((F.col("demand") > 0) & (F.day("ds") <= 20)).select("series", "ds", F.col("demand").alias("qty"))
    by_month = m.filter("series % 3 = 0").groupBy("series", F.trunc("ds", "MM").alias("month")).agg(F.sum("demand").alias("forecast")).filter("forecast > 0")
    totals = demand.select("series").distinct().filter("series % 3 = 1").withColumn("forecast", F.lit(5000.0))
    ins, pgi = (m.select("series", "ds", F.col(c).alias("qty")) for c in ("jit", "pgi"))
    return series.monthly_daily_blend(demand, series.blend_forecasts(demand, totals, by_month), series.first_source(ins.filter("series % 2 = 0"), pgi), 100.0, digits=4)


@query(f"with {PARTS} select series, ds, case when jit > 0 then jit else demand end as qty from moves")
def priority_fill(spark, d):
    m = moves(spark, d)
    return series.priority_fill(m.filter("jit > 0").select("series", "ds", F.col("jit").alias("qty")), m.select("series", "ds", F.col("demand").alias("qty")))


FIRST_MEANS = "tail as (select *, row_number() over (partition by series order by ds desc) as back from daily)"


@query(f"""with {DAILY}, {FIRST_MEANS}, level as (select series, round(avg(qty) filter (where back <= 7), 2) as a, round(list_reduce(list(qty order by ds), lambda p, x: 0.3::double * x + 0.7::double * p), 2) as b from tail group by series),
f as (select series, unnest(['moving_average', 'smoothing']) as preset, unnest([a, b]) as qty from level)
select series, preset, round(7 * qty, 2) as total, round(qty, 2) as average, qty as max, qty as min, 7::bigint as days, qty as third_day, round(avg(round(7 * qty, 2)) over (partition by preset), 1) as mean_total from f""")
def compare_presets(spark, d):
    s = daily(spark, d)
    found = evaluation.compare({"moving_average": series.flat_average_forecast(s, 7), "smoothing": series.flat_smoothing_forecast(s)})
    return found.withColumn("third_day", F.get("first_3", 2)).drop("first_3")


@query(f"""with {DAILY}, monthly as (select series, date_trunc('month', ds)::date as ds, sum(qty) as qty from daily group by 1, 2),
p as (select series, stddev_pop(qty) / avg(qty) as cv, count(*) as days from monthly group by series), s as (select a.series, sum(sign(b.qty - a.qty)) as s from monthly a join monthly b on b.series = a.series and b.ds > a.ds group by a.series),
z as (select series, days, round(case when coalesce(s, 0) > 0 then (s - 1) / sqrt(days * (days - 1) * (2 * days + 5) / 18.0) when s < 0 then (s + 1) / sqrt(days * (days - 1) * (2 * days + 5) / 18.0) else 0 end, 4) as z, round(cv, 4) as cv from p left join s using (series)),
x as (select series, qty - avg(qty) over (partition by series) as x, row_number() over (partition by series order by ds) as i, count(*) over (partition by series) as n from monthly),
t as (select series, max(n) as n, sum(x * x) as t from x group by series having max(n) >= 14),
acf as (select t.series, k, round(sum(a.x * b.x) / max(t.t), 3) as acf from t, range(1, 15) r(k), x a, x b where a.series = t.series and b.series = t.series and a.i = b.i + k and k <= t.n // 2 group by t.series, k), best as (select series, max(acf) as acf from acf group by series)
select z.series, array_to_string(list_filter([case when acf > 0.3 and days >= 14 then 'holt_winters' end, case when abs(z) > 1.96 then 'linear_trend' end, case when cv > 0.5 then 'safety_stock_plan' end, case when days >= 10 then 'auto_arima' end, 'moving_average'], lambda v: v is not null), ',') as presets from z left join best using (series)""")
def recommended_presets(spark, d):
    m = monthly(spark, d)
    found = evaluation.recommend(evaluation.profile(m), evaluation.mann_kendall(m), evaluation.best_lag(evaluation.autocorrelation(m)))
    return found.withColumn("presets", F.array_join("presets", ","))


#: functions over the monthly sums of a supplier, in order of months
FORMULAS = f"""with {DAILY}, m as (select series, date_trunc('month', ds)::date as ds, sum(qty) as q from daily group by 1, 2), i as (select *, row_number() over w - 1 as i, count(*) over (partition by series) as n, avg(q) over (partition by series) as mean, sum(100 - q) over w as run, avg(q) over (partition by series order by ds rows 6 preceding) as ma from m window w as (partition by series order by ds)),
t as (select series, avg(q) as tm, regr_slope(q, i - greatest(n - 30, 0)) as slope, count(*) as k from i where i >= n - 30 group by series)
select series, round(max(mean), 4) as mean, min(q) as smallest, max(q) as largest, round(stddev_pop(q), 4) as deviation, round(arg_max(ma, i), 4) as last_mean, round(sum(q), 4) as last_sum, count(*) + 2 as shifted_size, round(max(tm) + max(slope) * (max(k) + max(k) - 1 - (max(k) - 1) / 2.0), 4) as trend_end,
round(avg(q) filter (where i % 7 = 0 and i < n // 7 * 7) / max(mean), 4) as first_index, round(50 + arg_max(run, i), 4) as last_balance, round(sum(greatest(0, -(50 + run))), 4) as short, round(abs(50 + min(run)), 2) as depth, case when max(mean) > 1000 then 'high' else 'low' end as class
from i join t using (series) group by series"""


@query(FORMULAS)
def formula_catalogue(spark, d):
    f = {name: fn for name, (fn, _) in formula.CATALOG.items()}
    q = F.transform(F.sort_array(F.collect_list(F.struct("ds", "qty"))), lambda x: x["qty"])  # months: bounded by the calendar
    a, last = F.col("q"), lambda x: F.element_at(x, -1)
    arrays = monthly(spark, d).groupBy("series").agg(q.alias("q")).withColumn("supply", F.transform("q", lambda _: F.lit(100.0)))
    balance = f["balance"](F.lit(50.0), a, F.col("supply"))
    return rounded(
        arrays.select(
            "series", f["mean"](a).alias("mean"), f["min"](a).alias("smallest"), f["max"](a).alias("largest"), f["std"](a).alias("deviation"),
            last(f["moving_average"](a)).alias("last_mean"), last(f["cumsum"](a)).alias("last_sum"), F.size(f["shift"](a, 2)).cast("long").alias("shifted_size"), last(f["linear_trend"](a)).alias("trend_end"),
            f["seasonal_index"](a)[0].alias("first_index"), last(balance).alias("last_balance"), f["sum"](f["net_demand"](balance)).alias("short"), f["round"](f["abs"](F.array_min(balance)), 2).alias("depth"),
            f["if_then_else"](f["mean"](a) > 1000, F.lit("high"), F.lit("low")).alias("class"),
        ),
        "mean", "deviation", "last_mean", "last_sum", "trend_end", "first_index", "last_balance", "short",
    )


@query(f"""with recursive {DAILY}, m as (select series, sum(qty) as q, row_number() over (partition by series order by date_trunc('month', ds)) as i, max(10 * (series % 7)) as p from daily group by series, date_trunc('month', ds)),
plan as (select m.series, i, greatest(0, 500 + p - q) as stock, greatest(0, q - 500 - p) as net from m where i = 1 union all select m.series, m.i, greatest(0, stock + p - q), greatest(0, q - stock - p) from plan join m on m.series = plan.series and m.i = plan.i + 1),
jit as (select series, i, q, case when i % 3 = 0 then q / 2 else 0 end as j from m), rest as (select series, 100000 - sum(case when j > 0 then j else q end) - 2 * max(10 * (series % 7)) as rest, count(*) filter (where j <= 0) as free from jit group by series),
filled as (select series, sum(round(greatest(0, case when j > 0 then j else q + case when rest > 0 then rest / free else 0 end end), 2)) as filled from jit join rest using (series) group by series)
select series, round(sum(net), 4) as net, round(max(filled), 2) as filled from plan join filled using (series) group by series""")
def planned_quantities(spark, d):
    q = F.transform(F.sort_array(F.collect_list(F.struct("ds", "qty"))), lambda x: x["qty"])
    arrays = monthly(spark, d).groupBy("series").agg(q.alias("q"))
    each = (F.col("series") % 7 * 10).cast("double")
    supply = F.transform("q", lambda _: each)
    jit = F.transform("q", lambda x, i: F.when((i + 1) % 3 == 0, x / 2).otherwise(0.0))
    net = formula.total(formula.inventory_planning(F.col("q"), F.lit(500.0), supply))
    filled = formula.total(formula.jit_fill(F.lit(100000.0), F.col("q"), jit, F.array(each, each)))
    return arrays.select("series", F.round(net, 4).alias("net"), F.round(filled, 2).alias("filled"))


# reports


@query("""select r_name as dimension, count(*) as order_count, round(sum(o_totalprice), 2) as gmv, round(round(sum(o_totalprice), 2) / count(*), 6) as avg_amount
from orders join customer on c_custkey = o_custkey join nation on n_nationkey = c_nationkey join region on r_regionkey = n_regionkey where o_orderstatus = 'F' and c_mktsegment = 'BUILDING' and o_orderdate::date between date '1995-03-01' and date '1997-10-31' group by 1""")
def order_summary_filtered(spark, d):
    chosen = reporting.order_filter(order_rows(spark, d), "1995-03-01", "1997-10-31", status="paid", statuses={"paid": "F", "cancelled": "P"}, channel="BUILDING")
    return reporting.order_summary(chosen, "region", F.col("status") == "F", F.col("status") == "P")


@query(f"with {EVENTS} select first_day as day, round(sum(case when e.user_id is null then 0 else 1 end) / count(*), 4) as retention from f left join e on e.user_id = f.user_id and e.day = f.first_day + 30 group by 1")
def retention_30d(spark, d):
    return reporting.retention(user_days(spark, d), 30)


@query(f"""with {EVENTS}, k as (select user_id, arg_min(event_type, event_id) as dimension from events group by user_id)
select first_day as cohort, dimension, count(*) filter (where day = first_day) as size, count(*) filter (where day = first_day + 1) as day_1, count(*) filter (where day = first_day + 7) as day_7, count(*) filter (where day = first_day + 30) as day_30 from e join f using (user_id) join k using (user_id) group by 1, 2""")
def cohort_by_first_event(spark, d):
    first = table(spark, d, "events").groupBy("user_id").agg(F.min_by("event_type", "event_id").alias("dimension"))
    return reporting.cohorts(user_days(spark, d), dimension=first)


@query("""with r as (select c_mktsegment, count(*)::double as orders, round(sum(o_totalprice), 2) as amount from orders join customer on c_custkey = o_custkey where c_custkey % 10 < 1 + length(c_mktsegment) % 4 group by 1), m as (unpivot r on orders, amount into name measure value value)
select measure, min(value) as low, max(value) as high, round((max(value) - min(value)) / min(value), 4) as spread from m group by measure having count(*) >= 2 and min(value) > 0 and (max(value) - min(value)) / min(value) > 0.2""")
def report_insights(spark, d):
    rows = order_rows(spark, d).filter(F.col("o_custkey") % 10 < 1 + F.length("channel") % 4)
    report = rows.groupBy("channel").agg(F.count("*").cast("double").alias("orders"), F.round(F.sum("amount"), 2).alias("amount"))
    return reporting.insights(report, ["orders", "amount"])


@query("""with h as (select conv_id, turn, text, instr(lower(text), 'the') as p from conversations where instr(lower(text), 'the') > 0)
select conv_id, turn, substr(text, greatest(p - 120, 1), least(p - 1, 120) + 3 + 240) as snippet from h order by conv_id desc, turn desc limit 5""")
def turn_search(spark, d):
    return reporting.search_turns(table(spark, d, "conversations"), "the")


# sheets

W = """w as (select s_suppkey as k, s_name, s_nationkey, sum(case when l_returnflag = 'A' then l_quantity end) as a, sum(case when l_returnflag = 'N' then l_quantity end) as n, sum(case when l_returnflag = 'R' then l_quantity end) as r from supplier join lineitem on l_suppkey = s_suppkey group by all)"""


def supplier_sheet(spark, d):
    """A sheet with two header rows: ids, then two blocks of dated columns; numbers are texts with separators, as sheets have them."""
    of = lambda flag: F.sum(F.when(F.col("l_returnflag") == flag, F.col("l_quantity")))
    sums = table(spark, d, "lineitem").groupBy("l_suppkey").agg(of("A").alias("a"), of("N").alias("n"), of("R").alias("r"))
    rows = table(spark, d, "supplier").join(sums, F.col("s_suppkey") == F.col("l_suppkey"))
    name = F.when(F.col("s_suppkey") % 10 == 3, " ").otherwise(F.concat(F.lit(" "), "s_name"))  # rows without a name are noise
    shown = F.array(name, F.concat(F.col("s_nationkey").cast("string"), F.lit(".0")), F.format_number("a", 2), F.col("n").cast("string"), F.when(F.col("s_suppkey") % 7 == 0, "n/a").otherwise(F.col("r").cast("string")))
    body = rows.select((F.col("s_suppkey") + 3).cast("int").alias("row"), F.posexplode(shown).alias("col", "value"))
    head = spark.createDataFrame([(1, 2, "plan"), (1, 4, "actual"), (2, 0, " part "), (2, 1, "nation"), (2, 2, "2025-01-01 00:00:00"), (2, 3, "2025-01-02T00:00:00"), (2, 4, "2025-01-01")], "row int, col int, value string")
    return head.unionByName(body).select(F.lit("s").alias("sheet"), "row", (F.col("col") + 1).alias("col"), "value")


LONG = "x as (select k, s_name, s_nationkey, unnest(['plan', 'plan', 'actual']) as block, unnest(['2025-01-01', '2025-01-02', '2025-01-01']) as name, unnest([round(a, 2), n, case when k % 7 = 0 then null else r end]) as qty from w where k % 10 <> 3)"


@query(f"with {W}, {LONG} select 's' as sheet, cast(k + 3 as integer) as row, block, name, qty, s_name as part, s_nationkey::varchar as nation from x where qty is not null")
def sheet_blocks(spark, d):
    return sheets.unpivot_blocks(supplier_sheet(spark, d), [("", "part"), ("", "nation")], 1, 2, r"^\d{4}-\d{2}-\d{2}$")


@query(f"with {W}, {LONG} select 's' as sheet, cast(k + 3 as integer) as row, case when name = '2025-01-02' then 'second' else block end as name, qty, s_name as part from x where qty is not null")
def sheet_positions(spark, d):
    return sheets.unpivot_positions(supplier_sheet(spark, d), {"part": 1}, {3: "plan", 4: "second", 5: "actual"}, first_row=3)


@query(f"""with {W}, {LONG}, p as (select *, case when k % 2 = 0 then 'even' else 'odd' end as category from x where k % 3 <> 0 and qty is not null and block = 'plan')
select category, s_nationkey::varchar as nation, name, arg_max(qty, k) as qty from p group by all""")
def sheet_plan(spark, d):
    cells = supplier_sheet(spark, d)
    rows = sheets.unpivot_blocks(cells, [("", "part"), ("", "nation")], 1, 2, r"^\d{4}-\d{2}-\d{2}$").filter("block = 'plan'")
    plan = table(spark, d, "supplier").filter("s_suppkey % 3 <> 0").select(F.lit("s").alias("sheet"), (F.col("s_suppkey") + 3).cast("int").alias("row"), F.when(F.col("s_suppkey") % 2 == 0, "even").otherwise("odd").alias("category"))
    return sheets.extracted(rows, plan, ["nation"])


@query(f"""with {W}, c as (select k + 3 as row, 1 as col, case when k % 10 = 3 then ' ' else ' ' || s_name end as value from w union all select k + 3, 2, s_nationkey || '.0' from w)
select 's' as sheet, cast(row as integer) as row, cast(col as integer) as col, value from c where row not in (5, 8) and row <= 40 and (row > 30 or row in (select row from c where col = 2 and contains(value, '1')) or row in (4, 6))""")
def sheet_filters(spark, d):
    used = sheets.row_filter(supplier_sheet(spark, d).filter("row > 2"), after=30, positions=(4, 6), blocks={2: "1"})
    kept = sheets.row_filter(sheets.row_filter(used, before=40), positions=(5, 8), mode="skip")
    return sheets.column_filter(kept, after=2, mode="skip")


WRITTEN = """v as (select o_orderpriority as name, cast(o_orderkey as bigint) as row, o_orderdate::date as day, case when o_orderpriority = '1-URGENT' then 1 when o_orderpriority = '2-HIGH' then 9 else o_orderkey % 9 end as k from orders),
shown as (select name, row, case k when 0 then strftime(day, '%Y-%m-%d %H:%M:%S') when 1 then ' ' || strftime(day, '%Y-%m-%d') || ' ' when 2 then strftime(day, '%Y/%-m/%-d') when 3 then strftime(day, '%Y.%m.%d') when 4 then strftime(day, '%Y%m%d') when 5 then strftime(day, '%d/%m/%Y') when 6 then strftime(day, '%Y年%m月%d日') when 7 then (day - date '1899-12-30')::varchar || '.5' else 'bad ' || row end as value,
  case k when 0 then 'yyyy-MM-dd HH:mm:ss' when 1 then 'yyyy-MM-dd' when 2 then 'yyyy/MM/dd' when 3 then 'yyyy.MM.dd' when 4 then 'yyyyMMdd' when 5 then 'dd/MM/yyyy' when 6 then 'yyyy年MM月dd日' when 7 then 'serial' end as kind, case when k < 8 then day end as day from v)"""


def written_dates(spark, d):
    """Order dates as people write them, each priority a column of its own."""
    day = F.to_date("o_orderdate")
    k = F.when(F.col("o_orderpriority") == "1-URGENT", 1).when(F.col("o_orderpriority") == "2-HIGH", 9).otherwise(F.col("o_orderkey") % 9)
    shape = lambda f: F.date_format(day, f)
    shapes = [shape("yyyy-MM-dd HH:mm:ss"), F.concat(F.lit(" "), shape("yyyy-MM-dd"), F.lit(" ")), shape("yyyy/M/d"), shape("yyyy.MM.dd"), shape("yyyyMMdd"), shape("dd/MM/yyyy"), shape("yyyy年MM月dd日"), F.concat(F.date_diff(day, F.lit("1899-12-30").cast("date")).cast("string"), F.lit(".5"))]
    value = F.lit(None).cast("string")
    for i, s in enumerate(shapes):
        value = F.when(k == i, s).otherwise(value)
    return table(spark, d, "orders").select(F.col("o_orderpriority").alias("name"), F.col("o_orderkey").cast("long").alias("row"), F.coalesce(value, F.concat(F.lit("bad "), F.col("o_orderkey").cast("string"))).alias("value"))


@query(f"with {WRITTEN} select row, day from shown")
def parse_written_dates(spark, d):
    return written_dates(spark, d).select("row", sheets.parse_date(F.col("value")).alias("day"))


@query(f"""with {WRITTEN}, n as (select name, kind, count(*) as n from shown where kind is not null group by all), g as (select name, array_to_string(list(kind order by n desc, kind), ', ') as kinds, count(*) as k, sum(n)::bigint as parsed from n group by name),
b as (select name, value, row_number() over (partition by name order by row) as p from shown where kind is null), s as (select name, string_agg(value, '|' order by p) as samples from b where p <= 5 group by name)
select t.name, case when k is null then 'unknown' when k = 1 then kinds else 'mixed (' || kinds || ')' end as source, coalesce(kinds = 'yyyy-MM-dd', false) as matches, total, coalesce(parsed, 0) as parsed, total - coalesce(parsed, 0) as unparsed, coalesce(samples, '') as samples
from (select name, count(*) as total from shown group by name) t left join g using (name) left join s using (name)""")
def date_report(spark, d):
    return sheets.date_report(written_dates(spark, d))


# lookups and ranks

LOOKED = """with c as (select p_partkey as chunk_id, '/' || lower(p_type) || '/{id}/' || p_partkey % 400 as a, '/item/' || p_size || '/' || replace(p_brand, '#', '-') as b, p_name as message, 'E' || p_partkey % 500 as code, 'T' || p_partkey % 300 || '/' || p_partkey as value from part),
q as (select o_orderkey as query_id, case when o_orderkey % 2 = 0 then '/economy/' || o_custkey || '/' || o_orderkey % 1000 else '/item/' || 1 + o_orderkey % 50 || '/Brand-' || 1 + o_custkey % 25 end as path, 'E' || o_custkey as code, case when o_orderkey % 5 = 0 then 'T' || o_custkey % 600 else o_orderkey || '' end as status, case when o_orderkey % 50 = 0 then 'a small ring came' when o_orderkey % 50 = 1 then 'RED wi' else '' end as remark from orders),
h as (select query_id, chunk_id, 0 as place, 2 as literal from q join c on string_split(path, '/')[2] = string_split(a, '/')[2] and string_split(path, '/')[4] = string_split(a, '/')[4] union all select query_id, chunk_id, 0, 3 from q join c on path = b
  union all select query_id, chunk_id, 1, 0 from q join c using (code) union all select query_id, chunk_id, 2, 0 from q join (select chunk_id, unnest(string_split(value, '/')) as status from c) using (status) where length(status) >= 2
  union all select query_id, chunk_id, 3, 0 from q join c on length(message) >= 4 and length(remark) >= 3 and (contains(lower(remark), lower(message)) or contains(lower(message), lower(remark)))),
o as (select query_id, chunk_id, place, max(literal) as literal from h group by all)
select query_id, chunk_id, ['route', 'errorCode', 'status', 'remark'][place + 1] as layer, row_number() over (partition by query_id order by place, literal desc, chunk_id) as rank from o"""


@query(LOOKED)
def lookup_hits(spark, d):
    dashed = F.replace("p_brand", F.lit("#"), F.lit("-"))
    path = F.concat(F.lit("`/"), F.lower("p_type"), F.lit("/{id}/"), (F.col("p_partkey") % 400).cast("string"), F.lit("`, `/item/"), F.col("p_size").cast("string"), F.lit("/"), dashed, F.lit("`"))
    row = F.create_map(F.lit("**Path**"), path, F.lit("Message"), F.concat(F.lit("**"), "p_name", F.lit("**")), F.lit("Code"), F.concat(F.lit("`E"), (F.col("p_partkey") % 500).cast("string"), F.lit("`")), F.lit("Value"), F.concat(F.lit("T"), (F.col("p_partkey") % 300).cast("string"), F.lit("/"), F.col("p_partkey").cast("string")))
    chunks = table(spark, d, "part").select(F.col("p_partkey").alias("chunk_id"), F.lit("table_row").alias("chunk_type"), F.map_keys(row).alias("headers"), row.alias("row"))
    key, customer = F.col("o_orderkey"), F.col("o_custkey")
    url = F.when(key % 2 == 0, F.concat(F.lit("https://x.example/economy/"), customer.cast("string"), F.lit("/"), (key % 1000).cast("string"), F.lit("/?a=1"))).otherwise(F.concat(F.lit("/item/"), (1 + key % 50).cast("string"), F.lit("/Brand-"), (1 + customer % 25).cast("string"), F.lit("#top")))
    remark = F.when(key % 50 == 0, "a small ring came").when(key % 50 == 1, "RED wi").otherwise("")
    status = F.when(key % 5 == 0, F.concat(F.lit("T"), (customer % 600).cast("string"))).otherwise(key.cast("string"))
    payload = F.create_map(F.lit("errorCode"), F.concat(F.lit("E"), customer.cast("string")), F.lit("Status"), status, F.lit("remark"), remark)
    requests = table(spark, d, "orders").select(key.alias("query_id"), url.alias("url"), payload.alias("payload"))
    return lookup.hits(requests, chunks, ("errorcode",), ("status",), ("remark",))


@query("""with a as (select o_custkey as q, o_orderkey as k, row_number() over (partition by o_custkey order by o_totalprice desc, o_orderkey) as r from orders), b as (select o_custkey as q, o_orderkey as k, row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey) as r from orders),
f as (select q, k, sum(1.0::double / (60 + r - 1)) as s from (select * from a where r <= 10 union all select * from b where r <= 10) group by all), x as (select q, k, s * case when o_orderstatus = 'F' then 1.5::double else 1 end as s from f join orders on o_orderkey = k where not (o_orderpriority = '5-LOW'))
select q as query_id, k as chunk_id, round(s, 8) as score, rank from (select *, row_number() over (partition by q order by round(s, 12) desc, k) as rank from x) where rank <= 8""")
def fused_ranks(spark, d):
    orders = table(spark, d, "orders").select(F.col("o_custkey").alias("query_id"), F.col("o_orderkey").alias("chunk_id"), "o_totalprice", "o_orderdate", "o_orderstatus", "o_orderpriority")
    first, second = (retrieval.ranked(orders, 10, F.desc(c), "chunk_id") for c in ("o_totalprice", "o_orderdate"))
    merged = retrieval.fuse(first, second, "chunk_id").join(orders.select("chunk_id", "o_orderstatus"), "chunk_id")
    known = orders.filter("o_orderpriority = '5-LOW'").select("query_id", "chunk_id")
    left = retrieval.exclude(retrieval.boost(merged, F.col("o_orderstatus") == "F"), known, "chunk_id").select("query_id", "chunk_id", "score")
    return rounded(retrieval.ranked(left, 8, F.desc(F.round("score", 12)), "chunk_id"), "score", digits=8)


@query("""select query_id, array_to_string(list_filter([url, 'errorCode=' || code, 'b=' || nullif(b, ''), 'question ' || query_id], lambda v: v is not null), ' | ') as text
from (select o_orderkey as query_id, '/x/' || o_custkey as url, o_orderpriority as code, case when o_orderkey % 2 = 0 then '' else o_orderstatus end as b from orders)""")
def search_queries(spark, d):
    payload = F.create_map(F.lit("b"), F.when(F.col("o_orderkey") % 2 == 0, "").otherwise(F.col("o_orderstatus")), F.lit("none"), F.lit(None).cast("string"), F.lit("errorCode"), F.col("o_orderpriority"))
    text = retrieval.search_query(F.concat(F.lit("/x/"), F.col("o_custkey").cast("string")), payload, F.concat(F.lit("question "), F.col("o_orderkey").cast("string")), ("missing", "errorCode"))
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("query_id"), text.alias("text"))
