from datetime import date, datetime, timedelta
from random import Random

from pyspark.sql import functions as F

from cobaltine.functions import formula
from cobaltine.operators import evaluation, reporting, retrieval, series, sheets
from cobaltine.queries import moves, queries


def one(spark, expression):
    return spark.range(1).select(expression.alias("x")).first()["x"]


def array(*values):
    return F.array(*[F.lit(float(v)) for v in values]) if values else F.array().cast("array<double>")


def test_formula_functions(spark):
    assert one(spark, formula.exponential_smoothing(array(10, 20, 30)))[-1] == 18.1
    assert one(spark, formula.moving_average(array(1, 2, 3, 4), 2)) == [1.0, 1.5, 2.5, 3.5]
    assert one(spark, formula.linear_trend(array(1, 2, 3))) == [1, 2, 3, 4, 5, 6]
    assert one(spark, formula.shift(array(1, 2), 1)) == [0, 1, 2]
    assert one(spark, formula.shift(array(1, 2, 3), -1)) == [2, 3, 0]
    assert one(spark, formula.cumulative_sum(array(1, 2, 3))) == [1, 3, 6]
    assert one(spark, formula.seasonal_index(array(1, 3, 1, 3), 2)) == [0.5, 1.5]
    assert one(spark, formula.modulo(F.lit(-7.0), F.lit(3.0))) == 2.0
    assert one(spark, formula.divide(F.lit(1.0), F.lit(0.0))) == 0.0
    assert one(spark, formula.elementwise(array(1, 2, 3), array(1), lambda a, b: a + b)) == [2, 3, 4]
    assert one(spark, formula.inventory_planning(array(5, 5), F.lit(3.0), array(0, 4))) == [2.0, 1.0]
    assert one(spark, formula.net_demand(formula.balance(F.lit(10.0), array(5, 10), array(0, 0)))) == [0.0, 5.0]


def test_formula_functions_of_empty_arrays(spark):
    for f in (formula.exponential_smoothing, formula.moving_average, formula.linear_trend, formula.cumulative_sum):
        assert one(spark, f(array())) == []
    for f in (formula.total, formula.mean, formula.smallest, formula.largest, formula.deviation):
        assert one(spark, f(array())) == 0.0


def test_clamped_balance_is_the_recursion(spark):
    demand, supply, stock, expected = [5, 9, 0, 7, 2], [3, 0, 4, 1, 9], 4.0, []
    for d, s in zip(demand, supply, strict=True):
        raw = stock + s - d
        stock = max(0.0, raw)
        expected.append((raw, stock))
    rows = [("a", date(2025, 1, i + 1), float(d), float(s)) for i, (d, s) in enumerate(zip(demand, supply, strict=True))]
    got = series.clamped_balance(spark.createDataFrame(rows, "series string, ds date, demand double, supply double"), 4.0).orderBy("ds").collect()
    assert [(r["raw"], r["stock"]) for r in got] == expected


def test_jit_fill_spreads_the_rest_over_free_days(spark):
    days = [("a", date(2025, 12, 1 + i), 10.0, 50.0 if i == 0 else 0.0, 0.0) for i in range(5)]
    frame = spark.createDataFrame(days, "series string, ds date, demand double, jit double, pgi double")
    got = series.jit_priority_fill(frame, spark.createDataFrame([("a", 130.0)], "series string, total double")).orderBy("ds").collect()
    assert [r["qty"] for r in got] == [50.0, 20.0, 20.0, 20.0, 20.0]


def test_order_gap_goes_to_sunday_and_may_be_negative(spark):
    orders = spark.createDataFrame([("a", date(2025, 12, 3), 100.0)], "series string, ds date, qty double")
    totals = spark.createDataFrame([("a", 350.0, 50.0)], "series string, forecast double, delivered double")
    got = {r["ds"]: (r["qty"], r["type"]) for r in series.order_gap_blend(orders, totals).collect()}
    assert len(got) == 7 and got[date(2025, 12, 7)] == (200.0, "spread") and got[date(2025, 12, 3)] == (100.0, "daily_order")


def gap_rows(spark, orders, totals, **options):
    orders = spark.createDataFrame([("a", date(2025, 12, d), q) for d, q in orders], "series string, ds date, qty double")
    totals = spark.createDataFrame([("a", *totals)], "series string, forecast double, delivered double")
    return {r["ds"].day: (r["qty"], r["type"]) for r in series.order_gap_blend(orders, totals, **options).collect()}


def test_order_gap_is_not_spread_where_orders_reach_the_end(spark):
    for late in (7, 20):  # the Sunday, and after it
        got = gap_rows(spark, [(3, 100.0), (late, 5.0)], (350.0, 50.0))
        assert got == {d: (0.0, "daily_order") for d in range(1, 8)} | {3: (100.0, "daily_order")} | ({7: (5.0, "daily_order")} if late == 7 else {})
    assert gap_rows(spark, [(3, 300.0)], (350.0, 50.0))[7] == (0.0, "spread")


def test_order_gap_of_a_month_is_spread_from_the_last_order(spark):
    got = gap_rows(spark, [(20, 10.0), (28, 7.0)], (100.0, 50.0), monthly=True)
    assert got == {20: (10.0, "daily_order")} | {d: (0.0, "empty") for d in range(21, 28)} | {d: (25.0, "spread") for d in range(28, 32)}
    assert set(gap_rows(spark, [(30, 10.0), (31, 7.0)], (100.0, 50.0), monthly=True).values()) == {(10.0, "daily_order"), (7.0, "daily_order")}


def test_safety_stock_counts_deliveries(spark):
    demand = [4.0, 8.0, 6.0, 2.0, 10.0]
    rows = spark.createDataFrame([("a", date(2025, 1, i + 1), q) for i, q in enumerate(demand)], "series string, ds date, qty double")
    arriving = spark.createDataFrame([("a", 1, 3.0), ("a", 3, 20.0), ("a", 9, 5.0), ("b", 1, 7.0)], "series string, step int, qty double")
    mean, deviation = 6.0, 8.0**0.5
    for plan, z in ((series.safety_stock_plan, 1.65), (series.inventory_optimization, 1.6448536269514722)):
        stock, expected = 2.0, []
        for delivered in (3.0, 0.0, 20.0, 0.0, 0.0):
            ship = max(0.0, mean + z * deviation - stock - delivered)
            stock = max(0.0, stock + delivered - mean)
            expected.append((round(ship, 2), round(stock, 2)))
        got = plan(rows, begin=2.0, deliveries=arriving).orderBy("ds").collect()
        assert [(r["qty"], r["inventory"]) for r in got] == expected


def test_accuracy_of_zero_actual(spark):
    schema = "series string, ds date, qty double"
    got = evaluation.accuracy(spark.createDataFrame([("a", date(2025, 1, 1), 5.0)], schema), spark.createDataFrame([("a", date(2025, 1, 1), 0.0)], schema)).first()
    assert (got["mape"], got["smape"], got["data_points"]) == (None, 200.0, 1)


def test_trend_of_short_series(spark):
    known = {"up": [10, 20, 30], "down": [30, 20, 10], "flat": [10, 10, 11], "two": [10, 12], "edge": [100, 110], "one": [5], "zero": [0], "four": [1, 2, 3, 4]}
    rows = [(k, date(2025, 1, i + 1), float(q)) for k, qs in known.items() for i, q in enumerate(qs)]
    got = {r["series"]: (r["z"], r["trend"]) for r in evaluation.mann_kendall(spark.createDataFrame(rows, "series string, ds date, qty double")).collect()}
    assert {k: t for k, (_, t) in got.items()} == {"up": "rising", "down": "falling", "flat": "stable", "two": "rising", "edge": "stable", "one": "rising", "zero": "stable", "four": "stable"}
    assert [k for k, (z, _) in got.items() if z is not None] == ["four"]


def test_daily_trend_and_autocorrelation_are_the_plain_loops(spark, tmp_path):
    r, lines, known = Random(7), [], {}
    for key, n in ((1, 3), (2, 13), (3, 14), (4, 40), (5, 61)):
        known[key] = [float(r.randrange(1, 30) + i * (key - 3) // 4) for i in range(n)]
        lines += [(key, datetime(2025, 1, 1) + timedelta(days=2 * i), q) for i, q in enumerate(known[key])]
    spark.createDataFrame(lines, "l_suppkey long, l_shipdate timestamp, l_quantity double").write.parquet(str(tmp_path / "lineitem.parquet"))
    trends = {x["series"]: (x["s"], x["z"], x["trend"]) for x in queries()["mann_kendall_daily"](spark, str(tmp_path)).collect()}
    acf = {(x["series"], x["lag"]): x["acf"] for x in queries()["autocorrelation_daily"](spark, str(tmp_path)).collect()}
    lags = set()
    for key, q in known.items():
        n, mean = len(q), sum(q) / len(q)
        s = sum((q[j] > q[i]) - (q[j] < q[i]) for i in range(n) for j in range(i + 1, n))
        z = (s - (s > 0) + (s < 0)) / (n * (n - 1) * (2 * n + 5) / 18) ** 0.5
        assert trends[key][0] == s
        if n < 4:
            first, second = q[0], (q[1] + q[2]) / 2
            assert trends[key][1:] == (None, "rising" if second > 1.1 * first else "falling" if second < 0.9 * first else "stable")
        else:
            assert abs(trends[key][1] - z) < 1e-4 and trends[key][2] == ("rising" if z > 1.96 else "falling" if z < -1.96 else "stable")
        for k in range(1, min(n // 2, 14) + 1) if n >= 14 else ():
            lags.add((key, k))
            assert abs(acf[key, k] - sum((q[i] - mean) * (q[i - k] - mean) for i in range(k, n)) / sum((x - mean) ** 2 for x in q)) < 1e-3
    assert set(acf) == lags and {t for *_, t in trends.values()} > {"stable"}


def test_sheet_operators(spark):
    cells = spark.createDataFrame([("s", 1, 1, "id"), ("s", 1, 2, "2025-01"), ("s", 2, 1, "p1"), ("s", 2, 2, "1,200"), ("s", 3, 1, None), ("s", 3, 2, "7")], "sheet string, row int, col int, value string")
    got = sheets.unpivot_header(sheets.clean(cells), ["id"], 1, r"^\d{4}").collect()
    assert [(r["id"], r["name"], r["qty"]) for r in got] == [("p1", "2025-01", 1200.0)]
    merges = spark.createDataFrame([("s", 2, 3, 1, 1)], "sheet string, min_row int, max_row int, min_col int, max_col int")
    assert sheets.fill_merged(cells, merges).filter("row = 3 and col = 1").first()["value"] == "p1"
    for text, day in (("45658", date(2025, 1, 1)), ("2025/01/02", date(2025, 1, 2)), ("31/12/2024", date(2024, 12, 31)), ("x", None)):
        assert one(spark, sheets.parse_date(F.lit(text))) == day


def test_retrieval_functions(spark):
    assert one(spark, retrieval.normalize_url(F.lit("https://h.example/a/B/?q=1#x"))) == "/a/B"
    assert one(spark, retrieval.tokens(F.lit("Ab 中文 c_1"))) == ["ab", "中", "文", "c_1"]
    a = spark.createDataFrame([(1, 10, 1), (1, 11, 2)], "query_id int, id int, rank int")
    fused = {r["id"]: r["score"] for r in retrieval.fuse(a, a.filter("id = 11").withColumn("rank", F.lit(1)), "id").collect()}
    assert abs(fused[11] - (1 / 61 + 1 / 60)) < 1e-12 and abs(fused[10] - 1 / 60) < 1e-12


def test_retention(spark):
    events = spark.createDataFrame([(1, date(2025, 1, 1)), (1, date(2025, 1, 8)), (2, date(2025, 1, 1))], "user_id int, day date")
    assert reporting.retention(events, 7).first()["retention"] == 0.5
    assert reporting.active_users(events, 7).filter("day = date'2025-01-07'").first()["users"] == 2


def test_order_gap_of_a_month_with_an_order_on_the_day_after_its_end(spark):
    """Where the tables meet in a shuffle, the unused share is computed too and must not divide by zero."""
    rows = [("a", date(2025, 11, 30), 4.0), ("a", date(2025, 12, 1), 7.0)]
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = series.order_gap_blend(spark.createDataFrame(rows, "series string, ds date, qty double").repartition(2), spark.createDataFrame([("a", 100.0, 50.0)], "series string, forecast double, delivered double"), monthly=True).collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)
    assert [tuple(r)[1:] for r in got] == [(date(2025, 11, 30), 4.0, "daily_order")]


def test_formula_functions_work_in_proportion_to_the_length(spark):
    """Sums of the whole array were written into the function of each element: 20,000 values took minutes."""
    q = [float(i * 7 % 11) for i in range(20_000)]
    df = spark.createDataFrame([(q,)], "q array<double>")
    a, ten = F.col("q"), F.array(F.lit(10.0))
    began = datetime.now()
    got = df.select(formula.deviation(a).alias("d"), formula.exponential_smoothing(a).alias("e"), formula.cumulative_sum(a).alias("c"), formula.inventory_planning(a, F.lit(500.0), F.transform(a, lambda _: F.lit(4.0))).alias("p"), formula.jit_fill(F.lit(200_000.0), a, F.transform(a, lambda x, i: F.when(i % 3 == 0, x).otherwise(0.0)), ten).alias("j")).first()
    assert (datetime.now() - began).total_seconds() < 40
    level, run, stock = [q[0]], [0.0 + q[0]], 500.0
    for x in q[1:]:
        level.append(x * 0.3 + level[-1] * 0.7)
        run.append(run[-1] + x)
    for x, net in zip(q, got["p"], strict=True):
        assert net == max(0.0, x - stock - 4.0)
        stock = max(0.0, stock + 4.0 - x)
    m = sum(q) / len(q)
    assert got["e"] == level and got["c"] == run and abs(got["d"] - (sum((x - m) ** 2 for x in q) / len(q)) ** 0.5) < 1e-9
    calls = [i % 3 == 0 and x > 0 for i, x in enumerate(q)]
    more = (200_000.0 - 10.0 - sum(q)) / calls.count(False)
    assert all(abs(y - (x if c else x + more)) < 0.006 for x, c, y in zip(q, calls, got["j"], strict=True))


def test_trend_sums_are_counted_by_sorting(spark):
    """20,000 rows have 200 million pairs, which took minutes one by one."""
    rng = Random(2)
    many = [float(rng.randint(0, 30)) for _ in range(500)]
    loop = sum((b > a) - (b < a) for i, a in enumerate(many) for b in many[i + 1 :])
    start = date(1960, 1, 1)
    rows = [("a", start + timedelta(i), q) for i, q in enumerate(many)] + [("b", start + timedelta(i), float(i % 2)) for i in range(20_000)] + [("c", start, 1.0), ("c", start + timedelta(1), None)]
    began = datetime.now()
    got = {r["series"]: r["s"] for r in evaluation.mann_kendall(spark.createDataFrame(rows, "series string, ds date, qty double")).collect()}
    assert got == {"a": loop, "b": 10_000, "c": None} and (datetime.now() - began).total_seconds() < 60


def test_rollup_groups_by_dates_not_by_texts(spark, capsys):
    rows = [("a", date(2025, 1, 31), 1.0), ("a", date(2025, 1, 1), 2.0), ("a", date(2025, 2, 1), 4.0), ("b", None, 8.0)]
    found = series.daily_monthly_rollup(spark.createDataFrame(rows, "series string, ds date, qty double"))
    got = sorted(tuple(r) for r in found.filter("period is not null").collect())
    assert got == [("a", "daily", "20250101", 2.0), ("a", "daily", "20250131", 1.0), ("a", "daily", "20250201", 4.0), ("a", "monthly", "202501", 3.0), ("a", "monthly", "202502", 4.0)]
    assert sorted(tuple(r) for r in found.filter("period is null").collect()) == [("b", "daily", None, 8.0), ("b", "monthly", None, 8.0)]
    capsys.readouterr()
    found.explain()
    assert "date_format" not in capsys.readouterr().out  # no text is made below the sums


def test_tasks_of_moves_grow_with_the_rows(spark, monkeypatch):
    d = "/root/testdata/sf0.001"
    one, rows = sorted(map(str, moves(spark, d).collect())), spark.read.parquet(f"{d}/lineitem.parquet").count()
    monkeypatch.setattr(series, "TASK_ROWS", 500)
    assert moves(spark, d).rdd.getNumPartitions() == -(-rows // 500) > 4  # before: as many as the session has for a shuffle, at any size
    assert sorted(map(str, moves(spark, d).collect())) == one
    assert series.dealt(spark.range(0), "id").rdd.getNumPartitions() == 1
