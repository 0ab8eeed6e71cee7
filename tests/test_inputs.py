"""Dates and sheets as people write them, lookups, blends of other inputs, months ahead."""

import calendar
from collections import Counter
from datetime import date

import pytest
from pyspark.sql import functions as F

from cobaltine.operators import evaluation, lookup, models, retrieval, series, sheets


def test_dates_in_order_of_priority(spark):
    wanted = {
        "2025/1/2": date(2025, 1, 2), "2025年01月02日": date(2025, 1, 2), "2025年1月2日": date(2025, 1, 2), " 45658 ": date(2025, 1, 1), "45658.75": date(2025, 1, 1), "2025-01": None, "20250102": date(2025, 1, 2),
        "03/04/2025": date(2025, 4, 3), "12/31/2025": date(2025, 12, 31), "2025.1.2": date(2025, 1, 2), "2025-01-02 03:04:05": date(2025, 1, 2), "2025-01-02T03:04:05": None, "2025-13-01": None, "0": None, "73416": None, "x": None, "": None, None: None,
    }
    df = spark.createDataFrame([(k,) for k in wanted], "v string")
    assert {r["v"]: r["d"] for r in df.select("v", sheets.parse_date(F.col("v")).alias("d")).collect()} == wanted


def test_cells(spark):
    df = spark.createDataFrame([(" 12.0 ",), ("A1",), ("true",), (" ",), (None,), ("-3.9",), ("1,200.5",), ("2025-01-02T00:00:00",)], "v string")
    got = df.select(sheets.id_value(F.col("v")), sheets.int_value(F.col("v")), sheets.header_text(F.col("v"))).collect()
    assert list(map(tuple, got)) == [("12", 12, "12.0"), ("A1", None, "A1"), (None, None, "true"), (None, None, None), (None, None, None), ("-3.9", -3, "-3.9"), ("1,200.5", 1200, "1,200.5"), ("2025-01-02T00:00:00", None, "2025-01-02")]
    with pytest.raises(ValueError, match="plan"):
        sheets.required(df.limit(0), "plan")


def test_lookups(spark):
    row = {"Path": "`/a/{id}` and `/a/b`", "Method": "GET", "message": "⚠ **disk full**", "code": "`E1`", "Value": "on, off/x"}
    chunks = spark.createDataFrame([("c1", "table_row", list(row), row), ("c2", "table_row", ["url", "code"], {"url": "/a/b, /z", "code": "E1"}), ("c3", "section", None, None)], "chunk_id string, chunk_type string, headers array<string>, row map<string,string>")
    requests = spark.createDataFrame([(1, "http://h/a/b/?q=1", {"Error": " `E1` ", "State": "off", "Note": "the DISK FULL again"}), (2, "/a/7", {"error": None}), (3, "", None)], "query_id long, url string, payload map<string,string>")
    got = [tuple(r) for r in lookup.hits(requests, chunks, ("error",), ("state",), ("note",)).orderBy("query_id", "rank").collect()]
    assert got == [(1, "c1", "route", 1), (1, "c2", "route", 2), (1, "c1", "errorCode", 3), (1, "c1", "status", 4), (1, "c1", "remark", 5), (2, "c1", "route", 1)]
    assert lookup.routes(chunks).filter("chunk_id = 'c1'").select("method").distinct().collect()[0][0] == "GET"


def test_retrieve(spark):
    chunks = spark.createDataFrame([(i, t, m) for i, (t, m) in enumerate([("red fox", "x"), ("red dog", "y"), ("blue cat", "x"), ("green owl", "y"), ("grey elk", "y")])], "chunk_id long, text string, module string")
    vectors = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(5)] + [(9, None)], "chunk_id long, vector array<double>")
    queries = spark.createDataFrame([(7, "red", "y", [0.0, 1.0])], "query_id long, text string, module string, vector array<double>")
    got = [r["chunk_id"] for r in retrieval.retrieve(queries, chunks, vectors, top_k=3, known=spark.createDataFrame([(7, 0)], "query_id long, chunk_id long")).orderBy("rank").collect()]
    assert got == [1, 3, 4]
    near = retrieval.dense(queries, vectors, "chunk_id", 2).orderBy("rank").collect()
    assert [(r["chunk_id"], r["distance"]) for r in near] == [(0, 0.0), (1, 1.0)]


def test_last_of_a_date_counts(spark):
    make = lambda rows: spark.createDataFrame([("s", date(2025, 1, d), q, n) for n, (d, q) in enumerate(rows)], "series string, ds date, qty double, n int")
    got = evaluation.accuracy(make([(1, 5.0), (1, 8.0), (2, 4.0)]), make([(1, 1.0), (1, 10.0), (2, 4.0)]), order="n").first()
    assert (got["mae"], got["data_points"]) == (1.0, 2)


def test_blend_from_one_forecast_or_none(spark):
    demand = spark.createDataFrame([("a", date(2025, 1, 2), 4.0), ("b", date(2025, 2, 3), 6.0), ("b", date(2025, 2, 4), 0.0), ("c", date(2025, 1, 1), 0.0)], "series string, ds date, qty double")
    totals = spark.createDataFrame([("a", 34.0), ("b", 0.0)], "series string, forecast double")
    none = spark.createDataFrame([], "series string, month date, forecast double")
    got = series.blend_forecasts(demand, totals, none)
    assert sorted(map(tuple, got.collect())) == [("a", date(2025, 1, 1), 34.0), ("b", date(2025, 2, 1), 6.0)]
    days = series.monthly_daily_blend(demand.filter("series = 'a'"), got.filter("series = 'a'"), demand.limit(0)).collect()
    assert sorted({r["qty"] for r in days}) == [1.0, 4.0] and len(days) == 31


def test_models_go_on_by_months(spark):
    rows = [("s", date(2023 + i // 12, 1 + i % 12, 1), 10.0 + i % 12) for i in range(36)]
    df = spark.createDataFrame(rows, "series string, ds date, qty double")
    for model in (models.holt_winters, models.auto_arima, models.auto_regressive):
        assert [r["ds"] for r in model(df, horizon=3, unit="month").orderBy("ds").collect()] == [date(2026, m, 1) for m in (1, 2, 3)]
    assert [r["ds"] for r in models.holt_winters(df.limit(3), horizon=2, unit="month").orderBy("ds").collect()] == [date(2023, 4, 1), date(2023, 5, 1)]


def test_lookups_shuffle_no_pairs_of_requests_and_chunks(spark, monkeypatch, capsys):
    """Requests that ask for the same share their hits, in several arrays, and ranks go on from layer to layer."""
    monkeypatch.setattr(lookup, "BLOCK", 2)
    rows = [(i, "table_row", ["path", "message", "code", "value"], {"path": "`/a/{id}`, `/a/b`" if i % 2 else "`/a/{id}`", "message": "disk full", "code": f"E{i % 3}", "value": f"s{i % 2}"}) for i in range(1, 8)]
    chunks = spark.createDataFrame(rows, "chunk_id long, chunk_type string, headers array<string>, row map<string,string>")
    asked = [(q, "/a/b" if q < 3 else "/a/x", {"error": f"E{q % 2}", "state": "s1", "note": "the disk full" if q == 4 else ""}) for q in range(1, 5)]
    found = lookup.hits(spark.createDataFrame(asked, "query_id long, url string, payload map<string,string>"), chunks, ("error",), ("state",), ("note",))
    got = {}
    for r in found.orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["layer"], r["chunk_id"]))
    for q, url, payload in asked:
        ids = range(1, 8)
        want = [("route", i) for i in sorted(ids, key=lambda i: (-(i % 2), i))] if url == "/a/b" else [("route", i) for i in ids]
        want += [("errorCode", i) for i in ids if f"E{i % 3}" == payload["error"]] + [("status", i) for i in ids if i % 2] + [("remark", i) for i in ids if payload["note"]]
        assert got[q] == [(n, *w) for n, w in enumerate(want, 1)]
    capsys.readouterr()
    found.explain()
    assert not any("query_id" in line and "chunk_id" in line for line in capsys.readouterr().out.splitlines() if "Exchange" in line)


def test_lookups_take_inputs_apart_once(spark):
    """Chunks are read once, requests once for their urls and once for their payloads; without keys there are routes only."""
    names, read = ("requests", "chunks"), {k: spark.sparkContext.accumulator(0) for k in ("requests", "chunks")}

    def counted(rows, schema, counter):
        def seen(batches):
            for batch in batches:
                counter.add(batch.num_rows)
                yield batch

        return spark.createDataFrame(rows, schema).mapInArrow(seen, schema)

    row = {"path": "`/a/{id}`", "message": "disk full", "code": "E1", "value": "s1"}
    asked = [(q, f"/a/{q}", {"error": "E1", "state": "s1", "note": "disk full"}) for q in range(20)]
    inputs = counted(asked, "query_id long, url string, payload map<string,string>", read["requests"]), counted([(i, "table_row", list(row), row) for i in range(10)], "chunk_id long, chunk_type string, headers array<string>, row map<string,string>", read["chunks"])
    assert lookup.hits(*inputs, ("error",), ("state",), ("note",)).count() == 20 * 10 * 4
    assert [read[k].value for k in names] == [40, 10]  # before: requests five times, chunks seven times
    assert {tuple(r) for r in lookup.hits(*inputs).collect()} == {(q, i, "route", i + 1) for q in range(20) for i in range(10)}


def test_lookups_deal_what_is_put_out_by_its_rows(spark, monkeypatch):
    """What all requests ask for is put out by several tasks, whole and in order."""
    monkeypatch.setattr(lookup, "BLOCK", 5)
    monkeypatch.setattr(lookup, "TASK_ROWS", 20, raising=False)
    chunks = spark.createDataFrame([(i, "table_row", ["code", "message"], {"code": "E1", "message": "m"}) for i in range(10)], "chunk_id long, chunk_type string, headers array<string>, row map<string,string>")
    asked = spark.createDataFrame([(q, "", {"error": "E1"}) for q in range(40)], "query_id long, url string, payload map<string,string>")
    found = lookup.hits(asked, chunks, ("error",)).withColumn("task", F.spark_partition_id()).collect()
    assert sorted(tuple(r)[:4] for r in found) == [(q, i, "errorCode", i + 1) for q in range(40) for i in range(10)]
    assert max(Counter(r["task"] for r in found).values()) <= 100  # before: one task for all 400


def test_blend_shuffles_once_and_keeps_gaps(spark):
    """Against a plain version: months without a forecast between others, full months, supply outside of the calendar."""
    day = lambda m, d: date(2025, m, d)
    asked = {("a", day(1, 30)): 4.0, ("a", day(3, 2)): 5.0, ("a", day(5, 9)): 7.0, ("b", day(2, 10)): None, ("c", day(4, 4)): 1.0} | {("d", day(2, i)): 1.0 for i in range(1, 29)}
    months = {("a", day(2, 1)): 56.0, ("a", day(4, 1)): -30.0, ("b", day(2, 1)): 29.0, ("d", day(2, 1)): 99.0}
    came = {("a", day(1, 2)): 1000.0, ("a", day(2, 3)): 20.0, ("a", day(3, 31)): 3.0, ("a", day(5, 1)): 1000.0, ("b", day(1, 31)): 9.0, ("b", day(2, 28)): 2.0}
    make = lambda rows, names: spark.createDataFrame([(*k, v) for k, v in rows.items()], f"series string, {names}")
    found = series.monthly_daily_blend(make(asked, "ds date, qty double"), make(months, "month date, forecast double"), make(came, "ds date, qty double"), 10.0)
    assert "Join" not in found._jdf.queryExecution().toString()  # before: three joins, each with a shuffle of the whole calendar
    wanted = set()
    for s, begin, end in (("a", day(1, 30), day(4, 30)), ("b", day(2, 1), day(2, 28)), ("d", day(2, 1), day(2, 28))):
        stock = 10.0
        for n in range(begin.toordinal(), end.toordinal() + 1):
            now = date.fromordinal(n)
            of_month = {k: v for k, v in asked.items() if k[0] == s and k[1].month == now.month}
            free = calendar.monthrange(2025, now.month)[1] - len(of_month)
            forecast = months.get((s, now.replace(day=1)))
            fill = (forecast - sum(v or 0.0 for v in of_month.values())) / free if forecast is not None and free else 0.0
            known = asked.get((s, now))
            raw = stock + came.get((s, now), 0.0) - (fill if known is None else known)
            stock = max(0.0, raw)
            wanted.add((s, now, round(max(0.0, -raw), 2) + 0.0, round(raw, 2) + 0.0))
    got = [(r["series"], r["ds"], r["qty"], r["balance"]) for r in found.collect()]
    assert len(got) == len(wanted)
    for x, y in zip(sorted(got), sorted(wanted), strict=True):
        assert x[:2] == y[:2] and x[2:] == pytest.approx(y[2:], abs=0.011)
