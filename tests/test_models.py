"""Models against seasonal data, autoregressions and short series; stored skills, workbooks, markdown."""

import io
import zipfile
from datetime import date, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from cobaltine.operators import catalogue, markdown, models, reporting, series, streamed
from cobaltine.sources import workbooks

START = date(2025, 1, 1)


def frame(spark, **values):
    rows = [(k, START + timedelta(days=i), None if v is None else float(v)) for k, x in values.items() for i, v in enumerate(x)]
    return spark.createDataFrame(rows, "series string, ds date, qty double")


def seasonal(n, noise=0.0):
    t = np.arange(n)
    return 100 + 0.5 * t + np.array([20, 5, -5, -10, 0, 10, -20])[t % 7] + noise * np.random.default_rng(3).normal(size=n)


def test_holt_winters_follows_trend_and_season(spark):
    truth = seasonal(91)
    got = models.holt_winters(frame(spark, a=truth[:84], b=[3, 5], c=[2, 4, 6, 8, 10])).orderBy("series", "ds").collect()
    a = [r["qty"] for r in got if r["series"] == "a"]
    assert len(a) == 7 and np.abs(np.array(a) - truth[84:]).max() < 1
    assert [(r["ds"], r["qty"]) for r in got if r["series"] == "b"] == [(START + timedelta(days=2), 4.0), (START + timedelta(days=3), 4.0)]
    assert [r["qty"] for r in got if r["series"] == "c"] == pytest.approx([12, 14, 16, 18, 20, 22, 24], abs=0.1)


def test_holt_winters_beats_the_last_mean_on_noise():
    x = seasonal(147, noise=3.0)
    fitted = np.abs(models.holt_winters_values(x[:140], 7, 7) - x[140:]).mean()
    assert fitted < 5 and fitted < np.abs(x[133:140].mean() - x[140:]).mean() / 2


def test_arima_recovers_an_autoregression():
    rng, x = np.random.default_rng(5), [50.0]
    for _ in range(399):
        x.append(20 + 0.6 * x[-1] + rng.normal())
    x = np.array(x)
    got = models.arima_values(x, 30)
    assert abs(got[-1] - 50) < 1.5 and abs(got[0] - (20 + 0.6 * x[-1])) < 1
    line = models.arima_values(10 + 2.0 * np.arange(60), 5)
    assert line == pytest.approx([130, 132, 134, 136, 138], abs=1)


def test_routes_choose_by_length(spark):
    data = frame(spark, long=seasonal(40), middle=[1, 2, 3, 4, 5], short=[4, None])
    for route in (models.auto_seasonal, models.auto_regressive, models.auto_arima, models.trend_fallback):
        got = {(r["series"], (r["ds"] - START).days): r["qty"] for r in route(data).collect()}
        assert all(q >= 0 and np.isfinite(q) for q in got.values())
        assert {s for s, _ in got} == {"long", "middle", "short"} and len([1 for s, _ in got if s == "long"]) == 7
    assert {r["qty"] for r in models.auto_seasonal(data).filter("series = 'short'").collect()} == {2.0}
    assert [r["qty"] for r in models.auto_seasonal(data).filter("series = 'middle'").orderBy("ds").collect()] == [6, 7, 8, 9, 10]
    assert [round(r["qty"], 2) for r in models.auto_regressive(data).filter("series = 'short'").collect()] == [2.6] * 7


def test_models_of_empty_and_constant_series(spark):
    empty = frame(spark, a=[1]).filter("false")
    for route in (models.holt_winters, models.auto_arima, models.auto_seasonal, models.auto_regressive):
        assert route(empty).count() == 0
        assert {r["qty"] for r in route(frame(spark, a=[7] * 30)).collect()} == {7.0}


def test_topdown_by_product(spark):
    make = spark.createDataFrame
    volumes, shares = make([("b", 2_000_000.0)], "brand string, volume double"), make([("b", "brake", 0.15)], "brand string, product string, share double")
    delivered = make([("brake", "p1", 2500.0), ("brake", "p2", 1550.0)], "product string, part string, qty double")
    planned = make([("brake", "new", m, 5000.0) for m in range(4, 13)], "product string, part string, month int, qty double")
    got = series.topdown_by_product(volumes, shares, delivered, planned, make([(1, 0.85)], "month int, factor double"))
    at = {(r["part"], r["month"]): r["qty"] for r in got.collect()}
    assert len(at) == 33 and at["new", 4] == 5000.0
    assert at["p1", 1] == round(255_000 * 2500 / 4050 / 12 * 0.85, 2) and at["p2", 2] == round(255_000 * 1550 / 4050 / 12, 2)


CODE = "import math\ndef forecast(points):\n    if points[0][1] < 0:\n        raise ValueError('negative')\n    return [math.fsum(q for _, q in points)] * 2\n"


def test_python_skills_isolate_errors(spark):
    got = catalogue.run_python(frame(spark, a=[1, 2], b=[-1]), CODE).orderBy("series", "ds").collect()
    assert [(r["series"], r["ds"], r["qty"], r["error"]) for r in got] == [("a", date(2025, 1, 3), 3.0, None), ("a", date(2025, 1, 4), 3.0, None), ("b", None, None, "ValueError: negative")]


@pytest.mark.parametrize("code", ["import os", "from . import x", "from math import *", "eval('1')", "x.__class__", "__builtins__", "def f(:", "x = 1"])
def test_code_check_refuses(code):
    with pytest.raises(catalogue.Refused):
        catalogue.check_code(code + ("" if code in ("x = 1", "def f(:") else "\ndef forecast(p): return []"))


def test_skill_life_cycle(spark, tmp_path):
    skills = catalogue.Catalogue(spark, str(tmp_path / "skills"))
    skills.create("s1", "total", "python", CODE)
    with pytest.raises(catalogue.Refused):
        skills.activate("s1")
    with pytest.raises(catalogue.Refused):
        skills.create("s2", "total", "preset", "holt_winters")
    skills.review("s1")
    assert skills.activate("s1")["status"] == "active"
    skills.update("s1", body=CODE + "\n")
    assert skills.get("s1")["status"] == "draft"
    skills.create("s2", "seasonal", "preset", "holt_winters")
    assert [r["skill_id"] for r in catalogue.find(skills.versions(), tag="heavy").collect()] == ["s2"]
    back = skills.rollback("s1", 1)
    assert (back["version"], back["body"], back["status"]) == (5, CODE, "draft")
    assert skills.archive("s2")["status"] == "archived"
    assert catalogue.find(skills.versions(), skill_type="preset", status="archived").count() == 1
    with pytest.raises(catalogue.Refused):
        skills.rollback("s1", 99)


TEXT = """before
# A
intro
```
# no heading
| x | y |
|---|---|
| 1 | 2 |
```
### Deep
d
## B
| k | v |
|---|---|
| 1 |
| 2 | 3 | 4 |
# C
## B
"""


def test_markdown_tables(spark):
    docs = spark.createDataFrame([(1, TEXT), (2, None), (3, "")], "doc int, text string")
    got = {r["section"]: r for r in markdown.sections(docs, "doc", "text").filter("doc = 1").collect()}
    assert {s: (r["title"], r["level"], r["parent"], r["path"]) for s, r in got.items()} == {
        0: ("", 0, 0, [""]), 1: ("A", 1, 0, ["A"]), 2: ("Deep", 3, 1, ["A", "Deep"]), 3: ("B", 2, 1, ["A", "B"]), 4: ("C", 1, 0, ["C"]), 5: ("B", 2, 4, ["C", "B"]),
    }
    assert got[1]["body"].startswith("intro\n```\n# no heading") and got[0]["body"] == "before"
    rows = markdown.table_rows(docs, "doc", "text").orderBy("line").collect()
    assert [(r["headers"], r["cells"]) for r in rows] == [(["k", "v"], ["1", ""]), (["k", "v"], ["2", "3 | 4"])]
    chunks = {r["chunk_id"]: (r["chunk_type"], r["body"]) for r in markdown.chunks(docs, "doc", "text").collect()}
    assert chunks["a/b#row-2"] == ("table_row", "k: 2\nv: 3 | 4") and "c/b" in chunks and "section" in chunks
    assert markdown.sections(docs, "doc", "text").filter("doc > 1").count() == 0


def test_workbook_cells(spark, tmp_path):
    parts = {
        "xl/workbook.xml": '<workbook xmlns="m" xmlns:r="r"><sheets><sheet name="Plan" r:id="r1"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": '<Relationships xmlns="p"><Relationship Id="r1" Target="worksheets/sheet1.xml"/></Relationships>',
        "xl/sharedStrings.xml": '<sst xmlns="m"><si><t>part</t></si><si><r><t>a</t></r><r><t>b</t></r></si></sst>',
        "xl/worksheets/sheet1.xml": '<worksheet xmlns="m"><cols><col min="3" max="4" hidden="1"/></cols><sheetData><row r="1"><c r="A1" t="s"><v>0</v></c><c r="AB1"><v>1.5</v></c></row>'
        '<row r="2" hidden="1"><c r="A2" t="s"><v>1</v></c><c r="B2" t="b"><v>1</v></c><c r="C2" t="inlineStr"><is><t>in</t></is></c><c r="D2"/></row></sheetData><mergeCells><mergeCell ref="A1:A2"/></mergeCells></worksheet>',
    }
    with zipfile.ZipFile(tmp_path / "x.xlsx", "w") as archive:
        for name, text in parts.items():
            archive.writestr(name, text)
    (tmp_path / "bad.xlsx").write_bytes(io.BytesIO(b"no archive").getvalue())
    book = workbooks.workbook(spark, str(tmp_path))
    assert {(r["row"], r["col"]): r["value"] for r in workbooks.cells(book).collect()} == {(1, 1): "part", (1, 28): "1.5", (2, 1): "ab", (2, 2): "true", (2, 3): "in", (2, 4): None}
    assert [tuple(r)[1:] for r in workbooks.merges(book).collect()] == [(1, 2, 1, 1)]
    assert [r["row"] for r in workbooks.hidden_rows(book).collect()] == [2]
    assert sorted(r["col"] for r in workbooks.hidden_cols(book).collect()) == [3, 4]


def test_compaction_and_identity(spark):
    rows = [("long", i, "user" if i % 2 == 0 else "assistant", f"text  {i}") for i in range(10)] + [("short", 0, "user", None)]
    talk = spark.createDataFrame(rows, "conv_id string, turn int, role string, text string")
    got = reporting.compacted(talk, 8, 4).orderBy("conv_id", "turn").collect()
    assert [(r["conv_id"], r["turn"]) for r in got] == [("long", t) for t in range(5, 10)] + [("short", 0)]
    assert got[0]["text"] == "Turns: 10, user: 5, assistant: 5\nGoal: text 0\nLatest: text 8"
    assert {r["field"]: r["values"] for r in reporting.identity_summary(talk, ["conv_id", "role"], 1).collect()} == {"conv_id": "long", "role": "assistant"}
    assert spark.range(1).select(reporting.shortened(F.lit(" a  bc def"), 5)).first()[0] == "a bc…"


def test_several_series_at_once_are_fitted_as_each_alone(spark):
    """Series of all lengths share the steps of the recursion; a call a step and series took most of the time."""
    rng = np.random.default_rng(5)
    xs = [np.round(rng.gamma(2.0, 20.0, n)) for n in (40, 4, 14, 13, 120, 40, 7)]
    together = models.holt_winters_many(xs, 7, 7)
    assert all(np.array_equal(got, models.holt_winters_values(x, 7, 7)) for x, got in zip(xs, together, strict=True))
    many = frame(spark, **{f"s{i:02d}": list(xs[i % 7]) for i in range(models.TOGETHER + 9)})
    got = {}
    for r in models.holt_winters(many).orderBy("series", "ds").collect():
        got.setdefault(r["series"], []).append(r["qty"])
    assert len(got) == models.TOGETHER + 9
    for i in range(models.TOGETHER + 9):
        assert np.allclose(got[f"s{i:02d}"], np.maximum(together[i % 7], 0), atol=0.006)


def test_shocks_and_roots_are_found_once(monkeypatch):
    """The long autoregressions are few and shared by the orders, and most roots follow from two bounds."""
    rng = np.random.default_rng(6)
    for most in (1 + 1e-6, 0.999):
        for c in rng.normal(0, 0.7, (300, 3)):
            for n in (1, 2, 3):
                assert models.inside(c[:n], most) == bool((np.abs(np.roots(np.r_[1, -c[:n]])) <= most).all())
    calls = {"lstsq": 0, "roots": 0}
    for module, name in ((np.linalg, "lstsq"), (np, "roots")):
        def counted(*args, own=getattr(module, name), name=name, **options):
            calls[name] += 1
            return own(*args, **options)

        monkeypatch.setattr(module, name, counted)
    assert models.arima_values(np.round(rng.gamma(2, 200, 80)), 7) is not None
    assert calls["lstsq"] <= 40 and calls["roots"] < 36


def test_series_keep_their_tasks(spark):
    rows = spark.createDataFrame([(f"s{i}", date(2025, 1, d), float(d)) for i in range(40) for d in range(1, 6)], "series string, ds date, qty double")
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert streamed.in_runs(rows).rdd.getNumPartitions() == tasks  # before: little rows were merged to one task
    assert models.by_length(rows)(F.col("n") >= 4).rdd.getNumPartitions() == tasks


def test_shocks_taken_off_step_by_step():
    rng = np.random.default_rng(2)
    for ma in ([0.5], [0.5, -0.2], [0.4, 0.3, -0.6], [0.1, 0.2, 0.3, 0.4]):
        for known in range(len(ma), 6):
            plain = rng.normal(size=30).tolist()
            got = models.without_shocks(list(plain), ma, known)
            for t in range(known, len(plain)):
                plain[t] -= sum(c * plain[t - i] for i, c in enumerate(ma, 1))
            assert np.allclose(got, plain, rtol=1e-12, atol=1e-12)
