"""Batches of several skills: dispatch, errors as rows, trial, dry run, evaluation."""

import threading
from datetime import date

import pytest

from cobaltine.functions import formula
from cobaltine.operators import catalogue, evaluation, runs

FIELDS = "series string, ds date, qty double"
SKILL = "skill_id string, skill_type string, status string, body string, params string"


@pytest.fixture
def rows(spark):
    return spark.createDataFrame([(s, date(2025, 1, d), float(d * k)) for s, k in (("a", 1), ("b", 2), ("c", 3)) for d in range(1, 11)] + [("d", date(2025, 1, 1), None)], FIELDS)


def test_a_batch_of_all_kinds(spark, rows):
    skills = spark.createDataFrame(
        [
            ("avg", "preset", "active", "moving average", '{"window": 2}'),
            ("calls", "preset", "active", "priority_fill", None),
            ("blend", "preset", "active", "monthly_daily_blend", None),
            ("bad params", "preset", "active", "moving_average", '{"width": 2}'),
            ("sum", "expression", "active", "aggregate(qty, 0D, (s, x) -> s + x)", None),
            ("text", "expression", "active", "'x'", None),
            ("unknown column", "expression", "active", "nothing + 1", None),
            ("py", "python", "active", "def forecast(points):\n    return [qty for _, qty in points][:2]", None),
            ("py2", "python", "active", "def forecast(points):\n    return []", None),
            ("forbidden", "python", "active", "import os\ndef forecast(points):\n    return 1", None),
            ("kind", "sql", "active", "1", None),
            ("old", "preset", "archived", "moving_average", None),
        ],
        SKILL,
    )
    asked = spark.createDataFrame([("a", s) for s in ("avg", "avg", "sum", "text", "unknown column", "forbidden", "kind", "old", "none", None, "bad params", "blend")] + [("b", "py"), ("c", "py2"), ("c", "calls"), ("d", "sum"), ("d", "py"), ("elsewhere", "avg"), (None, "avg")], "series string, skill_id string")
    calls = spark.createDataFrame([("c", date(2025, 1, 3), 500.0), ("a", date(2025, 1, 3), 1.0)], FIELDS)
    found = runs.run(rows, asked, skills, {"calls": calls}).cache()
    got: dict = {}
    for r in found.collect():
        got.setdefault((r["series"], r["skill_id"]), []).append((r["ds"], r["qty"]) if r["error"] is None else r["error"])
    got = {k: sorted(v) for k, v in got.items()}
    assert got[("a", "avg")] == [(date(2025, 1, 11), 9.5), (date(2025, 1, 12), 9.5)]
    assert got[("a", "sum")] == [(date(2025, 1, 11), 55.0)] and got[("d", "sum")] == [(date(2025, 1, 2), 0.0)]
    assert got[("b", "py")] == [(date(2025, 1, 11), 2.0), (date(2025, 1, 12), 4.0)] and got[("d", "py")] == [(date(2025, 1, 2), 0.0)]
    assert (date(2025, 1, 3), 500.0) in got[("c", "calls")] and len(got[("c", "calls")]) == 10
    errors = {k: v[0] for k, v in got.items() if isinstance(v[0], str)}
    assert errors[("elsewhere", "avg")] == errors[("c", "py2")] == "no result"
    assert errors[("a", "none")] == errors[("a", None)] == "no such skill" and errors[("a", "old")] == "the skill is archived, not active"
    assert errors[("a", "blend")] == "LookupError: monthly_daily_blend needs monthly, supply"
    assert errors[("a", "forbidden")].startswith("Refused: import") and "string" in errors[("a", "text")] and "sql" in errors[("a", "kind")]
    assert errors[("a", "unknown column")].startswith("UNRESOLVED_COLUMN") and "width" in errors[("a", "bad params")]
    assert len(got) == 17
    n = {r["skill_id"]: (r["successes"], r["errors"], r["total"]) for r in runs.counts(found).filter("skill_id in ('avg', 'py')").collect()}
    assert n == {"avg": (1, 1, 2), "py": (2, 0, 2)}
    assert runs.counts(found).filter("skill_id is null and total = 17").count() == 1


def test_batches_of_nothing(spark, rows):
    skills = spark.createDataFrame([("avg", "preset", "active", "moving_average", None)], SKILL)
    asked = spark.createDataFrame([("a", "avg")], "series string, skill_id string")
    assert not runs.run(rows, asked.limit(0), skills).collect()
    assert [r["error"] for r in runs.run(rows.limit(0), asked, skills).collect()] == ["no result"]
    with pytest.raises(ValueError, match="more than"):
        many = spark.range(runs.MOST_SKILLS + 1).selectExpr("'a' as series", "cast(id as string) as skill_id")
        runs.run(rows, many, skills)


def test_trials_and_dry_runs(spark, rows):
    got = runs.trial(rows.filter("series = 'b'"), "expression", lambda q: formula.moving_average(q, 2))
    assert [r["qty"] for r in got.orderBy("ds").collect()] == [2.0, *(2 * d - 1.0 for d in range(2, 11))]
    assert runs.dry_run(rows, "python", "def forecast(points):\n    return 1 / points[0][1]") == []
    assert runs.dry_run(rows, "python", "def forecast(points):\n    return [] if points[0][1] > 1 else missing") == ["NameError: name 'missing' is not defined", "no result"]
    assert runs.dry_run(rows, "expression", "nothing")[0].startswith("UNRESOLVED_COLUMN")
    assert runs.dry_run(rows.limit(0), "preset", "moving_average") == ["no series to try it on"]


def test_evaluation_of_a_batch(spark, rows):
    results = spark.createDataFrame([("a", "x", date(2025, 1, 1), 3.0, None), ("a", "y", date(2025, 1, 1), 1.0, None), ("b", "x", None, None, "no result"), ("c", "x", date(2026, 1, 1), 1.0, None)], "series string, skill_id string, ds date, qty double, error string")
    got = {(r["series"], r["skill_id"]): (r["mae"], r["data_points"]) for r in runs.evaluate(results, rows).collect()}
    assert got == {("a", "x"): (2.0, 1), ("a", "y"): (0.0, 1), ("c", "x"): (None, 0)}


def test_suggested_parameters(spark, rows):
    found = evaluation.suggested(evaluation.profile(rows), evaluation.mann_kendall(rows), evaluation.best_lag(evaluation.autocorrelation(rows)))
    got = {r["series"]: tuple(r)[1:] for r in found.collect()}
    assert got["a"] == (3, 0.5, 10, 7, 7, 1.96)
    compared = evaluation.compare({"x": rows.filter("series < 'c'")}).collect()
    assert {(r["series"], tuple(r["first_3"]), r["mean_total"]) for r in compared} == {("a", (1.0, 2.0, 3.0), 82.5), ("b", (2.0, 4.0, 6.0), 82.5)}


def test_two_writers_of_a_catalogue(spark, tmp_path):
    """Both commit at once, time and again: every change is there, numbers are in a row, and a name has one owner."""
    path, refused = str(tmp_path / "skills"), []

    def write(who):
        mine = catalogue.Catalogue(spark, path)
        for i in range(4):
            mine.create(f"{who}{i}", f"{who}{i}", "preset", "moving_average")
        try:
            mine.create(f"{who}-same", "same", "preset", "moving_average")
        except catalogue.Refused as error:
            refused.append(str(error))

    threads = [threading.Thread(target=write, args=(who,)) for who in "ab"]
    for t in threads:
        t.start()
    for t in threads:
        t.join(300)
    skills = catalogue.Catalogue(spark, path)
    assert {r["skill_id"] for r in skills.versions().collect()} - {"a-same", "b-same"} == {f"{w}{i}" for w in "ab" for i in range(4)}
    assert skills.log.entries() == [f"{i:012d}" for i in range(1, 10)]
    assert len(refused) == 1 and "the name is taken" in refused[0]


def test_a_batch_of_changes(spark, tmp_path):
    skills = catalogue.Catalogue(spark, str(tmp_path / "skills"))
    skills.seed(["holt_winters", "moving_average"])
    assert {(r["skill_id"], r["status"], r["version"], tuple(r["tags"])) for r in catalogue.current(skills.versions()).collect()} == {("preset-holt_winters", "active", 2, ("preset", "heavy")), ("preset-moving_average", "active", 2, ("preset",))}
    code = "def forecast(p):\n    return 1"
    changes = [
        ("new", "create", "n", "python", code, None, None), ("bad", "create", "b", "python", "import os", None, None), ("x", "create", "same", "preset", "p", ["t"], None), ("y", "create", "same", "preset", "p", None, None),
        ("preset-holt_winters", "rollback", None, None, None, None, 9), ("preset-moving_average", "update", None, None, "other", None, None), ("gone", "archive", None, None, None, None, None), ("z", "explode", None, None, None, None, None),
        ("twice", "create", "t", "preset", "p", None, None), ("twice", "activate", None, None, None, None, None), ("noname", "create", None, "preset", "p", None, None), (None, "create", "q", "preset", "p", None, None),
    ]
    got = {(r["skill_id"], r["action"]): (r["problem"], r["status"], r["version"]) for r in skills.commit(spark.createDataFrame(changes, catalogue.CHANGE)).collect()}
    assert got[("new", "create")] == (None, "draft", 1) and got[("preset-moving_average", "update")] == (None, "draft", 3) and got[("x", "create")][0] is None
    problems = {k[0]: v[0] for k, v in got.items() if v[0]}
    assert problems == {"bad": "import outside of the allowed modules", "y": "the name is taken", "preset-holt_winters": "no such version", "gone": "no such skill", "z": "no such change", "twice": "several changes of one skill", "noname": "the id is taken, or there is no name", None: "no such change"}
    before = skills.commits()
    assert skills.commit(spark.createDataFrame([("gone", "archive", None, None, None, None, None)], catalogue.CHANGE)).first()["problem"] == "no such skill"
    assert skills.commits() == before
