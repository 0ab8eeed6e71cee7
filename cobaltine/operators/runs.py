"""Stored forecasts of several kinds over many series in one plan: run, trial, dry run, evaluation.

Which skill a series asks for is a column.  The rows are dealt out by it once, written with
a folder for each branch; each preset and each expression is then a branch of one union that
reads its own folder only, and all Python skills together are one more.  What cannot run, or
gives nothing, is a row with an error, so a batch never fails for one of its series.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Mapping
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, NumericType

from ..sources.shared import dealt
from . import catalogue, evaluation
from .presets import PRESETS, Preset, forecast

#: distinct skills of a batch, each a branch of the plan; more are an error
MOST_SKILLS = 500


def by_expression(rows: DataFrame, body: str | Callable[[Column], Column]) -> DataFrame:
    """(series, ds, qty): an expression over each series' quantities, oldest first.

    A text is Spark SQL over ``qty`` (array), ``days`` (array of dates) and ``n``; a callable
    takes the column ``qty``, as those of ``functions.formula`` do.  An array gives one value
    for each of the following days, a number one value.  Null values are left out.
    """
    points = F.sort_array(F.collect_list(F.struct("ds", F.coalesce(F.col("qty").cast("double"), F.lit(0.0)).alias("qty"))))
    grouped = rows.groupBy("series").agg(points.alias("points"), F.max("ds").alias("last_ds"))
    known = grouped.select("series", "last_ds", F.col("points.qty").alias("qty"), F.col("points.ds").alias("days"), F.size("points").alias("n"))
    value = known.withColumn("value", F.expr(body) if isinstance(body, str) else body(F.col("qty")))
    kind = value.schema["value"].dataType
    if isinstance(kind, NumericType):
        value = value.withColumn("value", F.array("value"))
    elif not (isinstance(kind, ArrayType) and isinstance(kind.elementType, NumericType)):
        raise ValueError(f"the expression gives {kind.simpleString()}, no number or array of numbers")
    each = value.select("series", "last_ds", F.posexplode("value").alias("i", "x")).filter("x is not null")
    return each.select("series", F.date_add("last_ds", F.col("i") + 1).alias("ds"), F.col("x").cast("double").alias("qty"))


def wanted(asked: DataFrame, skills: DataFrame) -> list[Row]:
    """The distinct skills that are asked for, known or not: a catalogue's size at most, not the data's."""
    named = asked.select("skill_id").distinct().join(skills.withColumn("known", F.lit(True)), "skill_id", "left")
    found = named.limit(MOST_SKILLS + 1).collect()
    if len(found) > MOST_SKILLS:
        raise ValueError(f"more than {MOST_SKILLS} skills in one batch")
    return found


def refused(skill: Row) -> str | None:
    """Why a skill does not run at all."""
    if not skill["known"]:
        return "no such skill"
    if skill["status"] != "active":
        return f"the skill is {skill['status']}, not active"
    return None


def run(rows: DataFrame, asked: DataFrame, skills: DataFrame, inputs: Mapping[str, DataFrame] | None = None, known: Mapping[str, Preset] = PRESETS) -> DataFrame:
    """Runs for each series of ``asked`` (series, skill_id) the skill that it names, over ``rows`` (series, ds, qty).

    ``skills`` has skill_id, skill_type (preset, expression or python), status, body (name of
    the preset, expression, or code) and params, a JSON object of parameters of a preset or
    null; one row a skill.  ``inputs`` are tables (series, ...) that presets need; they are
    cut to the series of the branch.  A series may ask for several skills, and asking twice
    is asking once.  Returns series, skill_id, ds, qty and error: points have no error, and a
    series without a point has one row with the reason.
    """
    spark, inputs = rows.sparkSession, inputs or {}
    asked = asked.select("series", "skill_id").filter("series is not null").distinct()
    numbered = list(enumerate(wanted(asked, skills)))
    if not numbered:
        return asked.select("series", "skill_id", F.lit(None).cast("date").alias("ds"), F.lit(None).cast("double").alias("qty"), F.lit(None).cast("string").alias("error"))
    numbers = spark.createDataFrame([(s["skill_id"], n) for n, s in numbered], "asked_id string, branch int")
    placed = asked.join(F.broadcast(numbers), asked["skill_id"].eqNullSafe(numbers["asked_id"])).drop("asked_id")  # MOST_SKILLS rows at most
    routed = dealt(rows.select("series", "ds", "qty").join(placed.select("series", "branch"), "series"), "branch", "batch")

    errors, branches, codes = {}, [], {}
    for n, skill in numbered:
        if reason := refused(skill):
            errors[n] = reason
            continue
        mine = routed.filter(F.col("branch") == n).select("series", "ds", "qty")
        try:
            if skill["skill_type"] == "python":
                catalogue.check_code(skill["body"])
                codes[n] = skill["body"]
                continue
            if skill["skill_type"] == "expression":
                found = by_expression(mine, skill["body"])
            elif skill["skill_type"] == "preset":
                own = placed.filter(F.col("branch") == n).select("series")
                cut = {k: t.join(own, "series", "left_semi") for k, t in inputs.items()}
                found = forecast(mine, skill["body"], known, cut, **json.loads(skill["params"] or "{}"))
            else:
                raise ValueError(f"no skills of type {skill['skill_type']}")
            branches.append(found.select("series", F.lit(n).alias("branch"), F.col("ds").cast("date").alias("ds"), F.col("qty").cast("double").alias("qty"), F.lit(None).cast("string").alias("error")))
        except AnalysisException as error:
            errors[n] = f"{error.getCondition() or 'ANALYSIS'}: the expression or its input does not fit"
        except (ValueError, LookupError, TypeError) as error:
            errors[n] = f"{type(error).__name__}: {error}"
    if codes:
        branches.append(catalogue.run_python_by(routed.filter(F.col("branch").isin(*codes)), codes))

    # a series without data or result, or whose skill cannot run, has this row only
    reasons = F.create_map(*[F.lit(x) for pair in errors.items() for x in pair])[F.col("branch")] if errors else F.lit(None).cast("string")
    marks = placed.select("series", "branch", F.lit(None).cast("date").alias("ds"), F.lit(None).cast("double").alias("qty"), F.coalesce(reasons, F.lit("no result")).alias("error"), F.lit(True).alias("mark"))
    results = reduce(DataFrame.unionByName, [b.withColumn("mark", F.lit(False)) for b in branches], marks)
    both = results.withColumn("only", F.min("mark").over(Window.partitionBy("series", "branch"))).filter("only = mark")
    return both.join(F.broadcast(numbers), "branch").select("series", F.col("asked_id").alias("skill_id"), "ds", "qty", "error")


def trial(rows: DataFrame, skill_type: str, body: str | Callable[[Column], Column], inputs: Mapping[str, DataFrame] | None = None, **params) -> DataFrame:
    """Runs a skill that is stored nowhere over all series: series, ds, qty and error."""
    if callable(body):
        return by_expression(rows, body).withColumn("error", F.lit(None).cast("string"))
    skills = rows.sparkSession.createDataFrame([("trial", skill_type, "active", body, json.dumps(params))], "skill_id string, skill_type string, status string, body string, params string")
    asked = rows.select("series", F.lit("trial").alias("skill_id")).distinct()
    return run(rows, asked, skills, inputs).drop("skill_id")


def dry_run(rows: DataFrame, skill_type: str, body: str, series: int = 3, **params) -> list[str]:
    """What goes wrong on the first few series, each problem once; an empty list if all of them have a result.  The number of series is bounded on purpose."""
    few = rows.select("series").distinct().orderBy("series").limit(series)
    out = trial(rows.join(F.broadcast(few), "series"), skill_type, body, **params)
    problems = out.filter("error is not null").select("error").distinct().orderBy("error")
    return [r["error"] for r in problems.collect()] or ([] if few.take(1) else ["no series to try it on"])


def counts(results: DataFrame) -> DataFrame:
    """(skill_id, successes, errors, total) of the series of each skill; skill_id is null for all of them."""
    each = results.groupBy("series", "skill_id").agg((F.count("error") > 0).alias("failed"))
    summed = [F.count_if(~F.col("failed")).alias("successes"), F.count_if("failed").alias("errors"), F.count("*").alias("total")]
    return each.groupBy("skill_id").agg(*summed).unionByName(each.agg(*summed).withColumn("skill_id", F.lit(None).cast("string")))


def evaluate(results: DataFrame, actual: DataFrame) -> DataFrame:
    """MAE, MAPE, RMSE and sMAPE of each series and skill over the dates that forecast and ``actual`` (series, ds, qty) share."""
    return evaluation.accuracy(results.filter("error is null"), actual, by=("series", "skill_id"))
