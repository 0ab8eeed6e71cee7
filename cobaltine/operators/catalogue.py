"""Stored forecasts: a log of versions with several writers, the life cycle over it, and Python ones run by series.

A change appends a version; the current state of a skill is its highest version.  So the
table needs no update in place and any version can be restored.  Changes come as a frame and
are decided by joins with the current state.
"""

from __future__ import annotations

import ast
import builtins
import signal
from collections.abc import Iterable
from contextlib import contextmanager
from datetime import date, timedelta
from uuid import uuid4

import pandas as pd
from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SCHEMA = "skill_id string, version int, name string, skill_type string, status string, body string, tags array<string>, action string"
#: fixed values: modules that code may import, names it may not call, builtins it has
MODULES = ("math", "statistics", "numpy", "pandas", "scipy", "sklearn", "statsmodels")
CALLS = ("eval", "exec", "open", "compile", "input", "globals", "locals", "vars", "dir", "getattr", "setattr", "delattr", "__import__", "breakpoint", "help")
BUILTINS = ("abs", "all", "any", "bool", "dict", "enumerate", "float", "int", "len", "list", "map", "max", "min", "pow", "range", "round", "set", "sorted", "str", "sum", "tuple", "zip", "print", "isinstance", "type")
#: fixed values: models that take long
HEAVY = ("auto_arima", "auto_regressive", "auto_seasonal", "holt_winters")


class Refused(ValueError):
    """A change that the life cycle or the check of the code does not allow."""


def check_code(code: str) -> None:
    """Raises Refused for code with foreign imports, blocked calls, dunder names or no ``forecast``.

    It keeps honest code within bounds.  It is no security boundary: review the code, and run
    it only where whoever wrote it may run code anyway.
    """
    try:
        parsed = ast.parse(code)
    except SyntaxError as error:
        raise Refused(f"line {error.lineno}: {error.msg}") from error
    for node in ast.walk(parsed):
        match node:
            case ast.Import(names=names) if any(n.name.split(".")[0] not in MODULES for n in names):
                raise Refused("import outside of the allowed modules")
            case ast.ImportFrom(module=module, names=names, level=level) if level or (module or "").split(".")[0] not in MODULES or any(n.name == "*" for n in names):
                raise Refused("import outside of the allowed modules")
            case ast.Call(func=ast.Name(id=name)) if name in CALLS:
                raise Refused(f"call of {name}")
            case ast.Attribute(attr=name) | ast.Name(id=name) if name.startswith("__"):
                raise Refused(f"use of {name}")
    if not any(isinstance(node, ast.FunctionDef) and node.name == "forecast" for node in parsed.body):
        raise Refused("no function forecast")


def points(result: object, after) -> list[tuple]:
    """(ds, qty) of what a skill returned: dicts with date and qty or value, numbers, or one number; nothing else counts."""
    if isinstance(result, int | float):
        result = [result]
    if not isinstance(result, Iterable):
        return []
    found, result = [], list(result)
    for i, x in enumerate(result):
        if isinstance(x, dict):
            found.append((pd.Timestamp(x.get("date", after + timedelta(days=i + 1))).date(), float(x.get("qty", x.get("value", 0)))))
        elif isinstance(x, int | float):
            found.append((after + timedelta(days=i + 1), float(x)))
    return found


class TooLong(BaseException):
    """Raised inside a skill at its time limit; no ``except Exception`` of the skill catches it."""


@contextmanager
def time_limit(seconds: float):
    """Ends Python code after some time, and again every second should it go on.  Only for the main thread, in which workers run functions; one call into native code is not cut off."""

    def stop(*_):
        raise TooLong

    before = signal.signal(signal.SIGALRM, stop)
    signal.setitimer(signal.ITIMER_REAL, seconds, 1.0)
    try:
        yield
    finally:
        signal.setitimer(signal.ITIMER_REAL, 0)
        signal.signal(signal.SIGALRM, before)


def skill_names() -> dict[str, object]:
    """What code finds when it starts: its builtins, exceptions, imports of the allowed modules only, date and timedelta."""

    def bring(name: str, *rest):
        if name.split(".")[0] not in MODULES:
            raise ImportError(f"import of {name}")
        return __import__(name, *rest)

    errors = {n: v for n, v in vars(builtins).items() if isinstance(v, type) and issubclass(v, Exception)}
    return {"__builtins__": {n: getattr(builtins, n) for n in BUILTINS} | errors | {"__import__": bring}, "__name__": "skill", "date": date, "timedelta": timedelta}


def called(code: str, group: pd.DataFrame, seconds: float) -> list[tuple]:
    """(ds, qty, error) of ``forecast(points)`` over one series, rows in order of ds."""
    names = skill_names()
    try:
        with time_limit(seconds):
            exec(compile(code, "<skill>", "exec"), names)  # noqa: S102
            found = points(names["forecast"](list(zip(group["ds"], group["qty"], strict=True))), group["ds"].iloc[-1])
        return [(ds, qty, None) for ds, qty in found]
    except TooLong:
        return [(None, None, f"TooLong: {seconds:g} s")]
    except Exception as error:  # what a skill raises is its result
        return [(None, None, f"{type(error).__name__}: {error}")]


def run_python_by(rows: DataFrame, codes: dict[int, str], seconds: float = 30.0) -> DataFrame:
    """(series, branch, ds, qty, error): calls the skill of each row's ``branch``, once a series with its (date, qty) pairs in order.

    A series whose call fails, or takes longer than ``seconds``, gives one row with the error
    and no date; the others go on.
    """
    for code in codes.values():
        check_code(code)

    def call(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("ds")
        out = pd.DataFrame(called(codes[int(group["branch"].iloc[0])], group, seconds), columns=["ds", "qty", "error"])
        return out.assign(series=group["series"].iloc[0], branch=group["branch"].iloc[0])[["series", "branch", "ds", "qty", "error"]]

    key = rows.schema["series"].dataType.simpleString()
    given = rows.select("series", "branch", "ds", F.coalesce("qty", F.lit(0.0)).alias("qty"))
    return given.groupBy("series", "branch").applyInPandas(call, f"series {key}, branch int, ds date, qty double, error string")


def run_python(series: DataFrame, code: str, seconds: float = 30.0) -> DataFrame:
    """(series, ds, qty, error) of one skill over all series, as ``run_python_by``."""
    return run_python_by(series.withColumn("branch", F.lit(0)), {0: code}, seconds).drop("branch")


def current(versions: DataFrame) -> DataFrame:
    """The highest version of each skill."""
    back = F.row_number().over(Window.partitionBy("skill_id").orderBy(F.desc("version")))
    return versions.withColumn("back", back).filter("back = 1").drop("back")


def find(versions: DataFrame, tag: str | None = None, skill_type: str | None = None, status: str | None = None) -> DataFrame:
    """Current skills that meet all the conditions given."""
    found = current(versions)
    if tag is not None:
        found = found.filter(F.array_contains("tags", tag))
    if skill_type is not None:
        found = found.filter(F.col("skill_type") == skill_type)
    return found if status is None else found.filter(F.col("status") == status)


CHANGE = "skill_id string, action string, name string, skill_type string, body string, tags array<string>, to_version int"


def code_problem(code: Column) -> Column:
    """What ``check_code`` has against some code; null if nothing."""

    def check(codes: pd.Series) -> pd.Series:
        def problem(text: str | None) -> str | None:
            try:
                check_code(text or "")
            except Refused as error:
                return str(error)
            return None

        return codes.map(problem).astype(object)

    return F.pandas_udf(check, "string")(code)


def decided(versions: DataFrame, changes: DataFrame) -> DataFrame:
    """What each of ``changes`` makes of its skill: the next version (columns of SCHEMA) and problem, which says why it is refused, or null.

    ``changes`` has the columns of CHANGE.  create: id and name must be free; update: columns
    that are not null, and a changed body makes a draft again; review: Python only, and again after the check of the code;
    activate: Python only if reviewed; archive; rollback: the content of ``to_version`` as a
    draft.  Without tags, a new skill gets those of its type; models that take long are tagged heavy.  A skill may
    have one change in a batch, and a name one owner.
    """
    state = current(versions).select("skill_id", F.struct("version", "name", "skill_type", "status", "body", "tags").alias("s"))
    old = versions.select("skill_id", F.col("version").alias("to_version"), F.struct("name", "skill_type", "body", "tags").alias("o"))
    owners = current(versions).groupBy("name").agg(F.min("skill_id").alias("owner"))
    asked = changes.withColumn("times", F.count("*").over(Window.partitionBy("skill_id"))).withColumn("first", F.when(F.col("name").isNotNull(), F.min("skill_id").over(Window.partitionBy("name"))))
    met = asked.join(state, "skill_id", "left").join(old, ["skill_id", "to_version"], "left").join(owners, "name", "left")
    a, s, o = F.col("action"), F.col("s"), F.col("o")
    given = F.when(F.size(F.coalesce("tags", F.array().cast("array<string>"))) > 0, F.col("tags")).when(F.col("skill_type") == "preset", F.array(F.lit("preset"))).otherwise(F.array(F.lit("business"), F.lit("user")))
    heavy = F.when((F.col("skill_type") == "preset") & F.col("body").isin(*HEAVY), F.array_union(given, F.array(F.lit("heavy")))).otherwise(given)
    pick = lambda c, new: F.when(a == "create", new).when(a == "rollback", o[c]).when(a == "update", F.coalesce(F.col(c), s[c])).otherwise(s[c])
    changed = (a == "update") & F.col("body").isNotNull()
    status = F.when(a.isin("create", "rollback") | changed, "draft").when(a == "review", "reviewed").when(a == "activate", "active").when(a == "archive", "archived").otherwise(s["status"])
    new = met.select(
        "skill_id", (F.coalesce(s["version"], F.lit(0)) + 1).alias("version"), pick("name", F.col("name")).alias("name"), pick("skill_type", F.col("skill_type")).alias("skill_type"), status.alias("status"),
        pick("body", F.col("body")).alias("body"), pick("tags", heavy).alias("tags"), F.when(a == "rollback", F.concat(F.lit("rollback to "), F.col("to_version").cast("string"))).otherwise(a).alias("action"),
        a.alias("a"), s["version"].isNotNull().alias("known"), s["status"].alias("was"), o.isNotNull().alias("found"), F.col("to_version"), F.col("times"), F.col("name").alias("named"), F.col("owner"), F.col("first"),
    )
    taken = F.col("a").isin("create", "update") & ((F.col("owner") != F.col("skill_id")) | (F.col("first") != F.col("skill_id")))
    python = F.col("skill_type") == "python"
    problem = (
        F.when(F.col("skill_id").isNull() | ~F.coalesce(F.col("a").isin("create", "update", "review", "activate", "archive", "rollback"), F.lit(False)), "no such change")
        .when(F.col("times") > 1, "several changes of one skill")
        .when((F.col("a") == "create") & (F.col("known") | F.col("named").isNull()), "the id is taken, or there is no name")
        .when((F.col("a") != "create") & ~F.col("known"), "no such skill")
        .when(F.coalesce(taken, F.lit(False)), "the name is taken")
        .when((F.col("a") == "rollback") & ~F.col("found"), "no such version")
        .when((F.col("a") == "review") & ~python, "only Python skills are reviewed")
        .when((F.col("a") == "activate") & python & (F.col("was") != "reviewed"), "a Python skill is reviewed before it becomes active")
        .when(python & F.col("a").isin("create", "update", "review"), code_problem(F.col("body")))
    )
    return new.select("skill_id", "version", "name", "skill_type", "status", "body", "tags", "action", problem.alias("problem"))


class Log:
    """Files of a folder with numbers, each made once: who comes second finds it there.  Any store that Hadoop knows, as long as its create without overwriting is exclusive."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.place = spark._jvm.org.apache.hadoop.fs.Path(path)
        self.files = self.place.getFileSystem(spark._jsc.hadoopConfiguration())
        self.path_of = spark._jvm.org.apache.hadoop.fs.Path

    def entries(self) -> list[str]:
        """Names in order of their numbers."""
        return sorted(x.getPath().getName() for x in self.files.listStatus(self.place)) if self.files.exists(self.place) else []

    def add(self, number: int, text: str) -> bool:
        """Whether ``number`` was free, and is now ours."""
        try:
            out = self.files.create(self.path_of(self.place, f"{number:012d}"), False)
        except Py4JJavaError as error:
            if "AlreadyExists" in str(error.java_exception) or "already exists" in str(error.java_exception):
                return False
            raise
        out.write(bytearray(text.encode()))
        out.close()
        return True


class Catalogue:
    """Skills in a folder, with any number of writers.

    A batch of changes is one commit: its new versions are written to a folder of their own,
    then the next number of the log is made to point to it.  Of two writers one gets the
    number; the other one decides anew, on the state that it finds then.  Readers see whole commits.
    """

    def __init__(self, spark: SparkSession, path: str, tries: int = 50) -> None:
        self.spark, self.path, self.tries = spark, path, tries
        self.log = Log(spark, f"{path}/log")

    def commits(self) -> list[str]:
        """Folders of the commits, in order."""
        return [r["value"] for r in self.spark.read.text([f"{self.path}/log/{n}" for n in names]).withColumn("n", F.col("_metadata.file_name")).orderBy("n").collect()] if (names := self.log.entries()) else []

    def versions(self, folders: list[str] | None = None) -> DataFrame:
        """All versions of all skills; with ``folders`` those of some commits."""
        folders = self.commits() if folders is None else folders
        known = self.spark.createDataFrame([], SCHEMA)
        return self.spark.read.schema(known.schema).parquet(*[f"{self.path}/data/{f}" for f in folders]) if folders else known

    def commit(self, changes: DataFrame) -> DataFrame:
        """Decides and writes a batch of changes; returns what ``decided`` says of each.  Refused changes do not keep the others back; without any accepted one nothing is written."""
        for _ in range(self.tries):
            folders, folder = self.commits(), uuid4().hex
            out = decided(self.versions(folders), changes.select(*(c.split(" ")[0] for c in CHANGE.split(", "))))
            out.write.parquet(f"{self.path}/decided/{folder}")
            out = self.spark.read.schema(out.schema).parquet(f"{self.path}/decided/{folder}")
            accepted = out.filter("problem is null").drop("problem")
            if accepted.isEmpty():
                return out
            accepted.write.parquet(f"{self.path}/data/{folder}")
            if self.log.add(len(folders) + 1, folder):
                return out
        raise RuntimeError(f"other writers came first {self.tries} times")

    def change(self, skill_id: str, action: str, **given) -> dict:
        """One change; its new version, or Refused."""
        row = self.commit(self.spark.createDataFrame([{"skill_id": skill_id, "action": action} | given], CHANGE)).first()
        if row["problem"]:
            raise Refused(f"{skill_id}: {row['problem']}")
        return {k: v for k, v in row.asDict().items() if k != "problem"}

    def get(self, skill_id: str, version: int | None = None) -> dict:
        mine = self.versions().filter(F.col("skill_id") == skill_id)
        found = (current(mine) if version is None else mine.filter(F.col("version") == version)).first()
        if found is None:
            raise Refused(f"no skill {skill_id}" + ("" if version is None else f" at version {version}"))
        return found.asDict()

    def create(self, skill_id: str, name: str, skill_type: str, body: str, tags: tuple[str, ...] = ()) -> dict:
        return self.change(skill_id, "create", name=name, skill_type=skill_type, body=body, tags=list(tags))

    def update(self, skill_id: str, **changes) -> dict:
        return self.change(skill_id, "update", **changes)

    def review(self, skill_id: str) -> dict:
        return self.change(skill_id, "review")

    def activate(self, skill_id: str) -> dict:
        return self.change(skill_id, "activate")

    def archive(self, skill_id: str) -> dict:
        return self.change(skill_id, "archive")

    def rollback(self, skill_id: str, version: int) -> dict:
        return self.change(skill_id, "rollback", to_version=version)

    def seed(self, presets: Iterable[str]) -> DataFrame:
        """Makes an active skill of each preset whose id is free: two commits for all of them."""
        names = self.spark.createDataFrame([(p,) for p in presets], "name string")
        kind = F.lit("preset")
        new = names.select(F.concat(F.lit("preset-"), "name").alias("skill_id"), F.lit("create").alias("action"), "name", kind.alias("skill_type"), F.col("name").alias("body"), F.lit(None).cast("array<string>").alias("tags"), F.lit(None).cast("int").alias("to_version"))
        made = self.commit(new).filter("problem is null")
        return self.commit(made.select("skill_id", F.lit("activate").alias("action"), *(F.lit(None).cast(t).alias(c) for c, t in (x.split(" ", 1) for x in CHANGE.split(", ")[2:]))))
