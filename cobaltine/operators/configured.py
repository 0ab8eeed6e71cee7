"""Sheets of many senders read by a table of configurations, in one plan for all of them.

A configuration is a row: what a sheet's columns are called, where its header is, which
columns hold quantities.  Cells are joined to it by sheet, so a new sender is a new row and
no new code.  A header whose row is not given is found by scoring the rows at the top.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import written
from . import sheets

#: engine: simple (a table of named columns), wide (quantities by column), complex (wide, by a plan of rows, names are dates);
#: header_row and header_rows (of the last header row) from 1 or null; levels: header rows with a name of their own;
#: var_rows: header rows whose texts make a column's name; ids: header texts and what they are called; primary: the header that must be filled
CONFIGURATION = "label string, engine string, header_row int, header_rows int, levels map<string, int>, var_rows array<int>, ids array<struct<header: string, name: string>>, primary string, pattern string, date_column string, date_format string"
#: rows at the top that may be the header if it is not given
TOP = 40


@dataclass(frozen=True)
class Parsed:
    """``rows``: sheet, label, row, category, ids (array of name and value), name, qty.  ``problems``: sheet, label, problem."""

    rows: DataFrame
    problems: DataFrame


def typed(cells: DataFrame) -> DataFrame:
    """Cells with a type; text where there is none.  Blanks and formula errors are left out."""
    kind = F.col("type") if "type" in cells.columns else F.lit(None).cast("string")
    return sheets.clean(cells.select("sheet", "row", "col", "value", kind.alias("type"))).filter("value is not null")


def is_quantity_header(value: Column, kind: Column) -> Column:
    """Whether a header cell names a column of quantities: by the pattern, or a date where the plan's engine reads it."""
    by_pattern = F.coalesce(F.regexp_like(value, F.col("pattern")), F.lit(False))
    return F.when(F.col("engine") == "complex", sheets.parse_date(value, kind).isNotNull()).when(F.col("engine") == "wide", by_pattern).otherwise(False)


def header_rows(cells: DataFrame, configured: DataFrame) -> DataFrame:
    """(sheet, header_row): the given row, else the lowest row that has a level's name, else the best of the top rows.

    Rows are scored by how many of the configured names they hold, then by how many columns
    of quantities they name, then by their other texts; of equal rows the upper one counts.
    ``configured`` has sheet and the columns of CONFIGURATION; a sheet that has no row with
    either is not in the result.
    """
    texts = sheets.header_text(F.col("value"))
    top = cells.filter(F.col("row") <= TOP).join(configured.filter("header_row is null and levels is null"), "sheet").withColumn("value", texts)
    known = F.exists("ids", lambda x: x["header"] == F.col("value"))
    number = sheets.number(F.col("value")).isNotNull()
    scored = top.groupBy("sheet", "row").agg(
        F.count_distinct(F.when(known, F.col("value"))).alias("names"), F.count_if(is_quantity_header(F.col("value"), F.col("type"))).alias("quantities"), F.count_if(~number).alias("texts")
    )
    best = scored.filter("names > 0 or quantities > 0").groupBy("sheet").agg(F.max_by("row", F.struct("names", "quantities", "texts", -F.col("row"))).alias("header_row"))
    given = configured.select("sheet", F.coalesce("header_row", F.array_max(F.map_values("levels"))).alias("header_row")).filter("header_row is not null")
    return given.unionByName(best.select("sheet", "header_row"))


def columns(cells: DataFrame, configured: DataFrame) -> DataFrame:
    """(sheet, col, header, name, level, is_id, below): what each column is.  ``level`` maps a level's name to the column's text there, ``below`` is the last header row."""
    placed = configured.drop("header_row").join(header_rows(cells, configured), "sheet").withColumn("below", F.coalesce("header_rows", "header_row"))
    parts = F.coalesce("var_rows", F.array("header_row"))
    wanted = placed.withColumns({"parts": parts, "level_rows": F.coalesce(F.map_values("levels"), F.array().cast("array<int>"))})
    head = cells.join(wanted, "sheet").filter((F.col("row") == F.col("header_row")) | F.array_contains("parts", F.col("row")) | F.array_contains("level_rows", F.col("row")))
    day = F.when(F.col("engine") == "complex", F.date_format(sheets.parse_date(F.col("value"), F.col("type")), "yyyy-MM-dd"))
    head = head.withColumns({"text": F.coalesce(day, sheets.header_text(F.col("value"))), "counts": (F.col("row") == F.col("header_row")) & is_quantity_header(sheets.header_text(F.col("value")), F.col("type"))})
    entry = F.filter(F.map_entries("levels"), lambda e: e["value"] == F.col("row"))
    # a column has as many header cells as the configuration names rows
    named = head.groupBy("sheet", "col").agg(
        F.max(F.when(F.col("row") == F.col("header_row"), F.col("text"))).alias("header"),
        F.max("counts").alias("counts"),
        F.sort_array(F.collect_list(F.when(F.array_contains("parts", F.col("row")), F.struct(F.array_position("parts", F.col("row")).alias("at"), "text")))).alias("pieces"),
        F.map_from_entries(F.flatten(F.collect_list(F.transform(F.coalesce(entry, F.array().cast("array<struct<key:string,value:int>>")), lambda e: F.struct(e["key"], F.col("text")))))).alias("level"),
        F.first("below").alias("below"),
        F.first("ids").alias("ids"),
    ).filter("header is not null")
    listed = named.withColumn("is_id", F.exists("ids", lambda x: x["header"] == F.col("header"))).filter("is_id or counts")
    name = F.when(F.col("is_id"), F.col("header")).otherwise(F.coalesce(F.nullif(F.array_join(F.transform("pieces", lambda p: p["text"]), "/"), F.lit("")), F.col("header")))
    # of several columns with an id's header, the first counts
    first = listed.filter("is_id").groupBy("sheet", "header").agg(F.min("col").alias("col")).select("sheet", "col")
    return listed.filter("not is_id").unionByName(listed.join(first, ["sheet", "col"], "left_semi").filter("is_id")).select("sheet", "col", "header", name.alias("name"), "level", "is_id", "below")


def problems(labels: DataFrame, configured: DataFrame, found: DataFrame) -> DataFrame:
    """(sheet, label, problem) of the sheets whose header does not fit."""
    seen = found.groupBy("sheet").agg(F.collect_set(F.when(F.col("is_id"), F.col("header"))).alias("has"), F.count_if(~F.col("is_id")).alias("n"))
    state = labels.join(configured.drop("label"), "sheet", "left").join(seen, "sheet", "left")
    nothing = F.array().cast("array<string>")
    lacking = F.array_except(F.transform("ids", lambda x: x["header"]), F.concat(F.coalesce("has", nothing), F.coalesce(F.map_keys("levels"), nothing)))
    problem = (
        F.when(F.col("engine").isNull(), "no configuration")
        .when(F.col("has").isNull(), "no header")
        .when(F.size(lacking) > 0, F.concat(F.lit("columns missing: "), F.array_join(F.sort_array(lacking), ", ")))
        .when((F.col("engine") != "simple") & (F.col("n") == 0), "no column of quantities")
    )
    return state.select("sheet", "label", problem.alias("problem")).filter("problem is not null")


def parse(cells: DataFrame, labels: DataFrame, configurations: DataFrame, hidden_cols: DataFrame | None = None, plan: DataFrame | None = None) -> Parsed:
    """Reads every sheet of ``labels`` (sheet, label) by the configuration of its label.

    ``cells`` has sheet, row, col, value and, if known, type (number, text, bool, date); merged ranges
    are filled.  Columns of ``hidden_cols`` (sheet, col) are not read, not for headers either.  ``plan`` (sheet, row, category)
    names the rows that complex sheets give, a row for each category that it is in.  Rows
    of simple sheets have ids only: all of their columns, the date in its format; those of others are one a quantity, with the ids of its
    row, or of its column's level.  A row whose primary id is blank, a cell that is no number and a row with nothing are left out.
    A sheet that gives no row has a problem that says why.
    """
    labels = labels.select("sheet", "label").distinct()
    configured = labels.join(configurations, "label")
    cells = typed(cells)
    if hidden_cols is not None:
        cells = cells.join(hidden_cols.select("sheet", "col").distinct(), ["sheet", "col"], "left_anti")
    found = written(columns(cells, configured), "columns")  # a row a column of a sheet, used several times
    bad = problems(labels, configured, found)
    fine = configured.join(bad.select("sheet"), "sheet", "left_anti")

    body = cells.join(found, ["sheet", "col"]).filter(F.col("row") > F.col("below")).join(fine.select("sheet", "date_column", "date_format"), "sheet")
    day = F.when(F.col("header") == F.col("date_column"), F.expr("date_format(day, date_format)"))
    shown = F.coalesce(day, sheets.id_value(F.col("value")))
    body = body.withColumn("day", sheets.parse_date(F.col("value"), F.col("type"))).withColumns({"shown": shown, "qty": sheets.number(F.col("value"))})
    # a row's cells meet: as many as a sheet has columns
    rows = body.groupBy("sheet", "row").agg(
        F.map_from_entries(F.collect_list(F.when(F.col("is_id") & F.col("shown").isNotNull(), F.struct("header", "shown")))).alias("has"),
        F.collect_list(F.when(~F.col("is_id") & F.col("qty").isNotNull(), F.struct("col", "name", "level", "qty"))).alias("data"),
    )
    rows = rows.join(fine.select("sheet", "label", "engine", "ids", "primary"), "sheet").filter(F.col("primary").isNull() | F.map_contains_key("has", F.coalesce("primary", F.lit(""))))
    one = F.array(F.struct(F.lit(0).alias("col"), F.lit(None).cast("string").alias("name"), F.create_map().cast("map<string,string>").alias("level"), F.lit(None).cast("double").alias("qty")))
    spread = rows.filter((F.col("engine") != "simple") | (F.size("has") > 0)).withColumn("d", F.explode(F.when(F.col("engine") == "simple", one).otherwise(F.col("data"))))
    ids = F.transform("ids", lambda x: F.struct(x["name"].alias("name"), F.coalesce(F.col("has")[x["header"]], F.col("d.level")[x["header"]]).alias("value")))
    out = spread.select("sheet", "label", "row", "engine", ids.alias("ids"), "d.name", "d.qty")
    planned = F.lit(None).cast("string")
    if plan is None:
        out = out.filter("engine <> 'complex'").withColumn("category", planned)
    else:
        by_plan = out.filter("engine = 'complex'").join(plan.select("sheet", "row", "category").distinct(), ["sheet", "row"])
        out = out.filter("engine <> 'complex'").withColumn("category", planned).unionByName(by_plan)
    out = out.select("sheet", "label", "row", "category", "ids", "name", "qty")
    empty = fine.select("sheet", "label", F.lit("no rows").alias("problem")).join(out.select("sheet").distinct(), "sheet", "left_anti")
    return Parsed(out, bad.unionByName(empty))


def records(rows: DataFrame) -> DataFrame:
    """(sheet, label, category, ids, data): the quantities of each tuple of ids, in the order of rows and names.

    Of a category's values of one name the one of the last row counts; other rows keep all of theirs.
    """
    newest = Window.partitionBy("sheet", "category", "ids", "name").orderBy(F.desc("row"))
    kept = rows.withColumn("back", F.when(F.col("category").isNotNull(), F.row_number().over(newest)).otherwise(1)).filter("back = 1")
    return kept.groupBy("sheet", "label", "category", "ids").agg(F.transform(F.sort_array(F.collect_list(F.struct("row", "name", "qty"))), lambda x: F.struct(x["name"], x["qty"])).alias("data"))
