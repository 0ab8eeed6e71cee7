"""Messy-spreadsheet operators over a cell table (sheet, row, col, value), positions from 1."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: fixed values: literals that stand for a failed formula
ERRORS = ("#REF!", "#N/A", "#VALUE!", "#DIV/0!", "#NAME?", "#NULL!", "#NUM!")
#: a time of day
CLOCK = r"(?:[01]?\d|2[0-3]):[0-5]\d:(?:[0-5]\d|6[01])"
#: the names of these date formats and their order are fixed values; each has what a text must look like, times included
DATE_FORMATS = (
    ("yyyy-MM-dd HH:mm:ss", rf"^\d{{4}}-\d{{1,2}}-\d{{1,2}} {CLOCK}$"),
    ("yyyy/MM/dd HH:mm:ss", rf"^\d{{4}}/\d{{1,2}}/\d{{1,2}} {CLOCK}$"),
    ("yyyy-MM-dd", r"^\d{4}-\d{1,2}-\d{1,2}$"),
    ("yyyy/MM/dd", r"^\d{4}/\d{1,2}/\d{1,2}$"),
    ("yyyy.MM.dd", r"^\d{4}\.\d{1,2}\.\d{1,2}$"),
    ("yyyyMMdd", r"^\d{8}$"),
    ("dd/MM/yyyy", r"^\d{1,2}/(0?[1-9]|1[0-2])/\d{4}$"),
    ("MM/dd/yyyy", r"^\d{1,2}/\d{1,2}/\d{4}$"),
    ("yyyy年MM月dd日", r"^\d{4}年\d{1,2}月\d{1,2}日$"),
)
#: serial numbers of days that count as dates, and the day before the first
SERIALS, EPOCH = (1, 73415), "1899-12-30"


def is_blank(value: Column) -> Column:
    return value.isNull() | (F.trim(value) == "")


def clean(cells: DataFrame) -> DataFrame:
    """Formula errors and blanks become nulls."""
    return cells.withColumn("value", F.when(F.col("value").isin(*ERRORS) | is_blank(F.col("value")), None).otherwise(F.col("value")))


def fill_merged(cells: DataFrame, merges: DataFrame) -> DataFrame:
    """Every cell of a merged range takes the value of its top left one, where that has one.

    ``merges`` has sheet, min_row, max_row, min_col, max_col.  Ranges are spread to the cells
    they cover, so the join is an equi-join.
    """
    kept = [c for c in ("value", "type") if c in cells.columns]
    heads = merges.join(cells.withColumnsRenamed({"row": "min_row", "col": "min_col"}).select("sheet", "min_row", "min_col", F.struct(*kept).alias("head")).filter("head.value is not null"), ["sheet", "min_row", "min_col"])
    covered = heads.select("sheet", F.explode(F.sequence("min_row", "max_row")).alias("row"), "min_col", "max_col", "head").select("sheet", "row", F.explode(F.sequence("min_col", "max_col")).alias("col"), "head")
    filled = F.coalesce("head", F.struct(*kept))
    return cells.join(covered, ["sheet", "row", "col"], "left").select("sheet", "row", "col", *[filled[c].alias(c) for c in kept])


def visible(cells: DataFrame, hidden_rows: DataFrame, hidden_cols: DataFrame) -> DataFrame:
    return cells.join(hidden_rows, ["sheet", "row"], "left_anti").join(hidden_cols, ["sheet", "col"], "left_anti")


def inherited_hidden(columns: DataFrame) -> DataFrame:
    """Columns (sheet, col, hidden) without a setting take that of the nearest column before them."""
    so_far = Window.partitionBy("sheet").orderBy("col").rowsBetween(Window.unboundedPreceding, 0)
    return columns.withColumn("hidden", F.coalesce(F.last("hidden", ignorenulls=True).over(so_far), F.lit(False)))


def axis_filter(cells: DataFrame, axis: str, before: int | None = None, after: int | None = None, positions: tuple[int, ...] = (), blocks: dict[int, str] | None = None, mode: str = "use") -> DataFrame:
    """Rows or columns (``axis`` row or col) that meet any of the conditions are kept (``use``) or dropped (``skip``).

    ``blocks`` maps the number of a line across (a column for rows, a row for columns) to a
    text that its cell must hold; cells are looked at after merged ranges are filled.
    """
    chosen, across = F.lit(False), "col" if axis == "row" else "row"
    if before is not None:
        chosen = chosen | (F.col(axis) <= before)
    if after is not None:
        chosen = chosen | (F.col(axis) > after)
    if positions:
        chosen = chosen | F.col(axis).isin(*positions)
    for at, text in (blocks or {}).items():
        lines = cells.filter((F.col(across) == at) & F.contains("value", F.lit(text))).select("sheet", axis).distinct().withColumn(f"block_{at}", F.lit(True))
        cells = cells.join(lines, ["sheet", axis], "left")
        chosen = chosen | F.coalesce(f"block_{at}", F.lit(False))
    return cells.filter(chosen if mode == "use" else ~chosen).drop(*(f"block_{at}" for at in blocks or {}))


def row_filter(cells: DataFrame, **conditions) -> DataFrame:
    return axis_filter(cells, "row", **conditions)


def column_filter(cells: DataFrame, **conditions) -> DataFrame:
    return axis_filter(cells, "col", **conditions)


def number(value: Column) -> Column:
    """Digits with thousands separators; anything else is null."""
    return F.regexp_replace(F.trim(value), ",", "").try_cast("double")


def unpivot_header(cells: DataFrame, id_names: list[str], header_row: int, pattern: str) -> DataFrame:
    """Long rows (sheet, row, ids, name, qty) of the columns whose header matches ``pattern``; rows without the first id are noise."""
    header = cells.filter(F.col("row") == header_row).select("sheet", "col", F.trim("value").alias("name"))
    body = cells.filter(F.col("row") > header_row).join(header, ["sheet", "col"])
    ids = body.filter(F.col("name").isin(*id_names)).groupBy("sheet", "row").pivot("name", id_names).agg(F.min_by("value", "col"))
    values = body.filter(F.col("name").rlike(pattern)).select("sheet", "row", "name", number(F.col("value")).alias("qty")).filter("qty is not null")
    return values.join(ids.filter(~is_blank(F.col(f"`{id_names[0]}`"))), ["sheet", "row"])


def headed(cells: DataFrame, header_row: int, names: dict[str, str]) -> DataFrame:
    """A sheet's rows below its header: (sheet, row) and the columns of ``names`` (header: new name), without rows that are all blank.

    New names must differ, and every sheet must have every header, else ValueError.
    """
    if len(set(names.values())) < len(names):
        raise ValueError("new names are not unique")
    header = cells.filter(F.col("row") == header_row).select("sheet", "col", header_text(F.col("value")).alias("name")).filter(F.col("name").isin(*names))
    lacking = cells.select("sheet").distinct().join(header.groupBy("sheet").agg(F.collect_set("name").alias("found")), "sheet", "left")
    lacking = lacking.select("sheet", F.array_except(F.array(*map(F.lit, names)), F.coalesce("found", F.array().cast("array<string>"))).alias("names")).filter(F.size("names") > 0).first()
    if lacking:
        raise ValueError(f"{lacking['sheet']}: no column {', '.join(lacking['names'])}")
    body = clean(cells.filter(F.col("row") > header_row).join(header, ["sheet", "col"]))
    table = body.groupBy("sheet", "row").pivot("name", list(names)).agg(F.min_by("value", F.when(F.col("value").isNotNull(), F.col("col")))).withColumnsRenamed(names)
    return table.na.drop("all", subset=list(names.values()))


def set_gaps(expected: DataFrame, actual: DataFrame, key: str) -> DataFrame:
    """(key, side): what is expected and ``missing``, and what is there and ``extra``; no rows if both are the same set."""
    e, a = (df.select(key).distinct() for df in (expected, actual))
    side = lambda df, name: df.withColumn("side", F.lit(name))
    return side(e.join(a, key, "left_anti"), "missing").unionByName(side(a.join(e, key, "left_anti"), "extra"))


def required(rows: DataFrame, what: str) -> DataFrame:
    """``rows``, or an error if there are none: a sheet that yields nothing has another form than was said."""
    if rows.isEmpty():
        raise ValueError(f"{what}: no rows")
    return rows


def unpivot_columns(wide: DataFrame, ids: list[str], names: list[str]) -> DataFrame:
    return wide.unpivot(ids, names, "name", "qty").filter("qty is not null")


#: what a date's text looks like with the year in front, and what each such text, then a day first, then a month first, is rewritten to
YEAR_FIRST = rf"^(\d{{4}})(?:([-/])(\d{{1,2}})\2(\d{{1,2}})(?: {CLOCK})?|\.(\d{{1,2}})\.(\d{{1,2}})|(\d{{2}})(\d{{2}})|年(\d{{1,2}})月(\d{{1,2}})日)$"
REWRITTEN = ((YEAR_FIRST, "$1-$3$5$7$9-$4$6$8$10"), (r"^(\d{1,2})/(0?[1-9]|1[0-2])/(\d{4})$", "$3-$2-$1"), (r"^(\d{1,2})/(\d{1,2})/(\d{4})$", "$3-$1-$2"))


def serial_date(value: Column, kind: Column) -> Column:
    """The date of a serial number (1 to 73415)."""
    serial = F.floor(F.regexp_extract(F.trim(value), r"^[0-9]{1,5}(\.[0-9]+)?$", 0).try_cast("double")).cast("int")
    return F.when((F.coalesce(kind, F.lit("number")) == "number") & serial.between(*SERIALS), F.date_add(F.lit(EPOCH).cast("date"), serial))


def written_date(value: Column, kind: Column) -> Column:
    """The date of a text in one of the nine formats; a few rewrites bring all of them to one form, so that the expression stays small."""
    text = F.trim(value)
    for looks, form in REWRITTEN:
        text = F.regexp_replace(text, looks, form)
    return F.when(F.coalesce(kind, F.lit("text")).isin("text", "date"), F.regexp_extract(text, r"^(?!0000)\d{4}-\d{1,2}-\d{1,2}$", 0).try_cast("date"))


def parse_date(value: Column, kind: Column | None = None) -> Column:
    """The date of a cell: a serial number or one of the nine formats; null for anything else.

    ``kind`` is the cell's type: a number can only be a serial number, a text only one of the
    formats, a date is its own text, a truth value nothing.  Where it is not known, a text of
    digits that may be a serial number is one.  Blanks around the text do not count, days and
    months may have one digit, and a day comes before the month unless that is no month.
    """
    kind = F.lit(None).cast("string") if kind is None else kind
    return F.coalesce(serial_date(value, kind), written_date(value, kind))


def date_kind(value: Column, kind: Column | None = None) -> Column:
    """The rule that reads a date: ``serial``, the format, or null."""
    kind = F.lit(None).cast("string") if kind is None else kind
    picked = F.lit(None).cast("string")
    for name, looks in reversed(DATE_FORMATS):
        picked = F.when(F.trim(value).rlike(looks), name).otherwise(picked)
    return F.when(serial_date(value, kind).isNotNull(), "serial").when(written_date(value, kind).isNotNull(), picked)


def date_report(values: DataFrame, target: str = "yyyy-MM-dd", samples: int = 5) -> DataFrame:
    """One row for each ``name`` of (name, row, value): how its dates are written.

    source is the only kind, ``mixed (a, b)`` by falling count (ties by name), or
    ``unknown``; matches tells whether all are in the format ``target``; samples are the first
    values, by row, that are no date.
    """
    kinds = values.select("name", "row", "value", date_kind(F.col("value")).alias("kind"))
    counted = kinds.filter("kind is not null").groupBy("name", "kind").agg(F.count("*").alias("n"))
    order = F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("n"), "kind")))  # ten kinds at most
    by_name = counted.groupBy("name").agg(F.transform(order, lambda x: x["kind"]).alias("kinds"), F.sum("n").alias("parsed"))
    place = F.row_number().over(Window.partitionBy("name").orderBy("row"))
    bad = kinds.filter("kind is null").withColumn("place", place).filter(F.col("place") <= samples)
    bad = bad.groupBy("name").agg(F.transform(F.sort_array(F.collect_list(F.struct("place", "value"))), lambda x: F.coalesce(x["value"], F.lit(""))).alias("samples"))
    total = values.groupBy("name").agg(F.count("*").alias("total"))
    known = total.join(by_name, "name", "left").join(bad, "name", "left")
    listed = F.array_join("kinds", ", ")
    source = F.when(F.col("kinds").isNull(), "unknown").when(F.size("kinds") == 1, listed).otherwise(F.concat(F.lit("mixed ("), listed, F.lit(")")))
    parsed = F.coalesce("parsed", F.lit(0))
    return known.select("name", source.alias("source"), F.coalesce(F.col("kinds") == F.array(F.lit(target)), F.lit(False)).alias("matches"), "total", parsed.alias("parsed"), (F.col("total") - parsed).alias("unparsed"), F.array_join(F.coalesce("samples", F.array().cast("array<string>")), "|").alias("samples"))


def id_value(value: Column) -> Column:
    """The text of an id cell: trimmed, whole numbers without their ``.0``, truth values and blanks null."""
    text = F.trim(value)
    whole = F.regexp_replace(text, r"^(-?[0-9]+)\.0+$", "$1")
    return F.when(is_blank(value) | F.lower(text).isin("true", "false"), None).otherwise(whole)


def int_value(value: Column) -> Column:
    """A number cell cut off towards zero, or null."""
    found = number(value)
    return F.when(found < 0, F.ceil(found)).otherwise(F.floor(found)).cast("bigint")


def header_text(value: Column) -> Column:
    """A header cell: trimmed, a date without its midnight, blanks null."""
    text = F.regexp_replace(F.trim(value), r"^(\d{4}-\d{2}-\d{2})[T ]00:00:00$", "$1")
    return F.when(text != "", text)


def unpivot_positions(cells: DataFrame, ids: dict[str, int], names: dict[int, str], first_row: int) -> DataFrame:
    """Long rows (sheet, row, ids, name, qty) by column numbers: ``ids`` maps a name to its column, ``names`` a column to its name.

    Rows start at ``first_row``; those whose first id is blank are noise.
    """
    body = cells.filter(F.col("row") >= first_row)
    by_column = {str(n): c for c, n in ids.items()}
    found = body.filter(F.col("col").isin(*ids.values())).groupBy("sheet", "row").pivot("col", list(ids.values())).agg(F.min("value"))
    found = found.select("sheet", "row", *[id_value(F.col(f"`{n}`")).alias(c) for n, c in by_column.items()]).filter(F.col(f"`{next(iter(ids))}`").isNotNull())
    label = F.element_at(F.create_map(*[F.lit(x) for pair in names.items() for x in pair]), F.col("col"))
    values = body.filter(F.col("col").isin(*names)).select("sheet", "row", label.alias("name"), number(F.col("value")).alias("qty")).filter("qty is not null")
    return values.join(found, ["sheet", "row"])


def unpivot_blocks(cells: DataFrame, ids: list[tuple[str, str]], block_row: int, header_row: int, pattern: str) -> DataFrame:
    """Long rows (sheet, row, ids, block, name, qty) of a sheet with two header rows, the upper one naming blocks of columns.

    ``ids`` are (block, name) of the id columns, '' for a column without a block; other
    columns whose lower header matches ``pattern`` hold quantities.  A block's name holds
    for the columns after it until the next one.
    """
    before = Window.partitionBy("sheet").orderBy("col").rowsBetween(Window.unboundedPreceding, 0)
    upper = cells.filter(F.col("row") == block_row).select("sheet", "col", header_text(F.col("value")).alias("upper"))
    lower = cells.filter(F.col("row") == header_row).select("sheet", "col", header_text(F.col("value")).alias("name"))
    header = lower.join(upper, ["sheet", "col"], "left").withColumn("block", F.coalesce(F.last("upper", ignorenulls=True).over(before), F.lit(""))).drop("upper")
    body = cells.filter(F.col("row") > header_row).join(header, ["sheet", "col"])
    is_id = F.concat_ws("\n", "block", "name").isin(*["\n".join(x) for x in ids])
    named = body.filter(is_id).groupBy("sheet", "row").pivot("name", [n for _, n in ids]).agg(F.min_by("value", "col"))
    named = named.select("sheet", "row", *[id_value(F.col(f"`{n}`")).alias(n) for _, n in ids]).filter(F.col(f"`{ids[0][1]}`").isNotNull())
    values = body.filter(~is_id & F.col("name").rlike(pattern)).select("sheet", "row", "block", "name", number(F.col("value")).alias("qty")).filter("qty is not null")
    return values.join(named, ["sheet", "row"])


def extracted(rows: DataFrame, plan: DataFrame, keys: list[str]) -> DataFrame:
    """What a plan takes from long rows (sheet, row, keys, name, qty): (category, keys, name, qty).

    ``plan`` has sheet, row and category.  Of several values of one key and name the one of
    the last row counts.
    """
    return rows.join(plan, ["sheet", "row"]).groupBy("category", *keys, "name").agg(F.max_by("qty", "row").alias("qty"))


def last_wins(rows: DataFrame, keys: list[str], value: str, order: str) -> DataFrame:
    """One row per key: the value of the highest ``order``."""
    return rows.groupBy(*keys).agg(F.max_by(value, order).alias(value))
