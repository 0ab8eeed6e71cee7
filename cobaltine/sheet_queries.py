"""Registered queries over sheets of several senders, read by configurations in one plan.

Supplier and part tables stand in for the sheets: simple ones list the parts of each
manufacturer, wide ones the suppliers of each nation under one to three title rows, another wide one has
blocks above its dates, a complex one is read by a plan of rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .more_queries import W
from .operators import configured
from .queries import query, table
from .sources.shared import written

CONFIGURATIONS = [
    ("parts", "simple", None, None, None, None, [("Item No", "item"), ("Maker", "maker"), ("Ready", "ready")], None, None, "Ready", "yyyyMMdd"),
    ("nations", "wide", None, None, None, None, [("part", "id"), ("nation", "place")], "part", r"^20\d{2}-\d{2}-\d{2}$", None, None),
    ("blocks", "wide", None, None, {"group": 1, "day": 2}, None, [("part", "id"), ("group", "group")], "part", r"^20\d{2}-\d{2}-\d{2}$", None, None),
    ("plans", "complex", 3, 4, None, None, [("part", "id")], "part", None, None, None),
    ("joined", "wide", 3, 3, None, [1, 3], [("part", "id")], "part", r"^20\d{2}-\d{2}-\d{2}$", None, None),
]
CELLS = ["sheet", "row", "col", "value", "type"]


def placed(rows: DataFrame, sheet, row, shown: list) -> DataFrame:
    """Cells of a table's rows; ``shown`` has (value, type) by column."""
    each = F.posexplode(F.array(*[F.struct(v.cast("string").alias("value"), (F.lit(t) if isinstance(t, str) else t).alias("type")) for v, t in shown]))
    return rows.select(sheet.alias("sheet"), row.cast("int").alias("row"), each.alias("col", "x")).select("sheet", "row", (F.col("col") + 1).alias("col"), "x.value", "x.type")


def heads(spark, names: DataFrame, texts: list[tuple]) -> DataFrame:
    """The same header cells (row, col, value, type) on each of some sheets; ``names`` has sheet and, added to the row, down."""
    fixed = F.explode(F.array(*[F.struct(F.lit(r).alias("r"), F.lit(c).alias("col"), F.lit(v).alias("value"), F.lit(t).alias("type")) for r, c, v, t in texts]))
    return names.select("sheet", "down", fixed.alias("x")).select("sheet", (F.col("x.r") + F.col("down")).cast("int").alias("row"), "x.col", "x.value", "x.type")


def sent(spark, d) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(cells, labels, plan) of all senders' sheets."""
    of = lambda flag: F.sum(F.when(F.col("l_returnflag") == flag, F.col("l_quantity")))
    sums = table(spark, d, "lineitem").groupBy("l_suppkey").agg(of("A").alias("a"), of("N").alias("n"), of("R").alias("r"))
    s = table(spark, d, "supplier").join(sums, F.col("s_suppkey") == F.col("l_suppkey")).withColumn("down", F.col("s_nationkey") % 3)
    part = table(spark, d, "part").withColumn("k", F.row_number().over(Window.partitionBy("p_brand").orderBy("p_partkey")))
    name = F.when(F.col("s_suppkey") % 10 == 3, " ").otherwise(F.concat(F.lit(" "), "s_name"))
    n, text = "number", "text"
    # parts: dates are serial numbers, texts or no dates; every 17th row is blank
    serial = F.col("p_partkey") % 2 == 0
    ready = F.when(F.col("p_partkey") % 11 == 0, "soon").when(serial, (45658 + F.col("p_size")).cast("string")).otherwise(F.date_format(F.date_add(F.lit("2025-01-01").cast("date"), F.col("p_size")), "yyyy/MM/dd"))
    gone = F.col("p_partkey") % 17 == 0
    parts = placed(part, F.concat(F.lit("parts of "), "p_brand"), F.col("k") + 2, [(F.when(~gone, F.col("p_partkey").cast("double")), n), (F.when(~gone, F.concat(F.lit(" "), "p_type")), text), (F.when(~gone, ready), F.when(serial & (F.col("p_partkey") % 11 != 0), n).otherwise(text)), (F.lit("x"), text)])
    parts_head = heads(spark, part.select(F.concat(F.lit("parts of "), "p_brand").alias("sheet"), F.lit(0).alias("down")).distinct(), [(1, 1, "list", text), (2, 1, " Item No", text), (2, 2, "Maker", text), (2, 3, "Ready", text), (2, 4, "Remark", text)])
    # nations: the header's row differs and is not given
    nation = F.concat(F.lit("nation "), "s_nationkey")
    line = F.row_number().over(Window.partitionBy("s_nationkey").orderBy("s_suppkey"))
    s = s.withColumn("line", line)
    quantities = [(F.format_number("a", 2), text), (F.col("n"), n), (F.when(F.col("s_suppkey") % 7 == 0, "n/a").otherwise(F.col("r").cast("string")), text)]
    nations = placed(s, nation, F.col("line") + F.col("down") + 1, [(name, text), (F.concat(F.col("s_nationkey").cast("string"), F.lit(".0")), n), *quantities, (F.lit("2025-01-09"), "date")])
    names = s.select(nation.alias("sheet"), "down").distinct()
    dates = [(1, 3, "2025-01-01 00:00:00", "date"), (1, 4, "2025-01-02T00:00:00", "date"), (1, 5, "2025-01-03", text)]
    nation_head = heads(spark, names, [(1, 1, "part", text), (1, 2, "nation", text), *dates, (1, 6, "made", text)])
    titles = names.filter("down > 0").select("sheet", F.explode(F.sequence(F.lit(1), F.col("down").cast("int"))).alias("row")).select("sheet", "row", F.lit(1).alias("col"), F.lit("a title, 2025-01-01").alias("value"), F.lit(text).alias("type"))
    # blocks: two header rows, the upper one's texts are filled over its columns
    one = lambda sheet: spark.range(1).select(F.lit(sheet).alias("sheet"), F.lit(0).alias("down"))
    blocks = placed(s, F.lit("blocks"), F.col("s_suppkey") + 3, [(name, text), *quantities])
    upper = [(1, 2, "plan", text), (1, 3, "plan", text), (1, 4, "actual", text)]
    block_head = heads(spark, one("blocks"), [*upper, (2, 1, "part", text), (2, 2, "2025-01-01", text), (2, 3, "2025-01-02", text), (2, 4, "2025-01-01", text)])
    joined = placed(s, F.lit("joined"), F.col("s_suppkey") + 4, [(name, text), *quantities])
    joined_head = heads(spark, one("joined"), [*upper, (3, 1, "part", text), (3, 2, "2025-01-01", text), (3, 3, "2025-01-02", text), (3, 4, "2025-01-03", text)])
    # plans: the third and fourth row are the header; the second column of quantities is hidden
    plans = placed(s, F.lit("plans"), F.col("s_suppkey") + 5, [(name, text), *quantities])
    plan_head = heads(spark, one("plans"), [(1, 1, "as of 2025", text), (3, 1, "part", text), (3, 2, "45658", n), (3, 3, "2025-01-02", text), (3, 4, "2025.1.3", text), (4, 2, "Wed", text)])
    plan = reduce(DataFrame.unionByName, [s.filter(F.col("s_suppkey") % k == 0).select(F.lit("plans").alias("sheet"), (F.col("s_suppkey") + 5).cast("int").alias("row"), F.lit(c).alias("category")) for k, c in ((2, "even"), (3, "third"))])
    # sheets that do not fit
    odd = heads(spark, one("odd"), [(1, 1, "part", text), (1, 2, "2025-01-01", text), (2, 1, "p", text), (2, 2, "1", n)])
    bare = heads(spark, one("bare"), [(1, 1, "part", text), (1, 2, "nation", text), (2, 1, "p", text)])
    unnumbered = heads(spark, one("unnumbered"), [(1, 1, "part", text), (1, 2, "nation", text), (1, 3, "2025-01-01", text), (2, 1, "p", text), (2, 3, "none", text)])
    cells = written(reduce(DataFrame.unionByName, [x.select(CELLS) for x in (parts, parts_head, nations, nation_head, titles, blocks, block_head, joined, joined_head, plans, plan_head, odd, bare, unnumbered)]), "cells")
    fixed = spark.createDataFrame([("blocks", "blocks"), ("joined", "joined"), ("plans", "plans"), ("odd", "nations"), ("bare", "nations"), ("unnumbered", "nations"), ("not there", "nations"), ("stray", "nobody")], "sheet string, label string")
    labels = written(reduce(DataFrame.unionByName, [fixed, names.select("sheet", F.lit("nations").alias("label")), part.select(F.concat(F.lit("parts of "), "p_brand").alias("sheet"), F.lit("parts").alias("label")).distinct()]), "labels")
    return cells, labels, plan


def parsed(spark, d) -> configured.Parsed:
    cells, labels, plan = sent(spark, d)
    configurations = spark.createDataFrame(CONFIGURATIONS, configured.CONFIGURATION)
    hidden = spark.createDataFrame([("plans", 3)], "sheet string, col int")
    return configured.parse(cells, labels, configurations, hidden, plan)


def flat(ids: str) -> Column:
    return F.array_join(F.transform(ids, lambda x: F.concat(x["name"], F.lit("="), F.coalesce(x["value"], F.lit("-")))), "|")


Q = f"""{W}, q as (select *, unnest([1, 2, 3]) as i, unnest([round(a, 2), n, case when k % 7 = 0 then null else r end]) as qty from w where k % 10 <> 3),
line as (select s_suppkey as k, row_number() over (partition by s_nationkey order by s_suppkey) as line from supplier where s_suppkey in (select k from w)),
p as (select *, row_number() over (partition by p_brand order by p_partkey) as line, strftime(date '2025-01-01' + cast(p_size as integer), '%Y%m%d') as day from part),
rows as (
  select 'parts of ' || p_brand as sheet, 'parts' as label, line + 2 as row, null as category, 'item=' || p_partkey || '|maker=' || p_type || '|ready=' || case when p_partkey % 11 = 0 then 'soon' else day end as ids, null as name, null as qty from p where p_partkey % 17 <> 0
  union all select 'nation ' || s_nationkey, 'nations', line + s_nationkey % 3 + 1, null, 'id=' || s_name || '|place=' || s_nationkey, '2025-01-0' || i, qty from q join line using (k) where qty is not null
  union all select 'blocks', 'blocks', k + 3, null, 'id=' || s_name || '|group=' || case when i = 3 then 'actual' else 'plan' end, '2025-01-0' || case when i = 3 then 1 else i end, qty from q where qty is not null
  union all select 'joined', 'joined', k + 4, null, 'id=' || s_name, case when i = 3 then 'actual' else 'plan' end || '/2025-01-0' || i, qty from q where qty is not null
  union all select 'plans', 'plans', k + 5, c, 'id=' || s_name, '2025-01-0' || i, qty from q join (values (2, 'even'), (3, 'third')) v(m, c) on k % m = 0 where qty is not null and i <> 2)"""


@query(f"with {Q} select sheet, label, cast(row as integer) as row, category, ids, name, qty from rows")
def configured_sheets(spark, d):
    return parsed(spark, d).rows.withColumn("ids", flat("ids"))


@query(f"""with {W} select * from (values ('odd', 'nations', 'columns missing: nation'), ('bare', 'nations', 'no column of quantities'), ('unnumbered', 'nations', 'no rows'), ('not there', 'nations', 'no header'), ('stray', 'nobody', 'no configuration')) v(sheet, label, problem)
union all select 'nation ' || s_nationkey, 'nations', 'no rows' from w group by s_nationkey having count(*) filter (k % 10 <> 3) = 0""")
def sheet_problems(spark, d):
    return parsed(spark, d).problems


@query(f"with {Q} select sheet, category, ids, string_agg(name || ' ' || cast(qty as bigint), ', ' order by row, name, qty) as data from rows where label <> 'parts' group by all")
def sheet_records(spark, d):
    found = configured.records(parsed(spark, d).rows.filter("label <> 'parts'"))
    shown = F.transform("data", lambda x: F.concat(x["name"], F.lit(" "), x["qty"].cast("bigint").cast("string")))
    return found.select("sheet", "category", flat("ids").alias("ids"), F.array_join(shown, ", ").alias("data"))


@query(f"with {W} select 'nation ' || s_nationkey as sheet, cast(s_nationkey % 3 + 1 as integer) as header_row from w group by s_nationkey union all select 'parts of ' || p_brand, 2 from part group by p_brand union all select * from (values ('blocks', 2), ('joined', 3), ('plans', 3), ('odd', 1), ('bare', 1), ('unnumbered', 1)) v(s, r)")
def sheet_header_rows(spark, d):
    cells, labels, _ = sent(spark, d)
    return configured.header_rows(configured.typed(cells), labels.join(spark.createDataFrame(CONFIGURATIONS, configured.CONFIGURATION), "label"))
