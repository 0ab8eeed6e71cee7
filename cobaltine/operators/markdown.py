"""Markdown documents as tables: lines, sections with their ancestors, table rows, chunks.

Everything is a window over the lines of one document, so documents spread over the cluster
and no text is parsed in Python.  Nulls count as empty texts.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import written
from .retrieval import slug

HEADING, FENCE, SEPARATOR = r"^(#{1,6})[ \t]+(.*)$", r"^\s*(```|~~~)", r"^\s*\|?\s*:?-+:?\s*(\|\s*:?-+:?\s*)+\|?\s*$"
LEVELS = range(1, 7)
#: characters of a task's documents, and what a document takes beside its own
PART_CHARACTERS, BESIDE = 4_000_000, 64


def parts_of(documents: DataFrame, text: str) -> int:
    """Tasks that documents are dealt to: they grow with the texts, so that what a task sorts does not."""
    total = documents.agg(F.sum(F.coalesce(F.length(text), F.lit(0)) + BESIDE)).first()[0]
    return max(1, -(-(total or 0) // PART_CHARACTERS))


def lines(documents: DataFrame, key: str, text: str, parts: int | None = None) -> DataFrame:
    """(key, line, value, fenced, level, title, section): level and title of heading lines outside of code, and the heading a line stands under (0 before the first).

    ``parts``, here and below, is the number of tasks; ``parts_of`` where it is not given.
    """
    whole = documents.select(key, text).repartition(parts or parts_of(documents, text), key)
    split = whole.select(key, F.posexplode(F.split(F.coalesce(text, F.lit("")), "\r?\n")).alias("line", "value"))
    order = Window.partitionBy(key).orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    mark = F.col("value").rlike(FENCE)
    fenced = split.withColumn("fenced", mark | (F.sum(mark.cast("int")).over(order) % 2 == 1))
    level = F.when(~F.col("fenced") & F.col("value").rlike(HEADING), F.length(F.regexp_extract("value", HEADING, 1)))
    headed = fenced.withColumn("level", level).withColumn("title", F.when(F.col("level").isNotNull(), F.trim(F.regexp_extract("value", HEADING, 2))))
    return headed.withColumn("section", F.count("level").over(order).cast("int"))


def sections(documents: DataFrame, key: str, text: str, parts: int | None = None) -> DataFrame:
    """(key, section, level, title, parent, path, body): each heading with its text; ``path`` has the titles from the top down.

    The parent is the nearest heading before it of a higher rank; 0 stands for none.  Text
    before the first heading is section 0.
    """
    all_lines = lines(documents, key, text, parts)
    plain = F.when(F.col("level").isNull(), F.struct("line", "value"))
    bodies = all_lines.groupBy(key, "section").agg(F.max("level").alias("level"), F.max("title").alias("title"), F.sort_array(F.collect_list(plain)).alias("rows"))
    heads = bodies.withColumn("body", F.regexp_replace(F.array_join(F.transform("rows", lambda r: r["value"]), "\n"), r"^\s+|\s+$", "")).drop("rows").filter("section > 0 or body <> ''")
    before = Window.partitionBy(key).orderBy("section").rowsBetween(Window.unboundedPreceding, -1)
    last = [F.last(F.when(F.col("level") == k, F.struct("section", "title")), ignorenulls=True).over(before) for k in LEVELS]
    seen = heads.withColumn("last", F.array(*last))
    # an earlier heading is an ancestor if no heading of its rank or a higher one came since
    above = F.filter(F.slice("last", 1, F.greatest(F.col("level") - 1, F.lit(0))), lambda x: x.isNotNull())
    kept = F.filter("above", lambda x, i: F.forall(F.slice(F.col("above"), 1, i), lambda y: y["section"] < x["section"]))
    found = seen.withColumn("above", F.when(F.col("level") > 1, above).otherwise(F.filter("last", lambda x: F.lit(False)))).withColumn("above", kept)
    path = F.concat(F.transform("above", lambda x: x["title"]), F.array(F.coalesce("title", F.lit(""))))
    parent = F.coalesce(F.try_element_at("above", F.lit(-1))["section"], F.lit(0))
    return found.select(key, "section", F.coalesce("level", F.lit(0)).alias("level"), F.coalesce("title", F.lit("")).alias("title"), parent.alias("parent"), path.alias("path"), "body")


def cut(row: Column) -> Column:
    bare = F.regexp_replace(F.trim(row), r"^\||\|$", "")
    return F.transform(F.split(bare, r"\|"), lambda cell: F.trim(cell))


def table_rows(documents: DataFrame, key: str, text: str, parts: int | None = None) -> DataFrame:
    """(key, section, line, headers, cells) of each data row of the tables of two columns or more.

    Short rows are filled up with empty cells; what a row has too many stays in its last
    cell, joined by `` | ``.
    """
    piped = lines(documents, key, text, parts).filter(~F.col("fenced") & F.col("value").contains("|"))
    order = Window.partitionBy(key).orderBy("line")
    island = piped.withColumn("island", F.col("line") - F.row_number().over(order))
    inside = Window.partitionBy(key, "island").orderBy("line")
    placed = island.withColumns({"place": F.row_number().over(inside), "head": F.first("value").over(inside), "rule": F.nth_value("value", 2).over(inside)})
    rows = placed.filter((F.col("place") > 2) & F.col("rule").rlike(SEPARATOR)).select(key, "section", "line", cut(F.col("head")).alias("headers"), cut(F.col("value")).alias("found"))
    n, m = F.size("headers"), F.size("found")
    filled = F.concat("found", F.array_repeat(F.lit(""), F.greatest(n - m, F.lit(0))))
    joined = F.concat(F.slice("found", 1, n - 1), F.array(F.array_join(F.slice("found", n, F.greatest(m - n + 1, F.lit(1))), " | ")))
    return rows.filter(n >= 2).select(key, "section", "line", "headers", F.when(m > n, joined).otherwise(filled).alias("cells"))


def chunks(documents: DataFrame, key: str, text: str, parts: int | None = None) -> DataFrame:
    """(key, chunk_id, chunk_type, title, body): one chunk for each section and one for each table row.

    Ids are slugs of the path; equal ones of a document are numbered from the second on.
    """
    parts = parts or parts_of(documents, text)
    heads = sections(documents, key, text, parts)
    named = heads.withColumn("base", F.coalesce(F.nullif(F.array_join(F.transform("path", slug), "/"), F.lit("")), F.lit("section")))
    place = F.row_number().over(Window.partitionBy(key, "base").orderBy("section"))
    named = named.withColumn("chunk_id", F.concat("base", F.when(place > 1, F.concat(F.lit("-"), place.cast("string"))).otherwise("")))
    whole = named.select(key, "chunk_id", F.lit("section").alias("chunk_type"), F.array_join("path", " > ").alias("title"), "body")
    number = F.row_number().over(Window.partitionBy(key, "section").orderBy("line"))
    shown = F.array_join(F.zip_with("headers", "cells", lambda h, c: F.concat(h, F.lit(": "), c)), "\n")
    rows = table_rows(documents, key, text, parts).select(key, "section", number.alias("row"), shown.alias("body")).join(named.select(key, "section", "chunk_id", "path"), [key, "section"])
    return whole.unionByName(rows.select(key, F.concat("chunk_id", F.lit("#row-"), F.col("row").cast("string")).alias("chunk_id"), F.lit("table_row").alias("chunk_type"), F.array_join("path", " > ").alias("title"), "body"))


def code_blocks(documents: DataFrame, key: str, text: str, parts: int | None = None) -> DataFrame:
    """(key, section, line, language, content) of each fenced block; one that is not closed takes the rest of the document."""
    marked = lines(documents, key, text, parts).withColumn("mark", F.col("value").rlike(FENCE))
    so_far = Window.partitionBy(key).orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    inside = marked.withColumn("marks", F.sum(F.col("mark").cast("int")).over(so_far)).filter("fenced").withColumn("block", F.floor((F.col("marks") + 1) / 2))
    opens = F.col("mark") & (F.col("marks") % 2 == 1)
    content = F.sort_array(F.collect_list(F.when(~F.col("mark"), F.struct("line", "value"))))
    return (
        inside.groupBy(key, "block")
        .agg(F.max("section").alias("section"), F.min("line").alias("line"), F.max(F.when(opens, F.regexp_extract("value", r"^\s*(?:```|~~~)\s*(\S*)", 1))).alias("language"), content.alias("rows"))
        .select(key, "section", "line", "language", F.array_join(F.transform("rows", lambda r: r["value"]), "\n").alias("content"))
    )


def trees(heads: DataFrame, key: str) -> DataFrame:
    """(key, title, summary, sections): each document's sections as one nested JSON array, from the rows of ``sections``.

    A node has section, level, title, body and children.  Nodes are folded into their parents
    from the deepest to the top, one join a depth, six at most, as headings have six ranks; a skipped rank makes no
    depth of its own.  The summary is the text before the first heading, the title the first heading of rank one, else of any.
    """
    node = F.to_json(F.struct("section", "level", "title", "body"))
    shown = heads.withColumns({"depth": F.size("path"), "node": node})
    nodes = written(shown.select(key, "section", "parent", "level", "title", "body", "depth", F.expr("left(node, length(node) - 1)").alias("head")), "nodes")
    folded = None
    for d in reversed(LEVELS):
        at = nodes.filter((F.col("depth") == d) & (F.col("section") > 0))
        children = F.lit("")
        if folded is not None:
            at, children = at.join(folded, [key, "section"], "left"), F.coalesce("children", F.lit(""))
        whole = at.select(key, "section", "parent", F.concat("head", F.lit(',"children":['), children, F.lit("]}")).alias("json"))
        ordered = F.sort_array(F.collect_list(F.struct("section", "json")))
        folded = whole.groupBy(key, F.col("parent").alias("section")).agg(F.array_join(F.transform(ordered, lambda x: x["json"]), ",").alias("children"))
    top = folded.filter("section = 0").select(key, F.concat(F.lit("["), "children", F.lit("]")).alias("sections"))
    rank = F.when(F.col("section") > 0, F.struct((F.col("level") > 1).alias("lower"), "section", "title"))
    facts = nodes.groupBy(key).agg(F.min(rank).alias("first"), F.max(F.when(F.col("section") == 0, F.col("body"))).alias("summary"))
    return facts.join(top, key, "left").select(key, F.coalesce("first.title", F.lit("")).alias("title"), F.coalesce("summary", F.lit("")).alias("summary"), F.coalesce("sections", F.lit("[]")).alias("sections"))


def unfolded(nested: DataFrame, key: str) -> DataFrame:
    """(key, section, level, title, parent, body): the rows of ``trees`` as a table again."""
    leaf = "section: int, level: int, title: string, body: string"
    kind = f"array<struct<{leaf}>>"
    for _ in LEVELS:
        kind = f"array<struct<{leaf}, children: {kind}>>"
    found, now = [], nested.select(key, F.lit(0).alias("parent"), F.from_json("sections", kind).alias("nodes"))
    for _ in LEVELS:
        each = now.select(key, "parent", F.explode("nodes").alias("n"))
        found.append(each.select(key, "n.section", "n.level", "n.title", "parent", "n.body"))
        now = each.select(key, F.col("n.section").alias("parent"), F.col("n.children").alias("nodes"))
    return reduce(DataFrame.unionByName, found)


def index(documents: DataFrame, key: str, text: str) -> DataFrame:
    """(key, title, section_count, chunk_count, table_rows, code_blocks): what a knowledge base's index says of each document."""
    counted = lambda rows, name: rows.groupBy(key).agg(F.count("*").alias(name))
    tasks = parts_of(documents, text)
    heads = sections(documents, key, text, tasks)
    first = heads.filter("section > 0").groupBy(key).agg(F.min(F.struct((F.col("level") > 1).alias("lower"), "section", "title"))["title"].alias("title"))
    parts = {"section_count": heads.filter("section > 0"), "chunk_count": chunks(documents, key, text, tasks), "table_rows": table_rows(documents, key, text, tasks), "code_blocks": code_blocks(documents, key, text, tasks)}
    out = documents.select(key).distinct().join(first, key, "left").withColumn("title", F.coalesce("title", F.lit("")))
    for name, rows in parts.items():
        out = out.join(counted(rows, name), key, "left").withColumn(name, F.coalesce(name, F.lit(0).cast("bigint")))
    return out


def write_base(documents: DataFrame, key: str, text: str, path: str) -> None:
    """A knowledge base below ``path``: tree (a document a line), chunks by document and index, each replaced as a whole."""
    trees(sections(documents, key, text), key).write.mode("overwrite").json(f"{path}/tree")
    chunks(documents, key, text).write.mode("overwrite").partitionBy(key).json(f"{path}/chunks")
    index(documents, key, text).write.mode("overwrite").json(f"{path}/index")
