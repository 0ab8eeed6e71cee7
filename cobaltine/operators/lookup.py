"""Deterministic lookups: routes, remarks, codes and statuses that rows of chunk tables hold.

Chunks are (chunk_id, chunk_type, headers, row): the headers of a table and one of its rows
as a map.  Each index is a table of its own; requests (query_id, url, payload) meet all four
in equi-joins.  What several requests hit alike is found and ordered once.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import written
from .retrieval import normalize_url, remark_groups, strip_markdown

#: fixed values: parts of header names that tell what a column holds
PATH_HEADERS = ("path", "路径", "url", "endpoint")
REMARK_HEADERS = ("processremark", "message", "触发文案", "错误", "errormsg")
CODE_HEADERS = ("code", "resultcode")
MESSAGE_HEADERS = ("message",)
LABEL_HEADERS = ("enum", "name", "constant")
VALUE_HEADERS = ("value", "值")
#: order of the layers in an answer
LAYERS = ("route", "errorCode", "status", "remark")


def names(plain: Column, keys: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(plain, F.lit(k)) for k in keys])


def cells(chunks: DataFrame) -> DataFrame:
    """(chunk_id, header, name, value, method, with_message, with_value) of the table rows among the chunks.

    ``name`` is the header as plain lower-case text; the last two tell whether the table has a message or a value column.
    """
    rows = chunks.filter((F.col("chunk_type") == "table_row") & (F.size("row") > 0) & (F.size("headers") > 0)).select("chunk_id", "headers", "row")
    plain = rows.withColumn("names", F.transform("headers", lambda h: F.lower(strip_markdown(h))))
    method = F.get(F.transform(F.filter(F.arrays_zip("headers", "names"), lambda h: h["names"] == "method"), lambda h: h["headers"]), F.lit(0))
    has = lambda keys: F.exists("names", lambda n: names(n, keys))
    told = plain.select("chunk_id", "row", F.coalesce(strip_markdown(F.try_element_at("row", method)), F.lit("")).alias("method"), has(MESSAGE_HEADERS).alias("with_message"), has(VALUE_HEADERS).alias("with_value"), F.explode(F.arrays_zip("headers", "names")).alias("h"))
    return told.select("chunk_id", F.col("h.headers").alias("header"), F.col("h.names").alias("name"), F.coalesce(F.try_element_at("row", "h.headers"), F.lit("")).alias("value"), "method", "with_message", "with_value")


def paths(cell: Column) -> Column:
    """Paths in a cell: those in code marks, or else the words that start with a slash."""
    marked = F.transform(F.regexp_extract_all(cell, F.lit("`(/[^`]+)`"), F.lit(1)), lambda x: F.trim(x))
    bare = F.filter(F.transform(F.split(cell, r"[<,，、\s]+"), lambda x: F.trim(x, F.lit("`"))), lambda x: x.startswith("/") & (F.length(x) > 1))
    return F.when(F.size(marked) > 0, marked).otherwise(bare)


def held_templates(found: DataFrame, *more: str) -> DataFrame:
    return found.filter(names(F.col("name"), PATH_HEADERS)).select("chunk_id", F.explode(paths(F.col("value"))).alias("template"), *more)


def held_remarks(found: DataFrame, *more: Column) -> DataFrame:
    told = found.filter(names(F.col("name"), REMARK_HEADERS)).select("chunk_id", *more, strip_markdown(F.col("value")).alias("text"))
    return told.filter(F.length("text") >= 4)


def held_codes(found: DataFrame) -> DataFrame:
    told = found.filter(F.col("with_message") & names(F.col("name"), CODE_HEADERS)).select("chunk_id", strip_markdown(F.col("value")).alias("code"))
    return told.filter(F.length("code").between(1, 16) & ~F.contains("code", F.lit(" ")))


def held_statuses(found: DataFrame) -> DataFrame:
    wanted = F.when(F.col("with_value"), names(F.col("name"), VALUE_HEADERS)).otherwise(names(F.col("name"), LABEL_HEADERS))
    words = F.transform(F.split(strip_markdown(F.col("value")), r"[,，/\s]+"), lambda x: F.trim(x, F.lit("`")))
    return found.filter(wanted).select("chunk_id", F.explode(words).alias("status")).filter(F.length("status").between(2, 32))


def routes(chunks: DataFrame) -> DataFrame:
    """(chunk_id, template, method)."""
    return held_templates(cells(chunks), "method")


def remarks(chunks: DataFrame) -> DataFrame:
    """(chunk_id, header, text) of remarks of four characters or more."""
    return held_remarks(cells(chunks), strip_markdown(F.col("header")).alias("header"))


def codes(chunks: DataFrame) -> DataFrame:
    """(chunk_id, code) of tables that have a message column too; long texts and texts with blanks are no codes."""
    return held_codes(cells(chunks))


def statuses(chunks: DataFrame) -> DataFrame:
    """(chunk_id, status): the words of 2 to 32 characters in value columns, or in label columns where there is no value column."""
    return held_statuses(cells(chunks)).distinct()


def payload_values(requests: DataFrame, keys: dict[int, tuple[str, ...]]) -> DataFrame:
    """(query_id, place, value): for each place of ``keys`` the payload's fields with one of its names (lower-cased), whatever their case; blanks are left out."""
    asked = requests.select("query_id", F.explode("payload").alias("name", "value")).filter(F.lower("name").isin(*{k for named in keys.values() for k in named}) & (F.col("value") != ""))
    places = F.array(*[F.when(F.lower("name").isin(*named), F.lit(place)) for place, named in keys.items()])
    return asked.select("query_id", F.explode(places).alias("place"), "value").filter("place is not null")


#: distinct places of wildcards that are sent to the requests
MOST_SHAPES = 100_000


def route_groups(requests: DataFrame, index: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(query_id, literal, group) of requests and (group, chunk_id) of templates; a template fits a path segment by segment where they share a group.

    Templates have few shapes, that is places of their wildcards.  A path is written once for
    each shape of its length, with its segments at those places left open, and then meets
    the templates in an equi-join on the whole text.
    """
    cut = lambda c: F.split(F.trim(c, F.lit("/")), "/")
    wild = lambda t: t.startswith("{") & t.endswith("}")
    # never null, so that the join does not look for nulls, which would cut each text again
    size = lambda c: F.coalesce(F.size(c), F.lit(0))
    held = index.select("chunk_id", cut(F.col("template")).alias("parts")).withColumn("shape", F.transform("parts", wild))
    mark = F.array_join(F.transform("shape", lambda w: F.when(w, "1").otherwise("0")), "")
    group = lambda mark, path: F.concat(mark, F.lit(":"), path)
    opened = F.array_join(F.transform("parts", lambda t: F.when(wild(t), "{}").otherwise(t)), "/")
    asked = requests.filter("url <> ''").select("query_id", cut(normalize_url(F.col("url"))).alias("segments")).withColumn("size", size("segments"))
    literal = F.size(F.filter("shape", lambda w: ~w))
    shapes = held.select(size("parts").alias("size"), "shape").distinct().select("size", "shape", mark.alias("mark"), literal.alias("literal"))
    # shapes are few, but that is looked at: they go to the requests, or else a length meets its shapes in a shuffle
    few = shapes.count() <= MOST_SHAPES
    shaped = asked.join(F.broadcast(shapes) if few else shapes, "size")
    open_ = F.array_join(F.zip_with("segments", "shape", lambda s, w: F.when(w, "{}").otherwise(s)), "/")
    return shaped.select("query_id", "literal", group(F.col("mark"), open_).alias("group")), held.select(group(mark, opened).alias("group"), "chunk_id")


def route_hits(requests: DataFrame, index: DataFrame) -> DataFrame:
    """(query_id, chunk_id, literal): templates that fit a path segment by segment."""
    asked, held = route_groups(requests, index)
    return asked.join(held, "group").groupBy("query_id", "chunk_id").agg(F.max("literal").alias("literal"))


#: hits that are kept together in a row
BLOCK = 1000
#: rows that a task puts out, more or less, unless there would be too many tasks
TASK_ROWS = 16_000_000
MOST_TASKS = 10_000


def hits(requests: DataFrame, chunks: DataFrame, code_keys: tuple[str, ...] = (), status_keys: tuple[str, ...] = (), remark_keys: tuple[str, ...] = ()) -> DataFrame:
    """(query_id, chunk_id, layer, rank): what requests (query_id, url, payload) hit, each chunk once a layer.

    Order: routes with more literal segments first, then codes, statuses and remarks; within
    a layer by chunk_id.  The keys name, in lower case, the payload fields to look up.

    Hits can be as many as requests times chunks, so no pair of the two is shuffled or sorted.
    Requests that ask a layer for the same texts have the same hits there: these are found and
    numbered once and kept as arrays of BLOCK, which the requests meet as they are put out.
    Where a layer starts in a request's ranks follows from the numbers of hits before it.
    Chunks and payloads are taken apart once, and what is put out is dealt to tasks by its
    rows: it may be a thousand times what the tasks read.
    """
    tasks = int(requests.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    route, code, status, remark = range(len(LAYERS))
    wanted_names = (*PATH_HEADERS, *REMARK_HEADERS, *CODE_HEADERS, *LABEL_HEADERS, *VALUE_HEADERS)
    found = written(cells(chunks.repartition(tasks, "chunk_id")).filter(names(F.col("name"), wanted_names)).select("chunk_id", "name", "value", "with_message", "with_value"), "cells")
    fields = written(payload_values(requests, {code: code_keys, status: status_keys, remark: remark_keys}), "fields")
    exact = lambda place: fields.filter(F.col("place") == place).select("query_id", F.lit(0).alias("literal"), F.trim(F.trim("value"), F.lit("`")).alias("group"))
    texts, told = remark_groups(fields.filter(F.col("place") == remark).select("query_id", F.col("value").alias("text")), held_remarks(found).select(F.col("chunk_id").alias("remark_id"), F.col("text").alias("remark")))
    paths_, templates = route_groups(requests, held_templates(found))
    layered = {
        route: (paths_, templates),
        code: (exact(code), held_codes(found).select(F.col("code").alias("group"), "chunk_id")),
        status: (exact(status), held_statuses(found).select(F.col("status").alias("group"), "chunk_id")),
        remark: (texts.select("query_id", F.lit(0).alias("literal"), F.col("q").alias("group")), told.select(F.col("q").alias("group"), F.col("remark_id").alias("chunk_id"))),
    }
    held = written(reduce(DataFrame.unionByName, [index.select(F.lit(place).alias("place"), "group", "chunk_id") for place, (_, index) in layered.items()]).distinct(), "held")
    asked = reduce(DataFrame.unionByName, [asks.select("query_id", F.lit(place).alias("place"), "literal", "group") for place, (asks, _) in layered.items()])
    known = asked.join(held.select("place", "group").distinct(), ["place", "group"], "left_semi")
    sets = written(known.groupBy("query_id", "place").agg(F.sort_array(F.collect_set(F.struct("literal", "group"))).alias("wanted")), "sets")
    kinds = written(sets.groupBy("place", "wanted").agg(F.count("*").alias("asks")).withColumn("set", F.monotonically_increasing_id()), "kinds")
    each = kinds.select("set", "place", F.explode("wanted").alias("w")).select("set", "place", "w.literal", "w.group").join(held, ["place", "group"])
    once = each.groupBy("set", "chunk_id").agg(F.max("literal").alias("literal"))
    numbered = once.withColumn("i", F.row_number().over(Window.partitionBy("set").orderBy(F.desc("literal"), "chunk_id")) - 1)
    packed = numbered.groupBy("set", F.floor(F.col("i") / BLOCK).cast("int").alias("block")).agg(F.sort_array(F.collect_list(F.struct("i", "chunk_id"))).alias("found"))
    blocks = written(packed.select("set", "block", F.col("found.chunk_id").alias("found")), "blocks")
    # a block that very many ask for is dealt to several tasks
    shares = F.ceil(F.col("asks") * F.least("size", F.lit(BLOCK)) / TASK_ROWS).cast("int")
    sized = kinds.join(blocks.groupBy("set").agg(F.sum(F.size("found")).alias("size")), "set").withColumn("shares", shares)
    rows = sized.agg(F.sum(F.col("asks") * F.col("size"))).first()[0] or 0
    parts = max(tasks, min(MOST_TASKS, -(-rows // TASK_ROWS)))
    before = F.sum("size").over(Window.partitionBy("query_id").orderBy("place").rowsBetween(Window.unboundedPreceding, -1))
    placed = sets.join(sized, ["place", "wanted"]).select("query_id", "place", "set", "size", F.pmod(F.xxhash64("query_id"), "shares").cast("int").alias("share"), F.coalesce(before, F.lit(0)).alias("before"))
    every = placed.withColumn("block", F.explode(F.sequence(F.lit(0), F.floor((F.col("size") - 1) / BLOCK).cast("int"))))
    layer, start = F.element_at(F.array(*[F.lit(x) for x in LAYERS]), F.col("place") + 1), (F.col("before") + F.col("block") * BLOCK + 1).cast("int")
    left = every.select("set", "block", "share", "query_id", layer.alias("layer"), start.alias("start")).repartition(parts, "set", "block", "share")
    right = blocks.join(sized.select("set", "shares"), "set").select("set", "block", F.explode(F.sequence(F.lit(0), F.col("shares") - 1)).alias("share"), "found").repartition(parts, "set", "block", "share")
    shown = left.join(right.hint("merge"), ["set", "block", "share"]).select("query_id", "layer", "start", F.posexplode("found").alias("i", "chunk_id"))
    return shown.select("query_id", "chunk_id", "layer", (F.col("start") + F.col("i")).alias("rank"))
