"""Chat formatting: links tool calls with their results.

Calls and results are joined by conversation and identifier.  A call may refer to results of
other calls, by ``{"$result": id}`` anywhere in its arguments; its level is one more than the
highest level it refers to, so (level, turn) is a topological order.  Arguments are checked
against the tool's schema, and each linked call is written as canonical JSON: keys sorted,
no blanks, characters unescaped where JSON allows.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import checkpoint

TYPES = {"object": dict, "array": list, "string": str, "boolean": bool, "integer": int, "number": (int, float), "null": type(None)}


#: halves of a character that stand alone, which UTF-8 cannot hold
LONE = re.compile("[\ud800-\udfff]")


def canonical(value: Any) -> str:
    """Keys sorted, no blanks, characters unescaped but for control characters, quotes, backslashes and lone surrogates."""
    text = json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False)
    return LONE.sub(lambda m: f"\\u{ord(m[0]):04x}", text)


def refused(constant: str) -> None:
    raise ValueError(f"{constant} is no JSON")


def parsed(text: str | None) -> Any:
    return json.loads(text or "", parse_constant=refused)


def examined(name: str | None, text: str | None, schemas: dict[str, dict]) -> tuple[str | None, list[str], list[str]]:
    """(canonical form, ids referred to, what is wrong) of a call's arguments."""
    try:
        value = parsed(text)
        return canonical(value), sorted(references(value)), problems(value, schemas[name]) if name in schemas else ["unknown tool"]
    except ValueError:  # of the parser, or a number beyond what a double or Python's digits hold
        return None, [], ["arguments are no JSON"]
    except RecursionError:
        return None, [], ["arguments are nested too deeply"]


def problems(value: Any, schema: dict, where: str = "$") -> list[str]:
    """What is wrong with a value: type, enum, required, properties, additionalProperties and items are looked at."""
    kind = schema.get("type")
    if kind and (not isinstance(value, TYPES[kind]) or isinstance(value, bool) and kind in ("integer", "number")):
        return [f"{where} is no {kind}"]
    found = [f"{where} is not one of the values allowed"] if "enum" in schema and value not in schema["enum"] else []
    if isinstance(value, dict):
        known = schema.get("properties", {})
        found += [f"{where}.{k} is missing" for k in sorted(schema.get("required", [])) if k not in value]
        for k in sorted(value):
            if k in known:
                found += problems(value[k], known[k], f"{where}.{k}")
            elif schema.get("additionalProperties") is False:
                found.append(f"{where}.{k} is unknown")
    if isinstance(value, list) and "items" in schema:
        for i, x in enumerate(value):
            found += problems(x, schema["items"], f"{where}[{i}]")
    return found


def references(value: Any) -> set[str]:
    if isinstance(value, dict):
        if set(value) == {"$result"} and isinstance(value["$result"], str):
            return {LONE.sub("\ufffd", value["$result"])}
        return set().union(*map(references, value.values()))
    return set().union(*map(references, value)) if isinstance(value, list) else set()


def checked(calls: DataFrame, schemas: dict[str, dict]) -> DataFrame:
    """Adds arguments in canonical form, the ids they refer to, and what is wrong with them."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, refs, wrong = [], [], []
            for name, text in zip(batch.column("name").to_pylist(), batch.column("arguments").to_pylist(), strict=True):
                of_call = examined(name, text, schemas)
                texts.append(of_call[0]), refs.append(of_call[1]), wrong.append([LONE.sub("\ufffd", w) for w in of_call[2]])
            yield pa.record_batch([*map(batch.column, names), pa.array(texts, pa.string()), pa.array(refs, pa.list_(pa.string())), pa.array(wrong, pa.list_(pa.string()))], [*names, "arguments", "refs", "problems"])

    names = ["conv_id", "call_id", "turn", "name", "n_calls"]
    return calls.select(*names, "arguments").mapInArrow(check, "conv_id long, call_id string, turn long, name string, n_calls long, arguments string, refs array<string>, problems array<string>")


def chains(single: DataFrame) -> DataFrame:
    """(conv_id, call_id, root, steps): where each chain of calls with one reference each ends, and how far that is.

    Each round doubles the steps that are known.  Calls on a cycle, or after one, are left out.
    """
    longest = single.groupBy("conv_id").count().agg(F.max("count")).first()[0] or 0
    hops, reach = checkpoint(single.select("conv_id", "call_id", F.col("ref").alias("root"), F.lit(1).alias("steps"))), 1
    inner = single.select("conv_id", F.col("call_id").alias("root"))
    while reach <= longest and hops.join(inner, ["conv_id", "root"], "left_semi").limit(1).count():
        further = hops.select("conv_id", F.col("call_id").alias("root"), F.col("root").alias("next"), F.col("steps").alias("more"))
        met = hops.join(further, ["conv_id", "root"], "left")
        hops, reach = checkpoint(met.select("conv_id", "call_id", F.coalesce("next", "root").alias("root"), (F.col("steps") + F.coalesce("more", F.lit(0))).alias("steps"))), 2 * reach
    return hops.join(inner, ["conv_id", "root"], "left_anti")


def levels(calls: DataFrame) -> DataFrame:
    """(conv_id, call_id, level); a call on a cycle, or after one, has none.  References to unknown ids count as level -1."""
    edges = calls.select("conv_id", "call_id", F.explode("refs").alias("ref"))
    known = calls.select("conv_id", F.col("call_id").alias("ref"))
    edges = checkpoint(edges.join(known, ["conv_id", "ref"], "left_semi").distinct())
    counted = edges.groupBy("conv_id", "call_id").agg(F.count("*").alias("n"), F.min("ref").alias("ref"))
    single = checkpoint(counted.filter("n = 1").drop("n"))
    ends = checkpoint(chains(single))
    joins = edges.join(counted.filter("n > 1").select("conv_id", "call_id"), ["conv_id", "call_id"], "left_semi")
    ahead = ends.select("conv_id", F.col("call_id").alias("ref"), "root", "steps")
    waits = checkpoint(joins.join(ahead, ["conv_id", "ref"], "left").select("conv_id", "call_id", F.coalesce("root", "ref").alias("ref"), F.coalesce("steps", F.lit(0)).alias("steps")))
    done = calls.select("conv_id", "call_id").join(counted, ["conv_id", "call_id"], "left_anti").withColumn("level", F.lit(0))
    while waits.count():  # one round for each level of calls with several references
        met = waits.join(done.select("conv_id", F.col("call_id").alias("ref"), "level"), ["conv_id", "ref"], "left")
        ready = met.groupBy("conv_id", "call_id").agg(F.count("*").alias("n"), F.count("level").alias("n_done"), F.max(F.col("level") + F.col("steps")).alias("level")).filter("n = n_done").select("conv_id", "call_id", (F.col("level") + 1).alias("level"))
        ready = checkpoint(ready)
        if not ready.count():
            break
        done = checkpoint(done.unionByName(ready))
        waits = checkpoint(waits.join(ready.select("conv_id", "call_id"), ["conv_id", "call_id"], "left_anti"))
    chained = ends.join(done.select("conv_id", F.col("call_id").alias("root"), "level"), ["conv_id", "root"])
    return done.unionByName(chained.select("conv_id", "call_id", (F.col("level") + F.col("steps")).alias("level")))


def link(calls: DataFrame, results: DataFrame, schemas: dict[str, dict]) -> DataFrame:
    """Links calls (conv_id, call_id, turn, name, arguments) with results (conv_id, call_id, turn, content).

    Returns for each identifier: conv_id, call_id, call_turn, result_turn, status (linked,
    unanswered, orphan for a result without call, early for a result before its call),
    n_calls, n_results, level, valid, problems and canonical.  Of several calls or results with one
    identifier the one of the smallest turn, then smallest content, counts.  Rows without
    conv_id or call_id take no part.  Arguments that are null, no JSON, hold NaN or a number
    out of range, or are nested deeper than the parser goes are a problem of the call, not an
    error; such a call refers to nothing.  Lone surrogates stay escaped.  Other columns are
    not looked at.
    """
    both = "conv_id is not null and call_id is not null"
    least = lambda df, *values: df.filter(both).groupBy("conv_id", "call_id").agg(F.min(F.struct("turn", *values)).alias("x"), F.count("*").alias("n")).select("conv_id", "call_id", "x.*", "n")
    calls = checkpoint(checked(least(calls, "name", "arguments").withColumnRenamed("n", "n_calls"), schemas))
    results = least(results, "content").select("conv_id", "call_id", F.col("turn").alias("result_turn"), "content", F.col("n").alias("n_results"))
    joined = calls.withColumnRenamed("turn", "call_turn").join(results, ["conv_id", "call_id"], "full").join(levels(calls), ["conv_id", "call_id"], "left")
    status = F.when(F.col("name").isNull() & F.col("call_turn").isNull(), "orphan").when(F.col("n_results").isNull(), "unanswered").when(F.col("result_turn") < F.col("call_turn"), "early").otherwise("linked")
    out = joined.select("conv_id", "call_id", "call_turn", "result_turn", status.alias("status"), F.coalesce("n_calls", F.lit(0)).alias("n_calls"), F.coalesce("n_results", F.lit(0)).alias("n_results"), "level", F.coalesce(F.size("problems") == 0, F.lit(False)).alias("valid"), F.coalesce("problems", F.array().cast("array<string>")).alias("problems"), "name", "arguments", "content")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for r in batch.select(["call_id", "name", "arguments", "content", "status"]).to_pylist():
                # arguments are canonical already, and their key comes first
                rest = canonical({"id": r["call_id"], "name": r["name"], "result": r["content"], "status": r["status"]})
                texts.append(f'{{"arguments":{r["arguments"] or "null"},{rest[1:]}')
            yield pa.record_batch([*map(batch.column, kept), pa.array(texts, pa.string())], [*kept, "canonical"])

    kept = ["conv_id", "call_id", "call_turn", "result_turn", "status", "n_calls", "n_results", "level", "valid", "problems"]
    return out.mapInArrow(write, "conv_id long, call_id string, call_turn long, result_turn long, status string, n_calls long, n_results long, level int, valid boolean, problems array<string>, canonical string")
