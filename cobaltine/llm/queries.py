"""The queries of this subpackage: each applies an operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, containment, langid, linededup, lloyd, multiindex, neardup, pii, repair, resampling, toolcalls, windows, wordbpe

VOCABULARY = "byte_bpe_50k.tiktoken"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text", "lang").withColumn("held_out", F.coalesce(langid.held_out(F.col("doc_id")), F.lit(False)))
    model = langid.train(documents.filter("not held_out"))
    out = langid.identify(documents, model)
    return out.select("doc_id", F.coalesce(langid.held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "lang_pred", "score", "rejected")


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.tokenize(table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY))


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.dedup_windows(table(spark, sf_dir, "documents"), window=13).drop("kept")


TURN = {"type": "object", "required": ["text", "turn"], "properties": {"text": {"type": "string"}, "turn": {"type": "integer"}, "after": {"type": "object"}}, "additionalProperties": False}
#: the table has plain turns only: each turn of the user counts as a call of one tool, any other turn but the assistant's as a call of another; an assistant's turn after it is its result, and the result before it what it refers to
TOOLS = {"reply": TURN, "instruct": TURN}


def op4_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each turn of ``conversations`` as a call or a result; turns without conv_id or turn take no part."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    named = lambda turn: F.concat_ws("-", F.lit("call"), F.col("conv_id"), turn)
    answered = turns.filter("role = 'assistant'").select("conv_id", (F.col("turn") + 1).alias("turn"), F.lit(True).alias("answered")).distinct()
    after = F.when(F.col("answered"), F.struct(named(F.col("turn") - 2).alias("$result")))
    arguments = F.to_json(F.struct("turn", "text", after.alias("after")))
    tool = F.when(F.col("role") == "user", "reply").otherwise("instruct")
    asked = turns.filter("turn is not null and not coalesce(role = 'assistant', false)")
    calls = asked.join(answered, ["conv_id", "turn"], "left").select("conv_id", named(F.col("turn")).alias("call_id"), "turn", tool.alias("name"), arguments.alias("arguments"))
    results = turns.filter("turn is not null and role = 'assistant'").select("conv_id", named(F.col("turn") - 1).alias("call_id"), "turn", F.col("text").alias("content"))
    return toolcalls.link(calls, results, TOOLS).drop("problems")


def op5_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return multiindex.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20)


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_pii(table(spark, sf_dir, "documents"))
    base = [k.name for k in pii.KINDS if k.base]
    count = lambda name: F.size(F.filter("spans", lambda s: s["kind"] == name)).cast("long").alias(f"n_{name}")
    digest = F.sha2(pii.listed(F.filter("spans", lambda s: s["kind"].isin(base))).cast("binary"), 256)
    scored = F.array_join(F.transform("spans", lambda s: F.format_string("%.1f", s["score"])), ",")
    more = [count("iban"), F.size("spans").cast("long").alias("n_spans"), scored.alias("scores")]
    return found.select("doc_id", *map(count, base), digest.alias("base_sha256"), pii.listed(F.col("spans")).alias("spans"), *more)


def op7_quality_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic")
    good = F.coalesce((F.col("quality") == 1) & (F.col("toxic") == 0), F.lit(False))
    share = labels.agg(F.avg(good.cast("int"))).first()[0] or 0.0
    return resampling.resample(table(spark, sf_dir, "documents"), labels.filter(good), share=share)


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return containment.contained_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"), size=3, percent=85)


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.dedup_lines(table(spark, sf_dir, "documents"), min_docs=10, min_chars=1).drop("kept")


def op11_word_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row of ``documents``; a null text is empty, long texts and repeated rows are encoded whole."""
    return wordbpe.tokenize(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation of ``conversations``, damaged by the checksum of its rows, and what its cheapest repair costs.

    Rows without turn come first, those without conv_id are one conversation, equal rows are
    duplicates; of a conversation that lost all its rows nothing is left to repair.
    """
    return repair.repair(repair.damaged(table(spark, sf_dir, "conversations")))


def op13_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every usable vector of ``embeddings``; repeated rows are vectors like others."""
    order = F.sha2(F.concat(F.lit("3:"), F.col("vec_id").cast("string")), 256)
    return lloyd.delta_lloyd(table(spark, sf_dir, "embeddings"), order, k=8, rounds=10)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_language_id, op2_byte_bpe, op3_substring_dedup, op4_tool_calls, op5_nearest, op6_pii, op7_quality_sample, op8_decontamination, op9_near_duplicates, op10_line_dedup, op11_word_bpe, op12_conversation_repair, op13_centroids)}


def oracle_sql() -> dict[str, str]:
    from .sql import ORACLES

    return dict(ORACLES)
