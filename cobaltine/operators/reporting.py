"""Business reports: order summary and pages, user activity, retention, cohorts, simple insights."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def order_summary(orders: DataFrame, dimension: Column | str, paid: Column, cancelled: Column) -> DataFrame:
    """Orders, revenue of paid ones and mean amount by a dimension; cancelled orders do not count.

    ``orders`` has order_id, amount and what the columns name.  Amounts are in cents at most, so the
    mean comes from the sum rounded to cents: in whatever order rows arrive, it is the same.
    """
    key = F.col(dimension) if isinstance(dimension, str) else dimension
    return orders.filter(~cancelled).groupBy(key.alias("dimension")).agg(
        F.count("*").alias("order_count"),
        F.round(F.sum(F.when(paid, F.col("amount")).otherwise(0.0)), 2).alias("gmv"),
        F.round(F.round(F.sum("amount"), 2) / F.count("amount"), 6).alias("avg_amount"),
    )


def order_filter(orders: DataFrame, start: str | None = None, end: str | None = None, status: str = "all", statuses: dict[str, str] | None = None, **equal: str) -> DataFrame:
    """Orders (day, status, ..) from ``start`` to ``end``, both included, with a status and with given values of other columns.

    ``status`` is all, paid, cancelled or refunded; ``statuses`` says how the table writes them.
    """
    if start:
        orders = orders.filter(F.col("day") >= F.lit(start).cast("date"))
    if end:
        orders = orders.filter(F.col("day") <= F.lit(end).cast("date"))
    if status != "all":
        orders = orders.filter(F.col("status") == (statuses or {}).get(status, status))
    for name, value in equal.items():
        orders = orders.filter(F.col(name) == value)
    return orders


def order_page(orders: DataFrame, sort_by: str = "amount", descending: bool = True, limit: int = 20, offset: int = 0) -> DataFrame:
    order = F.desc(sort_by) if descending else F.asc(sort_by)
    return orders.orderBy(order, "order_id").offset(offset).limit(limit)


def first_seen(events: DataFrame) -> DataFrame:
    """(user_id, first_day) of events (user_id, day)."""
    return events.groupBy("user_id").agg(F.min("day").alias("first_day"))


def new_users(events: DataFrame) -> DataFrame:
    return first_seen(events).groupBy(F.col("first_day").alias("day")).agg(F.count("*").alias("new_users"))


def active_users(events: DataFrame, days: int = 1) -> DataFrame:
    """Distinct users of each day and the ``days - 1`` before it, for days with events.

    Each user's day counts for the following days too; that multiplies rows by ``days`` and
    joins nothing.
    """
    per_day = events.select("user_id", "day").distinct()
    if days == 1:
        return per_day.groupBy("day").agg(F.count("*").alias("users"))
    span = per_day.agg(F.max("day").alias("end"))
    spread = per_day.select("user_id", F.explode(F.sequence("day", F.date_add("day", days - 1))).alias("day")).distinct()
    return spread.join(F.broadcast(span)).filter("day <= end").groupBy("day").agg(F.count("*").alias("users"))


def retention(events: DataFrame, after: int) -> DataFrame:
    """Share of each day's new users who are active ``after`` days later."""
    first = first_seen(events)
    later = events.select("user_id", "day").distinct()
    back = first.withColumn("day", F.date_add("first_day", after)).join(later, ["user_id", "day"], "left_semi").select("user_id").withColumn("back", F.lit(1))
    return first.join(back, "user_id", "left").groupBy(F.col("first_day").alias("day")).agg(F.round(F.sum(F.coalesce("back", F.lit(0))) / F.count("*"), 4).alias("retention"))


def cohorts(events: DataFrame, offsets: tuple[int, ...] = (1, 7, 30), dimension: DataFrame | None = None) -> DataFrame:
    """Size of each cohort (users by first day) and how many come back after some days.

    ``dimension`` (user_id, dimension) splits the cohorts further; users without a row there
    have a null one.
    """
    joined = events.select("user_id", "day").distinct().join(first_seen(events), "user_id")
    gap, keys = F.date_diff("day", "first_day"), [F.col("first_day").alias("cohort")]
    if dimension is not None:
        joined, keys = joined.join(dimension.select("user_id", "dimension"), "user_id", "left"), [*keys, F.col("dimension")]
    return joined.groupBy(*keys).agg(F.count_if(gap == 0).alias("size"), *[F.count_if(gap == n).alias(f"day_{n}") for n in offsets])


def insights(report: DataFrame, measures: list[str], least: float = 0.2) -> DataFrame:
    """(measure, low, high, spread) of measures that differ by more than ``least`` between the rows."""
    long = report.unpivot([], measures, "measure", "value") if len(measures) > 1 else report.select(F.lit(measures[0]).alias("measure"), F.col(measures[0]).alias("value"))
    span = long.groupBy("measure").agg(F.min("value").alias("low"), F.max("value").alias("high"), F.count("*").alias("n"))
    spread = (F.col("high") - F.col("low")) / F.col("low")
    return span.filter((F.col("n") >= 2) & (F.col("low") > 0)).withColumn("spread", F.round(spread, 4)).filter(spread > least).drop("n")


def chart(report: DataFrame, kind: str = "bar") -> dict:
    """Chart settings: the first column gives categories, the first numeric one values; at most 500 rows."""
    rows = report.limit(500).collect()
    numeric = [c for c, t in report.dtypes if t in ("int", "bigint", "double", "float") or t.startswith("decimal")]
    category, value = report.columns[0], next((c for c in numeric if c != report.columns[0]), report.columns[-1])
    return {"xAxis": {"type": "category", "data": [r[category] for r in rows]}, "yAxis": {"type": "value"}, "series": [{"type": kind, "name": value, "data": [r[value] for r in rows]}]}


def batch_counts(results: DataFrame) -> DataFrame:
    """One row: how many series have results and how many an error."""
    by_series = results.groupBy("series").agg(F.max(F.col("error").isNotNull()).alias("failed"))
    return by_series.agg(F.count_if(~F.col("failed")).alias("successes"), F.count_if("failed").alias("errors"))


def shown_turns(conversations: DataFrame) -> DataFrame:
    """What users and assistants said: no turns of other roles and no empty ones, as calls of tools are."""
    return conversations.filter(F.col("role").isin("user", "assistant") & (F.trim("text") != ""))


def recent_turns(conversations: DataFrame, n: int = 8) -> DataFrame:
    """The last ``n`` turns of each conversation, numbered from its end."""
    back = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("turn")))
    return conversations.withColumn("back", back).filter(F.col("back") <= n)


def search_turns(conversations: DataFrame, needle: str, limit: int = 5, before: int = 120, after: int = 240) -> DataFrame:
    """Turns that hold the text, whatever its case, with a snippet around its first place."""
    at = F.instr(F.lower("text"), needle.lower())
    hits = conversations.filter(at > 0)
    snippet = F.substr("text", F.greatest(at - before, F.lit(1)), F.least(at - 1, F.lit(before)) + len(needle) + after)
    return hits.select("conv_id", "turn", snippet.alias("snippet")).orderBy(F.desc("conv_id"), F.desc("turn")).limit(limit)


def conversation_summary(conversations: DataFrame) -> DataFrame:
    """Turns, roles and the first words of each conversation."""
    first = F.min_by(F.regexp_replace("text", r"\s+", " "), "turn")
    return conversations.groupBy("conv_id").agg(F.count("*").alias("turns"), F.array_join(F.sort_array(F.collect_set("role")), ",").alias("roles"), F.substring(first, 1, 60).alias("opening"))


def shortened(text: Column, most: int) -> Column:
    """White space as single spaces, at most ``most`` characters, the last one an ellipsis where text was cut."""
    flat = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " "))
    return F.when(F.length(flat) <= most, flat).otherwise(F.concat(F.rtrim(F.substring(flat, 1, most - 1)), F.lit("…")))


def compacted(conversations: DataFrame, threshold: int = 8, recent: int = 8) -> DataFrame:
    """(conv_id, turn, role, text): conversations of more than ``threshold`` turns become a summary and their last turns.

    The summary is a system turn, numbered one before the first turn that stays: counts of
    turns, the first and the last user turn.  Turns without text do not count in it.
    """
    back = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("turn")))
    placed = conversations.select("conv_id", "turn", "role", "text").withColumn("back", back).withColumn("n", F.count("*").over(Window.partitionBy("conv_id")))
    kept = placed.filter((F.col("n") <= threshold) | (F.col("back") <= recent)).select("conv_id", "turn", "role", "text")
    spoken = F.trim(F.coalesce("text", F.lit(""))) != ""
    user = spoken & (F.col("role") == "user")
    ask = lambda pick, most: shortened(pick(F.when(user, F.col("text")), F.when(user, F.col("turn"))), most)
    counted = placed.filter(F.col("n") > threshold).groupBy("conv_id").agg(
        F.min(F.when(F.col("back") <= recent, F.col("turn"))).alias("first_kept"),
        F.count_if(spoken).alias("turns"),
        F.count_if(user).alias("users"),
        F.count_if(spoken & (F.col("role") == "assistant")).alias("assistants"),
        ask(F.min_by, 220).alias("goal"),
        ask(F.max_by, 260).alias("latest"),
    )
    latest = F.when((F.col("latest") != "") & (F.col("latest") != F.col("goal")), F.concat(F.lit("Latest: "), "latest"))
    text = F.concat_ws("\n", F.format_string("Turns: %d, user: %d, assistant: %d", "turns", "users", "assistants"), F.when(F.col("goal") != "", F.concat(F.lit("Goal: "), "goal")), latest)
    return kept.unionByName(counted.select("conv_id", (F.col("first_kept") - 1).cast(conversations.schema["turn"].dataType).alias("turn"), F.lit("system").alias("role"), text.alias("text")))


def identity_summary(rows: DataFrame, fields: list[str], most: int = 5) -> DataFrame:
    """(field, values): the first values of each field in order, as text; nulls and empty ones are left out.

    Values are made distinct before they are ranked, so no group of rows is collected.
    """
    long = rows.select([F.col(f"`{c}`").cast("string").alias(c) for c in fields]).unpivot([], fields, "field", "value").filter("value <> ''").distinct()
    place = F.row_number().over(Window.partitionBy("field").orderBy("value"))
    first = long.withColumn("place", place).filter(F.col("place") <= most)
    return first.groupBy("field").agg(F.array_join(F.sort_array(F.collect_list("value")), ", ").alias("values"))
