"""Personal data: regular expressions propose, checksums confirm, context words adjust.

Spark SQL functions only.  The expressions are written so that long runs of one kind of
character do not make them slow: a match can only start where a run of its first characters
starts (or where the last match ended), and repetitions never give characters back.  That
finds the same leftmost non-overlapping matches as the plain forms.  Positions are summed up
in chunks, so that a text with many spans takes time in proportion to them.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Kind:
    name: str
    pattern: str
    #: score of a confirmed span, and words that raise it when they stand shortly before
    score: float
    context: tuple[str, ...]
    base: bool = True
    #: 1 for a pattern that only looks ahead, so that matches may overlap: they are tried at each blank, longest first
    group: int = 0


KINDS = (
    Kind("email", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", 0.8, ("mail", "contact", "write to")),
    Kind("ip", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", 0.6, ("ip", "host", "server", "address")),
    Kind("card", r"[0-9](?:[ -]?[0-9])++", 0.8, ("card", "credit", "debit", "visa", "pay")),
    Kind("phone", r"\+[0-9][ ().0-9-]+[0-9]", 0.6, ("phone", "call", "tel", "fax", "mobile")),
    Kind("iban", r"(?<![A-Za-z0-9])(?=([A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?)(?![A-Za-z0-9]))", 0.8, ("iban", "account", "bank"), base=False, group=1),
)
CONTEXT_CHARS, CONTEXT_SCORE = 40, 0.2


def luhn(digits: Column) -> Column:
    """Whether a string of digits has a right check digit."""

    def worth(c: Column, i: Column) -> Column:
        twice = c.cast("int") * 2
        return F.when(i % 2 == 0, c.cast("int")).otherwise(F.when(twice > 9, twice - 9).otherwise(twice))

    each = F.transform(F.split(F.reverse(digits), "(?!$)"), worth)
    return F.aggregate(each, F.lit(0), lambda a, x: a + x) % 10 == 0


def mod97(text: Column) -> Column:
    """Whether an account number's first four characters, moved to its end, leave the remainder 1."""
    moved = F.concat(F.substr(text, F.lit(5)), F.substring(text, 1, 4))

    def step(a: Column, c: Column) -> Column:
        number = F.when(c.rlike("[0-9]"), F.ascii(c) - 48).otherwise(F.ascii(c) - 55)
        return (a * F.when(number > 9, 100).otherwise(10) + number) % 97

    return F.aggregate(F.split(moved, "(?!$)"), F.lit(0), step) == 1


def is_valid(kind: str, value: Column) -> Column:
    """``F.when`` keeps the checks from values of the wrong length."""
    digits = F.regexp_replace(value, "[^0-9]", "")
    if kind == "ip":
        small = lambda p: F.when(F.length(p) > 3, False).otherwise(F.concat(F.lit("0"), F.substring(p, 1, 3)).cast("int") <= 255)
        return F.forall(F.split(value, r"\."), lambda p: small(F.regexp_replace(p, "^0+", "")))
    if kind == "card":
        return F.when(F.length(digits).between(16, 19), luhn(digits)).otherwise(False)
    if kind == "phone":
        return F.length(digits).between(8, 15)
    if kind == "iban":
        compact = F.replace(value, F.lit(" "), F.lit(""))
        return F.when(F.length(compact).between(15, 34), mod97(compact)).otherwise(False)
    return F.lit(True)


def longest_valid(kind: str, value: Column) -> Column:
    """``value`` less as few of its blank-separated last blocks as make it valid, or null."""
    blocks = F.split(value, " ")
    ends = F.transform(F.sequence(F.size(blocks), F.lit(1), F.lit(-1)), lambda n: F.array_join(F.slice(blocks, F.lit(1), n), " "))
    return F.get(F.filter(ends, lambda v: is_valid(kind, v)), F.lit(0))


#: items that a scan takes as one chunk
CHUNK = 64


def scanned(items: Column, start: Column, step: Callable[[Column, Column], Column], out: Callable[[Column, Column], Column], out_type: str) -> Column:
    """``out(state, item)`` of each item, where ``step(state, item)`` gives the state that the next item meets.

    A fold that adds to one array copies it for each item.  Here a chunk of items has an
    array of its own, so that only short arrays are copied.  ``items`` must be a variable or
    a column: an expression would be worked out again for each chunk.
    """
    empty = F.expr(f"cast(array() as array<{out_type}>)")
    chunks = F.transform(F.sequence(F.lit(0), F.floor((F.size(items) - 1) / CHUNK).cast("int")), lambda i: F.slice(items, i * CHUNK + 1, F.lit(CHUNK)))

    def chunk_after(done: Column, chunk: Column) -> Column:
        first = F.struct(F.element_at(done, -1)["state"].alias("state"), empty.alias("out"))
        each = lambda s, x: F.struct(step(s["state"], x).alias("state"), F.concat(s["out"], F.array(out(s["state"], x))).alias("out"))
        return F.concat(done, F.array(F.aggregate(chunk, first, each)))

    done = F.aggregate(chunks, F.array(F.struct(start.alias("state"), empty.alias("out"))), chunk_after)
    return F.when(F.size(items) > 0, F.flatten(F.transform(done, lambda x: x["out"]))).otherwise(empty)


def spans_of(kind: Kind, text: Column, found: Column) -> Column:
    """array<struct<kind, start, end, score>> of the valid ones of ``found``, the matches in ``text``.

    What stands between the matches tells where they start, and the end of what was passed
    is the context of the next one.  A pattern that looks ahead matches between characters;
    a blank before the text keeps its gap at a match at the start.
    """
    span = "struct<kind: string, start: int, end: int, score: double>"
    gaps = F.slice(F.split(F.concat(F.lit(" "), text) if kind.group else text, kind.pattern, -1), F.lit(1), F.size(found))
    last = lambda c: F.substring(c, -CONTEXT_CHARS, CONTEXT_CHARS)

    def item(gap: Column, value: Column) -> Column:
        kept = longest_valid(kind.name, value) if kind.group else F.when(is_valid(kind.name, value), value)
        passed = F.lit("") if kind.group else value
        return F.struct(F.length(gap).alias("gap"), last(gap).alias("before"), F.length(passed).alias("width"), last(passed).alias("passed"), F.length(kept).alias("size"))

    def start_of(s: Column, x: Column) -> Column:
        return s["at"] + x["gap"]

    def keeps(s: Column, x: Column) -> Column:
        """Of overlapping matches the first stays."""
        return x["size"].isNotNull() & (start_of(s, x) >= s["end"])

    def step(s: Column, x: Column) -> Column:
        end = F.when(keeps(s, x), start_of(s, x) + x["size"]).otherwise(s["end"])
        return F.struct((start_of(s, x) + x["width"]).alias("at"), end.alias("end"), last(F.concat(s["tail"], x["before"], x["passed"])).alias("tail"))

    def out(s: Column, x: Column) -> Column:
        before = F.lower(last(F.concat(s["tail"], x["before"])))
        score = F.lit(kind.score) + F.when(before.rlike(r"\b(?:" + "|".join(kind.context) + ")"), CONTEXT_SCORE).otherwise(0.0)
        found = F.struct(F.lit(kind.name).alias("kind"), start_of(s, x).alias("start"), (start_of(s, x) + x["size"]).alias("end"), score.alias("score"))
        return F.when(keeps(s, x), found).cast(span)

    state = F.struct(F.lit(-1 if kind.group else 0).alias("at"), F.lit(0).alias("end"), F.lit("").alias("tail"))
    items = F.array(F.zip_with(gaps, found, item))  # of one array, so that it becomes a variable
    spans = F.filter(F.flatten(F.transform(items, lambda x: scanned(x, state, step, out, span))), lambda x: x.isNotNull())
    return F.when(F.size(found) > 0, spans).otherwise(F.expr(f"cast(array() as array<{span}>)"))


def find_pii(documents: DataFrame) -> DataFrame:
    """All spans of personal data of each row.

    ``documents`` has doc_id and text.  Returns doc_id and spans, an array of (kind, start,
    end, score) in the order of ``KINDS``, then of start; positions are code points, ends
    exclusive.  The score is the kind's own, and more where a context word stands within
    CONTEXT_CHARS characters before the span.  A null or empty text has none; a very long one
    is searched whole.  Other columns are not looked at; no row is lost, and a repeated row
    gives a repeated row.
    """
    text = F.coalesce("text", F.lit("")).alias("text")
    found = documents.select("doc_id", text).select("doc_id", "text", *[F.regexp_extract_all("text", F.lit(k.pattern), F.lit(k.group)).alias(f"found_{k.name}") for k in KINDS])
    return found.select("doc_id", F.concat(*[spans_of(k, F.col("text"), F.col(f"found_{k.name}")) for k in KINDS]).alias("spans"))


def listed(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
