"""Text helpers as Column functions: anchors, JSON in replies, outlines, names of files and pages, values backed by pages."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructType

from .markdown import sections
from .retrieval import similarity

#: fixed values: titles of tables of contents
CONTENTS = ("目录", "Table of Contents", "TOC")
#: fixed values: other names of the kinds of skills
SKILL_TYPES = {"python_script": "python", "py": "python", "formula": "dsl", "expression": "dsl", "builtin": "preset"}


def present(text: Column) -> Column:
    return F.when(text != "", text)


def anchor(text: Column) -> Column:
    """Lower case, blanks as single dashes, without punctuation; ``section`` if nothing is left."""
    bare = F.regexp_replace(F.lower(F.trim(F.coalesce(text, F.lit("")))), r"(?U)[^\w\x{4e00}-\x{9fff}\- ]+", "")
    dashed = F.regexp_replace(F.regexp_replace(bare, r"[\s-]+", "-"), "^-|-$", "")
    return F.coalesce(present(dashed), F.lit("section"))


def json_object(text: Column) -> Column:
    """The JSON in a reply: the whole text, else its first fenced object, else what its outermost braces hold; null if none parses."""
    fenced = present(F.regexp_extract(text, r"(?s)```(?:json)?\s*(\{.*?\})\s*```", 1))
    braced = present(F.regexp_extract(text, r"(?s)\{.*\}", 0))
    return F.coalesce(*[F.when(F.try_parse_json(x).isNotNull(), x) for x in (present(F.trim(text)), fenced, braced)])


def skill_type(text: Column) -> Column:
    """The kind of a skill by any of its names; blank is ``dsl``."""
    name = F.coalesce(present(F.lower(F.trim(text))), F.lit("dsl"))
    known = F.create_map(*[F.lit(x) for pair in SKILL_TYPES.items() for x in pair])
    return F.coalesce(F.try_element_at(known, name), name)


def flat(text: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFKC", text).lower() if c.isprintable() and not c.isspace())


def squeezed(text: Column, by_line: bool = False) -> Column:
    """NFKC, lower case, without blanks and what cannot be printed; null is empty.  Spark has no Unicode normal forms.

    With ``by_line``, line ends stay.
    """

    def squeeze(texts: pd.Series) -> pd.Series:
        return texts.fillna("").map(lambda s: "\n".join(map(flat, s.split("\n") if by_line else [s])))

    return F.pandas_udf(squeeze, "string")(text)


def best_match(value: Column, choices: Column, least: float = 75.0) -> Column:
    """The choice most like ``value`` (null below ``least`` of 100); of equals the one nearest in length, then the first."""
    bare = lambda x: F.regexp_replace(F.lower(x), r"\s+", "")
    scored = F.transform(choices, lambda x, i: F.struct(similarity(bare(x), bare(value)).alias("score"), (-F.abs(F.length(bare(x)) - F.length(bare(value)))).alias("near"), (-i).alias("first"), x.alias("text")))
    return F.array_max(F.filter(scored, lambda s: s["score"] >= least))["text"]


def windowed(value: Column, text: Column) -> Column:
    """Every part of ``text`` that is as long as ``value``; none if it is shorter."""
    starts = F.sequence(F.lit(1), F.length(text) - F.length(value) + 1)
    return F.when(F.length(text) >= F.length(value), F.transform(starts, lambda i: F.substr(text, i, F.length(value)))).otherwise(F.array().cast("array<string>"))


def backed(values: DataFrame, least: float = 75.0) -> DataFrame:
    """(id, status, text): whether each (id, value, page) stands on its page, and as what.

    Statuses: ``empty``; ``exact``; ``normalized``, without regard to width, case and blanks;
    ``lines``, each line of the value by either rule, joined by blanks; ``fuzzy``, the most
    similar word or, for values with blanks, part of a line; ``missing``, with the value as it
    is.  Null pages are empty.  Likeness is by edits, not by the ratio of another library.
    """
    v, page = F.col("value"), F.col("page")
    known = values.select("id", F.trim(F.coalesce("value", F.lit(""))).alias("value"), F.coalesce("page", F.lit("")).alias("page"))
    known = known.withColumns({"flat": squeezed(v), "flat_page": squeezed(page), "parts": F.split(v, "\n"), "flat_parts": F.split(squeezed(v, by_line=True), "\n")})
    each = F.forall(F.zip_with("parts", "flat_parts", lambda x, y: F.contains(page, x) | F.contains(F.col("flat_page"), y)), lambda ok: ok)
    spaced, long = F.contains(v, F.lit(" ")), lambda x: F.length(x) > 1
    line = best_match(v, F.filter(F.split(page, r"\R"), long), least)
    like = F.when(spaced, best_match(v, windowed(v, line), least)).otherwise(best_match(v, F.filter(F.split(page, r"\s+"), long), least))
    direct = F.when(v == "", "empty").when(F.contains(page, v), "exact").when((F.col("flat") != "") & F.contains(F.col("flat_page"), F.col("flat")), "normalized")
    split = F.when(F.contains(v, F.lit("\n")), F.when(each, "lines").otherwise("missing"))
    found = known.withColumn("direct", F.coalesce(direct, split))
    found = found.withColumn("like", F.when(F.col("direct").isNull() & (F.length("value") > 1), like))
    status = F.coalesce("direct", F.when(F.col("like").isNotNull(), "fuzzy"), F.lit("missing"))
    return found.select("id", status.alias("status"), F.when(status == "lines", F.replace(v, F.lit("\n"), F.lit(" "))).otherwise(F.coalesce("like", "value")).alias("text"))


def field_paths(schema: StructType, before: str = "") -> list[tuple[str, str, bool]]:
    """(path, type, required) of the leaves of a schema; members of lists read ``a[].b``."""
    found = []
    for field in schema.fields:
        inner, path = field.dataType, before + field.name
        if isinstance(inner, ArrayType) and isinstance(inner.elementType, StructType):
            inner, path = inner.elementType, path + "[]"
        if isinstance(inner, StructType):
            found += field_paths(inner, path + ".")
        else:
            found.append((path, inner.simpleString(), not field.nullable))
    return found


def bare_path(path: Column) -> Column:
    return F.regexp_replace(path, r"\[[0-9]*\]", "")


def chosen_fields(values: DataFrame, include: tuple[str, ...] = (), exclude: tuple[str, ...] = (), prefix: bool = False) -> DataFrame:
    """The rows whose ``path``, without list positions, is included (all, if none is given) and not excluded; whole paths, or with ``prefix`` their beginnings."""
    path = bare_path(F.col("path"))
    held = lambda names: (F.exists(F.array(*map(F.lit, names)), lambda n: path.startswith(n)) if prefix else path.isin(*names))
    kept = values.filter(held(include)) if include else values
    return kept.filter(~held(exclude)) if exclude else kept


def outline(documents: DataFrame, key: str, text: str, deepest: int = 3) -> DataFrame:
    """(key, outline): the headings of each document down to a level, indented, without tables of contents and empty titles."""
    heads = sections(documents, key, text).filter(F.col("level").between(1, deepest) & (F.trim("title") != "") & ~F.trim("title").isin(*CONTENTS))
    line = F.concat(F.repeat(F.lit("  "), F.col("level") - 1), F.lit("- "), F.trim("title"))
    rows = F.sort_array(F.collect_list(F.struct("section", line.alias("line"))))
    return heads.groupBy(key).agg(F.array_join(F.transform(rows, lambda r: r["line"]), "\n").alias("outline"))


def page_kind(path: Column) -> Column:
    """Struct (module, kind) of a file by its path below the documents' folder.

    ``doc/<module>-doc.*`` is a ``doc``; all else is ``meta``, its module the whole name below
    ``table/`` and of ``project-overview.md``, elsewhere what stands before the first dash.
    """
    stem = F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"(?<=.)\.[^.]*$", "")
    is_doc = path.startswith("doc/") & stem.endswith("-doc")
    whole = path.startswith("table/") | (path == "project-overview.md")
    other = F.coalesce(present(F.split_part(stem, F.lit("-"), F.lit(1))), F.lit("misc"))
    module = F.when(is_doc, F.regexp_replace(stem, "-doc$", "")).when(whole, stem).otherwise(other)
    return F.struct(module.alias("module"), F.when(is_doc, "doc").otherwise("meta").alias("kind"))


def period_of(file_name: Column) -> Column:
    """The month (yyyy-MM) in a file's name, with -, _, /, 年 and 月 or nothing between; null if there is none."""
    pattern = r"(20\d{2})[-_/年]?(0?[1-9]|1[0-2])(?:[-_/月]|(?![A-Za-z0-9]))"
    year, month = (F.regexp_extract(file_name, pattern, i) for i in (1, 2))
    return F.when(year != "", F.concat(year, F.lit("-"), F.lpad(month, 2, "0")))


def names_token(file_name: Column, token: str) -> Column:
    """Whether ``token``, a pattern, stands in a name without a letter or digit on either side."""
    return file_name.rlike(f"(?<![A-Za-z0-9]){token}(?![A-Za-z0-9])")
