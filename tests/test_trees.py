"""Nested trees of sections, code blocks, index and its files."""

import json
import random

from cobaltine.operators import markdown, texts


def random_notes(rng, n):
    parts = ["text", "", "more | text", "```\n# no heading\n```", "last \\\" \t quote 中", "| a | b |\n|---|---|\n| 1 | 2 |"]
    return ["\n".join(rng.choice([f"{'#' * rng.randint(1, 6)} {rng.choice('abc')}{i}", rng.choice(parts)]) for i in range(rng.randint(0, 14))) for _ in range(n)]


def test_a_tree_read_back_is_the_section_table(spark):
    docs = spark.createDataFrame(list(enumerate([None, "", "no heading", "#### deep\n# top\n### skipped\n###### skipped more\n## next", *random_notes(random.Random(5), 40)])), "id int, text string").repartition(3)
    heads = markdown.sections(docs, "id", "text").cache()
    nested = markdown.trees(heads, "id").cache()
    want = sorted(map(tuple, heads.filter("section > 0").select("id", "section", "level", "title", "parent", "body").collect()))
    assert sorted(map(tuple, markdown.unfolded(nested, "id").collect())) == want
    assert {max(r[2] for r in want), min(r[2] for r in want)} == {1, 6}
    tree = {r["id"]: (r["title"], r["summary"], json.loads(r["sections"])) for r in nested.collect()}
    assert tree[2] == ("", "no heading", []) and tree[3][0] == "top"
    assert [n["title"] for n in tree[3][2]] == ["deep", "top"] and [n["title"] for n in tree[3][2][1]["children"]] == ["skipped", "next"]


def test_code_blocks(spark):
    docs = spark.createDataFrame([(1, "# a\n```python \nx = 1\n\n```\n## b\n ~~~\nopen\n# no heading"), (2, "plain"), (3, None)], "id int, text string")
    got = sorted(map(tuple, markdown.code_blocks(docs, "id", "text").collect()))
    assert got == [(1, 1, 1, "python", "x = 1\n"), (1, 2, 6, "", "open\n# no heading")]


def test_a_knowledge_base_on_disk(spark, tmp_path):
    docs = spark.createDataFrame([("m", "# t\nbody\n| a | b |\n|---|---|\n| 1 | 2 |"), ("n", "")], "module string, text string")
    for _ in range(2):  # written again it is the same
        markdown.write_base(docs, "module", "text", str(tmp_path))
    index = {r["module"]: r for r in spark.read.json(str(tmp_path / "index")).collect()}
    assert index["m"]["chunk_count"] == 2 and index["m"]["table_rows"] == 1 and index["n"]["section_count"] == 0
    assert spark.read.json(str(tmp_path / "chunks")).filter("module = 'm'").count() == 2
    assert [r["title"] for r in spark.read.json(str(tmp_path / "tree")).filter("module = 'm'").collect()] == ["t"]


def test_tasks_grow_with_the_texts(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"# t{i}\nx\n## s\n| a | b |\n|---|---|\n| {i} | 2 |\n```\n# no\n```") for i in range(60)] + [(60, None)], "id int, text string")
    views = (markdown.sections, markdown.table_rows, markdown.code_blocks, markdown.chunks, texts.outline, markdown.index)
    before = [sorted(map(str, view(docs, "id", "text").collect())) for view in views]
    assert markdown.parts_of(docs, "text") == 1 and markdown.parts_of(docs.limit(0), "text") == 1
    monkeypatch.setattr(markdown, "PART_CHARACTERS", 500)
    assert markdown.parts_of(docs, "text") == -(-docs.selectExpr("sum(coalesce(length(text), 0) + 64)").first()[0] // 500) > 10
    for view in (markdown.sections, markdown.table_rows, texts.outline):
        assert view(docs, "id", "text").rdd.getNumPartitions() == markdown.parts_of(docs, "text")  # before: as many as the session has for a shuffle, at any size
    assert [sorted(map(str, view(docs, "id", "text").collect())) for view in views] == before
