"""Every stage of the pipeline against a plain version of it, each on what the stage before wrote."""

import random
import re

import corpus_pipeline
import numpy as np
import public_tokenizers
import pytest
import tiktoken

from cobaltine.llm import bpe, langid

from test_edges import plain_counts
from test_llm import LOWER, WORD, plain_groups, sha

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, hash string"


def made_up(r, parts, n):
    return " ".join("".join(r.choice(parts) for _ in range(3)) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    r, out = random.Random(11), []
    parts = {"aa": ["the", "ing", "tion", "wh", "ou"], "bb": ["que", "eau", "é", "le", "ñ"]}
    for i in range(160):
        lang = "aa" if i % 2 else "bb"
        text = made_up(r, parts[lang], r.choice([8, 40, 60]))
        if i % 5 == 0:
            text += "\n Subscribe NOW\n" + made_up(r, parts[lang], 20)
        out.append((i, text, lang))
    for i in range(20):  # copies, near copies, benchmark passages
        words = out[i + 40][1].split(" ")
        if i % 2:
            words[r.randrange(len(words))] = "changed"
        out.append((200 + i, " ".join(words), out[i + 40][2]))
    out += [(300 + i, f"{made_up(r, parts['aa'], 30)} {out[i][1]} {made_up(r, parts['aa'], 30)}", "aa") for i in range(6)]
    out += [(400, None, "aa"), (401, "", None), (402, "12 34 !?", "bb"), (403, "xqzj wvkq jjqz " * 30, "aa"), (404, "Subscribe now", None), (None, out[3][1], "aa"), (None, None, None), (405, "x" * 200_000, None)]
    made = [(i, t, k, r.choice(["s", None]), None if t is None else len(t), "clash") for i, t, k in out]
    return [*made, made[7]]


@pytest.fixture(scope="module")
def stages(spark, rows, tmp_path_factory):
    """Rows that each stage got, and those it gave."""
    folder = tmp_path_factory.mktemp("sf")
    spark.createDataFrame(rows, COLUMNS).repartition(3).write.parquet(str(folder / "documents.parquet"))
    items = [(0, rows[0][1]), (1, rows[1][1]), (2, "not to be found anywhere at all"), (3, None), (4, "short"), (None, rows[2][1]), (5, rows[5][1].split("\n")[0])]
    spark.createDataFrame([(*x, "clash") for x in items], "item_id long, text string, hash string").write.parquet(str(folder / "benchmark.parquet"))
    seen, given = [spark.read.parquet(str(folder / "documents.parquet")).collect()], spark.read.parquet(str(folder / "documents.parquet"))
    out = corpus_pipeline.run(spark, str(folder))
    base = out.inputFiles()[0].rpartition("/tokens/")[0]
    for name, _ in corpus_pipeline.STAGES:
        given = spark.read.parquet(f"{base}/{name}")
        seen.append(given.collect())
    assert sorted(map(str, out.collect())) == sorted(map(str, seen[-1]))
    return dict(zip([n for n, _ in corpus_pipeline.STAGES], zip(seen, seen[1:], strict=False), strict=True)), items, str(folder)


def plain(rows):
    return sorted(((r["doc_id"], r["text"], r["lang"], r["source"], r["n_chars"]) for r in rows), key=str)


def test_language_stage(spark, stages):
    (before, after), folder = stages[0]["language_id"], stages[2]
    documents = spark.read.parquet(f"{folder}/documents.parquet")
    model = langid.train(documents.filter("doc_id is not null").filter(~langid.held_out(documents["doc_id"])))
    kept = []
    for r in before:
        counts = plain_counts(r["text"] or "")
        logits = sum((n * model.weights[b].astype(float) for b, n in counts.items()), np.zeros(len(model.bias))) / max(1, sum(counts.values())) + model.bias
        p = np.exp((logits - logits.max()) / model.temperature)
        if any(c.isalpha() for c in r["text"] or "") and (p / p.sum())[:-1].max() >= model.least:
            kept.append(r)
    assert plain(after) == plain(kept)
    gone = {r["doc_id"] for r in before} - {r["doc_id"] for r in after}
    assert {400, 401, 402, 405} <= gone and len(gone & set(range(300))) <= 2


def test_line_stage(stages):
    before, after = stages[0]["line_dedup"]
    key = lambda x: x.strip("\x20\t\n\x0b\x0c\r").translate(LOWER)
    keys = [set(map(key, (r["text"] or "").split("\n"))) for r in before]
    common = {k for k in set().union(*keys) if k and sum(k in x for x in keys) >= 10}
    assert common == {"subscribe now"}
    kept = []
    for r in before:
        text = None if r["text"] is None else "\n".join(x for x in r["text"].split("\n") if key(x) not in common)
        kept.append(r.asDict() | {"text": text, "n_chars": None if text is None else len(text)})
    assert plain(after) == plain(kept)


def test_near_duplicate_stage(stages):
    before, after = stages[0]["near_dedup"]
    once = {(r["doc_id"], r["text"]): r for r in before if r["doc_id"] is not None}
    order = sorted(once)  # plain_groups wants them numbered by doc_id
    groups = plain_groups([once[k]["text"] for k in order], 5, 80)
    stay = {k[0] for i, k in enumerate(order) if groups[i][2]}
    assert plain(after) == plain([r for k, r in once.items() if k[0] in stay] + [r for r in before if r["doc_id"] is None])
    assert len(after) < len(before) - 10


def test_decontamination_stage(stages):
    (before, after), items, _ = stages[0]["decontaminate"], *stages[1:]
    cut = lambda t: {tuple(w[i : i + 5]) for w in [WORD.findall((t or "").translate(LOWER))] for i in range(len(w) - 4)}
    wanted = [cut(t) for i, t in items if i is not None and cut(t)]
    bad = {r["doc_id"] for r in before if r["doc_id"] is not None and any(100 * len(x & cut(r["text"])) >= 80 * len(x) for x in wanted)}
    assert len(bad) >= 4
    assert plain(after) == plain([r for r in before if r["doc_id"] not in bad])


def test_token_stage(stages):
    before, after = stages[0]["tokens"]
    v = bpe.Vocabulary.load(bpe.vocabulary_lines(public_tokenizers.path("byte_bpe_50k.tiktoken")))
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=v.ranks, special_tokens={})
    expected = []
    for r in before:
        ids = library.encode_ordinary(r["text"] or "")
        expected.append((r["doc_id"], len(ids), sha(np.array(ids, "<u4").tobytes()), sha(r["text"] or ""), ids))
    assert sorted(map(str, map(tuple, after))) == sorted(map(str, expected))


def test_pipeline_of_empty_tables(spark, tmp_path):
    spark.createDataFrame([], COLUMNS).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.count() == 0 and re.match("doc_id,n_tokens,ids_sha256,decoded_sha256,ids", ",".join(out.columns))
