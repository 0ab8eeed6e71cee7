"""Every operator against a plain version, on rows with nulls, empty and repeated texts, ties and extra columns."""

import hashlib
import json
import random
import re

import corpus_pipeline
import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from cobaltine.llm import queries as llm_queries
from cobaltine.llm import bpe, components, containment, langid, linededup, multiindex, neardup, pii, resampling, toolcalls, windows

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sha(data):
    return hashlib.sha256(data if isinstance(data, bytes) else data.encode()).hexdigest()


@pytest.fixture(scope="session")
def texts():
    r = random.Random(5)
    vocabulary = [f"w{i}" for i in range(60)] + ["Été", "中文", "Xx,"]
    passage = " ".join(r.choice(vocabulary) for _ in range(40))
    out = [None, "", " \n\t ", "one", "one two", "One  two", "\n\n", "a " * 400, "x" * 3000]
    for i in range(90):
        words = [r.choice(vocabulary) for _ in range(r.randrange(1, 80))]
        if i % 4 == 0:
            words[r.randrange(len(words)) : 0] = passage.split()
        text = "".join(w + r.choice([" ", " ", "\n", "  "]) for w in words)
        if i % 3 == 0:
            text += "\n Common LINE \nother"
        out.append(text)
    for i in range(30):  # near copies, and copies
        words = WORD.findall(out[12 + i] or "")
        if words and i % 2:
            words[r.randrange(len(words))] = "changed"
        out.append(" ".join(words))
    return out + [out[20]] * 12


@pytest.fixture(scope="session")
def documents(spark, texts):
    rows = [(i, t, "en", "s", 0, "clash", 1.0, [1]) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, rep string, h1 double, found array<int>").repartition(5)


def rows_of(df, key="doc_id"):
    return {r[key]: r.asDict() for r in df.collect()}


def test_bpe_gives_the_ids_of_the_library(documents, texts):
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    got = rows_of(bpe.tokenize(documents, path, with_ids=True))
    v = bpe.Vocabulary.load(bpe.vocabulary_lines(path))
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=v.ranks, special_tokens={})
    for i, t in enumerate(texts):
        ids = library.encode_ordinary(t or "")
        assert got[i]["ids"] == ids and got[i]["n_tokens"] == len(ids)
        assert got[i]["ids_sha256"] == sha(np.array(ids, "<u4").tobytes()) and got[i]["decoded_sha256"] == sha(t or "")


def test_bpe_appends_and_edits():
    v = bpe.Vocabulary.load(bpe.vocabulary_lines(public_tokenizers.path("byte_bpe_50k.tiktoken")))
    r = random.Random(1)
    for _ in range(100):
        piece = "".join(r.choice("theaingo") for _ in range(r.randrange(1, 300))).encode()
        whole = bpe.PrefixTable(v, piece)
        cut = r.randrange(len(piece) + 1)
        grown = bpe.PrefixTable(v, piece[:cut])
        grown.append(piece[cut:])
        assert grown.last == whole.last and whole.ids() == v.merge(piece, 1 << 60)
        whole.replace(cut, cut, b"ing")
        assert whole.last == bpe.PrefixTable(v, piece[:cut] + b"ing" + piece[cut:]).last


def test_bpe_splits_like_the_pattern():
    e = bpe.BatchEncoder(bpe.Vocabulary.load(bpe.vocabulary_lines(public_tokenizers.path("byte_bpe_50k.tiktoken"))))
    find = bpe.Encoder(e.vocabulary, e.PATTERN).find
    r = random.Random(2)
    for _ in range(300):
        text = "".join(r.choice(" \n'stredlmv1²a.é中　") for _ in range(r.randrange(1, 25)))
        data = np.frombuffer(text.encode(), np.uint8)
        start, _ = e.split(data, np.array([0, len(data)]))
        ends = np.append(start[1:], len(data))
        assert [data[a:b].tobytes().decode() for a, b in zip(start, ends, strict=True)] == find(text)


def test_windows(documents, texts):
    seen, expected = {}, {}
    words = [WORD.findall(t or "") for t in texts]
    for i, w in enumerate(words):
        for k in range(len(w) - 12):
            seen.setdefault(tuple(w[k : k + 13]), i)
    for i, w in enumerate(words):
        gone = {j for k in range(len(w) - 12) if seen[tuple(w[k : k + 13])] < i for j in range(k, k + 13)}
        expected[i] = (len(w), len(gone), sha(" ".join(x for j, x in enumerate(w) if j not in gone)))
    got = rows_of(windows.dedup_windows(documents))
    assert {i: (r["n_words"], r["n_removed"], r["kept_sha256"]) for i, r in got.items()} == expected
    assert sum(n for _, n, _ in expected.values()) > 100


def plain_groups(texts, size, percent):
    sets = []
    for t in texts:
        w = WORD.findall((t or "").translate(LOWER))
        sets.append({tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w else set())
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= percent * len(a | sets[j]):
                x, y = sorted((find(i), find(j)))
                root[y] = x
    return {i: (len(s), find(i), find(i) == i) for i, s in enumerate(sets)}


@pytest.mark.parametrize(("size", "percent"), [(3, 85), (5, 80)])
def test_near_duplicates(documents, texts, size, percent):
    got = rows_of(neardup.near_duplicates(documents, size, percent))
    assert {i: (r["n_shingles"], r["component_id"], r["kept"]) for i, r in got.items()} == plain_groups(texts, size, percent)


def test_near_duplicates_in_blocks(documents, texts, monkeypatch):
    monkeypatch.setattr(neardup, "BLOCK", 2)
    got = rows_of(neardup.near_duplicates(documents, 3, 85))
    assert {i: r["component_id"] for i, r in got.items()} == {i: x[1] for i, x in plain_groups(texts, 3, 85).items()}


def test_near_duplicates_around_the_threshold(spark, monkeypatch):
    """A group of copies of which some are linked only through others, in blocks and without a broadcast."""
    monkeypatch.setattr(neardup, "BLOCK", 2)
    monkeypatch.setattr(neardup, "MOST_BROADCAST", 0)
    r, texts = np.random.default_rng(5), []
    for i in range(48):
        words = [f"w{k}" for k in range(200)]
        for k in r.choice(200, 2 + i % 3, replace=False):
            words[k] = f"x{i}y{k}"
        texts.append(" ".join(words))
    got = rows_of(neardup.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), 5, 80))
    assert {i: (x["n_shingles"], x["component_id"], x["kept"]) for i, x in got.items()} == plain_groups(texts, 5, 80)
    assert len({x["component_id"] for x in got.values()}) > 1


def test_near_duplicates_keep_one_of_repeated_rows_and_all_without_id(spark):
    text = "one two three four five six seven"
    rows = [(1, text, "x"), (1, text, "x"), (2, text, "x"), (3, "other words here", "x"), (None, text, "x"), (None, None, "y"), (4, None, "z"), (4, None, "z"), (5, "eight nine", "x"), (5, "ten eleven", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = neardup.without_near_duplicates(df)
    assert got.columns == df.columns
    assert sorted(map(tuple, got.collect()), key=str) == sorted([rows[0], rows[3], rows[4], rows[5], rows[6], rows[8], rows[9]], key=str)


def test_pipeline_writes_each_stage(spark, tmp_path, monkeypatch):
    spark.createDataFrame([(1, "a"), (2, "b")], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    seen = []

    def stage(session, docs, sf_dir):
        seen.append(docs.inputFiles())
        return docs.withColumn("text", F.concat("text", F.lit("!")))

    monkeypatch.setattr(corpus_pipeline, "STAGES", [("first", stage), ("second", stage)])
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert sorted(r["text"] for r in out.collect()) == ["a!!", "b!!"]
    folder = spark.sparkContext.getCheckpointDir().rpartition("/")[2] + "/pipeline-"
    assert all("/first/" in f and folder in f for f in seen[1]) and all("/second/" in f and folder in f for f in out.inputFiles())


def test_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (101, 101), (None, 3)], "a long, b long")
    got = {r["node"]: r["root"] for r in components.components(edges).collect()}
    assert got == {i: 0 for i in range(1, 41)} | {101: 100}


@pytest.mark.parametrize("options", [{}, {"shard_keys": 1, "broadcast_bytes": 20}])
def test_lines(documents, texts, options):
    keys = [[x.strip("\x20\t\n\x0b\x0c\r").translate(LOWER) for x in (t or "").split("\n")] for t in texts]
    common = {k for k in {k for ks in keys for k in ks} if k and sum(k in ks for ks in keys) >= 10}
    assert common
    got = rows_of(linededup.dedup_lines(documents, **options))
    for i, (t, ks) in enumerate(zip(texts, keys, strict=True)):
        kept = [x for x, k in zip((t or "").split("\n"), ks, strict=True) if k not in common]
        assert (got[i]["n_lines"], got[i]["n_dropped"], got[i]["kept_sha256"]) == (len(ks), len(ks) - len(kept), sha("\n".join(kept)))


def test_perfect_hash_is_minimal():
    r = np.random.default_rng(3)
    h1, h2 = r.integers(0, 1 << 63, (2, 5000)).astype(np.uint64)
    shard = linededup.Shard.build(h1, h2, np.arange(1, 5001))
    assert sorted(shard.slots(h1, h2).tolist()) == list(range(5000))
    assert (shard.docs(h1, h2) == np.arange(1, 5001)).all() and not shard.docs(h1 + np.uint64(1), h2).any()


def test_containment(spark, documents, texts):
    items = [(1, texts[30]), (2, None), (3, "too short"), (4, " ".join(f"w{i}" for i in range(20))), (5, texts[40]), (None, texts[31])]
    benchmark = spark.createDataFrame([(*x, "clash") for x in items], "item_id long, text string, hash string")
    cut = lambda t: {tuple(w[i : i + 5]) for w in [WORD.findall((t or "").translate(LOWER))] for i in range(len(w) - 4)}
    docs = [cut(t) for t in texts]
    expected = {(i, k, len(cut(t)), len(cut(t) & d)) for k, t in items if k and cut(t) for i, d in enumerate(docs) if 100 * len(cut(t) & d) >= 80 * len(cut(t))}
    for block in (2_000_000, 10):
        got = containment.contained_items(documents, benchmark, block_shingles=block).collect()
        assert {(r["doc_id"], r["item_id"], r["n_shingles"], r["n_shared"]) for r in got} == expected
    assert expected


BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def plain_pii(text):
    def luhn(d):
        return sum(x if i % 2 == 0 else sum(divmod(2 * x, 10)) for i, x in enumerate(map(int, reversed(d)))) % 10 == 0

    out = []
    for kind, pattern in BASE.items():
        for m in re.finditer(pattern, text):
            d = re.sub("[^0-9]", "", m[0])
            if {"email": True, "ip": all(int(p) <= 255 for p in m[0].split(".")) if kind == "ip" else True, "card": 16 <= len(d) <= 19 and luhn(d), "phone": 8 <= len(d) <= 15}[kind]:
                out.append(f"{kind}:{m.start()}:{m.end()}")
    return out


def test_pii(spark):
    r = random.Random(4)
    parts = ["a@b.c", "x.y+z@d-e.org.", "@", "1.2.3.4", "256.1.1.1", "001.2.3.0255", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (555) 010-9999", "+12", "é𝒳", "a@b.c_d@e.f", "1.2.3.4.5.6.7.8", "123", "-", ".", " ", "\n", "+"]
    texts = [None, "", "9" * 5000, "a" * 5000, "a.b" * 2000, "x@" + "a." * 3000, "card 4111111111111111"] + ["".join(r.choice(parts) for _ in range(r.randrange(14))) for _ in range(300)]
    texts.append("account GB82 WEST 1234 5698 7654 32, not GB83 WEST 1234 5698 7654 32")
    df = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)], "doc_id long, text string, spans string")
    got = rows_of(pii.find_pii(df))
    for i, t in enumerate(texts):
        assert [f"{s['kind']}:{s['start']}:{s['end']}" for s in got[i]["spans"] if s["kind"] in BASE] == plain_pii(t or ""), t
    assert [(s["kind"], round(s["score"], 2)) for s in got[len(texts) - 1]["spans"] if s["kind"] == "iban"] == [("iban", 1.0)]


def test_account_numbers_before_other_blocks(spark):
    be, at, gb = "BE68 5390 0754 7034", "AT61 1904 3002 3457 3201", "GB82 WEST 1234 5698 7654 32"
    texts = [be, f"{be} EUR", f"x {at} 2024", f"{be} {at} {gb} {be}", f"é {at} ABCD EFGH IJ {be}", f"{be.replace(' ', '')} 2024", f"CD45 {be}", "BE68 5390 0754 7035 EUR", f"{be}0 {be}"]
    wanted = [[be], [be], [at], [be, at, gb, be], [at, be], [be.replace(" ", "")], [be], [], [be]]
    got = rows_of(pii.find_pii(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")))
    for i, t in enumerate(texts):
        assert [t[x["start"] : x["end"]] for x in got[i]["spans"] if x["kind"] == "iban"] == wanted[i], t


def test_language_id(spark):
    r = random.Random(6)
    parts = {"aa": ["the", "ing", "tion", "wh"], "bb": ["que", "eau", "é", "le"]}
    rows = [(i, " ".join("".join(r.choice(parts[k]) for _ in range(3)) for _ in range(40)), k) for i, k in enumerate(["aa", "bb"] * 150)]
    df = spark.createDataFrame([*rows, (1000, None, "aa"), (1001, "12 34 !", "bb"), (1002, rows[0][1], None), (None, rows[1][1], "bb")], "doc_id long, text string, lang string")
    out = df.withColumn("held", F.coalesce(langid.held_out(F.col("doc_id")), F.lit(False)))
    model = langid.train(out.filter("not held"), per_language=60)
    got = rows_of(langid.identify(out, model))
    assert all(got[i]["lang_pred"] == k and 0 <= got[i]["score"] <= 1 for i, _, k in rows)
    assert got[1000]["lang_pred"] == got[1001]["lang_pred"] == "und" and got[1000]["rejected"] and got[1001]["rejected"]
    assert {1000, 1001}.isdisjoint(r["doc_id"] for r in langid.accepted(out, model).collect())
    empty = langid.train(df.limit(0))
    assert langid.identify(df, empty).filter("rejected").count() == df.count()


def test_nearest(spark):
    r = np.random.default_rng(8)
    v = r.normal(size=(1500, 16)).astype(np.float32)
    v[100:400] = v[100]
    rows = [(i, x.tolist(), "clash") for i, x in enumerate(v)] + [(5000, None, ""), (5020, [0.0] * 16, ""), (5040, [float("nan")] * 16, ""), (5060, [1.0], "")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, cell string")
    got: dict = {}
    for x in multiindex.nearest(df, F.col("vec_id") % 20 == 0).orderBy("query_id", "rank").collect():
        got.setdefault(x["query_id"], []).append(x["vec_id"])
    # the vector of another length counts as padded with zeros
    assert len(set(got.pop(5060)) & set(np.argsort(-v[:, 0])[:20].tolist())) >= 12
    assert set(got) == set(range(0, 1500, 20))
    scores, hits = v.astype(float) @ v.astype(float).T, 0
    for q, ids in got.items():
        order = [i for i in np.lexsort((np.arange(1500), -np.round(scores[q], 9))).tolist() if i != q][:20]
        hits += len(set(order) & set(ids))
        if 100 <= q < 400:
            assert ids == order
    assert hits >= 0.9 * 20 * len(got)
    assert multiindex.nearest(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0


def test_resampling(spark, documents):
    ids = spark.createDataFrame([(i,) for i in range(20, 40)], "doc_id long")
    got = resampling.resample(documents, ids, share=0.4).collect()
    order = sorted(got, key=lambda x: (-x["key"], x["doc_id"]))
    k = round(0.4 * len(got))
    assert [x["selected"] for x in order] == [True] * k + [False] * (len(got) - k)
    assert rows_of(documents.filter("text is null").join(spark.createDataFrame([(x["doc_id"], x["log_weight"]) for x in got], "doc_id long, w double"), "doc_id"))[0]["w"] == 0.0


def test_resampling_ratios(spark):
    df = spark.createDataFrame([(1, "good good"), (2, "bad bad"), (3, None)], "doc_id long, text string")
    got = rows_of(resampling.resample(df, df.filter("doc_id = 1").select("doc_id"), share=0.34))
    assert got[1]["log_weight"] > 0 > got[2]["log_weight"] and got[3]["log_weight"] == 0


def test_tool_calls(spark):
    schema = {"f": {"type": "object", "required": ["x"], "properties": {"x": {"type": "integer"}}}}
    calls = [(1, "a", 0, "f", '{"x": 1, "b": "é"}'), (1, "b", 1, "f", '{"x": {"$result": "a"}}'), (1, "c", 2, "f", "{"), (1, "d", 3, "g", "{}"), (1, "e", 4, "f", '{"x": {"$result": "e"}}'), (None, "z", 0, "f", "{}")]
    results = [(1, "a", 5, "r"), (1, "a", 6, "again"), (1, "o", 7, "no call"), (1, "d", 1, None)]
    got = rows_of(toolcalls.link(spark.createDataFrame(calls, "conv_id long, call_id string, turn long, name string, arguments string"), spark.createDataFrame(results, "conv_id long, call_id string, turn long, content string"), schema), "call_id")
    assert {k: (r["status"], r["level"], r["valid"]) for k, r in got.items()} == {"a": ("linked", 0, True), "b": ("unanswered", 1, False), "c": ("unanswered", 0, False), "d": ("early", 0, False), "e": ("unanswered", None, False), "o": ("orphan", None, False)}
    assert got["a"]["canonical"] == '{"arguments":{"b":"é","x":1},"id":"a","name":"f","result":"r","status":"linked"}'
    assert json.loads(got["o"]["canonical"])["arguments"] is None


def test_levels_of_long_chains_and_joins(spark):
    refs = {(1, f"c{i}"): [f"c{i - 1}"] if i else ["unknown"] for i in range(70)}
    refs |= {(2, "a"): [], (2, "b"): ["a"], (2, "c"): ["b"], (2, "m"): ["a", "c"], (2, "d"): ["m"], (2, "n"): ["d", "m"], (2, "x"): ["y"], (2, "y"): ["x"], (2, "z"): ["y"], (2, "w"): ["a", "z"], (2, "v"): ["w"]}
    calls = [(c, k, i, "f", json.dumps({"x": [{"$result": x} for x in r]})) for i, ((c, k), r) in enumerate(refs.items())]
    calls += [(1, "c0", 500, "f", "{}"), (1, "c0", 501, "f", "{}")]
    frame = spark.createDataFrame(calls, "conv_id long, call_id string, turn long, name string, arguments string")
    got = {(r["conv_id"], r["call_id"]): r for r in toolcalls.link(frame, spark.createDataFrame([], "conv_id long, call_id string, turn long, content string"), {"f": {}}).collect()}
    expected = {(1, f"c{i}"): i for i in range(70)} | {(2, k): v for k, v in {"a": 0, "b": 1, "c": 2, "m": 3, "d": 4, "n": 5, "x": None, "y": None, "z": None, "w": None, "v": None}.items()}
    assert {k: r["level"] for k, r in got.items()} == expected
    assert got[1, "c0"]["n_calls"] == 3 and got[1, "c1"]["n_calls"] == 1


def test_tool_calls_of_turns(spark, tmp_path):
    turns = [(1, 0, "system", "s"), (1, 1, "user", "a"), (1, 2, "assistant", "b"), (1, 3, "user", "c"), (1, 3, "user", "d"), (1, 4, "assistant", "e"), (1, 5, "user", "f"), (2, 0, "user", "g"), (2, 1, "user", "h")]
    spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    got = {(r["conv_id"], r["call_turn"]): r for r in llm_queries.op4_tool_calls(spark, str(tmp_path)).collect()}
    assert {k: (r["level"], r["n_calls"], r["status"], r["valid"]) for k, r in got.items()} == {(1, 0): (0, 1, "unanswered", True), (1, 1): (0, 1, "linked", True), (1, 3): (1, 2, "linked", True), (1, 5): (2, 1, "unanswered", True), (2, 0): (0, 1, "unanswered", True), (2, 1): (0, 1, "unanswered", True)}
    assert json.loads(got[1, 3]["canonical"])["arguments"] == {"turn": 3, "text": "c", "after": {"$result": "call-1-1"}}


def test_empty_tables(spark, documents):
    none = documents.limit(0)
    assert windows.dedup_windows(none).count() == 0
    assert neardup.near_duplicates(none).count() == 0
    assert linededup.dedup_lines(none).count() == 0
    assert pii.find_pii(none).count() == 0
    assert bpe.tokenize(none, public_tokenizers.path("byte_bpe_50k.tiktoken")).count() == 0
    assert containment.contained_items(documents, none.withColumnRenamed("doc_id", "item_id")).count() == 0
    assert resampling.resample(none, none, 0.5).count() == 0
