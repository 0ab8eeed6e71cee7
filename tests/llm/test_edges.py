"""Hard inputs of single operators, and brute-force versions of those that SQL cannot express."""

import json
import math
import os
import random
import time
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from cobaltine.llm import containment, langid, linededup, multiindex, neardup, pii, queries, resampling, toolcalls, windows
from cobaltine.llm.arrays import span_hashes

SF = "/root/testdata/sf0.01"
needs_tables = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def docs(spark, texts, ids=None):
    return spark.createDataFrame([(i, t, "clash") for i, t in zip(ids or range(len(texts)), texts, strict=True)], "doc_id long, text string, hash string")


# lines


def test_perfect_hash_parts_keys_that_share_a_hash():
    h1, h2 = np.array([5, 5, 9, 8, 7], np.uint64), np.array([1, 2, 3, 3, 3], np.uint64)
    shard = linededup.Shard.build(h1, h2, np.arange(10, 15))
    assert sorted(shard.slots(h1, h2).tolist()) == list(range(5))
    assert shard.docs(h1, h2).tolist() == [10, 11, 12, 13, 14]
    assert not shard.docs(h1, h2 + np.uint64(10)).any() and not linededup.Shard.build(h1[:0], h2[:0], h1[:0].astype(int)).docs(h1, h2).any()


@pytest.mark.parametrize("options", [{}, {"shard_keys": 1, "broadcast_bytes": 0}, {"broadcast_bytes": 0, "part_lines": 3}])
def test_lines_of_rows_that_share_a_doc_id(spark, options):
    """Each row is a document: ten of one doc_id, or of none, make a line common; a line twice in one row counts once."""
    texts = ["Same\nown %d\nsame" % i for i in range(6)] + ["x\nSAME "] * 4 + ["twice\ntwice"] * 9 + [None, ""]
    ids = [1] * 6 + [None] * 4 + [*range(20, 29), 30, None]
    got = sorted((r["doc_id"] or -1, r["n_lines"], r["n_dropped"], r["kept"]) for r in linededup.dedup_lines(docs(spark, texts, ids), **options).collect() if r["kept"])
    assert got == sorted([(1, 3, 2, f"own {i}") for i in range(6)] + [(-1, 2, 1, "x")] * 4 + [(i, 2, 0, "twice\ntwice") for i in range(20, 29)])


# vectors


def brute_nearest(vectors, queries, k=20):
    width = max((len(v) for v in vectors.values()), default=0)
    full = {i: [*v, *[0.0] * (width - len(v))] for i, v in vectors.items()}
    out = {}
    for q in queries:
        score = {i: sum(a * b for a, b in zip(full[q], v, strict=True)) for i, v in full.items() if i != q}
        out[q] = sorted(score, key=lambda i: (-score[i], i))[:k]
    return out


def answers(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r["query_id"], []).append(r["vec_id"])
    return out


@pytest.mark.parametrize("kind", ["float", "double", "int"])
def test_nearest_of_one_component_and_mixed_lengths(spark, kind):
    one = {i: [i % 7 + 1] for i in range(40)}
    mixed = {i: [(i * 7 + k) % 11 - 5 or 1 for k in range(1 + i % 3)] for i in range(40)} | {100 + i: [] for i in range(50)} | {200: [0], 220: None, 240: [None, 1]}
    for vectors in (one, mixed):
        df = spark.createDataFrame([(i, None if v is None else [x if kind == "int" or x is None else float(x) for x in v], "clash") for i, v in vectors.items()], f"vec_id long, embedding array<{kind}>, cell string")
        good = {i: v for i, v in vectors.items() if v and any(v) and None not in v}
        assert answers(multiindex.nearest(df, F.col("vec_id") % 20 == 0)) == brute_nearest(good, [i for i in good if i % 20 == 0])


def test_nearest_of_unusable_and_repeated_rows(spark):
    make = lambda rows: spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    query = F.col("vec_id") % 20 == 0
    assert multiindex.nearest(make([(0, None), (20, [0.0]), (40, [math.inf]), (60, [math.nan, 1.0]), (None, [1.0])]), query).count() == 0
    assert answers(multiindex.nearest(make([(0, [1.0, 2.0]), (0, [1.0, 2.0]), (0, [3.0, 1.0]), (1, [1.0, 0.0])]), query)) == {0: [1]}
    same = make([(i, [1.0, 1.0, 1.0]) for i in range(400)])  # one cell, and more ids than a block holds
    assert answers(multiindex.nearest(same, query)) == {q: [i for i in range(22) if i != q][:20] for q in range(0, 400, 20)}


def test_nearest_shares_out_a_dense_cell(spark, monkeypatch):
    monkeypatch.setattr(multiindex, "BLOCK", 8)
    monkeypatch.setattr(multiindex, "HELD", 1)
    r = np.random.default_rng(1)
    v = {i: (np.array([1.0, 0, 0, 0]) + r.normal(0, 0.01, 4)).tolist() for i in range(200)}
    df = spark.createDataFrame(list(v.items()), "vec_id long, embedding array<double>").repartition(6)
    assert answers(multiindex.nearest(df, F.col("vec_id") % 20 == 0, recall=1.01)) == brute_nearest(v, range(0, 200, 20))


# tool calls

CALLS, RESULTS = "conv_id long, call_id string, turn long, name string, arguments string", "conv_id long, call_id string, turn long, content string"


def test_hard_arguments(spark):
    deep = "[" * 100_000 + "]" * 100_000
    texts = {"lone": '{"x": "\\ud800", "\\udfff": 1}', "pair": '{"x": "\\ud83d\\ude00"}', "deep": deep, "nan": '{"x": NaN}', "inf": "[1e999]", "huge": "9" * 5000, "null": None, "control": '{"x": "\\u0000\\n"}', "ref": '{"$result": "\\ud800"}'}
    calls = [(1, k, i, "f", t) for i, (k, t) in enumerate(texts.items())]
    got = {r["call_id"]: r for r in toolcalls.link(spark.createDataFrame(calls, CALLS), spark.createDataFrame([], RESULTS), {"f": {}}).collect()}
    bad = {k: r["problems"] for k, r in got.items() if not r["valid"]}
    assert bad == {k: ["arguments are no JSON"] for k in ("nan", "inf", "huge", "null")} | {"deep": ["arguments are nested too deeply"]}
    assert got["lone"]["canonical"].startswith('{"arguments":{"x":"\\ud800","\\udfff":1},"id":"lone"')
    assert got["pair"]["canonical"].startswith('{"arguments":{"x":"😀"}')
    for r in got.values():
        assert "NaN" not in r["canonical"] and json.loads(r["canonical"])["id"] == r["call_id"]


def test_calls_against_a_plain_version(spark):
    """Random calls with repeats, references, cycles and results before, after and without calls."""
    r, calls, results = random.Random(3), [], []
    for conv in (1, 2, None):
        for _ in range(60):
            refs = [f"c{r.randrange(30)}" for _ in range(r.choice([0, 1, 1, 2, 2]))]
            calls.append((conv, r.choice([f"c{r.randrange(30)}"] * 9 + [None]), r.randrange(40), r.choice("fg"), json.dumps({"x": r.choice([1, "a", None]), "r": [{"$result": x} for x in refs]})))
            results.append((conv, r.choice([f"c{r.randrange(34)}"] * 9 + [None]), r.randrange(40), r.choice(["u", "v", None])))
    schema = {"f": {"type": "object", "properties": {"x": {"type": "integer"}}}}
    frame = lambda rows, kind: spark.createDataFrame(rows, kind).repartition(3)
    got = {(x["conv_id"], x["call_id"]): x for x in toolcalls.link(frame(calls, CALLS), frame(results, RESULTS), schema).collect()}

    first = lambda rows: {k: (min((x[2:] for x in rows if x[:2] == k), key=lambda x: [(v is not None, v) for v in x]), sum(x[:2] == k for x in rows)) for k in {x[:2] for x in rows if None not in x[:2]}}
    call, result = first(calls), first(results)
    refs = {k: {(k[0], x["$result"]) for x in json.loads(v[0][2])["r"]} & set(call) for k, v in call.items()}
    level = {}
    for _ in call:
        level |= {k: 1 + max((level[x] for x in refs[k]), default=-1) for k in call if k not in level and refs[k] <= set(level)}
    assert set(got) == set(call) | set(result)
    assert any(k not in level for k in call) and max(level.values()) > 2
    for k, x in got.items():
        (turn, name, text), n = call.get(k, ((None, None, None), 0))
        (at, content), m = result.get(k, ((None, None), 0))
        status = "orphan" if k not in call else "unanswered" if k not in result else "early" if at < turn else "linked"
        value = json.loads(text) if text else None
        valid = bool(value) and name == "f" and value["x"] == 1
        assert (x["status"], x["n_calls"], x["n_results"], x["level"], x["call_turn"], x["result_turn"], x["valid"]) == (status, n, m, level.get(k), turn, at, valid), k
        assert x["canonical"] == json.dumps({"arguments": value, "id": k[1], "name": name, "result": content, "status": status}, sort_keys=True, separators=(",", ":"))


def test_calls_of_empty_tables_and_clashing_columns(spark):
    calls, results = spark.createDataFrame([(1, "a", 0, "f", "{}", 1)], CALLS + ", level int"), spark.createDataFrame([(1, "a", 1, "r", 2)], RESULTS + ", n int")
    assert [(x["status"], x["level"]) for x in toolcalls.link(calls, results, {"f": {}}).collect()] == [("linked", 0)]
    assert toolcalls.link(calls.limit(0), results.limit(0), {}).count() == 0
    assert [x["status"] for x in toolcalls.link(calls.limit(0), results, {}).collect()] == ["orphan"]


# personal data


def test_many_spans_in_one_text(spark):
    n = 16_000
    text = "mail " + " ".join(f"u{i}@a.bc" for i in range(n)) + " " + "BE68 5390 0754 7034; " * 500
    df = docs(spark, [text, "a@b.cd"])
    pii.find_pii(df.filter("doc_id = 1")).collect()
    began = time.time()
    spans = {r["doc_id"]: r["spans"] for r in pii.find_pii(df).collect()}[0]
    assert time.time() - began < 20  # some seconds; minutes where time grows with the square
    assert [text[s["start"] : s["end"]] for s in spans if s["kind"] == "email"] == [f"u{i}@a.bc" for i in range(n)]
    assert {text[s["start"] : s["end"]] for s in spans if s["kind"] == "iban"} == {"BE68 5390 0754 7034"} and sum(s["kind"] == "iban" for s in spans) == 500
    assert spans[0]["score"] == 1.0 and spans[n - 1]["score"] == 0.8


def test_context_reaches_over_other_spans(spark):
    texts = ["contact a@b.cd, x@y.zz", "contact " + "z" * 40 + " a@b.cd", "IP 1.2.3.4 5.6.7.8", "é" * 30 + " phone +12345678"]
    got = {r["doc_id"]: [round(s["score"], 1) for s in r["spans"]] for r in pii.find_pii(docs(spark, texts)).collect()}
    assert got == {0: [1.0, 1.0], 1: [0.8], 2: [0.8, 0.8], 3: [0.8]}


# sampling


def test_resampling_against_a_plain_version(spark):
    r = random.Random(9)
    words = ["alpha", "Beta", "gamma", "delta", "é", "x"]
    texts = [None, "", " \n"] + [" ".join(r.choice(words[: 3 + i % 4]) for _ in range(r.randrange(1, 30))) for i in range(80)]
    texts += [texts[5]] * 3
    df, target = docs(spark, texts).repartition(4), list(range(10, 40))
    got = {x["doc_id"]: x for x in resampling.resample(df, spark.createDataFrame([(i, 1) for i in [*target, None, 12]], "doc_id long, key int"), share=0.3, seed=4).collect()}

    def one(word):
        data = word.encode()
        return int(span_hashes(np.frombuffer(data, np.uint8), np.array([0]), np.array([len(data)]))[0])

    def buckets(t):
        ws = [one(w.lower() if w.isascii() else w) for w in (t or "").split()]
        pairs = [int(resampling.rolled(np.array(p, np.uint64), 2)[0]) for p in zip(ws, ws[1:])]
        return [x % resampling.BUCKETS for x in ws + pairs]

    all_counts, of_target = Counter(b for t in texts for b in buckets(t)), Counter(b for i in target for b in buckets(texts[i]))
    p, q = sum(of_target.values()) + resampling.BUCKETS, sum(all_counts.values()) + resampling.BUCKETS
    ratio = lambda b: math.log((of_target[b] + 1) / p) - math.log((all_counts[b] + 1) / q)
    key = {}
    for i, t in enumerate(texts):
        seed = xxhash.xxh64_intdigest(np.array([5], "<i4").tobytes(), seed=42)  # as the SQL function: each argument seeds the next
        uniform = ((xxhash.xxh64_intdigest(np.array([i], "<i8").tobytes(), seed=seed) >> 11) + 0.5) / (1 << 53)
        weight = sum(map(ratio, buckets(t)))
        assert got[i]["log_weight"] == pytest.approx(weight, abs=1e-9)
        key[i] = weight - math.log(-math.log(uniform))
        assert got[i]["key"] == pytest.approx(key[i], abs=1e-9)
    best = sorted(key, key=lambda i: (-key[i], i))[: round(0.3 * len(texts))]
    assert {i for i, x in got.items() if x["selected"]} == set(best)
    assert resampling.resample(df, spark.createDataFrame([], "doc_id long"), 0.5).filter("log_weight <> 0").count() == 0


# languages


def plain_counts(text):
    """Subwords of the lower-cased text, byte by byte."""
    data = bytearray()
    for c in text:
        low = c.lower() if c.isascii() or "À" <= c <= "Þ" and c != "×" else c
        data += low.encode() if low.isalpha() or not low.isascii() else b" "
    out = Counter()
    for size in langid.ORDERS:
        for i in range(len(data) - size + 1):
            g = bytes(data[i : i + size])
            if b" " not in g[1:-1] and g not in (b"  ",) and not (g[0] == 32 and g[-1] == 32):
                code = sum(b << 8 * k for k, b in enumerate(g))
                out[(code * 0x9E3779B97F4A7C15 + size * 0xC2B2AE3D27D4EB4F & (1 << 64) - 1) % (1 << 64) >> 64 - langid.BUCKET_BITS] += 1
    return out


def test_subwords_against_a_plain_version():
    texts = ["", "a", "Été à Paris!", "ABC abc 12", "  x  yy zzz ", "中文 ok", "àÀ×÷ß"]
    got = langid.feature_counts(pa.array(texts))
    for i, t in enumerate(texts):
        assert {int(b): int(got[i, b]) for b in np.flatnonzero(got[i])} == dict(plain_counts(t)), t


@needs_tables
def test_language_of_held_out_documents(spark):
    """Held-out accuracy on a whole table; text of no language is rejected, and clean text is not."""
    documents = spark.read.parquet(f"{SF}/documents.parquet")
    rows = queries.op1_language_id(spark, SF).join(documents.select("doc_id", "lang", "text"), "doc_id").collect()
    held = [r for r in rows if r["held_out"] and r["lang"] and r["lang_pred"] != "und"]
    assert len(held) > 100 and sum(r["lang"] == r["lang_pred"] for r in held) >= 0.98 * len(held)
    assert sum(r["rejected"] for r in held) <= 0.01 * len(held)
    model = langid.train(documents.filter(~langid.held_out(F.col("doc_id"))))
    assert model.coverage >= 0.99 and model.rejection >= 0.9
    noise = ["xqz wvkj qqqp zzkx jwvq " * 8, "Kx9 vQz7 bbtw0 qpzrm fghjk wzzt" * 5, *[langid.junk(r["text"]) for r in rows[:40] if r["text"] and len(r["text"]) > 300]]
    rejected = [r["rejected"] for r in langid.identify(docs(spark, noise), model).collect()]
    assert len(rejected) > 20 and sum(rejected) >= 0.9 * len(rejected)


# passages, items and groups that many documents share


def test_windows_that_many_slices_share(spark, monkeypatch):
    """A task that remembers nothing, little or all hands on different rows and finds the same."""
    r = random.Random(2)
    shared, other = ([f"s{i}" for i in range(30)], [f"s{i}" for i in range(12, 18)] + [f"o{i}" for i in range(20)])
    texts = [" ".join([f"d{i}w{j}" for j in range(r.randrange(9))] + (shared if i % 2 else other) + [f"d{i}e{j}" for j in range(r.randrange(9))]) for i in range(60)]
    df = docs(spark, texts, r.sample(range(1000), 60)).coalesce(1)
    plain = {x["doc_id"]: (x["n_removed"], x["kept_sha256"]) for x in windows.dedup_windows(df).collect()}
    small = windows.slices
    monkeypatch.setattr(windows, "slices", lambda batches, text, limit=0: small(batches, text, 600))
    for most in (0, 3, 1 << 18):
        monkeypatch.setattr(windows.Seen.__init__, "__defaults__", (most,))
        assert {x["doc_id"]: (x["n_removed"], x["kept_sha256"]) for x in windows.dedup_windows(df).collect()} == plain
    assert sum(n for n, _ in plain.values()) > 1000


def test_items_that_share_shingles(spark):
    a, b = "one two three four five six seven", "two three four five six seven eight"
    items = spark.createDataFrame([(1, a), (2, b), (3, f"{a} {b}"), (3, None), (4, "One  Two three\tfour five")], "item_id long, text string")
    texts = [f"x {a} y {a}", b.upper(), f"{a} {b}", None, "", f"{a[:20]}", "one two three four five"]
    got = {(r["doc_id"], r["item_id"]): (r["n_shingles"], r["n_shared"]) for r in containment.contained_items(docs(spark, [*texts, texts[0]], [*range(7), 0]), items).collect()}
    assert got == {(0, 1): (3, 3), (0, 4): (1, 1), (1, 2): (3, 3), (2, 1): (3, 3), (2, 2): (3, 3), (2, 3): (8, 8), (2, 4): (1, 1), (6, 4): (1, 1)}
    left = containment.without_items(docs(spark, [*texts, a], [*range(7), None]), items)
    assert sorted(r["doc_id"] if r["doc_id"] is not None else -1 for r in left.collect()) == [-1, 3, 4, 5]
    assert containment.without_items(docs(spark, texts), items.limit(0)).count() == 7


def test_near_duplicates_in_a_grid(spark, monkeypatch):
    monkeypatch.setattr(neardup, "BLOCK", 1)
    monkeypatch.setattr(neardup, "GRID", 2)
    r, texts = np.random.default_rng(7), []
    for i in range(40):
        words = [f"w{k}" for k in range(120)]
        for k in r.choice(120, 1 + i % 4, replace=False):
            words[k] = f"x{i}y{k}"
        texts.append(" ".join(words))
    sets = [{tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)} for t in texts]
    root = list(range(40))
    for i in range(40):
        for j in range(i):
            if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]) and root[i] != root[j]:
                low, high = sorted((root[i], root[j]))
                root = [low if x == high else x for x in root]
    got = {x["doc_id"]: x["component_id"] for x in neardup.near_duplicates(docs(spark, [*texts, "", None, " "], [*range(40), 50, 51, 52])).collect()}
    assert got == dict(enumerate(root)) | {50: 50, 51: 51, 52: 52}
