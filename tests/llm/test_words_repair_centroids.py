"""Word-level BPE, conversation repair and centroids on hard inputs, against the library, SQL and plain versions."""

import hashlib
import math
import random

import duckdb
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from cobaltine.llm import bpe, lloyd, repair, wordbpe
from cobaltine.llm.arrays import text_bytes
from cobaltine.llm.sql import OP12

WORDS = public_tokenizers.path("word_bpe_49k.json")


# words


@pytest.fixture(scope="module")
def encoder():
    with open(WORDS, encoding="utf-8") as f:
        return wordbpe.WordEncoder(f.read())


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(WORDS)


def texts_of(rng, n):
    letters = "aAbB'sStrevemlLdD 0129 .,!\n\t\x0b\x1cÉéİΣς̧́  語🙂"
    marks = ["<|endoftext|>", "<|startoftext|>", "<|endof", "|>"]
    return ["".join(rng.choice(marks) if rng.random() < 0.03 else rng.choice(letters) for _ in range(rng.randint(0, 60))) for _ in range(n)]


def test_words_are_encoded_and_decoded_as_the_library_does(encoder, library):
    texts = [None, "", " ", "a", "<|endoftext|>x<|startoftext|><|endoftext|> y", "abcxyz" * 2000, "é́ x", "\u0085a b", *texts_of(random.Random(1), 3000)]
    ids, bounds = encoder.encode(*text_bytes(pa.array(texts, pa.string())))
    decoded = encoder.decode(ids, bounds)
    for i, (text, want) in enumerate(zip(texts, library.encode_batch([t or "" for t in texts], add_special_tokens=False), strict=True)):
        assert ids[bounds[i] : bounds[i + 1]].tolist() == want.ids, text
        assert decoded[i].decode() == library.decode(want.ids, skip_special_tokens=False), text


def test_byte_level_pieces_are_split_by_the_public_pattern():
    assert bpe.BatchEncoder.PATTERN == public_tokenizers.PATTERN


def test_long_fragments_merge_as_short_ones_do(encoder):
    rng, v = random.Random(2), encoder.vocabulary
    for _ in range(200):
        parts = [v.base[ord(rng.choice("aabbcesthe"))] for _ in range(rng.randint(1, wordbpe.SHORT))]
        assert v.merge(list(parts)) == v.merge_long(list(parts))


def test_no_merge_crosses_a_forced_boundary(encoder):
    """Symbols that stand side by side in no token: no merge makes one of both."""
    v, symbol = encoder.vocabulary, {i: s for s, i in enumerate(encoder.vocabulary.base)}
    pairs = [(symbol[p >> wordbpe.BITS], symbol[p & (1 << wordbpe.BITS) - 1]) for p in v.pairs if p >> wordbpe.BITS in symbol and p & (1 << wordbpe.BITS) - 1 in symbol]
    assert pairs and all(v.inside[a, b] for a, b in pairs)
    assert not v.inside.all()


def test_tokenize_words(spark, library):
    rows = [(1, "Hello, World's 42", "x"), (None, None, "x"), (1, "Hello, World's 42", "x"), (3, "", "x"), (4, "q" * 70_000, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    got = wordbpe.tokenize(docs, WORDS, with_ids=True).collect()
    assert sorted((r["doc_id"] or -1) for r in got) == [-1, 1, 1, 3, 4]
    for r in got:
        text = {1: rows[0][1], 4: rows[4][1]}.get(r["doc_id"], "")
        want = library.encode(text, add_special_tokens=False).ids
        assert r["ids"] == want and r["n_tokens"] == len(want)
        assert r["ids_sha256"] == hashlib.sha256(b"".join(i.to_bytes(4, "little") for i in want)).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(library.decode(want, skip_special_tokens=False).encode()).hexdigest()
    assert not wordbpe.tokenize(docs.limit(0), WORDS).collect()


# conversations


def cheapest(rows):
    """Plain version: the least (cost, audit, repaired turns), state by state, over rows (role, text) in order."""
    far = (10**9, "", ())
    seen, best = set(), [(0, "", ()), far, far, far]

    def with_inserts(b):
        for _ in range(3):
            b = [b[0], b[1], min([b[2], *((c + 5, s + "I", (*t, ("user", ""))) for c, s, t in (b[0], b[1], b[3]))]), min(b[3], (b[2][0] + 5, b[2][1] + "I", (*b[2][2], ("assistant", ""))))]
        return b

    best = with_inserts(best)
    counts = dict.fromkeys(("blank", "duplicate", "truncated"), 0)
    for role, text in rows:
        solid = text.strip(" \t\n\x0b\x0c\r")
        fault = "blank" if not solid else "duplicate" if (role, text) in seen else "truncated" if solid[-1] not in ".!?" else None
        seen.add((role, text))
        if fault:
            counts[fault] += 1
        more, after = 5 * (fault == "truncated"), [[(c + 2, s + "D", t)] for c, s, t in best]
        if fault in (None, "truncated"):
            for q, (c, s, t) in enumerate(best):
                to = 3 if q == 2 else 2
                after[to].append((c + 1 + more, s + "R", (*t, (("user", "assistant")[to - 2], text))))
                keeps = {"s": 1 if q == 0 else None, "u": 2 if q != 2 else None, "a": 3 if q == 2 else None}.get(role[:1])
                if keeps:
                    after[keeps].append((c + more, s + "K", (*t, (role, text))))
        best = with_inserts([min(a) for a in after])
    return (*min(best[0], best[3]), counts)


def conversation_rows(rng, n):
    texts = ["Yes.", "No!", "Why?", "cut off", "cut again", " \n", "", None, "Tail. \t", "Tail "]
    roles = ["system", "user", "assistant", "user", "assistant", "tool", None, ""]
    return [(rng.choice([1, 2, 3, 4, None]) if rng.random() < 0.8 else rng.randint(5, 40), rng.choice([None, *range(-2, 30)]), rng.choice(roles), rng.choice(texts)) for _ in range(n)]


FIELDS = "conv_id long, turn long, role string, text string"


@pytest.mark.parametrize("options", [{}, {"piece_rows": 3}])
def test_repair_against_a_plain_version(spark, options):
    rng = random.Random(3)
    rows = conversation_rows(rng, 400)
    turns = spark.createDataFrame(rows, FIELDS).repartition(5).withColumn("copies", F.lit(1)).withColumn("place", F.lit("clash"))
    got = {r["conv_id"]: r for r in repair.repair(turns, **options).collect()}
    mended = {}
    for r in sorted(repair.repair(turns, with_turns=True, **options).collect(), key=lambda r: r["place"]):
        mended.setdefault(r["conv_id"], []).extend((t["role"], t["text"]) for t in r["repaired"])
    assert len(got) == len({r[0] for r in rows})
    for conv, r in got.items():
        own = sorted(((t is not None, t or 0, " " if role is None else role, " " if text is None else text) for c, t, role, text in rows if c == conv), key=lambda x: (x[0], x[1], x[2].encode(), x[3].encode()))
        cost, audit, turns_left, counts = cheapest([x[2:] for x in own])
        assert (r["cost"], r["audit"]) == (cost, audit)
        assert tuple(mended[conv]) == turns_left
        assert r["repaired_sha256"] == hashlib.sha256("\n".join(f"{a}:{b}" for a, b in turns_left).encode()).hexdigest()
        assert {k: r[k] for k in counts} == counts
        known = {x[1] for x in own if x[0]}
        assert r["gaps"] == (max(known) - min(known) + 1 - len(known) if known else 0)
        assert r["illegal"] == sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in zip(own, own[1:], strict=False))


@pytest.mark.parametrize("options", [{}, {"piece_rows": 2}])
def test_damaged_conversations_against_sql(spark, options):
    rows = conversation_rows(random.Random(4), 700) + [(99, 1, "user", "Hi.")] * 30 + [(500 + i, 0, "user", "One.") for i in range(60)]
    frame = spark.createDataFrame(rows, FIELDS)
    got = sorted((tuple(r) for r in repair.repair(repair.damaged(frame), **options).collect()), key=str)
    con = duckdb.connect()
    con.register("given", pa.table({n: pa.array(c, t) for n, c, t in zip(("conv_id", "turn", "role", "text"), zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.string(), pa.string()), strict=True)}))
    con.execute("create table conversations as select * from given")
    want = sorted(con.execute(OP12).fetchall(), key=str)
    assert got == want
    assert any(r[7] == "" for r in got)  # some lost all their rows
    assert not repair.repair(repair.damaged(frame.limit(0))).collect()


# centroids


def plain_lloyd(vectors, order, k, rounds, scale, dimension):
    kept = [(i, [math.floor(scale * float(x)) for x in v], v) for i, v in vectors if v is not None and len(v) == dimension and all(x is not None and math.isfinite(x) for x in v)]
    centroids = [x for _, x, _ in sorted(kept, key=lambda r: (order(r[0]), r[2]))[:k]]
    nearest = lambda x: min((sum((a - b) ** 2 for a, b in zip(x, c, strict=True)), j) for j, c in enumerate(centroids))
    for _ in range(rounds):
        owner = [nearest(x)[1] for _, x, _ in kept]
        for j in range(len(centroids)):
            own = [x for (_, x, _), o in zip(kept, owner, strict=True) if o == j]
            if own:
                centroids[j] = [sum(col) // len(own) for col in zip(*own, strict=True)]
    out = []
    for i, x, _ in kept:
        d, j = nearest(x)
        out.append((i, j, d, hashlib.sha256(",".join(map(str, centroids[j])).encode()).hexdigest()))
    inertia = [sum(d for _, o, d, _ in out if o == j) for j in range(len(centroids))]
    return sorted(((i, j, d, inertia[j], sum(inertia), s) for i, j, d, s in out), key=str)


@pytest.mark.parametrize(("n", "k", "rounds"), [(300, 5, 6), (300, 5, 0), (3, 8, 10), (60, 1, 3)])
def test_centroids_against_a_plain_version(spark, n, k, rounds):
    rng = random.Random(n + k)
    vectors = [(i, [rng.choice([-1.0, 0.0, 0.25, 1.5]) + rng.random() * rng.choice([0, 0.3]) for _ in range(4)]) for i in range(n)]
    vectors += [(5, vectors[1][1])] * 9 + [(None, vectors[0][1]), (1000, None), (1001, []), (1002, [1.0] * 3), (1003, [1.0, None, 2.0, 3.0]), (1004, [float("nan"), 0.0, 0.0, 0.0]), (1005, [float("inf"), 0.0, 0.0, 0.0]), (1006, [1.0] * 5)]
    frame = spark.createDataFrame([(i, v, "x") for i, v in vectors], "vec_id long, embedding array<double>, block string").repartition(3)
    digest = lambda i: (i is None, hashlib.sha256(str(i).encode()).hexdigest() if i is not None else "")
    order = F.sha2(F.col("vec_id").cast("string"), 256)
    got = lloyd.delta_lloyd(frame, order, k=k, rounds=rounds, scale=16, dimension=4)
    assert sorted((tuple(r) for r in got.collect()), key=str) == plain_lloyd(vectors, digest, k, rounds, 16, 4)


def test_centroids_of_nothing_and_of_numbers_too_large(spark):
    frame = spark.createDataFrame([(1, [1e30] * 4)], "vec_id long, embedding array<double>")
    assert not lloyd.delta_lloyd(frame.limit(0), F.col("vec_id"), dimension=4).collect()
    with pytest.raises(ArithmeticError):
        lloyd.delta_lloyd(frame, F.col("vec_id"), dimension=4)


def test_rounds_look_at_what_has_changed_only(spark):
    """A vector whose owner stands still keeps its stored distance, right or not, unless a centroid that moved is nearer."""
    import numpy as np

    points, centroids = np.array([[0], [10], [21]]), np.array([[0], [10], [20]])
    owner, own = lloyd.nearest(points, centroids, np.array([False, False, True]), np.array([0, 1, 2]), np.array([7, 0, 99]))
    assert owner.tolist() == [0, 1, 2] and own.tolist() == [7, 0, 1]
    moves = lloyd.transfers(points, np.array([0, 0, 2]), owner, 3).reshape(3, 2)
    assert moves.tolist() == [[-10, -1], [10, 1], [0, 0]]
    assert lloyd.transfers(points, owner, owner, 3) is None
