"""Conversation structure repair by a lazily determinised weighted automaton.

A repaired conversation has roles ``(s?(ua)+)?``.  An automaton over the rows keeps, deletes,
re-roles and inserts at fixed costs.  Its cost vectors (what it costs to end well from each of
its four states), less their smallest entry, are the states of a deterministic automaton; they
are made when first met and kept in a transition table, so that a conversation is one look
into the table a row, and the cost is what was subtracted on the way.  The table is scanned
from the last row; the trace goes the other way, along arcs whose cost is tight, and so meets
the edits in the order in which ties are broken.

Rows are dealt out by ranges of (conversation, turn), not by conversation: each task has some
conversations whole, and finishes them; of those that begin or end at its borders, or are
longer than a piece, it hands on pieces.  Only one byte a row of these meets in one task (as
much as the audit that is returned); their texts stay in pieces and are hashed as a stream.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .storage import anew, checkpoint

#: rows and bytes of text of a piece of a conversation
PIECE_ROWS, PIECE_BYTES = 4096, 4 << 20

DELETE, INSERT, REROLE, UNFINISHED = 2, 5, 1, 5
#: states: nothing yet, after a system turn, after a user turn, after an assistant turn
START, SYSTEM, USER, ASSISTANT = range(4)
#: where a kept row of each class (system, user, assistant, other) leads from each state, or None
KEPT = ((SYSTEM, None, None, None), (USER, USER, None, USER), (None, None, ASSISTANT, None), (None,) * 4)
#: where a turn of the role that may come next leads: the same for inserted and re-roled ones
NEXT = (USER, USER, ASSISTANT, USER)
NAMES = {USER: "user", ASSISTANT: "assistant"}
FINE, TRUNCATED, DUPLICATE, BLANK = range(4)


class Determinised:
    """The table of the deterministic automaton, filled as codes are met.

    A code is a row's role class plus 4 times its fault.
    """

    def __init__(self):
        self.vectors: list[tuple[int, ...]] = []
        self.numbers: dict[tuple[int, ...], int] = {}
        self.table: dict[int, tuple[int, int]] = {}
        self.traces: dict[int, tuple[str, int]] = {}
        self.final, self.least = self.number(self.closed([0, None, None, 0]))

    @staticmethod
    def closed(costs: list[int | None]) -> list[int]:
        """With inserted turns: from each state to the next one."""
        out = [1 << 30 if c is None else c for c in costs]
        for _ in range(3):
            out = [min(c, INSERT + out[NEXT[q]]) for q, c in enumerate(out)]
        return out

    def number(self, costs: list[int]) -> tuple[int, int]:
        least = min(costs)
        vector = tuple(c - least for c in costs)
        n = self.numbers.setdefault(vector, len(self.vectors))
        if n == len(self.vectors):
            self.vectors.append(vector)
        return n, least

    @staticmethod
    def arcs(code: int, q: int) -> Iterator[tuple[str, int, int]]:
        """Edits that deal with a row of this code in state ``q``: initial, cost, next state."""
        kind, fault = code & 3, code >> 2
        yield "D", DELETE, q
        if fault < DUPLICATE:
            more = UNFINISHED if fault == TRUNCATED else 0
            if KEPT[kind][q] is not None:
                yield "K", more, KEPT[kind][q]
            yield "R", REROLE + more, NEXT[q]

    def before(self, after: int, code: int) -> tuple[int, int]:
        """Vector in front of a row, given the one behind it, and what was subtracted."""
        key = after << 4 | code
        if key not in self.table:
            v = self.vectors[after]
            self.table[key] = self.number(self.closed([min(c + v[to] for _, c, to in self.arcs(code, q)) for q in range(4)]))
        return self.table[key]

    def scan(self, codes: bytes) -> tuple[int, list[int]]:
        """The cheapest cost, and the vectors behind each row."""
        state, cost, table, behind = self.final, self.least, self.table, []
        for code in reversed(codes):
            behind.append(state)
            state, less = table.get(state << 4 | code) or self.before(state, code)
            cost += less
        behind.reverse()
        return cost + self.vectors[state][START], behind

    def edits(self, after: int, code: int, q: int) -> tuple[str, int]:
        """The least string of tight edits that deals with a row in state ``q``, and the state it leads to."""
        key = (after << 4 | code) << 2 | q
        if key not in self.traces:
            (front, less), v, out, at = self.before(after, code), self.vectors[after], "", q
            costs = [c + less for c in self.vectors[front]]
            while True:
                choices = [(name, to) for name, c, to in self.arcs(code, at) if c + v[to] == costs[at]]
                choices += [("I", NEXT[at])] if INSERT + costs[NEXT[at]] == costs[at] else []
                name, at = min(choices)
                out += name
                if name != "I":
                    break
            self.traces[key] = out, at
        return self.traces[key]

    def trace(self, codes: bytes, behind: list[int], q: int = START) -> tuple[list[str], int]:
        """The edits of each row, and the state behind the last one."""
        out, traces = [], self.traces
        for code, after in zip(codes, behind, strict=True):
            edit, q = traces.get((after << 4 | code) << 2 | q) or self.edits(after, code, q)
            out.append(edit)
        return out, q

    @staticmethod
    def ending(q: int) -> str:
        """Turns inserted after the last row."""
        return {START: "", SYSTEM: "II", USER: "I", ASSISTANT: ""}[q]


def applied(edits: list[str], roles: list[str], texts: list[str], q: int) -> Iterator[tuple[str, str]]:
    """The repaired turns (role, text).  ``edits`` may have one entry more than there are rows: what comes after them."""
    for i, edit in enumerate(edits):
        for name in edit:
            if name == "I":
                q = NEXT[q]
                yield NAMES[q], ""
            elif name == "R":
                q = NEXT[q]
                yield NAMES[q], texts[i]
            elif name == "K":
                # a kept system turn stands first; any other is the one that comes next
                q = SYSTEM if roles[i][:1] == "s" else NEXT[q]
                yield roles[i], texts[i]


def lines(turns: Iterable[tuple[str, str]]) -> bytes:
    return "\n".join([f"{role}:{text}" for role, text in turns]).encode()


def facts(codes: bytes) -> tuple[int, int, int, int]:
    """Blank, duplicate and truncated rows, and neighbours whose roles may not stand side by side."""
    c = np.frombuffer(codes, np.uint8)
    fault, kind = c >> 2, c & 3
    pair = kind[:-1] * 4 + kind[1:]
    return (*(int((fault == f).sum()) for f in (BLANK, DUPLICATE, TRUNCATED)), int((~np.isin(pair, [1, 6, 9])).sum()))


BLANKS = "[\\x20\\x09-\\x0D]"
PIECE = "conv_id long, place long, codes binary, first_turn long, last_turn long, turns long, roles array<string>, texts array<string>, copies array<long>, cost long, audit string, repaired array<struct<role string, text string>>, repaired_sha256 string"
RESULT = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"


def code_of(role: Column, text: Column, again: Column) -> Column:
    """A row's role class plus 4 times its first fault; ``again``: whether role and text were seen earlier."""
    initial = F.substring(role, 1, 1)
    kind = F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3)
    fault = F.when(~text.rlike("[^\\x20\\x09-\\x0D]"), BLANK).when(again, DUPLICATE).when(~text.rlike(f"[.!?]{BLANKS}*\\z"), TRUNCATED).otherwise(FINE)
    return (kind + 4 * fault).cast("int")


def coded(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, code, copies): equal rows once, with their number, before anything is dealt out."""
    rows = turns.groupBy("conv_id", "turn", "role", "text").agg(F.sum("copies").alias("copies"))
    # texts that a conversation has in several turns: the first one is no duplicate
    key = F.sha2(F.to_json(F.struct("conv_id", "role", "text")), 256)
    keyed = turns.filter("copies > 0").select(key.alias("key"), F.struct("turn").alias("at")).withColumn("hash", F.xxhash64("key"))
    again = keyed.groupBy("hash", "key").agg(F.min("at").alias("first"), F.max("at").alias("last")).filter("first < last").select("hash", "key", "first")
    met = rows.withColumn("key", key).withColumn("hash", F.xxhash64("key")).join(anew(again, "hash"), ["hash", "key"], "left")
    later = F.coalesce(F.col("first") < F.struct("turn"), F.lit(False))
    return met.select("conv_id", "turn", "role", "text", code_of(F.col("role"), F.col("text"), later).alias("code"), "copies")


TURNS = pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))
PIECE_TYPES = [pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.string()), pa.list_(pa.string()), pa.list_(pa.int64()), pa.int64(), pa.string(), TURNS, pa.string()]
PIECE_NAMES = ["conv_id", "place", "codes", "first_turn", "last_turn", "turns", "roles", "texts", "copies", "cost", "audit", "repaired", "repaired_sha256"]


def batch_of(found: list[tuple]) -> pa.RecordBatch:
    return pa.record_batch([pa.array(list(c), t) for c, t in zip(zip(*found, strict=True), PIECE_TYPES, strict=True)], PIECE_NAMES)


def pieces(rows: DataFrame, with_turns: bool, piece_rows: int, piece_bytes: int) -> DataFrame:
    """The rows of ``coded`` in pieces: those of conversations that a task has whole with their results, others open (audit is null)."""
    ranged = rows.repartitionByRange("conv_id", "turn", "role", F.substring("text", 1, 32)).sortWithinPartitions("conv_id", "turn", "role", "text")
    step, row_bytes = min(64, piece_rows), piece_bytes // piece_rows

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine, place = Determinised(), TaskContext.get().partitionId() << 33
        run: list[list] = [[], [], [], [], []]  # columns of the conversation at hand
        now, first, whole, weight, done = None, True, False, 0, []

        def piece(final: bool) -> tuple:
            turn, role, text, code, copies = run
            if final and min(copies) == max(copies) == 1:
                codes = bytes(code)
            else:  # of equal rows, all but the first are duplicates, if not blank
                codes = b"".join([bytes([c]) + bytes([c if c >> 2 == BLANK else c & 3 | DUPLICATE << 2]) * (n - 1) for c, n in zip(code, copies, strict=True) if n])
            known = [t for t, n in zip(turn, copies, strict=True) if n and t is not None]
            head = (now, place, codes, min(known, default=None), max(known, default=None), len(set(known)))
            if not final:
                keep = [i for i, n in enumerate(copies) if n]
                return (*head, *([col[i] for i in keep] for col in (role, text, copies)), None, None, None, None)
            cost, behind = machine.scan(codes)
            edits, q = machine.trace(codes, behind)
            edits.append(machine.ending(q))
            if len(codes) != len(role) or 0 in copies:
                role, text = ([x for x, n in zip(col, copies, strict=True) for _ in range(n)] for col in (role, text))
            turns = list(applied(edits, role, text, START))
            shown = [{"role": r, "text": t} for r, t in turns] if with_turns else None
            return (*head, None, None, None, cost, "".join(edits), shown, hashlib.sha256(lines(turns)).hexdigest())

        for batch in batches:
            columns, at = [batch.column(c).to_pylist() for c in ("turn", "role", "text", "code", "copies")], 0
            for key, group in itertools.groupby(batch.column("conv_id").to_pylist()):
                if run[0] and key != now:
                    done.append(piece(whole))
                    place, first, run = place + 1, False, [[], [], [], [], []]
                if not run[0]:
                    # the first conversation of a task may have begun in another one; a cut one goes on as it is
                    whole, weight = not first and key != now, 0
                now = key
                to = at + sum(1 for _ in group)
                while at < to:
                    upto = min(to, at + step)
                    for col, values in zip(run, columns, strict=True):
                        col += values[at:upto]
                    weight += sum(map(len, columns[2][at:upto])) + (upto - at) * row_bytes
                    at = upto
                    if weight > piece_bytes:
                        yield batch_of([*done, piece(False)])
                        place, first, whole, weight, done, run = place + 1, False, False, 0, [], [[], [], [], [], []]
                if len(done) >= 1000:
                    yield batch_of(done)
                    done = []
        if run[0]:
            done.append(piece(False))
        if done:
            yield batch_of(done)

    return ranged.mapInArrow(cut, PIECE)


def gaps(first: int | None, last: int | None, turns: int) -> int:
    return 0 if first is None else last - first + 1 - turns


def solved(open_pieces: DataFrame) -> DataFrame:
    """Results of conversations in several pieces, with the edits and the entry state of each piece.  Codes and turns meet, no texts."""
    met = open_pieces.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("place", "codes", "first_turn", "last_turn", "turns"))).alias("parts"))

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = Determinised()
        for batch in batches:
            found = []
            for conv, parts in zip(batch.column("conv_id").to_pylist(), batch.column("parts").to_pylist(), strict=True):
                codes = b"".join([p["codes"] for p in parts])
                cost, behind = machine.scan(codes)
                q, at, slices = START, 0, []
                for i, p in enumerate(parts):
                    to = at + len(p["codes"])
                    edits, after = machine.trace(codes[at:to], behind[at:to], q)
                    slices.append({"place": p["place"], "entry": q, "edits": edits + [machine.ending(after)] * (i == len(parts) - 1)})
                    q, at = after, to
                known = [p for p in parts if p["first_turn"] is not None]
                distinct = sum(p["turns"] for p in known) - sum(a["last_turn"] == b["first_turn"] for a, b in itertools.pairwise(known))
                n = gaps(known[0]["first_turn"], known[-1]["last_turn"], distinct) if known else 0
                found.append((conv, n, *facts(codes), cost, "".join(e for s in slices for e in s["edits"]), slices))
            types = [pa.int64()] * 7 + [pa.string(), pa.list_(pa.struct([("place", pa.int64()), ("entry", pa.int32()), ("edits", pa.list_(pa.string()))]))]
            yield pa.record_batch([pa.array(list(c), t) for c, t in zip(zip(*found, strict=True), types, strict=True)], names)

    names = [*(x.split(" ")[0] for x in RESULT.split(", ")), "slices"]
    return met.mapInArrow(solve, RESULT + ", slices array<struct<place: long, entry: int, edits: array<string>>>")


def repaired_pieces(open_pieces: DataFrame, answers: DataFrame) -> DataFrame:
    """(conv_id, place, role[], text[]) of each open piece after its edits; a piece meets its own edits, by place."""
    edits = answers.select(F.explode("slices").alias("s")).select("s.place", "s.entry", "s.edits")

    def mend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                roles, texts, copies, names, entry = (batch.column(c)[row].as_py() for c in ("roles", "texts", "copies", "edits", "entry"))
                roles, texts = ([x for x, n in zip(col, copies, strict=True) for _ in range(n)] for col in (roles, texts))
                turns = [{"role": r, "text": t} for r, t in applied(names, roles, texts, entry)]
                yield pa.record_batch([batch.column("conv_id").slice(row, 1), batch.column("place").slice(row, 1), pa.array([turns], TURNS)], ["conv_id", "place", "repaired"])

    joined = open_pieces.select("conv_id", "place", "roles", "texts", "copies").join(edits, "place")
    return joined.mapInArrow(mend, "conv_id long, place long, repaired array<struct<role: string, text: string>>")


def hashed(mended: DataFrame) -> DataFrame:
    """(conv_id, repaired_sha256): the pieces of a conversation pass through one hash in their order, and none is kept."""

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state, begun, out = None, None, False, []
        for batch in batches:
            for row in range(batch.num_rows):
                conv = batch.column("conv_id")[row].as_py()
                if state is None or conv != now:
                    if state is not None:
                        out.append((now, state.hexdigest()))
                    now, state, begun = conv, hashlib.sha256(), False
                turns = batch.column("repaired")[row].as_py()
                if turns:
                    state.update(b"\n" * begun + lines((t["role"], t["text"]) for t in turns))
                    begun = True
        if state is not None:
            out.append((now, state.hexdigest()))
        ids, digests = zip(*out, strict=True) if out else ((), ())
        yield pa.record_batch([pa.array(list(ids), pa.int64()), pa.array(list(digests), pa.string())], ["conv_id", "repaired_sha256"])

    return mended.repartition("conv_id").sortWithinPartitions("conv_id", "place").mapInArrow(digest, "conv_id long, repaired_sha256 string")


def repair(turns: DataFrame, with_turns: bool = False, piece_rows: int = PIECE_ROWS, piece_bytes: int = PIECE_BYTES) -> DataFrame:
    """The cheapest repair of each conversation to roles ``(s?(ua)+)?``.

    ``turns`` has conv_id, turn, role, text and copies: how often the row stands there; a row
    with 0 copies only names its conversation.  Rows are taken by turn (null first), then by role
    and text.  A null role or text counts as one blank, rows without conv_id are a
    conversation of their own.  A row's first fault counts: blank, duplicate (role and text
    seen earlier), truncated (does not end in ``.``, ``!`` or ``?``).  Keeping costs 0, another
    role 1, deleting 2 (the only choice for blank and duplicate rows), an inserted empty turn
    5, a truncated row that stays 5 more.

    Returns for each conversation: conv_id, gaps (turns missing between the first and the
    last), blank, duplicate, truncated, illegal (neighbours whose roles are not su, ua or au),
    cost, audit (initials of the edits, the least of equally cheap ones) and repaired_sha256
    (of ``role:text`` lines).  With ``with_turns`` it returns the repaired turns instead:
    conv_id, place and repaired, an array of (role, text); long conversations have several
    places, in order.  An empty table gives no row.
    """
    turns = turns.select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"), F.col("copies").cast("long").alias("copies"))
    cut = checkpoint(pieces(coded(turns), with_turns, piece_rows, piece_bytes))
    open_pieces = cut.filter("audit is null")
    answers = checkpoint(solved(open_pieces))
    mended = repaired_pieces(open_pieces, answers)
    if with_turns:
        return cut.filter("audit is not null").select("conv_id", "place", "repaired").unionByName(mended)

    def results(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            first, last, n, codes = (batch.column(c).to_pylist() for c in ("first_turn", "last_turn", "turns", "codes"))
            columns = [[gaps(*x) for x in zip(first, last, n, strict=True)], *zip(*map(facts, codes), strict=True)] if codes else [[]] * 5
            yield pa.record_batch([batch.column("conv_id"), *(pa.array(list(c), pa.int64()) for c in columns), *(batch.column(c) for c in ("cost", "audit", "repaired_sha256"))], names)

    names = [*(x.split(" ")[0] for x in RESULT.split(", ")), "repaired_sha256"]
    closed = cut.filter("audit is not null").select("conv_id", "first_turn", "last_turn", "turns", "codes", "cost", "audit", "repaired_sha256").mapInArrow(results, RESULT + ", repaired_sha256 string")
    digests = hashed(mended).withColumnRenamed("conv_id", "id")
    answered = answers.drop("slices").join(digests, answers["conv_id"].eqNullSafe(digests["id"])).drop("id")
    return closed.unionByName(answered)


def damaged(conversations: DataFrame) -> DataFrame:
    """Rows of ``conversations`` damaged by crc32 of ``conv_id:turn`` modulo 20, for tests of the repair: 0 drops a row, 1 empties its text, 2 removes ``.!?``, 3 repeats it, 4 sets the role user.  Dropped rows stay with 0 copies."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(text("conv_id"), F.lit(":"), text("turn")).cast("binary")) % 20
    rows = conversations.select("conv_id", "turn", text("role").alias("role"), text("text").alias("text"), kind.alias("kind"))
    body = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    gone = F.col("kind") == 0
    role = F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))
    stays = lambda c: F.when(~gone, c)
    return rows.select("conv_id", stays(F.col("turn")).alias("turn"), stays(role).alias("role"), stays(body).alias("text"), F.when(gone, 0).when(F.col("kind") == 3, 2).otherwise(1).alias("copies"))
