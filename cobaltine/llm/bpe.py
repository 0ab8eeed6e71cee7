"""Byte-level BPE by prefix dynamic programming.

For every byte prefix of a piece there is exactly one token that can end its encoding.  The
encoder stores that last token for each prefix.  The next prefix tries the tokens that are
suffixes of it, longest first, and takes the one that may follow the last token of the prefix
before it; two tokens may be neighbours if encoding them joined gives the same two tokens
back.  The table makes appends exact (earlier entries never change), and an edit is encoded
again only from where it starts.
"""

from __future__ import annotations

import base64
import hashlib
import itertools
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .arrays import slices, text_bytes

#: pieces whose ids are kept in a worker before the store is emptied
STORED_PIECES = 150_000
#: token pairs whose compatibility is kept
STORED_PAIRS = 300_000


class Vocabulary:
    """Ranks of a byte-level BPE, and which two tokens may stand side by side."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.tokens = [b""] * (max(ranks.values()) + 1)
        for token, i in ranks.items():
            self.tokens[i] = token
        self.longest = max(map(len, ranks))
        self._split: dict[int, tuple[int, int] | None] = {}
        self.pairs = Pairs(self)
        #: finds every token that ends at a byte; tokens that no merge makes are left out
        self.matcher = ahocorasick.Automaton()
        for token, i in ranks.items():
            if self.made(i):
                self.matcher.add_word(token.decode("latin-1"), (i, len(token)))
        self.matcher.make_automaton()

    @classmethod
    def load(cls, lines: list[bytes]) -> Vocabulary:
        """Lines of a .tiktoken file: a token in base64 and its rank."""
        return cls({base64.b64decode(a): int(b) for a, b in map(bytes.split, filter(None, lines))})

    def split(self, token: int) -> tuple[int, int] | None:
        """The two tokens that merge into ``token``; None for a token that no merge makes."""
        if token not in self._split:
            parts = self.merge(self.tokens[token], token)
            self._split[token] = tuple(parts) if len(parts) == 2 else None
        return self._split[token]

    def merge(self, piece: bytes, below: int) -> list[int]:
        """Encodes a short piece by merging the lowest rank first, using only ranks under ``below``."""
        parts = [bytes([b]) for b in piece]
        while len(parts) > 1:
            rank, at = min((self.ranks.get(a + b, below), i) for i, (a, b) in enumerate(itertools.pairwise(parts)))
            if rank >= below:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [self.ranks[p] for p in parts]

    def made(self, token: int) -> bool:
        """Whether encoding the token's own bytes gives the token; some vocabularies hold others."""
        return len(self.tokens[token]) == 1 or self.split(token) is not None


class Pairs(dict):
    """Whether two tokens may be neighbours: joining their bytes and encoding them gives both back.  Key: left << 20 | right."""

    def __init__(self, vocabulary: Vocabulary):
        super().__init__()
        self.vocabulary = vocabulary

    def __missing__(self, pair: int) -> bool:
        """Undoes the merges of both sides from the highest rank down.

        If at some moment the two tokens at the seam could merge before the ones around them
        do, the pair is impossible.
        """
        v, a, b, limit, possible = self.vocabulary, pair >> 20, pair & (1 << 20) - 1, 1 << 62, True
        while possible:
            rank = v.ranks.get(v.tokens[a] + v.tokens[b])
            if rank is not None and rank < limit:
                possible = False
                break
            x, y = v.split(a), v.split(b)
            if x and (a > b or not y):
                limit, a = a, x[1]
            elif y:
                # merges of equal rank go from left to right, so the seam comes before the right token
                limit, b = b + 1, y[0]
            else:
                break
        if len(self) >= STORED_PAIRS:
            self.clear()
        self[pair] = possible
        return possible


class PrefixTable:
    """The last token of every prefix of one piece."""

    def __init__(self, vocabulary: Vocabulary, piece: bytes = b""):
        self.vocabulary, self.piece, self.last = vocabulary, b"", []
        self.append(piece)

    def append(self, more: bytes) -> None:
        """Adds bytes at the end; what is stored for shorter prefixes stays as it is."""
        self.piece += more
        extend(self.vocabulary, self.piece, self.last)

    def replace(self, start: int, end: int, new: bytes) -> None:
        """Replaces bytes; prefixes up to ``start`` keep their entries, and the rest is encoded again only until it agrees with what was stored."""
        tail, old = self.piece[end:], self.last[end:]
        self.piece, self.last = self.piece[:start], self.last[:start]
        self.append(new)
        agree = 0
        for i in range(len(tail)):
            self.append(tail[i : i + 1])
            # a token looks back at most `longest` bytes and at the entry before it
            agree = agree + 1 if self.last[-1] == old[i] and len(self.vocabulary.tokens[old[i]]) <= i + 1 else 0
            if agree > self.vocabulary.longest:
                self.piece += tail[i + 1 :]
                self.last += old[i + 1 :]
                break

    def ids(self) -> list[int]:
        return trace(self.vocabulary, self.last)


def extend(v: Vocabulary, piece: bytes, last: list[int]) -> None:
    """Adds to ``last`` the last token of each prefix of ``piece`` that is longer than what it covers."""
    pairs, done = v.pairs, len(last)
    base = max(0, done - v.longest + 1)
    last += [-1] * (len(piece) - done)
    for end, (token, size) in v.matcher.iter(piece[base:].decode("latin-1")):
        end += base
        if end >= done and last[end] < 0:
            before = end - size
            if before < 0 or pairs[last[before] << 20 | token]:
                last[end] = token
    if -1 in last[done:]:
        raise ValueError(f"a byte of {piece!r} is in no token")


def trace(v: Vocabulary, last: list[int]) -> list[int]:
    """Ids of the whole piece: its last token, then the last token of what stands before that, and so on."""
    out, at, tokens = [], len(last), v.tokens
    while at:
        token = last[at - 1]
        out.append(token)
        at -= len(tokens[token])
    return out[::-1]


def encode_piece(v: Vocabulary, piece: bytes) -> list[int]:
    """A piece that is a token is that token; others are encoded by their prefixes."""
    whole = v.ranks.get(piece)
    if whole is not None:
        return [whole]
    last: list[int] = []
    extend(v, piece, last)
    return trace(v, last)


class Encoder(dict):
    """Ids of pieces as packed little-endian 32-bit integers; unknown pieces are encoded when first met."""

    def __init__(self, vocabulary: Vocabulary, pattern: str):
        super().__init__()
        self.vocabulary, self.find = vocabulary, regex.compile(pattern).findall

    def __missing__(self, piece: str) -> bytes:
        ids = np.array(encode_piece(self.vocabulary, piece.encode()), "<u4").tobytes()
        if len(piece) <= 64:
            if len(self) >= STORED_PIECES:
                self.clear()
            self[piece] = ids
        return ids

    def encode(self, text: str) -> bytes:
        return b"".join(map(self.__getitem__, self.find(text)))

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.vocabulary.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def character_classes() -> np.ndarray:
    """For each code point: 0 letter, 1 number, 2 other, 3 white space."""
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    out = np.full(0x110000, 2, np.uint8)
    for kind, pattern in ((0, r"\p{L}+"), (1, r"\p{N}+"), (3, r"\s+")):
        for m in regex.finditer(pattern, every):
            a, b = ord(m[0][0]), ord(m[0][-1])
            out[a : b + 1] = kind
    return out


class BatchEncoder:
    """Encodes all texts of a batch at once.

    Splits them as the common byte-level pattern does, with array operations; each distinct
    piece is encoded once and kept.  ``split`` gives what ``regex.findall`` would.
    """

    PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary, self.known, self.classes = vocabulary, {}, character_classes()
        self.sizes = np.array(list(map(len, vocabulary.tokens)), np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.sizes)])[:-1]
        self.flat = np.frombuffer(b"".join(vocabulary.tokens), np.uint8)

    def split(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Byte starts of all pieces, and for each row the index of its first piece (one more at the end)."""
        if not len(data):
            return np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
        points = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), "<u4")
        place = np.flatnonzero((data & 0xC0) != 0x80)
        rows = np.searchsorted(place, offsets)
        kind, n = self.classes[points], len(points)
        cut = np.ones(n + 1, bool)
        cut[1:n] = kind[1:] != kind[:-1]
        cut[rows] = True
        start = np.flatnonzero(cut)
        start, end, last_of_row = start[:-1], start[1:], np.isin(start[1:], rows)
        # the last white space before other text stands alone, or opens the next piece if it is a blank
        edge = end[(kind[start] == 3) & ~last_of_row]
        cut[edge - 1] = True
        cut[edge[points[edge - 1] == 32]] = False
        # an apostrophe that no blank precedes takes the letters of a contraction
        at = start[(points[start] == 39) & (end - start == 1) & ~last_of_row & cut[start]]
        at = at[kind[at + 1] == 0]
        upto = np.append(end, 0)[np.searchsorted(start, at + 1)]
        one, two = points[at + 1], points[np.minimum(at + 2, n - 1)]
        size = np.isin(one, [115, 116, 109, 100]).astype(np.int64)
        size[(upto >= at + 3) & (((one == 114) | (one == 118)) & (two == 101) | (one == 108) & (two == 108))] = 2
        at, size = at[size > 0], size[size > 0]
        cut[at + 1] = False
        cut[at + 1 + size] = True
        start = np.flatnonzero(cut[:-1])
        return place[start], np.searchsorted(start, rows)

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, and where each row's ids start (one more at the end)."""
        start, first = self.split(data, offsets)
        end = np.append(start[1:], len(data))
        # pieces are told apart byte for byte
        spans = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(np.append(start, end[-1:]).astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data))])
        coded, known, encoded = spans.dictionary_encode(), self.known, []
        piece = coded.indices.to_numpy()
        for span in coded.dictionary.to_pylist():
            ids = known.get(span)
            if ids is None:
                ids = np.array(encode_piece(self.vocabulary, span), np.uint32).tobytes()
                if len(span) <= 64:
                    if len(known) >= STORED_PIECES:
                        known.clear()
                    known[span] = ids
            encoded.append(ids)
        sizes = np.array(list(map(len, encoded)), np.int64) // 4
        ids, ends = ragged(np.frombuffer(b"".join(encoded), np.uint32), (np.cumsum(sizes) - sizes)[piece], sizes[piece])
        return ids, ends[first]

    def decode(self, ids: np.ndarray, bounds: np.ndarray) -> tuple[bytes, np.ndarray]:
        """Bytes of all ids, and where each row's bytes start."""
        out, ends = ragged(self.flat, self.starts[ids], self.sizes[ids])
        return out.tobytes(), ends[bounds]


def ragged(flat: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Concatenates ``flat[start:start + size]`` of all entries; also gives where each one starts (one more at the end)."""
    ends = np.concatenate([[0], np.cumsum(size)])
    return flat[np.repeat(start - ends[:-1], size) + np.arange(ends[-1])], ends


_encoders: dict[str, BatchEncoder] = {}


def shared_encoder(lines: list[bytes]) -> BatchEncoder:
    """One encoder for all tasks that a Python worker runs, so that its stored pieces stay warm."""
    key = hashlib.sha256(b"\n".join(lines)).hexdigest()
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = BatchEncoder(Vocabulary.load(lines))
    return _encoders[key]


def append_text(encoder: Encoder, text: str, pieces: list[str], more: str) -> list[str]:
    """Pieces of ``text + more``, given those of ``text``: only the last one can change."""
    kept = pieces[:-1]
    return kept + encoder.find((pieces[-1] if pieces else "") + more)


def vocabulary_lines(path: str) -> list[bytes]:
    """Reads the vocabulary file on the driver, once; its size does not depend on the data."""
    with open(path, "rb") as f:
        return f.read().splitlines()


def tokenize(documents: DataFrame, path: str, with_ids: bool = False) -> DataFrame:
    """Encodes every whole text, split by ``BatchEncoder.PATTERN``, and decodes the ids again.

    ``documents`` has doc_id and text; ``path`` names a .tiktoken file of ranks.  Returns for
    each row: doc_id, n_tokens, ids_sha256 (of the ids as little-endian unsigned 32-bit
    integers), decoded_sha256 (of the decoded bytes), and with ``with_ids`` the ids.  A null
    text is encoded as an empty one: no ids.  Other columns are not looked at, and no row is
    lost.  No special tokens: their strings are ordinary text.
    """
    lines = documents.sparkSession.sparkContext.broadcast(vocabulary_lines(path))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = shared_encoder(lines.value)
        for batch in slices(batches, "text"):
            data, offsets = text_bytes(batch.column("text"))
            ids, bounds = encoder.encode(data, offsets)
            decoded, ends = encoder.decode(ids, bounds)
            packed, spans = ids.astype("<u4").tobytes(), list(itertools.pairwise(bounds.tolist()))
            columns = [
                batch.column("doc_id"),
                pa.array(np.diff(bounds)),
                pa.array([hashlib.sha256(packed[4 * a : 4 * b]).hexdigest() for a, b in spans], pa.string()),
                pa.array([hashlib.sha256(decoded[a:b]).hexdigest() for a, b in itertools.pairwise(ends.tolist())], pa.string()),
            ]
            if with_ids:
                columns.append(pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(ids.astype(np.int32))))
            yield pa.record_batch(columns, names)

    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", *["ids"] * with_ids]
    return documents.select("doc_id", "text").mapInArrow(encode, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids)
