"""Word-level BPE with forced boundaries.

Two neighbouring bytes that stand side by side inside no token of the vocabulary are never
merged over, so a word can be cut between them for certain.  The fragments between the cuts
are encoded independently, each distinct one once a worker, and their ids concatenated.  The
last byte of a word differs from the same byte elsewhere, as tokens that end a word do.
"""

from __future__ import annotations

import hashlib
import heapq
import itertools
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from tokenizers import Tokenizer

from .arrays import slices, text_bytes, words
from .bpe import ragged

#: chunks and fragments whose ids are kept in a worker before the store is emptied, and the longest one kept, in bytes
STORED, LONGEST = 400_000, 128
#: symbols up to which a fragment is merged by looking at all its pairs again and again
SHORT = 64
#: how the vocabulary file splits text; fixed, as words are cut by it here too
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: the same pattern over lower-case ASCII chunks, one a line
ASCII_PATTERN = re.compile(rb"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^\na-z0-9]+|\n")
NONE = 1 << 62
BITS = 20


def byte_alphabet() -> list[str]:
    """The character that stands for each byte in a byte-level vocabulary: itself if it is printable, else the next one from code point 256."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = itertools.count(256)
    return [chr(b) if b in shown else chr(next(spare)) for b in range(256)]


class Vocabulary:
    """Tokens and merges of a tokenizer file whose words end in a suffix.

    A symbol is a byte, plus 256 if it ends its word.
    """

    def __init__(self, spec: dict):
        model, letters = spec["model"], byte_alphabet()
        suffix, vocab = model["end_of_word_suffix"], model["vocab"]
        splits = [x["pattern"].get("Regex") for x in spec["pre_tokenizer"]["pretokenizers"] if x["type"] == "Split"]
        if not suffix or splits != [PATTERN]:
            raise ValueError("not a vocabulary of words with an end, split by the known pattern")
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        names = {i: t for t, i in [*vocab.items(), *self.special.items()]}
        self.names = [names.get(i, "") for i in range(max(names) + 1)]
        self.base = [vocab[c + end] for end in ("", suffix) for c in letters]
        pairs = (m.split(" ") if isinstance(m, str) else m for m in model["merges"])
        #: left id and right id to rank and id of what they merge into
        self.pairs = {vocab[a] << BITS | vocab[b]: rank << BITS | vocab[a + b] for rank, (a, b) in enumerate(pairs)}
        #: whether two symbols stand side by side inside a token
        self.inside = np.zeros((256, 512), bool)
        byte = {c: i for i, c in enumerate(letters)}
        for token in vocab:
            ends = token.endswith(suffix) and token != suffix
            symbols = [byte[c] for c in (token[: -len(suffix)] if ends else token)]
            symbols[-1] += 256 * ends
            self.inside[symbols[:-1], symbols[1:]] = True

    def merge(self, parts: list[int]) -> list[int]:
        """Merges the neighbours of lowest rank, the leftmost first, until none merge."""
        if len(parts) > SHORT:
            return self.merge_long(parts)
        pairs = self.pairs
        ranks = [pairs.get(a << BITS | b, NONE) for a, b in itertools.pairwise(parts)]
        while ranks and (best := min(ranks)) < NONE:
            i = ranks.index(best)
            parts[i : i + 2] = [best & (1 << BITS) - 1]
            del ranks[i]
            if i:
                ranks[i - 1] = pairs.get(parts[i - 1] << BITS | parts[i], NONE)
            if i < len(ranks):
                ranks[i] = pairs.get(parts[i] << BITS | parts[i + 1], NONE)
        return parts

    def merge_long(self, parts: list[int]) -> list[int]:
        """The same with a heap of pairs, in n log n steps."""
        pairs, n, mask = self.pairs, len(parts), (1 << BITS) - 1
        before, after, gone = [*range(-1, n - 1)], [*range(1, n + 1)], bytearray(n)
        heap = [(r, i) for i, (a, b) in enumerate(itertools.pairwise(parts)) if (r := pairs.get(a << BITS | b)) is not None]
        heapq.heapify(heap)
        while heap:
            rank, i = heapq.heappop(heap)
            j = after[i]
            if gone[i] or j >= n or pairs.get(parts[i] << BITS | parts[j]) != rank:
                continue
            parts[i], gone[j], after[i] = rank & mask, 1, after[j]
            if after[j] < n:
                before[after[j]] = i
            for left, right in ((before[i], i), (i, after[i])):
                if left >= 0 and right < n and (r := pairs.get(parts[left] << BITS | parts[right])) is not None:
                    heapq.heappush(heap, (r, left))
        return [p for p, x in zip(parts, gone, strict=True) if not x]


class Store(dict):
    """Ids by bytes; emptied when full, and long entries are not kept."""

    def keep(self, key: bytes, ids: bytes) -> bytes:
        if len(key) <= LONGEST:
            if len(self) >= STORED:
                self.clear()
            self[key] = ids
        return ids


def gathered(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """The distinct spans of ``data`` in the order in which they are met, and the number of each span's own.  Spans are compared byte for byte."""
    flat, ends = ragged(data, start, end - start)
    spans = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(flat))])
    coded = spans.dictionary_encode()
    return coded.dictionary, coded.indices.to_numpy()


class WordEncoder:
    """Encodes all texts of a batch at once, as the file's tokenizer does, its special tokens in a text included.

    White space ends every word, so a text is cut at ASCII white space first: what a chunk
    between two blanks is encoded to depends on that chunk alone.
    """

    def __init__(self, text: str):
        tokenizer = Tokenizer.from_str(text)
        self.vocabulary = Vocabulary(json.loads(text))
        self.normal, self.split = tokenizer.normalizer, tokenizer.pre_tokenizer
        self.to_byte = {ord(c): b for b, c in enumerate(byte_alphabet())}
        special = sorted(self.vocabulary.special, key=len, reverse=True)
        self.is_special = re.compile(f"({'|'.join(map(re.escape, special))})") if special else None
        self.marks = [s.encode() for s in special]
        self.chunks, self.fragments = Store(), Store()
        named = [n.encode() + b" " for n in self.vocabulary.names]
        self.sizes = np.array(list(map(len, named)), np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.flat = np.frombuffer(b"".join(named), np.uint8)

    def pieces(self, chunk: str) -> list[bytes | int]:
        """The words of a chunk as bytes, and the ids of special tokens, which are found before anything is normalised."""
        out: list[bytes | int] = []
        for part in self.is_special.split(chunk) if self.is_special else [chunk]:
            if part in self.vocabulary.special:
                out.append(self.vocabulary.special[part])
            elif part:
                out += [w.translate(self.to_byte).encode("latin-1") for w, _ in self.split.pre_tokenize_str(self.normal.normalize_str(part))]
        return out

    def encode_words(self, found: list[bytes]) -> list[bytes]:
        """Ids of each word (packed 32-bit integers): all are cut at once, and each distinct fragment is merged once."""
        if not found:
            return []
        v, ends = self.vocabulary, np.cumsum(list(map(len, found)))
        symbols = np.frombuffer(b"".join(found), np.uint8).astype(np.uint16)
        symbols[ends - 1] += 256
        cut = np.ones(len(symbols), bool)
        cut[1:] = ~v.inside[symbols[:-1] & 255, symbols[1:]]
        cut[ends[:-1]] = True
        start = np.flatnonzero(cut)
        stop = np.append(start[1:], len(symbols))
        distinct, which = gathered(symbols.view(np.uint8), start * 2, stop * 2)
        ids = []
        for fragment in distinct.to_pylist():
            known = self.fragments.get(fragment)
            if known is None:
                parts = v.merge([v.base[s] for s in np.frombuffer(fragment, np.uint16).tolist()])
                known = self.fragments.keep(fragment, np.array(parts, "<u4").tobytes())
            ids.append(known)
        each, bounds = [ids[i] for i in which.tolist()], np.searchsorted(start, ends).tolist()
        return [each[a] if b - a == 1 else b"".join(each[a:b]) for a, b in itertools.pairwise([0, *bounds])]

    def encode_chunks(self, new: list[bytes]) -> list[bytes]:
        """Ids of chunks that are not known: plain ASCII ones are split together, the others one by one."""
        plain = [c.isascii() and not any(m in c for m in self.marks) for c in new]
        units: list[bytes | int] = ASCII_PATTERN.findall(b"".join([c.lower() + b"\n" for c, p in zip(new, plain, strict=True) if p]))
        stops = np.flatnonzero(np.fromiter((u == b"\n" for u in units), bool, len(units))).tolist()
        parts = iter([units[a + 1 : b] for a, b in itertools.pairwise([-1, *stops])])
        each = [next(parts) if p else self.pieces(c.decode()) for c, p in zip(new, plain, strict=True)]
        ids = iter(self.encode_words([u for part in each for u in part if not isinstance(u, int)]))
        return [b"".join([u.to_bytes(4, "little") if isinstance(u, int) else next(ids) for u in part]) for part in each]

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, and where each row's ids start (one more at the end)."""
        start, end, first = words(data, offsets)
        distinct, which = gathered(data, start, end)
        spans = distinct.to_pylist()
        encoded = [self.chunks.get(c) for c in spans]
        unknown = [i for i, ids in enumerate(encoded) if ids is None]
        for i, ids in zip(unknown, self.encode_chunks([spans[i] for i in unknown]), strict=True):
            encoded[i] = self.chunks.keep(spans[i], ids)
        sizes = np.fromiter(map(len, encoded), np.int64, len(encoded)) // 4
        ids, ends = ragged(np.frombuffer(b"".join(encoded), "<u4"), (np.cumsum(sizes) - sizes)[which], sizes[which])
        return ids, ends[first]

    def decode(self, ids: np.ndarray, bounds: np.ndarray) -> list[bytes]:
        """The tokens' names joined by blanks, row by row, in UTF-8."""
        flat, ends = ragged(self.flat, self.starts[ids], self.sizes[ids])
        whole, at = flat.tobytes(), ends[bounds].tolist()
        return [whole[a : max(a, b - 1)] for a, b in itertools.pairwise(at)]


_encoders: dict[str, WordEncoder] = {}


def shared_encoder(text: str) -> WordEncoder:
    """One encoder for all tasks that a Python worker runs, so that its stored chunks stay warm."""
    key = hashlib.sha256(text.encode()).hexdigest()
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = WordEncoder(text)
    return _encoders[key]


def tokenize(documents: DataFrame, path: str, with_ids: bool = False) -> DataFrame:
    """Encodes every whole text by a tokenizer file of words with an end, and decodes the ids again.

    ``documents`` has doc_id and text.  Returns for each row: doc_id, n_tokens, ids_sha256 (of
    the ids as little-endian unsigned 32-bit integers), decoded_sha256 (of the tokens' names
    joined by blanks, as a tokenizer without a decoder gives them, in UTF-8), and with
    ``with_ids`` the ids.  Special tokens in a text are tokens; none is added.  A null or
    empty text has no ids.  Rows without doc_id and repeated rows are kept as they are; other
    columns are not looked at.  A text without any white space is one chunk and is not kept
    in memory beyond its batch; its fragments are merged in n log n steps.
    """
    with open(path, encoding="utf-8") as f:
        held = documents.sparkSession.sparkContext.broadcast(f.read())  # its size does not depend on the data

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = shared_encoder(held.value)
        for batch in slices(batches, "text"):
            data, offsets = text_bytes(batch.column("text"))
            ids, bounds = encoder.encode(data, offsets)
            packed = ids.astype("<u4").tobytes()
            columns = [
                batch.column("doc_id"),
                pa.array(np.diff(bounds)),
                pa.array([hashlib.sha256(packed[4 * a : 4 * b]).hexdigest() for a, b in itertools.pairwise(bounds.tolist())], pa.string()),
                pa.array([hashlib.sha256(d).hexdigest() for d in encoder.decode(ids, bounds)], pa.string()),
            ]
            if with_ids:
                columns.append(pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(ids.astype(np.int32))))
            yield pa.record_batch(columns, names)

    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", *["ids"] * with_ids]
    return documents.select("doc_id", "text").mapInArrow(encode, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids)
