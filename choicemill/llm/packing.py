"""Cost-balanced packing of tokenised documents into training sequences.

The cost of a document in a sequence is estimated as LINEAR * tokens + QUADRATIC * tokens squared, since
attention runs within a document. Documents go in descending order of length, hence of cost, each to the
sequence of lowest cost so far that has room for it. What fits nowhere whole is cut into the largest rooms.

Each task packs the rows it reads, a group of about GROUP tokens at a time, so nothing is shuffled, no
source or document is gathered anywhere, and a lost task is simply run again on the same rows. A group's
sequences have just as many places as it has tokens: full sequences, and for what is left over, sequences
whose lengths are the powers of two that make it up. So there is no padding at all.

Token ids are those of the given tokenizer. It drops white space, and no token spans it, so distinct
spans are encoded once and remembered; spans of plain Latin letters and ASCII signs skip the tokenizer's
normaliser, of which only lower case concerns them, and go to its merge model directly.

Defined cases: null or empty text is the end token alone; repeated rows are packed each; a null id is
carried through; texts of any length are cut into pieces; an empty table gives no row.
"""

from __future__ import annotations

import itertools
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from tokenizers import Tokenizer

from choicemill.llm.common import BLANK, LOWERED, SLICE_BYTES, bytes_of, slices, span_hashes

TOKENIZER = "word_bpe_49k.json"
END = 2
CAPACITY = 4096
LINEAR, QUADRATIC = 1.0, 1.0 / 2048
GROUP = 2048 * CAPACITY
CACHE = 200_000  # spans that a Python worker remembers, some 50 MB


def _byte_letters() -> dict[int, str]:
    """The printable stand-in of each byte: itself where it is printable, else the next from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = itertools.count(256)
    return {b: chr(b if b in plain else next(spare)) for b in range(256)}


_LETTERS = _byte_letters()
BLANK_KIND, LETTER, DIGIT, SIGN, OTHER = range(5)
_KIND = np.full(256, OTHER, np.uint8)
_KIND[33:127] = SIGN
_KIND[[39, 60]] = OTHER  # apostrophes may belong to contractions, "<" to special tokens
_KIND[48:58] = DIGIT
_KIND[97:123] = LETTER
_KIND[np.flatnonzero(BLANK)] = BLANK_KIND


class Parts:
    """The spans of a slice of texts that are encoded one by one.

    A word of ASCII signs, digits and letters and of the letters U+00C0 to U+00FF falls into runs of
    letters, single digits and runs of signs, in lower case. Any other word is one span as it stands.
    """

    def __init__(self, texts: pa.Array):
        raw, offs = bytes_of(texts)
        data = LOWERED[raw]
        lead = data == 0xC3
        trail = np.zeros(len(data), bool)
        trail[1:] = lead[:-1]
        data[trail & (data >= 0x80) & (data <= 0x9E) & (data != 0x97)] += 32
        kind = _KIND[data]
        kind[lead | (trail & (data != 0x97) & (data != 0xB7))] = LETTER
        inside = kind != BLANK_KIND
        first = np.ones(len(data) + 1, bool)
        first[1:-1] = ~inside[:-1]
        first[offs] = True
        word = np.flatnonzero(inside & first[:-1])
        if len(word):
            # Every byte of a word that holds an odd byte counts as odd.
            odd = np.add.reduceat((kind == OTHER).astype(np.int32), word) > 0
            last = np.cumsum(inside & first[:-1]) - 1
            whole = odd[np.maximum(last, 0)] & inside & (last >= 0)
            kind[whole] = OTHER
            data = np.where(whole, raw, data)
        change = np.ones(len(data), bool)
        change[1:] = kind[1:] != kind[:-1]
        begin = inside & (first[:-1] | change | (kind == DIGIT))
        ends = np.append(begin[1:] | ~inside[1:], True) | first[1:]
        self.data, self.kind = data, kind
        self.starts = np.flatnonzero(begin)
        self.ends = np.flatnonzero(inside & ends) + 1
        self.bounds = np.searchsorted(self.starts, offs)
        self.hashes = span_hashes(data[inside], self.ends - self.starts)


class Encoder:
    """Token ids of texts; remembers the ids of spans across slices and tasks of a Python worker."""

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.known: dict[int, bytes] = {}

    def span(self, text: bytes, plain: bool) -> bytes:
        if plain:
            ids = [t.id for t in self.model.tokenize(text.decode("latin-1").translate(_LETTERS))]
        else:
            ids = self.tokenizer.encode(text.decode(), add_special_tokens=False).ids
        return struct.pack(f"<{len(ids)}I", *ids)

    def texts(self, texts: pa.Array, end: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after the other, ``end`` after each, and the n + 1 bounds."""
        parts = Parts(texts)
        distinct, where, which = np.unique(parts.hashes, return_index=True, return_inverse=True)
        known = self.known
        if len(known) + len(distinct) > CACHE:
            known.clear()
        found = []
        for h, at in zip(distinct.tolist(), where.tolist(), strict=True):
            ids = known.get(h)
            if ids is None:
                s = parts.starts[at]
                ids = known[h] = self.span(parts.data[s: parts.ends[at]].tobytes(), parts.kind[s] != OTHER)
            found.append(ids)
        found.append(struct.pack("<I", end))
        flat = np.frombuffer(b"".join(found), "<u4")
        size = np.array([len(x) // 4 for x in found], np.int64)
        place = np.cumsum(size) - size
        which = np.insert(which, parts.bounds[1:], len(distinct))
        length = size[which]
        upto = np.cumsum(length)
        ids = flat[np.repeat(place[which] - (upto - length), length) + np.arange(int(upto[-1]) if len(upto) else 0)]
        bounds = np.append(0, upto[parts.bounds[1:] + np.arange(len(texts))])
        return ids, bounds


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def powers(n: int) -> list[int]:
    """The powers of two that make up n, largest first."""
    return [1 << b for b in range(n.bit_length() - 1, -1, -1) if n >> b & 1]


def pack(lengths: list[int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int]]:
    """(document, start, length, sequence, offset) for documents of the given token counts."""
    pieces = []
    rest = []  # (length, document, start)
    sequence = 0
    for doc, n in enumerate(lengths):
        for start in range(0, n - capacity + 1, capacity):
            pieces.append((doc, start, capacity, sequence, 0))
            sequence += 1
        if n % capacity:
            rest.append((n % capacity, doc, n - n % capacity))
    total = sum(n for n, _, _ in rest)
    room = np.array([capacity] * (total // capacity) + powers(total % capacity), np.int64)
    size = room.copy()
    cost = np.zeros(len(room))
    rest.sort(key=lambda x: (-x[0], x[1]))
    for n, doc, start in rest:
        while n:
            at = int(np.where(room >= n, cost, np.inf).argmin())
            if room[at] < n:
                at = int(room.argmax())
            part = min(n, int(room[at]))
            pieces.append((doc, start, part, sequence + at, int(size[at] - room[at])))
            room[at] -= part
            cost[at] += LINEAR * part + QUADRATIC * part * part
            n, start = n - part, start + part
    return pieces


def _packer(path: str, end: int, capacity: int, group: int, with_ids: bool):
    def emit(ids: list[bytes], keys: list[pa.Array], base: int) -> Iterator[pa.RecordBatch]:
        lengths = [len(x) // 4 for x in ids]
        pieces = pack(lengths, capacity)
        names = pa.chunked_array(keys).combine_chunks()
        for at in range(0, len(pieces), 10_000):
            some = pieces[at: at + 10_000]
            doc, start, length, sequence, offset = (np.array(x, np.int64) for x in zip(*some, strict=True))
            raw = [ids[d][4 * s: 4 * (s + n)] for d, s, n, _, _ in some]
            columns = [names.take(pa.array(doc)), pa.array(start), pa.array(length),
                       pa.array([zlib.crc32(x) for x in raw], pa.int64()), pa.array([lengths[d] for d in doc], pa.int64()),
                       pa.array(base + sequence), pa.array(offset)]
            labels = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
            if with_ids:
                columns.append(pa.array([np.frombuffer(x, "<u4").astype(np.int32) for x in raw], pa.list_(pa.int32())))
                labels.append("ids")
            yield pa.RecordBatch.from_arrays(columns, labels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path).texts
        base = TaskContext.get().partitionId() << 32
        ids: list[bytes] = []
        keys: list[pa.Array] = []
        held = 0
        for b in slices(batches, limit=2 * SLICE_BYTES):
            keys.append(b.column("doc_id"))
            flat, bounds = encode(b.column("text"), end)
            ids += [flat[s:e].tobytes() for s, e in itertools.pairwise(bounds.tolist())]
            held += len(flat)
            if held >= group:
                yield from emit(ids, keys, base)
                base += held + 1
                ids, keys, held = [], [], 0
        if ids:
            yield from emit(ids, keys, base)
    return run


def packed(docs: DataFrame, tokenizer: str | None = None, end: int = END, capacity: int = CAPACITY,
           group: int = GROUP, with_ids: bool = False) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset (and ids) per piece."""
    schema = ("doc_id {}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
              .format(docs.schema["doc_id"].dataType.simpleString()) + (", ids array<int>" if with_ids else ""))
    path = tokenizer or public_tokenizers.path(TOKENIZER)
    return docs.select("doc_id", "text").mapInArrow(_packer(path, end, capacity, group, with_ids), schema)


def op4_packing(spark, sf_dir):
    """All documents as pieces of sequences of up to 4096 tokens."""
    return packed(spark.read.parquet(f"{sf_dir}/documents.parquet"))
