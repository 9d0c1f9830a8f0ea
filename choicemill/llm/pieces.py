"""SentencePiece encoding and decoding: the N best segmentations of a text over its piece lattice.

A text's blanks become U+2581, and one is put in front. No piece holds a U+2581 after another character,
so the lattice falls apart into chunks there. Equal chunks are segmented once and remembered:

* Forward Viterbi gives the best score of every prefix, by array steps over many chunks at once.
* For the N best, A* search walks backward from the end of a chunk. The forward scores are the exact best
  completions, so paths leave the agenda in order of their total score.
* A text's N best differ from its best in few chunks: only the N - 1 chunks with the smallest loss
  of their second best can take part, and A* runs for those alone. Their lists are then merged.

Each of the N best comes with its ids: those of the best, with the ids of other segmentations in the place of
single chunks.

A character without a piece is covered by the pieces of its UTF-8 bytes, at a score below all others. For the
best, ties go to the segmentation whose pieces are longer from the end on; the others follow in a fixed order.

Defined cases: null or empty text has no pieces and one empty segmentation of score 0; repeated rows
are encoded each; texts of any length are encoded whole.
"""

from __future__ import annotations

import heapq
import itertools
import zlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql.types import StringType, StructField, StructType

from choicemill.llm.common import flat_list, list_array, mixed, slices, stream
from choicemill.llm.language_id import _table

MODEL = "piece_bpe_32k.model"
BEST = 4
BLANK = "▁"
CACHE = 500_000  # chunks that a Python worker remembers
CELLS = 1 << 18  # characters that one array step holds; a longer chunk forms a step alone
SLOT_BITS = 18


def offsets(lengths) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(lengths, dtype=np.int64)])


def spread(offs: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Flat places of the lists number ``at``, one after the other, and the offsets of their result."""
    starts, lengths = offs[at], offs[at + 1] - offs[at]
    ends = offsets(lengths)
    return np.repeat(starts - ends[:-1], lengths) + np.arange(ends[-1]), ends


class Vocabulary:
    """Pieces with scores; read from the model once a Python worker."""

    def __init__(self, path: str):
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        self.bytes = {int(model.id_to_piece(i)[3:5], 16): i for i in range(n) if model.is_byte(i)}
        self.text = [model.id_to_piece(i) for i in range(n)]
        self.raw = [bytes([int(t[3:5], 16)]) if model.is_byte(i) else t.encode() for i, t in enumerate(self.text)]
        plain = [i for i in range(n) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
        self.score_of = {self.text[i]: (float(model.get_score(i)), i) for i in plain}
        if any(BLANK in self.text[i].lstrip(BLANK) for i in plain):
            raise ValueError("a piece holds a blank after its first character: texts cannot be cut at blanks")
        self.most = max(len(self.text[i]) for i in plain)
        self.floor = min(s for s, _ in self.score_of.values()) - 10
        self.factors = stream(self.most, 15)
        table = _table("random")
        prints = []
        for i in plain:
            points = np.frombuffer(self.text[i].encode("utf-32-le"), np.uint32)
            prints.append((table[points] * self.factors[: len(points)]).sum(dtype=np.uint64))
        prints = mixed(np.array(prints, np.uint64))
        order = np.argsort(prints)
        self.prints = prints[order]
        self.scores = np.array([self.score_of[self.text[i]][0] for i in plain])[order]
        self.ids = np.array([self.score_of[self.text[i]][1] for i in plain], np.int32)[order]
        self.slots = np.searchsorted(self.prints >> np.uint64(64 - SLOT_BITS), np.arange((1 << SLOT_BITS) + 1, dtype=np.uint64))
        self.byte_ids = np.array([self.bytes.get(b, 0) for b in range(256)], np.int32)
        self.raw_data = np.frombuffer(b"".join(self.raw), np.uint8)
        self.raw_offs = offsets([len(r) for r in self.raw])
        self.forget()

    def forget(self) -> None:
        """Empty the memory of chunks: their number, best score, loss of the second best, ids of the best."""
        self.found: dict[str, int] = {}
        self.lists: dict[tuple[str, int], list[tuple[float, bytes]]] = {}
        self.best, self.loss = np.zeros(0), np.zeros(0)
        self.flat, self.offs = np.zeros(0, np.int32), np.zeros(1, np.int64)

    def learn(self, texts: list[str]) -> None:
        """Segment chunks that are not known yet."""
        if not texts:
            return
        best, loss, flat, counts = segment(texts, self)
        self.found.update(zip(texts, range(len(self.best), len(self.best) + len(texts)), strict=True))
        self.best, self.loss = np.append(self.best, best), np.append(self.loss, loss)
        self.flat = np.append(self.flat, flat)
        self.offs = np.append(self.offs, self.offs[-1] + np.cumsum(counts))

    def find(self, prints: np.ndarray) -> np.ndarray:
        """Place of each fingerprint among the pieces, or -1."""
        slot = (prints >> np.uint64(64 - SLOT_BITS)).astype(np.int64)
        at, end = self.slots[slot], self.slots[slot + 1]
        out = np.full(len(prints), -1, np.int64)
        live = np.flatnonzero(at < end)
        while len(live):
            hit = self.prints[at[live]] == prints[live]
            out[live[hit]] = at[live[hit]]
            live = live[~hit]
            at[live] += 1
            live = live[at[live] < end[live]]
        return out

    def byte_edge(self, char: str) -> tuple[float, list[int]]:
        return self.floor * len(char.encode()), [self.bytes.get(b, 0) for b in char.encode()]


_known: dict[str, Vocabulary] = {}


def vocabulary(path: str) -> Vocabulary:
    if path not in _known:
        _known[path] = Vocabulary(path)
    return _known[path]


def chunks(text: str) -> list[str]:
    """Pieces of the escaped text that no piece crosses: each begins with blanks, but for the rest."""
    if not text:
        return []
    escaped = BLANK + text.replace(" ", BLANK)
    out = escaped.replace(BLANK, "\0" + BLANK) if "\0" not in escaped else None
    if out is None:
        cut = [0] + [i for i in range(1, len(escaped)) if escaped[i] == BLANK and escaped[i - 1] != BLANK] + [len(escaped)]
        return [escaped[s:e] for s, e in itertools.pairwise(cut)]
    parts = out.split("\0")[1:]
    if "" not in text.split(" "):
        return parts
    joined, blanks = [], ""
    for part in parts:
        blanks += part
        if part != BLANK:
            joined.append(blanks)
            blanks = ""
    return joined + ([blanks] if blanks else [])


def lattice_scores(texts: list[str], v: Vocabulary):
    """Forward scores [chunk, place], edge scores and pieces [chunk, start, length - 1], lengths, characters.

    A piece is given by its place in the vocabulary's tables; -1 stands for none or for bytes.
    """
    size = np.array([len(t) for t in texts])
    width, n = int(size.max()), len(texts)
    points = np.zeros((n, width), np.uint32)
    points[np.arange(width) < size[:, None]] = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    number = _table("random")[points]
    prints = np.zeros((n, width), np.uint64)
    edges = np.full((n, width, v.most), -np.inf)
    pieces = np.full((n, width, v.most), -1, np.int32)
    for length in range(1, min(v.most, width) + 1):
        span = width - length + 1
        prints[:, :span] += number[:, length - 1:] * v.factors[length - 1]
        row, start = np.nonzero(np.arange(span) <= (size - length)[:, None])
        at = v.find(mixed(prints[row, start]))
        if length == 1:
            bare = at < 0
            edges[row[bare], start[bare], 0] = v.floor * utf8_size(points[row[bare], start[bare]])
        hit = np.flatnonzero(at >= 0)
        edges[row[hit], start[hit], length - 1] = v.scores[at[hit]]
        pieces[row[hit], start[hit], length - 1] = at[hit]
    forward = np.full((n, width + v.most + 1), -np.inf)
    forward[:, 0] = 0
    for start in range(width):
        ahead = forward[:, start + 1: start + 1 + v.most]
        np.maximum(ahead, forward[:, start, None] + edges[:, start], out=ahead)
    return forward[:, : width + 1], edges, pieces, size, points


def utf8_size(points: np.ndarray) -> np.ndarray:
    return 1 + (points >= 0x80).astype(np.int64) + (points >= 0x800) + (points >= 0x10000)


def second_losses(forward, edges, size) -> np.ndarray:
    """How much the second best segmentation of each chunk scores below its best.

    Every other path leaves the best one by some edge; the best path through an edge is the forward
    score, the edge and the backward score.
    """
    n, width, most = edges.shape
    backward = np.full((n, width + 1), -np.inf)
    backward[np.arange(n), size] = 0
    best = forward[np.arange(n), size]
    second = np.full(n, np.inf)
    through = []
    for start in range(width - 1, -1, -1):
        reach = min(most, width - start)
        on = edges[:, start, :reach] + backward[:, start + 1: start + reach + 1]
        backward[:, start] = np.where(start < size, on.max(axis=1), backward[:, start])
        through.append(on)
    taken = np.zeros(n, np.int64)
    for start in range(width):
        # The best path goes on from here only where it has come to.
        loss = best[:, None] - (forward[:, start, None] + through[width - 1 - start])
        here = np.flatnonzero((taken == start) & (start < size))
        choice = loss[here].argmin(axis=1)
        loss[here, choice] = np.inf
        taken[here] += choice + 1
        second = np.minimum(second, loss.min(axis=1))
    return second


def n_best(text: str, forward: np.ndarray, edges: np.ndarray, n: int) -> list[tuple[float, tuple[int, ...]]]:
    """(score, cut points) of the n best segmentations of one chunk, by backward A*."""
    most = edges.shape[1]
    nodes: list[tuple[int, int]] = [(len(text), -1)]  # place and the node behind it
    agenda = [(-forward[len(text)], len(text), 0, 0.0)]
    # The best totals of different paths met so far: what falls below n of them is never looked at again.
    totals = [forward[len(text)]]
    out = []
    while agenda and len(out) < n:
        bound, end, node, behind = heapq.heappop(agenda)
        if end == 0:
            cut = []
            while node >= 0:
                place, node = nodes[node]
                cut.append(place)
            out.append((-bound, tuple(cut)))
            continue
        steps = []
        for length in range(1, min(most, end) + 1):
            score = edges[end - length, length - 1]
            if score > -np.inf:
                steps.append((forward[end - length] + score + behind, end - length, behind + score))
        steps.sort(reverse=True)  # the first goes on with the path that was taken from the agenda
        for i, (total, place, score) in enumerate(steps):
            if i and len(totals) < n:
                heapq.heappush(totals, total)
            elif i and total > totals[0]:
                heapq.heapreplace(totals, total)
            elif i:
                break
            heapq.heappush(agenda, (-total, place, len(nodes), score))
            nodes.append((place, node))
    return out


def alike(texts: list[str]) -> Iterator[list[int]]:
    """Numbers of chunks of nearly equal length, a block at a time."""
    size = np.array([len(t) for t in texts], np.int64)
    order = np.argsort(size, kind="stable")
    size = size[order]
    at = 0
    while at < len(order):
        most = int(size[at] + size[at] // 8)
        to = min(int(np.searchsorted(size, most, side="right")), at + max(1, CELLS // most))
        yield order[at:to].tolist()
        at = to


def segment(texts: list[str], v: Vocabulary) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For each chunk: best score, loss of the second best; the ids of all best, one after the other; their number."""
    best, loss = np.zeros(len(texts)), np.zeros(len(texts))
    counts = np.zeros(len(texts), np.int64)
    found, order = [], []
    for some in alike(texts):
        forward, edges, pieces, size, points = lattice_scores([texts[i] for i in some], v)
        loss[some] = second_losses(forward, edges, size)
        best[some] = forward[np.arange(len(some)), size]
        flat, counts[some] = best_ids(best_cuts(forward, edges, size), pieces, size, points, v)
        found.append(flat)
        order += some
    place = np.empty(len(texts), np.int64)
    place[order] = np.arange(len(texts))
    at, _ = spread(offsets(counts[order]), place)
    return best, loss, np.concatenate(found)[at], counts


def best_ids(cut, pieces, size, points, v: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """The ids of the best segmentations, chunk after chunk, and their number in each."""
    taken = np.full(points.shape, -2, np.int64)
    end = size.copy()
    while len(live := np.flatnonzero(end)):
        start = cut[live, end[live]]
        taken[live, start] = pieces[live, start, end[live] - start - 1]
        end[live] = start
    on = taken != -2
    at, chars = taken[on], points[on]
    ids = v.ids[at]
    times = np.where(at >= 0, 1, utf8_size(chars))
    counts = np.bincount(np.nonzero(on)[0], weights=times, minlength=len(size)).astype(np.int64)
    if (at < 0).any():
        bare = np.repeat(at < 0, times)
        ids = np.repeat(ids, times)
        raw = chars[at < 0].astype("<u4").tobytes().decode("utf-32-le").encode()
        ids[bare] = v.byte_ids[np.frombuffer(raw, np.uint8)]
    return ids, counts


def ids_of(text: str, path: tuple[int, ...], v: Vocabulary) -> bytes:
    """The ids of a segmentation given by its cut points, four bytes each."""
    out: list[int] = []
    for s, e in itertools.pairwise(path):
        piece = v.score_of.get(text[s:e])
        out += [piece[1]] if piece else v.byte_edge(text[s:e])[1]
    return np.array(out, "<u4").tobytes()


def several(texts: set[str], v: Vocabulary, n: int) -> Iterator[tuple[tuple[str, int], list[tuple[float, bytes]]]]:
    """The n best segmentations of each known chunk: how far each scores below the best, and its ids."""
    names = sorted(texts)
    for some in alike(names):
        forward, edges, *_ = lattice_scores([names[i] for i in some], v)
        for k, i in enumerate(some):
            at = v.found[names[i]]
            best = v.flat[v.offs[at]: v.offs[at + 1]].astype("<u4").tobytes()
            found = n_best(names[i], forward[k], edges[k], n)
            # Among equals the search may come to another one first.
            rest = [(max(found[0][0] - s, 0.0), ids) for s, path in found if (ids := ids_of(names[i], path, v)) != best]
            yield (names[i], n), [(0.0, best), *rest[: n - 1]]


def best_cuts(forward, edges, size) -> np.ndarray:
    """For each place, the start of the best piece that ends there, the longest of equals."""
    n, width, most = edges.shape
    cut = np.zeros((n, width + 1), np.int64)
    for end in range(1, width + 1):
        lengths = range(min(most, end), 0, -1)
        score = np.stack([forward[:, end - m] + edges[:, end - m, m - 1] for m in lengths], axis=1)
        cut[:, end] = end - np.array(lengths)[np.argmax(score, axis=1)]
    return cut


def merged(lists: list[list[tuple[float, bytes]]], n: int) -> list[tuple[float, tuple[int, ...]]]:
    """The n least losses in total, each with the number of the entry that every list gives to it."""
    out: list[tuple[float, tuple[int, ...]]] = [(0.0, ())]
    for entries in lists:
        out = sorted((a + loss, (*taken, k)) for a, taken in out for k, (loss, _) in enumerate(entries))[:n]
    return out


def replaced(raw: bytes, spans: list[tuple[int, int]], parts: list[bytes]) -> bytes:
    """``raw`` with other bytes in the place of ascending spans."""
    out, at = [], 0
    for (s, e), part in zip(spans, parts, strict=True):
        out += [raw[at:s], part]
        at = e
    return b"".join([*out, raw[at:]])


def least_losses(loss: np.ndarray, n: int) -> list[int]:
    """Places of the n smallest."""
    if n < 1:
        return []
    return np.sort(np.argpartition(loss, n - 1)[:n]).tolist() if len(loss) > n else list(range(len(loss)))


def segmentations(texts: list[str], v: Vocabulary, n: int) -> Iterator[list[tuple[float, bytes]]]:
    """For each text the scores and ids of its n best segmentations, the best first."""
    parts = [chunks(t) for t in texts]
    every = list(itertools.chain.from_iterable(parts))
    distinct = dict.fromkeys(every)
    new = [c for c in distinct if c not in v.found]
    if len(v.found) + len(new) > CACHE:
        v.forget()
        new = list(distinct)
    v.learn(new)
    at = np.fromiter(map(v.found.__getitem__, every), np.int64, len(every))
    rows = list(itertools.pairwise(offsets([len(p) for p in parts]).tolist()))
    losses, bests = v.loss[at], v.best[at]
    least = [least_losses(losses[s:e], n - 1) for s, e in rows]
    wanted = {p[i] for p, few in zip(parts, least, strict=True) for i in few}
    v.lists.update(several({c for c in wanted if (c, n) not in v.lists}, v, n))
    places, ends = spread(v.offs, at)
    ids, ends = v.flat[places].astype("<u4").tobytes(), 4 * ends
    for p, few, (s, e) in zip(parts, least, rows, strict=True):
        begin, best = int(ends[s]), float(bests[s:e].sum())
        raw = ids[begin: int(ends[e])]
        lists = [v.lists[p[i], n] for i in few]
        out = []
        for loss, taken in merged(lists, n):
            other = [(i, entries[k][1]) for i, entries, k in zip(few, lists, taken, strict=True) if k]
            spans = [(int(ends[s + i]) - begin, int(ends[s + i + 1]) - begin) for i, _ in other]
            out.append((best - loss, replaced(raw, spans, [x for _, x in other]) if other else raw))
        yield out


def _encode(path: str, n: int, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(path)
        for b in slices(batches):
            texts = [t or "" for t in b.column("text").to_pylist()]
            found = list(segmentations(texts, v, n))
            number = np.array([len(f) for f in found])
            first = offsets(number)
            raws = [raw for f in found for _, raw in f]
            ids = np.frombuffer(b"".join(raws), "<u4")
            ends = offsets([len(raw) // 4 for raw in raws])
            sizes = np.diff(ends)
            crcs = np.array([zlib.crc32(raw) for raw in raws], np.int64)
            wanted = itertools.chain.from_iterable(itertools.repeat(t, k) for t, k in zip(texts, number.tolist(), strict=True))
            same = np.array([t == d for t, d in zip(wanted, decoded(ids, ends, v), strict=True)], bool)
            scores = np.array([score for f in found for score, _ in f])
            columns = {
                "doc_id": b.column("doc_id"), "n_pieces": pa.array(sizes[first[:-1]]), "ids_crc32": pa.array(crcs[first[:-1]]),
                "best_scores": list_array(scores, number, pa.float64()), "round_trip": pa.array(same[first[:-1]]),
                "nth_pieces": list_array(sizes, number, pa.int64()), "nth_crc32": list_array(crcs, number, pa.int64()),
                "nth_round_trip": list_array(same, number, pa.bool_())}
            if with_ids:
                each = pa.StructArray.from_arrays(
                    [pa.array(scores), list_array(ids.astype(np.int32), sizes, pa.int32())], ["score", "ids"])
                columns["segmentations"] = pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), each)
            yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))
    return run


def decoded(ids: np.ndarray, ends: np.ndarray, v: Vocabulary) -> list[str]:
    """The texts of sequences of ids that follow each other, text i from ends[i] to ends[i + 1]."""
    places, at = spread(v.raw_offs, ids.astype(np.int64))
    raw = v.raw_data[places].tobytes()
    return [raw[s:e].decode("utf-8", "replace").replace(BLANK, " ")[1:] for s, e in itertools.pairwise(at[ends].tolist())]


def encoded(docs: DataFrame, model: str | None = None, n: int = BEST, ids: bool = True) -> DataFrame:
    """doc_id, n_pieces and ids_crc32 of the best segmentation, the n best scores, and whether decoding the best
    gives the text again (a U+2581 of the text itself comes back as a blank); nth_pieces, nth_crc32 and
    nth_round_trip have the same for each of the n best, and on demand segmentations their scores and ids."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(
        _encode(model or public_tokenizers.path(MODEL), n, ids),
        f"doc_id {kind}, n_pieces long, ids_crc32 long, best_scores array<double>, round_trip boolean, "
        "nth_pieces array<long>, nth_crc32 array<long>, nth_round_trip array<boolean>"
        + (", segmentations array<struct<score: double, ids: array<int>>>" if ids else ""))


def _decode(path: str, column: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(path)
        for b in slices(batches, column):
            ids, counts = flat_list(b.column(column))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(decoded(ids, offsets(counts), v), pa.string())],
                                             [*b.schema.names, "text"])
    return run


def decode(frame: DataFrame, column: str = "ids", model: str | None = None) -> DataFrame:
    """The columns of ``frame`` and the text of its lists of ids (null or empty: empty text)."""
    return frame.mapInArrow(_decode(model or public_tokenizers.path(MODEL), column),
                            StructType([*frame.schema.fields, StructField("text", StringType())]))


def op6_sentencepiece_nbest(spark, sf_dir):
    """The four best segmentations of every document: scores, number of pieces, digest of the ids, round trip."""
    return encoded(spark.read.parquet(f"{sf_dir}/documents.parquet"), ids=False)
