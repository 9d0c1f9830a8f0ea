"""Ranked lexical search by Block-Max MaxScore over an inverted index in segments.

Index. Each task turns its documents into segments of about SEGMENT_BYTES of text, without a shuffle. A
segment holds, for every term, a posting list in blocks of POSTINGS: first and last document, the block's
highest impact, and the packed postings. A posting's impact is what a term of weight 1 adds to the score.
The highest impact of a list is its global bound in the segment.

Search. A task takes the lists of one segment that a block of items uses. For each item lists go by
falling bound. While the bounds that are left could still lift a new document to the kth score so far, lists
are essential: they bring in documents, and partial scores raise the kth score. From there on lists are
non-essential and only add to documents already met: a document is rejected by the bound of the block that
could hold it, before that block is unpacked. The kth score goes on from segment to segment within a task,
and the best of all tasks are merged. Bounds equal to the kth score are followed up, so results
are exact, ties included.

Items are dealt to blocks of ITEMS. Nothing is broadcast; no list leaves its segment.

Defined cases: null texts and texts without a term hold nothing and count nowhere; an item without a term,
or whose terms no document holds, gets no row; repeated documents are ranked each, and a null doc_id is
ranked after others of the same score; equal rows of one item are answered once, rows of one id with
different texts each; other columns are ignored.
"""

from __future__ import annotations

import string
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from choicemill.llm.common import Words, byte_class, flat_list, gathered, list_array, ranges, slices, stage

SEGMENT_BYTES = 8 << 20
POSTINGS = 128
ITEMS = 256
TOP = 10

# Terms are runs of ASCII letters, digits and all beyond ASCII.
BETWEEN = ~byte_class(string.ascii_letters + string.digits)
BETWEEN[128:] = False

INDEX = ("segment long, term string, n long, bound long, first array<int>, last array<int>, best array<int>, "
         "width array<int>, payload binary, ids array<long>, named array<boolean>, m array<long>")


# ---------------------------------------------------------------- packing

def widths(values: np.ndarray) -> np.ndarray:
    """Bytes (1, 2 or 4) that hold each value."""
    return np.where(values < 1 << 8, 1, np.where(values < 1 << 16, 2, 4))


def packed(values: np.ndarray, at: np.ndarray, width: np.ndarray, out: np.ndarray) -> None:
    """Write each value at its place in as many bytes as its block's width."""
    for w in (1, 2, 4):
        rows = np.flatnonzero(width == w)
        for j in range(w):
            out[at[rows] + j] = (values[rows] >> (8 * j)) & 255


def unpacked(data: np.ndarray, at: int, n: int, width: int) -> np.ndarray:
    return np.frombuffer(data, f"<u{width}", n, at).astype(np.int64)


def impacts(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    """What an occurrence count adds to the score at weight 1."""
    return (1_000_000_000 * tf) // (1_000 * tf + 8 * m)


def lengths_scaled(n: np.ndarray, documents: int, words: int) -> np.ndarray:
    """m of documents with n words: 25 + (75 n N) div L, exactly."""
    if len(n) and int(n.max()) * 75 * documents >= 1 << 62:
        return np.array([25 + (75 * int(x) * documents) // words for x in n], np.int64)
    return 25 + (75 * n * documents) // max(1, words)


# ---------------------------------------------------------------- index

def _terms(texts: pa.Array) -> tuple[Words, pa.Array]:
    words = Words(texts, lower=True, blank=BETWEEN)
    offsets = np.append(0, np.cumsum(words.ends - words.starts))
    column = pa.LargeStringArray.from_buffers(len(words), pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(words.inside)))
    return words, column


def _sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    documents = total = 0
    for b in slices(batches):
        n = np.diff(Words(b.column("text"), lower=True, blank=BETWEEN).bounds)
        documents, total = documents + int((n > 0).sum()), total + int(n.sum())
    yield pa.RecordBatch.from_arrays([pa.array([documents]), pa.array([total])], ["documents", "words"])


def segment_of(batch: pa.RecordBatch, number: int, documents: int, words: int) -> Iterator[pa.RecordBatch]:
    """Index rows of one segment: one for each term, and one without a term that describes the documents."""
    found, terms = _terms(batch.column("text"))
    if not len(found):
        return
    coded = terms.dictionary_encode()
    n_docs = batch.num_rows
    key, tf = np.unique(coded.indices.to_numpy().astype(np.int64) * n_docs + found.owner, return_counts=True)
    term, doc = key // n_docs, key % n_docs
    m = lengths_scaled(np.diff(found.bounds).astype(np.int64), documents, words)
    impact = impacts(tf, m[doc])

    # Blocks: up to POSTINGS postings of one term.
    begin = np.flatnonzero(np.append(True, term[1:] != term[:-1]))
    size = np.diff(np.append(begin, len(term)))
    blocks = -(-size // POSTINGS)
    block = begin.repeat(blocks) + ranges(np.zeros(len(blocks), np.int64), blocks) * POSTINGS
    stop = np.append(block[1:], len(term))
    count = stop - block
    step = np.append(0, np.diff(doc))
    step[block] = 0  # the first document is kept with the block
    wide_step, wide_tf = widths(np.maximum.reduceat(step, block)), widths(np.maximum.reduceat(tf, block))
    at = np.append(0, np.cumsum(count * (wide_step + wide_tf)))
    out = np.zeros(at[-1], np.uint8)
    place = np.arange(len(term)) - block.repeat(count)
    packed(step, at[:-1].repeat(count) + place * wide_step.repeat(count), wide_step.repeat(count), out)
    packed(tf, (at[:-1] + count * wide_step).repeat(count) + place * wide_tf.repeat(count), wide_tf.repeat(count), out)

    t = len(begin)
    bounds = np.append(0, np.cumsum(blocks))
    payload = pa.LargeBinaryArray.from_buffers(pa.large_binary(), t, [None, pa.py_buffer(at[bounds]), pa.py_buffer(out)])
    best = np.maximum.reduceat(impact, block)

    def lists(values):
        return list_array(values.astype(np.int32), blocks, pa.int32())

    rows = pa.table({
        "segment": pa.array(np.full(t, number)), "term": coded.dictionary.take(pa.array(term[begin])).cast(pa.string()),
        "n": pa.array(size.astype(np.int64)), "bound": pa.array(np.maximum.reduceat(impact, begin)), "first": lists(doc[block]),
        "last": lists(doc[stop - 1]), "best": lists(best), "width": lists(wide_step * 16 + wide_tf), "payload": payload.cast(pa.binary()),
        "ids": pa.nulls(t, pa.list_(pa.int64())), "named": pa.nulls(t, pa.list_(pa.bool_())), "m": pa.nulls(t, pa.list_(pa.int64()))})
    yield from rows.to_batches(max_chunksize=20_000)
    ids = batch.column("doc_id")
    nothing = {c: pa.nulls(1, rows.schema.field(c).type) for c in rows.column_names}
    yield pa.RecordBatch.from_pydict({
        **nothing, "segment": pa.array([number], pa.int64()), "ids": pa.array([ids.fill_null(0).to_pylist()], pa.list_(pa.int64())),
        "named": pa.array([ids.is_valid().to_pylist()], pa.list_(pa.bool_())), "m": pa.array([m.tolist()], pa.list_(pa.int64()))},
        schema=rows.schema)


def _segments(documents: int, words: int, limit: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for whole in gathered(batches, "text", limit):
            for b in slices([whole], limit=limit):
                yield from segment_of(b, number, documents, words)
                number += 1
    return run


def build_index(docs: DataFrame, limit: int = SEGMENT_BYTES) -> tuple[DataFrame, int]:
    """The written index of ``docs`` (doc_id, text), and its number of documents."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where(F.col("text").isNotNull())
    size = rows.select("text").mapInArrow(_sizes, "documents long, words long").agg(
        F.sum("documents"), F.sum("words")).first()
    documents, words = size[0] or 0, size[1] or 0
    return stage(rows.mapInArrow(_segments(documents, words, limit), INDEX)), documents


# ---------------------------------------------------------------- search

class Lists:
    """The posting lists of one segment that a block of items uses."""

    def __init__(self, rows: pa.Table):
        described = rows.filter(rows.column("term").is_null())
        self.ids, self.named, self.m = (described.column(c).combine_chunks().flatten().to_numpy(zero_copy_only=False)
                                        for c in ("ids", "named", "m"))
        rows = rows.filter(rows.column("term").is_valid())
        self.bound = rows.column("bound").to_numpy()
        self.payload = rows.column("payload").to_pylist()
        self.n = rows.column("n").to_numpy()
        parts = {}
        for c in ("first", "last", "best", "width"):
            values, counts = flat_list(rows.column(c).combine_chunks())
            parts[c] = np.split(values.astype(np.int64), np.cumsum(counts)[:-1])
        self.first, self.last, self.best = parts["first"], parts["last"], parts["best"]
        self.wide = parts["width"]
        self.held: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}
        self.at = {}
        self.unpacked = 0  # blocks read so far
        self.items: dict[int, list[tuple[int, int]]] = {}
        for i, uses in enumerate(rows.column("uses").to_pylist()):
            for use in uses:
                self.items.setdefault(use["q"], []).append((use["weight"], i))

    def block(self, i: int, b: int) -> tuple[np.ndarray, np.ndarray]:
        """Documents and impacts of a block, unpacked once."""
        if (i, b) not in self.held:
            if i not in self.at:
                count = np.full(len(self.first[i]), POSTINGS)
                count[-1] = self.n[i] - POSTINGS * (len(count) - 1)
                step, tf = self.wide[i] // 16, self.wide[i] % 16
                self.at[i] = count, step, tf, np.cumsum(count * (step + tf)) - count * (step + tf)
            count, step, tf, at = (x[b] for x in self.at[i])
            data = self.payload[i]
            docs = self.first[i][b] + np.cumsum(unpacked(data, at, count, step))
            self.held[i, b] = docs, impacts(unpacked(data, at + count * step, count, tf), self.m[docs])
            self.unpacked += 1
        return self.held[i, b]

    def best_of(self, terms: list[tuple[int, int]], kth: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Documents (numbers in the segment) whose score may be among the best, and their scores."""
        terms = sorted(terms, key=lambda t: -t[0] * int(self.bound[t[1]]))
        bounds = np.array([w * int(self.bound[i]) for w, i in terms], np.int64)
        rest = np.append(np.cumsum(bounds[::-1])[::-1], 0)  # what this list and all after it can add
        least = max(kth, 1)
        score = np.zeros(len(self.ids), np.int64)
        at = 0
        while at < len(terms) and rest[at] >= least:  # essential: may bring in a document
            weight, i = terms[at]
            met = np.flatnonzero(score + rest[at] >= least) if at else np.zeros(0, np.int64)
            met = met[score[met] > 0]
            first, last = self.first[i], self.last[i]
            use = weight * self.best[i] + rest[at + 1] >= least
            use |= np.searchsorted(met, first) < np.searchsorted(met, last, side="right")
            for b in np.flatnonzero(use):
                docs, impact = self.block(i, b)
                score[docs] += weight * impact
            at += 1
            if len(score) >= k:
                least = max(least, int(np.partition(score, len(score) - k)[len(score) - k]))
        docs = np.flatnonzero((score > 0) & (score + rest[at] >= least))
        for j in range(at, len(terms)):  # non-essential: adds to documents already met
            if not len(docs):
                break
            weight, i = terms[j]
            b = np.searchsorted(self.first[i], docs, side="right") - 1
            inside = (b >= 0) & (docs <= self.last[i][b])
            reach = score[docs] + np.where(inside, weight * self.best[i][b], 0) + rest[j + 1]
            docs, b, inside = (x[reach >= least] for x in (docs, b, inside))
            for one in np.unique(b[inside]):
                held, impact = self.block(i, one)
                wanted = docs[inside & (b == one)]
                place = np.minimum(np.searchsorted(held, wanted), len(held) - 1)
                hit = held[place] == wanted
                score[wanted[hit]] += weight * impact[place[hit]]
        docs = docs[score[docs] >= least]
        return docs, score[docs]


class Heap:
    """The best k documents of one item so far."""

    def __init__(self):
        self.score, self.null, self.id = np.zeros(0, np.int64), np.zeros(0, bool), np.zeros(0, np.int64)

    def kth(self, k: int) -> int:
        return int(self.score[k - 1]) if len(self.score) >= k else 0

    def add(self, score: np.ndarray, null: np.ndarray, ids: np.ndarray, k: int) -> None:
        score, null, ids = np.append(self.score, score), np.append(self.null, null), np.append(self.id, ids)
        pick = np.lexsort((ids, null, -score))[:k]
        self.score, self.null, self.id = score[pick], null[pick], ids[pick]


def _search(k: int):
    def listed(heaps: dict[int, Heap]) -> pa.RecordBatch:
        size = [len(h.score) for h in heaps.values()]
        joined = [np.concatenate([getattr(h, c) for h in heaps.values()]) if heaps else np.zeros(0, t)
                  for c, t in (("id", np.int64), ("null", bool), ("score", np.int64))]
        return pa.RecordBatch.from_arrays(
            [pa.array(np.repeat(np.array(list(heaps), np.int64), size)), pa.array(joined[0], mask=joined[1]), pa.array(joined[2])],
            ["q", "doc_id", "score"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by block, then segment; heaps are held for one block at a time."""
        held: list[pa.RecordBatch] = []
        heaps: dict[int, Heap] = {}
        last = None

        def visit() -> None:
            lists = Lists(pa.Table.from_batches(held))
            for q, terms in lists.items.items():
                heap = heaps.setdefault(q, Heap())
                docs, score = lists.best_of(terms, heap.kth(k), k)
                heap.add(score, ~lists.named[docs].astype(bool), lists.ids[docs].astype(np.int64), k)

        for b in batches:
            if not b.num_rows:
                continue
            block, segment = (b.column(c).to_numpy() for c in ("block", "segment"))
            cuts = np.flatnonzero((block[1:] != block[:-1]) | (segment[1:] != segment[:-1])) + 1
            for s, e in zip([0, *cuts], [*cuts, b.num_rows], strict=True):
                if last is not None and last != (block[s], segment[s]):
                    visit()
                    held = []
                    if last[0] != block[s]:
                        yield listed(heaps)
                        heaps.clear()
                held.append(b.slice(s, e - s))
                last = (block[s], segment[s])
        if held:
            visit()
        yield listed(heaps)
    return run


def _asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in slices(batches):
        words, terms = _terms(b.column("text"))
        yield pa.RecordBatch.from_arrays([b.column("q").take(pa.array(words.owner)), terms.cast(pa.string())], ["q", "term"])


def top_documents(docs: DataFrame, items: DataFrame, k: int = TOP, limit: int = SEGMENT_BYTES, block: int = ITEMS) -> DataFrame:
    """item_id, rank, doc_id, score: the k best of ``docs`` (doc_id, text) for each of ``items`` (item_id, text)."""
    index, documents = build_index(docs, limit)
    asked = stage(items.select("item_id", "text").where(F.col("text").isNotNull()).distinct()
                  .withColumn("q", F.monotonically_increasing_id()))
    terms = stage(asked.select("q", "text").mapInArrow(_asked, "q long, term string").groupBy("q", "term").agg(F.count("*").alias("times")))
    held = index.join(terms.select("term").distinct(), "term", "left_semi").groupBy("term").agg(F.sum("n").alias("df"))
    weight = F.floor(1000.0 * F.log(F.lit(2.0 * documents + 2.0) / (2 * F.col("df") + 1))).cast("long")
    blocks = max(1, -(-asked.count() // block))
    uses = terms.join(held, "term").select(
        F.pmod(F.xxhash64("q"), F.lit(blocks)).cast("int").alias("block"), "term",
        F.struct("q", (F.col("times") * weight).alias("weight")).alias("use"))
    used = stage(uses.groupBy("block", "term").agg(F.collect_list("use").alias("uses")))
    lists = index.where(F.col("term").isNotNull()).join(used, "term")
    described = (index.where(F.col("term").isNull())
                 .withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
                 .withColumn("uses", F.lit(None).cast(used.schema["uses"].dataType)))
    met = lists.unionByName(described).repartition("block", "segment").sortWithinPartitions("block", "segment")
    found = met.mapInArrow(_search(k), "q long, doc_id long, score long")
    order = Window.partitionBy("q").orderBy(F.desc("score"), F.col("doc_id").isNull(), "doc_id")
    best = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return best.join(asked.select("q", "item_id"), "q").select("item_id", "rank", "doc_id", "score")


def op12_lexical_search(spark, sf_dir):
    """The ten best of all documents for each benchmark item."""
    return top_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


ORACLE = r"""
WITH d AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
               '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents),
q AS (SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
               '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
t AS (SELECT doc_id, term, count(*)::BIGINT AS tf FROM d GROUP BY ALL),
l AS (SELECT doc_id, count(*)::BIGINT AS n FROM d GROUP BY ALL),
c AS (SELECT count(*)::BIGINT AS docs, sum(n)::BIGINT AS words FROM l),
m AS (SELECT doc_id, 100 - 75 + ((75 * n * docs) // words) AS m FROM l, c),
f AS (SELECT term, floor(1000 * ln((2 * docs + 2) / (2 * count(*) + 1)))::BIGINT AS w FROM t, c GROUP BY term, docs),
u AS (SELECT item_id, term, count(*)::BIGINT AS times FROM q GROUP BY ALL),
s AS (SELECT item_id, doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * m)))::BIGINT AS score
      FROM u JOIN t USING (term) JOIN f USING (term) JOIN m USING (doc_id) GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank FROM s WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM r WHERE rank <= 10
"""
