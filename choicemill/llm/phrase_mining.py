"""Collocations by prefix-free parsing: phrases are counted inside distinct chunks, weighted.

1. Every piece of text between punctuation marks is cut into chunks at windows of LONGEST - 1 words whose
   fingerprint is divisible by DIVISOR. The content alone decides, so what repeats across documents is cut
   alike, and copies fall on the same chunks. Neighbouring chunks overlap by one window, and a piece ends
   in a chunk marked ``last``.
2. The distinct chunks of each language with their frequencies are the dictionary. It is written once; the
   texts are not read again.
3. n-grams are counted inside dictionary chunks, times the frequency. An n-gram belongs to the chunk in
   which it starts before the last window, so what lies in an overlap counts once; with a window of
   LONGEST - 1 words no n-gram of LONGEST words crosses the end of the chunk that owns it.
4. Counting goes by length. Fingerprint counts of words and pairs, then of triples whose pairs are
   frequent, give filters of a fixed size (FILTER_BITS each): a set bit only says that a phrase may be
   frequent, as fingerprints that collide add up. What passes is counted by its text, so counts are exact.
   With more frequent phrases than the filters tell apart, more rows are shuffled and nothing is lost.

Defined cases: null and empty texts have no words; a null language is ``und``; repeated rows count each;
ties in score and count go by the phrase's bytes; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from choicemill.llm.common import Words, byte_class, gathered, mixed, ranges, signed, slices, stage, stream

LONGEST = 4
DIVISOR = 16
LEAST = 30
COVER_PERCENT = 80
TOP = 2_000
FILTER_BITS = 1 << 26  # 8 MB for each of three filters, whatever the size of the corpus
GATHER_BYTES = 4 << 20
UNKNOWN = "und"

BREAKS = byte_class(".,;:!?\n\x0b\x0c\r")
BLANKS = byte_class(" \t") | BREAKS
SPACE = byte_class(" ")


# ---------------------------------------------------------------- dictionary

def run_hashes(words: Words, part: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprint of the run of ``length`` words from each word on, and whether it lies within one part."""
    n = len(words)
    out, whole = np.zeros(n, np.uint64), np.zeros(n, bool)
    m = n - length + 1
    if m > 0:
        whole[:m] = part[:m] == part[length - 1:]
        for j, factor in enumerate(stream(length, 21)):
            out[:m] += words.hashes[j: j + m] * factor
        out[:m] = mixed(out[:m] + np.uint64(length))
    return out, whole


def parsed(words: Words, divisor: int = DIVISOR, window: int = LONGEST - 1) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First word, end and ``last`` mark of every chunk."""
    n = len(words)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)
    breaks = np.append(0, np.cumsum(BREAKS[words.data]))
    opens = np.ones(n, bool)  # the word begins a piece
    opens[1:] = (breaks[words.starts[1:]] != breaks[words.ends[:-1]]) | (words.owner[1:] != words.owner[:-1])
    piece = np.cumsum(opens)
    hashes, whole = run_hashes(words, piece, window)
    first = np.flatnonzero(opens | (whole & (hashes % np.uint64(divisor) == 0)))
    after = np.append(first[1:], n)
    last = np.append(opens[first[1:]], True)
    return first, np.where(last, after, after + window), last


def spaced(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """All words with one space after each, and where each begins (n + 1 places)."""
    length = words.ends - words.starts
    out = np.full(len(words.inside) + len(words), 32, np.uint8)
    out[np.arange(len(words.inside)) + np.repeat(np.arange(len(words)), length)] = words.inside
    return out, np.append(0, np.cumsum(length + 1))


def phrases(flat: tuple[np.ndarray, np.ndarray], first: np.ndarray, end: np.ndarray) -> pa.Array:
    """The words from ``first`` to ``end`` of each row, joined by one space."""
    data, at = flat
    start, stop = at[first], at[end] - 1
    offsets = np.append(0, np.cumsum(stop - start))
    taken = data[ranges(start, stop)]
    if offsets[-1] < 1 << 31:
        return pa.StringArray.from_buffers(len(first), pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(taken))
    return pa.LargeStringArray.from_buffers(len(first), pa.py_buffer(offsets), pa.py_buffer(taken))


def _chunks(divisor: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in gathered(batches, "text", GATHER_BYTES):
            for b in slices([whole], limit=GATHER_BYTES):
                words = Words(b.column("text"), lower=True, blank=BLANKS)
                first, end, last = parsed(words, divisor)
                rows = pa.table({"lang": b.column("lang").take(pa.array(words.owner[first])),
                                 "chunk": phrases(spaced(words), first, end).cast(pa.large_string()), "last": last})
                found = rows.group_by(["lang", "chunk", "last"]).aggregate([([], "count_all")])
                found = found.rename_columns(["lang", "chunk", "last", "n"])
                found = found.set_column(1, "chunk", found.column("chunk").cast(pa.string()))
                yield from found.to_batches(max_chunksize=50_000)
    return run


def dictionary(docs: DataFrame, divisor: int = DIVISOR) -> DataFrame:
    """lang, chunk (words joined by a space), last, n: the distinct chunks and their frequencies."""
    rows = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit(UNKNOWN)).alias("lang"), "text")
    found = rows.where(F.col("text").isNotNull()).mapInArrow(
        _chunks(divisor), "lang string, chunk string, last boolean, n long")
    return found.groupBy("lang", "chunk", "last").agg(F.sum("n").alias("n"))


# ---------------------------------------------------------------- counting

class Grams:
    """Words of a batch of dictionary rows, and which n-grams each chunk owns."""

    def __init__(self, batch: pa.RecordBatch):
        self.words = words = Words(batch.column("chunk"), blank=SPACE)
        self.weight = batch.column("n").to_numpy()[words.owner]
        coded = batch.column("lang").dictionary_encode()
        self.langs, code = coded.dictionary, coded.indices.to_numpy()
        self.code = code[words.owner]
        salt = np.array([xxhash.xxh64_intdigest(v.encode()) for v in self.langs.to_pylist()], np.uint64)
        self.salt = salt[self.code]
        size = np.diff(words.bounds)
        owned = np.where(batch.column("last").to_numpy(zero_copy_only=False), size, size - (LONGEST - 1))
        self.place = np.arange(len(words)) - words.bounds[words.owner]
        self.mine = self.place < owned[words.owner]
        self.left = size[words.owner] - self.place  # words from here to the end of the chunk

    def hashes(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Fingerprint of the n-gram from each word on, within its language, and whether the chunk holds it."""
        runs, _ = run_hashes(self.words, self.words.owner, n)
        return mixed(runs ^ self.salt), self.left >= n


def _set(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    at = (hashes % np.uint64(FILTER_BITS)).astype(np.int64)
    return (bits[at >> 3] >> (at & 7)) & 1 == 1


def _sums(hashes: np.ndarray, weight: np.ndarray, n: int) -> pa.RecordBatch:
    key, at = np.unique(hashes, return_inverse=True)
    total = np.zeros(len(key), np.int64)
    np.add.at(total, at, weight)
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(key), n, np.int32)), pa.array(signed(key)), pa.array(total)],
                                      ["k", "h", "f"])


def _short(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Fingerprint counts of words and pairs."""
    for b in gathered(batches, "chunk", GATHER_BYTES):
        grams = Grams(b)
        for n in (1, 2):
            h, whole = grams.hashes(n)
            use = whole & grams.mine
            yield _sums(h[use], grams.weight[use], n)


def _both(bits: np.ndarray, grams: Grams, n: int) -> np.ndarray:
    """Whether the n-grams from this word and from the next one on may both be frequent."""
    h, whole = grams.hashes(n)
    good = whole & _set(bits, h)
    return good & np.append(good[1:], False) & (grams.left > n)


def _triples(filters):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs = np.frombuffer(filters.value[2], np.uint8)
        for b in gathered(batches, "chunk", GATHER_BYTES):
            grams = Grams(b)
            use = _both(pairs, grams, 2) & grams.mine
            yield _sums(grams.hashes(3)[0][use], grams.weight[use], 3)
    return run


def _texts(filters):
    """Exact counts of all words (k = 0) and of the phrases that may be frequent, by text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = {n: np.frombuffer(v, np.uint8) for n, v in filters.value.items()}
        for b in gathered(batches, "chunk", GATHER_BYTES):
            grams = Grams(b)
            flat = spaced(grams.words)
            tables = []
            for n in range(LONGEST + 1):
                if n == 0:
                    use = np.flatnonzero(grams.mine)
                    text = pa.nulls(len(use), pa.string())
                else:
                    if n == LONGEST:
                        good = _both(bits[n - 1], grams, n - 1)
                    else:
                        h, whole = grams.hashes(n)
                        good = whole & _set(bits[n], h)
                    use = np.flatnonzero(good & grams.mine)
                    text = phrases(flat, use, use + n)
                rows = pa.table({"lang": pa.array(grams.code[use]), "phrase": text, "f": grams.weight[use]})
                found = rows.group_by(["lang", "phrase"]).aggregate([("f", "sum")])
                tables.append(pa.table({
                    "lang": grams.langs.take(found.column("lang").combine_chunks()), "k": pa.array(np.full(found.num_rows, n, np.int32)),
                    "phrase": found.column("phrase").cast(pa.string()), "f": found.column("f_sum")}))
            yield from pa.concat_tables(tables).to_batches(max_chunksize=50_000)
    return run


def _filter(counts: DataFrame, least: int) -> bytes:
    """One bit for each residue of the frequent fingerprints: at most FILTER_BITS / 8 bytes reach the driver."""
    bit = F.pmod("h", F.lit(FILTER_BITS))  # equals the residue of the unsigned value, as FILTER_BITS is a power of two
    bits = counts.where(F.col("f") >= least).select(bit.alias("bit"))
    rows = bits.groupBy(F.bitmap_bucket_number(F.col("bit") + 1).alias("bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position(F.col("bit") + 1)).alias("bitmap")).collect()
    out = np.zeros(FILTER_BITS // 8, np.uint8)
    width = 4_096
    for bucket, bitmap in rows:
        at = (bucket - 1) * width
        out[at: at + width] = np.frombuffer(bytes(bitmap), np.uint8)[: len(out) - at]
    return out.tobytes()


def phrase_counts(docs: DataFrame, least: int = LEAST, divisor: int = DIVISOR) -> DataFrame:
    """lang, k, phrase, f: every phrase of 1 to LONGEST words found ``least`` times or more, and, as k = 0, all words."""
    chunks = stage(dictionary(docs, divisor))
    sums = "k int, h long, f long"

    def totals(rows: DataFrame) -> DataFrame:
        return stage(rows.groupBy("k", "h").agg(F.sum("f").alias("f")).where(F.col("f") >= least))

    context = docs.sparkSession.sparkContext
    short = totals(chunks.mapInArrow(_short, sums))
    filters = {n: _filter(short.where(F.col("k") == n), least) for n in (1, 2)}
    filters[3] = _filter(totals(chunks.mapInArrow(_triples(context.broadcast(filters)), sums)), least)
    found = chunks.mapInArrow(_texts(context.broadcast(filters)), "lang string, k int, phrase string, f long")
    return found.groupBy("lang", "k", "phrase").agg(F.sum("f").alias("f")).where((F.col("k") == 0) | (F.col("f") >= least))


# ---------------------------------------------------------------- scores

def collocations(docs: DataFrame, least: int = LEAST, cover: int = COVER_PERCENT, top: int = TOP,
                 divisor: int = DIVISOR) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the ``top`` phrases of each language.

    A phrase scores by its weakest cut, floor(2000000 a / (l + r)), and gives way to a longer candidate that
    holds it and has ``cover`` percent of its occurrences or more.
    """
    counts = stage(phrase_counts(docs, least, divisor))
    words = F.split("phrase", " ")
    candidates = counts.where("k >= 2").select("lang", "k", "phrase", F.col("f").alias("a"), words.alias("w"))
    cuts = candidates.select("lang", "phrase", "a", "k", "w", F.explode(F.sequence(F.lit(1), F.col("k") - 1)).alias("cut")).select(
        "lang", "phrase", "a", "cut", F.array_join(F.slice("w", F.lit(1), F.col("cut")), " ").alias("head"),
        F.array_join(F.slice("w", F.col("cut") + 1, F.col("k") - F.col("cut")), " ").alias("tail"))
    parts = counts.where("k >= 1").select("lang", "phrase", "f")
    sided = (cuts.join(parts.select("lang", F.col("phrase").alias("head"), F.col("f").alias("l")), ["lang", "head"])
             .join(parts.select("lang", F.col("phrase").alias("tail"), F.col("f").alias("r")), ["lang", "tail"]))
    score = F.expr("(CAST(2000000 AS DECIMAL(10, 0)) * CAST(a AS DECIMAL(19, 0))) div (CAST(l AS DECIMAL(19, 0)) + CAST(r AS DECIMAL(19, 0)))")
    lowest = sided.select("lang", "phrase", "a", F.struct(score.alias("score"), "cut", "l", "r").alias("x")).groupBy(
        "lang", "phrase", "a").agg(F.min("x").alias("x"))

    # Shorter candidates within each candidate, with the most frequent one that holds them.
    spans = [(s, n) for n in range(2, LONGEST) for s in range(1, LONGEST - n + 2)]
    inner = F.array(*[F.when(F.col("k") >= max(s + n - 1, n + 1), F.array_join(F.slice("w", s, n), " ")) for s, n in spans])
    held = (candidates.where("k > 2").select("lang", F.explode(inner).alias("phrase"), "a").where(F.col("phrase").isNotNull())
            .groupBy("lang", "phrase").agg(F.max("a").alias("longer")))
    wide = "DECIMAL(19, 0)"
    covered = F.coalesce(100 * F.col("longer").cast(wide) >= cover * F.col("a").cast(wide), F.lit(False))
    left = lowest.join(held, ["lang", "phrase"], "left").where(~covered)
    order = Window.partitionBy("lang").orderBy(F.desc("x.score"), F.desc("a"), "phrase")
    best = left.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    total = counts.where("k = 0").select("lang", F.col("f").alias("n"))
    return best.join(total, "lang").select(
        "lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", F.col("x.l").alias("l"), F.col("x.r").alias("r"), "n",
        F.col("x.score").alias("score"))


def op11_phrase_mining(spark, sf_dir):
    """Collocations of two to four words in each language, over all documents."""
    return collocations(spark.read.parquet(f"{sf_dir}/documents.parquet").select("text", "lang"))


ORACLE = r"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
               translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
           FROM documents WHERE text IS NOT NULL),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p),
g AS (SELECT lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(list_slice(w, i, i + k - 1), ' '))) AS phrase
      FROM w, (SELECT unnest([1, 2, 3, 4]) AS k) WHERE len(w) >= k),
f AS (SELECT lang, k, phrase, count(*)::BIGINT AS f FROM g GROUP BY ALL),
n AS (SELECT lang, sum(f)::BIGINT AS n FROM f WHERE k = 1 GROUP BY lang),
c AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE k >= 2 AND f >= 30),
u AS (SELECT lang, phrase, a, k, w, unnest(range(1, k)) AS cut FROM c),
s AS (SELECT u.lang, u.phrase, u.a, u.cut, x.f AS l, y.f AS r, ((2000000::HUGEINT * u.a) // (x.f + y.f))::BIGINT AS score
      FROM u JOIN f x ON x.lang = u.lang AND x.phrase = array_to_string(list_slice(u.w, 1, u.cut), ' ')
      JOIN f y ON y.lang = u.lang AND y.phrase = array_to_string(list_slice(u.w, u.cut + 1, u.k), ' ')),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
i AS (SELECT lang, a, array_to_string(list_slice(w, st, st + len - 1), ' ') AS phrase
      FROM c, (SELECT unnest([2, 3]) AS len), (SELECT unnest([1, 2, 3]) AS st) WHERE len < k AND st + len - 1 <= k),
h AS (SELECT lang, phrase, max(a) AS longer FROM i GROUP BY ALL),
t AS (SELECT b.*, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, a DESC, b.phrase)::BIGINT AS rank
      FROM b LEFT JOIN h ON h.lang = b.lang AND h.phrase = b.phrase
      WHERE NOT coalesce(100 * longer::HUGEINT >= 80 * a::HUGEINT, false))
SELECT t.lang, rank, phrase, a, l, r, n, score FROM t JOIN n ON n.lang = t.lang WHERE rank <= 2000
"""
