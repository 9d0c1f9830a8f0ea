"""Language identification by words first, then by ever shorter character n-grams.

Known words are scored by their log frequency in each language. A word that training has not seen is
scored by its character n-grams: at each place the longest known n-gram that starts there, of MOST
characters down to one.

The model is fitted on a bounded hash sample of labelled rows, about PER_LANGUAGE for each language; so
its tables are bounded as well and travel with the tasks. Counts are combined per task and summed by
Spark. Every document is then scored whole, in one pass without a shuffle.

Defined cases: null text, or text without a letter, is ``und`` with score 0; so is every text where
nothing could be learned; ties go to the language that sorts first; repeated rows are scored each.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from choicemill.llm.common import drawn, held_out, mixed, signed, slices, stream

PER_LANGUAGE = 4_000  # expected number of training rows of each language
MOST = 5
LEAST_COUNT = 2
UNKNOWN = "und"
WORD_SMOOTHING, GRAM_SMOOTHING = 0.1, 0.1

_POINTS = sys.maxunicode + 1
_tables: dict[str, np.ndarray] = {}


def _table(name: str) -> np.ndarray:
    """Over all code points: whether it is a letter, its lower case, its random number."""
    if not _tables:
        every = [chr(i) for i in range(_POINTS)]
        _tables["letter"] = np.array([c.isalpha() for c in every])
        lower = np.arange(_POINTS, dtype=np.uint32)
        for i, c in enumerate(every):
            if c != (low := c.lower()) and len(low) == 1:
                lower[i] = ord(low)
        _tables["lower"] = lower
        _tables["random"] = stream(_POINTS, 11)
    return _tables[name]


class LetterWords:
    """Runs of letters of a slice of texts, in lower case, with 64-bit fingerprints."""

    def __init__(self, texts: pa.Array):
        texts = pc.fill_null(texts, "")
        size = pc.utf8_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
        points = np.frombuffer("".join(texts.to_pylist()).encode("utf-32-le", "surrogatepass"), np.uint32)
        ends = np.cumsum(size)
        inside = _table("letter")[points] if len(points) else np.zeros(0, bool)
        first = np.ones(len(points) + 1, bool)
        first[1:-1] = ~inside[:-1]
        first[np.append(0, ends)] = True
        begin = inside & first[:-1]
        at = np.flatnonzero(begin)
        self.points = _table("lower")[points[inside]] if len(points) else np.zeros(0, np.uint32)
        position = np.cumsum(inside) - inside
        self.starts = position[at]
        self.ends = np.append(self.starts[1:], len(self.points)).astype(np.int64)
        self.bounds = np.searchsorted(at, np.append(0, ends))
        length = self.ends - self.starts
        if len(length):
            place = np.arange(len(self.points)) - np.repeat(self.starts, length)
            value = _table("random")[self.points] * stream(int(length.max()), 12)[place]
            self.hashes = mixed(np.add.reduceat(value, self.starts) + length.astype(np.uint64))
        else:
            self.hashes = np.zeros(0, np.uint64)

    @property
    def owner(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.bounds) - 1), np.diff(self.bounds))


def grams(points: np.ndarray, room: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Places at which n characters fit into their word, and the fingerprints of those n-grams."""
    at = np.flatnonzero(room >= n)
    out = np.full(len(at), n, np.uint64)
    for j, factor in enumerate(stream(n, 13)):
        out += _table("random")[points[at + j]] * factor
    return at, mixed(out)


def room_left(starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """For each character of consecutive words, the characters from it to the end of its word."""
    length = ends - starts
    return np.repeat(ends, length) - np.arange(int(length.sum()))


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in slices(batches):
        words = LetterWords(b.column("text"))
        lang = np.array(b.column("lang").to_pylist(), object)
        of_word = lang[words.owner]
        of_letter = np.repeat(of_word, words.ends - words.starts)
        room = room_left(words.starts, words.ends)
        found = [(0, of_word, words.hashes)]
        for n in range(1, MOST + 1):
            at, h = grams(words.points, room, n)
            found.append((n, of_letter[at], h))
        for n, langs, h in found:
            for name in np.unique(langs.astype(str)):
                values, times = np.unique(h[langs == name], return_counts=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([name] * len(values)), pa.array(np.full(len(values), n, np.int32)), pa.array(signed(values)),
                     pa.array(times.astype(np.int64))], ["lang", "n", "h", "k"])


@dataclass
class Model:
    """Sorted fingerprints and, for each, log frequencies by language."""

    languages: list[str]
    known: np.ndarray
    scores: np.ndarray
    gram_known: np.ndarray
    gram_scores: np.ndarray


def train(docs: DataFrame, per_language: int = PER_LANGUAGE) -> Model:
    """A model of the rows of ``docs`` (text, lang, doc_id) that are not held out and have a language."""
    rows = docs.where(~held_out() & F.col("lang").isNotNull() & F.col("text").isNotNull()).select(
        "doc_id", "text", F.col("lang").cast("string").alias("lang"))
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    languages = sorted(sizes)
    if not languages:
        none = np.zeros(0, np.uint64)
        return Model([], none, np.zeros((0, 0), np.float32), none, np.zeros((0, 0), np.float32))
    share = F.create_map(*[F.lit(x) for name in languages for x in
                           (name, min(1.0, per_language / sizes[name]))])
    counts = [F.coalesce(F.sum(F.when(F.col("lang") == x, F.col("k"))), F.lit(0)).alias(f"k{i}")
              for i, x in enumerate(languages)]
    kept = (rows.where(drawn(share[F.col("lang")], "doc_id", "text")).select("text", "lang")
            .mapInArrow(_counts, "lang string, n int, h long, k long")
            .groupBy("n", "h").agg(*counts, F.sum("k").alias("all")).where(F.col("all") >= LEAST_COUNT).toArrow())
    n = kept.column("n").to_numpy()
    h = kept.column("h").to_numpy().view(np.uint64)
    k = np.array([kept.column(f"k{i}").to_numpy() for i in range(len(languages))], np.float64).T

    def logs(mask: np.ndarray, smoothing: float) -> np.ndarray:
        some = k[mask]
        return np.log((some + smoothing) / (some.sum(axis=0) + smoothing * max(1, len(some))))

    parts = [(h[n == i], logs(n == i, GRAM_SMOOTHING)) for i in range(1, MOST + 1)]
    gram_known, gram_scores = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
    order, g_order = np.argsort(h[n == 0]), np.argsort(gram_known)
    return Model(languages, h[n == 0][order], logs(n == 0, WORD_SMOOTHING)[order].astype(np.float32),
                 gram_known[g_order], gram_scores[g_order].astype(np.float32))


def _find(known: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Place of each value in a sorted array, and whether it is there."""
    if not len(known):
        return np.zeros(len(h), np.int64), np.zeros(len(h), bool)
    at = np.minimum(np.searchsorted(known, h), len(known) - 1)
    return at, known[at] == h


def word_scores(words: LetterWords, model: Model) -> tuple[np.ndarray, np.ndarray]:
    """Scores (distinct word x language) and, for each word, the number of its distinct one."""
    distinct, where, which = np.unique(words.hashes, return_index=True, return_inverse=True)
    at, seen = _find(model.known, distinct)
    scores = np.zeros((len(distinct), len(model.languages)))
    if seen.any():
        scores[seen] = model.scores[at[seen]]
    new = np.flatnonzero(~seen)
    if len(new) and len(model.gram_known):
        starts, ends = words.starts[where[new]], words.ends[where[new]]
        length = ends - starts
        upto = np.cumsum(length)
        points = words.points[np.repeat(starts - (upto - length), length) + np.arange(int(upto[-1]))]
        room = room_left(upto - length, upto)
        open_ = np.ones(len(points), bool)
        values = np.zeros((len(points), len(model.languages)))
        for n in range(MOST, 0, -1):
            place, h = grams(points, np.where(open_, room, 0), n)
            i, there = _find(model.gram_known, h)
            values[place[there]] = model.gram_scores[i[there]]
            open_[place[there]] = False
        scores[new] = np.add.reduceat(values, upto - length) / length[:, None]
    return scores, which


def _predict(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            words = LetterWords(b.column("text"))
            counts = np.diff(words.bounds)
            best, sure = np.full(b.num_rows, UNKNOWN, object), np.zeros(b.num_rows)
            some = np.flatnonzero(counts)
            if len(some) and model.languages:
                scores, which = word_scores(words, model)
                sums = np.add.reduceat(scores[which], words.bounds[:-1][some])
                sums -= sums.max(axis=1, keepdims=True)
                odds = np.exp(sums)
                best[some] = np.array(model.languages, object)[sums.argmax(axis=1)]
                sure[some] = odds.max(axis=1) / odds.sum(axis=1)
            yield pa.RecordBatch.from_arrays(
                [b.column("__row"), pa.array(best, pa.string()), pa.array(sure)], ["__row", "lang_pred", "score"])
    return run


def predicted(docs: DataFrame, model: Model, columns: list[str]) -> DataFrame:
    """__row (the given columns as they are), lang_pred and score."""
    kept = F.struct(*[F.col(f"`{c}`") for c in columns])
    rows = docs.select("text", kept.alias("__row"))
    kind = rows.schema["__row"].dataType.simpleString()
    return rows.mapInArrow(_predict(model), f"__row {kind}, lang_pred string, score double")


def language_id(docs: DataFrame, per_language: int = PER_LANGUAGE) -> DataFrame:
    """doc_id, held_out, lang_pred, score per row of ``docs``."""
    model = train(docs, per_language)
    return predicted(docs, model, ["doc_id"]).select(
        "__row.doc_id", held_out("__row.doc_id").alias("held_out"), "lang_pred", "score")


def recognised(docs: DataFrame, least: float = 0.5) -> DataFrame:
    """``docs`` without the rows whose language is unknown or in doubt; a null doc_id does no harm."""
    found = predicted(docs, train(docs), docs.columns)
    return found.where((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= least)).select("__row.*")


def op10_language_id(spark, sf_dir):
    """Language of every document, learned from the rows that are not held out."""
    return language_id(spark.read.parquet(f"{sf_dir}/documents.parquet"))
