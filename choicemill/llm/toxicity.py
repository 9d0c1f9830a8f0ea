"""Toxicity by weak supervision.

1. Voters. Terms are words and word beginnings that mark toxic rows in a bounded hash sample of labelled rows
   that are not held out: either by lying in a text at all, or by being frequent in it, whichever tells more.
   Terms that begin alike form a family; each of LEXICONS voters has its share of the families and says yes
   to a text of whose words one in DENSE is marked by it. One voter asks for one in MARKED over all families,
   and pattern voters look at texts in capitals and at exclamation marks.
2. Label model. The votes of all rows that are not held out are counted by bitmask (at most 2 to the number
   of voters). Expectation maximisation over these counts estimates how often each voter says yes on toxic and on
   other texts, without labels. Voters whose votes still go together when the class is known are
   correlated; each counts with the inverse of the size of its group, and the model is fitted again.
3. Classifier. A logistic regression over the share of a text's words that each term marks is fitted to the
   posterior of a bounded hash sample of texts, and scores every text in one pass without a shuffle.

Shares, not presence: a long clean text holds most word beginnings once. Language, source and id are no inputs.
Defined cases: null, empty and wordless texts get the score of the intercept; without a usable label every
score is 0; repeated rows are scored each; labels that are null teach nothing, and of repeated labels of one
id each counts.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from choicemill.llm.common import drawn, flat_list, held_out, list_array, mixed, signed, slices, stage, stream
from choicemill.llm.language_id import LetterWords, _table

PER_CLASS = 4_000  # expected number of labelled rows of each class that voters are learned from
FIT_ROWS = 20_000  # expected number of texts that the classifier is fitted on
TERMS = 384
LEXICONS = 10
PREFIXES = (4, 5, 6)
CHANCE = 40  # a term's likelihood ratio statistic must pass 2 ln(terms / CHANCE): a few pass by chance at any size
LEAST_ODDS = 1.5
DENSE = 200
MARKED = 100
SHORT = 50  # shares of shorter texts are taken over this many words
HIGHEST = 10.0  # per cent
THRESHOLD = 0.3
CORRELATED = 0.3
NEVER = -1_000.0


def terms(words: LetterWords) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word number, fingerprint and family of every word and word beginning."""
    length = words.ends - words.starts
    family = words.hashes.copy()
    places, found = [np.arange(len(length))], [words.hashes]
    for n in PREFIXES:
        some = np.flatnonzero(length >= n)
        h = np.full(len(some), 100 + n, np.uint64)
        for j, factor in enumerate(stream(n, 14)):
            h += _table("random")[words.points[words.starts[some] + j]] * factor
        h = mixed(h)
        if n == PREFIXES[0]:
            family[some] = h
        places.append(some)
        found.append(h)
    at = np.concatenate(places)
    return at, np.concatenate(found), family[at]


def _presence(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Terms of labelled texts: rows of each label that hold the term, and that hold it densely."""
    for b in slices(batches):
        words = LetterWords(b.column("text"))
        at, h, family = terms(words)
        label = b.column("toxic").to_numpy().astype(np.int64)
        size = np.diff(words.bounds)
        values, first, which = np.unique(h, return_index=True, return_inverse=True)
        pairs, times = np.unique(which.astype(np.int64) * b.num_rows + words.owner[at], return_counts=True)
        term, text = pairs // b.num_rows, pairs % b.num_rows
        dense = times * DENSE >= size[text]
        n = [np.bincount(term, weights=w, minlength=len(values)).astype(np.int64)
             for w in (label[text], 1 - label[text], dense * label[text], dense * (1 - label[text]))]
        yield pa.RecordBatch.from_arrays(
            [pa.array(signed(values)), pa.array(signed(family[first])), *[pa.array(x) for x in n]],
            ["h", "family", "pos", "neg", "dense_pos", "dense_neg"])


def gain(pos: str, neg: str, n: dict[int, int]) -> Column:
    """Likelihood ratio statistic of a term against the label, 0 where it does not mark toxic rows."""
    total = n[0] + n[1]

    def part(seen: Column, row: Column, column: int) -> Column:
        return F.when(seen > 0, seen * F.log(seen * total / (row * column))).otherwise(0.0)

    held = F.col(pos) + F.col(neg)
    rest = F.lit(total) - held
    g = part(F.col(pos), held, n[1]) + part(F.col(neg), held, n[0]) \
        + part(n[1] - F.col(pos), rest, n[1]) + part(n[0] - F.col(neg), rest, n[0])
    odds = F.log((F.col(pos) + 0.5) / n[1]) - F.log((F.col(neg) + 0.5) / n[0])
    return F.when(odds > LEAST_ODDS, 2 * g).otherwise(0.0)


def learn_terms(docs: DataFrame, labels: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints of the terms that mark toxic texts, the strongest first, and the voter of each."""
    nothing = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    known = labels.where(~held_out() & F.col("toxic").isin(0, 1)).select(
        F.col("doc_id").alias("__id"), F.col("toxic").cast("int").alias("toxic"))
    sizes = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if not sizes.get(1) or not sizes.get(0):
        return nothing
    share = F.when(F.col("toxic") == 1, min(1.0, PER_CLASS / sizes[1])).otherwise(min(1.0, PER_CLASS / sizes[0]))
    # About 2 * PER_CLASS rows of 12 bytes at any size of the tables.
    sample = F.broadcast(known.where(drawn(share, "__id")))
    rows = docs.where(~held_out()).join(sample, F.col("doc_id") == F.col("__id")).select("text", "toxic")
    rows = stage(rows.where(F.col("text").isNotNull()))
    n = {r["toxic"]: r["n"] for r in rows.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if not n.get(1) or not n.get(0):
        return nothing
    names = ("pos", "neg", "dense_pos", "dense_neg")
    counted = rows.mapInArrow(_presence, "h long, family long, " + ", ".join(f"{x} long" for x in names)).groupBy(
        "h", "family").agg(*[F.sum(x).alias(x) for x in names])
    counted = stage(counted)
    least = 2 * math.log(max(1.0, counted.count() / CHANCE))
    best = (counted.withColumn("gain", F.greatest(gain("pos", "neg", n), gain("dense_pos", "dense_neg", n)))
            .where((F.col("gain") > 0) & (F.col("gain") >= least)).orderBy(F.desc("gain"), "h").limit(TERMS).select("h", "family").toArrow())
    _, first, which = np.unique(best.column("family").to_numpy(), return_index=True, return_inverse=True)
    # Families are dealt to the voters from the strongest on.
    place = np.argsort(np.argsort(first))
    return best.column("h").to_numpy().view(np.uint64).copy(), place[which] % LEXICONS


def present(words: LetterWords, vocabulary: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Word number and place in the sorted vocabulary of each term found."""
    if not len(vocabulary):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    word, h, _ = terms(words)
    at = np.minimum(np.searchsorted(vocabulary, h), len(vocabulary) - 1)
    there = vocabulary[at] == h
    return word[there], at[there]


def shares(words: LetterWords, vocabulary: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text number, place in the vocabulary, and the per cent of the text's words that the term marks."""
    word, at = present(words, vocabulary)
    size = np.maximum(np.diff(words.bounds), SHORT)
    pairs, times = np.unique(words.owner[word].astype(np.int64) * max(1, len(vocabulary)) + at, return_counts=True)
    text, term = pairs // max(1, len(vocabulary)), pairs % max(1, len(vocabulary))
    return text, term, np.minimum(100 * times / size[text], HIGHEST)


def patterns(text: str) -> int:
    """Bits of the pattern voters."""
    shouting = bool(text) and text.upper() == text and text.lower() != text
    return shouting | (text.count("!") > text.count(".")) << 1


PATTERN_VOTERS = 2
VOTERS = LEXICONS + 1 + PATTERN_VOTERS


def _votes(vocabulary: np.ndarray, voter: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            words = LetterWords(b.column("text"))
            size = np.diff(words.bounds)
            word, at = present(words, vocabulary)
            marked = np.unique(word * LEXICONS + voter[at])  # a word counts once for a voter
            times = np.zeros((b.num_rows, LEXICONS + 1), np.int64)
            np.add.at(times, (words.owner[marked // LEXICONS], marked % LEXICONS), 1)
            np.add.at(times, (words.owner[np.unique(word)], LEXICONS), 1)
            least = np.array([DENSE] * LEXICONS + [MARKED])
            yes = (times > 0) & (times * least >= np.maximum(size, SHORT)[:, None])
            bits = (yes.astype(np.int64) << np.arange(LEXICONS + 1)).sum(axis=1)
            more = np.array([patterns(t or "") for t in b.column("text").to_pylist()], np.int64) << LEXICONS + 1
            text, term, share = shares(words, vocabulary)
            n = np.bincount(text, minlength=b.num_rows)
            yield pa.RecordBatch.from_arrays(
                [pa.array(bits | more), list_array(term.astype(np.int32), n, pa.int32()), list_array(share, n, pa.float64())],
                ["mask", "terms", "shares"])
    return run


class LabelModel:
    """Naive Bayes with a hidden class over yes-no voters, with weights for correlated voters."""

    def __init__(self, masks: np.ndarray, counts: np.ndarray, voters: int, rounds: int = 50):
        self.voters = voters
        self.weight = np.ones(voters)
        votes = self.votes(masks)
        start = np.where(votes[:, LEXICONS] > 0, 0.95, 0.02)
        self._fit(votes, counts, start, rounds)
        p = self.posterior(masks)
        self.correlations = self._correlations(votes, counts, p)
        near = np.abs(self.correlations) > CORRELATED
        self.weight = 1 / near.sum(axis=1)
        self._fit(votes, counts, p, rounds)

    def votes(self, masks: np.ndarray) -> np.ndarray:
        return (masks[:, None] >> np.arange(self.voters) & 1).astype(float)

    def _fit(self, votes, counts, p, rounds):
        for _ in range(rounds):
            ones, zeros = counts * p, counts * (1 - p)
            self.prior = (ones.sum() + 1) / (counts.sum() + 10)
            self.yes = [(votes.T @ zeros + 0.1) / (zeros.sum() + 1), (votes.T @ ones + 0.1) / (ones.sum() + 1)]
            p = self._posterior(votes)

    def _correlations(self, votes, counts, p):
        """Correlation of the voters' errors, given the class."""
        total = np.zeros((self.voters, self.voters))
        for c, w in ((0, counts * (1 - p)), (1, counts * p)):
            rest = votes - self.yes[c]
            total += (rest * w[:, None]).T @ rest
        scale = np.sqrt(np.diag(total)) + 1e-9
        return np.where(np.eye(self.voters) > 0, 1.0, total / np.outer(scale, scale))

    def _posterior(self, votes):
        logs = [votes * np.log(self.yes[c]) + (1 - votes) * np.log(1 - self.yes[c]) for c in (0, 1)]
        odds = np.log(self.prior / (1 - self.prior)) + ((logs[1] - logs[0]) * self.weight).sum(axis=1)
        return 1 / (1 + np.exp(-np.clip(odds, -30, 30)))

    def posterior(self, masks: np.ndarray) -> np.ndarray:
        return self._posterior(self.votes(masks))


def _scores(vocabulary: np.ndarray, weights: np.ndarray, intercept: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            text, term, share = shares(LetterWords(b.column("text")), vocabulary)
            total = intercept + np.bincount(text, weights=weights[term] * share, minlength=b.num_rows)
            score = np.where(total <= NEVER, 0.0, 1 / (1 + np.exp(-np.clip(total, -500, 500))))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(score)], ["doc_id", "score"])
    return run


def train(docs: DataFrame, labels: DataFrame) -> tuple[np.ndarray, np.ndarray, float, LabelModel | None]:
    """Vocabulary, weights, intercept and the label model behind them."""
    ranked, voter = learn_terms(docs, labels)
    if not len(ranked):
        return ranked, np.zeros(0), NEVER, None
    order = np.argsort(ranked)
    vocabulary, voter = ranked[order], voter[order]
    rows = docs.where(~held_out() & F.col("text").isNotNull())
    voted = rows.select("doc_id", "text")
    cast = _votes(vocabulary, voter)
    masks = voted.select("text").mapInArrow(cast, "mask long, terms array<int>, shares array<double>").groupBy("mask").agg(
        F.count("*").alias("n")).toArrow()
    mask, n = masks.column("mask").to_numpy(), masks.column("n").to_numpy().astype(float)
    model = LabelModel(mask, n, VOTERS)
    share = min(1.0, FIT_ROWS / max(1.0, n.sum()))
    sample = voted.where(drawn(share, "doc_id", "text")).select("text").mapInArrow(
        _labelled(cast, model, len(vocabulary)), "x array<double>, label double, weight double")
    table = stage(sample).select(array_to_vector("x").alias("features"), "label", "weight")
    fitted = LogisticRegression(weightCol="weight", maxIter=40, regParam=1e-4).fit(table)
    return vocabulary, fitted.coefficients.toArray(), float(fitted.intercept), model


def _labelled(cast, model: LabelModel, width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in cast(batches):
            p = model.posterior(b.column("mask").to_numpy())
            x = np.zeros((b.num_rows, width))
            at, n = flat_list(b.column("terms"))
            x[np.repeat(np.arange(b.num_rows), n), at] = flat_list(b.column("shares"))[0]
            for label, weight in ((1.0, p), (0.0, 1 - p)):
                yield pa.RecordBatch.from_arrays(
                    [list_array(x.ravel(), np.full(b.num_rows, width), pa.float64()), pa.array(np.full(b.num_rows, label)),
                     pa.array(weight)], ["x", "label", "weight"])
    return run


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted per row of ``docs``."""
    vocabulary, weights, intercept, _ = train(docs, labels)
    kind = docs.schema["doc_id"].dataType.simpleString()
    scored = docs.select("doc_id", "text").mapInArrow(
        _scores(vocabulary, weights, intercept), f"doc_id {kind}, score double")
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def op8_toxicity(spark, sf_dir):
    """Toxicity of every document, from weak labels."""
    return toxicity(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
