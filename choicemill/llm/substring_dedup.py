"""Substring dedup by level-wise doubling.

A run of words that repeats consists of two halves that repeat. So level L looks only at what
level L / 2 has left, and stops where nothing is left:

1. On the first level (half a window), each text gives the smallest fingerprint among the
   half-windows inside every window. These anchors are about a sixth of all half-windows, depend on
   content alone, and every window holds one, so equal windows have equal anchors.
2. Anchors are counted over all texts. A text learns which of its anchors occur nowhere else; windows
   over such a *sole* anchor cannot repeat and go. Texts with sole anchors only need no further look.
3. Windows over the other anchors, twice as long, are compared by 96-bit fingerprints, and each
   content's first occurrence (smallest id, then start) is sent back to its text. Every other
   surviving window repeats an earlier one, and the words under it are removed.

Equal texts are one content from the start: all but the one with the smallest id are covered
whole. All counting is by aggregates that combine before they shuffle; nothing is collected per
fingerprint, so a passage in a third of all texts costs one row a task. Lists are kept per text only.

4. Above the window, a run of 2L words is looked at only where both of its halves of L words are
   known to repeat, which a text's own positions tell. Runs that occur once go, the others are the next
   level's halves, until no text has a candidate left. A level takes along only the words under its
   candidates, so texts are shuffled less and less. The last level a text reaches is its longest repeat.

Windows of one length decide what is removed; the levels above it add ``longest_repeat`` and change no
decision, so the pipeline's form leaves them out. Runs of a level are named by doubling the names of the
level below inside the task, so a level of any length costs one step more than the last.

Defined cases: null or empty text has no words; a null id sorts last; rows with equal id and equal
text are one document and get the same answer; rows with equal id and different texts are ordered by
text fingerprint. Other columns are ignored. Windows are judged on the input.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from choicemill.llm.common import (
    Words, flat_list, identified, list_array, mixed, order_id, ranges, signed, slices, stage, stream)

EMPTY_SHA = hashlib.sha256(b"").hexdigest()
TOP = np.uint64(0xFFFFFFFFFFFFFFFF)


def _sliding(x: np.ndarray, width: int, pick) -> np.ndarray:
    """pick (minimum or maximum) over x[i : i + width], for the i where that fits."""
    have, out = 1, x
    while have * 2 <= width:
        out = pick(out[:-have], out[have:])
        have *= 2
    rest = width - have
    return pick(out[:-rest], out[rest:]) if rest else out


def window_anchors(words: Words, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each word: the anchor of the window from there on, whether that window lies within its text,
    and whether an anchor starts at the word itself."""
    half = window // 2
    parts, _ = words.runs(half)
    n = len(words)
    least, whole, chosen = np.full(n, TOP), np.zeros(n, bool), np.zeros(n, bool)
    m = n - window + 1
    if m <= 0:
        return least, whole, chosen
    owner = words.owner
    whole[:m] = owner[:m] == owner[window - 1:]
    width = window - half + 1
    least[:m] = _sliding(parts[: m + width - 1], width, np.minimum)
    covering = np.concatenate([np.zeros(width - 1, np.uint64), np.where(whole, least, np.uint64(0))])
    chosen = (_sliding(covering, width, np.maximum) == parts) & (parts > 0)
    return least, whole, chosen


def _heads(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            words = Words(b.column("text"))
            _, _, chosen = window_anchors(words, window)
            parts, _ = words.runs(window // 2)
            counts = np.diff(words.bounds)
            anchors = np.array([len(np.unique(parts[s:e][chosen[s:e]])) if e - s >= window else 0
                                for s, e in zip(words.bounds[:-1], words.bounds[1:], strict=True)], np.int64)
            sha = [hashlib.sha256(b" ".join((t or "").encode().split())).hexdigest()
                   for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b.column(c) for c in ("doc_id", "o", "k1", "k2")] + [
                    pa.array(counts.astype(np.int64)), pa.array(anchors), pa.array(sha)],
                ["doc_id", "o", "k1", "k2", "n_words", "n_anchors", "sha"])
    return run


def _anchors(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            words = Words(b.column("text"))
            _, _, chosen = window_anchors(words, window)
            parts, _ = words.runs(window // 2)
            each = [np.unique(parts[s:e][chosen[s:e]], return_counts=True)
                    for s, e in zip(words.bounds[:-1], words.bounds[1:], strict=True)]
            keys = np.repeat(b.column("k1").to_numpy(), [len(found) for found, _ in each])
            yield pa.RecordBatch.from_arrays(
                [pa.array(signed(np.concatenate([found for found, _ in each]))), pa.array(keys),
                 pa.array(np.concatenate([times for _, times in each]) > 1)], ["h", "k1", "again"])
    return run


def _surviving(words: Words, sole: np.ndarray, window: int) -> np.ndarray:
    """Words at which a window starts whose anchor occurs elsewhere."""
    least, whole, _ = window_anchors(words, window)
    at = np.flatnonzero(whole)
    return at[~np.isin(signed(least[at]), sole)]


def _candidates(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            words = Words(b.column("text"))
            sole, _ = flat_list(b.column("sole"))
            at = _surviving(words, sole, window)
            one, _ = words.runs(window, 4)
            two, _ = words.runs(window, 5)
            text = words.owner[at]
            start = at - words.bounds[text]
            yield pa.RecordBatch.from_arrays(
                [pa.array(signed(one[at])), pa.array((two[at] >> np.uint64(32)).astype(np.uint32).view(np.int32)),
                 pa.array(b.column("o").to_numpy()[text]), pa.array(b.column("tie").to_numpy()[text]),
                 pa.array(start.astype(np.int32))], ["a", "b", "o", "tie", "start"])
    return run


def _halves_found(at: np.ndarray, length: int) -> np.ndarray:
    """Places in one text where both halves of a run of twice the length repeat; ``at`` is ascending."""
    return at[np.isin(at + length, at, assume_unique=True)]


def _spans_of(at: np.ndarray) -> np.ndarray:
    """Ascending numbers as alternating starts and ends of gapless ranges."""
    if not len(at):
        return np.zeros(0, np.int32)
    cut = np.flatnonzero(np.diff(at) != 1)
    return np.column_stack([at[np.append(0, cut + 1)], at[np.append(cut, len(at) - 1)] + 1]).ravel().astype(np.int32)


def _places(spans: np.ndarray) -> np.ndarray:
    """The numbers inside alternating starts and ends."""
    return ranges(spans[::2].astype(np.int64), spans[1::2].astype(np.int64))


def _named_runs(words: Words, window: int, length: int, seed: int) -> np.ndarray:
    """Fingerprints of the runs of ``length`` words, a doubling of the window, from each word on."""
    name, _ = words.runs(window, seed)
    left, right = stream(2, seed + 16)
    while window < length:
        m = max(len(name) - window, 0)
        name = np.append(mixed(name[:m] * left + name[window:] * right), np.zeros(len(name) - m, np.uint64))
        window *= 2
    return name


def _longer(window: int, length: int):
    """The runs of ``length`` words at the places a text still has to show."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            words = Words(b.column("text"))
            spans, counts = flat_list(b.column("spans"))
            ends = np.cumsum(counts)
            at = [_places(spans[e - n: e]) for n, e in zip(counts, ends, strict=True)]
            text = np.repeat(np.arange(len(at)), [len(x) for x in at])
            start = np.concatenate(at)
            place = start + words.bounds[text]
            one, two = (_named_runs(words, window, length, seed)[place] for seed in (4, 5))
            yield pa.RecordBatch.from_arrays(
                [pa.array(signed(one)), pa.array((two >> np.uint64(32)).astype(np.uint32).view(np.int32)),
                 pa.array(b.column("o").to_numpy()[text]), pa.array(b.column("tie").to_numpy()[text]),
                 pa.array(start.astype(np.int32))], ["a", "b", "o", "tie", "start"])
    return run


def _cut(words: Words, text: int, at: np.ndarray, length: int) -> tuple[str, np.ndarray]:
    """The words of a text under the runs of ``length`` words at ascending places, and the places there as spans.

    A filler stands between parts that do not touch, where no run starts: no two parts make up a run.
    """
    if not len(at):
        return "", np.zeros(0, np.int32)
    opens = np.append(True, at[1:] > at[:-1] + length)
    first, last = at[opens], at[np.append(opens[1:], True)] + length
    shift = first - (np.cumsum(last - first + 1) - (last - first + 1))
    base = words.bounds[text]
    parts = [words.data[words.starts[base + f]: words.ends[base + e - 1]].tobytes() for f, e in zip(first, last, strict=True)]
    return b" | ".join(parts).decode(), _spans_of(at - shift[np.cumsum(opens) - 1])


def _left_over(length: int):
    """Texts with a repeated run of ``length`` words, cut to what may be part of a repeat of twice that length."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            words = Words(b.column("text"))
            spans, counts = flat_list(b.column("spans"))
            alone, lone_counts = flat_list(b.column("alone"))
            ends, lone_ends = np.cumsum(counts), np.cumsum(lone_counts)
            rest = [np.setdiff1d(_places(spans[e - n: e]), alone[f - m: f], assume_unique=True)
                    for n, e, m, f in zip(counts, ends, lone_counts, lone_ends, strict=True)]
            cuts = [_cut(words, t, _halves_found(at, length), 2 * length) for t, at in enumerate(rest) if len(at)]
            if cuts:
                kept = b.filter(pa.array([len(at) > 0 for at in rest]))
                yield pa.RecordBatch.from_arrays(
                    [kept.column("o"), kept.column("tie"), *_cut_columns(cuts)], ["o", "tie", "text", "spans"])
    return run


def _cut_columns(cuts: list[tuple[str, np.ndarray]]) -> list[pa.Array]:
    return [pa.array([text for text, _ in cuts], pa.string()),
            list_array(np.concatenate([x for _, x in cuts]), np.array([len(x) for _, x in cuts]), pa.int32())]


def _removals(window: int, texts: bool, ladder: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            words = Words(b.column("text"))
            sole, _ = flat_list(b.column("sole"))
            firsts, counts = flat_list(b.column("firsts"))
            keeps = firsts + np.repeat(words.bounds[:-1], counts)
            alive = _surviving(words, sole, window)
            at = np.setdiff1d(alive, keeps)
            change = np.zeros(len(words) + 1, np.int64)
            np.add.at(change, at, 1)
            np.add.at(change, at + window, -1)
            gone = np.cumsum(change[:-1]) > 0
            removed, shas, kept = [], [], []
            for t, (s, e) in enumerate(zip(words.bounds[:-1], words.bounds[1:], strict=True)):
                flags = gone[s:e]
                raw = words.data[words.offs[t]: words.offs[t + 1]].tobytes()
                left = b" ".join([w for w, g in zip(raw.split(), flags.tolist(), strict=True) if not g])
                removed.append(int(flags.sum()))
                shas.append(hashlib.sha256(left).hexdigest())
                if texts:
                    kept.append(_without(raw, words, t, flags) if removed[-1] else raw.decode())
            columns = [b.column("k1"), b.column("k2"), pa.array(removed, pa.int64()), pa.array(shas, pa.string())]
            names = ["k1", "k2", "removed", "sha_left"]
            if texts:
                columns.append(pa.array(kept, pa.string()))
                names.append("kept_text")
            if ladder:
                alone, counts = flat_list(b.column("alone"))
                again = np.setdiff1d(alive, alone + np.repeat(words.bounds[:-1], counts))
                each = [again[s:e] - w for w, s, e in zip(
                    words.bounds[:-1], *(np.searchsorted(again, x) for x in (words.bounds[:-1], words.bounds[1:])), strict=True)]
                cuts = [_cut(words, t, _halves_found(x, window), 2 * window) for t, x in enumerate(each)]
                columns += [b.column("o"), b.column("tie"), pa.array([len(x) > 0 for x in each]), *_cut_columns(cuts)]
                names += ["o", "tie", "repeats", "text", "spans"]
            yield pa.RecordBatch.from_arrays(columns, names)
    return run


def _without(raw: bytes, words: Words, t: int, flags: np.ndarray) -> str:
    """The text without the removed words and the blanks after each of them."""
    s, e = words.bounds[t], words.bounds[t + 1]
    base = words.offs[t]
    keep = np.ones(len(raw), bool)
    nexts = np.append(words.starts[s + 1: e], words.offs[t + 1]) - base
    for i in np.flatnonzero(flags):
        keep[words.starts[s + i] - base: nexts[i]] = False
    return np.frombuffer(raw, np.uint8)[keep].tobytes().decode()


def _climb(level: DataFrame, window: int) -> DataFrame:
    """o, tie, longest: the last length, doubling from the window, at which a run of the text repeats.

    ``level`` holds o, tie, what is left of the text and the candidates (spans) of twice the window there, for
    texts with a repeated window. Each level shuffles only words that may be part of a repeat of its length.
    """
    reached, length = level.select("o", "tie", F.lit(window).cast("long").alias("longest")), window
    open_ = level.where(F.size("spans") > 0)
    while not open_.isEmpty():
        length *= 2
        alone = (open_.mapInArrow(_longer(window, length), "a long, b int, o long, tie long, start int")
                 .groupBy("a", "b").agg(F.min(F.struct("o", "tie", "start")).alias("at"), F.count("*").alias("n"))
                 .where("n = 1").groupBy("at.o", "at.tie").agg(F.collect_list("at.start").alias("alone")))
        level = stage(open_.join(alone, ["o", "tie"], "left")
                      .select("o", "tie", "text", "spans", F.coalesce("alone", F.array().cast("array<int>")).alias("alone"))
                      .mapInArrow(_left_over(length), "o long, tie long, text string, spans array<int>"))
        reached = reached.unionByName(level.select("o", "tie", F.lit(length).cast("long").alias("longest")))
        open_ = level.where(F.size("spans") > 0)
    return reached.groupBy("o", "tie").agg(F.max("longest").alias("longest"))


def repeated_runs(docs: DataFrame, window: int = 20, texts: bool = False,
                  ladder: bool = False) -> tuple[DataFrame, DataFrame]:
    """Per row of ``docs`` its measures, and per text content what is removed from its first holder.

    First table: doc_id, o, k1, k2, n_words, n_anchors, sha. Second: k1, k2, first (smallest id), copied
    (whether several ids hold it), removed, sha_left (null where no window repeats) and, on demand,
    kept_text and longest (the last level that the content reaches, null where no window repeats).
    """
    if window < 2:
        raise ValueError("a window has two words at least")
    rows = identified(docs)
    heads = stage(rows.mapInArrow(
        _heads(window), "doc_id long, o long, k1 long, k2 long, n_words long, n_anchors long, sha string"))
    contents = heads.groupBy("k1", "k2").agg(F.min("o").alias("first"), (F.min("o") < F.max("o")).alias("copied"),
                                             F.first("n_anchors").alias("n_anchors"))
    counted = rows.select("k1", "text").mapInArrow(_anchors(window), "h long, k1 long, again boolean")
    sole = (counted.groupBy("h").agg(F.min("k1").alias("k1"), F.max("k1").alias("k_max"),
                                     F.max("again").alias("again"))
            .where((F.col("k1") == F.col("k_max")) & ~F.col("again"))
            .groupBy("k1").agg(F.collect_list("h").alias("sole")))
    # Different texts of one id, as damaged tables have them, are told apart by their fingerprint.
    shared = contents.groupBy("first").agg(F.count("*").alias("n")).where("n > 1").select(
        "first", F.lit(True).alias("shared"))
    lists = stage(contents.where("n_anchors > 0").join(shared, "first", "left").join(sole, "k1", "left")
             .where(F.coalesce(F.size("sole"), F.lit(0)) < F.col("n_anchors"))
             .select(F.col("first").alias("o"), F.when(F.col("shared"), F.col("k1")).otherwise(0).alias("tie"),
                     "k1", "k2", F.coalesce("sole", F.array().cast("array<long>")).alias("sole")))
    suspects = rows.drop("doc_id").join(lists, ["o", "k1", "k2"])
    # The ladder counts occurrences, so repeated rows of one id and text must be one row.
    suspects = stage(suspects.dropDuplicates(["o", "k1", "k2"]) if ladder else suspects)
    none = F.array().cast("array<int>")
    windows = (suspects.select("text", "sole", "o", "tie")
               .mapInArrow(_candidates(window), "a long, b int, o long, tie long, start int").groupBy("a", "b"))
    at = F.min(F.struct("o", "tie", "start")).alias("at")
    if ladder:
        firsts = stage(windows.agg(at, F.count("*").alias("n")).groupBy("at.o", "at.tie").agg(
            F.collect_list("at.start").alias("firsts"),
            F.collect_list(F.when(F.col("n") == 1, F.col("at.start"))).alias("alone")))
    else:
        firsts = windows.agg(at).groupBy("at.o", "at.tie").agg(F.collect_list("at.start").alias("firsts"))
    schema = "k1 long, k2 long, removed long, sha_left string" + (", kept_text string" if texts else "")
    found = suspects.join(firsts, ["o", "tie"], "left")
    given = ["text", "sole", "k1", "k2", F.coalesce("firsts", none).alias("firsts")]
    if ladder:
        given += ["o", "tie", F.coalesce("alone", none).alias("alone")]
        schema += ", o long, tie long, repeats boolean, text string, spans array<int>"
    changed = found.select(*given).mapInArrow(_removals(window, texts, ladder), schema)
    if ladder:
        changed = stage(changed)
        tops = _climb(changed.where("repeats").select("o", "tie", "text", "spans"), window)
        changed = changed.join(tops, ["o", "tie"], "left").drop("o", "tie", "repeats", "text", "spans")
    else:
        changed = stage(changed.dropDuplicates(["k1", "k2"]))
    return heads, contents.drop("n_anchors").join(changed, ["k1", "k2"], "left")


def substring_dedup(docs: DataFrame, window: int = 20) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256, longest_repeat per row of ``docs``.

    longest_repeat is the greatest length among window, 2 window, 4 window, ... at which some run of that many
    words of the document also occurs elsewhere, in it or in another document (0: not even a window does).
    """
    heads, contents = repeated_runs(docs, window, ladder=True)
    copy = (F.col("o") != F.col("first")) & (F.col("n_words") >= window)
    # All of a text that several ids hold repeats: the greatest level that fits into it.
    fits = F.expr(f"length(bin(n_words div {window})) - 1")
    whole = F.when(F.col("copied") & (F.col("n_words") >= window), F.lit(window) * F.pow(F.lit(2), fits).cast("long"))
    return heads.join(contents, ["k1", "k2"]).select(
        "doc_id", "n_words",
        F.when(copy, F.col("n_words")).otherwise(F.coalesce("removed", F.lit(0))).alias("n_removed"),
        F.when(copy, F.lit(EMPTY_SHA)).otherwise(F.coalesce("sha_left", "sha")).alias("kept_sha256"),
        F.coalesce(whole, F.col("longest"), F.lit(0)).cast("long").alias("longest_repeat"))


def without_repeats(docs: DataFrame, window: int = 20) -> DataFrame:
    """``docs`` with the repeated words cut out of the texts, all columns kept.

    A row of which nothing is left is dropped; n_chars, where there is such a column, follows the text.
    """
    _, contents = repeated_runs(docs, window, texts=True)
    named = docs.columns
    tagged = docs.select("*", order_id().alias("__o"), F.xxhash64("text").alias("__k1"),
                         F.xxhash64(F.lit(1), "text").alias("__k2"))
    joined = tagged.join(contents.select(
        F.col("k1").alias("__k1"), F.col("k2").alias("__k2"), F.col("first").alias("__first"),
        F.col("removed").alias("__removed"), F.col("kept_text").alias("__kept")), ["__k1", "__k2"])
    n_words = F.size(F.filter(F.split("text", "[ \t-\r]+"), lambda w: w != ""))
    copy = F.when(F.col("__o") != F.col("__first"), F.coalesce(n_words >= window, F.lit(False))).otherwise(F.lit(False))
    touched = F.coalesce(F.col("__removed"), F.lit(0)) > 0
    first = F.col("__o") == F.col("__first")
    joined = joined.where(~copy & ~(first & touched & (F.trim(F.col("__kept")) == "")))
    text = F.when(first & touched, F.col("__kept")).otherwise(F.col("text"))
    columns = []
    for c in named:
        if c == "text":
            columns.append(text.alias(c))
        elif c == "n_chars":
            columns.append(F.when(first & touched, F.length("__kept").cast(docs.schema[c].dataType))
                           .otherwise(F.col(c)).alias(c))
        else:
            columns.append(F.col(f"`{c}`"))
    return joined.select(*columns)


def op1_substring_dedup(spark, sf_dir):
    """Words of every document covered by a window of 20 words that also starts earlier."""
    return substring_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"), 20)
