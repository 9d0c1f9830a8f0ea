"""Near-duplicate groups by MinHash bands, odd sketches and exact confirmation.

1. Each text becomes its set of 5-word shingles. MinHash samples of the set give band keys; texts with
   equal sets are one *class* from here on, so copies cost one row each.
2. Samples are folded into an odd sketch: a bitmap in which every (function, minimum) flips one bit.
   The bits in which two sketches differ estimate the sets' symmetric difference, most precisely
   where sets are similar.
3. Classes with a band key in common are candidates. First round: each class against the smallest class
   of its buckets only, confirmed on full sets; most groups of near copies join here with a row a class.
   Second round: buckets that still hold several components, one of those with equal members, bring the full
   sets of their classes together in blocks of BLOCK_BYTES. Within a block, pairs of different components
   that sizes and sketches let pass are decided on the full sets, and a link joins its components at once.
   So only confirmed links that join two components leave a block: fewer than it has members.
4. Components of confirmed links, named by their smallest document.

With 48 bands of 5 samples, two sets at similarity 0.75 share no band with probability 2e-6, and less
above. A sketch estimate must reach 0.55 to go on, 5 standard errors below the threshold.

Defined cases: null, empty and blank texts have empty sets, linked with nothing, and are kept; rows with
equal id and equal text are one document, rows with equal id and different texts have a set each and are
told apart by the fingerprints of their texts; a null id sorts last and names no document, so of equal rows
with a null id one is kept. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from choicemill.llm.common import (
    Words,
    identified,
    list_array,
    mixed,
    order_id,
    ranges,
    signed,
    slices,
    stage,
    stream,
)
from choicemill.llm.graph import components

SHINGLE = 5
BANDS = 48
ROWS = 5
BITS = 1024
BLOCK_BYTES = 16 << 20  # full sets of a bucket that form one side of a comparison


def shingles(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints of all shingles, text after text, and their number in each text."""
    runs, whole = words.runs(SHINGLE)
    counts = np.diff(words.bounds)
    lone = np.flatnonzero((counts > 0) & (counts < SHINGLE))
    for t in lone:
        s, e = words.bounds[t], words.bounds[t + 1]
        runs[s] = mixed(np.array([(words.hashes[s:e] * stream(e - s, 6)).sum() + np.uint64(e - s)]))[0]
        whole[s] = True
    number = np.where(counts >= SHINGLE, counts - SHINGLE + 1, np.minimum(counts, 1))
    return runs[whole], number


def sketches(minima: np.ndarray) -> np.ndarray:
    """Odd sketches of samples (function x text): one row of BITS / 8 bytes a text."""
    functions, texts = minima.shape
    flips = mixed(minima.astype(np.uint64) + (np.arange(functions, dtype=np.uint64)[:, None] << np.uint64(32)))
    at = (flips % np.uint64(BITS)).astype(np.int64) + np.arange(texts) * BITS
    odd = np.bincount(at.ravel(), minlength=texts * BITS).reshape(texts, BITS) & 1
    return np.packbits(odd.astype(np.uint8), axis=1)


def similarity(different_bits: np.ndarray) -> np.ndarray:
    """Estimated Jaccard similarity from the number of bits in which two sketches differ."""
    share = np.minimum(2.0 * different_bits / BITS, 1 - 1e-9)
    return 1 + BITS / 2 * np.log(1 - share) / (2 * BANDS * ROWS)


def full_sets(texts: pa.Array) -> list[np.ndarray]:
    """The sorted shingle fingerprints of each text."""
    values, number = shingles(Words(texts, lower=True))
    ends = np.cumsum(number)
    return [np.unique(values[e - k: e]) for e, k in zip(ends, number, strict=True)]


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    n = BANDS * ROWS
    factors = (stream(n, 7) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
    shifts = (stream(n, 8) >> np.uint64(32)).astype(np.uint32)
    for b in slices(batches):
        values, number = shingles(Words(b.column("text"), lower=True))
        ends = np.cumsum(number)
        sets = [np.unique(values[e - k: e]) for e, k in zip(ends, number, strict=True)]
        size = np.array([len(s) for s in sets], np.int64)
        one = np.array([np.bitwise_xor.reduce(mixed(s)) if len(s) else 0 for s in sets], np.uint64)
        two = np.array([mixed(s + np.uint64(9)).sum() if len(s) else 0 for s in sets], np.uint64)
        some = np.flatnonzero(number)
        minima = np.zeros((n, len(some)), np.uint32)
        if len(some):
            short = (values >> np.uint64(32)).astype(np.uint32)
            starts = (ends - number)[some]
            for i in range(n):
                minima[i] = np.minimum.reduceat((short ^ shifts[i]) * factors[i], starts)
        keys = np.zeros((len(some), BANDS), np.uint64)
        for band in range(BANDS):
            mix = np.full(len(some), band + 1, np.uint64)
            for row in range(ROWS):
                mix = mixed(mix * np.uint64(31) + minima[band * ROWS + row])
            keys[:, band] = mix
        sketch = np.full(len(number), None, object)
        sketch[some] = [r.tobytes() for r in sketches(minima)] if len(some) else []
        yield pa.RecordBatch.from_arrays(
            [b.column("doc_id"), b.column("o"), b.column("k1"), b.column("k2"), pa.array(size), pa.array(signed(mixed(one + two))),
             list_array(signed(keys.ravel()), np.where(number > 0, BANDS, 0), pa.int64()),
             pa.array(sketch, pa.binary())],
            ["doc_id", "o", "k1", "k2", "n", "node", "keys", "sketch"])


def _confirm(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            linked = []
            for x, y in zip(full_sets(b.column("text_a")), full_sets(b.column("text")), strict=True):
                common = len(np.intersect1d(x, y, assume_unique=True))
                linked.append(100 * common >= percent * (len(x) + len(y) - common))
            yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b")], ["a", "b"]).filter(pa.array(linked))
    return run


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in slices(batches):
        yield pa.RecordBatch.from_arrays(
            [b.column("node"), pa.array([s.tobytes() for s in full_sets(b.column("text"))], pa.binary())], ["node", "elements"])


def joining_links(label, side, sketch, sets: list[np.ndarray], percent: int, floor: float) -> list[tuple[int, int]]:
    """Index pairs of members of a bucket that are links by their full sets and join two components.

    Pairs within a component, pairs whose sizes or sketches rule a link out and, where both sides are
    given, pairs of one side are passed over. Common elements of one member and all others are counted at
    once, through the members that hold each element.
    """
    n, size = len(sets), np.array([len(s) for s in sets])
    group = np.unique(label, return_inverse=True)[1]
    apart = len(np.unique(side)) > 1
    code = np.unique(np.concatenate(sets), return_inverse=True)[1]
    order = np.argsort(code, kind="stable")
    holder = np.repeat(np.arange(n), size)[order]
    bounds = np.searchsorted(code[order], np.arange(code.max() + 2))
    ends = np.cumsum(size)
    found: list[tuple[int, int]] = []
    for i in range(n - 1):
        j = i + 1 + np.flatnonzero(group[i + 1:] != group[i])
        if apart:
            j = j[side[j] != side[i]]
        small, large = np.minimum(size[i], size[j]), np.maximum(size[i], size[j])
        j = j[100 * small >= percent * large]
        j = j[similarity(np.bitwise_count(sketch[i] ^ sketch[j]).sum(axis=1)) >= floor] if len(j) else j
        if not len(j):
            continue
        own = code[ends[i] - size[i]: ends[i]]
        common = np.bincount(holder[ranges(bounds[own], bounds[own + 1])], minlength=n)[j]
        j = j[100 * common >= percent * (size[i] + size[j] - common)]
        if len(j):
            j = j[np.unique(group[j], return_index=True)[1]]
            found += zip([i] * len(j), j.tolist(), strict=True)
            group[np.isin(group, group[j])] = group[i]
    return found


def _join(percent: int, floor: float):
    def links(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        node, label, side = (rows.column(c).to_numpy() for c in ("node", "label", "own"))
        sketch = np.frombuffer(b"".join(rows.column("sketch").to_pylist()), np.uint64).reshape(len(node), -1)
        sets = [np.frombuffer(x, np.uint64) for x in rows.column("elements").to_pylist()]
        found = joining_links(label, side, sketch, sets, percent, floor)
        if found:
            i, j = np.array(found).T
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.minimum(node[i], node[j])), pa.array(np.maximum(node[i], node[j]))], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by bucket; one block of a bucket is held at a time."""
        held: list[pa.RecordBatch] = []
        last = None
        for b in batches:
            if not b.num_rows:
                continue
            key = b.column("key").to_numpy()
            tile = b.column("tile").to_numpy()
            cuts = np.flatnonzero((key[1:] != key[:-1]) | (tile[1:] != tile[:-1])) + 1
            for s, e in zip([0, *cuts], [*cuts, b.num_rows], strict=True):
                if last is not None and last != (key[s], tile[s]):
                    yield from links(pa.Table.from_batches(held))
                    held = []
                held.append(b.slice(s, e - s))
                last = (key[s], tile[s])
        if held:
            yield from links(pa.Table.from_batches(held))
    return run


def near_duplicate_groups(docs: DataFrame, percent: int = 75, floor: float = 0.55) -> DataFrame:
    """doc_id, n_shingles, component_id, kept per row of ``docs``.

    A row is kept if its id names its component; without an id, if it was chosen among equal rows.
    """
    named = F.coalesce(F.col("doc_id") == F.col("component_id"), F.when(F.col("doc_id").isNull(), F.col("first")), F.lit(False))
    return _verdicts(docs, percent, floor).select("doc_id", "n_shingles", "component_id", named.alias("kept"))


def _verdicts(docs: DataFrame, percent: int = 75, floor: float = 0.55) -> DataFrame:
    """doc_id, n_shingles, component_id and ``first`` (the row represents its group) per row, with the row's
    key none, o, k1, k2: whether it lacks an id, its id and its text's fingerprints."""
    rows = identified(docs)
    # Rows with a null id get a number each: equal ones are not one document.
    number = F.when(F.col("doc_id").isNull(), F.monotonically_increasing_id()).otherwise(F.lit(-1))
    heads = stage(rows.mapInArrow(
        _signatures, "doc_id long, o long, k1 long, k2 long, n long, node long, keys array<long>, sketch binary")
        .withColumn("u", number).withColumn("none", F.col("doc_id").isNull()))
    row = F.struct("none", "o", "k1", "k2", "u")
    classes = heads.where("n > 0").groupBy("node").agg(F.min(row).alias("name")).select("node", "name.o", "name")
    # One row stands for each class: the first document that has the set.
    chosen = heads.where("n > 0").join(classes, ["node", "o"]).dropDuplicates(["node"])
    keyed = chosen.select("node", "o", "n", F.explode("keys").alias("key"))
    shared = keyed.groupBy("key").agg(F.count("*").alias("members"), F.min(F.struct("o", "node")).alias("pivot"))
    members = stage(keyed.drop("o").join(shared.where("members > 1").drop("members"), "key"))
    pivots = (members.where("node != pivot.node").groupBy("node").agg(F.min("pivot").alias("pivot"))
              .select(F.col("pivot.node").alias("a"), F.col("node").alias("b")))
    texts = stage(_texts(rows, chosen, members))
    with_a = pivots.join(texts.select(F.col("node").alias("a"), F.col("text").alias("text_a")), "a")
    both = with_a.join(texts.withColumnRenamed("node", "b"), "b")
    links = stage(both.select("a", "b", "text_a", "text").mapInArrow(_confirm(percent), "a long, b long"))
    links = links.union(stage(_across(members, components(links), texts, chosen, percent, floor)))
    final = components(links, classes.select("node", "name")).withColumnRenamed("label", "head")
    named = classes.join(final, "node", "left").select("node", F.coalesce("head", "name").alias("head"))
    head = F.when(F.col("n") == 0, row).otherwise(F.col("head"))
    return heads.drop("keys", "sketch").join(named, "node", "left").select(
        "doc_id", "none", "o", "k1", "k2", F.col("n").alias("n_shingles"),
        F.when(~head["none"], head["o"]).alias("component_id"), (row == head).alias("first"))


def _across(members: DataFrame, labels: DataFrame, texts: DataFrame, chosen: DataFrame, percent: int, floor: float) -> DataFrame:
    """Confirmed links between components that meet in a bucket: fewer than a block has members."""
    labelled = members.join(labels, "node", "left").select("key", "node", "n", F.coalesce("label", "node").alias("label"))
    several = labelled.groupBy("key").agg(
        F.count("*").alias("members"), F.sum("n").alias("elements"), F.min("label").alias("low"), F.max("label").alias("high"),
        F.bit_xor(F.xxhash64("node")).alias("x"), F.bit_xor(F.xxhash64(F.lit(1), "node")).alias("y")).where("low != high")
    # Buckets with the same members hold the same pairs.
    once = several.groupBy("members", "x", "y").agg(F.min("key").alias("key"), F.first("elements").alias("elements"))
    tiles = F.ceil(8 * F.col("elements") / BLOCK_BYTES).cast("int").alias("tiles")
    own = F.pmod(F.xxhash64("node"), F.col("tiles")).cast("int")
    tile = F.greatest("own", "other").cast("long") * (1 << 31) + F.least("own", "other")
    blocks = stage(labelled.join(once.select("key", tiles), "key")
                   .select("key", "node", "label", own.alias("own"), F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("other"))
                   .select("key", "node", "label", "own", tile.alias("tile")))
    sets = texts.join(blocks.select("node").distinct(), "node").mapInArrow(_sets, "node long, elements binary")
    return (blocks.join(sets, "node").join(chosen.select("node", "sketch"), "node")
            .repartition("key", "tile").sortWithinPartitions("key", "tile")
            .mapInArrow(_join(percent, floor), "a long, b long"))


def _texts(rows: DataFrame, chosen: DataFrame, members: DataFrame) -> DataFrame:
    """node, text of the classes that share a bucket with another."""
    wanted = chosen.select("node", "o", "k1").join(members.select("node").distinct(), "node")
    # Equal rows, as null ids may have many, come once: a pair is confirmed by one row a side.
    return rows.select("o", "k1", "text").dropDuplicates(["o", "k1"]).join(wanted, ["o", "k1"]).select("node", "text")


def op2_minhash_dedup(spark, sf_dir):
    """Groups of documents linked by a shingle similarity of 0.75 or more, over all documents."""
    return near_duplicate_groups(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def without_near_copies(docs: DataFrame) -> DataFrame:
    """``docs`` with the first document of every group alone; a repeated row of it stays too if it has an id.

    Rows are judged by id and text together: neither an id that others have as well nor a null id drops a clean text.
    """
    key = ["__none", "__o", "__k1", "__k2"]
    gone = stage(_verdicts(docs).groupBy("none", "o", "k1", "k2").agg(F.max("first").alias("first")).where(~F.col("first"))
                 .select(*[F.col(c[2:]).alias(c) for c in key]))
    ours = {"__none": F.col("doc_id").isNull(), "__o": order_id(), "__k1": F.xxhash64("text"), "__k2": F.xxhash64(F.lit(1), "text")}
    left = docs.withColumns(ours).join(gone, key, "left_anti")
    # Of equal texts without an id one row stays; a text without words is no copy of another.
    nameless = F.col("doc_id").isNull() & F.coalesce(F.col("text").rlike("[^ \\t-\\r]"), F.lit(False))
    named = left.where(~nameless).drop(*key)
    once = (left.where(nameless).groupBy("__k1", "__k2")
            .agg(F.min(F.struct(*[F.col(f"`{c}`") for c in docs.columns])).alias("row")).select("row.*"))
    return named.unionByName(once)
