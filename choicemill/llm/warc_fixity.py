"""Merkle fixity audit of WARC replicas.

Records of an archive are ordered by offset. A leaf is the hash of a record's offset, length and SHA-256;
a node covers FAN neighbouring nodes, hence an offset range, and hashes their hashes in order; the root
covers the archive. Two replicas are compared from the roots down, and only the children of nodes that
differ are looked at, until the damaged records are found.

Hashing a record needs no shuffle; trees are built from its digest, length and offset alone, by groups of
FAN rows at most. An archive holds RECORDS records on average, so its offsets are one short running sum.

Defined cases: null url or html count as empty; a null page_id goes to archive 0 and sorts last; repeated
rows are records each; a record or archive that only one replica has is reported; an empty table gives no row.
In files, damaged headers and cut records are records that are not intact; an empty file has none.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from choicemill.llm.common import stage

FAN = 16
RECORDS = 1024


def record(url: Column, html: Column) -> Column:
    """A resource record as text."""
    body = F.coalesce(html, F.lit(""))
    return F.concat(F.lit("WARC/1.1\r\nWARC-Type: resource\r\nWARC-Target-URI: "), F.coalesce(url, F.lit("")),
                    F.lit("\r\nContent-Length: "), F.octet_length(body).cast("string"), F.lit("\r\n\r\n"), body, F.lit("\r\n\r\n"))


def scan(content: bytes) -> list[tuple[int, int, bool]]:
    """(offset, length, intact) of the records of an uncompressed WARC file, without gaps.

    A stretch that starts with no readable header, or whose stated length does not end at a record's end, is
    one record that is not intact; it reaches to the next place that looks like a record's start.
    """
    out, at = [], 0
    while at < len(content):
        head = content.find(b"\r\n\r\n", at)
        said = None
        if head >= 0 and content.startswith(b"WARC/", at):
            said = re.search(rb"(?i)\r\nContent-Length: *(\d{1,18})\r\n", content[at: head + 2])
        stop = head + 4 + int(said[1]) + 4 if said else 0
        intact = bool(said) and content[stop - 4: stop] == b"\r\n\r\n"
        if not intact:
            start = content.find(b"\r\n\r\nWARC/", at + 1)
            stop = start + 4 if start >= 0 else len(content)
        out.append((at, stop - at, intact))
        at = stop
    return out


def parse(content: bytes) -> list[tuple[int, int]]:
    """(offset, length) of the records of an uncompressed WARC file, damaged ones included."""
    return [(at, size) for at, size, _ in scan(content)]


def records_of_files(spark: SparkSession, path: str) -> DataFrame:
    """archive (path), offset, length, sha256 and intact of the records of WARC files; one task reads one file."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib
        schema = pa.schema([("archive", pa.string()), ("offset", pa.int64()), ("length", pa.int64()),
                            ("sha256", pa.string()), ("intact", pa.bool_())])
        for b in batches:
            for name, content in zip(b.column("path").to_pylist(), b.column("content").to_pylist(), strict=True):
                yield pa.RecordBatch.from_pylist([
                    {"archive": name, "offset": o, "length": n, "intact": whole,
                     "sha256": hashlib.sha256(content[o: o + n]).hexdigest()} for o, n, whole in scan(content)], schema)
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(run, "archive string, offset long, length long, sha256 string, intact boolean")


def leaves(records: DataFrame) -> DataFrame:
    """archive, i, offset, length, digest, in the order of offsets, from archive, offset, length, sha256."""
    place = F.row_number().over(Window.partitionBy("archive").orderBy("offset")) - 1
    return records.withColumn("i", place.cast("long")).withColumn(
        "digest", F.sha2(F.concat_ws(":", F.col("offset").cast("string"), F.col("length").cast("string"), "sha256").cast("binary"), 256))


def levels(leaf: DataFrame) -> list[DataFrame]:
    """Nodes (archive, i, digest) of every level, leaves first, up to one root an archive."""
    out = [leaf.select("archive", "i", "digest")]
    most = leaf.agg(F.max("i")).first()[0] or 0
    while most:
        children = F.array_sort(F.collect_list(F.struct("i", "digest")))
        out.append(stage(out[-1].groupBy("archive", F.floor(F.col("i") / FAN).alias("parent")).agg(children.alias("c")).select(
            "archive", F.col("parent").alias("i"),
            F.sha2(F.array_join(F.transform("c", lambda x: x["digest"]), "").cast("binary"), 256).alias("digest"))))
        most //= FAN
    return out


def audit(left: DataFrame, right: DataFrame) -> DataFrame:
    """archive, i of the leaves that differ between two tables of ``leaves``."""
    a, b = levels(left), levels(right)
    height = max(len(a), len(b))

    def level(tree: list[DataFrame], n: int) -> DataFrame:
        # A lower tree has its root as the first child all the way up.
        return tree[min(n, len(tree) - 1)]

    suspects: DataFrame | None = None
    for n in range(height - 1, -1, -1):
        x, y = level(a, n), level(b, n).withColumnRenamed("digest", "other")
        if suspects is not None:
            near = suspects.select("archive", F.col("i").alias("parent"))
            x, y = (t.withColumn("parent", F.floor(F.col("i") / FAN)).join(near, ["archive", "parent"], "left_semi").drop("parent")
                    for t in (x, y))
        suspects = x.join(y, ["archive", "i"], "full").where(~F.col("digest").eqNullSafe(F.col("other"))).select("archive", "i")
        suspects = stage(suspects)
    return suspects


def archived(pages: DataFrame, damaged: Column | None = None) -> DataFrame:
    """archive, page_id, offset, length, sha256 of the pages as records; ``damaged`` ones have one wrong
    character in their first line, as a replica with bit rot might."""
    archives = max(1, -(-pages.count() // RECORDS))
    text = record(F.col("url"), F.col("html"))
    if damaged is not None:
        text = F.when(damaged, F.regexp_replace(text, "^WARC", "WARX")).otherwise(text)
    rows = pages.select(
        "page_id", "url", F.coalesce(F.pmod(F.col("page_id"), F.lit(archives)), F.lit(0)).cast("long").alias("archive"),
        F.octet_length(text).cast("long").alias("length"), F.sha2(text.cast("binary"), 256).alias("sha256"),
        F.sha2(record(F.col("url"), F.col("html")).cast("binary"), 256).alias("o"))
    before = Window.partitionBy("archive").orderBy(F.col("page_id").asc_nulls_last(), F.col("url").asc_nulls_last(), "o")
    return stage(rows.withColumn("offset", F.sum("length").over(before.rowsBetween(Window.unboundedPreceding, -1)))
                 .select("archive", "page_id", F.coalesce("offset", F.lit(0)).alias("offset"), "length", "sha256"))


def op5_warc_fixity(spark, sf_dir):
    """All pages as records of archives, and which of them a replica with planted bit rot (page_id divisible
    by 97) has damaged, as the audit finds it."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    first = stage(leaves(archived(pages)))
    second = stage(leaves(archived(pages, F.coalesce(F.col("page_id") % 97 == 0, F.lit(False)))))
    found = audit(first, second).withColumn("damaged", F.lit(True))
    return first.join(found, ["archive", "i"], "left").select(
        "page_id", "archive", "i", "offset", "length", "sha256", F.coalesce("damaged", F.lit(False)).alias("damaged"))


ORACLE = r"""
WITH n AS (SELECT greatest(1, ceil(count(*) / 1024.0))::BIGINT AS n FROM pages),
r AS (SELECT page_id, url, coalesce(page_id % n.n, 0)::BIGINT AS archive,
             'WARC/1.1' || chr(13) || chr(10) || 'WARC-Type: resource' || chr(13) || chr(10) || 'WARC-Target-URI: ' || coalesce(url, '')
             || chr(13) || chr(10) || 'Content-Length: ' || strlen(coalesce(html, '')) || chr(13) || chr(10) || chr(13) || chr(10)
             || coalesce(html, '') || chr(13) || chr(10) || chr(13) || chr(10) AS t FROM pages, n),
d AS (SELECT page_id, url, archive, strlen(t)::BIGINT AS length, sha256(t) AS sha256 FROM r)
SELECT page_id, archive, (row_number() OVER w - 1)::BIGINT AS i,
       coalesce(sum(length) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS "offset",
       length, sha256, coalesce(page_id % 97 = 0, false) AS damaged
FROM d WINDOW w AS (PARTITION BY archive ORDER BY page_id, url, sha256)
"""
