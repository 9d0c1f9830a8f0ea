"""The corpus pipeline: stages over documents, each written as Parquet and read again by the next.

Every stage works on all that the one before has kept, and its decisions take effect: rejected languages
go, one document of each group of near copies stays, repeated passages are cut, secrets are masked, and
what is left is packed into sequences. All stages but the last return the columns of documents.
"""

from __future__ import annotations

from choicemill.llm import ready
from choicemill.llm.common import stage
from choicemill.llm.language_id import recognised
from choicemill.llm.minhash_dedup import without_near_copies
from choicemill.llm.packing import packed
from choicemill.llm.secret_scan import masked
from choicemill.llm.substring_dedup import without_repeats


def language_id(spark, docs, sf_dir):
    ready(spark)
    return recognised(docs)


def near_dedup(spark, docs, sf_dir):
    ready(spark)
    return without_near_copies(docs)


def substring_dedup(spark, docs, sf_dir):
    ready(spark)
    return without_repeats(docs)


def secret_scan(spark, docs, sf_dir):
    ready(spark)
    return masked(docs)


def packing(spark, docs, sf_dir):
    ready(spark)
    return packed(docs)


STAGES = [("language_id", language_id), ("minhash_dedup", near_dedup), ("substring_dedup", substring_dedup),
          ("secret_scan", secret_scan), ("packing", packing)]

# Tokenisers and cost-ordered packing are beyond SQL.
ORACLE_SQL = None


def run(spark, sf_dir):
    """All stages over the documents of a folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
