"""Secret scans: fixed patterns, and character Markov models compared by log-likelihood ratio.

Two first-order models over the characters of ALPHABET are trained from labelled samples: random strings
(label 1) and ordinary identifiers (label 0). A run of 16 characters or more whose ratio, summed and per
step, is high is taken for a secret. Ratios are whole thousandths, so sums do not depend on their order.

All of it is DataFrame functions. Counting combines before the shuffle, and the model is a table of
LETTERS x LETTERS numbers at any size of the corpus. Spans are in code points, the end excluded.

Defined cases: null or empty text has no span; repeated rows are scanned each; other columns are ignored
or, in ``masked``, kept; without samples of a class the models are equal and add nothing, with a warning.
"""

from __future__ import annotations

import math
import string
import warnings

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from choicemill.llm.common import drawn

# The patterns of the base kinds.
ASSIGN = r"((?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
KINDS = ("assign", "access", "hex", "markov")
ALPHABET = string.ascii_letters + string.digits + "+/_=-"
RUN = r"[A-Za-z0-9+/_=\-]{16,}"
PLAIN = r"[A-Za-z][A-Za-z_\-]{7,}"
SAMPLE_ROWS = 20_000  # expected number of documents from which samples are taken
SMOOTHING = 0.5
BACKOFF = 5.0  # pairs that the single characters' frequencies count for
STEP, TOTAL = 400, 8_000  # least thousandths of a nat per step and in all


def _spans(text: Column, pattern: str, kind: str, least: int = 0, group: int = 0) -> Column:
    """kind, start, end and value of all matches whose group has ``least`` characters, without nulls.

    Matches and the gaps between them alternate, which gives the places.
    """
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    value = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else whole
    gaps = F.split(text, pattern, -1)
    empty = F.array().cast("array<struct<kind:string,start:int,end:int,value:string>>")

    def step(s: Column, z: Column) -> Column:
        start = s["at"] + F.length(z["gap"])
        end = start + F.length(z["whole"])
        here = F.array(F.struct(F.lit(kind).alias("kind"), start.alias("start"), end.alias("end"), z["value"].alias("value")))
        return F.struct(end.alias("at"), F.concat(s["out"], F.when(F.length(z["value"]) >= least, here).otherwise(empty)).alias("out"))

    zipped = F.arrays_zip(whole.alias("whole"), value.alias("value"), F.slice(gaps, 1, F.size(whole)).alias("gap"))
    folded = F.aggregate(zipped, F.struct(F.lit(0).alias("at"), empty.alias("out")), step)
    return F.when(text.rlike(pattern), folded["out"]).otherwise(empty)


def base_spans(text: Column) -> Column:
    """All spans of the fixed patterns. Runs that are too short are left out by the pattern itself where
    that finds the same matches."""
    return F.concat(
        _spans(text, ASSIGN, "assign", 12, 2), _spans(text, ACCESS[:-1] + "{14,}", "access"),
        _spans(text, HEX[:-1] + "{16,}", "hex"))


def samples(docs: DataFrame, rows: int = SAMPLE_ROWS) -> DataFrame:
    """value, label from a hash sample of about ``rows`` documents: what the fixed patterns find, and
    words of eight letters or more."""
    share = min(1.0, rows / max(1, docs.count()))
    some = docs.where(drawn(share, "doc_id", "text"))
    text = F.coalesce(F.col("text"), F.lit(""))
    found = F.transform(base_spans(text), lambda s: F.struct(
        F.regexp_extract(s["value"], r"([A-Za-z0-9+/_=\-]+)[^A-Za-z0-9+/_=\-]*$", 1).alias("value"), F.lit(1).alias("label")))
    # One word in eight by its own hash is plenty; words are the same in all sizes of the corpus.
    words = F.transform(
        F.filter(F.array_distinct(F.regexp_extract_all(text, F.lit(PLAIN), F.lit(0))), lambda w: F.pmod(F.xxhash64(w), F.lit(8)) == 0),
        lambda w: F.struct(w.alias("value"), F.lit(0).alias("label")))
    return some.select(F.explode(F.concat(found, words)).alias("s")).select("s.value", "s.label")


def train(labelled: DataFrame) -> list[int]:
    """Thousandths of log(p(next | char, random) / p(next | char, ordinary)) for all pairs in ALPHABET order."""
    pairs = labelled.where(F.length("value") > 1).select("label", F.explode(F.transform(
        F.sequence(F.lit(1), F.length("value") - 1), lambda i: F.substring("value", i, F.lit(2)))).alias("pair"))
    n = len(ALPHABET)
    counts = {0: {}, 1: {}}
    # At most two rows for each pair of the alphabet.
    allowed = pairs.where(F.col("pair").rlike(r"^[A-Za-z0-9+/_=\-]{2}$") & F.col("label").isin(0, 1))
    for label, pair, k in allowed.groupBy("label", "pair").agg(F.count("*").alias("k")).collect():
        counts[label][pair] = k
    if lacking := [c for c in (0, 1) if not counts[c]]:
        warnings.warn(f"no labelled samples of class {lacking}: the Markov models add no span", stacklevel=2)
        return [0] * n * n
    # A pair's frequency is drawn towards that of its second character, so characters that ordinary
    # identifiers do not use count against them after any other.
    single, total = [], []
    for c in (0, 1):
        after = {b: sum(counts[c].get(a + b, 0) for a in ALPHABET) for b in ALPHABET}
        every = sum(after.values()) + SMOOTHING * n
        single.append({b: (after[b] + SMOOTHING) / every for b in ALPHABET})
        total.append({a: sum(counts[c].get(a + b, 0) for b in ALPHABET) for a in ALPHABET})
    model = []
    for a in ALPHABET:
        for b in ALPHABET:
            p = [(counts[c].get(a + b, 0) + BACKOFF * single[c][b]) / (total[c][a] + BACKOFF) for c in (0, 1)]
            model.append(round(1000 * math.log(p[1] / p[0])))
    return model


def markov_score(value: Column, model: list[int]) -> Column:
    """Sum of the ratios along a string of ALPHABET."""
    # A cast of a constant is folded once in the plan; a lambda over it would run again at every character.
    table = F.split(F.lit(",".join(map(str, model))), ",").cast("array<int>")
    at = F.transform(F.split(value, ""), lambda c: F.instr(F.lit(ALPHABET), c))

    def step(s: Column, i: Column) -> Column:
        ratio = F.get(table, (s["last"] - 1) * len(ALPHABET) + i - 1)
        return F.struct(i.alias("last"), (s["sum"] + F.when((s["last"] > 0) & (i > 0), F.coalesce(ratio, F.lit(0))).otherwise(0)).alias("sum"))

    return F.aggregate(at, F.struct(F.lit(0).alias("last"), F.lit(0).alias("sum")), step)["sum"]


def scanned(docs: DataFrame, model: list[int]) -> DataFrame:
    """``docs`` with __text (never null), __base and __found: base spans, and all spans in order."""
    text = docs.withColumn("__text", F.coalesce(F.col("text"), F.lit("")))
    two = text.withColumn("__base", base_spans(F.col("__text"))).withColumn("__runs", _spans(F.col("__text"), RUN, "markov"))

    def secret(s: Column) -> Column:
        least = F.greatest(F.lit(TOTAL), STEP * (F.length(s["value"]) - 1))
        apart = ~F.exists("__base", lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"]))
        return apart & (markov_score(s["value"], model) >= least)

    found = F.concat("__base", F.filter("__runs", secret))
    return two.withColumn("__found", found).drop("__runs")


def listed(spans: Column) -> Column:
    """kind:start:end by start, then by kind as listed, joined by commas."""
    keyed = F.transform(spans, lambda s: F.struct(
        s["start"].alias("start"),
        F.array_position(F.array(*[F.lit(k) for k in KINDS]), s["kind"]).alias("kind"), s["end"].alias("end")))
    return F.array_join(F.transform(F.sort_array(keyed), lambda s: F.concat_ws(
        ":", F.element_at(F.array(*[F.lit(k) for k in KINDS]), s["kind"].cast("int")), s["start"].cast("string"), s["end"].cast("string"))), ",")


def secret_scan(docs: DataFrame, model: list[int] | None = None) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, n_markov, base_sha256, spans per row of ``docs``."""
    rows = docs.select("doc_id", "text")
    found = scanned(rows, model if model is not None else train(samples(rows)))

    def number(kind: str) -> Column:
        return F.size(F.filter("__found", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select("doc_id", *[number(k) for k in KINDS], F.sha2(listed(F.col("__base")).cast("binary"), 256).alias("base_sha256"),
                        listed(F.col("__found")).alias("spans"))


def masked(docs: DataFrame, model: list[int] | None = None, mark: str = "[secret]") -> DataFrame:
    """``docs`` with every secret in the text replaced by a mark, all columns kept."""
    found = scanned(docs, model if model is not None else train(samples(docs)))
    ordered = F.sort_array(F.transform("__found", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"))))

    def step(s: Column, x: Column) -> Column:
        gap = F.substring(F.col("__text"), s["at"] + 1, x["start"] - s["at"])
        return F.struct(F.greatest(s["at"], x["end"]).alias("at"), F.when(x["start"] >= s["at"], F.concat(
            s["out"], gap, F.lit(mark))).otherwise(s["out"]).alias("out"))

    folded = F.aggregate(ordered, F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), step)
    cut = found.withColumn("__cut", F.when(F.size("__found") > 0, folded))
    text = F.when(F.col("__cut").isNotNull(), F.concat(
        F.col("__cut.out"), F.substring(F.col("__text"), F.col("__cut.at") + 1, F.length("__text")))).otherwise(F.col("text"))
    columns = [text.alias("text") if c == "text" else
               F.when(F.col("__cut").isNotNull(), F.length(text).cast(docs.schema[c].dataType)).otherwise(F.col(c)).alias(c)
               if c == "n_chars" else F.col(f"`{c}`") for c in docs.columns]
    return cut.select(*columns)


def op7_secret_scan(spark, sf_dir):
    """Secrets in every document, by pattern and by Markov models trained here."""
    return secret_scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
