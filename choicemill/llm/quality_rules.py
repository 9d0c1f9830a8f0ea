"""Quality rules as a bitmask ledger, in DataFrame functions alone.

Every rule is evaluated once per document: its measurement is stored, and a failure sets the rule's bit.
The ledger is written to the shared folder; verdicts and ablations read it and not the texts.
A policy is a version, a set of required rules (a mask) and nothing else, so deciding again under another
version is ``failures & mask = 0`` over the ledger. Ablations come from the counts per distinct bitmask, of
which there are at most 2 to the number of rules: a document hangs on one rule alone where its bitmask
within the policy is that rule's bit.

Defined cases: null or blank text has no words and fails ``few_words``; repeated rows are judged each;
other columns are ignored; a null id is carried through.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from choicemill.llm.common import stage

BLANKS = r"[ \t-\r]"
# Fixed value: the characters that count as symbols.
SYMBOLS = "[#*$%&|<>]"
SPAN = 5


@dataclass(frozen=True)
class Rule:
    """``fails`` is a condition over the ledger's measurements."""

    name: str
    fails: str


# Bit i belongs to the i-th rule; new rules are appended, so stored ledgers stay readable.
RULES = (
    Rule("few_words", "n_words < 10"),
    Rule("repeated_words", "100 * n_repeat_words > 20 * n_words"),
    Rule("symbols", "10 * n_symbols > n_words * 3"),
    Rule("duplicate_lines", "10 * n_dup_lines > 3 * n_lines"),
    Rule("word_length", "word_chars < 2 * n_words or word_chars > 20 * n_words"),
)


@dataclass(frozen=True)
class Policy:
    version: str
    rules: tuple[str, ...]

    def mask(self, rules: tuple[Rule, ...] = RULES) -> int:
        names = [r.name for r in rules]
        return sum(1 << names.index(n) for n in self.rules)


BASE = Policy("base", ("few_words", "repeated_words"))
CURRENT = Policy("v1", tuple(r.name for r in RULES))


def shifted(array: Column, by: int) -> Column:
    return F.slice(array, by + 1, F.greatest(F.size(array) - by, F.lit(0)))


def measured(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words.

    Steps are projections of one row: fingerprints of words, of runs of five words, then places of
    runs found more than once. Nothing is exploded or shuffled. Texts without a repeated run, most of
    all, skip the sorting.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^ \t-\r]"))
    first = docs.select(
        "doc_id", text.alias("text"),
        F.transform(F.filter(F.split(text, BLANKS + "+"), lambda w: w != ""), lambda w: F.xxhash64(w)).alias("w"),
        lines.alias("lines"))
    second = first.select(
        "doc_id", F.size("w").cast("long").alias("n_words"),
        (F.length("text") - F.regexp_count("text", F.lit(BLANKS))).cast("long").alias("word_chars"),
        F.regexp_count("text", F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.slice(F.transform(F.arrays_zip("w", *[shifted(F.col("w"), i).alias(f"w{i}") for i in range(1, SPAN)]),
                            lambda z: F.xxhash64(z)),
                1, F.greatest(F.size("w") - (SPAN - 1), F.lit(0))).alias("runs"))
    third = second.withColumn("sorted", F.when(
        F.size(F.array_distinct("runs")) < F.size("runs"),
        F.sort_array(F.arrays_zip(F.col("runs").alias("run"), F.sequence(F.lit(1), F.size("runs")).alias("at"))))).drop("runs")
    # A run is repeated when the one before or after it in the sorted order is equal.
    keys = F.transform("sorted", lambda z: z["run"])
    fourth = third.select("*", keys.alias("k"))
    around = F.arrays_zip(
        F.col("sorted").alias("one"),
        F.concat(F.array(F.lit(None).cast("long")), F.col("k")).alias("before"), shifted(F.col("k"), 1).alias("after"))
    fifth = fourth.select(
        "*", F.sort_array(F.transform(
            F.filter(around, lambda z: F.coalesce((z["one"]["run"] == z["before"]) | (z["one"]["run"] == z["after"]),
                                                  F.lit(False))),
            lambda z: z["one"]["at"])).alias("places")).drop("sorted", "k")
    # Each repeated run covers five words, or as many as lie before the next one.
    covered = F.aggregate(
        F.arrays_zip(F.col("places").alias("at"), shifted(F.col("places"), 1).alias("then")), F.lit(0).cast("long"),
        lambda n, z: n + F.least(F.lit(SPAN), F.coalesce(z["then"] - z["at"], F.lit(SPAN))))
    return fifth.select("doc_id", "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines",
                        F.coalesce(covered, F.lit(0)).alias("n_repeat_words"))


def ledger(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The measurements and ``failures``, a long with a bit per failed rule."""
    bits = F.lit(0).cast("long")
    for i, rule in enumerate(rules):
        bits = bits.bitwiseOR(F.when(F.expr(rule.fails), F.lit(1 << i)).otherwise(F.lit(0)).cast("long"))
    return measured(docs).withColumn("failures", bits)


def stored(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The ledger, written and read again: some 60 bytes a document."""
    return stage(ledger(docs, rules))


def fails(policy: Policy, rules: tuple[Rule, ...] = RULES) -> Column:
    """Whether a ledger row fails a policy."""
    return F.col("failures").bitwiseAND(F.lit(policy.mask(rules))) != 0


def only_rule(policy: Policy, rules: tuple[Rule, ...] = RULES) -> Column:
    """The rule that alone keeps a ledger row from passing a policy, null where none or several do."""
    failed = F.col("failures").bitwiseAND(F.lit(policy.mask(rules)))
    names = [r.name for r in rules]
    return F.coalesce(*[F.when(failed == (1 << names.index(n)), F.lit(n)) for n in policy.rules])


def ablation(entries: DataFrame, policies: tuple[Policy, ...], rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """version, rule, n_docs, n_kept, n_failing (the rule), n_only (kept if just this rule were left out),
    from the counts per bitmask."""
    masks = entries.groupBy("failures").agg(F.count("*").alias("n"))
    grid = F.array(*[F.struct(F.lit(p.version).alias("version"), F.lit(p.mask(rules)).cast("long").alias("mask"),
                              F.lit(n).alias("rule"), F.lit(1 << [r.name for r in rules].index(n)).cast("long").alias("bit"))
                     for p in policies for n in p.rules])
    failed = F.col("failures").bitwiseAND(F.col("g.mask"))
    return masks.select("failures", "n", F.explode(grid).alias("g")).groupBy("g.version", "g.rule").agg(
        F.sum("n").alias("n_docs"), F.sum(F.when(failed == 0, F.col("n")).otherwise(0)).alias("n_kept"),
        F.sum(F.when(failed.bitwiseAND(F.col("g.bit")) != 0, F.col("n")).otherwise(0)).alias("n_failing"),
        F.sum(F.when(failed == F.col("g.bit"), F.col("n")).otherwise(0)).alias("n_only"))


def op3_quality_rules(spark, sf_dir):
    """Measurements, failure bits and verdicts of every document, decided from the stored ledger."""
    entries = stored(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return entries.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                          "failures", fails(BASE).alias("base_failed"), (~fails(CURRENT)).alias("kept"),
                          only_rule(CURRENT).alias("only_rule"))


def quality_rule_ablation(spark, sf_dir):
    """What each rule of each policy rejects, alone and at all, over all documents, from the stored ledger."""
    return ablation(stored(spark.read.parquet(f"{sf_dir}/documents.parquet")), (BASE, CURRENT))


LEDGER_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT r, list_filter(string_split_regex(text, '[ \t-\r]+'), lambda x: x <> '') AS w,
             list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^ \t-\r]')) AS l FROM d),
g AS (SELECT r, i, array_to_string(w[i : i + 4], ' ') AS run
      FROM (SELECT r, w, unnest(range(1, len(w) - 3)) AS i FROM w)),
p AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, run) AS n FROM g) WHERE n > 1),
c AS (SELECT r, sum(least(5, coalesce(nxt - i, 5))) AS n
      FROM (SELECT r, i, lead(i) OVER (PARTITION BY r ORDER BY i) AS nxt FROM p) GROUP BY r),
m AS (SELECT d.doc_id, len(w.w)::BIGINT AS n_words,
             length(regexp_replace(d.text, '[ \t-\r]', '', 'g'))::BIGINT AS word_chars,
             (length(d.text) - length(regexp_replace(d.text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
             len(w.l)::BIGINT AS n_lines, (len(w.l) - len(list_distinct(w.l)))::BIGINT AS n_dup_lines,
             coalesce(c.n, 0)::BIGINT AS n_repeat_words
      FROM d JOIN w USING (r) LEFT JOIN c USING (r)),
f AS (SELECT *, (CASE WHEN n_words < 10 THEN 1 ELSE 0 END + CASE WHEN 100 * n_repeat_words > 20 * n_words THEN 2 ELSE 0 END
  + CASE WHEN 10 * n_symbols > n_words * 3 THEN 4 ELSE 0 END + CASE WHEN 10 * n_dup_lines > 3 * n_lines THEN 8 ELSE 0 END
  + CASE WHEN word_chars < 2 * n_words OR word_chars > 20 * n_words THEN 16 ELSE 0 END)::BIGINT AS failures FROM m)
"""

ORACLE = LEDGER_SQL + r"""
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, failures,
       (failures & 3) <> 0 AS base_failed, failures = 0 AS kept,
       CASE failures WHEN 1 THEN 'few_words' WHEN 2 THEN 'repeated_words' WHEN 4 THEN 'symbols'
                     WHEN 8 THEN 'duplicate_lines' WHEN 16 THEN 'word_length' END AS only_rule FROM f
"""

ABLATION_ORACLE = LEDGER_SQL + r""",
p2 AS (SELECT 'base' AS version, 3 AS mask, rule, bit FROM (VALUES ('few_words', 1), ('repeated_words', 2)) t(rule, bit)
       UNION ALL SELECT 'v1', 31, rule, bit
       FROM (VALUES ('few_words', 1), ('repeated_words', 2), ('symbols', 4), ('duplicate_lines', 8), ('word_length', 16)) t(rule, bit))
SELECT version, rule, count(*)::BIGINT AS n_docs, count(*) FILTER (WHERE failures & mask = 0)::BIGINT AS n_kept,
       count(*) FILTER (WHERE failures & bit <> 0)::BIGINT AS n_failing,
       count(*) FILTER (WHERE failures & mask = bit)::BIGINT AS n_only
FROM f, p2 GROUP BY version, rule
"""
