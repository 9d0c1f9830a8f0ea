"""Equivalent SQL for every query, over the base tables only.

Shared steps are named fragments; ``sql`` puts the ones a statement needs in front of it.
"""

from __future__ import annotations

import re

from choicemill.functions.hashing import POISSON_STEPS
from choicemill.functions.text import LINE_END, SPACE
from choicemill.params import DEFAULT as P

M = P.candidates
K = P.k


def d(value: float) -> str:
    return f"CAST({value!r} AS DOUBLE)"


def r(expr: str, digits: int = 8) -> str:
    """Round half up after settling at 12 decimals, as the Spark side does."""
    return f"CAST(round(CAST({expr} AS DECIMAL(38,12)), {digits}) AS DOUBLE)"


def n(expr: str) -> str:
    return f"CAST({expr} AS BIGINT)"


def cnt(condition: str) -> str:
    return f"count(CASE WHEN {condition} THEN 1 END)"


def settle(expr: str) -> str:
    return f"CAST(CAST({expr} AS DECIMAL(38,12)) AS DOUBLE)"


def uniform(digest: str, lane: str = "0") -> str:
    return f"(CAST(('0x' || substr({digest}, 1 + 13 * ({lane}), 13)) AS BIGINT) / 4503599627370496.0::DOUBLE)"


def poisson(u: str) -> str:
    return "(" + " + ".join(f"CAST({u} >= {d(s)} AS INTEGER)" for s in POISSON_STEPS) + ")"


ORDER = "l_orderkey, l_linenumber, l_shipdate, l_extendedprice, l_suppkey, l_quantity, l_discount, l_tax"
ALPHAS = ", ".join(f"({i}, {d(a)})" for i, a in enumerate(P.alphas))
LAMBDAS = ", ".join(f"({d(x)})" for x in P.lambdas)
MODELS = ", ".join(f"('{m}', {i})" for i, m in enumerate(M))

FRAGMENTS: dict[str, str] = {
    "alphas": f"SELECT * FROM (VALUES {ALPHAS}) t(alpha_id, alpha)",
    "lambdas": f"SELECT * FROM (VALUES {LAMBDAS}) t(lam)",
    "models": f"SELECT * FROM (VALUES {MODELS}) t(model, ord)",
    "obs": f"""
      SELECT substr(sha256(dataset || '||' || category || '||' || question), 1, 16) AS query_id, * FROM (
        SELECT p_partkey, CASE WHEN p_type IN ('ECONOMY','PROMO') THEN 'd0' ELSE 'd1' END AS dataset,
          p_type AS category, CAST(p_partkey AS VARCHAR) || ' ' || p_name || ' ' || p_brand AS question,
          'm' || ord AS model, CAST(ord AS INTEGER) AS ord,
          CAST(l_returnflag <> 'R' AS INTEGER) AS correct,
          CASE WHEN l_discount = 0 THEN 0.0::DOUBLE ELSE l_extendedprice * (1.0::DOUBLE - l_discount) END AS raw_cost,
          l_quantity AS latency, CAST(p_size AS DOUBLE) AS p_size, p_retailprice,
          CAST(length(p_name) AS DOUBLE) AS name_length
        FROM (SELECT *, l_suppkey % {K} AS ord, row_number() OVER (
                PARTITION BY l_partkey, l_suppkey % {K} ORDER BY {ORDER}) AS rn FROM lineitem) f
        JOIN part ON p_partkey = l_partkey WHERE rn = 1)""",
    "complete": f"SELECT query_id FROM obs GROUP BY query_id HAVING count(*) = {K}",
    "queries": """SELECT DISTINCT query_id, dataset, category, question, p_partkey, p_size, p_retailprice, name_length
      FROM obs WHERE query_id IN (SELECT query_id FROM complete)""",
    "splits": f"""
      SELECT *, CASE WHEN rn <= floor(cn * {d(P.train_ratio)}) THEN 'train'
          WHEN rn <= floor(cn * {d(P.train_ratio)}) + floor(cn * {d(P.validation_ratio)}) THEN 'validation'
          ELSE 'test' END AS split
      FROM (SELECT *, row_number() OVER (PARTITION BY dataset, category
                ORDER BY sha256('{P.seed}||' || query_id)) AS rn,
              count(*) OVER (PARTITION BY dataset, category) AS cn FROM queries)""",
    "sobs": "SELECT o.*, s.split FROM obs o JOIN splits s USING (query_id)",
    "medians": """SELECT dataset, model, quantile_cont(raw_cost, 0.5) AS median_cost FROM sobs
      WHERE split = 'train' AND raw_cost > 0 GROUP BY dataset, model""",
    "cleaned": """SELECT s.*, CAST(raw_cost <= 0 AS INTEGER) AS cost_imputed,
        CASE WHEN raw_cost > 0 THEN raw_cost ELSE median_cost END AS cost_clean
      FROM sobs s LEFT JOIN medians m USING (dataset, model)""",
    "crange": f"""SELECT clip_threshold, least(lo, clip_threshold) AS lo, least(hi, clip_threshold) AS hi FROM (
        SELECT quantile_cont(cost_clean, {P.clip_percentile}) AS clip_threshold, min(cost_clean) AS lo,
          max(cost_clean) AS hi FROM cleaned WHERE split = 'train')""",
    "scaled": """SELECT c.*, least(cost_clean, clip_threshold) AS cost_clipped,
        CAST(cost_clean > clip_threshold AS INTEGER) AS cost_winsorized,
        CASE WHEN hi - lo = 0 THEN 0.0::DOUBLE
          ELSE (least(cost_clean, clip_threshold) - lo) / (hi - lo) END AS scaled_cost
      FROM cleaned c, crange""",
    "core": """SELECT *, greatest(0.0::DOUBLE, least(1.0::DOUBLE, scaled_cost)) AS normalized_cost,
        CAST(greatest(0.0::DOUBLE, least(1.0::DOUBLE, scaled_cost)) <> scaled_cost AS INTEGER) AS normalization_clipped
      FROM scaled""",
    "ua": """SELECT c.*, alpha_id, alpha, round(correct - alpha * normalized_cost, 6) AS utility
      FROM core c, alphas""",
    "oracle": """SELECT query_id, alpha, max(utility) AS oracle_utility, arg_max(model, (utility, -ord)) AS oracle_model
      FROM ua GROUP BY query_id, alpha""",
    "uo": "SELECT * FROM ua JOIN oracle USING (query_id, alpha)",
}


def sql(statement: str, **extra: str) -> str:
    """Prefix a statement with the fragments it uses, in dependency order."""
    known = {**FRAGMENTS, **extra}
    order: list[str] = []

    def need(text: str) -> None:
        for name in known:
            if name not in order and re.search(rf"\b(?:FROM|JOIN|,)\s+{name}\b", text):
                need(known[name])
                if name not in order:
                    order.append(name)

    need(statement)
    if not order:
        return statement
    ctes = ",\n".join(f"{name} AS MATERIALIZED ({known[name]})" for name in order)
    return f"WITH {ctes}\n{statement}"


def metrics(counts: bool = True, model: str = "model", regret: str = "oracle_utility - utility") -> str:
    text = f"""count(*) AS n_queries, {r('avg(correct)')} AS accuracy, {r('avg(cost_clean)')} AS avg_cost,
      {r('avg(latency)')} AS avg_latency, {r('avg(utility)')} AS mean_utility,
      {r('avg(oracle_utility)')} AS oracle_utility, {r(f'avg({regret})')} AS mean_regret"""
    if counts:
        text += "".join(f", {cnt(f'''{model} = '{m}' ''')} AS selected_{m}" for m in M)
    return text


ORACLES: dict[str, str] = {}


def oracle(name: str, statement: str, **extra: str) -> None:
    ORACLES[name] = sql(statement, **extra)


# ------------------------------------------------------------ splits, conditioning, utility
oracle("observations", """SELECT query_id, dataset, category, question, model, ord, correct, raw_cost, latency FROM obs""")
oracle("query_splits", "SELECT query_id, dataset, category, question, split FROM splits")
oracle("query_splits_scaled", "SELECT query_id, dataset, category, question, split FROM splits")
oracle("split_counts", "SELECT split, count(*) AS n_queries FROM splits GROUP BY split")
oracle("split_stratum_sizes", """SELECT dataset, category, count(*) AS n_queries,
    count(CASE WHEN split = 'train' THEN 1 END) AS n_train,
    count(CASE WHEN split = 'validation' THEN 1 END) AS n_validation,
    count(CASE WHEN split = 'test' THEN 1 END) AS n_test FROM splits GROUP BY dataset, category""")
_UTILS = ", ".join(f"max(CASE WHEN alpha_id = {i} THEN utility END) AS utility_{i}" for i in range(len(P.alphas)))
oracle("utility_table", f"""SELECT query_id, dataset, category, split, model, correct, latency,
    round(raw_cost, 8) AS raw_cost, cost_imputed, round(cost_clean, 8) AS cost_clean, cost_winsorized,
    round(cost_clipped, 8) AS cost_clipped, round(normalized_cost, 6) AS normalized_cost, normalization_clipped,
    {_UTILS} FROM ua GROUP BY ALL""")
_PARAMS = f"""SELECT 'median__' || dataset || '__' || model AS name, {r('median_cost')} AS value FROM medians
    UNION ALL SELECT 'clip_threshold', {r('clip_threshold')} FROM crange
    UNION ALL SELECT 'normalization_min', {r('lo')} FROM crange
    UNION ALL SELECT 'normalization_max', {r('hi')} FROM crange"""
oracle("cost_parameters", _PARAMS)
oracle("cost_parameters_scaled", _PARAMS)

# ------------------------------------------------------------ baselines
_FIXED = f"SELECT alpha, 'Fixed ' || model AS policy, {metrics()} FROM uo WHERE split = 'test' GROUP BY alpha, model"
oracle("fixed_policies", _FIXED)
_REGRETS = ", ".join(
    f"{r(f'''max(oracle_utility) - max(CASE WHEN model = '{m}' THEN utility END)''', 6)} AS regret_{m}" for m in M)
oracle("oracle_decisions", f"""SELECT query_id, alpha, max(oracle_model) AS oracle_model,
    max(oracle_utility) AS oracle_utility, {_REGRETS} FROM uo WHERE split = 'test' GROUP BY query_id, alpha""")
FRAGMENTS["vmeans"] = f"""SELECT alpha, model, ord, {settle('avg(utility)')} AS u FROM ua
    WHERE split = 'validation' GROUP BY alpha, model, ord"""
FRAGMENTS["bestfixed"] = """SELECT alpha, arg_max(model, (u, -ord)) AS selected_model, max(u) AS u
    FROM vmeans GROUP BY alpha"""
_VU = ", ".join(f"{r(f'''max(CASE WHEN model = '{m}' THEN vm.u END)''')} AS validation_utility_{m}" for m in M)
oracle("best_fixed_selection", f"""SELECT alpha, selected_model, {r('max(b.u)')} AS validation_mean_utility, {_VU}
    FROM bestfixed b JOIN vmeans vm USING (alpha) GROUP BY alpha, selected_model""")
_BEST = f"""SELECT alpha, selected_model AS validation_selected_model, {r('b.u')} AS validation_mean_utility,
    {metrics()}, 'Best Fixed Utility' AS policy FROM uo JOIN bestfixed b USING (alpha)
    WHERE split = 'test' AND model = selected_model GROUP BY alpha, selected_model, b.u"""
oracle("best_fixed_policy", _BEST)
FRAGMENTS["cmeans"] = f"""SELECT alpha, category, model, {settle('avg(utility)')} AS u FROM ua
    WHERE split = 'train' GROUP BY alpha, category, model"""
FRAGMENTS["gmeans"] = f"""SELECT alpha, model, ord, {settle('avg(utility)')} AS u FROM ua
    WHERE split = 'train' GROUP BY alpha, model, ord"""
FRAGMENTS["fallback"] = """SELECT alpha, arg_max(model, (u, -ord)) AS fallback_model, max(u) AS u
    FROM gmeans GROUP BY alpha"""
FRAGMENTS["cmap"] = """SELECT alpha, category, model AS selected_model, u FROM (SELECT *, row_number() OVER (
      PARTITION BY alpha, category ORDER BY u DESC, model) AS rn FROM cmeans) WHERE rn = 1"""
oracle("category_map", f"""SELECT alpha, category, selected_model, {r('c.u')} AS training_mean_utility, fallback_model
    FROM cmap c JOIN fallback USING (alpha)""")
oracle("fallback_choice", f"SELECT alpha, fallback_model, {r('u')} AS training_mean_utility FROM fallback")
FRAGMENTS["cchoice"] = """SELECT u.*, coalesce(selected_model, fallback_model) AS pick FROM uo u
    JOIN fallback f USING (alpha) LEFT JOIN cmap c ON c.alpha = u.alpha AND c.category = u.category"""
for _split in ("validation", "test"):
    oracle(f"category_policy_{_split}", f"""SELECT alpha, {metrics()}, 'Category Router (train-selected)' AS policy
        FROM cchoice WHERE split = '{_split}' AND model = pick GROUP BY alpha""")
oracle("baseline_summary", f"""SELECT *, NULL::VARCHAR AS validation_selected_model, NULL::DOUBLE AS validation_mean_utility
    FROM ({_FIXED}) UNION ALL BY NAME SELECT * FROM ({_BEST})""")

# ------------------------------------------------------------ sources and sinks
oracle("csv_round_trip", "SELECT doc_id, text, lang, source, n_chars FROM documents")
oracle("csv_multi_file", f"""SELECT o_orderstatus, count(*) AS n, {r('sum(o_totalprice)', 2)} AS total FROM orders
    GROUP BY o_orderstatus""")
oracle("question_bank_numeric", """SELECT 'numeric' AS dataset, source AS category, text AS question,
    CAST(n_chars AS VARCHAR) AS ground_truth FROM documents""")
oracle("question_bank_choice", """SELECT 'letter' AS dataset, p_type AS category,
    p_name || chr(10) || chr(10) || 'A. ' || p_brand || chr(10) || 'B. ' || p_type || chr(10) || 'C. ' || p_name
      || chr(10) || 'D. ' || p_size AS question,
    substr('ABCD', 1 + CAST(p_partkey % 4 AS INTEGER), 1) AS ground_truth FROM part""")
oracle("sample_per_category", """SELECT p_partkey, p_name, p_type FROM part
    QUALIFY row_number() OVER (PARTITION BY p_type ORDER BY p_partkey) <= 20""")
oracle("sample_first", "SELECT p_partkey, p_name, p_type FROM part ORDER BY p_partkey LIMIT 100")
_SIX = ", ".join(f"round({c}, 6) AS {c}" for c in (
    "alpha", "accuracy", "avg_cost", "avg_latency", "mean_utility", "oracle_utility", "mean_regret",
    "validation_mean_utility", "training_mean_utility"))
oracle("report_union", f"""SELECT policy, n_queries, {_SIX}, {', '.join(f'selected_{m}' for m in M)},
      validation_selected_model, fallback_model
    FROM (SELECT * FROM ({_FIXED}) UNION ALL BY NAME SELECT * FROM ({_BEST})
      UNION ALL BY NAME SELECT alpha, fallback_model, {r('u')} AS training_mean_utility FROM fallback)""")
oracle("parameter_json", f"""SELECT CAST(alpha AS VARCHAR) AS key, alpha, selected_model,
    {r('u')} AS validation_mean_utility FROM bestfixed""")
oracle("resumable_append", "SELECT query_id, model, correct, raw_cost, latency FROM obs")

# ------------------------------------------------------------ grading and token costs

def strip(expr: str) -> str:
    return f"regexp_replace({expr}, '^[{SPACE}]+|[{SPACE}]+$', '', 'g')"


FRAGMENTS["answers"] = f"""
  SELECT l_orderkey, l_linenumber, 'm' || (l_suppkey % {K}) AS model, 'numeric' AS dataset,
    CASE l_orderkey % 6 WHEN 0 THEN 'Let me see.' || chr(10) || 'Final Answer: ' || q
      WHEN 1 THEN 'final answer: ' || q || '.00 units' WHEN 2 THEN 'about ' || q || ' or 7'
      WHEN 3 THEN 'Final Answer: 1,' || lpad(q, 3, '0') WHEN 4 THEN 'Final Answer: unknown' ELSE '' END AS answer,
    q AS ground_truth
  FROM (SELECT *, CAST(CAST(l_quantity AS INTEGER) AS VARCHAR) AS q FROM lineitem)
  UNION ALL
  SELECT l_orderkey, l_linenumber, 'm' || (l_suppkey % {K}), 'letter',
    CASE WHEN l_linenumber % 2 = 0 THEN 'Final Answer: ' || l_returnflag
      ELSE ' ' || lower(t) || chr(10) END, t
  FROM (SELECT *, substr('ABCD', 1 + CAST(l_suppkey % 4 AS INTEGER), 1) AS t FROM lineitem)"""
FRAGMENTS["predicted"] = rf"""
  SELECT * EXCLUDE (body, number, marked), CASE WHEN dataset = 'numeric'
      THEN CASE WHEN number <> '' THEN replace(number, ',', '') ELSE body END
      ELSE CASE WHEN marked <> '' THEN upper(marked)
        WHEN upper({strip('answer')}) IN ('A','B','C','D') THEN upper({strip('answer')}) ELSE '' END END AS prediction
  FROM (SELECT *, regexp_extract(body, '[-+]?[0-9][0-9,]*(?:\.[0-9]+)?', 0) AS number,
      regexp_extract(answer, '(?i)Final Answer:[{SPACE}]*([ABCD])\b', 1) AS marked
    FROM (SELECT *, {strip(rf"CASE WHEN regexp_matches(answer, '(?i)Final Answer:') THEN regexp_extract(answer, '(?i)Final Answer:[{SPACE}]*([^\n]*)', 1) ELSE answer END")} AS body
      FROM answers))"""
FRAGMENTS["graded"] = f"""
  SELECT *, CAST(CASE WHEN dataset = 'numeric' THEN coalesce(
        TRY_CAST(prediction AS DECIMAL(38,18)) = TRY_CAST(replace(ground_truth, ',', '') AS DECIMAL(38,18)),
        lower({strip('prediction')}) = lower({strip('ground_truth')}))
      ELSE upper({strip('prediction')}) = upper({strip('ground_truth')}) END AS INTEGER) AS correct
  FROM predicted"""
oracle("graded_answers", "SELECT * FROM graded")
oracle("grading_accuracy", f"""SELECT dataset, model, count(*) AS n, {r('avg(correct)')} AS accuracy
    FROM graded GROUP BY dataset, model""")
WORD = r"[\p{L}\p{N}_](?:[\p{L}\p{N}_''-]*[\p{L}\p{N}_])?"
TOKEN = WORD + r"|[^\p{L}\p{N}_" + SPACE + "]"


def regexp_count(text: str, pattern: str) -> str:
    return f"CAST(len(regexp_extract_all({text}, '{pattern}')) AS INTEGER)"


_PRICE = {"m0": (0.15, 0.60), "m1": (3.0, 15.0), "m2": (0.10, 0.40), "m3": (0.05, 0.25)}
_PRICES = ", ".join(f"('{m}', {d(a)}, {d(b)})" for m, (a, b) in _PRICE.items())
oracle("token_costs", f"""SELECT doc_id, t.model, prompt_tokens, completion_tokens,
    round(prompt_tokens / 1000000.0::DOUBLE * pin + completion_tokens / 1000000.0::DOUBLE * pout, 8) AS cost
  FROM (SELECT doc_id, 'm' || (doc_id % {K}) AS model, CAST({regexp_count('text', TOKEN)} AS BIGINT) AS prompt_tokens,
      n_chars % 500 AS completion_tokens FROM documents) t
  JOIN (VALUES {_PRICES}) p(model, pin, pout) ON p.model = t.model""")

# ------------------------------------------------------------ completeness, integrity, quality
FRAGMENTS["expected"] = """SELECT CASE WHEN p_type IN ('ECONOMY','PROMO') THEN 'd0' ELSE 'd1' END AS dataset,
    p_partkey FROM part"""
FRAGMENTS["docs"] = "SELECT doc_id, lang AS dataset, source AS category, text AS question FROM documents"
oracle("duplicate_documents", """SELECT dataset, category, question, count(*) AS occurrences FROM docs
    GROUP BY dataset, category, question HAVING count(*) > 1""")
oracle("duplicate_line_keys", """SELECT l_orderkey, l_linenumber, count(*) AS occurrences FROM lineitem
    GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1""")
oracle("unique_documents", """SELECT substr(sha256(dataset || '||' || category || '||' || question), 1, 16) AS query_id,
    dataset, category, question, min(doc_id) AS doc_id, count(*) AS copies FROM docs
    GROUP BY dataset, category, question""")
FRAGMENTS["found"] = """SELECT p_partkey, count(*) AS rows, string_agg(DISTINCT model, ',' ORDER BY model) AS found
    FROM obs GROUP BY p_partkey"""
_MISSING = " || ".join(f"CASE WHEN contains(found, '{m}') THEN '' ELSE ',{m}' END" for m in M)
oracle("candidates_found", f"SELECT p_partkey, rows, found, ltrim({_MISSING}, ',') AS missing FROM found")
oracle("missing_candidates", """SELECT p_partkey, model FROM expected, models EXCEPT
    SELECT p_partkey, model FROM obs""")
oracle("absent_queries", """SELECT o_orderkey FROM orders
    EXCEPT SELECT l_orderkey FROM lineitem""")
oracle("completeness_summary", f"""SELECT e.dataset, count(*) AS expected,
    count(CASE WHEN f.rows IS NULL OR f.rows < {K} THEN 1 END) AS incomplete,
    count(CASE WHEN f.rows IS NULL THEN 1 END) AS absent, CAST(sum(coalesce(f.rows, 0)) AS BIGINT) AS observed_rows
    FROM expected e LEFT JOIN found f USING (p_partkey) GROUP BY e.dataset""")
oracle("split_violations", f"""SELECT query_id, CAST(1 AS BIGINT) AS n_splits, count(DISTINCT model) AS n_models
    FROM obs GROUP BY query_id HAVING count(DISTINCT model) <> {K}""")
oracle("incomplete_queries", f"""SELECT count(*) AS n_queries, {cnt(f"n = {K}")} AS n_complete, {cnt(f"n <> {K}")} AS n_incomplete
    FROM (SELECT query_id, count(DISTINCT model) AS n FROM obs GROUP BY query_id)""")
oracle("id_report", """SELECT count(*) AS n_rows, count(DISTINCT query_id) AS n_ids,
    count(*) - count(DISTINCT query_id) AS duplicate_ids, CAST(0 AS BIGINT) AS illegal_splits FROM splits""")
oracle("side_mismatches", """SELECT query_id, 'train' AS left_split, split AS right_split,
    CASE WHEN split IS NULL THEN 'only_left' ELSE 'split_differs' END AS reason
    FROM (SELECT DISTINCT query_id FROM obs) o LEFT JOIN splits s USING (query_id)
    WHERE split IS NULL OR split <> 'train'""")
oracle("non_finite_features", "SELECT l_orderkey FROM lineitem WHERE l_discount = 0 OR l_tax <= 0")
_QS = {"median": 0.5, "p90": 0.90, "p95": 0.95, "p99": 0.99, "p999": 0.999}


def _costs(column: str, source: str) -> str:
    return f"""SELECT count(*) AS n_rows, {r(f'min({column})')} AS min_cost, {r(f'max({column})')} AS max_cost,
    {', '.join(f"{r(f'quantile_cont({column}, {q})')} AS {name}_cost" for name, q in _QS.items())} FROM {source}"""


oracle("cost_distribution", _costs("raw_cost", "obs"))
oracle("cost_distribution_scaled", _costs("l_extendedprice", "lineitem"))
oracle("zero_costs", "SELECT dataset, model, count(*) AS n_rows FROM obs WHERE raw_cost = 0 GROUP BY dataset, model")
oracle("most_expensive", """SELECT query_id, dataset, model, raw_cost, latency FROM obs
    ORDER BY raw_cost DESC, query_id, model LIMIT 10""")
oracle("one_to_one", """SELECT coalesce(o_orderkey, l_orderkey) AS o_orderkey, coalesce(a, 0) AS n_left,
    coalesce(b, 0) AS n_right FROM (SELECT o_orderkey, count(*) AS a FROM orders GROUP BY 1) o
    FULL JOIN (SELECT l_orderkey, count(*) AS b FROM lineitem GROUP BY 1) l ON o_orderkey = l_orderkey
    WHERE coalesce(a, 0) <> 1 OR coalesce(b, 0) <> 1""")
oracle("label_conflicts", """SELECT sha256(question) AS digest FROM docs GROUP BY question
    HAVING min(category) <> max(category)""")
oracle("null_counts", " UNION ALL ".join(
    f"SELECT '{c}' AS column, count(*) - count({c}) AS nulls FROM documents LEFT JOIN labels USING (doc_id)"
    for c in ("text", "lang", "quality", "toxic")))
oracle("membership", "SELECT query_id, model, correct FROM sobs WHERE split = 'validation'")

# ------------------------------------------------------------ features
_NUMBER = r"[-+]?[0-9][0-9,]*(?:\.[0-9]+)?"


def text_features(text: str) -> str:
    words = f"regexp_extract_all({text}, '{WORD}')"
    options = regexp_count(text, rf"(?m)^[ABCD]\.[{SPACE}]")
    return rf"""CAST(length({text}) AS INTEGER) AS char_count, {regexp_count(text, WORD)} AS word_count,
    {regexp_count(text, TOKEN)} AS approx_token_count,
    CAST(len(regexp_extract_all(regexp_replace({text}, '({LINE_END})\z', ''), '{LINE_END}')) + 1 AS INTEGER) AS line_count,
    greatest(1, {regexp_count(text, '[.!?]+')}) AS sentence_count, {regexp_count(text, _NUMBER)} AS number_count,
    CAST(length(regexp_replace({text}, '[^-+*/=<>^%$]', '', 'g')) AS INTEGER) AS math_symbol_count,
    CAST(length({text}) - length(replace({text}, '?', '')) AS INTEGER) AS question_mark_count,
    {options} AS option_count, CAST({options} >= 4 AS INTEGER) AS is_multiple_choice,
    CASE WHEN len({words}) > 0 THEN round(length(array_to_string({words}, '')) / len({words})::DOUBLE, 6)
      ELSE 0.0::DOUBLE END AS avg_word_length"""


oracle("text_features", f"SELECT doc_id, dataset, category, {text_features('question')} FROM docs")


def _one_hot(prefix: str, column: str, values: list[str]) -> str:
    return ", ".join(f"CAST({column} = '{v}' AS INTEGER) AS {prefix}_{v.lower()}" for v in values)


LANGS = ["de", "en", "es", "fr"]
SOURCES = [f"src{i}" for i in range(20)]
TYPES = ["ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD"]
oracle("one_hot_features", f"""SELECT doc_id, dataset, category, {_one_hot('dataset', 'dataset', LANGS)},
    {_one_hot('category', 'category', SOURCES)} FROM docs""")
oracle("embedding_features", """SELECT query_id, vec_id, CAST(dim - 1 AS INTEGER) AS dim,
    CASE WHEN norm > 0 THEN round(x / norm, 8) ELSE x END AS value
  FROM (SELECT query_id, vec_id, dim, CAST(embedding[dim] AS DOUBLE) AS x,
      sqrt(list_sum(list_transform(embedding, lambda y: CAST(y AS DOUBLE) * CAST(y AS DOUBLE)))) AS norm
    FROM (SELECT q.query_id, vec_id, embedding, unnest(generate_series(1, len(embedding))) AS dim
      FROM queries q JOIN embeddings e ON e.vec_id = q.p_partkey % (SELECT count(*) FROM embeddings)))""")
oracle("feature_table", f"""SELECT query_id, dataset, category, split, p_size, p_retailprice, name_length,
    {text_features('question')}, {_one_hot('dataset', 'dataset', ['d0', 'd1'])} FROM splits""")

# ------------------------------------------------------------ ensemble and routing
FRAGMENTS["weights"] = f"""SELECT * FROM (SELECT query_id, CAST(member AS INTEGER) AS member,
      {poisson(uniform(f"sha256('{P.seed}|' || (member // 4) || '|' || query_id)", 'CAST(member % 4 AS INTEGER)'))} AS w
    FROM (SELECT query_id FROM splits WHERE split = 'train'), range({P.members}) t(member)) WHERE w > 0"""
FRAGMENTS["unit_weights"] = "SELECT query_id, CAST(0 AS INTEGER) AS member, 1 AS w FROM splits WHERE split = 'train'"


def ensemble_fragments(tag: str, group: str, weights: str = "weights", members: int = P.members) -> None:
    """Fit, prediction, statistics, state, sweep and decisions of one learner variant."""
    f = FRAGMENTS
    f[f"fit{tag}"] = f"""SELECT member, {group} AS grp, model, ord, CAST(sum(w) AS BIGINT) AS w,
        CAST(sum(w * correct) AS DOUBLE) AS c, sum(w * normalized_cost) AS n
      FROM core JOIN {weights} USING (query_id) GROUP BY member, {group}, model, ord"""
    f[f"overall{tag}"] = f"SELECT member, model, sum(c) / sum(w) AS c, sum(n) / sum(w) AS n FROM fit{tag} GROUP BY member, model"
    f[f"pred{tag}"] = f"""SELECT g.grp, alpha_id, alpha, a.member, m.model, m.ord,
        {settle('coalesce(t.c / t.w, a.c) - alpha * coalesce(t.n / t.w, a.n)')} AS yhat
      FROM (SELECT DISTINCT {group} AS grp FROM queries) g, alphas, models m
      JOIN overall{tag} a ON a.model = m.model
      LEFT JOIN fit{tag} t ON t.grp = g.grp AND t.member = a.member AND t.model = m.model"""
    f[f"pick{tag}"] = f"""SELECT grp, alpha, member, arg_max(model, (yhat, -ord)) AS pick FROM pred{tag}
      GROUP BY grp, alpha, member"""
    f[f"votes{tag}"] = f"""SELECT grp, alpha, m.model, {cnt('pick = m.model')} / {float(members)}::DOUBLE AS vote
      FROM pick{tag}, models m GROUP BY grp, alpha, m.model"""
    f[f"dis{tag}"] = f"""SELECT grp, alpha, {r('1.0::DOUBLE - max(vote)')} AS disagreement,
        {r(f'sum(CASE WHEN vote > 0 THEN -vote * ln(vote) ELSE 0 END) / ln({float(K)}::DOUBLE)')} AS entropy
      FROM votes{tag} GROUP BY grp, alpha"""
    f[f"stats{tag}"] = f"""SELECT grp, alpha, model, {r('avg(yhat)')} AS mean, {r('stddev_pop(yhat)')} AS risk
      FROM pred{tag} GROUP BY grp, alpha, model"""
    f[f"state{tag}"] = f"""SELECT u.query_id, u.dataset, u.category, u.split, u.alpha, u.model, u.ord, mean, risk,
        vote, disagreement, entropy, utility AS actual, correct, cost_clean AS cost, raw_cost, latency,
        oracle_model, oracle_utility
      FROM uo u JOIN stats{tag} s ON s.grp = u.{group} AND s.alpha = u.alpha AND s.model = u.model
      JOIN votes{tag} v ON v.grp = u.{group} AND v.alpha = u.alpha AND v.model = u.model
      JOIN dis{tag} x ON x.grp = u.{group} AND x.alpha = u.alpha"""
    f[f"sweep_rows{tag}"] = f"""SELECT * FROM state{tag}, lambdas WHERE split = 'validation'
      QUALIFY row_number() OVER (PARTITION BY query_id, alpha, lam ORDER BY mean - lam * risk DESC, ord) = 1"""
    f[f"sweep{tag}"] = f"SELECT alpha, lam, {summary()} FROM sweep_rows{tag} GROUP BY alpha, lam"
    f[f"best{tag}"] = f"""SELECT * FROM sweep{tag}
      QUALIFY row_number() OVER (PARTITION BY alpha ORDER BY mean_regret, lam) = 1"""
    f[f"routers{tag}"] = f"""SELECT alpha, 0.0::DOUBLE AS lam, 'utility_only' AS router FROM alphas
      UNION ALL SELECT alpha, lam, 'risk_aware' FROM best{tag}"""
    f[f"tdec{tag}"] = f"""SELECT s.*, lam, router FROM state{tag} s JOIN routers{tag} t ON s.alpha = t.alpha
      WHERE split = 'test'
      QUALIFY row_number() OVER (PARTITION BY query_id, s.alpha, router ORDER BY mean - lam * risk DESC, ord) = 1"""


def summary(diagnostics: bool = True) -> str:
    text = f"""count(*) AS num_queries, {r('avg(correct)')} AS accuracy, {r('avg(cost)')} AS average_cost,
      {r('avg(latency)')} AS average_latency, {r('avg(actual)')} AS mean_realized_utility,
      {r('avg(oracle_utility)')} AS mean_oracle_utility,
      {r('avg(round(oracle_utility - actual, 6))')} AS mean_regret"""
    if diagnostics:
        text += f""", {r('avg(risk)')} AS mean_selected_risk, {r('avg(disagreement)')} AS mean_decision_disagreement"""
    return text + "".join(f", {cnt(f'''model = '{m}' ''')} AS {m}_selected" for m in M)


ensemble_fragments("", "category")
ensemble_fragments("_ab", "dataset")
ensemble_fragments("_one", "category", "unit_weights", 1)
oracle("bootstrap_weights", "SELECT query_id, member, w FROM weights")
FRAGMENTS["shape"] = f"""SELECT count(DISTINCT dataset) AS nd, count(DISTINCT category) AS nc,
    (SELECT max(len(embedding)) FROM embeddings) AS dims FROM splits"""
FRAGMENTS["wide"] = f"""SELECT query_id, split, dataset, category, p_size, p_retailprice, name_length, {text_features('question')},
      embedding, sqrt(list_sum(list_transform(embedding, lambda y: CAST(y AS DOUBLE) * CAST(y AS DOUBLE)))) AS norm
    FROM splits s JOIN embeddings e ON e.vec_id = s.p_partkey % (SELECT count(*) FROM embeddings)"""
_STRUCTURE = ("char_count", "word_count", "approx_token_count", "line_count", "sentence_count", "number_count", "math_symbol_count",
              "question_mark_count", "option_count", "is_multiple_choice", "avg_word_length")
FRAGMENTS["matrix"] = f"""SELECT query_id, split, family, CAST(position AS INTEGER) AS position, value FROM (
    SELECT query_id, split, 'numeric' AS family, unnest([0, 1, 2]) AS position, unnest([p_size, p_retailprice, name_length]) AS value FROM wide
    UNION ALL SELECT query_id, split, 'structure', unnest(range(3, 14)), unnest([{', '.join(f'CAST({c} AS DOUBLE)' for c in _STRUCTURE)}]) FROM wide
    UNION ALL SELECT query_id, split, 'dataset', 13 + dense_rank() OVER (ORDER BY dataset), 1.0::DOUBLE FROM wide
    UNION ALL SELECT query_id, split, 'category', 13 + nd + dense_rank() OVER (ORDER BY category), 1.0::DOUBLE FROM wide, shape
    UNION ALL SELECT query_id, split, 'embedding', 13 + nd + nc + dim,
        CASE WHEN norm > 0 THEN round(CAST(embedding[dim] AS DOUBLE) / norm, 8) ELSE 0.0::DOUBLE END
      FROM (SELECT *, unnest(range(1, len(embedding) + 1)) AS dim FROM wide), shape) WHERE value <> 0"""
oracle("feature_matrix", "SELECT query_id, split, family, position, value FROM matrix")
oracle("label_positions", """SELECT l_orderkey, l_linenumber, l_suppkey,
    CAST(dense_rank() OVER (ORDER BY CAST(l_orderkey AS VARCHAR)) - 1 AS INTEGER) AS position FROM lineitem""")
oracle("training_targets", f"""SELECT query_id, alpha, p_size, p_retailprice, name_length, model, utility AS target, n_features, feature_norm
    FROM ua JOIN (SELECT query_id, CAST(count(*) AS INTEGER) AS n_features, {r('sqrt(sum(value * value))', 6)} AS feature_norm
      FROM matrix GROUP BY query_id) USING (query_id) WHERE split = 'train'""")
FRAGMENTS["xm"] = """SELECT query_id, position + 1 AS i, value AS x FROM matrix WHERE split = 'train'
    UNION ALL SELECT query_id, 0, 1.0::DOUBLE FROM splits WHERE split = 'train'"""
FRAGMENTS["wm"] = """SELECT query_id, member, w FROM weights
    UNION ALL SELECT query_id, CAST(-1 AS INTEGER), 1 FROM splits WHERE split = 'train'"""
FRAGMENTS["gram"] = """SELECT member, a.i, b.i AS j, sum(w * a.x * b.x) AS value
    FROM xm a JOIN xm b ON b.query_id = a.query_id AND b.i >= a.i JOIN wm ON wm.query_id = a.query_id GROUP BY 1, 2, 3"""
FRAGMENTS["ym"] = f"""SELECT query_id, ord AS t, CAST(correct AS DOUBLE) AS y FROM core
    UNION ALL SELECT query_id, ord + {K}, normalized_cost FROM core"""
FRAGMENTS["cross_moments"] = """SELECT member, i, CAST(1 + 14 + nd + nc + dims + t AS INTEGER) AS j, sum(w * x * y) AS value
    FROM xm JOIN ym USING (query_id) JOIN wm USING (query_id), shape GROUP BY ALL"""
oracle("ridge_moments", f"""SELECT member, g.i, g.j, {r('CASE WHEN g.i = g.j THEN ln(g.value) ELSE g.value / sqrt(a.value * b.value) END', 6)} AS value
    FROM gram g JOIN gram a ON a.member = g.member AND a.i = g.i AND a.j = g.i
    JOIN gram b ON b.member = g.member AND b.i = g.j AND b.j = g.j WHERE g.value <> 0
    UNION ALL SELECT member, c.i, c.j, {r('c.value / sqrt(a.value * b.value)', 6)} AS value
    FROM cross_moments c JOIN gram a USING (member) JOIN gram b USING (member)
    WHERE a.i = c.i AND a.j = c.i AND b.i = 0 AND b.j = 0 AND c.value <> 0""".replace("SELECT member, g.i", "SELECT g.member, g.i"))
for _name, _tag in (("group_model", ""), ("group_model_ablation", "_ab")):
    _cols = ", ".join(f"{r(f'max(CASE WHEN ord = {i} THEN {c} END)', 6)} AS {c}{i}" for i in range(K) for c in "cn")
    oracle(_name, f"SELECT member, grp, max(w) AS w, {_cols} FROM fit{_tag} GROUP BY member, grp")
_YH = ", ".join(f"{r(f'''max(CASE WHEN model = '{m}' THEN yhat END)''')} AS predicted_utility_{m}" for m in M)
oracle("member_predictions", f"""SELECT query_id, alpha, member, max(pick) AS selected_model, {_YH}
    FROM splits q JOIN pred p ON p.grp = q.category JOIN pick USING (grp, alpha, member)
    WHERE split = 'validation' GROUP BY query_id, alpha, member""")
_STATE = ", ".join(f"max(CASE WHEN model = '{m}' THEN {c} END) AS {a}_{m}" for m in M for c, a in (
    ("mean", "mean_utility"), ("risk", "risk"), ("actual", "actual_utility"), ("vote", "vote_fraction")))
for _name, _tag in (("validation_state", ""), ("validation_state_ablation", "_ab")):
    oracle(_name, f"""SELECT query_id, category, alpha, {_STATE}, disagreement AS decision_disagreement,
        entropy AS decision_entropy FROM state{_tag} WHERE split = 'validation' GROUP BY ALL""")
oracle("predictor_errors", f"""SELECT alpha, model, count(*) AS n_queries, {r('avg(abs(mean - actual))')} AS mae,
    {r('sqrt(avg((mean - actual) * (mean - actual)))')} AS rmse FROM state_one WHERE split = 'validation'
    GROUP BY alpha, model""")
oracle("single_fit_router", f"""SELECT alpha, {summary(False)} FROM sweep_rows_one WHERE lam = 0 GROUP BY alpha""")
_DECISION = """query_id, dataset, category, alpha, lam AS "lambda", model AS selected_model, mean AS selected_mean_utility,
    risk AS selected_risk, disagreement AS decision_disagreement, entropy AS decision_entropy,
    actual AS realized_utility, oracle_model, oracle_utility, round(oracle_utility - actual, 6) AS regret,
    correct, cost, latency"""
oracle("validation_decisions", f"SELECT {_DECISION} FROM sweep_rows")
oracle("lambda_sweep", 'SELECT * RENAME (lam AS "lambda") FROM sweep')
oracle("lambda_sweep_ablation", 'SELECT * RENAME (lam AS "lambda") FROM sweep_ab')
oracle("best_lambdas", 'SELECT * RENAME (lam AS "lambda") FROM best')
oracle("best_lambdas_ablation", 'SELECT * RENAME (lam AS "lambda") FROM best_ab')
oracle("frozen_lambdas_json", 'SELECT CAST(alpha AS VARCHAR) AS key, alpha, lam AS "lambda", mean_regret FROM best')
oracle("test_decisions", f"SELECT {_DECISION}, router FROM tdec")
oracle("test_results", f"""SELECT alpha, lam AS "lambda", router, {summary(False)} FROM tdec GROUP BY alpha, lam, router""")
oracle("test_results_ablation",
       f"""SELECT alpha, lam AS "lambda", router, {summary(False)} FROM tdec_ab GROUP BY alpha, lam, router""")
FRAGMENTS["pairs"] = """SELECT u.query_id, u.alpha, u.dataset, u.category, t.lam, u.model AS um, t.model AS rm,
    u.mean AS u_mean, u.risk AS u_risk, t.mean AS r_mean, t.risk AS r_risk, u.actual AS u_actual,
    t.actual AS r_actual, u.correct AS u_correct, t.correct AS r_correct, u.cost AS u_cost, t.cost AS r_cost,
    u.latency AS u_latency, t.latency AS r_latency, u.oracle_utility
  FROM (SELECT * FROM tdec WHERE router = 'utility_only') u
  JOIN (SELECT * FROM tdec WHERE router = 'risk_aware') t USING (query_id, alpha)"""
_WIDE = ", ".join(
    f"max(CASE WHEN s.model = '{m}' THEN s.mean END) AS mean_utility_{m}, "
    f"max(CASE WHEN s.model = '{m}' THEN s.risk END) AS risk_{m}, "
    f"max(CASE WHEN s.model = '{m}' THEN {r('s.mean - lam * s.risk')} END) AS risk_adjusted_score_{m}" for m in M)
oracle("test_state", f"""SELECT query_id, p.dataset, p.category, alpha, lam AS "lambda", {_WIDE}, um AS utility_only_model,
    rm AS risk_aware_model, CAST(um <> rm AS INTEGER) AS decision_changed, u_mean AS utility_only_selected_mean,
    u_risk AS utility_only_selected_risk, r_mean AS risk_aware_selected_mean, r_risk AS risk_aware_selected_risk,
    {r('r_mean - u_mean')} AS selected_mean_difference_risk_minus_utility,
    {r('r_risk - u_risk')} AS selected_risk_difference_risk_minus_utility,
    {r('u_mean - lam * u_risk')} AS utility_only_model_risk_adjusted_score,
    {r('r_mean - lam * r_risk')} AS risk_aware_model_risk_adjusted_score,
    {r('(r_mean - lam * r_risk) - (u_mean - lam * u_risk)')} AS risk_adjusted_score_margin
  FROM pairs p JOIN state s USING (query_id, alpha) GROUP BY ALL""")

# ------------------------------------------------------------ risk signals


def avg_rank(value: str, keys: str) -> str:
    return (f"(rank() OVER (PARTITION BY {keys} ORDER BY {value})"
            f" + (count(*) OVER (PARTITION BY {keys}, {value}) - 1) / 2.0::DOUBLE)")


def rho(x: str = "rx", y: str = "ry") -> str:
    return r(f"CASE WHEN max({x}) > min({x}) AND max({y}) > min({y}) THEN corr({x}, {y}) END")


FRAGMENTS["records"] = """SELECT query_id, dataset, category, alpha, model AS selected_model, oracle_model,
    round(oracle_utility - actual, 6) AS regret, risk AS selected_risk, disagreement, entropy FROM state
  WHERE split = 'validation' QUALIFY row_number() OVER (PARTITION BY query_id, alpha ORDER BY mean DESC, ord) = 1"""
oracle("routing_records", "SELECT * FROM records")
FRAGMENTS["merr"] = "SELECT query_id, alpha, model, risk, abs(mean - actual) AS error FROM state WHERE split = 'validation'"
FRAGMENTS["pooled"] = f"""SELECT alpha, 'model_level_std_all_models' AS signal, count(*) AS n, {rho()} AS spearman_rho
  FROM (SELECT alpha, {avg_rank('risk', 'alpha')} AS rx, {avg_rank('error', 'alpha')} AS ry FROM merr) GROUP BY alpha"""
_TAKE = f"greatest(1, CAST(floor(n * {d(P.tail_fraction)}) AS INTEGER))"
FRAGMENTS["permodel"] = f"""SELECT alpha, 'model_level_std_' || model AS signal, count(*) AS n, {rho()} AS spearman_rho,
    {r(f'avg(CASE WHEN rn <= {_TAKE} THEN error END)')} AS low_20_mean_error,
    {r(f'avg(CASE WHEN rn > n - {_TAKE} THEN error END)')} AS high_20_mean_error
  FROM (SELECT *, {avg_rank('risk', 'alpha, model')} AS rx, {avg_rank('error', 'alpha, model')} AS ry,
      row_number() OVER (PARTITION BY alpha, model ORDER BY risk, query_id) AS rn,
      count(*) OVER (PARTITION BY alpha, model) AS n FROM merr) GROUP BY alpha, model"""
_MS = """SELECT *, 'model_level_prediction_error' AS analysis FROM (
    SELECT *, NULL::DOUBLE AS low_20_mean_error, NULL::DOUBLE AS high_20_mean_error FROM pooled
    UNION ALL SELECT * FROM permodel)"""
for _name in ("model_signals", "model_signals_scaled"):
    oracle(_name, _MS)
FRAGMENTS["sigrows"] = """SELECT query_id, alpha, regret, 'selected_model_std' AS signal, selected_risk AS value FROM records
  UNION ALL SELECT query_id, alpha, regret, 'decision_disagreement', disagreement FROM records
  UNION ALL SELECT query_id, alpha, regret, 'decision_entropy', entropy FROM records"""
_T = ", ".join(f"({d(t)})" for t in P.failure_thresholds)
FRAGMENTS["sigranked"] = f"""SELECT *, {avg_rank('value', 'alpha, signal')} AS rx,
    {avg_rank('regret', 'alpha, signal')} AS ry,
    row_number() OVER (PARTITION BY alpha, signal ORDER BY value, query_id) AS rn,
    count(*) OVER (PARTITION BY alpha, signal) AS n FROM sigrows"""
_FAIL = "CAST(regret > failure_threshold AS INTEGER)"
_POS = f"CAST(sum({_FAIL}) AS DOUBLE)"
_SIG = f"""SELECT 'routing_uncertainty' AS analysis, alpha, signal, failure_threshold, count(*) AS n,
    {rho()} AS spearman_rho,
    {r(f'CASE WHEN {_POS} > 0 AND {_POS} < count(*) THEN (sum({_FAIL} * rx) - {_POS} * ({_POS} + 1) / 2) / ({_POS} * (count(*) - {_POS})) END')} AS auroc,
    {r(f'avg({_FAIL})')} AS failure_rate,
    {r(f'avg(CASE WHEN rn <= {_TAKE} THEN {_FAIL} END)')} AS low_20_failure_rate,
    {r(f'avg(CASE WHEN rn > n - {_TAKE} THEN {_FAIL} END)')} AS high_20_failure_rate,
    {r(f'avg(CASE WHEN rn <= {_TAKE} THEN regret END)')} AS low_20_mean_regret,
    {r(f'avg(CASE WHEN rn > n - {_TAKE} THEN regret END)')} AS high_20_mean_regret
  FROM sigranked, (VALUES {_T}) t(failure_threshold) GROUP BY alpha, signal, failure_threshold"""
for _name in ("routing_signals", "routing_signals_scaled"):
    oracle(_name, _SIG)
oracle("quantity_price_correlation", f"""SELECT l_returnflag, count(*) AS n, {rho()} AS rho FROM (
    SELECT l_returnflag, {avg_rank('l_quantity', 'l_returnflag')} AS rx,
      {avg_rank('l_extendedprice', 'l_returnflag')} AS ry FROM lineitem) GROUP BY l_returnflag""")

# ------------------------------------------------------------ paired inference
FRAGMENTS["rpairs"] = """SELECT query_id, dataset, category, alpha, um AS u_selected_model, rm AS r_selected_model,
    u_correct, r_correct, u_cost, r_cost, u_latency, r_latency, u_actual AS u_realized_utility,
    r_actual AS r_realized_utility, round(oracle_utility - u_actual, 6) AS u_regret,
    round(oracle_utility - r_actual, 6) AS r_regret FROM pairs"""
oracle("router_pairs", "SELECT * FROM rpairs")


def mcnemar_sql(source: str, keys: str, a: str, b: str) -> str:
    """Binomial tail through log-gamma, term by term."""
    term = f"exp(lgamma({a} + {b} + 1) - lgamma(i + 1) - lgamma({a} + {b} - i + 1) - ({a} + {b}) * ln(2.0::DOUBLE))"
    return f"""SELECT {keys}, {a}, {b}, CASE WHEN {a} = {b} THEN 1.0::DOUBLE
        ELSE least(1.0::DOUBLE, 2 * sum({term})) END AS p
      FROM {source}, LATERAL (SELECT unnest(range(0, least({a}, {b}) + 1)) AS i) GROUP BY {keys}, {a}, {b}"""


FRAGMENTS["wins"] = f"""SELECT alpha, count(*) AS n_queries,
    {cnt('u_correct = 1 AND r_correct = 0')} AS utility_only_accuracy_wins,
    {cnt('u_correct = 0 AND r_correct = 1')} AS risk_aware_accuracy_wins FROM rpairs GROUP BY alpha"""
FRAGMENTS["mcn"] = mcnemar_sql("wins", "alpha, n_queries", "utility_only_accuracy_wins", "risk_aware_accuracy_wins")
_MCN = f"alpha, n_queries, utility_only_accuracy_wins, risk_aware_accuracy_wins, {r('p')} AS mcnemar_p_value"
oracle("mcnemar", f"SELECT {_MCN} FROM mcn")
_DIFFS = (("accuracy", "correct"), ("utility", "realized_utility"), ("regret", "regret"))
FRAGMENTS["diffs"] = "SELECT alpha, " + ", ".join(
    f"{r(f'avg(r_{c} - u_{c})')} AS {n}_difference_risk_minus_utility" for n, c in _DIFFS) + " FROM rpairs GROUP BY alpha"
oracle("mean_differences", "SELECT * FROM diffs")


def intervals(unit: str, source: str) -> dict[str, str]:
    digest = f"sha256('ci{P.seed}|' || g || '|' || unit)"
    return {
        f"units{unit}": source,
        f"draws{unit}": f"""SELECT unit, g * 4 + lane AS b, {poisson(uniform('digest', 'lane'))} AS w FROM (
            SELECT unit, g, {digest} AS digest FROM (SELECT DISTINCT unit FROM units{unit}),
              range({P.resamples // 4}) t(g)), (VALUES (0), (1), (2), (3)) l(lane)""",
        f"means{unit}": f"""SELECT alpha, b, {', '.join(f'sum(w * {n}) / sum(w * n) AS {n}' for n, _ in _DIFFS)}
            FROM units{unit} JOIN draws{unit} USING (unit) WHERE w > 0 GROUP BY alpha, b""",
        f"ci{unit}": "SELECT alpha, " + ", ".join(
            f"{r(f'quantile_cont({n}, {q})')} AS {n}_ci_{e}" for n, _ in _DIFFS
            for e, q in (("lower", 0.025), ("upper", 0.975))) + f" FROM means{unit} GROUP BY alpha",
    }


_UNIT_DIFFS = ", ".join(f"CAST(r_{c} - u_{c} AS DOUBLE) AS {n}" for n, c in _DIFFS)
FRAGMENTS.update(intervals("_q", f"SELECT query_id AS unit, alpha, 1 AS n, {_UNIT_DIFFS} FROM rpairs"))
FRAGMENTS.update(intervals("_h", f"""SELECT CAST(CAST('0x' || substr(query_id, 1, 3) AS INTEGER) AS VARCHAR) AS unit,
    alpha, count(*) AS n, {', '.join(f'sum(CAST(r_{c} - u_{c} AS DOUBLE)) AS {n}' for n, c in _DIFFS)}
    FROM rpairs GROUP BY 1, alpha"""))
for _name, _u in (("paired_tests", "_q"), ("paired_tests_bucketed", "_h")):
    oracle(_name, f"SELECT * FROM (SELECT {_MCN} FROM mcn) JOIN diffs USING (alpha) JOIN ci{_u} USING (alpha)")
FRAGMENTS["segments"] = f"""SELECT l_returnflag, l_linenumber, {cnt("l_linestatus = 'F'")} AS a,
    {cnt("l_linestatus = 'O'")} AS b FROM lineitem GROUP BY 1, 2"""
FRAGMENTS["segp"] = mcnemar_sql("segments", "l_returnflag, l_linenumber", "a", "b")
oracle("mcnemar_segments", f"SELECT l_returnflag, l_linenumber, a, b, {r('p')} AS p FROM segp")

# ------------------------------------------------------------ mechanism, groups, transitions
_TRANSITION = """CASE WHEN u_correct = 0 AND r_correct = 1 THEN 'wrong_to_correct'
    WHEN u_correct = 1 AND r_correct = 0 THEN 'correct_to_wrong'
    WHEN u_correct = 1 THEN 'both_correct' ELSE 'both_wrong' END"""


def _side(s: str, name: str) -> str:
    return f"""{s}_mean AS {name}_predicted_mean, {s}_risk AS {name}_risk, {r(f'lam * {s}_risk')} AS {name}_penalty,
    {r(f'{s}_mean - lam * {s}_risk')} AS {name}_risk_adjusted_score, {s}_correct AS {name}_correct,
    {s}_actual AS {name}_realized_utility"""


_CAND = ", ".join(
    f"max(CASE WHEN s.model = '{m}' THEN {e} END) AS {m}_{n}" for m in M for n, e in (
        ("predicted_mean", "s.mean"), ("risk", "s.risk"), ("risk_adjusted_score", r("s.mean - lam * s.risk")),
        ("correct", "s.correct"), ("realized_utility", "s.actual")))
FRAGMENTS["changed"] = f"""SELECT query_id, p.dataset, p.category, alpha, lam AS "lambda", um AS utility_only_model,
    rm AS risk_aware_model, {_TRANSITION} AS correctness_transition, {_side('u', 'utility_only')},
    {_side('r', 'risk_aware')}, {r('r_mean - u_mean')} AS predicted_mean_difference_risk_minus_utility,
    {r('r_risk - u_risk')} AS risk_difference_risk_minus_utility,
    {r('lam * r_risk - lam * u_risk')} AS penalty_difference_risk_minus_utility,
    {r('(r_mean - lam * r_risk) - (u_mean - lam * u_risk)')} AS score_difference_risk_minus_utility,
    {r('r_actual - u_actual')} AS realized_utility_difference_risk_minus_utility,
    CAST(r_risk < u_risk AS INTEGER) AS lower_risk_selected, CAST(r_mean < u_mean AS INTEGER) AS lower_mean_selected,
    string_agg(s.model, ' > ' ORDER BY s.mean DESC, s.ord) AS mean_ranking,
    string_agg(s.model, ' > ' ORDER BY s.mean - lam * s.risk DESC, s.ord) AS risk_adjusted_ranking, {_CAND}
  FROM pairs p JOIN state s USING (query_id, alpha)
  WHERE abs(alpha - {d(P.mechanism_alpha)}) <= 1e-9 AND um <> rm GROUP BY ALL"""
oracle("changed_decisions", "SELECT * FROM changed")
_MEANS = ", ".join(f"{r(f'avg({c}_difference_risk_minus_utility)')} AS mean_{n}" for n, c in (
    ("predicted_mean_difference", "predicted_mean"), ("risk_difference", "risk"), ("penalty_difference", "penalty"),
    ("score_margin", "score"), ("realized_utility_difference", "realized_utility")))
oracle("mechanism_summary", f"""SELECT max(alpha) AS alpha, max("lambda") AS "lambda", count(*) AS changed_decisions,
    {n('coalesce(sum(lower_risk_selected), 0)')} AS lower_risk_selected_count,
    {r('avg(lower_risk_selected)')} AS lower_risk_selected_rate,
    {n('coalesce(sum(lower_mean_selected), 0)')} AS lower_mean_selected_count,
    {r('avg(lower_mean_selected)')} AS lower_mean_selected_rate, {_MEANS},
    {', '.join(f'''{cnt(f"correctness_transition = '{t}'")} AS {t}''' for t in (
        'wrong_to_correct', 'correct_to_wrong', 'both_correct', 'both_wrong'))} FROM changed""")


def _two(column: str, name: str, difference: str = "") -> str:
    text = f"{r(f'avg(u_{column})')} AS utility_only_{name}, {r(f'avg(r_{column})')} AS risk_aware_{name}"
    if difference:
        text += f", {r(f'avg(r_{column}) - avg(u_{column})')} AS {difference}_difference_risk_minus_utility"
    return text


oracle("group_comparison", f"""SELECT alpha, group_type, group_name, count(*) AS n_queries,
    {_two('correct', 'accuracy', 'accuracy')}, {_two('cost', 'average_cost', 'cost')},
    {_two('latency', 'average_latency')}, {_two('realized_utility', 'mean_utility', 'utility')},
    {_two('regret', 'mean_regret', 'regret')},
    {cnt('u_selected_model = r_selected_model')} AS same_decision_count,
    {cnt('u_selected_model <> r_selected_model')} AS changed_decision_count,
    {r('avg(CAST(u_selected_model <> r_selected_model AS INTEGER))')} AS changed_decision_rate,
    {cnt('r_realized_utility > u_realized_utility')} AS risk_aware_better_count,
    {cnt('u_realized_utility > r_realized_utility')} AS utility_only_better_count,
    {cnt('u_realized_utility = r_realized_utility')} AS equal_utility_count
  FROM (SELECT *, 'overall' AS group_type, 'overall' AS group_name FROM rpairs
    UNION ALL SELECT *, 'dataset', dataset FROM rpairs
    UNION ALL SELECT *, 'subject', category FROM rpairs WHERE dataset = 'd1') GROUP BY alpha, group_type, group_name""")
_GAIN = "round(r_realized_utility - u_realized_utility, 6)"
oracle("selection_transitions", f"""SELECT alpha, u_selected_model AS utility_only_model,
    r_selected_model AS risk_aware_model, count(*) AS count, {cnt(f'{_GAIN} > 0')} AS risk_better_count,
    {cnt(f'{_GAIN} < 0')} AS utility_better_count, {cnt(f'{_GAIN} = 0')} AS equal_count,
    {r(f'avg({_GAIN})')} AS mean_utility_difference, {r('avg(round(r_regret - u_regret, 6))')} AS mean_regret_difference
  FROM rpairs WHERE u_selected_model <> r_selected_model GROUP BY 1, 2, 3""")

# ------------------------------------------------------------ prediction and ranking errors
FRAGMENTS["perr"] = f"""SELECT query_id, dataset, category, alpha, model, mean AS predicted_utility,
    risk AS predictive_risk, actual AS realised_utility, correct, raw_cost, cost AS cost_clean,
    {r('mean - actual')} AS prediction_error, {r('abs(mean - actual)')} AS abs_prediction_error,
    {r('(mean - actual) * (mean - actual)')} AS squared_prediction_error FROM state WHERE split = 'test'"""
oracle("prediction_errors", "SELECT * FROM perr")
_ERR = f"""count(*) AS n, {r('avg(abs_prediction_error)')} AS mae,
    {r('quantile_cont(abs_prediction_error, 0.5)')} AS median_abs_error,
    {r('quantile_cont(abs_prediction_error, 0.9)')} AS p90_abs_error,
    {r('sqrt(avg(prediction_error * prediction_error))')} AS rmse, {r('avg(prediction_error)')} AS mean_signed_error,
    {r('avg(predictive_risk)')} AS mean_risk"""
for _name, _keys in (("error_by_model", "alpha, model"), ("error_by_model_scaled", "alpha, model"),
                     ("error_by_category", "alpha, category"), ("error_by_model_category", "alpha, category, model")):
    oracle(_name, f"SELECT {_keys}, {_ERR} FROM perr GROUP BY {_keys}")
FRAGMENTS["cmp"] = """SELECT a.query_id, a.alpha, a.model AS model_a, b.model AS model_b, a.ord AS oa, b.ord AS ob,
    round(a.mean - b.mean, 8) AS pd, round(a.actual - b.actual, 6) AS rd
  FROM state a JOIN state b ON a.query_id = b.query_id AND a.alpha = b.alpha AND a.ord < b.ord WHERE a.split = 'test'"""
FRAGMENTS["inv"] = f"""SELECT query_id, alpha, {cnt('pd <> 0 AND rd <> 0')} AS valid,
    {cnt('pd <> 0 AND rd <> 0 AND sign(pd) <> sign(rd)')} AS inversions,
    coalesce(string_agg(CASE WHEN pd <> 0 AND rd <> 0 AND sign(pd) <> sign(rd) THEN model_a || '>' || model_b END, ';'
      ORDER BY oa, ob), '') AS reversed_pairs FROM cmp GROUP BY query_id, alpha"""
FRAGMENTS["tops"] = """SELECT *, row_number() OVER (PARTITION BY query_id, alpha ORDER BY mean DESC, ord) AS pr,
    row_number() OVER (PARTITION BY query_id, alpha ORDER BY actual DESC, ord) AS ar FROM state WHERE split = 'test'"""
FRAGMENTS["rank_rows"] = f"""SELECT query_id, alpha, dataset, category, predicted_top_model, realised_top_model,
    CAST(predicted_top_model = realised_top_model AS INTEGER) AS top1_match, predicted_top_utility,
    predicted_second_utility, round(predicted_top_utility - predicted_second_utility, 8) AS predicted_margin,
    {r('predicted_top_utility - top_actual')} AS selected_prediction_error,
    {r('abs(predicted_top_utility - top_actual)')} AS selected_abs_error, selected_risk, mean_abs_error_all_models,
    max_abs_error_all_models, round(best_actual - top_actual, 6) AS realised_regret,
    CAST(round(best_actual - top_actual, 6) > {d(P.material_regret)} AS INTEGER) AS material_failure,
    CAST(inversions AS INTEGER) AS pairwise_inversions, CAST(valid AS INTEGER) AS valid_pairwise_comparisons,
    CASE WHEN valid > 0 THEN {r('inversions / valid::DOUBLE')} END AS pairwise_inversion_rate, reversed_pairs
  FROM (SELECT query_id, alpha, dataset, category, max(CASE WHEN pr = 1 THEN model END) AS predicted_top_model,
      max(CASE WHEN ar = 1 THEN model END) AS realised_top_model,
      max(CASE WHEN pr = 1 THEN mean END) AS predicted_top_utility,
      max(CASE WHEN pr = 2 THEN mean END) AS predicted_second_utility,
      max(CASE WHEN pr = 1 THEN actual END) AS top_actual, max(CASE WHEN ar = 1 THEN actual END) AS best_actual,
      max(CASE WHEN pr = 1 THEN risk END) AS selected_risk, {r('avg(abs(mean - actual))')} AS mean_abs_error_all_models,
      {r('max(abs(mean - actual))')} AS max_abs_error_all_models
    FROM tops GROUP BY query_id, alpha, dataset, category) JOIN inv USING (query_id, alpha)"""
oracle("ranking_errors", "SELECT * FROM rank_rows")
oracle("pairwise_reversals", f"""SELECT alpha, model_a, model_b, {cnt('v')} AS n_queries, {cnt('x')} AS n_reversals,
    CASE WHEN {cnt('v')} > 0 THEN {r(f"{cnt('x')} / {cnt('v')}::DOUBLE")} END AS reversal_rate,
    {r('avg(CASE WHEN v THEN abs(pd) END)')} AS mean_predicted_gap,
    {r('avg(CASE WHEN v THEN abs(rd) END)')} AS mean_realised_gap
  FROM (SELECT *, pd <> 0 AND rd <> 0 AS v, pd <> 0 AND rd <> 0 AND sign(pd) <> sign(rd) AS x FROM cmp)
  GROUP BY alpha, model_a, model_b""")
_BY_MATCH = ", ".join(
    f"{r(f'avg(CASE WHEN top1_match = {v} THEN {c} END)')} AS ranking_{w}_mean_{m}" for m, c in (
        ("margin", "predicted_margin"), ("abs_error", "selected_abs_error"), ("risk", "selected_risk"),
        ("regret", "realised_regret")) for w, v in (("correct", 1), ("wrong", 0)))
oracle("ranking_summary", f"""SELECT alpha, count(*) AS n_queries, {r('avg(top1_match)')} AS top1_match_rate,
    {r('1 - avg(top1_match)')} AS top1_ranking_error_rate,
    {r('avg(pairwise_inversion_rate)')} AS mean_pairwise_inversion_rate,
    {r('avg(predicted_margin)')} AS mean_predicted_margin, {_BY_MATCH},
    {r('avg(material_failure)')} AS material_failure_rate FROM rank_rows GROUP BY alpha""")


def ranking_metrics(margin: str, error: str, risk: str) -> str:
    return f"""count(*) AS n_queries, {r('avg(top1_match)')} AS top1_match_rate,
    {r('avg(predicted_margin)')} AS {margin}, {r('avg(selected_abs_error)')} AS {error},
    {r('avg(selected_risk)')} AS {risk}, {r('avg(realised_regret)')} AS mean_regret,
    {r('avg(material_failure)')} AS material_failure_rate,
    {r('avg(pairwise_inversion_rate)')} AS mean_pairwise_inversion_rate"""


oracle("ranking_by_category", f"""SELECT alpha, category,
    {ranking_metrics('mean_predicted_margin', 'mean_selected_abs_error', 'mean_selected_risk')}
    FROM rank_rows GROUP BY alpha, category""")
FRAGMENTS["medges"] = """SELECT alpha, quantile_cont(predicted_margin, [0.0, 0.2, 0.4, 0.6, 0.8]) AS q
    FROM rank_rows GROUP BY alpha"""
FRAGMENTS["mbins"] = "SELECT x.*, 1 + " + " + ".join(
    f"CAST(q[{i}] < predicted_margin AND q[{i}] > q[{i - 1}] AS INTEGER)" for i in range(2, 6)) + """ AS bin
    FROM rank_rows x JOIN medges USING (alpha)"""
for _name in ("ranking_by_margin", "ranking_by_margin_scaled"):
    oracle(_name, f"""SELECT alpha, CASE bin WHEN 1 THEN 'Q1 smallest' WHEN 5 THEN 'Q5 largest' ELSE 'Q' || bin END
        AS margin_quintile, {ranking_metrics('mean_margin', 'mean_abs_error', 'mean_risk')}
        FROM mbins GROUP BY alpha, bin""")

# ------------------------------------------------------------ policy comparison
_STD = """alpha, accuracy, avg_cost AS average_cost, mean_utility AS mean_realized_utility, mean_regret,
    oracle_utility AS mean_oracle_utility, avg_latency AS average_latency, n_queries AS num_queries,
    NULL::DOUBLE AS lam"""
_ROUTER = """alpha, accuracy, average_cost, mean_realized_utility, mean_regret, mean_oracle_utility,
    average_latency, num_queries, lam"""
_LABEL = "CASE router WHEN 'utility_only' THEN 'Utility-only' ELSE 'Risk-aware' END"
FRAGMENTS["fixedrows"] = _FIXED
FRAGMENTS["bestrows"] = _BEST
FRAGMENTS["catrows"] = f"SELECT alpha, {metrics()} FROM cchoice WHERE split = 'test' AND model = pick GROUP BY alpha"
FRAGMENTS["policies"] = f"""
  SELECT {_STD}, upper(policy) AS policy, 'fixed_model' AS policy_family, policy[7:] AS selected_model FROM fixedrows
  UNION ALL SELECT {_STD}, policy, 'best_fixed', validation_selected_model FROM bestrows
  UNION ALL SELECT {_STD}, 'Category-only', 'category_router', NULL FROM catrows
  UNION ALL SELECT {_ROUTER}, 'Full ' || {_LABEL}, 'full_ensemble', NULL FROM (
    SELECT alpha, lam, router, {summary(False)} FROM tdec GROUP BY alpha, lam, router)
  UNION ALL SELECT {_ROUTER}, 'No-category ' || {_LABEL}, 'no_category_ensemble', NULL FROM (
    SELECT alpha, lam, router, {summary(False)} FROM tdec_ab GROUP BY alpha, lam, router)"""


def pareto_flag(source: str) -> str:
    ta, tc = d(P.accuracy_tolerance), d(P.cost_tolerance)
    return f"""SELECT *, NOT EXISTS (SELECT 1 FROM {source} j WHERE j.accuracy >= i.accuracy - {ta}
        AND j.average_cost <= i.average_cost + {tc}
        AND (j.accuracy > i.accuracy + {ta} OR j.average_cost < i.average_cost - {tc})) AS accuracy_cost_pareto
      FROM {source} i"""


FRAGMENTS["flagged"] = pareto_flag("policies")
oracle("policy_comparison", 'SELECT * RENAME (lam AS "lambda") FROM flagged')
oracle("policy_null_counts", " UNION ALL ".join(
    f"""SELECT '{c}' AS column, count(*) - count({'lam' if c == 'lambda' else c}) AS nulls FROM policies""" for c in (
        "alpha", "accuracy", "average_cost", "mean_realized_utility", "mean_regret", "mean_oracle_utility", "average_latency",
        "num_queries", "lambda", "policy", "policy_family", "selected_model")))
oracle("pareto_rows", 'SELECT * RENAME (lam AS "lambda") FROM flagged WHERE accuracy_cost_pareto')
oracle("operating_points", """SELECT policy, string_agg(CAST(alpha AS VARCHAR), ',' ORDER BY alpha) AS alpha_values,
    arg_min(accuracy, alpha) AS accuracy, arg_min(average_cost, alpha) AS average_cost,
    min(mean_realized_utility) AS mean_utility_min, max(mean_realized_utility) AS mean_utility_max,
    min(mean_regret) AS mean_regret_min, max(mean_regret) AS mean_regret_max, count(*) AS num_alpha_settings
  FROM flagged WHERE accuracy_cost_pareto GROUP BY policy, round(accuracy, 6), round(average_cost, 9)""")
FRAGMENTS["suppliers"] = f"""SELECT l_suppkey, {r("avg(CAST(l_returnflag <> 'R' AS DOUBLE))", 4)} AS accuracy,
    {r('avg(l_extendedprice)', 2)} AS average_cost FROM lineitem GROUP BY l_suppkey"""
oracle("supplier_front", pareto_flag("suppliers"))

# ------------------------------------------------------------ streaming
FRAGMENTS["ev"] = f"""SELECT event_id, ts, user_id AS query, 'm' || (event_id % {K}) AS model,
    CAST(event_type <> 'error' AS INTEGER) AS correct, value AS cost,
    CAST(json_extract_string(props, '$.k') AS BIGINT) AS tokens FROM events"""
for _name in ("stream_ingestion", "stream_ingestion_restarts"):
    oracle(_name, "SELECT * FROM ev")
_EPOCH = "TIMESTAMP '1970-01-01 00:00:00'"
_CARD = f"""window_start, window_end, model, count(*) AS n, {r('avg(correct)')} AS accuracy,
    {r('avg(cost)')} AS mean_cost, {r('sum(cost)', 6)} AS total_cost"""
oracle("stream_scorecard", f"""SELECT {_CARD} FROM (SELECT *, time_bucket(INTERVAL 1 DAY, ts, {_EPOCH}) AS window_start,
      time_bucket(INTERVAL 1 DAY, ts, {_EPOCH}) + INTERVAL 1 DAY AS window_end FROM ev)
    GROUP BY window_start, window_end, model""")
oracle("stream_scorecard_sliding", f"""SELECT {_CARD} FROM (
      SELECT *, time_bucket(INTERVAL 12 HOUR, ts, {_EPOCH}) - to_hours(12 * i) AS window_start,
        time_bucket(INTERVAL 12 HOUR, ts, {_EPOCH}) - to_hours(12 * i) + INTERVAL 2 DAY AS window_end
      FROM ev, range(4) t(i))
    GROUP BY window_start, window_end, model""")
_LACKS = " || ".join(f"CASE WHEN {cnt(f'''model = '{m}' ''')} = 0 THEN ',{m}' ELSE '' END" for m in M)
oracle("stream_completeness", f"""SELECT window_start, window_start + INTERVAL 7 DAY AS window_end, query,
    count(*) AS n, ltrim({_LACKS}, ',') AS missing
  FROM (SELECT *, time_bucket(INTERVAL 7 DAY, ts, {_EPOCH}) AS window_start FROM ev)
  GROUP BY window_start, query HAVING count(DISTINCT model) < {K}""")
oracle("stream_grading", f"""SELECT g.*, CAST(length(answer) AS BIGINT) AS prompt_tokens,
    l_orderkey % 500 AS completion_tokens,
    round(length(answer) / 1000000.0::DOUBLE * pin + (l_orderkey % 500) / 1000000.0::DOUBLE * pout, 8) AS cost
  FROM graded g JOIN (VALUES {_PRICES}) p(price_model, pin, pout) ON price_model = g.model""")
oracle("stream_decisions", f"SELECT {_DECISION}, router FROM tdec")

# ------------------------------------------------------------ reshaping
oracle("wide_predictions_to_long", """SELECT query_id, alpha, model, mean AS predicted_utility,
    risk AS predictive_risk FROM state WHERE split = 'test'""")
oracle("wide_utilities_to_long", "SELECT query_id, model, alpha, utility AS realised_utility FROM ua")
oracle("outcomes_wide", "SELECT query_id, " + ", ".join(
    f"max(CASE WHEN model = '{m}' THEN {v} END) AS {v}_{m}" for v in ("correct", "raw_cost") for m in M)
    + " FROM obs GROUP BY query_id")
