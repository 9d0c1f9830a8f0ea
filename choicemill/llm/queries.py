"""Registered queries of this subpackage and their SQL."""

from __future__ import annotations

from choicemill.llm import (
    html_extraction,
    knn,
    language_id,
    lexical_search,
    minhash_dedup,
    packing,
    phrase_mining,
    pieces,
    quality_rules,
    ready,
    secret_scan,
    substring_dedup,
    toxicity,
    warc_fixity,
)

_OPERATORS = [
    substring_dedup.op1_substring_dedup, minhash_dedup.op2_minhash_dedup, quality_rules.op3_quality_rules, quality_rules.quality_rule_ablation,
    packing.op4_packing, warc_fixity.op5_warc_fixity,
    pieces.op6_sentencepiece_nbest, secret_scan.op7_secret_scan, toxicity.op8_toxicity,
    knn.op9_exact_knn, language_id.op10_language_id,
    phrase_mining.op11_phrase_mining, lexical_search.op12_lexical_search, html_extraction.op13_html_extraction,
]


def _prepared(fn):
    def run(spark, sf_dir):
        return fn(ready(spark), sf_dir)
    run.__name__, run.__doc__ = fn.__name__, fn.__doc__
    return run


QUERIES = {fn.__name__: _prepared(fn) for fn in _OPERATORS}
ORACLES = {"op3_quality_rules": quality_rules.ORACLE, "quality_rule_ablation": quality_rules.ABLATION_ORACLE,
           "op5_warc_fixity": warc_fixity.ORACLE,
           "op9_exact_knn": knn.ORACLE, "op11_phrase_mining": phrase_mining.ORACLE,
           "op12_lexical_search": lexical_search.ORACLE, "op13_html_extraction": html_extraction.ORACLE}
