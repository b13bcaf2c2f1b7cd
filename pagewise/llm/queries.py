"""The registered queries of the training-data operators, over whole tables."""

from __future__ import annotations

import public_tokenizers

from pagewise.llm import (backoff, collocations, filter_audit, jaccard_trie, main_text, pattern_packing, pieces, piecewise, preference,
                          sharding, toxicity, url_templates, winnowing)
from pagewise.llm.common import table


def op1_shard_rows(spark, sf_dir):
    return sharding.shard_documents(table(spark, sf_dir, "documents"))


def op2_preference_pairs(spark, sf_dir):
    return preference.preference_rows(table(spark, sf_dir, "conversations"))


def op3_jaccard_join(spark, sf_dir):
    return jaccard_trie.jaccard_classes(table(spark, sf_dir, "documents"))


def op4_backoff_scores(spark, sf_dir):
    return backoff.score_documents(table(spark, sf_dir, "documents"))


def op5_main_text(spark, sf_dir):
    return main_text.extract_pages(table(spark, sf_dir, "pages"))


def op6_decontaminate(spark, sf_dir):
    return winnowing.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_toxicity(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return toxicity.score_documents(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def op8_piecewise_hash(spark, sf_dir):
    return piecewise.neighbour_fingerprints(table(spark, sf_dir, "documents"))


def op9_encode_decode(spark, sf_dir):
    return pieces.round_trips(table(spark, sf_dir, "documents"))


def op10_url_verdicts(spark, sf_dir):
    return url_templates.url_verdicts(table(spark, sf_dir, "pages"))


def op11_filter_audit(spark, sf_dir):
    return filter_audit.audit_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_pattern_packing(spark, sf_dir):
    return pattern_packing.pack(spark, table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op13_collocations(spark, sf_dir):
    return collocations.collocations(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_shard_rows, op2_preference_pairs, op3_jaccard_join, op4_backoff_scores, op5_main_text, op6_decontaminate,
                                op7_toxicity, op8_piecewise_hash, op9_encode_decode, op10_url_verdicts, op11_filter_audit,
                                op12_pattern_packing, op13_collocations)}
