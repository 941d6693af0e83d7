"""Queries of this subpackage, each over its whole table, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline

from . import hamming, lexical, mixing, njoin, phrases, pieces, quality, revisits, secrets, sharding, substrings, topk, toxicity
from .common import table


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_topk_search": lambda s, d: topk.op1_topk_search(table(s, d, "embeddings")),
        "op2_secret_scans": lambda s, d: secrets.op2_secret_scans(table(s, d, "documents")),
        "op3_substring_dedup": lambda s, d: substrings.op3_substring_dedup(table(s, d, "documents")),
        "op4_mixing_weights": lambda s, d: mixing.op4_mixing_weights(table(s, d, "documents")),
        "op5_toxicity": lambda s, d: toxicity.op5_toxicity(table(s, d, "documents"), table(s, d, "labels")),
        "op6_sentencepiece": lambda s, d: pieces.op6_sentencepiece(table(s, d, "documents")),
        "op7_quality_rules": lambda s, d: quality.op7_quality_rules(table(s, d, "documents")),
        "op8_sharding": lambda s, d: sharding.op8_sharding(table(s, d, "documents")),
        "op9_ngram_jaccard_join": lambda s, d: njoin.op9_ngram_jaccard_join(table(s, d, "documents")),
        "op10_warc_revisits": lambda s, d: revisits.op10_warc_revisits(table(s, d, "pages")),
        "op11_hamming_search": lambda s, d: hamming.op11_hamming_search(table(s, d, "embeddings")),
        "op12_lexical_search": lambda s, d: lexical.op12_lexical_search(table(s, d, "documents"), table(s, d, "benchmark")),
        "op13_phrase_mining": lambda s, d: phrases.op13_phrase_mining(table(s, d, "documents")),
        "pipeline": corpus_pipeline.run,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_topk_search": topk.ORACLE,
        "op2_secret_scans": secrets.ORACLE,
        "op3_substring_dedup": substrings.ORACLE,
        "op8_sharding": sharding.ORACLE,
        "op10_warc_revisits": revisits.ORACLE,
        "op12_lexical_search": lexical.ORACLE,
        "op13_phrase_mining": phrases.ORACLE,
    }
