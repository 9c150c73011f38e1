"""The queries of this subpackage by name, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import ann, convtrie, decontaminate, divergence, langid, licenses, pieces, preference, repeats, ring, simhash, toxicity, warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_warc_chunks": warc.op1_warc_chunks,
    "op2_bounded_ring": ring.op2_bounded_ring,
    "op3_preference_pairs": preference.op3_preference_pairs,
    "op4_suffix_pieces": pieces.op4_suffix_pieces,
    "op5_subword_softmax": langid.op5_subword_softmax,
    "op6_simhash_covering": simhash.op6_simhash_covering,
    "op7_collision_counting": ann.op7_collision_counting,
    "op8_levenshtein_trie": toxicity.op8_levenshtein_trie,
    "op9_license_tfidf": licenses.op9_license_tfidf,
    "op10_fm_index": decontaminate.op10_fm_index,
    "op11_run_columns": divergence.op11_run_columns,
    "op12_repeated_bytes": repeats.op12_repeated_bytes,
    "op13_prefix_trie": convtrie.op13_prefix_trie,
}

ORACLE: dict[str, str] = {
    "op1_warc_chunks": warc.SQL,
    "op3_preference_pairs": preference.SQL,
    "op10_fm_index": decontaminate.SQL,
    "op11_run_columns": divergence.SQL,
    "op12_repeated_bytes": repeats.SQL,
    "op13_prefix_trie": convtrie.SQL,
}
