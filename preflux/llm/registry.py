"""Queries of the training-data operators, with SQL where SQL can express them."""

from __future__ import annotations

import corpus_pipeline

from .bpe import op4_pair_index_bpe
from .decontaminate import OP7_SQL, op7_benchmark_containment
from .hard_negatives import OP13_SQL, op13_radix_negatives
from .language_model import op2_backoff_automaton
from .multi_index import OP12_SQL, op12_multi_index
from .pii import op3_shape_field
from .prefix_trie import OP11_SQL, op11_prefix_owners
from .quality import op8_decision_list
from .sharding import op6_bounded_ring
from .simhash import op1_vantage_simhash
from .suffix_dedup import op9_parsed_suffixes
from .substring import op5_window_dedup
from .url_filter import op10_redirect_rules

QUERIES = {
    "pipeline": corpus_pipeline.run,
    "op1_vantage_simhash": op1_vantage_simhash,
    "op2_backoff_automaton": op2_backoff_automaton,
    "op3_shape_field": op3_shape_field,
    "op4_pair_index_bpe": op4_pair_index_bpe,
    "op5_window_dedup": op5_window_dedup,
    "op6_bounded_ring": op6_bounded_ring,
    "op7_benchmark_containment": op7_benchmark_containment,
    "op8_decision_list": op8_decision_list,
    "op9_parsed_suffixes": op9_parsed_suffixes,
    "op10_redirect_rules": op10_redirect_rules,
    "op11_prefix_owners": op11_prefix_owners,
    "op12_multi_index": op12_multi_index,
    "op13_radix_negatives": op13_radix_negatives,
}
ORACLES = {"op7_benchmark_containment": OP7_SQL, "op11_prefix_owners": OP11_SQL, "op12_multi_index": OP12_SQL, "op13_radix_negatives": OP13_SQL}
if corpus_pipeline.ORACLE_SQL:
    ORACLES["pipeline"] = corpus_pipeline.ORACLE_SQL
