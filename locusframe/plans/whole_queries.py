"""The queries over the first letters of the documents again, as name_whole over whole documents."""

from __future__ import annotations

from functools import partial

from . import model_queries, sequence_queries, source_queries  # noqa: F401  they register the queries
from . import views as V
from .registry import ORACLES, QUERIES, query

NAMES = """one_hot_sequence one_hot_decode one_hot_with_signal ngram_matrix conv_norm kmer_count kmer_extract kmer_count_approx
ngram_vocab_features pwm_score best_motif_center dinucleotide_shuffle random_features featurize_sequence
scan_regions scan_windows write_windows scan_seq_train scan_seq_test scan_seq_concord""".split()

for _name in NAMES:
    _sql = ORACLES[_name].replace(V.CTE["sequences"], V.CTE["whole_sequences"])
    query(f"{_name}_whole", _sql)(partial(QUERIES[_name], view=V.whole_sequences))
