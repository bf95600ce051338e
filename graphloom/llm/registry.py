"""Queries of the subpackage and their SQL."""

from __future__ import annotations

import corpus_pipeline

from .ann import OP6_SQL, op6_block_neighbours
from .bpe import op4_bpe_automaton
from .hmm_lm import op10_hidden_markov
from .mixing import OP1_SQL, op1_mix_sources
from .near_dup import OP2_SQL, op2_near_duplicates
from .quality import op8_quality_mcd
from .sharding import OP9_SQL, op9_shard_tree
from .toxicity import op7_string_kernel
from .url_filter import OP5_SQL, op5_url_link_graph
from .warc import OP3_SQL, op3_warc_bundles


def queries() -> dict:
    return {
        "op1_mix_sources": op1_mix_sources,
        "op2_near_duplicates": op2_near_duplicates,
        "op3_warc_bundles": op3_warc_bundles,
        "op4_bpe_automaton": op4_bpe_automaton,
        "op5_url_link_graph": op5_url_link_graph,
        "op6_block_neighbours": op6_block_neighbours,
        "op7_string_kernel": op7_string_kernel,
        "op8_quality_mcd": op8_quality_mcd,
        "op9_shard_tree": op9_shard_tree,
        "op10_hidden_markov": op10_hidden_markov,
        "pipeline": corpus_pipeline.run,
    }


def oracle_sql() -> dict:
    pipeline = {"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {}
    return pipeline | {
        "op1_mix_sources": OP1_SQL,
        "op2_near_duplicates": OP2_SQL,
        "op3_warc_bundles": OP3_SQL,
        "op5_url_link_graph": OP5_SQL,
        "op6_block_neighbours": OP6_SQL,
        "op9_shard_tree": OP9_SQL,
    }
