"""Queries of the training-data operators and their SQL."""

from __future__ import annotations

from tessera.llm.counts import op6_resynchronised_counts
from tessera.llm.decontamination import op2_blockmax_decontamination
from tessera.llm.html import op4_max_subsequence_html
from tessera.llm.lines import OP10_SQL, op10_window_line_dedup
from tessera.llm.media import op8_iso_media
from tessera.llm.middle import OP11_SQL, op11_fill_in_middle
from tessera.llm.minhash import OP13_SQL, op13_minhash_coordinates
from tessera.llm.mixing import OP3_SQL, op3_temperature_mix
from tessera.llm.phrases import OP12_SQL, op12_weighted_collocations
from tessera.llm.sharding import OP9_SQL, op9_prefix_sum_shards
from tessera.llm.simhash import op7_simhash_anchors
from tessera.llm.tokens import op5_ranked_varint_tokens
from tessera.llm.toxicity import op1_noisy_or_toxicity


def queries() -> dict:
    return {
        "op1_noisy_or_toxicity": op1_noisy_or_toxicity,
        "op2_blockmax_decontamination": op2_blockmax_decontamination,
        "op3_temperature_mix": op3_temperature_mix,
        "op4_max_subsequence_html": op4_max_subsequence_html,
        "op5_ranked_varint_tokens": op5_ranked_varint_tokens,
        "op6_resynchronised_counts": op6_resynchronised_counts,
        "op7_simhash_anchors": op7_simhash_anchors,
        "op8_iso_media": op8_iso_media,
        "op9_prefix_sum_shards": op9_prefix_sum_shards,
        "op10_window_line_dedup": op10_window_line_dedup,
        "op11_fill_in_middle": op11_fill_in_middle,
        "op12_weighted_collocations": op12_weighted_collocations,
        "op13_minhash_coordinates": op13_minhash_coordinates,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op3_temperature_mix": OP3_SQL,
        "op9_prefix_sum_shards": OP9_SQL,
        "op10_window_line_dedup": OP10_SQL,
        "op11_fill_in_middle": OP11_SQL,
        "op12_weighted_collocations": OP12_SQL,
        "op13_minhash_coordinates": OP13_SQL,
    }
