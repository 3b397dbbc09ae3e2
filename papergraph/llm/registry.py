"""Queries of this subpackage and their SQL, by name."""

from __future__ import annotations

from . import fill_in_middle, jpeg, langid, line_frequency, markov, mixing, near_dedup, packing, personal_data, secrets, toxicity, unit_dedup, zone_clusters
from .sql import SQL


def queries() -> dict:
    return {
        "op1_hyperdimensional_language": langid.op1_hyperdimensional_language,
        "op2_linked_secrets": secrets.op2_linked_secrets,
        "op3_jpeg_payload": jpeg.op3_jpeg_payload,
        "op4_counterfactual_toxicity": toxicity.op4_counterfactual_toxicity,
        "op5_line_dedup": unit_dedup.op5_line_dedup,
        "op6_hierarchical_packing": packing.op6_hierarchical_packing,
        "op7_hidden_markov": markov.op7_hidden_markov,
        "op8_pareto_mix": mixing.op8_pareto_mix,
        "op9_line_frequency": line_frequency.op9_line_frequency,
        "op10_minhash_postings": near_dedup.op10_minhash_postings,
        "op11_fill_in_middle": fill_in_middle.op11_fill_in_middle,
        "op12_zone_map_clusters": zone_clusters.op12_zone_map_clusters,
        "op13_boosted_candidates": personal_data.op13_boosted_candidates,
    }


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
