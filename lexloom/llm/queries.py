"""The registered queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

from . import decontamination, jaccard_join, media, packing, pii, quality, sharding, token_counts, toxicity, url_filter

QUERIES = {
    "op1_quality": quality.op1_quality,
    "op2_token_counts": token_counts.op2_token_counts,
    "op3_pii": pii.op3_pii,
    "op4_decontamination": decontamination.op4_decontamination,
    "op5_jaccard_join": jaccard_join.op5_jaccard_join,
    "op6_url_filter": url_filter.op6_url_filter,
    "op7_packing": packing.op7_packing,
    "op8_toxicity": toxicity.op8_toxicity,
    "op9_media": media.op9_media,
    "op10_sharding": sharding.op10_sharding,
}
ORACLES = {
    "op5_jaccard_join": jaccard_join.OP5_SQL,
    "op4_decontamination": decontamination.OP4_SQL,
}
