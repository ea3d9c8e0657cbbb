"""The queries of this subpackage and the DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import collocations, flac, licenses, mixing, negatives, packing, pii, secrets, simhash, suffix_dedup, token_counts, topk, toxicity


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_suffix_dedup": suffix_dedup.op1_suffix_dedup,
        "op2_simhash": simhash.op2_simhash,
        "op3_packing": packing.op3_packing,
        "op4_mixing": mixing.op4_mixing,
        "op5_secrets": secrets.op5_secrets,
        "op6_toxicity": toxicity.op6_toxicity,
        "op7_token_counts": token_counts.op7_token_counts,
        "op8_topk": topk.op8_topk,
        "op9_flac": flac.op9_flac,
        "op10_licenses": licenses.op10_licenses,
        "op11_hard_negatives": negatives.op11_hard_negatives,
        "op12_pii": pii.op12_pii,
        "op13_collocations": collocations.op13_collocations,
    }


def oracle_sql() -> dict[str, str]:
    return {"op4_mixing": mixing.OP4_SQL, "op5_secrets": secrets.op5_sql(), "op8_topk": topk.OP8_SQL, "op11_hard_negatives": negatives.OP11_SQL, "op13_collocations": collocations.OP13_SQL}
