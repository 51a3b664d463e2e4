"""Registered queries of this package and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import decontaminate, fingerprints, jaccard, langid, lexical, licences, lm_score, mixing, packing, pii, token_files, url_lists, whitening

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_fingerprints": fingerprints.op1,
    "op2_decontaminate": decontaminate.op2,
    "op3_jaccard_join": jaccard.op3,
    "op4_token_files": token_files.op4,
    "op5_best_fit_packing": packing.op5,
    "op6_url_lists": url_lists.op6,
    "op7_language_id": langid.op7,
    "op8_licences": licences.op8,
    "op9_pii_surrogates": pii.op9,
    "op10_lm_scores": lm_score.op10,
    "op11_ranked_search": lexical.op11,
    "op12_source_mix": mixing.op12,
    "op13_whitening": whitening.op13,
}

SQL: dict[str, str] = {"op6_url_lists": url_lists.OP6_SQL, "op11_ranked_search": lexical.OP11_SQL}
