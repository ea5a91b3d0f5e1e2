"""The queries of this subpackage, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import decontam, divergence, licenses, lines, lm, media, ngrams, packing, pii, quality, suffixes, urls, whitening

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_media": media.op1_media,
    "op2_quality": quality.op2_quality,
    "op3_pii": pii.op3_pii,
    "op4_urls": urls.op4_urls,
    "op5_ngrams": ngrams.op5_ngrams,
    "op6_lines": lines.op6_lines,
    "op7_lm": lm.op7_lm,
    "op8_suffixes": suffixes.op8_suffixes,
    "op9_packing": packing.op9_packing,
    "op10_decontam": decontam.op10_decontam,
    "op11_licenses": licenses.op11_licenses,
    "op12_divergence": divergence.op12_divergence,
    "op13_whitening": whitening.op13_whitening,
}
ORACLE_SQL: dict[str, str] = {"op4_urls": urls.OP4_SQL, "op5_ngrams": ngrams.OP5_SQL, "op6_lines": lines.OP6_SQL, "op8_suffixes": suffixes.OP8_SQL, "op10_decontam": decontam.OP10_SQL, "op11_licenses": licenses.OP11_SQL, "op12_divergence": divergence.OP12_SQL}
