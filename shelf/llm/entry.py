"""Queries of the corpus operators, one ``opN_<name>`` each, and the pipeline."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline
from shelf.llm import decontam, linededup, media, mixing, neardup, oracle, pii, planes, quality, secrets, sharding

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_pii": pii.op1_pii,
    "op2_media": media.op2_media,
    "op3_neardup": neardup.op3_neardup,
    "op4_sharding": sharding.op4_sharding,
    "op5_lines": linededup.op5_lines,
    "op6_quality": quality.op6_quality,
    "op7_decontam": decontam.op7_decontam,
    "op8_planes": planes.op8_planes,
    "op9_secrets": secrets.op9_secrets,
    "op10_mixing": mixing.op10_mixing,
    "pipeline": corpus_pipeline.run,
}

#: SQL for those queries that SQL can express over whole tables; the others have
#: brute-force tests.
ORACLE_SQL: dict[str, str] = dict(oracle.ORACLE_SQL)
