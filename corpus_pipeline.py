"""A pipeline over ``documents``: each stage is written as Parquet and read again as the next one's input.

In order: documents of no recognised language go; of equal texts the one with the largest
id stays; of near copies the one with the smallest; sources are mixed to their targets, so
that documents go or come twice; what is left is encoded, and decoded to check. Rows with
null ids or texts, and repeated rows, go through as each operator says.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from eventloom.llm import exact_dedup, language, mixing, pieces, simhash
from eventloom.llm.common import documents, pin
from eventloom.llm.queries import PIECES
from eventloom.session import tune

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
STAGES: list[tuple[str, Stage]] = [
    ("language", lambda spark, docs, sf_dir: language.recognised(docs, PIECES)),
    ("exact_dedup", lambda spark, docs, sf_dir: exact_dedup.distinct_texts(docs)),
    ("near_dedup", lambda spark, docs, sf_dir: simhash.one_of_each(docs)),
    ("mix", lambda spark, docs, sf_dir: mixing.mixed(docs)),
    ("encode", lambda spark, docs, sf_dir: pieces.encode(docs, PIECES)),
]
#: Digests in the mix, fingerprints and pieces are beyond SQL; see tests/llm/test_pipeline.py.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(tune(spark), sf_dir)
    for name, stage in STAGES[:-1]:
        docs = pin(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
