"""A corpus from raw documents to packed training sequences, stage by stage.

Each stage takes ``(spark, docs, sf_dir)`` and works on all that the stage before it
kept. ``run`` writes every stage's result as Parquet to the shared folder and gives
what it reads back to the next one. All stages but the last keep the columns of ``documents``, whatever
others there are and however they are named. In every stage a null text counts as empty, texts of any length
are read whole, a row with a null id stays unless its text is judged, and an empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

import public_tokenizers

from armlens.llm import exact_dedup, packing, pii, simhash, toxicity
from armlens.llm.common import table, tuned
from armlens.sources.session import stored


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored 0.5 or more go; equal texts, empty ones too, have equal scores, so copies stay or go together."""
    return toxicity.without_toxic(docs, table(tuned(spark), sf_dir, "labels"))


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the largest id stays, of empty ones too.

    Rows that repeat that id and text all stay; rows without an id stay only where no equal text has one.
    """
    tuned(spark)
    return exact_dedup.without_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: five-word shingles, similarity 0.8 or more.

    It is the one with the smallest id; its repeats, and rows without an id, stay too. Empty texts are alike.
    """
    tuned(spark)
    return simhash.one_of_each(docs, shingle=5, similarity=0.8)


def sanitise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data and disclosing terms are replaced in the texts, and their lengths set anew.

    Every row stays; null and empty texts, and those without such data, are as they were. Repeated rows change alike.
    """
    tuned(spark)
    return pii.sanitised(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences of 1024 ids, one row per piece of a document.

    An empty or null text is its end id alone. Repeated rows, and rows without an id, are packed like any others.
    """
    tuned(spark)
    packed = packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


STAGES = [
    ("toxicity", reject_toxic),
    ("exact_dedup", drop_exact_copies),
    ("simhash_near_dedup", drop_near_copies),
    ("pii", sanitise),
    ("best_fit_packing", pack),
]

# Learned scores, hash fingerprints and token ids have no form in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(tuned(spark), sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
