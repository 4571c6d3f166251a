"""Cleaning and packing a corpus: five stages, each a written table that the next one reads.

    toxicity          documents that the classifier rejects go
    near_duplicates   one document of each class stays
    secrets           secrets are replaced by a mark in the text
    mixing            documents are taken as often as the mix of sources asks for
    packing           documents are encoded, cut and packed into sequences

Each stage takes (spark, docs, sf_dir) and works on all rows of ``docs``; all but the last return the columns of docs.
The toxicity classifier learns from the labels table of ``sf_dir`` and the labelled documents among ``docs``. Nulls, empty and
long texts, ties, repeated rows and empty tables have the results that the operators' docstrings give.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tallymap.llm import mixing, neardup, packing, secrets, toxicity
from tallymap.llm.tables import ship, table
from tallymap.session import write_stage


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return toxicity.drop_toxic(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return neardup.keep_one_of_each(docs)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return secrets.redact_secrets(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return mixing.apply_mix(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return packing.pack_texts(docs, public_tokenizers.path("word_bpe_49k.json"), end_id=1)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", one_of_each),
    ("secrets", redact_secrets),
    ("mixing", mix),
    ("packing", pack),
]

#: SQL can't express these stages; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to the documents."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = write_stage(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
