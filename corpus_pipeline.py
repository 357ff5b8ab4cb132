"""A training corpus from ``documents``, in stages: language, exact copies, near copies, mixture, packing.

Each stage takes (spark, docs, sf_dir) and works on all rows of ``docs``; its result is written and read again as the
next stage's ``docs``. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sediment.llm.common import cut, kept_rows
from sediment.llm.exactdedup import exact_groups
from sediment.llm.langid import fit_on, keep_identified
from sediment.llm.mixing import mix
from sediment.llm.neardup import near_duplicates
from sediment.llm.packing import pack_documents
from sediment.llm.queries import MIXTURE, tokenizer_path


def identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents whose language the model rejects."""
    return keep_identified(docs, fit_on(docs))


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    return kept_rows(docs, exact_groups(docs))


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that links of 75 percent or more connect."""
    return kept_rows(docs, near_duplicates(docs, 75))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Fewer poor documents, so that good ones make up their share of the tokens; good ones stay, once each."""
    return mix(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), MIXTURE, label_col="quality", whole="1", repeat=False)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of 4096 tokens. Earlier stages leave more Python workers than there are cores, so none keeps a tokenizer."""
    return pack_documents(docs, tokenizer_path("word_bpe_49k.json"), 4096, 1, keep=False)


STAGES = [
    ("language", identified),
    ("exact_dedup", without_copies),
    ("near_dedup", without_near_copies),
    ("mixing", mixed),
    ("packing", packed),
]

#: SQL can express neither the models nor the tokenizer; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
