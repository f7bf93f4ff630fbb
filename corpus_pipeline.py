"""The corpus pipeline: stages over documents, each an operator of the llm subpackage.

Each stage takes what its predecessor kept and returns rows with the columns of documents; the last returns the facts of
the token store. Rows that share a doc_id are documents of their own to the join; of rows alike in id and text one stays.
An empty table passes through every stage and has no facts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spindrift.llm import decontam, langid, mixing
from spindrift.llm.common import crc32_text, documents, staged, table
from spindrift.llm.jaccard_join import filter_by_ids, one_of_each
from spindrift.llm.token_store import Store


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the classifier accepts; null and letterless texts go."""
    held = crc32_text(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 4 == 2
    return langid.keep_accepted(docs, langid.fit(docs, ~held))


def jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked ones, that of the least doc_id. Rows that share a doc_id stay where their texts aren't
    linked, and documents with a null doc_id, without words or without text stay; texts of any length are compared whole."""
    return one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    found = decontam.find(docs, table(spark, sf_dir, "benchmark"))
    return filter_by_ids(docs, staged(spark, found.select(F.col("doc_id").alias("id")).distinct(), "leaks"), "doc_id", "left_anti")


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document at least once; those of sources below the largest up to twice."""
    return mixing.mix_sources(docs).select(*[F.col(f"`{c}`") for c in docs.columns])


def token_store(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids written to the store and read back."""
    import public_tokenizers

    return Store.write(docs, public_tokenizers.path("word_bpe_49k.json")).facts()


STAGES = [("language_id", language_id), ("jaccard_join", jaccard_join), ("decontamination", decontamination), ("source_mixing", source_mixing), ("token_store", token_store)]

#: Hashes, learned centroids and a tokenizer's merges: SQL can't express the stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each stage's rows written and read again."""
    docs = documents(spark, sf_dir)
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = staged(spark, docs, name)
    return docs
