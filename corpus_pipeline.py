"""The corpus pipeline: quality rules, exact and near duplicates, mixing, packing.

Each stage works on all that the one before kept. It is written as Parquet and
read again, so a stage that fails is rerun from its predecessor's table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stowage.llm.common import table
from stowage.llm.dedup import exact_dedup
from stowage.llm.jaccard import jaccard_join
from stowage.llm.mixing import mix_sources
from stowage.llm.packing import pack
from stowage.llm.quality import quality
from stowage.llm.tokens import tokenizer_path
from stowage.plans.scratch import broadcast_if_small, materialise


#: Columns that the stages read; others pass through, whatever their names.
READ = ("doc_id", "text", "source")


def hidden(docs: DataFrame) -> DataFrame:
    """``docs`` with other columns under names that no operator uses."""
    return docs.withColumnsRenamed({c: f"_own_{c}" for c in docs.columns if c not in READ})


def shown(out: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of ``docs`` of a result made from ``hidden(docs)``."""
    return out.select(*[F.col(c if c in READ else f"_own_{c}").alias(c) for c in docs.columns])


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules keep.

    Null and empty texts have no words and go; a text of any length is judged
    whole; repeated rows are judged alike; null ids are judged as unlabelled
    documents are; an empty table stays empty.
    """
    return shown(quality(hidden(docs), table(spark, sf_dir, "labels"), carry=True).where("kept"), docs)


def exact_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every group of equal texts: the one with the largest id.

    A null text equals an empty one; a null id stays only where its group has
    no other; of repeated rows one stays; texts of any length are compared
    whole; an empty table stays empty.
    """
    return shown(exact_dedup(hidden(docs), carry=True).where("kept"), docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of every group of texts that share 80 percent or more of their five-word shingles.

    Rows that share an id are one document, which stays or goes as a whole.
    Rows with a null id and texts without words are linked with nothing and
    stay; a text of any length has all its shingles; an empty table stays
    empty.
    """
    joined = materialise(jaccard_join(docs, percent=80, width=5).select("doc_id", "component_id"), "joined")
    others = joined.where(F.col("doc_id") != F.col("component_id")).select("doc_id").distinct()
    return docs.join(broadcast_if_small(others, 1_000_000), "doc_id", "left_anti").select(*docs.columns)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated or left out so that sources have equal shares.

    A null source is a source of its own; null and empty texts have no
    volume; rows equal in id and text draw alike; null ids draw by their
    text; an empty table stays empty.
    """
    return shown(mix_sources(hidden(docs)), docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of 2048 tokens: one row for every piece of every row.

    Null texts count as empty and hold the end id alone; longer texts are cut
    and none is dropped; null and repeated ids are packed like others; an
    empty table gives no pieces.
    """
    return pack(docs, tokenizer_path("byte_bpe_50k.json"))


STAGES = [
    ("quality_rules", quality_rules),
    ("exact_duplicates", exact_duplicates),
    ("near_duplicates", near_duplicates),
    ("mixing", mixing),
    ("packing", packing),
]

#: Tokens and hashed n-grams are not expressible in SQL; the tests rerun the stages in plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return docs
