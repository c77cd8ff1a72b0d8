"""A training corpus from `documents`: toxic texts go, copies and near copies go, sources are mixed
to target weights, and the rest is packed into sequences.

Each stage takes (spark, docs, sf_dir), works on all that the one before kept, and returns a
DataFrame that is written as Parquet and read again as the next one's docs. All but the last return
the columns of documents.

Every stage reads whole texts, of any length; null counts as empty; an empty table gives an empty one;
more columns are carried, whatever their names, but for the last stage, which has its own. Rows are
told apart by all their columns, so null and repeated ids lose no text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lakelens.llm import exactdup, minhash, mixing, packing, toxicity
from lakelens.llm.common import scratch


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model scores below 0.5.

    Rows are scored each by their own text; empty ones have the score of no terms, equal ones equal
    scores. Rows without an id are never learnt from. Without labels of both kinds the score is the
    share of toxic labels, 0 without any, so all rows stay.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.without_toxic(docs, toxicity.train(docs, labels))


def exact_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of texts equal but for white space.

    The longest stays, then the one of least id, nulls last, then of least row hash; null and empty
    texts are one group.
    """
    return exactdup.deduplicated(docs)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by five-word shingles at a similarity of 0.8 or more.

    That of least id stays, nulls last, then of least row hash. Texts without words link with nothing
    and stay; rows that agree in every column count once.
    """
    return minhash.deduplicated(docs, words=5, similarity=(80, 100))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as many times as the mix of sources takes it.

    Null sources are one source. Repeated rows are documents of their own; those without words have
    nothing to give and aren't taken. Ties in the order go by size, id and row hash.
    """
    return mixing.mixed(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents with their sequence and place; a bin holds one piece of a source.

    Copies get numbers of their own and conflict. Texts without words have one piece and no bin. Ties
    in size go by id, copy and piece, so reruns agree. Its columns are doc_id, copy, piece, length,
    bin_id and start.
    """
    return packing.pack(docs)


STAGES = [
    ("toxicity", toxicity_stage),
    ("exact_dedup", exact_dedup_stage),
    ("near_dedup", near_dedup_stage),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]

#: A learnt model, random draws and chains of links are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to documents, each result written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    base = scratch(spark)
    for i, (name, stage) in enumerate(STAGES):
        path = f"{base}/{i}_{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
