"""The corpus pipeline: five stages over ``documents``, each on all that the one before kept.

All stages take null values in any column, repeated rows, empty tables, and extra columns of any name, which all but the last return: a
null text is an empty one; rows are dropped by id, so rows that share an id go only if all of them are to go; a row with a null id
is judged like any other, except that it takes no part in the near dedup and stays there; of rows with equal id and text one stays."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.llm.common import scratch_path
from cairn.llm.exact_dedup import drop_exact_copies
from cairn.llm.mixing import first_places, mix_sources
from cairn.llm.ngram_join import drop_near_copies
from cairn.llm.packing import pack, token_pieces
from cairn.llm.quality import keep_good


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject."""
    return keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def without_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the one with the most characters, then the smallest id."""
    return drop_exact_copies(docs)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of five-word-shingle Jaccard similarity 0.8 or more."""
    return drop_near_copies(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, in the order that mixes their sources to the target weights."""
    return mix_sources(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str, **settings) -> DataFrame:
    """Pieces of the documents with their place in sequences of at most 2048 tokens; ascending ``sequence_id`` follows the mix.

    The mix depends on ids and sources alone, so the places of the stage before are found again without relying on the
    order of its files. Texts do not move.
    """
    pieces = token_pieces(docs, public_tokenizers.path("byte_bpe_50k.json"), carry=("source",))
    same = F.col("doc_id").eqNullSafe(F.col("__id")) & F.col("source").eqNullSafe(F.col("__source"))
    placed = pieces.join(first_places(docs), same).drop("source", "__id", "__source")
    return pack(placed, order_col="__position", **settings)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", good_quality),
    ("exact dedup", without_exact_copies),
    ("near dedup", without_near_copies),
    ("mix", mixed),
    ("pack", packed),
]

#: Quality, mixing and packing are not expressible in SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what each returns is written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        result = stage(spark, docs, sf_dir)
        path = scratch_path(spark, f"stage-{name.replace(' ', '-')}")
        result.write.parquet(path)
        docs = spark.read.schema(result.schema).parquet(path)
    return docs
