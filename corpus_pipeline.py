"""From raw documents to token ids, in stages that each apply one operator of the training-data subpackage.

Every stage is written as Parquet to the folder that driver and executors share, and read again as the
next one's documents. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm import bpe, langid, mixing, pii, setjoin
from gridloom.llm.common import shared_dir, written
from gridloom.llm.registry import KEY, table, tokenizer_file

#: A document's language must be this likely.
LEAST_SCORE = 0.5


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is known; those without a letter, or of no likely language, go."""
    model = langid.train(docs, tokenizer_file("piece_bpe_32k.model"))
    found = langid.predict(docs, model)
    return found.filter((F.col("lang_pred") != langid.UNKNOWN) & (F.col("score") >= LEAST_SCORE)).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group whose sets of five-word runs reach a Jaccard similarity of 0.8: that with the least id.

    An id stands for one document: its rows go together, where each of them has a copy under a lesser id. Rows without id can't be
    told from each other and stay.
    """
    groups = setjoin.join(docs, n=5, part=80, whole=100)
    gone = groups.groupBy("doc_id").agg(F.min(F.col("component_id") < F.col("doc_id")).alias("copy")).filter("copy").select("doc_id")
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with pseudonyms for personal values; the number of characters follows."""
    out = pii.pseudonymise(docs, KEY)
    return out.withColumn("n_chars", F.when(F.col("n_pii") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*docs.columns)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, in the order of their place in the mixture of sources. Readers don't keep the order of part files, so ``token_ids`` finds the places again."""
    return mixing.mix(docs, keep=True).orderBy("position").select(*docs.columns)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document and its ``position`` in the mixture of sources, in this order.

    The position follows from ids and sources alone, so it is the one that the stage before sorted by, however its files are read;
    rows that repeat an id of a source may change places with each other.
    """
    placed = mixing.mix(docs, keep=True).orderBy("position")
    return bpe.encode_decode(placed, tokenizer_file("word_bpe_49k.json"), place="position").select("doc_id", "position", "n_tokens", "ids")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("personal_data", personal_data),
    ("mixture", mixture),
    ("token_ids", token_ids),
]

#: Segmentations, groups of near duplicates, permutations and merges are beyond SQL; tests hold the rows against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder."""
    docs, root = table(spark, sf_dir, "documents"), shared_dir(spark)
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs, f"{k}-{name}", root)
    return docs
