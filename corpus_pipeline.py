"""The corpus pipeline: toxicity, near-duplicates, decontamination, mixing, token files.

Each stage takes (spark, docs, sf_dir); its result is written as Parquet and read again as the
next one's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessera.llm.common import stored, table
from tessera.llm.decontamination import without_contaminated
from tessera.llm.jaccard import representatives
from tessera.llm.mixing import mixed_rows
from tessera.llm.simhash import first_of_each, keep_rows
from tessera.llm.tokens import token_file_digest, vocabulary
from tessera.llm.toxicity import learn, without_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the noisy-or model of the labelled ones scores at 0.3 or more go.

    Each row is judged by its own whole text, so repeated rows and rows without a doc_id go or stay
    alike. Null and empty texts count as one sentence without words. Without labels of both classes
    the model is constant. An empty table gives an empty one.
    """
    return without_toxic(docs, learn(docs, table(spark, sf_dir, "labels")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document with the smallest doc_id stays.

    First groups of fingerprints at most 3 bits apart, then, of what is left, groups of texts whose
    five-word shingles have a Jaccard similarity of 0.8 or more: no two documents that stay are
    linked either way. Null and empty texts, and texts without words, are alike. Of rows that repeat
    a doc_id that with the smallest text hash is judged and stays or goes. Rows without a doc_id
    can't be named by a group and all stay. An empty table gives an empty one.
    """
    return keep_rows(docs, representatives(docs, first_of_each(docs)))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go.

    Each row is judged by its own whole text; null and empty texts stay, as do all rows if the
    benchmark is empty. Null and empty items are in no text.
    """
    return without_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document stays and comes as often as its source's weight asks for.

    A null source is one of its own; null and empty texts have no tokens and come as often as their
    block does; repeated rows each count. A single source stays as it is, as does an empty table.
    """
    return mixed_rows(docs)


def token_files(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of the documents as read back from the token files.

    A row for each row of docs, in ascending doc_id order in the files (nulls first, ties by text
    hash); a null or empty text is the end id alone; an empty table gives an empty one.
    """
    return token_file_digest(docs, vocabulary("word_bpe_49k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", toxicity),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("mixing", mixing),
    ("token_files", token_files),
]

#: Models, fingerprints and tokenizers are beyond SQL: tests hold the stages against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
