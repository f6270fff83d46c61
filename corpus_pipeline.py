"""A corpus pipeline: language ID, SimHash near-dedup, substring dedup, mixing to target weights, packing.

Each stage takes ``(spark, docs, sf_dir)`` and works on all that its predecessor kept; all but the last return the columns of
``documents``.  Stages are written to the shared folder and read again, so a lost executor costs one stage at most.

Whole texts go to Python in batches of about ``BATCH`` bytes, a longer text alone: by rows alone, 10,000 texts would lie in
the executor and in its Python workers several times over.  That is set for the session and stays, since a stage's rows are made when
they are read.  No text is cut or left out by it; the second matching of substring dedup, which takes documents as they lie
together in a task, may choose another holder of a passage.

Odd rows: an empty table gives an empty one in every stage.  Null, empty and letterless texts go in the first stage.  Rows without
``doc_id`` are compared with nothing and stay up to packing, which leaves them out.  Rows that share an id stay or go
together as near copies and in the mixture, and are not compared with each other.  Null languages and sources are values of their own.
Texts of any length are taken whole, and further columns of any name come back as they were.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from findmark.llm import entries, langid, mixing, packing, passages, simhash
from findmark.llm.shared import stored

BATCH = 2 << 20


def _in_batches(stage: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    @wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH)
        return stage(spark, docs, sf_dir)

    return run


@_in_batches
def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text has a language, whatever ``lang`` says; profiles are learned from the same folds as in ``op10``."""
    return langid.keep_known(docs, langid.learn(docs.where(~langid.held_out())))


@_in_batches
def one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one with the smallest id, of each component of fingerprint links; ties keep all rows of that id."""
    return simhash.keep_one(docs)


@_in_batches
def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages that stand in a document of a smaller id; documents that were nothing else go."""
    return passages.remove_repeats(docs)


@_in_batches
def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents sampled by a hash of their id so that sources, languages and topics have their target shares of tokens."""
    return mixing.sample(docs)


@_in_batches
def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 1024 tokens; each id of each document with an id lies in one of them."""
    return packing.pack(docs, entries.tokenizer_path())


STAGES = [
    ("language ID", known_language),
    ("SimHash near-dedup", one_of_near_copies),
    ("substring dedup", without_repeats),
    ("mixing to target weights", mixed),
    ("packing", packed),
]

#: SimHash, chains and rank-order profiles are beyond SQL; ``tests/llm`` tests their operators against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = stored(docs, f"stage-{i}")
    return docs


def queries() -> dict:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {} if ORACLE_SQL is None else {"pipeline": ORACLE_SQL}
