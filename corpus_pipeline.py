"""A training corpus from raw documents: rules, near-duplicates, repeated passages, mix, packed sequences.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as the next
stage's docs. All stages but the last return the columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tangle.llm import common, fertility, mixing, packing, simhash, substrings

#: Intermediate folders that each stage has written, by the stage's name.
_scratch: dict[str, set[str]] = {}


def _stage(work: Callable) -> Callable:
    """A stage, which on its start deletes the intermediate folders of the other stages: their results have been written by
    then. Nothing is deleted while docs reads such a folder, or from what can't be told."""

    @wraps(work)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        common.tune(spark)
        own, reads = _scratch.setdefault(work.__name__, set()), common.sources(docs)
        for name, folders in _scratch.items():
            if name != work.__name__ and reads is not None and not reads & folders:
                common.discard(folders)
                folders.clear()
        before = common.written()
        out = work(spark, docs, sf_dir)
        own |= common.written() - before
        return out

    return run


@_stage
def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and whose tokeniser fertility is within its bands."""
    return fertility.judge(docs, carry=True).filter("kept").select("row.*")


@_stage
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, the one of smallest doc_id."""
    return simhash.deduplicate(docs)


@_stage
def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the words of passages that a smaller doc_id holds; n_chars is counted again."""
    left = substrings.dedup(docs).select(*common.columns(docs))
    return left.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


@_stage
def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of sources at target weights: a row for each run of words taken, so a document may come twice or in part."""
    return mixing.materialize(docs).select(*common.columns(docs))


@_stage
def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 4096 tokens and where they lie in which sequence."""
    return packing.pack(packing.pieces(docs))[0]


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("substring_dedup", substring_dedup),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: No SQL expresses the tokenisers and the seeded draws; tests/llm compares the stages with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder and read again; results are deleted once they are read."""
    docs, before = common.table(spark, sf_dir, "documents"), []
    for _, stage in STAGES[:-1]:
        docs = common.durable(stage(spark, docs, sf_dir))
        common.drop(*before)
        before = [docs]
    return STAGES[-1][1](spark, docs, sf_dir)
