"""From raw documents to packed training sequences, stage by stage; each stage is stored before the next one reads it.

What a stage keeps on disk for itself is deleted when the next stage is called, as its result has been stored by then.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from alertweave.llm import decontaminate, language, packing, simhash, suffixes
from alertweave.llm.common import cut, table
from alertweave.session import Scratch

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
_last = Scratch()


def staged(make: Stage) -> Stage:
    """The stage, after the folders of the stage before it are gone, unless `docs` still reads them."""

    @wraps(make)
    def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        global _last
        before = _last
        read = docs.inputFiles() if before.folders else []
        with Scratch() as _last:
            if any(folder.rsplit("/", 1)[1] in path for folder in before.folders for path in read):
                _last.folders += before.folders
            else:
                before.drop(spark)
            return make(spark, docs, sf_dir)

    return stage


@staged
def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that can be told; null and letterless texts go."""
    return language.accepted(docs)


@staged
def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, the one with the smallest id."""
    return simhash.keep_representatives(docs)


@staged
def suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages of 50 bytes and more that an earlier document has."""
    return suffixes.with_repeats_removed(docs)


@staged
def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate.without_leaks(docs, table(spark, sf_dir, "benchmark"))


@staged
def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per piece of a document in a sequence of 2048 tokens."""
    return packing.pack(docs, public_tokenizers.path(packing.TOKENIZER))


STAGES = [
    ("language_id", language_id),
    ("simhash_dedup", simhash_dedup),
    ("suffix_dedup", suffix_dedup),
    ("decontamination", decontamination),
    ("packing", packed),
]

#: Fingerprints, components and byte-pair ids are out of SQL's reach; tests/llm compares with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), Scratch()
    for _, stage in STAGES[:-1]:
        made = stage(spark, docs, sf_dir)
        with Scratch() as stored:
            docs = cut(made)
        before.drop(spark)  # this stage's input
        before = stored
    return STAGES[-1][1](spark, docs, sf_dir)
