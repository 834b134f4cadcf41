"""Corpus pipeline: five stages over ``documents``, each written as Parquet and read again by the next.

Every stage takes ``(spark, docs, sf_dir)``; all but the last return the columns of ``docs``, whatever other names there are. Texts are
taken whole, whatever their length. Rows without an id are kept or dropped by their text like others, but never as a copy; rows that repeat
an id are rows of their own. Results do not depend on the order of rows, and empty tables give empty tables.

Every stage sets the session's bound on an Arrow batch (``spark.sql.execution.arrow.maxBytesPerBatch``) to ``BATCH_BYTES`` where it is larger: executors and
their Python workers hold a batch for each core several times over, and a stage's rows are the same whatever its batches are.
"""
from __future__ import annotations

import functools
import re

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from quillon.llm import jaccard, packing, quality, suffix, toxicity
from quillon.llm.common import save

#: Repeated passages are taken out from so many bytes on: about 30 words, so that passages of 50 words are found whole.
PASSAGE_BYTES = 200
#: Bytes of an Arrow batch between executors and their Python workers, but for a longer row.
BATCH_BYTES = 4_000_000


def _small_batches(stage):
    """A stage whose tables are read and written in batches of ``BATCH_BYTES`` at most."""
    @functools.wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        key = "spark.sql.execution.arrow.maxBytesPerBatch"
        number, unit = re.fullmatch(r"(-?\d+)([a-z]?)[a-z]*", spark.conf.get(key).strip().lower()).groups()
        if not 0 < int(number) << 10 * " kmgtp".index(unit.replace("b", "") or " ") <= BATCH_BYTES:
            spark.conf.set(key, BATCH_BYTES)
        return stage(spark, docs, sf_dir)

    return run


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


@_small_batches
def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents whose score reaches 0.3. Null, empty and wordless texts are scored as an empty window, and so stay as long as that
    is not toxic. Equal texts fare alike."""
    return toxicity.select(docs, _labels(spark, sf_dir))


@_small_batches
def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents that belong to the highest grade with at least one half. Null and empty texts are graded by the thresholds alone."""
    return quality.select(docs, _labels(spark, sf_dir))


@_small_batches
def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the smallest id of each group of texts that link at 0.8 over five-word shingles. Texts without words, rows without an id, and unlike rows of
    one id stay; of rows that repeat id and text one stays."""
    return jaccard.keep_one(docs, k=5, num=80, den=100)


@_small_batches
def cut_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts every passage of ``PASSAGE_BYTES`` that also stands elsewhere, all its occurrences; rows stay, with ``n_chars`` counted anew. Null texts
    become empty."""
    return suffix.dedup(docs, PASSAGE_BYTES)


@_small_batches
def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row for each power-of-two piece of each row's ids. Null and empty texts give the end id alone."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("quality classifier", keep_quality),
    ("n-gram Jaccard join", keep_one_of_near_copies),
    ("suffix-array dedup", cut_repeated_passages),
    ("packing", pack_sequences),
]

#: No stage but the last could be written in SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``: the pieces of the last."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = save(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
