"""From documents to packed training sequences.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written
as Parquet and read again as the next one's docs:

1. ``quality``: the weak-label classifier; documents that it rejects go;
2. ``near_duplicates``: the n-gram Jaccard join (five words, 0.8 or more); of
   each group of linked documents the one with the smallest doc_id stays;
3. ``secrets``: the secret scan; what it finds is cut out of the texts;
4. ``packing``: harmonic packing into sequences of 4096 tokens.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from spoolkit.llm.harmonic_packing import pack
from spoolkit.llm.partenum_join import one_of_each
from spoolkit.llm.secret_scan import redact
from spoolkit.llm.weak_quality import good_only
from spoolkit.storage import stored


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the classifier keeps, with all their columns.

    A null, empty or wordless text scores 0 and goes; very long texts are judged
    whole, repeated rows alike; an empty table stays empty.
    """
    return good_only(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: the one with the smallest doc_id, all its columns as they are.

    Null, empty and wordless texts are like no other and stay; texts of fewer
    than five words are compared as one sequence.  Equal rows of one id count
    once, different texts of one id are documents of their own.
    """
    return one_of_each(docs, width=5, percent=80)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with the secrets cut out of their texts; n_chars follows, other columns stay.

    Null texts stay null, empty ones empty; whole texts are scanned; repeated
    rows stay repeated.
    """
    return redact(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each piece of each document: where it lies in which sequence.

    A null or empty text is one id, its end; long documents are cut; rows of one
    id, or none, are documents of their own.  An empty table gives no rows.
    """
    return pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("secrets", secrets), ("packing", packing)]

#: SQL can't express the classifier, the tokenizer and the packing.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {} if ORACLE_SQL is None else {"pipeline": ORACLE_SQL}
