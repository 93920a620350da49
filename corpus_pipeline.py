"""The corpus pipeline: language ID, line dedup, n-gram Jaccard join, benchmark decontamination, BPE.

``STAGES`` lists (name, function); each function takes (spark, docs, sf_dir), works on all that
the stage before it kept, and returns a DataFrame that is written as Parquet and read again as the
next stage's docs.  All stages but the last return the columns of documents.

Defined cases: null texts, and texts without letters or far from all languages learned, go in the
first stage; without any labelled row no language is known and all texts go; texts without words link
with nothing; rows that repeat a doc_id and text become one in the third stage; a null doc_id
is smaller than all others; further columns, whatever their names, are kept up to the last stage; an empty
table, or an empty benchmark, is no error.

The stages with the largest Python workers, the join and the encoder, begin by shrinking the Java heaps, as both share an executor's memory.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from strandwork.llm import bpe, decontaminate, jaccard, langid, linededup
from strandwork.llm.common import materialize, shrink
from strandwork.llm.queries import VOCABULARY


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is known; the model is fitted on the documents themselves."""
    return langid.keep_known(docs, langid.fit(docs))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that are kept elsewhere."""
    return linededup.clean_documents(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component, the one with the smallest doc_id."""
    shrink(spark)
    return jaccard.one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    return decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Digests of token ids and of decoded bytes."""
    shrink(spark)
    return bpe.digest(docs, public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN)


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("ngram_jaccard_join", near_duplicates),
    ("benchmark_decontamination", decontamination),
    ("byte_level_bpe", tokenize),
]

#: SQL can express neither the language model nor the encoding.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``; each result but the last is a table in the shared folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = materialize(docs)
    return docs
