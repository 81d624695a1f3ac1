"""The corpus pipeline: toxicity, near duplicates, repeated text, benchmark passages, token ids.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next stage's docs.
All but the last return the columns of documents.

Defined cases, for every stage: rows with null ids or repeated ids are rows of their own; nulls in other columns stay; further columns,
whatever their names, come back as they were (the last stage leaves them out); a text of any length is treated whole; an empty table
gives no rows.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkreco.llm.bpe import encode_and_decode
from sparkreco.llm.decontaminate import drop_leaked
from sparkreco.llm.jaccard import drop_near_copies
from sparkreco.llm.samples import fold
from sparkreco.llm.storage import materialize
from sparkreco.llm.suffix_dedup import cut_repeats
from sparkreco.llm.toxicity import fit_toxicity, reject_toxic

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects by their language's threshold go.

    A null or empty text is scored as one without words; a language that is null or was not seen has the common threshold; without labels of
    both classes all scores are alike.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return reject_toxic(docs, fit_toxicity(docs, labels, fold("doc_id", 5) != 0))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of linked documents the one with the smallest id stays.

    Documents without words (null, empty or blank texts) are linked with nothing and stay, repeated ones too; of rows with equal ids and
    linked texts one stays.
    """
    return drop_near_copies(docs, n=5, percent=75)


def repeated_text(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Text that a document with a smaller id has too is cut out; a document of which nothing is left goes.

    Null and empty texts, of which nothing was cut, stay. A null id counts as larger than all others; rows with equal ids never cut each other.
    """
    return cut_repeats(docs, length=50)


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go.

    Null and empty texts hold none; items without words are not searched for; without items all documents stay.
    """
    return drop_leaked(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document's token ids, how many there are, and the hash of what they decode to. A null or empty text has none."""
    coded = encode_and_decode(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return coded.select("doc_id", "ids", F.size("ids").cast("long").alias("n_tokens"), F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [("toxicity", toxicity), ("jaccard", near_duplicates), ("suffix_dedup", repeated_text), ("decontaminate", benchmark_passages), ("bpe", token_ids)]
#: SQL expresses neither the classifier nor the tokenizer; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
