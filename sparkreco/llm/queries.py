"""Queries of the operators in this subpackage: (spark, sf_dir) -> DataFrame, each over whole tables."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkreco.llm import oracles

QUERIES = {}
#: DuckDB SQL for what SQL can express; the others are tested against brute force.
ORACLE_SQL: dict[str, str] = {"op2_knn": oracles.KNN, "op4_html_text": oracles.HTML, "op6_suffix_dedup": oracles.SUFFIX, "op7_repeats": oracles.REPEATS, "op10_jaccard": oracles.JACCARD, "op13_merkle": oracles.MERKLE}


def query(f):
    QUERIES[f.__name__] = f
    return f


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sparkreco.llm.bpe import encode_and_decode

    coded = encode_and_decode(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " ").cast("binary"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


@query
def op4_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sparkreco.llm.html_text import extract_main_text

    return extract_main_text(table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))


@query
def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sparkreco.llm.samples import fold
    from sparkreco.llm.toxicity import fit_toxicity, score_toxicity, threshold

    docs = table(spark, sf_dir, "documents")
    model = fit_toxicity(docs, table(spark, sf_dir, "labels"), fold("doc_id", 5) != 0)
    scored = score_toxicity(docs.select("doc_id", "text", "lang"), model)
    return scored.select(
        "doc_id",
        F.coalesce(fold("doc_id", 5) == 0, F.lit(False)).alias("held_out"),
        F.col("toxicity").alias("score"),
        (F.col("toxicity") >= 0.5).cast("int").alias("predicted"),
        (F.col("toxicity") >= threshold(model)).cast("int").alias("rejected"),
    )


@query
def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sparkreco.llm.quality import fit_quality, score_quality
    from sparkreco.llm.samples import fold

    docs = table(spark, sf_dir, "documents")
    model = fit_quality(docs, table(spark, sf_dir, "labels"), fold("doc_id", 4) != 2, decide_at=0.7)
    return score_quality(docs.select("doc_id", "text"), model).select(
        "doc_id",
        F.coalesce(fold("doc_id", 4) == 2, F.lit(False)).alias("held_out"),
        F.col("quality_score").alias("score"),
        (F.col("quality_score") >= 0.7).cast("int").alias("predicted"),
    )


@query
def op2_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sparkreco.llm.knn import knn_join

    return knn_join(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


@query
def op7_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sparkreco.llm.repeats import remove_repeats

    found = remove_repeats(table(spark, sf_dir, "documents"), window=35)
    return found.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


@query
def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sparkreco.llm.suffix_dedup import remove_repeated_bytes

    found = remove_repeated_bytes(table(spark, sf_dir, "documents"), length=50)
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


@query
def op10_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sparkreco.llm.jaccard import jaccard_components

    return jaccard_components(table(spark, sf_dir, "documents"), n=5, percent=75)


@query
def op3_bilinear_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sparkreco.llm.bilinear import score_texts
    from sparkreco.llm.samples import fold

    scored = score_texts(table(spark, sf_dir, "documents"), fold("doc_id", 5) != 1)
    return scored.select("doc_id", F.coalesce(fold("doc_id", 5) == 1, F.lit(False)).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


@query
def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sparkreco.llm.decontaminate import find_leaks

    found = find_leaks(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", F.explode("leaks").alias("leak")).select("doc_id", "leak.item_id", F.round("leak.score", 6).alias("score"), F.round("leak.question", 6).alias("question_overlap"), F.round("leak.answer", 6).alias("answer_overlap"))


@query
def op11_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sparkreco.llm.pieces import encode_and_decode

    coded = encode_and_decode(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"), packed=True)
    return coded.select("doc_id", F.expr("octet_length(ids) div 4").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


@query
def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sparkreco.llm.alignment import align

    found = align(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, public_tokenizers.path("piece_bpe_32k.model"))
    digest = F.when(F.col("groups") == "", "").otherwise(F.sha2(F.col("groups").cast("binary"), 256))
    return found.documents.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", digest.alias("groups_sha256"))


@query
def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sparkreco.llm.merkle import folded, leaf_hash, manifest, proof_text

    docs = table(spark, sf_dir, "documents")
    fields = ["doc_id", "source", "lang", "n_chars", "text"]
    lowered = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    tampered = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, leaf_hash(*[lowered if c == "text" else F.col(c) for c in fields]))
    found = manifest(docs, fields, carry={"tampered": tampered}).withColumn("folded_root", folded(F.coalesce("tampered", "leaf"), F.col("proof")))
    return found.select("doc_id", "leaf", "subroot", "root", F.sha2(proof_text(F.col("proof")).cast("binary"), 256).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))
