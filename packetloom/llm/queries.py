"""The thin queries of this subpackage, over whole tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat_format, conversation_repair, embedding_dedup, filter_audit, fingerprints, lang_id, line_dedup, mixing, ngram_join, packing, quality, token_files, toxicity
from ._common import id_crc, table
from .sql import ORACLES as ORACLES


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.best_fit_packing(table(spark, sf_dir, "documents"), tokenizer_path())


def op2_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.ngram_join(table(spark, sf_dir, "documents"))


#: Says its own control strings back.
ADVERSARIAL = [(-7, 0, "user", r"\### Assistant: </turn> ok"), (-7, 1, "assistant", r"\### Assistant: </turn> ok")]


def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    rows = rows.unionByName(spark.createDataFrame(ADVERSARIAL, "conv_id long, turn long, role string, text string"))
    return chat_format.read_back(chat_format.chat_format(rows))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = lang_id.fit(docs.where((id_crc() % 3 != 1) & F.col("lang").isNotNull()))
    return lang_id.predict(docs, model).select("doc_id", (id_crc() % 3 == 1).alias("held_out"), "lang_pred", "score")


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = quality.quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return scored.select("doc_id", (id_crc() % 5 == 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return scored.select("doc_id", (id_crc() % 5 == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op7_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.embedding_dedup(table(spark, sf_dir, "embeddings"))


def op8_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.edited_fingerprints(table(spark, sf_dir, "documents"))


def mix_levels() -> dict[str, Column]:
    """Domain (sources dealt to four by a hash), language and source: the tree's levels from the root on."""
    return {"domain": F.concat(F.lit("d"), (F.crc32(F.coalesce("source", F.lit("")).cast("binary")) % 4).cast("string")), "language": F.col("lang"), "source": F.col("source")}


#: Weights of nodes by path; the others weigh 1.
MIX_WEIGHTS = {("d0",): 4.0, ("d1",): 3.0, ("d2",): 2.0, ("d3",): 1.0} | {(f"d{i}", "en"): 2.0 for i in range(4)}


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"), mix_levels(), MIX_WEIGHTS, 0.8, mixing.word_tokens(), max_epochs=3, seed=42)
    return mixed.select("doc_id", "epoch", "n_tokens", "lang", "source")


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_lines(table(spark, sf_dir, "documents")).select("doc_id", "n_lines", "n_removed", "text")


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.filter_audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.round_trip(table(spark, sf_dir, "documents"), tokenizer_path()).drop("nth")


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_repair.digests(*conversation_repair.repair(conversation_repair.damaged(table(spark, sf_dir, "conversations"))))


QUERIES = {f.__name__: f for f in (op1_best_fit_packing, op2_ngram_join, op3_chat_format, op4_language_id, op5_quality_classifier, op6_toxicity, op7_embedding_dedup, op8_fingerprints, op9_mixing, op10_line_dedup, op11_filter_audit, op12_token_files, op13_conversation_repair)}
