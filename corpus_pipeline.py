"""A training-corpus pipeline of five stages, each on all that the one before it kept.

Stages take (spark, docs, sf_dir) and return a DataFrame; each result is written as Parquet to the shared
folder and read again as the next stage's docs.  All but the last return the columns of documents (doc_id,
text, lang, source, n_chars).

Defined results: a null or empty document passes the filters (it has nothing to reject) and is packed as its
separator; repeated rows count as one document where near duplicates are removed, and
texts of one id, or of none, that are no copies are documents of their own; an empty table passes through all stages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from packetloom.llm import line_dedup, mixing, ngram_join, packing, queries, toxicity
from packetloom.llm._common import materialize, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: From this score on a document is rejected.
TOXIC = 0.5
#: Share of all tokens that the mixture takes, and passes over a source at most.
MIX_BUDGET, MIX_EPOCHS, MIX_SEED = 0.8, 2, 42


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below TOXIC; the grammar learns from the training labels of these documents."""
    grammar = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    scored = toxicity.weigh(docs, grammar, list(COLUMNS), with_text=True)
    return scored.where(toxicity.curve(grammar) < TOXIC).select(*COLUMNS)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with near-duplicate lines removed from their texts; n_chars follows the text."""
    out = line_dedup.dedup_lines(docs.select(*COLUMNS))
    return out.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def dedup_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the one with the smallest doc_id, and of one id's texts that are copies
    the one of the smallest hash.  An id may have other texts, or be null: what goes is a text of an id."""
    found = ngram_join.ngram_join(docs).where("not kept").select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_text")).distinct()
    hashed = docs.withColumn("_hash", F.xxhash64("text"))
    kept = hashed.join(found, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_hash") == F.col("_text")), "left_anti")
    return kept.dropDuplicates(["doc_id", "_hash"]).select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixture: documents as often as its epochs take them."""
    mixed = mixing.mix(docs.select(*COLUMNS), queries.mix_levels(), queries.MIX_WEIGHTS, MIX_BUDGET, mixing.word_tokens(), max_epochs=MIX_EPOCHS, seed=MIX_SEED)
    return mixed.select(*COLUMNS)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document lies in the training sequences."""
    return packing.best_fit_packing(docs, queries.tokenizer_path())


STAGES = [
    ("toxicity", reject_toxic),
    ("line dedup", dedup_lines),
    ("n-gram Jaccard join", dedup_documents),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: The grammar, MinHash and best fit are beyond SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(*COLUMNS)
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
