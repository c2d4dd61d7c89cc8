"""Documents to packed training sequences: drop toxic, drop poor, drop copies, pack.

Each stage takes the documents that the stage before it kept, as a written table, and
works on all of them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from footfall.llm import jaccard, packing, resampling, store, toxicity

#: Chunks whose ids a worker remembers. Workers outlive the packing, and the stages of a
#: later run need their memory.
KEPT_CHUNKS = 150_000


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the compression distance does not take for toxic."""
    labels = store.table(store.ready(spark), sf_dir, "labels")
    model = toxicity.train(docs, labels, F.crc32(F.col("doc_id").cast("string")) % 4 != 2)
    scored = toxicity.score(docs, model, "_toxicity")
    return scored.filter(F.col("_toxicity") < toxicity.THRESHOLD).drop("_toxicity")


def resample(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents drawn by their importance for good text."""
    return resampling.sample(docs, store.table(store.ready(spark), sf_dir, "labels"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    store.ready(spark)
    return jaccard.deduplicate(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents left, with their sequence and place."""
    import public_tokenizers

    store.ready(spark)
    tokenizer = public_tokenizers.path("word_bpe_49k.json")
    return packing.pack_documents(docs, tokenizer, kept=KEPT_CHUNKS)


STAGES = [
    ("toxicity", drop_toxic),
    ("quality_classifier", resample),
    ("ngram_jaccard_join", drop_copies),
    ("best_fit_packing", pack),
]

#: No SQL: trained models and a tokenizer decide.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to ``documents``, one after the other."""
    docs = store.table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = store.written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
