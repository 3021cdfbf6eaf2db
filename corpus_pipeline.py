"""From raw documents to token ids: four stages over whole tables.

Toxic documents go, one document of each group of near copies stays, documents with
a passage of a benchmark item go, and what is left is encoded.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from framecloud.llm import bpe, decontaminate, order_minhash, toxicity
from framecloud.llm.storage import new_folder, written
from framecloud.session import tune

TOKENIZER = "byte_bpe_50k.json"


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents below the toxicity threshold. Held-out rows never train the model."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = toxicity.fit(docs, labels, ~toxicity.held_out())
    scored = toxicity.score(docs, model, name="_toxicity")
    return scored.where(scored["_toxicity"] < toxicity.THRESHOLD).select(*docs.columns)


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near copies."""
    return order_minhash.first_of_each_class(docs, new_folder(spark, "near")).select(*docs.columns)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of a benchmark item."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    found = decontaminate.with_leaks(docs, items, new_folder(spark, "decontaminate"), name="_leaks_found")
    return found.where("size(_leaks_found) = 0").select(*docs.columns)


def encode_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, the token ids of the whole text, and whether they decode to it again."""
    rows = docs.select("doc_id", "text")
    encoded = bpe.encode(rows, public_tokenizers.path(TOKENIZER), intact="decodes")
    return encoded.selectExpr("doc_id", "size(ids) as n_tokens", "decodes", "ids")


STAGES = [
    ("toxicity", reject_toxic),
    ("near-dedup", keep_one_of_near_copies),
    ("decontamination", drop_benchmark_leaks),
    ("bpe", encode_texts),
]

#: A trained classifier and an alignment are no SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to the documents, each written and read again by the next."""
    docs = tune(spark).read.parquet(f"{sf_dir}/documents.parquet")
    folder = new_folder(spark, "pipeline")
    for number, (_, stage) in enumerate(STAGES):
        docs = written(stage(spark, docs, sf_dir), f"{folder}/{number}")
    return docs
