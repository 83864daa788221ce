"""A corpus pipeline over ``documents``: five stages, each written as Parquet and read again.

A stage is (name, function); the function takes (spark, docs, sf_dir). All but the last return the
columns of ``documents``. SQL cannot express the stages; ``tests/llm/test_pipeline.py`` compares the
whole with brute force.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftrank.llm.arrays import stored

ORACLE_SQL = None


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def keep_good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that the attention model of ``labels.quality`` rejects."""
    from siftrank.llm.quality import keep_selected, learn_quality

    marked = _table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("selected"))
    model = learn_quality(docs.select("doc_id", "text"), marked, id_col="doc_id", text_col="text")
    return keep_selected(docs, model, text_col="text")


def keep_one_near_duplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays, the one with the smallest id.

    Near-duplicates have a Jaccard similarity of 0.8 or more on five-word shingles.
    """
    from siftrank.llm.near_duplicates import keep_one_of_each

    return keep_one_of_each(docs, id_col="doc_id", text_col="text")


def remove_repeated_strings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut every byte in a 200-byte string that also stands elsewhere; ``n_chars`` follows the text.

    A document that loses its whole text stays, with an empty one.
    """
    from siftrank.llm.suffix_dedup import without_repeats

    cut = without_repeats(docs, text_col="text")
    return cut.withColumn("n_chars", F.coalesce(F.length("text").cast("long"), F.col("n_chars"))).select(*docs.columns)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that hold a passage of ``benchmark``."""
    from siftrank.llm.decontaminate import without_leaks

    return without_leaks(docs, _table(spark, sf_dir, "benchmark"), text_col="text", item_col="item_id", item_text_col="text")


def encode_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, and the hash of the bytes they decode to."""
    import public_tokenizers

    from siftrank.llm.bpe import decode_tokens, encode_text

    ranks = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    encoded = encode_text(docs, ranks, public_tokenizers.PATTERN, id_col="doc_id", text_col="text")
    return decode_tokens(encoded, ranks).select(
        "doc_id", F.size("token_ids").cast("long").alias("n_tokens"), "token_ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("quality", keep_good_quality),
    ("near_duplicates", keep_one_near_duplicate),
    ("repeated_strings", remove_repeated_strings),
    ("decontamination", drop_benchmark_leaks),
    ("tokens", encode_documents),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = _table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
