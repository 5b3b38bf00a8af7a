"""The corpus pipeline: toxic documents go, near duplicates go, repeated
passages go, benchmark passages go, the rest is encoded to token ids (and
decoded again as a check).

Each stage takes (spark, docs, sf_dir), works on everything that the stage
before it kept, and is written as Parquet and read again. All but the last
return the columns of ``documents``.

Cases, the same in every stage: a null or empty text is judged like one without
words and stays (encoded to no tokens); a row without id stays, is compared with
no other and keeps its passages; rows equal in id and text count once from the
near-duplicate stage on; an id with several texts has each of them judged for
itself there; an empty table gives an empty table; columns beyond those of
``documents`` pass through all stages but the last.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from epilens.llm import bpe, decontaminate, minhash, substring_dedup, toxicity
from epilens.llm.common import stage, table
from epilens.llm.queries import RANKS


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score reaches the threshold of their language go."""
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model).where(~F.col("rejected")).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays: five-word shingles, similarity 0.8."""
    return minhash.keep_one(docs)


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of at least 50 words that repeat another place are cut out."""
    return _counted(substring_dedup.drop_repeats(docs))


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of the benchmark are cut out."""
    kept = [c for c in docs.columns if c != "text"]
    found = decontaminate.find_contamination(docs, table(spark, sf_dir, "benchmark"), keep=kept, cleaned=True)
    return _counted(found.withColumnRenamed("cleaned", "text")).select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, token_ids, n_tokens, and whether decoding gave the text back."""
    path = public_tokenizers.path(RANKS)
    ids = bpe.encode(docs.select("doc_id", "text"), path, public_tokenizers.PATTERN)
    same = F.col("decoded") == F.coalesce("text", F.lit("")).cast("binary")
    return bpe.decode(ids, path).select(
        "doc_id", "token_ids", F.size("token_ids").cast("long").alias("n_tokens"), same.alias("round_trip")
    )


def _counted(docs: DataFrame) -> DataFrame:
    """n_chars of the text as it is now."""
    return docs.withColumn("n_chars", F.length("text").cast("long"))


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("repeated_passages", drop_repeated_passages),
    ("decontamination", drop_benchmark),
    ("encoding", encode),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, function in STAGES:
        docs = stage(function(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
