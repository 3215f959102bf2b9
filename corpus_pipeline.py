"""From raw documents to training shards: each stage works on all that the one before kept."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netfabric.llm import decontaminate, langid, minhash, mixing, sharding
from netfabric.session import cut_lineage, prepare

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

#: Share of a text's n-grams that its language has to hold; prose has over 0.5.
MIN_LANGUAGE_SCORE = 0.05


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one of the languages that the labelled documents teach.

    Rejected are null texts, texts without a letter, and texts whose n-grams no language
    knows.  Every other row stays, repeats included.  Without labelled rows nothing can be
    told, and all texts with a letter stay.
    """
    model = langid.train(docs)
    found = langid.identify(docs, model, F.col("text"))
    least = MIN_LANGUAGE_SCORE if model.langs else 0.0
    known = (F.col("_lang.score") >= least) & ((F.col("_lang.lang_pred") != langid.UNKNOWN) | F.lit(not model.langs))
    return found.filter(known & F.regexp_like("text", F.lit(r"\p{L}"))).drop("_lang")


def remove_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by a similarity of 0.8 on five-word shingles, that with the smallest id.

    Of rows that repeat an id one stays.  Rows with a null id and texts without words stay.
    """
    near = cut_lineage(minhash.near_duplicates(docs, shingle=5, percent=80).filter("doc_id IS NOT NULL"))
    gone = near.filter("NOT kept").select("doc_id").distinct()
    again = cut_lineage(near.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("doc_id"))
    left = docs.join(gone, "doc_id", "left_anti").select(*docs.columns)
    if not again.take(1):
        return left
    once = left.join(again, "doc_id", "left_semi").dropDuplicates(["doc_id"])
    return left.join(again, "doc_id", "left_anti").select(*docs.columns).unionByName(once.select(*docs.columns))


def remove_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of ``benchmark``; a row with a null id is never held against it."""
    benchmark = spark.read.parquet(f"{sf_dir.rstrip('/')}/benchmark.parquet")
    flagged = cut_lineage(decontaminate.find_contamination(docs, benchmark).select("doc_id").distinct())
    return docs.join(flagged, "doc_id", "left_anti").select(*docs.columns)


def mix_by_source(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the source mix takes, each as often as it takes it (0 to 3 times)."""
    return mixing.mixed_rows(docs, weights=(1, 2, 3), cap=3)


def assign_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Shard and slot of every document, in 24 shards of near equal bytes."""
    return sharding.shard_by_bytes(docs, shards=24)


STAGES: list[tuple[str, Stage]] = [
    ("language", identify_language),
    ("near_duplicates", remove_near_duplicates),
    ("decontamination", remove_benchmark_leaks),
    ("mixing", mix_by_source),
    ("sharding", assign_shards),
]
#: SQL has no form for the models and signatures of the first three stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each one's rows are written and read back as the next one's input."""
    docs = prepare(spark).read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = cut_lineage(docs)
    return docs
