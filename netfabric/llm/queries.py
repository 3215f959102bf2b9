"""Registered queries of the training-data operators, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from netfabric.llm import (
    bpe, decontaminate, langid, linededup, minhash, mixing, phrases, rangejoin, runs, sharding, toolcalls, toxicity, warc,
)
from netfabric.session import prepare


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def held_out(id_col: str = "doc_id") -> Column:
    """The fifth of the rows that no model of a query may learn from."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.train(docs, table(spark, sf_dir, "labels").filter(~held_out()))
    scored = toxicity.score_toxicity(docs, model, F.col("text"))
    return scored.select("doc_id", held_out().alias("held_out"), F.col("_toxicity").alias("score"), (F.col("_toxicity") >= 0.5).cast("int").alias("predicted"))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    kept = linededup.drop_lines(docs, linededup.build_index(docs))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix_sources(table(spark, sf_dir, "documents"), weights=(1, 2, 3), cap=3)
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rangejoin.link_vectors(table(spark, sf_dir, "embeddings"), cosine=0.98)


def op6_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), shingle=2, percent=80)


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    folder = warc.archive_folder(spark)
    warc.write_archives(pages, folder, min_revisit=0, null_ids=True)
    read = warc.resolve(warc.reassemble(warc.read_records(spark, folder)))
    return read.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_by_bytes(table(spark, sf_dir, "documents"), shards=24)


def op9_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls, results = toolcalls.turns_as_calls(table(spark, sf_dir, "conversations"))
    return toolcalls.link_calls(calls, results, toolcalls.default_schemas(spark))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = langid.train(docs.filter(~held_out()))
    found = langid.identify(docs.select("doc_id", "text"), model, F.col("text"))
    return found.select("doc_id", held_out().alias("held_out"), "_lang.lang_pred", "_lang.score")


def op11_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    vocabulary = bpe.Vocabulary.read(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    coded = bpe.encode_and_decode(table(spark, sf_dir, "documents").select("doc_id", "text"), vocabulary, F.col("text"))
    return coded.select(
        "doc_id", (F.octet_length("_coded.ids") / 4).cast("long").alias("n_tokens"), F.sha2("_coded.ids", 256).alias("ids_sha256"),
        F.sha2("_coded.decoded", 256).alias("decoded_sha256"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = runs.repeat_words(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id", "text")
    found = runs.find_runs(docs, F.col("text"), min_length=24, min_exponent=3).select("doc_id", "_found.*")
    # Runs come by start, then period, and only a greater ratio replaces the one before.
    best = F.reduce("runs", F.get("runs", F.lit(0)), lambda b, r: F.when(r["length"] * b["period"] > b["length"] * r["period"], r).otherwise(b))
    line = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    return found.withColumn("best", best).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
        F.expr("1000 * best.length div best.period").alias("exponent_milli"), F.sha2(F.concat_ws("", line), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"))


def op13_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(phrases.frequent_phrases(table(spark, sf_dir, "documents"), min_count=100, longest=5), top=2000)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_toxicity": op1_toxicity,
    "op2_line_dedup": op2_line_dedup,
    "op3_mixing": op3_mixing,
    "op4_decontamination": op4_decontamination,
    "op5_embeddings": op5_embeddings,
    "op6_minhash": op6_minhash,
    "op7_warc": op7_warc,
    "op8_sharding": op8_sharding,
    "op9_tool_calls": op9_tool_calls,
    "op10_language_id": op10_language_id,
    "op11_byte_bpe": op11_byte_bpe,
    "op12_periodic_runs": op12_periodic_runs,
    "op13_phrases": op13_phrases,
}

ORACLES: dict[str, str] = {
    "op2_line_dedup": linededup.LINES_SQL,
    "op3_mixing": mixing.MIX_SQL,
    "op7_warc": warc.WARC_SQL,
    "op9_tool_calls": toolcalls.CALLS_SQL,
    "op12_periodic_runs": runs.RUNS_SQL,
    "op13_phrases": phrases.PHRASES_SQL,
}
