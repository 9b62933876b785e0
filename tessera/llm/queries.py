"""The queries of the numbered operators, on the given tables."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import bpe, collocations, crf, decontam, fingerprint, hpy, langid, neardup, oracles, periods, secrets, store, suffix, windows
from tessera.llm.workspace import documents


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contamination(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op2_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.fingerprints(documents(spark, sf_dir))


def op3_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hpy.scores(documents(spark, sf_dir))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return crf.quality(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    removed = F.expr("aggregate(spans, 0L, (a, s) -> a + s.stop - s.start)").alias("n_removed")
    return suffix.substring_dedup(documents(spark, sf_dir)).select("doc_id", "n_bytes", removed, F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op6_passage_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    removed = F.expr("aggregate(spans, 0L, (a, s) -> a + s.last_word - s.first_word)").alias("n_removed_words")
    return windows.passage_dedup(documents(spark, sf_dir)).select("doc_id", "n_words", F.size("spans").cast("long").alias("n_spans"), removed, "spans", "partners", F.sha2("deduped", 256).alias("deduped_sha256"))


def op7_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(documents(spark, sf_dir), k=4)


def op8_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.store_and_check(documents(spark, sf_dir), vocabulary("byte_bpe_50k.json"))


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(documents(spark, sf_dir), vocabulary("byte_bpe_multi_50k.tiktoken"), pattern())


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(documents(spark, sf_dir))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periods.periodic_runs(documents(spark, sf_dir), planted=True)


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(documents(spark, sf_dir))


def op13_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secrets(documents(spark, sf_dir))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_decontamination, op2_fingerprints, op3_language_model, op4_quality, op5_substring_dedup, op6_passage_dedup, op7_near_duplicates, op8_token_store, op9_byte_bpe, op10_language, op11_periodic_runs, op12_collocations, op13_secrets)}


def oracle_sql() -> dict[str, str]:
    return {"op1_decontamination": oracles.OP1, "op7_near_duplicates": oracles.OP7, "op11_periodic_runs": oracles.OP11, "op12_collocations": oracles.OP12, "op13_secrets": oracles.OP13}
