"""A training corpus from raw documents, stage by stage; each stage is written before the next reads it."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import bpe, decontam, langid, neardup, windows
from tessera.llm.queries import pattern, vocabulary
from tessera.llm.workspace import documents, materialise

#: A document less like every language than this is none's.
LEAST_COSINE = 0.05


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of a known language: those without a letter (null and empty texts too), or like no language, go. Learns from rows with ``lang``.

    Repeated rows go or stay together; rows without doc_id are judged as others; an empty table gives an empty one.
    """
    found = langid.predict(docs, langid.fit(docs))
    return found.where((F.col("lang_pred") != langid.UNKNOWN) & (F.col("score") >= LEAST_COSINE)).select(docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest doc_id, of each group of near duplicates; rows without doc_id stay."""
    gone = neardup.near_duplicates(docs).where("not kept").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(docs.columns)


def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages of 50 words or more that an earlier document has; a text of nothing else goes.

    Null and empty texts stay as they are; rows that share a doc_id count as one document; an empty table gives an empty one.
    """
    found = windows.passage_dedup(docs)
    left = found.where((F.size("spans") == 0) | F.col("deduped").rlike(r"[^\x20\x09-\x0D]"))
    text = F.when(F.size("spans") == 0, F.col("text")).otherwise(F.col("deduped"))
    left = left.withColumn("text", text)
    return left.withColumn("n_chars", F.when(F.size("spans") == 0, F.col("n_chars")).otherwise(F.char_length("text").cast("long"))).select(docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item, judged row by row: of rows that share a doc_id, or have none, those with an item in their own text go.

    Null and empty texts, and those of fewer than five words, hold nothing and stay; repeated rows stay or go together; an empty table gives one.
    """
    own = F.xxhash64("doc_id", "text")
    held = decontam.contamination(docs.select(own.alias("doc_id"), "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select(F.col("doc_id").alias("_own")).distinct()
    return docs.withColumn("_own", own).join(held, "_own", "left_anti").select(docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids (little-endian unsigned 32-bit) and the digests of ids and decoded bytes, a row for each row; null texts have no ids."""
    return bpe.round_trip(docs, vocabulary("byte_bpe_multi_50k.tiktoken"), pattern(), keep_ids=True)


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("passages", passages), ("decontamination", decontamination), ("tokens", tokens)]

#: Language, near-duplicate passages and BPE are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for i, (name, stage) in enumerate(STAGES, 1):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES):
            docs = materialise(docs, name)
    return docs
