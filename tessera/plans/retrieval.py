"""Queries that hold many questions against many passages."""

from pyspark.sql import functions as F

from tessera.operators import retrieve
from tessera.plans.registry import query

_COSINES = """WITH q AS (SELECT vec_id AS question, embedding::DOUBLE[] AS a, sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])) + 1e-8 AS na FROM embeddings WHERE vec_id % 50 = 0),
p AS (SELECT vec_id AS passage, label, embedding::DOUBLE[] AS b, sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])) + 1e-8 AS nb FROM embeddings),
s AS (SELECT question, passage, label, round(list_inner_product(a, b) / (na * nb), 9) AS sim FROM q, p),"""


@query("udf_02_nearest", "embeddings", _COSINES + " r AS (SELECT *, row_number() OVER (PARTITION BY question ORDER BY sim DESC, passage DESC) AS rank FROM s) SELECT question, passage, round(sim, 6) AS similarity, rank FROM r WHERE rank <= 5")
def _(embeddings):
    """Every vector whose id 50 divides asks all vectors for its five nearest."""
    questions = embeddings.where("vec_id % 50 = 0").select(F.col("vec_id").cast("long").alias("question"), F.col("embedding").alias("vector"), F.lit(5).alias("k"))
    found = retrieve.nearest(embeddings.select(F.col("vec_id").cast("long").alias("passage"), F.col("embedding").alias("vector")), questions)
    return found.withColumn("similarity", F.round("similarity", 6))


@query("doc_13_expanded", "embeddings", _COSINES + " r AS (SELECT *, row_number() OVER (PARTITION BY question, label ORDER BY sim DESC, passage DESC) AS rank FROM s), k AS (SELECT question, CASE WHEN question % 100 = 0 THEN 8 ELSE 6 END AS k FROM q) SELECT question, label AS document, passage, rank FROM r JOIN k USING (question) WHERE rank <= k")
def _(embeddings):
    """Each document's passages for each question: two at a time for three columns asked together, or more where a first attempt found nothing."""
    first, again = retrieve.batch_k(2, 3), retrieve.expanded_k(2)
    questions = embeddings.where("vec_id % 50 = 0").select(F.col("vec_id").cast("long").alias("question"), F.col("embedding").alias("vector"), F.when(F.col("vec_id") % 100 == 0, again).otherwise(first).alias("k"))
    passages = embeddings.select(F.col("label").cast("long").alias("document"), F.col("vec_id").cast("long").alias("passage"), F.col("embedding").alias("vector"))
    return retrieve.nearest(passages, questions, by_document=True).select("question", F.col("document").cast("int").alias("document"), "passage", "rank")


@query("doc_13_questions", "part", "SELECT p_brand, 'which?' || coalesce(' ' || string_agg('Information about ' || name || ': ' || definition, ' ' ORDER BY name), '') AS question FROM (SELECT DISTINCT p_brand, p_type AS name, lower(p_type) AS definition FROM part) GROUP BY p_brand")
def _(part):
    columns = part.select("p_brand", F.struct(F.col("p_type").alias("name"), F.lower("p_type").alias("definition")).alias("c")).groupBy("p_brand").agg(F.sort_array(F.collect_set("c")).alias("columns"))
    return columns.select("p_brand", retrieve.retrieval_question(F.lit("which?"), F.col("columns")).alias("question"))
