"""Queries on schemas and values by the vectors of what they say."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.functions.similarity import cosine
from tessera.operators import catalog, retrieve, semantics, units
from tessera.plans.registry import query

_COSINE = "list_inner_product({a}::DOUBLE[], {b}::DOUBLE[]) / ((sqrt(list_inner_product({a}::DOUBLE[], {a}::DOUBLE[])) + 1e-8) * (sqrt(list_inner_product({b}::DOUBLE[], {b}::DOUBLE[])) + 1e-8))"


def schemas_of(embeddings):
    """Forty vectors are two schemas of one name, old and new: every third new column means nearly what the old one twenty before does."""
    n = F.col("vec_id")
    before = embeddings.select((n + 20).alias("vec_id"), F.col("embedding").alias("near"))
    rows = embeddings.join(before, "vec_id", "left")
    vector = F.when((n % 40 >= 20) & (n % 3 == 0), F.zip_with("near", "embedding", lambda x, y: x.cast("double") + y.cast("double") * 0.2)).otherwise(F.transform("embedding", lambda x: x.cast("double")))
    name = F.concat(F.when(n % 40 >= 20, "COL ").otherwise("col "), F.when(n % 5 == 0, n % 20).otherwise(n).cast("string"))
    every = rows.select(F.floor(n / 40).alias("schema"), n.alias("seq"), name.alias("name"), F.repeat(F.lit("r"), (n % 7).cast("int")).alias("rationale"), F.when(n % 2 == 0, F.array(F.lit("a"), (n % 3).cast("string"))).alias("allowed"), vector.alias("vector"))
    return every.where("seq % 40 < 20"), every.where("seq % 40 >= 20")


@query("sim_10_merge_schemas", "embeddings")
def _(embeddings):
    """Old and new schemas merged by name, else by meaning."""
    return semantics.merge_schemas(*schemas_of(embeddings))


@query("jon_08_by_meaning", "embeddings")
def _(embeddings):
    """Predicted fields (the new columns) take gold ones (the old)."""
    gold, predicted = (s.select(F.col("schema").alias("table"), "seq", F.col("name").alias("field"), "vector") for s in schemas_of(embeddings))
    return semantics.align_fields(predicted, gold).withColumn("score", F.round("score", 9))


@query("srt_07_by_query", "embeddings", f"WITH q AS (SELECT label, arg_min(embedding, vec_id) AS q FROM embeddings GROUP BY label), s AS (SELECT label, vec_id, round({_COSINE.format(a='embedding', b='q')}, 9) + 0.05 * (vec_id % 300) / 100 AS score FROM embeddings JOIN q USING (label)) SELECT label, vec_id FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY score DESC, vec_id % 300, vec_id) AS n FROM s) WHERE n <= 4")
def _(embeddings):
    """The four columns of each label nearest to what is asked (its first vector), longer rationales a little ahead."""
    asked = embeddings.groupBy("label").agg(F.min_by("embedding", "vec_id").alias("q"))  # a vector a label
    rows = embeddings.join(F.broadcast(asked), "label").withColumn("relevance", F.round(cosine(F.col("embedding"), F.col("q")), 9)).withColumn("rationale", F.repeat(F.lit("r"), (F.col("vec_id") % 300).cast("int")))
    return catalog.pruned(rows, "label", F.col("relevance"), F.col("rationale"), 4).select("label", "vec_id")


@query("sim_16_by_meaning", "embeddings", f"WITH p AS (SELECT a.vec_id, 'value ' || a.vec_id AS x, CASE a.vec_id % 4 WHEN 0 THEN 'VALUE ' || a.vec_id WHEN 1 THEN 'the value ' || a.vec_id || ' it is' WHEN 2 THEN 'another text of it' ELSE 'short' END AS y, 'longer value ' || a.vec_id AS z, {_COSINE.format(a='a.embedding', b='b.embedding')} AS c FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1) SELECT vec_id, CASE vec_id % 4 WHEN 0 THEN 1.0 WHEN 1 THEN 0.7 WHEN 2 THEN greatest(0, round(c, 9)) ELSE 0 END::DOUBLE AS score FROM p")
def _(embeddings):
    """Each vector's text against the next one's: equal, within, of like meaning, or too short."""
    after = embeddings.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("next"))
    n, text = F.col("vec_id") % 4, F.col("vec_id").cast("string")
    said = F.when(n < 2, F.concat(F.lit("value "), text)).otherwise(F.concat(F.lit("longer value "), text))
    truth = F.when(n == 0, F.concat(F.lit("VALUE "), text)).when(n == 1, F.concat(F.lit("the value "), text, F.lit(" it is"))).when(n == 2, "another text of it").otherwise("short")
    return embeddings.join(after, "vec_id").select("vec_id", F.round(semantics.meaning_similarity(said, truth, F.col("embedding"), F.col("next")), 9).alias("score"))


@query("sim_24_any_order", "embeddings", f"WITH q AS (SELECT embedding AS q FROM embeddings WHERE vec_id = 0), s AS (SELECT label, vec_id, round({_COSINE.format(a='embedding', b='q')}, 9) AS sim FROM embeddings, q), r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY sim DESC, vec_id DESC) AS n FROM s) SELECT label, list(vec_id ORDER BY n) AS best, true AS same FROM r WHERE n <= 3 GROUP BY label")
def _(embeddings):
    """The passages nearest to the first vector, found from rows in their order and in another."""
    question = embeddings.where("vec_id = 0").select(F.lit(0).cast("long").alias("question"), F.col("embedding").alias("vector"), F.lit(3).alias("k"))
    passages = embeddings.select(F.col("label").cast("long").alias("document"), F.col("vec_id").cast("long").alias("passage"), F.col("embedding").alias("vector"))
    best = lambda rows, name: retrieve.nearest(rows, question, by_document=True).groupBy("document").agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "passage"))), lambda x: x["passage"]).alias(name))
    other = best(passages.repartition(7, F.md5(F.col("passage").cast("string"))).sortWithinPartitions(F.md5(F.col("passage").cast("string"))), "other")
    return best(passages, "best").join(other, "document").select(F.col("document").cast("int").alias("label"), "best", (F.col("best") == F.col("other")).alias("same"))


@query("sim_06_merged_name", "part", "WITH n AS (SELECT p_partkey, p_name AS a, CASE p_partkey % 4 WHEN 0 THEN p_name || ' II' WHEN 1 THEN split_part(p_name, ' ', 1) WHEN 2 THEN replace(p_name, ' ', '') ELSE 'another thing' END AS b FROM part) SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN b WHEN 1 THEN a WHEN 2 THEN a ELSE CASE WHEN length(a) <= length(b) THEN a ELSE b END END AS name, CASE p_partkey % 4 WHEN 0 THEN '''' || a || ''' appears to be a variation of ''' || b || '''' WHEN 1 THEN '''' || b || ''' appears to be a variation of ''' || a || '''' WHEN 2 THEN 'Names differ only in case or spacing' ELSE 'names appear to refer to the same entity' END AS reason FROM n")
def _(part):
    """A name beside a longer one, its own first word, its own without spaces, and another."""
    k, name = F.col("p_partkey") % 4, F.col("p_name")
    other = F.when(k == 0, F.concat(name, F.lit(" II"))).when(k == 1, F.split_part(name, F.lit(" "), F.lit(1))).when(k == 2, F.replace(name, F.lit(" "), F.lit(""))).otherwise("another thing")
    return part.select("p_partkey", units.merged_name(name, other).alias("m")).select("p_partkey", "m.*")


@query("agg_10_pending", "documents", "WITH v AS (SELECT DISTINCT lang AS \"column\", source AS value, doc_id FROM documents), n AS (SELECT \"column\", value, doc_id, row_number() OVER (PARTITION BY \"column\", value ORDER BY doc_id) AS k, count(*) OVER (PARTITION BY \"column\", value) AS documents FROM v) SELECT \"column\", value, max(documents) AS documents, list(doc_id ORDER BY doc_id) AS first FROM n WHERE k <= 10 GROUP BY ALL")
def _(documents):
    """Values that wait, with how many documents have them and the first ten."""
    values = documents.select(F.col("lang").alias("column"), F.col("source").alias("value"), F.col("doc_id").alias("document"))
    return catalog.pending(values)
