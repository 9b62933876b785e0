"""Queries of a schema's life, of staged extraction, and of retrieval in batches."""

from pyspark.sql import functions as F

from tessera.functions import replies
from tessera.operators import catalog, extract, merge, retrieve
from tessera.plans.registry import query
from tessera.sources import readers, writers
from tessera.sources.scratch import new_path


@query("prj_07_rename", "supplier", "SELECT s_suppkey, s_name AS title, 'x ' || s_name AS title_excerpt FROM supplier")
def _(supplier):
    return catalog.rename_column(supplier.select("s_suppkey", "s_name", F.concat(F.lit("x "), "s_name").alias("s_name_excerpt")), "s_name", "title")


@query("prj_08_drop", "nation", "SELECT n_nationkey, n_name FROM nation")
def _(nation):
    return catalog.drop_column(nation.select("n_nationkey", "n_name", "n_regionkey", F.lit("e").alias("n_regionkey_excerpt")), "n_regionkey")


@query("ddl_03_add_column", "nation", "SELECT n_nationkey, NULL::VARCHAR AS note FROM nation")
def _(nation):
    return catalog.add_column(nation.select("n_nationkey"), "note")


@query("ddl_04_merge_columns", "part", "SELECT p_partkey, concat_ws(' / ', nullif(trim(p_brand), ''), nullif(trim(p_type), '')) AS label FROM part")
def _(part):
    merged = part.select("p_partkey", "p_brand", "p_type", merge.merge_columns([F.col("p_brand"), F.col("p_type")], "concatenate", " / ").alias("label"))
    return catalog.drop_column(catalog.drop_column(merged, "p_brand"), "p_type")


@query("sim_10_merge_catalogs", "part", "WITH a AS (SELECT DISTINCT p_brand AS name, p_type AS v FROM part WHERE p_size < 25), b AS (SELECT DISTINCT upper(p_brand) AS name, p_type AS v FROM part WHERE p_size >= 20), n AS (SELECT lower(name) AS k, name, 0 AS o, v FROM a UNION ALL SELECT lower(name), name, 1, v FROM b) SELECT arg_min(name, o) AS name, CASE WHEN max(o) = 1 THEN 'the longer one' ELSE 'short' END AS rationale, list(DISTINCT v ORDER BY v) AS allowed_values FROM n GROUP BY k")
def _(part):
    rows = lambda df, name, rationale: df.groupBy(name.alias("name")).agg(F.lit(rationale).alias("rationale"), F.sort_array(F.collect_set("p_type")).alias("allowed_values"))
    old, new = rows(part.where("p_size < 25"), F.col("p_brand"), "short"), rows(part.where("p_size >= 20"), F.upper("p_brand"), "the longer one")
    return catalog.merge_catalogs(old, new).withColumn("allowed_values", F.sort_array("allowed_values"))


@query("set_06_excerpt_union", "conversations", "WITH s AS (SELECT conv_id, turn, text, row_number() OVER (PARTITION BY conv_id, lower(trim(text)) ORDER BY turn) AS n FROM conversations) SELECT conv_id, list(text ORDER BY turn) AS excerpts FROM s WHERE n = 1 GROUP BY conv_id")
def _(conversations):
    own = conversations.groupBy("conv_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]).alias("all"))
    return own.select("conv_id", merge.fold_excerpts(F.col("all")).alias("excerpts"))


@query("set_07_converged", "part", "WITH x AS (SELECT p_brand, list_distinct(list(lower(p_type)) FILTER (p_partkey % 40 <> 0)) AS a, list_distinct(list(lower(p_type))) AS b FROM part GROUP BY p_brand) SELECT p_brand, len(list_intersect(a, b))::DOUBLE / greatest(len(list_distinct(list_concat(a, b))), 1) >= 0.9 AND len(a) = len(b) AS converged FROM x")
def _(part):
    """Whether each brand's set of types is what it was before its last parts came."""
    low = F.lower("p_type")
    sets = part.groupBy("p_brand").agg(F.collect_set(F.when(F.col("p_partkey") % 40 != 0, low)).alias("a"), F.collect_set(low).alias("b"))
    return sets.select("p_brand", catalog.converged(F.col("a"), F.col("b")).alias("converged"))


@query("srt_07_pruned_columns", "part", "SELECT p_brand, p_type FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY n + 0.05 * length(p_type) / 100 DESC, p_type) AS k FROM (SELECT p_brand, p_type, count(*) AS n FROM part GROUP BY ALL)) WHERE k <= 3")
def _(part):
    """The three columns of most weight of each schema, longer rationales a little ahead."""
    rows = part.groupBy("p_brand", "p_type").agg(F.count(F.lit(1)).cast("double").alias("weight"))
    return catalog.pruned(rows, "p_brand", F.col("weight"), F.col("p_type"), 3).select("p_brand", "p_type")


@query("fn_06_decode", "documents", "SELECT doc_id, 'née ' || source AS text FROM documents")
def _(documents):
    said = F.concat(F.lit("née "), "source")
    content = F.when(F.col("doc_id") % 2 == 0, F.encode(said, "UTF-8")).otherwise(F.encode(said, "ISO-8859-1"))
    return documents.select("doc_id", readers.as_text(content).alias("text"))


@query("snk_01_append", "orders", "SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY o_orderstatus")
def _(orders):
    """Rows appended one status after the other, then read as one table."""
    spark, path = orders.sparkSession, new_path(orders.sparkSession, "appended")
    for status in ("F", "O", "P"):
        writers.append_jsonl(orders.where(F.col("o_orderstatus") == status).select("o_orderkey", "o_orderstatus"), path)
    return readers.read_jsonl(spark, path, "o_orderkey long, o_orderstatus string").groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"))


@query("llm_02_modes", "documents", "SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'Question: which?' || chr(10) || chr(10) || 'Documents:' || chr(10) || source WHEN 1 THEN 'Documents:' || chr(10) || source ELSE 'Question: which?' END AS prompt FROM documents")
def _(documents):
    mode = F.when(F.col("doc_id") % 3 == 0, "STANDARD").when(F.col("doc_id") % 3 == 1, "DOCUMENT_ONLY").otherwise("QUERY_ONLY")
    return documents.select("doc_id", extract.discovery_prompt(mode, F.lit("which?"), F.col("source")).alias("prompt"))


@query("llm_09_attempts", "lineitem", "SELECT l_orderkey AS doc_id, l_linestatus AS \"column\", arg_min(l_returnflag, l_linenumber) AS answer, min(l_linenumber) AS attempt FROM (SELECT l_orderkey, l_linestatus, l_linenumber, min(l_returnflag) AS l_returnflag FROM lineitem WHERE l_returnflag <> 'N' AND l_linenumber <= 3 GROUP BY ALL) GROUP BY ALL")
def _(lineitem):
    """Cells asked for one by one: the first of three attempts that says something counts."""
    answer = F.when(F.col("l_returnflag") == "N", "not found").otherwise(F.col("l_returnflag"))
    replies_ = lineitem.groupBy("l_orderkey", "l_linestatus", "l_linenumber").agg(F.min(answer).alias("answer"))
    return extract.first_answers(replies_.select(F.col("l_orderkey").alias("doc_id"), F.col("l_linestatus").alias("column"), F.col("l_linenumber").alias("attempt"), "answer"), 3)


@query("llm_07_missing_cells", "documents labels", "SELECT d.doc_id, c AS \"column\" FROM documents d CROSS JOIN (SELECT unnest(['quality', 'toxic', 'topic']) AS c) LEFT JOIN labels l USING (doc_id) WHERE l.doc_id IS NULL OR c = 'topic'")
def _(documents, labels):
    """Cells that a pass over all columns left open, for the next stage."""
    found = labels.select("doc_id", F.explode(F.array(F.lit("quality"), F.lit("toxic"))).alias("column"))
    return extract.missing_cells(documents.select("doc_id"), found, ["quality", "toxic", "topic"])


@query("sup_08_aspects", "events", "SELECT event_id, [event_type, json_extract_string(props, '$.k')] AS aspects, json_extract_string(props, '$.k') AS k FROM events")
def _(events):
    k = F.get_json_object("props", "$.k")
    said = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("Aspects: ['"), "event_type", F.lit("', '"), k, F.lit("'] and\n```json\n"), "props", F.lit("\n```"))).otherwise(F.concat(F.lit('I chose ["'), "event_type", F.lit('", "'), k, F.lit('"]. So: '), "props", F.lit(" is it")))
    return events.select("event_id", replies.aspects(said).alias("aspects"), F.try_variant_get(replies.repaired(said), "$.k", "string").alias("k"))


@query("sim_23_ranked_in_batches", "embeddings", "SELECT label, vec_id FROM (SELECT label, vec_id, row_number() OVER (PARTITION BY label ORDER BY embedding[1]::DOUBLE DESC, vec_id DESC) AS n FROM embeddings) WHERE n <= 4")
def _(embeddings):
    """Ranked in batches of forty, twice as many kept of each, and these ranked again."""
    return retrieve.ranked_in_batches(embeddings, F.element_at("embedding", 1).cast("double"), "label", "vec_id", 4, 40).select("label", "vec_id")
