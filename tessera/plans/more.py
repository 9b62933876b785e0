"""Queries of the remaining operators."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.functions import cells, documents as docs_, literals, similarity
from tessera.operators import catalog, cost, evaluate, extract, merge, profile, retrieve
from tessera.plans.registry import query
from tessera.sources import readers, writers
from tessera.sources.scratch import new_path
from tessera.streaming import progress


@query("src_03_system_files", "nation", "SELECT n_nationkey FROM nation WHERE n_nationkey % 3 <> 0")
def _(nation):
    named = nation.withColumn("f", F.when(F.col("n_nationkey") % 3 == 0, F.concat(F.lit("~$"), "n_name")).otherwise(F.concat("n_name", F.lit(".txt"))))
    return named.where(~readers.is_system(F.col("f"))).select("n_nationkey")


@query("src_16_encodings", "supplier", "SELECT s_suppkey, 'é' || s_name AS text FROM supplier")
def _(supplier):
    text = F.concat(F.lit("é"), "s_name")
    content = F.when(F.col("s_suppkey") % 2 == 0, F.encode(text, "UTF-8")).otherwise(F.encode(text, "ISO-8859-1"))
    return supplier.select("s_suppkey", readers.as_text(content).alias("text"))


@query("src_02_files", "region", "SELECT count(*) AS files, 0 AS hidden FROM region")
def _(region):
    spark, path = region.sparkSession, new_path(region.sparkSession, "files")
    region.repartition(5, "r_regionkey").select(F.concat(F.lit("d"), F.col("r_regionkey").cast("string")).alias("d"), F.col("r_name").alias("value")).write.partitionBy("d").text(path)
    found = readers.scan_files(spark, [f"{path}/d=d{i}" for i in range(5)])
    return found.agg(F.count(F.lit(1)).alias("files"), F.count_if(F.col("filename").startswith("_")).cast("int").alias("hidden"))


@query("prj_01_nested_rows", "orders", "SELECT o_orderkey, ['status'] AS names FROM orders")
def _(orders):
    flat = F.create_map(F.lit("_row_name"), F.col("o_orderpriority"), F.lit("status"), F.col("o_orderstatus"))
    return orders.select("o_orderkey", F.map_keys(cells.nested(flat)).alias("names"))


@query("prj_06_excerpts", "supplier", """SELECT s_suppkey, list_transform(x, lambda e: e.text) AS texts, list_transform(x, lambda e: e.source) AS sources FROM (SELECT s_suppkey, CASE s_suppkey % 6
  WHEN 0 THEN [{'text': 'it''s ' || s_name, 'source': 'd "1"'}, {'text': s_name || chr(10) || 'b', 'source': 'file'}] WHEN 1 THEN [{'text': s_name, 'source': 'a'}, {'text': 'plain', 'source': 'file'}]
  WHEN 2 THEN [{'text': s_name, 'source': 'x'}, {'text': 'b "q"', 'source': 'file'}] WHEN 3 THEN [{'text': s_name || ' said so', 'source': 'file'}]
  WHEN 4 THEN [{'text': 'don''t ' || s_name, 'source': 's'}, {'text': '[odd', 'source': 'file'}] ELSE []::STRUCT("text" VARCHAR, source VARCHAR)[] END AS x FROM supplier)""")
def _(supplier):
    """Dictionaries in Python's spelling, bracketed sources, a JSON list, plain text, broken quotes, and nothing."""
    name = F.col("s_name")
    cell = F.element_at(F.array(
        F.concat(F.lit("{'text': \"it's "), name, F.lit("\", 'source': 'd \"1\"'} | '"), name, F.lit("\\nb'")),
        F.concat(F.lit("[a] "), name, F.lit(" | plain")),
        F.concat(F.lit('[{"text": "'), name, F.lit('", "source": "x"}, "b \\"q\\"", 7]')),
        F.concat(name, F.lit(" said so")),
        F.concat(F.lit("{'text': 'don't "), name, F.lit("', 'source': 's'} | [odd")),
        F.lit(""),
    ), (F.col("s_suppkey") % 6 + 1).cast("int"))
    found = supplier.select("s_suppkey", literals.excerpt_items(cell, F.lit("file")).alias("x"))
    return found.select("s_suppkey", F.col("x.text").alias("texts"), F.col("x.source").alias("sources"))


@query("prj_17_attach_source", "supplier", "SELECT s_suppkey, s_name AS text, 'doc' AS source FROM supplier")
def _(supplier):
    got = cells.attach_source(F.array("s_name"), F.lit("doc"))
    return supplier.select("s_suppkey", got[0]["text"].alias("text"), got[0]["source"].alias("source"))


@query("prj_19_unit_name", "orders", "SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN o_orderpriority ELSE o_orderstatus END AS unit FROM orders")
def _(orders):
    data = F.create_map(F.when(F.col("o_orderkey") % 2 == 0, F.lit("unit_name")).otherwise(F.lit("Observation")), F.when(F.col("o_orderkey") % 2 == 0, F.col("o_orderpriority")).otherwise(F.col("o_orderstatus")))
    return orders.select("o_orderkey", cells.unit_name(data).alias("unit"))


@query("prj_20_source_document", "documents", "SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'named' ELSE source END AS document FROM documents")
def _(documents):
    data = F.when(F.col("doc_id") % 2 == 0, F.create_map(F.lit("document"), F.lit("named"))).otherwise(F.create_map(F.lit("x"), F.lit("y")))
    return documents.select("doc_id", cells.source_document(data, F.array("source")).alias("document"))


@query("prj_24_flatten", "part", "SELECT p_partkey, p_brand || ', ' || p_type AS v FROM part")
def _(part):
    return part.select("p_partkey", cells.flatten_json(F.to_json(F.array("p_brand", "p_type"))).alias("v"))


@query("prj_13_full_columns", "documents labels", "SELECT doc_id, lang FROM documents")
def _(documents, labels):
    wide = documents.select("doc_id", "lang").join(labels.select("doc_id", "toxic"), "doc_id", "left")
    return wide.select(profile.full_columns(wide, wide.columns, 95.0))


@query("jon_09_schema_matrix", "nation", "SELECT a.n_name AS gold, b.n_name AS predicted, round(CASE WHEN a.n_name = b.n_name THEN 1::DOUBLE ELSE 0::DOUBLE END, 6) AS score FROM nation a, nation b WHERE a.n_regionkey = 0 AND b.n_regionkey < 2")
def _(nation):
    gold, predicted = nation.where("n_regionkey = 0").select(F.col("n_name").alias("gold")), nation.where("n_regionkey < 2").select(F.col("n_name").alias("predicted"))
    return gold.crossJoin(F.broadcast(predicted)).withColumn("score", F.when(F.col("gold") == F.col("predicted"), 1.0).otherwise(0.0))  # catalogs: tens of names


@query("jon_18_model_spec", "nation region", "SELECT n_name, coalesce(r_regionkey, -1) AS spec FROM nation LEFT JOIN region ON starts_with(n_name, left(r_name, 2))")
def _(nation, region):
    prefix = region.select(F.left("r_name", F.lit(2)).alias("p"), "r_regionkey")
    return nation.join(F.broadcast(prefix), F.col("n_name").startswith(F.col("p")), "left").select("n_name", F.coalesce("r_regionkey", F.lit(-1)).alias("spec"))


@query("agg_04_completeness_all", "customer", "SELECT count(*) AS total_rows, 100::DOUBLE AS completeness FROM customer")
def _(customer):
    return profile.completeness(customer, customer.columns, "N5")


@query("agg_23_warnings", "documents", "WITH c AS (SELECT (ceil(count(*) / 4) + 1)::BIGINT AS calls FROM documents), t AS (SELECT calls, calls * 15 * 250 AS tokens_in, calls * 300 AS tokens_out FROM c) SELECT calls, list_filter([CASE WHEN tokens_in / calls > 0.8 * 4000 THEN 'near the context limit' END, CASE WHEN round(tokens_in / 1e6 * 0.15 + tokens_out / 1e6 * 0.6, 6) > 10 THEN 'over 10 dollars' END], lambda w: w IS NOT NULL) AS warnings FROM t")
def _(documents):
    return cost.warnings(cost.discovery(documents, 4, 15, 0.15, 0.6), 4000).select("calls", "warnings")


@query("agg_26_extraction_quality", "documents labels", "SELECT round(count(quality) / count(*), 6) AS success_rate, round(least(1, 1.2 * count(quality) / count(*)), 6) AS quality FROM documents LEFT JOIN labels USING (doc_id)")
def _(documents, labels):
    rate = F.count("quality") / F.count(F.lit(1))
    return documents.select("doc_id").join(labels, "doc_id", "left").agg(F.round(rate, 6).alias("success_rate"), F.round(F.least(F.lit(1.0), rate * 1.2), 6).alias("quality"))


@query("agg_29_contribution", "documents", "SELECT source, round(count(*) / (SELECT count(*) FROM documents), 6) AS rate FROM documents GROUP BY source")
def _(documents):
    n = documents.agg(F.count(F.lit(1)).alias("all"))
    return documents.groupBy("source").agg(F.count(F.lit(1)).alias("n")).crossJoin(F.broadcast(n)).select("source", F.round(F.col("n") / F.col("all"), 6).alias("rate"))


@query("agg_32_papers_by_row", "documents", "SELECT split_part(source, 'c', 2) AS row_name, list(DISTINCT lang ORDER BY lang) AS papers FROM documents GROUP BY 1")
def _(documents):
    return documents.groupBy(F.split_part("source", F.lit("c"), F.lit(2)).alias("row_name")).agg(F.sort_array(F.collect_set("lang")).alias("papers"))


@query("set_02_ordered_union", "part", "SELECT p_partkey, CASE WHEN p_brand = p_type THEN [p_brand] ELSE [p_brand, p_type] END AS v FROM part")
def _(part):
    return part.select("p_partkey", F.filter(F.array_distinct(F.concat(F.array("p_brand", "p_type"), F.array("p_brand", F.lit(None)))), lambda x: x.isNotNull()).alias("v"))


@query("set_08_needed_documents", "documents", "SELECT DISTINCT source FROM documents WHERE source NOT IN ('src1', 'src2')")
def _(documents):
    local = documents.where(F.col("source").isin("src1", "src2")).select("source").distinct()
    return documents.select("source").distinct().join(local, "source", "left_anti")


@query("fn_09_clamp", "part", "SELECT p_partkey, CASE WHEN p_size < 10 THEN '10.0' WHEN p_size > 40 THEN '40.0' ELSE p_size || '%' END AS v FROM part")
def _(part):
    return part.select("p_partkey", cells.clamp(F.concat(F.col("p_size").cast("string"), F.lit("%")), 10, 40).alias("v"))


@query("fn_10_rounding", "orders", "SELECT o_orderkey, ceil(o_totalprice / 1000)::BIGINT AS up, round(abs(o_totalprice - 1000) / 7, 4) AS err FROM orders")
def _(orders):
    return orders.select("o_orderkey", F.ceil(F.col("o_totalprice") / 1000).alias("up"), F.round(F.abs(F.col("o_totalprice") - 1000) / 7, 4).alias("err"))


@query("fn_11_cost", "orders", "SELECT o_orderkey, round(o_custkey / 1e6 * 0.1537 + o_orderkey / 1e6 * 0.6131, 6) AS cost FROM orders")
def _(orders):
    return orders.select("o_orderkey", cost.cost(F.col("o_custkey"), F.col("o_orderkey"), 0.1537, 0.6131).alias("cost"))


@query("fn_14_arrays", "part", "SELECT p_partkey, [p_type] AS rest FROM part")
def _(part):
    return part.select("p_partkey", F.array_distinct(F.flatten(F.array(F.slice(F.array("p_brand", "p_type"), 2, 5), F.array("p_type")))).alias("rest"))


@query("fn_16_iso_dates", "orders", "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS day, true AS iso FROM orders")
def _(orders):
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    return orders.select("o_orderkey", day.alias("day"), day.rlike(r"^\d{4}-\d{2}-\d{2}").alias("iso"))


@query("doc_08_structural", "pages")
def _(pages):
    return pages.select("page_id", F.posexplode(docs_.structural(docs_.html_text(F.col("html")))).alias("pos", "part"))


@query("doc_14_prompts", "supplier", "SELECT s_suppkey, 'Column: name' || chr(10) || 'Text: ' || s_name AS prompt FROM supplier")
def _(supplier):
    return supplier.select("s_suppkey", F.concat_ws("\n", F.lit("Column: name"), F.concat(F.lit("Text: "), "s_name")).alias("prompt"))


@query("sim_13_dispatch", "orders", "SELECT o_orderkey, CASE o_orderstatus WHEN 'O' THEN true WHEN 'F' THEN true ELSE false END AS match FROM orders")
def _(orders):
    status = F.col("o_orderstatus")
    predicted = F.when(status == "O", "Yes, it has").when(status == "F", "123").otherwise("abc")
    truth = F.when(status == "O", "yes").when(status == "F", "123.0").otherwise("xyz")
    binary = evaluate.binary(truth).isNotNull() & (status == "O")
    match = F.when(binary, evaluate.binary(predicted) == evaluate.binary(truth)).when(cells.number(truth).isNotNull(), evaluate.numeric_match(predicted, truth)["match"]).otherwise(F.lower(predicted) == F.lower(truth))
    return orders.select("o_orderkey", match.alias("match"))


@query("sim_22_rerank", "embeddings", "WITH q AS (SELECT embedding AS q FROM embeddings WHERE vec_id = 0), s AS (SELECT vec_id, label, list_dot_product(embedding::DOUBLE[], q::DOUBLE[]) AS d, list_dot_product(embedding::DOUBLE[], q::DOUBLE[]) / ((sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) + 1e-8) * (sqrt(list_dot_product(q::DOUBLE[], q::DOUBLE[])) + 1e-8)) AS sim FROM embeddings, q), t AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY sim DESC, vec_id DESC) AS n FROM s) WHERE n <= 8) SELECT label, vec_id FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY d DESC, vec_id DESC) AS m FROM t) WHERE m <= 3")
def _(embeddings):
    """The eight nearest by cosine of each label, ordered anew by a second scorer, three kept."""
    q = embeddings.where("vec_id = 0").select(F.col("embedding").alias("q"))
    near = embeddings.join(F.broadcast(q), F.lit(True)).withColumn("similarity", similarity.cosine(F.col("embedding"), F.col("q")))
    return retrieve.rerank(retrieve.top_k(near, "label", "vec_id", 8), similarity.dot(F.col("embedding"), F.col("q")), "label", "vec_id", 3).select("label", "vec_id")


@query("ddl_05_validate", "part", "SELECT lower(p_brand) AS name, count(*) > 1 AS duplicate FROM part GROUP BY 1")
def _(part):
    return part.groupBy(F.lower("p_brand").alias("name")).agg((F.count(F.lit(1)) > 1).alias("duplicate"))


@query("ddl_09_remove_units", "documents", "SELECT doc_id FROM documents WHERE lang NOT IN ('de', 'fr')")
def _(documents):
    gone = documents.where(F.col("lang").isin("de", "fr")).select("lang").distinct()
    return documents.join(gone, "lang", "left_anti").select("doc_id")


@query("str_sliding", "events", "WITH b AS (SELECT event_type, time_bucket(INTERVAL 1 HOUR, ts) AS h FROM events), s AS (SELECT event_type, h AS start FROM b UNION ALL SELECT event_type, h - INTERVAL 1 HOUR FROM b) SELECT start, event_type, count(*) AS n FROM s GROUP BY ALL")
def _(events):
    from tessera.plans.jobs import _stream

    out = progress.run_once(progress.sliding(_stream(events), "ts", "event_type", "2 hours", "1 hour", "60 days"))
    return out.select(F.col("window.start").alias("start"), "event_type", "n")


@query("str_08_suggested", "events", "SELECT event_type AS \"column\", user_id % 3 = 0 AS value, count(DISTINCT user_id) AS documents FROM events GROUP BY ALL")
def _(events):
    from tessera.plans.jobs import _stream

    rows = _stream(events).select(F.col("event_type").alias("column"), (F.col("user_id") % 3 == 0).alias("value"), F.col("user_id").alias("document"))
    return progress.run_once(progress.suggested(rows))


@query("sup_01_fill_by_position", "nation region", "SELECT n_nationkey, r_name AS paper FROM nation JOIN region ON n_nationkey = r_regionkey")
def _(nation, region):
    return nation.join(region, F.expr("n_nationkey = r_regionkey")).select("n_nationkey", F.col("r_name").alias("paper"))


@query("sup_03_strategy", "part", r"""WITH t AS (SELECT p_partkey, 'Kind' || p_size AS name, CASE p_partkey % 6 WHEN 0 THEN 'a count of ' || p_name WHEN 1 THEN 'the TYPE, and ' || p_type WHEN 2 THEN 'about the evidence for ' || p_name WHEN 3 THEN 'detailed ' || p_name WHEN 4 THEN '' ELSE p_name END AS d, CASE WHEN p_partkey % 4 = 0 THEN 'a score' ELSE '' END AS r FROM part)
SELECT p_partkey, CASE WHEN regexp_matches(x, 'unique|identifier|name|id') THEN 'identifier' WHEN regexp_matches(x, 'numeric|number|count|score|value') THEN 'numeric' WHEN regexp_matches(x, 'categorical|classification|type|category') THEN 'categorical' WHEN regexp_matches(x, 'detailed|description|content|text') THEN 'text' ELSE 'general' END AS extraction_type,
  CASE WHEN regexp_matches(x, 'unique|identifier|name|id') THEN 0.8 WHEN regexp_matches(x, 'numeric|number|count|score|value') THEN 0.75 WHEN regexp_matches(x, 'categorical|classification|type|category') THEN 0.65 WHEN regexp_matches(x, 'detailed|description|content|text') THEN 0.6 ELSE 0.7 END::DOUBLE AS confidence_threshold,
  CASE WHEN regexp_matches(x, 'unique|identifier|name|id|numeric|number|count|score|value|categorical|classification|type|category') OR NOT regexp_matches(x, 'detailed|description|content|text') THEN 'heuristic' ELSE 'expanded_retrieval' END AS fallback_strategy,
  list_sort(list_distinct(list_concat([lower(name)], list_filter(regexp_extract_all(lower(d), '\w{3,}'), lambda w: w NOT IN ('the', 'and', 'for', 'with', 'this', 'that', 'from', 'about'))))) AS search_keywords FROM (SELECT *, lower(d || ' ' || r) AS x FROM t)""")
def _(part):
    n = F.col("p_partkey")
    said = F.element_at(F.array(F.concat(F.lit("a count of "), "p_name"), F.concat(F.lit("the TYPE, and "), "p_type"), F.concat(F.lit("about the evidence for "), "p_name"), F.concat(F.lit("detailed "), "p_name"), F.lit(""), F.col("p_name")), (n % 6 + 1).cast("int"))
    got = catalog.strategy(F.concat(F.lit("Kind"), F.col("p_size").cast("string")), said, F.when(n % 4 == 0, "a score").otherwise(""))
    return part.select("p_partkey", got.alias("s")).select("p_partkey", "s.*")


@query("sup_07_example_rows", "documents", "SELECT doc_id, lang FROM (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY md5(doc_id::VARCHAR), doc_id) AS n FROM documents) WHERE n <= 2")
def _(documents):
    w = Window.partitionBy("lang").orderBy(F.md5(F.col("doc_id").cast("string")), "doc_id")
    return documents.withColumn("n", F.row_number().over(w)).where("n <= 2").select("doc_id", "lang")


@query("sup_09_named_shots", "labels documents", "SELECT doc_id, quality FROM labels WHERE doc_id IN (SELECT min(doc_id) FROM documents GROUP BY source)")
def _(labels, documents):
    """Rows picked by name: those of each source's first document."""
    return labels.join(documents.groupBy("source").agg(F.min("doc_id").alias("doc_id")).select("doc_id"), "doc_id", "left_semi").select("doc_id", "quality")


@query("sup_11_recommendations", "labels", "SELECT round(avg(quality), 6) AS accuracy, CASE WHEN avg(quality) < 0.7 THEN ['refine definitions', 'add columns'] WHEN avg(quality) < 0.8 THEN ['add columns'] ELSE [] END AS recommendations FROM labels")
def _(labels):
    one = labels.agg(F.avg("quality").alias("accuracy")).withColumn("answer_rate", F.col("accuracy")).withColumn("high_rate", F.lit(1.0))
    return catalog.recommendations(one).select(F.round("accuracy", 6).alias("accuracy"), "recommendations")


@query("sup_16_infer_unit", "documents", "SELECT min(lang) AS unit FROM documents")
def _(documents):
    return documents.agg(F.coalesce(F.min("lang"), F.lit("entry")).alias("unit"))


@query("llm_10_postprocess", "orders", "SELECT o_orderkey, o_orderstatus AS answer FROM orders WHERE o_orderstatus <> 'P'")
def _(orders):
    answer = F.when(F.col("o_orderstatus") == "P", "not reported").otherwise(F.col("o_orderstatus"))
    rows = orders.select("o_orderkey", answer.alias("answer"))
    return rows.where(~cells.placeholder(F.col("answer"), F.lit(0)))


@query("llm_12_cache", "documents labels", "SELECT d.doc_id FROM documents d WHERE md5(text) NOT IN (SELECT md5(text) FROM documents JOIN labels USING (doc_id))")
def _(documents, labels):
    known = documents.join(labels, "doc_id").select(F.md5("text").alias("key")).distinct()
    return retrieve.missing_embeddings(documents.select("doc_id", "text"), known).select("doc_id")


@query("snk_09_blank_cells", "documents labels", "SELECT d.doc_id::VARCHAR AS \"Doc Id\", coalesce(quality::VARCHAR, '') AS \"Quality\" FROM documents d LEFT JOIN labels USING (doc_id)")
def _(documents, labels):
    return writers.answers(documents.select("doc_id").join(labels.select("doc_id", "quality"), "doc_id", "left"), blank=True)


@query("jon_19_excerpts_by_document", "documents", "SELECT doc_id, 'exact' AS status FROM documents WHERE length(text) > 40")
def _(documents):
    long = documents.where("length(text) > 40").select("doc_id", "text", F.substring("text", 11, 20).alias("excerpt"))
    return long.select("doc_id", similarity.ground_plain(F.col("excerpt"), F.col("text")).alias("status"))


@query("llm_05_discovery", "documents", "SELECT unnest(['lang', 'source']) AS name")
def _(documents):
    shown = documents.select(F.concat_ws("\n", F.concat(F.lit("lang: "), "lang"), F.concat(F.lit("source: "), "source"), "text").alias("text"))  # what the model is shown
    return extract.propose(shown, extract.RuleModel).select("name")


@query("agg_35_rows_with_missing", "documents", "SELECT count(DISTINCT doc_id) AS n_rows FROM documents WHERE source NOT IN ('src0', 'src1')")
def _(documents):
    refs = documents.select(F.col("doc_id").alias("row_name"), F.col("source").alias("paper"))
    papers = documents.select(F.col("source").alias("paper"))
    status = merge.availability(refs, papers.where("paper = 'src0'"), papers.where("paper = 'src1'"))
    return refs.join(status.where("status = 'missing'"), "paper").agg(F.count_distinct("row_name").alias("n_rows"))
