"""Queries of the document engine, retrieval, evaluation, costs and Spark's own extensions."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.functions import cells, documents as docs_, replies, similarity
from tessera.functions.cells import bound
from tessera.operators import alike, cost, evaluate, filters, match, retrieve
from tessera.plans.registry import query

_SENT = "string_split(regexp_replace(text, '([.?!])\\s+', '\\1' || chr(1), 'g'), chr(1))"


@query("doc_09_sentences", "documents", f"SELECT doc_id, len({_SENT})::INT AS n, {_SENT}[1] AS first FROM documents")
def _(documents):
    s = docs_.sentences(F.col("text"))
    return documents.select("doc_id", F.size(s).alias("n"), F.element_at(s, 1).alias("first"))


@query("win_10_word_windows", "documents", "WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '') AS w FROM documents) SELECT doc_id, CASE WHEN len(w) = 0 THEN 0 ELSE ((len(w) - 1) // 64 + 1)::INT END AS n, array_to_string(w[1:128], ' ') AS first FROM w")
def _(documents):
    found = lambda w: F.struct(F.size(w).alias("n"), F.coalesce(F.array_join(F.try_element_at(w, F.lit(1)), " "), F.lit("")).alias("first"))
    return documents.select("doc_id", bound(docs_.windows(docs_.words(F.col("text")), 128, 64), found).alias("w")).select("doc_id", "w.*")


@query("doc_10_chunks", "documents")
def _(documents):
    return documents.select("doc_id", F.posexplode(docs_.chunks(F.col("text"), docs_.chunk_width(2000, 15))).alias("pos", "passage"))


@query("doc_01_preprocess", "documents", "WITH t AS (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'Abstract and introduction' || chr(10) || text || chr(10) || 'the methods and results' ELSE text END AS body FROM documents), f AS (SELECT doc_id, body, body || chr(10) || 'References' || chr(10) || '[1] x' AS whole FROM t) SELECT doc_id, CASE WHEN doc_id % 2 = 0 AND length(whole) >= 1000 THEN regexp_replace(body, '^\\s+|\\s+$', '', 'g') ELSE whole END AS text FROM f")
def _(documents):
    body = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("Abstract and introduction\n"), "text", F.lit("\nthe methods and results"))).otherwise(F.col("text"))
    shown = documents.select("doc_id", F.concat(body, F.lit("\nReferences\n[1] x")).alias("text"))
    return shown.select("doc_id", docs_.preprocess(F.col("text"), filters.paper_score(F.col("text")) >= 4).alias("text"))


# where a heading that follows a text begins: after the first line break that ends it
_HEADED = "WITH h AS (SELECT doc_id, text, CASE doc_id % 5 WHEN 0 THEN 'References' WHEN 1 THEN '2. Reference' WHEN 2 THEN 'literature cited' WHEN 3 THEN '\\section{references}' ELSE 'Works cited' END AS heading FROM documents), f AS (SELECT doc_id, heading, text || chr(10) || heading || chr(10) || '[1] x' AS t, length(regexp_replace(text, '\\s+$', '')) AS n, length(text) AS whole FROM h), g AS (SELECT *, CASE WHEN doc_id % 5 = 3 THEN whole + 2 WHEN n = 0 THEN 1 ELSE n + strpos(substr(t, n + 1), chr(10)) + 1 END AS place FROM f)"


@query("doc_02_references", "documents", f"{_HEADED} SELECT doc_id, CASE WHEN doc_id % 5 < 4 AND place - 1 > 0.7 * length(t) THEN regexp_replace(substr(t, 1, place - 1), '^\\s+|\\s+$', '', 'g') ELSE t END AS text FROM g")
def _(documents):
    heading = F.get(F.array(*map(F.lit, ("References", "2. Reference", "literature cited", "\\section{references}", "Works cited"))), (F.col("doc_id") % 5).cast("int"))
    return documents.select("doc_id", docs_.without_references(F.concat("text", F.lit("\n"), heading, F.lit("\n[1] x"))).alias("text"))


@query("doc_03_acknowledgments", "documents", "WITH f AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN '[1] 2' ELSE 'we thank' END AS tail, text || chr(10) || 'Acknowledgements' || chr(10) || CASE WHEN doc_id % 3 = 0 THEN '[1] 2' ELSE 'we thank' END AS t, length(regexp_replace(text, '\\s+$', '')) AS n FROM documents), g AS (SELECT *, CASE WHEN n = 0 THEN 1 ELSE n + strpos(substr(t, n + 1), chr(10)) + 1 END AS place FROM f) SELECT doc_id, CASE WHEN doc_id % 3 > 0 THEN substr(t, 1, place - 1) || chr(10) || tail WHEN place - 1 > 0.8 * length(t) THEN substr(t, 1, place - 1) ELSE t END AS text FROM g")
def _(documents):
    tail = F.when(F.col("doc_id") % 3 == 0, "[1] 2").otherwise("we thank")
    return documents.select("doc_id", docs_.without_acknowledgments(F.concat("text", F.lit("\nAcknowledgements\n"), tail)).alias("text"))


@query("doc_05_tables", "pages")
def _(pages):
    text = F.concat(docs_.html_text(F.col("html")), F.lit("\nTable 1. Pages\nid | url\n1 | a\n2 | b\n\n"))
    return pages.select("page_id", text.alias("text")).lateralJoin(docs_.DetectTables(F.col("text").outer())).drop("text")


@query("doc_07_cells", "part", "SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN [p_name, p_brand, p_type] WHEN 1 THEN [p_name, p_brand] ELSE [p_name, p_type] END AS cells FROM part")
def _(part):
    k = F.col("p_partkey") % 3
    line = F.when(k == 0, F.concat(F.lit("| "), F.concat_ws(" | ", "p_name", "p_brand", "p_type"), F.lit(" |"))).when(k == 1, F.concat_ws("\t", "p_name", "p_brand")).otherwise(F.concat_ws("   ", "p_name", "p_type"))
    return part.select("p_partkey", docs_.line_cells(line).alias("cells"))


@query("doc_12_keywords", "part", "SELECT p_partkey, list_sort(list_filter(list_distinct(regexp_extract_all(lower(p_name || ' ' || p_type), '[a-z0-9_]+')), lambda w: length(w) > 2)) AS keywords FROM part")
def _(part):
    return part.select("p_partkey", F.array_sort(docs_.keywords(F.concat_ws(" ", "p_name", "p_type"))).alias("keywords"))


@query("doc_04_reduction", "pages")
def _(pages):
    text = docs_.html_text(F.col("html"))
    return pages.select("page_id", F.length("html").alias("before"), F.length(text).alias("after"), F.round(1 - F.length(text) / F.length("html"), 6).alias("reduction"))


@query("fn_04_nfkc", "documents")
def _(documents):
    return documents.select("doc_id", docs_.nfkc(F.col("text")).alias("text"))


@query("fn_05_slug", "part", "SELECT p_partkey, regexp_replace(regexp_replace(p_name, '[^\\w\\s.-]', '', 'g'), '\\s+', '_', 'g') AS slug FROM part")
def _(part):
    return part.select("p_partkey", docs_.slug(F.col("p_name")).alias("slug"))


@query("fn_07_tokens", "documents", "SELECT doc_id, length(text) // 4 AS tokens FROM documents")
def _(documents):
    return documents.select("doc_id", docs_.token_count(F.col("text")).alias("tokens"))


@query("fn_12_json", "events", "SELECT event_id, json_extract_string(props, '$.k') AS k FROM events")
def _(events):
    k = F.col("event_id") % 6
    cut = F.regexp_replace("props", r"\}\s*$", "")
    shown = (
        F.when(k == 0, F.concat(F.lit("Sure:\n```json\n"), "props", F.lit("\n``` as asked")))
        .when(k == 1, F.concat(cut, F.lit(", }")))
        .when(k == 2, cut)
        .when(k == 3, F.concat(F.lit("I found "), "props"))
        .when(k == 4, F.translate("props", '"', "“"))
        .otherwise(F.col("props"))
    )
    return events.select("event_id", F.try_variant_get(replies.repaired(shown), "$.k", "string").alias("k"))


_HOLDS = lambda column, words: "(" + " OR ".join(f"contains({column}, '{w}')" for w in words) + ")"
_CONFIDENCE = f"CASE WHEN {_HOLDS('t', ['high confident', 'very confident', 'certain', 'definitely'])} THEN 'High' WHEN {_HOLDS('t', ['medium', 'somewhat', 'likely', 'probably'])} THEN 'Medium' WHEN {_HOLDS('t', ['low', 'uncertain', 'unclear', 'insufficient', 'not sure'])} THEN 'Low' ELSE 'Medium' END"
_SUFFICIENCY = f"CASE WHEN {_HOLDS('t', ['insufficient information', 'not enough', 'missing', 'unclear'])} THEN 'Insufficient' WHEN {_HOLDS('t', ['partially', 'somewhat', 'limited'])} THEN 'Partial' ELSE 'Complete' END"
_SAID = "SELECT event_id, lower(props || CASE event_id % 8 WHEN 0 THEN ' I am Certain' WHEN 1 THEN ' probably so' WHEN 2 THEN ' not sure, unclear' WHEN 3 THEN ' confident' WHEN 4 THEN ' somewhat limited' WHEN 5 THEN ' not enough, low' WHEN 6 THEN ' partially' ELSE '' END) AS t FROM events"


def _said(events):
    tail = F.get(F.array(*map(F.lit, (" I am Certain", " probably so", " not sure, unclear", " confident", " somewhat limited", " not enough, low", " partially", ""))), (F.col("event_id") % 8).cast("int"))
    return events.select("event_id", F.concat("props", tail).alias("t"))


@query("fn_18_confidence", "events", f"SELECT event_id, {_CONFIDENCE} AS confidence, {_SUFFICIENCY} AS sufficiency FROM ({_SAID})")
def _(events):
    return _said(events).select("event_id", replies.confidence(F.col("t")).alias("confidence"), replies.sufficiency(F.col("t"), F.lit("")).alias("sufficiency"))


@query("fn_19_reply_parts", "part", "SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN p_name ELSE p_name END AS answer, CASE WHEN p_partkey % 3 = 0 THEN 'Medium' ELSE p_brand END AS confidence, CASE WHEN p_partkey % 3 = 0 THEN p_name ELSE p_type || ' |x' END AS reasoning, 'Complete' AS sufficiency FROM part")
def _(part):
    reply = F.when(F.col("p_partkey") % 3 == 0, F.concat("p_name", F.lit("  "))).otherwise(F.concat(F.concat_ws(" | ", "p_name", "p_brand", "p_type"), F.lit(" |x ")))
    return part.select("p_partkey", replies.parts(reply).alias("p")).select("p_partkey", "p.*")


@query("fn_20_binary", "events", f"SELECT event_id, CASE WHEN {_HOLDS('t', ['yes', 'true', 'positive', 'confirmed', 'present'])} THEN true WHEN {_HOLDS('t', ['no', 'false', 'negative', 'absent', 'not', 'none'])} THEN false END AS v FROM (SELECT event_id, lower(event_type || CASE event_id % 6 WHEN 0 THEN ' is NOT present' WHEN 1 THEN ' Confirmed' WHEN 2 THEN ' 12 mg' WHEN 3 THEN ' absent' WHEN 4 THEN ' none' ELSE '' END) AS t FROM events)")
def _(events):
    tail = F.get(F.array(*map(F.lit, (" is NOT present", " Confirmed", " 12 mg", " absent", " none", ""))), (F.col("event_id") % 6).cast("int"))
    return events.select("event_id", evaluate.binary(F.concat("event_type", tail)).alias("v"))


@query("fn_21_longest_capitals", "part", "SELECT p_partkey, coalesce(list_reduce(list_prepend('', regexp_extract_all(upper(p_name), '[A-Z]{3,}')), lambda a, x: CASE WHEN length(x) > length(a) THEN x ELSE a END), '') AS v FROM part")
def _(part):
    return part.select("p_partkey", evaluate.longest_sequence(F.upper("p_name")).alias("v"))


_SIM = "WITH q AS (SELECT embedding AS q FROM embeddings WHERE vec_id = 0), s AS (SELECT vec_id, label, list_dot_product(embedding::DOUBLE[], q::DOUBLE[]) / ((sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) + 1e-8) * (sqrt(list_dot_product(q::DOUBLE[], q::DOUBLE[])) + 1e-8)) AS sim FROM embeddings, q)"


def _scored(embeddings):
    q = embeddings.where("vec_id = 0").select(F.col("embedding").alias("q"))
    return embeddings.crossJoin(F.broadcast(q)).withColumn("similarity", similarity.cosine(F.col("embedding"), F.col("q"))).select("vec_id", "label", "similarity")


@query("win_01_top_k", "embeddings", f"{_SIM} SELECT label, vec_id, round(sim, 6) AS similarity FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY sim DESC, vec_id DESC) AS n FROM s) WHERE n <= 3")
def _(embeddings):
    return retrieve.top_k(_scored(embeddings), "label", "vec_id", 3).select("label", "vec_id", F.round("similarity", 6).alias("similarity"))


@query("win_02_dynamic_k", "embeddings", f"{_SIM} SELECT label, vec_id FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY sim DESC, vec_id DESC) AS n, greatest(count(*) FILTER (sim > 0.2) OVER (PARTITION BY label), 2) AS k FROM s) WHERE n <= k")
def _(embeddings):
    return retrieve.dynamic_k(_scored(embeddings), "label", "vec_id", 0.2, 2).select("label", "vec_id")


@query("sim_01_cosine", "embeddings", f"{_SIM} SELECT vec_id, round(sim, 6) AS similarity FROM s")
def _(embeddings):
    return _scored(embeddings).select("vec_id", F.round("similarity", 6).alias("similarity"))


@query("sim_02_ratio", "part")
def _(part):
    return part.select("p_partkey", F.round(similarity.ratio_udf("p_name", "p_type"), 6).alias("ratio"))


@query("sim_04_exact", "part", "SELECT p_partkey, lower(p_brand) = lower('brand#11') AS same FROM part")
def _(part):
    return part.select("p_partkey", (F.lower("p_brand") == "brand#11").alias("same"))


@query("sim_11_allowed_values", "part")
def _(part):
    """Parts' types with a letter doubled, lost or wrong, their sizes with a percent sign, and words, against allowed values of five kinds of columns."""
    n = F.col("p_partkey")
    names = F.array_sort(F.collect_set("p_name"))
    catalog = part.groupBy((F.col("p_partkey") % 3).alias("k")).agg(names.alias("names"))
    lists = catalog.select(F.concat(F.lit("name"), "k").alias("column"), F.col("names").alias("allowed"))
    fixed = part.sparkSession.createDataFrame([("number", [" Number "]), ("range", ["10-40"]), ("below", ["-10-20"]), ("odd", ["a-b"]), ("free", [])], "column string, allowed array<string>")
    column = F.element_at(F.array(*[F.lit(c) for c in ("name0", "name1", "name2", "number", "range", "below", "odd", "free", "unknown")]), (n % 9 + 1).cast("int"))
    size = F.concat(F.lit(" "), F.col("p_size").cast("string"), F.when(n % 4 == 0, "%").otherwise(""))
    typo = F.when(n % 5 == 0, F.upper("p_name")).when(n % 5 == 1, F.concat(F.substring("p_name", 2, 50), F.lit("s"))).when(n % 5 == 2, F.reverse("p_name")).when(n % 5 == 3, F.replace("p_name", F.lit(" "), F.lit("  "))).otherwise(F.col("p_type"))
    rows = part.select("p_partkey", column.alias("column"), F.when(n % 9 < 3, typo).when(n % 11 == 0, F.lit("none of it")).otherwise(size).alias("answer"))
    return alike.allowed_values(rows, lists.unionByName(fixed))


@query("sim_14_numeric", "part", "WITH x AS (SELECT p_partkey, CASE WHEN p_partkey % 5 > 0 THEN round(p_retailprice, 2) END AS p, p_retailprice + p_size % 20 AS t FROM part) SELECT p_partkey, abs(p - t) / abs(t) < 0.01 AS match, round(greatest(0, 1 - abs(p - t) / abs(t)), 6) AS similarity FROM x")
def _(part):
    said = F.when(F.col("p_partkey") % 5 > 0, F.concat(F.lit("about "), F.format_string("%.2f", "p_retailprice"), F.lit(" EUR, or 7"))).otherwise("no idea")
    got = evaluate.numeric_match(said, F.col("p_retailprice") + F.col("p_size") % 20)
    return part.select("p_partkey", got["match"].alias("match"), F.round(got["similarity"], 6).alias("similarity"))


@query("sim_16_value_similarity", "part", "SELECT p_partkey, CASE WHEN lower(trim(p_name)) = lower(trim(p_type)) THEN 1::DOUBLE WHEN contains(lower(p_name), lower(split_part(p_name, ' ', 1))) THEN 0.7::DOUBLE ELSE 0::DOUBLE END AS score FROM part")
def _(part):
    first = F.split_part("p_name", F.lit(" "), F.lit(1))
    other = F.when(F.lower("p_name") == F.lower("p_type"), F.col("p_name")).otherwise(first)
    score = evaluate.value_similarity(F.col("p_name"), other)
    return part.select("p_partkey", F.when(F.col("p_name") == first, F.lit(0.7)).otherwise(score).alias("score"))


@query("sim_17_tfidf", "part", "WITH w AS (SELECT p_partkey, unnest(regexp_extract_all(lower(p_name), '[a-z0-9]+')) AS term FROM part), t AS (SELECT p_partkey, term, count(*) AS tf FROM w GROUP BY ALL), n AS (SELECT count(DISTINCT p_partkey) AS n FROM w), d AS (SELECT term, count(*) AS df FROM t GROUP BY term), l AS (SELECT p_partkey, count(*) AS len FROM w GROUP BY 1) SELECT p_partkey, term, round(tf::DOUBLE / len * (ln(n::DOUBLE / df) + 1), 6) AS weight FROM t JOIN d USING (term) JOIN l USING (p_partkey), n WHERE df < n * 0.5")
def _(part):
    w = part.select("p_partkey", F.explode(F.regexp_extract_all(F.lower("p_name"), F.lit("[a-z0-9]+"), 0)).alias("term"))
    tf = w.groupBy("p_partkey", "term").agg(F.count(F.lit(1)).alias("tf"))
    df = tf.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    length = w.groupBy("p_partkey").agg(F.count(F.lit(1)).alias("len"))
    n = length.agg(F.count(F.lit(1)).alias("n"))
    rows = tf.join(df, "term").join(length, "p_partkey").crossJoin(n).where(F.col("df") < F.col("n") * 0.5)
    return rows.select("p_partkey", "term", F.round(F.col("tf") / F.col("len") * (F.log(F.col("n") / F.col("df")) + 1), 6).alias("weight"))


@query("jon_19_ground_plain", "benchmark documents", "SELECT item_id, doc_id, CASE WHEN contains(d.text, b.text) THEN 'exact' ELSE 'case_insensitive' END AS status FROM benchmark b, documents d WHERE contains(lower(d.text), lower(b.text))")
def _(benchmark, documents):
    return _grounded(benchmark, documents).select(F.col("inner").alias("item_id"), F.col("outer").alias("doc_id"), similarity.ground_plain(F.col("text_in"), F.col("text_out")).alias("status"))


def _grounded(benchmark, documents):
    return match.grounded(benchmark.select(F.col("item_id").alias("inner"), F.col("text").alias("text_in")), documents.select(F.col("doc_id").alias("outer"), F.col("text").alias("text_out")))


@query("sim_12_ground_fuzzy", "documents")
def _(documents):
    words = F.split("text", r"\s+")
    excerpt = F.array_join(F.slice(F.transform(words, lambda w, i: F.when(i == 6, F.lit("other")).otherwise(w)), 3, 12), " ")
    shown = documents.select("doc_id", "text", excerpt.alias("excerpt"))
    return shown.select("doc_id", similarity.ground_udf("excerpt", "text").alias("g")).select("doc_id", "g.*")


@query("agg_11_grounding_stats", "benchmark documents", "SELECT CASE WHEN contains(d.text, b.text) THEN 'exact' ELSE 'case_insensitive' END AS status, count(*) AS n FROM benchmark b, documents d WHERE contains(lower(d.text), lower(b.text)) GROUP BY 1")
def _(benchmark, documents):
    return _grounded(benchmark, documents).groupBy(similarity.ground_plain(F.col("text_in"), F.col("text_out")).alias("status")).agg(F.count(F.lit(1)).alias("n"))


@query("agg_12_gt_metrics", "labels", "SELECT count(*) AS n, round(avg((quality::VARCHAR = toxic::VARCHAR)::INT), 6) AS accuracy, round(avg((quality::VARCHAR = toxic::VARCHAR)::INT), 6) AS containment FROM labels")
def _(labels):
    return evaluate.gt_metrics(labels, F.col("quality").cast("string"), F.col("toxic").cast("string"))


@query("agg_12_accuracy_by_type", "documents labels", "SELECT lang, count(*) AS n, round(avg((quality = 1)::INT), 6) AS accuracy FROM documents JOIN labels USING (doc_id) GROUP BY lang")
def _(documents, labels):
    return documents.join(labels, "doc_id").groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg((F.col("quality") == 1).cast("double")), 6).alias("accuracy"))


@query("agg_13_rates", "labels documents", "SELECT round(count(quality) / count(*), 6) AS answer_rate, round(count(*) FILTER (quality = 1) / count(*), 6) AS high_rate FROM documents LEFT JOIN labels USING (doc_id)")
def _(labels, documents):
    return documents.join(labels, "doc_id", "left").agg(F.round(F.count("quality") / F.count(F.lit(1)), 6).alias("answer_rate"), F.round(F.count_if(F.col("quality") == 1) / F.count(F.lit(1)), 6).alias("high_rate"))


@query("agg_14_column_usage", "lineitem", "SELECT l_shipmode AS name, r AS rate, CASE WHEN r > 0.7 THEN 'high' WHEN r < 0.1 THEN 'low' ELSE 'middle' END AS class FROM (SELECT l_linestatus AS l_shipmode, round(count(*) / (SELECT count(*) FROM lineitem), 6) AS r FROM lineitem GROUP BY l_linestatus)")
def _(lineitem):
    return evaluate.column_usage(lineitem.select(F.array("l_linestatus").alias("used")), "used")


@query("agg_15_schema_recall", "lineitem", "SELECT count(*) AS tables, round(avg(best), 6) AS mean_recall FROM (SELECT l_orderkey, max(l_discount) AS best FROM lineitem GROUP BY l_orderkey)")
def _(lineitem):
    return evaluate.recall_by_table(lineitem.select(F.col("l_orderkey").alias("tabid"), F.col("l_discount").alias("recall")))


@query("agg_16_correlation", "lineitem", "SELECT round(corr(l_quantity, l_extendedprice), 6) AS corr, round(avg(l_quantity), 6) AS mean, median(l_quantity) AS median FROM lineitem")
def _(lineitem):
    return lineitem.agg(F.round(F.corr("l_quantity", "l_extendedprice"), 6).alias("corr"), F.round(F.avg("l_quantity"), 6).alias("mean"), F.median("l_quantity").alias("median"))


@query("agg_17_prf", "labels", "WITH c AS (SELECT count(*) FILTER (quality = 1 AND toxic = 1)::DOUBLE AS tp, count(*) FILTER (quality = 1 AND toxic = 0)::DOUBLE AS fp, count(*) FILTER (quality = 0 AND toxic = 1)::DOUBLE AS fn FROM labels) SELECT round(tp / (tp + fp), 6) AS precision, round(tp / (tp + fn), 6) AS recall, round(2 * tp / (2 * tp + fp + fn), 6) AS f1 FROM c")
def _(labels):
    q, t = F.col("quality") == 1, F.col("toxic") == 1
    one = labels.agg(F.count_if(q & t).alias("tp"), F.count_if(q & ~t).alias("fp"), F.count_if(~q & t).alias("fn"))
    return one.select(*evaluate.prf(F.col("tp"), F.col("fp"), F.col("fn"))).select(*[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")])


@query("agg_18_token_stats", "documents", "SELECT count(*) AS n_documents, sum(length(text) // 4)::BIGINT AS total_tokens, (sum(length(text) // 4) // count(*))::BIGINT AS avg_tokens, max(length(text) // 4) AS max_tokens FROM documents")
def _(documents):
    return cost.token_stats(documents)


@query("agg_19_calls_by_stage", "events", "SELECT event_type AS stage, count(*) AS calls, sum((length(props) + length(event_type)) // 4)::BIGINT AS tokens FROM events GROUP BY event_type")
def _(events):
    return cost.calls_by_stage(events.select(F.col("event_type").alias("stage"), F.length("props").alias("prompt_length"), F.length("event_type").alias("completion_length")))


@query("agg_20_quota", "events", "SELECT user_id, count(*) AS calls, count(*) >= 5 AS blocked FROM events GROUP BY user_id")
def _(events):
    return events.groupBy("user_id").agg(F.count(F.lit(1)).alias("calls"), (F.count(F.lit(1)) >= 5).alias("blocked"))


@query("agg_21_cost_discovery", "documents", "SELECT c AS calls, c * 3750 AS tokens_in, c * 300 AS tokens_out, round(c * 3750 / 1e6 * 0.15 + c * 300 / 1e6 * 0.6, 6) AS cost FROM (SELECT (ceil(count(*) / 4) + 1)::BIGINT AS c FROM documents)")
def _(documents):
    return cost.discovery(documents, 4, 15, 0.15, 0.6)


@query("agg_22_cost_extraction", "documents", "SELECT n + u AS calls, i AS tokens_in, u * 224 AS tokens_out, round(i / 1e6 * 0.15 + u * 224 / 1e6 * 0.6, 6) AS cost FROM (SELECT count(*) AS n, floor(count(*) * 1.5)::BIGINT AS u, floor(sum(length(text) // 4) * 2.5)::BIGINT AS i FROM documents)")
def _(documents):
    return cost.extraction(documents, 8, 0.15, 0.6)


@query("win_08_stratified", "documents", "SELECT doc_id, lang FROM (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY md5(doc_id::VARCHAR), doc_id) AS n FROM documents) WHERE n <= 5")
def _(documents):
    return evaluate.stratified(documents, "lang", [F.md5(F.col("doc_id").cast("string")), F.col("doc_id")], 5).select("doc_id", "lang")


@query("win_09_frequent_classes", "documents", "SELECT source, n FROM (SELECT source, count(*) AS n FROM documents GROUP BY source) ORDER BY n DESC, source LIMIT 6")
def _(documents):
    return documents.groupBy("source").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "source").limit(6)


@query("sup_06_key_histogram", "events", "SELECT len(json_keys(props))::INT AS n_keys, count(*) AS n FROM events GROUP BY 1")
def _(events):
    return events.groupBy(F.size(F.json_object_keys("props")).alias("n_keys")).agg(F.count(F.lit(1)).alias("n"))


@query("sup_10_prompt_text", "supplier", "SELECT s_suppkey, 's_name: ' || s_name || '; s_nationkey: ' || s_nationkey AS prompt FROM supplier")
def _(supplier):
    pairs = [F.concat(F.lit(f"{c}: "), F.col(c).cast("string")) for c in ("s_name", "s_nationkey")]
    return supplier.select("s_suppkey", F.concat_ws("; ", *pairs).alias("prompt"))


# what Spark adds


@query("ext_cube", "lineitem", "SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 4) AS quantity FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
def _(lineitem):
    return lineitem.cube("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("l_quantity"), 4).alias("quantity"))


@query("ext_rollup", "lineitem", "SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)")
def _(lineitem):
    return lineitem.rollup("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("n"))


@query("ext_range_join", "orders lineitem", "SELECT o_orderkey, count(*) AS n FROM orders JOIN lineitem ON o_orderkey = l_orderkey AND l_shipdate BETWEEN o_orderdate AND o_orderdate + INTERVAL 30 DAY GROUP BY o_orderkey")
def _(orders, lineitem):
    near = orders.join(lineitem, F.expr("o_orderkey = l_orderkey AND l_shipdate BETWEEN o_orderdate AND o_orderdate + INTERVAL 30 DAYS"))
    return near.groupBy("o_orderkey").agg(F.count(F.lit(1)).alias("n"))


@query("ext_window_frames", "lineitem", "SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, round(sum(l_quantity) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey ROWS BETWEEN 1 PRECEDING AND CURRENT ROW), 4) AS moving FROM lineitem")
def _(lineitem):
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey").rowsBetween(-1, 0)
    return lineitem.select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", F.round(F.sum("l_quantity").over(w), 4).alias("moving"))


@query("ext_intersect", "part", "SELECT p_brand FROM part WHERE p_size < 10 INTERSECT SELECT p_brand FROM part WHERE p_size > 40")
def _(part):
    return part.where("p_size < 10").select("p_brand").intersect(part.where("p_size > 40").select("p_brand"))


@query("ext_except_all", "lineitem", "SELECT l_returnflag, count(*) AS n FROM (SELECT l_returnflag FROM lineitem EXCEPT ALL SELECT l_returnflag FROM lineitem WHERE l_quantity > 25) GROUP BY 1")
def _(lineitem):
    left = lineitem.select("l_returnflag").exceptAll(lineitem.where("l_quantity > 25").select("l_returnflag"))
    return left.groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n"))


@query("ext_tumbling", "events", "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def _(events):
    w = events.groupBy(F.window("ts", "1 hour"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return w.select(F.col("window.start").alias("start"), "event_type", "n", "total")


@query("ext_sessions", "events", "WITH g AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM events), s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT user_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, k")
def _(events):
    s = events.groupBy("user_id", F.session_window("ts", "6 hours")).agg(F.count(F.lit(1)).alias("n"))
    return s.select("user_id", F.col("session_window.start").alias("start"), "n")


@query("ext_revenue_by_nation", "lineitem orders customer nation region", "SELECT n_name, r_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ALL")
def _(lineitem, orders, customer, nation, region):
    rows = lineitem.join(orders, F.expr("l_orderkey = o_orderkey")).join(customer, F.expr("o_custkey = c_custkey")).join(nation, F.expr("c_nationkey = n_nationkey")).join(region, F.expr("n_regionkey = r_regionkey"))
    return rows.groupBy("n_name", "r_name").agg(F.round(F.sum(F.expr("l_extendedprice * (1 - l_discount)")), 2).alias("revenue"))
