"""Queries of merges, catalogs, units and set operations."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import cells
from tessera.functions.similarity import contains_score, jaccard, tokens
from tessera.operators import catalog, merge, units
from tessera.operators.match import match_rows
from tessera.operators.table import longest_runs
from tessera.plans.registry import query


def _patch(customer: DataFrame) -> DataFrame:
    """Newer balances of every third customer, and of some that the base lacks."""
    return customer.where("c_custkey % 3 = 0").select("c_name", (F.col("c_acctbal") + 1000).alias("c_acctbal"), F.col("c_custkey").alias("seq"))


_BASE = "(SELECT * FROM customer WHERE c_custkey % 6 <> 0)"
_PATCH = "(SELECT c_name, c_acctbal + 1000 AS c_acctbal FROM customer WHERE c_custkey % 3 = 0)"


@query("jon_01_upsert", "customer", f"SELECT c_custkey, b.c_name, round(coalesce(p.c_acctbal, b.c_acctbal), 6) AS c_acctbal FROM {_BASE} b LEFT JOIN {_PATCH} p ON b.c_name = p.c_name")
def _(customer):
    out = merge.upsert(customer.where("c_custkey % 6 <> 0"), _patch(customer), "c_name", ["c_acctbal"], "seq")
    return out.select("c_custkey", "c_name", F.round("c_acctbal", 6).alias("c_acctbal"))


@query("jon_01_upsert_by_paper", "documents", "SELECT doc_id, CASE WHEN doc_id % 4 = 1 AND doc_id % 3 <> 2 THEN 'paper ' || doc_id WHEN doc_id % 3 = 2 AND doc_id % 4 = 0 THEN 'exact ' || doc_id ELSE lang END AS lang FROM documents")
def _(documents):
    """Rows of one name, of none and of their own, each with two papers of its own; patches by stem and by name."""
    n, text = F.col("doc_id"), F.col("doc_id").cast("string")
    name = F.when(n % 3 == 0, "row").when(n % 3 == 2, F.concat(F.lit("Own"), text))
    papers = F.array(F.concat(F.lit("none_"), text), F.when(n % 2 == 0, F.concat(F.lit("p."), text, F.lit(".txt"))).otherwise(F.concat(F.lit("Doc"), text, F.lit("_v1.txt"))))
    base = documents.select("doc_id", name.alias("name"), "lang", papers.alias("papers"))
    by_paper = documents.where("doc_id % 4 = 1 AND doc_id % 3 <> 2").select(F.concat(F.lit("doc"), text).alias("name"), F.concat(F.lit("paper "), text).alias("lang"), n.alias("seq"))
    by_name = documents.where("doc_id % 3 = 2 AND doc_id % 4 = 0").select(F.concat(F.lit("Own"), text).alias("name"), F.concat(F.lit("exact "), text).alias("lang"), n.alias("seq"))
    return merge.upsert(base, by_paper.unionByName(by_name), "name", ["lang"], "seq", papers="papers").select("doc_id", "lang")


@query("jon_02_append_new", "customer", "SELECT c_name, c_custkey FROM customer WHERE c_custkey % 6 <> 0 UNION ALL SELECT c_name, NULL FROM customer WHERE c_custkey % 6 = 0")
def _(customer):
    return merge.append_new(customer.where("c_custkey % 6 <> 0").select("c_name", "c_custkey"), _patch(customer).select("c_name"), "c_name")


@query("jon_03_add_columns", "documents labels", "SELECT d.doc_id, lang, quality, toxic FROM documents d LEFT JOIN labels USING (doc_id)")
def _(documents, labels):
    return merge.add_columns(documents.select("doc_id", "lang"), labels.withColumn("seq", F.col("doc_id")), "doc_id", ["quality", "toxic"], "seq")


@query("jon_04_incremental", "orders customer", "SELECT c_custkey, n_orders FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n_orders FROM orders GROUP BY o_custkey) ON c_custkey = o_custkey")
def _(orders, customer):
    new = orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count(F.lit(1)).alias("n_orders"))
    return merge.add_columns(customer.select("c_custkey"), new, "c_custkey", ["n_orders"], "n_orders")


@query("jon_05_by_position", "nation region", "SELECT n_nationkey, coalesce(r_name, n_name) AS n_name FROM nation LEFT JOIN region ON n_nationkey = r_regionkey")
def _(nation, region):
    new = region.select(F.col("r_regionkey").alias("n_nationkey"), F.col("r_name").alias("n_name"))
    return merge.update_by_position(nation.select("n_nationkey", "n_name"), new, "n_nationkey", "n_name")


@query("jon_06_cross_file_dedup", "orders", "SELECT o_orderkey FROM (SELECT o_orderkey, o_custkey, o_orderkey % 4 AS f, min(o_orderkey % 4) OVER (PARTITION BY o_custkey) AS first FROM orders) WHERE f = first")
def _(orders):
    return merge.cross_file_dedup(orders.select("o_orderkey", "o_custkey", (F.col("o_orderkey") % 4).alias("f")), "o_custkey", "f").select("o_orderkey")


@query("jon_07_containment_match", "part", "WITH t AS (SELECT DISTINCT split_part(p_name, ' ', 1) AS key FROM part), p AS (SELECT DISTINCT p_name AS match FROM part), x AS (SELECT key, match, least(length(key), length(match))::DOUBLE / greatest(length(key), length(match)) AS score FROM t, p WHERE contains(key, match) OR contains(match, key)) SELECT key, round(max(score), 6) AS score FROM x WHERE score > 0.3 GROUP BY key")
def _(part):
    truth = part.select(F.split_part("p_name", F.lit(" "), F.lit(1)).alias("n")).distinct()
    return match_rows(truth, part.select(F.col("p_name").alias("n")).distinct(), "n").select("key", F.round("score", 6).alias("score"))


@query("jon_10_value_alignment", "documents labels", "SELECT count(*) AS n, round(avg(CASE WHEN l.quality IS NULL THEN 0.0 WHEN l.quality = 1 THEN 1.0 ELSE 0.5 END), 6) AS mean_score FROM documents d LEFT JOIN labels l USING (doc_id)")
def _(documents, labels):
    score = F.when(F.col("quality").isNull(), 0.0).when(F.col("quality") == 1, 1.0).otherwise(0.5)
    return documents.select("doc_id").join(labels, "doc_id", "left").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(score), 6).alias("mean_score"))


@query("jon_11_compatibility", "nation region", "WITH a AS (SELECT lower(replace(replace(n_name, ' ', ''), '_', '')) AS name FROM nation WHERE n_nationkey < 15), b AS (SELECT lower(replace(replace(n_name, ' ', ''), '_', '')) AS name FROM nation WHERE n_nationkey >= 10) SELECT coalesce(a.name, b.name) AS name, CASE WHEN a.name IS NULL THEN 'extra' WHEN b.name IS NULL THEN 'missing' ELSE 'matching' END AS status FROM a FULL JOIN b ON a.name = b.name")
def _(nation, region):
    names = nation.select("n_nationkey", F.col("n_name").alias("name"))
    return catalog.compatibility(names.where("n_nationkey < 15"), names.where("n_nationkey >= 10"))


@query("jon_12_similar_units", "part")
def _(part):
    names = part.select(F.col("p_name").alias("name")).distinct()
    return units.similar_units(names, 0.7)


@query("jon_13_availability", "documents benchmark", "SELECT source AS paper, CASE WHEN source IN ('src0', 'src1', 'src2') THEN 'local' WHEN source IN ('src3', 'src4') THEN 'cloud' ELSE 'missing' END AS status, count(DISTINCT doc_id) AS n_rows FROM documents GROUP BY source")
def _(documents, benchmark):
    refs = documents.select(F.col("doc_id").alias("row_name"), F.col("source").alias("paper"))
    papers = documents.select(F.col("source").alias("paper"))
    return merge.availability(refs, papers.where(F.col("paper").isin("src0", "src1", "src2")), papers.where(F.col("paper").isin("src2", "src3", "src4")))


@query("jon_14_papers_to_rows", "orders", "SELECT o_custkey AS paper, list(o_orderkey ORDER BY o_orderkey) AS rows FROM orders GROUP BY o_custkey")
def _(orders):
    rows = orders.select("o_orderkey", F.array("o_custkey").alias("papers"))
    return merge.papers_of_rows(rows, "o_orderkey", "papers")


@query("jon_15_new_columns", "part", "SELECT DISTINCT lower(p_type) AS name FROM part WHERE lower(p_type) NOT IN (SELECT lower(p_type) FROM part WHERE p_size > 20 AND p_size % 7 = 0 AND starts_with(p_type, 'S'))")
def _(part):
    low = part.select(F.lower("p_type").alias("name"), "p_size")
    return low.select("name").distinct().join(low.where("p_size > 20 AND p_size % 7 = 0 AND name LIKE 's%'").select("name"), "name", "left_anti")


@query("jon_16_changes", "nation", "SELECT name, change FROM (SELECT CASE n_regionkey WHEN 1 THEN n_name || '2' ELSE n_name END AS name, CASE n_regionkey WHEN 0 THEN 'new' WHEN 1 THEN 'renamed' WHEN 2 THEN 'definition' WHEN 3 THEN 'allowed_values' END AS change FROM nation) WHERE change IS NOT NULL")
def _(nation):
    base = nation.select(F.col("n_nationkey").alias("column_id"), "n_regionkey", F.col("n_name").alias("name"), F.lit("d").alias("definition"), F.lit("r").alias("rationale"), F.array(F.lit("a"), F.lit("b")).alias("allowed_values"))
    r = F.col("n_regionkey")
    new = base.withColumn("name", F.when(r == 1, F.concat("name", F.lit("2"))).otherwise(F.col("name"))).withColumn("definition", F.when(r == 2, "other").otherwise("d")).withColumn("allowed_values", F.when(r == 3, F.array(F.lit("c"))).when(r == 4, F.array(F.lit("b"), F.lit("a"))).otherwise(F.col("allowed_values")))
    return catalog.changes(base.where("n_regionkey <> 0"), new)


@query("jon_17_model_price", "supplier", "SELECT s_name AS model, CASE WHEN s_suppkey % 2 = 0 THEN s_acctbal ELSE 1.0 END AS price_in, CASE WHEN s_suppkey % 2 = 0 THEN 2::DOUBLE ELSE 3::DOUBLE END AS price_out FROM supplier")
def _(supplier):
    from tessera.operators.cost import price_of

    prices = supplier.where("s_suppkey % 2 = 0").select(F.col("s_name").alias("model"), F.col("s_acctbal").alias("price_in"), F.lit(2.0).alias("price_out"))
    return price_of(supplier.select(F.col("s_name").alias("model")), prices, (1.0, 3.0))


@query("jon_20_union_layouts", "supplier customer", "SELECT s_name AS name, s_suppkey, NULL AS c_custkey FROM supplier UNION ALL SELECT c_name, NULL, c_custkey FROM customer")
def _(supplier, customer):
    return supplier.select(F.col("s_name").alias("name"), "s_suppkey").unionByName(customer.select(F.col("c_name").alias("name"), "c_custkey"), allowMissingColumns=True)


@query("agg_07_unit_summary", "documents", "SELECT lang AS unit, count(*) AS n_rows, list(DISTINCT source ORDER BY source) AS documents FROM documents WHERE lang IS NOT NULL GROUP BY lang")
def _(documents):
    return units.unit_summary(documents, "lang", "source")


@query("agg_08_source_counts", "documents", "SELECT source AS source_document, count(*) AS n_rows FROM documents WHERE source IS NOT NULL GROUP BY source")
def _(documents):
    return units.source_counts(documents, "source")


def _suggested(events: DataFrame) -> DataFrame:
    return events.select(F.col("event_type").alias("column"), F.get_json_object("props", "$.k").alias("value"), F.col("user_id").alias("document"))


@query("agg_09_suggested_values", "events", "SELECT event_type AS \"column\", json_extract_string(props, '$.k') AS value, count(DISTINCT user_id) AS documents FROM events GROUP BY ALL HAVING count(DISTINCT user_id) >= 3")
def _(events):
    return _suggested(events).groupBy("column", "value").agg(F.count_distinct("document").alias("documents")).where("documents >= 3")


@query("agg_10_add_or_wait", "events", "SELECT c AS \"column\", v AS value, n AS documents, CASE WHEN n >= 20 THEN 'add' ELSE 'pending' END AS action FROM (SELECT event_type AS c, json_extract_string(props, '$.k') AS v, count(DISTINCT user_id) AS n FROM events GROUP BY ALL) WHERE NOT (c = 'click' AND v = '1')")
def _(events):
    known = events.sparkSession.createDataFrame([("click", "1")], "column string, value string")
    return catalog.suggestions(_suggested(events), known, 20)


@query("agg_27_fold_rows", "conversations", "WITH RECURSIVE s AS (SELECT conv_id, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn, text) AS n FROM conversations), f AS (SELECT conv_id, n, text AS a FROM s WHERE n = 1 UNION ALL SELECT f.conv_id, s.n, CASE WHEN a IS NULL OR a = '' THEN text WHEN text IS NULL OR text = '' OR text = a THEN a WHEN length(text) > length(a) THEN text ELSE a || '; ' || text END FROM f JOIN s ON f.conv_id = s.conv_id AND s.n = f.n + 1) SELECT conv_id, a AS text FROM f WHERE n = (SELECT max(n) FROM s WHERE s.conv_id = f.conv_id)")
def _(conversations):
    return merge.fold_rows(conversations, "conv_id", "turn", "text")


@query("agg_28_row_completion", "lineitem", "SELECT l_orderkey, count(*) FILTER (l_linenumber > 3) = 0 AS complete FROM lineitem GROUP BY l_orderkey")
def _(lineitem):
    number = F.col("l_linenumber").cast("string")
    expected = lineitem.groupBy("l_orderkey").agg(F.collect_set(number).alias("papers"))
    done = lineitem.where("l_linenumber <= 3").groupBy("l_orderkey").agg(F.collect_set(number).alias("papers"))
    return merge.complete_rows(expected, done, "l_orderkey", "papers")


for _name, _strategy, _sql in (
    ("concat", "concatenate", "concat_ws(' ', nullif(trim(p_brand), ''), nullif(trim(p_type), ''), nullif(trim(p_brand), ''))"),
    ("unique", "combine_unique", "CASE WHEN p_brand = p_type THEN p_brand ELSE concat_ws(' ', p_brand, p_type) END"),
    ("first", "take_first", "coalesce(p_brand, p_type, '')"),
    ("longest", "take_longest", "CASE WHEN length(p_type) > length(p_brand) THEN p_type ELSE p_brand END"),
):

    @query(f"agg_33_merge_columns_{_name}", "part", f"SELECT p_partkey, {_sql} AS merged FROM part")
    def _(part, strategy=_strategy):
        cols = [F.col("p_brand"), F.col("p_type"), F.col("p_brand")]
        return part.select("p_partkey", merge.merge_columns(cols, strategy).alias("merged"))


@query("agg_34_known_units", "orders", "SELECT o_orderpriority AS paper, list(DISTINCT o_orderstatus ORDER BY o_orderstatus) AS rows FROM orders GROUP BY ALL")
def _(orders):
    return merge.papers_of_rows(orders.select("o_orderstatus", F.array("o_orderpriority").alias("papers")), "o_orderstatus", "papers")


@query("agg_30_modifications", "events", "SELECT event_type AS action, count(*) AS n FROM events GROUP BY event_type")
def _(events):
    return events.groupBy(F.col("event_type").alias("action")).agg(F.count(F.lit(1)).alias("n"))


@query("win_03_best_units", "lineitem", "SELECT l_orderkey, l_linenumber FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 2 ELSE 3 END, l_linenumber) AS n FROM lineitem) WHERE n <= 2")
def _(lineitem):
    named = lineitem.withColumn("confidence", F.when(F.col("l_returnflag") == "A", "high").when(F.col("l_returnflag") == "N", "medium").otherwise("low"))
    return units.best_units(named, "l_orderkey", "confidence", "l_linenumber", 2).select("l_orderkey", "l_linenumber")


@query("flt_23_confident", "lineitem", "SELECT l_returnflag, count(*) AS n FROM lineitem WHERE l_returnflag <> 'R' GROUP BY l_returnflag")
def _(lineitem):
    named = lineitem.withColumn("confidence", F.when(F.col("l_returnflag") == "R", "LOW").otherwise("high"))
    return units.keep_confident(named).groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n"))


@query("flt_24_suspicious_names", "customer", "SELECT c_custkey FROM customer WHERE c_mktsegment NOT IN ('AUTOMOBILE', 'BUILDING')")
def _(customer):
    named = customer.withColumn("name", F.when(F.col("c_mktsegment") == "AUTOMOBILE", " Answer ").when(F.col("c_mktsegment") == "BUILDING", "observation_units").when(F.col("c_mktsegment") == "MACHINERY", "test").otherwise(F.col("c_mktsegment")))
    return named.where(~units.suspicious(F.col("name"))).select("c_custkey")


@query("sim_06_merge_reason", "nation", "SELECT a.n_name AS a, b.n_name AS b, CASE WHEN lower(a.n_name) = lower(b.n_name) THEN 'same name' WHEN contains(lower(a.n_name), lower(b.n_name)) OR contains(lower(b.n_name), lower(a.n_name)) THEN 'one name within the other' ELSE 'similar names' END AS reason FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey")
def _(nation):
    a, b = nation.alias("a"), nation.alias("b")
    pairs = a.join(b, F.expr("a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey"))
    return pairs.select(F.col("a.n_name").alias("a"), F.col("b.n_name").alias("b"), units.merge_reason(F.col("a.n_name"), F.col("b.n_name")).alias("reason"))


@query("sim_07_components", "customer orders", "WITH m AS (SELECT o_custkey, min(o_orderkey) AS root FROM orders GROUP BY o_custkey) SELECT o_orderkey AS node, root FROM orders JOIN m USING (o_custkey) UNION ALL SELECT o_custkey + 1000000000000, root FROM m")
def _(customer, orders):
    return units.components(orders.select(F.col("o_orderkey").alias("a"), (F.col("o_custkey") + 1000000000000).alias("b")))


@query("sim_07_best_name", "part", "WITH n AS (SELECT lower(p_brand) AS unit, list(DISTINCT CASE WHEN p_partkey % 2 = 0 THEN upper(p_brand) ELSE p_brand END) AS names FROM part GROUP BY 1) SELECT unit, CASE WHEN len(list_filter(names, lambda x: x <> upper(x))) > 0 THEN list_filter(names, lambda x: x <> upper(x))[1] ELSE names[1] END AS name FROM n")
def _(part):
    name = F.when(F.col("p_partkey") % 2 == 0, F.upper("p_brand")).otherwise(F.col("p_brand"))
    return part.groupBy(F.lower("p_brand").alias("unit")).agg(F.collect_set(name).alias("names")).select("unit", units.best_name(F.col("names")).alias("name"))


@query("sim_08_merge_units", "documents", "SELECT doc_id, CASE WHEN lang IN ('es', 'fr') THEN 'romance' ELSE lang END AS lang, CASE WHEN lang IN ('es', 'fr') THEN [lang] END AS original_units FROM documents")
def _(documents):
    return units.merge_units(documents.select("doc_id", "lang"), "lang", ["ES", "FR"], "romance")


@query("sim_09_dedup_units", "embeddings")
def _(embeddings):
    """Forty vectors are a document's units, named by label and number; every fourth leans on the one before."""
    n = F.col("vec_id")
    before = embeddings.select((n + 1).alias("vec_id"), F.col("embedding").alias("last"))
    lean = F.when((n % 4 == 1) & F.col("last").isNotNull(), F.zip_with("embedding", "last", lambda x, y: x * F.lit(0.3).cast("float") + y)).otherwise(F.col("embedding"))
    own = embeddings.join(before, "vec_id", "left").select(
        F.floor(n / 40).alias("document"), n.alias("seq"), F.concat(F.lit("Unit "), "label", F.when(n % 7 == 0, "").otherwise(F.concat(F.lit(" no "), n.cast("string")))).alias("name"), lean.alias("vector"),
        F.element_at(F.array(*[F.lit(c) for c in (*units.CONFIDENCE, "odd")]), (n % 5 + 1).cast("int")).alias("confidence"), F.array(F.concat(F.lit("passage "), (n % 3).cast("string"))).alias("passages"),
    )
    return units.dedup_units(own)


@query("sim_03_token_jaccard", "part", "WITH t AS (SELECT p_partkey, list_distinct(regexp_extract_all(lower(p_name), '[a-z0-9]+')) AS a, list_distinct(regexp_extract_all(lower(p_type), '[a-z0-9]+')) AS b FROM part) SELECT p_partkey, round(len(list_intersect(a, b))::DOUBLE / greatest(len(list_distinct(list_concat(a, b))), 1), 6) AS score FROM t")
def _(part):
    return part.select("p_partkey", F.round(jaccard(tokens(F.col("p_name")), tokens(F.col("p_type"))), 6).alias("score"))


@query("sim_15_contains", "part", "SELECT p_partkey, round(CASE WHEN contains(p_name, p_brand) OR contains(p_brand, p_name) THEN least(length(p_name), length(p_brand))::DOUBLE / greatest(length(p_name), length(p_brand)) END, 6) AS score FROM part")
def _(part):
    return part.select("p_partkey", F.round(contains_score(F.col("p_name"), F.col("p_brand")), 6).alias("score"))


@query("set_01_schema_jaccard", "part", "SELECT round(len(list_intersect(a, b))::DOUBLE / greatest(len(list_distinct(list_concat(a, b))), 1), 6) AS jaccard FROM (SELECT list(DISTINCT lower(p_type)) FILTER (p_size < 30) AS a, list(DISTINCT lower(p_type)) FILTER (p_size > 20) AS b FROM part)")
def _(part):
    low = part.select(F.lower("p_type").alias("name"), "p_size")
    return catalog.schema_jaccard(low.where("p_size < 30"), low.where("p_size > 20"), "name")


@query("set_04_except", "part", "SELECT DISTINCT p_type || p_brand AS name FROM part WHERE p_size > 25 EXCEPT SELECT p_type || p_brand FROM part WHERE p_size < 20")
def _(part):
    named = part.select(F.concat("p_type", "p_brand").alias("name"), "p_size")
    return named.where("p_size > 25").select("name").distinct().join(named.where("p_size < 20").select("name"), "name", "left_anti")


@query("set_05_union_locations", "supplier customer", "SELECT s_name AS name, 0 AS file_ord FROM supplier UNION ALL SELECT c_name, 1 FROM customer")
def _(supplier, customer):
    return supplier.select(F.col("s_name").alias("name"), F.lit(0).alias("file_ord")).unionByName(customer.select(F.col("c_name").alias("name"), F.lit(1).alias("file_ord")))


@query("win_05_cumulative", "documents", "SELECT source, n, sum(n) OVER (ORDER BY source)::BIGINT AS cumulative FROM (SELECT source, count(*) AS n FROM documents GROUP BY source)")
def _(documents):
    n = documents.groupBy("source").agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("cumulative", F.sum("n").over(Window.orderBy("source").rowsBetween(Window.unboundedPreceding, 0)))


@query("win_06_unchanged_runs", "lineitem", "WITH c AS (SELECT l_orderkey, sum(x) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey ROWS UNBOUNDED PRECEDING) AS run, l_linenumber FROM (SELECT *, CASE WHEN lag(l_returnflag) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) = l_returnflag THEN 0 ELSE 1 END AS x FROM lineitem)) SELECT l_orderkey, max(n) AS longest FROM (SELECT l_orderkey, run, count(*) AS n FROM c GROUP BY ALL) GROUP BY l_orderkey")
def _(lineitem):
    return longest_runs(lineitem, ["l_linenumber", "l_partkey", "l_suppkey"], "l_returnflag", "l_orderkey")


@query("win_07_keep_first", "documents", "SELECT min(doc_id) AS doc_id FROM documents GROUP BY text")
def _(documents):
    return documents.groupBy(F.xxhash64("text"), F.md5("text")).agg(F.min("doc_id").alias("doc_id")).select("doc_id")


@query("win_11_first_source", "documents", "SELECT lang AS name, min_by(source, doc_id) AS source FROM documents GROUP BY lang")
def _(documents):
    return documents.groupBy(F.col("lang").alias("name")).agg(F.min_by("source", "doc_id").alias("source"))


@query("fn_15_map_filter", "orders", "SELECT o_orderkey, o_orderstatus AS status FROM orders")
def _(orders):
    data = F.create_map(F.lit("_row"), F.col("o_orderpriority"), F.lit("status"), F.col("o_orderstatus"))
    kept = F.map_filter(data, lambda k, v: ~k.startswith("_"))
    return orders.select("o_orderkey", F.element_at(kept, "status").alias("status"))


@query("fn_03_digest", "documents", "SELECT doc_id, left(md5(text), 16) AS key FROM documents")
def _(documents):
    return documents.select("doc_id", F.left(F.md5("text"), F.lit(16)).alias("key"))


@query("fn_08_ranges", "part", "SELECT p_partkey, (-10)::DOUBLE AS low, p_size::DOUBLE AS high FROM part")
def _(part):
    text = F.concat(F.lit("-10-"), F.col("p_size").cast("string"))
    part_ = lambda i: F.regexp_extract(text, r"^(-?\d+(?:\.\d+)?)-(-?\d+(?:\.\d+)?)$", i).try_cast("double")
    return part.select("p_partkey", part_(1).alias("low"), part_(2).alias("high"))


@query("prj_16_normal_names", "part", "SELECT DISTINCT p_type, lower(replace(replace(replace(p_type, '_', ''), ' ', ''), '-', '')) AS name FROM part")
def _(part):
    return part.select("p_type", cells.normal_name(F.col("p_type")).alias("name")).distinct()
