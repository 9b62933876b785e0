"""Queries on the quality of extracted tables."""

from pyspark.sql import functions as F

from tessera.operators import order, quality
from tessera.plans.registry import query

_D = "CASE WHEN r > 0.9 THEN CASE WHEN contains(lower(name), 'id') OR contains(lower(name), 'name') THEN 'Unique identifier or name for ' || t ELSE 'Specific ' || t || ' values, mostly unique across records' END WHEN r < 0.1 THEN 'Categorical ' || t || ' data with limited distinct values' ELSE 'Data about ' || t END"


@query("prj_16_described", "supplier orders", f"""WITH v AS (SELECT 's_suppkey' AS name, 'S Suppkey' AS t, s_suppkey::VARCHAR AS v, 'number' AS kind FROM supplier UNION ALL SELECT 's_name', 'S Name', s_name, 'text' FROM supplier UNION ALL SELECT 'o_orderstatus', 'O Orderstatus', o_orderstatus, 'text' FROM orders UNION ALL SELECT 'status_id', 'Status ID', o_orderstatus, 'cells' FROM orders UNION ALL SELECT 'day-url', 'Day URL', strftime(o_orderdate, '%Y-%m-%d') || repeat('/x', 30), 'url' FROM orders UNION ALL SELECT 'notes', 'Notes', o_orderkey || repeat(' long', 20), 'text' FROM orders),
s AS (SELECT name, t, kind, count(DISTINCT v) / count(*) AS r, max(length(v)) > 100 AS long, min(v) AS sample FROM v GROUP BY ALL)
SELECT name, {_D} || CASE WHEN kind = 'cells' THEN ' (extracted from documents with supporting evidence)' WHEN kind = 'url' THEN ' (URL/link format)' WHEN kind = 'number' THEN ' (numeric values)' WHEN long THEN ' (detailed text content)' ELSE '' END AS definition,
  concat_ws('. ', CASE WHEN r > 0.9 THEN 'High uniqueness suggests this field contains specific identifying information' WHEN r < 0.1 THEN 'Low uniqueness indicates categorical classification useful for grouping and analysis' ELSE 'Moderate uniqueness suggests semi-structured data suitable for detailed analysis' END,
    CASE WHEN kind = 'cells' THEN 'Contains extracted answers with supporting document excerpts for verification' WHEN contains(lower(name), 'id') THEN 'Serves as a key identifier for linking and referencing records' WHEN contains(lower(name), 'name') THEN 'Provides human-readable labels for identification and display' WHEN kind = 'number' THEN 'Numeric values enable quantitative analysis and comparisons' WHEN long THEN 'Long text content provides detailed information for comprehensive analysis' END,
    CASE WHEN length(sample) > 50 THEN 'Contains detailed content that may require summarization or excerpt viewing' END) || '.' AS rationale FROM s""")
def _(supplier, orders):
    """What the values of six columns suggest of them."""
    one = lambda df, name, value, kind: df.select(F.lit(name).alias("name"), value.cast("string").alias("v"), F.lit(kind).alias("kind"))
    parts = [
        one(supplier, "s_suppkey", F.col("s_suppkey"), "number"), one(supplier, "s_name", F.col("s_name"), "text"), one(orders, "o_orderstatus", F.col("o_orderstatus"), "text"), one(orders, "status_id", F.col("o_orderstatus"), "cells"),
        one(orders, "day-url", F.concat(F.date_format("o_orderdate", "yyyy-MM-dd"), F.repeat(F.lit("/x"), 30)), "url"), one(orders, "notes", F.concat(F.col("o_orderkey").cast("string"), F.repeat(F.lit(" long"), 20)), "text"),
    ]
    cells = parts[0]
    for p in parts[1:]:
        cells = cells.unionByName(p)
    each = cells.groupBy("name", "kind", "v").agg(F.count(F.lit(1)).alias("n"))  # distinct values are summed before the shuffle
    stats = each.groupBy("name", "kind").agg(F.count(F.lit(1)).alias("unique_values"), F.sum("n").alias("total_values"), (F.max(F.length("v")) > 100).alias("long_text"), F.min("v").alias("sample"))
    return quality.described(stats).select("name", "definition", "rationale")


@query("agg_16_quality_report", "lineitem", """WITH f AS (SELECT 'f' || l_linenumber AS field, l_discount * 10 AS score, CASE WHEN l_orderkey % 3 = 0 THEN l_tax * 10 END AS judged FROM lineitem), m AS (SELECT field, round(avg(score), 6) AS s FROM f GROUP BY field)
SELECT round(5.0 / 8, 6) AS schema_recall, round(5.0 / 6, 6) AS schema_precision, round(2 * (5.0 / 8) * (5.0 / 6) / (5.0 / 8 + 5.0 / 6), 6) AS schema_f1, round(count(DISTINCT l_orderkey) / count(*), 6) AS row_match_rate, (SELECT round(avg(score), 6) FROM f) AS mean, (SELECT round(median(score), 6) FROM f) AS median, (SELECT count(score) FROM f) AS comparisons,
  (SELECT round(avg(judged), 6) FROM f) AS judge_mean, (SELECT count(judged) FROM f) AS judge_comparisons, (SELECT round(corr(score, judged), 6) FROM f WHERE judged IS NOT NULL) AS judge_correlation,
  (SELECT list(field ORDER BY s DESC, field)[1:5] FROM m) AS best_fields, (SELECT list(field ORDER BY s, field)[1:5] FROM m) AS worst_fields FROM lineitem""")
def _(lineitem):
    """A report on lines as compared values: fields by line number, discounts as scores, taxes as a judge's."""
    scores = lineitem.select(F.concat(F.lit("f"), F.col("l_linenumber").cast("string")).alias("field"), (F.col("l_discount") * 10).alias("score"), F.when(F.col("l_orderkey") % 3 == 0, F.col("l_tax") * 10).alias("judged"))
    sizes = lineitem.agg(F.lit(8).alias("gt_fields"), F.lit(6).alias("pred_fields"), F.lit(5).alias("aligned_fields"), F.count(F.lit(1)).alias("gt_rows"), (2 * F.count(F.lit(1))).alias("pred_rows"), F.count_distinct("l_orderkey").alias("rows_matched"))
    return quality.quality_report(scores, sizes)


@query("agg_14_column_report", "orders", """WITH u AS (SELECT unnest(list_distinct([o_orderpriority, o_orderstatus, CASE WHEN o_orderkey % 50 = 0 THEN 'rare' ELSE o_orderstatus END, 'every', 'stranger'])) AS name FROM orders), c AS (SELECT DISTINCT o_orderpriority AS name FROM orders UNION SELECT DISTINCT o_orderstatus FROM orders UNION VALUES ('rare'), ('every'), ('never'), ('none')),
r AS (SELECT c.name, coalesce(k, 0)::DOUBLE / (SELECT count(*) FROM orders) AS rate FROM c LEFT JOIN (SELECT name, count(*) AS k FROM u GROUP BY name) USING (name))
SELECT count(*)::INT AS total_columns, list(name ORDER BY rate DESC, name)[1:5] AS most_used, list_filter(list({'n': name, 'r': rate} ORDER BY rate, name)[1:5], lambda x: x.r < 0.1).list_transform(lambda x: x.n) AS least_used, coalesce(list(name ORDER BY name) FILTER (rate = 0), []) AS unused, coalesce(list(name ORDER BY name) FILTER (rate > 0.7), []) AS highly_used FROM r""")
def _(orders):
    """Orders as answers that used columns: their priorities, states and a few others."""
    used = F.array("o_orderpriority", "o_orderstatus", F.when(F.col("o_orderkey") % 50 == 0, "rare").otherwise(F.col("o_orderstatus")), F.lit("every"), F.lit("stranger"))
    columns = orders.select(F.explode(F.array("o_orderpriority", "o_orderstatus", F.lit("rare"), F.lit("every"), F.lit("never"), F.lit("none"))).alias("name"))
    return quality.column_report(orders.select(used.alias("used")), "used", columns)


@query("agg_12_truth_metrics", "lineitem", """WITH c AS (SELECT CASE l_orderkey % 3 WHEN 0 THEN 'Yes' WHEN 1 THEN l_linenumber::VARCHAR ELSE l_returnflag || ' flag of it' END AS truth, CASE l_orderkey % 3 WHEN 0 THEN CASE WHEN l_tax > 0.04 THEN ' yes ' ELSE 'not at all' END WHEN 1 THEN CASE WHEN l_tax > 0.04 THEN l_linenumber::VARCHAR ELSE (l_linenumber * 2)::VARCHAR END ELSE CASE WHEN l_tax > 0.04 THEN l_returnflag || ' FLAG of it' ELSE 'the ' || l_returnflag || ' flag of it' END END AS predicted, l_discount AS confidence, l_orderkey % 3 AS k, l_tax > 0.04 AS hit FROM lineitem),
e AS (SELECT CASE k WHEN 0 THEN 'binary' WHEN 1 THEN 'numeric' ELSE 'semantic' END AS type, hit AS same, CASE WHEN hit THEN 1.0 WHEN k = 2 THEN 0.8 ELSE 0.0 END AS s, hit OR k = 2 OR k = 1 AND contains(predicted, truth) AS held, confidence FROM c)
SELECT type, count(*) AS n, round(avg(same::INT), 6) AS accuracy, round(avg(s), 6) AS avg_similarity, round(avg(held::INT), 6) AS containment_rate, round(avg(confidence), 6) AS avg_confidence FROM e GROUP BY ROLLUP (type)""")
def _(lineitem):
    """Lines as comparisons of three types, right where the tax is above 4 %."""
    k, hit, flag, n = F.col("l_orderkey") % 3, F.col("l_tax") > 0.04, F.col("l_returnflag"), F.col("l_linenumber")
    truth = F.when(k == 0, "Yes").when(k == 1, n.cast("string")).otherwise(F.concat(flag, F.lit(" flag of it")))
    said = F.when(k == 0, F.when(hit, " yes ").otherwise("not at all")).when(k == 1, F.when(hit, n.cast("string")).otherwise((n * 2).cast("string"))).otherwise(F.when(hit, F.concat(flag, F.lit(" FLAG of it"))).otherwise(F.concat(F.lit("the "), flag, F.lit(" flag of it"))))
    return quality.truth_metrics(lineitem.select(said.alias("predicted"), truth.alias("truth"), F.col("l_discount").alias("confidence")))


@query("jon_18_model_specs", "supplier nation", """WITH m AS (SELECT s_suppkey, CASE s_suppkey % 3 WHEN 0 THEN 'A' WHEN 1 THEN 'b' ELSE 'none' END AS provider, CASE s_suppkey % 4 WHEN 0 THEN 'NATION_' || s_nationkey WHEN 1 THEN 'NATION_' || s_nationkey || '-002' WHEN 2 THEN 'other' ELSE s_name END AS model FROM supplier), s AS (SELECT n_name AS name, n_nationkey AS spec FROM nation)
SELECT s_suppkey, coalesce((SELECT spec FROM s WHERE provider <> 'none' AND name = model), (SELECT arg_min(spec, spec) FROM s WHERE provider <> 'none' AND starts_with(model, name)), CASE provider WHEN 'A' THEN 1000 END, 9999)::INT AS spec,
  CASE WHEN provider <> 'none' AND model IN (SELECT name FROM s) THEN 'exact' WHEN provider <> 'none' AND EXISTS (SELECT 1 FROM s WHERE starts_with(model, name)) THEN 'prefix' WHEN provider = 'A' THEN 'provider' ELSE 'global' END AS how FROM m""")
def _(supplier, nation):
    """Suppliers as models of three providers; nations as the names two providers know, one with a default."""
    n, key = F.col("s_suppkey"), F.col("s_nationkey").cast("string")
    models = supplier.select("s_suppkey", F.when(n % 3 == 0, "A").when(n % 3 == 1, "b").otherwise("none").alias("provider"), F.when(n % 4 == 0, F.concat(F.lit("NATION_"), key)).when(n % 4 == 1, F.concat(F.lit("NATION_"), key, F.lit("-002"))).when(n % 4 == 2, "other").otherwise(F.col("s_name")).alias("model"))
    specs = nation.select(F.explode(F.array(F.lit("a"), F.lit("b"))).alias("provider"), F.col("n_name").alias("model"), F.col("n_nationkey").cast("int").alias("spec"), F.col("n_nationkey").alias("seq"))
    default = nation.where("n_nationkey = 0").select(F.lit("a").alias("provider"), F.lit("_default").alias("model"), F.lit(1000).alias("spec"), F.col("n_nationkey").alias("seq"))
    return quality.model_specs(models, specs.unionByName(default), 9999).select("s_suppkey", "spec", "how")


@query("sup_01_backfill", "orders supplier", "WITH f AS (SELECT s_name, row_number() OVER (ORDER BY s_name) - 1 AS place FROM supplier) SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN ['own'] ELSE CASE WHEN s_name IS NOT NULL THEN [s_name] WHEN o_orderkey % 3 = 1 THEN [] END END AS papers FROM orders LEFT JOIN f ON o_orderkey = place")
def _(orders, supplier):
    """Orders as rows by number, of which two thirds lack papers; suppliers' names as files."""
    n = F.col("o_orderkey")
    rows = orders.select("o_orderkey", F.when(n % 3 == 0, F.array(F.lit("own"))).when(n % 3 == 1, F.array().cast("array<string>")).alias("papers"))
    return quality.backfilled(rows, "o_orderkey", "papers", supplier.select(F.col("s_name").alias("name")))


@query("ddl_05_problems", "part", "WITH c AS (SELECT p_partkey, p_size AS schema, CASE p_partkey % 5 WHEN 0 THEN upper(p_type) WHEN 1 THEN p_type WHEN 2 THEN 'ab' WHEN 3 THEN ' ' ELSE p_name END AS name, CASE WHEN p_partkey % 2 = 0 THEN p_type ELSE ' ' END AS definition FROM part) SELECT schema, name, list_filter([CASE WHEN trim(name) = '' THEN 'no name' END, CASE WHEN trim(name) <> '' AND count(*) OVER (PARTITION BY schema, lower(name)) > 1 THEN 'duplicate name' END], lambda x: x IS NOT NULL) AS errors, list_filter([CASE WHEN trim(definition) = '' THEN 'missing definition' END, CASE WHEN trim(name) <> '' AND length(name) < 3 THEN 'short name' END], lambda x: x IS NOT NULL) AS warnings FROM c")
def _(part):
    n = F.col("p_partkey")
    name = F.when(n % 5 == 0, F.upper("p_type")).when(n % 5 == 1, F.col("p_type")).when(n % 5 == 2, "ab").when(n % 5 == 3, " ").otherwise(F.col("p_name"))
    return quality.validated(part.select(F.col("p_size").alias("schema"), name.alias("name"), F.when(n % 2 == 0, F.col("p_type")).otherwise(" ").alias("definition")))


_ANSWER = "CASE o_orderkey % 6 WHEN 0 THEN o_orderpriority WHEN 1 THEN lower(o_orderpriority) WHEN 2 THEN 'not reported' WHEN 3 THEN ' ' WHEN 4 THEN 'something else' ELSE 'N/A' END"


def _answers(orders):
    n = F.col("o_orderkey")
    said = F.when(n % 6 == 0, F.col("o_orderpriority")).when(n % 6 == 1, F.lower("o_orderpriority")).when(n % 6 == 2, "not reported").when(n % 6 == 3, " ").when(n % 6 == 4, "something else").otherwise("N/A")
    excerpts = F.when(n % 6 == 5, F.array(F.lit("N/A it says"))).otherwise(F.array().cast("array<string>"))
    rows = orders.select(n.alias("row"), F.lit("priority").alias("column"), said.alias("answer"), excerpts.alias("excerpts"), (n % 12 == 0).alias("suggested"))
    catalog = orders.agg(F.lit("priority").alias("column"), F.sort_array(F.collect_set("o_orderpriority")).alias("allowed"))
    return quality.postprocessed(rows, catalog)


@query("llm_10_answers", "orders", f"SELECT o_orderkey AS row, CASE WHEN o_orderkey % 6 < 2 THEN o_orderpriority ELSE {_ANSWER} END AS value, o_orderkey % 6 < 2 AS normalized, CASE WHEN o_orderkey % 6 IN (4, 5) THEN {_ANSWER} WHEN o_orderkey % 12 = 0 THEN o_orderpriority END AS unmatched FROM orders WHERE o_orderkey % 6 NOT IN (2, 3) AND NOT (o_orderkey % 6 < 2 AND o_orderpriority = '4-NOT SPECIFIED')")
def _(orders):
    """Answers that say something ("4-NOT SPECIFIED" says nothing), as allowed values where they fit one."""
    return _answers(orders)[0].select("row", "value", "normalized", "unmatched")


@query("llm_10_unmatched", "orders", f"SELECT DISTINCT 'priority' AS \"column\", CASE WHEN o_orderkey % 12 = 0 THEN o_orderpriority ELSE {_ANSWER} END AS value FROM orders WHERE o_orderkey % 6 IN (4, 5) OR o_orderkey % 12 = 0 AND o_orderpriority <> '4-NOT SPECIFIED'")
def _(orders):
    return _answers(orders)[1]


@query("udf_03_schema_recall", "part", "WITH g AS (SELECT DISTINCT p_brand AS tab, p_type AS c FROM part), p AS (SELECT DISTINCT p_brand AS tab, 'the ' || lower(p_type) AS c FROM part WHERE p_size < 25) SELECT g.tab AS \"table\", round(avg((p.c IS NOT NULL)::INT), 6) AS recall FROM g LEFT JOIN p ON g.tab = p.tab AND p.c = 'the ' || lower(g.c) GROUP BY g.tab")
def _(part):
    """Brands as tables, types as columns; those of small parts are predicted, with a word more."""
    gold = part.select(F.col("p_brand").alias("table"), F.col("p_type").alias("column"), F.col("p_name").alias("value"))
    found = part.where("p_size < 25").select(F.col("p_brand").alias("table"), F.concat(F.lit("the "), F.lower("p_type")).alias("column"), F.col("p_name").alias("value"))
    return quality.schema_recall(found, gold, "name", "containment", 1.0)


@query("win_05_running", "orders", "SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1 AS position, round(sum(o_totalprice) OVER (ORDER BY o_orderdate, o_orderkey), 2) AS total FROM orders")
def _(orders):
    """Orders by date with their number and the running total, over the whole table."""
    found = order.running_totals(orders.select("o_orderkey", "o_orderdate", F.round(F.col("o_totalprice") * 100).cast("long").alias("cents"), F.lit(1).cast("long").alias("one")), ["o_orderdate", "o_orderkey"], {"total": "cents", "place": "one"})
    return found.select("o_orderkey", (F.col("place") - 1).alias("position"), F.round(F.col("total") / 100, 2).alias("total"))
