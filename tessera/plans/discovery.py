"""Queries on what replies propose; the replies are made of the tables' own values."""

from pyspark.sql import functions as F

from tessera.operators import discovery
from tessera.plans.registry import query


@query("llm_04_schema_replies", "part", r"""WITH r AS (SELECT p_partkey AS k, p_name AS n, p_type AS t FROM part)
SELECT k AS p_partkey, CASE k % 5 WHEN 0 THEN [n || ' x', 'b'] WHEN 1 THEN [n] WHEN 2 THEN [n, 'Second'] WHEN 3 THEN [] ELSE [] END AS names, CASE k % 5 WHEN 2 THEN [t, 'thing'] WHEN 0 THEN ['r', ''] WHEN 1 THEN [''] ELSE [] END AS rationales, CASE k % 5 WHEN 0 THEN 2 ELSE 0 END AS n_allowed, k % 5 <> 0 AS helpful, CASE WHEN k % 5 = 0 THEN 1 ELSE 0 END AS n_additions FROM r""")
def _(part):
    """Replies as an object in a fence, a bare list, lines of text, an object without columns, and nothing."""
    k, n, t = F.col("p_partkey"), F.col("p_name"), F.col("p_type")
    fenced = F.concat(F.lit('So:\n```json\n{"document_helpful": false, "columns": [{"name": "1. **'), n, F.lit('** x", "rationale": "r", "allowed_values": ["a", null, "b"]}, {"name": "b", "definition": "d", "allowed_values": []}], "suggested_value_additions": [{"column_name": "b", "new_values": ["v"], "reason": "seen"}]}\n```'))
    bare = F.concat(F.lit('[{"name": "'), n, F.lit('"}]'))
    lines = F.concat(F.lit("{\n- "), n, F.lit(": "), t, F.lit('\n"name": "no"\nrationale: no\nx: short\nSecond: thing\n}'))
    reply = F.when(k % 5 == 0, fenced).when(k % 5 == 1, bare).when(k % 5 == 2, lines).when(k % 5 == 3, '{"other": 1}')
    got = part.select("p_partkey", discovery.schema_reply(reply).alias("s"))
    allowed = F.aggregate(F.transform("s.columns", lambda c: F.coalesce(F.size(c["allowed_values"]), F.lit(0))), F.lit(0), lambda a, x: a + x)
    return got.select("p_partkey", F.col("s.columns.name").alias("names"), F.col("s.columns.rationale").alias("rationales"), allowed.alias("n_allowed"), F.col("s.document_helpful").alias("helpful"), F.size("s.additions").alias("n_additions"))


@query("llm_03_units", "conversations", r"WITH c AS (SELECT conv_id, list(regexp_replace(text, '^\s+|\s+$', '', 'g') ORDER BY turn, text)[1:5] AS p, count(*) AS n FROM conversations GROUP BY conv_id) SELECT conv_id, CASE conv_id % 3 WHEN 0 THEN 'STANDARD' WHEN 1 THEN 'DOCUMENT_ONLY' ELSE 'QUERY_ONLY' END AS mode, CASE conv_id % 3 WHEN 0 THEN 'Question: which?' || chr(10) || chr(10) || 'Documents:' || chr(10) || array_to_string(p, chr(10) || chr(10)) WHEN 1 THEN 'Documents:' || chr(10) || array_to_string(p, chr(10) || chr(10)) ELSE 'Question: which?' END AS prompt, CASE WHEN conv_id % 4 < 2 THEN 'Turn of ' || conv_id END AS unit FROM c")
def _(conversations):
    """What a row stands for, asked with a conversation's first turns, its question, or both; every other reply doesn't say."""
    k = F.col("conv_id")
    own = conversations.groupBy("conv_id").agg(F.slice(F.transform(F.sort_array(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]), 1, 6).alias("passages"))
    asked = discovery.unit_question(F.when(k % 3 != 1, " which? "), F.when(k % 3 != 2, F.col("passages")))
    reply = F.when(k % 4 < 2, F.concat(F.lit('```json\n{"observation_unit": {"name": "Turn of '), k.cast("string"), F.lit('", "definition": "one turn"}}\n```'))).when(k % 4 == 2, '{"observation_unit": {"name": "x"}}').otherwise("a turn, I think")
    return own.select("conv_id", asked.alias("q"), discovery.unit_reply(reply).alias("u")).select("conv_id", "q.mode", "q.prompt", F.col("u.name").alias("unit"))


def _units(orders):
    """Customers as documents, their orders as units; what is said of each is made of its values."""
    k = F.col("o_orderkey")
    units = orders.select(F.col("o_custkey").alias("document"), k.alias("seq"), F.concat(F.lit("Order "), k.cast("string")).alias("unit"), F.when(k % 3 == 0, F.array(F.lit("one"), F.col("o_orderpriority"))).alias("passages"))
    documents = orders.groupBy(F.col("o_custkey").alias("document")).agg(F.concat(F.lit("Text of "), F.count(F.lit(1)).cast("string")).alias("text"))
    return units, documents


@query("llm_07_unit_requests", "orders", "WITH d AS (SELECT o_custkey, 'Text of ' || count(*) AS text FROM orders GROUP BY o_custkey) SELECT o_custkey AS document, 'Order ' || o_orderkey AS unit, CASE WHEN o_custkey % 4 <> 0 AND o_orderkey % 3 = 0 THEN 'one' || chr(10) || chr(10) || '--- RELEVANT PASSAGE ---' || chr(10) || chr(10) || o_orderpriority ELSE text END AS passages FROM orders JOIN d USING (o_custkey) WHERE o_custkey % 4 <> 0 UNION ALL SELECT o_custkey, 'Known', text FROM d WHERE o_custkey % 4 = 0")
def _(orders):
    """Every unit with the passages to ask it with; a quarter of customers have one known unit instead."""
    units, documents = _units(orders)
    known = documents.where("document % 4 = 0").select("document", F.lit(0).cast("long").alias("seq"), F.lit("Known").alias("unit"))
    return discovery.unit_requests(units, documents, known).select("document", "unit", "passages")


@query("llm_07_unit_rows", "orders", "SELECT o_custkey AS document, 'Order ' || o_orderkey AS unit, 'status' AS \"column\", o_orderstatus AS answer, 0 AS n_excerpts, NULL AS source, true AS normalized FROM orders WHERE o_orderkey % 5 <> 4 UNION ALL SELECT o_custkey, 'Order ' || o_orderkey, 'priority', o_orderpriority, 1, o_custkey::VARCHAR, false FROM orders WHERE o_orderkey % 5 < 3")
def _(orders):
    """Replies about orders as cells: states allowed whatever the case, priorities with evidence, other columns and bad replies left out."""
    units, _ = _units(orders)
    k = F.col("o_orderkey")
    said = orders.select(k.alias("seq"), F.when(k % 5 == 4, "no JSON").otherwise(F.concat(F.lit('{"status": {"answer": "'), F.lower("o_orderstatus"), F.lit('", "excerpts": []}, "other": "x", "priority": '), F.when(k % 5 == 3, '"not reported"').otherwise(F.concat(F.lit('{"value": "'), "o_orderpriority", F.lit('", "evidence": ["seen"]}'))), F.lit("}"))).alias("reply"))
    columns = orders.agg(F.sort_array(F.collect_set("o_orderstatus")).alias("allowed")).select(F.lit("status").alias("column"), "allowed")
    columns = columns.unionByName(columns.select(F.lit("priority").alias("column"), F.array().cast("array<string>").alias("allowed")))
    rows, _ = discovery.unit_rows(units.join(said, "seq"), columns)
    return rows.select("document", "unit", "column", "answer", F.size("excerpts").alias("n_excerpts"), F.get("excerpts", F.lit(0))["source"].alias("source"), "normalized")


@query("sup_04_for_extraction", "part", "WITH c AS (SELECT p_partkey, CASE p_partkey % 6 WHEN 5 THEN '_hidden' WHEN 4 THEN 'Papers' ELSE 'The_' || replace(p_name, ' ', '_') END AS name, CASE WHEN p_partkey % 2 = 0 THEN p_type END AS d, CASE WHEN p_partkey % 3 = 0 THEN 'it matters' ELSE '' END AS r FROM part), x AS (SELECT *, lower(replace(name, '_', ' ')) AS p FROM c WHERE p_partkey % 6 < 4) SELECT p_partkey, name, coalesce(d, 'Information about ' || p) AS definition, CASE WHEN r = '' THEN 'Relevant data for ' || p || ' analysis' ELSE r END AS rationale, 'For column ''' || name || ''': ' || coalesce('Definition: ' || d || ' ', '') || CASE WHEN r <> '' THEN 'Purpose: ' || r || ' ' ELSE '' END || CASE WHEN d IS NOT NULL AND r <> '' THEN 'Given that this column represents ''' || d || ''' and is important because ''' || r || ''', carefully extract the most relevant information from the document that matches this purpose. Focus on information that directly relates to ' || p || ' as described.' WHEN d IS NOT NULL THEN 'Extract information that matches the definition: ''' || d || '''. Look for data specifically related to ' || p || '.' ELSE 'Extract relevant information for ' || p || '.' END || ' Provide specific, factual information from the document. If the exact information is not available, return ''Not found'' rather than guessing.' AS extraction_guidance FROM x")
def _(part):
    k = F.col("p_partkey")
    name = F.when(k % 6 == 5, "_hidden").when(k % 6 == 4, "Papers").otherwise(F.concat(F.lit("The_"), F.translate("p_name", " ", "_")))
    columns = part.select("p_partkey", F.lit(1).alias("schema"), name.alias("name"), F.when(k % 2 == 0, F.col("p_type")).alias("definition"), F.when(k % 3 == 0, "it matters").otherwise("").alias("rationale"))
    return discovery.for_extraction(columns).select("p_partkey", "name", "definition", "rationale", "extraction_guidance")
