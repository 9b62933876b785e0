"""Queries that write and read files, run streams, or extract cells."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.operators import extract
from tessera.plans.registry import query
from tessera.sources import readers, writers
from tessera.sources.scratch import new_path
from tessera.streaming import progress


@query("src_04_jsonl", "events", "SELECT event_id, event_type, value FROM events")
def _(events):
    path = new_path(events.sparkSession, "jsonl")
    writers.append_jsonl(events.select("event_id", "event_type", "value"), path)
    return readers.read_jsonl(events.sparkSession, path, "event_id long, event_type string, value double")


@query("src_05_csv", "customer", "SELECT c_custkey, c_name, CASE WHEN c_custkey % 4 <> 3 THEN c_mktsegment END AS segment, CASE WHEN c_custkey % 3 = 0 THEN '# ' || c_name ELSE c_mktsegment || ', \"' || c_custkey || '\"' || chr(10) || 'c_custkey' END AS note FROM customer")
def _(customer):
    """Four files whose headers differ in order, delimiter and columns, read as one table by name."""
    spark, path = customer.sparkSession, new_path(customer.sparkSession, "csv")
    note = F.when(F.col("c_custkey") % 3 == 0, F.concat(F.lit("# "), "c_name")).otherwise(F.concat(F.col("c_mktsegment"), F.lit(', "'), F.col("c_custkey").cast("string"), F.lit('"\nc_custkey')))
    rows = customer.select(F.col("c_custkey").cast("string").alias("c_custkey"), "c_name", "c_mktsegment", note.alias("note"))
    orders = [("c_custkey c_name c_mktsegment note", ","), ("note c_mktsegment c_custkey c_name", ";"), ("c_name note c_mktsegment c_custkey", "\t"), ("note c_custkey c_name", "|")]
    quoted = lambda c: F.concat(F.lit('"'), F.replace(F.col(c), F.lit('"'), F.lit('""')), F.lit('"'))
    k = (F.col("c_custkey").cast("long") % 4).cast("int")
    line = F.get(F.array(*[F.concat_ws(d, *[quoted(c) for c in names.split()]) for names, d in orders]), k)
    heads = spark.createDataFrame([(f"f{i}.csv", f"# Query: {i}\n\n" + d.join(names.split()) + "\n") for i, (names, d) in enumerate(orders)], "name string, text string")
    body = rows.select(F.concat(F.lit("f"), k.cast("string"), F.lit(".csv")).alias("name"), F.concat(line, F.lit("\n")).alias("text"), F.col("c_custkey").cast("long").alias("seq"))
    writers.write_files(heads.withColumn("seq", F.lit(-1).cast("long")).unionByName(body), path, ["seq"])
    return readers.read_csv(spark, path, rename={"c_mktsegment": "segment"}, schema="c_custkey long, c_name string, c_mktsegment string, note string")


@query("src_06_preamble", "supplier", "SELECT s_suppkey, s_name, CASE WHEN s_suppkey % 2 = 0 THEN '# Query: which?' ELSE 's_suppkey,s_name' || chr(10) || 'x' END AS note FROM supplier")
def _(supplier):
    """Exports with a preamble, one for each nation, read back: rows that look like the preamble or the header stay."""
    spark, path = supplier.sparkSession, new_path(supplier.sparkSession, "exports")
    rows = supplier.withColumn("note", F.when(F.col("s_suppkey") % 2 == 0, "# Query: which?").otherwise("s_suppkey,s_name\nx"))
    meta = {"session_id": "s", "query": "which?", "columns": [{"name": "s_name", "definition": "a name", "rationale": "asked"}]}
    writers.export_csv(rows.select("s_suppkey", "s_name", "note", "s_nationkey"), path, meta, "s_nationkey")
    return readers.read_csv(spark, f"{path}/*", schema="s_suppkey long, s_name string, note string")


@query("src_07_validate", "events", "SELECT user_id, 'csv' AS format, count(*) FILTER (event_id % 16 < 4) AS n_rows, 3 AS n_columns, count(*) FILTER (event_id % 16 < 4) = 0 AS schema_only, 0 AS n_errors, CASE WHEN count(*) FILTER (event_id % 16 < 4) = 0 THEN 2 ELSE 1 END AS n_warnings FROM events GROUP BY user_id")
def _(events):
    """A file of a few events of each user, parted by semicolons, with line breaks in cells, and what its beginning says; some have no rows."""
    spark, path = events.sparkSession, new_path(events.sparkSession, "uploads")
    name = F.concat(F.col("user_id").cast("string"), F.lit(".csv"))
    heads = events.select(name.alias("name"), F.lit(-1).cast("long").alias("seq"), F.lit("# Query: q\nevent;note;value\n").alias("text")).distinct()
    rows = events.where("event_id % 16 < 4").select(name.alias("name"), F.col("event_id").alias("seq"), F.concat(F.col("event_id").cast("string"), F.lit(';"a\n""b"", ;";'), F.col("value").cast("string"), F.lit("\n")).alias("text"))
    writers.write_files(heads.unionByName(rows), path, ["seq"])
    found = readers.validate_files(spark, path).withColumn("user_id", F.regexp_extract(F.col("filename"), r"^(.*)\.csv$", 1).cast("int"))
    return found.select("user_id", "format", "n_rows", "n_columns", "schema_only", F.size("errors").alias("n_errors"), F.size("warnings").alias("n_warnings"))


@query("src_09_upload_errors", "nation", "SELECT n_regionkey, CASE n_regionkey % 3 WHEN 0 THEN ['Unsupported file format'] WHEN 1 THEN ['CSV file must have at least a header row'] ELSE [] END AS errors FROM nation GROUP BY n_regionkey")
def _(nation):
    spark, path = nation.sparkSession, new_path(nation.sparkSession, "uploads")
    k = F.col("n_regionkey") % 3
    files = nation.groupBy("n_regionkey").agg(F.count(F.lit(1)).alias("n")).select(F.concat(F.lit("f"), F.col("n_regionkey").cast("string"), F.when(k == 0, ".exe").when(k == 1, ".csv").otherwise(".jsonl")).alias("name"), F.when(k == 1, "# only a comment\n").otherwise('{"a": 1}\n').alias("text"))
    writers.write_files(files, path)
    return readers.validate_files(spark, path).select(F.regexp_extract("filename", r"(\d+)", 1).cast("int").alias("n_regionkey"), "errors")


@query("snk_03_schema_files", "part", "WITH c AS (SELECT p_brand, p_type, min(p_partkey) AS seq FROM part GROUP BY ALL), n AS (SELECT *, 1 + (row_number() OVER (PARTITION BY p_brand ORDER BY seq) - 1) // 2 AS iteration FROM c) SELECT p_brand AS schema, list(p_type ORDER BY seq) AS columns, max(iteration) AS snapshots, count(*) FILTER (iteration = 1) AS first_total, round(count(*)::DOUBLE / max(iteration), 6) AS contribution_rate FROM n GROUP BY p_brand")
def _(part):
    """The schema artefact of each brand, two columns an iteration, as a file of its own, and what it says."""
    spark, path = part.sparkSession, new_path(part.sparkSession, "schemas")
    found = part.groupBy("p_brand", "p_type").agg(F.min("p_partkey").alias("seq"))
    iteration = F.floor((F.row_number().over(Window.partitionBy("p_brand").orderBy("seq")) - 1) / 2) + 1
    columns = found.select(F.col("p_brand").alias("schema"), "seq", F.col("p_type").alias("name"), F.concat(F.lit("of "), "p_brand").alias("definition"), F.lit(None).cast("string").alias("rationale"), F.array(F.lit("a")).alias("allowed"), iteration.alias("iteration"), F.concat(F.lit("doc"), F.col("seq").cast("string")).alias("document"))
    writers.write_schema(columns, path)
    back = spark.read.schema("id string, columns array<struct<name: string>>, contribution_rate double, schema_evolution struct<snapshots: array<struct<iteration: long, total_columns: long>>>").json(path)
    snapshots = F.col("schema_evolution.snapshots")
    return back.select(F.col("id").alias("schema"), F.transform("columns", lambda c: c["name"]).alias("columns"), F.size(snapshots).cast("long").alias("snapshots"), F.get(snapshots, F.lit(0))["total_columns"].alias("first_total"), "contribution_rate")


@query("src_10_schema_files", "part", "SELECT p_partkey, CASE WHEN p_partkey % 4 = 3 THEN NULL ELSE p_brand END AS name, CASE WHEN p_partkey % 4 = 3 THEN NULL ELSE p_type END AS rationale, CASE p_partkey % 4 WHEN 3 THEN NULL WHEN 1 THEN 2 ELSE 0 END AS n_allowed FROM part")
def _(part):
    """Schema files in their four forms: columns of each, none for one that is bad."""
    k = F.col("p_partkey") % 4
    old = F.struct(F.col("p_brand").alias("column"), F.col("p_type").alias("explanation"))
    new = F.struct(F.col("p_brand").alias("name"), F.col("p_type").alias("rationale"), F.array("p_name", "p_brand").alias("allowed_values"))
    text = F.when(k == 0, F.to_json(F.struct(F.array(old).alias("schema")))).when(k == 1, F.to_json(F.struct(F.array(new).alias("columns")))).when(k == 2, F.to_json(F.array(old))).otherwise("{bad")
    c = F.get(readers.schema_columns(text), F.lit(0))
    return part.select("p_partkey", c["name"].alias("name"), c["rationale"].alias("rationale"), F.when(c.isNotNull(), F.size(c["allowed_values"])).alias("n_allowed"))


@query("src_08_json_rows", "supplier", "SELECT s_suppkey, s_name FROM supplier")
def _(supplier):
    """Rows of a nation as a complete export of nine keys, as a list, or as lists and exports of one; a folder of all, and their rows again."""
    spark, path = supplier.sparkSession, new_path(supplier.sparkSession, "json")
    row = F.to_json(F.struct("s_suppkey", "s_name"))
    k, key = F.col("s_nationkey") % 3, F.col("s_nationkey").cast("string")
    head = '{"query": "q", "generated": "g", "session_id": "s", "model": null, "unit": {}, "evolution": [], "metadata": {"a": 1}, "version": 2, "data": ['
    first = F.row_number().over(Window.partitionBy("s_nationkey").orderBy("s_suppkey")) == 1  # a nation is a file
    many = supplier.where(k < 2).select(F.concat(key, F.lit(".json")).alias("name"), F.col("s_suppkey").cast("long").alias("seq"), F.concat(F.when(first, F.when(k == 0, head).otherwise("[")).otherwise(","), row).alias("text"))
    ends = supplier.where(k < 2).groupBy("s_nationkey").agg(F.max("s_suppkey").alias("last")).select(F.concat(key, F.lit(".json")).alias("name"), (F.col("last") + 1).cast("long").alias("seq"), F.when(k == 0, "]}").otherwise("]").alias("text"))
    single = supplier.where(k == 2).select(F.concat(F.lit("one"), F.col("s_suppkey").cast("string"), F.lit(".json")).alias("name"), F.lit(0).cast("long").alias("seq"), row.alias("text"))
    empty = spark.createDataFrame([("empty.json", 0, '{"query": "q", "data": []}'), ("bad.json", 0, "{")], "name string, seq long, text string")
    writers.write_files(many.unionByName(ends).unionByName(single).unionByName(empty), path, ["seq"])
    return readers.read_json(spark, path)


@query("src_13_locations", "supplier nation", "SELECT s_name AS row_name, 0 AS file_ord FROM supplier UNION ALL SELECT n_name, 2 FROM nation")
def _(supplier, nation):
    spark, root = supplier.sparkSession, new_path(supplier.sparkSession, "locations")
    writers.append_jsonl(supplier.select(F.col("s_name").alias("row_name")), f"{root}/a")
    writers.append_jsonl(nation.select(F.col("n_name").alias("row_name")), f"{root}/c")
    return readers.union_locations(spark, [f"{root}/a", f"{root}/b", f"{root}/c"], "row_name string")


@query("src_01_text_scan", "benchmark", "SELECT count(*) AS files, sum(length(text))::BIGINT AS characters FROM benchmark")
def _(benchmark):
    spark, path = benchmark.sparkSession, new_path(benchmark.sparkSession, "texts")
    benchmark.select(F.concat(F.lit("k"), F.col("item_id").cast("string")).alias("k"), F.replace("text", F.lit("\n"), F.lit(" ")).alias("value")).write.partitionBy("k").text(path)
    found = readers.scan_texts(spark, [path])
    return found.agg(F.count(F.lit(1)).alias("files"), F.sum(F.length(F.regexp_replace("text", "\n$", ""))).alias("characters"))


@query("src_15_eval_tables", "supplier", "SELECT s_suppkey::VARCHAR AS tabid, s_name AS name FROM supplier")
def _(supplier):
    spark, path = supplier.sparkSession, new_path(supplier.sparkSession, "tables")
    table = F.concat(F.lit("```json\n"), F.to_json(F.struct(F.col("s_name").alias("name"))), F.lit("\n```"))
    supplier.select(F.to_json(F.struct(F.col("s_suppkey").cast("string").alias("tabid"), table.alias("table"))).alias("value")).write.text(path)
    return readers.read_eval_tables(spark, path).select("tabid", F.try_variant_get("table", "$.name", "string").alias("name"))


@query("snk_02_rewrite", "nation", "SELECT n_nationkey, n_name || '!' AS n_name FROM nation")
def _(nation):
    spark, path = nation.sparkSession, new_path(nation.sparkSession, "rewrite")
    kind = "n_nationkey int, n_name string"
    writers.append_jsonl(nation.select("n_nationkey", "n_name"), path)
    writers.rewrite_jsonl(readers.read_jsonl(spark, path, kind).withColumn("n_name", F.concat("n_name", F.lit("!"))), path, spark)
    return readers.read_jsonl(spark, path, kind)


@query("snk_04_answers", "events", "SELECT event_id::VARCHAR AS \"Event Id\", coalesce(json_extract_string(props, '$.answer'), props) AS \"Props\" FROM events")
def _(events):
    return writers.answers(events.select("event_id", "props"))


@query("snk_05_complete_rows", "supplier", "SELECT s_suppkey, '{\"s_suppkey\":' || s_suppkey || ',\"s_name\":\"' || s_name || '\"}' AS json FROM supplier")
def _(supplier):
    return writers.complete_rows(supplier.select("s_suppkey", "s_name"), "s_suppkey")


@query("snk_07_excerpts", "supplier", "SELECT s_suppkey, '[doc] ' || s_name || ' | [] x' AS excerpts FROM supplier")
def _(supplier):
    kind = "struct<text: string, source: string>"
    pair = F.array(F.struct(F.col("s_name").alias("text"), F.lit("doc").alias("source")).cast(kind), F.struct(F.lit("x").alias("text"), F.lit(None).cast("string").alias("source")).cast(kind))
    return supplier.select("s_suppkey", writers.excerpts_text(pair).alias("excerpts"))


def _stream(events):
    spark, path = events.sparkSession, new_path(events.sparkSession, "source")
    events.select("event_id", "ts", "user_id", "event_type").write.parquet(path)
    return progress.events(spark, path, "event_id long, ts timestamp, user_id long, event_type string")


@query("str_tumbling", "events", "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n FROM events GROUP BY ALL")
def _(events):
    out = progress.run_once(progress.tumbling(_stream(events), "ts", "event_type", "1 hour", "60 days"))
    return out.select(F.col("window.start").alias("start"), "event_type", "n")


@query("str_sessions", "events", "WITH g AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM events), s AS (SELECT user_id, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT user_id, count(*) AS n FROM s GROUP BY user_id, k")
def _(events):
    return progress.run_once(progress.sessions(_stream(events), "ts", "user_id", "6 hours", "60 days")).select("user_id", "n")


@query("str_07_resume", "documents labels", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def _(documents, labels):
    return progress.remaining(documents.select("doc_id"), labels, "doc_id")


@query("llm_08_extract", "orders", "SELECT o_orderkey AS doc_id, 'status' AS \"column\", o_orderstatus AS answer, 'exact' AS status FROM orders UNION ALL SELECT o_orderkey, 'priority', o_orderpriority, 'exact' FROM orders")
def _(orders):
    text = F.concat(F.lit("# Order\nstatus: "), F.col("o_orderstatus"), F.lit("\npriority: "), F.col("o_orderpriority"))
    docs = orders.select(F.col("o_orderkey").alias("doc_id"), text.alias("text"))
    return extract.extract(docs, ["status", "priority", "carrier"], extract.RuleModel).select("doc_id", "column", "answer", "status")


@query("llm_06_units", "orders", "SELECT o_orderkey AS doc_id, 'Order ' || o_orderstatus AS unit_name, 'high' AS confidence FROM orders")
def _(orders):
    docs = orders.select(F.col("o_orderkey").alias("doc_id"), F.concat(F.lit("# Order "), F.col("o_orderstatus"), F.lit("\n")).alias("text"))
    return extract.identify_units(docs, extract.RuleModel)
