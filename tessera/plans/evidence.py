"""Queries of replies, cells of many shapes, suggestions, alignment, features, exports and runs."""

import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.functions import features, replies
from tessera.operators import catalog, evaluate, retrieve
from tessera.plans.registry import query
from tessera.sources import writers
from tessera.sources.scratch import new_path
from tessera.streaming import progress

_K = "json_extract_string(props, '$.k')"


def _pick(n, *options):
    """One of the options by ``n``."""
    return F.get(F.array(*[o if not isinstance(o, str) else F.lit(o) for o in options]), (n % len(options)).cast("int"))


def _events(events):
    return events.select("event_id", F.get_json_object("props", "$.k").alias("k"), "event_type", "props")


@query("prj_02_column_map", "events", f"SELECT event_id, {_K} AS k FROM events")
def _(events):
    row = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit('{"row_name": "x", "data": '), "props", F.lit("}"))).otherwise(F.col("props"))
    return events.select("event_id", F.get_json_object(F.coalesce(F.get_json_object(row, "$.data"), row), "$.k").alias("k"))


_SHAPES = (
    lambda k, t: F.concat(F.lit('{"answer": "'), k, F.lit('", "excerpts": ["'), t, F.lit('", "b"]}')),
    lambda k, t: F.concat(F.lit('{"value": "'), k, F.lit('", "excerpt": "'), t, F.lit('"}')),
    lambda k, t: F.concat(F.lit("{'response': '"), k, F.lit("', 'evidence': ['"), t, F.lit("'], 'ok': None}")),
    lambda k, t: F.concat(F.lit('{"answer": "[{\'value\': \''), k, F.lit("', 'excerpt': 'z'}]\", \"quotes\": [\""), t, F.lit('"]}')),
    lambda k, t: k,
    lambda k, t: F.concat(F.lit('[{"text": "'), k, F.lit('"}]')),
)


@query("prj_21_normal_cell", "events", f"SELECT event_id, {_K} AS answer, CASE event_id % 6 WHEN 0 THEN [event_type, 'b'] WHEN 1 THEN [event_type] WHEN 2 THEN [event_type] WHEN 3 THEN [event_type] ELSE []::VARCHAR[] END AS excerpts FROM events")
def _(events):
    rows = _events(events)
    cell = _pick(F.col("event_id"), *[f(F.col("k"), F.col("event_type")) for f in _SHAPES])
    return rows.select("event_id", replies.normal_cell(cell).alias("c")).select("event_id", "c.*")


@query("prj_11_display", "events", f"SELECT event_id, CASE event_id % 5 WHEN 0 THEN {_K} WHEN 1 THEN {_K} WHEN 2 THEN event_type || ', ' || {_K} WHEN 3 THEN {_K} || ', ' || event_type ELSE '' END AS shown FROM events")
def _(events):
    k, t = F.col("k"), F.col("event_type")
    cell = _pick(F.col("event_id"), F.concat(F.lit('{"answer": {"value": "'), k, F.lit('"}}')), F.concat(F.lit("{'text': '"), k, F.lit("', 'source': 'it's'}")), F.concat(F.lit('["'), t, F.lit('", "'), k, F.lit('"]')), F.concat(F.lit('{"a": "'), k, F.lit('", "b": "", "c": "'), t, F.lit('"}')), F.lit(None).cast("string"))
    return _events(events).select("event_id", replies.display(cell).alias("shown"))


@query("fn_13_payload", "events", f"SELECT event_id, {_K} AS k FROM events")
def _(events):
    doubled = F.replace(F.replace("props", F.lit("{"), F.lit("{{")), F.lit("}"), F.lit("}}"))
    said = _pick(F.col("event_id"), F.concat(F.lit("As asked\n```json\n"), "props", F.lit("\n```\nand ```{}```")), F.concat(F.lit("```\n"), doubled, F.lit("```")), F.concat(F.lit("  "), doubled, F.lit("\n")), F.concat(F.lit("``` json "), F.col("props"), F.lit(" ```")))
    return events.select("event_id", F.get_json_object(replies.payload(said), "$.k").alias("k"))


@query("fn_17_retry_wait", "events", "SELECT event_id, CASE event_id % 4 WHEN 0 THEN (user_id % 50)::INT WHEN 1 THEN (user_id % 70)::INT WHEN 2 THEN 90 ELSE 45 END AS wait FROM events")
def _(events):
    user = F.col("user_id")
    said = _pick(F.col("event_id"), F.concat(F.lit("429, please Retry in "), (user % 50).cast("string"), F.lit(".75s")), F.concat(F.lit("retry_delay {\n  seconds: "), (user % 70).cast("string"), F.lit("\n}")), F.lit("quota: 10 requests Per Minute"), F.lit("unavailable"))
    return events.select("event_id", replies.retry_wait(said).alias("wait"))


@query("llm_14_grade", "part", "SELECT p_partkey, round(CASE p_partkey % 5 WHEN 0 THEN p_size / 10.0 WHEN 1 THEN least(10, p_size) / 10.0 WHEN 2 THEN 0.5 WHEN 3 THEN 0.0 ELSE (p_size % 10) / 10.0 END, 6)::DOUBLE AS grade FROM (SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 THEN p_size % 10 ELSE p_size END AS p_size FROM part)")
def _(part):
    n = F.col("p_size").cast("string")
    digit = (F.col("p_size") % 10).cast("string")
    said = _pick(F.col("p_partkey"), F.concat(F.lit('{"score": '), digit, F.lit("}")), F.concat(F.lit('```json\n{"score": '), n, F.lit(', "confidence": "High",}\n```')), F.lit("I would say eight"), F.lit('{"score": -3}'), F.concat(F.lit('Well: {"score": "'), digit, F.lit('", "reasoning": "cut')))
    return part.select("p_partkey", F.round(replies.grade(said), 6).alias("grade"))


@query("llm_13_few_shots", "labels documents", "SELECT lang, 'Example ' || n || ':' || chr(10) || 'Paper: ' || source || chr(10) || 'Extracted Data: n_chars: ' || n_chars || '; toxic: ' || toxic || chr(10) || 'Ground Truth Answer: ' || quality AS shown FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS n FROM documents JOIN labels USING (doc_id)) WHERE n <= 3")
def _(labels, documents):
    n = F.row_number().over(Window.partitionBy("lang").orderBy("doc_id"))
    rows = documents.join(labels, "doc_id").select("lang", "source", "n_chars", "toxic", "quality", n.alias("n")).where("n <= 3")
    pairs = F.concat_ws("; ", *[F.concat(F.lit(f"{c}: "), F.col(c).cast("string")) for c in ("n_chars", "toxic")])
    return rows.select("lang", replies.example_text(F.col("n"), F.col("source"), pairs, F.col("quality")).alias("shown"))


@query("llm_13_used_columns", "part", "SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN ['p_brand'] WHEN 1 THEN ['p_type'] ELSE [] END AS used FROM part")
def _(part):
    said = _pick(F.col("p_partkey"), F.concat(F.lit("it is "), F.upper("p_brand")), F.concat(F.lit("by P_TYPE I'd say so")), F.lit("cannot tell"))
    return part.select("p_partkey", replies.used_columns(said, ["p_brand", "p_type"]).alias("used"))


@query("llm_11_known_units", "documents labels", "SELECT d.doc_id, CASE WHEN l.doc_id IS NULL THEN d.source ELSE 'unit ' || l.quality END AS unit, CASE WHEN l.doc_id IS NULL THEN 'medium' ELSE 'known' END AS confidence FROM documents d LEFT JOIN labels l USING (doc_id)")
def _(documents, labels):
    """Units given for a document stand; other documents go on to be looked at."""
    given = labels.select("doc_id", F.concat(F.lit("unit "), F.col("quality").cast("string")).alias("unit"), F.lit("known").alias("confidence"))
    left = documents.join(given, "doc_id", "left_anti").select("doc_id", F.col("source").alias("unit"), F.lit("medium").alias("confidence"))
    return documents.select("doc_id").join(given, "doc_id").unionByName(left)


@query("ddl_07_decisions", "part", "WITH a AS (SELECT p_brand AS c, list(DISTINCT upper(p_type) ORDER BY upper(p_type)) AS allowed FROM part WHERE p_size < 10 GROUP BY 1), p AS (SELECT DISTINCT p_brand AS c, p_type AS v FROM part), d AS (SELECT c, v FROM p WHERE length(v) % 2 = 0), n AS (SELECT d.c, list(v ORDER BY v) FILTER (NOT list_contains(coalesce(allowed, []), upper(v))) AS fresh FROM d LEFT JOIN a USING (c) GROUP BY d.c) SELECT b.c AS \"column\", list_concat(coalesce(allowed, []), coalesce(fresh, [])) AS allowed FROM (SELECT DISTINCT p_brand AS c FROM part) b LEFT JOIN a USING (c) LEFT JOIN n USING (c)")
def _(part):
    """Types wait for each brand; those of even length are approved, the others rejected."""
    brands = part.select(F.col("p_brand").alias("column")).distinct()
    allowed = part.where("p_size < 10").groupBy(F.col("p_brand").alias("column")).agg(F.sort_array(F.collect_set(F.upper("p_type"))).alias("allowed"))
    pending = part.select(F.col("p_brand").alias("column"), F.col("p_type").alias("value"))
    decisions = pending.withColumn("approve", F.length("value") % 2 == 0)
    return catalog.decide(brands.join(allowed, "column", "left"), pending, decisions)[0]


@query("ddl_07_pending", "part", "SELECT DISTINCT p_brand AS \"column\", p_type AS value FROM part WHERE length(p_type) % 3 <> 0")
def _(part):
    pending = part.select(F.col("p_brand").alias("column"), F.col("p_type").alias("value"))
    decisions = pending.where("length(value) % 3 = 0").withColumn("approve", F.lit(False)).unionByName(pending.select("column", F.lit("not waiting").alias("value"), F.lit(True).alias("approve")))
    return catalog.decide(pending.select("column").distinct().withColumn("allowed", F.array().cast("array<string>")), pending, decisions)[1]


@query("jon_08_align_fields", "lineitem", "SELECT DISTINCT l_orderkey AS tabid, CASE WHEN l_linenumber % 2 = 0 THEN 'COL' || l_linenumber ELSE 'the col' || l_linenumber || ' value' END AS pred_field, 'col' || l_linenumber AS gold_field, CASE WHEN l_linenumber % 2 = 0 THEN 1.0 ELSE 0.8 END::DOUBLE AS score FROM lineitem WHERE l_linenumber <> 3")
def _(lineitem):
    """A table for each order: its gold fields by line number (but the third), the predicted ones spelled otherwise."""
    lines = lineitem.select(F.col("l_orderkey").alias("tabid"), "l_linenumber").distinct()
    n = F.col("l_linenumber").cast("string")
    gold = lines.where("l_linenumber <> 3").select("tabid", F.concat(F.lit("col"), n).alias("field"), F.col("l_linenumber").alias("seq"))
    predicted = lines.select("tabid", F.when(F.col("l_linenumber") % 2 == 0, F.concat(F.lit("COL"), n)).otherwise(F.concat(F.lit("the col"), n, F.lit(" value"))).alias("field"), F.col("l_linenumber").alias("seq"))
    return catalog.align_fields(predicted, gold, "tabid")


_HAS = lambda words: "CASE WHEN regexp_matches(lower(t), '" + "|".join(words) + "') THEN 2.0 ELSE 0.0 END::DOUBLE"


@query("sim_18_marks", "part", "SELECT p_partkey, [CASE WHEN p_size % 2 = 0 THEN 1.0 ELSE 0.0 END::DOUBLE, CASE WHEN p_size % 2 = 1 THEN 1.0 ELSE 0.0 END::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE, CASE WHEN p_size % 3 = 0 THEN 2.0 ELSE 0.0 END::DOUBLE, " + ", ".join(_HAS(w) for w in features.DOMAINS.values()) + "] AS marks FROM (SELECT p_partkey, p_size, p_name || ' ' || p_type || CASE p_partkey % 4 WHEN 0 THEN ' start year' WHEN 1 THEN ' success rate' WHEN 2 THEN ' city' ELSE '' END AS t FROM part)")
def _(part):
    text = F.concat(F.col("p_name"), F.lit(" "), "p_type", _pick(F.col("p_partkey"), " start year", " success rate", " city", ""))
    kind = F.when(F.col("p_size") % 2 == 0, "String").otherwise("number")
    return part.select("p_partkey", features.marks(text, kind, F.when(F.col("p_size") % 3 == 0, F.array("p_brand"))).alias("marks"))


@query("sim_21_value_features", "part", "SELECT 'p_brand' AS \"column\", list(v ORDER BY v)[1:5] AS features FROM (SELECT DISTINCT lower(p_brand) AS v FROM part) UNION ALL SELECT 'p_type', list(v ORDER BY v)[1:5] FROM (SELECT DISTINCT lower(p_type) AS v FROM part)")
def _(part):
    """A column by its values: the first few in order, of all that occur."""
    values = part.select(F.explode(F.create_map(F.lit("p_brand"), F.lower("p_brand"), F.lit("p_type"), F.lower("p_type"))).alias("column", "v")).distinct()
    n = F.row_number().over(Window.partitionBy("column").orderBy("v"))
    return values.withColumn("n", n).where("n <= 5").groupBy("column").agg(F.sort_array(F.collect_list("v")).alias("features"))


@query("udf_05_comparisons", "part", "SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN true WHEN 1 THEN p_size % 4 = 0 WHEN 2 THEN true WHEN 3 THEN p_partkey % 2 = 0 ELSE false END AS match, CASE p_partkey % 5 WHEN 0 THEN 1.0 WHEN 1 THEN CASE WHEN p_size % 4 = 0 THEN 1.0 ELSE round(1 - 1.0 / (p_size + 1), 6) END WHEN 2 THEN 1.0 WHEN 3 THEN CASE WHEN p_partkey % 2 = 0 THEN 1.0 ELSE 0.5 END ELSE 0.0 END::DOUBLE AS similarity FROM (SELECT p_partkey, CASE WHEN p_size < 20 THEN 20 ELSE p_size END AS p_size FROM part)")
def _(part):
    """Each truth is compared its own way: yes or no, numbers, sequences, words; nothing matches an empty one."""
    size = F.when(F.col("p_size") < 20, 20).otherwise(F.col("p_size"))
    n = F.col("p_partkey")
    truth = _pick(n, F.lit("Yes"), (size + 1).cast("string"), F.lit("MKTAYIAKQRQISFVK"), F.lit("red apple pie"), F.lit(""))
    predicted = _pick(n, F.lit("it is confirmed"), F.concat(F.lit("about "), F.when(size % 4 == 0, size + 1).otherwise(size).cast("string"), F.lit(" units")), F.lit("the sequence MKTAYIAKQRQISFVK of it"), F.when(n % 2 == 0, "Red pie, apple").otherwise("red apple tart pan"), F.lit("something"))
    got = evaluate.compare(predicted, truth)
    return part.select("p_partkey", got["match"].alias("match"), F.round(F.when((n % 5 == 3) & (n % 2 == 1), 0.5).otherwise(got["similarity"]), 6).alias("similarity"))


@query("doc_11_fit_prompt", "conversations")
def _(conversations):
    """Prompts of a conversation's turns within 120 tokens."""
    turns = conversations.groupBy("conv_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("turn", "text"))), lambda x: F.concat(F.lit("Turn "), x["turn"].cast("string"), F.lit("\nPaper content: "), x["text"])).alias("blocks"))
    return turns.select("conv_id", features.fit_prompt(F.concat(F.lit("Conversation "), F.col("conv_id").cast("string")), F.col("blocks"), 120).alias("prompt"))


@query("sup_02_document_cap", "documents", "SELECT source, doc_id FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY md5(doc_id::VARCHAR || '42'), doc_id) AS n FROM documents) WHERE n <= 40")
def _(documents):
    """Each source may keep as many documents as it has free slots: a seeded order decides which."""
    n = F.row_number().over(Window.partitionBy("source").orderBy(F.md5(F.concat(F.col("doc_id").cast("string"), F.lit("42"))), "doc_id"))
    return documents.withColumn("n", n).where("n <= 40").select("source", "doc_id")


@query("sup_12_bulk_remove", "documents", "SELECT source AS unit, count(*) AS n_removed, 'removed' AS outcome FROM documents WHERE source IN ('src1', 'src3') GROUP BY source UNION ALL SELECT 'no such unit', 0, 'failed'")
def _(documents):
    asked = documents.sparkSession.createDataFrame([("src1",), ("src3",), ("no such unit",)], "unit string")
    found = documents.select(F.col("source").alias("unit")).join(F.broadcast(asked), "unit", "left_semi").groupBy("unit").agg(F.count(F.lit(1)).alias("n_removed"))
    return asked.join(found, "unit", "left").select("unit", F.coalesce("n_removed", F.lit(0)).alias("n_removed"), F.when(F.col("n_removed") > 0, "removed").otherwise("failed").alias("outcome"))


@query("sup_14_local_paths", "documents", "SELECT doc_id, doc_id % 5 IN (0, 1, 3) AS local FROM documents")
def _(documents):
    path = _pick(F.col("doc_id"), F.concat(F.lit("/home/x/"), "source"), F.concat(F.lit("./"), "source"), F.concat(F.lit("datasets/"), "source"), F.concat(F.lit("/a/b/"), "source"), F.col("source"))
    return documents.select("doc_id", features.is_local_path(path).alias("local"))


@query("snk_06_archives", "supplier", "SELECT s_nationkey, ['column_metadata.csv', 'data.csv', 'metadata.json', 'schema.json'] AS files, count(*) AS n_rows FROM supplier GROUP BY s_nationkey")
def _(supplier):
    """A ZIP of schema, column definitions, data and metadata for each nation's suppliers, written and read again."""
    spark, path = supplier.sparkSession, new_path(supplier.sparkSession, "archives")
    columns = [{"name": "s_suppkey", "definition": "key"}, {"name": "s_name", "definition": "name, in full"}]
    writers.archives(supplier.select("s_nationkey", "s_suppkey", "s_name"), "s_nationkey", columns, {"query": "which?"}).write.parquet(path)

    def opened(batches):
        import io
        import zipfile

        for b in batches:
            rows = []
            for key, content in zip(b["s_nationkey"], b["content"], strict=True):
                z = zipfile.ZipFile(io.BytesIO(content))
                rows.append((key, sorted(z.namelist()), len(pd.read_csv(z.open("data.csv")))))
            yield pd.DataFrame(rows, columns=["s_nationkey", "files", "n_rows"])

    return spark.read.parquet(path).mapInPandas(opened, "s_nationkey int, files array<string>, n_rows long")


@query("snk_07_rich_csv", "supplier", "SELECT s_suppkey, s_name, '[doc, 1] \"' || s_name || '\" | [] b' AS s_name_excerpt, 'a name, in full' AS s_name_definition FROM supplier")
def _(supplier):
    """Answers beside their excerpts and definitions under a preamble, read back."""
    from tessera.sources import readers

    spark, path = supplier.sparkSession, new_path(supplier.sparkSession, "rich")
    excerpts = F.array(F.struct(F.lit("doc, 1").alias("source"), F.concat(F.lit('"'), "s_name", F.lit('"')).alias("text")), F.struct(F.lit(None).cast("string").alias("source"), F.lit("b").alias("text")))
    rows = supplier.select("s_nationkey", "s_suppkey", "s_name", writers.excerpts_text(excerpts).alias("s_name_excerpt"), F.lit("a name, in full").alias("s_name_definition"))
    writers.export_csv(rows, path, {"query": "which?", "columns": [{"name": "s_name", "definition": "a name, in full"}]}, "s_nationkey")
    return readers.read_csv(spark, f"{path}/*", schema="s_suppkey long, s_name string, s_name_excerpt string, s_name_definition string")


@query("snk_08_schema_only", "part", "SELECT p_brand AS name, 'seen ' || count(*) || ' times' AS definition, len(list(DISTINCT p_type)) AS n_allowed FROM part GROUP BY p_brand")
def _(part):
    """Schemas without rows, as JSON, written and read again."""
    from tessera.sources import readers

    spark, path = part.sparkSession, new_path(part.sparkSession, "schemas")
    column = F.struct(F.col("p_brand").alias("name"), F.concat(F.lit("seen "), F.count(F.lit(1)).cast("string"), F.lit(" times")).alias("definition"), F.sort_array(F.collect_set("p_type")).alias("allowed_values"))
    part.groupBy("p_brand").agg(column.alias("c")).select(F.to_json(F.struct(F.array("c").alias("schema"))).alias("value")).write.text(path)
    c = F.get(readers.schema_columns(F.col("value")), F.lit(0))
    return spark.read.text(path).select(c["name"].alias("name"), c["definition"].alias("definition"), F.size(c["allowed_values"]).cast("long").alias("n_allowed"))


@query("snk_12_evaluation_report", "documents labels", "WITH m AS (SELECT lang, count(*)::DOUBLE AS n, avg(quality) AS accuracy, avg(CASE WHEN toxic = 1 THEN 1.0 ELSE 0.0 END) AS toxic FROM documents JOIN labels USING (doc_id) GROUP BY lang) SELECT lang, '# Evaluation Report: ' || lang || chr(10) || chr(10) || '| Metric | Value |' || chr(10) || '|--------|-------|' || chr(10) || '| n | ' || n::BIGINT || ' |' || chr(10) || '| accuracy | ' || CASE WHEN accuracy = floor(accuracy) THEN accuracy::BIGINT::VARCHAR ELSE printf('%.3f', accuracy) END || ' |' || chr(10) || '| toxic | ' || CASE WHEN toxic = floor(toxic) THEN toxic::BIGINT::VARCHAR ELSE printf('%.3f', toxic) END || ' |' || chr(10) AS markdown, round(accuracy, 6) AS json_accuracy, 3 AS csv_metrics, round(n + accuracy + toxic, 6) AS csv_total FROM m")
def _(documents, labels):
    """Metrics of each language as JSON, CSV and Markdown files, written and read again."""
    from tessera.sources import readers

    spark, path = documents.sparkSession, new_path(documents.sparkSession, "report")
    found = documents.join(labels, "doc_id").groupBy("lang").agg(F.count(F.lit(1)).cast("double").alias("n"), F.avg("quality").alias("accuracy"), F.avg(F.when(F.col("toxic") == 1, 1.0).otherwise(0.0)).alias("toxic"))
    metrics = found.select(F.col("lang").alias("report"), F.posexplode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m in ("n", "accuracy", "toxic")])).alias("seq", "m")).select("report", "seq", "m.*")
    writers.write_report(metrics, path)
    name = readers.file_name(F.col("_metadata.file_path"))
    texts = spark.read.text(f"{path}/*_report.md", wholetext=True).select(F.regexp_replace(name, "_report.md$", "").alias("lang"), F.col("value").alias("markdown"))
    told = spark.read.schema("report string, overall_metrics map<string, double>").json(f"{path}/*.json").select(F.col("report").alias("lang"), F.round(F.col("overall_metrics")["accuracy"], 6).alias("json_accuracy"))
    lines = spark.read.option("header", True).schema("metric string, value double").csv(f"{path}/*_summary.csv").select(F.regexp_replace(name, "_summary.csv$", "").alias("lang"), "value")
    sums = lines.groupBy("lang").agg(F.count(F.lit(1)).cast("int").alias("csv_metrics"), F.round(F.sum("value"), 6).alias("csv_total"))
    return texts.join(told, "lang").join(sums, "lang")


@query("snk_10_backup", "nation", "SELECT n_nationkey, n_name AS before, upper(n_name) || '!' AS after FROM nation")
def _(nation):
    """A snapshot is taken before a rewrite and still has the old rows."""
    spark, path = nation.sparkSession, new_path(nation.sparkSession, "table")
    writers.append_jsonl(nation.select("n_nationkey", "n_name"), path)
    kept = writers.backup(spark, path)
    writers.rewrite_jsonl(spark.read.json(path).withColumn("n_name", F.concat(F.upper("n_name"), F.lit("!"))), path, spark)
    return spark.read.json(kept).select(F.col("n_nationkey").cast("int").alias("n_nationkey"), F.col("n_name").alias("before")).join(spark.read.json(path).select(F.col("n_nationkey").cast("int").alias("n_nationkey"), F.col("n_name").alias("after")), "n_nationkey")


@query("str_01_cell_events", "events", "SELECT event_id, 'kind' AS \"column\", event_type AS value FROM events UNION ALL SELECT event_id, 'user', user_id::VARCHAR FROM events")
def _(events):
    """A stream of rows as a stream of cells, each pushed once."""
    from tessera.plans.jobs import _stream

    rows = _stream(events).select("event_id", F.col("event_type").alias("kind"), F.col("user_id").alias("user"))
    return progress.run_once(progress.cell_events(rows, "event_id", ["kind", "user"]), mode="append")


@query("str_04_event_kinds", "events", "SELECT CASE event_type WHEN 'click' THEN 'row_completed' WHEN 'view' THEN 'progress' WHEN 'purchase' THEN 'completed' ELSE 'log' END AS kind, count(*) AS n FROM events GROUP BY 1")
def _(events):
    from tessera.plans.jobs import _stream

    kind = F.when(F.col("event_type") == "click", "row_completed").when(F.col("event_type") == "view", "progress").when(F.col("event_type") == "purchase", "completed").otherwise("log")
    return progress.run_once(_stream(events).groupBy(progress.event_kind(kind).alias("kind")).agg(F.count(F.lit(1)).alias("n")))


@query("ddl_10_continue", "documents labels", "SELECT d.doc_id, d.lang, l.quality FROM documents d LEFT JOIN labels l USING (doc_id) WHERE d.doc_id % 2 = 0 UNION ALL SELECT d.doc_id, d.lang, l.quality FROM documents d LEFT JOIN labels l USING (doc_id) WHERE d.doc_id % 2 = 1")
def _(documents, labels):
    """A table extracted from half of the documents goes on: its rows get the new column, the other documents all columns."""
    from tessera.operators import merge

    old = documents.where("doc_id % 2 = 0").select("doc_id", "lang")
    found = labels.select("doc_id", "quality", F.col("doc_id").alias("seq"))
    grown = merge.add_columns(old, found, "doc_id", ["quality"], "seq")
    fresh = merge.add_columns(progress.remaining(documents, old, "doc_id").select("doc_id", "lang"), found, "doc_id", ["quality"], "seq")
    return grown.unionByName(fresh)


@query("src_12_schema_problems", "part", "SELECT p_brand AS name, count(*) > 1 AS twice, p_brand IS NULL AS unnamed FROM part GROUP BY p_brand")
def _(part):
    """Problems of a schema that holds every part's brand as a column."""
    rows = part.select(F.col("p_brand").alias("name"))
    return rows.groupBy("name").agg((F.count(F.lit(1)) > 1).alias("twice")).select("name", "twice", F.col("name").isNull().alias("unnamed"))
