"""Queries on the history of schemas and on runs as they go."""

from pyspark.sql import functions as F

from tessera.operators import history
from tessera.plans.registry import query
from tessera.sources.scratch import new_path
from tessera.streaming import progress


def _schema(orders):
    """A schema of three columns for each customer with orders, and their orders as edits."""
    customers = orders.select(F.col("o_custkey").alias("schema")).distinct()
    place = F.explode(F.array(*[F.lit(i) for i in range(3)])).alias("seq")
    columns = customers.select("schema", place).select("schema", "seq", F.concat(F.lit("col"), F.col("seq").cast("string")).alias("name"), F.lit("first").alias("definition"), F.lit("because").alias("rationale"), F.array(F.lit("a"), F.lit("b")).alias("allowed"))
    k, text = F.col("o_orderkey"), F.col("o_orderkey").cast("string")
    edits = orders.select(
        F.col("o_custkey").alias("schema"), (k + 1).alias("at"), F.concat(F.lit("col"), (k % 4).cast("string")).alias("column"),
        F.when(k % 5 == 0, F.concat(F.lit("col"), ((k + 1) % 4).cast("string"))).alias("new_name"), F.when(k % 3 == 0, F.concat(F.lit("by "), text)).alias("definition"),
        F.when(k % 7 == 0, "other").alias("rationale"), F.when(k % 11 == 0, F.array().cast("array<string>")).when(k % 11 == 1, F.array(F.col("o_orderpriority"))).alias("allowed"),
    )
    return columns, edits


@query("ddl_01_versions", "orders")
def _(orders):
    """Every version of every customer's columns."""
    return history.versions(*_schema(orders))


@query("ddl_01_as_of", "orders")
def _(orders):
    """Each customer's schema at the middle of the table's orders."""
    columns, edits = _schema(orders)
    middle = orders.agg(F.floor(F.max("o_orderkey") / 2).alias("at"))
    return history.as_of(history.versions(columns, edits), columns.select("schema").distinct().join(F.broadcast(middle)))


@query("ddl_08_changes", "orders")
def _(orders):
    """What changed since a baseline of the first two columns; even customers' last columns have data."""
    columns, edits = _schema(orders)
    found = history.versions(columns, edits)
    baselines = columns.where("seq < 2 AND schema % 5 <> 0").select("schema", F.lit(0).alias("at"), F.col("seq").alias("id"))
    return history.changes_since(found, baselines, found.where("id = 2 AND schema % 2 = 0").select("schema", "name"))


def _files(events, *columns):
    """Four files of events, one after the other, as a stream of a file a trigger."""
    spark, path = events.sparkSession, new_path(events.sparkSession, "source")
    kept = events.select("event_id", *columns)
    for k in range(4):  # the order of files is that of their writing
        kept.where(F.col("event_id") % 4 == k).coalesce(1).write.mode("append").parquet(path)
    return progress.events(spark, path, kept.schema, files=1)


@query("str_03_completed", "events", "SELECT min(event_id % 4) AS batch, user_id AS document FROM events GROUP BY user_id")
def _(events):
    """Documents newly completed in each trigger."""
    spark = events.sparkSession
    out, state = new_path(spark, "completed"), new_path(spark, "state")
    progress.deltas(_files(events, "user_id").select(F.col("user_id").alias("document")), "document", out, state)
    return progress.read_batches(spark, out).select(F.col("batch").cast("long").alias("batch"), "document")


@query("str_03_progress", "events", "WITH f AS (SELECT user_id, min(event_id % 4) AS b FROM events GROUP BY user_id), n AS (SELECT b AS batch, count(*) AS newly FROM f GROUP BY b) SELECT batch, newly, sum(newly) OVER (ORDER BY batch)::BIGINT AS completed, (SELECT count(DISTINCT user_id) FROM events) AS total FROM n")
def _(events):
    """How many documents each trigger completed, and how many there were by then, of all."""
    spark = events.sparkSession
    out, state = new_path(spark, "completed"), new_path(spark, "state")
    progress.deltas(_files(events, "user_id").select(F.col("user_id").alias("document")), "document", out, state)
    total = events.agg(F.count_distinct("user_id").alias("total"))
    return progress.counts(progress.read_batches(spark, out)).withColumn("batch", F.col("batch").cast("long")).join(F.broadcast(total))


@query("str_06_stop", "events", "SELECT 'stopped' AS run, 2 AS batches, count(*) AS n FROM events WHERE event_id % 4 < 2 UNION ALL SELECT 'resumed', 2, count(*) FROM events")
def _(events):
    """A run that is stopped after two batches keeps what it has, and another goes on from there."""
    spark = events.sparkSession
    out, state, stream = new_path(spark, "rows"), new_path(spark, "state"), _files(events, "user_id")
    first = progress.run_until(stream, out, state, lambda n: n >= 2)
    kept = spark.read.parquet(out).agg(F.lit("stopped").alias("run"), F.lit(first).alias("batches"), F.count(F.lit(1)).alias("n")).collect()  # before the run goes on
    second = progress.run_until(stream, out, state, lambda n: False)
    return spark.createDataFrame(kept, "run string, batches int, n long").unionByName(spark.read.parquet(out).agg(F.lit("resumed").alias("run"), F.lit(second).alias("batches"), F.count(F.lit(1)).alias("n")))


@query("snk_11_snapshots", "events", "SELECT b AS batch, event_type AS schema, count(DISTINCT user_id % 50) AS columns FROM events, (VALUES (0), (1), (2), (3)) AS v(b) WHERE event_id % 4 <= b GROUP BY ALL")
def _(events):
    """The schemas known after each batch, a snapshot a batch."""
    spark = events.sparkSession
    out, state = new_path(spark, "snapshots"), new_path(spark, "state")
    found = _files(events, "user_id", "event_type").select(F.col("event_type").alias("schema"), F.concat(F.lit("col"), (F.col("user_id") % 50).cast("string")).alias("column"))
    progress.snapshots(found, ["schema", "column"], out, state)
    return progress.read_batches(spark, out).groupBy(F.col("batch").cast("int").alias("batch"), "schema").agg(F.count(F.lit(1)).alias("columns"))
