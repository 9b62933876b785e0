"""Streams: progress of a running extraction, event-time windows, suggested values as state."""

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.sources.scratch import new_path


def events(spark: SparkSession, path: str, schema, files: int | None = None) -> DataFrame:
    """Files of a folder as they come, all that are there or ``files`` of them in a batch."""
    reader = spark.readStream.schema(schema)
    return (reader.option("maxFilesPerTrigger", files) if files else reader).parquet(path)


def completed(stream: DataFrame, document: str, at: str, late: str = "1 day") -> DataFrame:
    """Each document once, when its first row comes."""
    return stream.withWatermark(at, late).dropDuplicatesWithinWatermark([document])


def _to_the_end(df: DataFrame, put: Callable[[DataFrame, int], None], state: str) -> None:
    df.writeStream.foreachBatch(put).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()


def _batch(out: str, number: int) -> str:
    return f"{out}/batch={number:09d}"


def read_batches(spark: SparkSession, out: str) -> DataFrame:
    """What batches left in ``out``, with their numbers."""
    return spark.read.option("basePath", out).parquet(f"{out}/batch=*")


def deltas(stream: DataFrame, document: str, out: str, state: str) -> None:
    """The documents newly completed in each batch, in a folder of the batch: each document once, when its first row comes.

    State keeps the names of completed documents. A batch that runs again after a failure replaces its folder; a later
    run goes on from ``state``. Rows without a document complete none.
    """
    once = stream.where(F.col(document).isNotNull()).dropDuplicates([document])
    _to_the_end(once, lambda rows, n: rows.select(document).write.mode("overwrite").parquet(_batch(out, n)), state)


def counts(batches: DataFrame) -> DataFrame:
    """batch, newly, completed of deltas: a row for each batch that completed any, so few rows."""
    each = batches.groupBy("batch").agg(F.count(F.lit(1)).alias("newly"))
    return each.withColumn("completed", F.sum("newly").over(Window.orderBy("batch")))


def snapshots(stream: DataFrame, key: list[str], out: str, state: str) -> None:
    """All distinct ``key`` known after each batch, in a folder of the batch: what is known so far and what is new.

    A batch takes the snapshot before it, so that a run that stops has a whole one; a batch that runs again replaces its own.
    """
    spark = stream.sparkSession

    def put(rows: DataFrame, n: int) -> None:
        found = rows.select(*key)
        if n:
            found = found.unionByName(spark.read.schema(found.schema).parquet(_batch(out, n - 1)))
        found.distinct().write.mode("overwrite").parquet(_batch(out, n))

    _to_the_end(stream, put, state)


def tumbling(stream: DataFrame, at: str, key: str, width: str, late: str) -> DataFrame:
    return stream.withWatermark(at, late).groupBy(F.window(at, width), key).agg(F.count(F.lit(1)).alias("n"))


def sliding(stream: DataFrame, at: str, key: str, width: str, step: str, late: str) -> DataFrame:
    return stream.withWatermark(at, late).groupBy(F.window(at, width, step), key).agg(F.count(F.lit(1)).alias("n"))


def sessions(stream: DataFrame, at: str, key: str, gap: str, late: str) -> DataFrame:
    return stream.withWatermark(at, late).groupBy(F.session_window(at, gap), key).agg(F.count(F.lit(1)).alias("n"))


def suggested(stream: DataFrame) -> DataFrame:
    """Running number of documents for each value of (column, value, document); state keeps each such triple once."""
    return stream.dropDuplicates(["column", "value", "document"]).groupBy("column", "value").agg(F.count(F.lit(1)).alias("documents"))


#: Kinds of events that a run reports.
EVENT_KINDS = ["progress", "log", "error", "completed", "schema_updated", "schema_completed", "row_completed", "reprocessing_started", "reprocessing_completed"]


def event_kind(kind: Column) -> Column:
    """A kind of event; others are logs."""
    return F.when(kind.isin(EVENT_KINDS), kind).otherwise("log")


def cell_events(rows: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """key, column, value: each cell of a stream of rows as an event of its own."""
    cells = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns])
    return rows.select(key, F.explode(cells).alias("c")).select(key, "c.*")


def run_until(df: DataFrame, out: str, state: str, should_stop: Callable[[int], bool]) -> int:
    """Append a stream's rows to ``out`` batch by batch until ``should_stop(batches)`` or its end; what was written stays, a later run goes on from ``state``.

    Returns the number of batches. The batch under way is finished, and the next one is not begun.
    """
    done: list[int] = []

    def put(batch: DataFrame, number: int) -> None:
        if not (done and should_stop(len(done))):
            batch.write.mode("append").parquet(out)
            done.append(number)
        else:
            raise StopIteration

    query = df.writeStream.foreachBatch(put).option("checkpointLocation", state).trigger(availableNow=True).start()
    try:
        query.awaitTermination()
    except Exception:
        if not should_stop(len(done)):
            raise
        query.stop()
    return len(done)


def run_once(df: DataFrame, mode: str = "complete") -> DataFrame:
    """All that is there now through the stream, written to the shared folder and read as a table."""
    spark = df.sparkSession
    out, state = new_path(spark, "stream"), new_path(spark, "state")
    if mode == "append":
        query = df.writeStream.outputMode(mode).format("parquet").option("path", out).option("checkpointLocation", state).trigger(availableNow=True).start()
    else:
        def put(batch: DataFrame, _: int) -> None:
            batch.write.mode("overwrite").parquet(out)

        query = df.writeStream.outputMode(mode).foreachBatch(put).option("checkpointLocation", state).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.parquet(out)


def watch(df: DataFrame, on_rows: Callable[[DataFrame, int], None], state: str, every: str = "2 seconds"):
    """Hand each batch of new rows to ``on_rows``; the checkpoint replays what no consumer has seen. Stop with ``stop()``."""
    return df.writeStream.foreachBatch(on_rows).option("checkpointLocation", state).trigger(processingTime=every).start()


def remaining(documents: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Documents that a resumed run has still to do."""
    return documents.join(done.select(key).distinct(), key, "left_anti")
