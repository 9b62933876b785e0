"""Writers: JSON lines, CSV with answers or with evidence, complete exports, archives, snapshots."""

import json
import zipfile
from datetime import UTC, datetime
from io import BytesIO, StringIO

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import MapType

from tessera.functions.cells import unwrap
from tessera.sources import uploads

IDS = ["row_name", "papers", "unit_name"]


def append_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def rewrite_jsonl(df: DataFrame, path: str, spark: SparkSession) -> None:
    """Replace a table by ``df``, which may read it: written beside it, then swapped."""
    new, old = f"{path}.new", f"{path}.old"
    df.write.mode("overwrite").json(new)
    fs = spark._jvm.org.apache.hadoop.fs
    system = fs.Path(path).getFileSystem(spark._jsc.hadoopConfiguration())
    if system.exists(fs.Path(path)):
        system.rename(fs.Path(path), fs.Path(old))
    system.rename(fs.Path(new), fs.Path(path))
    system.delete(fs.Path(old), True)


def snapshot_name(path: str, now: datetime | None = None) -> str:
    return f"{path}.backup-{(now or datetime.now(UTC)):%Y%m%dT%H%M%S}"


def export_columns(columns: list[str], order: list[str] | None = None, ids_first: bool = True) -> list[str]:
    """Identifying columns first, then the requested order, then the others sorted."""
    ids = [c for c in IDS if c in columns] if ids_first else []
    wanted = [c for c in order or [] if c in columns and c not in ids]
    rest = sorted(c for c in columns if c not in ids and c not in wanted and not c.startswith("_"))
    return [*ids, *wanted, *rest]


def answers(df: DataFrame, order: list[str] | None = None, blank: bool = False) -> DataFrame:
    """Answers only, under display headers; absent cells blank where asked for."""
    out = []
    for c in export_columns(df.columns, order):
        value = unwrap(F.col(c).cast("string"))
        out.append((F.coalesce(value, F.lit("")) if blank else value).alias(c.replace("_", " ").title()))
    return df.select(*out)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.option("header", True).option("escape", '"').csv(path)


def write_files(files: DataFrame, path: str, order: list[str] | None = None) -> None:
    """A file for each name of ``files`` (name, text and others): its texts one after the other in ``order``, written by one task.

    Rows stream into their file, so none is gathered; a file is whole or not there, and names are the files' own.
    """
    uploads.register(files.sparkSession)
    dealt = files.repartition("name").sortWithinPartitions("name", *(order or []))
    dealt.select("name", "text").write.format("named_files").mode("append").option("path", path).save()


def csv_cell(value: Column) -> Column:
    """A CSV cell, in quotes where it holds a comma, quote, line break or leading number sign."""
    text = F.coalesce(value.cast("string"), F.lit(""))
    return F.when(text.rlike(r'[,"\n\r]|^#|^\s|\s$'), F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(text)


def export_csv(df: DataFrame, path: str, meta: dict, by: str, order: list[str] | None = None) -> None:
    """A CSV file for each value of the column ``by``, with the preamble of ``meta``, a header and the rows without ``by``, in ``order`` (else that of their columns)."""
    columns = [c for c in df.columns if c != by]
    key = order or [c for c in columns if not isinstance(df.schema[c].dataType, MapType)]
    head = "".join(f"{x}\n" for x in [*preamble(meta), ",".join(columns)])
    name = F.concat(F.coalesce(F.col(by).cast("string"), F.lit("none")), F.lit(".csv"))
    line = F.concat(F.concat_ws(",", *[csv_cell(F.col(c)) for c in columns]), F.lit("\n"))
    rows = df.select(name.alias("name"), F.lit(1).alias("_part"), F.struct(*key).alias("_key"), line.alias("text"))
    heads = rows.select("name").distinct().select("name", F.lit(0).alias("_part"), F.lit(head).alias("text"))
    write_files(heads.unionByName(rows, allowMissingColumns=True), path, ["_part", "_key"])


def write_schema(columns: DataFrame, path: str) -> None:
    """A JSON file for each schema of ``columns`` (schema, seq, name, definition, rationale, allowed, iteration, document): its query artefact with evolution.

    Beside the columns in order stands, for each iteration, what it added and how many columns there were, where each
    column came from, and the share of documents that contributed any.
    """
    column = F.struct("seq", "name", "definition", "rationale", F.col("allowed").alias("allowed_values"), "iteration", F.col("document").alias("source_document"))
    own = columns.groupBy("schema").agg(
        F.transform(F.sort_array(F.collect_list(column)), lambda c: c.dropFields("seq")).alias("columns"),
        (F.count_distinct("document") / F.greatest(F.max("iteration"), F.lit(1))).alias("contribution_rate"),
    )
    steps = F.transform(F.array_distinct(F.transform("columns", lambda c: c["iteration"])), lambda i: F.struct(
        i.alias("iteration"),
        F.transform(F.filter("columns", lambda c: c["iteration"] == i), lambda c: c["name"]).alias("new_columns"),
        F.size(F.filter("columns", lambda c: c["iteration"] <= i)).alias("total_columns"),
        F.array_distinct(F.transform(F.filter("columns", lambda c: c["iteration"] == i), lambda c: c["source_document"])).alias("documents_processed"),
    ))
    sources = F.map_from_entries(F.transform("columns", lambda c: F.struct(c["name"], c["source_document"])))
    body = F.struct(F.col("schema").alias("id"), "columns", F.round("contribution_rate", 6).alias("contribution_rate"), F.struct(F.array_sort(steps).alias("snapshots"), sources.alias("column_sources")).alias("schema_evolution"))
    write_files(own.select(F.concat(F.col("schema").cast("string"), F.lit(".json")).alias("name"), F.concat(F.to_json(body), F.lit("\n")).alias("text")), path)


def write_report(metrics: DataFrame, path: str, title: str = "Evaluation Report") -> None:
    """For each ``report`` of ``metrics`` (report, seq, metric, value) three files: its metrics as JSON, as CSV and as a Markdown table."""
    shown = F.when(F.col("value") == F.floor("value"), F.col("value").cast("long").cast("string")).otherwise(F.format_string("%.3f", "value"))
    rows = metrics.select(F.col("report").cast("string").alias("report"), "seq", "metric", "value", shown.alias("shown"))
    pair = F.struct("seq", "metric", "value")
    as_json = rows.groupBy("report").agg(F.transform(F.sort_array(F.collect_list(pair)), lambda x: F.struct(x["metric"].alias("key"), x["value"].alias("value"))).alias("m")).select(F.concat("report", F.lit(".json")).alias("name"), F.lit(0).alias("seq"), F.concat(F.to_json(F.struct("report", F.map_from_entries("m").alias("overall_metrics"))), F.lit("\n")).alias("text"))
    as_csv = rows.select(F.concat("report", F.lit("_summary.csv")).alias("name"), "seq", F.concat(csv_cell(F.col("metric")), F.lit(","), F.col("value").cast("string"), F.lit("\n")).alias("text"))
    as_table = rows.select(F.concat("report", F.lit("_report.md")).alias("name"), "seq", F.concat(F.lit("| "), "metric", F.lit(" | "), "shown", F.lit(" |\n")).alias("text"))
    reports = rows.select("report").distinct()
    heads = reports.select(F.concat("report", F.lit("_summary.csv")).alias("name"), F.lit(-1).alias("seq"), F.lit("metric,value\n").alias("text")).unionByName(
        reports.select(F.concat("report", F.lit("_report.md")).alias("name"), F.lit(-1).alias("seq"), F.concat(F.lit(f"# {title}: "), "report", F.lit("\n\n| Metric | Value |\n|--------|-------|\n")).alias("text"))
    )
    every = [d.withColumn("seq", F.col("seq").cast("long")) for d in (as_json, as_csv, as_table, heads)]
    write_files(every[0].unionByName(every[1]).unionByName(every[2]).unionByName(every[3]), path, ["seq"])


def excerpts_text(excerpts: Column) -> Column:
    """Excerpts as one text: "[source] text" joined by bars."""
    return F.array_join(F.transform(excerpts, lambda x: F.concat(F.lit("["), F.coalesce(x["source"], F.lit("")), F.lit("] "), x["text"])), " | ")


def complete_rows(df: DataFrame, key: str) -> DataFrame:
    """Each row as one JSON text."""
    return df.select(key, F.to_json(F.struct(*df.columns)).alias("json"))


def preamble(meta: dict) -> list[str]:
    """Comment lines that ``parse_preamble`` reads back."""
    out = [f"# {label}: {meta[k]}" for label, k in (("Session ID", "session_id"), ("Query", "query"), ("Generated", "generated")) if meta.get(k)]
    if meta.get("unit"):
        out.append(f"# Observation Unit: {json.dumps(meta['unit'])}")
    for c in meta.get("columns", []):
        out.append(f"# {c['name']}: {c.get('definition', '')}")
        if c.get("rationale"):
            out.append(f"# Rationale: {c['rationale']}")
        if c.get("allowed_values"):
            out.append(f"# Allowed Values: {', '.join(c['allowed_values'])}")
    return out


def archives(df: DataFrame, by: str, columns: list[dict], meta: dict) -> DataFrame:
    """``by``, content: a ZIP for each value of ``by`` with schema.json, column_metadata.csv, data.csv and metadata.json; each is upload-sized."""
    kind, names = dict(df.dtypes)[by], [c for c in df.columns if c != by]

    def pack(key: tuple, own: pd.DataFrame) -> pd.DataFrame:
        data = BytesIO()
        with zipfile.ZipFile(data, "w", zipfile.ZIP_DEFLATED) as z:
            z.writestr("schema.json", json.dumps({"schema": columns}))
            z.writestr("column_metadata.csv", schema_csv(columns))
            z.writestr("data.csv", own[names].to_csv(index=False))
            z.writestr("metadata.json", json.dumps(meta | {"n_rows": len(own)}))
        return pd.DataFrame({by: [key[0]], "content": [data.getvalue()]})

    return df.groupBy(by).applyInPandas(pack, f"{by} {kind}, content binary")


def markdown_table(df: DataFrame) -> DataFrame:
    """value: each row as a line of a Markdown table."""
    return df.select(F.concat(F.lit("| "), F.concat_ws(" | ", *df.columns), F.lit(" |")).alias("value"))


def backup(spark: SparkSession, path: str, now: datetime | None = None) -> str:
    """Path of a copy of a JSONL table, made by the tasks."""
    kept = snapshot_name(path, now)
    spark.read.text(path).write.text(kept)
    return kept


def schema_csv(columns: list[dict]) -> str:
    import csv

    out = StringIO()
    w = csv.writer(out)
    w.writerow(["name", "definition", "rationale", "allowed_values"])
    for c in columns:
        w.writerow([c["name"], c.get("definition", ""), c.get("rationale", ""), "; ".join(c.get("allowed_values", []))])
    return out.getvalue()
