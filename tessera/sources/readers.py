"""Readers: text scans, JSON in several shapes, CSV with a preamble, tables of several locations."""

import json
import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from tessera.sources import uploads
from tessera.sources.scratch import new_path

#: Names of system files.
SYSTEM_FILES = r"^(\..*|Thumbs\.db|desktop\.ini|~\$.*|\._.*|\.tmp.*)$"
TEXT_FILES = "*.{txt,md,html,htm,TXT,MD,HTML,HTM}"


def file_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)$", 1)


def is_system(name: Column) -> Column:
    return name.rlike(SYSTEM_FILES)


def scan_texts(spark: SparkSession, roots: list[str], seed: int | None = None) -> DataFrame:
    """filename, text of all text files below the roots; in an order by hash where a seed is given."""
    df = spark.read.text(roots, wholetext=True, recursiveFileLookup=True, pathGlobFilter=TEXT_FILES).select(file_name(F.col("_metadata.file_path")).alias("filename"), F.col("value").alias("text"))
    df = df.where(~is_system(F.col("filename")))
    return df if seed is None else df.orderBy(F.xxhash64("filename", F.lit(seed)), "filename")


def scan_files(spark: SparkSession, directories: list[str]) -> DataFrame:
    """directory, filename, content of any regular file of the directories themselves."""
    df = spark.read.format("binaryFile").load(directories)
    return df.select(F.regexp_extract("path", r"^(.*)/[^/]*$", 1).alias("directory"), file_name(F.col("path")).alias("filename"), "content").where(~is_system(F.col("filename")))


def as_text(content: Column, encodings: tuple[str, ...] = ("UTF-8", "ISO-8859-1")) -> Column:
    """Bytes as text: the first encoding that fits, without those that don't."""
    return F.when(F.is_valid_utf8(content.cast("string")), F.decode(content, encodings[0])).otherwise(F.decode(content, encodings[-1]))


def read_jsonl(spark: SparkSession, path: str | list[str], schema: StructType | str | None = None, strict: bool = True) -> DataFrame:
    """A JSON object for each line; blank lines are skipped, malformed ones raise or, unless ``strict``, go."""
    reader = spark.read.option("mode", "FAILFAST" if strict else "DROPMALFORMED")
    return (reader.schema(schema) if schema else reader).json(path)


def read_json(spark: SparkSession, path: str, rows: str = "data") -> DataFrame:
    """Rows of JSON files, whatever each holds: a list, an export with its rows in a list under ``rows`` (whatever else it holds), or one object.

    Each file is decided by what it holds itself. Of rows the columns of all files are taken; an export without rows has none.
    """
    raw = spark.read.text(path, wholetext=True).select(F.try_parse_json("value").alias("v"))
    under = F.try_variant_get("v", f"$.{rows}", "array<variant>")
    kind = F.schema_of_variant("v")
    inner = F.when(kind.startswith("ARRAY"), F.try_variant_get("v", "$", "array<variant>")).when(under.isNotNull(), under).otherwise(F.array("v"))
    found = raw.select(F.explode(inner).alias("r")).select(F.to_json("r").alias("json")).where(F.col("json").startswith("{"))
    kept = new_path(spark, "rows")
    found.write.text(kept)  # a row a line, read again by the columns of all
    return spark.read.json(kept)


def heads(spark: SparkSession, path: str, most: int = uploads.MOST) -> DataFrame:
    """What the beginnings of uploads say, a row for each file of a folder: format, header, delimiter, encoding, preamble, rows, errors, warnings."""
    uploads.register(spark)
    return spark.read.format("upload_heads").option("most", most).load(path)


def read_csv(spark: SparkSession, path: str, encoding: str | None = None, rename: dict[str, str] | None = None, schema: str | None = None) -> DataFrame:
    """A CSV file with header, or a folder of them; comments stand before the header only, blank lines nowhere.

    Each file is read by its own header, delimiter and encoding (UTF-8, else Latin-1, unless one is given), so columns
    of several files meet by name. Later lines that look like a comment or the header are rows; cells may hold line
    breaks. Types are those of ``schema``, else of the narrowest of int, long, double, boolean that all cells spell; cells
    that don't spell a given type are null.
    """
    uploads.register(spark)
    if schema:
        kinds = spark.createDataFrame([], schema).schema
        names = kinds.fieldNames()
    else:
        found = heads(spark, path).where("header is not null").select(F.posexplode("header").alias("i", "name")).groupBy(F.trim("name").alias("name")).agg(F.min("i").alias("i"))
        names = [r.name for r in found.where("name <> ''").orderBy("i", "name").collect()]  # the columns of all files
        if not names:
            return spark.createDataFrame([], StructType())
    reader = spark.read.format("upload_rows").schema(StructType([StructField(n, StringType()) for n in names]))
    rows = (reader.option("encoding", encoding) if encoding else reader).load(path)
    if schema:
        typed = [F.col(f"`{f.name}`").try_cast(f.dataType).alias(f.name) for f in kinds]
    else:
        order = ["int", "bigint", "double", "boolean"]
        fits = rows.agg(*[F.coalesce(F.min(F.when(F.col(f"`{n}`").isNotNull(), F.col(f"`{n}`").try_cast(k).isNotNull())), F.lit(False)).alias(f"{i}_{k}") for i, n in enumerate(names) for k in order])
        told = fits.first()
        typed = [F.col(f"`{n}`").cast(next((k for k in order if told[f"{i}_{k}"]), "string")).alias(n) for i, n in enumerate(names)]
    return rows.select(*typed).withColumnsRenamed(rename or {})


def preamble_lines(spark: SparkSession, path: str) -> list[str]:
    """Comment lines before the first other line of a file."""
    found = heads(spark, path).where(F.size("preamble") > 0).select("preamble").first()
    return list(found.preamble) if found else []


def validate_files(spark: SparkSession, path: str, most: int = uploads.MOST) -> DataFrame:
    """filename, format, n_rows, n_columns, schema_only, errors, warnings of uploads: by name, size and what their beginnings hold.

    Rows are those of the first 8 KB that hold a header (all, where the file is that short); a quoted line break is no
    row's end, and the delimiter is what the header shows.
    """
    return heads(spark, path, most).select("filename", "format", "n_rows", "n_columns", "schema_only", "errors", "warnings")


def schema_columns(text: Column) -> Column:
    """Columns (name, definition, rationale, allowed_values) of a schema's JSON: a list, or one under schema or columns; column or name, explanation or rationale. Bad text has none."""
    entry = "array<struct<column: string, name: string, definition: string, explanation: string, rationale: string, allowed_values: array<string>>>"
    listed = F.when(F.trim(text).startswith("["), F.from_json(text, entry))
    under = F.from_json(F.when(F.trim(text).startswith("{"), text), f"struct<schema: {entry}, columns: {entry}>")
    found = F.coalesce(listed, under["schema"], under["columns"], F.array().cast(entry.replace(": ", ":")))
    named = F.transform(found, lambda c: F.struct(F.coalesce(c["column"], c["name"]).alias("name"), F.coalesce(c["definition"], F.lit("")).alias("definition"), F.coalesce(c["explanation"], c["rationale"], F.lit("")).alias("rationale"), F.coalesce(c["allowed_values"], F.array().cast("array<string>")).alias("allowed_values")))
    return F.filter(named, lambda c: F.coalesce(c["name"], F.lit("")) != "")


def parse_preamble(lines: list[str]) -> dict:
    """What comment lines say: session, query, unit, generated, columns with definition, rationale and allowed values, sources."""
    out: dict = {"columns": []}
    fields = {"session id": "session_id", "query": "query", "generated": "generated", "schema creation model": "schema_model", "value extraction model": "value_model"}
    for line in lines:
        text = line.strip().strip('"').lstrip("#").strip()
        key, _, value = text.partition(":")
        name, value = key.strip().lower(), value.strip()
        if not value and not text:
            continue
        if name in fields:
            out[fields[name]] = value
        elif name == "observation unit":
            try:
                out["unit"] = json.loads(value)
            except ValueError:
                out["unit"] = {"name": value}
        elif name == "column sources":
            out["sources"] = dict(p.split("=", 1) for p in re.split(r"\s*;\s*", value) if "=" in p)
        elif name.startswith("iteration"):
            out.setdefault("evolution", []).append(value)
        elif name == "rationale" and out["columns"]:
            out["columns"][-1]["rationale"] = value
        elif name == "allowed values" and out["columns"]:
            out["columns"][-1]["allowed_values"] = [v.strip() for v in value.split(",") if v.strip()]
        elif value:
            out["columns"].append({"name": key.strip(), "definition": value})
    return out


def union_locations(spark: SparkSession, paths: list[str], schema: str) -> DataFrame:
    """JSONL tables of several places, in order; places that don't exist are left out."""
    found = []
    fs = spark._jvm.org.apache.hadoop.fs
    for i, p in enumerate(paths):
        path = fs.Path(p)
        if path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
            found.append(read_jsonl(spark, p, schema, strict=False).withColumn("file_ord", F.lit(i)))
    if not found:
        return spark.createDataFrame([], schema).withColumn("file_ord", F.lit(0))
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), found)


def read_eval_tables(spark: SparkSession, path: str) -> DataFrame:
    """tabid, table (variant) of JSONL whose tables are JSON texts, fenced or not; bad lines go."""
    inner = F.regexp_replace(F.get_json_object("value", "$.table"), r"^```(?:json)?\s*|\s*```$", "")
    df = spark.read.text(path).select(F.get_json_object("value", "$.tabid").alias("tabid"), F.try_parse_json(inner).alias("table"))
    return df.where(F.col("tabid").isNotNull() & F.col("table").isNotNull())
