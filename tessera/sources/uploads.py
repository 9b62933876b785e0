"""Uploaded files as they come: a source that looks at their beginnings, a source of their rows, and a sink of named files.

Files are opened through Arrow's file systems, so paths may lie in any store that Arrow reaches; each is read by one
task, in a stream (uploads end at 100 MB).
"""

import codecs
import csv
import io
import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from fnmatch import fnmatchcase

import pyarrow as pa
from pyarrow import fs as stores
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

#: Bytes of a file's beginning: at first, for each further step, and in all.
FIRST, STEP, MOST_HEAD = 8 << 10, 64 << 10, 256 << 10
#: Bytes of an upload, files of a task that looks at beginnings, rows of a batch.
MOST, FILES, ROWS = 100 << 20, 32, 5000
#: Encodings in the order they are tried, and what may part cells.
ENCODINGS, DELIMITERS = ("utf-8", "latin-1", "cp1252"), ",;\t|"
HEAD = "path string, filename string, format string, n_rows long, n_columns long, schema_only boolean, encoding string, delimiter string, header array<string>, preamble array<string>, errors array<string>, warnings array<string>"


def store(path: str) -> tuple[stores.FileSystem, str]:
    """The file system of a path and the path in it."""
    if "://" in path:
        return stores.FileSystem.from_uri(path)
    return stores.LocalFileSystem(), path.removeprefix("file:")


def listed(path: str) -> list[str]:
    """The files of a folder, those that fit a pattern in it, or one file; names that begin with a dot or underscore are none."""
    system, at = store(path)
    folder, _, last = at.rpartition("/")
    wanted = "*"
    if any(c in last for c in "*?["):
        at, wanted = folder, last
    info = system.get_file_info(at)
    found = system.get_file_info(stores.FileSelector(at)) if info.type == stores.FileType.Directory else [info]
    return sorted(x.path for x in found if x.type == stores.FileType.File and x.base_name[0] not in "._" and fnmatchcase(x.base_name, wanted))


def encoding_of(raw: bytes, whole: bool) -> str:
    """The first encoding that reads these bytes; a character cut off at the end of a beginning is no error."""
    for e in ENCODINGS:
        try:
            codecs.getincrementaldecoder(e)().decode(raw, whole)
            return e
        except UnicodeDecodeError:
            continue
    return ENCODINGS[-1]


def is_comment(line: str) -> bool:
    return line.strip().lstrip('"').startswith("#")


def sniffed(header: str) -> str:
    """What parts the cells of a header: the candidate that comes most often outside quotes, a comma where none does."""
    bare = "".join(header.split('"')[::2])
    best = max(DELIMITERS, key=bare.count)
    return best if bare.count(best) else ","


@dataclass
class Files(InputPartition):
    paths: list[str]


class Heads(DataSourceReader):
    """A row for each file, from its beginning: 8 KB, then 64 KB more until a header is there, 256 KB at most; JSON that is no list of lines is read whole."""

    def __init__(self, path: str, most: int):
        self.path, self.most = path, most

    def partitions(self) -> list[Files]:
        found = listed(self.path)
        return [Files(found[i : i + FILES]) for i in range(0, len(found), FILES)] or [Files([])]

    def read(self, partition: Files) -> Iterator[tuple]:
        system, _ = store(self.path)
        for path in partition.paths:
            name = path.rsplit("/", 1)[-1]
            size = system.get_file_info(path).size
            errors = [f"File size exceeds {self.most >> 20}MB limit"] if size > self.most else []
            low = name.lower()
            kind = "csv" if low.endswith(".csv") else "json" if low.endswith((".json", ".jsonl")) else None
            seen: dict = {"errors": errors, "warnings": []}
            if kind is None:
                errors.append("Unsupported file format")
            else:
                with system.open_input_stream(path) as f:
                    try:
                        (self._csv if kind == "csv" else self._lines if low.endswith(".jsonl") else self._json)(f, size, seen)
                    except (ValueError, csv.Error) as e:
                        errors.append(f"Invalid {kind.upper()}: {e}")
            yield path, name, kind, seen.get("n_rows"), seen.get("n_columns"), seen.get("schema_only", False), seen.get("encoding"), seen.get("delimiter"), seen.get("header"), seen.get("preamble"), errors, seen["warnings"]

    def _csv(self, f, size: int, seen: dict) -> None:
        raw, step = b"", FIRST
        while len(raw) < MOST_HEAD:
            chunk = f.read(step)
            raw, step = raw + chunk, min(2 * step, STEP)
            whole = not chunk or len(raw) >= size
            encoding = encoding_of(raw, whole)
            lines = raw.decode(encoding, "ignore").removeprefix("﻿").split("\n")
            lines = lines if whole else lines[:-1]  # the last line may go on
            at = next((i for i, x in enumerate(lines) if x.strip() and not is_comment(x)), None)
            if at is not None or whole:
                break
        else:
            seen["errors"].append(f"CSV metadata exceeds {MOST_HEAD >> 10}KB")
            return
        if at is None:
            seen["errors"].append("CSV file must have at least a header row")
            return
        comments = [x.strip().strip('"') for x in lines[:at] if x.strip()]
        delimiter = sniffed(lines[at])
        rows = [r for r in csv.reader(io.StringIO("\n".join(lines[at:]), newline=""), delimiter=delimiter) if any(c.strip() for c in r)]
        seen |= {"encoding": encoding, "delimiter": delimiter, "header": rows[0], "preamble": comments, "n_columns": len(rows[0]), "n_rows": len(rows) - 1, "schema_only": len(rows) == 1 and whole}
        if comments:
            seen["warnings"].append(f"Detected {len(comments)} metadata comment lines")
        if seen["schema_only"]:
            seen["warnings"].append("Schema-only CSV detected (no data rows)")
        if not whole:
            seen["warnings"].append("Rows are those of the beginning")

    def _lines(self, f, size: int, seen: dict) -> None:
        raw = f.read(FIRST)
        lines = raw.decode("utf-8", "ignore").strip().split("\n")
        if not lines[0].strip():
            raise ValueError("no line")
        if len(raw) < size and len(lines) > 1:
            lines = lines[:-1]
        first = json.loads(lines[0])
        seen |= {"encoding": "utf-8", "n_rows": len(lines), "header": list(first), "n_columns": len(first)}

    def _json(self, f, size: int, seen: dict) -> None:
        data = json.loads(f.read().decode("utf-8"))
        seen["encoding"] = "utf-8"
        if isinstance(data, list):
            head = data[0] if data and isinstance(data[0], dict) else None
            seen |= {"n_rows": len(data), "n_columns": len(head) if head is not None else int(bool(data)), "header": list(head or [])}
        elif isinstance(data, dict) and isinstance(data.get("data"), list):
            schema = data.get("schema")
            columns = schema.get("columns", []) if isinstance(schema, dict) else ((data["data"] or [{}])[0].get("data") or {})
            seen["warnings"].append("Complete export")
            seen |= {"n_rows": len(data["data"]), "n_columns": len(columns)}
        elif isinstance(data, dict) and "schema" in data:
            seen["warnings"].append("Schema")
            seen |= {"n_columns": len(data["schema"]), "schema_only": True}
        elif isinstance(data, dict):
            seen |= {"n_rows": 1, "n_columns": len(data), "header": list(data)}


class Rows(DataSourceReader):
    """The rows of CSV files, by the names in each file's own header: a file is a partition.

    Comments stand before the header only and blank lines nowhere; quotes may hold line breaks and delimiters. A column
    that a file lacks is null there, as is an empty cell without quotes or with; longer rows lose what no header names.
    """

    def __init__(self, path: str, schema: StructType, encoding: str | None):
        self.path, self.names, self.encoding = path, schema.fieldNames(), encoding

    def partitions(self) -> list[Files]:
        return [Files([p]) for p in listed(self.path)] or [Files([])]

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        system, _ = store(self.path)
        for path in partition.paths:
            encoding = self.encoding
            if not encoding:
                with system.open_input_stream(path) as f:
                    encoding = "utf-8"
                    decoder = codecs.getincrementaldecoder("utf-8")()
                    try:
                        while chunk := f.read(1 << 20):
                            decoder.decode(chunk)
                        decoder.decode(b"", True)
                    except UnicodeDecodeError:
                        encoding = ENCODINGS[1]
            with system.open_input_stream(path) as f:
                yield from self._rows(io.TextIOWrapper(f, "utf-8-sig" if encoding.lower() in ("utf-8", "utf8") else encoding, newline=""))

    def _rows(self, lines: io.TextIOWrapper) -> Iterator[pa.RecordBatch]:
        for header in lines:
            if header.strip() and not is_comment(header):
                break
        else:
            return

        def rest():
            yield header
            yield from lines

        rows = csv.reader(rest(), delimiter=sniffed(header))
        place = {n.strip(): i for i, n in reversed(list(enumerate(next(rows))))}
        at, held = [place.get(n) for n in self.names], []
        for r in rows:
            if not any(c.strip() for c in r):
                continue
            held.append([r[i] if i is not None and i < len(r) and r[i] != "" else None for i in at])
            if len(held) == ROWS:
                yield self._batch(held)
                held = []
        if held:
            yield self._batch(held)

    def _batch(self, rows: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*rows)], names=self.names)


class UploadHeads(DataSource):
    @classmethod
    def name(cls) -> str:
        return "upload_heads"

    def schema(self) -> str:
        return HEAD

    def reader(self, schema: StructType) -> Heads:
        return Heads(self.options["path"], int(self.options.get("most", MOST)))


class UploadRows(DataSource):
    @classmethod
    def name(cls) -> str:
        return "upload_rows"

    def reader(self, schema: StructType) -> Rows:
        return Rows(self.options["path"], schema, self.options.get("encoding"))


@dataclass
class Written(WriterCommitMessage):
    paths: list[str]


class NamedFilesWriter(DataSourceWriter):
    """Texts (name, text), those of one name side by side in a task, each as a file of its name.

    A task writes beside the place and moves its finished files there; where it fails it leaves nothing, and where
    another fails the job takes back what was moved. So a file is whole or not there.
    """

    def __init__(self, path: str):
        self.path = path

    def write(self, iterator: Iterator) -> Written:
        system, root = store(self.path)
        beside, done, names, out = f"{root}/.{uuid.uuid4().hex}", [], [], None
        system.create_dir(beside, recursive=True)
        try:
            for row in iterator:
                if not names or names[-1] != row.name:
                    if out:
                        out.close()
                    if row.name in names or "/" in row.name:
                        raise ValueError(f"{row.name} is no name of a file of this task")
                    names.append(row.name)
                    out = system.open_output_stream(f"{beside}/{row.name}")
                out.write((row.text or "").encode())
            if out:
                out.close()
            for n in names:
                system.move(f"{beside}/{n}", f"{root}/{n}")
                done.append(f"{root}/{n}")
        except BaseException:
            for p in done:
                system.delete_file(p)
            raise
        finally:
            system.delete_dir(beside)
        return Written(done)

    def commit(self, messages: list) -> None:
        return None

    def abort(self, messages: list) -> None:
        system, _ = store(self.path)
        for m in messages:
            for p in m.paths if m else []:
                system.delete_file(p)


class NamedFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "named_files"

    def schema(self) -> str:
        return "name string, text string"

    def writer(self, schema: StructType, overwrite: bool) -> NamedFilesWriter:
        return NamedFilesWriter(self.options["path"])


def register(spark: SparkSession) -> None:
    for source in (UploadHeads, UploadRows, NamedFiles):
        spark.dataSource.register(source)
