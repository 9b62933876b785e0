"""Extraction of cells by a language model behind a small interface, with an offline stand-in that follows rules."""

import json
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.cells import placeholder
from tessera.functions.similarity import ground
from tessera.operators.catalog import ColumnDef, TableSchema, Unit


class Model(Protocol):
    def generate(self, prompt: str) -> str: ...


@dataclass
class RuleModel:
    """Offline stand-in: answers ``key: value`` lines and proposes such keys as columns."""

    calls: list[int] = field(default_factory=list)

    def generate(self, prompt: str) -> str:
        self.calls.append(len(prompt))
        request, _, text = prompt.partition("\n---\n")
        task = json.loads(request)
        found = {k.strip().lower(): v.strip() for k, v in re.findall(r"(?m)^([A-Za-z_][\w ]{1,40}):\s*(.+)$", text)}
        if task["task"] == "columns":
            return json.dumps({"columns": [{"name": k.replace(" ", "_"), "definition": f"value of {k}", "rationale": "stated"} for k in sorted(found)]})
        if task["task"] == "units":
            return json.dumps({"observation_units": [{"unit_name": n, "confidence": "high"} for n in re.findall(r"(?m)^# (.+)$", text)]})
        out = {}
        for c in task["columns"]:
            if (v := found.get(c.lower().replace("_", " "), found.get(c.lower()))) is not None:
                out[c] = {"answer": v, "excerpts": [v]}
        return json.dumps(out)


def parse_reply(text: str) -> dict:
    """The JSON object in a reply: plain, fenced, the last one in prose, or cut short."""
    text = text.replace("“", '"').replace("”", '"')
    fenced = re.search(r"```(?:json)?\s*(.*?)```", text, re.S)
    for candidate in ([fenced[1]] if fenced else []) + [text, *re.findall(r"\{.*\}", text, re.S)]:
        for attempt in (candidate, re.sub(r",\s*([}\]])", r"\1", candidate), candidate + '"}' * 1, candidate + "}", candidate + "}}"):
            try:
                if isinstance(found := json.loads(attempt), dict):
                    return found
            except ValueError:
                continue
    return {}


def discovery_prompt(mode: Column, question: Column, text: Column) -> Column:
    """What discovery shows: question and documents, or one of them alone, by mode (STANDARD, DOCUMENT_ONLY, QUERY_ONLY)."""
    asked = F.when(mode != "DOCUMENT_ONLY", F.concat(F.lit("Question: "), question))
    shown = F.when(mode != "QUERY_ONLY", F.concat(F.lit("Documents:\n"), text))
    return F.concat_ws("\n\n", asked, shown)


def missing_cells(docs: DataFrame, found: DataFrame, columns: list[str]) -> DataFrame:
    """doc_id, column of every cell that ``found`` (doc_id, column) lacks: what the next stage asks for."""
    wanted = docs.select("doc_id", F.explode(F.array(*map(F.lit, columns))).alias("column"))
    return wanted.join(found.select("doc_id", "column").distinct(), ["doc_id", "column"], "left_anti")


def first_answers(attempts: DataFrame, most: int) -> DataFrame:
    """doc_id, column, answer, attempt: of the first ``most`` attempts (doc_id, column, attempt, answer) at a cell the first that says something."""
    said = attempts.where((F.col("attempt") <= most) & (F.coalesce("answer", F.lit("")) != "") & ~placeholder(F.coalesce("answer", F.lit("")), F.lit(0)))
    return said.groupBy("doc_id", "column").agg(F.min_by("answer", "attempt").alias("answer"), F.min("attempt").alias("attempt"))


def prompt(task: dict, text: str) -> str:
    return json.dumps(task) + "\n---\n" + text


PLACEHOLDER = re.compile(r"not (provided|specified|available|found|mentioned|reported|stated)|unknown|n/a|no information", re.I)


def cells_of(reply: dict, columns: list[str]) -> dict[str, dict]:
    """Cells of a reply that hold something: missing ones, and placeholders without evidence, go."""
    out = {}
    for c in columns:
        cell = reply.get(c)
        cell = cell if isinstance(cell, dict) else {"answer": cell, "excerpts": []} if cell is not None else None
        if cell and cell.get("answer") not in (None, "") and not (not cell.get("excerpts") and PLACEHOLDER.search(str(cell["answer"]))):
            out[c] = {"answer": str(cell["answer"]), "excerpts": [str(x) for x in cell.get("excerpts") or []]}
    return out


def extract_document(model: Model, text: str, columns: list[str], batch: int = 3) -> dict[str, dict]:
    """All columns at once; where two or more are missing, these in reverse; then what is left in batches."""
    found = cells_of(parse_reply(model.generate(prompt({"task": "values", "columns": columns}, text))), columns)
    missing = [c for c in columns if c not in found]
    if len(missing) >= 2:
        found |= cells_of(parse_reply(model.generate(prompt({"task": "values", "columns": missing[::-1]}, text))), missing)
        missing = [c for c in columns if c not in found]
    for i in range(0, len(missing), batch):
        few = missing[i : i + batch]
        found |= cells_of(parse_reply(model.generate(prompt({"task": "values", "columns": few}, text))), few)
    return found


ROWS = "doc_id long, column string, answer string, excerpt string, status string, char_start int, char_end int"


def extract(docs: DataFrame, columns: list[str], model: Callable[[], Model], text: str = "text") -> DataFrame:
    """doc_id, column, answer, excerpt and where it stands, of each cell that the model finds; documents in parallel."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        client = model()
        for batch in batches:
            out = []
            for doc, body in zip(batch["doc_id"], batch["text"], strict=True):
                for c, cell in extract_document(client, body or "", columns).items():
                    excerpt = cell["excerpts"][0] if cell["excerpts"] else None
                    out.append((doc, c, cell["answer"], excerpt, *ground(excerpt or "", body or "")))
            yield pd.DataFrame(out, columns=["doc_id", "column", "answer", "excerpt", "status", "char_start", "char_end"])

    return docs.select("doc_id", F.col(text).alias("text")).mapInPandas(run, ROWS)


def identify_units(docs: DataFrame, model: Callable[[], Model]) -> DataFrame:
    """doc_id, unit_name, confidence of the units that the model names in each document, two tries each."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        client = model()
        for batch in batches:
            out = []
            for doc, body in zip(batch["doc_id"], batch["text"], strict=True):
                for _ in range(2):
                    if units := parse_reply(client.generate(prompt({"task": "units"}, body or ""))).get("observation_units"):
                        out += [(doc, u["unit_name"], u.get("confidence", "medium")) for u in units]
                        break
            yield pd.DataFrame(out, columns=["doc_id", "unit_name", "confidence"])

    return docs.select("doc_id", "text").mapInPandas(run, "doc_id long, unit_name string, confidence string")


def discover(batches: list[list[str]], model: Model, schema: TableSchema, patience: int = 1, most: int = 6) -> tuple[TableSchema, list[dict]]:
    """A schema from batches of passages, one after the other, since each batch sees the last schema.

    Ends after ``patience`` batches in a row without change, or ``most`` batches. Returns the schema and a snapshot of
    each batch: documents so far, columns, new ones.
    """
    unchanged, snapshots, seen = 0, [], 0
    for passages in batches[:most]:
        reply = parse_reply(model.generate(prompt({"task": "columns", "known": [c.name for c in schema.columns]}, "\n".join(passages))))
        proposed = TableSchema(columns=tuple(ColumnDef(r["name"], r.get("definition", ""), r.get("rationale", ""), tuple(r.get("allowed_values") or ())) for r in reply.get("columns", []) if r.get("name")))
        merged = schema.merge(proposed).pruned(lambda c: 0.0)
        seen += len(passages)
        new = [c.name for c in merged.columns if not schema.find(c.name)]
        snapshots.append({"cumulative_documents": seen, "total_columns": len(merged.columns), "new_columns": new})
        unchanged = unchanged + 1 if schema.converged(merged) and not new else 0
        schema = merged if merged.unit else TableSchema(merged.query, merged.columns, Unit(), merged.max_keys)
        if unchanged >= patience:
            break
    return schema, snapshots


def propose(docs: DataFrame, model: Callable[[], Model], text: str = "text") -> DataFrame:
    """name, definition, rationale, allowed_values, n_documents: columns the model proposes for any document, in parallel.

    Names that differ in case alone are one column, spelled as the least of them; the longest rationale stays and
    allowed values unite, sorted.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        client = model()
        for batch in batches:
            out = []
            for body in batch["text"]:
                reply = parse_reply(client.generate(prompt({"task": "columns", "known": []}, body or "")))
                named = {r["name"].lower(): r for r in reversed(reply.get("columns") or []) if r.get("name")}
                out += [(key, r["name"], r.get("definition", ""), r.get("rationale", ""), list(r.get("allowed_values") or ())) for key, r in named.items()]
            yield pd.DataFrame(out, columns=["key", "name", "definition", "rationale", "allowed_values"])

    rows = docs.select(F.col(text).alias("text")).mapInPandas(run, "key string, name string, definition string, rationale string, allowed_values array<string>")
    # counted by what is proposed first: documents that propose the same are one row
    same = rows.groupBy(*rows.columns).agg(F.count(F.lit(1)).alias("n"))
    longest = F.max_by("rationale", F.struct(F.length("rationale"), "rationale")).alias("rationale")
    allowed = F.array_sort(F.array_distinct(F.flatten(F.collect_set("allowed_values")))).alias("allowed_values")
    return same.groupBy("key").agg(F.min("name").alias("name"), F.min("definition").alias("definition"), longest, allowed, F.sum("n").alias("n_documents")).drop("key")
