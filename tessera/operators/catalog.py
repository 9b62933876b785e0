"""The schema as data: columns with definitions, their changes, suggestions and merges."""

import hashlib
import json
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.cells import bound, normal_name
from tessera.functions.replies import holds_any


@dataclass(frozen=True)
class ColumnDef:
    name: str
    definition: str = ""
    rationale: str = ""
    allowed_values: tuple[str, ...] = ()
    auto_expand: int | None = 2
    source_document: str | None = None
    iteration: int | None = None

    def checksum(self) -> str:
        return hashlib.md5(f"{self.definition}|{self.rationale}|{'|'.join(sorted(self.allowed_values))}".encode()).hexdigest()


@dataclass(frozen=True)
class Unit:
    name: str = "entry"
    definition: str = ""
    example_names: tuple[str, ...] = ()


@dataclass(frozen=True)
class TableSchema:
    """Columns in order, the question they answer, and what a row is. Changes give a new schema."""

    query: str = ""
    columns: tuple[ColumnDef, ...] = ()
    unit: Unit | None = None
    max_keys: int | None = None
    history: tuple[str, ...] = field(default=())

    def find(self, name: str) -> ColumnDef | None:
        return next((c for c in self.columns if c.name.lower() == name.lower()), None)

    def add(self, column: ColumnDef) -> "TableSchema":
        if self.find(column.name):
            raise ValueError(f"there is a column {column.name}")
        return replace(self, columns=(*self.columns, column), history=(*self.history, f"add {column.name}"))

    def drop(self, name: str) -> "TableSchema":
        return replace(self, columns=tuple(c for c in self.columns if c.name.lower() != name.lower()), history=(*self.history, f"drop {name}"))

    def edit(self, name: str, **changes) -> "TableSchema":
        return replace(self, columns=tuple(replace(c, **changes) if c.name.lower() == name.lower() else c for c in self.columns), history=(*self.history, f"edit {name}"))

    def merge(self, other: "TableSchema", alike=None, threshold: float = 0.9) -> "TableSchema":
        """Columns of both: equal names first, then the first of likeness ``threshold`` or more, else a new column. The longer rationale stays, allowed values unite in order."""
        out = [*self.columns]
        for new in other.columns:
            at = next((i for i, c in enumerate(out) if c.name.lower() == new.name.lower()), None)
            if at is None and alike:
                at = next((i for i, c in enumerate(out) if alike(c.name, new.name) >= threshold), None)
            if at is None:
                out.append(new)
            else:
                old = out[at]
                longer = new if len(new.rationale) > len(old.rationale) else old
                out[at] = replace(old, rationale=longer.rationale, allowed_values=tuple(dict.fromkeys([*old.allowed_values, *new.allowed_values])))
        return replace(self, columns=tuple(out))

    def jaccard(self, other: "TableSchema") -> float:
        a, b = ({c.name.lower() for c in s.columns} for s in (self, other))
        return len(a & b) / max(1, len(a | b))

    def converged(self, other: "TableSchema") -> bool:
        return self.jaccard(other) >= 0.9 and len(self.columns) == len(other.columns)

    def pruned(self, score) -> "TableSchema":
        """The ``max_keys`` columns of highest ``score(column)``, plus a twentieth for each hundred characters of rationale."""
        if not self.max_keys or len(self.columns) <= self.max_keys:
            return self
        ranked = sorted(self.columns, key=lambda c: -(score(c) + 0.05 * len(c.rationale) / 100))
        return replace(self, columns=tuple(ranked[: self.max_keys]))

    def problems(self) -> dict[str, list[str]]:
        """Errors (names that occur twice) and warnings (no definition, a name of under three characters)."""
        names = [c.name.lower() for c in self.columns]
        return {"errors": sorted({n for n in names if names.count(n) > 1}), "warnings": [c.name for c in self.columns if not c.definition or len(c.name) < 3]}

    def dumps(self) -> str:
        return json.dumps({"query": self.query, "schema": [{"column": c.name, "definition": c.definition, "explanation": c.rationale, "allowed_values": list(c.allowed_values)} for c in self.columns], "observation_unit": self.unit and {"name": self.unit.name, "definition": self.unit.definition, "example_names": list(self.unit.example_names)}})

    @staticmethod
    def loads(text: str) -> "TableSchema":
        """Accepts ``schema`` or ``columns``, ``column`` or ``name``, ``explanation`` or ``rationale``; bad text is an empty schema."""
        try:
            raw = json.loads(text)
        except ValueError:
            return TableSchema()
        rows = raw if isinstance(raw, list) else raw.get("schema") or raw.get("columns") or []
        unit = raw.get("observation_unit") if isinstance(raw, dict) else None
        cols = [ColumnDef(r.get("column") or r.get("name") or "", r.get("definition") or "", r.get("explanation") or r.get("rationale") or "", tuple(r.get("allowed_values") or ())) for r in rows]
        return TableSchema(raw.get("query", "") if isinstance(raw, dict) else "", tuple(cols), unit and Unit(unit["name"], unit.get("definition", ""), tuple(unit.get("example_names") or ())))


def schema_jaccard(a: DataFrame, b: DataFrame, name: str) -> DataFrame:
    """jaccard of two sets of names, each name a row; 0 where both are empty."""
    both = a.select(name).distinct().withColumn("a", F.lit(1)).join(b.select(name).distinct().withColumn("b", F.lit(1)), name, "full")
    return both.agg(F.round(F.count_if(F.col("a").isNotNull() & F.col("b").isNotNull()) / F.greatest(F.count(F.lit(1)), F.lit(1)), 6).alias("jaccard"))


def compatibility(schema: DataFrame, data: DataFrame) -> DataFrame:
    """name, status (matching, missing, extra) of schema columns against data columns, both by normal name."""
    a = schema.select(normal_name(F.col("name")).alias("name"), F.lit(1).alias("a")).distinct()
    b = data.select(normal_name(F.col("name")).alias("name"), F.lit(1).alias("b")).distinct()
    return a.join(b, "name", "full").select("name", F.when(F.col("a").isNull(), "extra").when(F.col("b").isNull(), "missing").otherwise("matching").alias("status"))


def changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """name, change of two catalogs (column_id, name, definition, rationale, allowed_values): the first that applies of new, renamed, definition, rationale, allowed_values; the order of allowed values is none."""
    o = old.select("column_id", *[F.col(c).alias(f"o_{c}") for c in ("name", "definition", "rationale", "allowed_values")])
    both = new.join(o, "column_id", "left")
    kind = (
        F.when(F.col("o_name").isNull(), "new")
        .when(F.col("o_name") != F.col("name"), "renamed")
        .when(~F.col("o_definition").eqNullSafe(F.col("definition")), "definition")
        .when(~F.col("o_rationale").eqNullSafe(F.col("rationale")), "rationale")
        .when(~F.array_sort("o_allowed_values").eqNullSafe(F.array_sort("allowed_values")), "allowed_values")
    )
    return both.select("name", kind.alias("change")).where("change is not null")


def suggestions(values: DataFrame, known: DataFrame, threshold: int | None = 2) -> DataFrame:
    """column, value, documents, action of values (column, value, document) that ``known`` (column, value) lacks.

    Seen in ``threshold`` documents or more a value is added, else it waits; without a threshold all wait.
    """
    low = known.select(F.col("column"), F.lower("value").alias("_low")).distinct()
    counted = values.groupBy("column", "value").agg(F.count_distinct("document").alias("documents"))
    fresh = counted.withColumn("_low", F.lower("value")).join(low, ["column", "_low"], "left_anti").drop("_low")
    return fresh.withColumn("action", F.when(F.col("documents") >= F.lit(threshold), "add").otherwise("pending") if threshold and threshold > 0 else F.lit("pending"))


def pending(values: DataFrame, most: int = 10) -> DataFrame:
    """column, value, documents, first: values (column, value, document) that wait, in how many documents they are, and the ``most`` first of these.

    First ones are found within parts of a value's documents, so that a common value's are not gathered.
    """
    each = values.distinct()
    part = F.pmod(F.xxhash64("document"), F.lit(16))
    near = Window.partitionBy("column", "value", part).orderBy("document")
    all_ = each.groupBy("column", "value").agg(F.count(F.lit(1)).alias("documents"))
    few = each.withColumn("_n", F.row_number().over(near)).where(F.col("_n") <= most).groupBy("column", "value").agg(F.slice(F.sort_array(F.collect_list("document")), 1, most).alias("first"))
    return all_.join(few, ["column", "value"])


def _twins(name: str) -> list[str]:
    return [name, f"{name}_excerpt", f"{name}_excerpts"]


def rename_column(df: DataFrame, old: str, new: str) -> DataFrame:
    """A table's column, and its excerpts', under another name; a name that is taken raises."""
    if new in df.columns:
        raise ValueError(f"there is a column {new}")
    return df.withColumnsRenamed(dict(zip(_twins(old), _twins(new))))


def drop_column(df: DataFrame, name: str) -> DataFrame:
    """A table without a column and its excerpts."""
    return df.drop(*_twins(name))


def add_column(df: DataFrame, name: str) -> DataFrame:
    """A table with an empty column; a name that is taken, whatever the case, raises."""
    if name.lower() in [c.lower() for c in df.columns]:
        raise ValueError(f"there is a column {name}")
    return df.withColumn(name, F.lit(None).cast("string"))


def merge_catalogs(old: DataFrame, new: DataFrame) -> DataFrame:
    """name, rationale, allowed_values of columns of both catalogs: names equal but for case are one, spelled as in ``old``; the longer rationale stays, allowed values unite, old ones first."""
    both = old.select(F.lit(0).alias("_o"), "name", "rationale", "allowed_values").unionByName(new.select(F.lit(1).alias("_o"), "name", "rationale", "allowed_values"))
    longest = F.max_by("rationale", F.struct(F.length("rationale"), -F.col("_o"))).alias("rationale")
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("_o", "name", "allowed_values"))), lambda x: x["allowed_values"])
    return both.groupBy(F.lower("name").alias("_k")).agg(F.min_by("name", F.struct("_o", "name")).alias("name"), longest, F.array_compact(F.array_distinct(F.flatten(ordered))).alias("allowed_values")).drop("_k")


def converged(before: Column, after: Column) -> Column:
    """Whether two arrays of names are nearly one set, of one size."""
    alike = F.size(F.array_intersect(before, after)) / F.greatest(F.size(F.array_union(before, after)), F.lit(1))
    return (alike >= 0.9) & (F.size(before) == F.size(after))


def pruned(columns: DataFrame, schema: str, score: Column, rationale: Column, most: int) -> DataFrame:
    """The ``most`` columns of each schema of highest ``score``, plus a twentieth for each hundred characters of rationale; the first by rationale among equals."""
    n = F.row_number().over(Window.partitionBy(schema).orderBy(F.desc(score + 0.05 * F.length(rationale) / 100), rationale))
    return columns.withColumn("_n", n).where(F.col("_n") <= most).drop("_n")


def decide(catalog: DataFrame, pending: DataFrame, decisions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The catalog (column, allowed) and the pending values (column, value) after decisions (column, value, approve).

    Approved values are added in order, but for those allowed already, whatever the case, of which the first spelling
    stays; approved and rejected ones wait no longer. Decisions on values that don't wait change nothing.
    """
    waiting = pending.select("column", "value").distinct()
    known = decisions.join(waiting, ["column", "value"], "left_semi").groupBy("column", "value").agg(F.max("approve").alias("approve"))
    added = known.where("approve").groupBy("column").agg(F.sort_array(F.collect_list("value")).alias("added"))
    spelled = F.aggregate(
        F.coalesce("added", F.array().cast("array<string>")),
        F.coalesce("allowed", F.array().cast("array<string>")),
        lambda acc, v: F.when(F.exists(acc, lambda a: F.lower(a) == F.lower(v)), acc).otherwise(F.array_append(acc, v)),
    )
    return catalog.join(added, "column", "left").select("column", spelled.alias("allowed")), waiting.join(known, ["column", "value"], "left_anti")


def field_score(predicted: Column, gold: Column) -> Column:
    """1 for equal names, 0.8 where one holds the other, else 0."""
    p, g = F.lower(F.trim(predicted)), F.lower(F.trim(gold))
    return F.when(p == g, 1.0).when(g.contains(p) | p.contains(g), 0.8).otherwise(0.0)


#: What the name of a field that is no subject of alignment holds.
META_FIELDS = ["id", "row_name", "protein_name", "fasta", "sequence", "hash", "combined", "gt_", "_id", "index"]


def align_fields(predicted: DataFrame, gold: DataFrame, table: str, least: float = 0.6) -> DataFrame:
    """table, pred_field, gold_field, score: for each table (table, field, seq), predicted fields in order take the best gold field still free above ``least``.

    A table's fields are few (a schema), so they are one row's arrays; tables are spread over tasks.
    """
    plain = lambda df, name: df.where(~holds_any(F.lower("field"), META_FIELDS)).groupBy(table).agg(F.transform(F.sort_array(F.collect_list(F.struct("seq", "field"))), lambda x: x["field"]).alias(name))
    both = plain(predicted, "_p").join(plain(gold, "_g"), table)
    start = F.struct(F.array().cast("array<string>").alias("used"), F.array().cast("array<struct<pred_field:string,gold_field:string,score:double>>").alias("out"))

    def step(acc: Column, p: Column) -> Column:
        scored = F.transform(F.col("_g"), lambda g, i: F.struct(field_score(p, g).alias("score"), (-i).alias("place"), g.alias("gold")))
        best = F.array_max(F.filter(scored, lambda c: (c["score"] > least) & ~F.array_contains(acc["used"], c["gold"])))

        def taken(b: Column) -> Column:
            row = F.struct(p.alias("pred_field"), b["gold"].alias("gold_field"), b["score"].alias("score"))
            return F.when(b.isNull(), acc).otherwise(F.struct(F.array_append(acc["used"], b["gold"]).alias("used"), F.array_append(acc["out"], row).alias("out")))

        return bound(best, taken)

    return both.select(table, F.explode(F.aggregate("_p", start, step)["out"]).alias("_")).select(table, "_.*")


#: Terms within definition and rationale, by type of extraction, with its least confidence; the first that applies.
STRATEGIES = {
    "identifier": (["unique", "identifier", "name", "id"], 0.8),
    "numeric": (["numeric", "number", "count", "score", "value"], 0.75),
    "categorical": (["categorical", "classification", "type", "category"], 0.65),
    "text": (["detailed", "description", "content", "text"], 0.6),
}
#: Words of a definition that are no keywords.
NO_KEYWORDS = ["the", "and", "for", "with", "this", "that", "from", "about"]


def strategy(name: Column, definition: Column, rationale: Column) -> Column:
    """extraction_type, confidence_threshold, fallback_strategy and search_keywords (sorted) of a column, by terms anywhere in its definition and rationale.

    Keywords are the column's name and the words of three letters or more of its definition. Nulls count as empty.
    """
    said = F.coalesce(definition, F.lit(""))
    low = F.lower(F.concat(said, F.lit(" "), F.coalesce(rationale, F.lit(""))))
    kind, least = F.lit("general"), F.lit(0.7)
    for k, (terms, bound_) in reversed(STRATEGIES.items()):
        kind, least = F.when(holds_any(low, terms), k).otherwise(kind), F.when(holds_any(low, terms), bound_).otherwise(least)
    words = F.filter(F.regexp_extract_all(F.lower(said), F.lit(r"(?U)(\w{3,})"), 1), lambda w: ~w.isin(NO_KEYWORDS))
    keywords = F.array_sort(F.array_distinct(F.concat(F.array(F.lower(name)), words)))
    return F.struct(kind.alias("extraction_type"), least.alias("confidence_threshold"), F.when(kind == "text", "expanded_retrieval").otherwise("heuristic").alias("fallback_strategy"), keywords.alias("search_keywords"))


def recommendations(one: DataFrame) -> DataFrame:
    """What the metrics (accuracy, answer_rate, high_rate) of an evaluation call for."""
    said = F.array(F.when(F.col("accuracy") < 0.7, "refine definitions"), F.when(F.col("answer_rate") < 0.8, "add columns"), F.when(F.col("high_rate") < 0.5, "add examples"))
    return one.withColumn("recommendations", F.filter(said, lambda x: x.isNotNull()))
