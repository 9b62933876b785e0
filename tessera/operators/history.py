"""The history of schemas: every version of every column, built from a log of edits; schemas as they were; changes since a baseline.

Columns: schema, seq (order), name, definition, rationale, allowed (array). Edits: schema, at (their order), column (the
name it has then), new_name, definition, rationale, allowed; null leaves as it is, an empty list clears allowed values.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.cells import bound

_STATE = "struct<id:int,name:string,definition:string,rationale:string,allowed:array<string>,since:bigint>"
_VERSION = "struct<id:int,name:string,definition:string,rationale:string,allowed:array<string>,valid_from:bigint,valid_to:bigint>"
_ACTION = "struct<at:bigint,column_name:string,original_name:string,new_name:string,definition_changed:boolean,rationale_changed:boolean,allowed_values_changed:boolean,found:boolean>"
_FIELDS = ("name", "definition", "rationale", "allowed")


def _edited(c: Column, e: Column) -> Column:
    """A column after an edit."""
    allowed = F.when(e["allowed"].isNull(), c["allowed"]).when(F.size(e["allowed"]) > 0, e["allowed"])
    name = F.when(F.coalesce(e["new_name"], F.lit("")) != "", e["new_name"]).otherwise(c["name"])
    return F.struct(c["id"].alias("id"), name.alias("name"), F.coalesce(e["definition"], c["definition"]).alias("definition"), F.coalesce(e["rationale"], c["rationale"]).alias("rationale"), allowed.alias("allowed"), e["at"].alias("since"))


def _replayed(columns: DataFrame, edits: DataFrame) -> DataFrame:
    """schema, now (columns after the last edit), old (versions that ended), actions: each schema's log gone through in order."""
    start = columns.groupBy("schema").agg(F.sort_array(F.collect_list(F.struct("seq", *_FIELDS))).alias("c"))
    start = start.select("schema", F.transform("c", lambda c, i: F.struct(i.alias("id"), *[c[f].alias(f) for f in _FIELDS], F.lit(0).cast("long").alias("since"))).cast(f"array<{_STATE}>").alias("now"))
    log = edits.select("schema", F.struct(F.col("at").cast("long").alias("at"), F.col("column").alias("column"), "new_name", "definition", "rationale", "allowed").alias("e")).groupBy("schema").agg(F.sort_array(F.collect_list("e")).alias("log"))
    both = start.join(log, "schema", "left")

    def step(s: Column, e: Column) -> Column:
        place = F.array_position(F.transform(s["now"], lambda c: c["name"]), e["column"]) - 1  # the first of that name

        def apply(i: Column) -> Column:
            was = F.get(s["now"], i.cast("int"))
            ended = F.struct(*[was[f].alias(f) for f in ("id", *_FIELDS)], was["since"].alias("valid_from"), e["at"].alias("valid_to"))
            now = F.transform(s["now"], lambda c, k: F.when(k == i, _edited(c, e)).otherwise(c))
            name = F.coalesce(F.nullif(e["new_name"], F.lit("")), e["column"])
            action = F.struct(e["at"].alias("at"), name.alias("column_name"), e["column"].alias("original_name"), e["new_name"].alias("new_name"), *[e[f].isNotNull().alias(n) for f, n in (("definition", "definition_changed"), ("rationale", "rationale_changed"), ("allowed", "allowed_values_changed"))], (i >= 0).alias("found"))
            old = F.when(i >= 0, F.concat(s["old"], F.array(ended.cast(_VERSION)))).otherwise(s["old"])
            return F.struct(now.cast(f"array<{_STATE}>").alias("now"), old.alias("old"), F.concat(s["actions"], F.array(action.cast(_ACTION))).alias("actions"))

        return bound(F.coalesce(place, F.lit(-1).cast("long")), apply)

    none = lambda kind: F.array().cast(f"array<{kind}>")
    begin = F.struct(F.col("now").alias("now"), none(_VERSION).alias("old"), none(_ACTION).alias("actions"))
    empty = F.array().cast("array<struct<at:bigint,column:string,new_name:string,definition:string,rationale:string,allowed:array<string>>>")
    return both.select("schema", F.aggregate(F.coalesce("log", empty), begin, step).alias("s")).select("schema", "s.*")


def versions(columns: DataFrame, edits: DataFrame) -> DataFrame:
    """schema, id, name, definition, rationale, allowed, valid_from, valid_to of every version of every column.

    ``id`` is a column's place in its first schema and stays with it through renames. A version holds from one edit to
    the next (null: still). Edits of columns that have no such name then change nothing; of two columns of one name the
    first is meant. Versions begin at 0; ``at`` is above 0 and differs within a schema. A schema's log is worked through in one
    task, as its order asks; schemas are many.
    """
    now = F.transform("now", lambda c: F.struct(*[c[f].alias(f) for f in ("id", *_FIELDS)], c["since"].alias("valid_from"), F.lit(None).cast("long").alias("valid_to")).cast(_VERSION))
    return _replayed(columns, edits).select("schema", F.explode(F.concat("old", now)).alias("v")).select("schema", "v.*").where("valid_to IS NULL OR valid_to > valid_from")


def actions(columns: DataFrame, edits: DataFrame) -> DataFrame:
    """schema, at, column_name, original_name, new_name, what changed, found: the log of what edits did; ``found`` is false where no column had the name."""
    return _replayed(columns, edits).select("schema", F.explode("actions").alias("a")).select("schema", "a.*")


def as_of(found: DataFrame, times: DataFrame) -> DataFrame:
    """The columns of each schema (schema, at) as they were: the versions that hold at that time, its own edit included."""
    asked = times.select("schema", "at").distinct()
    return found.join(asked, "schema").where((F.col("valid_from") <= F.col("at")) & (F.col("valid_to").isNull() | (F.col("at") < F.col("valid_to")))).select("schema", "at", "id", *_FIELDS)


def changes_since(found: DataFrame, baselines: DataFrame, filled: DataFrame) -> DataFrame:
    """schema, name, change_type, old_value, new_value of columns that differ from their baseline.

    ``baselines`` has schema, at, id: the columns that a baseline taken then has. The first that applies of new, renamed,
    definition, rationale, allowed_values. A column that the baseline lacks, but that has data (``filled``: schema, name), joins
    the baseline as it is and has not changed. Schemas without a baseline have no changes; columns of excerpts don't count.
    """
    current = found.where("valid_to IS NULL").where(~F.lower("name").endswith("_excerpt"))
    base = found.join(baselines, ["schema", "id"]).where((F.col("valid_from") <= F.col("at")) & (F.col("valid_to").isNull() | (F.col("at") < F.col("valid_to")))).select("schema", "id", *[F.col(f).alias(f"o_{f}") for f in _FIELDS])
    both = current.join(baselines.select("schema").distinct(), "schema").join(base, ["schema", "id"], "left")
    both = both.join(filled.select("schema", "name").distinct().withColumn("filled", F.lit(True)), ["schema", "name"], "left")
    text = lambda c: F.coalesce(c, F.lit(""))
    values = lambda c: F.array_sort(F.array_distinct(F.coalesce(c, F.array().cast("array<string>"))))
    kind = (
        F.when(F.col("o_name").isNull(), F.when(F.col("filled").isNull(), "new"))
        .when(F.col("o_name") != F.col("name"), "renamed")
        .when(text(F.col("o_definition")) != text(F.col("definition")), "definition")
        .when(text(F.col("o_rationale")) != text(F.col("rationale")), "rationale")
        .when(values(F.col("o_allowed")) != values(F.col("allowed")), "allowed_values")
    )
    of = lambda p, none: F.when(kind == "renamed", F.col(f"{p}name")).when(kind == "definition", F.col(f"{p}definition")).when(kind == "rationale", F.col(f"{p}rationale")).when(kind == "allowed_values", F.array_join(F.coalesce(f"{p}allowed", F.array().cast("array<string>")), ", ")).otherwise(none)
    return both.select("schema", "name", kind.alias("change_type"), of("o_", F.lit(None)).alias("old_value"), of("", text(F.col("definition"))).alias("new_value")).where("change_type IS NOT NULL")
