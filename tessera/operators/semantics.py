"""Schemas and fields by meaning: where names say nothing, the cosine of their vectors decides.

Vectors come with the rows (arrays of numbers of one length); a null one is like nothing. A schema's columns are few and
come together as arrays; schemas are spread over tasks.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.cells import bound
from tessera.functions.replies import holds_any
from tessera.functions.similarity import cosine
from tessera.operators.catalog import META_FIELDS
from tessera.operators.evaluate import value_similarity

_COLUMN = "struct<name:string,rationale:string,allowed:array<string>,vector:array<double>>"


def _likeness(a: Column, b: Column) -> Column:
    """Cosine to twelve decimals, 0 where a vector is null or empty."""
    return F.when(F.size(a) == F.size(b), F.round(F.coalesce(cosine(a, b), F.lit(0.0)), 12)).otherwise(0.0)


def merge_schemas(old: DataFrame, new: DataFrame, threshold: float = 0.9) -> DataFrame:
    """schema, seq, name, rationale, allowed of the columns of ``old`` with those of ``new`` merged in, one after the other.

    Both have schema, seq, name, rationale, allowed, vector. A new column is the first one equal to it but for case,
    else the first whose vector has cosine ``threshold`` or more with its own; else it is added and may be what a later one is
    merged with. The longer rationale stays (of equals the old), allowed values unite in order. Schemas of one side stay as they are, those of
    ``new`` merged within themselves.
    """
    item = F.struct(F.col("name").alias("name"), F.coalesce("rationale", F.lit("")).alias("rationale"), F.col("allowed").alias("allowed"), F.transform("vector", lambda x: x.cast("double")).alias("vector")).cast(_COLUMN)
    listed = lambda df, n: df.groupBy("schema").agg(F.transform(F.sort_array(F.collect_list(F.struct("seq", item.alias("c")))), lambda x: x["c"]).alias(n))
    both = listed(old, "have").join(listed(new, "come"), "schema", "full")
    none = F.array().cast(f"array<{_COLUMN}>")

    def step(have: Column, c: Column) -> Column:
        same = F.array_position(F.transform(have, lambda x: F.lower(x["name"]) == F.lower(c["name"])), F.lit(True)) - 1
        alike = F.array_position(F.transform(have, lambda x: _likeness(c["vector"], x["vector"]) >= threshold), F.lit(True)) - 1

        def put(i: Column) -> Column:
            united = lambda x: F.filter(F.array_distinct(F.concat(F.coalesce(x["allowed"], F.array().cast("array<string>")), c["allowed"])), lambda v: v.isNotNull())
            allowed = lambda x: F.when(F.coalesce(F.size(c["allowed"]), F.lit(0)) > 0, F.when(F.size(united(x)) > 0, united(x))).otherwise(x["allowed"])
            longer = lambda x: F.when(F.length(c["rationale"]) > F.length(x["rationale"]), c["rationale"]).otherwise(x["rationale"])
            merged = F.transform(have, lambda x, k: F.when(k == i, F.struct(x["name"].alias("name"), longer(x).alias("rationale"), allowed(x).alias("allowed"), x["vector"].alias("vector")).cast(_COLUMN)).otherwise(x))
            return F.when(i >= 0, merged).otherwise(F.concat(have, F.array(c)))

        return bound(F.when(same >= 0, same).otherwise(alike), put)

    out = both.select("schema", F.aggregate(F.coalesce("come", none), F.coalesce("have", none), step).alias("all"))
    return out.select("schema", F.posexplode("all").alias("seq", "c")).select("schema", "seq", "c.name", "c.rationale", "c.allowed")


def align_fields(predicted: DataFrame, gold: DataFrame, least: float = 0.6) -> DataFrame:
    """table, pred_field, gold_field, score: predicted fields (table, seq, field, vector), in order, take the best gold field still free, above ``least``.

    Equal names score 1, one within the other 0.8, others the cosine of their vectors (0 at least); of equal scores the
    earlier gold field is taken. Fields that only identify take no part.
    """
    item = F.struct(F.col("field").alias("field"), F.transform("vector", lambda x: x.cast("double")).alias("vector"))
    listed = lambda df, n: df.where(~holds_any(F.lower("field"), META_FIELDS)).groupBy("table").agg(F.transform(F.sort_array(F.collect_list(F.struct("seq", item.alias("f")))), lambda x: x["f"]).alias(n))
    both = listed(predicted, "p").join(listed(gold, "g"), "table")
    start = F.struct(F.array().cast("array<int>").alias("used"), F.array().cast("array<struct<pred_field:string,gold_field:string,score:double>>").alias("out"))

    def score(a: Column, b: Column) -> Column:
        x, y = F.lower(F.trim(a["field"])), F.lower(F.trim(b["field"]))
        return F.when(x == y, 1.0).when(x.contains(y) | y.contains(x), 0.8).otherwise(F.greatest(F.lit(0.0), _likeness(a["vector"], b["vector"])))

    def step(s: Column, p: Column) -> Column:
        scored = F.transform("g", lambda g, i: F.struct(score(p, g).alias("score"), (-i).alias("place"), g["field"].alias("field")))
        best = F.array_max(F.filter(scored, lambda c: (c["score"] > least) & ~F.array_contains(s["used"], c["place"])))

        def take(b: Column) -> Column:
            row = F.struct(p["field"].alias("pred_field"), b["field"].alias("gold_field"), b["score"].alias("score"))
            return F.when(b.isNull(), s).otherwise(F.struct(F.array_append(s["used"], b["place"]).alias("used"), F.array_append(s["out"], row).alias("out")))

        return bound(best, take)

    return both.select("table", F.explode(F.aggregate("p", start, step)["out"]).alias("x")).select("table", "x.*")


def meaning_similarity(predicted: Column, truth: Column, predicted_vector: Column, truth_vector: Column) -> Column:
    """1 for equal texts, 0.7 where one holds the other, for longer ones (over ten characters both) the cosine of their vectors, else 0."""
    a, b = F.trim(predicted), F.trim(truth)
    plain = value_similarity(predicted, truth)
    return F.when((plain == 0) & (F.length(a) > 10) & (F.length(b) > 10), F.greatest(F.lit(0.0), _likeness(predicted_vector, truth_vector))).otherwise(plain)
