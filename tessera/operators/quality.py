"""Quality of extracted tables: reports on values and columns, generated descriptions, what becomes of replies, ways to score by name."""

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import cells
from tessera.functions.similarity import jaccard, tokens
from tessera.operators import alike, evaluate
from tessera.operators.order import numbered

#: Words of a column's name that are spelled in capitals.
CAPITALS = ["Id", "Url", "Api", "Xml", "Json"]
#: Endings of a definition, and of a rationale, by the kind of a column's values.
KIND_DEFINITIONS = {"cells": " (extracted from documents with supporting evidence)", "url": " (URL/link format)", "email": " (email address format)", "number": " (numeric values)"}
KIND_RATIONALES = {
    "cells": "Contains extracted answers with supporting document excerpts for verification",
    "id": "Serves as a key identifier for linking and referencing records",
    "name": "Provides human-readable labels for identification and display",
    "number": "Numeric values enable quantitative analysis and comparisons",
    "long": "Long text content provides detailed information for comprehensive analysis",
}
UNIQUENESS = {
    "high": "High uniqueness suggests this field contains specific identifying information",
    "low": "Low uniqueness indicates categorical classification useful for grouping and analysis",
    "middle": "Moderate uniqueness suggests semi-structured data suitable for detailed analysis",
}


def described(stats: DataFrame) -> DataFrame:
    """``stats`` (name, kind, unique_values, total_values, long_text, sample) with the definition and rationale that such values suggest.

    Over nine tenths distinct values are identifying, under a tenth categories. ``kind`` is cells, url, email, number
    or another. A column without values has nulls.
    """
    ratio = F.try_divide(F.col("unique_values"), F.col("total_values"))
    low = F.lower("name")
    title = F.initcap(F.translate("name", "_-", "  "))
    title = reduce(lambda t, w: F.replace(t, F.lit(w), F.lit(w.upper())), CAPITALS, title)
    identifying = low.contains("id") | low.contains("name")
    about = F.when(ratio > 0.9, F.when(identifying, F.concat(F.lit("Unique identifier or name for "), title)).otherwise(F.concat(F.lit("Specific "), title, F.lit(" values, mostly unique across records"))))
    about = about.when(ratio < 0.1, F.concat(F.lit("Categorical "), title, F.lit(" data with limited distinct values"))).when(ratio.isNotNull(), F.concat(F.lit("Data about "), title))
    kind = F.coalesce(F.col("kind"), F.lit(""))
    ending = F.when(F.col("long_text"), " (detailed text content)").otherwise("")
    for k, text in reversed(KIND_DEFINITIONS.items()):
        ending = F.when(kind == k, text).otherwise(ending)
    spread = F.when(ratio > 0.9, UNIQUENESS["high"]).when(ratio < 0.1, UNIQUENESS["low"]).when(ratio.isNotNull(), UNIQUENESS["middle"])
    use = F.when(kind == "cells", KIND_RATIONALES["cells"]).when(low.contains("id"), KIND_RATIONALES["id"]).when(low.contains("name"), KIND_RATIONALES["name"]).when(kind == "number", KIND_RATIONALES["number"]).when(F.col("long_text"), KIND_RATIONALES["long"])
    detail = F.when(F.length("sample") > 50, "Contains detailed content that may require summarization or excerpt viewing")
    rationale = F.when(ratio.isNotNull(), F.concat(F.concat_ws(". ", spread, use, detail), F.lit(".")))
    return stats.withColumn("definition", F.concat(about, ending)).withColumn("rationale", rationale)


def quality_report(scores: DataFrame, sizes: DataFrame) -> DataFrame:
    """One row: schema recall, precision and F1, row match rate, mean and median of values, the five best and worst fields, correlation with a judge.

    ``scores`` has field, score, judged (null: no judgement) of each compared value; ``sizes`` is one row of gt_fields,
    pred_fields, aligned_fields, gt_rows, pred_rows, rows_matched. The match rate is of the smaller table. Without
    values means are 0 and lists empty. Of equal fields the first by name stands first.
    """
    total = scores.agg(
        F.coalesce(F.round(F.avg("score"), 6), F.lit(0.0)).alias("mean"), F.coalesce(F.round(F.median("score"), 6), F.lit(0.0)).alias("median"), F.count("score").alias("comparisons"),
        F.round(F.avg("judged"), 6).alias("judge_mean"), F.count("judged").alias("judge_comparisons"),
        F.when(F.count("judged") > 1, F.round(F.corr(F.when(F.col("judged").isNotNull(), F.col("score")), "judged"), 6)).otherwise(0.0).alias("judge_correlation"),
    )
    fields = scores.groupBy("field").agg(F.round(F.avg("score"), 6).alias("score")).where("score is not null")  # a row for each field
    ordered = fields.agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("o"), "field"))).alias("down"), F.array_sort(F.collect_list(F.struct(F.col("score").alias("o"), "field"))).alias("up"))
    names = lambda c: F.transform(F.slice(c, 1, 5), lambda x: x["field"])
    recall, precision = F.coalesce(F.try_divide("aligned_fields", "gt_fields"), F.lit(0.0)), F.coalesce(F.try_divide("aligned_fields", "pred_fields"), F.lit(0.0))
    f1 = F.coalesce(F.try_divide(2 * recall * precision, recall + precision), F.lit(0.0))
    rate = F.coalesce(F.try_divide(F.col("rows_matched"), F.least("gt_rows", "pred_rows")), F.lit(0.0))
    schema = sizes.select(F.round(recall, 6).alias("schema_recall"), F.round(precision, 6).alias("schema_precision"), F.round(f1, 6).alias("schema_f1"), F.round(rate, 6).alias("row_match_rate"))
    return schema.join(F.broadcast(total)).join(F.broadcast(ordered.select(names("down").alias("best_fields"), names("up").alias("worst_fields"))))  # one row each


def column_report(rows: DataFrame, used: str, columns: DataFrame) -> DataFrame:
    """One row: total_columns, most_used (5), least_used (5, under a tenth of rows), unused, highly_used (over 0.7) of ``columns`` (name) by what rows used.

    Among equals the first by name comes first. Columns that rows name and the schema lacks don't count.
    """
    n = rows.agg(F.count(F.lit(1)).alias("n"))
    k = rows.select(F.explode(F.array_distinct(used)).alias("name")).groupBy("name").agg(F.count(F.lit(1)).alias("k"))
    rate = F.coalesce(F.try_divide(F.coalesce("k", F.lit(0)), F.col("n")), F.lit(0.0))
    rates = columns.select("name").distinct().join(k, "name", "left").join(F.broadcast(n)).select("name", rate.alias("rate"))
    each = rates.agg(F.sort_array(F.collect_list(F.struct("name", "rate"))).alias("all"))  # a column each: a schema's
    by = lambda sign: F.transform(F.array_sort(F.transform("all", lambda x: F.struct((sign * x["rate"]).alias("o"), x["name"].alias("name"), x["rate"].alias("rate")))), lambda x: F.struct(x["name"], x["rate"]))
    named = lambda c: F.transform(c, lambda x: x["name"])
    return each.select(
        F.size("all").alias("total_columns"), named(F.slice(by(-1), 1, 5)).alias("most_used"), named(F.filter(F.slice(by(1), 1, 5), lambda x: x["rate"] < 0.1)).alias("least_used"),
        named(F.filter("all", lambda x: x["rate"] == 0)).alias("unused"), named(F.filter("all", lambda x: x["rate"] > 0.7)).alias("highly_used"),
    )


def truth_metrics(rows: DataFrame) -> DataFrame:
    """type, n, accuracy, avg_similarity, containment_rate, avg_confidence of comparisons (predicted, truth, confidence): of each type and of all (null).

    The type is how a truth is best compared; a value is right where both texts are equal but for case and outer space,
    contained where the prediction holds the truth. Means are of whole sums of 12 decimals, so that ties in the last place
    don't go by the order of rows.
    """
    p, t = F.lower(F.trim("predicted")), F.lower(F.trim("truth"))
    got = evaluate.compare(F.col("predicted"), F.col("truth"))
    each = rows.select(evaluate.kind_of(F.col("truth")).alias("type"), F.coalesce(p == t, F.lit(False)).cast("double").alias("same"), got["similarity"].alias("similarity"), F.coalesce(p.contains(t) & (t != ""), F.lit(False)).cast("double").alias("held"), "confidence")
    whole = lambda c: c.cast("double").try_cast("decimal(28,12)")
    exact = lambda c: F.when(F.count(whole(c)) == F.count(c), F.try_divide(F.try_sum(whole(c)).cast("double"), F.count(c)))
    mean = lambda c, name: F.round(F.coalesce(exact(F.col(c)), F.avg(c)), 6).alias(name)
    return each.rollup("type").agg(F.count(F.lit(1)).alias("n"), mean("same", "accuracy"), mean("similarity", "avg_similarity"), mean("held", "containment_rate"), mean("confidence", "avg_confidence"))


def model_specs(models: DataFrame, specs: DataFrame, fallback: int) -> DataFrame:
    """``models`` (provider, model) with spec and how it was found: exact, prefix, provider or global.

    ``specs`` has provider (lower case), model (``_default`` for the provider's), spec, seq: of several names that a
    model begins with, the first by ``seq`` counts. Prefixes meet models as equal keys: each beginning of a model as long as
    some name of its provider asks for it. Repeated rows give a row each.
    """
    asked = models.select("provider", "model").distinct().withColumn("p", F.lower("provider"))
    named = specs.select(F.col("provider").alias("p"), F.col("model").alias("name"), "spec", "seq").where("name <> '_default'")
    lengths = named.groupBy("p").agg(F.collect_set(F.length("name")).alias("lengths"))
    begins = asked.join(lengths, "p").select("p", "provider", "model", F.explode("lengths").alias("n")).where(F.length("model") >= F.col("n")).withColumn("name", F.expr("left(model, n)"))
    exact = F.col("name") == F.col("model")
    found = begins.join(named, ["p", "name"]).groupBy("provider", "model").agg(F.min_by(F.struct("spec", F.when(exact, "exact").otherwise("prefix").alias("how")), F.struct((~exact).alias("o"), "seq")).alias("own"))
    other = specs.where("model = '_default'").select(F.col("provider").alias("p"), F.col("spec").alias("default"))
    out = models.join(found, ["provider", "model"], "left").join(other, F.lower(models["provider"]) == other["p"], "left")
    how = F.when(F.col("own").isNotNull(), F.col("own.how")).when(F.col("default").isNotNull(), "provider").otherwise("global")
    return out.select(*models.columns, F.coalesce("own.spec", "default", F.lit(fallback)).alias("spec"), how.alias("how"))


def postprocessed(answers: DataFrame, catalog: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``answers`` (row, column, answer, excerpts, suggested) that say something, with value, normalized, unmatched; and column, values that no allowed value fits.

    Answers that stand for none, without an excerpt, and blank ones go. What fits nothing allowed, or was suggested, waits
    for the schema: each value of a column once.
    """
    said = answers.where(~cells.placeholder(F.col("answer"), F.size("excerpts"))).where(F.trim(F.coalesce("answer", F.lit(""))) != "")
    done = alike.allowed_values(said, catalog)
    tracked = F.when(F.col("unmatched").isNotNull(), F.col("unmatched")).when(F.coalesce("suggested", F.lit(False)), F.col("value"))
    out = done.select(*said.columns, "value", F.col("matched").alias("normalized"), tracked.alias("unmatched"))
    return out, out.where("unmatched is not null").select("column", F.col("unmatched").alias("value")).distinct()


def backfilled(rows: DataFrame, position: str, papers: str, files: DataFrame) -> DataFrame:
    """``rows`` whose ``papers`` are null or empty get the file of their position (from 0) among the sorted names of ``files`` (name), where there is one."""
    placed = numbered(files.select("name").distinct(), ["name"], "_at")
    out = rows.join(placed, rows[position] == placed["_at"], "left")
    missing = F.coalesce(F.size(papers), F.lit(0)) <= 0
    return out.select(*[(F.when(missing & F.col("name").isNotNull(), F.array("name")).otherwise(rows[c]).alias(c) if c == papers else rows[c]) for c in rows.columns])


def validated(columns: DataFrame) -> DataFrame:
    """schema, name, errors, warnings of ``columns`` (schema, name, definition): names twice but for case, no definition, names under three characters, none at all."""
    low = F.lower("name")
    twice = columns.groupBy(F.col("schema").alias("_schema"), low.alias("_low")).agg(F.count(F.lit(1)).alias("_n"))
    out = columns.join(twice, F.col("schema").eqNullSafe(F.col("_schema")) & low.eqNullSafe(F.col("_low")))
    blank = F.trim(F.coalesce("name", F.lit(""))) == ""
    errors = F.array_compact(F.array(F.when(blank, "no name"), F.when(~blank & (F.col("_n") > 1), "duplicate name")))
    warnings = F.array_compact(F.array(F.when(F.trim(F.coalesce("definition", F.lit(""))) == "", "missing definition"), F.when(~blank & (F.length("name") < 3), "short name")))
    return out.select("schema", "name", errors.alias("errors"), warnings.alias("warnings"))


Feature = Callable[[DataFrame], DataFrame]
Scorer = Callable[[Column, Column], Column]
#: Features of columns and scores of their alignment, by name. Add to them to register another.
FEATURES: dict[str, Feature] = {}
SCORERS: dict[str, Scorer] = {
    "exact": lambda a, b: (F.lower(a) == F.lower(b)).cast("double"),
    "jaccard": lambda a, b: jaccard(tokens(a), tokens(b)),
    "containment": lambda a, b: F.size(F.array_intersect(tokens(a), tokens(b))) / F.greatest(F.least(F.size(tokens(a)), F.size(tokens(b))), F.lit(1)),
}


def feature(name: str):
    """Register a function from cells (table, column, value) to features (table, column, text)."""

    def add(make: Feature) -> Feature:
        FEATURES[name] = make
        return make

    return add


@feature("name")
def _names(cells_: DataFrame) -> DataFrame:
    return cells_.select("table", "column").distinct().withColumn("text", F.col("column"))


@feature("values")
def _values(cells_: DataFrame, most: int = 5) -> DataFrame:
    """A column by its name and first few distinct values."""
    each = cells_.where("value is not null").groupBy("table", "column", "value").agg(F.lit(1).alias("_"))
    return each.groupBy("table", "column").agg(F.concat_ws(" ", "column", F.array_join(F.slice(F.sort_array(F.collect_set("value")), 1, most), " ")).alias("text"))


def schema_recall(predicted: DataFrame, gold: DataFrame, by: str = "name", scorer: str = "jaccard", threshold: float = 0.7) -> DataFrame:
    """table, recall: the share of a gold table's columns to which some predicted column of that table aligns with ``threshold`` or more.

    Both have (table, column, value); features and score go by their registered names. Columns meet within their table.
    """
    p, g = FEATURES[by](predicted).select("table", F.col("text").alias("p")), FEATURES[by](gold).select("table", "column", F.col("text").alias("g"))
    best = g.join(p, "table", "left").groupBy("table", "column").agg(F.max(SCORERS[scorer](F.col("p"), F.col("g"))).alias("score"))
    return best.groupBy("table").agg(F.round(F.avg((F.coalesce("score", F.lit(0.0)) >= threshold).cast("double")), 6).alias("recall"))
