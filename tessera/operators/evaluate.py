"""Evaluation against ground truth: comparison of values, matching of rows and schemas, metrics."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.cells import number
from tessera.functions.similarity import contains_score, jaccard, ratio_udf, tokens

#: Words that say yes and no; yes is looked for first.
POSITIVE = ["yes", "true", "positive", "confirmed", "present"]
NEGATIVE = ["no", "false", "negative", "absent", "not", "none"]


#: Truths that are compared as yes or no.
BINARY = ["yes", "no", "true", "false", "positive", "negative"]


def binary(text: Column) -> Column:
    """True, false or null by the words within a text; a positive word anywhere wins."""
    low = F.lower(F.trim(text))
    yes = F.exists(F.array(*map(F.lit, POSITIVE)), lambda w: low.contains(w))
    no = F.exists(F.array(*map(F.lit, NEGATIVE)), lambda w: low.contains(w))
    return F.when(yes, True).when(no, False)


def relative_error(predicted: Column, truth: Column) -> Column:
    """Of the first number within the prediction against a truth that is a number; null where either is none."""
    p, t = F.regexp_extract(predicted.cast("string"), r"[\d.]+", 0).try_cast("double"), number(truth)
    return F.when(t == 0, F.when(p == 0, 0.0).otherwise(1.0)).otherwise(F.abs(p - t) / F.abs(t))


def numeric_match(predicted: Column, truth: Column) -> Column:
    """match (error under 1 %) and similarity (1 less the error, at least 0)."""
    e = relative_error(predicted, truth)
    return F.struct((e < 0.01).alias("match"), F.greatest(F.lit(0.0), 1 - e).alias("similarity"))


def value_similarity(predicted: Column, truth: Column) -> Column:
    """1 for equal texts, 0.7 where one holds the other, else 0; 0 for empty ones."""
    a, b = F.lower(F.trim(predicted)), F.lower(F.trim(truth))
    return F.when((F.coalesce(a, F.lit("")) == "") | (F.coalesce(b, F.lit("")) == ""), 0.0).when(a == b, 1.0).when(a.contains(b) | b.contains(a), 0.7).otherwise(0.0)


def kind_of(truth: Column) -> Column:
    """How a truth is best compared: binary, numeric, sequence or semantic."""
    plain = F.lower(F.trim(truth))
    return F.when(plain.isin(BINARY), "binary").when(number(truth).isNotNull(), "numeric").when((F.length(truth) > 10) & truth.rlike("^[A-Z]+$"), "sequence").otherwise("semantic")


def _same(match: Column, similarity: Column) -> Column:
    return F.struct(F.coalesce(match, F.lit(False)).alias("match"), F.coalesce(similarity, F.lit(0.0)).alias("similarity"))


def _exact(p: Column, t: Column) -> Column:
    same = F.lower(F.trim(p)) == F.lower(F.trim(t))
    return _same(same, same.cast("double"))


def _contains(p: Column, t: Column) -> Column:
    held = F.lower(p).contains(F.lower(F.trim(t)))
    return _same(held, held.cast("double"))


def _semantic(p: Column, t: Column) -> Column:
    s = jaccard(tokens(p), tokens(t))
    return _same(s >= 0.95, s)


def _binary(p: Column, t: Column) -> Column:
    same = binary(p) == binary(t)
    return _same(same, same.cast("double"))


def _numeric(p: Column, t: Column) -> Column:
    got = numeric_match(p, t)
    return F.when(got["similarity"].isNotNull(), _same(got["match"], got["similarity"])).otherwise(_semantic(p, t))


def _sequence(p: Column, t: Column) -> Column:
    a, b = longest_sequence(p), longest_sequence(t)
    return F.when((a != "") & (b != ""), _same(a == b, ratio_udf(a, b))).otherwise(_semantic(p, t))


#: Ways to compare a prediction with a truth, by name: each gives match and similarity. Add to it to register another.
COMPARISONS = {"exact": _exact, "contains": _contains, "semantic": _semantic, "binary": _binary, "numeric": _numeric, "sequence": _sequence}


def compare(predicted: Column, truth: Column, kind: str = "auto") -> Column:
    """match and similarity by the way named, or by ``kind_of`` the truth; empty texts match nothing."""
    if kind != "auto":
        found = COMPARISONS.get(kind, _semantic)(predicted, truth)
    else:
        of = kind_of(truth)
        found = F.when(of == "binary", _binary(predicted, truth)).when(of == "numeric", _numeric(predicted, truth)).when(of == "sequence", _sequence(predicted, truth)).otherwise(_semantic(predicted, truth))
    empty = (F.coalesce(predicted, F.lit("")) == "") | (F.coalesce(truth, F.lit("")) == "")
    return F.when(empty, _same(F.lit(False), F.lit(0.0))).otherwise(found)


def longest_sequence(text: Column) -> Column:
    """Longest run of three capitals or more, the first among equals."""
    return F.aggregate(F.regexp_extract_all(text, F.lit("([A-Z]{3,})"), 1), F.lit(""), lambda a, x: F.when(F.length(x) > F.length(a), x).otherwise(a))


def gt_metrics(df: DataFrame, predicted: Column, truth: Column) -> DataFrame:
    """n, accuracy, containment of predictions against the truth; rows without a prediction are wrong."""
    p, t = F.lower(F.trim(predicted)), F.lower(F.trim(truth))
    right = F.coalesce(p == t, F.lit(False))
    inside = F.coalesce(contains_score(p, t).isNotNull(), F.lit(False))
    return df.agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(right.cast("double")), 6).alias("accuracy"), F.round(F.avg(inside.cast("double")), 6).alias("containment"))


def prf(tp: Column, fp: Column, fn: Column) -> list[Column]:
    """precision, recall and f1; 0 without true positives."""
    p, r = F.try_divide(tp, tp + fp), F.try_divide(tp, tp + fn)
    zero = lambda c: F.when(tp == 0, 0.0).otherwise(c)
    return [zero(p).alias("precision"), zero(r).alias("recall"), zero(2 * p * r / (p + r)).alias("f1")]


def recall_by_table(scores: DataFrame) -> DataFrame:
    """tables, mean_recall of (tabid, prediction, recall): the best prediction of each table, then the mean."""
    best = scores.groupBy("tabid").agg(F.max("recall").alias("best"))
    return best.agg(F.count(F.lit(1)).alias("tables"), F.round(F.avg("best"), 6).alias("mean_recall"))


def stratified(df: DataFrame, label: str, order: list[Column], n: int) -> DataFrame:
    """n rows of each class by ``order``."""
    w = Window.partitionBy(label).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= n).drop("_n")


def column_usage(df: DataFrame, used: str) -> DataFrame:
    """name, rate: the share of rows that used each column, with its class."""
    n = df.agg(F.count(F.lit(1)).alias("n"))  # one row
    rows = df.select(F.explode(used).alias("name")).groupBy("name").agg(F.count(F.lit(1)).alias("k")).join(F.broadcast(n), F.lit(True))
    rate = F.round(F.col("k") / F.col("n"), 6)
    return rows.select("name", rate.alias("rate"), F.when(rate > 0.7, "high").when(rate < 0.1, "low").otherwise("middle").alias("class"))
