"""Texts that are nearly equal by the ratio of matching blocks: which pairs can reach a threshold, and allowed values found that way."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.cells import bound
from tessera.functions.similarity import ratio_udf
from tessera.sources.scratch import new_path

#: Characters counted as common, the most frequent ones; their number bounds what a join broadcasts.
COMMON = 1000


def characters(text: Column) -> Column:
    """The characters of a text, each with how often it came so far, so that bags of characters are sets."""
    return bound(F.split(text, ""), lambda own: F.transform(F.filter(own, lambda c: c != ""), lambda c, i: F.concat(c, F.size(F.filter(F.slice(own, F.lit(1), i + 1), lambda x: x == c)).cast("string"))))


def ratio_pairs(left: DataFrame, right: DataFrame, threshold: float) -> DataFrame:
    """grp, a, b, ratio of texts of ``left`` (grp, a) and ``right`` (grp, b) of one group whose ratio is ``threshold`` or more.

    The ratio is 2 M / (|a| + |b|) of M characters in matching blocks, a first, as given (no folding). M is at most the
    number of characters both have, so a partner of a text must share threshold / (2 - threshold) of its characters or
    more: pairs meet at one of the rarest characters of both, are held to their lengths and their common characters,
    and only the survivors are aligned. Repeated texts count once; null and empty texts have no pairs.
    """

    def told(df: DataFrame, name: str) -> DataFrame:
        own = df.select("grp", F.col(name).alias("text")).where("length(text) > 0").distinct()
        return own.withColumn("chars", characters(F.col("text")))

    a, b = told(left, "a"), told(right, "b")
    often = a.select(F.explode("chars").alias("c")).unionByName(b.select(F.explode("chars").alias("c"))).groupBy("c").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "c").limit(COMMON)

    def posted(df: DataFrame) -> DataFrame:
        ranked = df.select("grp", "text", F.explode("chars").alias("c")).join(F.broadcast(often), "c", "left").groupBy("grp", "text").agg(F.sort_array(F.collect_list(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "c"))).alias("o"))
        least = F.ceil(F.size("o") * (threshold / (2 - threshold)) - 1e-9).cast("int")
        prefix = F.slice("o", F.lit(1), F.greatest(F.size("o") - least + 1, F.lit(1)))
        own = ranked.select("grp", "text", F.transform("o", lambda x: x["c"]).alias("chars"), prefix.alias("prefix"))
        return own.select("grp", "text", "chars", "prefix", F.explode("prefix").alias("key"))

    side = lambda df, x: df.select("grp", "key", *[F.col(c).alias(f"{x}_{c}") for c in ("text", "chars", "prefix")])
    met = side(posted(a), "a").join(side(posted(b), "b"), ["grp", "key"])
    total = F.size("a_chars") + F.size("b_chars")
    met = met.where(2 * F.least(F.size("a_chars"), F.size("b_chars")) >= (threshold - 1e-9) * total)
    # at the first character in order that both post, so that a pair is looked at once
    met = met.where(F.array_min(F.array_intersect("a_prefix", "b_prefix")) == F.col("key"))
    met = met.where(2 * F.size(F.array_intersect("a_chars", "b_chars")) >= (threshold - 1e-9) * total)
    met = met.select("grp", F.col("a_text").alias("a"), F.col("b_text").alias("b"))
    return met.withColumn("ratio", F.when(F.col("a") == F.col("b"), 1.0).otherwise(ratio_udf("a", "b"))).where(F.col("ratio") >= threshold)


def numeric_range(constraint: Column) -> Column:
    """low and high of "0-100" or "-10-10", null for other texts."""

    def of(parts: Column) -> Column:
        n, value = F.size(parts), lambda i: F.trim(F.get(parts, F.lit(i))).try_cast("double")
        low = F.when((n == 2) & (F.get(parts, F.lit(0)) != "") & (F.get(parts, F.lit(1)) != ""), value(0)).when((n == 3) & (F.get(parts, F.lit(0)) == ""), -value(1))
        return bound(F.struct(low.alias("low"), F.when(n == 2, value(1)).otherwise(value(2)).alias("high")), lambda r: F.when(r["low"].isNotNull() & r["high"].isNotNull(), r))

    return bound(F.split(F.trim(constraint), "-"), of)


def _spelled(value: Column) -> Column:
    """A double as text, whole numbers with one decimal."""
    return F.when((value == F.floor(value)) & (F.abs(value) < 1e15), F.concat(value.cast("long").cast("string"), F.lit(".0"))).otherwise(value.cast("string"))


def allowed_values(rows: DataFrame, catalog: DataFrame, threshold: float = 0.8) -> DataFrame:
    """``rows`` (column, answer and others) with value, matched, unmatched, by the allowed values of ``catalog`` (column, allowed).

    One allowed value that says ``number`` takes any number, one that is a range takes numbers and moves those outside to
    its ends; a percent sign goes. Otherwise the first value equal whatever the case, else the first of the most similar ones
    if its ratio is ``threshold`` or more. What fits nothing stays and stands in ``unmatched``. Columns without allowed values and empty or null
    answers stay as they are and match nothing. Repeated rows give a row each.
    """
    known = catalog.select("column", "allowed").where(F.size("allowed") > 0)
    strip = lambda c: F.regexp_replace(c, r"^\s+|\s+$", "")
    constraint = strip(F.lower(F.get("allowed", F.lit(0))))
    base = rows.join(known, "column", "left").withColumn("_low", strip(F.lower("answer"))).withColumn("_clean", strip(F.regexp_replace(strip(F.col("answer")), "%+$", "")))
    single = F.size("allowed") == 1
    base = base.withColumn("_kind", F.when(F.col("allowed").isNull() | (F.coalesce(F.length("answer"), F.lit(0)) == 0), "none").when(single & (constraint == "number"), "number").when(single & numeric_range(constraint).isNotNull(), "range").otherwise("text"))
    base = base.withColumn("_range", numeric_range(constraint)).withColumn("_number", F.col("_clean").try_cast("double"))
    exact = F.get(F.filter("allowed", lambda v: strip(F.lower(v)) == F.col("_low")), F.lit(0))
    base = base.withColumn("_exact", F.when(F.col("_kind") == "text", exact))
    base.write.parquet(path := new_path(rows.sparkSession, "answers"))  # read for the search and for its answers
    base = rows.sparkSession.read.schema(base.schema).parquet(path)
    asked = base.where("_kind = 'text' AND _exact IS NULL").select(F.col("column").alias("grp"), F.col("_low").alias("a")).distinct()
    values = known.select(F.col("column").alias("grp"), F.posexplode("allowed").alias("pos", "value")).withColumn("b", F.lower("value"))
    near = ratio_pairs(asked, values.select("grp", "b"), threshold).join(values, ["grp", "b"])
    best = near.groupBy("grp", "a").agg(F.max_by("value", F.struct("ratio", -F.col("pos"))).alias("_near")).withColumnsRenamed({"grp": "column", "a": "_low"})
    found = base.join(best, ["column", "_low"], "left")
    low, high = F.col("_range.low"), F.col("_range.high")
    clamped = F.when(F.col("_number") < low, _spelled(low)).when(F.col("_number") > high, _spelled(high)).when(F.col("_number").isNotNull(), F.col("_clean"))
    hit = F.when(F.col("_kind") == "number", F.when(F.col("_number").isNotNull(), F.col("_clean"))).when(F.col("_kind") == "range", clamped).when(F.col("_kind") == "text", F.coalesce("_exact", "_near"))
    found = found.withColumn("_hit", hit).withColumn("value", F.coalesce("_hit", "answer")).withColumn("matched", F.col("_hit").isNotNull())
    return found.withColumn("unmatched", F.when((F.col("_kind") != "none") & F.col("_hit").isNull(), F.col("answer"))).select(*rows.columns, "value", "matched", "unmatched")
