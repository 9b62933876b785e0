"""Profiles of columns: counts, completeness, types and patterns, each in one pass over the table."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.cells import is_empty, number, value_kind
from tessera.operators.filters import NUMERIC


def long_form(df: DataFrame, columns: list[str]) -> DataFrame:
    """name, value (text) of every cell: wide columns as rows, without a shuffle."""
    return df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).cast("string").alias("value")) for c in columns])).alias("c")).select("c.*")


def column_profile(df: DataFrame, columns: list[str], policy: str = "N3", nulls_distinct: bool = True) -> DataFrame:
    """name, non_null_count, unique_count of each column: one aggregate over (name, value) pairs, summed before the shuffle.

    ``nulls_distinct``: a null answer counts as a value of its own.
    """
    pairs = long_form(df, columns).groupBy("name", "value").agg(F.count(F.lit(1)).alias("n"))
    unique = F.count(F.lit(1)) if nulls_distinct else F.count("value")
    filled = F.sum(F.when(~is_empty(F.col("value"), policy), F.col("n")).otherwise(0))
    return pairs.groupBy("name").agg(filled.alias("non_null_count"), unique.alias("unique_count"))


def _filled(c: str, policy: str) -> Column:
    return F.count_if(~is_empty(F.col(c), policy))


def completeness(df: DataFrame, columns: list[str], policy: str = "N3") -> DataFrame:
    """One row: total_rows and the percentage of cells that are filled, 0 without cells."""
    filled = sum((_filled(c, policy) for c in columns), F.lit(0))
    cells = F.count(F.lit(1)) * len(columns)
    return df.agg(F.count(F.lit(1)).alias("total_rows"), F.round(F.coalesce(F.try_divide(filled * 100.0, cells), F.lit(0.0)), 6).alias("completeness"))


def fullness(df: DataFrame, columns: list[str]) -> DataFrame:
    """name, fullness (percentage of cells filled, one decimal) of each column."""
    one = df.agg(F.count(F.lit(1)).alias("n"), *[_filled(c, "N2").alias(c) for c in columns])
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("name"), F.round(F.try_divide(F.col(c) * 100.0, F.col("n")), 1).alias("fullness")) for c in columns]))
    return one.select(pairs.alias("c")).select("c.*")


def full_columns(df: DataFrame, columns: list[str], threshold: float) -> list[str]:
    """Columns whose fullness is at least ``threshold``."""
    kept = {r.name for r in fullness(df, columns).where(F.col("fullness") >= threshold).collect()}
    return [c for c in columns if c in kept]


def numeric_range(df: DataFrame, columns: list[str]) -> DataFrame:
    """name, low, high of the numbers in each column, whatever else it holds."""
    pairs = long_form(df, columns)
    return pairs.groupBy("name").agg(F.min(number(F.col("value"))).alias("low"), F.max(number(F.col("value"))).alias("high"))


def distinct_values(df: DataFrame, column: str) -> DataFrame:
    """Values of a column that are not empty, each once."""
    return df.where(~is_empty(F.col(column), "N2")).select(F.col(column).cast("string").alias("value")).distinct()


def pattern_kinds(df: DataFrame, column: str) -> DataFrame:
    """kind, n: how many values look like what."""
    return df.where(F.col(column).isNotNull()).groupBy(value_kind(F.col(column).cast("string")).alias("kind")).agg(F.count(F.lit(1)).alias("n"))


def length_stats(df: DataFrame, column: str) -> DataFrame:
    """Shortest, longest and mean length, and the share of distinct values."""
    text = F.col(column).cast("string")
    return df.agg(F.min(F.length(text)).alias("shortest"), F.max(F.length(text)).alias("longest"), F.round(F.avg(F.length(text)), 6).alias("mean_length"), F.round(F.count_distinct(text) / F.count(text), 6).alias("uniqueness"))


def column_type(values: Column, declared: str = "string", allowed: bool = False) -> Column:
    """Aggregate: the type of a column's values: categorical, json, array, boolean, number, date or string."""
    if allowed:
        return F.lit("categorical")
    if declared in NUMERIC:
        return F.lit("number")
    text = values.cast("string")
    every = lambda c: F.bool_and(F.when(~is_empty(text, "N2"), c))
    return (
        F.when(every(text.rlike(r"^\s*\[.*\]\s*$")), "array")
        .when(every(text.rlike(r"^\s*\{.*\}\s*$")), "json")
        .when(every(F.lower(text).isin("true", "false", "yes", "no")), "boolean")
        .when(every(number(text).isNotNull()), "number")
        .when(every(text.rlike(r"^\d{4}-\d{2}-\d{2}")), "date")
        .otherwise("string")
    )


def column_types(df: DataFrame, columns: list[str], allowed: tuple[str, ...] = ()) -> DataFrame:
    """name, type of each column over all its values."""
    kinds = dict(df.dtypes)
    one = df.agg(*[column_type(F.col(c), kinds[c], c in allowed).alias(c) for c in columns])
    return one.select(F.explode(F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).alias("type")) for c in columns])).alias("c")).select("c.*")


def total_documents(df: DataFrame, papers: str) -> DataFrame:
    """Distinct documents that rows name, or the number of rows where they name none."""
    named = df.select(F.explode_outer(papers).alias("p"), F.lit(1).alias("one"))
    return df.agg(F.count(F.lit(1)).alias("n")).crossJoin(named.agg(F.count_distinct("p").alias("d"))).select(F.when(F.col("d") > 0, F.col("d")).otherwise(F.col("n")).alias("total_documents"))
