"""Whole tables in an order: numbers of rows and running totals, without bringing them to one task."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.sources.scratch import new_path


def _ranges(df: DataFrame, order: list[Column | str]) -> DataFrame:
    """``df`` in ranges of ``order``, each a part with its number, written so that parts stay what they are."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    df.repartitionByRange(n, *order).withColumn("_part", F.spark_partition_id()).write.parquet(path := new_path(df.sparkSession, "ranges"))
    return df.sparkSession.read.parquet(path)


def numbered(df: DataFrame, order: list[Column | str], name: str = "position") -> DataFrame:
    """``df`` with the place of each row in ``order``, from 0; rows equal in it stand in no fixed order.

    Rows are dealt in ranges, numbered within each, and moved up by the rows of the ranges before: a row for each range
    is all that is gathered.
    """
    rows = _ranges(df, order)
    before = rows.groupBy("_part").agg(F.count(F.lit(1)).alias("_n")).withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    place = F.row_number().over(Window.partitionBy("_part").orderBy(*order)) - 1
    return rows.withColumn("_place", place).join(F.broadcast(before), "_part").withColumn(name, F.col("_before") + F.col("_place")).drop("_part", "_before", "_place")


def running_totals(df: DataFrame, order: list[Column | str], columns: dict[str, str]) -> DataFrame:
    """``df`` with running sums, in ``order``, of columns: new name to column; null counts as 0. Rows of ``order`` differ."""
    rows = _ranges(df, order)
    sums = rows.groupBy("_part").agg(*[F.sum(F.coalesce(c, F.lit(0))).alias(f"_{n}") for n, c in columns.items()])
    ahead = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    before = sums.select("_part", *[F.coalesce(F.sum(f"_{n}").over(ahead), F.lit(0)).alias(f"_{n}") for n in columns])
    inside = Window.partitionBy("_part").orderBy(*order)
    rows = rows.withColumns({n: F.sum(F.coalesce(c, F.lit(0))).over(inside) for n, c in columns.items()}).join(F.broadcast(before), "_part")
    return rows.withColumns({n: F.col(n) + F.col(f"_{n}") for n in columns}).drop("_part", *[f"_{n}" for n in columns])
