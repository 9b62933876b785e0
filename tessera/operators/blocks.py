"""Tables of any length beside a join without equal keys, in blocks that each fit a broadcast."""

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows and characters of a block, about.
ROWS, CHARS = 50_000, 16_000_000


def blocks(df: DataFrame) -> list[DataFrame]:
    """Parts of ``df`` that hold each of its rows once, as many as its rows and characters ask for."""
    row = F.struct(*df.columns)
    size = df.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.length(F.to_json(row))), F.lit(0)).alias("c")).first()
    n = max(1, -(-size.n // ROWS), -(-size.c // CHARS))
    return [df.where(F.pmod(F.xxhash64(*df.columns), F.lit(n)) == i) for i in range(n)] if n > 1 else [df]


def join_blocks(df: DataFrame, other: DataFrame, on: Column) -> DataFrame:
    """The inner join of both, ``df`` read once for each block of ``other``."""
    return reduce(DataFrame.unionAll, [df.join(F.broadcast(b), on) for b in blocks(other)])
