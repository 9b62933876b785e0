"""A table request: document filter, search, rules, sort, page."""

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.cells import number
from tessera.operators.filters import NUMERIC, Rule, apply_rules, of_documents, search

MOST_ROWS = 200
MOST_UNITS = 500


def sort_keys(name: str, kind: str, descending: bool = False, dialect: str = "server") -> list[Column]:
    """Order of one column: empty last in both directions (``ui``: first when descending), numbers before text."""
    col = F.col(name)
    empty = col.isNull() | (col.cast("string") == "")
    place = empty.desc() if dialect == "ui" and descending else empty.asc()
    if kind in NUMERIC or kind in ("timestamp", "date"):
        return [place, col.desc_nulls_last() if descending else col.asc_nulls_last()]
    num, low = number(col), F.when(~empty, F.lower(col))  # all empty cells are equal
    if descending:
        return [place, num.isNull().asc(), num.desc_nulls_last(), low.desc_nulls_last()]
    return [place, num.isNull().asc(), num.asc_nulls_last(), low.asc_nulls_last()]


@dataclass(frozen=True)
class TableRequest:
    rules: list[Rule] = field(default_factory=list)
    term: str = ""
    search_in: list[str] = field(default_factory=list)
    sort: list[tuple[str, str]] = field(default_factory=list)
    tie: str = "doc_id"
    documents: list[str] = field(default_factory=list)
    document_column: str = "source"
    page: int = 0
    page_size: int = 50


class Table:
    """A lazy table under a request; a page is one top-k job, its counts one aggregate."""

    def __init__(self, df: DataFrame, request: TableRequest):
        if not 0 < request.page_size <= MOST_ROWS or request.page < 0:
            raise ValueError(f"a page has 1 to {MOST_ROWS} rows and a number of 0 or more")
        self.request, self.scope = request, of_documents(df, request.documents, request.document_column)

    def filtered(self) -> DataFrame:
        r = self.request
        return apply_rules(search(self.scope, r.term, r.search_in), r.rules)

    def ordered(self) -> DataFrame:
        types = dict(self.scope.dtypes)
        keys = [k for c, way in self.request.sort for k in sort_keys(c, types[c], way == "desc")]
        return self.filtered().orderBy(*keys, self.request.tie)

    def page(self) -> DataFrame:
        r = self.request
        return self.ordered().offset(r.page * r.page_size).limit(r.page_size)

    def counts(self) -> DataFrame:
        """total_count, filtered_count, has_more."""
        r = self.request
        total = self.scope.agg(F.count(F.lit(1)).alias("total_count"))
        kept = self.filtered().agg(F.count(F.lit(1)).alias("filtered_count"))
        return total.crossJoin(kept).withColumn("has_more", F.lit((r.page + 1) * r.page_size) < F.col("filtered_count"))


def unit_page(df: DataFrame, unit: str, order: list[str], page: int, size: int, units: list[str] | None = None) -> DataFrame:
    """All rows of the units on a page. Units go by lower-cased name, then by name, so that ``A`` and ``a`` are two.

    Units are ranked once, on their distinct names, and the rows join the few names of the page.
    """
    if not 0 < size <= MOST_UNITS:
        raise ValueError(f"a page has 1 to {MOST_UNITS} units")
    names = df.where(F.col(unit).isNotNull())
    if units:
        names = names.where(F.col(unit).isin(units))
    names = names.select(unit).distinct().orderBy(F.lower(F.col(unit)), unit).offset(page * size).limit(size)
    return df.join(F.broadcast(names), unit).orderBy(F.lower(F.col(unit)), unit, *order)  # at most MOST_UNITS names


def top_columns(df: DataFrame, sources: dict[str, str]) -> DataFrame:
    """Distinct documents by rows, for the side list of sources."""
    return df.groupBy(*sources).agg(F.count(F.lit(1)).alias("n"))


def runs(df: DataFrame, order: list[str], value: str, within: str | None = None) -> DataFrame:
    """``run`` number of consecutive rows of one value, in order; ``within`` keeps groups of rows apart and in parallel."""
    w = Window.partitionBy(within).orderBy(*order) if within else Window.orderBy(*order)
    changed = F.when(F.lag(value).over(w).eqNullSafe(F.col(value)) & F.lag(F.lit(1)).over(w).isNotNull(), 0).otherwise(1)
    return df.withColumn("_changed", changed).withColumn("run", F.sum("_changed").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_changed")


def longest_runs(df: DataFrame, order: list[str], value: str, within: str) -> DataFrame:
    """``within`` and the length of its longest run, of ``runs``: from one sort, without a table of runs in memory.

    Partitions are as many as the session's, or four for each one read where these are more, so that what a task sorts
    doesn't grow with the input.
    """
    spark = df.sparkSession
    dealt = df.select(within, *order, value).repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * df.rdd.getNumPartitions()), within)
    w = Window.partitionBy(within).orderBy(*order)
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    same = F.lag(value).over(w).eqNullSafe(F.col(value)) & F.lag(F.lit(1)).over(w).isNotNull()
    rows = dealt.select(within, *order, same.alias("_same"), F.row_number().over(w).cast("long").alias("_n"), F.lead(F.lit(1)).over(w).isNull().alias("_last"))
    size = F.col("_n") - F.max(F.when(~F.col("_same"), F.col("_n"))).over(upto) + 1
    return rows.withColumn("_size", size).withColumn("longest", F.max("_size").over(upto)).where("_last").select(within, "longest")
