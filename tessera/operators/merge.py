"""Merging tables of rows: upserts by name with a fallback on paper stems, folds of rows, merges of columns."""

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.sources.scratch import new_path


def last_of(patch: DataFrame, key: str, order: str) -> DataFrame:
    """The last row of each key: a later duplicate wins."""
    w = Window.partitionBy(key).orderBy(F.desc(order))
    return patch.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def paper_stem(paper: Column) -> Column:
    """The part of a paper's name before its first underscore, else its name without extension, in lower case."""
    return F.lower(F.when(paper.contains("_"), F.split_part(paper, F.lit("_"), F.lit(1))).otherwise(F.regexp_replace(paper, r"\.[^.]*$", "")))


def upsert(base: DataFrame, patch: DataFrame, key: str, columns: list[str], order: str, papers: str | None = None, overwrite_null: bool = False) -> DataFrame:
    """``base`` with ``columns`` of the patch row of equal key, else of the row's own first paper whose stem is a patch key in lower case.

    Of patch rows with one key the last counts; of keys equal but for case the one that came up last. Rows that neither
    reaches stay as they are, rows of one key or none keep their own papers, repeated rows stay. A null in the patch
    keeps the old value unless ``overwrite_null``; patch rows without a key or with an empty one are left out.
    """
    spark = base.sparkSession
    named = patch.where(F.coalesce(F.col(key).cast("string"), F.lit("")) != "")
    values = lambda kept: F.struct(*[F.col(c).alias(f"_new_{c}") for c in columns]).alias(kept)
    new = named.groupBy(F.col(key).alias("_key")).agg(F.max_by(values("_"), order).alias("_exact"), F.min(order).alias("_first"))
    hit = base
    if papers:
        base.withColumn("_row", F.monotonically_increasing_id()).write.parquet(path := new_path(spark, "rows"))  # rows keep their numbers
        hit = spark.read.parquet(path)
    hit = hit.join(new.select("_key", "_exact"), hit[key] == F.col("_key"), "left")
    value, reached = F.col("_exact"), F.col("_exact").isNotNull()
    if papers:
        low = new.groupBy(F.lower("_key").alias("_stem")).agg(F.max_by("_exact", "_first").alias("_near"))
        stems = hit.where("_exact IS NULL").select("_row", F.posexplode(papers).alias("_pos", "_paper")).select("_row", "_pos", paper_stem(F.col("_paper")).alias("_stem"))
        second = stems.join(low, "_stem").groupBy("_row").agg(F.min_by("_near", "_pos").alias("_near"))
        hit = hit.join(second, "_row", "left")
        value, reached = F.coalesce("_exact", "_near"), reached | F.col("_near").isNotNull()
    out = []
    for c in base.columns:
        if c in columns:
            got = value[f"_new_{c}"]
            out.append(F.when(reached, got if overwrite_null else F.coalesce(got, hit[c])).otherwise(hit[c]).alias(c))
        else:
            out.append(hit[c])
    return hit.select(*out)


def append_new(base: DataFrame, patch: DataFrame, key: str) -> DataFrame:
    """``base`` and the patch rows of keys it lacks; columns that one side lacks are null there."""
    return base.unionByName(patch.join(base.select(key).distinct(), key, "left_anti"), allowMissingColumns=True)


def add_columns(base: DataFrame, values: DataFrame, key: str, columns: list[str], order: str) -> DataFrame:
    """``base`` with new columns by key; null where there is no value."""
    return base.join(last_of(values, key, order).select(key, *columns), key, "left")


def update_by_position(base: DataFrame, values: DataFrame, position: str, column: str) -> DataFrame:
    """``base`` with a column replaced by position of the row."""
    new = values.select(position, F.col(column).alias("_new"), F.lit(True).alias("_hit"))
    return base.join(new, position, "left").withColumn(column, F.when(F.col("_hit"), F.col("_new")).otherwise(F.col(column))).drop("_new", "_hit")


def update_cell(df: DataFrame, key: str, value: str, column: str, new: Column, order: str) -> DataFrame:
    """``df`` with one cell changed: that of the first row, in order, whose key is ``value``."""
    first = df.where(F.col(key) == value).agg(F.min(order).alias("_first"))
    return df.crossJoin(F.broadcast(first)).withColumn(column, F.when((F.col(key) == value) & (F.col(order) == F.col("_first")), new).otherwise(F.col(column))).drop("_first")


def cross_file_dedup(df: DataFrame, key: str, file_order: str) -> DataFrame:
    """Rows whose key was not seen in an earlier file; repeats within a file and null keys stay.

    The first file of each key is an aggregate, joined back: no key's rows are gathered.
    """
    first = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.min(file_order).alias("_first"))
    return df.join(first, key, "left").where(F.col(key).isNull() | (F.col(file_order) == F.col("_first"))).drop("_first")


def fold_answers(items: Column) -> Column:
    """Answers in order as one: a longer one replaces, another that is shorter is appended, an equal one is left out."""
    step = lambda a, x: F.when(a.isNull() | (a == ""), x).when(x.isNull() | (x == "") | (x == a), a).when(F.length(x) > F.length(a), x).otherwise(F.concat(a, F.lit("; "), x))
    return F.aggregate(items, F.lit(None).cast("string"), step)


def fold_excerpts(items: Column) -> Column:
    """Excerpts in order, each once without regard to case and outer space."""
    seen = lambda a, x: F.exists(a, lambda y: F.lower(F.trim(y)) == F.lower(F.trim(x)))
    return F.aggregate(items, F.array().cast("array<string>"), lambda a, x: F.when(seen(a, x), a).otherwise(F.concat(a, F.array(x))))


def fold_rows(df: DataFrame, key: str, order: str, answer: str) -> DataFrame:
    """One row for each key, its answers folded in order (equal places by the answer), as ``fold_answers`` does.

    The fold depends on the order, so a key's answers go through one task, but as a stream: sorted by Spark, which
    spills, with no more in memory than the answer so far.
    """
    kinds = dict(df.dtypes)
    rows = df.select(key, order, answer).repartition(key).sortWithinPartitions(key, order, answer)

    def fold(batches):
        now, held, begun, out = None, None, False, ([], [])
        for b in batches:
            for k, x in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), strict=True):
                if begun and k != now:
                    out[0].append(now)
                    out[1].append(held)
                    held = None
                if not begun or k != now:
                    now, begun, held = k, True, None
                if not held:
                    held = x
                elif x and x != held:
                    held = x if len(x) > len(held) else f"{held}; {x}"
            if len(out[0]) > 1000:
                yield pa.RecordBatch.from_arrays([pa.array(out[0], b.column(0).type), pa.array(out[1], pa.string())], [key, answer])
                out = ([], [])
        if begun:
            yield pa.RecordBatch.from_arrays([pa.array([*out[0], now], b.column(0).type), pa.array([*out[1], held], pa.string())], [key, answer])

    return rows.mapInArrow(fold, f"`{key}` {kinds[key]}, `{answer}` string")


def merge_columns(columns: list[Column], strategy: str, separator: str = " ") -> Column:
    """Several columns as one: concatenate, combine_unique, take_first or take_longest; blank values don't count."""
    filled = F.filter(F.array(*[c.cast("string") for c in columns]), lambda x: x.isNotNull() & (F.trim(x) != ""))
    if strategy == "combine_unique":
        return F.array_join(F.array_distinct(filled), separator)
    if strategy == "take_first":
        return F.coalesce(F.try_element_at(filled, F.lit(1)), F.lit(""))
    if strategy == "take_longest":
        return F.aggregate(filled, F.lit(""), lambda a, x: F.when(F.length(x) > F.length(a), x).otherwise(a))
    return F.array_join(filled, separator)


def papers_of_rows(df: DataFrame, key: str, papers: str) -> DataFrame:
    """paper, rows: the inverse of rows that name papers."""
    return df.select(F.explode(papers).alias("paper"), key).groupBy("paper").agg(F.sort_array(F.collect_set(key)).alias("rows"))


def availability(refs: DataFrame, local: DataFrame, cloud: DataFrame) -> DataFrame:
    """paper, status (local, cloud, missing), n_rows for papers that rows refer to (row_name, paper)."""
    n = refs.groupBy("paper").agg(F.count_distinct("row_name").alias("n_rows"))
    have = n.join(local.select("paper").distinct().withColumn("_l", F.lit(1)), "paper", "left").join(cloud.select("paper").distinct().withColumn("_c", F.lit(1)), "paper", "left")
    return have.select("paper", F.when(F.col("_l").isNotNull(), "local").when(F.col("_c").isNotNull(), "cloud").otherwise("missing").alias("status"), "n_rows")


def complete_rows(expected: DataFrame, done: DataFrame, key: str, papers: str) -> DataFrame:
    """key, complete: whether all papers a row expects are done."""
    return expected.join(done.select(key, F.col(papers).alias("_done")), key, "left").select(key, (F.size(F.array_except(papers, F.coalesce("_done", F.array().cast("array<string>")))) == 0).alias("complete"))
