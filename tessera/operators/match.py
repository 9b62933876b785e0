"""Joins on containment: which text holds which, by an equi-join on grams and a check of the survivors."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.cells import bound
from tessera.operators.blocks import join_blocks
from tessera.sources.scratch import new_path

#: Words of a document's gram, characters of a name's.
WORD_GRAM, CHAR_GRAM = 4, 3


def word_grams(text: Column) -> Column:
    """Hashes of the WORD_GRAM consecutive words from each word on."""
    return _grams(F.filter(F.split(F.lower(text), r"\s+"), lambda w: w != ""))


def inner_grams(text: Column) -> Column:
    """As ``word_grams``, without the first and last word, which may be parts of words in a text that holds this one."""
    words = F.filter(F.split(F.lower(text), r"\s+"), lambda w: w != "")
    return _grams(bound(words, lambda w: F.slice(w, F.lit(2), F.greatest(F.size(w) - 2, F.lit(0)))))


def _grams(words: Column) -> Column:
    def of(h: Column) -> Column:
        n = F.size(h) - WORD_GRAM + 1
        return F.when(n > 0, F.transform(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(WORD_GRAM)]))).otherwise(F.array().cast("array<bigint>"))

    return bound(F.transform(words, lambda w: F.xxhash64(w)), of)


def char_grams(text: Column) -> Column:
    """Hashes of the CHAR_GRAM characters from each character on."""

    def of(low: Column) -> Column:
        n = F.length(low) - CHAR_GRAM + 1
        return F.when(n > 0, F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.xxhash64(F.substring(low, i, F.lit(CHAR_GRAM))))).otherwise(F.array().cast("array<bigint>"))

    return bound(F.lower(text), of)


def holders(inner: DataFrame, outer: DataFrame, own: Column, all_: Column) -> DataFrame:
    """inner, text_in, outer, text_out of ``inner`` (inner, text_in) and ``outer`` (outer, text_out): pairs whose outer text holds the inner one, whatever the case.

    ``own`` are grams that any holder of the inner text has, ``all_`` those of the outer text. Each inner text asks with
    its gram that fewest outer texts have; nothing is compared with all. Texts too short for a gram, and empty ones, go
    by blocks of a broadcast. Null texts hold nothing and are in nothing.
    Repeated rows of ``inner`` count once, those of ``outer`` each.
    """
    asked = inner.where("text_in is not null").select("inner", "text_in", F.array_distinct(own).alias("_g"))
    grams = asked.where(F.size("_g") > 0).select("inner", "text_in", F.explode("_g").alias("_g"))
    wanted = grams.select("_g").distinct()
    has = outer.where("text_out is not null").select("outer", F.explode(all_).alias("_g")).join(wanted, "_g", "left_semi").distinct()
    has.write.parquet(path := new_path(has.sparkSession, "grams"))  # what the inner texts ask for only, read twice
    has = has.sparkSession.read.schema(has.schema).parquet(path)
    often = has.groupBy("_g").agg(F.count(F.lit(1)).alias("_n"))
    # a text of whose grams one is in no outer text is in none of them, and the check below says so
    rarest = grams.join(often, "_g").groupBy("inner", "text_in").agg(F.min_by("_g", F.struct("_n", "_g")).alias("_g"))
    met = rarest.join(has, "_g").drop("_g").join(outer, "outer")
    met = met.where(F.lower("text_out").contains(F.lower("text_in"))).select("inner", "text_in", "outer", "text_out")
    short = asked.where(F.size("_g") == 0).drop("_g")
    return met.unionByName(join_blocks(outer, short, F.lower("text_out").contains(F.lower("text_in"))).select(*met.columns))


def grounded(excerpts: DataFrame, documents: DataFrame) -> DataFrame:
    """``holders`` of excerpts (inner, text_in) among documents (outer, text_out), by words."""
    return holders(excerpts, documents, inner_grams(F.col("text_in")), word_grams(F.col("text_out")))


def containing_names(a: DataFrame, b: DataFrame) -> DataFrame:
    """``holders`` of names, by characters."""
    return holders(a, b, char_grams(F.col("text_in")), char_grams(F.col("text_out")))


def match_rows(truth: DataFrame, predicted: DataFrame, key: str, least: float = 0.3) -> DataFrame:
    """key, match, score: for each truth the prediction that holds it, or is held by it, of the best score; the first of equals.

    The score is the shorter length over the longer; those up to ``least`` don't count. Case counts.
    """
    t, p = truth.select(F.col(key).alias("key")).distinct(), predicted.select(F.col(key).alias("match")).distinct()
    own = t.select(F.col("key").alias("inner"), F.col("key").alias("text_in"))
    other = p.select(F.col("match").alias("outer"), F.col("match").alias("text_out"))
    swap = lambda d, a, b: d.select(F.col(d.columns[0]).alias(a), F.col(d.columns[0]).alias(b))
    pairs = containing_names(own, other).select(F.col("inner").alias("key"), F.col("outer").alias("match"))
    pairs = pairs.unionByName(containing_names(swap(other, "inner", "text_in"), swap(own, "outer", "text_out")).select(F.col("outer").alias("key"), F.col("inner").alias("match"))).distinct()
    pairs = pairs.where(F.col("key").contains(F.col("match")) | F.col("match").contains(F.col("key"))).where((F.length("key") > 0) & (F.length("match") > 0))
    score = F.least(F.length("key"), F.length("match")) / F.greatest(F.length("key"), F.length("match"))
    scored = pairs.withColumn("score", score).where(F.col("score") > least)
    return scored.groupBy("key").agg(F.max("score").alias("score"), F.min_by("match", F.struct(-F.col("score"), F.col("match"))).alias("match"))
