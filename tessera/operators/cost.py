"""Token and cost estimates."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.documents import token_count
from tessera.operators.blocks import join_blocks

#: Fixed values of the cost model.
PASSAGE_TOKENS, REPLY_TOKENS, FILL, CELL_TOKENS, UNITS_PER_DOCUMENT = 250, 300, 0.7, 40, 1.5


def cost(tokens_in: Column, tokens_out: Column, price_in: float, price_out: float) -> Column:
    """Price of tokens, given by the million, to six places."""
    return F.round(tokens_in / 1e6 * price_in + tokens_out / 1e6 * price_out, 6)


def token_stats(docs: DataFrame) -> DataFrame:
    """n_documents, total_tokens, avg_tokens (whole), max_tokens."""
    t = token_count(F.col("text"))
    total = F.coalesce(F.sum(t), F.lit(0))
    return docs.agg(F.count(F.lit(1)).alias("n_documents"), total.alias("total_tokens"), F.coalesce(F.try_divide(total, F.count(F.lit(1))).cast("long"), F.lit(0)).alias("avg_tokens"), F.coalesce(F.max(t), F.lit(0)).alias("max_tokens"))


def discovery(docs: DataFrame, batch: int, k: int, price_in: float, price_out: float) -> DataFrame:
    """calls, tokens_in, tokens_out, cost of finding a schema: a call for each batch and one for the unit."""
    calls = (F.ceil(F.count(F.lit(1)) / F.lit(batch)) + 1).cast("long")
    one = docs.agg(calls.alias("calls"), (calls * F.lit(k * PASSAGE_TOKENS)).alias("tokens_in"), (calls * F.lit(REPLY_TOKENS)).alias("tokens_out"))
    return one.withColumn("cost", cost(F.col("tokens_in"), F.col("tokens_out"), price_in, price_out))


def extraction(docs: DataFrame, columns: int, price_in: float, price_out: float) -> DataFrame:
    """calls, tokens_in, tokens_out, cost of filling the table: each document once, and once for each unit."""
    n = F.count(F.lit(1))
    units = F.floor(n * UNITS_PER_DOCUMENT).cast("long")
    out = units * F.lit(max(100, int(columns * FILL * CELL_TOKENS)))
    one = docs.agg((n + units).alias("calls"), F.floor(F.coalesce(F.sum(token_count(F.col("text"))), F.lit(0)) * (1 + UNITS_PER_DOCUMENT)).cast("long").alias("tokens_in"), out.alias("tokens_out"))
    return one.withColumn("cost", cost(F.col("tokens_in"), F.col("tokens_out"), price_in, price_out))


def warnings(one: DataFrame, context: int) -> DataFrame:
    """``one`` with what an estimate should warn of."""
    return one.withColumn("warnings", F.filter(F.array(F.when(F.col("tokens_in") / F.col("calls") > 0.8 * context, "near the context limit"), F.when(F.col("cost") > 10, "over 10 dollars")), lambda w: w.isNotNull()))


def calls_by_stage(log: DataFrame) -> DataFrame:
    """stage, calls, tokens of a call log."""
    return log.groupBy("stage").agg(F.count(F.lit(1)).alias("calls"), F.sum(F.floor((F.col("prompt_length") + F.col("completion_length")) / 4).cast("long")).alias("tokens"))


def price_of(models: DataFrame, prices: DataFrame, default: tuple[float, float]) -> DataFrame:
    """model, price_in, price_out: by equal name, else where one name holds the other (the longest known), else the default."""
    known = prices.select(F.col("model").alias("known"), F.struct("price_in", "price_out").alias("p"))
    equal = models.select("model").distinct().join(known, F.col("model") == F.col("known"), "left")
    rest = equal.where("known is null").select("model")
    part = join_blocks(rest, known, F.col("model").contains(F.col("known")) | F.col("known").contains(F.col("model")))
    found = equal.select("model", "p", F.when(F.col("known").isNotNull(), F.lit(-1)).alias("n")).unionByName(part.select("model", "p", (-F.length("known")).alias("n")))
    one = found.groupBy("model").agg(F.min_by("p", "n").alias("p"))
    return one.select("model", F.coalesce("p.price_in", F.lit(default[0])).alias("price_in"), F.coalesce("p.price_out", F.lit(default[1])).alias("price_out"))
