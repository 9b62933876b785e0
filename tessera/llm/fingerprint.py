"""Document fingerprints: a wide hash of the canonical text, by DataFrame functions alone.

Canonical text: Unicode normal form KC (ICU's, which Spark carries, called by reflection), lower case, runs of white
space as one space, none at either end. Its fingerprint is two 64-bit xxhashes, 32 hex digits. Documents of equal
fingerprint are compared byte by byte before they count as one class.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.workspace import parts

NFKC = "com.ibm.icu.text.Normalizer"
#: Buckets of neighbouring documents for each partition of a shuffle.
BUCKETS = 4


def canonical(text: Column) -> Column:
    folded = F.lower(F.reflect(F.lit(NFKC), F.lit("compose"), F.coalesce(text, F.lit("")), F.lit(True)))
    return F.trim(F.regexp_replace(folded, r"(?U)\s+", " "))


def fingerprint(canon: Column) -> Column:
    wide = [F.xxhash64(canon), F.xxhash64(F.lit(0x5BD1E995), canon, F.lit(0x27D4EB2F))]
    return F.lower(F.concat(*[F.lpad(F.hex(x), 16, "0") for x in wide]))


def numbered(rows: DataFrame) -> DataFrame:
    """``rows`` with ``bucket``: neighbours in (id, tie), whose cuts are quantiles of both, so that no spread of ids fills one bucket.

    The cuts come to the driver, a row for each bucket; each row finds its own by binary search over them.
    """
    n = BUCKETS * parts(rows.sparkSession)
    ranged = rows.select("id", "tie").repartitionByRange(n, "id", "tie").groupBy(F.spark_partition_id().alias("part")).agg(F.min(F.struct("id", "tie")).alias("least"))
    cuts = sorted((r.least.id, r.least.tie) for r in ranged.collect())[1:]
    if not cuts:
        return rows.withColumn("bucket", F.lit(0))
    ids, ties = (F.split(F.lit(",".join(str(c[i]) for c in cuts)), ",").cast("array<bigint>") for i in (0, 1))
    steps = F.array(*[F.lit(1 << k) for k in reversed(range(len(cuts).bit_length()))])

    def step(bucket: Column, size: Column) -> Column:
        cut = bucket + size - 1
        passed = (F.get(ids, cut) < F.col("id")) | (F.get(ids, cut) == F.col("id")) & (F.get(ties, cut) <= F.col("tie"))
        return bucket + F.when(passed, size).otherwise(F.lit(0))

    return rows.withColumn("bucket", F.aggregate(steps, F.lit(0), step))


def with_next(docs: DataFrame) -> DataFrame:
    """doc_id, text, next_text: the text of the next document in descending doc_id, after the last the first's.

    Null texts count as empty. Equal doc_ids follow in an order fixed by a hash of their texts, null doc_ids come last.
    Documents are dealt to buckets of neighbours; each bucket also gets the first document of the bucket that follows,
    so that one shuffle of the texts and no global sort is needed.
    """
    half = F.shiftrightunsigned(F.xxhash64("text"), 1)
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    # null ids come below the least id: their ties are negative
    rows = numbered(rows.withColumn("id", F.coalesce("doc_id", F.lit(-(2**63)))).withColumn("tie", F.when(F.col("doc_id").isNull(), -half - 1).otherwise(half)))
    heads = rows.groupBy("bucket").agg(F.max(F.struct("id", "tie")).alias("top"))  # a row for each bucket
    order = Window.orderBy(F.desc("bucket"))
    last = F.min("bucket").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    heads = heads.select("bucket", F.coalesce(F.lag("bucket").over(order), last).alias("to"), "top.id", "top.tie")
    ghosts = rows.join(F.broadcast(heads), ["bucket", "id", "tie"]).groupBy("to").agg(F.max("text").alias("text"))
    both = rows.withColumn("ghost", F.lit(False)).unionByName(ghosts.select(F.col("to").alias("bucket"), "text", F.lit(True).alias("ghost")), allowMissingColumns=True)
    down = Window.partitionBy("bucket").orderBy("ghost", F.desc("id"), F.desc("tie"))
    return both.withColumn("next_text", F.lead("text").over(down)).where(~F.col("ghost")).select("doc_id", "text", "next_text")


def classes(docs: DataFrame) -> DataFrame:
    """fingerprint, canon_sha256, class_id (smallest doc_id), n_copies of every distinct canonical text of ``docs``.

    Grouping by hash and text compares bytes inside equal buckets and is summed before the shuffle, so copies held by a
    third of all documents travel once from each task.
    """
    canon = docs.select("doc_id", canonical(F.col("text")).alias("canon"))
    found = canon.select("doc_id", "canon", fingerprint(F.col("canon")).alias("fingerprint")).groupBy("fingerprint", "canon").agg(F.min("doc_id").alias("class_id"), F.count(F.lit(1)).alias("n_copies"))
    return found.select("fingerprint", F.sha2("canon", 256).alias("canon_sha256"), "class_id", "n_copies")


def fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprint of every text and of its edited text, and its class of canonical copies.

    The edited text has the last floor(n / 2) code points replaced by as many of the next document's first (or all it
    has). near_edited and near_next are 1.0 where the fingerprints are equal and 0.0 elsewhere: an exact digest knows
    no other likeness. Null and empty texts share one fingerprint; without rows the result is empty; other columns of
    ``docs`` are ignored. Repeated rows give a row each.
    """
    half = F.floor(F.col("n_chars") / 2).cast("int")
    rows = with_next(docs).withColumn("n_chars", F.char_length("text").cast("long"))
    rows = rows.withColumn("edited", F.concat(F.substring("text", F.lit(1), (F.col("n_chars") - half).cast("int")), F.substring("next_text", F.lit(1), half)))
    rows = rows.withColumn("canon", canonical(F.col("text"))).select(
        "doc_id", "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        fingerprint(F.col("canon")).alias("fingerprint"),
        F.sha2("canon", 256).alias("canon_sha256"),
        fingerprint(canonical(F.col("edited"))).alias("edited_fingerprint"),
        fingerprint(canonical(F.col("next_text"))).alias("next_fingerprint"),
    )
    same = lambda c: F.when(F.col("fingerprint") == F.col(c), 1.0).otherwise(0.0)
    rows = rows.select("doc_id", "n_chars", "edited_sha256", "fingerprint", "canon_sha256", "edited_fingerprint", same("edited_fingerprint").alias("near_edited"), same("next_fingerprint").alias("near_next"))
    return rows.join(classes(docs), ["fingerprint", "canon_sha256"], "left").select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "class_id", "n_copies")
