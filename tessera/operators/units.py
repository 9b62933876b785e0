"""Units (what a row stands for): views, likeness, merging and duplicates."""

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.cells import bound
from tessera.functions.similarity import dot, ratio, ratio_udf
from tessera.operators.alike import ratio_pairs
from tessera.sources.scratch import new_path

#: Confidence from best to worst.
CONFIDENCE = ["high", "known", "medium", "low"]
#: Parts in which the edges of a node meet its label.
SALTS = 8
#: Names that are no unit.
SUSPICIOUS = ["answer", "excerpts", "confidence", "relevant_passages", "observation_units"]


def unit_summary(df: DataFrame, unit: str, source: str) -> DataFrame:
    """unit, n_rows, documents (sorted, each once) of every unit."""
    return df.where(F.col(unit).isNotNull()).groupBy(F.col(unit).alias("unit")).agg(F.count(F.lit(1)).alias("n_rows"), F.sort_array(F.collect_set(source)).alias("documents"))


def source_counts(df: DataFrame, source: str) -> DataFrame:
    return df.where(F.col(source).isNotNull()).groupBy(F.col(source).alias("source_document")).agg(F.count(F.lit(1)).alias("n_rows"))


def merge_units(df: DataFrame, unit: str, names: list[str], target: str) -> DataFrame:
    """Rows of the named units (without regard to case) under ``target``, their first names in ``original_units``."""
    hit = F.lower(F.col(unit)).isin([n.lower() for n in names])
    return df.withColumn("original_units", F.when(hit, F.array(F.col(unit)))).withColumn(unit, F.when(hit, F.lit(target)).otherwise(F.col(unit)))


def keep_confident(df: DataFrame, confidence: str = "confidence") -> DataFrame:
    return df.where(F.coalesce(F.lower(F.col(confidence)) != "low", F.lit(True)))


def suspicious(name: Column) -> Column:
    """Whether a unit's name is a key of another kind of reply."""
    return F.coalesce(F.lower(F.trim(name)).isin(SUSPICIOUS), F.lit(False))


def best_units(df: DataFrame, document: str, confidence: str, order: str, most: int = 15) -> DataFrame:
    """The ``most`` units of each document by confidence, earlier first."""
    rank = F.coalesce(*[F.when(F.lower(F.col(confidence)) == c, i) for i, c in enumerate(CONFIDENCE)], F.lit(len(CONFIDENCE)))
    w = Window.partitionBy(document).orderBy(rank, order)
    return df.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= most).drop("_n")


def similar_units(names: DataFrame, threshold: float) -> DataFrame:
    """a, b, score of units, a before b: 0.7 of the text ratio and 0.3 of the shared words over the longer's, case apart.

    Names without a word in common score below 0.7, so for a ``threshold`` of 0.7 or more they needn't meet. Two names
    that share two words meet at one of them that is not the commonest of either. Two names that share one word, of
    two or more, get 0.15 for it at most: what is left asks for a ratio so high that they meet only where they share
    that word and a rare character, are of like length and have most characters in common. So no common word's names
    meet each other. Names equal but for case score 1.
    """
    if threshold < 0.7:
        raise ValueError("units below 0.7 may share no word")
    plain = F.trim(F.lower("name"))
    words = F.array_distinct(F.filter(F.split(plain, r"\s+"), lambda w: w != ""))
    keyed = names.where("name is not null").distinct().select("name", plain.alias("low"), words.alias("w"))
    each = keyed.select("name", "low", "w", F.explode("w").alias("k"))
    often = each.groupBy("k").agg(F.count(F.lit(1)).alias("n"))
    ranked = each.join(often, "k").groupBy("name", "low", "w").agg(F.sort_array(F.collect_list(F.struct("n", "k"))).alias("o"))
    rare = ranked.select("name", "low", "w", F.explode(F.transform(F.slice("o", F.lit(1), F.greatest(F.size("o") - 1, F.lit(1))), lambda x: x["k"])).alias("k"))
    side = lambda df, x: df.select("k", *[F.col(c).alias(f"{x}_{c}") for c in ("name", "low", "w")])
    many = side(rare, "a").join(side(rare, "b"), "k").where("struct(a_low, a_name) < struct(b_low, b_name)").where((F.size(F.array_intersect("a_w", "b_w")) > 1) | (F.size("a_w") == 1) & (F.size("b_w") == 1))
    many = many.select("a_name", "a_low", "a_w", "b_name", "b_low", "b_w").distinct()
    one = each.select(F.col("k").alias("grp"), "name", "low", "w")
    near = ratio_pairs(one.select("grp", F.col("low").alias("a")), one.select("grp", F.col("low").alias("b")), (threshold - 0.15) / 0.7).where("a < b").select("a", "b").distinct()
    of = lambda x: keyed.select(F.col("low").alias(x), *[F.col(c).alias(f"{x}_{c}") for c in ("name", "low", "w")])
    few = near.join(of("a"), "a").join(of("b"), "b").where(F.size(F.array_intersect("a_w", "b_w")) == 1).where((F.size("a_w") > 1) | (F.size("b_w") > 1)).select(*many.columns)
    overlap = F.size(F.array_intersect("a_w", "b_w")) / F.greatest(F.size("a_w"), F.size("b_w"))
    score = F.when(F.col("a_low") == F.col("b_low"), 1.0).otherwise(F.round(0.7 * ratio_udf("a_low", "b_low") + 0.3 * overlap, 6))
    return many.unionByName(few).select(F.col("a_name").alias("a"), F.col("b_name").alias("b"), score.alias("score")).where(F.col("score") >= threshold)


def merged_name(a: Column, b: Column) -> Column:
    """name and reason of a merge of two units: the longer name where one holds the other, the first where they differ in case or spaces, else the shorter."""
    x, y = F.trim(a), F.trim(b)
    low = lambda c: F.lower(c)
    tight = lambda c: F.replace(F.lower(c), F.lit(" "), F.lit(""))
    variation = lambda p, q: F.concat(F.lit("'"), p, F.lit("' appears to be a variation of '"), q, F.lit("'"))
    name = F.when(low(y).contains(low(x)), y).when(low(x).contains(low(y)), x).when(tight(x) == tight(y), x).when(F.length(x) <= F.length(y), x).otherwise(y)
    reason = F.when(low(y).contains(low(x)), variation(x, y)).when(low(x).contains(low(y)), variation(y, x)).when(tight(x) == tight(y), "Names differ only in case or spacing").otherwise("names appear to refer to the same entity")
    return F.struct(name.alias("name"), reason.alias("reason"))


def merge_reason(a: Column, b: Column) -> Column:
    """Why two units may be one."""
    return F.when(F.lower(a) == F.lower(b), "same name").when(F.lower(a).contains(F.lower(b)) | F.lower(b).contains(F.lower(a)), "one name within the other").otherwise("similar names")


def best_name(names: Column) -> Column:
    """Of several names one that is not all capitals, and of these the longest."""
    plain = F.filter(names, lambda n: n != F.upper(n))
    pool = F.when(F.size(plain) > 0, plain).otherwise(names)
    return F.aggregate(pool, F.lit(""), lambda a, n: F.when(F.length(n) > F.length(a), n).otherwise(a))


def components(edges: DataFrame) -> DataFrame:
    """node, root of undirected edges (a, b), root the smallest node within reach.

    Labels go to neighbours and jump to their roots' roots until nothing changes, written to the shared folder each
    round. A node's edges meet its label in SALTS parts, and minima are taken before the shuffle, so a node of many
    neighbours is dealt out; roots of many nodes meet their label by a join that Spark splits where it is skewed.
    """
    spark = edges.sparkSession
    salt = F.pmod(F.xxhash64("a"), F.lit(SALTS)).alias("salt")

    def written(df: DataFrame) -> DataFrame:
        df.write.parquet(path := new_path(spark, "components"))
        return spark.read.schema(df.schema).parquet(path)

    both = written(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a is not null and b is not null").distinct())
    labels = written(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("root")))
    while True:
        copies = labels.select(F.col("node").alias("b"), "root", F.explode(F.expr(f"sequence(0L, {SALTS - 1}L)")).alias("salt"))
        near = both.select("a", "b", salt).join(copies, ["b", "salt"]).groupBy(F.col("a").alias("node")).agg(F.min("root").alias("near"))
        jump = labels.selectExpr("node AS root", "root AS far")
        nxt = written(labels.join(near, "node").join(jump, "root", "left").selectExpr("node", "least(root, near, coalesce(far, root)) AS root", "root AS was"))
        if nxt.where("root <> was").isEmpty():
            return nxt.select("node", "root")
        labels = nxt.select("node", "root")


def similar_pairs(rows: DataFrame, threshold: float, pivots: int = 3) -> DataFrame:
    """document, a, b (a < b, numbers of units) of one document whose vectors have cosine ``threshold`` or more, or of whose names one holds the other.

    Angles are a metric: units whose angles to one of the document's first vectors differ by more than the threshold's are not
    similar. Units meet by that angle in strips as wide as the threshold, are held to further vectors, then measured.
    Names meet at the first three characters of the one that is held.
    """
    width = math.acos(threshold)
    unit = rows.where("vector is not null and size(vector) > 0")
    length = F.sqrt(dot(F.col("vector"), F.col("vector"))) + 1e-8
    unit = unit.select("document", "seq", bound(length, lambda n: F.transform("vector", lambda x: x.cast("double") / n)).alias("v"))
    first = unit.withColumn("_n", F.row_number().over(Window.partitionBy("document").orderBy("seq"))).where(F.col("_n") <= pivots).groupBy("document").agg(F.transform(F.sort_array(F.collect_list(F.struct("seq", "v"))), lambda x: x["v"]).alias("p"))
    angle = lambda a, b: F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot(a, b))))
    placed = unit.join(first, "document").select("document", "seq", "v", F.transform("p", lambda p: angle(F.col("v"), p)).alias("angles")).withColumn("strip", F.floor(F.get("angles", F.lit(0)) / width))
    other = placed.select("document", F.col("seq").alias("seq_b"), F.col("v").alias("v_b"), F.col("angles").alias("angles_b"), F.explode(F.array(F.col("strip") - 1, F.col("strip"), F.col("strip") + 1)).alias("strip"))
    met = placed.join(other, ["document", "strip"]).where("seq < seq_b").where(~F.exists(F.zip_with("angles", "angles_b", lambda x, y: F.abs(x - y) > width + 1e-6), lambda far: far))
    near = met.where(dot(F.col("v"), F.col("v_b")) >= threshold).select("document", F.col("seq").alias("a"), F.col("seq_b").alias("b"))
    named = rows.select("document", "seq", F.trim(F.lower("name")).alias("low")).where("length(low) > 2")
    grams = F.array_distinct(F.transform(F.sequence(F.lit(1), F.length("low") - 2), lambda i: F.substring(F.col("low"), i, F.lit(3))))
    inner = named.select("document", F.col("seq").alias("i"), F.col("low").alias("low_i"), F.substring("low", 1, 3).alias("g"))
    held = inner.join(named.select("document", F.col("seq").alias("o"), F.col("low").alias("low_o"), F.explode(grams).alias("g")), ["document", "g"]).where("i <> o").where(F.col("low_o").contains(F.col("low_i")))
    return near.unionByName(held.select("document", F.least("i", "o").alias("a"), F.greatest("i", "o").alias("b"))).distinct()


def first_similar(pairs: DataFrame) -> DataFrame:
    """document, seq, seed of every unit that joins another: the earliest similar one that joins none itself.

    In rounds: a unit whose earlier similar units all join others is a seed; one with a seed among them is decided once
    every still earlier one is. The earliest undecided of each document is decided in any round, most far sooner.
    """
    spark = pairs.sparkSession

    def written(df: DataFrame) -> DataFrame:
        df.write.parquet(path := new_path(spark, "units"))
        return spark.read.schema(df.schema).parquet(path)

    pairs = written(pairs)
    # state: null undecided, true a seed, false joins another; without earlier similar units a unit is a seed
    later = pairs.select("document", F.col("b").alias("seq")).distinct()
    state = written(pairs.select("document", F.col("a").alias("seq")).join(later, ["document", "seq"], "left_anti").distinct().withColumn("seed", F.lit(True)).unionByName(later.withColumn("seed", F.lit(None).cast("boolean"))))
    while not state.where("seed is null").isEmpty():
        before = pairs.join(state.withColumnsRenamed({"seq": "a", "seed": "seed_a"}), ["document", "a"]).groupBy("document", F.col("b").alias("seq")).agg(F.max(F.coalesce("seed_a", F.lit(False))).alias("some"), F.count(F.when(F.col("seed_a").isNull(), 1)).alias("open"))
        now = F.coalesce(F.col("seed"), F.when(F.col("some"), False).when(F.col("open") == 0, True))
        state = written(state.join(before, ["document", "seq"], "left").select("document", "seq", now.alias("seed")))
    seeds = state.where("seed").select("document", F.col("seq").alias("a"))
    return pairs.join(seeds, ["document", "a"]).join(seeds.withColumnRenamed("a", "b"), ["document", "b"], "left_anti").groupBy("document", F.col("b").alias("seq")).agg(F.min("a").alias("seed"))


def dedup_units(df: DataFrame, document: str = "document", name: str = "name", vector: str = "vector", confidence: str = "confidence", threshold: float = 0.85) -> DataFrame:
    """document, seq, name, confidence, members, passages: units that join the first earlier seed they resemble, as one.

    ``df`` has the columns named, seq (order, no two alike in a document) and, maybe, passages (an array). Units resemble each other by cosine
    or where one name of three characters or more holds the other, whatever the case; a unit that joined another is no
    seed. The group takes the name and confidence of its best confidence, the earliest of equals; members and passages
    stand in that order, passages once by their first 200 characters. Other confidences than the four known count as medium; a unit without vector or name resembles
    none by it. An empty table gives none; other columns are ignored.
    """
    spark = df.sparkSession
    passages = F.col("passages") if "passages" in df.columns else F.array().cast("array<string>")
    own = df.select(F.col(document).alias("document"), "seq", F.col(name).alias("name"), F.col(vector).alias("vector"), F.col(confidence).alias("confidence"), passages.alias("passages"))
    own.write.parquet(path := new_path(spark, "units"))
    own = spark.read.schema(own.schema).parquet(path)
    joined = first_similar(similar_pairs(own, threshold))
    rank = F.coalesce(*[F.when(F.coalesce("confidence", F.lit("medium")) == c, i) for i, c in enumerate(CONFIDENCE)], F.lit(CONFIDENCE.index("medium")))
    member = F.struct(rank.alias("rank"), "seq", "name", F.coalesce("passages", F.array().cast("array<string>")).alias("passages"), F.col("confidence").alias("confidence"))
    grouped = own.join(joined, ["document", "seq"], "left").groupBy("document", F.coalesce("seed", "seq").alias("seq")).agg(F.sort_array(F.collect_list(member)).alias("m"))
    seen = lambda kept, p: F.exists(kept, lambda k: F.substring(k, 1, 200) == F.substring(p, 1, 200))
    passages = F.aggregate(F.flatten(F.transform("m", lambda x: x["passages"])), F.array().cast("array<string>"), lambda kept, p: F.when(seen(kept, p), kept).otherwise(F.concat(kept, F.array(p))))
    alone = F.size("m") == 1
    return grouped.select(F.col("document").alias(document), "seq", F.get("m", F.lit(0))["name"].alias(name), F.get("m", F.lit(0))["confidence"].alias(confidence), F.transform("m", lambda x: x["name"]).alias("members"), F.when(alone, F.get("m", F.lit(0))["passages"]).otherwise(passages).alias("passages"))


def likeness(a: str, b: str) -> float:
    """Of two names on the driver."""
    wa, wb = set(a.lower().split()), set(b.lower().split())
    return 0.7 * ratio(a.lower(), b.lower()) + 0.3 * len(wa & wb) / max(1, len(wa), len(wb))

