"""Columns of many schemas at once: features, cosine pairs, clusters by average linkage, their names, and the cluster a new column joins.

Input are columns: schema, seq (order within the schema), name, definition, rationale, data_type, allowed (an array).
Both sides of every join grow with the columns, while their files may compress to next to nothing, by which Spark would
take them for small: joins are merges, so that the driver gathers no side.
"""

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.cells import bound
from tessera.functions.features import marks
from tessera.sources.scratch import new_path

#: Words of definitions that say nothing.
STOP_WORDS = (
    "the a an and or but in on at to for of with by from as is was are were been be have has had do does did will would could should may might "
    "must shall can need dare ought used this that these those which who whom whose what where when why how all each every both few more most "
    "other some such than too very just also now here there then once only own same so not nor any into over after before"
).split()
#: The least average similarity of a merge, columns of a cluster, clusters, and the least similarity of a suggestion.
LEAST, MOST_COLUMNS, MOST_CLUSTERS, SUGGEST = 0.25, 8, 10, 0.3
#: Similarities are whole numbers of this many parts, so that sums don't depend on their order and ties are ties.
PARTS = 10**12
#: Merges of a schema in one job; positions from here on are merged clusters.
ROUNDS, MERGED = 8, 1 << 30


def name_tokens(name: Column) -> Column:
    """Words of a column name, apart at capitals, underscores and hyphens, without single characters."""
    words = F.split(F.lower(F.regexp_replace(F.regexp_replace(name, "([a-z])([A-Z])", "$1 $2"), "[_-]", " ")), r"\s+")
    return F.filter(words, lambda w: F.length(w) > 1)


def text_tokens(text: Column) -> Column:
    """Words of a text that have three characters or more and say something."""
    words = F.split(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^a-z0-9\s]", " "), r"\s+")
    return F.filter(words, lambda w: (F.length(w) > 2) & ~w.isin(STOP_WORDS))


def common_terms(columns: DataFrame) -> DataFrame:
    """schema, term of words that half of a schema's column names have."""
    n = columns.groupBy("schema").agg(F.count(F.lit(1)).alias("n"))
    seen = columns.select("schema", F.explode(F.array_distinct(name_tokens(F.col("name")))).alias("term")).groupBy("schema", "term").agg(F.count(F.lit(1)).alias("df"))
    return seen.join(n.hint("merge"), "schema").where(F.col("df") >= F.ceil(F.col("n") / 2)).select("schema", "term")


def _said(columns: DataFrame, common: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Columns' marks (schema, seq, marks), and their words that are not common (schema, seq, term, freq)."""
    text = F.concat_ws(" ", F.coalesce("name", F.lit("")), F.coalesce("definition", F.lit("")), F.coalesce("rationale", F.lit("")))
    words = F.concat(F.coalesce(name_tokens(F.col("name")), F.array()), text_tokens(F.col("definition")), text_tokens(F.col("rationale")))
    base = columns.select("schema", "seq", words.alias("words"), marks(text, F.col("data_type"), F.col("allowed")).alias("marks"))
    terms = base.select("schema", "seq", F.explode("words").alias("term")).groupBy("schema", "seq", "term").agg(F.count(F.lit(1)).alias("freq")).join(common.hint("merge"), ["schema", "term"], "left_anti")
    return base.select("schema", "seq", "marks"), terms


def _idf(n: Column, df: Column) -> Column:
    return F.log(n / df) + 1


def _weighed(base: DataFrame, terms: DataFrame, *idfs: str) -> DataFrame:
    """schema, seq and, by the name of each idf that ``terms`` has, a map of feature to weight."""
    own = terms.groupBy("schema", "seq").agg(F.sum("freq").alias("total"), F.sort_array(F.collect_list(F.struct("term", "freq", *idfs))).alias("terms"))
    flags = F.filter(F.transform("marks", lambda w, i: F.struct(F.concat(F.lit("\u0000"), i.cast("string")).alias("key"), w.alias("value"))), lambda e: e["value"] > 0)
    parts = lambda idf: F.transform("terms", lambda t: F.struct(t["term"].alias("key"), (t["freq"] / F.col("total") * t[idf]).alias("value")))
    none = F.array().cast("array<struct<key:string,value:double>>")
    return base.join(own.hint("merge"), ["schema", "seq"], "left").select("schema", "seq", *[F.map_from_entries(F.concat(F.coalesce(parts(idf), none), flags)).alias(idf) for idf in idfs])


def vectors(columns: DataFrame, common: DataFrame) -> DataFrame:
    """schema, seq, vector (map of feature to weight): TF-IDF of the words that are not common, type, allowed values and domains."""
    base, terms = _said(columns, common)
    n = columns.groupBy("schema").agg(F.count(F.lit(1)).alias("n"))
    df = terms.groupBy("schema", "term").agg(F.count(F.lit(1)).alias("df")).join(n.hint("merge"), "schema")
    return _weighed(base, terms.join(df.hint("merge"), ["schema", "term"]).withColumn("vector", _idf(F.col("n"), F.col("df"))), "vector")


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two sparse vectors (maps), 0 where one is empty."""
    total = lambda values: F.aggregate(values, F.lit(0.0), lambda s, x: s + x)
    norm = lambda v: F.sqrt(total(F.transform(F.map_values(v), lambda x: x * x)))
    dot = total(F.transform(F.map_keys(a), lambda k: F.element_at(a, k) * F.coalesce(F.element_at(b, k), F.lit(0.0))))
    return F.coalesce(F.try_divide(dot, norm(a) * norm(b)), F.lit(0.0))


def cosine_pairs(rows: DataFrame, threshold: float) -> DataFrame:
    """schema, a, b, score of pairs a < b of one schema whose cosine is ``threshold`` or more, or above 0 for a threshold of 0.

    A vector is posted under its rarest features only, until what is left of it is too short to reach the threshold
    with any vector of length 1. The rarest feature two similar vectors share is posted by both, so only pairs that can
    reach the threshold meet; each is verified once.
    """
    rows = _written(rows, "vectors")
    entries = rows.select("schema", "seq", F.explode("vector").alias("f", "w")).where("w <> 0")
    df = entries.groupBy("schema", "f").agg(F.count(F.lit(1)).alias("df"))
    length = F.aggregate(F.map_values("vector"), F.lit(0.0), lambda s, x: s + x * x)
    posted = rows.select("schema", "seq", length.alias("long"), F.explode("vector").alias("f", "w")).where("w <> 0").join(df.hint("merge"), ["schema", "f"])
    rest = F.sum(F.col("w") * F.col("w") / F.col("long")).over(Window.partitionBy("schema", "seq").orderBy(F.desc("df"), F.desc("f")).rowsBetween(Window.unboundedPreceding, 0))
    posted = posted.withColumn("rest", rest).where(F.col("rest") >= threshold * threshold - 1e-9).where("df > 1").select("schema", "f", "seq")
    met = posted.withColumnRenamed("seq", "a").join(posted.withColumnRenamed("seq", "b").hint("merge"), ["schema", "f"]).where("a < b").select("schema", "a", "b").distinct()
    side = lambda name: rows.select("schema", F.col("seq").alias(name), F.col("vector").alias(f"v_{name}")).hint("merge")
    scored = met.join(side("a"), ["schema", "a"]).join(side("b"), ["schema", "b"]).select("schema", "a", "b", cosine(F.col("v_a"), F.col("v_b")).alias("score"))
    return scored.where(F.col("score") >= threshold - 1e-12 if threshold > 0 else F.col("score") > 0)


def _written(df: DataFrame, name: str) -> DataFrame:
    df.write.parquet(path := new_path(df.sparkSession, name))
    return df.sparkSession.read.schema(df.schema).parquet(path)


def merges(pairs: DataFrame, least: float = LEAST, most: int = MOST_COLUMNS) -> DataFrame:
    """schema, nth, a, b, score: in each schema the most similar two clusters merge, again and again, by average linkage.

    Only clusters of ``most`` members together merge, while the average reaches ``least``; ties go to the pair whose first, then
    second, cluster stands first, and a merged cluster goes to the end. All schemas merge at once, a pair each a round;
    sums of similarities are what links keep, so a merge adds two links of each neighbour and looks at no vector again.
    """
    none = F.array().cast("array<struct<nth:int,a:int,b:int,score:double>>")
    links = pairs.select("schema", F.col("a").cast("int").alias("a"), F.col("b").cast("int").alias("b"), F.lit(1).alias("n_a"), F.lit(1).alias("n_b"), F.round(F.col("score") * PARTS).cast("long").alias("total"))
    # a row of each schema that is no link stays to the end and has what merged
    keeper = pairs.select("schema").distinct().select("schema", F.lit(-1).alias("a"), F.lit(-1).alias("b"), F.lit(MERGED).alias("n_a"), F.lit(0).alias("n_b"), F.lit(0).cast("long").alias("total"))
    links, done, nth = _written(links.unionByName(keeper), "links"), [], 0
    own = Window.partitionBy("schema")
    while True:
        links = links.withColumn("log", none).repartition("schema")
        for _ in range(ROUNDS):
            average = F.col("total") / (F.col("n_a") * F.col("n_b"))
            fits = (F.col("n_a") + F.col("n_b") <= most) & (average >= least * PARTS)
            best = F.max(F.when(fits, F.struct(average.alias("average"), (-F.col("a")).alias("a"), (-F.col("b")).alias("b"), (F.col("n_a") + F.col("n_b")).alias("n")))).over(own)
            at, found = MERGED + nth, links.withColumn("m", best)
            hit = lambda c: F.coalesce(F.col(c).isin(-F.col("m.a"), -F.col("m.b")), F.lit(False))
            marked = found.withColumn("hit_a", hit("a")).withColumn("hit_b", hit("b")).where("not (hit_a and hit_b)")
            touched = F.col("hit_a") | F.col("hit_b")
            said = F.struct(F.lit(nth).alias("nth"), (-F.col("m.a")).alias("a"), (-F.col("m.b")).alias("b"), (F.col("m.average") / PARTS).alias("score"))
            links = marked.select(
                "schema", F.when(F.col("hit_a"), F.col("b")).otherwise(F.col("a")).alias("a"), F.when(touched, at).otherwise(F.col("b")).alias("b"),
                F.when(F.col("hit_a"), F.col("n_b")).otherwise(F.col("n_a")).alias("n_a"), F.when(touched, F.col("m.n")).otherwise(F.col("n_b")).alias("n_b"), "total",
                F.when((F.col("a") < 0) & F.col("m").isNotNull(), F.array_append("log", said)).otherwise(F.col("log")).alias("log"),
            ).where((F.col("a") < 0) | (F.col("n_a") + F.col("n_b") <= most)).groupBy("schema", "a", "b", "n_a", "n_b").agg(F.sum("total").alias("total"), F.first("log").alias("log"))
            nth += 1  # clusters too large together only grow, so their link is of no more use
        links = _written(links, "links")
        done.append(links.where("a < 0").select("schema", F.explode("log").alias("x")).select("schema", "x.*"))
        if done[-1].where(F.col("nth") == nth - 1).isEmpty():
            return reduce(DataFrame.unionByName, done)
        links = links.drop("log")


def _title(text: Column) -> Column:
    """Each word's first letter a capital, the rest as it is."""
    return F.array_join(F.transform(F.split(text, " "), lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substr(w, F.lit(2)))), " ")


def _label(members: Column) -> Column:
    """Of members (index and tokens) in order: the one or two tokens that most of them have, or the number of the first."""
    flat = F.flatten(F.transform(members, lambda m: m["tokens"]))

    def scored(tokens: Column) -> Column:
        once = F.array_distinct(tokens)
        cover = lambda t: F.size(F.filter(members, lambda m: F.array_contains(m["tokens"], t)))
        times = lambda t: F.size(F.filter(tokens, lambda x: x == t))
        return F.array_sort(F.transform(once, lambda t, i: F.struct((-cover(t)).alias("cover"), (-cover(t) * times(t)).alias("score"), i.alias("i"), t.alias("token"))))

    def named(order: Column) -> Column:
        near = F.filter(order, lambda o, i: (i == 0) | (-o["cover"] >= 0.25 * F.size(members)))
        return F.when(F.size(near) > 0, _title(F.array_join(F.transform(F.slice(near, 1, 2), lambda o: o["token"]), " & "))).otherwise(F.concat(F.lit("Group "), (F.get(members, F.lit(0))["i"] + 1).cast("string")))

    return bound(flat, lambda tokens: bound(scored(tokens), named))


def clusters(columns: DataFrame, least: float = LEAST, most: int = MOST_COLUMNS, count: int = MOST_CLUSTERS) -> DataFrame:
    """schema, nth, name, columns, score of the clusters of every schema, ten at most and then the columns left, eight together.

    Columns stand in the order of ``seq``; their names differ within a schema. A cluster that took no merge scores 1,
    what is left has no score. Names are unique within a schema. Schemas are many and small; one schema's columns come
    together as arrays. A schema of null and columns without a name are left out; other columns are ignored.
    """
    named = columns.where("schema is not null and name is not null")
    numbered = named.withColumn("i", F.row_number().over(Window.partitionBy("schema").orderBy("seq", "name")) - 1).withColumn("seq", F.col("i"))
    numbered = _written(numbered.select("schema", "seq", "name", "definition", "rationale", "data_type", "allowed"), "columns")
    common = common_terms(numbered)
    joined = merges(cosine_pairs(vectors(numbered, common), 0.0), least, most)
    shared = common.groupBy("schema").agg(F.collect_set("term").alias("common"))
    tokens = F.filter(name_tokens(F.col("name")), lambda t: ~F.array_contains(F.coalesce("common", F.array().cast("array<string>")), t) & (F.length(t) > 2))
    own = numbered.join(shared.hint("merge"), "schema", "left").select("schema", F.struct(F.col("seq").alias("i"), "name", tokens.alias("tokens")).alias("c")).groupBy("schema").agg(F.sort_array(F.collect_list("c")).alias("all"))
    steps = joined.groupBy("schema").agg(F.sort_array(F.collect_list(F.struct("nth", "a", "b", "score"))).alias("steps"))
    state = own.join(steps.hint("merge"), "schema", "left")
    single = F.transform("all", lambda c: F.struct(c["i"].cast("int").alias("at"), F.array(c).alias("members"), F.lit(1.0).alias("score")))

    def merge(now: Column, step: Column) -> Column:
        of = lambda at: F.get(F.filter(now, lambda x: x["at"] == at), F.lit(0))["members"]
        left = F.filter(now, lambda x: (x["at"] != step["a"]) & (x["at"] != step["b"]))
        return F.concat(left, F.array(F.struct((step["nth"] + MERGED).alias("at"), F.concat(of(step["a"]), of(step["b"])).alias("members"), step["score"].alias("score"))))

    none = F.array().cast("array<struct<nth:int,a:int,b:int,score:double>>")
    state = state.select("schema", "all", F.aggregate(F.coalesce("steps", none), single, merge).alias("found"))
    best = F.transform(F.slice("found", 1, count), lambda x: F.struct(x["members"].alias("members"), x["score"].alias("score")))
    state = state.select("schema", best.alias("best"), F.array_sort(F.flatten(F.transform(F.slice("found", F.lit(count + 1), F.greatest(F.size("found") - count, F.lit(0))), lambda x: x["members"]))).alias("rest"))
    chunks = F.when(F.size("rest") > 0, F.transform(F.sequence(F.lit(0), F.floor((F.size("rest") - 1) / most).cast("int")), lambda k: F.struct(F.slice("rest", k * most + 1, F.lit(most)).alias("members"), F.lit(None).cast("double").alias("score"))))
    state = state.select("schema", F.size("best").alias("n"), F.concat("best", F.coalesce(chunks, F.array().cast("array<struct<members:array<struct<i:int,name:string,tokens:array<string>>>,score:double>>"))).alias("found"))
    alone = lambda x: _title(F.array_join(F.slice(F.get(x["members"], F.lit(0))["tokens"], 1, 3), " "))

    def base(x: Column, i: Column) -> Column:
        lone = F.when(alone(x) == "", F.concat(F.lit("Group "), (2 * i - F.col("n") + 1).cast("string"))).otherwise(alone(x))
        return F.when(x["score"].isNull() & (F.size(x["members"]) == 1), lone).otherwise(_label(x["members"]))

    other = lambda x: F.transform(F.filter(x["members"], lambda m: F.size(m["tokens"]) >= 2), lambda m: _title(F.array_join(F.slice(m["tokens"], 1, 2), " ")))
    wanted = F.transform("found", lambda x, i: F.struct(base(x, i).alias("name"), other(x).alias("others")))
    state = state.select("schema", "found", wanted.alias("wanted"))

    def take(used: Column, w: Column) -> Column:
        suffixed = F.transform(F.sequence(F.lit(2), F.size(used) + 2), lambda k: F.concat(w["name"], F.lit(" "), k.cast("string")))
        free = F.filter(F.concat(F.array(w["name"]), w["others"], suffixed), lambda n: ~F.array_contains(used, n))
        return F.concat(used, F.array(F.get(free, F.lit(0))))

    names = F.aggregate("wanted", F.array().cast("array<string>"), take)
    out = state.select("schema", "found", names.alias("names")).select("schema", "names", F.posexplode("found").alias("nth", "x"))
    return out.select("schema", (F.col("nth") + 1).alias("nth"), F.get("names", F.col("nth")).alias("name"), F.transform("x.members", lambda m: m["name"]).alias("columns"), F.col("x.score").alias("score"))


def suggest(fresh: DataFrame, columns: DataFrame, found: DataFrame, least: float = SUGGEST) -> DataFrame:
    """schema, column, name, score: for each new column the cluster of its schema to whose members it is most similar on average.

    ``found`` has schema, nth, name, columns. A column whose best average is not above ``least`` has nulls. Weights are
    those of the schema with the one new column; words count as common without it. A new column changes a word's weight
    only by whether it has the word, so that a schema's columns have two vectors, however many new ones there are.
    """
    new = fresh.select("schema", F.struct(F.col("name").alias("column")).alias("seq"), "name", "definition", "rationale", "data_type", "allowed")
    old = _written(columns.select("schema", F.col("seq").cast("long").alias("seq"), "name", "definition", "rationale", "data_type", "allowed"), "columns")
    common = common_terms(old)
    n = old.groupBy("schema").agg((F.count(F.lit(1)) + 1).alias("n"))
    base, terms = _said(old, common)
    df = terms.groupBy("schema", "term").agg(F.count(F.lit(1)).alias("df"))
    known = terms.join(df.join(n.hint("merge"), "schema").hint("merge"), ["schema", "term"])
    theirs = _weighed(base, known.withColumn("without", _idf(F.col("n"), F.col("df"))).withColumn("with", _idf(F.col("n"), F.col("df") + 1)), "without", "with")
    base, terms = _said(new, common)
    asked = terms.join(df.hint("merge"), ["schema", "term"], "left").join(n.hint("merge"), "schema")
    mine = _weighed(base, asked.withColumn("own", _idf(F.col("n"), F.coalesce("df", F.lit(0)) + 1)), "own").withColumnRenamed("seq", "key")
    members = found.select("schema", "nth", F.col("name").alias("cluster"), F.explode("columns").alias("name")).join(old.select("schema", "seq", "name").hint("merge"), ["schema", "name"]).select("schema", "nth", "cluster", "seq")
    met = _written(members.join(theirs.hint("merge"), ["schema", "seq"]), "vectors").join(_written(mine, "vectors").hint("merge"), "schema")
    weights = F.transform_values("without", lambda k, w: F.when(F.map_contains_key("own", k), F.element_at("with", k)).otherwise(w))
    scored = met.select("schema", "key", "nth", "cluster", F.round(bound(weights, lambda v: cosine(F.col("own"), v)) * PARTS).cast("long").alias("score"))
    averages = scored.groupBy("schema", "key", "nth", "cluster").agg((F.sum("score") / F.count(F.lit(1)) / PARTS).alias("score")).where(F.col("score") > least)
    best = averages.groupBy("schema", "key").agg(F.max_by(F.struct("cluster", "score"), F.struct("score", -F.col("nth"))).alias("b"))
    return new.select("schema", F.col("seq").alias("key")).join(best.hint("merge"), ["schema", "key"], "left").select("schema", "key.column", F.col("b.cluster").alias("name"), F.col("b.score").alias("score"))
