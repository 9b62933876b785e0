"""Queries on the columns of many schemas: clusters, names, suggestions."""

from pyspark.sql import functions as F

from tessera.operators import clusters
from tessera.plans.registry import query

#: A schema is forty consecutive parts of one brand; its number grows with the table.
BLOCK = 1000
#: Parts of the schemas that each meet all nations.
SHARES = 64


def columns_of(part):
    """Parts as columns: named by their names, defined by type."""
    n = F.col("p_partkey")
    return part.select(
        F.concat_ws("#", "p_brand", F.floor(n / BLOCK).cast("string")).alias("schema"), n.alias("seq"),
        F.concat_ws("_", F.translate("p_name", " ", "_"), (n % BLOCK).cast("string")).alias("name"), F.concat_ws(" ", "p_type", F.when(n % 3 == 0, "of the year").when(n % 3 == 1, "in a city")).alias("definition"),
        F.when(n % 5 > 0, F.concat_ws(" ", F.lit("of"), "p_brand")).alias("rationale"), F.element_at(F.array(*[F.lit(t) for t in ("String", "number", "date", "other")]), (n % 4 + 1).cast("int")).alias("data_type"),
        F.when(F.col("p_size") % 4 == 0, F.array("p_brand")).alias("allowed"),
    )


@query("sim_18_similar_columns", "part")
def _(part):
    """Pairs of columns of one schema with cosine 0.8 or more over words, types, allowed values and domains."""
    rows = columns_of(part)
    found = clusters.cosine_pairs(clusters.vectors(rows, clusters.common_terms(rows)), 0.8)
    return found.withColumn("score", F.round("score", 9))


@query("sim_19_column_clusters", "part")
def _(part):
    """Clusters of every schema's columns, with unique names."""
    return clusters.clusters(columns_of(part)).withColumn("score", F.round("score", 9))


@query("sim_20_suggested_cluster", "part supplier")
def _(part, supplier):
    """For each schema of a brand a new column, one more for each nation of suppliers, and the cluster that each fits.

    The new column has the word and type of the schema's first part; a nation's has the type of the part that its number
    points to. In order of schemas, the schema's own column after those of nations.
    """
    rows = columns_of(part)
    own = rows.select("schema", "seq").join(part.hint("merge"), F.col("p_partkey") == F.col("seq"))
    schemas = own.groupBy("schema").agg(F.sort_array(F.collect_list(F.struct("seq", "p_name", "p_type"))).alias("parts"))
    nations = supplier.where("s_nationkey is not null").select(F.col("s_nationkey").alias("nation")).distinct()
    # every schema meets every nation: schemas are dealt to shares, and each share has all nations
    dealt = schemas.withColumn("share", F.pmod(F.xxhash64("schema"), F.lit(SHARES)).cast("int"))
    met = dealt.join(nations.withColumn("share", F.explode(F.sequence(F.lit(0), F.lit(SHARES - 1)))).hint("merge"), "share").drop("share")
    word = F.element_at(F.split(F.get("parts", F.lit(0))["p_name"], " "), -1)
    asked = schemas.select("*", F.concat(F.lit("new_"), word).alias("name"), F.lit(0).alias("at")).unionByName(met.select("schema", "parts", F.concat(F.lit("new_"), word, F.lit("_nation_"), "nation").alias("name"), F.pmod("nation", F.size("parts")).alias("at")))
    fresh = asked.select("schema", "name", F.get("parts", "at")["p_type"].alias("definition"), F.lit(None).cast("string").alias("rationale"), F.lit("number").alias("data_type"), F.lit(None).cast("array<string>").alias("allowed"))
    return clusters.suggest(fresh, rows, clusters.clusters(rows)).withColumn("score", F.round("score", 9)).orderBy("schema", F.desc("column"))
