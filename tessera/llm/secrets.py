"""Secrets by patterns, and by who owns them: values many owners hold are examples, others look live.

DataFrame functions alone. Every value that a pattern finds is a candidate, and so is every long random-looking token
that stands without a keyword; candidates are hashed, and each hash is counted by distinct repositories (texts) and
owners (sources) of the whole corpus. Widely copied values are examples; a bare token of few owners is reported as
well, as ``reuse`` where some text assigns it to a keyword, as ``token`` elsewhere.
"""

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.workspace import materialise

#: Patterns of a keyword's part and a value's part, by kind, in the order of equal starts, and the value's least length.
BASE = {
    "assign": (r"""(?i)((?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?)([A-Za-z0-9+/_.=-]+)""", 12),
    "access": (r"()(AKIA[A-Z0-9]+)", 18),
    "hex": (r"()([0-9a-f]+)", 16),
}
#: A token that stands alone, and what it must hold to look random.
BARE = (r"()([A-Za-z0-9_-]+)", 20)
RANDOM = ["[0-9]", "[a-z]", "[A-Z]"]
ADDED = ["reuse", "token"]
#: From so many owners on a value is an example. Hashes with a thousandth of all candidates, a thousand at most, are joined by broadcast.
EXAMPLE_OWNERS, HOT_SHARE = 3, 1000
MARK, OTHER = "\u0001", "\u007f"


def bound(value: Column, use) -> Column:
    """``use`` of a value that is worked out once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def running(sizes: Column, block: int = 128) -> Column:
    """Before each element, the sum of those before it; by blocks, as arrays that grow by one are copied each time."""

    def sums(values: Column) -> Column:
        return F.aggregate(values, F.array(F.lit(0).cast("long")), lambda a, x: F.concat(a, F.array(F.element_at(a, -1) + x)))

    def joined(blocks: Column) -> Column:
        before = sums(F.transform(blocks, lambda b: F.element_at(b, -1)))
        return bound(before, lambda at: F.flatten(F.transform(blocks, lambda b, i: F.transform(F.slice(b, F.lit(1), F.size(b) - 1), lambda x: x + F.get(at, i)))))

    cut = F.transform(F.sequence(F.lit(0), F.floor((F.size(sizes) - 1) / block).cast("int")), lambda b: sums(F.slice(sizes, b * block + 1, F.lit(block))))
    return bound(cut, joined)


def matches(text: Column, pattern: str, least: int) -> Column:
    """start, stop (code points) and value of the leftmost matches that do not overlap, as far as the value has ``least`` characters.

    Each match is set off by marks and the text parted there: outside, keyword, value, outside and so on.
    """
    pieces = F.split(F.regexp_replace(text, pattern, f"{MARK}$1{MARK}$2{MARK}"), MARK)

    def found(own: Column) -> Column:
        def spans(at: Column) -> Column:
            each = F.transform(F.sequence(F.lit(0), F.floor(F.size(own) / 3).cast("int") - 1), lambda j: F.struct(
                F.get(at, 3 * j + 1).alias("start"),
                (F.get(at, 3 * j + 2) + F.char_length(F.get(own, 3 * j + 2))).alias("stop"),
                F.get(own, 3 * j + 2).alias("value"),
            ))
            return F.filter(each, lambda s: F.char_length(s["value"]) >= least)

        return F.when(F.size(own) > 1, bound(running(F.transform(own, lambda p: F.char_length(p).cast("long"))), spans))

    none = F.array().cast("array<struct<start:bigint,stop:bigint,value:string>>")
    return F.coalesce(bound(pieces, found), none)


def candidates(docs: DataFrame) -> DataFrame:
    """row, doc_id, owner, repo and spans (start, kind number, stop, hash of the value, whether it is bare) of every row."""
    kinds = list(BASE)
    # only values long enough count, and these runs are maximal, so that shorter ones need not be set off
    wanted = {k: (p[:-2] + f"{{{least if k == 'hex' else least - 4},}})" if k != "assign" else p, least) for k, (p, least) in BASE.items()}
    bare = (BARE[0][:-2] + f"{{{BARE[1]},}})", BARE[1])
    clean = F.translate(F.coalesce("text", F.lit("")), MARK, OTHER)
    wide = lambda v: F.concat(*[F.lpad(F.hex(x), 16, "0") for x in (F.xxhash64(v), F.xxhash64(F.lit(0x5BD1E995), v))])
    seen = lambda spans, no: F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.lit(no).alias("no"), s["stop"].alias("stop"), wide(s["value"]).alias("hash")))
    rows = docs.select("doc_id", F.coalesce("source", F.lit("")).alias("owner"), clean.alias("text"))
    rows = rows.select("doc_id", "owner", F.xxhash64("text").alias("repo"), F.char_length("text").alias("size"), *[matches(F.col("text"), *wanted[k]).alias(k) for k in kinds], matches(F.col("text"), *bare).alias("bare"))
    base = F.array_sort(F.concat(*[seen(F.col(k), i) for i, k in enumerate(kinds)]))
    random = lambda s: reduce(Column.__and__, [F.rlike(s["value"], F.lit(r)) for r in RANDOM])
    lone = seen(F.filter("bare", random), len(kinds))
    rows = rows.select("doc_id", "owner", "repo", base.alias("base"), lone.alias("lone"))
    free = F.filter("lone", lambda t: ~F.exists("base", lambda b: (b["start"] < t["stop"]) & (t["start"] < b["stop"])))
    return rows.select(F.monotonically_increasing_id().alias("row"), "doc_id", "owner", "repo", "base", free.alias("lone"))


def ownership(found: DataFrame) -> DataFrame:
    """hash, hits, repos, owners, assigned (whether some keyword or key pattern has it) of every candidate of ``found``.

    Counted in steps, each summed before its shuffle, so that a value of a third of all rows travels once from each task.
    """
    once = found.groupBy("hash", "owner", "repo").agg(F.count(F.lit(1)).alias("hits"), F.max(F.col("no") < len(BASE) - 1).alias("assigned"))
    by_owner = once.groupBy("hash", "owner").agg(F.count(F.lit(1)).alias("repos"), F.sum("hits").alias("hits"), F.max("assigned").alias("assigned"))
    return by_owner.groupBy("hash").agg(F.sum("hits").alias("hits"), F.sum("repos").alias("repos"), F.count(F.lit(1)).alias("owners"), F.max("assigned").alias("assigned"))


def listed(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in [*BASE, *ADDED]])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["no"]), s["start"].cast("string"), s["stop"].cast("string"))), ",")


def secrets(docs: DataFrame) -> DataFrame:
    """Secrets of every text: numbers by kind, base_sha256 and spans, and n_example, n_live.

    A span is ``kind:start:end`` in code points, end exclusive, by start, then kind. n_example counts spans whose value
    three owners or more hold, n_live the others (bare tokens among them). A null source is an owner of its own; null and
    empty texts have no spans and the digest of nothing; repeated rows give a row each and are one repository; an empty
    table gives none; other columns are ignored.
    """
    rows = materialise(candidates(docs), "candidates")
    each = rows.where("size(base) + size(lone) > 0").select("row", "owner", "repo", F.explode(F.concat("base", "lone")).alias("s")).select("row", "owner", "repo", "s.*")
    owned = materialise(ownership(each), "owned")
    total = owned.agg(F.sum("hits")).first()[0] or 0
    verdict = owned.select("hash", "assigned", (F.col("owners") >= EXAMPLE_OWNERS).alias("example"), (F.col("hits") * HOT_SHARE >= total).alias("hot"))
    hot, cold = F.broadcast(verdict.where("hot").drop("hot")), verdict.where("not hot").drop("hot")
    spans = each.select("row", "hash", "start", "no", "stop")
    told = spans.join(hot, "hash").unionByName(spans.join(hot, "hash", "left_anti").join(cold, "hash"))
    lone, kind = F.col("no") == len(BASE), F.when(F.col("assigned"), len(BASE)).otherwise(len(BASE) + 1)
    told = told.groupBy("row").agg(
        F.collect_list(F.when(lone & ~F.col("example"), F.struct("start", kind.alias("no"), "stop"))).alias("added"),
        F.count(F.when(~lone & F.col("example"), True)).alias("n_example"),
        F.count(F.when(~F.col("example"), True)).alias("n_live"),
    )
    out = rows.join(told, "row", "left").withColumn("own", F.transform("base", lambda s: F.struct(s["start"].alias("start"), s["no"].alias("no"), s["stop"].alias("stop"))))
    every = F.array_sort(F.concat("own", F.coalesce("added", F.array().cast("array<struct<start:bigint,no:int,stop:bigint>>"))))
    numbers = [F.expr(f"cast(size(filter(base, s -> s.no = {i})) as bigint)").alias(f"n_{k}") for i, k in enumerate(BASE)]
    return out.select("doc_id", *numbers, F.sha2(listed(F.col("own")), 256).alias("base_sha256"), listed(every).alias("spans"), *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n_example", "n_live")])
