"""Connected components, and clusters within groups of candidates."""

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.workspace import materialise, parts

#: Largest group that one task clusters, in members and in bytes of their payloads; larger ones go round by round.
GROUP, GROUP_BYTES = 20_000, 64 << 20
#: Members of a large group that all others are held against in one round.
PIVOTS = 32


def connected_components(edges: DataFrame) -> DataFrame:
    """node, root of every node of ``edges`` (u, v long): root is the smallest node that can be reached.

    Alternates large-star and small-star steps, written out each time; a node of many neighbours is summed before the
    shuffle and its edges stay rows of their own.
    """
    now = materialise(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    mark = None
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").where("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")).select("e.*").where("u <> v").distinct()
        now = materialise(small, "edges")
        state = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == mark:
            break
        mark = state
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def spanning(n: int, linked: Callable[[int, np.ndarray], np.ndarray]) -> np.ndarray:
    """Cluster of each of n members, the first one's number: each pair is linked, in one cluster already, or found not linked.

    ``linked(p, others)`` says which of ``others`` member p links with. Members of p's own cluster need no comparison.
    """
    root = np.arange(n)
    for p in range(n):
        others = np.flatnonzero(root != root[p])
        if not len(others):
            break
        if len(found := others[linked(p, others)]):
            roots = np.unique(np.append(root[found], root[p]))
            root[np.isin(root, roots)] = roots[0]
    return root


def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[int], list[bytes]]]:
    """doc_ids and payloads of each group of rows sorted by grp; groups of one member are left out."""
    now, ids, payloads = None, [], []
    for b in batches:
        grp = b.column("grp").to_numpy()
        cuts = [0, *(np.flatnonzero(np.diff(grp)) + 1).tolist(), len(grp)]
        doc, payload = b.column("doc_id").to_pylist(), b.column("payload").to_pylist()
        for i, j in zip(cuts, cuts[1:]):
            if i == j:
                continue
            if grp[i] != now:
                if len(ids) > 1:
                    yield ids, payloads
                now, ids, payloads = grp[i], [], []
            ids += doc[i:j]
            payloads += payload[i:j]
    if len(ids) > 1:
        yield ids, payloads


def cluster(members: DataFrame, compare, group: int = GROUP) -> DataFrame:
    """doc_id, root of all members (grp long, doc_id long, payload binary) within each group, root the smallest doc_id.

    ``compare(payloads)`` returns the ``linked`` of ``spanning``. Groups of more than ``group`` members, or of more bytes
    than GROUP_BYTES, are clustered by rounds of joins, without being gathered.
    """
    members = materialise(members, "members")
    sizes = members.groupBy("grp").agg(F.count(F.lit(1)).alias("size"), F.sum(F.length("payload").cast("long")).alias("bytes"))
    large = materialise(sizes.where((F.col("size") > group) | (F.col("bytes") > GROUP_BYTES)).select("grp"), "large")

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, roots = [], []
        for doc, payload in runs(batches):
            found = np.array(doc)[spanning(len(doc), compare(payload))]
            ids += doc
            roots += found.tolist()
            if len(ids) > 50_000:
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(roots, pa.int64())], ["doc_id", "root"])
                ids, roots = [], []
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(roots, pa.int64())], ["doc_id", "root"])

    small = members.join(large, "grp", "left_anti").repartition(parts(members.sparkSession), "grp").sortWithinPartitions("grp", "doc_id").mapInArrow(own, "doc_id long, root long")
    if large.isEmpty():
        return small
    return small.unionByName(_rounds(members.join(large, "grp", "left_semi"), compare))


def _rounds(members: DataFrame, compare) -> DataFrame:
    """As ``cluster``: each round holds PIVOTS members of every group against all members in other clusters."""
    base = materialise(members.withColumn("root", F.col("doc_id")), "rounds")
    after = None
    while True:
        open_ = base.groupBy("grp").agg((F.min("root") < F.max("root")).alias("open")).where("open").select("grp")
        rank = F.row_number().over(Window.partitionBy("grp").orderBy("doc_id"))
        waiting = base.join(open_, "grp")
        if after is not None:
            waiting = waiting.join(after, "grp").where("doc_id > upto").drop("upto")
        pivots = materialise(waiting.withColumn("rank", rank).where(F.col("rank") <= PIVOTS).groupBy("grp").agg(F.collect_list(F.struct("doc_id", "root", "payload")).alias("pivots"), F.max("doc_id").alias("upto")), "pivots")
        if pivots.isEmpty():
            return base.select("doc_id", "root")

        def links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                found = set()
                groups: dict[int, list[dict]] = {}
                for row in b.to_pylist():
                    groups.setdefault(row["grp"], []).append(row)
                for rows in groups.values():
                    pivots = rows[0]["pivots"]
                    linked = compare([p["payload"] for p in pivots] + [r["payload"] for r in rows])
                    roots = np.array([r["root"] for r in rows])
                    for i, p in enumerate(pivots):
                        others = np.flatnonzero(roots != p["root"])
                        if len(others):
                            hit = others[linked(i, others + len(pivots))]
                            found |= {(p["root"], int(x)) for x in np.unique(roots[hit])}
                if found:
                    u, v = zip(*found, strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])

        edges = base.join(pivots.select("grp", "pivots"), "grp").select("grp", "root", "payload", "pivots").mapInArrow(links, "u long, v long")
        merged = connected_components(edges).withColumnRenamed("node", "was")
        base = materialise(base.join(merged, base.root == merged.was, "left").select("grp", "doc_id", "payload", F.coalesce(merged.root, base.root).alias("root")), "rounds")
        after = pivots.select("grp", "upto")
