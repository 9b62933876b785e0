"""Near-duplicate documents by an inverted join on MinHash coordinates.

A document is posted under each pair of coordinate and value of its signature. Documents that agree in at least MATCHES
of COORDS coordinates are candidates. Two such documents share a posting among the COORDS - MATCHES + 1 rarest of each
(prefix), so only those postings meet; within a posting, collisions are counted over whole signatures, and members that
are in one cluster already are skipped. Candidates form loose clusters, within which links are confirmed on the full
shingle sets. A pair at similarity 0.8 misses MATCHES collisions about 3 times in a million.
"""

import hashlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.components import cluster, connected_components
from tessera.llm.textcore import seeded, shingles, slices, words
from tessera.llm.workspace import materialise

COORDS, MATCHES = 32, 15


def sets(buf: np.ndarray, offs: np.ndarray, k: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each document."""
    h, at = shingles(*words(buf, offs), k)
    return [np.unique(h[a:b]) for a, b in zip(at.tolist(), at[1:].tolist())]


def signatures(found: list[np.ndarray]) -> np.ndarray:
    """One row of COORDS 32-bit values for each set that is not empty."""
    flat = np.concatenate(found)
    at = np.cumsum([0, *[len(x) for x in found[:-1]]])
    out = np.empty((len(found), COORDS), np.uint32)
    for c in range(COORDS):
        out[:, c] = np.minimum.reduceat(seeded(flat, c) >> np.uint64(32), at)
    return out


def sketches(docs: DataFrame, k: int) -> DataFrame:
    """doc_id, n_shingles, key (digest of the set), signature; both null for a text without words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, buf, offs in slices(batches):
            found = sets(buf, offs, k)
            full = [x for x in found if len(x)]
            sig = iter(signatures(full)) if full else iter(())
            out = [(len(x), hashlib.blake2b(x.tobytes(), digest_size=16).digest(), next(sig).tobytes()) if len(x) else (0, None, None) for x in found]
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.binary()), pa.array([x[2] for x in out], pa.binary())], ["doc_id", "n_shingles", "key", "signature"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_shingles long, key binary, signature binary")


def postings(reps: DataFrame) -> DataFrame:
    """key, doc_id for each coordinate of each signature."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sig = np.frombuffer(b"".join(b.column("signature").to_pylist()), np.uint32).reshape(-1, COORDS)
            key = seeded(sig.astype(np.uint64) << np.uint64(8) | np.arange(COORDS, dtype=np.uint64), 99).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(key.ravel()), pa.array(np.repeat(b.column("doc_id").to_numpy(), COORDS))], ["posting", "doc_id"])

    return reps.select("doc_id", "signature").mapInArrow(run, "posting long, doc_id long")


def collide(payloads: list[bytes]):
    """Of signatures: whether two agree in MATCHES coordinates."""
    sig = np.frombuffer(b"".join(payloads), np.uint32).reshape(-1, COORDS)
    return lambda p, others: (sig[others] == sig[p]).sum(1) >= MATCHES


def overlap(payloads: list[bytes], num: int, den: int):
    """Of sorted hash sets: whether the intersection is num / den of the union or more."""
    size = np.array([len(p) // 8 for p in payloads])
    found = [np.frombuffer(p, np.uint64) for p in payloads]
    flat = np.concatenate(found)
    at = np.concatenate([[0], np.cumsum(size)])

    def linked(p: int, others: np.ndarray) -> np.ndarray:
        near = (size[others] * den >= size[p] * num) & (size[p] * den >= size[others] * num)
        out = np.zeros(len(others), bool)
        few = others[near]
        if len(few) * 4 < len(size):
            both = np.array([np.intersect1d(found[p], found[i], assume_unique=True).size for i in few], np.int64)
        else:
            place = np.minimum(np.searchsorted(found[p], flat), size[p] - 1)
            both = np.add.reduceat((found[p][place] == flat).astype(np.int64), at[:-1])[few]
        out[near] = den * both >= num * (size[p] + size[few] - both)
        return out

    return linked


def near_duplicates(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: documents linked where 100 * intersection >= 80 * union of k-word shingles.

    A text of fewer than k words is one shingle; null texts and texts without words are linked with nothing. Equal sets
    are one document from the start, so copies are never compared. component_id is the smallest doc_id that links
    reach; kept is whether it is the document's own. Repeated rows give a row each and don't count as links; with a null
    doc_id, component_id and kept are null. Other columns are ignored.
    """
    sketch = materialise(sketches(docs, k), "sketch")
    full = sketch.where("key is not null and doc_id is not null")
    reps = full.groupBy("key").agg(F.min("doc_id").alias("doc_id"), F.first("signature").alias("signature"))
    reps = materialise(reps, "reps")
    posted = postings(reps)
    often = posted.groupBy("posting").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    # postings of one document only come first in its prefix and meet nobody
    room = COORDS - MATCHES + 1
    own = posted.join(often, "posting").groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("df", "posting"))).alias("p"))
    prefix = own.select("doc_id", F.explode(F.expr(f"slice(p, 1, greatest(0, {room} - ({COORDS} - size(p))))")).alias("x")).select(F.col("x.posting").alias("grp"), "doc_id")
    loose = cluster(prefix.join(reps.select("doc_id", F.col("signature").alias("payload")), "doc_id").select("grp", "doc_id", "payload"), collide)
    loose = connected_components(loose.where("doc_id <> root").select(F.col("doc_id").alias("u"), F.col("root").alias("v")))

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, buf, offs in slices(batches):
            yield pa.RecordBatch.from_arrays([rows.column("grp"), rows.column("doc_id"), pa.array([x.tobytes() for x in sets(buf, offs, k)], pa.binary())], ["grp", "doc_id", "payload"])

    with_text = docs.select("doc_id", "text").join(loose.select(F.col("node").alias("doc_id"), F.col("root").alias("grp")), "doc_id")
    full_sets = with_text.mapInArrow(gather, "grp long, doc_id long, payload binary").dropDuplicates(["grp", "doc_id"])
    linked = cluster(full_sets, partial(overlap, num=num, den=den)).where("doc_id <> root")
    of_key = reps.select("key", F.col("doc_id").alias("rep")).join(linked.select(F.col("doc_id").alias("rep"), "root"), "rep", "left").select("key", F.coalesce("root", "rep").alias("component"))
    out = sketch.select("doc_id", "n_shingles", "key").join(of_key, "key", "left").select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")).alias("component_id"))
    return out.withColumn("kept", F.col("doc_id") == F.col("component_id"))
