"""Retrieval of passages by cosine, the best k of each document."""

from collections.abc import Iterator
from typing import Protocol

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.similarity import cosine


class Retriever(Protocol):
    def query(self, passages: DataFrame, question: str, k: int) -> DataFrame: ...


def scored(passages: DataFrame, vector: str, query: Column) -> DataFrame:
    return passages.withColumn("similarity", cosine(F.col(vector), query))


def top_k(rows: DataFrame, group: str, order: str, k: int) -> DataFrame:
    """The k most similar rows of each group, later ones first among equals; none for k = 0."""
    w = Window.partitionBy(group).orderBy(F.desc("similarity"), F.desc(order))
    return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def dynamic_k(rows: DataFrame, group: str, order: str, threshold: float, least: int) -> DataFrame:
    """As ``top_k``, with k the number of rows above ``threshold`` and ``least`` at least. The count is a join of an aggregate."""
    k = rows.groupBy(group).agg(F.greatest(F.count_if(F.col("similarity") > threshold), F.lit(least)).alias("k"))
    w = Window.partitionBy(group).orderBy(F.desc("similarity"), F.desc(order))
    return rows.join(k, group).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= F.col("k"))


def rerank(rows: DataFrame, score: Column, group: str, order: str, k: int) -> DataFrame:
    """The k rows of each group by another ``score``, later ones first among equals."""
    return top_k(rows.drop("rank").withColumn("similarity", score), group, order, k)


def ranked_in_batches(rows: DataFrame, score: Column, group: str, order: str, k: int, most: int) -> DataFrame:
    """The k best rows of each group by a scorer that takes ``most`` rows at once: 2 k of each batch are ranked once more."""
    place = F.row_number().over(Window.partitionBy(group).orderBy(order))
    held = rows.withColumn("_batch", F.floor((place - 1) / most)).withColumn("similarity", score)
    w = Window.partitionBy(group, "_batch").orderBy(F.desc("similarity"), F.desc(order))
    finalists = held.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= 2 * k).drop("rank", "_batch")
    return top_k(finalists, group, order, k)


def expanded_k(k: int) -> int:
    """Passages for another attempt where the first found nothing."""
    return min(max(2 * k, 8), 24)


def batch_k(k: int, n: int) -> int:
    """Passages for ``n`` questions that are asked together."""
    return min(k * n, 15)


def retrieval_question(query: Column, columns: Column | None = None) -> Column:
    """What is asked of passages for columns (name, definition): the query and, of each, what it is about."""
    if columns is None:
        return query
    told = F.array_join(F.transform(columns, lambda c: F.concat(F.lit("Information about "), c["name"], F.lit(": "), c["definition"])), " ")
    return F.when(F.size(columns) > 0, F.concat(query, F.lit(" "), told)).otherwise(query)


#: Questions that go to all tasks at once; passages of a batch that are scored together.
QUESTIONS, BATCH = 2000, 2000


def nearest(passages: DataFrame, questions: DataFrame, by_document: bool = False) -> DataFrame:
    """question, (document,) passage, similarity, rank: for each question its k most similar passages, of all or of each document.

    ``questions`` has question (long), vector, k; ``passages`` passage (long), vector and, by document, document (long). Cosine as
    in ``cosine``, to nine decimals; among equals the later passage comes first. Questions are a stated set: they go round
    in blocks of QUESTIONS, each held against all passages; a task keeps the k best of each question while its batches
    go by, and only those are shuffled. Null vectors, and vectors of another length than the question's, match nothing; k = 0 retrieves nothing.
    """
    spark = passages.sparkSession
    total, widest = questions.agg(F.count(F.lit(1)), F.coalesce(F.max("k"), F.lit(0))).first()
    blocks = max(1, -(-total // QUESTIONS))
    rows = passages.where("vector is not null").select(*(["document"] if by_document else []), "passage", "vector")
    kinds = f"question long, {'document long, ' if by_document else ''}passage long, similarity double"
    out = None
    for b in range(blocks):
        own = questions.where("vector is not null").select("question", "vector")
        if blocks > 1:
            own = own.where(F.pmod(F.xxhash64("question"), F.lit(blocks)) == b)
        block = sorted((r.question, r.vector) for r in own.collect())  # some QUESTIONS rows
        found = rows.mapInArrow(_scorer(block, widest, by_document), kinds)
        out = found if out is None else out.unionByName(found)
    group = ["question", "document"] if by_document else ["question"]
    near = Window.partitionBy(*group).orderBy(F.desc("similarity"), F.desc("passage"))
    ranked = out.withColumn("rank", F.row_number().over(near)).where(F.col("rank") <= widest)
    return ranked.join(questions.select("question", "k"), "question").where(F.col("rank") <= F.col("k")).drop("k")


def _scorer(block: list, k: int, by_document: bool):
    """A function of batches of passages: the k best of each question of ``block`` that they hold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width = len(block[0][1]) if block else 0
        same = [q for q in block if len(q[1]) == width]
        names = np.array([q[0] for q in same], np.int64)
        asked = np.array([q[1] for q in same], np.float64).reshape(len(same), width)
        asked /= np.sqrt((asked * asked).sum(1))[:, None] + 1e-8
        kept = (np.zeros((len(same), 0)), np.zeros((len(same), 0), np.int64))
        for batch in batches:
            for i in range(0, batch.num_rows, BATCH):
                part = batch.slice(i, BATCH)
                part = part.filter(pc.equal(pc.list_value_length(part.column("vector")), width))
                if not part.num_rows or not len(same) or not k:
                    continue
                v = part.column("vector").flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width)
                v /= np.sqrt((v * v).sum(1))[:, None] + 1e-8
                score, ids = np.round(asked @ v.T, 9), part.column("passage").to_numpy()
                if by_document:
                    of = part.column("document").to_numpy()
                    for q in range(len(same)):
                        order = np.lexsort((-ids, -score[q], of))
                        first = np.flatnonzero(np.append(True, np.diff(of[order]) != 0))
                        place = np.arange(len(order)) - np.repeat(first, np.diff(np.append(first, len(order))))
                        best = order[place < k]
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(best), names[q])), pa.array(of[best]), pa.array(ids[best]), pa.array(score[q, best])], ["question", "document", "passage", "similarity"])
                else:
                    score, ids = np.concatenate([kept[0], score], 1), np.concatenate([kept[1], np.broadcast_to(ids, (len(same), len(ids)))], 1)
                    best = np.lexsort((-ids, -score), axis=1)[:, :k]
                    kept = np.take_along_axis(score, best, 1), np.take_along_axis(ids, best, 1)
        if not by_document and kept[0].shape[1]:
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(names, kept[0].shape[1])), pa.array(kept[1].ravel()), pa.array(kept[0].ravel())], ["question", "passage", "similarity"])

    return run


def missing_embeddings(passages: DataFrame, store: DataFrame) -> DataFrame:
    """Passages whose digest the store of embeddings lacks."""
    return passages.withColumn("key", F.md5("text")).join(store.select("key"), "key", "left_anti")


class HashingRetriever:
    """Offline stand-in for an embedder: words hashed to a few hundred counters."""

    def __init__(self, dim: int = 509):
        self.dim = dim

    def embed(self, passages: DataFrame, text: str, name: str) -> DataFrame:
        slots = F.expr(f"transform(regexp_extract_all(lower({text}), '[a-z0-9]+', 0), w -> pmod(xxhash64(w), {self.dim}L))")
        count = F.expr(f"transform(sequence(0L, {self.dim - 1}L), n -> cast(size(filter(_slots, s -> s = n)) as float))")
        return passages.withColumn("_slots", slots).withColumn(name, count).drop("_slots")

    def query(self, passages: DataFrame, question: str, k: int) -> DataFrame:
        both = self.embed(self.embed(passages.withColumn("_q", F.lit(question)), "text", "_v"), "_q", "_w")
        return top_k(scored(both, "_v", F.col("_w")).drop("_v", "_w", "_q"), "doc_id", "pos", k)
