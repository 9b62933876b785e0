"""Language identification with hyperdimensional profiles.

Every letter has a random vector of +1 and -1. A trigram's vector binds its letters: the first's permuted twice, the
second's once, the third's as it is, multiplied element by element. A document is the sum (bundle) of its trigrams'
vectors, a language the sum of its documents' unit vectors, and a document goes to the language of largest cosine.
Characters that are no letters count as one word boundary.
"""

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.textcore import slices

DIM = 1024
UNKNOWN = "und"
#: Documents from which the prototypes are learnt, about: more labelled rows are thinned evenly by a hash of doc_id.
FIT_DOCUMENTS = 40_000
BLOCK = 4096


@lru_cache(1)
def _folding() -> np.ndarray:
    """Lower-case letter of each code point, 0 where there is none."""
    out = np.zeros(0x110000, np.int32)
    for c in range(0x110000):
        if not 0xD800 <= c < 0xE000 and (x := chr(c)).isalpha():
            out[c] = ord(low) if len(low := x.lower()) == 1 else c
    return out


@lru_cache(20_000)
def letter_vector(code: int) -> np.ndarray:
    return np.random.Generator(np.random.Philox(key=code + 1)).integers(0, 2, DIM, dtype=np.int8) * 2 - 1


def trigrams(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Letters that occur (code points, 0 the boundary), trigram numbers in base len(letters), and each one's document."""
    code = np.frombuffer(buf.tobytes().decode().encode("utf-32-le"), np.uint32)
    chars = np.concatenate([[0], np.cumsum((buf & 0xC0) != 0x80)])[offs]
    sym = np.insert(_folding()[code], chars, 0)  # a boundary before each document and at the end
    doc = np.repeat(np.arange(len(offs)), np.diff(np.append(chars, len(code))) + 1)
    used = np.zeros(0x110000, bool)
    used[sym] = True
    letters = np.flatnonzero(used)
    rank = np.zeros(0x110000, np.int64)
    rank[letters] = np.arange(len(letters))
    sym = rank[sym]
    at = np.flatnonzero(sym[1:-1]) + 1
    k = len(letters)
    return letters, (sym[at - 1] * k + sym[at]) * k + sym[at + 1], doc[at]


def bundles(buf: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """One row for each document: the sum of its trigrams' vectors (zero without letters)."""
    n = len(offs) - 1
    out = np.zeros((n, DIM), np.float32)
    letters, tri, doc = trigrams(buf, offs)
    if not len(tri):
        return out
    k = len(letters)
    if k**3 <= 1 << 24:
        seen = np.zeros(k**3, bool)
        seen[tri] = True
        found = np.flatnonzero(seen)
        place = np.zeros(k**3, np.int32)
        place[found] = np.arange(len(found))
        tri = place[tri]
    else:
        found, tri = np.unique(tri, return_inverse=True)
    base = np.array([letter_vector(c) for c in letters.tolist()])
    base = np.roll(base, 2, 1), np.roll(base, 1, 1), base
    first = np.searchsorted(doc, np.arange(0, n + 256, 256))
    for b in range(0, len(found), BLOCK):
        own = found[b : b + BLOCK]
        table = (base[0][own // (k * k)] * base[1][own // k % k] * base[2][own % k]).astype(np.float32)
        for g, (i, j) in enumerate(zip(first, first[1:])):
            t, d = tri[i:j], doc[i:j] - 256 * g
            if len(found) > BLOCK:
                inside = (t >= b) & (t < b + BLOCK)
                t, d = t[inside] - b, d[inside]
            rows = min(256, n - 256 * g)
            if len(t):
                count = np.bincount(d * len(own) + t, minlength=rows * len(own)).reshape(rows, len(own)).astype(np.float32)
                out[256 * g : 256 * g + rows] += count @ table
    return out


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def fit(docs: DataFrame, at_most: int = FIT_DOCUMENTS) -> dict[str, np.ndarray]:
    """Prototypes of the languages in ``lang`` of ``docs`` (doc_id, text, lang); rows without lang are left out.

    Learns from about ``at_most`` documents, evenly thinned. One vector for each language comes to the driver.
    """
    known = docs.select("doc_id", "text", "lang").where("lang is not null")
    share = min(1.0, at_most / max(1, known.count()))
    if share < 1:
        known = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int(share * (1 << 20)))

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for rows, buf, offs in slices(batches, limit=1 << 20):
            vec = unit(bundles(buf, offs))
            langs = np.array(rows.column("lang").to_pylist())
            for lang in np.unique(langs):
                total[lang] = total.get(lang, 0) + vec[langs == lang].sum(0, dtype=np.float64)
        yield pa.RecordBatch.from_arrays([pa.array([str(x) for x in total], pa.string()), pa.array([v.tolist() for v in total.values()], pa.list_(pa.float64()))], ["lang", "vec"])

    sums = known.mapInArrow(partial, "lang string, vec array<double>").select("lang", F.posexplode("vec").alias("i", "v")).groupBy("lang", "i").agg(F.sum("v").alias("v"))
    out: dict[str, np.ndarray] = {}
    for lang, i, v in sums.collect():
        out.setdefault(lang, np.zeros(DIM, np.float64))[i] = v
    return {k: out[k] for k in sorted(out)}


def predict(docs: DataFrame, prototypes: dict[str, np.ndarray]) -> DataFrame:
    """All columns of ``docs`` and lang_pred, score (columns of these names are replaced).

    lang_pred is the language of largest cosine, the first by name among equals, and ``und`` for texts that are null or
    have no letter, or where nothing was learnt; score is that cosine, at least 0, and 0 for ``und``.
    """
    langs = [*prototypes]
    table = unit(np.array([prototypes[x] for x in langs])).astype(np.float32) if langs else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, buf, offs in slices(batches, limit=1 << 20):
            if table is None:
                best, score, any_ = np.zeros(rows.num_rows, int), np.zeros(rows.num_rows), np.zeros(rows.num_rows, bool)
            else:
                vec = bundles(buf, offs)
                any_ = vec.any(1)
                cos = unit(vec) @ table.T
                best = cos.argmax(1)
                score = np.where(any_, np.clip(cos[np.arange(len(cos)), best], 0, 1), 0)
            pred = [langs[b] if a else UNKNOWN for a, b in zip(any_.tolist(), best.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(pred, pa.string()), pa.array(score.astype(np.float64))], [*rows.schema.names, "lang_pred", "score"])

    plain = docs.drop("lang_pred", "score")
    from pyspark.sql.types import StructType

    return plain.mapInArrow(run, StructType([*plain.schema.fields]).add("lang_pred", "string").add("score", "double"))


def held_out(remainder: int, of: int):
    """Whether crc32 of doc_id as text leaves this remainder; false for a null doc_id."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % of == remainder, F.lit(False))


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score: learnt from the rows that are not held out."""
    model = fit(docs.where(~held_out(1, 3)))
    return predict(docs.select("doc_id", "text"), model).select("doc_id", held_out(1, 3).alias("held_out"), "lang_pred", "score")
