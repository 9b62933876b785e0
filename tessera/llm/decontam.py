"""Benchmark decontamination: short test items found inside long documents.

Items are partitioned by the size of their shingle set (powers of two). For each size class a document is cut into
blocks as long as the class's largest item; two neighbouring blocks form a window, whose MinHash signature is the
element-wise minimum of its blocks'. An item whose signature agrees with some window's in any coordinate is a candidate;
candidates are verified by exact shingle containment in the whole document. Where 80 % of an item's shingles occur in a
document, in one place or scattered, no coordinate agrees about once in 30,000 cases.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.textcore import mix, shingles, slices, text_buffer, words

COORDS = 64
#: Items and their characters in one pass over the documents, about: their sets and signatures go to every executor.
ITEMS_PER_PASS, CHARS_PER_PASS = 20_000, 16_000_000
_SCALE = mix(np.arange(1, COORDS + 1, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95)) | np.uint64(1)


class Items:
    """Signatures of the items of each size class, by coordinate, and the items' sets."""

    def __init__(self, ids: list[int], texts: list[str], k: int):
        h, at = shingles(*words(*text_buffer(pa.array(texts, pa.string()))), k, whole=False)
        sets = [np.unique(h[a:b]) for a, b in zip(at.tolist(), at[1:].tolist())]
        self.ids = [i for i, s in zip(ids, sets, strict=True) if len(s)]
        self.sets = [s for s in sets if len(s)]
        grade = np.array([len(s).bit_length() for s in self.sets], np.int64)
        self.classes = []
        for g in np.unique(grade).tolist():
            own = np.flatnonzero(grade == g)
            sig = np.array([[(self.sets[i] * s).min() for s in _SCALE] for i in own], np.uint64)
            order = np.argsort(sig, axis=0)
            values = np.take_along_axis(sig, order, 0)
            filters = np.zeros((COORDS, 1 << 16), bool)
            for c in range(COORDS):
                filters[c, values[:, c] >> np.uint64(48)] = True
            self.classes.append((1 << g, values, own[order], filters))

    def candidates(self, h: np.ndarray, at: np.ndarray) -> set[tuple[int, int]]:
        """(document, item) pairs of a slice whose signatures agree somewhere."""
        found: set[tuple[int, int]] = set()
        size = np.diff(at)
        docs = np.flatnonzero(size)
        for block, values, items, filters in self.classes:
            n = -(-size[docs] // block)
            doc = np.repeat(docs, n)
            first = np.cumsum(n) - n
            starts = at[doc] + (np.arange(len(doc)) - np.repeat(first, n)) * block
            joined = doc[1:] == doc[:-1]
            for c in range(COORDS):
                least = np.minimum.reduceat(h * _SCALE[c], starts)
                window = least.copy()
                window[:-1][joined] = np.minimum(least[:-1], least[1:])[joined]
                hit = np.flatnonzero(filters[c][window >> np.uint64(48)])
                if len(hit):
                    lo, hi = np.searchsorted(values[:, c], window[hit], "left"), np.searchsorted(values[:, c], window[hit], "right")
                    for w, a, b in zip(hit[lo < hi].tolist(), lo[lo < hi].tolist(), hi[lo < hi].tolist(), strict=True):
                        found.update((int(doc[w]), int(i)) for i in items[a:b, c])
        return found


def contamination(docs: DataFrame, items: DataFrame, k: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """doc_id, item_id, item_shingles, shared: every document that holds num / den or more of an item's distinct shingles.

    Items come as (item_id, text). Texts of fewer than k words, empty or null, have no shingles: such items match
    nothing, such documents hold nothing. Repeated documents or items give a row each. Other columns are ignored. The
    items are a stated query set: they go round in blocks of ITEMS_PER_PASS items and CHARS_PER_PASS characters, each held
    against all documents; no shuffle.
    """
    n, chars = items.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.length("text")), F.lit(0))).first()
    passes = max(1, -(-n // ITEMS_PER_PASS), -(-chars // CHARS_PER_PASS))
    out = None
    for p in range(passes):
        block = items.select("item_id", F.coalesce("text", F.lit("")).alias("text"))
        if passes > 1:
            block = block.where(F.pmod(F.xxhash64("item_id"), F.lit(passes)) == p)
        rows = sorted((tuple(r) for r in block.collect()), key=lambda r: (r[0] is None, r))
        held = Items([r[0] for r in rows], [r[1] for r in rows], k)

        def run(batches: Iterator[pa.RecordBatch], held: Items = held) -> Iterator[pa.RecordBatch]:
            for rows, buf, offs in slices(batches):
                h, at = shingles(*words(buf, offs), k, whole=False)
                own: list[tuple[int, int, int, int]] = []
                last, sorted_ = -1, None
                for d, i in sorted(held.candidates(h, at)) if len(h) else ():
                    if d != last:
                        last, sorted_ = d, np.unique(h[at[d] : at[d + 1]])
                    item = held.sets[i]
                    place = np.minimum(np.searchsorted(sorted_, item), len(sorted_) - 1)
                    shared = int((sorted_[place] == item).sum())
                    if shared * den >= len(item) * num:
                        own.append((d, held.ids[i], len(item), shared))
                cols = [*zip(*own, strict=True)] if own else [(), (), (), ()]
                yield pa.RecordBatch.from_arrays([pc.take(rows.column("doc_id"), pa.array(cols[0], pa.int64())), *(pa.array(c, pa.int64()) for c in cols[1:])], ["doc_id", "item_id", "item_shingles", "shared"])

        found = docs.select("doc_id", "text").mapInArrow(run, "doc_id long, item_id long, item_shingles long, shared long")
        out = found if out is None else out.unionByName(found)
    return out
