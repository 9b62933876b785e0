"""Periodic runs of words by the dictionary of basic factors.

A basic factor is a stretch of m words, m a power of two; it is named by the pair of names of its halves. Positions of
one name in one document follow each other; where the next one is at a gap of at most 2 m, equal gaps at consecutive
positions form an arithmetic progression and propose a period. Of these proposals a level keeps those of gap m / 2 < q
<= m: there the factor holds a whole period, so the gap is the smallest period, the stretch of equal gaps begins where
the run begins and its last factor's next occurrence ends where the run ends. Each run of four periods or more comes
from exactly one level; the other proposals are parts or repeats of what the next or an earlier level has.
"""

import hashlib
import zlib
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame

#: Documents of a batch are worked on together up to so many bytes.
SLICE_BYTES = 8 << 20


def runs(ids: np.ndarray, offs: np.ndarray, least: int = 6, times: int = 4) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, length and smallest period of every run of length >= max(least, times * period), by start, then period.

    ``ids`` are the words of all documents, ``offs`` the documents' bounds; times must be 4 or more.
    """
    n = np.diff(offs)
    doc, end, room = np.repeat(np.arange(len(n)), n), np.repeat(offs[1:], n), np.repeat(n // times, n)
    pos, name, m = np.arange(len(ids)), ids, 1
    found = [np.zeros((3, 0), np.int64)]
    while len(pos):
        order = np.argsort(name, kind="stable")
        here, after = order[:-1], order[1:]
        same = name[here] == name[after]
        gap = pos[after] - pos[here]
        near = same & (doc[pos[here]] == doc[pos[after]]) & (gap <= room[pos[here]])
        follows = np.zeros(len(pos), np.int64)
        follows[here[near]] = gap[near]
        at = np.flatnonzero((follows > m // 2) & (follows <= m))
        if len(at):
            p, q = pos[at], follows[at]
            first = np.flatnonzero(np.append(True, (np.diff(p) != 1) | (np.diff(q) != 0)))
            last = np.append(first[1:], len(at)) - 1
            size = p[last] - p[first] + q[first] + m
            long = size >= np.maximum(least, times * q[first])
            found.append(np.stack([p[first], size, q[first]])[:, long])
        # a run of a longer period has, at each of its factors, another occurrence of the factor within that period
        alive = np.zeros(len(pos), bool)
        alive[here[near]] = alive[after[near]] = True
        rank = np.zeros(len(pos), np.int64)
        rank[after] = np.cumsum(~same)
        pos, rank = pos[alive], rank[alive]
        half = np.minimum(np.searchsorted(pos, pos + m), len(pos) - 1)
        both = (pos[half] == pos + m) & (pos + 2 * m <= end[pos]) & (room[pos] > m) if len(pos) else np.zeros(0, bool)
        name = rank[both] * (len(order) + 1) + rank[half[both]]
        pos, m = pos[both], 2 * m
    start, size, period = np.concatenate(found, 1)
    order = np.lexsort((period, start))
    return start[order], size[order], period[order]


def repeated(doc_id: int | None, n: int) -> np.ndarray | None:
    """For a tenth of documents, by a checksum of the id, which original word stands at each place; None for the rest."""
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 or not n:
        return None
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    place = np.arange(n)
    place[a:] = a + (place[a:] - a) % p
    return place


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list[bytes], np.ndarray]]:
    """Ids, words and each document's first word, of so many documents at a time."""
    for batch in batches:
        ids, words, at, size = [], [], [0], 0
        for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
            ids.append(doc_id)
            raw = text.encode() if text else b""
            words += raw.split()  # at \x20 and \x09 to \x0D
            at.append(len(words))
            size += len(raw)
            if size >= SLICE_BYTES:
                yield ids, words, np.array(at)
                ids, words, at, size = [], [], [0], 0
        if ids:
            yield ids, words, np.array(at)


def _row(words: np.ndarray, start: np.ndarray, size: np.ndarray, period: np.ndarray) -> tuple:
    """n_runs, the greatest run, the digest of all runs and of the words that stay, of one document."""
    listed = list(zip(start.tolist(), size.tolist(), period.tolist(), strict=True))
    best = max(listed, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=None)
    if best:
        edge = np.zeros(len(words) + 1, np.int64)
        np.add.at(edge, start + period, 1)
        np.add.at(edge, start + size, -1)
        words = words[np.cumsum(edge[:-1]) == 0]
    said = "".join(f"{s},{n},{q}\n" for s, n, q in listed)
    return len(listed), *((*best, 1000 * best[1] // best[2]) if best else (None,) * 4), hashlib.sha256(said.encode()).hexdigest(), hashlib.sha256(b" ".join(words.tolist())).hexdigest()


SCHEMA = "doc_id long, n_words long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"


def periodic_runs(docs: DataFrame, times: int = 4, least: int = 6, planted: bool = False) -> DataFrame:
    """Runs of words of every text: how many, the one of the greatest length / period, and digests of all and of the text without them.

    A run is a stretch with smallest period q, at least max(least, times * q) words long, that cannot be extended; ties
    go to the smallest start, then period. Words of a run after its first q are dropped from the collapsed text. With
    ``planted``, a tenth of documents is searched with its tail made periodic, so that runs of all sizes occur. Null and
    empty texts have no runs, four nulls and the digests of nothing; rows without doc_id are searched as they are;
    repeated rows give a row each, an empty table none; other columns are ignored. A text is worked on whole, in
    one task, in memory of some hundred bytes a word; nothing is shuffled.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = pa.schema([("doc_id", pa.int64()), *[(c, pa.int64()) for c in ("n_words", "n_runs", "start", "length", "period", "exponent_milli")], ("runs_sha256", pa.string()), ("collapsed_sha256", pa.string())])
        for doc_ids, words, offs in _slices(batches):
            raw = np.empty(len(words), object)
            raw[:] = words
            if planted:
                for doc_id, a, b in zip(doc_ids, offs, offs[1:]):
                    place = repeated(doc_id, int(b - a))
                    if place is not None:
                        raw[a:b] = raw[a + place]
            start, size, period = runs(pd.factorize(raw)[0].astype(np.int64), offs, least, times)
            cuts = np.searchsorted(start, offs)
            rows = [(d, int(b - a), *_row(raw[a:b], start[i:j] - a, size[i:j], period[i:j])) for d, a, b, i, j in zip(doc_ids, offs, offs[1:], cuts, cuts[1:])]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), kinds)], schema=kinds)

    return docs.select("doc_id", "text").mapInArrow(run, SCHEMA)


def words_of(words: list[bytes], times: int = 4, least: int = 6) -> list[tuple[int, int, int]]:
    """The runs of one list of words as (start, length, period)."""
    raw = np.empty(len(words), object)
    raw[:] = words
    return list(zip(*(x.tolist() for x in runs(pd.factorize(raw)[0].astype(np.int64), np.array([0, len(words)]), least, times)), strict=True))
