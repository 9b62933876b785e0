"""Byte-level BPE by rank, many pieces at once, on segment trees over byte positions.

A piece of n bytes starts as n tokens. A segment tree over the byte positions holds, at the position where a live token
starts, the rank of the pair it forms with its right neighbour; the root therefore names the leftmost pair of least
rank. A merge changes three leaves (the pair's two, and the left neighbour's), each a walk of log n nodes to the root.
Pieces of similar length form one array of trees, so that each step is one numpy operation for all of them.
"""

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from tessera.llm.textcore import SegmentEncoder, ragged, slices

NONE = np.int64(1) << 62


class Ranks:
    """Token bytes by rank, and the ranks of the pairs that merge."""

    def __init__(self, lines: list[bytes], pattern: str):
        table = {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}
        self.table, self.pattern = table, regex.compile(pattern)
        self._forget()
        self.byte = np.array([table[bytes([b])] for b in range(256)], np.int64)
        pairs = {}
        for token, rank in table.items():
            for cut in range(1, len(token)):
                if (a := table.get(token[:cut])) is not None and (b := table.get(token[cut:])) is not None:
                    pairs[a << 32 | b] = rank
        self.keys = np.array(sorted(pairs), np.int64)
        self.values = np.array([pairs[k] for k in self.keys.tolist()], np.int64)
        self.lens = np.zeros(max(table.values()) + 1, np.int64)
        for token, rank in table.items():
            self.lens[rank] = len(token)
        self.starts = np.cumsum(self.lens) - self.lens
        self.bytes = np.zeros(int(self.lens.sum()), np.uint8)
        for token, rank in table.items():
            self.bytes[self.starts[rank] : self.starts[rank] + len(token)] = np.frombuffer(token, np.uint8)

    def pair(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair of tokens, NONE where the two don't merge."""
        key = left << 32 | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where((self.keys[at] == key) & (left >= 0) & (right >= 0), self.values[at], NONE)

    def merge(self, pieces: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pieces of at most ``width`` (a power of two) bytes, flat, and how many each has."""
        n = len(pieces)
        lens = np.array([len(p) for p in pieces], np.int64)
        raw = np.frombuffer(b"".join(p.ljust(width, b"\0") for p in pieces), np.uint8).reshape(n, width)
        token = np.where(np.arange(width) < lens[:, None], self.byte[raw], -1)
        after = np.broadcast_to(np.arange(1, width + 1), (n, width)).copy()
        before = np.broadcast_to(np.arange(-1, width - 1), (n, width)).copy()
        tree = np.full((n, 2 * width), NONE, np.int64)  # the leaf of position p is node width + p; a key is rank * width + p
        if width > 1:
            rank = self.pair(token[:, :-1], token[:, 1:])
            tree[:, width : 2 * width - 1] = np.where(rank < NONE, rank * width + np.arange(width - 1), NONE)
        level = width
        while level > 1:
            level //= 2
            tree[:, level : 2 * level] = np.minimum(tree[:, 2 * level : 4 * level : 2], tree[:, 2 * level + 1 : 4 * level : 2])
        live = np.flatnonzero(tree[:, 1] < NONE) if width > 1 else np.zeros(0, np.int64)
        while len(live):
            root = tree[live, 1]
            at, rank = root % width, root // width
            gone = after[live, at]
            nxt = after[live, gone]
            token[live, at] = rank
            token[live, gone] = -1
            after[live, at] = nxt
            inner = nxt < width
            before[live[inner], nxt[inner]] = at[inner]
            prev = before[live, at]
            self._put(tree, width, live, gone, np.full(len(live), NONE))
            right = np.where(inner, token[live, np.minimum(nxt, width - 1)], -1)
            self._put(tree, width, live, at, self._key(rank, right, at, width))
            has = prev >= 0
            self._put(tree, width, live[has], prev[has], self._key(token[live[has], prev[has]], rank[has], prev[has], width))
            live = live[tree[live, 1] < NONE]
        keep = token >= 0
        return token[keep], keep.sum(1)

    def _key(self, left, right, at, width):
        rank = self.pair(left, right)
        return np.where(rank < NONE, rank * width + at, NONE)

    @staticmethod
    def _put(tree, width, rows, at, key):
        """Point update: the leaf, then each node above it."""
        node = width + at
        tree[rows, node] = key
        while width > 1:
            node = node >> 1
            tree[rows, node] = np.minimum(tree[rows, 2 * node], tree[rows, 2 * node + 1])
            width >>= 1

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, flat, and how many each has; each match of the pattern is encoded separately."""
        if len(self.pieces) > 250_000:
            self._forget()
        split = [self.pattern.findall(t) for t in texts]
        at, base = self.pieces, len(self.pieces)
        slot = np.array([at.setdefault(p, len(at)) for ps in split for p in ps], np.int64)
        fresh = [p.encode() for p in islice(at, base, None)]
        if fresh:
            whole = np.array([self.table.get(p, -1) for p in fresh], np.int64)
            size = np.array([len(p) for p in fresh], np.int64)
            lens = np.ones(len(fresh), np.int64)
            begin = np.arange(len(fresh), dtype=np.int64)
            flats, done = [whole], len(fresh)
            width = 1 << np.ceil(np.log2(size)).astype(np.int64)
            for w in np.unique(width[whole < 0]).tolist():
                own = np.flatnonzero((width == w) & (whole < 0))
                step = max(1, (1 << 18) // w)
                for i in range(0, len(own), step):
                    few = own[i : i + step]
                    flat, n = self.merge([fresh[k] for k in few.tolist()], w)
                    lens[few], begin[few] = n, done + np.cumsum(n) - n
                    flats.append(flat)
                    done += len(flat)
            self.begin, self.count = np.append(self.begin, begin + len(self.ids)), np.append(self.count, lens)
            self.ids = np.concatenate([self.ids, *flats])
        lens = self.count[slot]
        upto = np.concatenate([[0], np.cumsum(lens)])
        ends = upto[np.cumsum([len(ps) for ps in split])]
        return self.ids[ragged(self.begin[slot], lens)].astype(np.uint32), np.diff(ends, prepend=0)

    def _forget(self):
        self.pieces: dict[str, int] = {}
        self.ids, self.begin, self.count = (np.zeros(0, np.int64) for _ in range(3))

    def decode(self, ids: np.ndarray) -> bytes:
        return self.bytes[ragged(self.starts[ids], self.lens[ids])].tobytes()


@lru_cache(2)
def load(path: str, pattern: str) -> Ranks:
    with open(path, "rb") as f:
        return Ranks(f.read().splitlines(), pattern)


@lru_cache(2)
def encoder(path: str, pattern: str) -> SegmentEncoder:
    """One for each worker and vocabulary: what it has spelt before it need not merge again."""
    ranks = load(path, pattern)
    return SegmentEncoder(ranks.encode, ranks.lens, most=1_000_000)


def encode_documents(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, ids (little-endian unsigned 32-bit) of every text of ``docs``.

    ``path`` is a rank file that every executor has, ``pattern`` splits texts before merging. Null and empty texts have
    no ids; repeated rows are encoded each; other columns are ignored. No shuffle, and a task holds one slice of texts.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spell = encoder(path, pattern)
        for rows, buf, offs in slices(batches):
            ids, at = spell(buf, offs)
            raw, at = ids.astype("<u4").tobytes(), (at * 4).tolist()
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), pa.array([raw[a:b] for a, b in zip(at, at[1:])], pa.binary())], ["doc_id", "ids"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, ids binary")


def decode_documents(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, text of every row of ``encoded`` (doc_id, ids); null ids decode to the empty text, bytes that are no UTF-8 raise."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks = load(path, pattern)
        for b in batches:
            texts = [ranks.decode(np.frombuffer(x or b"", "<u4")).decode() for x in b.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def round_trip(docs: DataFrame, path: str, pattern: str, keep_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: every text encoded, and the ids decoded again; ``ids`` last if kept.

    Null and empty texts give no ids and the digests of nothing.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spell, ranks = encoder(path, pattern), load(path, pattern)
        for rows, buf, offs in slices(batches):
            ids, at = spell(buf, offs)
            text = ranks.decode(ids)
            upto = np.concatenate([[0], np.cumsum(ranks.lens[ids])])[at].tolist()
            raw, pos = memoryview(ids.astype("<u4").tobytes()), (at * 4).tolist()
            view = memoryview(text)
            digest = lambda v, p: pa.array([hashlib.sha256(v[a:b]).hexdigest() for a, b in zip(p, p[1:])], pa.string())
            cols = {"doc_id": rows.column("doc_id"), "n_tokens": pa.array(np.diff(at)), "ids_sha256": digest(raw, pos), "decoded_sha256": digest(view, upto)}
            if keep_ids:
                cols["ids"] = pa.array([bytes(raw[a:b]) for a, b in zip(pos, pos[1:])], pa.binary())
            yield pa.RecordBatch.from_arrays([*cols.values()], [*cols])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids binary" * keep_ids)
