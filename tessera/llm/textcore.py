"""Array primitives over Arrow text columns: words, segments, shingles and their 64-bit hashes.

Every function works on the concatenated UTF-8 bytes of a batch of documents (``buf``) and the
document boundaries (``offs``, one more than documents), so that a task handles millions of
words with a handful of numpy calls.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 2 << 20

_rng = np.random.Generator(np.random.Philox(20240229))
BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
STEP = np.uint64(0x9E3779B97F4A7C15)
#: Lower-cases A-Z only.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Bytes that separate words: \x20 and \x09 to \x0D.
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[9, 10, 11, 12, 13, 32]] = True
#: ASCII letters, and visible ASCII besides letters, digits and the apostrophe.
LETTER = np.zeros(256, bool)
LETTER[65:91] = LETTER[97:123] = True
MARK = np.zeros(256, bool)
MARK[33:127] = True
MARK[48:58] = MARK[39] = False
MARK &= ~LETTER
_pow = np.zeros(0, np.uint64)


def _powers(n: int) -> np.ndarray:
    global _pow
    if len(_pow) < n:
        size = 1 << int(n).bit_length()
        grown = np.full(size, STEP, np.uint64)
        grown[0] = 1
        _pow = np.multiply.accumulate(grown)
    return _pow


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser: spreads a 64-bit value over all its bits."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def seeded(x: np.ndarray, seed: int) -> np.ndarray:
    """Another hash of hashes, by seed."""
    return mix(x ^ np.uint64((seed * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) & (2**64 - 1)))


def text_buffer(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes and boundaries of a string column; null counts as empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = pc.fill_null(col, "")
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    _, pos, data = col.buffers()
    if len(col) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offs = np.frombuffer(pos, np.int64 if wide else np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offs[0] : offs[-1]], offs - offs[0]


def slices(batches: Iterator[pa.RecordBatch], text: str = "text", limit: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Row ranges of at most ``limit`` bytes of text (one document at least), with their bytes."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        buf, offs = text_buffer(batch.column(text))
        i = 0
        while i < batch.num_rows:
            j = int(np.searchsorted(offs, offs[i] + limit, "right")) - 1
            j = min(max(j, i + 1), batch.num_rows)
            yield batch.slice(i, j - i), buf[offs[i] : offs[j]], offs[i : j + 1] - offs[i]
            i = j


def run_hashes(buf: np.ndarray, starts: np.ndarray, live: np.ndarray | None = None) -> np.ndarray:
    """A 64-bit hash of each run of bytes from one start to the next; bytes not ``live`` count as absent at a run's end."""
    n = len(buf)
    if not len(starts):
        return np.zeros(0, np.uint64)
    lens = np.diff(np.append(starts, n))
    local = np.arange(starts[0], n, dtype=np.int64) - np.repeat(starts, lens)
    val = BYTE[buf[starts[0] :]]
    val *= _powers(int(lens.max()) + 1)[local]
    if live is not None:
        val *= live[starts[0] :]
    return mix(np.add.reduceat(val, starts - starts[0]))


def words(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the lower-cased words of each document and each document's first word."""
    hashes, at, _ = word_spans(buf, offs)
    return hashes, at


def word_spans(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """As ``words``, with the byte at which each word starts."""
    n = len(buf)
    if n == 0:
        return np.zeros(0, np.uint64), np.zeros(len(offs), np.int64), np.zeros(0, np.int64)
    live = ~IS_SPACE[buf]
    first = live.copy()
    first[1:] &= ~live[:-1]
    heads = offs[:-1][offs[:-1] < offs[1:]]
    first[heads] = live[heads]
    starts = np.flatnonzero(first)
    return run_hashes(LOWER[buf], starts, live), np.searchsorted(starts, offs), starts


def word_ends(buf: np.ndarray, offs: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The byte after each word."""
    stop = np.append(np.flatnonzero(IS_SPACE[buf]), len(buf))
    ends = stop[np.searchsorted(stop, starts)]
    return np.minimum(ends, offs[np.searchsorted(offs, starts, "right")])


def shingles(wh: np.ndarray, at: np.ndarray, k: int, whole: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the k-word shingles of each document, in order, and each document's first one.

    With fewer than k words the whole sequence counts as one shingle if ``whole``; without words there is none.
    """
    counts = np.diff(at)
    n = len(wh)
    h = np.zeros(n, np.uint64)
    scale = mix(np.arange(1, k + 1, dtype=np.uint64) * STEP) | np.uint64(1)
    for j in range(k):
        h[: n - j] += wh[j:] * scale[j]
    h = mix(h)
    size = np.maximum(counts - k + 1, 0)
    keep = np.zeros(n + 1, np.int32)
    np.add.at(keep, at[:-1], (size > 0).astype(np.int32))
    np.add.at(keep, at[:-1] + size, -(size > 0).astype(np.int32))
    keep = np.cumsum(keep[:-1]) > 0
    if whole:
        for d in np.flatnonzero((counts > 0) & (counts < k)):
            own = wh[at[d] : at[d + 1]]
            h[at[d]] = mix((own * scale[: len(own)]).sum(dtype=np.uint64)[None] + np.uint64(len(own)))[0]
            keep[at[d]] = True
            size[d] = 1
    return h[keep], np.concatenate([[0], np.cumsum(size)])


def ragged(starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """The positions starts[i] .. starts[i]+lens[i]-1 of every i, one after the other."""
    total = int(lens.sum())
    if total == 0:
        return np.zeros(0, np.int64)
    shift = starts - np.concatenate([[0], np.cumsum(lens)[:-1]])
    return np.repeat(shift, lens) + np.arange(total)


def segment_starts(buf: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Where text may be cut so that no token of a space-led splitting pattern crosses a cut.

    At the start of a document; at a single space between two characters that are visible ASCII or Latin-1 letters; and
    between such a letter and a punctuation mark other than the apostrophe.
    """
    n = len(buf)
    cut = np.zeros(n, bool)
    if n > 2:
        seen = (buf > 32) & (buf < 127)
        latin = np.zeros(n, bool)
        latin[1:] = (buf[:-1] == 0xC3) & (buf[1:] >= 0x80)
        left, right = seen | latin, seen | (buf == 0xC3)
        cut[1:-1] = (buf[1:-1] == 32) & left[:-2] & right[2:]
        letter = LETTER[buf]
        letter[1:] |= latin[1:] & (buf[1:] != 0x97) & (buf[1:] != 0xB7)
        cut[1:] |= MARK[buf[1:]] & letter[:-1]
    cut[offs[:-1][offs[:-1] < offs[1:]]] = True
    return np.flatnonzero(cut)


def within(buf: np.ndarray, offs: np.ndarray, token: bytes, places: np.ndarray) -> np.ndarray:
    """Which of ``places`` lie within an occurrence of ``token``, its first byte aside, that no document boundary parts."""
    raw, found = buf.tobytes(), []
    at = raw.find(token)
    while at >= 0:
        found.append(at)
        at = raw.find(token, at + 1)
    begin = np.array(found, np.int64)
    begin = begin[np.searchsorted(offs, begin, "right") == np.searchsorted(offs, begin + len(token) - 1, "right")]
    if not len(begin):
        return np.zeros(len(places), bool)
    last = begin[np.maximum(np.searchsorted(begin, places) - 1, 0)]  # the last occurrence that begins before the place
    return (last < places) & (places < last + len(token))


def joinable(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Whether a segment begins and ends as ``segment_starts`` asks of both sides of a cut."""
    last, before, second = buf[ends - 1], buf[np.maximum(ends - 2, starts)], buf[np.minimum(starts + 1, ends - 1)]
    return (ends - starts > 1) & (buf[starts] == 32) & ((second > 32) & (second < 127) | (second == 0xC3)) & ((last > 32) & (last < 127) | (before == 0xC3) & (last >= 0x80))


def distinct(key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """As ``np.unique`` with index and inverse: sorts each key's upper bits and its place as one number, unless keys differ in their lower bits alone."""
    bits = np.uint64(len(key).bit_length())
    both = np.sort(key >> bits << bits | np.arange(len(key), dtype=np.uint64))
    place = (both & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    by_place = key[place]
    head = np.append(True, by_place[1:] != by_place[:-1])
    if np.count_nonzero(head[1:]) > np.count_nonzero(both[1:] >> bits != both[:-1] >> bits):
        return np.unique(key, return_index=True, return_inverse=True)
    inverse = np.empty(len(key), np.int64)
    inverse[place] = np.cumsum(head) - 1
    return by_place[head], place[head], inverse


class SegmentEncoder:
    """Encodes each distinct segment once and spells documents from them.

    ``encode`` takes a list of strings and returns their ids (flat) and how many each has; ``id_bytes`` is the number
    of bytes each id stands for. New segments are encoded in joined blocks, which have the same cuts. The memory of
    segments is emptied at ``most`` entries: that bounds space and never changes the ids.
    """

    def __init__(self, encode, id_bytes: np.ndarray, most: int = 3_000_000, block: int = 1 << 16, whole: tuple[bytes, ...] = ()):
        self.encode, self.id_bytes, self.most, self.block, self.whole = encode, id_bytes, most, block, whole
        self._clear()

    def _clear(self):
        self.keys, self.slots = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.flat = np.zeros(0, np.uint32)
        self.starts, self.lens = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _learn(self, buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of these segments, flat, and how many each has."""
        raw, size = buf.tobytes(), ends - starts
        free = joinable(buf, starts, ends)
        order = np.concatenate([np.flatnonzero(free), np.flatnonzero(~free)])
        together = np.cumsum(size[order[: free.sum()]]) // self.block
        cuts = np.concatenate([np.flatnonzero(np.diff(together, prepend=-1)), np.arange(free.sum(), len(order)), [len(order)]])
        texts = [b"".join(raw[a:b] for a, b in zip(starts[own].tolist(), ends[own].tolist(), strict=True)).decode() for own in (order[i:j] for i, j in zip(cuts.tolist(), cuts[1:].tolist()))]
        flat, _ = self.encode(texts)
        at = np.concatenate([[0], np.cumsum(self.id_bytes[flat])])
        first = np.searchsorted(at, np.concatenate([[0], np.cumsum(size[order])]))
        lens = np.empty(len(order), np.int64)
        lens[order] = np.diff(first)
        begin = np.empty(len(order), np.int64)
        begin[order] = first[:-1]
        return flat[ragged(begin, lens)], lens

    def __call__(self, buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all documents and each document's first id."""
        starts = segment_starts(buf, offs)
        for token in self.whole:
            starts = starts[~within(buf, offs, token, starts)]
        if not len(starts):
            return np.zeros(0, np.uint32), np.zeros(len(offs), np.int64)
        if len(self.keys) > self.most:
            self._clear()
        ends = np.append(starts[1:], len(buf))
        key, first, inverse = distinct(run_hashes(buf, starts) ^ (ends - starts).astype(np.uint64))
        at = np.searchsorted(self.keys, key)
        known = np.zeros(len(key), bool)
        inside = at < len(self.keys)
        known[inside] = self.keys[at[inside]] == key[inside]
        slot = np.empty(len(key), np.int64)
        slot[known] = self.slots[at[known]]
        new = np.flatnonzero(~known)
        if len(new):
            flat, lens = self._learn(buf, starts[first[new]], ends[first[new]])
            slot[new] = np.arange(len(self.lens), len(self.lens) + len(new))
            self.keys, self.slots = np.insert(self.keys, at[new], key[new]), np.insert(self.slots, at[new], slot[new])
            self.starts = np.append(self.starts, len(self.flat) + np.cumsum(lens) - lens)
            self.flat, self.lens = np.append(self.flat, flat), np.append(self.lens, lens)
        slot = slot[inverse]
        lens = self.lens[slot]
        ids = self.flat[ragged(self.starts[slot], lens)]
        upto = np.concatenate([[0], np.cumsum(lens)])
        return ids, upto[np.searchsorted(starts, offs)]
