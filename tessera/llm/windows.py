"""Near-duplicate passages across documents by compact windows.

A document is its sequence of five-word shingles. For each of HASHES functions a Cartesian tree stands over the
shingles' hashes (the least is the root, the leftmost of equals). A node whose subtree spans 46 shingles (50 words) or
more is a compact window (l, c, r): all subsequences [i, j] with l <= i <= c <= j <= r share the signature of c. Windows
of equal signature in two documents, laid over each other at c, share every subsequence of their common part (interval
join); where enough functions' common parts cover one place, a passage is a candidate, and the shingles of both
documents there verify it: at least 46 shingles, similarity 0.8 or more. Later documents lose the passage.

Windows whose shingles are the same within REACH of c are copies: they hold the same passages around c. A copy meets the
first holder of its content (in its task, and these firsts in the bucket of the signature). The first holders of
different contents of one signature are compared, every one with every earlier one, by those shingles. In small groups
likeness by 8 bits of each asks (it is only ever overrated); in large ones all 32 bits do, and of earlier windows that hold
a passage place by place (ALIKE of SPAN shingles the same) the widest are taken: such passages are proved, and a window
is asked only for what reaches beyond them. Likeness that is not proved closes nothing. No holder of a passage is left out
but for one that is earlier still: the first holder of any 46 shingles is the first holder of all its windows around them.
"""

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.packed import BLOBS, blob_rows, by_bucket, inflated, squeezed, unpack
from tessera.llm.suffix import ordered
from tessera.llm.textcore import STEP, mix, ragged, shingles, slices, word_ends, word_spans, words
from tessera.llm.workspace import materialise, parts

WORDS, SHINGLE = 50, 5
SPAN = WORDS - SHINGLE + 1
HASHES, ENOUGH = 8, 4
#: Places on either side of c that 46 shingles around it can reach.
REACH = SPAN - 1
#: Of 46 shingles alike in similarity 0.8 so many are the same at least; of the 22 on one side of c that lie among them, all but five.
ALIKE, SIDE = 41, 22
#: Marks a part that stands for ENOUGH functions, since its content was compared.
SURE = 8
#: Marks, beside SURE, a part that is a passage as it stands: equal contents (within REACH of its place both documents are
#: the same) or, with PROVED, shingles compared place by place.
COPY, PROVED = 16, 32
#: Marks the whole content of windows of which what can be a passage is proved: it is no reason to ask.
SPARE = 64
#: Groups of up to so many contents are compared pair by pair, larger ones in blocks of at most BLOCK earlier contents.
FEW, BLOCK = 64, 128
#: The least common part of two windows that counts: a passage's shingles, less one edit of its length.
COMMON = SPAN - SHINGLE
#: Unmatched shingles that one edit makes, twice: matches further apart are two passages.
GAP = 2 * SHINGLE
#: Places of a window's content, and the bits by which the shingles of large groups are looked up, in one window and in a block.
WIDTH, SLOTS, WIDER = 2 * REACH + 1, 14, 20
_STAMP = mix(np.arange(1, WIDTH + 1, dtype=np.uint64) * np.uint64(0x9FB21C651E98DF25)) | np.uint64(1)
_SCALE = mix(np.arange(1, HASHES + 1, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F)) | np.uint64(1)
_BACK = np.uint64(pow(int(STEP), -1, 1 << 64))


def compact_windows(h: np.ndarray, lo: np.ndarray, hi: np.ndarray, span: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """l, c, r of the Cartesian tree's nodes that span ``span`` places or more.

    ``lo`` and ``hi`` bound each place's document. Such nodes are the least of some ``span`` places. A node's subtree
    reaches to the nearest smaller value on both sides; these are its ancestors, so they span as much and are found among
    the nodes alone.
    """
    n = len(h)
    none = (np.zeros(0, np.int64),) * 3
    if n < span:
        return none
    bits = np.uint64(n.bit_length())
    key = (h >> bits << bits) | np.arange(n, dtype=np.uint64)  # the leftmost of equals is the least
    least, w = key, 1
    while 2 * w <= span:
        least = np.minimum(least[:-w], least[w:])
        w *= 2
    if span - w:
        least = np.minimum(least[: -(span - w)], least[span - w :])
    at = least[hi[: n - span + 1] >= np.arange(span, n + 1)] & ((np.uint64(1) << bits) - np.uint64(1))
    if not len(at):
        return none
    c = at[np.append(True, at[1:] != at[:-1])].astype(np.int64)
    v, m = key[c], len(c)
    tables, w = [v], 1
    while 2 * w < m:
        last = tables[-1]
        tables.append(np.append(np.minimum(last[:-w], last[w:]), last[m - w :]))
        w *= 2
    low, high = np.searchsorted(c, lo[c]), np.searchsorted(c, hi[c])
    left, right = np.arange(m), np.arange(1, m + 1)
    for k in range(len(tables) - 1, -1, -1):
        step = 1 << k
        at = left - step
        go = at >= low
        go &= tables[k][np.maximum(at, 0)] > v
        left[go] -= step
        go = right + step <= high
        go &= tables[k][np.minimum(right, m - 1)] > v
        right[go] += step
    l = np.where(left > low, c[np.maximum(left - 1, 0)] + 1, lo[c])
    r = np.where(right < high, c[np.minimum(right, m - 1)], hi[c]) - 1
    return l, c, r


class Contents:
    """Hashes of stretches of shingles, from sums over all of them."""

    def __init__(self, h: np.ndarray):
        power = np.multiply.accumulate(np.full(len(h) + 1, STEP, np.uint64))
        self.back = np.multiply.accumulate(np.full(len(h) + 1, _BACK, np.uint64))
        self.upto = np.append(np.uint64(0), np.cumsum(h * power[:-1], dtype=np.uint64))

    def of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """A hash of each stretch from ``a`` to before ``b``."""
        return mix((self.upto[b] - self.upto[a]) * self.back[a] + (b - a).astype(np.uint64))

    def around(self, l: np.ndarray, c: np.ndarray, r: np.ndarray) -> np.ndarray:
        """32 bits for the content of each window within REACH of its place."""
        return (mix(self.of(np.maximum(l, c - REACH), c) * STEP + self.of(c, np.minimum(r, c + REACH) + 1)) >> np.uint64(32)).astype(np.uint32)


def content_firsts(s: np.ndarray, content: np.ndarray, doc: np.ndarray, c: np.ndarray) -> np.ndarray:
    """For each window the first one (by document and place) of its signature and content."""
    order = np.lexsort((c, doc))
    bits = len(s).bit_length()
    place, key = ordered(mix(s + mix(content.astype(np.uint64)))[order] >> np.uint64(bits), bits)
    head = np.append(True, key[1:] != key[:-1])
    out = np.empty(len(s), np.int64)
    out[order[place]] = order[place][np.maximum.accumulate(np.where(head, np.arange(len(key)), 0))]
    return out


def signatures(docs: DataFrame) -> DataFrame:
    """Blobs of (signature, document, l, c, r, content) of all compact windows, by bucket of the signature; copies of another document in their task are pairs already."""
    n = parts(docs.sparkSession)
    buckets = 4 * n

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []

        def flush() -> Iterator[pa.RecordBatch]:
            s, doc, l, c, r, content = (np.concatenate(x) for x in zip(*held, strict=True))
            held.clear()
            if not len(s):
                return
            first = content_firsts(s, content, doc, c)
            copy = doc[first] != doc
            keep = np.flatnonzero(~copy)
            k = s[keep]
            cols = [(k >> np.uint64(32)).astype(np.uint32), (k >> np.uint64(24)).astype(np.uint8), (k & np.uint64(HASHES - 1)).astype(np.uint8), doc[keep], c[keep], reach(c[keep] - l[keep]), reach(r[keep] - c[keep]), content[keep]]
            yield blob_rows([*by_bucket((k % np.uint64(buckets)).astype(np.int64), cols)], 0)
            copy = np.flatnonzero(copy)
            pairs = _common(doc, l, c, r, (s & np.uint64(HASHES - 1)).astype(np.int32) + SURE + COPY, copy, first[copy])
            if len(pairs[0]):
                yield blob_rows(pair_blobs(pairs, n), 1)

        for rows, buf, offs in slices(batches):
            h, at = shingles(*words(buf, offs), SHINGLE, whole=False)
            size = np.diff(at)
            lo, hi = np.repeat(at[:-1], size), np.repeat(at[1:], size)
            ids = rows.column("doc_id").to_numpy()
            of = np.repeat(np.arange(len(size)), size)
            contents = Contents(h)
            for k in range(HASHES):
                v = h * _SCALE[k]
                l, c, r = compact_windows(v, lo, hi, SPAN)
                held.append([mix(v[c]) & ~np.uint64(HASHES - 1) | np.uint64(k), ids[of[c]], *(x.astype(np.int32) for x in (l - lo[c], c - lo[c], r - lo[c])), contents.around(l, c, r)])
            if sum(len(x[0]) for x in held) > 1_000_000:
                yield from flush()
        if held:
            yield from flush()

    return docs.select("doc_id", "text").where("doc_id is not null").mapInArrow(send, BLOBS)


def joined(high: np.ndarray, low: np.ndarray, k: np.ndarray) -> np.ndarray:
    """Signatures as they were sent."""
    return high.astype(np.uint64) << np.uint64(16) | low.astype(np.uint64) << np.uint64(8) | k


#: A signature as sent: 40 of its bits (chance meetings fail verification), function, document, place, reach to both sides,
#: 32 bits of its content.
SIGNED = ["<u4", "u1", "u1", "<i8", "<i4", "<u2", "<u2", "<u4"]
#: Marks, beside its function, a window of a signature of over FEW contents.
WIDE = HASHES
#: A window whose content is asked for: document, and the rest as above.
ASKED = {"doc": "<i8", "high": "<u4", "low": "u1", "k": "u1", "c": "<i4", "before": "<u2", "after": "<u2"}


def reach(x: np.ndarray) -> np.ndarray:
    """How far a window goes, 65,535 places at most: no passage of SPAN shingles around its place is cut."""
    return np.minimum(x, 0xFFFF).astype(np.uint16)


def _common(doc, l, c, r, k, a, b) -> list[np.ndarray]:
    """member, partner, function, shift, the member's interval of the part that windows a (later) and b have in common, and its place, where that is wide enough."""
    shift = c[a] - c[b]
    i, j = np.maximum(l[a], l[b] + shift), np.minimum(r[a], r[b] + shift)
    wide = j - i + 1 >= COMMON
    return [x[wide] for x in (doc[a], doc[b], k[a], shift, i, j, c[a])]


PAIRS = ["<i8", "<i8", "u1", "<i4", "<i4", "<i4", "<i4"]


def pair_blobs(pairs: list[np.ndarray], buckets: int) -> list[tuple[int, bytes]]:
    """Common parts by bucket of their member, in an order that compresses."""
    member, partner, k, shift, i, j, c = pairs
    order = np.lexsort((i, k, partner, member))
    cols = [member, partner, k.astype(np.uint8), shift.astype(np.int32), i.astype(np.int32), (j - i).astype(np.int32), (c - i).astype(np.int32)]
    return [*by_bucket(member[order] % buckets, [c[order] for c in cols])]


def gathered(batches: Iterator[pa.RecordBatch], kind: int, kinds: list[str]) -> dict[int, list[list[np.ndarray]]]:
    """Blobs of one kind, unpacked, by bucket."""
    asked: dict[int, list] = {}
    for batch in batches:
        for bucket, of, blob in zip(*(batch.column(x).to_pylist() for x in ("bucket", "kind", "data")), strict=True):
            if of == kind:
                asked.setdefault(bucket, []).append(unpack(blob, kinds))
    return asked


def copies(docs: DataFrame) -> DataFrame:
    """Blobs of kind 1: parts that a window of ``member`` shares with the first holder of its content; of kind 2: first holders whose signature has other contents. Both by bucket of the document."""
    n = parts(docs.sparkSession)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked: dict[int, list] = {}
        for batch in batches:
            met = []
            for bucket, kind, blob in zip(*(batch.column(x).to_pylist() for x in ("bucket", "kind", "data")), strict=True):
                if kind == 0:
                    asked.setdefault(bucket, []).append(unpack(blob, SIGNED)[:-1])
                else:
                    met.append((bucket, blob))
            if met:
                yield blob_rows(met, 1)
        pairs, alive = [], []
        for found in asked.values():
            high, low, k, doc, c, before, after, content = (np.concatenate(v) for v in zip(*found, strict=True))
            s = joined(high, low, k)
            first = content_firsts(s, content, doc, c)
            copy = doc[first] != doc
            own = np.flatnonzero(copy)
            pairs.append(_common(doc, c - before.astype(np.int32), c, c + after.astype(np.int32), k.astype(np.int32) + SURE + COPY, own, first[own]))
            own = np.flatnonzero(~copy)
            own = own[np.lexsort((doc[own], s[own]))]
            head = np.flatnonzero(_firsts(s[own])) if len(own) else own
            stop = np.append(head[1:], len(own))
            some = np.repeat(doc[own[head]] != doc[own[stop - 1]], stop - head)
            k = k.copy()
            k[own] |= np.repeat(np.where(stop - head > FEW, WIDE, 0), stop - head).astype(np.uint8)
            alive.append([v[own[some]] for v in (doc, high, low, k, c, before, after)])
        if pairs:
            yield blob_rows(pair_blobs([np.concatenate(x) for x in zip(*pairs, strict=True)], n), 1)
            cols = [np.concatenate(x) for x in zip(*alive, strict=True)]
            order = np.lexsort((cols[4], cols[3], cols[0]))
            yield blob_rows([*by_bucket(cols[0][order] % n, [x[order] for x in cols])], 2)

    return signatures(docs).repartition(n, "bucket").mapInArrow(meet, BLOBS)


#: A window with its content: signature, function, document, place, reach to both sides; its shingles follow, a byte each in blobs of kind 3, 32 bits each in those of kind 4.
HELD = ["<u8", "u1", "<i8", "<i4", "<u2", "<u2"]


def slot(codes: np.ndarray, bits: int) -> np.ndarray:
    """So many bits of shingles' codes."""
    return codes * np.uint32(0x9E3779B1) >> np.uint32(32 - bits)


def contents(docs: DataFrame, met: DataFrame) -> DataFrame:
    """Blobs of first holders and their shingles within REACH, by bucket of the signature: of kind 3 those of few contents, of kind 4 WIDE ones."""
    buckets = 4 * parts(docs.sparkSession)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for found in gathered(batches, 2, [*ASKED.values()]).values():
            cols = [np.concatenate(x) for x in zip(*found, strict=True)][:-1]
            order = np.argsort(cols[0], kind="stable")
            whole = np.empty(len(order), np.dtype([*ASKED.items()]))
            for name, x in zip(ASKED, cols, strict=True):
                whole[name] = x[order]
            cut = np.flatnonzero(_firsts(whole["doc"])) if len(whole) else order
            yield pa.RecordBatch.from_arrays([pa.array(whole["doc"][cut]), pa.array([whole[i:j].tobytes() for i, j in zip(cut, [*cut[1:], len(whole)])], pa.binary())], ["doc_id", "w"])

    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, buf, offs in slices(inflated(batches, 1000)):
            h, at = shingles(*words(buf, offs), SHINGLE, whole=False)
            codes = (h >> np.uint64(32)).astype(np.uint32)
            held = [np.frombuffer(x, np.dtype([*ASKED.items()])) for x in b.column("w").to_pylist()]
            d, w = np.repeat(np.arange(len(held)), [len(x) for x in held]), np.concatenate(held)
            here = w["c"].astype(np.int64) + w["after"] < np.diff(at)[d]  # another row of this doc_id may have the window
            d, w = d[here], w[here]
            left, right = (np.minimum(w[x], REACH).astype(np.int64) for x in ("before", "after"))
            size, wide = left + right + 1, w["k"] >= WIDE
            s, begin = joined(w["high"], w["low"], w["k"] & np.uint8(HASHES - 1)), at[d] + w["c"] - left
            for kind, own in ((3, ~wide), (4, wide)):
                data, x = codes[ragged(begin[own], size[own])], w[own]
                yield blob_rows([*by_bucket((s[own] % np.uint64(buckets)).astype(np.int64), [s[own], *(x[v] for v in ("k", "doc", "c", "before", "after"))], data if kind == 4 else slot(data, 8).astype(np.uint8), size[own])], kind)

    n = parts(docs.sparkSession)
    asked = met.where("kind = 2").repartition(n, "bucket").mapInArrow(rows, "doc_id long, w binary")
    short = squeezed(docs.where("doc_id is not null"))
    return short.hint("merge").join(asked, "doc_id").select("doc_id", "w", "z").mapInArrow(spell, BLOBS)


def _sums(hit: np.ndarray) -> np.ndarray:
    """How many of the SPAN places from each on are hit."""
    out, at, sums, n = np.zeros((len(hit), WIDTH - SPAN + 1), np.uint8), 0, hit.view(np.uint8), 1
    while True:  # sums of 1, 2, 4 ... places; those that SPAN is made of
        if SPAN & n:
            out += sums[:, at : at + WIDTH - SPAN + 1]
            at += n
        if 2 * n > SPAN:
            return out
        sums, n = sums[:, :-n] + sums[:, n:], 2 * n


def _ends(hit: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first and the last hit of the stretches of SPAN places that begin where ``begins`` says; WIDTH and -1 without any."""
    edge = np.zeros((len(hit), WIDTH + 1), np.int8)
    edge[:, : WIDTH - SPAN + 1] += begins
    edge[:, SPAN:] -= begins
    held = hit & (np.cumsum(edge, 1, dtype=np.int8)[:, :WIDTH] > 0)
    some = begins.any(1)
    return np.where(some, held.argmax(1), WIDTH), np.where(some, WIDTH - 1 - held[:, ::-1].argmax(1), -1)


def _reaching(rows: np.ndarray, hit: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Those of ``rows`` that have ALIKE hits in SPAN places, and the first and the last of these."""
    some = np.flatnonzero(np.count_nonzero(hit, 1) >= ALIKE)
    held = (_sums(hit[some]) >= ALIKE) & begins[some]
    any_ = held.any(1)
    some = some[any_]
    return rows[some], *_ends(hit[some], held[any_])


class Held:
    """Contents of windows, each with its place in the middle of a row: 8 bits of each shingle (``data`` from ``at``), and all 32 (``codes`` from ``spot``) of those whose ``spot`` is not -1."""

    def __init__(self, at: np.ndarray, size: np.ndarray, data: np.ndarray, left: np.ndarray, codes: np.ndarray | None = None, spot: np.ndarray | None = None):
        n = len(at)
        place = np.arange(WIDTH) - (REACH - left)[:, None]
        self.inside = (place >= 0) & (place < size[:, None])
        self.own = np.zeros((n, WIDTH), np.uint8)
        self.own[self.inside] = data[ragged(at, size)]
        self.has = np.zeros((n, 256), bool)
        self.has[np.repeat(np.arange(n), size), data[ragged(at, size)]] = True
        #: Where SPAN places begin that the window holds.
        self.begins = self.inside[:, : WIDTH - SPAN + 1] & self.inside[:, SPAN - 1 :]
        self.row = np.full(n, -1)
        if codes is not None:
            wide = np.flatnonzero(spot >= 0)
            self.row[wide] = np.arange(len(wide))
            self.code = np.zeros((len(wide), WIDTH), np.uint32)
            self.code[self.inside[wide]] = codes[ragged(spot[wide], size[wide])]

    def alike(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Which pairs have SPAN shingles of a that are alike by 8 bits, wherever they lie in b."""
        hit = self.has[b[:, None], self.own[a]] & self.inside[a]
        return ((_sums(hit) >= ALIKE) & self.begins[a]).any(1)

    def proved(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each pair the first and last of a's shingles, from one that is the same to another, in SPAN of which ALIKE are the same as b's place by place; both ways from the window's place."""
        hit = (self.code[self.row[a]] == self.code[self.row[b]]) & self.inside[a] & self.inside[b]
        return _ends(hit, (_sums(hit) >= ALIKE) & self.begins[a] & self.begins[b] & hit[:, REACH, None])


def compared(s: np.ndarray, doc: np.ndarray, w: Held) -> list[np.ndarray]:
    """Pairs of windows (later document, earlier document) of one signature that have SPAN shingles alike around their places: a, b, the first and last place that are ``proved`` (WIDTH and -1: none), and whether there may be more.

    Windows are in order of signature, document and place. In a group of over FEW whose shingles are all there in 32 bits,
    a window is asked only for what exceeds its proved places: of those that prove more, the widest of a block to both sides
    are given, and of the others all whose shingles, wherever they lie, may make a passage that reaches beyond.
    """
    n, out = len(s), []
    head = np.flatnonzero(_firsts(s)) if n else np.zeros(0, np.int64)
    many = np.diff(np.append(head, n))

    def give(a: np.ndarray, b: np.ndarray, first: np.ndarray | None = None, last: np.ndarray | None = None, more: np.ndarray | None = None) -> None:
        m = len(a)
        out.append((a, b, np.full(m, WIDTH) if first is None else first, np.full(m, -1) if last is None else last, np.ones(m, bool) if more is None else more))

    whole = np.array([(w.row[g : g + m] >= 0).all() for g, m in zip(head, many)], bool) & (many > FEW)
    before = np.arange(n) - np.repeat(head, many)
    some = np.flatnonzero(np.repeat(~whole, many) & (before > 0))
    cut = np.append(np.flatnonzero(np.diff(np.cumsum(before[some]) // 50_000, prepend=-1)), len(some))
    for i, j in zip(cut, cut[1:]):
        later = some[i:j]
        a, b = np.repeat(later, before[later]), ragged(later - before[later], before[later])
        for i in range(0, len(a), 50_000):
            x, y = a[i : i + 50_000], b[i : i + 50_000]
            x, y = (v[doc[x] != doc[y]] for v in (x, y))
            good = w.alike(x, y)
            give(x[good], y[good])
    for g, m in zip(head[whole].tolist(), many[whole].tolist()):
        _compare_large(g, m, doc, w, give)
    kinds = (np.int64, np.int64, np.int64, np.int64, bool)
    return [np.concatenate(x) for x in zip(*out, strict=True)] if out else [np.zeros(0, t) for t in kinds]


def _compare_large(g: int, m: int, doc: np.ndarray, w: Held, give: Callable) -> None:
    """``compared`` for the windows g to g + m of one signature, in blocks of earlier ones."""
    place = np.arange(WIDTH) - REACH
    code, all_in, begins = w.code[w.row[g : g + m]], w.inside[g : g + m], w.begins[g : g + m]
    slots, wide = slot(code, SLOTS).astype(np.int32), slot(code, WIDER).astype(np.int32)
    first, last = np.full(m, WIDTH), np.full(m, -1)  # what is proved of each window
    # SPAN times the same shingle are a passage of whoever has it: ``matches`` takes them, wherever it stands
    same = (code == code[:, REACH, None]) & all_in
    low_same, high_same = REACH + 1 - np.where(same[:, : REACH + 1].all(1), REACH + 1, same[:, REACH::-1].argmin(1)), REACH - 1 + np.where(same[:, REACH:].all(1), REACH + 1, same[:, REACH:].argmin(1))
    few = high_same - low_same + 1 < SPAN
    low_same[few], high_same[few] = WIDTH, -1
    there, of_block = np.zeros(1 << WIDER, bool), np.zeros((BLOCK, 1 << SLOTS), bool)
    row, spots = np.nonzero(all_in)
    own, at = np.unique(code[row, spots].astype(np.uint64) << np.uint64(32) | row.astype(np.uint64), return_inverse=True)
    change = _firsts(own >> np.uint64(32))
    shared = np.zeros(code.shape, bool)
    shared[row, spots] = (np.bincount(np.cumsum(change) - 1)[np.cumsum(change) - 1] > 1)[at]
    for start in range(0, m, 4096):
        mine = np.arange(start, min(start + 4096, m))
        counts = np.zeros((3, len(mine), 256), np.float32)  # of shingles around, and of the SIDE to the right and to the left
        inside = w.inside[g + mine]
        for x, side in enumerate((inside, inside & (place > 0) & (place <= SIDE), inside & (place < 0) & (place >= -SIDE))):
            row, spots = np.nonzero(side)
            counts[x] = np.bincount(row * 256 + w.own[g + mine[row], spots], minlength=len(mine) * 256).reshape(-1, 256)
        full = counts[1:].sum(2) == SIDE
        # shingles that no other window has are in no passage
        able = np.flatnonzero(((_sums(shared[mine]) >= ALIKE) & begins[mine]).any(1))
        begin, step = 0, 16
        while begin < mine[-1]:
            stop = min(begin + step, int(mine[-1]))
            known = all_in[begin:stop]
            there[wide[begin:stop][known]] = True
            # a passage of one of the block is one of the shingles of all of them
            rest = able[mine[able] > begin]
            rest, low, high = _reaching(rest, there[wide[mine[rest]]] & all_in[mine[rest]], begins[mine[rest]])
            rest = rest[(low < first[mine[rest]]) | (high > last[mine[rest]])]
            there[wide[begin:stop][known]] = False
            if not len(rest):
                begin, step = stop, min(2 * step, BLOCK)
                continue
            set_ = np.nonzero(known)[0], slots[begin:stop][known]
            of_block[set_] = True
            block = w.has[g + begin : g + stop].T.astype(np.float32)
            may = counts[0, rest] @ block >= ALIKE
            near = np.zeros_like(may)
            for x in (1, 2):
                near |= (counts[x, rest] @ block >= SIDE - (SPAN - ALIKE)) & full[x - 1, rest][:, None]
            a, b = np.nonzero(may & near)
            a, b = mine[rest[a]], b + begin
            ok = (doc[g + a] != doc[g + b]) & (b < a)
            a, b = a[ok], b[ok]
            for i in range(0, len(a), 50_000):
                x, y = a[i : i + 50_000], b[i : i + 50_000]
                hit = of_block[(y - begin)[:, None], slots[x]] & all_in[x]
                some, low, high = _reaching(np.arange(len(x)), hit, begins[x])
                x, y = x[some], y[some]
                new = (low < first[x]) | (high > last[x])
                x, y, low, high = x[new], y[new], low[new], high[new]
                lo, hi = w.proved(g + x, g + y)
                one = (code[x, REACH] == code[y, REACH]) & (high_same[x] >= 0)
                sure_lo, sure_hi = np.where(one, np.minimum(lo, low_same[x]), lo), np.where(one, np.maximum(hi, high_same[x]), hi)
                pick = np.zeros(len(x), bool)
                for key, better in ((sure_lo, sure_lo < first[x]), (-sure_hi, sure_hi > last[x])):
                    order = np.lexsort((y, key, x))
                    best = order[_firsts(x[order])] if len(order) else order
                    pick[best[better[best]]] = True
                np.minimum.at(first, x[pick], sure_lo[pick])
                np.maximum.at(last, x[pick], sure_hi[pick])
                more = (low < first[x]) | (high > last[x]) | pick & one
                told = pick | more
                give(g + x[told], g + y[told], np.where(pick, lo, WIDTH)[told], np.where(pick, hi, -1)[told], more[told])
            of_block[set_] = False
            begin, step = stop, min(2 * step, BLOCK)


def alike_contents(s: np.ndarray, doc: np.ndarray, at: np.ndarray, size: np.ndarray, data: np.ndarray, left: np.ndarray, codes: np.ndarray | None = None, spot: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The pairs of ``compared``; without ``codes`` all that are alike by 8 bits."""
    return tuple(compared(s, doc, Held(at, size, data, left, codes, spot))[:2])


def stamp(codes: np.ndarray) -> int:
    """32 bits that tell a stretch of at most WIDTH shingles."""
    return int((codes * _STAMP[: len(codes)]).sum(dtype=np.uint64) >> np.uint64(32))


def near_rows(s, doc, k, c, w: Held, left, right) -> list[np.ndarray]:
    """Parts of the pairs of ``compared``: proved ones with the stamp of their shingles for a shift, and whole contents."""
    a, b, first, last, more = compared(s, doc, w)
    x, low, high = a[last >= 0], first[last >= 0], last[last >= 0]
    code = np.concatenate([np.zeros(0, np.uint32), *(w.code[w.row[v], i : j + 1] for v, i, j in zip(x, low, high))])
    size = high - low + 1
    stamps = np.add.reduceat(code * _STAMP[ragged(np.zeros(len(x), np.int64), size)], np.cumsum(size) - size) if len(x) else np.zeros(0, np.uint64)
    out = [[doc[x], doc[b[last >= 0]], k[x] + SURE + COPY + PROVED, (stamps >> np.uint64(32)).astype(np.uint32).view(np.int32), c[x] + low - REACH, c[x] + high - REACH, c[x]]]
    i, j = c[a] - left[a], c[a] + right[a]
    # two shifts where they differ, so that all of the partner's shingles may lie opposite
    shifts, mark = (i - (c[b] - left[b]), j - (c[b] + right[b])), k[a] + SURE + np.where(more, 0, SPARE)
    for shift, x in zip(shifts, (slice(None), shifts[0] != shifts[1])):
        out.append([v[x] for v in (doc[a], doc[b], mark, shift, i, j, c[a])])
    return [np.concatenate(v) for v in zip(*out, strict=True)]


def near_parts(docs: DataFrame, met: DataFrame) -> DataFrame:
    """Blobs of parts that a first holder shares with an earlier one of other content, by bucket of the member."""
    n = parts(docs.sparkSession)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs, asked = [], {}
        for batch in batches:
            for bucket, kind, blob in zip(*(batch.column(x).to_pylist() for x in ("bucket", "kind", "data")), strict=True):
                asked.setdefault(bucket, {3: [], 4: []})[kind].append(unpack(blob, HELD))
        for found in asked.values():
            s, k, doc, c, before, after = (np.concatenate(x) for x in [*zip(*found[3], *found[4], strict=True)][:-1])
            left, right = np.minimum(before, REACH).astype(np.int64), np.minimum(after, REACH).astype(np.int64)
            codes = np.concatenate([np.zeros(0, np.uint8), *(x[-1] for x in found[4])]).view("<u4")
            data = np.concatenate([*(x[-1] for x in found[3]), slot(codes, 8).astype(np.uint8)])
            size = left + right + 1
            at = np.cumsum(size) - size
            spot = at - (len(data) - len(codes))  # kind 4 comes last
            order = np.lexsort((c, doc, s))
            s, k, doc, c, left, right, size, at, spot = (x[order] for x in (s, k & np.uint8(HASHES - 1), doc, c.astype(np.int64), left, right, size, at, spot))
            w = Held(at, size, data, left, codes, np.maximum(spot, -1))
            pairs.append(near_rows(s, doc, k.astype(np.int32), c, w, left, right))
        if pairs:
            yield blob_rows(pair_blobs([np.concatenate(x) for x in zip(*pairs, strict=True)], n), 1)

    return contents(docs, met).repartition(n, "bucket").mapInArrow(compare, BLOBS)


def common_parts(docs: DataFrame) -> DataFrame:
    """Blobs of parts that a window of ``member`` shares with one of an earlier document, by bucket of the member."""
    met = materialise(copies(docs), "copies")
    return met.where("kind = 1").unionByName(near_parts(docs, met))


def _firsts(*keys: np.ndarray) -> np.ndarray:
    """Where sorted keys change."""
    out = np.ones(len(keys[0]), bool)
    out[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    return out


def needed(member, partner, k, i, j, c) -> np.ndarray:
    """Which parts stay: all but those of partners whose every part lies where other partners hold the member's own words.

    Copies are the same within REACH of their place, and proved parts are passages. Stretches of one partner that touch are
    one. Of these, sorted and without those that lie in another, each next one is the last that leaves no gap; all places
    that any of them covers stay covered by the chosen ones.
    """
    keep = np.ones(len(member), bool)
    own = np.flatnonzero(k & COPY)
    if not len(own):
        return keep
    low, high = np.maximum(i[own], c[own] - REACH), np.minimum(j[own], c[own] + REACH)
    order = np.lexsort((low, partner[own], member[own]))
    own, low, high = own[order], low[order], high[order]
    head = _firsts(member[own], partner[own])
    room, group = int(high.max()) + 3, np.cumsum(head) - 1
    upto = np.maximum.accumulate(high + group * room) - group * room
    head[1:] |= low[1:] > upto[:-1] + 1
    at = np.flatnonzero(head)
    own, low, high = own[at], low[at], upto[np.append(at[1:], len(own)) - 1]
    order = np.lexsort((partner[own], -high, low, member[own]))
    own, low, high = own[order], low[order], high[order]
    head = _firsts(member[own])
    room, group = int(max(j.max(), high.max())) + 2, np.cumsum(head) - 1
    a, b = low + group * room, high + group * room  # one line of places for all members
    last = np.maximum.accumulate(b)
    outer = np.append(True, b[1:] > last[:-1])
    own, a, b = own[outer], a[outer], b[outer]
    after = np.searchsorted(a, b + 1, "right") - 1  # the last stretch that begins in this one or right after it
    chosen, at, n = [], 0, len(own)
    for x, nxt in enumerate(after.tolist()):
        if x == at:
            chosen.append(x)
            at = nxt if nxt > x else x + 1
    # the stretches that copies cover, without gaps between those that touch
    begin = np.flatnonzero(np.append(True, a[1:] > b[:-1] + 1))
    start, stop = a[begin], b[np.append(begin[1:], len(b)) - 1]
    members = member[own[np.searchsorted(group[outer], np.arange(group[-1] + 1))]]
    of = np.minimum(np.searchsorted(members, member), len(members) - 1)
    x, y = i + of * room, j + of * room
    at = np.maximum(np.searchsorted(start, x, "right") - 1, 0)
    within = (members[of] == member) & (start[at] <= x) & (y <= stop[at]) | (k & SPARE > 0)
    order = np.lexsort((partner, member))
    head = _firsts(member[order], partner[order])
    pair = np.empty(len(member), np.int64)
    pair[order] = np.cumsum(head) - 1
    stays = np.zeros(pair.max() + 1, bool)
    stays[pair[~within]] = True
    stays[pair[own[chosen]]] = True
    return stays[pair]


def covered(member, partner, k, shift, i, j) -> list[np.ndarray]:
    """member, partner, first and last place (of the member's shingles) that parts of ENOUGH functions, or one that is SURE, cover, and the places of the partner that may lie opposite."""
    order = np.lexsort((i, k, partner, member))
    member, partner, k, shift, i, j = (x[order] for x in (member, partner, k, shift, i, j))
    pair = np.cumsum(_firsts(member, partner)) - 1
    weight = np.where(k >= SURE, ENOUGH, 1)
    enough = np.bincount(pair, _firsts(pair, k) * weight) >= ENOUGH
    member, partner, k, shift, i, j, weight, pair = (x[enough[pair]] for x in (member, partner, k, shift, i, j, weight, pair))
    if not len(pair):
        return [np.zeros(0, np.int64)] * 6
    head = _firsts(pair)
    first = np.flatnonzero(head)
    pair = np.cumsum(head) - 1
    # parts of one function that overlap count once
    own = _firsts(pair, k)
    group = np.cumsum(own) - 1
    room = int(j.max()) + 2
    upto = np.maximum.accumulate(j + group * room) - group * room
    begin = own.copy()
    begin[1:] |= i[1:] > upto[:-1]
    at = np.flatnonzero(begin)
    start, stop, of = i[at], upto[np.append(at[1:], len(i)) - 1] + 1, pair[at]
    place, step, of = np.concatenate([start, stop]), np.concatenate([weight[at], -weight[at]]), np.concatenate([of, of])
    order = np.lexsort((step, place, of))
    place, of = place[order], of[order]
    on = np.cumsum(step[order]) >= ENOUGH
    was = np.append(False, on[:-1])
    up, down = np.flatnonzero(on & ~was), np.flatnonzero(was & ~on)
    some, at = np.unique(of[up], return_index=True)
    last = len(down) - 1 - np.unique(of[down][::-1], return_index=True)[1]
    low, high = place[up[at]], place[down[last]] - 1
    least, most = np.minimum.reduceat(shift, first)[some], np.maximum.reduceat(shift, first)[some]
    return [x.astype(np.int64) for x in (member[first[some]], partner[first[some]], low, high, np.maximum(low - most, 0), high - least)]


def proved_rows(member, partner, stamps, i, j) -> list[np.ndarray]:
    """Proved parts as ``candidates`` gives them, without those that lie in another of the same two documents."""
    order = np.lexsort((-j, i, partner, member))
    member, partner, stamps, i, j = (x[order].astype(np.int64) for x in (member, partner, stamps, i, j))
    if len(i):
        line = j + (np.cumsum(_firsts(member, partner)) - 1) * (int(j.max()) + 2)
        keep = np.append(True, line[1:] > np.maximum.accumulate(line)[:-1])
        member, partner, stamps, i, j = (x[keep] for x in (member, partner, stamps, i, j))
    return [member, partner, i, j, np.full(len(i), -1), stamps & 0xFFFFFFFF]


def candidates(docs: DataFrame) -> DataFrame:
    """member, partner, i, j, u, v: stretches of shingles (both ends in) of two documents that may hold one passage; with u of -1 the member's stretch is one, and v its stamp."""

    def cover(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked: dict[int, list] = {}
        for b in batches:
            for bucket, blob in zip(b.column("bucket").to_pylist(), b.column("data").to_pylist(), strict=True):
                asked.setdefault(bucket, []).append(unpack(blob, PAIRS)[:7])
        for found in asked.values():
            member, partner, k, shift, i, more, place = (np.concatenate(x) for x in zip(*found, strict=True))
            j = i.astype(np.int64) + more
            asked_for = needed(member, partner, k, i.astype(np.int64), j, i.astype(np.int64) + place)
            member, partner, k, shift, i, j = (x[asked_for] for x in (member, partner, k, shift, i, j))
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in proved_rows(*(x[k & PROVED > 0] for x in (member, partner, shift, i, j)))], ["member", "partner", "i", "j", "u", "v"])
            out = covered(*(x[k & PROVED == 0] for x in (member, partner, k, shift, i, j)))
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in out], ["member", "partner", "i", "j", "u", "v"])

    sent = common_parts(docs).repartition(parts(docs.sparkSession), "bucket")
    return sent.mapInArrow(cover, "member long, partner long, i long, j long, u long, v long")


def matches(own: np.ndarray, other: np.ndarray) -> list[tuple[int, int]]:
    """Stretches of ``own`` shingles, ends out, that are near-duplicates of stretches of ``other``.

    Matches are runs within one alignment of both documents (a shingle that ``other`` has twice is found at its first
    place). A run that is alike enough as a whole is one stretch; of another run, all SPAN shingles that are. A run that is
    shorter by the shingles at its ends that differ is one if it has ALIKE shingles.
    """
    order = np.argsort(other, kind="stable")
    place = np.minimum(np.searchsorted(other, own, sorter=order), len(other) - 1)
    at = order[place]
    hit = np.flatnonzero(other[at] == own)
    hit = hit[np.argsort(at[hit] - hit, kind="stable")]
    out = []
    for aligned in np.split(hit, np.flatnonzero(np.diff(at[hit] - hit) > SPAN) + 1):
        aligned = np.sort(aligned)
        for run in np.split(aligned, np.flatnonzero(np.diff(aligned) > GAP + 1) + 1):
            if len(run) and run[-1] - run[0] + 1 >= SPAN:
                out += _alike(own, other, at, run)
            elif len(run) >= ALIKE and np.ptp(at[run] - run) == 0:  # place by place, with differing shingles at an end of the SPAN
                a, b = int(run[0]), int(run[-1]) + 1
                if b - a + min(a, int(at[a])) + min(len(own) - b, len(other) - int(at[b - 1]) - 1) >= SPAN:
                    out.append((a, b))
    return out


def _alike(own: np.ndarray, other: np.ndarray, at: np.ndarray, run: np.ndarray) -> list[tuple[int, int]]:
    a, b = int(run[0]), int(run[-1]) + 1
    x, y = np.unique(own[a:b]), np.unique(other[int(at[run].min()) : int(at[run].max()) + 1])
    both = len(np.intersect1d(x, y, assume_unique=True))
    if 5 * both >= 4 * (len(x) + len(y) - both):
        return [(a, b)]
    start = np.arange(a, b - SPAN + 1)
    first, last = np.searchsorted(run, start), np.searchsorted(run, start + SPAN) - 1
    both = last - first + 1
    length = np.abs(at[run[np.maximum(last, 0)]] - at[run[np.minimum(first, len(run) - 1)]]) + 1
    good = start[(both > 0) & (5 * both >= 4 * (SPAN + np.maximum(length, both) - both))]
    return [(int(g[0]), int(g[-1]) + SPAN) for g in np.split(good, np.flatnonzero(np.diff(good) > 1) + 1) if len(g)]


#: Bits of the bitmap of documents, whatever the corpus (8 MB), and of one row of it.
MARKED, MARKED_ROW = 26, 18


def marked(found: DataFrame, column: str) -> np.ndarray:
    """A bitmap of the hashes of all ids in ``column``: a text whose bit is not set needs no join."""

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(1 << MARKED, bool)
        for b in batches:
            bits[_cell(b.column(0).to_numpy())] = True
        yield from rows({int(r): np.packbits(bits[r << MARKED_ROW : r + 1 << MARKED_ROW]) for r in np.unique(np.flatnonzero(bits) >> MARKED_ROW)})

    def rows(held: dict[int, np.ndarray]) -> Iterator[pa.RecordBatch]:
        if held:
            press = zstandard.ZstdCompressor(1).compress
            yield pa.RecordBatch.from_arrays([pa.array([*held], pa.int32()), pa.array([press(x.tobytes()) for x in held.values()], pa.binary())], ["row", "data"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for b in batches:
            for r, x in zip(b.column("row").to_pylist(), b.column("data").to_pylist(), strict=True):
                x = np.frombuffer(zstandard.ZstdDecompressor().decompress(x), np.uint8)
                held[r] = held[r] | x if r in held else x
        yield from rows(held)

    out, width = np.zeros(1 << MARKED - 3, np.uint8), 1 << MARKED_ROW - 3
    for row in found.select(column).mapInArrow(cells, "row int, data binary").repartition(min(64, parts(found.sparkSession)), "row").mapInArrow(merge, "row int, data binary").collect():  # in all at most the bitmap
        out[row.row * width : (row.row + 1) * width] = np.frombuffer(zstandard.ZstdDecompressor().decompress(bytes(row.data)), np.uint8)
    return out


def _cell(ids: np.ndarray) -> np.ndarray:
    return (mix(ids.astype(np.uint64)) >> np.uint64(64 - MARKED)).astype(np.int64)


def among(docs: DataFrame, bitmap: np.ndarray, inside: bool = True) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For a task: rows of ``docs`` whose doc_id is in the bitmap, or all others (those without doc_id too)."""
    sent = docs.sparkSession.sparkContext.broadcast(zstandard.ZstdCompressor(3).compress(bitmap.tobytes()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.frombuffer(zstandard.ZstdDecompressor().decompress(sent.value), np.uint8)
        for b in batches:
            ids = b.column("doc_id")
            cell = _cell(ids.fill_null(0).to_numpy())
            hit = (bits[cell >> 3] >> (7 - (cell & 7)).astype(np.uint8) & 1).astype(bool) & ids.is_valid().to_numpy(zero_copy_only=False)
            yield b.filter(pa.array(hit == inside))

    return run


def stretches(docs: DataFrame, found: DataFrame) -> DataFrame:
    """For ``found`` of ``candidates``: member, partner, i, j and ``h``, the partner's shingles (32 bits each) that may hold passages of the member's i to j.

    Partners' texts join the pairs by rows: a document that many others copy is joined as often, never gathered.
    """

    def stretch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, buf, offs in slices(inflated(batches)):
            h, at = shingles(*words(buf, offs), SHINGLE, whole=False)
            h = (h >> np.uint64(32)).astype(np.uint32)
            u, v = b.column("u").to_pylist(), b.column("v").to_pylist()
            own = [h[at[d] + u[d] : min(at[d] + v[d] + 1, at[d + 1])].tobytes() for d in range(b.num_rows)]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("member", "partner", "i", "j")), pa.array(own, pa.binary())], ["member", "partner", "i", "j", "h"])

    texts = squeezed(docs, only=among(docs, marked(found, "partner"))).withColumnRenamed("doc_id", "partner")
    return found.hint("merge").join(texts, "partner").select("member", "partner", "i", "j", "u", "v", "z").mapInArrow(stretch, "member long, partner long, i long, j long, h binary")


def passage_dedup(docs: DataFrame) -> DataFrame:
    """All columns of ``docs`` and n_words, spans (first word, last word out), partners, deduped.

    spans are the maximal runs of words in passages of 50 words or more of which an earlier document (smaller doc_id)
    holds a near-duplicate, partners the documents it was found in, deduped the text without them. Texts that are null,
    empty or shorter than 50 words keep all; so do rows without doc_id; rows of one doc_id count as one document.
    Columns of ``docs`` named n_words, spans, partners or deduped are replaced.
    """
    from pyspark.sql.types import ArrayType, LongType, StructType

    asked = materialise(candidates(docs), "candidates")
    proved = asked.where("u < 0").select("member", "partner", "i", "j", F.lit(None).cast("binary").alias("h"), F.col("v").alias("stamp"))
    held = stretches(docs, asked.where("u >= 0")).withColumn("stamp", F.lit(None).cast("long")).unionByName(proved)
    found = held.groupBy(F.col("member").alias("doc_id")).agg(F.collect_list(F.struct("partner", "i", "j", "h", "stamp")).alias("_s"))

    def cut(batches: Iterator[pa.RecordBatch], joins: bool = True) -> Iterator[pa.RecordBatch]:
        for b, buf, offs in slices(inflated(batches, kind=pa.string()) if joins else batches):
            wh, at, starts = word_spans(buf, offs)
            ends = word_ends(buf, offs, starts)
            h, first = shingles(wh, at, SHINGLE, whole=False)
            h = (h >> np.uint64(32)).astype(np.uint32)
            spans, partners, texts = [], [], []
            for d, s in enumerate(b.column("_s").to_pylist() if joins else [None] * b.num_rows):
                hits, by = [], set()
                for x in s or ():
                    own = h[first[d] + x["i"] : min(first[d] + x["j"] + 1, first[d + 1])]
                    if x["h"] is None:
                        if len(own) == x["j"] - x["i"] + 1 and stamp(own) == x["stamp"]:  # another row of this doc_id may have the stretch
                            hits.append((x["i"], x["j"] + SHINGLE))
                            by.add(x["partner"])
                        continue
                    other = np.frombuffer(x["h"], np.uint32)
                    if len(own) and len(other) and (found := matches(own, other)):
                        hits += [(x["i"] + m, x["i"] + e + SHINGLE - 1) for m, e in found]
                        by.add(x["partner"])
                runs: list[list[int]] = []
                for x, y in sorted(hits):
                    if runs and x <= runs[-1][1]:
                        runs[-1][1] = max(runs[-1][1], y)
                    else:
                        runs.append([x, y])
                edges = [offs[d], *(e for x, y in runs for e in (starts[at[d] + x], ends[at[d] + y - 1])), offs[d + 1]]
                texts.append(b"".join(buf[x:y].tobytes() for x, y in zip(edges[::2], edges[1::2], strict=True)).decode())
                spans.append([{"first_word": x, "last_word": y} for x, y in runs])
                partners.append(sorted(by))
            keep = [c for c in b.schema.names if c != "_s"]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), pa.array(np.diff(at)), pa.array(spans, pa.list_(pa.struct([("first_word", pa.int64()), ("last_word", pa.int64())]))), pa.array(partners, pa.list_(pa.int64())), pa.array(texts, pa.string())], [*keep, "n_words", "spans", "partners", "deduped"])

    plain = docs.drop("n_words", "spans", "partners", "deduped")
    others = [c for c in plain.columns if c != "text"]
    schema = StructType([plain.schema[c] for c in [*others, "text"]]).add("n_words", "long").add("spans", ArrayType(StructType().add("first_word", LongType()).add("last_word", LongType()))).add("partners", ArrayType(LongType())).add("deduped", "string")
    plain, members = plain.select(*others, "text"), marked(asked, "member")
    joint = squeezed(plain, others, among(plain, members)).join(found.hint("merge"), "doc_id", "left").select(*others, "z", "_s").mapInArrow(cut, schema)
    rest = among(plain, members, inside=False)
    return joint.unionByName(plain.mapInArrow(lambda batches: cut(rest(batches), joins=False), schema))
