"""Exact substring dedup: bytes covered by a 100-byte string that also starts earlier.

1. Anchors. Each 100-byte window takes the least hash among the 32-byte strings in it (the leftmost of equals); equal
   windows take equal anchors. A run of windows with one anchor is a record, one for every 35 bytes or so. An anchor of
   one record only needs no further look.
2. Contexts. The bytes around every shared anchor, up to 168, go to the bucket of their anchor; equal contexts of a task
   go once, so what a third of all documents share arrives once from each task.
3. Suffix arrays. A bucket's contexts form shards. Each shard gets its suffix array by Larsson-Sadakane refinement
   (groups not yet single are sorted by the rank ``h`` bytes on, ``h`` doubling), Kasai's common prefixes cut it into
   groups of equal 100-byte strings, and where an anchor's contexts fill several shards, the shards' distinct strings are
   merged by binary search. All but the first start in each group are removed.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.packed import BLOBS, blob_rows, by_bucket, inflated, squeezed, unpack
from tessera.llm.textcore import BYTE, STEP, mix, ragged, slices
from tessera.llm.workspace import materialise, parts

LENGTH = 100
GRAM = 32
#: Contexts in a shard, in bytes: positions, ranks and places then fit one 64-bit sorting key.
SHARD = 1 << 20
#: Records of one anchor from which its windows are dealt by more of their bytes.
HOT = 2048
#: Records a task holds before it sends them.
HELD = 1_000_000
LANES = 4096


def gram_hashes(buf: np.ndarray, size: int) -> np.ndarray:
    """Hash of the ``size`` (a power of two) bytes from each position; the last size - 1 are of no use."""
    h, step, n = BYTE[buf], STEP, 1
    while n < size:
        nxt = h * step
        nxt[:-n] += h[n:]
        h, step, n = nxt, step * step, 2 * n
    return mix(h)


def anchors(buf: np.ndarray, offs: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, ...]:
    """anchor, document, start in the document, number of windows, and bytes from the start to the anchor, of every record."""
    n = len(buf)
    span = length - GRAM + 1
    size = np.diff(offs)
    with np.errstate(over="ignore"):
        h = gram_hashes(buf, GRAM)
    bits = np.uint64(max(8, int(n).bit_length()))
    key = (h >> bits << bits) | np.arange(n, dtype=np.uint64)
    w = 1
    while 2 * w <= span:
        key[: n - w] = np.minimum(key[: n - w], key[w:])
        w *= 2
    key[: n - (span - w)] = np.minimum(key[: n - (span - w)], key[span - w :])
    windows = np.maximum(size - length + 1, 0)
    p = ragged(offs[:-1], windows)
    at = (key[p] & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    first = np.ones(len(p), bool)
    first[1:] = at[1:] != at[:-1]
    first = np.flatnonzero(first)
    doc = np.repeat(np.arange(len(size)), windows)[first]
    return h[at[first]], doc, p[first] - offs[doc], np.diff(np.append(first, len(p))), at[first] - p[first]


def leading(buf: np.ndarray, size: int = 8) -> np.ndarray:
    """The ``size`` bytes from each position as a big-endian number; zeros beyond the end."""
    out = np.zeros(len(buf), np.uint64)
    for j in range(min(size, len(buf))):
        out[: len(buf) - j] |= buf[j:].astype(np.uint64) << np.uint64(8 * (size - 1 - j))
    return out


def ordered(key: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Places in the order of ``key``, equal keys in their own order, and the keys so; a key has 64 - ``bits`` bits, a place ``bits``."""
    packed = np.sort(key << np.uint64(bits) | np.arange(len(key), dtype=np.uint64))
    return (packed & np.uint64((1 << bits) - 1)).astype(np.int64), packed >> np.uint64(bits)


def suffix_array(buf: np.ndarray) -> np.ndarray:
    """Suffixes in order, for up to 2^21 bytes. Kasai's step needs the whole order, not that of the first bytes alone."""
    n = len(buf)
    bits = n.bit_length()
    if bits > 21:
        raise ValueError(f"{n} bytes are too many for one shard")
    h = min(8, (64 - bits) // 8)
    sa, key = ordered(leading(buf, h), bits)
    head = np.ones(n, bool)
    head[1:] = key[1:] != key[:-1]
    rank = np.zeros(n + 1, np.uint64)  # from 1 on; 0 is the empty suffix
    rank[sa] = np.maximum.accumulate(np.where(head, np.arange(1, n + 1), 0)).astype(np.uint64)
    while h < n:
        todo = np.flatnonzero(~(head & np.append(head[1:], True)))
        if not len(todo):
            break
        own = sa[todo]
        order, key = ordered(rank[own] << np.uint64(bits) | rank[np.minimum(own + h, n)], bits)
        own = own[order]
        sa[todo] = own
        head[todo[1:]] = key[1:] != key[:-1]
        rank[own] = np.maximum.accumulate(np.where(head[todo], todo + 1, 0)).astype(np.uint64)
        h *= 2
    return sa


def common_prefixes(buf: np.ndarray, sa: np.ndarray, most: int) -> np.ndarray:
    """For each place in ``sa``, the common prefix with the place before, ``most`` at most (Kasai, in parallel lanes).

    Going from suffix i to i + 1 the common prefix shrinks by one at most, so every lane, a stretch of neighbouring
    suffixes, goes on from the last one's.
    """
    n = len(buf)
    before = np.full(n + 1, -1, np.int64)
    before[sa[1:]] = sa[:-1]
    word = np.append(leading(buf), np.zeros(most + 16, np.uint64))
    out = np.zeros(n, np.int64)
    step = -(-n // LANES)
    lane = np.arange(0, n, step)
    h = np.zeros(len(lane), np.int64)
    for s in range(step):
        i = lane + s
        live = i < n
        i = np.minimum(i, n - 1)
        j = before[i]
        h = np.where(live & (j >= 0), np.maximum(h - 1, 0), 0)
        go = np.flatnonzero(live & (j >= 0))
        while len(go):
            diff = word[i[go] + h[go]] ^ word[j[go] + h[go]]
            # whole equal words go on; else the leading zero bytes count
            add = np.where(diff == 0, 8, 7 - np.floor(np.log2(np.maximum(diff, 1).astype(np.float64))).astype(np.int64) // 8)
            add = np.where((diff != 0) & (diff >> np.uint64(56) != 0), 0, add)
            h[go] = np.minimum(h[go] + np.maximum(add, 0), np.minimum(n - np.maximum(i[go], j[go]), most))
            go = go[(diff == 0) & (h[go] < np.minimum(n - np.maximum(i[go], j[go]), most))]
        out[i[live]] = h[live]
    return out[sa]


def repeated(shards: list[tuple[np.ndarray, np.ndarray, np.ndarray]], length: int = LENGTH) -> list[np.ndarray]:
    """For each shard, which window starts repeat an earlier one in any shard.

    A shard is its bytes, the positions of its window starts, and each one's order (a structured array of document and
    place); equal orders are one occurrence.
    """
    flags, known, known_order = [], None, None
    for buf, starts, order in shards:
        sa = suffix_array(buf)
        group = np.cumsum(common_prefixes(buf, sa, length) < length)
        of = np.empty(len(buf), np.int64)
        of[sa] = group
        mine = of[starts]
        place = np.lexsort((order["p"], order["doc"], mine))
        head = np.ones(len(place), bool)
        head[1:] = mine[place[1:]] != mine[place[:-1]]
        first = place[np.flatnonzero(head)]
        rep = np.empty(len(place), np.int64)
        rep[place] = np.repeat(first, np.diff(np.append(np.flatnonzero(head), len(place))))
        flag = order != order[rep]
        if len(shards) > 1:
            text = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(buf, length)[starts[first]]).view(f"S{length}").ravel()
            if known is None:
                known, known_order = text, order[first]
                owner = np.zeros(len(text), np.int64)
                where = first
            else:
                at = np.searchsorted(known, text)
                hit = np.flatnonzero((at < len(known)) & (known[np.minimum(at, len(known) - 1)] == text))
                old, new = known_order[at[hit]], order[first[hit]]
                later = (old["doc"] < new["doc"]) | (old["doc"] == new["doc"]) & (old["p"] < new["p"])
                flag[first[hit[later]]] = True
                sooner = hit[~later & (old != new)]  # strings whose first start is in this shard
                for shard in np.unique(owner[at[sooner]]).tolist():
                    flags[shard][where[at[sooner[owner[at[sooner]] == shard]]]] = True
                known_order[at[sooner]], owner[at[sooner]], where[at[sooner]] = order[first[sooner]], len(flags), first[sooner]
                fresh = np.setdiff1d(np.arange(len(text)), hit)
                known = np.insert(known, at[fresh], text[fresh])
                known_order = np.insert(known_order, at[fresh], order[first[fresh]])
                owner = np.insert(owner, at[fresh], len(flags))
                where = np.insert(where, at[fresh], first[fresh])
        flags.append(flag)
    return flags


ORDER = np.dtype([("doc", np.int64), ("p", np.int64)])


def _ordered(doc: np.ndarray, p: np.ndarray) -> np.ndarray:
    out = np.empty(len(doc), ORDER)
    out["doc"], out["p"] = doc, p
    return out


def _runs(doc: np.ndarray, p: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Spans of bytes that these windows cover: neighbouring starts make one span."""
    if not len(doc):
        return doc, p, p
    order = np.lexsort((p, doc))
    doc, p = doc[order], p[order]
    head = np.ones(len(doc), bool)
    head[1:] = (doc[1:] != doc[:-1]) | (p[1:] > p[:-1] + 1)
    head = np.flatnonzero(head)
    return doc[head], p[head], p[np.append(head[1:], len(p)) - 1] + length


def _span_batch(doc, start, stop) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array(start, pa.int64()), pa.array(stop, pa.int64())], ["doc_id", "start", "stop"])


def shared_anchors(docs: DataFrame, length: int) -> DataFrame:
    """anchor, doc_id, start, n, at of the records whose anchor has another record; ``at`` is the anchor's place after start."""
    buckets = 4 * parts(docs.sparkSession)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []

        def flush() -> Iterator[pa.RecordBatch]:
            a, doc, p, n, at = (np.concatenate(x) for x in zip(*held, strict=True))
            held.clear()
            order = np.argsort(a)
            head = np.ones(len(a), bool)
            head[1:] = a[order[1:]] != a[order[:-1]]
            times = np.diff(np.append(np.flatnonzero(head), len(a)))
            first, rest = order[head], order[~head]
            # the first record of an anchor asks its bucket; the others know that it is shared and may go anywhere
            count = np.zeros(len(a), np.int32)
            count[first] = times
            keep = np.sort(first)
            yield blob_rows([*by_bucket((a[keep] % np.uint64(buckets)).astype(np.int64), [x[keep] for x in (a, doc, p, n, at, count)])], 0)
            if len(rest):
                yield blob_rows([*by_bucket(doc[rest] % buckets, [x[rest] for x in (a, doc, p, n, at, count)])], 1)

        for rows, buf, offs in slices(batches):
            a, doc, p, n, at = anchors(buf, offs, length)
            ids = rows.column("doc_id").to_numpy()
            held.append([a, ids[doc], p.astype(np.int32), n.astype(np.uint16), at.astype(np.uint16)])
            if sum(len(x[0]) for x in held) > HELD:
                yield from flush()
        if held:
            yield from flush()

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = ["<u8", "<i8", "<i4", "<u2", "<u2", "<i4"]
        asked: dict[int, list] = {}
        for b in batches:
            for bucket, kind, blob in zip(*(b.column(c).to_pylist() for c in ("bucket", "kind", "data")), strict=True):
                found = unpack(blob, kinds)[:6]
                if kind == 0:
                    asked.setdefault(bucket, []).append(found)
                else:
                    yield rows(found[:5])
        for found in asked.values():
            *cols, count = (np.concatenate(x) for x in zip(*found, strict=True))
            _, which = np.unique(cols[0], return_inverse=True)
            keep = np.bincount(which, count)[which] > 1
            if keep.any():
                yield rows([c[keep] for c in cols])

    def rows(cols: list[np.ndarray]) -> pa.RecordBatch:
        kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32()]
        return pa.RecordBatch.from_arrays([pa.array(c.view(np.int64) if c.dtype == np.uint64 else c, kind) for c, kind in zip(cols, kinds, strict=True)], ["anchor", "doc_id", "start", "n", "at"])

    sent = docs.select("doc_id", "text").where("doc_id is not null").mapInArrow(send, BLOBS)
    return sent.repartition(parts(docs.sparkSession), "bucket").mapInArrow(ask, "anchor long, doc_id long, start int, n int, at int")


def records(docs: DataFrame, length: int) -> DataFrame:
    """``shared_anchors`` with ``hot``: whether the anchor has more than HOT records. Anchors are found once and written."""
    found = materialise(shared_anchors(docs, length), "anchors")
    hot = materialise(found.groupBy("anchor").agg(F.count(F.lit(1)).alias("times")).where(F.col("times") > HOT).select("anchor", F.lit(True).alias("hot")), "hot")
    return found.join(hot, "anchor", "left").withColumn("hot", F.coalesce("hot", F.lit(False)))


def removed_spans(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """doc_id, start, stop of runs of bytes to remove; runs of one document may overlap."""
    buckets = 4 * parts(docs.sparkSession)
    columns = ["anchor", "start", "n", "at", "hot"]
    per_doc = records(docs, length).groupBy("doc_id").agg(F.collect_list(F.struct(*columns)).alias("r"))
    found = squeezed(docs).join(per_doc.hint("merge"), "doc_id").select("doc_id", "z", *(F.col(f"r.{c}").alias(c) for c in columns))

    def contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flat = lambda b, c: b.column(c).flatten().to_numpy(zero_copy_only=False)
        for b, buf, offs in slices(inflated(batches)):
            counts = b.column("anchor").value_lengths().to_numpy()
            a, p, n, at = flat(b, "anchor").view(np.uint64), *(flat(b, c).astype(np.int64) for c in ("start", "n", "at"))
            row = np.repeat(np.arange(b.num_rows), counts)
            hot = flat(b, "hot").astype(bool)
            if hot.any():
                a, p, n, row = _deal(a, p, n, p + at, row, hot, buf, offs, length)
            doc = b.column("doc_id").to_numpy()[row]
            size = n + length - 1
            data = buf[ragged(offs[row] + p, size)]
            # equal contexts of this slice: the first in order goes on, the others are removed here
            begin = np.cumsum(size) - size
            raw = data.tobytes()
            name: dict[bytes, int] = {}
            same = np.array([name.setdefault(raw[i:j], len(name)) for i, j in zip(begin.tolist(), (begin + size).tolist(), strict=True)])
            order = np.lexsort((p, doc, a, same))
            head = np.ones(len(order), bool)
            head[1:] = (same[order[1:]] != same[order[:-1]]) | (a[order[1:]] != a[order[:-1]])
            first = order[head]
            rep = np.repeat(first, np.diff(np.append(np.flatnonzero(head), len(order))))
            gone = order[(doc[order] != doc[rep]) | (p[order] != p[rep])]
            keep = np.sort(first)
            yield blob_rows([*by_bucket((a[keep] % np.uint64(buckets)).astype(np.int64), [a[keep], doc[keep], p[keep].astype(np.int32), n[keep].astype(np.int32)], data[ragged(begin[keep], size[keep])], size[keep])], 0)
            if len(gone):
                yield blob_rows([*by_bucket(doc[gone] % buckets, [doc[gone], p[gone].astype(np.int32), (p[gone] + size[gone]).astype(np.int32)])], 1)

    def resolve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked: dict[int, list] = {}
        for b in batches:
            for bucket, kind, blob in zip(*(b.column(c).to_pylist() for c in ("bucket", "kind", "data")), strict=True):
                if kind == 0:
                    asked.setdefault(bucket, []).append(unpack(blob, ["<u8", "<i8", "<i4", "<i4"]))
                else:
                    yield _span_batch(*unpack(blob, ["<i8", "<i4", "<i4"])[:3])
        for found in asked.values():
            a, doc, p, n, data = (np.concatenate(x) for x in zip(*found, strict=True))
            yield from _bucket(a, doc, p.astype(np.int64), n.astype(np.int64), data, length)

    sent = found.mapInArrow(contexts, BLOBS)
    return sent.repartition(parts(docs.sparkSession), "bucket").mapInArrow(resolve, "doc_id long, start long, stop long")


def _deal(a, p, n, at, row, hot, buf, offs, length):
    """Records of hot anchors in two: windows that hold half of the rest to the anchor's left, and the others.

    The new anchor covers those bytes too; equal windows still get equal anchors.
    """
    half = (length - GRAM) // 2
    own = np.flatnonzero(hot)
    p_, at_, stop = p[own], at[own], p[own] + n[own]
    split = np.clip(at_ - half + 1, p_, stop)  # windows from here on hold fewer than half bytes before the anchor
    power = np.multiply.accumulate(np.full(GRAM + half, STEP, np.uint64))
    out = [[x[~hot]] for x in (a, p, n, row)]
    for first, last, x in ((p_, split, at_ - half), (split, stop, at_)):
        some = np.flatnonzero(last > first)
        for i in range(0, len(some), 1 << 14):
            few = some[i : i + (1 << 14)]
            places = (offs[row[own[few]]] + x[few])[:, None] + np.arange(GRAM + half)
            for col, v in zip(out, (mix((BYTE[buf[places]] * power).sum(1, dtype=np.uint64)), first[few], (last - first)[few], row[own[few]]), strict=True):
                col.append(v)
    return (np.concatenate(x) for x in out)


def _bucket(a, doc, p, n, data, length) -> Iterator[pa.RecordBatch]:
    size = n + length - 1
    begin = np.cumsum(size) - size
    # contexts that several tasks sent count once; the first in order stands for all
    raw = data.tobytes()
    name: dict[bytes, int] = {}
    same = np.array([name.setdefault(raw[i:j], len(name)) for i, j in zip(begin.tolist(), (begin + size).tolist(), strict=True)])
    order = np.lexsort((p, doc, same, a))
    head = np.ones(len(order), bool)
    head[1:] = (same[order[1:]] != same[order[:-1]]) | (a[order[1:]] != a[order[:-1]])
    first = order[head]
    rep = np.repeat(first, np.diff(np.append(np.flatnonzero(head), len(order))))
    gone = order[(doc[order] != doc[rep]) | (p[order] != p[rep])]
    yield _span_batch(doc[gone], p[gone], p[gone] + size[gone])
    # shards of whole anchors; an anchor of more than a shard has shards of its own
    upto = np.cumsum(size[first])
    new = np.ones(len(first), bool)
    new[1:] = a[first[1:]] != a[first[:-1]]
    heads = np.flatnonzero(new)
    totals = np.diff(np.append(upto[heads] - size[first[heads]], upto[-1] if len(upto) else 0))
    groups: list[list[np.ndarray]] = []
    room, begun = 0, 0
    for h, t, e in zip(heads.tolist(), totals.tolist(), [*heads[1:].tolist(), len(first)], strict=True):
        if t > room and begun < h:
            groups.append([first[begun:h]])
            begun = h
        if t > SHARD:
            cut = np.cumsum(size[first[h:e]]) // SHARD
            groups.append(np.split(first[h:e], np.flatnonzero(np.diff(cut)) + 1))
            room, begun = 0, e
        else:
            room = (SHARD if t > room else room) - t
    if begun < len(first):
        groups.append([first[begun:]])
    for shards in groups:
        built = []
        for own in shards:
            at = np.cumsum(size[own]) - size[own]
            starts = ragged(at, n[own])
            places = ragged(p[own], n[own])
            built.append((data[ragged(begin[own], size[own])], starts, _ordered(np.repeat(doc[own], n[own]), places)))
        for (_, _, order_), flag in zip(built, repeated(built, length), strict=True):
            yield _span_batch(*_runs(order_["doc"][flag], order_["p"][flag], length))


def substring_dedup(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """doc_id, text, n_bytes, spans (start, stop of maximal removed runs), kept (remaining bytes) of every document.

    Removes each byte covered by a ``length``-byte string that also starts earlier: in a document of smaller doc_id, or
    in the same one. Judged on the input. Null texts count as empty, texts shorter than ``length`` keep all. Rows of one
    doc_id count as one document and should be equal; rows without doc_id keep all. Other columns are ignored.
    """
    spans = removed_spans(docs, length).groupBy("doc_id").agg(F.collect_list(F.struct("start", "stop")).alias("s"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
        for b, buf, offs in slices(inflated(batches)):
            size, spans_, kept = [], [], []
            for i, s in enumerate(b.column("s").to_pylist()):
                own, runs = buf[offs[i] : offs[i + 1]], []
                size.append(len(own))
                for x in sorted((x["start"], x["stop"]) for x in s or ()):
                    if runs and x[0] <= runs[-1][1]:
                        runs[-1][1] = max(runs[-1][1], x[1])
                    else:
                        runs.append([*x])
                edges = [0, *(e for r in runs for e in r), len(own)]
                kept.append(b"".join(own[x:y].tobytes() for x, y in zip(edges[::2], edges[1::2], strict=True)))
                spans_.append([{"start": x, "stop": y} for x, y in runs])
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(size, pa.int64()), pa.array(spans_, kind), pa.array(kept, pa.binary())], ["doc_id", "n_bytes", "spans", "kept"])

    return squeezed(docs).join(spans.hint("merge"), "doc_id", "left").mapInArrow(cut, "doc_id long, n_bytes long, spans array<struct<start: long, stop: long>>, kept binary")
