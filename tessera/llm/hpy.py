"""Language-model scores by a hierarchical Pitman-Yor model of word pairs.

Every word is a context with a Chinese restaurant of its own; all of them share one parent, the restaurant of single
words, whose customers are their tables and whose base is uniform over the vocabulary and one share for words never seen.
Seating is sampled by Gibbs: a dish's number of tables is drawn from its conditional given all others' (exactly, by
generalised Stirling numbers, for up to EXACT customers; beyond, by seating them anew in growing batches). A restaurant's
dishes are drawn side by side given the last sweep's tables. The parent is seated on first counts, children on that
parent, the parent on the children's tables, then children again, whose predictive probabilities are averaged over the
last sweeps; a text's score is their log.

Scale: every word keeps its own seating. The FREQUENT commonest words' goes to every task, as a word asks for it with
each token; the others' stays in the bucket of the word, which their pairs pass on the way to their restaurant. Of such a
word each context is one customer of the parent: under so small a base a second table is as good as impossible. A context
of more than HOT tokens is seated in parts, dealt by word, that share its numbers of customers and tables.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.langid import held_out
from tessera.llm.packed import BLOBS, blob_rows, by_bucket, pack, unpack
from tessera.llm.textcore import mix, slices, words
from tessera.llm.workspace import materialise, parts

END, START = np.uint64(0x0E4D0E4D0E4D0E4D), np.uint64(0x57A2757A2757A275)
FREQUENT = 100_000
HOT = 50_000
DISCOUNT, STRENGTH = 0.8, 1.0
PARENT_DISCOUNT, PARENT_STRENGTH = 0.6, 10.0
EXACT = 32
BURN_IN, SAMPLES = 1, 2
#: Tokens a task holds before it sends them.
HELD = 1_000_000
#: Numbers of a block of a vector that tasks sum.
BLOCK = 4096
_DEAL = np.uint64(0x9E3779B97F4A7C15)


def token_stream(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each token, the token before it, and its document."""
    wh, at = words(buf, offs)
    w = np.insert(wh, at[1:], END)
    at = at + np.arange(len(at))
    u = np.empty_like(w)
    u[1:] = w[:-1]
    u[at[:-1]] = START
    return w, u, np.repeat(np.arange(len(at) - 1), np.diff(at))


def tally(keys: np.ndarray, weights: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    found, which = np.unique(keys, return_inverse=True)
    return found, np.bincount(which, weights, len(found)).astype(np.int64)


def word_counts(train: DataFrame, buckets: int) -> DataFrame:
    """bucket, n_types, n_tokens, hist, data: counts of all training tokens, a row for each bucket of their hashes."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def flush() -> pa.RecordBatch:
            w, c = tally(np.concatenate(held))
            held.clear()
            return blob_rows([*by_bucket((w % np.uint64(buckets)).astype(np.int64), [w, c.astype(np.int32)])], 0)

        for _, buf, offs in slices(batches):
            held.append(token_stream(buf, offs)[0])
            if sum(map(len, held)) > HELD:
                yield flush()
        if held:
            yield flush()

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, list] = {}
        for b in batches:
            for bucket, blob in zip(b.column("bucket").to_pylist(), b.column("data").to_pylist(), strict=True):
                found.setdefault(bucket, []).append(unpack(blob, ["<u8", "<i4"])[:2])
        for bucket, xs in found.items():
            w, c = tally(np.concatenate([x[0] for x in xs]), np.concatenate([x[1] for x in xs]))
            hist = np.bincount(np.log2(c).astype(np.int64), minlength=64)
            yield pa.RecordBatch.from_arrays([pa.array([bucket], pa.int32()), pa.array([len(w)], pa.int64()), pa.array([int(c.sum())], pa.int64()), pa.array([hist.tolist()], pa.list_(pa.int64())), pa.array([pack([w, c, np.zeros(0, np.uint8)])], pa.binary())], ["bucket", "n_types", "n_tokens", "hist", "data"])

    sent = train.mapInArrow(send, BLOBS).repartition(parts(train.sparkSession), "bucket")
    return sent.mapInArrow(add, "bucket int, n_types long, n_tokens long, hist array<long>, data binary")


class Parent:
    """The restaurant of single words. Holds the frequent words' seating, and of all others' the sums.

    ``types`` words occur in training; each has its share of the base, and so have all words that don't, together.
    """

    def __init__(self, words_: np.ndarray, counts: np.ndarray, n_docs: int, tokens: int, types: int):
        order = np.argsort(words_)
        self.words, self.counts = words_[order], counts[order]
        self.tokens, self.types, self.n_docs = tokens, types, n_docs
        self.base = 1 / (types + 1)
        #: tables of the contexts that are seated in parts: of each frequent word, and of the start of a text
        self.tables = np.zeros(len(words_) + 1)
        self.seat(self.counts, tokens - int(counts.sum()), types - len(words_))

    def seat(self, customers: np.ndarray, rare_customers: float, rare_tables: float) -> None:
        """Sample the frequent words' tables; ``p`` becomes their averaged probabilities, ``open`` that of a word never seen."""
        c = customers.astype(np.int64)
        rng = np.random.Generator(np.random.Philox(17))
        self.norm = PARENT_STRENGTH + c.sum() + rare_customers
        p, opened, t = np.zeros(len(c)), 0.0, np.minimum(c, 1)
        for sweep in range(BURN_IN + SAMPLES):
            total = np.array([t.sum() + rare_tables])
            t = sweep_tables(c, t, np.zeros(len(c), np.int64), total, np.full(len(c), self.base), PARENT_DISCOUNT, PARENT_STRENGTH, rng)
            if sweep >= BURN_IN:
                free = (PARENT_STRENGTH + PARENT_DISCOUNT * (t.sum() + rare_tables)) / self.norm * self.base
                p += (c - PARENT_DISCOUNT * t) / self.norm + free
                opened += free
        self.p, self.open, self.total = p / SAMPLES, opened / SAMPLES, float(t.sum() + rare_tables)

    def rare(self, customers: np.ndarray, tables: np.ndarray) -> np.ndarray:
        """Probability of words that are not frequent, from their own seating; none is no seating."""
        return (customers - PARENT_DISCOUNT * tables) / self.norm + self.open

    def seat_rare(self, customers: np.ndarray, seed: int) -> np.ndarray:
        """Averaged tables of words that are not frequent, given all others'."""
        rng = np.random.Generator(np.random.Philox(seed))
        c, t, out = customers.astype(np.int64), np.minimum(customers, 1).astype(np.int64), np.zeros(len(customers))
        for sweep in range(BURN_IN + SAMPLES):
            t = sweep_tables(c, t, np.zeros(len(c), np.int64), np.array([self.total]), np.full(len(c), self.base), PARENT_DISCOUNT, PARENT_STRENGTH, rng)
            out += t if sweep >= BURN_IN else 0
        return (out / SAMPLES).astype(np.float32)

    def places(self, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Place of each word among the frequent ones, and whether it is one."""
        at = np.minimum(np.searchsorted(self.words, w), max(0, len(self.words) - 1))
        return at, self.words[at] == w if len(self.words) else np.zeros(len(w), bool)

    def contexts(self, u: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Place, training tokens (0 of those not frequent) and parts of each context."""
        at, own = self.places(u)
        c = np.where(own, self.counts[at] if len(self.words) else 0, 0)
        at, c = np.where(u == START, len(self.words), at), np.where(u == START, self.n_docs, c)
        return at, c, np.maximum(1, -(-c // HOT))

    def keys(self, u: np.ndarray, w: np.ndarray) -> np.ndarray:
        """Restaurant of each pair: its context, or the part of it that the word is dealt to."""
        _, _, n = self.contexts(u)
        return np.where(n > 1, mix(u + (mix(w) % n.astype(np.uint64) + np.uint64(1)) * _DEAL), u)


_STIRLING: dict[float, np.ndarray] = {}


def stirling(d: float) -> np.ndarray:
    """log of the generalised Stirling numbers of c customers at t tables, up to EXACT."""
    if d not in _STIRLING:
        s = np.full((EXACT + 1, EXACT + 1), -np.inf)
        s[0, 0] = 0
        for c in range(1, EXACT + 1):
            for t in range(1, c + 1):
                more = s[c - 1, t] + np.log(c - 1 - d * t) if c - 1 > d * t and np.isfinite(s[c - 1, t]) else -np.inf
                s[c, t] = np.logaddexp(s[c - 1, t - 1], more)
        _STIRLING[d] = s
    return _STIRLING[d]


def sweep_tables(c: np.ndarray, t: np.ndarray, group: np.ndarray, total: np.ndarray, p0: np.ndarray, d: float, theta: float, rng: np.random.Generator) -> np.ndarray:
    """New numbers of tables of all dishes (c customers, t tables, restaurant ``group``), given the restaurants' totals."""
    out = np.minimum(c, 1)
    rest = total[group] - t
    log_s = stirling(d)
    for n in range(2, EXACT + 1):
        own = np.flatnonzero(c == n)
        for i in range(0, len(own), 100_000):
            few = own[i : i + 100_000]
            seats = np.cumsum(np.log(theta + d * (rest[few, None] + np.arange(n))) + np.log(p0[few, None]), 1) + log_s[n, 1 : n + 1]
            out[few] = 1 + np.argmax(seats + rng.gumbel(size=seats.shape), 1)
    own = np.flatnonzero(c > EXACT)
    if len(own):
        # all customers leave and come again; from EXACT on in batches of a sixteenth of those seated
        here, tables = np.ones(len(own)), np.ones(len(own))
        while len(left := np.flatnonzero(here < c[own])):
            k = own[left]
            new = (theta + d * (rest[k] + tables[left])) * p0[k]
            chance = new / (here[left] - d * tables[left] + new)
            batch = np.minimum(np.maximum(1, np.where(here[left] > EXACT, here[left] // 16, 1)), c[k] - here[left])
            tables[left] += rng.binomial(batch.astype(np.int64), np.clip(chance, 0, 1))
            here[left] += batch
        out[own] = tables.astype(np.int64)
    return out


class Restaurants:
    """The restaurants of a bucket: types (restaurant, word) with their customers, sorted by restaurant.

    ``customers`` and ``tables`` are those of the whole context where it is seated in parts (tables 0: not known yet), else
    0. ``extra`` are the tables, of one customer each, of further types that each restaurant has, restaurant by restaurant.
    """

    def __init__(self, key: np.ndarray, count: np.ndarray, p0: np.ndarray, customers: np.ndarray, tables: np.ndarray, seed: int, extra: np.ndarray | None = None):
        head = np.ones(len(key), bool)
        head[1:] = key[1:] != key[:-1]
        self.group, self.first = np.cumsum(head) - 1, np.flatnonzero(head)
        self.n = len(self.first)
        self.c, self.p0 = count, p0
        self.extra = np.zeros(self.n) if extra is None else extra
        own = np.bincount(self.group, count, self.n) + self.extra
        whole = customers[self.first]
        self.customers = np.where(whole > 0, whole, own)
        self.known, self.share = tables[self.first], np.where(whole > 0, whole / np.maximum(own, 1), 1.0)
        self.rng = np.random.Generator(np.random.Philox(seed))
        self.t = np.minimum(count, 1)

    def totals(self) -> np.ndarray:
        return np.where(self.known > 0, self.known, (np.bincount(self.group, self.t, self.n) + self.extra) * self.share)

    def sweep(self) -> None:
        self.t = sweep_tables(self.c, self.t, self.group, np.maximum(self.totals(), np.bincount(self.group, self.t, self.n)), self.p0, DISCOUNT, STRENGTH, self.rng)

    def predictive(self) -> np.ndarray:
        """Averaged probability of every type in its restaurant."""
        p = np.zeros(len(self.c))
        for i in range(BURN_IN + SAMPLES):
            self.sweep()
            if i >= BURN_IN:
                norm = STRENGTH + self.customers
                p += np.maximum(self.c - DISCOUNT * self.t, 0) / norm[self.group] + ((STRENGTH + DISCOUNT * self.totals()) / norm)[self.group] * self.p0
        return p / SAMPLES


#: Pairs of a frequent word, sorted by restaurant (differences), their context where it is seated in parts, and the word's place.
PAIR = ["<u8", "<u8", "<i4"]
#: Pairs of another word: context, word, and the customers and tables of the word in the parent.
RARE = ["<u8", "<u8", "<i4", "<f4"]


def _pair_blobs(parent: Parent, buckets: int, u, place, extra: list[np.ndarray]) -> list[tuple[int, bytes]]:
    """Pairs of frequent words by bucket of their restaurant."""
    return _keyed_blobs(parent.keys(u, parent.words[place]), u, buckets, [place.astype(np.int32), *extra])


def _keyed_blobs(key, u, buckets: int, cols: list[np.ndarray], partitions: int = 0) -> list[tuple[int, bytes]]:
    """Records by bucket of their restaurant (or the partition that gets it), sorted by it, so that equal contexts are zero differences."""
    bucket = (key % np.uint64(buckets)).astype(np.int64)
    bucket = bucket % partitions if partitions else bucket
    order = np.lexsort((cols[0], key, bucket))
    bucket, key, u, *cols = (x[order] for x in (bucket, key, u, *cols))
    out: list[tuple[int, bytes]] = []
    if not len(order):
        return out
    cuts = np.flatnonzero(np.diff(bucket, prepend=-1))
    for i, j in zip(cuts.tolist(), [*cuts[1:].tolist(), len(order)], strict=True):
        k = key[i:j]
        out.append((int(bucket[i]), pack([np.diff(k, prepend=np.uint64(0)), np.where(u[i:j] == k, np.uint64(0), u[i:j]), *(c[i:j] for c in cols), np.zeros(0, np.uint8)])))
    return out


def _joined(blobs: list[bytes], kinds: list[str]) -> list[np.ndarray]:
    """The arrays of blobs, one after the other; none of no blobs."""
    if not blobs:
        return [np.zeros(0, np.dtype(k)) for k in kinds]
    return [np.concatenate(c) for c in list(zip(*(unpack(b, kinds) for b in blobs), strict=True))[: len(kinds)]]


def _pairs(parent: Parent, frequent: list[bytes], rare: list[bytes], more: list[str], rare_more: list[str]) -> tuple[np.ndarray, ...]:
    """key, context, word, parent's probability, and the further columns of all pairs of a bucket."""
    xs = [unpack(b, PAIR + more)[:-1] for b in frequent]
    for x in xs:
        x[0] = np.cumsum(x[0], dtype=np.uint64)
    key, u, place, *own = [np.concatenate(c) for c in zip(*xs, strict=True)] if xs else [np.zeros(0, np.dtype(k)) for k in PAIR + more]
    ru, rw, c, t, *other = _joined(rare, RARE + rare_more)
    u = np.concatenate([np.where(u == 0, key, u), ru])
    w = np.concatenate([parent.words[place] if len(place) else np.zeros(0, np.uint64), rw])
    p0 = np.concatenate([parent.p[place] if len(place) else np.zeros(0), parent.rare(c.astype(float), t.astype(float))])
    return np.concatenate([key, parent.keys(ru, rw)]), u, w, p0, *(np.concatenate(x) for x in zip(own, other, strict=True))


def _types(key, w, count) -> tuple[np.ndarray, ...]:
    """Each (restaurant, word) once with its customers, and which one each row is."""
    order = np.lexsort((w, key))
    head = np.ones(len(order), bool)
    head[1:] = (key[order[1:]] != key[order[:-1]]) | (w[order[1:]] != w[order[:-1]])
    which = np.empty(len(order), np.int64)
    which[order] = np.cumsum(head) - 1
    first = order[head]
    return first, which, np.bincount(which, count, len(first)).astype(np.int64)


def _seated(parent: Parent, key, u, p0, count, seed: int, extra: np.ndarray | None = None) -> tuple[Restaurants, np.ndarray, np.ndarray]:
    """Restaurants of types, the place of each type's context, and whether that is seated in parts."""
    at, c, n = parent.contexts(u)
    split = n > 1
    return Restaurants(key, count, p0, np.where(split, c, 0), np.where(split, parent.tables[at], 0), seed, extra), at, split


def learn(rows: DataFrame) -> tuple[Parent, DataFrame, int]:
    """The parent with its tables sampled, the pairs of words that are not frequent with these words' seating, and the number of buckets.

    ``rows`` are id, text, held_out; those held out are not learnt from, but their pairs are among the others'.
    """
    buckets = 4 * parts(rows.sparkSession)
    train = rows.where("not held_out").select("id", "text")
    counts = materialise(word_counts(train, buckets), "words")
    sums = counts.select("bucket", "n_types", "n_tokens", "hist").collect()  # a row for each bucket
    types, tokens = sum(r.n_types for r in sums), sum(r.n_tokens for r in sums)
    above = np.cumsum(np.sum([r.hist for r in sums], 0)[::-1])[::-1] if sums else np.zeros(64)
    least = 1 << int(np.argmax(above <= FREQUENT))

    def often(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for bucket, blob in zip(b.column("bucket").to_pylist(), b.column("data").to_pylist(), strict=True):
                w, c = unpack(blob, ["<u8", "<i8"])[:2]
                keep = c >= least
                yield pa.RecordBatch.from_arrays([pa.array([bucket], pa.int32()), pa.array([w[keep].tobytes()], pa.binary()), pa.array([c[keep].tobytes()], pa.binary())], ["bucket", "w", "c"])

    found = counts.select("bucket", "data").mapInArrow(often, "bucket int, w binary, c binary").collect()  # FREQUENT words at most
    w, c = (np.concatenate([np.frombuffer(r[k], kind) for r in found]) if found else np.zeros(0, kind) for k, kind in (("w", np.uint64), ("c", np.int64)))
    ends = c[w == END]
    parent = Parent(w, c, int(ends[0]) if len(ends) else train.count(), tokens, types)
    rare = materialise(rare_pairs(rows, parent, counts, buckets), "rare")
    seen = rare.where("kind = 4").select("data").collect()  # two numbers for each bucket
    rare_sums = np.sum([np.frombuffer(r.data, np.float64) for r in seen], 0) if seen else np.zeros(2)
    tables = child_tables(train, parent, rare, buckets)
    parent.tables = tables[len(parent.words) :].astype(float)
    parent.seat(tables[: len(parent.words)], *rare_sums)
    return parent, rare, buckets


def rare_pairs(rows: DataFrame, parent: Parent, counts: DataFrame, buckets: int) -> DataFrame:
    """Blobs of the pairs whose word is not frequent, by bucket of their restaurant (kind 0, with the word's seating), of how many such words each restaurant has (6), of what each text's such words add to its sums (2), and of the sums of all seatings (4)."""
    shared = rows.sparkSession.sparkContext.broadcast(parent)
    unit, n_parts = np.log10(parent.tokens + parent.types + 1), parts(rows.sparkSession)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parent, held = shared.value, []

        def flush() -> pa.RecordBatch:
            w, u, row, train = (np.concatenate(x) for x in zip(*held, strict=True))
            held.clear()
            order = np.lexsort((row, u, w))
            head = np.ones(len(order), bool)
            a, b = order[1:], order[:-1]
            head[1:] = (w[a] != w[b]) | (u[a] != u[b]) | (row[a] != row[b])
            first = order[head]
            times = np.diff(np.append(np.flatnonzero(head), len(order)))
            return blob_rows([*by_bucket((w[first] % np.uint64(buckets)).astype(np.int64), [w[first], u[first], row[first], (2 * times + train[first]).astype(np.int32)])], 0)

        for b, buf, offs in slices(batches):
            w, u, d = token_stream(buf, offs)
            _, own = parent.places(w)
            few = np.flatnonzero(~own)
            held.append((w[few], u[few], b.column("id").to_numpy()[d[few]], ~b.column("held_out").to_numpy(zero_copy_only=False)[d[few]]))
            if sum(len(x[0]) for x in held) > HELD:
                yield flush()
        if held:
            yield flush()

    def looked_up(bucket: int, blobs: list[bytes], words_: bytes | None) -> tuple[list[np.ndarray], ...]:
        """Sums by text, types by restaurant, pairs with their words' seating, and sums of the seating, of a bucket of words."""
        parent = shared.value
        w, u, row, times = _joined(blobs, ["<u8", "<u8", "<i8", "<i4"])
        train, times = times & 1, times >> 1
        have, c = unpack(words_, ["<u8", "<i8"])[:2] if words_ else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
        at = np.minimum(np.searchsorted(have, w), max(0, len(have) - 1))
        n = np.where(have[at] == w, c[at], 0) if len(have) else np.zeros(len(w), np.int64)
        sums = _by_row(row, [np.zeros(len(w)), times * (n > 0), times * (np.log10(n + 1) - unit), np.zeros(len(w))])
        # customers in the parent: a word's training contexts
        order = np.lexsort((u, ~train.astype(bool), w))
        head = np.ones(len(order), bool)
        head[1:] = w[order[1:]] != w[order[:-1]]
        fresh = head.copy()
        fresh[1:] |= u[order[1:]] != u[order[:-1]]
        group = np.cumsum(head) - 1
        customers = np.bincount(group, fresh & (train[order] == 1))
        tables = parent.seat_rare(customers, bucket)
        c_, t_ = np.empty(len(w), np.int32), np.empty(len(w), np.float32)
        c_[order], t_[order] = customers[group], tables[group]
        key = parent.keys(u, w)
        types = order[fresh & (train[order] == 1)]
        one, at, n = np.unique(key[types], return_index=True, return_counts=True)
        return sums, [one, u[types[at]], n.astype(np.int32)], [key, u, w, c_, t_, row, (2 * times + train).astype(np.int32)], [np.array([customers.sum(), tables.sum()], np.float64)]

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked: dict[int, list[bytes]] = {}
        table: dict[int, bytes] = {}
        for b in batches:
            for bucket, kind, blob in zip(*(b.column(c).to_pylist() for c in ("bucket", "kind", "data")), strict=True):
                if kind == 3:
                    table[bucket] = blob
                else:
                    asked.setdefault(bucket, []).append(blob)
        found = [looked_up(bucket, asked.pop(bucket), table.pop(bucket, None)) for bucket in [*asked]]
        if not found:
            return
        # one row for each bucket or partition and kind: rows grow with the partitions, not with the buckets of both sides
        sums, types, pairs, seats = ([np.concatenate(x) for x in zip(*kind, strict=True)] for kind in zip(*found, strict=True))
        del found
        turn = TaskContext.get().partitionId() % n_parts
        row, *cols = _by_row(sums[0], sums[1:])
        yield blob_rows([(turn, pack([row, *(x.astype(np.int32) for x in cols[:2]), *cols[2:], np.zeros(0, np.uint8)]))], 2)
        if len(types[0]):
            yield blob_rows(_keyed_blobs(types[0], types[1], buckets, types[2:], n_parts), 6)
        key, *cols = pairs
        order = np.lexsort((cols[1], key))
        yield blob_rows([*by_bucket((key[order] % np.uint64(buckets)).astype(np.int64), [x[order] for x in cols])], 0)
        yield blob_rows([(turn, seats[0].reshape(-1, 2).sum(0).tobytes())], 4)

    table = counts.select("bucket", F.lit(3).alias("kind"), "data")
    sent = rows.select("id", "text", "held_out").mapInArrow(send, BLOBS).unionByName(table)
    return sent.repartition(parts(rows.sparkSession), "bucket").mapInArrow(look_up, BLOBS)


def child_tables(train: DataFrame, parent: Parent, rare: DataFrame, buckets: int) -> np.ndarray:
    """Tables of each frequent word in all restaurants, the parent's customers; then of each context that is seated in parts. Summed by blocks."""
    shared = train.sparkSession.sparkContext.broadcast(parent)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parent, held = shared.value, []

        def flush() -> pa.RecordBatch:
            u, place = (np.concatenate(x) for x in zip(*held, strict=True))
            held.clear()
            first, _, n = _types(u, place, None)
            return blob_rows(_pair_blobs(parent, buckets, u[first], place[first], [n.astype(np.int32)]), 1)

        for _, buf, offs in slices(batches):
            w, u, _ = token_stream(buf, offs)
            place, own = parent.places(w)
            held.append((u[own], place[own]))
            if sum(len(x[0]) for x in held) > HELD:
                yield flush()
        if held:
            yield flush()

    def seat(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parent = shared.value
        frequent, others = _by_kind(batches)
        total = np.zeros(2 * len(parent.words) + 1, np.int64)
        more = [unpack(x, ["<u8", "<u8", "<i4"])[:3] for blobs in others.values() for x in blobs]
        # the other words' tables, one for each, of all restaurants of this partition
        keys = np.concatenate([np.zeros(0, np.uint64), *(np.cumsum(x[0], dtype=np.uint64) for x in more)])
        context, times = (np.concatenate([np.zeros(0, kind), *(x[i] for x in more)]) for i, kind in ((1, np.uint64), (2, np.int32)))
        at, _, in_parts = parent.contexts(context)
        whole = (context != 0) & (in_parts > 1)
        total[len(parent.words) :] += np.bincount(at[whole], times[whole], len(parent.words) + 1).astype(np.int64)
        keys, which = np.unique(keys, return_inverse=True)
        times = np.bincount(which, times, len(keys))
        for bucket in frequent:
            key, u, w, p0, count = _pairs(parent, frequent.get(bucket, []), [], ["<i4"], ["<i4"])
            first, _, c = _types(key, w, count)
            own = np.unique(key)
            place = np.minimum(np.searchsorted(keys, own), max(0, len(keys) - 1))
            extra = np.where(keys[place] == own, times[place], 0.0) if len(keys) else np.zeros(len(own))
            r, at, split = _seated(parent, key[first], u[first], p0[first], c, bucket, extra)
            for _ in range(BURN_IN + 1):
                r.sweep()
            place, own = parent.places(w[first])
            total[: len(parent.words)] += np.bincount(place[own], r.t[own], len(parent.words)).astype(np.int64)
            total[len(parent.words) :] += np.bincount(at[split], r.t[split], len(parent.words) + 1).astype(np.int64)
        blocks = [(i // BLOCK, total[i : i + BLOCK].tobytes()) for i in range(0, len(total), BLOCK) if total[i : i + BLOCK].any()]
        if blocks:
            yield blob_rows(blocks, 5)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for k, x in zip(b.column("bucket").to_pylist(), b.column("data").to_pylist(), strict=True):
                sums[k] = sums.get(k, 0) + np.frombuffer(x, np.int64)
        yield blob_rows([(k, x.tobytes()) for k, x in sums.items()], 5)

    n = parts(train.sparkSession)
    # the others' counts go as kind 0, which here stands beside the frequent words' pairs
    more = rare.where("kind = 6").select("bucket", F.lit(0).alias("kind"), "data")
    sent = train.mapInArrow(send, BLOBS).unionByName(more).repartitionById(n, F.col("bucket") % n)
    out = np.zeros(2 * len(parent.words) + 1, np.int64)
    for r in sent.mapInArrow(seat, BLOBS).repartition(min(n, 64), "bucket").mapInArrow(add, BLOBS).select("bucket", "data").collect():  # 2 FREQUENT numbers
        x = np.frombuffer(r.data, np.int64)
        out[r.bucket * BLOCK : r.bucket * BLOCK + len(x)] = x
    return out


def _by_kind(batches: Iterator[pa.RecordBatch], sums: list | None = None) -> tuple[dict[int, list[bytes]], dict[int, list[bytes]]]:
    """Blobs of frequent (kind 1) and other pairs (0) by bucket; sums (2) go to ``sums``."""
    frequent: dict[int, list[bytes]] = {}
    others: dict[int, list[bytes]] = {}
    for b in batches:
        for bucket, kind, blob in zip(*(b.column(c).to_pylist() for c in ("bucket", "kind", "data")), strict=True):
            if kind == 2:
                sums.append(unpack(blob, SUMS)[:5])
            else:
                (frequent if kind else others).setdefault(bucket, []).append(blob)
    return frequent, others


#: id, tokens, known tokens, base score and score of a text, or what is known of them in one place.
SUMS = ["<i8", "<i4", "<i4", "<f8", "<f8"]


def _identified(docs: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """id, text, held_out, and the table (id, doc_id) where ids are not the doc_ids: where these repeat or are null, rows are written with numbers of their own."""
    held = F.coalesce(held_out(2, 7), F.lit(False)).alias("held_out")
    repeated = docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1 or doc_id is null")
    if repeated.isEmpty():
        return docs.select(F.col("doc_id").alias("id"), "text", held), None
    rows = materialise(docs.select(F.monotonically_increasing_id().alias("id"), "doc_id", "text", held), "rows")
    return rows.select("id", "text", "held_out"), rows.select("id", "doc_id", "held_out")


def scores(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every text of ``docs``.

    Learns from the documents that are not held out (those without doc_id are not). Null and empty texts are the end
    token alone. Every row has a result, whether or not its doc_id repeats or is null. With nothing to learn from, all
    words are equally likely. Perplexity is 10 ** (-score / n_tokens).
    """
    spark = docs.sparkSession
    rows, names = _identified(docs)
    parent, rare, buckets = learn(rows)
    shared = spark.sparkContext.broadcast(parent)
    unit = np.log10(parent.tokens + parent.types + 1)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parent, held = shared.value, []

        def flush() -> Iterator[pa.RecordBatch]:
            u, row, train, place, own = (np.concatenate(x) for x in zip(*held, strict=True))
            held.clear()
            # texts: what is known here
            ids, which = np.unique(row, return_inverse=True)
            count = np.where(own, parent.counts[place], 0) if len(parent.words) else np.zeros(len(u))
            base = np.bincount(which, np.where(own, np.log10(count + 1) - unit, 0))
            yield blob_rows([*by_bucket(ids % buckets, [ids, np.bincount(which).astype(np.int32), np.bincount(which, own).astype(np.int32), base, np.zeros(len(ids))])], 2)
            # pairs of frequent words go to their restaurant
            some = np.flatnonzero(own)
            order = some[np.lexsort((row[some], place[some], u[some]))]
            head = np.ones(len(order), bool)
            a, b = order[1:], order[:-1]
            head[1:] = (u[a] != u[b]) | (place[a] != place[b]) | (row[a] != row[b])
            first = order[head]
            times = np.diff(np.append(np.flatnonzero(head), len(order)))
            yield blob_rows(_pair_blobs(parent, buckets, u[first], place[first], [row[first], (2 * times + train[first]).astype(np.int32)]), 1)

        for b, buf, offs in slices(batches):
            w, u, d = token_stream(buf, offs)
            ids, train = b.column("id").to_numpy(), ~b.column("held_out").to_numpy(zero_copy_only=False)
            held.append((u, ids[d], train[d], *parent.places(w)))
            if sum(len(x[0]) for x in held) > HELD:
                yield from flush()
        if held:
            yield from flush()

    def scored(bucket: int, frequent: list[bytes], others: list[bytes]) -> list[np.ndarray]:
        """What a bucket's pairs add to their texts' scores; its arrays go before the next bucket's come."""
        key, u, w, p0, row, times = _pairs(shared.value, frequent, others, ["<i8", "<i4"], ["<i8", "<i4"])
        first, which, c = _types(key, w, (times >> 1) * (times & 1))
        r, _, _ = _seated(shared.value, key[first], u[first], p0[first], c, bucket)
        none = np.zeros(len(row))
        return _by_row(row, [none, none, none, (times >> 1) * np.log10(r.predictive())[which]])

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: list[list[np.ndarray]] = []
        frequent, others = _by_kind(batches, sums)
        for bucket in {*frequent, *others}:
            sums.append(scored(bucket, frequent.pop(bucket, []), others.pop(bucket, [])))
        if sums:
            row, *cols = (np.concatenate(x) for x in zip(*sums, strict=True))
            row, *cols = _by_row(row, cols)
            yield blob_rows([*by_bucket(row % buckets, [row, cols[0].astype(np.int32), cols[1].astype(np.int32), cols[2].astype(float), cols[3].astype(float)])], 2)

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = [unpack(x, SUMS)[:5] for b in batches for x in b.column("data").to_pylist()]
        if sums:
            row, *cols = (np.concatenate(x) for x in zip(*sums, strict=True))
            row, tokens, known, base, score = _by_row(row, cols)
            yield pa.RecordBatch.from_arrays([pa.array(row), pa.array(tokens.astype(np.int64)), pa.array(known.astype(np.int64)), pa.array(base), pa.array(score)], ["id", "n_tokens", "n_known", "base_score", "score"])

    n = parts(spark)
    sent = rows.mapInArrow(send, BLOBS).unionByName(rare.where("kind in (0, 2)"))
    out = sent.repartition(n, "bucket").mapInArrow(answer, BLOBS).repartition(n, "bucket").mapInArrow(total, "id long, n_tokens long, n_known long, base_score double, score double")
    out = out.join(names, "id") if names is not None else out.withColumnRenamed("id", "doc_id").withColumn("held_out", held_out(2, 7))
    return out.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(parent.tokens).cast("long").alias("train_tokens"), "base_score", "score")


def _by_row(row: np.ndarray, cols: list[np.ndarray]) -> list[np.ndarray]:
    ids, which = np.unique(row, return_inverse=True)
    return [ids, *(np.bincount(which, c, len(ids)) for c in cols)]
