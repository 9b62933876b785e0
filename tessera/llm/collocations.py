"""Collocations: phrases whose parts keep company, found by mergeable Misra-Gries summaries and counted exactly after.

First pass: every task counts the n-grams of its texts; their 48-bit fingerprints travel to hash partitions (ranges of
the fingerprint). A partition knows its mass, the number of n-gram occurrences that fall into it, before the first
counter comes, and merges the tasks' summaries into one of ROOM times mass / threshold counters: what is taken off a
counter is under threshold / ROOM then, so that every n-gram of that frequency survives. Second pass: exact counts of the
n-grams that survived, by their words. Equal fingerprints only let an n-gram more through to the exact count.

Survivors go to the second pass as a bitmap of at most 2 ** FILTER_BITS bits, whatever the corpus. A fuller bitmap
keeps fewer infrequent n-grams out of the second shuffle; the counts stay exact.
"""

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.textcore import LOWER, STEP, mix
from tessera.llm.workspace import materialise, parts

UNKNOWN = "und"
#: Bytes of text that are counted at a time; counters of a task that are kept, those that wait to be merged with them, and rows.
SLICE_BYTES, HELD, WAITING, ROWS = 2 << 20, 2_000_000, 1_500_000, 500_000
#: Counters of a summary for each that the guarantee needs: the fewer are taken off, the fewer infrequent n-grams survive.
ROOM = 4
FINGERPRINT_BITS, FILTER_BITS, MOST_BUCKET_BITS = 48, 28, 20
COUNT_BITS, MOST_COUNT = 16, 65535
#: Copies of a single word's count, and of a longer part's, that a join deals the phrases of a common part over.
WORD_SALTS, PART_SALTS, TOP_SALTS = 8, 2, 8
#: A-Z folded; bytes that end a piece (a line break here), and the tab as a space.
_FOLD = LOWER.copy()
_FOLD[[ord(c) for c in ".,;:!?"]] = _FOLD[10:14] = 10
_FOLD[9] = 32
_FOLD = _FOLD.tobytes()


class Grams:
    """Distinct n-grams of one length: where each begins (an index of the next shorter), its last word, count and hash."""

    def __init__(self, prefix: np.ndarray, word: np.ndarray, count: np.ndarray, hashed: np.ndarray):
        self.prefix, self.word, self.count, self.hash = prefix, word, count, hashed


def grams(langs: list, texts: list, longest: int, keep=None) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[Grams]]:
    """Languages, words in all of each language, distinct words, and the distinct n-grams of 1 to ``longest`` words within pieces.

    The prefix of a single word is its language. With ``keep``, a predicate of hashes, n-grams it refuses are left out
    and not made longer.
    """
    code, names = pd.factorize(pd.Series([x or UNKNOWN for x in langs], dtype=object))
    raw = [t.encode() if t else b"" for t in texts]
    data = b"\n".join(raw).translate(_FOLD)
    buf = np.frombuffer(data, np.uint8)
    solid = (buf != 10) & (buf != 32)
    first = np.flatnonzero(solid & np.append(True, ~solid[:-1])) if len(buf) else np.zeros(0, np.int64)
    piece = np.cumsum(buf == 10, dtype=np.int32)[first]
    at = np.cumsum([0, *[len(r) + 1 for r in raw]])
    lang = code[np.searchsorted(at, first, "right") - 1]
    words = np.empty(len(first), object)
    words[:] = data.split()
    ids, known = pd.factorize(words)
    del words, raw, buf, solid, data
    word_hash = np.array([xxhash.xxh3_64_intdigest(w) for w in known], np.uint64)
    lang_hash = np.array([xxhash.xxh3_64_intdigest(x.encode(), 1) for x in names], np.uint64)
    pos, before, before_hash, found = np.arange(len(ids)), lang.astype(np.int64), lang_hash, []
    for n in range(1, longest + 1):
        last = pos + n - 1
        inside = last < len(ids)
        inside[inside] = piece[pos[inside]] == piece[last[inside]]
        pos, before = pos[inside], before[inside]
        own, distinct = pd.factorize(before * max(len(known), 1) + ids[pos + n - 1])
        prefix, word = np.divmod(np.asarray(distinct, np.int64), max(len(known), 1))
        with np.errstate(over="ignore"):
            hashed = mix(before_hash[prefix] * STEP + word_hash[word]) if len(prefix) else np.zeros(0, np.uint64)
        count = np.bincount(own, minlength=len(prefix))
        if keep is not None:
            kept = keep(hashed)
            new = np.cumsum(kept) - 1
            here = kept[own]
            pos, own = pos[here], new[own[here]]
            prefix, word, count, hashed = prefix[kept], word[kept], count[kept], hashed[kept]
        found.append(Grams(prefix, word, count, hashed))
        before, before_hash = own.astype(np.int64), hashed
    return np.asarray(names, object), np.bincount(lang, minlength=len(names)), known, found


def _portions(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list]]:
    """Languages and texts of so many bytes at a time, one document at least."""
    langs, texts, size = [], [], 0
    for batch in (b.slice(i, 256) for b in batches for i in range(0, b.num_rows, 256)):
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
            langs.append(lang)
            texts.append(text)
            size += len(text or "")
            if size >= SLICE_BYTES:
                yield langs, texts
                langs, texts, size = [], [], 0
    if langs:
        yield langs, texts


def summed(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order and the sum of each one's counts."""
    key, count = np.concatenate(keys), np.concatenate(counts)
    if not len(key):
        return key, count
    order = np.argsort(key)
    key, count = key[order], count[order]
    first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    return key[first], np.add.reduceat(count, first)


class Summary:
    """A Misra-Gries summary of at most ``capacity`` counters, merged from others; ``less`` is what any counter may lack.

    A merge sums counters and takes the (capacity + 1)-th largest off all, which takes at least capacity + 1 times as
    much mass away: in all, less <= mass / (capacity + 1).
    """

    def __init__(self, capacity: int):
        self.capacity, self.less = capacity, 0
        self.keys, self.counts = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]

    def merge(self, keys: np.ndarray, counts: np.ndarray) -> None:
        self.keys.append(keys)
        self.counts.append(counts)
        if sum(map(len, self.keys[1:])) > max(self.capacity, 1 << 18):
            self.settle()

    def settle(self) -> None:
        key, count = summed(self.keys, self.counts)
        if len(key) > self.capacity:
            off = int(np.partition(count, len(count) - self.capacity - 1)[len(count) - self.capacity - 1])
            self.less += off
            left = count > off
            key, count = key[left], count[left] - off
        self.keys, self.counts = [key], [count]

    def frequent(self, threshold: int) -> np.ndarray:
        """Every key that came ``threshold`` times or more, if the capacity is more than mass / threshold; others may be among them."""
        self.settle()
        return self.keys[0][self.counts[0] + self.less >= threshold]


def merged(parts_: list[np.ndarray]) -> np.ndarray:
    """Counters (fingerprint, then 16 bits of count) in order, equal fingerprints as one. Counts end at 65535, far above any threshold."""
    x = np.concatenate(parts_)
    x.sort()
    key = x >> np.uint64(COUNT_BITS)
    first = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(x) else np.zeros(0, np.int64)
    count = np.minimum(np.add.reduceat(x & np.uint64(MOST_COUNT), first), np.uint64(MOST_COUNT)) if len(x) else x
    return key[first] << np.uint64(COUNT_BITS) | count


def _planes(values: np.ndarray) -> bytes:
    """Bytes of equal weight together: what compresses."""
    return np.ascontiguousarray(values.view(np.uint8).reshape(len(values), -1).T).tobytes()


def _pack(key: np.ndarray, count: np.ndarray) -> bytes:
    body = _planes(np.diff(key, prepend=np.uint64(0))) + _planes(count.astype(np.uint64))
    return zstandard.ZstdCompressor(1).compress(body)


def _unpack(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8)
    key, count = (np.ascontiguousarray(p.reshape(8, -1).T).view(np.uint64).ravel() for p in np.split(raw, 2))
    return np.cumsum(key), count.astype(np.int64)


def bucket_bits(spark: SparkSession) -> int:
    """Buckets are ranges of the hash, a power of two of them, and whole bytes of the bitmap."""
    return min(MOST_BUCKET_BITS, (4 * parts(spark) - 1).bit_length())


def survivors(docs: DataFrame, longest: int, threshold: int) -> np.ndarray:
    """The bitmap of fingerprints among which all n-grams of ``threshold`` occurrences are."""
    n, bits = parts(docs.sparkSession), bucket_bits(docs.sparkSession)
    shift, cells = np.uint64(FINGERPRINT_BITS - bits), FINGERPRINT_BITS - FILTER_BITS

    def summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush() -> pa.RecordBatch:
            key, count = held[0] >> np.uint64(COUNT_BITS), (held[0] & np.uint64(MOST_COUNT)).astype(np.int64)
            bucket = (key >> shift).astype(np.int64)
            cut = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])) if len(key) else np.zeros(0, np.int64)
            mass = np.add.reduceat(count, cut) if len(cut) else cut
            own = bucket[cut]
            blobs = [_pack(key[i:j], count[i:j]) for i, j in zip(cut.tolist(), [*cut[1:].tolist(), len(key)])]
            data = pa.array([None] * len(own) + blobs, pa.binary())
            return pa.RecordBatch.from_arrays([pa.array(np.tile(own, 2), pa.int32()), pa.array([*mass.tolist(), *[None] * len(own)], pa.int64()), data], ["bucket", "mass", "data"])

        held, waiting = [np.zeros(0, np.uint64)], 0
        for langs, texts in _portions(batches):
            for g in grams(langs, texts, longest)[3]:
                held.append(g.hash >> np.uint64(64 - FINGERPRINT_BITS) << np.uint64(COUNT_BITS) | np.minimum(g.count, MOST_COUNT).astype(np.uint64))
                waiting += len(g.count)
            if waiting > WAITING:
                held, waiting = [merged(held)], 0
                if len(held[0]) > HELD:
                    yield flush()
                    held = [np.zeros(0, np.uint64)]
        held = [merged(held)]
        if len(held[0]):
            yield flush()

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def close() -> pa.RecordBatch:
            cell = (summary.frequent(threshold) >> np.uint64(cells)).astype(np.int64) - (now << (FILTER_BITS - bits))
            own = np.zeros(1 << (FILTER_BITS - bits), np.uint8)
            own[cell] = 1
            return pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array([zstandard.ZstdCompressor(3).compress(np.packbits(own).tobytes())], pa.binary())], ["bucket", "data"])

        now, mass, summary = None, 0, None
        for b in batches:
            for bucket, own, blob in zip(b.column("bucket").to_pylist(), b.column("mass").to_pylist(), b.column("data")):
                if bucket != now:
                    if summary is not None:
                        yield close()
                    now, mass, summary = bucket, 0, None
                if own is not None:  # all of a bucket's masses come before its counters
                    mass += own
                else:
                    summary = summary or Summary(ROOM * (mass // threshold + 1))
                    summary.merge(*_unpack(blob.as_py()))
        if summary is not None:
            yield close()

    sent = docs.select("lang", "text").mapInArrow(summarise, "bucket int, mass long, data binary")
    dealt = sent.repartitionById(n, F.col("bucket") % n).sortWithinPartitions("bucket", F.col("data").isNotNull())
    bitmap = np.zeros((1 << FILTER_BITS) // 8, np.uint8)
    width = len(bitmap) >> bits
    for row in dealt.mapInArrow(merge, "bucket int, data binary").toLocalIterator():  # in all at most the bitmap
        bitmap[row.bucket * width : (row.bucket + 1) * width] = np.frombuffer(zstandard.ZstdDecompressor().decompress(bytes(row.data)), np.uint8)
    return bitmap


#: Parts of the phrases that begin with one word.
SPREAD = 8
COUNTED = pa.schema([("lang", pa.string()), ("k", pa.int32()), ("phrase", pa.string()), ("root", pa.uint64()), ("a", pa.int64())])
SENT = pa.schema([COUNTED.field(n) for n in ("lang", "k", "phrase", "a")])


def totals(tables: list[pa.Table]) -> pa.Table:
    """Equal phrases of a language as one row."""
    rest = [n for n in tables[0].schema.names if n not in ("lang", "k", "phrase")]
    found = pa.concat_tables(tables).group_by(["lang", "k", "phrase"]).aggregate([(n, "sum" if n == "a" else "min") for n in rest])
    return found.rename_columns(["lang", "k", "phrase", *rest])


def frequent_phrases(docs: DataFrame, longest: int, threshold: int) -> DataFrame:
    """lang, k (words), phrase, a: exact counts of all n-grams of ``threshold`` occurrences or more; k = 0 has the words in all of a language.

    A task's counts of the survivors travel as one compressed table for each bucket; a bucket adds them up by the words
    themselves.
    """
    if threshold > MOST_COUNT:
        raise ValueError("summaries count to 65535")
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(zstandard.ZstdCompressor(3).compress(survivors(docs, longest, threshold).tobytes()))
    n, bits = parts(spark), bucket_bits(spark)
    def packed(table: pa.Table) -> pa.RecordBatch:
        bucket = (table.column("root").to_numpy() >> np.uint64(64 - bits)).astype(np.int32)
        # phrases that begin alike stand together, which compresses them
        order = pc.sort_indices(table.select(["phrase"]).append_column("bucket", pa.array(bucket)), [("bucket", "ascending"), ("phrase", "ascending")])
        bucket = bucket[order.to_numpy()]
        cut = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1]))
        table, blobs = table.select(SENT.names).take(order).combine_chunks(), []
        for i, j in zip(cut.tolist(), [*cut[1:].tolist(), len(order)]):
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, SENT) as out:
                out.write_table(table.slice(i, j - i))
            blobs.append(zstandard.ZstdCompressor(3).compress(sink.getvalue()))
        return pa.RecordBatch.from_arrays([pa.array(bucket[cut], pa.int32()), pa.array(blobs, pa.binary())], ["bucket", "data"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap = np.frombuffer(zstandard.ZstdDecompressor().decompress(sent.value), np.uint8)

        def keep(hashed: np.ndarray) -> np.ndarray:
            cell = (hashed >> np.uint64(64 - FILTER_BITS)).astype(np.int64)
            return (bitmap[cell >> 3] >> (7 - (cell & 7)).astype(np.uint8) & 1).astype(bool)

        held, rows, settled = [], 0, 0
        for langs, texts in _portions(batches):
            names, total, known, found = grams(langs, texts, longest, keep)
            words, names = pa.array(known.tolist(), pa.binary()).cast(pa.string()), pa.array(names.tolist(), pa.string())
            own = np.array([xxhash.xxh3_64_intdigest(x.encode(), 2) for x in names.to_pylist()], np.uint64)
            held.append(pa.table([names, pa.array([0] * len(names), pa.int32()), pa.array([""] * len(names)), pa.array(own), pa.array(total, pa.int64())], schema=COUNTED))
            lang, phrase, root = None, None, None
            for k, g in enumerate(found, 1):
                root = g.hash if k == 1 else root[g.prefix]
                lang = names.take(pa.array(g.prefix)) if k == 1 else lang.take(pa.array(g.prefix))
                last = words.take(pa.array(g.word))
                phrase = last if k == 1 else pc.binary_join_element_wise(phrase.take(pa.array(g.prefix)), last, " ")
                part = mix(root + (g.hash & np.uint64(SPREAD - 1)) * STEP)  # a bucket has all of a part of a word's phrases
                held.append(pa.table([lang, pa.array(np.full(len(last), k, np.int32)), phrase, pa.array(part), pa.array(g.count, pa.int64())], schema=COUNTED))
                rows += len(last)
            if rows > settled + ROWS:
                held = [totals(held)]
                rows = settled = held[0].num_rows
                pa.default_memory_pool().release_unused()
                if rows > ROWS:
                    yield packed(held[0])
                    held, rows, settled = [], 0, 0
        if held:
            yield packed(totals(held))

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def close() -> Iterator[pa.RecordBatch]:
            own = totals(held)
            own = own.filter(pc.or_(pc.greater_equal(own.column("a"), threshold), pc.equal(own.column("k"), 0)))
            yield from own.select(["lang", "k", "phrase", "a"]).to_batches(50_000)

        now, held, rows = None, [], 0
        for b in batches:
            for bucket, blob in zip(b.column("bucket").to_pylist(), b.column("data")):
                if bucket != now:
                    if held:
                        yield from close()
                    now, held, rows = bucket, [], 0
                held.append(pa.ipc.open_stream(zstandard.ZstdDecompressor().decompress(blob.as_py())).read_all())
                rows += held[-1].num_rows
                if rows > 2 * held[0].num_rows + ROWS:
                    held = [totals(held)]
                    rows = held[0].num_rows
        if held:
            yield from close()

    blobs = docs.select("lang", "text").mapInArrow(count, "bucket int, data binary")
    return blobs.repartitionById(n, F.col("bucket") % n).sortWithinPartitions("bucket").mapInArrow(add, "lang string, k int, phrase string, a long")


def score(a: Column, left: Column, right: Column) -> Column:
    """floor(10**6 * a * a / (left * right)) of counts up to 10**13 and 10**16, exact though the products pass 64 bits."""
    wide = lambda c: c.cast("decimal(16,0)")
    above = (F.lit(1_000_000).cast("decimal(7,0)") * (wide(a) * wide(a)).cast("decimal(31,0)")).cast("decimal(38,0)")
    return F.call_function("div", above, (wide(left) * wide(right)).cast("decimal(38,0)"))


def _salted(part: Column, phrase: Column) -> Column:
    """Which copy of its part's count a phrase meets."""
    return F.pmod(F.xxhash64(phrase), F.when(F.instr(part, " ") > 0, PART_SALTS).otherwise(WORD_SALTS)).cast("int")


def collocations(docs: DataFrame, longest: int = 3, threshold: int = 10, contained: int = 50, top: int = 2000) -> DataFrame:
    """Each language's best phrases of 2 to ``longest`` words: lang, rank, phrase, a, l, r, n, score.

    Words are runs of bytes other than space and tab, A-Z folded, in pieces between ``.,;:!?`` and line breaks; a is a
    phrase's number of occurrences, overlaps included, l and r those of its first and second part at the cut where
    floor(10**6 * a * a / (l * r)) is least (ties: the earliest cut), n the words of the language. A phrase goes where
    some longer one that holds it is at least ``contained`` hundredths as frequent. Order: score, a descending, phrase
    in byte order. A null language is ``und``, null and empty texts have no words, equal rows count each; without
    phrases, or without rows, the result is empty; other columns are ignored.
    """
    counts = materialise(frequent_phrases(docs, longest, threshold), "phrases")
    words = F.split("phrase", " ")
    joined = lambda first, size: F.array_join(F.slice(words, first, size), " ")
    candidates = counts.where("k > 1")
    cuts = candidates.select("lang", "phrase", "k", "a", F.explode(F.sequence(F.lit(1), F.col("k") - 1)).alias("cut")).withColumn("first", joined(F.lit(1), F.col("cut"))).withColumn("rest", joined(F.col("cut") + 1, F.col("k") - F.col("cut")))
    copies = F.sequence(F.lit(0), F.when(F.col("k") > 1, PART_SALTS).otherwise(WORD_SALTS) - 1)
    of = counts.where(f"k between 1 and {longest - 1}").select("lang", "phrase", "a", F.explode(copies).alias("salt"))
    side = lambda part, name: of.select("lang", F.col("phrase").alias(part), F.col("a").alias(name), F.col("salt").alias(f"salt_{part}"))
    cuts = cuts.withColumn("salt_first", _salted(F.col("first"), F.col("phrase"))).join(side("first", "l"), ["lang", "first", "salt_first"])
    cuts = cuts.withColumn("salt_rest", _salted(F.col("rest"), F.col("phrase"))).join(side("rest", "r"), ["lang", "rest", "salt_rest"])
    cuts = cuts.withColumn("score", score(F.col("a"), F.col("l"), F.col("r")))
    scored = cuts.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "cut", "l", "r")).alias("s"))
    inner = F.expr("flatten(transform(sequence(2, k - 1), s -> transform(sequence(1, k - s + 1), i -> array_join(slice(split(phrase, ' '), i, s), ' '))))")
    longer = candidates.where("k > 2").select("lang", F.explode(inner).alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("longest"))
    left = scored.join(longer, ["lang", "phrase"], "left").where(F.col("longest").isNull() | (100 * F.col("longest") < contained * F.col("a")))
    left = left.select("lang", "phrase", "a", "s.score", "s.l", "s.r")
    order = [F.desc("score"), F.desc("a"), "phrase"]
    # a language may hold most phrases: its best are found among the best of parts of it
    near = Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(TOP_SALTS))).orderBy(*order)
    best = left.withColumn("near", F.row_number().over(near)).where(F.col("near") <= top)
    ranked = best.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    totals = counts.where("k = 0").select("lang", F.col("a").alias("n"))
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
