"""Content-addressed store of token ids.

A rolling hash over the last ids cuts every document's id stream into chunks, so equal passages give equal chunks
wherever they stand. A chunk is stored once, under its digest. A document is a recipe: its chunks' digests in order and
the root of a Merkle tree over them; part roots (over doc_id, size and root of each recipe) and one manifest root stand
above these. Reading starts with the manifest and raises where anything below does not agree with it.

Tables of a store (Parquet, below its path):
    chunks    digest binary, n int, ids binary (little-endian unsigned 16- or 32-bit), compressed in rows of one bucket
    recipes   part int, doc_id long, n_tokens long, digests binary (16 bytes each), root binary; by doc_id
    manifest  part int, first long, last long, n_tokens long, root binary; part -1 holds the root of all parts
"""

import os
import zlib
from collections.abc import Iterator
from functools import lru_cache
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.textcore import SegmentEncoder, mix, ragged, slices
from tessera.llm.workspace import parts, workdir

DIGEST = 16
WINDOW = 8
#: One id in 256 ends a chunk; a chunk has 2048 ids at most.
CUT_BITS, LONGEST = 8, 2048
#: Chunks of recipes a task holds before it asks for them.
PIECES = 500_000


def digest(data: bytes) -> bytes:
    return blake2b(data, digest_size=DIGEST).digest()


def merkle(leaves: list[bytes]) -> bytes:
    """Root of a binary hash tree; a node without a partner rises as it is. Without leaves, the digest of nothing."""
    while len(leaves) > 1:
        leaves = [digest(b"\1" + leaves[i] + leaves[i + 1]) if i + 1 < len(leaves) else leaves[i] for i in range(0, len(leaves), 2)]
    return leaves[0] if leaves else digest(b"")


def chunk_ends(ids: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Ends of the chunks of concatenated streams; each stream starts at ``at[i]`` and is not empty."""
    n = len(ids)
    tab = mix(ids.astype(np.uint64) + np.uint64(1))
    roll = np.zeros(n, np.uint64)
    for j in range(min(WINDOW, n)):
        roll[j:] += tab[: n - j] * np.uint64((2 * j + 1) * 0x9E3779B97F4A7C15 % 2**64)
    cut = mix(roll) >> np.uint64(64 - CUT_BITS) == 0
    place = np.arange(n) - np.repeat(at[:-1], np.diff(at))
    cut &= place >= WINDOW - 1  # else the window reaches into the stream before
    cut[at[1:] - 1] = True
    ends = np.flatnonzero(cut) + 1
    begin = np.concatenate([[0], ends[:-1]])
    more = [np.arange(b + LONGEST, e, LONGEST) for b, e in zip(begin[ends - begin > LONGEST], ends[ends - begin > LONGEST], strict=True)]
    return np.sort(np.concatenate([ends, *more])) if more else ends


@lru_cache(1)
def tokenizer(path: str) -> SegmentEncoder:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    with open(path) as f:
        tok = Tokenizer.from_str(f.read())
    vocab = tok.get_vocab()
    added = tuple(t.content.encode() for t in tok.get_added_tokens_decoder().values())
    size = np.zeros(max(vocab.values()) + 1, np.int64)
    for token, i in vocab.items():
        size[i] = len(token.encode()) if token.encode() in added else len(token)  # byte-level: one character for each byte

    def encode(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        ids = [np.array(tok.encode_batch_fast([t], add_special_tokens=False)[0].ids, np.uint32) for t in texts]  # without offsets, one block's encoding in memory at a time
        return np.concatenate(ids), np.array([len(x) for x in ids], np.int64)

    return SegmentEncoder(encode, size, most=600_000, whole=added)


def write(docs: DataFrame, path: str, vocabulary: str, end_id: int = 0) -> None:
    """Encode every text of ``docs`` (doc_id, text), append ``end_id`` to each, and write the store at ``path``.

    Null texts count as empty and give the end id alone. Repeated rows are documents of their own, in the order of
    doc_id and then of their text's digest. Other columns are ignored; without rows the tables are empty. One shuffle
    carries each task's distinct chunks to the bucket of their digest, where a chunk is kept once: a chunk that a third
    of all documents share arrives once from each task. Recipes go round the buckets in turn, whatever they hold. Ids go
    as 16 bits where the vocabulary allows.
    """
    spark = docs.sparkSession
    buckets = parts(spark)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spell, sent, press = tokenizer(vocabulary), set(), zstandard.ZstdCompressor(3)
        wide = "<u4" if len(spell.id_bytes) > 1 << 16 else "<u2"
        turn = TaskContext.get().partitionId()
        for rows, buf, offs in slices(batches, limit=2 << 20):
            ids, at = spell(buf, offs)
            ids, at = np.insert(ids, at[1:], end_id), at + np.arange(len(at))
            raw = memoryview(ids.astype(wide).tobytes())
            width = int(wide[-1])
            ends = chunk_ends(ids, at)
            begin = np.concatenate([[0], ends[:-1]])
            names = [digest(raw[a:b]) for a, b in zip((begin * width).tolist(), (ends * width).tolist(), strict=True)]
            first = np.searchsorted(begin, at).tolist()
            held: dict[int, list[int]] = {}
            for i, name in enumerate(names):
                if name not in sent:
                    sent.add(name)
                    held.setdefault(int.from_bytes(name[:4], "little") % buckets, []).append(i)
            if len(sent) > 100_000:
                sent = set()  # chunks sent again are dropped in their bucket
            blobs = [press.compress(b"".join(names[i] + int(ends[i] - begin[i]).to_bytes(2, "little") for i in own) + b"".join(raw[begin[i] * width : ends[i] * width] for i in own)) for own in held.values()]
            yield pa.RecordBatch.from_arrays([pa.array([*held], pa.int32()), pa.array([True] * len(held), pa.bool_()), pa.nulls(len(held), pa.int64()), pa.array([len(v) for v in held.values()], pa.int64()), pa.array(blobs, pa.binary())], ["bucket", "chunk", "doc_id", "n", "data"])
            recipes = [b"".join(names[a:b]) for a, b in zip(first, first[1:])]
            ids_of = rows.column("doc_id")
            yield pa.RecordBatch.from_arrays([pa.array((turn + np.arange(len(recipes))) % buckets, pa.int32()), pa.array([False] * len(recipes), pa.bool_()), ids_of, pa.array(np.diff(at)), pa.array(recipes, pa.binary())], ["bucket", "chunk", "doc_id", "n", "data"])
            turn += len(recipes)

    def keep_once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        open_ = zstandard.ZstdDecompressor()
        for b in batches:
            kind, name, n, data = [], [], [], []
            for chunk, doc, count, blob in zip(b.column("chunk").to_pylist(), b.column("doc_id").to_pylist(), b.column("n").to_pylist(), b.column("data").to_pylist(), strict=True):
                if not chunk:
                    kind.append("recipe"), name.append(doc), n.append(count), data.append(blob)
                    continue
                fresh = []
                for key, ids in _split(open_.decompress(blob), count):
                    if key[:DIGEST] not in seen:
                        seen.add(key[:DIGEST])
                        fresh.append((key, ids))
                if fresh:
                    kind.append("chunks"), name.append(None), n.append(len(fresh)), data.append(b"".join(k for k, _ in fresh) + b"".join(v for _, v in fresh))
            yield pa.RecordBatch.from_arrays([pa.array(kind, pa.string()), pa.array(name, pa.int64()), pa.array(n, pa.int64()), pa.array(data, pa.binary())], ["kind", "doc_id", "n", "data"])

    rows = docs.select("doc_id", "text").mapInArrow(cut, "bucket int, chunk boolean, doc_id long, n long, data binary")
    once = rows.repartitionById(buckets, F.col("bucket")).mapInArrow(keep_once, "kind string, doc_id long, n long, data binary")
    once.write.option("compression", "zstd").partitionBy("kind").parquet(f"{path}/objects")
    _recipes(spark, path)


def _split(raw: bytes, count: int) -> Iterator[tuple[bytes, bytes]]:
    """Digest with size, and ids, of each chunk of a blob."""
    keys = [raw[i : i + DIGEST + 2] for i in range(0, count * (DIGEST + 2), DIGEST + 2)]
    sizes = [int.from_bytes(k[DIGEST:], "little") for k in keys]
    at = count * (DIGEST + 2)
    width = (len(raw) - at) // max(1, sum(sizes))
    for key, size in zip(keys, sizes, strict=True):
        ids = raw[at : at + size * width]
        at += size * width
        yield key, ids


def _objects(spark: SparkSession, path: str, kind: str) -> DataFrame:
    return spark.read.schema("doc_id long, n long, data binary, kind string").parquet(f"{path}/objects").where(F.col("kind") == kind).drop("kind")


def _root(digests: bytes) -> bytes:
    return merkle([digests[i : i + DIGEST] for i in range(0, len(digests), DIGEST)])


def _part_roots(ordered: DataFrame) -> list[dict]:
    """part, first, last, n_tokens, root of every part, from the digests of its recipes: a row for each partition asked for."""

    def roots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = pa.schema([("part", pa.int32()), ("first", pa.int64()), ("last", pa.int64()), ("n_tokens", pa.int64()), ("root", pa.binary())])
        now: dict = {}

        def row() -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist([now | {"root": merkle(now["root"])}], names)

        for b in batches:
            for r in b.to_pylist():
                if now and r["part"] != now["part"]:
                    yield row()
                    now = {}
                now = now or {"part": r["part"], "first": r["doc_id"], "n_tokens": 0, "root": []}
                if r["root"] != (root := _root(r["digests"])):
                    raise ValueError(f"the recipe of document {r['doc_id']} is damaged")
                now["last"] = r["doc_id"]
                now["n_tokens"] += r["n_tokens"]
                now["root"].append(digest(f"{r['doc_id']} {r['n_tokens']} ".encode() + root))
        if now:
            yield row()

    by_part = ordered.repartition(parts(ordered.sparkSession), "part").sortWithinPartitions("part", "doc_id", F.md5("digests")).select("part", "doc_id", "n_tokens", "digests", "root")
    found = by_part.mapInArrow(roots, "part int, first long, last long, n_tokens long, root binary").collect()
    return sorted(({**r.asDict(), "root": bytes(r.root)} for r in found), key=lambda r: r["part"])


def _top(manifest: list[dict]) -> dict:
    ends = {"first": manifest[0]["first"], "last": manifest[-1]["last"]} if manifest else {"first": None, "last": None}
    return {"part": -1, **ends, "n_tokens": sum(r["n_tokens"] for r in manifest), "root": merkle([r["root"] for r in manifest])}


def _recipes(spark: SparkSession, path: str) -> None:
    """Recipes in the order of doc_id, and the manifest."""

    def root(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.append_column("root", pa.array([_root(x) for x in b.column("digests").to_pylist()], pa.binary()))

    found = _objects(spark, path, "recipe").select("doc_id", F.col("n").alias("n_tokens"), F.col("data").alias("digests"))
    ordered = found.repartitionByRange(parts(spark), "doc_id", F.md5("digests")).sortWithinPartitions("doc_id", F.md5("digests"), "n_tokens")
    ordered.select(F.spark_partition_id().alias("part"), "*").mapInArrow(root, "part int, doc_id long, n_tokens long, digests binary, root binary").write.parquet(f"{path}/recipes")
    manifest = _part_roots(spark.read.parquet(f"{path}/recipes"))
    rows = [(r["part"], r["first"], r["last"], r["n_tokens"], bytearray(r["root"])) for r in [*manifest, _top(manifest)]]
    spark.createDataFrame(rows, "part int, first long, last long, n_tokens long, root binary").coalesce(1).write.parquet(f"{path}/manifest")


def verify(spark: SparkSession, path: str) -> list[dict]:
    """The manifest's parts, once it agrees with itself and with the roots and sums of all recipes; else raises."""
    stored = [{**r.asDict(), "root": bytes(r.root)} for r in spark.read.parquet(f"{path}/manifest").collect()]  # a row for each part
    manifest = sorted((r for r in stored if r["part"] >= 0), key=lambda r: r["part"])
    if [r for r in stored if r["part"] < 0] != [_top(manifest)]:
        raise ValueError("the manifest is damaged")
    if (found := _part_roots(spark.read.parquet(f"{path}/recipes"))) != manifest:
        names = {r["part"] for r in manifest if r not in found} | {r["part"] for r in found if r not in manifest}
        raise ValueError(f"recipes of parts {sorted(names)} are damaged")
    return manifest


def recipes(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, digests, root of every document, verified: start counts the ids of all documents before it."""
    from pyspark.sql import Window

    order = Window.partitionBy("part").orderBy("doc_id", F.md5("digests")).rowsBetween(Window.unboundedPreceding, -1)
    total, bases = 0, []
    for r in verify(spark, path):
        bases.append((r["part"], total))
        total += r["n_tokens"]
    at = F.broadcast(spark.createDataFrame(bases, "part int, base long"))  # a row for each part
    return spark.read.parquet(f"{path}/recipes").join(at, "part").select("doc_id", (F.col("base") + F.coalesce(F.sum("n_tokens").over(order), F.lit(0))).alias("start"), "n_tokens", "digests", "root")


def _combine(crc: np.ndarray, nxt: np.ndarray, shift: np.ndarray) -> np.ndarray:
    """CRC of one stream followed by another, from both CRCs; ``shift`` is the second's operator of ``_shift``."""
    out = np.zeros_like(crc)
    for bit in range(32):
        out ^= np.where(crc >> np.uint32(bit) & np.uint32(1), shift[:, bit], np.uint32(0))
    return out ^ nxt


@lru_cache(1)
def _shifts() -> np.ndarray:
    """What the CRC register becomes after 1, 2, 4, ... zero bytes, bit by bit (linear over GF(2))."""
    base = zlib.crc32(b"\0")
    one = np.array([zlib.crc32(b"\0", 1 << b) ^ base for b in range(32)], np.uint32)
    rows = [one]
    for _ in range(13):
        last = rows[-1]
        rows.append(_combine(last, np.zeros(32, np.uint32), np.broadcast_to(last, (32, 32))))
    return np.array(rows)


@lru_cache(4096)
def _shift(n_bytes: int) -> np.ndarray:
    """The operator for ``n_bytes`` zero bytes."""
    out, k = np.array([1 << b for b in range(32)], np.uint32), 0
    while n_bytes >> k:
        if n_bytes >> k & 1:
            out = _combine(out, np.zeros(32, np.uint32), np.broadcast_to(_shifts()[k], (32, 32)))
        k += 1
    return out


def _stored(b: pa.RecordBatch) -> Iterator[list[tuple[bytes, np.ndarray]]]:
    """Digest and ids of the chunks of each row, verified."""
    for count, raw in zip(b.column("n").to_pylist(), b.column("data").to_pylist(), strict=True):
        out = []
        wide = (len(raw) - count * (DIGEST + 2)) // max(1, sum(int.from_bytes(raw[i + DIGEST : i + DIGEST + 2], "little") for i in range(0, count * (DIGEST + 2), DIGEST + 2)))
        for key, ids in _split(raw, count):
            if digest(ids) != key[:DIGEST]:
                raise ValueError(f"chunk {key[:DIGEST].hex()} is damaged")
            out.append((key[:DIGEST], np.frombuffer(ids, f"<u{wide}").astype("<u4")))
        yield out


def chunks(spark: SparkSession, path: str) -> DataFrame:
    """digest, n, ids (little-endian unsigned 32-bit) of every stored chunk, read from the files; a chunk that is not what its digest names raises."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for found in _stored(b):
                yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in found], pa.binary()), pa.array([len(x) for _, x in found], pa.int32()), pa.array([x.tobytes() for _, x in found], pa.binary())], ["digest", "n", "ids"])

    return _objects(spark, path, "chunks").mapInArrow(read, "digest binary, n int, ids binary")


def _pieces(spark: SparkSession, path: str, stored: DataFrame, columns: list[str]) -> DataFrame:
    """doc_id, start, n_tokens, seq and ``columns`` of ``stored`` for every chunk of every document; one that is not stored raises.

    A digest joins once from each task, with the list of its places: one that a third of all documents share is no hot key.
    """
    at = ["doc_id", "start", "n_tokens", "seq"]

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def flush() -> pa.RecordBatch:
            name = np.concatenate([h[0] for h in held])
            cols = [pa.concat_arrays([h[1].column(c).take(h[2]) for h in held]) for c in at[:3]] + [pa.array(np.concatenate([h[3] for h in held]), pa.int32())]
            held.clear()
            order = np.lexsort((name[:, 1], name[:, 0]))
            name = name[order]
            head = np.ones(len(name), bool)
            head[1:] = (name[1:] != name[:-1]).any(1)
            cuts = pa.array(np.append(np.flatnonzero(head), len(name)), pa.int32())
            keys = pa.FixedSizeBinaryArray.from_buffers(pa.binary(DIGEST), int(head.sum()), [None, pa.py_buffer(np.ascontiguousarray(name[head]).tobytes())]).cast(pa.binary())
            return pa.RecordBatch.from_arrays([keys, *(pa.ListArray.from_arrays(cuts, c.take(pa.array(order))) for c in cols)], ["digest", *at])

        for b in batches:
            raw = b.column("digests").to_pylist()
            n = np.array([len(x) // DIGEST for x in raw], np.int64)
            seq = ragged(np.zeros(len(n), np.int64), n)
            held.append((np.frombuffer(b"".join(raw), np.uint64).reshape(-1, 2), b, pa.array(np.repeat(np.arange(len(n)), n)), seq))
            if sum(len(h[0]) for h in held) > PIECES:
                yield flush()
        if held:
            yield flush()

    asked = recipes(spark, path).mapInArrow(ask, "digest binary, doc_id array<long>, start array<long>, n_tokens array<long>, seq array<int>")
    missing = F.raise_error(F.concat(F.lit("no chunk "), F.hex("digest")))
    rows = asked.join(stored.withColumn("known", F.lit(1)), "digest", "left")
    return rows.select(F.explode(F.arrays_zip(*at)).alias("_"), *(F.when(F.col("known") == 1, F.col(c)).otherwise(missing).alias(c) for c in columns)).select("_.*", *columns)


def _whole(n_tokens: Column, found: Column, value: Column) -> Column:
    """``value`` where as many ids were found as the recipe has; else raises."""
    return F.when(n_tokens == found, value).otherwise(F.raise_error(F.concat(F.lit("ids found: "), found.cast("string"), F.lit(" of "), n_tokens.cast("string"))))


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, ids of every document, put together from its chunks; a store that is damaged anywhere raises."""
    rows = _pieces(spark, path, chunks(spark, path), ["ids"]).groupBy("doc_id", "start", "n_tokens").agg(F.expr("aggregate(array_sort(collect_list(struct(seq, ids))), cast('' as binary), (a, x) -> concat(a, x.ids))").alias("ids"))
    return rows.select("doc_id", "start", _whole(F.col("n_tokens"), F.expr("length(ids) div 4"), F.col("ids")).alias("ids"))


def checksums(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the files.

    The roots and sums of all recipes are held against the manifest first. Each stored chunk is read, verified against
    its digest and summed once; a document's CRC is combined from its chunks' sums in order, so no ids are shuffled. A
    chunk, recipe or part that is missing or altered raises.
    """

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for found in _stored(b):
                yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in found], pa.binary()), pa.array([len(x) for _, x in found], pa.int32()), pa.array([zlib.crc32(x) for _, x in found], pa.int64())], ["digest", "n", "crc"])

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            crcs, ns = b.column("crcs").to_pylist(), b.column("ns").to_pylist()
            acc = np.array([c[0] for c in crcs], np.uint32)
            left = np.arange(len(acc))
            k = 1
            while len(left := left[[len(crcs[i]) > k for i in left]]):
                acc[left] = _combine(acc[left], np.array([crcs[i][k] for i in left], np.uint32), np.array([_shift(4 * ns[i][k]) for i in left]))
                k += 1
            for found, n, doc in zip(map(sum, ns), b.column("n_tokens").to_pylist(), b.column("doc_id").to_pylist(), strict=True):
                if found != n:
                    raise ValueError(f"{found} of {n} ids found of document {doc}")
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("start"), b.column("n_tokens"), pa.array(acc.astype(np.int64))], ["doc_id", "start", "n_tokens", "ids_crc32"])

    small = _objects(spark, path, "chunks").mapInArrow(sums, "digest binary, n int, crc long")
    whole = _pieces(spark, path, small, ["n", "crc"]).groupBy("doc_id", "start", "n_tokens").agg(F.array_sort(F.collect_list(F.struct("seq", "n", "crc"))).alias("of"))
    return whole.select("doc_id", "start", "n_tokens", F.col("of.n").alias("ns"), F.col("of.crc").alias("crcs")).mapInArrow(fold, "doc_id long, start long, n_tokens long, ids_crc32 long")


def store_and_check(docs: DataFrame, vocabulary: str) -> DataFrame:
    """Write ``docs`` to a new store in the shared folder and return ``checksums`` of it."""
    path = workdir(docs.sparkSession, "store")
    write(docs, path, vocabulary)
    return checksums(docs.sparkSession, path)
