"""Arrays in rows: many small records travel through a shuffle as one compressed blob for each bucket."""

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql.types import StructType


def pack(arrays: list[np.ndarray]) -> bytes:
    """Arrays, all but the last of equal length, as one compressed blob; the last is bytes of any length."""
    head = len(arrays[0]).to_bytes(8, "little")
    return zstandard.ZstdCompressor(3).compress(head + b"".join(np.ascontiguousarray(a).tobytes() for a in arrays))


def unpack(blob: bytes, kinds: list[str]) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    n, at, out = int.from_bytes(raw[:8], "little"), 8, []
    for kind in kinds:
        dtype = np.dtype(kind)
        out.append(np.frombuffer(raw, dtype, n, at))
        at += n * dtype.itemsize
    out.append(np.frombuffer(raw, np.uint8, offset=at))
    return out


def by_bucket(bucket: np.ndarray, arrays: list[np.ndarray], data: np.ndarray | None = None, sizes: np.ndarray | None = None) -> Iterator[tuple[int, bytes]]:
    """(bucket, blob) of the records of each bucket; ``data`` holds ``sizes`` bytes of each record, in order."""
    from tessera.llm.textcore import ragged

    if not len(bucket):
        return
    order = np.argsort(bucket, kind="stable")
    cuts = np.flatnonzero(np.diff(bucket[order], prepend=-1))
    begin = np.cumsum(sizes) - sizes if sizes is not None else None
    for i, j in zip(cuts.tolist(), [*cuts[1:].tolist(), len(order)], strict=True):
        own = order[i:j]
        tail = data[ragged(begin[own], sizes[own])] if data is not None else np.zeros(0, np.uint8)
        yield int(bucket[own[0]]), pack([*(a[own] for a in arrays), tail])


def blob_rows(rows: list[tuple[int, bytes]], kind: int) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([b for b, _ in rows], pa.int32()), pa.array([kind] * len(rows), pa.int32()), pa.array([x for _, x in rows], pa.binary())], ["bucket", "kind", "data"])


BLOBS = "bucket int, kind int, data binary"


def squeezed(docs: DataFrame, columns: list[str] | None = None, only: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]] | None = None) -> DataFrame:
    """``columns`` (doc_id alone unless given) and z: texts compressed one by one, for a shuffle that moves whole texts; of the rows that ``only`` lets through."""
    plain = docs.select(*(columns or ["doc_id"]), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(1).compress
        for b in only(batches) if only else batches:
            z = pa.array([None if t is None else press(t.encode()) for t in b.column("text").to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], z], [*b.schema.names[:-1], "z"])

    return plain.mapInArrow(run, StructType(plain.schema.fields[:-1]).add("z", "binary"))


def inflated(batches: Iterator[pa.RecordBatch], rows: int = 2000, kind: pa.DataType | None = None) -> Iterator[pa.RecordBatch]:
    """Batches with the texts of column ``z`` in ``text``, as bytes unless ``kind`` is given."""
    open_ = zstandard.ZstdDecompressor().decompress
    for batch in batches:
        for i in range(0, batch.num_rows, rows):
            b = batch.slice(i, rows)
            keep = [c for c in b.schema.names if c != "z"]
            text = pa.array([None if z is None else open_(z) for z in b.column("z").to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), text.cast(kind) if kind else text], [*keep, "text"])
