"""Document quality by a linear-chain conditional random field over lines.

Each line is good or bad. Its potential comes from its own features and those of the lines before and after it; a
transition potential links neighbours. In training every line bears its document's label. The document's score is the
mean of the lines' forward-backward marginals, weighted by their lengths. Label, language, source and id are no features.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.textcore import run_hashes, slices, word_spans

#: Labelled documents from which the field is learnt, about: more are thinned evenly by a hash of doc_id.
FIT_DOCUMENTS = 4000
#: Characters of these documents, about, and of the longest one that is drawn: documents are drawn whole or not at all.
FIT_CHARS, LONGEST = 24_000_000, 1_000_000
#: Lines of these documents, about, and of the one of most lines that is drawn: a line's features are some 50 numbers on the driver.
FIT_LINES, MOST_LINES = 300_000, 50_000
STEPS, RATE, DECAY = 300, 0.05, 1e-3
#: Marks whose share of a line is a feature each.
MARKS = b"|#$%&*!?.,;:<>{}[]()=_-/\\@+~^\"'`"
#: Classes of bytes: others, lower vowels and consonants, upper ones, digits, white space, beyond ASCII, each mark.
KIND = np.zeros(256, np.int64)
for _kind, _bytes in enumerate([b"aeiou", b"bcdfghjklmnpqrstvwxyz", b"AEIOU", b"BCDFGHJKLMNPQRSTVWXYZ", b"0123456789", b"\t\n\v\f\r ", bytes(range(128, 256)), *(bytes([m]) for m in MARKS)], 1):
    KIND[[*_bytes]] = _kind
KINDS = 8 + len(MARKS)


def features(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features of every line, bytes of every line, and each document's first line (one line at least)."""
    inner = np.flatnonzero(buf == 10) + 1
    inner = inner[~np.isin(inner, offs)]
    first = np.concatenate([[0], np.cumsum(1 + np.diff(np.searchsorted(inner, offs)))])
    begin = np.empty(first[-1], np.int64)
    begin[first[:-1]] = offs[:-1]
    rest = np.ones(len(begin), bool)
    rest[first[:-1]] = False
    begin[rest] = inner
    ends = np.append(begin[1:], 0)
    ends[first[1:] - 1] = offs[1:]
    size = ends - begin
    line = np.repeat(np.arange(len(begin)), size)
    count = np.bincount(line * KINDS + KIND[buf], minlength=len(begin) * KINDS).reshape(-1, KINDS) / np.maximum(size, 1)[:, None]
    upper, letters = count[:, 3] + count[:, 4], count[:, [1, 2, 3, 4, 7]].sum(1)
    cols = [np.log1p(size), letters, upper, count[:, 5], count[:, 6], count[:, 7], count[:, 1] + count[:, 3], upper / np.maximum(letters, 1e-3)]
    cols += [np.sqrt(count[:, 8 + m]) for m in range(len(MARKS))]
    cols.append(count[:, 8:].sum(1))
    h, at, ws = word_spans(buf, offs)
    in_line = line[ws] if len(ws) else np.zeros(0, np.int64)
    words = np.bincount(in_line, minlength=len(begin))
    # words that the line, and lines that the document, has more than once
    _, which, times = np.unique(h ^ (in_line.astype(np.uint64) << np.uint64(40)), return_inverse=True, return_counts=True)
    again = np.bincount(in_line, times[which] > 1, len(begin)) / np.maximum(words, 1)
    doc = np.repeat(np.arange(len(offs) - 1), np.diff(first))
    name = np.zeros(len(begin), np.uint64)
    name[size > 0] = run_hashes(buf, begin[size > 0])
    _, which, times = np.unique(name ^ (doc.astype(np.uint64) << np.uint64(40)), return_inverse=True, return_counts=True)
    twice = (times[which] > 1).astype(float)
    dwords = np.repeat(np.arange(len(offs) - 1), np.diff(at))
    _, which, times = np.unique(h ^ (dwords.astype(np.uint64) << np.uint64(40)), return_inverse=True, return_counts=True)
    often = np.bincount(in_line, np.log(times[which]), len(begin)) / np.maximum(words, 1) if len(h) else np.zeros(len(begin))
    cols += [np.log1p(words), size / np.maximum(words, 1) / 10, again, twice, often, (words == 0).astype(float)]
    return np.stack(cols, 1), size, first


def with_neighbours(x: np.ndarray, first: np.ndarray) -> np.ndarray:
    """A line's features, those of the lines before and after it (zeros beyond the document), and a constant."""
    before, after = np.zeros_like(x), np.zeros_like(x)
    before[1:], after[:-1] = x[:-1], x[1:]
    before[first[:-1]] = 0
    after[first[1:] - 1] = 0
    return np.concatenate([x, before, after, np.ones((len(x), 1))], 1)


def marginals(unary: np.ndarray, trans: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """P(good) of every line, and the expected number of each transition, by forward and backward passes.

    ``unary`` is a line's potential for good against bad; ``trans[a, b]`` that of state a followed by b. Chains go on
    side by side, the longest first.
    """
    size = np.diff(first)
    order = np.argsort(-size, kind="stable")
    start, size = first[:-1][order], size[order]
    forward, backward = np.zeros(len(unary)), np.zeros(len(unary))
    r = unary[start].copy()
    forward[start] = r
    most = int(size[0]) if len(size) else 0
    live = np.searchsorted(-size, -np.arange(1, most + 1), "right")  # chains of at least t lines
    for t in range(1, most):
        k = live[t]
        at = start[:k] + t
        r = unary[at] + np.logaddexp(r[:k] + trans[1, 1], trans[0, 1]) - np.logaddexp(r[:k] + trans[1, 0], trans[0, 0])
        forward[at] = r
    s = np.zeros(0)
    for t in range(most - 2, -1, -1):
        k = live[t + 1]
        at = start[:k] + t
        s = np.append(s, np.zeros(k - len(s)))
        into = unary[at + 1] + s
        s = np.logaddexp(trans[1, 1] + into, trans[1, 0]) - np.logaddexp(trans[0, 1] + into, trans[0, 0])
        backward[at] = s
    inner = np.ones(len(unary), bool)
    inner[first[1:] - 1] = False
    at = np.flatnonzero(inner)
    into = unary[at + 1] + backward[at + 1]
    four = np.stack([np.broadcast_to(trans[0, 0], len(at)), trans[0, 1] + into, forward[at] + trans[1, 0], forward[at] + trans[1, 1] + into])
    four = np.exp(four - four.max(0)) if len(at) else four
    pairs = (four / four.sum(0)).sum(1).reshape(2, 2) if len(at) else np.zeros((2, 2))
    return 1 / (1 + np.exp(-np.clip(forward + backward, -50, 50))), pairs


class Field:
    """Weights of the field, and what its features are scaled by."""

    def __init__(self, mean, scale, weights, trans):
        self.mean, self.scale, self.weights, self.trans = mean, scale, weights, trans

    def unary(self, x: np.ndarray, first: np.ndarray) -> np.ndarray:
        return with_neighbours((x - self.mean) / self.scale, first) @ self.weights

    def scores(self, buf: np.ndarray, offs: np.ndarray) -> np.ndarray:
        x, size, first = features(buf, offs)
        p, _ = marginals(self.unary(x, first), self.trans, first)
        weight = np.maximum(size, 1).astype(float)
        return np.add.reduceat(p * weight, first[:-1]) / np.add.reduceat(weight, first[:-1])


def train(x: np.ndarray, first: np.ndarray, good: np.ndarray) -> Field:
    """Maximum likelihood with a quadratic penalty, by gradient steps (Adam); ``good`` is each document's label."""
    mean, scale = x.mean(0), np.maximum(x.std(0), 1e-3)
    z = with_neighbours((x - mean) / scale, first)
    size = np.diff(first)
    y = np.repeat(good.astype(float), size)
    # a long document weighs as a short one
    weight = np.repeat(1 / size, size)
    seen = np.zeros((2, 2))
    seen[0, 0], seen[1, 1] = (size[good == 0] - 1).sum(), (size[good == 1] - 1).sum()
    theta = np.zeros(z.shape[1] + 4)
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    docs, pairs_seen = len(size), max(1, (size - 1).sum())
    for step in range(1, STEPS + 1):
        p, pairs = marginals(z @ theta[:-4], theta[-4:].reshape(2, 2), first)
        grad = np.append(z.T @ ((y - p) * weight) / docs, ((seen - pairs) / pairs_seen).ravel()) - DECAY * theta
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        theta += RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return Field(mean, scale, theta[:-4], theta[-4:].reshape(2, 2))


def fit(docs: DataFrame, labels: DataFrame, at_most: int = FIT_DOCUMENTS, chars: int = FIT_CHARS, lines_at_most: int = FIT_LINES) -> Field | None:
    """Field learnt from ``docs`` (doc_id, text) whose ``quality`` in ``labels`` is 0 or 1; None without any.

    The features of about ``at_most`` documents, ``chars`` characters and ``lines_at_most`` lines, evenly thinned, come
    to the driver. Where a doc_id has several labels, the highest counts. Documents of over LONGEST characters or
    MOST_LINES lines are not learnt from.
    """
    breaks = F.regexp_count("text", F.lit("\n")) + 1
    known = labels.where("quality in (0, 1)").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    docs = docs.where((F.coalesce(F.length("text"), F.lit(0)) <= LONGEST) & (F.coalesce(breaks, F.lit(1)) <= MOST_LINES))
    n = known.count()
    drawn = known.where(F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(1 << 20)) < int(min(1.0, at_most / max(1, n)) * (1 << 20)))
    sizes = [F.coalesce(F.sum(c), F.lit(0)) for c in (F.length("text"), F.coalesce(breaks, F.lit(1)))]
    size, count = docs.join(F.broadcast(drawn), "doc_id").agg(*sizes).first() if n else (0, 0)
    share = min(1.0, at_most / max(1, n)) * min(1.0, chars / max(1, size), lines_at_most / max(1, count))
    if share < 1:
        known = known.where(F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(1 << 20)) < int(share * (1 << 20)))

    def lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, buf, offs in slices(batches, limit=1 << 20):
            x, _, first = features(buf, offs)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("quality"), pa.array([x[i:j].tobytes() for i, j in zip(first, first[1:])], pa.binary())], ["doc_id", "quality", "x"])

    rows = docs.select("doc_id", "text").join(F.broadcast(known), "doc_id").select("doc_id", "text", F.col("quality").cast("int").alias("quality"))
    rows = rows.mapInArrow(lines, "doc_id long, quality int, x binary").orderBy("doc_id").collect()
    if not rows:
        return None
    width = features(np.zeros(0, np.uint8), np.zeros(2, np.int64))[0].shape[1]
    x = [np.frombuffer(r.x, np.float64).reshape(-1, width) for r in rows]
    first = np.concatenate([[0], np.cumsum([len(a) for a in x])])
    return train(np.concatenate(x), first, np.array([r.quality for r in rows]))


def score(docs: DataFrame, field: Field | None) -> DataFrame:
    """doc_id, score of every text of ``docs``: from 0 (bad) to 1. Null and empty texts are one empty line; without a field 0.5."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, buf, offs in slices(batches, limit=1 << 20):
            s = field.scores(buf, offs) if field else np.full(b.num_rows, 0.5)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(s)], ["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, score double")


def quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of every document; learns labels of documents that are not held out only."""
    from tessera.llm.langid import held_out

    field = fit(docs, labels.where(~held_out(1, 3)))
    return score(docs, field).select("doc_id", held_out(1, 3).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
