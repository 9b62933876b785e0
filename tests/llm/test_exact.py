"""Operators whose results brute force or a library gives exactly."""

import base64
import hashlib
import re
import zlib
from itertools import combinations

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tessera.llm import bpe, components, decontam, fingerprint, neardup, store, suffix, textcore, windows
from tessera.llm.workspace import workdir

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def folded(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def shingled(text, k):
    w = folded(text)
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


@pytest.fixture(scope="module")
def reference():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(max_size=60), max_size=6))
def test_bpe_of_any_text(reference, texts):
    buf, offs = textcore.text_buffer(pa.array(texts, pa.string()))
    ids, at = bpe.encoder(PATH, public_tokenizers.PATTERN)(buf, offs)
    assert [ids[a:b].tolist() for a, b in zip(at, at[1:])] == [reference.encode_ordinary(t) for t in texts]


def test_bpe_round_trip(make, odd, reference):
    out = {r.doc_id: r for r in bpe.round_trip(make(odd), PATH, public_tokenizers.PATTERN, keep_ids=True).collect()}
    for d, t in odd:
        ids = np.array(reference.encode_ordinary(t or ""), "<u4")
        assert out[d].n_tokens == len(ids) and bytes(out[d].ids) == ids.tobytes()
        assert out[d].decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()
    back = bpe.decode_documents(bpe.encode_documents(make(odd), PATH, public_tokenizers.PATTERN), PATH, public_tokenizers.PATTERN)
    assert {r.doc_id: r.text for r in back.collect()} == {d: t or "" for d, t in odd}
    assert bpe.round_trip(make([]), PATH, public_tokenizers.PATTERN).count() == 0


def test_store(spark, make, odd):
    vocab = public_tokenizers.path("byte_bpe_50k.json")
    tok = Tokenizer.from_file(vocab)
    special = "a <|endoftext|> b<|endoftext|><|endoftext|>.x <|endof text|> é<|endoftext|>!"
    rows = [*odd, (20, odd[0][1]), (21, odd[9][1]), (22, special), (23, "<|endoftext|>"), (24, "|>" + special * 3), (25, "<|endoftext")]
    path = workdir(spark, "store")
    store.write(make(rows), path, vocab)
    sums = {r.doc_id: r for r in store.checksums(spark, path).collect()}
    whole = {r.doc_id: bytes(r.ids) for r in store.read_documents(spark, path).collect()}
    at = 0
    for d, t in sorted(rows):
        ids = np.array([*tok.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        assert (sums[d].start, sums[d].n_tokens, sums[d].ids_crc32) == (at, len(ids), zlib.crc32(ids.tobytes()))
        assert whole[d] == ids.tobytes()
        at += len(ids)
    assert 50256 in np.frombuffer(whole[22], "<u4")
    names = [bytes(r.digest) for r in store.chunks(spark, path).collect()]
    assert len(names) == len(set(names))  # copies are stored once
    top = spark.read.parquet(f"{path}/manifest").where("part = -1").collect()[0]
    parts = [bytes(r.root) for r in spark.read.parquet(f"{path}/manifest").where("part >= 0").orderBy("part").collect()]
    assert bytes(top.root) == store.merkle(parts) and top.n_tokens == at
    assert store.store_and_check(make([]), vocab).count() == 0


def test_store_of_rows_without_id(spark, make):
    vocab = public_tokenizers.path("byte_bpe_50k.json")
    out = store.store_and_check(make([(None, "x y"), (1, "z"), (1, "z"), (1, None)]), vocab).collect()
    assert sorted((r.doc_id or -1, r.n_tokens) for r in out) == [(-1, 3), (1, 1), (1, 2), (1, 2)]
    spans = sorted((r.start, r.start + r.n_tokens) for r in out)
    assert spans[0][0] == 0 and all(a[1] == b[0] for a, b in zip(spans, spans[1:]))


def _altered(path, table, change):
    """Rewrites the rows of the first file of ``table`` that has any."""
    import glob
    import os

    for name in sorted(glob.glob(f"{path}/{table}/*.parquet")):
        found = pq.ParquetFile(name).read()
        if found.num_rows:
            os.remove(name)
            os.path.exists(crc := os.path.join(os.path.dirname(name), f".{os.path.basename(name)}.crc")) and os.remove(crc)
            rows = change(found.to_pylist())
            pq.write_table(pa.Table.from_pylist(rows, found.schema), name)
            return
    raise AssertionError("nothing to alter")


def _first_chunk_gone(rows):
    (key, _), *rest = store._split(rows[0]["data"], rows[0]["n"])
    data = b"".join(k for k, _ in rest) + b"".join(v for _, v in rest)
    return [rows[0] | {"n": len(rest), "data": data}, *rows[1:]] if rest else rows[1:]


@pytest.mark.parametrize(
    ("table", "change"),
    [
        ("objects/kind=chunks", _first_chunk_gone),
        ("objects/kind=chunks", lambda rows: [rows[0] | {"data": rows[0]["data"][:-1] + bytes([rows[0]["data"][-1] ^ 1])}, *rows[1:]]),
        ("recipes", lambda rows: rows[1:]),
        ("recipes", lambda rows: [rows[0] | {"n_tokens": rows[0]["n_tokens"] + 1}, *rows[1:]]),
        ("recipes", lambda rows: [rows[0] | {"digests": rows[0]["digests"][::-1]}, *rows[1:]]),
        ("recipes", lambda rows: [rows[0] | {"doc_id": -5}, *rows[1:]]),
        ("manifest", lambda rows: [r for r in rows if r["part"] != 0]),
        ("manifest", lambda rows: [r | {"n_tokens": r["n_tokens"] + (r["part"] == 0)} for r in rows]),
    ],
)
def test_damage_raises(spark, make, odd, table, change):
    path = workdir(spark, "store")
    store.write(make([*odd[:4], odd[9]]), path, public_tokenizers.path("byte_bpe_50k.json"))
    _altered(path, table, change)
    with pytest.raises(Exception):
        store.checksums(spark, path).collect()
    with pytest.raises(Exception):
        store.read_documents(spark, path).collect()


def test_merkle_tells_changes():
    leaves = [bytes([i]) * 16 for i in range(5)]
    assert store.merkle(leaves) != store.merkle(leaves[::-1]) and store.merkle(leaves[:1]) == leaves[0]


def test_fingerprints(make, odd):
    rows = [*odd, (16, "  ONE two "), (17, "ﬁne"), (18, "FINE"), (19, "é"), (20, "É")]
    out = {r.doc_id: r for r in fingerprint.fingerprints(make(rows)).collect()}
    texts = {d: t or "" for d, t in rows}
    order = sorted(texts, reverse=True)
    for i, d in enumerate(order):
        t, nxt = texts[d], texts[order[(i + 1) % len(order)]]
        edited = t[: len(t) - len(t) // 2] + nxt[: len(t) // 2]
        assert out[d].n_chars == len(t) and out[d].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert out[d].near_edited in (0.0, 1.0)
    same = [{1, 3, 4}, {5, 6, 7}, {8, 9, 16}, {17, 18}, {19, 20}]
    for group in same:
        assert len({out[d].fingerprint for d in group}) == 1 and {out[d].class_id for d in group} == {min(group)}
        assert {out[d].n_copies for d in group} == {len(group)}
    assert out[20].near_next == 1.0 and out[2].fingerprint != out[1].fingerprint
    assert fingerprint.fingerprints(make([])).count() == 0
    one = fingerprint.fingerprints(make([(3, "x y")])).collect()[0]
    assert one.near_next == 1.0 and one.edited_sha256 == hashlib.sha256(b"x x").hexdigest()


def value_of(text):
    """The fingerprint by other means: NFKC and xxhash64 in Python."""
    import unicodedata

    import xxhash

    canon = re.sub(r"\s+", " ", unicodedata.normalize("NFKC", text).lower()).strip(" ").encode()

    def xx(parts):
        seed = 42
        for x in parts:
            seed = xxhash.xxh64_intdigest(x, seed)
        return seed

    return f"{xx([canon]):016x}{xx([(0x5BD1E995).to_bytes(4, 'little'), canon, (0x27D4EB2F).to_bytes(4, 'little')]):016x}"


@pytest.mark.parametrize("ids", [[-(2**63), -6_900_000_000_000_000_000, -1, 0, 1, 6_900_000_000_000_000_000, 2**63 - 1], [*range(30), 10**15], [7] * 12, [None, 3, None, 1, 3, -(2**63)]])
def test_fingerprints_of_any_ids(make, ids):
    texts = [f"Text ﬁ  {i % 9} \tof É{i % 9}" if i % 5 else None for i in range(len(ids))]
    rows = list(zip(ids, texts))
    out = fingerprint.fingerprints(make(rows)).collect()
    assert len(out) == len(rows)
    following = {(r.doc_id, r.text): [] for r in fingerprint.with_next(make(rows)).collect()}
    pairs = [(r.doc_id, r.text, r.next_text) for r in fingerprint.with_next(make(rows)).collect()]
    for d, t, nxt in pairs:
        following[d, t].append(nxt)
    # one ring through all rows, ids descending, null ids last
    assert sorted(t for _, t, _ in pairs) == sorted(n for _, _, n in pairs)
    order = sorted({i for i in ids if i is not None}, reverse=True) + [None] * (None in ids)
    of = lambda i: {t or "" for d, t in rows if d == i}
    for i, nxt in zip(order, [*order[1:], order[0]]):
        ends = [n for d, t, n in pairs if d == i]
        assert all(n in of(i) | of(nxt) for n in ends) and any(n in of(nxt) for n in ends)
    assert sorted(r.fingerprint for r in out) == sorted(value_of(t or "") for t in texts)


def linked_components(sets, num=80, den=100):
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in combinations(sets, 2):
        both = len(sets[a] & sets[b])
        if sets[a] and den * both >= num * len(sets[a] | sets[b]):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {d: find(d) for d in sets}


@pytest.mark.parametrize("group", [20_000, 3])
def test_near_duplicates(make, odd, group, monkeypatch):
    monkeypatch.setattr(components, "GROUP", group)
    monkeypatch.setattr(components.cluster, "__defaults__", (group,))
    base = odd[0][1].split()
    chain = []
    for i in range(8):  # each near the one before it, the ends far apart
        w = base[:]
        w[: 12 * i] = [f"x{j}" for j in range(12 * i)]
        chain.append((100 + i, " ".join(w)))
    rows = [*odd, *chain, (5, None)]
    out = {r.doc_id: r for r in neardup.near_duplicates(make(rows), k=4).collect()}
    want = linked_components({d: shingled(t, 4) for d, t in rows})
    for d, t in rows:
        assert out[d].n_shingles == len(shingled(t, 4))
        assert out[d].component_id == want[d] and out[d].kept == (want[d] == d)
    assert neardup.near_duplicates(make([])).count() == 0


def repeats(rows, length):
    seen, out = set(), {}
    for d, t in sorted(rows):
        b = (t or "").encode()
        mask = np.zeros(len(b), bool)
        for p in range(len(b) - length + 1):
            if b[p : p + length] in seen:
                mask[p : p + length] = True
            seen.add(b[p : p + length])
        out[d] = bytes(x for x, m in zip(b, mask) if not m)
    return out


@pytest.mark.parametrize("hot", [2048, 3])
def test_substrings(make, odd, hot, monkeypatch):
    monkeypatch.setattr(suffix, "HOT", hot)
    monkeypatch.setattr(suffix, "SHARD", 1 << 20 if hot > 3 else 600)
    line = "this very common line of more than thirty two bytes"
    rows = [*odd, *[(200 + i, f"{i} begins {line} and ends in {i * 7} ways, {odd[0][1][i * 9 : i * 9 + 140]}") for i in range(40)]]
    out = {r.doc_id: bytes(r.kept) for r in suffix.substring_dedup(make(rows)).collect()}
    assert out == repeats(rows, 100)
    assert suffix.substring_dedup(make([])).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.binary(min_size=0, max_size=60).map(lambda b: bytes(x % 3 + 97 for x in b)), min_size=1, max_size=4))
def test_suffix_arrays(texts):
    buf = np.frombuffer(b"".join(texts), np.uint8)
    sa = suffix.suffix_array(buf)
    raw = buf.tobytes()
    assert sa.tolist() == sorted(range(len(raw)), key=lambda i: raw[i:])
    if len(raw) > 1:
        lcp = suffix.common_prefixes(buf, sa, 20)
        for k in range(1, len(sa)):
            a, b = raw[sa[k - 1] :], raw[sa[k] :]
            n = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
            assert lcp[k] == min(n, 20)


def test_passages(make, odd):
    out = {r.doc_id: r for r in windows.passage_dedup(make(odd)).collect()}
    covered = lambda d: sum(s.last_word - s.first_word for s in out[d].spans)
    n = {d: len(folded(t)) for d, t in odd}
    assert all(out[d].n_words == n[d] for d in n)
    assert covered(2) == 300 and covered(3) == 300 and out[3].deduped.strip() == ""
    assert 80 <= covered(12) <= 90 and out[12].partners == [11] and out[12].deduped.split()[:30] == odd[11][1].split()[:30]
    assert not any(covered(d) for d in (1, 4, 5, 6, 7, 8, 9, 10, 11, 13, 14))
    assert out[1].score == "mine" and out[5].text is None and out[1].deduped == odd[0][1]
    assert windows.passage_dedup(make([])).count() == 0


def test_contamination(spark, make, odd):
    w = odd[9][1].split()
    items = [(1, " ".join(w[5000:5040])), (2, " ".join(w[9000:9020] + ["zzz"] * 20)), (3, " ".join([*w[100:118], "edit", *w[119:140]])), (4, "one two"), (5, None), (6, ""), (7, odd[0][1]), (8, odd[0][1]), (9, " ".join(w[200:225] + w[15000:15025]))]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id): (r.item_shingles, r.shared) for r in decontam.contamination(make(odd), bench).collect()}
    want = {}
    for d, t in odd:
        own = shingled(t, 5) if len(folded(t)) >= 5 else set()
        for i, x in items:
            s = shingled(x, 5) if len(folded(x)) >= 5 else set()
            if s and 100 * len(s & own) >= 80 * len(s):
                want[d, i] = (len(s), len(s & own))
    assert got == want and (10, 1) in got and (10, 9) in got
    assert decontam.contamination(make([]), bench).count() == 0 and decontam.contamination(make(odd), bench.limit(0)).count() == 0
