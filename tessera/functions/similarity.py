"""Likeness of vectors and texts."""

from difflib import SequenceMatcher

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import DoubleType, IntegerType, StringType, StructType

#: English stop words for token likeness.
STOP_WORDS = ["a", "an", "and", "are", "as", "at", "by", "for", "in", "is", "it", "of", "on", "or", "that", "the", "to", "was", "were", "with"]


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays in double precision; norms have 1e-8 added, so that zero vectors give 0."""
    return dot(a, b) / ((F.sqrt(dot(a, a)) + 1e-8) * (F.sqrt(dot(b, b)) + 1e-8))


def tokens(text: Column, stop_words: list[str] | None = None) -> Column:
    """Distinct lower-case words of letters and digits, without ``stop_words`` where they are given, by their stems."""
    found = F.regexp_extract_all(F.lower(text), F.lit(r"[a-z0-9]+"), 0)
    return F.array_distinct(F.transform(F.filter(found, lambda w: ~w.isin(stop_words)), stem)) if stop_words else F.array_distinct(found)


def stem(word: Column) -> Column:
    """A word without its commonest English endings."""
    for pattern, by in ((r"(ss|sh|ch|x)es$", "$1"), (r"ies$", "y"), (r"(?<=[^su])s$", ""), (r"(?<=[a-z]{3})(ing|ed)$", "")):
        word = F.regexp_replace(word, pattern, by)
    return word


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays as sets; 0 where both are empty."""
    return F.size(F.array_intersect(a, b)) / F.greatest(F.size(F.array_union(a, b)), F.lit(1))


def contains_score(a: Column, b: Column) -> Column:
    """Shorter over longer length where one text holds the other, else null."""
    la, lb = F.length(a), F.length(b)
    return F.when((la > 0) & (lb > 0) & (a.contains(b) | b.contains(a)), F.least(la, lb) / F.greatest(la, lb))


def ratio(a: str, b: str) -> float:
    """Share of characters in matching blocks, prediction first, case apart."""
    return SequenceMatcher(None, (a or "").lower(), (b or "").lower()).ratio()


@pandas_udf(DoubleType())
def ratio_udf(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([ratio(x, y) for x, y in zip(a, b, strict=True)])


def _in_windows(place: np.ndarray, n: int, width: int, ids: np.ndarray) -> np.ndarray:
    """Distinct ``ids`` at ``place`` (ascending positions) within each window of ``width`` words: each counts where its last one before is outside."""
    order = np.lexsort((place, ids))
    same = np.append(False, ids[order][1:] == ids[order][:-1])
    before = np.full(len(place), -1)
    before[order[same]] = place[order[np.flatnonzero(same) - 1]]
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, np.maximum(before + 1, np.maximum(place - width + 1, 0)), 1)
    np.add.at(edge, place + 1, -1)
    return np.cumsum(edge)[: n - width + 1]


def _candidates(want: list[str], have: list[str], least: float) -> tuple[np.ndarray, np.ndarray]:
    """Windows of as many words as ``want`` with a word likeness of ``least`` or more, and the most their ratio can be.

    The ratio counts characters in matching blocks, so it is at most what the characters both have, whatever their order, allow.
    """
    n, width = len(have), len(want)
    code: dict[str, int] = {}
    ids = np.array([code.setdefault(w, len(code)) for w in have])
    target = set(want)
    mine = np.flatnonzero([w in target for w in have])
    both = _in_windows(mine, n, width, ids[mine])
    either = len(target) + _in_windows(np.arange(n), n, width, ids) - both
    near = np.flatnonzero(both >= least * either)
    if not len(near):
        return near, np.zeros(0)
    joined = " ".join(want)
    letters = sorted(set(joined))
    names, per_word = list(code), np.zeros((len(code), len(letters)), np.int64)
    edge = np.bincount(near, minlength=n + 1) - np.bincount(near + width, minlength=n + 1)
    for i in np.unique(ids[np.cumsum(edge)[:n] > 0]).tolist():  # words outside of these windows don't count
        per_word[i] = [names[i].count(c) for c in letters]
    upto = np.concatenate([np.zeros((1, len(letters)), np.int64), np.cumsum(per_word[ids], 0)])
    counts = upto[near + width] - upto[near]
    counts[:, [c == " " for c in letters]] += width - 1
    size = np.concatenate([[0], np.cumsum([len(w) for w in have])])
    length = size[near + width] - size[near] + width - 1
    common = np.minimum(counts, np.array([joined.count(c) for c in letters])).sum(1)
    return near, 2.0 * common / (len(joined) + length)


def ground(excerpt: str, source: str, low: str | None = None, least: float = 0.6) -> tuple[str, int, int]:
    """Where an excerpt stands in its source: exact, case_insensitive, fuzzy (the first best window of as many words, ratio 0.6 or more) or not_found.

    A fuzzy match begins where the window's words, joined by single spaces, stand in the source as they are; where they
    don't, nothing is found. Windows are scored from the highest possible ratio down, until no other can be as good.
    """
    if not excerpt or not source:
        return "not_found", -1, -1
    if (at := source.find(excerpt)) >= 0:
        return "exact", at, at + len(excerpt)
    low = source.lower() if low is None else low
    want = excerpt.lower()
    if (at := low.find(want)) >= 0:
        return "case_insensitive", at, at + len(excerpt)
    plain, words = source.split(), excerpt.split()
    if len(words) < 3 or len(plain) < len(words):
        return "not_found", -1, -1
    have = [w.lower() for w in plain]
    matcher = SequenceMatcher(None)
    # as the excerpt comes first, it is what changes least: the window is what the matcher analyses
    near, most = _candidates(want.split(), have, 0.3) if len(want.split()) == len(words) else (np.arange(len(plain) - len(words) + 1), np.ones(len(plain) - len(words) + 1))
    slack = len(want) - len(" ".join(want.split()))  # outer and repeated spaces of the excerpt, which the bound leaves out
    best, place = 0.0, None
    for k in np.lexsort((near, -most)).tolist():
        i, top = int(near[k]), most[k] + 2.0 * slack / max(1, len(want))
        if top < max(best, least) - 1e-9:
            break
        matcher.set_seqs(want, " ".join(have[i : i + len(words)]))
        r = matcher.ratio()
        if r > best or r == best and place is not None and i < place:
            best, place = r, i
    if place is not None and best >= least:
        found = " ".join(plain[place : place + len(words)])
        if (at := source.find(found)) >= 0:
            return "fuzzy", at, at + len(found)
    return "not_found", -1, -1


@pandas_udf(StructType().add("status", StringType()).add("char_start", IntegerType()).add("char_end", IntegerType()))
def ground_udf(excerpt: pd.Series, source: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([ground(e, s) for e, s in zip(excerpt, source, strict=True)], columns=["status", "char_start", "char_end"])


def ground_plain(excerpt: Column, source: Column) -> Column:
    """exact, case_insensitive or not_found, without Python."""
    return F.when((F.length(excerpt) > 0) & source.contains(excerpt), "exact").when((F.length(excerpt) > 0) & F.lower(source).contains(F.lower(excerpt)), "case_insensitive").otherwise("not_found")
