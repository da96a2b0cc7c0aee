"""Periodic runs of words, by the runs theorem.

A run is a stretch with a smallest period that cannot be extended. Each holds a Lyndon word of the length of its period,
under the order of words or under the reverse order, that is the longest Lyndon word at its place. Those end where a later
suffix first comes before (or, for the reverse order, after) the suffix that starts there: at the next smaller or greater
value of the inverse suffix array. How far such a root repeats to the right is the longest common prefix of two
suffixes: a range minimum of the LCP array, from a sparse table.

All texts of a batch share one suffix array. Their words are different characters, so that suffixes of different texts
never have anything in common, and each text ends in a character of its own.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, modest_batches

#: A run counts from so many words, and from so many periods.
LEAST_WORDS, LEAST_PERIODS = 24, 3


def suffix_ranks(chars: np.ndarray) -> list[np.ndarray]:
    """Ranks of the prefixes of 1, 2, 4, ... characters of all suffixes, by doubling; the last are those of the suffixes.
    Suffixes that are alone with their prefix are not sorted again. No two suffixes may be prefixes of each other."""
    n = len(chars)
    at, order = np.arange(n), np.argsort(chars, kind="stable")
    key, rank, levels = chars[order], np.zeros(n, np.int64), []
    group, h = np.zeros(n, np.int64), 0
    while True:
        new = np.append(True, key[1:] != key[:-1])
        here = at[: len(order)]
        # Ranks count from the group's first place; a group's members are next to each other.
        first = np.maximum.accumulate(np.where(new, here, 0))
        outer = np.maximum.accumulate(np.where(np.append(True, group[1:] != group[:-1]), here, 0))
        rank[order] = group + first - outer
        levels.append(rank.astype(np.int32 if n < 2**31 else np.int64))
        order = order[~(new & np.append(new[1:], True))]
        if not len(order):
            return levels
        h = h * 2 or 1
        key = rank[order] * (n + 1) + rank[order + h]
        by = np.argsort(key, kind="stable")
        order, key = order[by], key[by]
        group = rank[order]


def common_prefixes(levels: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(suffix array, LCP array): lcp[k] is the common prefix of the suffixes at k and k + 1."""
    rank = levels[-1]
    sa = np.empty(len(rank), np.int64)
    sa[rank] = np.arange(len(rank))
    lcp, a, b = np.zeros(len(sa) - 1, np.int64), sa[:-1].copy(), sa[1:].copy()
    equal = [np.flatnonzero(levels[0][a] == levels[0][b])]
    for level in levels[1:-1]:
        last = equal[-1]
        equal.append(last[level[a[last]] == level[b[last]]])
    for k in range(len(equal) - 1, -1, -1):
        on = equal[k][levels[k][a[equal[k]]] == levels[k][b[equal[k]]]]
        for x in (lcp, a, b):
            x[on] += 1 << k
    return sa, lcp


def next_smaller(values: list[int]) -> list[int]:
    """For each position the next one with a smaller value, or the length."""
    out, waiting = [len(values)] * len(values), []
    for i, v in enumerate(values):
        while waiting and values[waiting[-1]] > v:
            out[waiting.pop()] = i
        waiting.append(i)
    return out


class RangeMinimum:
    """Minima of values[lo:hi] by a sparse table."""

    def __init__(self, values: np.ndarray):
        self.table = [values]
        while (half := 1 << len(self.table) - 1) * 2 <= len(values):
            last = self.table[-1]
            self.table.append(np.minimum(last[:-half], last[half:]))

    def of(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        level = np.frexp((hi - lo).astype(float))[1] - 1
        out = np.empty(len(lo), np.int64)
        for k in np.unique(level):
            on, t = level == k, self.table[k]
            out[on] = np.minimum(t[lo[on]], t[hi[on] - (1 << int(k))])
        return out


def _least(period):
    return np.maximum(LEAST_WORDS, LEAST_PERIODS * period)


#: The leftmost root of a run starts less than a period after the run, so that it repeats so far to the right at least.
SHORTEST = int(min(_least(q) - 2 * q + 1 for q in range(1, LEAST_WORDS + 1)))


def runs_of(chars: np.ndarray, rank: np.ndarray, lcp: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs of one text that are long enough, by start and period. chars end in a character of
    their own, rank is the inverse suffix array, lcp its LCP array."""
    shared = np.zeros(len(rank), np.int64)
    np.maximum(np.append(lcp, 0), np.insert(lcp, 0, 0), out=shared)
    near, found = shared[rank] >= SHORTEST, {}
    minimum = RangeMinimum(lcp)
    for order in (rank, len(rank) - 1 - rank):
        ends = np.array(next_smaller(order.tolist()))
        i = np.flatnonzero(near & (ends < len(rank)))
        j = ends[i]
        right = minimum.of(np.minimum(rank[i], rank[j]), np.maximum(rank[i], rank[j]))
        on = right >= _least(j - i) - 2 * (j - i) + 1
        for x, y, z in zip(i[on].tolist(), j[on].tolist(), (j + right)[on].tolist(), strict=True):
            key = (z, y - x)
            found[key] = min(x, found.get(key, x))
    out = []
    for (end, q), i in found.items():
        most = min(i, q - 1)
        differ = np.flatnonzero(chars[i - most : i] != chars[i + q - most : i + q])
        start = i - most + (int(differ[-1]) + 1 if len(differ) else 0)
        if end - start >= _least(q):
            out.append((start, end - start, q))
    return sorted(out, key=lambda r: (r[0], r[2]))


def batch_runs(texts: list[list]) -> list[list[tuple[int, int, int]]]:
    """The runs of each of several lists of words."""
    parts, starts, at = [], [], 0
    for t, words in enumerate(texts):
        number: dict = {}
        own = np.fromiter((number.setdefault(w, len(number) + 1) for w in words), np.int64, len(words))
        parts += [own, np.zeros(1, np.int64)]
        parts[-2] += t << 32
        parts[-1] += t << 32
        starts.append(at)
        at += len(words) + 1
    chars = np.concatenate(parts) if parts else np.empty(0, np.int64)
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    if len(chars) < 2:
        return out
    levels = suffix_ranks(chars)
    _, lcp = common_prefixes(levels)
    rank = levels[-1].astype(np.int64)
    # Texts take up the same places in the batch and in its suffix array.
    edges = np.append(starts, at)
    for t in np.unique(np.searchsorted(edges, np.flatnonzero(lcp >= SHORTEST), side="right") - 1).tolist():
        a, b = int(edges[t]), int(edges[t + 1])
        out[t] = runs_of(chars[a:b], rank[a:b] - a, lcp[a : b - 1])
    return out


def collapsed(words: list, runs: list[tuple[int, int, int]]) -> list:
    """The words without those that any run has after its first period."""
    if not runs:
        return words
    keep = np.ones(len(words), bool)
    for start, length, q in runs:
        keep[start + q : start + length] = False
    return [words[i] for i in np.flatnonzero(keep).tolist()]


_OUT = pa.schema([
    ("row", pa.int64()), ("n_words", pa.int64()),
    ("runs", pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))),
    ("collapsed_text", pa.string()),
])


def _found(batches):
    for ids, texts in chunks(batches, ["doc_id", "text"], "text", most_bytes=2 << 20):
        words = [t.encode().split() if t else [] for t in texts]
        runs = batch_runs(words)
        left = [b" ".join(collapsed(w, r)) for w, r in zip(words, runs, strict=True)]
        rows = [[dict(zip(("start", "length", "period"), r, strict=True)) for r in of] for of in runs]
        columns = [ids, [len(w) for w in words], rows, left]
        arrays = [pa.array(c, t) for c, t in zip(columns, _OUT.types, strict=True)]
        yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", *_OUT.names[1:]])


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each input row: doc_id, n_words, runs, collapsed_text.

    Words are runs of anything but ASCII white space, numbered from 0. runs lists every stretch with smallest period q, of
    max(24, 3q) words or more, that no neighbouring word extends: start, length, period, by start then period.
    collapsed_text is the words, joined by one space, that no run has after its first q. Null and empty texts have no words, no
    runs and an empty text; ids may be null, repeat, and be of any type that casts to long; other columns are
    ignored; an empty table gives an empty result. Nothing shuffles; a worker holds 2 MB of texts at a time, or one longer
    one, and some 300 bytes a word of them.
    """
    modest_batches(docs.sparkSession)
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    return rows.mapInArrow(
        _found,
        "doc_id long, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed_text string",
    )


def planted(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) with every tenth text, by the checksum of its id, made periodic from some word on: of n words,
    word a + i becomes word a + i % p, where a = g % n and p = 1 + (n - a) div (3 + g % 8) for g, a tenth of the checksum.
    Null ids and texts without words stay as they are."""
    h = F.crc32(F.encode(F.col("doc_id").cast("string"), "UTF-8"))
    words = "regexp_extract_all(text, '[^\\\\x20\\\\x09-\\\\x0D]+', 0)"
    folded = F.expr(
        f"""aggregate(array({words}), '', (z, w) -> array_join(transform(w, (x, i) -> w[int(CASE
            WHEN i < _g % size(w) THEN i
            ELSE _g % size(w) + (i - _g % size(w)) % (1 + (size(w) - _g % size(w)) DIV (3 + _g % 8)) END)]), ' '))"""
    )
    some = docs.select("doc_id", "text", h.alias("_h")).withColumn("_g", F.expr("_h DIV 10"))
    periodic = (F.col("_h") % 10 == 0) & F.col("text").isNotNull()
    return some.select("doc_id", F.when(periodic, folded).otherwise(F.col("text")).alias("text"))


def run_digests(found: DataFrame) -> DataFrame:
    """The rows of periodic_runs as doc_id, n_runs, the run of greatest length / period (start, length, period,
    exponent_milli; of equals the first, then that of the smaller period), and digests of all runs and of what is left."""
    better = "l.length * r.period > r.length * l.period OR (l.length * r.period = r.length * l.period AND (l.start, l.period) < (r.start, r.period))"
    best = F.expr(
        f"array_sort(runs, (l, r) -> CASE WHEN l = r THEN 0 WHEN {better} THEN -1 ELSE 1 END)"
    )
    lines = F.expr("array_join(transform(runs, r -> concat(r.start, ',', r.length, ',', r.period, '\\n')), '')")
    return found.withColumn("best", F.get(best, F.lit(0))).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("best.start").alias("start"),
        F.col("best.length").alias("length"), F.col("best.period").alias("period"),
        F.expr("best.length * 1000 DIV best.period").alias("exponent_milli"), F.sha2(lines, 256).alias("runs_sha256"),
        F.sha2("collapsed_text", 256).alias("collapsed_sha256"),
    )
