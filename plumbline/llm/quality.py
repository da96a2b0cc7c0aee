"""Quality scores by pairwise ranking.

Each text has a strength, a weighted sum of its features, and a better text is preferred to a worse one with
probability sigmoid(difference of strengths). Weights are learned by logistic loss on feature differences of
preference pairs. The threshold is a quantile of the strengths of labelled texts: the one below which lies the
share of worse ones. The score is the sigmoid of what a strength has over the threshold.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, modest_batches, spare

#: Quantile bins that each raw feature is cut into; a text's features are its bins.
BINS = 12


def _classes() -> np.ndarray:
    """For each byte: 0 lower case, 1 upper case, 2 digit, 3 space, 4 line end, 5 sentence marks, 6 other ASCII
    marks, 7 beyond ASCII."""
    out = np.full(256, 6, np.uint8)
    out[97:123], out[65:91], out[48:58], out[[32, 9, 11, 12, 13]], out[10], out[128:] = 0, 1, 2, 3, 4, 7
    for c in b".,;:?'\"-()":
        out[c] = 5
    return out


_CLASS = _classes()
NAMES = [
    "log_bytes", "upper", "digit", "space", "lines", "stops", "marks", "beyond", "log_words", "word_len", "distinct",
    "top_word", "repeat_next", "pair_distinct", "marked_words", "capital_words", "line_distinct", "short_lines",
    "top_mark", "longest_word",
]


def features(text: str | None) -> list[float]:
    """Raw features of a whole text; an empty one has zeros."""
    if not text:
        return [0.0] * len(NAMES)
    raw = text.encode()
    b = np.frombuffer(raw, np.uint8)
    n = len(b)
    hist = np.bincount(b, minlength=256)
    share = np.bincount(_CLASS, weights=hist, minlength=8) / n
    words = raw.split()
    m = max(1, len(words))
    counts = Counter(words)
    pairs = list(zip(words, words[1:], strict=False))
    lines = [x for x in raw.split(b"\n") if x.strip()]
    marks = hist[_CLASS == 6]
    ends = sum(not w[-1:].isalnum() and w[-1] < 128 and w[-1] not in b".,;:?'\"-()" for w in words)
    return [
        math.log1p(n), share[1] / (
            share[0] + share[1] + 1e-9
        ), share[2], share[3], share[4], share[5], share[6], share[7],
        math.log1p(len(words)), sum(map(len, words)) / m, len(counts) / m**0.8, max(counts.values(), default=0) / m,
        sum(x == y for x, y in pairs) / m, len(set(pairs)) / max(1, len(pairs)), ends / m, sum(
            w.isupper() for w in words
        ) / m,
        len(set(lines)) / max(1, len(lines)), sum(
            len(x) < 40 for x in lines
        ) / max(1, len(lines)), float(marks.max()) / n, math.log1p(max(map(len, words), default=0)),
    ]


class PairwiseRanker:
    """Strengths over binned features, learned from pairs of a better and a worse text."""

    def __init__(self, seed: int = 5, ridge: float = 1.0, pairs: int = 60_000):
        self.seed, self.ridge, self.pairs = seed, ridge, pairs

    def _bins(self, x: np.ndarray) -> np.ndarray:
        cols = [np.eye(BINS)[np.searchsorted(e, x[:, i], side="right")] for i, e in enumerate(self.edges)]
        return np.hstack([*cols, (x - self.mean) / self.std])

    def fit(self, x: np.ndarray, y: np.ndarray) -> PairwiseRanker:
        self.edges = [np.quantile(c, np.arange(1, BINS) / BINS) if len(c) else np.zeros(BINS - 1) for c in x.T]
        self.mean, self.std = (x.mean(0), x.std(0) + 1e-9) if len(x) else (np.zeros(x.shape[1]), np.ones(x.shape[1]))
        z = self._bins(x)
        self.w = np.zeros(z.shape[1])
        good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
        self.cut = 0.0
        if len(good) and len(bad):
            rng = np.random.default_rng(self.seed)
            n = min(self.pairs, len(good) * len(bad))
            better, worse = rng.choice(good, n), rng.choice(bad, n)
            for _ in range(12):  # Newton steps on the mean logistic loss of "better minus worse is positive"
                slope, curve = -self.ridge * self.w, self.ridge * np.eye(len(self.w))
                for i in range(0, n, 5000):  # differences are made a few thousand at a time
                    d = z[better[i : i + 5000]] - z[worse[i : i + 5000]]
                    p = 1 / (1 + np.exp(np.clip(d @ self.w, -30, 30)))
                    slope += d.T @ p
                    curve += (d * (p * (1 - p))[:, None]).T @ d
                step = np.linalg.solve(curve, slope)
                self.w += step
                if np.abs(step).max() < 1e-6:
                    break
            self.cut = float(np.quantile(z @ self.w, len(bad) / (len(bad) + len(good))))
        return self

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self._bins(x) @ self.w - self.cut, -30, 30)))


_RAW = pa.schema([("doc_id", pa.int64()), ("y", pa.int32()), ("x", pa.list_(pa.float64()))])


def _featured(batches):
    for ids, y, text in chunks(batches, ["doc_id", "y", "text"], "text"):
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(ids, pa.int64()), pa.array(y, pa.int32()),
                pa.array([features(t) for t in text], pa.list_(pa.float64()))
            ],
            schema=_RAW,
        )


def train(labelled: DataFrame, seed: int = 5) -> PairwiseRanker:
    """Fit on labelled(doc_id, y, text): the driver gets the features of its rows, so they have to be a bounded sample, as
    train_part makes it."""
    modest_batches(labelled.sparkSession)
    got = labelled.mapInArrow(_featured, "doc_id long, y int, x array<double>").orderBy("doc_id", "y", "x").toArrow()
    x = got.column("x").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, len(NAMES))
    return PairwiseRanker(seed).fit(x, got.column("y").to_numpy().astype(int))


def _scored(model, names: list[str], text_col: str, out: str):
    """Arrow batches with the score added as column out."""

    def run(batches):
        for batch in batches:
            parts = [
                model.value.score(np.array([features(t) for t in text], float).reshape(-1, len(NAMES)))
                for (text,) in chunks([batch], [text_col], text_col)
            ]
            arrays = [batch.column(batch.schema.get_field_index(n)) for n in names]
            yield pa.RecordBatch.from_arrays(
                [*arrays, pa.array(np.concatenate([np.empty(0), *parts]))], names=[*names, out],
            )

    return run


def score(docs: DataFrame, model: PairwiseRanker, text_col: str = "text", out: str = "score") -> DataFrame:
    """docs with a score (0 to 1) for each row in column out, from the whole text alone; an empty or null text is scored as
    such. A column of that name is replaced. Rows stand alone, nothing shuffles."""
    rows = docs.drop(out) if out in docs.columns and text_col != out else docs
    modest_batches(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(model)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInArrow(_scored(held, rows.columns, text_col, out), f"{schema}, `{out}` double")


def train_part(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_rows: int = 20_000,
    seed: int = 5,
) -> DataFrame:
    """(doc_id, y, text) of a sample of about max_rows labelled ids, those of the lowest digests, that may be learned from:
    crc32 of the id as text, modulo 3, isn't 1. The ids are drawn from the labels alone and broadcast, so that texts are
    read once and only the sample's move. An id with several labels counts as its best, with several texts as the first
    in their order; labels other than 0 and 1 are left out."""
    known = labels.filter(
        "doc_id is not null and quality in (0, 1)"
    ).groupBy(F.col("doc_id").alias("_l")).agg(F.max("quality").cast("int").alias("y"))
    known = known.filter(F.crc32(F.col("_l").cast("string").cast("binary")) % 3 != 1)
    n = known.count()
    if n > max_rows:
        known = known.filter(F.pmod(F.xxhash64("_l", F.lit(seed)), F.lit(1_000_000)) < int(1_000_000 * max_rows / n))
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
    )
    met = rows.join(F.broadcast(known), rows["doc_id"] == known["_l"], "inner")
    return met.groupBy("doc_id").agg(F.max("y").alias("y"), F.min("text").alias("text"))


def quality_scores(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_rows: int = 20_000,
) -> DataFrame:
    """One row for each input row: doc_id, held_out, score, predicted (1 from a score of 0.5).

    A bounded sample of labelled rows (max_rows, about) is learned from; all rows are scored. Where labels are
    missing, or of one kind, all scores are 0.5. A null id is held out of nothing (false). Repeated rows are scored
    alike. An empty table gives an empty result.
    """
    model = train(train_part(docs, labels, id_col, text_col, max_rows))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))
    return score(rows, model).select(
        "doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )


def keep_good(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_rows: int = 20_000,
) -> DataFrame:
    """docs, with all columns, whatever their names, without the rows whose score is below the threshold. Null and empty
    texts are scored as such; repeated rows stay or go alike; an empty table stays empty."""
    model = train(train_part(docs, labels, id_col, text_col, max_rows))
    name = spare(docs, "score")
    return score(docs, model, text_col, name).filter(F.col(name) >= 0.5).select(
        *[F.col(f"`{c}`") for c in docs.columns]
    )
