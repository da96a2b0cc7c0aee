"""The search index over chunks: built once, kept, and asked by batches of queries, one Spark job a batch."""

from __future__ import annotations

import threading
from collections import OrderedDict
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import context
from ..operators import index as X
from .encoders import HashingEncoder

SCALE = 60.0
#: So many of the nearest vectors take part in a fusion.
NEAREST = 200
#: So many searches are remembered: chunks don't change under an index.
REMEMBERED = 256


@dataclass(frozen=True)
class Chunk:
    chunk_id: str
    patient_id: str
    ord: int
    kind: str
    date: str | None
    text: str
    meta: dict


@dataclass(frozen=True)
class Hit:
    chunk: Chunk
    score: float
    bm25_rank: int | None = None
    dense_rank: int | None = None
    via: str = "retrieved"

    def shown(self, n: int) -> dict:
        """As the n-th piece of evidence."""
        c = self.chunk
        return {
            "n": n, "chunk_id": c.chunk_id, "patient_id": c.patient_id, "kind": c.kind, "date": c.date,
            "text": c.text, "score": self.score, "bm25_rank": self.bm25_rank, "dense_rank": self.dense_rank,
            "via": self.via,
        }


class ChunkIndex:
    """Postings, term statistics and hashed vectors of all chunks. Statistics are global, also when a search is scoped to one
    patient. Ties go by chunk id."""

    def __init__(self, chunks: DataFrame, encoder=None):
        self.chunks = chunks.persist()
        self.n = self.chunks.count()
        self.posts = X.postings(self.chunks, "chunk_id", "text").persist()
        self.stats = X.corpus_stats(self.chunks, "text").persist()
        self.encoder = encoder or HashingEncoder()
        self.vectors = self.encoder.fit(self.chunks, "chunk_id", "text").persist()
        self.asof = self.chunks.agg(F.max("date")).first()[0] or "1970-01-01"
        self.remembered, self._lock = REMEMBERED, threading.Lock()
        self._held: OrderedDict[tuple, list[Hit]] = OrderedDict()

    def close(self) -> None:
        for df in (self.chunks, self.posts, self.stats, self.vectors):
            df.unpersist()
        self.encoder.close()
        self._held.clear()

    def _scope(self, patient_id: str | None) -> DataFrame | None:
        return None if patient_id is None else self.chunks.filter(
            F.col("patient_id") == patient_id
        ).select(F.col("chunk_id").alias("id"))

    def get(self, ids: list[str]) -> list[Chunk]:
        """Chunks by id, in the order asked for."""
        rows = self.chunks.filter(F.col("chunk_id").isin(ids)).collect() if ids else []
        found = {r["chunk_id"]: _chunk(r) for r in rows}
        return [found[i] for i in ids if i in found]

    def of_patient(self, patient_id: str) -> list[Chunk]:
        """One patient's chunks in order: bounded by one record."""
        return [_chunk(r) for r in self.chunks.filter(F.col("patient_id") == patient_id).orderBy("ord").collect()]

    def _ranks(self, asked: DataFrame, scope: DataFrame | None, mode: str, expand: bool) -> DataFrame:
        """qid, id, b, d, sim: lexical and dense ranks. asked(qid, text, patient_id): where a patient is named, only the
        patient's chunks are ranked; scope (id) says the same of all questions at once, and sooner."""
        lexical = dense = None
        if mode != "dense" and mode != "nearest":
            scores = X.bm25(self.posts, self.stats, X.query_terms(asked, "qid", "text", expand), scope)
            ranks = X.ranked(self._within(scores, asked, scope))
            lexical = ranks.select(
                "qid", "id", F.col("rank").alias("b"), F.lit(None).cast("long").alias("d"),
                F.lit(None).cast("double").alias("sim"),
            )
        if mode != "bm25":
            near = X.sparse_cosine(self.vectors, self.encoder.encode(asked, "qid", "text", expand), scope)
            ranks = X.ranked(self._within(near, asked, scope), NEAREST).filter("score > 0")
            dense = ranks.select(
                "qid", "id", F.lit(None).cast("long").alias("b"), F.col("rank").alias("d"),
                F.col("score").alias("sim"),
            )
        rows = lexical.unionByName(dense) if lexical is not None and dense is not None else lexical or dense
        return rows.groupBy("qid", "id").agg(F.max("b").alias("b"), F.max("d").alias("d"), F.max("sim").alias("sim"))

    def _within(self, scores: DataFrame, asked: DataFrame, scope: DataFrame | None) -> DataFrame:
        if scope is not None or asked.filter("patient_id is not null").isEmpty():
            return scores
        owner = self.chunks.select(F.col("chunk_id").alias("id"), F.col("patient_id").alias("_owner"))
        met = scores.join(F.broadcast(asked.select("qid", "patient_id")), "qid").join(owner, "id")
        return met.filter("patient_id is null or patient_id = _owner").select("qid", "id", "score")

    def _asked(self, mode: str, k: int, pairs: list[tuple[str, str | None]]) -> list[list[Hit]]:
        """Hits for each (text, patient), by one job."""
        spark, patients = self.chunks.sparkSession, {p for _, p in pairs}
        asked = spark.createDataFrame(
            [(i, t, p) for i, (t, p) in enumerate(pairs)], "qid int, text string, patient_id string",
        )
        scope = self._scope(next(iter(patients))) if len(patients) == 1 else None
        rows = self._ranks(asked, scope, mode, mode != "nearest")
        if mode == "nearest":
            found = X.ranked(rows.filter(F.col("d") < k).withColumn("score", F.col("sim")), k)
            return self._hits(found, len(pairs), lambda r: round(r["score"], 4), lambda r: r["rank"] + 1)
        part = lambda c: F.coalesce(1.0 / (F.lit(float(X.RRF_K)) + F.col(c)), F.lit(0.0))
        found = X.ranked(rows.withColumn("score", (part("b") + part("d")) * SCALE), k)
        return self._hits(found, len(pairs), lambda r: round(r["score"], 4), lambda r: r["d"])

    def find(self, mode: str, k: int, pairs: list[tuple[str, str | None]]) -> list[list[Hit]]:
        """Hits for each (text, patient): what was asked before from memory, all others by one job."""
        with self._lock:
            known = {x: self._held[mode, k, x] for x in pairs if (mode, k, x) in self._held}
            for x in known:
                self._held.move_to_end((mode, k, x))
        new = [x for x in dict.fromkeys(pairs) if x not in known]
        if new:
            known |= zip(new, self._asked(mode, k, new), strict=True)
            with self._lock:
                self._held |= {(mode, k, x): known[x] for x in new}
                while len(self._held) > self.remembered:
                    self._held.popitem(last=False)
        return [list(known[x]) for x in pairs]

    def search(self, texts: list[str], k: int, patient_id: str | None = None, mode: str = "hybrid") -> list[list[Hit]]:
        """The k best chunks for each text, by reciprocal ranks."""
        return self.find(mode, k, [(t, patient_id) for t in texts])

    def nearest(self, texts: list[str], k: int, patient_id: str | None = None) -> list[list[Hit]]:
        """The k nearest chunks to each text as it is, by cosine; their dense ranks count from 1."""
        return self.find("nearest", k, [(t, patient_id) for t in texts])

    def neighbours(self, ids: list[str]) -> list[Chunk]:
        """What stands beside the chunks in their records, in the order of the chunks."""
        seeds = self.chunks.sparkSession.createDataFrame([(i,) for i in ids], "chunk_id string")
        rows = context.neighbours(self.chunks, seeds, len(ids)).collect()
        return [_chunk(r) for r in sorted(rows, key=lambda r: (ids.index(r["seed"]), r["place"]))]

    def _hits(self, top: DataFrame, n: int, score, dense) -> list[list[Hit]]:
        met = top.join(self.chunks, top["id"] == self.chunks["chunk_id"])
        out: list[list[Hit]] = [[] for _ in range(n)]
        for r in sorted(met.collect(), key=lambda r: (r["qid"], r["rank"])):  # k rows a query
            out[r["qid"]].append(Hit(_chunk(r), score(r), r["b"], dense(r)))
        return out

    def similarity(self, ids: list[str]) -> dict[tuple[str, str], float]:
        """Cosines between the chunks of a small pool."""
        mine = self.vectors.filter(F.col("id").isin(ids))
        rows = mine.alias("a").join(mine.alias("b"), "bucket").groupBy(
            F.col("a.id").alias("i"), F.col("b.id").alias("j"),
        ).agg(F.sum(F.col("a.weight") * F.col("b.weight")).alias("s"))
        return {(r["i"], r["j"]): r["s"] for r in rows.collect()}


def _chunk(r) -> Chunk:
    return Chunk(r["chunk_id"], r["patient_id"], r["ord"], r["kind"], r["date"], r["text"], r["meta"].asDict())


def fuse(rankings: list[list[Hit]], k: int) -> list[Hit]:
    """Reciprocal rank fusion of short lists; a chunk keeps the attributes of its first hit."""
    total: dict[str, float] = {}
    first: dict[str, Hit] = {}
    for hits in rankings:
        for rank, h in enumerate(hits):
            key = h.chunk.chunk_id
            total[key] = total.get(key, 0.0) + 1 / (X.RRF_K + rank)
            first.setdefault(key, h)
    order = sorted(total, key=lambda c: (-round(total[c], 12), c))[:k]
    return [replace(first[c], score=round(total[c] * SCALE, 4)) for c in order]


def diversify(index: ChunkIndex, hits: list[Hit], k: int, weight: float = 0.7) -> list[Hit]:
    """Maximal marginal relevance over a pool: each pick weighs its score against its likeness to the picks before."""
    if len(hits) < 2:
        return hits[:k]
    top = max(h.score for h in hits) or 1.0
    like = index.similarity([h.chunk.chunk_id for h in hits])
    left, out = list(hits), []
    while left and len(out) < k:
        def gain(h: Hit) -> float:
            near = max((like.get((h.chunk.chunk_id, o.chunk.chunk_id), 0.0) for o in out), default=None)
            return h.score / top if near is None else weight * h.score / top - (1 - weight) * near
        best = max(left, key=gain)
        left.remove(best)
        out.append(best)
    return out
