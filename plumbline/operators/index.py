"""Lexical and vector search over any table of (id, text): postings, BM25, hashed TF-IDF, fusion.

Everything takes a whole batch of queries. Postings are partitioned by term, query terms are broadcast only when
a count says that they are few, and statistics are always those of the whole corpus.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..scratch import materialise

K1, B = 1.4, 0.75
RRF_K = 60
#: Query rows up to which they are broadcast.
FEW = 200_000


def bounded(df: DataFrame, most: int) -> DataFrame:
    """df with a broadcast hint if it can't have more than FEW rows, else as it is."""
    return F.broadcast(df) if most <= FEW else df


def counted(toks: Column) -> Column:
    """(term, tf) structs of the distinct tokens of a sorted array: where each run of equal tokens starts, and how far the
    next one is. In proportion to the tokens, and within the row."""
    def run(start: Column, place: Column, starts: Column) -> Column:
        end = F.coalesce(F.get(starts, place + 1), F.size(toks))
        return F.struct(F.get(toks, start).alias("term"), (end - start).cast("long").alias("tf"))

    places = F.transform(toks, lambda t, i: F.when((i == 0) | (t != F.get(toks, i - 1)), i))
    return F.transform(F.array(F.array_compact(places)), lambda s: F.transform(s, lambda x, i: run(x, i, s)))[0]


def spread(rows: DataFrame) -> DataFrame:
    """rows as they are, unless they come from so few files and splits that most cores would have nothing to do: only then are
    they dealt out."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    if len(rows.inputFiles()) >= cores or rows.rdd.getNumPartitions() >= cores:
        return rows
    return rows.repartition(cores)


def _counts(docs: DataFrame, id_col: str, text_col: str, of) -> DataFrame:
    """id, len, term, tf: texts are counted in their rows, so that none of them is shuffled."""
    rows = spread(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("_t")))
    rows = T.once(rows, toks=T.tokens(F.col("_t"))).select("id", F.size("toks").cast("long").alias("len"), "toks")
    rows = T.once(rows, sorted=F.sort_array(of(F.col("toks")))).select("id", "len", "sorted")
    return rows.select("id", "len", F.explode(counted(F.col("sorted"))).alias("_c")).select(
        "id", "len", "_c.term", "_c.tf",
    )


def postings(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, len, term, tf: a row for each distinct term of each text."""
    return _counts(docs, id_col, text_col, lambda toks: toks)


def corpus_stats(docs: DataFrame, text_col: str) -> DataFrame:
    """One row: n texts and their average length in tokens (0 if there is none)."""
    return docs.agg(
        F.count(F.lit(1)).alias("n"),
        F.coalesce(F.avg(F.size(T.tokens(F.col(text_col)))), F.lit(0.0)).alias("avg_len"),
    )


def bm25_idf(n: Column, df: Column) -> Column:
    return F.log(1 + (n - df + 0.5) / (df + 0.5))


def query_terms(queries: DataFrame, qid_col: str, text_col: str, expand: bool = False) -> DataFrame:
    """qid, term: the distinct (synonym-expanded) terms of each query."""
    toks = T.tokens(F.col(text_col))
    return queries.select(
        F.col(qid_col).alias("qid"), F.explode(F.array_distinct(T.expanded(toks) if expand else toks)).alias("term"),
    )


def bm25(posts: DataFrame, stats: DataFrame, terms: DataFrame, scope: DataFrame | None = None) -> DataFrame:
    """qid, id, score for each text that has a term of the query. scope (id) restricts what is scored, not the
    statistics; so does an owner in both posts and terms, by which they are joined too. terms come from short
    queries, so that counting them is cheap; their frequencies are joined to them first, and then postings meet everything
    in one join."""
    n, on = terms.count(), ["term", "owner"] if "owner" in terms.columns else ["term"]
    # Only postings of asked terms are kept, once, for their frequencies and their scores.
    mine = materialise(posts.join(bounded(terms.select("term").distinct(), n), "term", "left_semi"), "postings")
    dfs = mine.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    weighed = terms.join(dfs, "term").crossJoin(F.broadcast(stats)).select(
        "qid", *on, bm25_idf(F.col("n"), F.col("df")).alias("idf"),
        F.coalesce(F.nullif("avg_len", F.lit(0.0)), F.lit(1.0)).alias("avg_len"),
    )
    rows = mine if scope is None else mine.join(scope, "id", "left_semi")
    joined = rows.join(bounded(weighed, n), on)
    norm = K1 * (1 - B + B * F.col("len") / F.col("avg_len"))
    part = F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + norm)
    return joined.groupBy("qid", "id").agg(F.sum(part).alias("score"))


def ranked(scores: DataFrame, k: int | None = None, digits: int = 9) -> DataFrame:
    """scores with their 0-based rank within a query, by score and then id; ranks under k only. Scores are rounded
    first, so that the order doesn't hang on the order of summation. The limit is on the row number itself, by which Spark
    keeps k rows a query in each task before it shuffles any."""
    line = Window.partitionBy("qid").orderBy(F.col("score").desc(), F.col("id"))
    rows = scores.withColumn("score", F.round("score", digits)).withColumn("rank", F.row_number().over(line))
    rows = rows if k is None else rows.filter(F.col("rank") <= k)
    return rows.withColumn("rank", F.col("rank").cast("long") - 1)


def feature_counts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, feature, tf over unigrams and bigrams."""
    return _counts(docs, id_col, text_col, T.features).select("id", F.col("term").alias("feature"), "tf")


def _blake(dim: int):
    """Bucket and sign from eight bytes of BLAKE2b, read as one big-endian number: its remainder, and its highest bit."""
    def digits(features: pd.Series) -> pd.DataFrame:
        data = b"".join(hashlib.blake2b(f.encode(), digest_size=8).digest() for f in features)
        h = np.frombuffer(data, ">u8").astype(np.uint64)
        sign = np.where(h >> np.uint64(63) == 1, 1.0, -1.0)
        return pd.DataFrame({"bucket": (h % np.uint64(dim)).astype(np.int32), "sign": sign})

    return F.pandas_udf(digits, "struct<bucket:int,sign:double>")


def placed(features: DataFrame, dim: int, digest: str = "md5") -> DataFrame:
    """features with the bucket and sign that the digest of each feature gives. MD5 stays in the JVM, and SQL can check it;
    blake2b goes through Arrow, and gives the vectors of indexes made with it."""
    if digest == "blake2b":
        rows = features.withColumn("_at", _blake(dim)("feature"))
        return rows.select("*", "_at.bucket", "_at.sign").drop("_at")
    if digest != "md5":
        raise ValueError(f"no digest {digest}: md5 or blake2b")
    d = F.md5("feature")
    bucket = F.pmod(F.conv(F.substring(d, 1, 15), 16, 10).cast("long"), F.lit(dim)).cast("int")
    sign = F.when(F.conv(F.substring(d, 16, 1), 16, 10).cast("int") >= 8, -1.0).otherwise(1.0)
    return features.select("*", bucket.alias("bucket"), sign.alias("sign"))


def hashed(weighted: DataFrame) -> DataFrame:
    """(id, bucket, weight) from (id, tf, idf, bucket, sign) of features. One shuffle by id serves the sums and the norms."""
    rows = weighted.select("id", "bucket", (F.col("sign") * (1 + F.log("tf")) * F.col("idf")).alias("_w"))
    sums = rows.repartition("id").groupBy("id", "bucket").agg(F.sum("_w").alias("w"))
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy("id")))
    return sums.select(
        "id", "bucket", (F.col("w") / F.coalesce(F.nullif(norm, F.lit(0.0)), F.lit(1.0))).alias("weight"),
    )


def encode(
    queries: DataFrame, qid_col: str, text_col: str, idf: DataFrame, n: int, dim: int = 1024, expand: bool = True,
    digest: str = "md5",
) -> DataFrame:
    """(qid, bucket, weight) of queries; features that no text has get the weight of a frequency of 0."""
    toks = T.tokens(F.col(text_col))
    rows = queries.select(
        F.col(qid_col).alias("id"), F.explode(T.features(T.expanded(toks) if expand else toks)).alias("feature"),
    )
    tf = rows.groupBy("id", "feature").agg(F.count(F.lit(1)).alias("tf"))
    most = tf.count()  # of queries only
    # What is asked for is looked up first, so that no other feature is counted or shuffled for it.
    asked = idf.join(F.broadcast(tf.select("feature")), "feature", "left_semi") if most <= FEW else idf
    met = asked.join(bounded(tf, most), "feature", "right").withColumn(
        "idf", F.coalesce("idf", F.log(F.lit(n + 1.0)) + 1),
    )
    return bounded(hashed(placed(met, dim, digest)).withColumnRenamed("id", "qid"), most)


def sparse_cosine(vectors: DataFrame, queries: DataFrame, scope: DataFrame | None = None) -> DataFrame:
    """qid, id, score: dot products of unit vectors (id, bucket, weight) that share a bucket, and an owner where queries have
    one, with a query's, which carry a broadcast hint where they are few."""
    on = ["bucket", "owner"] if "owner" in queries.columns else ["bucket"]
    rows = vectors if scope is None else vectors.join(scope, "id", "left_semi")
    return rows.join(
        queries.withColumnRenamed("weight", "_w"), on,
    ).groupBy("qid", "id").agg(F.sum(F.col("weight") * F.col("_w")).alias("score"))


#: Dense queries that go by one broadcast: some 10 MB of them.
DENSE_BLOCK = 20_000


def dense_cosine(vectors: DataFrame, queries: DataFrame, when: Column | None = None) -> DataFrame:
    """qid, id, score of dense vectors (id, vector) against queries(qid, qvector): a stated query set against all rows, never
    all pairs. when restricts what is scored. Many queries are cut into blocks by their ids, each of which is broadcast
    by itself."""
    n = queries.count()
    blocks = max(1, -(-n // DENSE_BLOCK))
    out = None
    for b in range(blocks):
        part = queries if blocks == 1 else queries.filter(F.pmod(F.xxhash64("qid"), F.lit(blocks)) == b)
        met = vectors.join(F.broadcast(part), F.lit(True) if when is None else when)
        scored = met.select("qid", "id", T.dot(F.col("vector"), F.col("qvector")).alias("score"))
        out = scored if out is None else out.unionByName(scored)
    return out


#: Rows of a block of vectors, and of a block of queries: their product is one task's matrix.
DENSE_ROWS, DENSE_QUERIES = 8192, 512


def _best(k: int, digits: int, others: bool):
    """A reader of pairs of blocks: for each query of a block the rows that can be among its k best of the other block. The matrix
    product says which come near; those are summed again in the order of T.dot, so that their scores are the same."""
    step = 10.0**digits

    def codes(left, right) -> tuple[np.ndarray, np.ndarray]:
        known = {v: i for i, v in enumerate(set(left) - {None})}
        return np.array([known.get(v, -1) for v in left]), np.array([known.get(v, -2) if v is not None else -2 for v in right])

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                row = {c: batch.column(c).slice(i, 1).flatten() for c in batch.schema.names}
                ids, qids = row["ids"], row["qids"]
                v = row["flat"].to_numpy(zero_copy_only=False).reshape(len(ids), -1)
                q = row["qflat"].to_numpy(zero_copy_only=False).reshape(len(qids), -1)
                s = q @ v.T
                if "labels" in row:
                    mine, theirs = codes(row["labels"].to_pylist(), row["qlabels"].to_pylist())
                    s[theirs[:, None] != mine[None, :]] = -np.inf
                if others:
                    same = qids.to_numpy(zero_copy_only=False)[:, None] == ids.to_numpy(zero_copy_only=False)[None, :]
                    s[same] = -np.inf
                last = len(ids) - min(k, len(ids))
                norms = np.sqrt((q * q).sum(axis=1)) * np.sqrt((v * v).sum(axis=1).max())
                least = np.partition(s, last, axis=1)[:, last] - 1 / step - 1e-12 * norms
                at, to = np.nonzero((s >= least[:, None]) & (s > -np.inf))
                score = np.zeros(len(at))
                for d in range(v.shape[1]):
                    score += v[to, d] * q[at, d]
                shown = np.sign(score) * np.floor(np.abs(score) * step + 0.5)
                order = np.lexsort((to, -shown, at))
                at, to, score = at[order], to[order], score[order]
                kept = np.arange(len(at)) - np.searchsorted(at, at) < k
                yield pa.RecordBatch.from_arrays(
                    [qids.take(pa.array(at[kept])), ids.take(pa.array(to[kept])), pa.array(score[kept])],
                    ["qid", "id", "score"],
                )

    return run


def dense_top(
    vectors: DataFrame, queries: DataFrame, k: int, digits: int, scoped: bool = False, others: bool = False,
) -> DataFrame:
    """qid, id, score, rank: the k best of dense_cosine, of vectors (id, vector) and queries (qid, qvector). scoped: of rows
    whose label is the query's ql; others: of rows with another id. Rows and queries are dealt into blocks, and each pair of
    blocks is one matrix product, whose best k a query go on. What is no vector of finite numbers, of the common length,
    goes by dense_cosine."""
    double = lambda c: F.transform(c, lambda x: x.cast("double"))
    rows, asked = vectors.withColumn("vector", double("vector")), queries.withColumn("qvector", double("qvector"))
    dim = asked.agg(F.max(F.size("qvector"))).first()[0]
    sound = lambda c: F.coalesce(
        (F.size(c) == F.lit(dim)) & (F.size(c) > 0)
        & F.forall(c, lambda x: x.isNotNull() & (F.abs(x) < F.lit(float("inf")))), F.lit(False),
    )
    held, n = rows.withColumn("_ok", sound("vector")), asked.withColumn("_ok", sound("qvector"))
    some = held.agg(F.count(F.lit(1)), F.count_if("_ok")).first()
    wanted = n.agg(F.count(F.lit(1)), F.count_if("_ok")).first()
    when = (F.col("label") == F.col("ql")) if scoped else None
    if others:
        when = F.col("id") != F.col("qid")
    fine, good = held.filter("_ok").drop("_ok"), n.filter("_ok").drop("_ok")
    found = None
    if some[1] and wanted[1]:
        dealt = lambda key, many, most: F.pmod(F.xxhash64(key), F.lit(max(1, -(-many // most)))).alias("_b")
        packed = lambda df, many, most, key, vector, label: df.groupBy(dealt(key, many, most)).agg(
            F.sort_array(F.collect_list(F.struct(key, vector, *([label] if scoped else [])))).alias("s")
        )
        left = packed(fine, some[1], DENSE_ROWS, "id", "vector", "label").select(
            F.col("s.id").alias("ids"), F.flatten("s.vector").alias("flat"),
            *([F.col("s.label").alias("labels")] if scoped else []),
        )
        parts = max(1, -(-wanted[1] // DENSE_BLOCK))
        kinds = {**dict(good.dtypes), **dict(fine.dtypes)}
        for b in range(parts):
            part = good if parts == 1 else good.filter(F.pmod(F.xxhash64("qid", F.lit(1)), F.lit(parts)) == b)
            right = packed(part, -(-wanted[1] // parts), DENSE_QUERIES, "qid", "qvector", "ql").select(
                F.col("s.qid").alias("qids"), F.flatten("s.qvector").alias("qflat"),
                *([F.col("s.ql").alias("qlabels")] if scoped else []),
            )
            pairs = spread(left).crossJoin(F.broadcast(right))
            got = pairs.mapInArrow(_best(k, digits, others), f"qid {kinds['qid']}, id {kinds['id']}, score double")
            found = got if found is None else found.unionByName(got)
    odd = []
    if some[1] < some[0]:
        odd.append(dense_cosine(held.filter("not _ok").drop("_ok"), asked, when))
    if wanted[1] < wanted[0]:
        odd.append(dense_cosine(fine, n.filter("not _ok").drop("_ok"), when))
    for more in odd:
        found = more if found is None else found.unionByName(more)
    return ranked(dense_cosine(rows, asked, when) if found is None else found, k, digits)


def fused_top(scores: DataFrame, near: DataFrame, k: int, digits: int = 6, scale: float = 100.0) -> DataFrame:
    """The k best of the reciprocal fusion of two rankings: all texts with lexical scores, and near(qid, id, rank). No more is
    ranked than can matter. The best k by words alone are worth 1 / (RRF_K + k - 1) at least, so a text of rank r among the
    near that is worth less on its own needs a lexical rank under a bound that r gives; what is worth as much on its
    own (ranks under k) has its lexical rank counted: how many texts score better. Both rankings are used several times,
    and so are written first."""
    worth = 1 / (RRF_K + k - 1)
    most = max(k, math.ceil(1 / (worth - 1 / (RRF_K + k))) - RRF_K + 1)
    exact = materialise(scores.withColumn("score", F.round("score", digits)), "scores")
    near = materialise(near, "near")
    best = ranked(exact, most, digits).select("qid", "id", "rank")
    first = near.filter(F.col("rank") < k).select("qid", "id")
    few = k * near.select("qid").distinct().count()
    at = exact.join(bounded(first, few), ["qid", "id"]).select(
        "qid", F.col("id").alias("_id"), F.col("score").alias("_s"),
    )
    better = (F.col("score") > F.col("_s")) | ((F.col("score") == F.col("_s")) & (F.col("id") < F.col("_id")))
    beaten = exact.join(bounded(at, few), "qid").groupBy("qid", F.col("_id").alias("id"))
    lexical = best.unionByName(beaten.agg(F.sum(better.cast("long")).alias("rank"))).distinct()
    return ranked(fuse(lexical, near, scale=scale), k, digits)


def fuse(*rankings: DataFrame, scale: float = 100.0, carry: list[str] = ()) -> DataFrame:
    """qid, id, score: reciprocal rank fusion of rankings (qid, id, rank), first places adding 1/60. carry: columns of a text,
    the same in all rankings, that stay."""
    every = rankings[0].select("qid", "id", "rank", *carry)
    for r in rankings[1:]:
        every = every.unionByName(r.select("qid", "id", "rank", *carry))
    return every.groupBy("qid", "id").agg(
        (F.sum(1.0 / (F.lit(float(RRF_K)) + F.col("rank"))) * scale).alias("score"), *[F.first(c).alias(c) for c in carry],
    )
