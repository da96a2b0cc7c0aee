"""Queries that SQL can't express: diverse selection, clusters, maps, and event windows as a stream."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import index as X
from ..operators import similarity
from ..streaming import events as stream
from .queries import query, table


def _diverse(pool: pd.DataFrame, k: int, weight: float) -> pd.DataFrame:
    """Maximal marginal relevance within one query's pool of a few dozen rows."""
    pool = pool.sort_values(["score", "id"], ascending=[False, True]).reset_index(drop=True)
    v = np.stack(pool["vector"].to_numpy())
    rel = pool["score"].to_numpy() / (pool["score"].max() or 1.0)
    like, chosen = v @ v.T, [0]
    while len(chosen) < min(k, len(pool)):
        gain = weight * rel - (1 - weight) * like[:, chosen].max(axis=1)
        gain[chosen] = -np.inf
        chosen.append(int(np.argmax(gain)))
    return pd.DataFrame(
        {"qid": pool["qid"].iloc[0], "vec_id": pool["id"].iloc[chosen].to_numpy(), "place": np.arange(len(chosen))}
    )


@query()
def mmr_select(spark, sf_dir) -> DataFrame:
    """Ten diverse neighbours for every fiftieth vector, from its forty nearest."""
    emb = table(spark, sf_dir, "embeddings")
    asked = emb.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("qvector"))
    rows = emb.select(F.col("vec_id").alias("id"), F.transform("embedding", lambda x: x.cast("double")).alias("vector"))
    pool = X.dense_top(rows, asked, 40, 12).join(rows, "id").select("qid", "id", "score", "vector")
    return pool.groupBy("qid").applyInPandas(lambda p: _diverse(p, 10, 0.7), "qid long, vec_id long, place long")


@query()
def kmeans_clusters(spark, sf_dir) -> DataFrame:
    points = similarity.clustered(table(spark, sf_dir, "embeddings"), "embedding", "vec_id")
    return points.groupBy("cluster").agg(F.count(F.lit(1)).alias("size"), F.countDistinct("label").alias("labels"))


@query()
def pca_map(spark, sf_dir) -> DataFrame:
    return similarity.clustered(
        table(spark, sf_dir, "embeddings"), "embedding", "vec_id",
    ).select("vec_id", "cluster", "x", "y", "z")


@query(
    """SELECT event_type, time_bucket(INTERVAL 1 DAY, ts)::VARCHAR AS day, count(*)::BIGINT AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL"""
)
def daily_windows(spark, sf_dir) -> DataFrame:
    """The batch form of the streaming aggregate in plumbline.streaming."""
    got = stream.windowed(table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp")), "1 day")
    return got.select(
        "event_type", F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("day"), "n",
        F.round("total", 4).alias("total"),
    )


