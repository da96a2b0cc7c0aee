"""Queries over series of events, terms, conversations and vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.vocab import NORMAL_95, T_95
from ..operators import index as X
from ..operators import series as S
from .queries import _r, _toks, query, table

# ---------------------------------------------------------------- series of events


@query("""SELECT user_id, event_type, arg_max(value, (ts, event_id)) AS last_of_ties, arg_max(value, (ts, -event_id)) AS first_of_ties, max(ts)::DATE::VARCHAR AS day
FROM events GROUP BY user_id, event_type""")
def latest_per_key(spark, sf_dir):
    ev = table(spark, sf_dir, "events").select("user_id", "event_type", "ts", "event_id", "value")
    last = S.newest(ev, ["user_id", "event_type"], "ts", "event_id").select(
        "user_id", "event_type", F.col("value").alias("last_of_ties"), F.to_date("ts").cast("string").alias("day"),
    )
    first = S.newest(ev, ["user_id", "event_type"], "ts", "event_id", ties="first").select(
        "user_id", "event_type", F.col("value").alias("first_of_ties"),
    )
    return last.join(first, ["user_id", "event_type"])


@query("""WITH g AS (SELECT user_id, event_type, count(*) AS n, arg_min(value, (ts, event_id)) AS a, arg_max(value, (ts, event_id)) AS b FROM events GROUP BY ALL)
SELECT user_id, event_type, n, a AS first_value, b AS last_value, CASE WHEN n < 2 THEN 'insufficient data' WHEN a = 0 THEN 'stable'
  WHEN (b - a) / abs(a) > 0.08::DOUBLE THEN 'rising' WHEN (b - a) / abs(a) < -0.08::DOUBLE THEN 'falling' ELSE 'stable' END AS trend FROM g""")
def lab_trend(spark, sf_dir):
    return S.trends(table(spark, sf_dir, "events"), ["user_id", "event_type"], "ts", "event_id", "value")


_T95 = "MAP {" + ", ".join(f"{k}: {float(v)}::DOUBLE" for k, v in T_95.items()) + "}"


@query(f"""WITH e AS (SELECT user_id, event_type, date_diff('day', DATE '2024-01-01', ts::DATE)::DOUBLE AS x, value AS y FROM events),
g AS (SELECT user_id, event_type, count(*) AS n, regr_slope(y, x) AS b, regr_intercept(y, x) AS a, regr_sxx(y, x) AS sxx, regr_syy(y, x) AS syy, regr_sxy(y, x) AS sxy, avg(x) AS mx, max(x) AS lx
  FROM e GROUP BY ALL HAVING count(*) >= 4 AND regr_sxx(y, x) > 0),
h AS (SELECT *, lx + 90 AS x0, greatest(syy - sxy * sxy / sxx, 0) AS ss FROM g),
i AS (SELECT *, a + b * x0 AS p, coalesce({_T95}[n - 2], {NORMAL_95}::DOUBLE) * sqrt(ss / (n - 2)) * sqrt(1 + 1.0::DOUBLE / n + (x0 - mx) * (x0 - mx) / sxx) AS w FROM h)
SELECT user_id, event_type, n, round(p, 3) AS predicted, round(p - w, 3) AS low, round(p + w, 3) AS high, round(b * 30, 3) AS slope_per_30d,
  round(CASE WHEN syy > 0 THEN 1 - ss / syy ELSE 0 END, 4) AS r2, x0::BIGINT AS target_x FROM i""")
def ols_forecast(spark, sf_dir):
    ev = table(spark, sf_dir, "events").select(
        "user_id", "event_type",
        F.datediff(F.to_date("ts"), F.lit("2024-01-01").cast("date")).cast("double").alias("x"),
        F.col("value").alias("y"),
    )
    got = S.forecasts(ev, ["user_id", "event_type"], "x", "y", 90)
    return got.select(
        "user_id", "event_type", "n",
        *[_r(F.col(c), 3).alias(c) for c in ("predicted", "low", "high", "slope_per_30d")],
        _r(F.col("r2"), 4).alias("r2"), F.col("target_x").cast("long").alias("target_x"),
    )


@query("""WITH r AS (SELECT user_id, event_type, value, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS rn, count(*) OVER (PARTITION BY user_id, event_type) AS n FROM events),
m AS (SELECT user_id, event_type, median(value) AS med FROM r WHERE rn > 1 AND n >= 4 GROUP BY ALL),
d AS (SELECT user_id, event_type, any_value(med) AS med, median(abs(value - med)) * 1.4826::DOUBLE AS mad, stddev_pop(value) AS sd FROM r JOIN m USING (user_id, event_type) WHERE rn > 1 GROUP BY ALL)
SELECT user_id, event_type, round(med, 4) AS median, round(value, 4) AS last,
  round((value - med) / CASE WHEN mad <> 0 THEN mad WHEN sd <> 0 THEN sd ELSE 1e-9 END, 3) AS z,
  abs((value - med) / CASE WHEN mad <> 0 THEN mad WHEN sd <> 0 THEN sd ELSE 1e-9 END) > 3.5 AS flag
FROM d JOIN r USING (user_id, event_type) WHERE rn = 1""")
def robust_anomaly(spark, sf_dir):
    got = S.anomalies(table(spark, sf_dir, "events"), ["user_id", "event_type"], "ts", "event_id", "value")
    return got.select(
        "user_id", "event_type", _r(F.col("median"), 4).alias("median"), _r(F.col("last"), 4).alias("last"),
        _r(F.col("z"), 3).alias("z"), "flag",
    )


@query("""WITH d AS (SELECT o_custkey, o_orderkey, o_totalprice, o_orderdate::DATE AS day FROM orders),
r AS (SELECT *, dense_rank() OVER (PARTITION BY o_custkey ORDER BY day) AS p FROM d),
s AS (SELECT o_custkey, o_orderkey, round(o_totalprice * (1 + 0.5::DOUBLE * p / max(p) OVER (PARTITION BY o_custkey)), 8) AS score FROM r)
SELECT o_custkey, o_orderkey, score, row_number() OVER (PARTITION BY o_custkey ORDER BY score DESC, o_orderkey) AS place FROM s""")
def recency_weighted(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select(
        "o_custkey", "o_orderkey", "o_totalprice", F.to_date("o_orderdate").alias("day"),
    )
    rows = S.with_recency(rows, "day", ["o_custkey"]).select(
        "o_custkey", "o_orderkey", F.round(F.col("o_totalprice") * (1 + 0.5 * F.col("recency")), 8).alias("score"),
    )
    return rows.withColumn(
        "place",
        F.row_number().over(Window.partitionBy("o_custkey").orderBy(F.desc("score"), "o_orderkey")).cast("long"),
    )


@query(
    "SELECT o_orderkey, o_custkey, o_orderdate::DATE::VARCHAR AS day FROM orders WHERE o_orderdate::DATE BETWEEN (SELECT max(o_orderdate)::DATE - 180 FROM orders) AND (SELECT max(o_orderdate)::DATE FROM orders)"
)
def date_window(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.to_date("o_orderdate").alias("day"))
    return rows.crossJoin(F.broadcast(rows.agg(F.max("day").alias("asof")))).filter(
        F.col("day").between(F.date_sub("asof", 180), F.col("asof"))
    ).select("o_orderkey", "o_custkey", F.col("day").cast("string").alias("day"))


@query("""WITH r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS rank FROM events),
k AS (SELECT user_id, event_type, arg_max(event_id, (ts, -rank)) AS event_id, min(rank) AS first_rank FROM r GROUP BY ALL)
SELECT user_id, event_type, event_id, row_number() OVER (PARTITION BY user_id ORDER BY first_rank) AS place FROM k""")
def newest_per_fact(spark, sf_dir):
    rows = table(spark, sf_dir, "events").withColumn(
        "rank", F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("value"), "event_id")),
    )
    kept = rows.groupBy("user_id", "event_type").agg(
        F.max_by("event_id", F.struct("ts", -F.col("rank"))).alias("event_id"), F.min("rank").alias("first_rank"),
    )
    return kept.select(
        "user_id", "event_type", "event_id",
        F.row_number().over(Window.partitionBy("user_id").orderBy("first_rank")).cast("long").alias("place"),
    )


# ---------------------------------------------------------------- terms and conversations


@query(rf"""WITH u AS (SELECT doc_id, term, count(*) AS c FROM (SELECT doc_id, unnest({_toks()}) AS term FROM documents) GROUP BY ALL)
SELECT term, sum(c)::BIGINT AS mentions, count(*)::BIGINT AS n_docs, max(doc_id) AS last_doc FROM u GROUP BY term""")
def term_counts(spark, sf_dir):
    """Every term of the documents, with its mentions."""
    rows = table(spark, sf_dir, "documents").select(
        "doc_id", F.explode(T.tokens(F.col("text"))).alias("term"),
    ).groupBy("doc_id", "term").agg(F.count(F.lit(1)).alias("c"))
    return rows.groupBy("term").agg(
        F.sum("c").alias("mentions"), F.count(F.lit(1)).alias("n_docs"), F.max("doc_id").alias("last_doc"),
    )


# ---------------------------------------------------------------- JSON


@query("SELECT event_id, json_extract_string(props, '$.k')::BIGINT AS k FROM events")
def json_extract(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))


# ---------------------------------------------------------------- similarity and evaluation


_SIM = """WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v, label FROM embeddings),
s AS (SELECT a.vec_id AS vec_id, b.vec_id AS other, a.label = b.label AS same, round(list_cosine_similarity(a.v, b.v), 5) AS score FROM e a, e b WHERE a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id)"""


def _similar(spark, sf_dir) -> DataFrame:
    emb = table(spark, sf_dir, "embeddings")
    unit = F.transform("embedding", lambda x: x.cast("double") / F.col("norm"))
    rows = T.once(emb, norm=F.sqrt(T.dot(F.col("embedding"), F.col("embedding")))).select(
        F.col("vec_id").alias("id"), unit.alias("vector"), "label",
    )
    asked = rows.filter("id % 50 = 0").select(
        F.col("id").alias("qid"), F.col("vector").alias("qvector"), F.col("label").alias("ql"),
    )
    near = X.dense_top(rows, asked, 5, 5, others=True)
    labels = emb.select("vec_id", "label")
    met = near.join(labels.toDF("qid", "ql"), "qid").join(labels.toDF("id", "label"), "id")
    return met.select(
        F.col("qid").alias("vec_id"), F.col("id").alias("other"), (F.col("label") == F.col("ql")).alias("same"),
        "score", "rank",
    )


@query(
    f"{_SIM} SELECT vec_id, other, same, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY score DESC, other) - 1 AS rank FROM s) WHERE rank < 5"
)
def nearest_vectors(spark, sf_dir):
    return _similar(spark, sf_dir)


@query("""WITH t AS (SELECT o_custkey AS c, list_sort(list_distinct(list(o_orderpriority))) AS p FROM orders GROUP BY o_custkey),
n AS (SELECT c_custkey AS c, c_nationkey, lead(c_custkey) OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS d FROM customer)
SELECT n.c AS a, n.d AS b, array_to_string(list_sort(list_intersect(x.p, y.p)), ',') AS shared FROM n JOIN t x ON x.c = n.c JOIN t y ON y.c = n.d""")
def shared_items(spark, sf_dir):
    t = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c")).agg(
        F.collect_set("o_orderpriority").alias("p")
    )
    n = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("a"),
        F.lead("c_custkey").over(Window.partitionBy("c_nationkey").orderBy("c_custkey")).alias("b"),
    )
    met = n.join(
        t.select(F.col("c").alias("a"), F.col("p").alias("pa")), "a",
    ).join(t.select(F.col("c").alias("b"), F.col("p").alias("pb")), "b")
    return met.select("a", "b", F.array_join(F.array_sort(F.array_intersect("pa", "pb")), ",").alias("shared"))


@query(f"""{_SIM}, r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY score DESC, other) AS rank FROM s),
q AS (SELECT vec_id, min(CASE WHEN same THEN rank END) AS first FROM r WHERE rank <= 5 GROUP BY vec_id)
SELECT count(*)::BIGINT AS n, round(avg(CASE WHEN first IS NULL THEN 0.0::DOUBLE ELSE 1 END), 4) AS recall_at_5, round(avg(coalesce(1.0::DOUBLE / first, 0)), 4) AS mrr FROM q""")
def eval_recall_mrr(spark, sf_dir):
    first = _similar(spark, sf_dir).groupBy("vec_id").agg(
        F.min(F.when(F.col("same"), F.col("rank") + 1)).alias("first")
    )
    return first.agg(
        F.count(F.lit(1)).alias("n"),
        F.round(F.avg(F.col("first").isNotNull().cast("double")), 4).alias("recall_at_5"),
        F.round(F.avg(F.coalesce(1.0 / F.col("first"), F.lit(0.0))), 4).alias("mrr"),
    )


@query("""WITH t AS (SELECT d.source, d.doc_id, l.quality = 0 AS truth, length(regexp_replace(coalesce(d.text, ''), '[^!$%&*#|]', '', 'g')) * 50 > length(coalesce(d.text, '')) AS pred FROM documents d JOIN labels l USING (doc_id)),
c AS (SELECT source, sum((truth AND pred)::INT) AS tp, sum(pred::INT) AS p, sum(truth::INT) AS a FROM t GROUP BY source)
SELECT source, tp::BIGINT AS tp, round(CASE WHEN p > 0 THEN tp::DOUBLE / p ELSE 0 END, 4) AS prec, round(CASE WHEN a > 0 THEN tp::DOUBLE / a ELSE 0 END, 4) AS rec, round(CASE WHEN p + a > 0 THEN 2.0::DOUBLE * tp / (p + a) ELSE 0 END, 4) AS f1 FROM c""")
def eval_set_f1(spark, sf_dir):
    text = F.coalesce("text", F.lit(""))
    odd = F.length(F.regexp_replace(text, "[^!$%&*#|]", "")) * 50 > F.length(text)
    rows = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id").select(
        "source", (F.col("quality") == 0).cast("int").alias("t"), odd.cast("int").alias("p"),
    )
    c = rows.groupBy("source").agg(
        F.sum(F.col("t") * F.col("p")).alias("tp"), F.sum("p").alias("p"), F.sum("t").alias("a"),
    )
    share = lambda top, n: F.round(F.coalesce(F.try_divide(top.cast("double"), n), F.lit(0.0)), 4)
    return c.select(
        "source", "tp", share(F.col("tp"), F.col("p")).alias("prec"), share(F.col("tp"), F.col("a")).alias("rec"),
        share(2 * F.col("tp"), F.col("p") + F.col("a")).alias("f1"),
    )
