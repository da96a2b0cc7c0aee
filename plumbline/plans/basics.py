"""Queries of the elementary operators: sets, strings, dates, numbers, arrays, shares, pivots, flattening."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from .queries import query, table


@query("""WITH c AS (SELECT DISTINCT c_nationkey AS k FROM customer WHERE c_acctbal > 9000), s AS (SELECT DISTINCT s_nationkey AS k FROM supplier WHERE s_acctbal > 5000)
SELECT 'both' AS part, k FROM (FROM c INTERSECT FROM s) UNION ALL SELECT 'customers only', k FROM (FROM c EXCEPT FROM s) UNION ALL SELECT 'either', k FROM (FROM c UNION FROM s)""")
def set_operations(spark, sf_dir) -> DataFrame:
    c = table(spark, sf_dir, "customer").filter("c_acctbal > 9000").select(F.col("c_nationkey").alias("k")).distinct()
    s = table(spark, sf_dir, "supplier").filter("s_acctbal > 5000").select(F.col("s_nationkey").alias("k")).distinct()
    parts = [("both", c.intersect(s)), ("customers only", c.subtract(s)), ("either", c.union(s).distinct())]
    out = [df.select(F.lit(name).alias("part"), "k") for name, df in parts]
    return out[0].unionByName(out[1]).unionByName(out[2])


@query("""SELECT c_custkey, upper(c_mktsegment) AS up, left(c_name, 4) || '…' AS cut, starts_with(c_name, 'Cust') AS pre, trim(c_name, 'C0#') AS bare, len(string_split(c_name, '#'))::BIGINT AS parts,
instr(c_name, '#')::BIGINT AS hash_at, regexp_replace(c_name, '[0-9]+', 'N', 'g') AS masked, printf('%s / %s', c_mktsegment, c_custkey::VARCHAR) AS label FROM customer""")
def string_functions(spark, sf_dir) -> DataFrame:
    n = F.col("c_name")
    return table(spark, sf_dir, "customer").select(
        "c_custkey", F.upper("c_mktsegment").alias("up"), F.concat(
            F.substring(n, 1, 4), F.lit("…"),
        ).alias("cut"), F.startswith(n, F.lit("Cust")).alias("pre"), F.btrim(n, F.lit("C0#")).alias("bare"), F.size(F.split(n, "#", -1)).cast("long").alias("parts"),
        F.instr(n, "#").cast("long").alias("hash_at"), F.regexp_replace(n, "[0-9]+", "N").alias(
            "masked"
        ), F.format_string("%s / %s", "c_mktsegment", F.col("c_custkey").cast("string")).alias("label"),
    )


@query("""WITH o AS (SELECT o_orderkey, o_orderdate::DATE AS d FROM orders)
SELECT o_orderkey, strftime(d, '%Y-%m-%d') AS iso, date_diff('day', DATE '1970-01-01', d)::BIGINT AS day_no, (d - 180)::DATE::VARCHAR AS before, (d + 90)::DATE::VARCHAR AS after,
year(d)::BIGINT AS y, make_date(year(d), 1, 1)::VARCHAR AS jan, make_date(year(d), 12, 31)::VARCHAR AS dec, -(strftime(d, '%Y%m%d')::BIGINT) AS sort_key FROM o""")
def date_functions(spark, sf_dir) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("d"))
    s = lambda c: c.cast("string")
    return rows.select(
        "o_orderkey", F.date_format("d", "yyyy-MM-dd").alias("iso"), F.datediff(
            "d", F.lit("1970-01-01").cast("date"),
        ).cast("long").alias("day_no"), s(F.date_sub("d", 180)).alias("before"), s(F.date_add("d", 90)).alias("after"), F.year("d").cast("long").alias("y"),
        s(F.make_date(F.year("d"), F.lit(1), F.lit(1))).alias("jan"), s(
            F.make_date(F.year("d"), F.lit(12), F.lit(31))
        ).alias("dec"), (-F.date_format("d", "yyyyMMdd").cast("long")).alias("sort_key"),
    )


@query("""SELECT p_partkey, round(ln(1 + p_size), 6) AS log_size, round(1 + ln(p_size), 6) AS tf, round(sqrt(p_retailprice), 6) AS root, abs(p_size - 25)::BIGINT AS off, round(least(greatest((p_retailprice - 1000) / 300, -3), 3), 6) AS clipped,
round(coalesce(p_retailprice / nullif(p_size - 10, 0), 0), 6) AS safe FROM part""")
def number_functions(spark, sf_dir) -> DataFrame:
    z, p = F.col("p_size"), F.col("p_retailprice")
    r = lambda c: F.round(c, 6)
    return table(spark, sf_dir, "part").select(
        "p_partkey", r(F.log1p(z)).alias("log_size"), r(
            1 + F.log(z)
        ).alias("tf"), r(F.sqrt(p)).alias("root"), F.abs(z - 25).cast("long").alias("off"),
        r(
            F.least(F.greatest((p - 1000) / 300, F.lit(-3.0)), F.lit(3.0))
        ).alias("clipped"), r(F.coalesce(F.try_divide(p, z - 10), F.lit(0.0))).alias("safe"),
    )


@query("""WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings)
SELECT vec_id, (list_position(v, list_max(v)) - 1)::BIGINT AS argmax, (list_position(v, list_min(v)) - 1)::BIGINT AS argmin, len(list_filter(v, lambda x: x > 0))::BIGINT AS positive, round(list_dot_product(v, v), 5) AS norm2,
round(list_sum(list_transform(range(1, len(v)), lambda i: v[i] * v[i + 1])), 5) AS neighbours, len(list_filter(v, lambda x: x > 0.5)) > 0 AS any_large FROM e""")
def array_functions(spark, sf_dir) -> DataFrame:
    v = F.col("v")
    rows = table(spark, sf_dir, "embeddings").select(
        "vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("v"),
    )
    at = lambda x: (F.array_position(v, x) - 1).cast("long")
    pairs = F.zip_with(F.slice(v, 1, F.size(v) - 1), F.slice(v, 2, F.size(v) - 1), lambda a, b: a * b)
    return rows.select(
        "vec_id", at(F.array_max(v)).alias("argmax"), at(F.array_min(v)).alias("argmin"), F.size(
            F.filter(v, lambda x: x > 0)
        ).cast("long").alias("positive"), F.round(T.dot(v, v), 5).alias("norm2"),
        F.round(
            F.aggregate(pairs, F.lit(0.0), lambda s, x: s + x), 5,
        ).alias("neighbours"), F.exists(v, lambda x: x > 0.5).alias("any_large"),
    )


@query("""WITH g AS (SELECT user_id, event_type, count(*) AS n, sum(value) AS s FROM events GROUP BY ALL)
SELECT user_id, event_type, round(n::DOUBLE / sum(n) OVER (PARTITION BY user_id), 6) AS share, round(n::DOUBLE / max(n) OVER (PARTITION BY user_id), 6) AS bar,
round(coalesce((s - min(s) OVER w) / nullif(max(s) OVER w - min(s) OVER w, 0), 0), 5) AS scaled FROM g WINDOW w AS (PARTITION BY user_id)""")
def shares_and_scaling(spark, sf_dir) -> DataFrame:
    w = Window.partitionBy("user_id")
    g = table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(
        F.count(F.lit(1)).alias("n"), F.sum("value").alias("s"),
    )
    low, high = F.min("s").over(w), F.max("s").over(w)
    return g.select(
        "user_id", "event_type", F.round(F.col("n") / F.sum("n").over(w), 6).alias("share"),
        F.round(F.col("n") / F.max("n").over(w), 6).alias("bar"),
        F.round(F.coalesce(F.try_divide(F.col("s") - low, high - low), F.lit(0.0)), 5).alias("scaled"),
    )
