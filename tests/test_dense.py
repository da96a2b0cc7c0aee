"""Dense searches by blocks against the plain join of all pairs."""

import pytest
from pyspark.sql import functions as F

from plumbline.operators import index as X

NAN = float("nan")


@pytest.mark.parametrize("mode", ["all", "scoped", "others"])
def test_blocks_give_the_rows_of_the_plain_join(spark, monkeypatch, mode):
    monkeypatch.setattr(X, "DENSE_ROWS", 16)
    monkeypatch.setattr(X, "DENSE_QUERIES", 3)
    plain = [(i, [((i * 7 + j * 3) % 11 - 5) / 4.0 for j in range(4)], i % 3 if i % 10 else None) for i in range(90)]
    copies = [(100 + i, plain[4][1], 1) for i in range(40)]
    odd = [(200, None, 1), (201, [1.0, None, 0.0, 1.0], 1), (202, [NAN, 1.0, 0.0, 0.0], 0), (203, [1.0, 2.0], 0), (204, [], 2), (205, [0.0] * 4, 1)]
    rows = spark.createDataFrame(plain + copies + odd, "id long, vector array<double>, label int")
    asked = rows.filter("id % 5 = 0 or id > 199").select(F.col("id").alias("qid"), F.col("vector").alias("qvector"), F.col("label").alias("ql"))
    when = {"all": None, "scoped": F.col("label") == F.col("ql"), "others": F.col("id") != F.col("qid")}[mode]
    want = X.ranked(X.dense_cosine(rows, asked, when), 7, digits=5)
    got = X.dense_top(rows, asked, 7, 5, scoped=mode == "scoped", others=mode == "others")
    key = lambda df: sorted(map(str, df.select("qid", "id", "score", "rank").collect()))
    assert key(got) == key(want)


def test_pairs_that_no_ranking_needs_stay_in_their_block(spark):
    rows = spark.range(2000).select("id", F.array(F.sin("id"), F.cos("id")).alias("vector"))
    asked = rows.filter("id % 50 = 0").select(F.col("id").alias("qid"), F.col("vector").alias("qvector"))
    plan = X.dense_top(rows, asked, 5, 5)._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "aggregate(zip_with" not in plan
