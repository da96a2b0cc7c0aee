"""Exact medians without lists, also for keys of very many values."""

import random
from statistics import median

import pytest

from plumbline.operators import series


@pytest.mark.parametrize("listed", [1_000_000, 20])
def test_medians_are_exact(spark, monkeypatch, listed):
    monkeypatch.setattr(series, "LISTED", listed)
    monkeypatch.setattr(series, "BINS", 64)
    rng = random.Random(2)
    values = {
        "normal": [rng.gauss(0, 1) for _ in range(501)], "even": [rng.random() for _ in range(400)],
        "equal": [3.5] * 100, "two": [rng.random() * 1e-9 for _ in range(150)] + [1 + rng.random() * 1e-9 for _ in range(150)],
        "ties": [float(rng.randint(0, 3)) for _ in range(300)], "wide": [10.0 ** rng.randint(-300, 300) for _ in range(201)],
        "huge": [1.7e308, -1.7e308] * 60 + [0.0], "few": [2.0, 1.0], "one": [7.0],
    }
    rows = [(k, v) for k, vs in values.items() for v in vs] + [("one", None), ("none", None)]
    rng.shuffle(rows)
    got = series.medians(spark.createDataFrame(rows, "k string, v double"), ["k"], "v").collect()
    assert {r["k"]: r["median"] for r in got} == {k: pytest.approx(median(v), rel=1e-15) for k, v in values.items()}


def test_anomalies_keep_no_lists_and_count_repeated_last_rows(spark, monkeypatch):
    rows = [("a", d, i, float(v)) for i, (d, v) in enumerate([("d1", 1), ("d2", 2), ("d3", 3), ("d4", 50)])]
    rows += [("b", "d9", 5, 4.0)] * 4 + [("c", "d1", 1, 1.0)] * 3
    df = spark.createDataFrame(rows, "k string, d string, o int, v double")
    got = {r["k"]: r for r in series.anomalies(df, ["k"], "d", "o", "v").collect()}
    assert set(got) == {"a", "b"} and (got["a"]["median"], got["a"]["last"], got["a"]["flag"]) == (2.0, 50.0, True)
    assert (got["b"]["median"], got["b"]["z"], got["b"]["flag"]) == (4.0, 0.0, False)
    plan = series.anomalies(df, ["k"], "d", "o", "v")._jdf.queryExecution().executedPlan().toString()
    assert "collect_list" not in plan
    monkeypatch.setattr(series, "LISTED", 2)
    assert {r["k"]: r for r in series.anomalies(df, ["k"], "d", "o", "v").collect()} == got
