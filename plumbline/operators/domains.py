"""Domains of values that the driver has to know: few by their nature, and checked to be."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame

#: Values up to which a domain counts as one.
MOST = 10_000


def few(df: DataFrame, value: str | Column, most: int = MOST) -> list:
    """The distinct values of a column that aren't null, in order; more than most raise ValueError."""
    rows = df.select(value).toDF("v").filter("v IS NOT NULL").distinct().limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} distinct values: this is no domain")
    return sorted(r["v"] for r in rows)
