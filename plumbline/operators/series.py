"""Series of dated values per key: newest row, trend, linear forecast, robust anomaly, recency."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vocab import NORMAL_95, T_95
from ..scratch import materialise


def newest(df: DataFrame, keys: list[str], date: str, order: str, ties: str = "last") -> DataFrame:
    """The newest row of each key. Of equal dates the last in the given order counts, or the first. An aggregate, not
    a window: keys of many rows are reduced before they shuffle."""
    key = F.struct(F.col(date), F.col(order) if ties == "last" else -F.col(order))
    return df.groupBy(*keys).agg(
        F.max_by(F.struct(*[c for c in df.columns if c not in keys]), key).alias("_r")
    ).select(*keys, "_r.*")


def change(first: Column, last: Column, n: Column) -> Column:
    """insufficient data, stable, rising or falling, by a relative change of 8 %."""
    rel = (last - first) / F.abs(F.nullif(first, F.lit(0.0)))
    return F.when(
        n < 2, "insufficient data",
    ).when(first == 0, "stable").when(rel > 0.08, "rising").when(rel < -0.08, "falling").otherwise("stable")


def trends(df: DataFrame, keys: list[str], date: str, order: str, value: str) -> DataFrame:
    at = F.struct(F.col(date), F.col(order))
    got = df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.min_by(value, at).alias("first_value"),
        F.max_by(value, at).alias("last_value"),
    )
    return got.withColumn("trend", change(F.col("first_value"), F.col("last_value"), F.col("n")))


def forecasts(df: DataFrame, keys: list[str], x: str, y: str, horizon: float, least: int = 4) -> DataFrame:
    """Ordinary least squares of y on x (days) for each key, and its 95 % prediction interval at the last x plus the
    horizon. Keys of fewer than `least` points, or of one x only, are left out."""
    got = df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias(
            "intercept"
        ), F.regr_sxx(y, x).alias("sxx"),
        F.regr_syy(y, x).alias("syy"), F.regr_sxy(y, x).alias("sxy"), F.avg(x).alias("mx"), F.max(x).alias("last_x"),
    ).filter((F.col("n") >= least) & (F.col("sxx") > 0))
    dof = F.col("n") - 2
    table = F.create_map(*[v for k, t in T_95.items() for v in (F.lit(k).cast("long"), F.lit(float(t)))])
    rest = F.greatest(F.col("syy") - F.col("sxy") * F.col("sxy") / F.col("sxx"), F.lit(0.0))
    x0 = F.col("last_x") + F.lit(float(horizon))
    se = F.sqrt(rest / dof) * F.sqrt(1 + 1 / F.col("n") + (x0 - F.col("mx")) * (x0 - F.col("mx")) / F.col("sxx"))
    reach = F.coalesce(F.try_element_at(table, dof), F.lit(NORMAL_95)) * se
    at = F.col("intercept") + F.col("slope") * x0
    return got.select(
        *keys, "n", at.alias("predicted"), (at - reach).alias("low"), (at + reach).alias("high"), (
            F.col("slope") * 30
        ).alias("slope_per_30d"),
        F.when(F.col("syy") > 0, 1 - rest / F.col("syy")).otherwise(0.0).alias("r2"), x0.alias("target_x"),
    )


#: Values of a key up to which an aggregate may hold them all; bins of a histogram beyond that.
LISTED, BINS = 1_000_000, 4096


def medians(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """keys, median: the exact median of each key's values (nulls don't count; the mean of the middle two of an even number).

    Keys of up to LISTED values are aggregated. Of the others there are few (one in LISTED rows at most), and nothing ever
    holds their values: a histogram of BINS bins, counted on the map side, tells which bin the middle lies in, and the next
    histogram covers that bin only, until it holds few values or equal ones.
    """
    rows = df.select(*keys, F.col(value).cast("double").alias("_v")).filter("_v is not null")
    sizes = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
    hot = materialise(sizes.filter(F.col("_n") > LISTED), "hot")
    if hot.isEmpty():
        return rows.groupBy(*keys).agg(F.median("_v").alias("median"))
    names = F.broadcast(hot.select(*keys))
    few = rows.join(names, keys, "left_anti").groupBy(*keys).agg(F.median("_v").alias("median"))
    return few.unionByName(_selected(rows.join(names, keys, "left_semi"), keys, hot))


def _selected(rows: DataFrame, keys: list[str], hot: DataFrame) -> DataFrame:
    """Medians by refining histograms: _a and _b are the ranks of the middle values among those from _lo to _hi."""
    still = hot.select(
        *keys, "_n", "_lo", "_hi", F.expr("(_n - 1) div 2").alias("_a"), F.expr("_n div 2").alias("_b"),
    )
    known = None
    while True:
        met = rows.join(F.broadcast(still), keys).filter("_v between _lo and _hi")
        # Halves, as the difference of two doubles may be none.
        place = F.least(F.lit(BINS - 1), F.floor((F.col("_v") / 2 - F.col("_lo") / 2) / (F.col("_hi") / 2 - F.col("_lo") / 2) * BINS))
        place = F.when(F.col("_hi") / 2 > F.col("_lo") / 2, place).otherwise(0).cast("int")
        bins = met.groupBy(*keys, "_a", "_b", place.alias("_bin")).agg(
            F.count(F.lit(1)).alias("_n"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"),
        )
        line = Window.partitionBy(*keys).orderBy("_bin").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        bins = bins.withColumn("_upto", F.sum("_n").over(line)).withColumn("_before", F.col("_upto") - F.col("_n"))
        held = lambda rank: F.max(F.when(
            (F.col("_before") <= F.col(rank)) & (F.col(rank) < F.col("_upto")), F.struct("_bin", "_before", "_n", "_lo", "_hi"),
        ))
        both = materialise(bins.groupBy(*keys, "_a", "_b").agg(held("_a").alias("x"), held("_b").alias("y")), "bins")
        apart, flat = F.col("x._bin") != F.col("y._bin"), F.col("x._lo") == F.col("x._hi")
        done = both.filter(apart | flat).select(*keys, (F.col("x._hi") / 2 + F.col("y._lo") / 2).alias("median"))
        known = done if known is None else known.unionByName(done)
        more = lambda c: F.col(c) - F.col("x._before")
        still = both.filter(~(apart | flat)).select(*keys, "x._n", "x._lo", "x._hi", more("_a").alias("_a"), more("_b").alias("_b"))
        if still.filter(F.col("_n") > LISTED).isEmpty():
            break
    rest = rows.join(F.broadcast(still), keys).filter("_v between _lo and _hi").groupBy(*keys, "_a", "_b").agg(
        F.sort_array(F.collect_list("_v")).alias("s")
    )
    at = lambda rank: F.get("s", F.col(rank).cast("int"))
    return known.unionByName(rest.select(*keys, (at("_a") / 2 + at("_b") / 2).alias("median")))


def anomalies(
    df: DataFrame, keys: list[str], date: str, order: str, value: str, threshold: float = 3.5, least: int = 4,
) -> DataFrame:
    """How far each key's last value is from its history, in scaled median absolute deviations; where that is 0, in
    standard deviations of the history, or else in billionths. Null values don't count. No key's history is held as a
    list: see medians."""
    rows = df.select(
        *keys, F.struct(F.col(date), F.col(order), F.col(value).cast("double").alias("v")).alias("_at"),
        F.col(value).cast("double").alias("_v"),
    ).filter("_v is not null")
    last = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.max("_at").alias("_last")).filter(F.col("_n") >= least)
    met = rows.join(last, keys)
    # Rows that repeat the last one belong to its history, but for one of them.
    again = met.filter("_at = _last").groupBy(*keys).agg(F.max("_v").alias("_v"), F.count(F.lit(1)).alias("_m"))
    again = again.select(*keys, "_v", F.explode(F.expr("array_repeat(0, cast(_m - 1 as int))")).alias("_")).drop("_")
    history = materialise(met.filter("_at < _last").select(*keys, "_v").unionByName(again), "history")
    middle = medians(history, keys, "_v")
    off = history.join(middle, keys).select(*keys, F.abs(F.col("_v") - F.col("median")).alias("_v"))
    spread = medians(off, keys, "_v").withColumnRenamed("median", "_mad")
    std = history.groupBy(*keys).agg(F.stddev_pop("_v").alias("_std"))
    got = last.join(middle, keys).join(spread, keys).join(std, keys).withColumn("last", F.col("_last.v"))
    mad = F.col("_mad") * 1.4826
    scale = F.when(mad != 0, mad).when(F.col("_std") != 0, F.col("_std")).otherwise(1e-9)
    return got.withColumn("z", (F.col("last") - F.col("median")) / scale).select(
        *keys, "median", "last", "z", (F.abs("z") > threshold).alias("flag"),
    )


def with_recency(df: DataFrame, date: str, over: list[str], name: str = "recency") -> DataFrame:
    """df with a date's place among the distinct dates of its group, from 1/n to 1; 0 without a date."""
    line = Window.partitionBy(*over).orderBy(F.col(date).asc_nulls_last())
    ranked = df.withColumn("_place", F.when(F.col(date).isNotNull(), F.dense_rank().over(line)))
    n = F.max("_place").over(Window.partitionBy(*over))
    return ranked.withColumn(name, F.coalesce(F.col("_place") / n, F.lit(0.0))).drop("_place")
