"""Mixing sources to target weights by capped water-filling and seeded repetition.

Each source's target is its weighted share of the mix, clamped at max_epochs times its size; what the clamped
ones can't take is dealt out again by weight until none is above its cap. A source with target r times its size
gets every document floor(r) times, and once more those that come first in a seeded order until the
fractional part is met.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, materialise

#: Rows up to which the table of sources is broadcast.
MAX_BROADCAST_SOURCES = 1_000_000


def _order(seed: int, id_col: Column, text: Column) -> Column:
    """A document's place in the seeded order: 32 bits of a digest of its id, or of its text if it has none."""
    return F.conv(
        F.substring(
            F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(id_col.cast("string"), F.concat(F.lit("null:"), text)))), 1,
            8,
        ),
        16, 10,
    ).cast("long")


def _place(docs: DataFrame, seed: int, id_col: str, text_col: str) -> Column:
    """Where a row stands in the seeded order: by its place h, and within it by id (k) and text (x)."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    whole_number = dict(docs.dtypes)[id_col] in ("tinyint", "smallint", "int", "bigint")
    key = F.coalesce(F.col(id_col).cast("long") if whole_number else F.xxhash64(id_col), F.lit(-1).cast("long"))
    return F.struct(_order(seed, F.col(id_col), text).alias("h"), key.alias("k"), F.xxhash64(text).alias("x"))


def _meet(left: DataFrame, right: DataFrame, few: bool, how: str = "inner", key: str = "source") -> DataFrame:
    """left, with the columns of right's row of its source; right is broadcast where there are few sources."""
    right = right.withColumnRenamed("source", "_s")
    return left.join(F.broadcast(right) if few else right, left[key].eqNullSafe(right["_s"]), how).drop("_s")


def fill(sources: DataFrame, weights: list[float], share: float, max_epochs: float) -> DataFrame:
    """sources(source, source_size) with target. Closed form of the repeated clamping: by rising cap a weight,
    a source is clamped as long as an equal level over it and all after it would reach its cap."""
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(
        F.array(*[F.lit(float(x)) for x in weights]),
        ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int"),
    )
    table = sources.withColumn("_w", w).withColumn("_cap", F.col("source_size") * F.lit(float(max_epochs)))
    line = Window.orderBy(F.col("_cap") / F.col("_w"), F.col("source").asc_nulls_last())
    before = line.rowsBetween(Window.unboundedPreceding, -1)
    after = line.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    every = Window.partitionBy()
    table = table.withColumn(
        "_level",
        (
            F.lit(float(share)) * F.sum("source_size").over(every) - F.coalesce(
                F.sum("_cap").over(before), F.lit(0.0),
            )
        ) / F.sum("_w").over(after),
    )
    table = table.withColumn("_full", F.col("_level") * F.col("_w") >= F.col("_cap"))
    level = F.max(F.when(~F.col("_full"), F.col("_level"))).over(every)
    return table.withColumn(
        "target", F.when(F.col("_full"), F.col("_cap")).otherwise(level * F.col("_w")),
    ).select("source", "source_size", "target")


def mix_plan(
    docs: DataFrame, weights: list[float] = (3, 1, 2), share: float = 1.5, max_epochs: float = 2.0, seed: int = 17,
    id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
) -> DataFrame:
    """One row for each input row: doc_id, size, source_size, target, taken, copies.

    Weights repeat over the sources in code-point order, null last. A null text has size 0; a null source is
    a source; rows with a null id are told apart by their texts. Rows that repeat an id and text are taken alike. Sizes
    of 0 are never taken once more. An empty table gives an empty result. Reruns agree: the order depends on seed, id
    and text only. Ids may be of any type. A source misses its target by half of one document at most (and the
    rows that repeat its id and text).
    """
    rows, sources, cuts, few = _cuts(docs, weights, share, max_epochs, seed, id_col, text_col, source_col)
    out = _meet(_meet(rows, sources, few), cuts, few, "left").withColumn(
        "copies", _copies(F.col("_at"), F.col("size") > 0),
    )
    return out.select(
        "doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies",
    )


def _copies(at: Column, any_words: Column) -> Column:
    """How often a row is taken that has met its source's _whole and _cut."""
    return F.col("_whole") + (F.coalesce(at <= F.col("_cut"), F.lit(False)) & any_words).cast("long")


def _cuts(
    docs: DataFrame, weights: list[float], share: float, max_epochs: float, seed: int, id_col: str, text_col: str,
    source_col: str,
) -> tuple[DataFrame, DataFrame, DataFrame, bool]:
    """rows(doc_id, source, size, _at), sources(source, source_size, target, _whole), cuts(source, _cut) with the last of the
    order that is taken once more, and whether there are few enough sources to broadcast."""
    size = F.regexp_count(F.coalesce(F.col(text_col), F.lit("")), F.lit(WORD)).cast("long")
    at, source = _place(docs, seed, id_col, text_col).alias("_at"), F.col(source_col).cast("string").alias("source")
    rows = materialise(docs.select(F.col(id_col).alias("doc_id"), source, size.alias("size"), at), "sizes")
    sources = fill(rows.groupBy("source").agg(F.sum("size").alias("source_size")), list(weights), share, max_epochs)
    ratio = F.col("target") / F.when(F.col("source_size") > 0, F.col("source_size"))
    sources = sources.withColumn("_whole", F.coalesce(F.floor(ratio), F.lit(0)).cast("long"))
    sources = materialise(
        sources.withColumn("_quota", F.col("target") - F.col("_whole") * F.col("source_size")), "sources",
    )
    # A few rows a source; the cut is found in bins of the order, so that no source meets in one task.
    few = sources.count() <= MAX_BROADCAST_SOURCES

    def located(part: DataFrame, bins: Column, start: Column) -> DataFrame:
        """source, _bin, _start: the bin in which the source's quota ends, and the words before it. As a quota is
        less than its source's size, there is exactly one."""
        sums = part.groupBy(
            "source", "_quota", start.alias("_from"), bins.alias("_bin"),
        ).agg(F.sum("size").alias("_words"))
        line = Window.partitionBy("source").orderBy("_bin")
        cum = sums.withColumn(
            "_end", F.col("_from") + F.sum("_words").over(line),
        ).withColumn("_begin", F.col("_end") - F.col("_words"))
        return materialise(
            cum.filter(
                (F.col("_begin") <= F.col("_quota")) & (F.col("_quota") < F.col("_end"))
            ).select("source", "_bin", F.col("_begin").alias("_start")),
            "bins",
        )

    h = F.col("_at.h")
    asked = _meet(rows, sources.select("source", "_quota"), few)
    first = located(asked, F.shiftright(h, 22), F.lit(0).cast("long"))
    second = located(
        _meet(asked, first, few).filter(F.shiftright(h, 22) == F.col("_bin")).drop("_bin"), F.shiftright(h, 12),
        F.col("_start"),
    )
    edge = _meet(asked, second, few).filter(F.shiftright(h, 12) == F.col("_bin"))
    line = Window.partitionBy("source").orderBy("_at").rowsBetween(Window.unboundedPreceding, 0)
    upto = edge.withColumn("_end", F.col("_start") + F.sum("size").over(line))
    last = upto.filter(
        F.col("_end") * 2 - F.col("size") <= F.col("_quota") * 2
    ).groupBy("source").agg(F.max("_at").alias("_last"))
    least = F.lit(-(1 << 63)).cast("long")
    none = F.struct(F.shiftleft("_bin", 12).alias("h"), least.alias("k"), least.alias("x"))
    cuts = materialise(
        _meet(second, last, few, "left").select("source", F.coalesce("_last", none).alias("_cut")), "cuts",
    )
    return rows, sources.drop("_quota"), cuts, few


def mix_sources(
    docs: DataFrame, weights: list[float] = (3, 1, 2), share: float = 1.5, max_epochs: float = 2.0, seed: int = 17,
    id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
) -> DataFrame:
    """The mix itself: the rows of docs, with all columns, whatever their names, each as many times as mix_plan takes it.
    Each row is held against its source's cut where it is, so that null ids, and ids that repeat over texts or sources,
    are rows like any other; null texts have no words and go only with whole repetitions. An empty table stays empty."""
    _, sources, cuts, few = _cuts(docs, weights, share, max_epochs, seed, id_col, text_col, source_col)
    words = F.coalesce(F.col(text_col).cast("string"), F.lit("")).rlike(WORD)
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")  # one column, which no name can clash with
    rows = docs.select(
        whole, F.col(source_col).cast("string").alias("_source"), _place(docs, seed, id_col, text_col).alias("_at"),
        words.alias("_words"),
    )
    met = _meet(_meet(rows, sources.select("source", "_whole"), few, key="_source"), cuts, few, "left", key="_source")
    copies = F.sequence(F.lit(1).cast("long"), F.col("_copies"))
    met = met.select("_row", _copies(F.col("_at"), F.col("_words")).alias("_copies")).filter("_copies > 0")
    return met.select("_row", F.explode(copies)).select("_row.*")
