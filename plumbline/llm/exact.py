"""Exact de-duplication by two passes over a saturating Bloom filter.

Pass 1 hashes every text into two cells of a blocked filter, shuffles the cells (two a row, a block and a bit
each) to count them, and keeps those hit at least twice; the bitmaps are small enough to broadcast. Pass 2 tests every row: one with a cell hit once is unique and passes
straight through; only the possibly repeated (digest, id) pairs shuffle, to be grouped exactly.
DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BLOCK_BITS, bit_set, cells, join_groups, materialise

def _celled(rows: DataFrame, blocks: int) -> DataFrame:
    """rows with the block and the two cells in it that their digest (_sha) hits."""
    return rows.withColumns(dict(zip(("_block", "_bit_a", "_bit_b"), cells(F.col("_sha"), blocks), strict=True)))


def repeated_cells(celled: DataFrame) -> DataFrame:
    """Pass 1: bitmaps (_block, _bits) of the cells that are hit at least twice."""
    hits = celled.select("_block", F.explode(F.array_distinct(F.array("_bit_a", "_bit_b"))).alias("bit"))
    twice = hits.groupBy("_block", "bit").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    return twice.groupBy("_block").agg(F.bitmap_construct_agg(F.col("bit").cast("long")).alias("_bits"))


def _tested(celled: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """Pass 2: rows with _maybe, whether both their cells are in the bitmaps; the bitmaps are broadcast."""
    both = bit_set(F.col("_bits"), F.col("_bit_a")) & bit_set(F.col("_bits"), F.col("_bit_b"))
    return celled.join(F.broadcast(bitmaps), "_block", "left").withColumn(
        "_maybe", F.coalesce(both, F.lit(False)),
    ).drop("_block", "_bit_a", "_bit_b", "_bits")


def _with_sha(docs: DataFrame, text_col: str) -> DataFrame:
    return docs.withColumn("_sha", F.unhex(F.sha2(F.coalesce(F.col(text_col).cast("string"), F.lit("")), 256)))


def _passes(
    docs: DataFrame, id_col: str, text_col: str, bits_per_row: int, max_blocks: int,
) -> tuple[DataFrame, DataFrame, int, int]:
    """(doc_id, _sha, _maybe) of all rows, the bitmaps, their number of blocks, and the number of rows."""
    rows = materialise(_with_sha(docs, text_col).select(F.col(id_col).alias("doc_id"), "_sha"), "digests")
    n = rows.count()
    blocks = max(1, min(max_blocks, -(-n * bits_per_row // BLOCK_BITS)))
    bitmaps = materialise(repeated_cells(_celled(rows, blocks)), "bitmaps")
    return _tested(_celled(rows, blocks), bitmaps), bitmaps, blocks, n


def _grouped(tested: DataFrame, n: int) -> DataFrame:
    """doc_id, keep_id, group_size, kept, _sha of the possibly repeated rows, exactly."""
    ids = materialise(
        tested.filter("_maybe").groupBy("_sha", "doc_id").agg(F.count(F.lit(1)).alias("times")), "repeated",
    )
    groups = materialise(
        ids.groupBy("_sha").agg(
            F.max("doc_id").alias("keep_id"), F.sum("times").alias("group_size"), F.count(F.lit(1)).alias("_ids"),
        ),
        "groups",
    )
    each = join_groups(ids, groups, "_sha", "_ids", n).withColumn(
        "_i", F.explode(F.sequence(F.lit(1).cast("long"), F.col("times"))),
    )
    return each.select(
        "doc_id", "keep_id", "group_size",
        (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("_i") == 1)).alias("kept"), "_sha",
    )


def exact_groups(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bits_per_row: int = 16, max_blocks: int = 16_384,
) -> DataFrame:
    """One row for each input row: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical; null counts as empty. The largest id of a group stays (null ids lose to
    any other; where all are null, one null row stays). Rows that repeat an id within a group count, and one
    of them stays. An empty table gives an empty result. Other columns are ignored, whatever their names.

    The filter takes bits_per_row bits a row up to max_blocks blocks of 4 KB (64 MB): that bounds the
    broadcast. Over 33 million rows it fills up, more unique rows are taken for possibly repeated ones, and
    up to 72 bytes of each row shuffle; the result stays exact.
    """
    tested, _, _, n = _passes(docs, id_col, text_col, bits_per_row, max_blocks)
    straight = tested.filter(~F.col("_maybe")).select(
        "doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"),
        F.lit(True).alias("kept"), "_sha",
    )
    return straight.unionByName(_grouped(tested, n)).withColumn("text_sha256", F.lower(F.hex("_sha"))).drop("_sha")


def exact_dedup(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bits_per_row: int = 16, max_blocks: int = 16_384,
) -> DataFrame:
    """The rows of docs, with all their columns, that exact_groups keeps: unique ones pass straight through, only possibly
    repeated ones shuffle. Columns may have any names; an empty table stays empty. A row with a null id is kept if no other of its text has an id; rows that repeat a kept
    id and text are reduced to one."""
    tested, bitmaps, blocks, n = _passes(docs, id_col, text_col, bits_per_row, max_blocks)
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")  # one column, which no name can clash with
    keyed = _with_sha(
        docs.select(whole, F.col(id_col).alias("_id"), F.col(text_col).alias("_text")), "_text",
    ).drop("_text")
    rows = _tested(_celled(keyed, blocks), bitmaps)
    stay = _grouped(tested, n).filter("kept").select(F.col("doc_id").alias("_kept"), F.col("_sha").alias("_s"))
    again = rows.filter("_maybe").dropDuplicates(["_id", "_sha"])
    again = again.join(stay, again["_id"].eqNullSafe(stay["_kept"]) & (again["_sha"] == stay["_s"]), "left_semi")
    return rows.filter(~F.col("_maybe")).select("_row.*").unionByName(again.select("_row.*"))
