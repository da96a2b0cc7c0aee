"""Shared pieces of the corpus operators: joins on hot keys and by ids, word hashing, filters."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..scratch import materialise

#: Words of whole texts: everything but the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"

#: At most this many keys can each hold one row in so many of a table.
HOT_KEYS = 10_000


def hot_limit(n: int) -> int:
    """Rows from which a key counts as hot: no more than HOT_KEYS keys can have so many of n rows."""
    return max(256, -(-n // HOT_KEYS))


def join_groups(rows: DataFrame, groups: DataFrame, key: str, size: str, n: int, how: str = "inner") -> DataFrame:
    """Join rows with groups (one row a key, with the number of its rows in column size) on key.

    Keys of hot_limit(n) rows or more go by a broadcast of at most HOT_KEYS rows, so that none of them meets
    in one task; all others by a shuffle. how: inner or left, as seen from rows. Column size is dropped.
    """
    limit = hot_limit(n)
    hot = F.broadcast(groups.filter(F.col(size) >= limit).drop(size))
    cold = groups.filter(F.col(size) < limit).drop(size)
    first = rows.join(hot, key, "inner")
    rest = rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(cold, key, how)
    return first.select(*rest.columns).unionByName(rest)


def join_salted(rows: DataFrame, wide: DataFrame, key: str, spread: Column, per_task: int = 256) -> DataFrame:
    """Join many rows a key with one or few wide rows a key: a key with more than per_task rows is cut into salted parts,
    and only its wide rows are repeated, once a part. spread: what deals a key's rows out to its parts."""
    sizes = rows.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    parts = sizes.select(key, F.ceil(F.col("_n") / per_task).cast("int").alias("_parts")).filter("_parts > 1")
    dealt = F.when(F.col("_parts").isNull(), F.lit(0)).otherwise(
        F.pmod(F.xxhash64(spread), F.col("_parts")).cast("int")
    )
    salted = rows.join(parts, key, "left").withColumn("_salt", dealt).drop("_parts")
    every = F.sequence(F.lit(0), F.coalesce(F.col("_parts"), F.lit(1)) - 1)
    copies = wide.join(parts, key, "left").withColumn("_salt", F.explode(every)).drop("_parts")
    return salted.join(copies, [key, "_salt"], "inner").drop("_salt")


def spare(df: DataFrame, name: str) -> str:
    """name, or a longer one if df has a column of that name."""
    held = {c.lower() for c in df.columns}
    while name.lower() in held:
        name += "_"
    return name


# ---------------------------------------------------------------- rows by a table of ids

#: Ids up to which they are broadcast as they are.
FEW_IDS = 1_000_000
#: Bits of one block of a filter: what one bitmap of bitmap_construct_agg holds. 64 MB of blocks are broadcast at most.
BLOCK_BITS, MAX_BLOCKS = 32_768, 16_384


def cells(key: Column, blocks: int) -> tuple[Column, Column, Column]:
    """The block of a blocked filter that a key falls into, and its two bits there."""
    h = F.xxhash64(key)
    low = F.lit(BLOCK_BITS - 1)
    return F.pmod(
        F.shiftright(h, 30), F.lit(blocks),
    ).cast("int"), h.bitwiseAND(low).cast("int"), F.shiftright(h, 15).bitwiseAND(low).cast("int")


def bit_set(bitmap: Column, position: Column) -> Column:
    byte = F.conv(F.hex(F.substring(bitmap, (position / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return byte.bitwiseAND(F.pow(F.lit(2), position % 8).cast("int")) != 0


def _filtered(docs: DataFrame, ids: DataFrame, n: int, id_col: str) -> tuple[DataFrame, DataFrame]:
    """(rows whose id may be among ids, rows whose id isn't), by a broadcast filter of 16 bits an id, 64 MB at most."""
    blocks = max(1, min(MAX_BLOCKS, -(-n * 16 // BLOCK_BITS)))
    block, a, b = cells(F.col("_id"), blocks)
    bits = ids.select(block.alias("_block"), F.explode(F.array_distinct(F.array(a, b))).alias("_bit"))
    bitmaps = materialise(
        bits.groupBy("_block").agg(F.bitmap_construct_agg(F.col("_bit").cast("long")).alias("_bits")), "bitmaps",
    )
    names = spare(docs, "_block"), spare(docs, "_bits")
    block, a, b = cells(F.col(f"`{id_col}`").cast("long"), blocks)
    bitmaps = bitmaps.select(F.col("_block").alias(names[0]), F.col("_bits").alias(names[1]))
    met = docs.join(F.broadcast(bitmaps), block == bitmaps[names[0]], "left")
    maybe = F.coalesce(bit_set(F.col(names[1]), a) & bit_set(F.col(names[1]), b), F.lit(False))
    return met.filter(maybe).drop(*names), met.filter(~maybe).drop(*names)


def _keyed(docs: DataFrame, ids: DataFrame, id_col: str) -> tuple[DataFrame, Column]:
    name = spare(docs, "_one")
    side = ids.select(F.col(ids.columns[0]).alias(name))
    return side, docs[f"`{id_col}`"].cast("long") == side[name]


def with_ids(docs: DataFrame, ids: DataFrame, id_col: str) -> DataFrame:
    """The rows of docs whose id is among ids (one column of distinct ids, written). Few ids are broadcast; of many, a filter
    is, so that next to no other rows shuffle."""
    n = ids.count()
    side, same = _keyed(docs, ids, id_col)
    if n <= FEW_IDS:
        return docs.join(F.broadcast(side), same, "left_semi")
    maybe, _ = _filtered(docs, ids.select(F.col(ids.columns[0]).alias("_id")), n, id_col)
    side, same = _keyed(maybe, ids, id_col)
    return maybe.join(side, same, "left_semi")


def without_ids(docs: DataFrame, ids: DataFrame, id_col: str) -> DataFrame:
    """The rows of docs whose id isn't among ids (one column of distinct ids, written); rows with a null id stay. Few ids are
    broadcast. Of many, a filter is: what it rules out stays where it is, of the rest only the ids shuffle, and
    the rows that it took for others come back by with_ids."""
    n = ids.count()
    side, same = _keyed(docs, ids, id_col)
    if n <= FEW_IDS:
        return docs.join(F.broadcast(side), same, "left_anti")
    maybe, sure = _filtered(docs, ids.select(F.col(ids.columns[0]).alias("_id")), n, id_col)
    seen = maybe.select(F.col(f"`{id_col}`").cast("long").alias("_id")).distinct()
    mistaken = materialise(seen.join(ids.select(F.col(ids.columns[0]).alias("_id")), "_id", "left_anti"), "mistaken")
    return sure.unionByName(with_ids(maybe, mistaken, id_col))


# ---------------------------------------------------------------- words and hashes in Python workers


def modest_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Hand whole texts to Python workers in batches of few rows, so that workers stay small. The setting stays: it
    is read when a plan runs, after the operator that made it has returned."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= rows:
        spark.conf.set(key, str(rows))


def chunks(batches: Iterable, columns: list[str], text: str, most_bytes: int = 4 << 20) -> Iterator[tuple]:
    """Lists of the named columns for runs of rows whose texts hold about most_bytes, a single long text alone."""
    pa.set_memory_pool(pa.system_memory_pool())  # gives back what is freed
    for batch in batches:
        sizes = pc.fill_null(
            pc.binary_length(batch.column(batch.schema.get_field_index(text))), 0,
        ).to_numpy(zero_copy_only=False)
        start = 0
        while start < batch.num_rows:
            n = max(1, int(np.searchsorted(np.cumsum(sizes[start:]), most_bytes, side="right")))
            part = batch.slice(start, n)
            yield tuple(part.column(part.schema.get_field_index(c)).to_pylist() for c in columns)
            start += n


class WordHash(dict):
    """64-bit hashes of words (bytes), remembered for up to 200,000 words at a time."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 200_000:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), dtype=np.uint64, count=len(words))


def odd(seed: int, n: int) -> np.ndarray:
    """n fixed odd multipliers."""
    return np.random.default_rng(seed).integers(0, 2**63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def mix(x: np.ndarray) -> np.ndarray:
    """A finaliser that spreads each input bit over all output bits."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def gram_hashes(words: np.ndarray, k: int, seed: int = 1) -> np.ndarray:
    """Hashes of all runs of k consecutive word hashes; empty if there are fewer."""
    n = len(words) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for j, a in enumerate(odd(seed, k)):
        out += words[j : j + n] * a
    return mix(out)


# ---------------------------------------------------------------- sets of ids of a bounded size


#: Bits of a piece of a filter or sketch that is merged on its own.
PIECE = 1 << 16


def pack(places: np.ndarray) -> bytes:
    """A piece's bits, from their distinct places: as a bitmap, or as 16-bit numbers where that is shorter."""
    if len(places) * 16 < PIECE:
        return b"L" + places.astype(np.uint16).tobytes()
    return b"B" + np.packbits(np.isin(np.arange(PIECE), places)).tobytes()


def unpack(data: bytes) -> np.ndarray:
    bits = np.zeros(PIECE, bool)
    if data[:1] == b"L":
        bits[np.frombuffer(data, np.uint16, offset=1)] = True
        return bits
    return np.unpackbits(np.frombuffer(data, np.uint8, offset=1)).astype(bool)


class IdFilter:
    """A Bloom filter over ids: never false of one it holds, true of about one other in a hundred while it has room. It
    takes 12 bits an id up to most_bits (64 MB); beyond that more others pass."""

    def __init__(self, n: int, most_bits: int = 1 << 29):
        self.bits = PIECE
        while self.bits < most_bits and self.bits < n * 12:
            self.bits *= 2
        self.set = np.zeros(self.bits // 8, np.uint8)

    def places(self, ids: np.ndarray):
        """Four arrays: each id's bits."""
        h = mix(ids.astype(np.uint64))
        for k in range(4):
            h = mix(h + np.uint64(k + 1))
            yield (h & np.uint64(self.bits - 1)).astype(np.int64)

    def add(self, ids: np.ndarray) -> None:
        for c in self.places(ids):
            np.bitwise_or.at(self.set, c >> 3, (1 << (c & 7)).astype(np.uint8))

    def maybe(self, ids: np.ndarray) -> np.ndarray:
        ok = np.ones(len(ids), bool)
        for c in self.places(ids):
            ok &= (self.set[c >> 3] >> (c & 7).astype(np.uint8)) & 1 == 1
        return ok


def _id_pieces(n: int, most: int = 1_000_000):
    """The pieces of the filter of a partition's ids, in parts of up to about `most` ids."""

    def run(batches):
        f, held, count = IdFilter(n), [], 0

        def made():
            places = np.unique(np.concatenate(held))
            edges = np.flatnonzero(np.diff(places // PIECE)) + 1
            parts = np.split(places, edges)
            numbers, data = [int(p[0] // PIECE) for p in parts], [pack(p % PIECE) for p in parts]
            for i in range(0, len(parts), 500):
                arrays = [pa.array(numbers[i : i + 500], pa.int32()), pa.array(data[i : i + 500], pa.binary())]
                yield pa.RecordBatch.from_arrays(arrays, names=["piece", "bits"])

        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            if len(ids):
                held.extend(f.places(ids))
                count += len(ids)
            if count > most:
                yield from made()
                held, count = [], 0
        if held:
            yield from made()

    return run


def _merged(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One piece of the filter, from all parts of it, one batch of them at a time."""
    bits = np.zeros(PIECE, bool)
    for batch in batches:
        for data in batch.column("bits").to_pylist():
            bits |= unpack(data)
    packed = np.packbits(bits, bitorder="little").tobytes()
    yield pa.RecordBatch.from_arrays(
        [pa.array([key[0].as_py()], pa.int32()), pa.array([packed], pa.binary())], names=["piece", "bits"],
    )


def id_filter(ids: DataFrame):
    """A broadcast IdFilter of a one-column table of ids. Partitions make packed pieces of it, which are merged where they
    meet; the driver gets each piece once: 64 MB at most, whatever the number of ids."""
    n = ids.count()
    whole = IdFilter(n)
    parts = ids.mapInArrow(_id_pieces(n), "piece int, bits binary")
    for r in parts.groupBy("piece").applyInArrow(_merged, "piece int, bits binary").toLocalIterator():
        start = r["piece"] * (PIECE // 8)
        whole.set[start : start + PIECE // 8] = np.frombuffer(r["bits"], np.uint8)
    return ids.sparkSession.sparkContext.broadcast(whole)
