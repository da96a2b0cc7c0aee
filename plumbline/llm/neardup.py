"""Near-duplicate groups by SetSketch registers.

A text becomes its set of word shingles, and the set a sketch: for each register an own hash of every shingle,
of which the smallest is kept, read as an exponential variate and cut to the exponent of a base near 1. Such
registers merge by their maximum, and two of them agree about as often as the sets overlap. Runs of registers
are banded into buckets; a bucket proposes pairs; a pair is estimated from all registers by maximum likelihood
and, unless it is far below the threshold, verified on the full shingle sets. Links become components.

Within a bucket not all pairs are formed. Texts too much of which no other candidate has can't have a link and
leave at once. Then each member meets the bucket's most ordinary one. After the links so found have joined
members into components, only members outside a bucket's largest component meet the members of other
components: any link still missing within a bucket has one end among them.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import (
    WordHash, chunks, gram_hashes, id_filter, join_groups, join_salted, materialise, modest_batches, odd, with_ids,
    without_ids,
)

#: SetSketch with 16-bit registers: base, rate and largest register value.
BASE, RATE, TOP = 1.001, 20.0, 65_535
REGISTERS, ROWS = 112, 4
#: Candidates whose estimate is below the threshold by more than this (some eight standard errors) are dropped.
MARGIN = 0.28


def shingle_set(words: np.ndarray, k: int) -> np.ndarray:
    """Sorted distinct hashes of all runs of k words; of the whole sequence if it is shorter."""
    if not len(words):
        return np.empty(0, np.uint64)
    return np.unique(gram_hashes(words, min(k, len(words)), seed=k))


_A, _X = odd(11, REGISTERS), odd(12, REGISTERS)


def registers(shingles: np.ndarray) -> np.ndarray:
    """Register values of a set; merged sets have the maxima of their registers."""
    low = np.full(REGISTERS, 2**32 - 1, np.uint64)
    for i in range(0, len(shingles), 4096):
        part = shingles[i : i + 4096, None] ^ _X
        part *= _A
        part >>= np.uint64(32)
        np.minimum(low, part.min(axis=0), out=low)
    x = -np.log1p(-(low.astype(np.float64) + 0.5) / 2**32)
    return np.clip(np.floor(1 - np.log(x / RATE) / math.log(BASE)), 0, TOP).astype(np.uint16)


def likely_jaccard(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """Maximum-likelihood overlap of sets of n_a and n_b elements (rows) from their registers.

    The registers of one are larger, equal or smaller than the other's with probabilities that follow from the
    overlap and the sizes; the likelihood is concave in the overlap, so a ternary search finds its maximum.
    """
    more, less = (a > b).sum(1), (a < b).sum(1)
    same = a.shape[1] - more - less
    u = n_a / (n_a + n_b)
    v = 1 - u
    log_b = math.log(BASE)

    def p(x):
        return -np.log1p(-np.clip(x, 0, 1) * (BASE - 1) / BASE) / log_b

    def fit(j):
        hi, lo = p(u - v * j), p(v - u * j)
        return more * np.log(hi + 1e-12) + less * np.log(lo + 1e-12) + same * np.log(np.maximum(1 - hi - lo, 1e-12))

    left, right = np.zeros(len(u)), np.minimum(u / v, v / u)
    for _ in range(30):
        third = (right - left) / 3
        better = fit(left + third) < fit(right - third)
        left, right = np.where(better, left + third, left), np.where(better, right, right - third)
    return (left + right) / 2


_SKETCH = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("set", pa.binary()), ("regs", pa.binary())])


def _sketches(k: int):
    def run(batches):
        of = WordHash().of
        for ids, text in chunks(batches, ["doc_id", "text"], "text"):
            rows = []
            for i, t in zip(ids, text, strict=True):
                s = shingle_set(of(t.encode().lower().split()), k) if t else ()
                rows.append(
                    (i, len(s), xxhash.xxh3_128_digest(s.tobytes()), registers(s).tobytes()) if len(s)
                    else (i, 0, None, None)
                )
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _SKETCH.types, strict=True)], schema=_SKETCH,
            )

    return run


def _sets(k: int, wanted):
    """Shingle sets of the texts that may be wanted; of nearly all others there are none."""
    schema = pa.schema([("id", pa.int64()), ("items", pa.list_(pa.int64()))])

    def run(batches):
        of = WordHash().of
        for ids, text in chunks(batches, ["id", "text"], "text"):
            keep = wanted.value.maybe(np.array(ids, np.int64)).tolist()
            ids, text = [i for i, x in zip(ids, keep, strict=True) if x], [
                t for t, x in zip(text, keep, strict=True) if x
            ]
            items = [shingle_set(of(t.encode().lower().split()), k).view(np.int64) for t in text]
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(items, pa.list_(pa.int64()))], schema=schema,
            )

    return run


def _likely(threshold: float):
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            col = lambda c: batch.column(batch.schema.get_field_index(c))  # noqa: E731, B023
            regs = [
                np.frombuffer(b"".join(col(c).to_pylist()), np.uint16).reshape(-1, REGISTERS)
                for c in ("regs_a", "regs_b")
            ]
            sizes = [col(c).to_numpy(zero_copy_only=False).astype(float) for c in ("n_a", "n_b")]
            keep = pa.array(likely_jaccard(*regs, *sizes) >= threshold - MARGIN)
            yield pa.RecordBatch.from_arrays([col("a"), col("b")], schema=schema).filter(keep)

    return run


def components(links: DataFrame, most_rows: int) -> DataFrame:
    """id, root: the smallest id reachable over links(a, b), for each id that has a link; most_rows bounds the links.

    Contraction: every node that has a smaller neighbour hooks to its smallest one, chains of hooks are
    shortened to their roots, links are rewritten to roots, and what still joins different roots goes into the
    next round. Rounds halve the roots at least; each ends in written tables. Nodes of very many links and roots of
    very many ids are grouped with map-side minima, and their joins go through join_groups.
    """
    both = links.select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo"))
    edges = materialise(both.filter("hi <> lo").distinct(), "edges", most_rows)
    known = None
    while n := edges.count():
        hooks = edges.groupBy("hi").agg(F.min("lo").alias("up"))
        while True:
            ups = hooks.select(F.col("hi").alias("up"), F.col("up").alias("_top"))
            size = hooks.groupBy("up").agg(F.count(F.lit(1)).alias("_n"))
            jumped = join_groups(hooks, ups.join(size, "up"), "up", "_n", n, "left")
            moved = jumped.select("hi", F.coalesce("_top", "up").alias("up"), F.col("_top").isNotNull().alias("moved"))
            moved = materialise(moved, "hooks", n)
            hooks = moved.select("hi", "up")
            if moved.filter("moved").isEmpty():
                break
        here = hooks.select(F.col("hi").alias("id"), F.col("up").alias("root"))
        if known is not None:
            ups = hooks.select(F.col("hi").alias("root"), F.col("up").alias("_top"))
            size = known.groupBy("root").agg(F.count(F.lit(1)).alias("_n"))
            met = join_groups(known, ups.join(size, "root"), "root", "_n", most_rows, "left")
            older = met.select("id", F.coalesce("_top", "root").alias("root"))
            here = older.unionByName(here.join(known.select("id"), "id", "left_anti"))
        known = materialise(here, "roots", most_rows)
        low = edges.groupBy("lo").agg(F.count(F.lit(1)).alias("_n")).join(
            hooks.withColumnRenamed("hi", "lo"), "lo", "left",
        )
        high = edges.groupBy("hi").agg(F.count(F.lit(1)).alias("_n")).join(hooks, "hi").select(
            "hi", F.col("up").alias("_h"), "_n",
        )
        met = join_groups(edges, low.select("lo", F.coalesce("up", "lo").alias("_l"), "_n"), "lo", "_n", n)
        met = join_groups(met, high, "hi", "_n", n).select(
            F.greatest("_l", "_h").alias("hi"), F.least("_l", "_h").alias("lo"),
        )
        edges = materialise(met.filter("hi <> lo").distinct(), "edges", n)
    if known is None:
        return edges.select(F.col("hi").alias("id"), F.col("lo").alias("root"))
    roots = known.select(F.col("root").alias("id"), "root").distinct()
    return known.unionByName(roots.join(known.select("id"), "id", "left_anti"))


def _could_link(n_a: Column, own_a: Column, n_b: Column, own_b: Column, percent: int) -> Column:
    """Whether sets of n shingles, own of which no other candidate has, may overlap enough: what is shared is no
    more than the smaller rest."""
    shared = F.least(n_a - own_a, n_b - own_b)
    return shared * 100 >= (n_a + n_b - shared) * percent


def _estimated(pairs: DataFrame, reps: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose registers don't put them far below the threshold."""
    side = lambda x: reps.select(F.col("rep").alias(x), F.col("n").alias(f"n_{x}"), F.col("regs").alias(f"regs_{x}"))
    met = join_salted(join_salted(pairs, side("b"), "b", F.col("a")), side("a"), "a", F.col("b"))
    return met.mapInArrow(_likely(percent / 100), "a long, b long")


def _compared(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) with shared, the size of their full sets' intersection, and linked, whether it suffices."""
    side = lambda x: sets.select(F.col("id").alias(x), F.col("items").alias(f"items_{x}"))
    both = join_salted(join_salted(pairs, side("b"), "b", F.col("a")), side("a"), "a", F.col("b"))
    shared = F.size(F.array_intersect("items_a", "items_b")).cast("long")
    union = F.size("items_a").cast("long") + F.size("items_b") - shared
    return both.select("a", "b", shared.alias("shared"), (shared * 100 >= union * percent).alias("linked"))


def _met_enough(percent: int) -> Column:
    """For a pair joined from inside and out: whether no first both were compared with rules a link out. What two
    sets share lies within that first, where it is bounded by what each shares with it, or outside, where it is
    bounded by what each has there, less the shingles that only it has."""
    bound = "least(u.s, v.s) + least(n_x - u.s - own_x, n - v.s - own)"
    return F.expr(
        f"NOT coalesce(exists(firsts_x, u -> exists(firsts, v -> u.p = v.p AND ({bound}) * {100 + percent} < {percent} * (n + n_x))), false)"
    )


_WIDTH = ROWS * 2
_BANDS = REGISTERS // ROWS


def _banded(some: DataFrame, *more: str) -> DataFrame:
    """A row for each band of each set: rep, n, more, band, bucket."""
    bands = F.array(*[F.xxhash64(F.lit(b), F.substring("regs", b * _WIDTH + 1, _WIDTH)) for b in range(_BANDS)])
    return some.select("rep", "n", *more, F.posexplode(bands).alias("band", "bucket"))


def _sharing(reps: DataFrame, n: int) -> DataFrame:
    """The reps that share a bucket with another: buckets are only counted, so that they aggregate by hash."""
    banded = _banded(reps).select("rep", "bucket")
    shared = banded.groupBy("bucket").agg(F.count(F.lit(1)).alias("_size")).filter("_size > 1")
    return join_groups(banded, shared, "bucket", "_size", n).select("rep").distinct()


def _members(able: DataFrame, n: int) -> DataFrame:
    """rep, n, own, band, bucket, and the bucket's first member (first_rep, first_n, first_own), for buckets of two or more.
    The first has the fewest shingles of its own: it is the text nearest to what the others vary. The order is one
    number, so that this aggregates by hash."""
    banded = _banded(able, "own")
    order = F.shiftleft(
        F.least("own", F.lit((1 << 24) - 1)).cast("long"), 39,
    ).bitwiseOR(F.pmod(F.xxhash64("rep"), F.lit(1 << 39)))
    firsts = [F.min_by(c, order).alias(f"first_{c}") for c in ("rep", "n", "own")]
    shared = banded.groupBy("bucket").agg(*firsts, F.count(F.lit(1)).alias("_size")).filter("_size > 1")
    return join_groups(banded, shared, "bucket", "_size", n)


def near_dup_groups(
    docs: DataFrame, shingle: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """One row for each input row: doc_id, n_shingles, component_id, kept, class_id, n_links.

    Ids are whole numbers. Words are runs of anything but ASCII white space, A-Z lower-cased; a document's set holds its
    distinct runs of `shingle` words, or its whole sequence if it has fewer, and is empty without words or text. Documents
    are linked when 100 * intersection >= percent * union; empty sets are linked with nothing. component_id is
    the smallest id reachable, the id itself included; kept says that this is the row's own. class_id is the
    smallest id of the same set (its own for empty sets), n_links counts the verified links between this class
    and other classes that were needed to join components. Rows with a null id are nobody's copy: they stay,
    with a null component. So do rows of an id that has several different sets: each is its own component, as nothing
    tells which of them the id means. Other columns are ignored. An empty table gives an empty result.

    Texts never shuffle: a broadcast filter of at most 64 MB tells a second scan which sets to make. A link of Jaccard J
    is missed by all 28 bands with probability (1 - J^4)^28: below 4e-7 at 0.8 and 2e-9 at 0.85, far less above.
    """
    modest_batches(docs.sparkSession)
    n_docs = docs.count()
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    sketched = materialise(
        rows.mapInArrow(_sketches(shingle), "doc_id long, n long, `set` binary, regs binary"), "sketches",
    )
    named = sketched.filter("n > 0 and doc_id is not null")
    alone = sketched.filter("n = 0 or doc_id is null")
    texts_of = named.select("doc_id", F.xxhash64("set").alias("h")).groupBy("doc_id").agg(
        F.min("h").alias("low"), F.max("h").alias("high"),
    )
    several = materialise(texts_of.filter("low <> high").select("doc_id"), "several", n_docs)
    if not several.isEmpty():
        named, alone = without_ids(named, several, "doc_id"), alone.unionByName(with_ids(named, several, "doc_id"))
    # Registers follow from the set: as part of the key, they need no aggregate of their own.
    classes = materialise(
        named.groupBy("set", "n", "regs").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("_size")),
        "classes",
    )
    reps = classes.select("rep", "n", "regs")
    texts = rows.select(F.col("doc_id").alias("id"), "text").filter("id is not null and text is not null")
    n_banded = n_docs * _BANDS

    # Sets are made of what shares a bucket with something. A shingle that only one of them has can't be shared, and
    # a set with too many such shingles has no link: what merely shares a passage goes out here.
    near = materialise(reps.join(_sharing(reps, n_banded), "rep", "left_semi"), "near", n_docs)
    sets = materialise(
        texts.mapInArrow(_sets(shingle, id_filter(near.select("rep"))), "id long, items array<long>"), "sets",
    )
    owners = sets.select("id", F.explode("items").alias("item")).groupBy("item").agg(
        F.min("id").alias("rep"), F.count(F.lit(1)).alias("c"),
    ).filter("c = 1")
    own = owners.groupBy("rep").agg(F.count(F.lit(1)).alias("own"))
    able = near.join(own, "rep", "left").withColumn("own", F.coalesce("own", F.lit(0)).cast("long"))
    able = materialise(able.filter((F.col("n") - F.col("own")) * 100 >= F.col("n") * percent), "able", n_docs)
    members = materialise(_members(able, n_banded), "members", n_banded)
    fits = (F.col("rep") != F.col("first_rep")) & _could_link(
        F.col("n"), F.col("own"), F.col("first_n"), F.col("first_own"), percent,
    )
    star = members.filter(fits).select(F.col("first_rep").alias("a"), F.col("rep").alias("b")).distinct()
    likely = materialise(_estimated(star, reps, percent), "likely", n_banded)
    compared = materialise(_compared(likely, sets, percent), "compared", n_banded)
    links = compared.filter("linked").select("a", "b")
    firsts = compared.groupBy(F.col("b").alias("rep")).agg(
        F.collect_list(F.struct(F.col("a").alias("p"), F.col("shared").alias("s"))).alias("firsts")
    )
    roots = components(links, n_banded)
    # What the star of a bucket can't see: links between other members that are still in different components.
    placed = members.select("rep", "n", "own", "band", "bucket").join(
        roots.withColumnRenamed("id", "rep"), "rep", "left",
    ).join(firsts, "rep", "left")
    placed = materialise(placed.withColumn("root", F.coalesce("root", "rep")), "placed", n_banded)
    parts = placed.groupBy("bucket", "root").agg(F.count(F.lit(1)).alias("c"))
    open_buckets = parts.groupBy("bucket").agg(
        F.max_by("root", F.struct("c", "root")).alias("main"), F.count(F.lit(1)).alias("k"),
        F.sum("c").alias("_size"),
    ).filter("k > 1")
    inside = join_groups(placed, open_buckets.drop("k"), "bucket", "_size", n_banded)
    inside = materialise(inside.join(able.select("rep", "regs"), "rep"), "inside", n_banded)
    names = {"rep": "x", "n": "n_x", "own": "own_x", "firsts": "firsts_x", "root": "root_x", "regs": "regs_x"}
    out = inside.filter("root <> main").select("bucket", *[F.col(c).alias(x) for c, x in names.items()])
    apart = (F.col("root") != F.col("root_x")) & ((F.col("root") == F.col("main")) | (F.col("rep") < F.col("x")))
    # Two sets meet in the first of the bands that they share only.
    first_band = F.expr(
        f"NOT exists(sequence(0, band), j -> j < band AND substring(regs, j * {_WIDTH} + 1, {_WIDTH}) = substring(regs_x, j * {_WIDTH} + 1, {_WIDTH}))"
    )
    enough = _could_link(F.col("n"), F.col("own"), F.col("n_x"), F.col("own_x"), percent) & _met_enough(percent)
    met = join_salted(inside, out, "bucket", F.col("rep"), per_task=4096).filter(apart & enough & first_band)
    pairs = met.select(
        F.col("rep").alias("a"), F.col("x").alias("b"), F.col("n").alias("n_a"), F.col("n_x").alias("n_b"),
        F.col("regs").alias("regs_a"), F.col("regs_x").alias("regs_b"),
    )
    likely = pairs.mapInArrow(_likely(percent / 100), "a long, b long").select(
        F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"),
    ).distinct()
    tried = star.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    rest = materialise(likely.join(tried, ["a", "b"], "left_anti"), "rest")
    if not rest.isEmpty():
        more = materialise(_compared(rest, sets, percent).filter("linked").select("a", "b"), "more")
        if not more.isEmpty():
            links = links.unionByName(more)
            roots = components(links, n_banded)
    degree = links.select(
        F.explode(F.array("a", "b")).alias("rep")
    ).groupBy("rep").agg(F.count(F.lit(1)).alias("n_links"))
    of_class = classes.join(roots.withColumnRenamed("id", "rep"), "rep", "left").join(degree, "rep", "left")
    of_class = of_class.select(
        "set", F.coalesce("root", "rep").alias("component_id"), F.col("rep").alias("class_id"),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), "_size",
    )
    of_class = materialise(of_class, "of_class", n_docs)
    met = join_groups(named.select("doc_id", "n", "set"), of_class, "set", "_size", n_docs).drop("set")
    alone = alone.select(
        "doc_id", "n", F.col("doc_id").alias("component_id"), F.col("doc_id").alias("class_id"),
        F.lit(0).cast("long").alias("n_links"),
    )
    every = met.select("doc_id", "n", "component_id", "class_id", "n_links").unionByName(alone)
    return every.select(
        "doc_id", F.col("n").alias("n_shingles"), "component_id",
        F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"), "class_id", "n_links",
    )


def drop_near_dups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """docs, with all columns, whatever their names, without the documents that near_dup_groups doesn't keep. Rows that
    repeat a kept id and text are reduced to one; rows with a null id, and those of an id with several different
    texts, are nobody's copies and stay. An empty table stays empty. Only ids shuffle for the decision."""
    groups = materialise(
        near_dup_groups(docs, id_col=id_col, text_col=text_col, **options).select("doc_id", "kept"), "kept",
    )
    gone = groups.filter("not kept").select("doc_id").distinct()
    again = groups.filter(
        "kept and doc_id is not null"
    ).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("doc_id")
    left = without_ids(docs, gone, id_col)
    if again.isEmpty():
        return left
    once = with_ids(left, again, id_col).dropDuplicates([id_col, text_col])
    return without_ids(left, again, id_col).unionByName(once)
