"""Near-duplicate vectors by a subspace pigeonhole join.

Vectors are scaled to length 1 and turned by a fixed random rotation, which spreads what they have over all coordinates, and
cut into blocks of few coordinates. Cosine c means a squared distance of 2 - 2c. If two vectors are that near, they
are so near in one block at least that its squared distance is within the block's share of the budget, in proportion
to its coordinates. So each block is a range join of its own: a grid over its first coordinates, with cells as wide as the
block's radius, in which a vector is at home in one cell and visits those next to it that its ball reaches (of two
neighbours, the one is at home where the other visits). What a block finds is verified on the whole vectors, and counts in
the first block only that is within its share: once, however many blocks find it.

Equal vectors are one. A cell is dealt out in tiles of its own rows, and each tile meets the rest of the cell in pieces, so
that no task holds a group of unbounded size; pairs stay in the task that finds them, which gives numbers of links
and, for the components, no more edges than it has rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import join_groups, materialise
from .neardup import components

#: Of 64 coordinates, each takes 16: of unrelated vectors, two in a million are then within a block's share (of 8: 7 in 1000).
BLOCKS = 4
#: Rows of a tile, held by a task; rows that meet it there at most, some 2 billion pairs.
TILE, PIECE = 16_384, 131_072
#: Cells of a matrix of distances, and pairs verified at a time.
MATRIX, PAIRS = 1_000_000, 50_000
#: For what rounding may take from a squared distance, and from one in single precision (of vectors of length 1).
SLACK, FLOAT_SLACK = 1e-9, 1e-5


def rotation(dims: int) -> np.ndarray:
    """A fixed orthogonal matrix."""
    q, r = np.linalg.qr(np.random.default_rng(dims).standard_normal((dims, dims)))
    return q * np.sign(np.diag(r))


def bounds(dims: int, blocks: int, budget: float) -> list[tuple[int, int, float]]:
    """(from, to, share of the budget) for each block of coordinates."""
    cuts = np.linspace(0, dims, min(blocks, dims) + 1).round().astype(int).tolist()
    return [(a, b, budget * (b - a) / dims) for a, b in zip(cuts, cuts[1:], strict=False)]


def _later(grid: int) -> list[tuple[int, ...]]:
    """Neighbours of a cell that come after it."""
    return [x for x in product((-1, 0, 1), repeat=grid) if x > (0,) * grid]


def places(turned: np.ndarray, blocks: int, budget: float, grid: int) -> list[tuple[np.ndarray, int, np.ndarray, bool]]:
    """(rows, block, cells, whether they visit) of unit vectors: homes and the later neighbours that a row's ball reaches."""
    out = []
    for block, (a, b, share) in enumerate(bounds(turned.shape[1], blocks, budget)):
        width = np.sqrt(share) + SLACK
        at = turned[:, a : min(b, a + grid)] / width
        home = np.floor(at).astype(np.int64)
        code = lambda cells: (cells + 2**15) @ (2 ** (16 * np.arange(cells.shape[1])))
        out.append((np.arange(len(at)), block, code(home), False))
        for step in np.array(_later(at.shape[1])):
            gap = np.where(step > 0, home + 1 - at, np.where(step < 0, at - home, 0))
            near = np.flatnonzero((gap**2).sum(1) <= 1)
            out.append((near, block, code(home[near] + step), True))
    return out


def _placed(blocks: int, budget: float, grid: int):
    schema = pa.schema([
        ("node", pa.int64()), ("size", pa.int64()), ("dims", pa.int32()), ("block", pa.int32()), ("cell", pa.int64()),
        ("visits", pa.bool_()), ("vector", pa.binary()),
    ])

    def run(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, 500):
                node, size, raw = (c.to_pylist() for c in batch.slice(start, 500).columns)
                by_dims: dict[int, list[int]] = {}
                for i, v in enumerate(raw):
                    by_dims.setdefault(len(v), []).append(i)
                for dims, rows in by_dims.items():
                    turned = np.array([raw[i] for i in rows])
                    turned /= np.abs(turned).max(1, keepdims=True)  # so that no square overflows or vanishes
                    turned = turned / np.linalg.norm(turned, axis=1, keepdims=True) @ rotation(dims)
                    packed = [v.tobytes() for v in turned]
                    for which, block, cells, visits in places(turned, blocks, budget, grid):
                        columns = [
                            [node[rows[i]] for i in which], [size[rows[i]] for i in which], [dims] * len(which),
                            [block] * len(which), cells, [visits] * len(which), [packed[i] for i in which],
                        ]
                        arrays = [pa.array(c, t) for c, t in zip(columns, schema.types, strict=True)]
                        yield pa.RecordBatch.from_arrays(arrays, schema=schema)

    return run


def forest(labels: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The smallest place that each place reaches over links (i, j) and over labels."""
    while True:
        before = labels.copy()
        low = np.minimum(labels[i], labels[j])
        for x in (i, j):
            np.minimum.at(labels, before[x], low)
            np.minimum.at(labels, x, low)
        labels = labels[labels]
        if np.array_equal(labels, before):
            return labels


def _halves(x: np.ndarray, left: bool) -> np.ndarray:
    """x with two more coordinates, so that the product of a left and a right row is half their negative squared distance."""
    minus, one = -(x**2).sum(1, keepdims=True) / 2, np.ones((len(x), 1))
    return np.hstack([x, minus, one] if left else [x, one, minus]).astype(np.float32)


class Tile:
    """The rows of a group's own tile, what has met them, and what was found."""

    def __init__(self, dims: int, block: int, blocks: int, least: float):
        self.least, self.block, self.bounds = least, block, bounds(dims, blocks, 2 - 2 * least)
        self.node, self.size = np.empty(0, np.int64), np.empty(0, np.int64)
        self.vectors, self.left = np.empty((0, dims)), None

    def hold(self, node: np.ndarray, size: np.ndarray, vectors: np.ndarray) -> None:
        self.node, self.size = np.append(self.node, node), np.append(self.size, size)
        self.vectors = np.concatenate([self.vectors, vectors])

    def start(self, among: bool):
        """Everything is held now. among: whether the tile's own pairs are this group's to find."""
        self.links, self.label = np.zeros(len(self.node), np.int64), np.arange(len(self.node))
        if among:
            self.meet(self.node, self.size, self.vectors, own=True)

    def near(self, others: np.ndarray, own: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Linked pairs (own row, other row) that are this block's to count."""
        a, b, share = self.bounds[self.block]
        if self.left is None:
            self.left = _halves(self.vectors[:, a:b], left=True)
            self.room = np.empty(max(MATRIX, len(self.left)), np.float32), np.empty(max(MATRIX, len(self.left)), bool)
        for start in range(0, len(others), step := max(1, MATRIX // max(1, len(self.left)))):
            part = _halves(others[start : start + step, a:b], left=False)
            n = len(self.left) * len(part)
            product, within = (x[:n].reshape(len(self.left), -1) for x in self.room)
            np.matmul(self.left, part.T, out=product)
            np.greater_equal(product, np.float32(-share / 2 - FLOAT_SLACK), out=within)
            i, j = np.divmod(np.flatnonzero(within), len(part))
            j += start
            if own:
                i, j = i[i < j], j[i < j]
            for k in range(0, len(i), PAIRS):
                yield self.verified(i[k : k + PAIRS], j[k : k + PAIRS], others)

    def verified(self, i: np.ndarray, j: np.ndarray, others: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        x, y = self.vectors[i], others[j]
        on = (x * y).sum(1) >= self.least
        i, j, apart = i[on], j[on], (x[on] - y[on]) ** 2
        first = np.full(len(i), -1)
        for block, (a, b, share) in enumerate(self.bounds[: self.block + 1]):
            first[(first < 0) & (apart[:, a:b].sum(1) <= share + SLACK)] = block
        on = first == self.block
        return i[on], j[on]

    def meet(self, node: np.ndarray, size: np.ndarray, vectors: np.ndarray, own: bool = False):
        """(node, links, other end) rows of the others that have links with the tile."""
        links, n = np.zeros(len(node), np.int64), len(self.node)
        label = self.label if own else np.append(self.label, np.arange(n, n + len(node)))
        for i, j in self.near(vectors, own):
            if not len(i):
                continue
            self.links += np.bincount(i, size[j], n).astype(np.int64)
            links += np.bincount(j, self.size[i], len(node)).astype(np.int64)
            label = forest(label, i, j if own else j + n)
        self.label = label[:n]
        if own:
            self.links += links
            return None
        has = np.flatnonzero(links)
        return node[has], links[has], self.node[label[n:][has]]

    def rest(self):
        """The same of the tile's own rows."""
        has = np.flatnonzero(self.links)
        return self.node[has], self.links[has], self.node[self.label[has]]


_FOUND = pa.schema([("node", pa.int64()), ("links", pa.int64()), ("other", pa.int64())])
_GROUP = ["dims", "block", "cell", "tile", "piece"]


def _linked(blocks: int, least: float):
    """Rows sorted by group, the tile's own rows first: one tile is held at a time, the others pass by."""

    def batch_of(columns):
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], schema=_FOUND)

    def run(batches):
        group, tile, started = None, None, False
        for batch in batches:
            keys = np.array([batch.column(batch.schema.get_field_index(c)).to_numpy() for c in _GROUP]).T
            held = batch.column(batch.schema.get_field_index("held")).to_numpy(zero_copy_only=False)
            node, size = (batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("node", "size"))
            raw = batch.column(batch.schema.get_field_index("vector"))
            change = (keys[1:] != keys[:-1]).any(1) | (held[1:] != held[:-1])
            edges = [0, *(np.flatnonzero(change) + 1).tolist(), len(keys)]
            for a, b in zip(edges, edges[1:], strict=False):
                if a == b:
                    continue
                key = tuple(keys[a].tolist())
                if key != group:
                    if tile is not None:
                        if not started:
                            tile.start(group[-1] == 0)
                        yield batch_of(tile.rest())
                    group, tile, started = key, Tile(key[0], key[1], blocks, least), False
                rows = np.frombuffer(b"".join(raw.slice(a, b - a).to_pylist()), np.float64).reshape(b - a, -1)
                if held[a]:
                    tile.hold(node[a:b], size[a:b], rows)
                    continue
                if not started:
                    tile.start(key[-1] == 0)
                    started = True
                if len(tile.node):
                    yield batch_of(tile.meet(node[a:b], size[a:b], rows))
        if tile is not None:
            if not started:
                tile.start(group[-1] == 0)
            yield batch_of(tile.rest())

    return run


def _usable(v: Column) -> Column:
    """Whether all components are finite and one isn't zero."""
    ok = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.coalesce(ok & F.exists(v, lambda x: x != 0), F.lit(False))


def near_vectors(
    vectors: DataFrame, least: float = 0.9, blocks: int = BLOCKS, id_col: str = "vec_id", vector_col: str = "embedding",
) -> DataFrame:
    """One row for each input row: vec_id, n_links, component_id, kept, class_id.

    Two rows are linked when their vectors have as many components and a cosine of `least` (over 0, at most 1) or more, in
    double precision. n_links counts the other rows linked directly with a row, equal vectors included; component_id is
    the smallest id reachable over links, the row's own included; kept says that this is its own; class_id is the smallest id
    of the same vector. Vectors that are null, empty, zero, or hold a null or a component that isn't finite have no links, and
    neither have rows with a null id, whose component is null and which are kept. Ids are whole numbers; rows that repeat an
    id count as rows of their own. Other columns are ignored; an empty table gives an empty result.
    """
    budget = 2 - 2 * least
    rows = vectors.select(
        F.col(f"`{id_col}`").cast("long").alias("vec_id"), F.col(f"`{vector_col}`").cast("array<double>").alias("v"),
    ).withColumn("ok", _usable(F.col("v")) & F.col("vec_id").isNotNull())
    classes = rows.filter("ok").groupBy("v").agg(F.min("vec_id").alias("class_id"), F.count(F.lit(1)).alias("size"))
    classes = materialise(classes, "classes").withColumn("node", F.monotonically_increasing_id())
    classes = materialise(classes, "numbered")
    n = classes.count()
    # As many coordinates in the grid as keep a cell near the size of a tile, at some six cells a coordinate.
    grid = 1
    while grid < 3 and n > TILE * 6**grid:
        grid += 1
    placed = materialise(
        classes.select("node", "size", "v").repartition("node").mapInArrow(
            _placed(blocks, budget, grid),
            "node long, size long, dims int, block int, cell long, visits boolean, vector binary",
        ), "placed",
    )
    cell = ["dims", "block", "cell"]
    crowd = placed.groupBy(*cell).agg(F.count_if(~F.col("visits")).alias("homes"), F.count(F.lit(1)).alias("all"))
    crowd = crowd.filter("homes > 0").select(
        *cell, F.ceil(F.col("homes") / TILE).alias("tiles"), F.ceil(F.col("all") / PIECE).alias("pieces"),
    )
    # Few cells are over these limits (each takes so many rows of its block); the others have one tile and one piece.
    large = F.broadcast(crowd.filter("tiles > 1 or pieces > 1"))
    dealt = placed.join(large, cell, "left").withColumns({
        "tiles": F.coalesce("tiles", F.lit(1)), "pieces": F.coalesce("pieces", F.lit(1)),
    })
    own = F.pmod(F.xxhash64("node"), F.col("tiles"))
    piece = F.pmod(F.xxhash64("node", F.lit(1)), F.col("pieces"))
    zero = F.lit(0).cast("long")
    held = F.transform(
        F.sequence(zero, F.col("pieces") - 1), lambda p: F.struct(own.alias("tile"), p.alias("piece"), F.lit(True).alias("held")),
    )
    met = F.when(F.col("visits"), F.col("tiles")).otherwise(own)
    passing = F.when(met > 0, F.transform(
        F.sequence(zero, met - 1), lambda t: F.struct(t.alias("tile"), piece.alias("piece"), F.lit(False).alias("held")),
    )).otherwise(F.array())
    roles = F.when(F.col("visits"), passing).otherwise(F.concat(held, passing))
    groups = dealt.select("node", "size", *cell, "vector", F.explode(roles).alias("role")).select(
        "node", "size", *cell, "vector", "role.*",
    )
    groups = groups.repartition(*_GROUP).sortWithinPartitions(*_GROUP, F.desc("held"))
    found = materialise(groups.mapInArrow(_linked(blocks, least), "node long, links long, other long"), "found")
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    edges = found.filter("node <> other").select(F.col("node").alias("a"), F.col("other").alias("b"))
    roots = components(edges, n * (blocks + 1))
    known = classes.select("v", "class_id", "size", "node").join(links, "node", "left").join(
        roots.withColumnRenamed("id", "node"), "node", "left",
    ).withColumn("root", F.coalesce("root", "node"))
    known = materialise(known.withColumn("links", F.coalesce("links", zero) + F.col("size") - 1), "known")
    # A component may be a third of all classes: its smallest id is met by its size, like any hot group.
    tops = known.groupBy("root").agg(F.min("class_id").alias("component_id"), F.count(F.lit(1)).alias("_n"))
    known = materialise(join_groups(known, tops, "root", "_n", n).select("v", "class_id", "size", "links", "component_id"), "tops")
    linked = join_groups(rows.filter("ok").select("vec_id", "v"), known.withColumnRenamed("size", "_size"), "v", "_size", n)
    alone = rows.filter("not ok").select(
        "vec_id", zero.alias("links"), F.col("vec_id").alias("component_id"), F.col("vec_id").alias("class_id"),
    )
    every = linked.select("vec_id", "links", "component_id", "class_id").unionByName(alone)
    return every.select(
        "vec_id", F.col("links").alias("n_links"), "component_id",
        F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)).alias("kept"), "class_id",
    )
