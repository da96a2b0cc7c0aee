"""Substring de-duplication: windows of words that occur in an earlier document are removed.

Counting every window exactly would shuffle the whole corpus, so a count-min sketch decides first which windows
can be repeated at all. What it counts is each window's smallest 7-word run (its minimiser), once a position:
a window is no more frequent than its minimiser, and neighbouring windows share theirs, so a quarter of the
insertions do. Sketches of partitions merge by saturating addition; their estimates never fall short. The second
pass sends only windows estimated repeated, each distinct one once for each stretch of text a task reads, to be
grouped exactly by a 96-bit hash.
"""

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import (
    PIECE, WordHash, chunks, gram_hashes, id_filter, join_groups, materialise, mix, modest_batches, pack, unpack,
    with_ids, without_ids,
)

DEPTH = 2
#: Words a window's minimiser has.
GRAM = 7


def _lines(texts: list, of) -> tuple[np.ndarray, np.ndarray, list]:
    """Word hashes of several texts in one line, the text of each word, and the words themselves."""
    lists = [t.encode().split() if t else [] for t in texts]
    sizes = np.array([len(x) for x in lists], np.int64)
    return of([w for x in lists for w in x]), np.repeat(np.arange(len(lists)), sizes), lists


def minimisers(line: np.ndarray, doc: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each window that lies in one document: its first word, and its minimiser's position and hash."""
    n = len(line) - window + 1
    if n <= 0:
        return (np.empty(0, np.int64),) * 2 + (np.empty(0, np.uint64),)
    k = min(GRAM, window)
    grams = gram_hashes(line, k, seed=21)
    best, at = grams[:n].copy(), np.arange(n)
    for j in range(1, window - k + 1):
        nxt = grams[j : j + n]
        less = nxt < best
        best = np.where(less, nxt, best)
        at = np.where(less, np.arange(j, j + n), at)
    ok = np.flatnonzero(doc[:n] == doc[window - 1 :])
    return ok, at[ok], best[ok]


def _cells(h: np.ndarray, row: int, width: int) -> np.ndarray:
    return mix(h + np.uint64(row * 0x9E3779B9 + 1)) & np.uint64(width - 1)


_BLOCK = pa.schema([("row", pa.int32()), ("block", pa.int32()), ("once", pa.binary()), ("twice", pa.binary())])


def _emit(seen: list[np.ndarray], width: int):
    h = np.concatenate(seen)
    rows: list = [[], [], [], []]
    for r in range(DEPTH):
        cells, times = np.unique(_cells(h, r, width), return_counts=True)
        edges = np.flatnonzero(np.diff(cells >> np.uint64(16))) + 1
        for c, t in zip(np.split(cells, edges), np.split(times, edges), strict=True):
            low = (c & np.uint64(PIECE - 1)).astype(np.int64)
            for col, x in zip(rows, (r, int(c[0] >> np.uint64(16)), pack(low), pack(low[t > 1])), strict=True):
                col.append(x)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, _BLOCK.types, strict=True)], schema=_BLOCK)


def _sketch(window: int, width: int, known, most: int = 2_000_000):
    """The sketch of a partition, in parts of up to `most` insertions."""

    def run(batches):
        of, seen, held = WordHash().of, [], 0
        for ids, text in chunks(batches, ["doc_id", "text"], "text"):
            _, text = _originals(ids, text, known)
            line, doc, _ = _lines(text, of)
            _, at, h = minimisers(line, doc, window)
            _, first = np.unique(at, return_index=True)
            if len(first):
                seen.append(h[first])
                held += len(first)
            if held > most:
                yield _emit(seen, width)
                seen, held = [], 0
        if held:
            yield _emit(seen, width)

    return run


def _merge(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Saturating sum of one block's counts over all partial sketches, one batch of them at a time."""
    once = np.zeros(PIECE, bool)
    twice = np.zeros(PIECE, bool)
    for batch in batches:
        for o, t in zip(batch.column("once").to_pylist(), batch.column("twice").to_pylist(), strict=True):
            bits = unpack(o)
            twice |= unpack(t) | (once & bits)
            once |= bits
    yield pa.RecordBatch.from_pydict(
        {
            "row": pa.array([key[0].as_py()], pa.int32()), "block": pa.array([key[1].as_py()], pa.int32()),
            "bits": pa.array([np.packbits(twice).tobytes()], pa.binary()),
        }
    )


_HIT = pa.schema(
    [("doc_id", pa.int64()), ("pos", pa.int32()), ("h", pa.int64()), ("g", pa.int32()), ("known", pa.bool_())]
)


_SEQ = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("seq", pa.binary())])


def _sequences(batches):
    for ids, text in chunks(batches, ["doc_id", "text"], "text"):
        words = [t.encode().split() if t else [] for t in text]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(ids, pa.int64()), pa.array([len(w) for w in words]),
                pa.array([xxhash.xxh3_128_digest(b" ".join(w)) for w in words], pa.binary())
            ],
            schema=_SEQ,
        )


def _originals(ids, text, known):
    """The rows that may be nobody's copy."""
    keep = known.value.maybe(np.array(ids, np.int64)).tolist()
    return [i for i, k in zip(ids, keep, strict=True) if k], [t for t, k in zip(text, keep, strict=True) if k]


class Seen:
    """The windows that a task has sent, with the smallest document each was sent for: the last `most` of them. Windows
    forgotten are sent once more, which costs a row and changes nothing."""

    def __init__(self, most: int = 1_000_000):
        self.most = most
        self.h, self.g, self.least = np.empty(0, np.uint64), np.empty(0, np.int32), np.empty(0, np.int64)

    def known(self, h: np.ndarray, g: np.ndarray) -> np.ndarray:
        """The smallest document that each of the distinct windows (by rising h) was sent for, or the largest number."""
        out = np.full(len(h), np.iinfo(np.int64).max)
        if len(self.h):
            at = np.minimum(np.searchsorted(self.h, h), len(self.h) - 1)
            same = (self.h[at] == h) & (self.g[at] == g)
            out[same] = self.least[at[same]]
        return out

    def add(self, h: np.ndarray, g: np.ndarray, least: np.ndarray) -> None:
        if len(self.h) + len(h) > self.most:
            self.h, self.g, self.least = self.h[:0], self.g[:0], self.least[:0]
        h, g, least = (np.concatenate(x) for x in ((self.h, h), (self.g, g), (self.least, least)))
        order = np.lexsort((least, h))
        h, g, least = h[order], g[order], least[order]
        first = np.concatenate([[True], h[1:] != h[:-1]])
        self.h, self.g, self.least = h[first], g[first], least[first]


def _repeated(window: int, width: int, filters, known):
    """Windows estimated repeated. Of equal windows of a task only those in the smallest document so far are sent to be
    grouped; the others are known to be covered at once, and get a key of their own. So a window that every text has
    makes a row a task in its group, or a few."""

    def run(batches):
        of, sent = WordHash().of, Seen()
        bits = filters.value
        for ids, text in chunks(batches, ["doc_id", "text"], "text"):
            ids, text = _originals(ids, text, known)
            line, doc, _ = _lines(text, of)
            first, _, m = minimisers(line, doc, window)
            ok = np.ones(len(first), bool)
            for r in range(DEPTH):
                c = _cells(m, r, width).astype(np.int64)
                ok &= (bits[r][c >> 3] >> (7 - (c & 7)).astype(np.uint8)) & 1 == 1
            first = first[ok]
            if not len(first):
                continue
            h = gram_hashes(line, window, seed=22)[first]
            g = (gram_hashes(line, window, seed=23)[first] >> np.uint64(32)).astype(np.uint32).view(np.int32)
            owner = np.array(ids, np.int64)[doc[first]]
            begin = np.searchsorted(doc, np.arange(len(text)))
            pos = (first - begin[doc[first]]).astype(np.int32)
            order = np.lexsort((pos, owner, g, h))
            h, g, owner, pos = h[order], g[order], owner[order], pos[order]
            new = np.concatenate([[True], (h[1:] != h[:-1]) | (g[1:] != g[:-1])])
            least = owner[new]
            before = sent.known(h[new], g[new])
            fresh = least < before
            sent.add(h[new][fresh], g[new][fresh], least[fresh])
            sure = owner != np.minimum(least, before)[np.cumsum(new) - 1]
            h = np.where(sure, mix(owner.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + pos.astype(np.uint64)), h)
            for i in range(0, len(h), 50_000):
                z = slice(i, i + 50_000)
                columns = [pa.array(x[z]) for x in (owner, pos, h.view(np.int64), g, sure)]
                yield pa.RecordBatch.from_arrays(columns, schema=_HIT)

    return run


def _apply(window: int):
    schema = pa.schema(
        [
            ("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string()),
            ("kept_text", pa.string())
        ]
    )

    def run(batches):
        for ids, text, starts, copy in chunks(batches, ["doc_id", "text", "starts", "copy"], "text"):
            rows = []
            for i, t, s, c in zip(ids, text, starts, copy, strict=True):
                words = t.encode().split() if t else []
                if c and len(words) >= window:
                    s = range(len(words) - window + 1)
                gone = np.zeros(len(words) + 1, np.int64)
                if s:
                    at = np.unique(np.array(s, np.int64))
                    np.add.at(gone, at, 1)
                    np.add.at(gone, at + window, -1)
                gone = np.cumsum(gone)[:-1] > 0
                kept = b" ".join(words if not s else [w for w, x in zip(words, gone.tolist(), strict=True) if not x])
                rows.append((i, len(words), int(gone.sum()), hashlib.sha256(kept).hexdigest(), kept.decode()))
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema,
            )

    return run


def substring_dedup(
    docs: DataFrame, window: int = 13, id_col: str = "doc_id", text_col: str = "text", max_cells: int = 1 << 28,
) -> DataFrame:
    """One row for each input row: doc_id, n_words, n_removed, kept_sha256, kept_text.

    Ids are whole numbers. Words are runs of anything but ASCII white space, unchanged; a window is `window` consecutive words of one
    document. Each word is removed that a window covers whose words also start in a document with a smaller id,
    as judged on the input. kept_text joins the other words by one space. A null text has no words, a text of
    fewer words than a window loses none. Rows with a null id neither cover nor lose anything. Rows that repeat
    an id are one document, so they don't cover each other, but lose the same. Other columns are ignored. An
    empty table gives an empty result.

    The sketch has DEPTH rows of up to max_cells cells; merged and reduced to "counted twice or more" it is
    broadcast as DEPTH * max_cells / 8 bytes (64 MB) at most. Over some 200 million insertions it fills up and
    passes more windows on; the result stays exact.
    """
    modest_batches(docs.sparkSession)
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    named = rows.filter("doc_id is not null")
    n_chars = named.agg(F.sum(F.length("text"))).first()[0] or 0
    width = 1 << 20
    while width < max_cells and width * 8 < n_chars:  # some 25 characters an insertion
        width *= 2
    # Whoever has the words of a smaller id from first to last loses them all, and needs no windows.
    seqs = materialise(named.mapInArrow(_sequences, "doc_id long, n_words long, seq binary"), "sequences")
    least = materialise(
        seqs.groupBy("seq").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("_size")), "least",
    )
    n = seqs.count()
    copies = join_groups(
        seqs.select("doc_id", "seq"), least, "seq", "_size", n,
    ).filter("doc_id > least").select("doc_id", F.lit(True).alias("copy")).distinct()
    known = id_filter(least.select("least"))
    partial = named.mapInArrow(_sketch(window, width, known), "row int, block int, once binary, twice binary")
    merged = partial.groupBy("row", "block").applyInArrow(_merge, "row int, block int, bits binary")
    bits = np.zeros((DEPTH, width // 8), np.uint8)
    for r in merged.toLocalIterator():
        bits[r["row"], r["block"] * PIECE // 8 : (r["block"] + 1) * PIECE // 8] = np.frombuffer(r["bits"], np.uint8)
    filters = spark.sparkContext.broadcast(bits)
    hits = named.mapInArrow(
        _repeated(window, width, filters, known), "doc_id long, pos int, h long, g int, known boolean",
    )
    # Equal windows of a task are one row or a few, so a group has hardly more rows than there are tasks.
    least_of = F.min("doc_id").over(Window.partitionBy("h", "g", "known"))
    covered = hits.withColumn("least", least_of).filter("known or doc_id > least").select("doc_id", "pos")
    starts = covered.groupBy("doc_id").agg(F.collect_set("pos").alias("starts"))
    marks = materialise(
        starts.join(copies, "doc_id", "full").select(
            "doc_id", "starts", F.coalesce("copy", F.lit(False)).alias("copy"),
        ),
        "marks", n,
    )
    # Only texts that lose something move to what is known of them.
    touched = marks.select("doc_id")
    nothing = [F.lit(None).cast("array<int>").alias("starts"), F.lit(False).alias("copy")]
    whole = without_ids(rows, touched, "doc_id").select("doc_id", "text", *nothing)
    marked = whole.unionByName(with_ids(rows, touched, "doc_id").join(marks, "doc_id"))
    return marked.mapInArrow(
        _apply(window), "doc_id long, n_words long, n_removed long, kept_sha256 string, kept_text string",
    )

