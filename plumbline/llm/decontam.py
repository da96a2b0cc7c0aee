"""Benchmark decontamination: a broadcast hash set of normalised test n-grams, scanned over all training text.

Words of the benchmark get numbers; a training text becomes a line of such numbers (0 for words that no item has), hashes
of its windows are looked up in the sorted hashes of the benchmark's, and hits are verified word by word.
"""

from __future__ import annotations

import hashlib
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, materialise, modest_batches, odd

#: Maps A-Z to a-z, keeps 0-9, a-z and all bytes of non-ASCII characters, and turns the rest into spaces.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_B = odd(3, 1)[0]
#: Characters of items in one broadcast set: some 130 MB of arrays.
BLOCK_CHARS = 16_000_000


def words(text: str | None) -> list[bytes]:
    """Lower-cased (A-Z) runs of digits, ASCII letters and non-ASCII characters."""
    return text.encode().translate(_FOLD).split() if text else []


class GramSet:
    """The windows of one block of benchmark items: a number for each word they have, all words' numbers in one line, and for
    each distinct window its hash and first place there. That is some 30 bytes a word, and 100 a distinct word."""

    def __init__(self, items: list[tuple[int | None, str | None]], n: int):
        lists = [words(text) for _, text in items]
        sizes = np.array([len(x) for x in lists], np.int64)
        self.number: dict[bytes, int] = {}
        self.names = [str(i) for i, _ in items]
        self.line = np.array([self.number.setdefault(w, len(self.number) + 1) for x in lists for w in x], np.uint32)
        item, length = np.repeat(np.arange(len(items)), sizes), np.minimum(sizes, n)
        #: window length -> (sorted hashes, first word, item) of its windows; of equal windows of an item, one
        self.windows: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        for k in sorted(set(length[length > 0].tolist())):
            first = item[: len(item) - k + 1]
            at = np.flatnonzero((first == item[k - 1 :]) & (length[first] == k))
            h = _roll(self.line, k)[at]
            order = np.lexsort((at, item[at], h))
            h, at = h[order], at[order]
            new = np.concatenate([[True], (h[1:] != h[:-1]) | (item[at[1:]] != item[at[:-1]])])
            self.windows[k] = h[new], at[new], item[at[new]]

    def hits(self, line: np.ndarray, doc: np.ndarray):
        """(first word, length, names of items) of each window in a line of word numbers (0 for words that no item has) of
        several documents; what the hashes find is held against the words themselves."""
        for k, (known, at, item) in self.windows.items():
            if len(line) < k:
                continue
            whole = np.convolve(line == 0, np.ones(k, int), "valid") == 0
            here = np.flatnonzero(whole & (doc[: len(line) - k + 1] == doc[k - 1 :]))
            h = _roll(line, k)[here]
            left = np.searchsorted(known, h)
            found = np.flatnonzero(known[np.minimum(left, len(known) - 1)] == h)
            for i, j, x in zip(here[found].tolist(), left[found].tolist(), h[found].tolist(), strict=True):
                names = set()
                while j < len(known) and known[j] == x:
                    if np.array_equal(self.line[at[j] : at[j] + k], line[i : i + k]):
                        names.add(self.names[item[j]])
                    j += 1
                if names:
                    yield i, k, names


def _roll(line: np.ndarray, k: int) -> np.ndarray:
    out = np.zeros(max(0, len(line) - k + 1), np.uint64)
    for j in range(k):
        out = out * _B + line[j : j + len(out)].astype(np.uint64)
    return out


def _scanned(g: GramSet, text: list):
    """(number of the text, first word of the hit in it, length, items) of each hit in texts."""
    lists = [words(t) for t in text]
    sizes = np.array([len(x) for x in lists], np.int64)
    starts = np.concatenate([[0], np.cumsum(sizes)])
    line = np.fromiter((y for x in lists for y in map(g.number.get, x, repeat(0))), np.uint32, int(starts[-1]))
    doc = np.repeat(np.arange(len(lists)), sizes)
    for i, k, found in g.hits(line, doc):
        d = int(doc[i])
        yield d, i - int(starts[d]), k, found


def _pass(grams, schema: pa.Schema):
    """Arrow batches of (key columns, text, n_words, hits, items) with one block's hits and items added."""

    def run(batches):
        g = grams.value
        for *rest, text, old, items in chunks(batches, [*schema.names[:-3], "text", "hits", "items"], "text"):
            marks: dict[int, set] = {}
            names: dict[int, set] = {}
            for d, i, k, found in _scanned(g, text):
                marks.setdefault(d, set()).update(range(i, i + k))
                names.setdefault(d, set()).update(found)
            hits = [
                np.array(sorted(marks[d] | set(np.frombuffer(o, np.uint32).tolist())), np.uint32).tobytes()
                if d in marks else o for d, o in enumerate(old)
            ]
            got = [sorted({*(o or ()), *names[d]}) if d in names else o for d, o in enumerate(items)]
            cols = [*rest, text, hits, got]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(cols, schema.types, strict=True)], schema=schema,
            )

    return run


def _finish(schema: pa.Schema, width: int):
    def run(batches):
        for *rest, text, hits, items in chunks(batches, [*schema.names[:width], "text", "hits", "items"], "text"):
            n_hit = [len(h) // 4 for h in hits]
            n_words = [len(words(t)) for t in text]
            sha = [hashlib.sha256(",".join(i).encode()).hexdigest() for i in items]
            clean = []
            for t, h in zip(text, hits, strict=True):
                clean.append(cut(t, np.frombuffer(h, np.uint32)) if len(h) else t)
            cols = [*rest, n_words, n_hit, [len(i) for i in items], sha, [n > 0 for n in n_hit], clean]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(cols, schema.types, strict=True)], schema=schema,
            )

    return run


def cut(text: str, hit: np.ndarray) -> str:
    """text without the words numbered in hit, and without what stands between two neighbouring ones of them."""
    raw = text.encode()
    at = np.frombuffer(raw.translate(_FOLD), np.uint8) != 32
    edge = np.flatnonzero(np.diff(np.concatenate([[0], at.view(np.int8), [0]])))
    begin, end = edge[::2], edge[1::2]
    out, last, before = [], 0, -2
    for i in hit.tolist():
        if i != before + 1:
            out.append(raw[last : begin[i]])
        last, before = int(end[i]), i
    return b"".join([*out, raw[last:]]).decode()


def decontaminate(
    docs: DataFrame, benchmark: DataFrame, n: int = 10, id_col: str = "doc_id", text_col: str = "text",
    item_col: str = "item_id", item_text_col: str = "text", block_chars: int = BLOCK_CHARS,
) -> DataFrame:
    """One row for each input row: doc_id, n_words, n_hit, n_items, items_sha256, contaminated, clean_text.

    A window is n consecutive words of an item (all of them if it has fewer, but some); a document's words are
    hit if they lie in any occurrence of one. n_items counts items with windows that occur; items of equal id
    are one, a null id shows as "None". clean_text is the text without hit words. A null text has no words and
    stays null; an item without words has no window. An empty benchmark hits nothing, an empty table gives an
    empty result. Other columns of docs are ignored.

    The broadcast set is built from at most block_chars characters of items at a time (plus one item); a larger
    benchmark is scanned in blocks, one after the other, with what was found written in between; no row of docs ever
    shuffles.
    """
    modest_batches(docs.sparkSession)
    kind = dict(docs.select(F.col(id_col).alias("doc_id")).dtypes)["doc_id"]
    df = docs.select(
        F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.lit(b"").alias("hits"),
        F.array().cast("array<string>").alias("items"),
    )
    id_type = pa.int64() if kind == "bigint" else pa.int32() if kind == "int" else pa.string()
    if not pa.types.is_integer(id_type):
        df = df.withColumn("doc_id", F.col("doc_id").cast("string"))
    state = pa.schema(
        [("doc_id", id_type), ("text", pa.string()), ("hits", pa.binary()), ("items", pa.list_(pa.string()))]
    )
    sets = _gram_sets(benchmark, n, item_col, item_text_col, block_chars)
    df = _by_blocks(df, sets, lambda rows, grams: rows.mapInArrow(_pass(grams, state), rows.schema))
    ddl = f"doc_id {df.schema['doc_id'].dataType.simpleString()}, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, clean_text string"
    last = pa.schema(
        [
            ("doc_id", id_type), ("n_words", pa.int64()), ("n_hit", pa.int64()), ("n_items", pa.int64()),
            ("items_sha256", pa.string()), ("contaminated", pa.bool_()), ("clean_text", pa.string())
        ]
    )
    return df.mapInArrow(_finish(last, 1), ddl)


def drop_contaminated(
    docs: DataFrame, benchmark: DataFrame, text_col: str = "text", n: int = 10, item_col: str = "item_id",
    item_text_col: str = "text", block_chars: int = BLOCK_CHARS,
) -> DataFrame:
    """docs, with all columns, whatever their names, without the rows whose text holds a window of the benchmark. Nothing
    shuffles: each row is scanned in place, so repeated rows stay or go alike. Rows with a null or empty text stay; an
    empty benchmark drops nothing; an empty table stays empty."""
    modest_batches(docs.sparkSession)
    sets = _gram_sets(benchmark, n, item_col, item_text_col, block_chars)
    return _by_blocks(docs, sets, lambda rows, grams: rows.mapInArrow(_keep(grams, text_col), rows.schema))


def _by_blocks(rows: DataFrame, sets, scan) -> DataFrame:
    """rows scanned against one set after the other. What comes out is written before the next set is used, so that no stage,
    and no executor, holds two of them: a benchmark of several blocks costs as many writes of the rows, less one."""
    before = None
    for grams in sets:
        if before is not None:
            rows = materialise(rows, "scanned")
            before.unpersist()
        rows, before = scan(rows, grams), grams
    return rows


def _gram_sets(benchmark: DataFrame, n: int, item_col: str, item_text_col: str, block_chars: int):
    """Broadcast GramSets of blocks of a benchmark's items."""
    spark = benchmark.sparkSession
    items = benchmark.select(F.col(item_col).alias("i"), F.col(item_text_col).alias("t")).filter("t is not null")
    total = items.agg(F.sum(F.length("t")).alias("c")).first()["c"] or 0
    blocks = max(1, -(-total // block_chars))
    for b in range(blocks):
        part = items if blocks == 1 else items.filter(F.pmod(F.xxhash64("t"), F.lit(blocks)) == b)
        yield spark.sparkContext.broadcast(GramSet([(r["i"], r["t"]) for r in part.toLocalIterator()], n))


def _keep(grams, text_col: str):
    def run(batches):
        g = grams.value
        for batch in batches:
            keep = []
            for (text,) in chunks([batch], [text_col], text_col):
                bad = {d for d, *_ in _scanned(g, text)}
                keep += [d not in bad for d in range(len(text))]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return run
