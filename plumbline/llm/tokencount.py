"""Token counts by a linear longest-match automaton.

The vocabulary becomes a trie. Each node knows where to go on when its next byte doesn't match (its failure
link) and how many pieces greedy matching has then completed (its popped count), so a word is counted in one
pass over its bytes, without back-tracking and without building pieces. Resolved into one table of
transitions, the automaton runs over all words of a stretch of text at once.
"""

from __future__ import annotations

import base64

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, modest_batches

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"


def read_vocabulary(path: str) -> list[bytes]:
    """Pieces of a file with one base64-coded piece and its rank a line."""
    with open(path, "rb") as lines:
        return [base64.b64decode(line.split()[0]) for line in lines if line.strip()]


class Automaton:
    """step[node, byte] and popped[node, byte]: the next node, and the pieces completed by going there; last[node]:
    the pieces that remain to be counted at a word's end."""

    def __init__(self, vocabulary: list[bytes]):
        pieces = {p for p in vocabulary if p}
        missing = [b for b in range(256) if bytes([b]) not in pieces]
        children: list[dict[int, int]] = [{}]
        ends, parent, order = [False], [(0, 0)], [0]
        for p in [*pieces, *(bytes([b]) for b in missing)]:
            at = 0
            for c in p:
                nxt = children[at].get(c)
                if nxt is None:
                    nxt = children[at][c] = len(children)
                    children.append({})
                    ends.append(False)
                    parent.append((at, c))
                at = nxt
            ends[at] = True
        n = len(children)
        self.step = np.zeros((n, 256), np.int32)
        self.popped = np.zeros((n, 256), np.int16)
        fail, pops = np.zeros(n, np.int64), np.zeros(n, np.int64)
        for at in order:  # breadth first: a failure link leads to a shallower node, whose row is complete
            for c, nxt in children[at].items():
                if ends[nxt]:
                    fail[nxt], pops[nxt] = 0, 1
                else:
                    fail[nxt], pops[nxt] = self.step[fail[at], c], pops[at] + self.popped[fail[at], c]
                order.append(nxt)
            if at:
                self.step[at] = self.step[fail[at]]
                self.popped[at] = pops[at] + self.popped[fail[at]]
            for c, nxt in children[at].items():
                self.step[at, c], self.popped[at, c] = nxt, 0
        self.last = np.zeros(n, np.int64)
        for at in order[1:]:
            self.last[at] = pops[at] + self.last[fail[at]]

    def count(self, data: np.ndarray, begin: np.ndarray, end: np.ndarray, prefix: int | None = None) -> np.ndarray:
        """Pieces of each word data[begin:end], after a prefix byte if one is given."""
        size = end - begin
        order = np.argsort(-size, kind="stable")
        begin, size = begin[order], size[order]
        node = np.zeros(len(begin), np.int32)
        total = np.zeros(len(begin), np.int64)
        if prefix is not None:
            node[:] = self.step[0, prefix]
        active = len(begin)
        for j in range(int(size[0]) if len(size) else 0):
            active = int(np.searchsorted(-size[:active], -j, side="left"))
            byte = data[begin[:active] + j]
            total[:active] += self.popped[node[:active], byte]
            node[:active] = self.step[node[:active], byte]
        out = np.empty(len(total), np.int64)
        out[order] = total + self.last[node]
        return out


_BUILT: dict[int, Automaton] = {}


def _automaton(vocabulary: list[bytes]) -> Automaton:
    """The automaton of this worker, kept from task to task."""
    key = hash(tuple(vocabulary))
    if key not in _BUILT:
        _BUILT.clear()
        _BUILT[key] = Automaton(vocabulary)
    return _BUILT[key]


def _count(vocabulary):
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_tokens", pa.int64())])
    space = np.zeros(256, bool)
    space[[9, 10, 11, 12, 13, 32]] = True

    def run(batches):
        automaton = _automaton(vocabulary.value)
        for ids, text in chunks(batches, ["doc_id", "text"], "text"):
            raw = [t.encode() if t else b"" for t in text]
            data = np.frombuffer(b" ".join(raw) + b" ", np.uint8)
            edge = np.flatnonzero(np.diff(np.concatenate([[0], (~space[data]).view(np.int8), [0]])))
            begin, end = edge[::2], edge[1::2]
            pieces = automaton.count(data, begin, end, prefix=32)
            starts = np.cumsum([0, *(len(r) + 1 for r in raw)])
            first = np.searchsorted(begin, starts)
            upto = np.concatenate([[0], np.cumsum(pieces)])
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(np.diff(first)), pa.array(upto[first[1:]] - upto[first[:-1]])],
                schema=schema,
            )

    return run


def token_counts(
    docs: DataFrame, vocabulary: str = VOCABULARY, id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """One row for each input row: doc_id, n_words, n_tokens.

    Words are runs of anything but ASCII white space. Each is counted as one leading space and its UTF-8 bytes,
    cut from the left into the longest pieces of the vocabulary; a byte that isn't a piece counts as one. A null
    or blank text has 0. Rows stand alone: repeated rows and ids count each for itself. Other columns are
    ignored; an empty table gives an empty result. The vocabulary (read by the driver) is broadcast, nothing
    shuffles, and a worker holds one automaton and a few MB of text, or one text if that is longer.
    """
    modest_batches(docs.sparkSession)
    pieces = docs.sparkSession.sparkContext.broadcast(read_vocabulary(vocabulary))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(_count(pieces), "doc_id long, n_words long, n_tokens long")
