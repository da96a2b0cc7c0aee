"""Encoders of texts as unit vectors, in sparse form: id, bucket, weight. An index works with any object that has a name,
fit, encode and close."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from ..functions import questions as Q
from ..operators import blocks
from ..operators import index as X


class HashingEncoder:
    """Signed hashed TF-IDF over unigrams and bigrams, by the digest md5 or blake2b."""

    def __init__(self, dim: int = 1024, digest: str = "md5"):
        self.dim, self.digest, self.name = dim, digest, f"hashing-{dim}" + ("" if digest == "md5" else f"-{digest}")

    def fit(self, docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
        self.n = docs.count()
        vectors, idf = blocks.feature_weights(docs, id_col, text_col, self.dim, self.digest)
        self.idf = idf.persist()
        return vectors

    def encode(self, queries: DataFrame, qid_col: str, text_col: str, expand: bool) -> DataFrame:
        return X.encode(queries, qid_col, text_col, self.idf, self.n, self.dim, expand, self.digest)

    def close(self) -> None:
        self.idf.unpersist()


class SentenceEncoder:
    """Any model that turns a list of texts into rows of numbers; by default a sentence-transformers model, where that
    package is installed. load runs once in each Python worker, and texts go through it in Arrow batches."""

    def __init__(
        self, load=None, name: str = "sentence-transformers", model: str = "sentence-transformers/all-MiniLM-L6-v2",
    ):
        self.load, self.name, self.model = load, name, model
        if load is None:
            import sentence_transformers  # noqa: F401 - fails here rather than in a worker

    def _vectors(self, df: DataFrame, key: str, text_col: str, id_col: str, expand: bool) -> DataFrame:
        load, model = self.load, self.model

        def run(batches):
            encode = load() if load else _transformer(model)
            for frame in batches:
                said = [" ".join(Q.tokenize(t or "", True)) if expand else t or "" for t in frame["_text"]]
                v = np.asarray(encode(said), float).reshape(len(said), -1)
                v /= np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)
                for i, row in zip(frame["_id"], v, strict=True):
                    at = np.flatnonzero(row)
                    yield pd.DataFrame({key: [i] * len(at), "bucket": at.astype("int32"), "weight": row[at]})

        kind = dict(df.dtypes)[id_col]
        rows = df.selectExpr(f"`{id_col}` AS _id", f"`{text_col}` AS _text")
        return rows.mapInPandas(run, f"{key} {kind}, bucket int, weight double")

    def fit(self, docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
        return self._vectors(docs, "id", text_col, id_col, False)

    def encode(self, queries: DataFrame, qid_col: str, text_col: str, expand: bool) -> DataFrame:
        return self._vectors(queries, "qid", text_col, qid_col, False)

    def close(self) -> None:
        pass


def _transformer(model: str):
    from sentence_transformers import SentenceTransformer

    held = SentenceTransformer(model)
    return lambda texts: held.encode(texts, normalize_embeddings=True)
