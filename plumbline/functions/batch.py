"""What questions ask for, over whole tables: driver-side readers in Arrow batches of Python workers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Texts whose readings a task keeps.
KEPT = 20_000


def read(df: DataFrame, text_col: str, readers: dict[str, tuple[str, Callable]]) -> DataFrame:
    """df with a column for each reader: name -> (type, function of the text). A null text counts as empty. Of a batch's equal
    texts one is read; a read text is kept for the next batches of the task, up to KEPT of them."""
    out = df
    for name, (kind, _) in readers.items():
        out = out.withColumn(name, F.lit(None).cast(kind))

    def run(frames):
        known = {}
        for frame in frames:
            texts = [t or "" for t in frame[text_col]]
            if len(known) > KEPT:
                known = {}
            for t in set(texts) - known.keys():
                known[t] = [f(t) for _, f in readers.values()]
            yield frame.assign(**{name: [known[t][i] for t in texts] for i, name in enumerate(readers)})

    return df.mapInPandas(run, out.schema)
