"""What stands beside a chunk in its record: the chunks that give it its context."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .index import bounded

# Fixed values: (kind of the seed, kind of its neighbours, how many).
RULES = [
    ("lab", "lab", 2), ("note", "encounter", 2), ("encounter", "note", 2), ("diagnosis", "medication", 1),
    ("medication", "diagnosis", 2),
]
# End of the fixed values.


def _beside(seed: str, other: str) -> Column:
    """What else has to hold of a seed s and a neighbour c of these kinds in the same record."""
    if seed == other:
        return (F.col("s.meta.test") == F.col("c.meta.test")) & (F.col("s.chunk_id") != F.col("c.chunk_id"))
    if {seed, other} == {"note", "encounter"}:
        return F.col("s.date") == F.col("c.date")
    return F.coalesce(F.col("c.meta.current"), F.lit(False)) if other == "medication" else F.lit(True)


def neighbours(chunks: DataFrame, seeds: DataFrame, most: int | None = None) -> DataFrame:
    """seed, place, and the neighbour's columns, for seeds(chunk_id, one row each): a lab's newest other results of the test,
    a note's encounters of the day and the reverse, a diagnosis's current medication, a medication's diagnoses; else
    in the order of the record. One join on the record. most: a bound of the seeds' number; seeds are broadcast where it says
    that they are few, and otherwise as Spark finds them at run time. Seeds that tell their own patient_id, kind, date and meta
    aren't looked up."""
    few = (lambda df: df) if most is None else (lambda df: bounded(df, most))
    told = {"patient_id", "kind", "date", "meta"} <= set(seeds.columns)
    mine = few(seeds if told else chunks.join(few(seeds.select("chunk_id")), "chunk_id", "left_semi")).alias("s")
    kinds = [(F.col("s.kind") == a) & (F.col("c.kind") == b) & _beside(a, b) for a, b, _ in RULES]
    either = kinds[0]
    for k in kinds[1:]:
        either = either | k
    met = chunks.alias("c").join(mine, (F.col("s.patient_id") == F.col("c.patient_id")) & either)
    newest = F.when(F.col("s.kind") == "lab", F.col("c.date"))
    line = Window.partitionBy("s.chunk_id").orderBy(newest.desc_nulls_last(), F.col("c.ord"))
    most = F.coalesce(*[F.when(F.col("s.kind") == a, F.lit(n)) for a, _, n in RULES])
    rows = met.select(
        F.col("s.chunk_id").alias("seed"), F.row_number().over(line).alias("place"), most.alias("_most"), "c.*",
    )
    return rows.filter(F.col("place") <= F.col("_most")).drop("_most")
