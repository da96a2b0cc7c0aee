"""Scratch tables in the shared folder that the cluster names: where lineage and long plans end."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The shared folder that the cluster names; in local mode only, a temporary one where none is named."""
    conf = spark.sparkContext.getConf()
    base = spark.conf.get("spark.checkpoint.dir", None) or conf.get("spark.checkpoint.dir", None)
    if not base:
        base = spark.sparkContext.getCheckpointDir()
    if not base:
        if not conf.get("spark.master", "").startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
        base = tempfile.mkdtemp(prefix="plumbline-")
        spark.sparkContext.setCheckpointDir(base)
        base = spark.sparkContext.getCheckpointDir()
    return base.rstrip("/")


def scratch_root(spark: SparkSession) -> str:
    """This application's folder in the shared one, removed at its end."""
    root = f"{shared_folder(spark)}/plumbline-{spark.sparkContext.applicationId}"
    if root not in _ROOTS:
        _ROOTS.add(root)
        atexit.register(_remove, spark, root)
    return root


_ROOTS: set[str] = set()


def _remove(spark: SparkSession, root: str) -> None:
    """Best effort at the driver's end; a cluster's own retention rule covers the rest."""
    try:
        path = spark._jvm.org.apache.hadoop.fs.Path(root)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    except Exception:  # noqa: BLE001 - the JVM may have gone already
        pass


#: Files that a table of few rows is written to at most, and rows a file beyond that.
FEW_FILES, ROWS_A_FILE = 24, 250_000


def materialise(df: DataFrame, name: str, most_rows: int | None = None) -> DataFrame:
    """Write df as Parquet to the shared scratch folder and read it back: lineage ends here, and a lost
    executor costs a re-read, never a re-computation. most_rows, where a bound is known, keeps a small table that comes
    out of a wide shuffle from becoming thousands of tiny files; the number of files grows with the bound."""
    spark = df.sparkSession
    path = f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}"
    schema = df.schema
    if most_rows is not None:
        df = df.coalesce(max(FEW_FILES, -(-most_rows // ROWS_A_FILE)))
    df.write.parquet(path)
    return spark.read.schema(schema).parquet(path)
