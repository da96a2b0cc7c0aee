"""The patients to look at, as of a day: risk, alerts and how both moved since the snapshot before.

    python -m jobs.risk_worklist --tables s3a://lake/tables --worklist s3a://lake/worklist

Reads customers, orders and order lines as records, scores them with the library's clinical rules, and writes one snapshot
a day, partitioned by as_of. The day is that of the settings, or else of the newest order; later orders are left out. A
rerun for a day replaces that day's partition and no other; earlier snapshots tell what has changed.
"""

from __future__ import annotations

import logging
from datetime import date

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobs.common import config, main
from plumbline.operators import clinical
from plumbline.plans.clinic import records

NAME = "risk_worklist"
log = logging.getLogger(NAME)


def _before(spark: SparkSession, worklist: str, day: date) -> DataFrame:
    """patient_id, previous_score of the newest snapshot before the day."""
    try:
        older = spark.read.parquet(worklist).filter(F.col("as_of") < F.lit(day))
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], "patient_id string, previous_score long")
    last = older.agg(F.max("as_of")).first()[0]
    return older.filter(F.col("as_of") == F.lit(last)).select("patient_id", F.col("score").alias("previous_score"))


def run(spark: SparkSession, tables: str, worklist: str, settings: dict | None = None) -> DataFrame:
    """Write the snapshot of one day; returns all snapshots."""
    settings = settings or config(NAME)
    orders = spark.read.parquet(f"{tables}/orders.parquet")
    newest = F.max(F.to_date("o_orderdate"))
    day = date.fromisoformat(settings["as_of"]) if settings["as_of"] else orders.agg(newest).first()[0]
    if day is None:
        raise ValueError("there are no orders, and the settings name no day")
    scored = clinical.with_risk(records(spark, tables, until=day))
    first = F.get("alerts", F.lit(0))
    rows = scored.select(
        "patient_id", "name", "age", F.col("score").cast("long").alias("score"), "band",
        F.size("alerts").cast("long").alias("n_alerts"), first["severity"].alias("severity"), first["title"].alias("title"),
    ).filter(F.col("score") >= settings["least_score"])
    rows = rows.join(_before(spark, worklist, day), "patient_id", "left").withColumns(
        {"moved": F.col("score") - F.col("previous_score"), "as_of": F.lit(day)}
    )
    rows.hint("rebalance").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("as_of").parquet(worklist)
    out = spark.read.parquet(worklist)
    log.info("read %d orders of %s, wrote %d patients as of %s to %s", orders.count(), tables, out.filter(F.col("as_of") == F.lit(day)).count(), day, worklist)
    return out


if __name__ == "__main__":
    main(NAME, run, {"tables": "folder of the tables", "worklist": "where the snapshots are"})
