"""The jobs as queries: each run twice over whole tables into one new folder under the shared one, and read back."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobs import index_documents, risk_worklist
from plumbline.plans.clinic import _REC, _RISK
from plumbline.plans.queries import _toks
from plumbline.scratch import shared_folder


def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def job1_index_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The postings after two runs, of which the second has nothing new to take. The table is a folder or a single file; a
    stream takes either by a pattern."""
    at = _folder(spark, "index")
    for _ in range(2):
        out = index_documents.run(spark, f"{sf_dir}/documents.parque[t]", f"{at}/index", f"{at}/checkpoint")
    return out.select("id", "term", "tf", "len", F.col("bucket").cast("long").alias("bucket"))


def job2_risk_worklist(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The worklist after two runs for the same day."""
    at = _folder(spark, "worklist")
    for _ in range(2):
        out = risk_worklist.run(spark, sf_dir, at)
    return out.withColumn("as_of", F.col("as_of").cast("string"))


QUERIES = {"job1_index_documents": job1_index_documents, "job2_risk_worklist": job2_risk_worklist}
ORACLE_SQL = {
    "job1_index_documents": f"""WITH d AS (SELECT doc_id AS id, {_toks()} AS w FROM documents),
t AS (SELECT id, len(w)::BIGINT AS len, unnest(w) AS term FROM d)
SELECT id, term, count(*)::BIGINT AS tf, len, ('0x' || substr(md5(term), 1, 6))::BIGINT % 64 AS bucket FROM t GROUP BY id, term, len""",
    "job2_risk_worklist": f"""WITH {_REC}, {_RISK},
top AS (SELECT c, count(*)::BIGINT AS n, arg_min(severity, (o, i)) AS severity, arg_min(title, (o, i)) AS title FROM al GROUP BY c)
SELECT (SELECT max(o_orderdate)::DATE::VARCHAR FROM orders) AS as_of, pid AS patient_id, name, age, score, band, coalesce(n, 0)::BIGINT AS n_alerts, severity, title,
NULL::BIGINT AS previous_score, NULL::BIGINT AS moved FROM rk JOIN pat USING (c, pid) LEFT JOIN top USING (c)""",
}
