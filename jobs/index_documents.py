"""Keeps a lexical index of a growing folder of documents: a stream over its files, which ends when all are taken.

    python -m jobs.index_documents --documents s3a://lake/documents --index s3a://lake/index --checkpoint s3a://lake/index-mark

The index has two tables. `documents` (id, len, batch) lists what is indexed; `postings` (term, id, tf, len, bucket, batch) has
a row for each distinct term of each document, partitioned by a bucket of the term, so that a search reads the buckets of its
terms only (`search`), and by the micro-batch that wrote it. The checkpoint names the files that were taken. A batch that is
run again after a failure replaces its own partitions. Ids that another batch has indexed are not indexed again; of rows that
repeat an id within a batch, the one with the smallest digest of its text is taken. Rows without an id can't be found by
one and are left out, which the log says.
"""

from __future__ import annotations

import logging
from functools import partial

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from jobs.common import config, main
from plumbline.operators import index as X

NAME = "index_documents"
log = logging.getLogger(NAME)


def bucket(term: Column, buckets: int) -> Column:
    return (F.conv(F.substring(F.md5(term), 1, 6), 16, 10).cast("int") % buckets).cast("int")


def _existing(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The table at path, empty where there is none yet."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def _write(index: str, settings: dict, read: dict[int, int], batch: DataFrame, number: int) -> None:
    """Index one micro-batch; read gets its number of rows."""
    spark, id_type = batch.sparkSession, dict(batch.dtypes)[settings["id_column"]]
    rows = batch.select(F.col(settings["id_column"]).alias("id"), F.col(settings["text_column"]).alias("text"))
    known = _existing(spark, f"{index}/documents", f"id {id_type}, len long, batch long").filter(F.col("batch") != number)
    named = rows.filter("id is not null")
    # Texts are shuffled only where an id repeats.
    several = named.groupBy("id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("id")
    once = named.join(several, "id", "left_anti").unionByName(
        named.join(several, "id", "left_semi").groupBy("id").agg(F.min_by("text", F.sha2("text", 256)).alias("text"))
    ) if not several.isEmpty() else named
    new = once.join(known, "id", "left_anti")
    posts = X.postings(new, "id", "text").withColumns(
        {"bucket": bucket(F.col("term"), settings["buckets"]), "batch": F.lit(number).cast("long")}
    )
    # Rebalancing cuts up the bucket of a term that is everywhere.
    posts.hint("rebalance", "bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(
        "bucket", "batch",
    ).parquet(f"{index}/postings")
    # Last: a batch counts as indexed when its postings are there.
    listed = new.select("id", F.size(X.T.tokens(F.col("text"))).cast("long").alias("len"), F.lit(number).cast("long").alias("batch"))
    listed.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(f"{index}/documents")
    wrote = spark.read.parquet(f"{index}/postings").filter(F.col("batch") == number).count()
    taken = spark.read.parquet(f"{index}/documents").filter(F.col("batch") == number).count()
    read[number] = batch.count()
    log.info("batch %d: read %d rows, indexed %d documents, wrote %d postings", number, read[number], taken, wrote)


def run(spark: SparkSession, documents: str, index: str, checkpoint: str, settings: dict | None = None) -> DataFrame:
    """Index the documents that came since the last run; returns the index's postings."""
    settings = settings or config(NAME)
    schema = spark.read.parquet(documents).select(settings["id_column"], settings["text_column"]).schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", settings["max_files_per_trigger"]).parquet(documents)
    read: dict[int, int] = {}
    query = stream.writeStream.foreachBatch(partial(_write, index, settings, read)).option(
        "checkpointLocation", checkpoint,
    ).trigger(availableNow=True).start()
    query.awaitTermination()
    log.info("read %d new rows of %s; the index is %s", sum(read.values()), documents, index)
    return spark.read.parquet(f"{index}/postings")


def search(spark: SparkSession, index: str, queries: DataFrame, k: int = 10, settings: dict | None = None) -> DataFrame:
    """qid, id, score, rank of the k best documents by BM25 for each of queries(qid, text): few and short, so that their terms'
    buckets are named in the filter and no other is read."""
    settings = settings or config(NAME)
    terms = X.query_terms(queries, "qid", "text")
    asked = [r[0] for r in terms.select(bucket(F.col("term"), settings["buckets"]).alias("b")).distinct().collect()]
    held = spark.read.parquet(f"{index}/documents")
    stats = held.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.avg("len"), F.lit(0.0)).alias("avg_len"))
    posts = spark.read.parquet(f"{index}/postings").filter(F.col("bucket").isin(asked))
    return X.ranked(X.bm25(posts.select("id", "len", "term", "tf"), stats, terms), k)


if __name__ == "__main__":
    main(NAME, run, {
        "documents": "folder of Parquet files that grows, or a pattern of such", "index": "where the index is", "checkpoint": "the stream's checkpoint",
    })
