"""The jobs: against SQL, over growing input, and rerun."""

import json
import logging
from datetime import date

import pytest
from conftest import rows_of
from pyspark.sql import functions as F

from jobs import common, index_documents, queries, risk_worklist


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query_agrees_with_sql(name, spark, data_dir, duck):
    got, want = queries.QUERIES[name](spark, data_dir).toPandas(), duck.sql(queries.ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns) and rows_of(got) == rows_of(want)


def test_the_index_takes_only_what_is_new(spark, data_dir, tmp_path, caplog):
    docs = spark.read.parquet(f"{data_dir}/documents.parquet").select("doc_id", "text")
    coming, index, mark = (str(tmp_path / x) for x in ("coming", "index", "mark"))
    run = lambda: index_documents.run(spark, coming, index, mark)
    rows = lambda df: sorted(map(tuple, df.select("id", "term", "tf", "len").collect()))
    docs.filter("doc_id % 3 = 0").coalesce(1).write.parquet(coming)
    first = rows(run())
    assert first and {r[0] % 3 for r in first} == {0}
    # New files, one of which has a known id with another text, and a row without an id.
    docs.filter("doc_id % 3 = 1").coalesce(2).write.mode("append").parquet(coming)
    odd = [(0, "changed text"), (None, "no id"), (-1, None), (-2, ""), (-3, "b b"), (-3, "c c c")]
    spark.createDataFrame(odd, docs.schema).coalesce(1).write.mode("append").parquet(coming)
    with caplog.at_level(logging.INFO):
        second = rows(run())
    n = docs.filter("doc_id % 3 = 1").count()
    assert f"read {n + len(odd)} new rows" in caplog.text and f"indexed {n + 3} documents" in caplog.text
    assert set(first) < set(second) and not any(r[1] == "changed" for r in second)
    assert len({r[1] for r in second if r[0] == -3}) == 1
    held = {r["id"]: r["batch"] for r in spark.read.parquet(f"{index}/documents").collect()}
    assert held[0] == 0 and held[-1] == held[-2] == 1 and None not in held
    assert rows(run()) == second
    # A batch that runs again, as after a failure, replaces itself.
    again = spark.read.parquet(coming).filter("doc_id % 3 = 1 or doc_id < 0 or doc_id is null or text = 'changed text'")
    index_documents._write(index, common.config("index_documents"), {}, again, 1)
    assert rows(spark.read.parquet(f"{index}/postings")) == second


def test_a_search_reads_the_buckets_of_its_terms(spark, data_dir, tmp_path):
    from plumbline.operators import index as X

    docs = spark.read.parquet(f"{data_dir}/documents.parquet").select("doc_id", "text")
    docs.write.parquet(str(tmp_path / "d"))
    index_documents.run(spark, str(tmp_path / "d"), str(tmp_path / "i"), str(tmp_path / "m"))
    asked = spark.read.parquet(f"{data_dir}/benchmark.parquet").limit(3).select(F.col("item_id").alias("qid"), "text")
    got = index_documents.search(spark, str(tmp_path / "i"), asked, 5)
    want = X.ranked(
        X.bm25(X.postings(docs, "doc_id", "text"), X.corpus_stats(docs, "text"), X.query_terms(asked, "qid", "text")), 5,
    )
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_worklist_snapshots_by_day(spark, data_dir, tmp_path):
    at, run = str(tmp_path / "w"), lambda day: risk_worklist.run(spark, data_dir, at, {"as_of": day, "least_score": 0})
    rows = lambda df: sorted(map(repr, df.collect()))
    early = rows(run("1996-06-30"))
    both = run("1997-06-30")
    assert {r["as_of"] for r in both.collect()} == {date(1996, 6, 30), date(1997, 6, 30)}
    assert rows(both.filter("as_of = '1996-06-30'")) == early
    later = {r["patient_id"]: r for r in both.filter("as_of = '1997-06-30'").collect()}
    old = {r["patient_id"]: r["score"] for r in both.filter("as_of = '1996-06-30'").collect()}
    assert all(r["previous_score"] == old[p] and r["moved"] == r["score"] - old[p] for p, r in later.items())
    assert any(r["moved"] for r in later.values()) and any(s > 0 for s in old.values())
    before = rows(both)
    assert rows(run("1997-06-30")) == before and rows(run("1996-06-30")) == before


def test_settings_come_from_the_file_and_are_checked(tmp_path):
    (tmp_path / "c.json").write_text(json.dumps({"buckets": 8}))
    assert common.config("index_documents", str(tmp_path / "c.json"))["buckets"] == 8
    (tmp_path / "c.json").write_text(json.dumps({"bukets": 8}))
    with pytest.raises(ValueError, match="bukets"):
        common.config("index_documents", str(tmp_path / "c.json"))
