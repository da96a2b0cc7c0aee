"""Queries whose results have no head only: every feature, every term."""

from collections import Counter

import pytest

from plumbline.functions.text import tokens
from plumbline.plans import queries, relational  # noqa: F401 - they register their queries


@pytest.fixture(scope="module")
def toks(spark, data_dir):
    docs = spark.read.parquet(f"{data_dir}/documents.parquet")
    return {r["doc_id"]: r["t"] for r in docs.select("doc_id", tokens(docs["text"]).alias("t")).collect()}


def test_features_of_one_document_stay(spark, data_dir, toks):
    times, n_docs = Counter(), Counter()
    for t in toks.values():
        found = [*t, *(f"{a}_{b}" for a, b in zip(t, t[1:]))]
        times.update(found)
        n_docs.update(set(found))
    got = {
        r["feature"]: (r["n_docs"], r["n_times"])
        for r in queries.QUERIES["ngram_features"](spark, data_dir).collect()
    }
    assert got == {f: (n_docs[f], n) for f, n in times.items()} and 1 in n_docs.values()


def test_terms_after_the_fiftieth_stay(spark, data_dir, toks):
    mentions, ids = Counter(), {}
    for d, t in toks.items():
        mentions.update(t)
        for x in set(t):
            ids.setdefault(x, set()).add(d)
    got = [
        tuple(r[c] for c in ("term", "mentions", "n_docs", "last_doc"))
        for r in queries.QUERIES["term_counts"](spark, data_dir).collect()
    ]
    assert sorted(got) == sorted((x, n, len(ids[x]), max(ids[x])) for x, n in mentions.items()) and len(got) > 50


def test_records_shuffle_the_columns_they_are_made_of(spark, data_dir):
    from plumbline.plans.clinic import records

    plan = records(spark, data_dir)._jdf.queryExecution().executedPlan().toString().splitlines()
    under = [plan[i + 1] for i, line in enumerate(plan) if "Exchange hashpartitioning(c#" in line]
    assert under and not any("collect_list" in line for line in under)
    assert sum("REPARTITION_BY_COL" in line for line in plan) == 2
