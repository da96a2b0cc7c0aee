"""Patients' feature vectors against SQL, with records read once."""

import pytest
from conftest import rows_of

import __spark_entry__ as entry
from plumbline.operators import similarity
from plumbline.plans import clinic


@pytest.mark.parametrize("name", ["similar_entities", "feature_pivot"])
def test_vectors_are_those_of_sql(spark, duck, data_dir, name):
    got = entry.queries()[name](spark, data_dir).toPandas()
    assert rows_of(got) == rows_of(duck.sql(entry.oracle_sql()[name]).df())


def test_records_are_read_once(spark, data_dir):
    vectors = similarity.feature_vectors(clinic.records(spark, data_dir))
    plan = vectors._jdf.queryExecution().executedPlan().toString()
    assert "lineitem" not in plan and "Exchange" not in plan
