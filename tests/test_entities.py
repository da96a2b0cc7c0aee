"""Entities of equal sentences, which are searched once, against those of whole texts."""

import pytest
from pyspark.sql import functions as F

from plumbline.operators import index, nlp

TEXTS = [
    "Reports cough; no headache. Denies fatigue but has nausea. Allergies: Latex, Penicillin.", "Reports cough; no headache.",
    None, "", "No history; free  of chest pain. Known diabetes and high blood pressure.", "negative for wheeze, not ruled out: COUGH",
    "Reports cough; no headache. Reports cough; no headache.", "Nothing to see.", "without fever, fatigue; however low mood",
]


@pytest.mark.parametrize("few", [200_000, 1])
def test_sentences_give_the_entities_of_their_texts(spark, monkeypatch, few):
    monkeypatch.setattr(index, "FEW", few)
    rows = spark.createDataFrame(list(enumerate(TEXTS)), "id int, text string")
    key = lambda df: sorted(map(str, df.select("id", "e.*").collect()))
    want = key(rows.select("id", F.explode(nlp.entities(F.col("text"))).alias("e")))
    assert key(nlp.entity_rows(rows, "text")) == want and len(want) > 15
    some = key(rows.select("id", F.explode(nlp.entities(F.col("text"), ("symptom",))).alias("e")))
    assert some == [x for x in want if "type='symptom'" in x] and any("negated=True" in x for x in some)
