"""The evaluation as tables against plain loops over the same records and chunks."""

import pytest
from pyspark.sql import functions as F

from plumbline.operators.chunks import chunk_records
from plumbline.plans import evaluate as E
from plumbline.plans import grid as G
from plumbline.plans.batched import Batch
from plumbline.plans.search import _chunk
from plumbline.sources import records as R

ROWS = R.generate(14, 5)
ALL = {k: 10**6 for k in E.SIZES}


@pytest.fixture(scope="module")
def made(spark):
    records = R.from_rows(spark, ROWS)
    return records, Batch(chunk_records(records))


def test_cases_are_those_of_plain_loops(made):
    records, batch = made
    people = [r.asDict(recursive=True) for r in records.collect()]
    chunks = [_chunk(r) for r in batch.chunks.collect()]
    got = G.cases(batch, ALL).collect()
    assert len({r["qid"] for r in got}) == len(got)
    mine = lambda suite: {
        (r["text"], r["patient_id"], frozenset(r["gold"])) for r in got if r["suite"] == suite
    }
    theirs = lambda cases: {(c["q"], c["pid"], frozenset(c["gold"])) for c in cases}
    assert mine("lay") == theirs(E.lay_cases(people, chunks)) != set()
    assert mine("latest") == theirs(E.latest_cases(people, chunks)) != set()
    about = lambda cases: {(p, g) for _, p, g in cases}  # noqa: E731 - the wording of a question is drawn
    assert about(mine("exact")) == about(theirs(E.exact_cases(people, chunks))) == about(mine("answerable"))
    window = {(r["text"], r["patient_id"], r["test"], r["since"], r["until"]) for r in got if r["suite"] == "window"}
    assert window == {tuple(c[x] for x in ("q", "pid", "test", "start", "end")) for c in E.window_cases(people, batch.asof)}
    few = G.cases(batch, {"exact": 7, "latest": 3, "unanswerable": 4, "answerable": 0})
    n = {r["suite"]: r["count"] for r in few.groupBy("suite").count().collect()}
    assert (n["exact"], n["latest"], n["abstain"], "answerable" in n) == (7, 3, 4, False)
    again = G.cases(batch, {"exact": 7, "latest": 3, "unanswerable": 4, "answerable": 0})
    assert {r["qid"] for r in few.collect()} == {r["qid"] for r in again.collect()}

    asked, truth = G.cohort_cases(records.repartition(3))
    told = {(r["suite"], r["text"]): set() for r in asked.collect()}
    for r in truth.join(asked.drop("patient_id"), "qid").collect():
        told[r["suite"], r["text"]].add(r["patient_id"])
    want = {("cohort", c["q"]): c["truth"] for c in E.cohort_cases(people)}
    want |= {("paraphrase", c["q"]): c["truth"] for c in E.cohort_cases(people, E.PARAPHRASE, E.MOST["paraphrase"])}
    assert told == want != {}


def test_scores_are_those_of_plain_loops(spark, made):
    records, batch = made
    asked = spark.createDataFrame(
        [("a", ["x", "y"]), ("b", ["z"]), ("c", ["q"]), ("d", [])], "qid string, gold array<string>",
    )
    hits = spark.createDataFrame(
        [("a", "n", 0), ("a", "y", 1), ("a", "x", 2), ("b", "z", 5), ("c", "q", 0)], "qid string, id string, rank long",
    )
    assert {r["qid"]: r["place"] for r in G.first_places(asked, hits).collect()} == {"a": 2, "b": None, "c": 1, "d": None}
    found = spark.createDataFrame([("a", "1"), ("a", "1"), ("a", "2"), ("b", "9")], "qid string, patient_id string")
    truth = spark.createDataFrame([("a", "1"), ("a", "3"), ("b", "8"), ("c", "7")], "qid string, patient_id string")
    sets = {"a": ({"1", "2"}, {"1", "3"}), "b": ({"9"}, {"8"}), "c": (set(), {"7"}), "d": (set(), set())}
    for r in G.set_scores(asked, found, truth).collect():
        assert (r["precision"], r["recall"], r["f1"]) == pytest.approx(E.set_scores(*sets[r["qid"]])), r["qid"]
    small = {"exact": 8, "latest": 4, "window": 3, "unanswerable": 4, "answerable": 3}
    got = {(r["strategy"], r["suite"]): r for r in G.grid(records, batch, ["bm25", "corrective"], small).collect()}
    assert {s for _, s in got} == {"exact", "lay", "latest", "window", "abstain", "cohort", "paraphrase"}
    assert len(got) == 14 and all(0 <= r["value"] <= 1 for r in got.values())
    assert got["bm25", "exact"]["n"] == 8 and got["bm25", "abstain"]["value"] == 0.0
    assert got["corrective", "abstain"]["value"] > 0.5 and got["bm25", "exact"]["value"] > 0.8
    assert batch.chunks.filter(F.col("kind") == "lab").count() > 0
