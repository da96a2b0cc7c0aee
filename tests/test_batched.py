"""Strategies over tables of questions against the same strategies asked one question at a time."""

import pytest
from pyspark.sql import functions as F

from plumbline.functions import questions as Q
from plumbline.operators import privacy
from plumbline.operators.chunks import chunk_records
from plumbline.plans.batched import Batch
from plumbline.plans.search import ChunkIndex
from plumbline.plans.strategies import STRATEGIES, Context, rerank
from plumbline.sources import records as R

ROWS = R.generate(12, 5)
ABOUT = [r["patient_id"] for r in ROWS]
ASKED = [
    (0, "What is the latest creatinine?", ABOUT[0]), (1, "any abnormal HbA1c since 2024?", ABOUT[1]),
    (2, "current medications and also documented allergies", ABOUT[2]), (3, "which visits in 2025", ABOUT[3]),
    (4, "high potassium", None), (5, "sugar control over the last 6 months", None), (6, "zebra quantum flux", ABOUT[4]),
    (7, "kidney function", ABOUT[0]), (8, "zebra quantum kidney flux orbit", None), (9, "latest hemoglobin", "NOBODY"),
    (10, "was she admitted to hospital?", ABOUT[5]), (11, None, None), (12, "", ABOUT[6]), (13, "the of", ABOUT[7]),
    (14, "creatinine since 2024-13", ABOUT[8]), (15, "high potassium", None),
]
K = 4


def remember(index):
    """The searches that the strategies make for these questions, asked together."""
    index.remembered = 10_000
    variants = [(v, p) for _, t, p in ASKED for v in Q.variants(t or "")]
    parts = [(v, p) for _, t, p in ASKED for part in Q.decompose(t or "") for v in Q.variants(part)]
    plain = [(t or "", p) for _, t, p in ASKED]
    for k in (2, K, 4 * K, 5 * K, 20, 25, 40):
        index.find("hybrid", k, plain)
    for mode in ("bm25", "dense"):
        index.find(mode, K, plain)
    index.find("hybrid", 2 * K, parts + plain)
    index.find("hybrid", 3 * K, variants)
    said = [(x, p) for _, t, p in ASKED for x in Q.hypothetical(t or "")]
    for k in (2 * K, 3 * K):
        index.find("nearest", k, said)


@pytest.fixture(scope="module")
def both(spark):
    chunks = chunk_records(R.from_rows(spark, ROWS))
    index, batch = ChunkIndex(chunks), Batch(chunks)
    asked = batch.read(spark.createDataFrame(ASKED, "qid int, text string, patient_id string"))
    remember(index)
    yield Context(index, None, None, set(), {}), batch, asked
    index.close()


@pytest.mark.parametrize("sid", ["bm25", "naive", "mmr", "hybrid", "rerank", "multiquery", "hyde", "window", "temporal", "corrective"])
def test_a_table_of_questions_equals_one_at_a_time(both, sid):
    ctx, batch, asked = both
    out = {"rerank": batch.reranked}.get(sid, getattr(batch, sid, None))(asked, K)
    hits, outcomes = {}, {r["qid"]: r for r in out.outcomes.collect()}
    for r in out.hits.orderBy("qid", "rank").collect():
        hits.setdefault(r["qid"], []).append((r["id"], r["rank"], r["score"]))
    assert set(outcomes) == {q for q, _, _ in ASKED}
    for qid, text, pid in ASKED:
        try:
            one = STRATEGIES[sid](text or "", ctx, pid, K)
        except ValueError:
            continue  # a month that doesn't exist: the table reads no time there
        mine = hits.get(qid, [])
        assert [i for i, _, _ in mine] == [h.chunk.chunk_id for h in one.hits], (qid, text)
        assert [r for _, r, _ in mine] == list(range(len(mine)))
        assert [s for _, _, s in mine] == pytest.approx([h.score for h in one.hits], abs=0.011)
        assert outcomes[qid]["coverage"] == pytest.approx(one.confidence, abs=1e-9)
        if sid == "corrective":
            assert outcomes[qid]["abstained"] == one.abstain
            if one.abstain:
                assert outcomes[qid]["uncovered"] == one.structured["uncovered"]
    if sid == "corrective":
        assert {r["stage"] for r in outcomes.values()} >= {0} and any(r["abstained"] for r in outcomes.values())


def test_features_equal_those_of_one_question(both):
    ctx, batch, asked = both
    pool = batch.search(asked, 25)
    got = {(r["qid"], r["id"]): r for r in batch.rerank(asked, pool).collect()}
    for qid, text, pid in ASKED[:8]:
        for hit, features in rerank(text, ctx.index.search([text], 25, pid)[0]):
            row = got[qid, hit.chunk.chunk_id]
            assert {n: row[n] for n in features} == pytest.approx(features, abs=1e-6)


def test_a_question_about_a_record_meets_it_by_a_join_on_term_and_record(both):
    _, batch, asked = both
    plan = batch._lexical(asked.filter("patient_id is not null"))._jdf.queryExecution().optimizedPlan().toString()
    assert [x for x in plan.splitlines() if "Join Inner" in x and "owner" in x and "term" in x]


def test_no_questions_and_no_chunks(spark, both):
    _, batch, asked = both
    none = batch.corrective(asked.limit(0), K)
    assert none.hits.count() == 0 and none.outcomes.count() == 0
    empty = Batch(batch.chunks.limit(0))
    for sid in ("hybrid", "corrective", "window", "temporal"):
        out = getattr(empty, sid)(asked, K)
        assert out.hits.count() == 0 and out.outcomes.filter(F.col("label") == "low").count() == len(ASKED)
    assert Q.variants("") == []


def test_names_of_all_rows_are_masked(spark):
    names = ["Ann Lee", "Ann", "Ann Lee Moss", "Jörg Äsch", "  O'Hara ", "", None, "##", "Ann"]
    texts = [
        "Ann Lee Moss met Ann Lee, Ann and Annika.", "jörg äsch, Jörg Äsch: O'Hara", "", None, "no one", "Ann", "Ann Lee  Moss",
        "(Ann)(Ann)Lee", "Ann " * 5000,
    ]
    rows = [(i, t, "x", "y") for i, t in enumerate(texts)] + [(5, "Ann", "x", "y"), (None, "by Ann", "x", "y"), (None, "Ann", "x", "y")]
    df = spark.createDataFrame(rows, "name int, text string, _run string, _hits2 string")
    known = spark.createDataFrame([(n,) for n in names], "name string")
    got = privacy.mask_names(df, "name", "text", known)
    assert got.columns == df.columns
    m = "[PATIENT]"
    want = [
        (None, f"by {m}"), (None, m), (0, f"{m} met {m}, {m} and Annika."), (1, f"jörg äsch, {m}: {m}"), (2, ""), (3, None),
        (4, "no one"), (5, m), (5, m), (6, f"{m}  Moss"), (7, f"({m})({m})Lee"), (8, f"{m} " * 5000),
    ]
    key = lambda r: (r[0] is not None, r[0] or 0, r[1] or "")
    assert sorted(((r["name"], r["text"]) for r in got.collect()), key=key) == sorted(want, key=key)
    assert privacy.mask_names(df, "name", "text", known.limit(0)).count() == len(rows)
