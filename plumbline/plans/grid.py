"""The evaluation as tables: cases are made from chunks and records, all questions of a suite are answered together by each
strategy, and scores are joins of what was found with what is true. No record, chunk or hit passes through the driver.

The cases are those of `evaluate`, whose tables of questions and conditions these are; where a suite is a sample, it is drawn
by a digest of question and patient, so that reruns draw the same cases however the tables are partitioned.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from datetime import timedelta

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..scratch import materialise
from . import evaluate as E
from .batched import Answers, Batch

#: Hits asked for: of suites about sets of patients, and of all others.
MANY, K = 20, E.K

#: strategy -> its answers for (batch, questions, k). The graph, the agent and the router answer one question at a time
#: (`evaluate.evaluate`).
STRATEGIES: dict[str, Callable[[Batch, DataFrame, int], Answers]] = {
    "bm25": Batch.bm25, "naive": Batch.naive, "hybrid": Batch.hybrid, "multiquery": Batch.multiquery, "hyde": Batch.hyde,
    "rerank": Batch.reranked, "mmr": Batch.mmr, "window": Batch.window, "temporal": Batch.temporal,
    "corrective": Batch.corrective,
}

_CASE = ["suite", "text", "patient_id", "gold", "test", "since", "until"]


def _case(rows: DataFrame, suite: str, text: Column, **more: Column) -> DataFrame:
    """rows as cases of a suite; what doesn't apply is null."""
    none = {"gold": "array<string>", "test": "string", "since": "string", "until": "string"}
    values = [more[c].alias(c) if c in more else F.lit(None).cast(t).alias(c) for c, t in none.items()]
    return rows.select(F.lit(suite).alias("suite"), text.alias("text"), "patient_id", *values)


def _draw(cases: DataFrame, n: int, seed: int) -> DataFrame:
    """n of the cases by a seeded digest of what is asked."""
    order = F.xxhash64(F.lit(seed), "text", "patient_id")
    return cases.orderBy(order, "text", "patient_id").limit(n)


def _filled(template: str, **cols: Column) -> Column:
    out: Column = F.lit(template)
    for name, c in cols.items():
        out = F.replace(out, F.lit("{" + name + "}"), c)
    return out


def _gold(rows: DataFrame, *by: str) -> DataFrame:
    """rows by some columns, with the ids of their chunks: those of one patient's results at most."""
    return rows.groupBy(*by).agg(F.collect_set("chunk_id").alias("gold"))


def cases(made: Batch, sizes: dict[str, int] | None = None) -> DataFrame:
    """qid, suite, text, patient_id, gold (ids of chunks), test, since, until: all cases about one record each, written once.
    gold is null where nothing is true (abstain) or truth is a time (window). sizes bound the sampled suites."""
    sizes, c = E.SIZES | (sizes or {}), made.chunks
    labs = c.filter("kind = 'lab'").select(
        "patient_id", "chunk_id", "date", F.col("meta.test").alias("test"), F.col("meta.value").alias("value"),
    )
    t, d = F.col("test"), F.col("date")
    one = _gold(labs, "patient_id", "test", "date", "value")
    either = F.pmod(F.xxhash64("patient_id", "test", "date", "value"), F.lit(len(E.EXACT_LAB)))
    asked = F.element_at(F.array(*[_filled(x, t=t, d=d) for x in E.EXACT_LAB]), either.cast("int") + 1)
    exact = _case(one, "exact", asked, gold=F.col("gold"))
    said = c.filter("kind = 'diagnosis'")
    text = _filled(E.EXACT_DIAGNOSIS, c=F.col("meta.condition"))
    exact = exact.unionByName(_case(said, "exact", text, gold=F.array("chunk_id")))
    known = _gold(c.filter("kind = 'profile'"), "patient_id")
    exact = exact.unionByName(_case(known, "exact", F.lit(E.EXACT_ALLERGY), gold=F.col("gold")))

    spark = c.sparkSession
    lay = spark.createDataFrame([(q, x) for q, tests in E.LAY.items() for x in tests], "q string, test string")
    plain = _gold(labs.join(F.broadcast(lay), "test"), "patient_id", "q")  # the question table is a fixed one

    newest = labs.groupBy("patient_id", "test").agg(F.count(F.lit(1)).alias("n"), F.max("date").alias("date"))
    at = _gold(labs.join(newest.filter("n > 1").drop("n"), ["patient_id", "test", "date"]), "patient_id", "test")

    since, until = (made.asof - timedelta(days=180)).isoformat(), made.asof.isoformat()
    inside = labs.groupBy("patient_id", "test").agg(
        F.max(d.between(since, until)).alias("some"), F.min(d.between(since, until)).alias("all"),
    ).filter("some and not all")

    nothing = c.select("patient_id").distinct().crossJoin(  # a fixed number of questions a patient
        F.broadcast(spark.createDataFrame([(q,) for q in E.UNANSWERABLE], "q string"))
    )
    suites = [
        _draw(exact, sizes["exact"], 11), _case(plain, "lay", F.col("q"), gold=F.col("gold")),
        _draw(_case(at, "latest", _filled(E.LATEST, t=t), gold=F.col("gold")), sizes["latest"], 11),
        _draw(
            _case(inside, "window", _filled(E.WINDOW, t=t), test=t, since=F.lit(since), until=F.lit(until)),
            sizes["window"], 11,
        ),
        _draw(_case(nothing, "abstain", F.col("q")), sizes["unanswerable"], 5),
        _draw(exact, sizes["answerable"], 5).withColumn("suite", F.lit("answerable")),
    ]
    out = suites[0]
    for s in suites[1:]:
        out = out.unionByName(s)
    return materialise(out.select(_number(*_CASE[:3]).alias("qid"), *_CASE), "cases")


def _number(*cols: str) -> Column:
    """A case's key: a digest of what tells it from others."""
    return F.md5(F.to_json(F.struct(*cols)))


def cohort_cases(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(qid, suite, text, patient_id) without a patient, and (qid, patient_id): who meets each question's conditions. Records
    are judged in Python one at a time, by the rules of `evaluate.meets`. Questions that nobody or too many meet are out."""
    fixed = [(s, q, cs) for s, of in (("cohort", E.COHORT), ("paraphrase", E.PARAPHRASE)) for q, cs in of.items()]

    def judge(frames):
        for frame in frames:
            found = []
            for text in frame["r"]:
                p = json.loads(text)
                p = {k: [] for k in ("labs", "medications", "diagnoses", "notes")} | {"allergies": ""} | p
                drugs = {m["name"].lower().split()[0] for m in p["medications"] if m["active"]} - set(E.NO_NAMES)
                on = [("cohort", E.COHORT_DRUG.format(d=d)) for d in sorted(drugs)]
                on += [(s, q) for s, q, cs in fixed if all(E.meets(p, x) for x in cs)]
                found += [(s, q, p["patient_id"]) for s, q in on]
            yield pd.DataFrame(found, columns=["suite", "text", "patient_id"])

    whole = F.to_json(F.struct(*records.columns), {"ignoreNullFields": "false"}).alias("r")
    held = records.select(whole).mapInPandas(judge, "suite string, text string, patient_id string")
    held = materialise(held, "truth")
    size = held.groupBy("suite", "text").agg(F.count(F.lit(1)).alias("n"))
    most = F.when(F.col("suite") == "cohort", E.MOST["cohort"]).otherwise(E.MOST["paraphrase"])
    kept = size.filter(F.col("n") <= most).select(
        _number("suite", "text").alias("qid"), "suite", "text", F.lit(None).cast("string").alias("patient_id"),
    )
    return materialise(kept, "cases"), held.select(_number("suite", "text").alias("qid"), "patient_id")


# ---------------------------------------------------------------- scores


def first_places(asked: DataFrame, hits: DataFrame, k: int = K) -> DataFrame:
    """qid, place: of each case with gold, where the first true chunk among the first k hits is, from 1; else null."""
    gold = asked.select("qid", F.explode("gold").alias("id"))
    at = hits.filter(F.col("rank") < k).join(gold, ["qid", "id"]).groupBy("qid").agg((F.min("rank") + 1).alias("place"))
    return asked.select("qid").join(at, "qid", "left")


def set_scores(asked: DataFrame, found: DataFrame, truth: DataFrame) -> DataFrame:
    """qid, precision, recall, f1 of found(qid, patient_id) against truth(qid, patient_id); all 0 where nothing is found."""
    mine = found.select("qid", "patient_id").distinct()
    rows = asked.select("qid").join(mine.groupBy("qid").agg(F.count(F.lit(1)).alias("n")), "qid", "left")
    rows = rows.join(truth.groupBy("qid").agg(F.count(F.lit(1)).alias("m")), "qid", "left")
    both = mine.join(truth, ["qid", "patient_id"]).groupBy("qid").agg(F.count(F.lit(1)).alias("b"))
    rows = rows.join(both, "qid", "left").fillna(0, ["n", "m", "b"])
    share = lambda a, b: F.coalesce(F.col(a) / F.nullif(F.col(b), F.lit(0)), F.lit(0.0))
    rows = rows.select("qid", share("b", "n").alias("precision"), share("b", "m").alias("recall"))
    p, r = F.col("precision"), F.col("recall")
    return rows.withColumn("f1", F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0))


def inside(made: Batch, asked: DataFrame, hits: DataFrame, k: int = K) -> DataFrame:
    """qid, share: how many of a case's first k hits are results of its test within its time; 0 without hits."""
    met = made._met(hits.filter(F.col("rank") < k), date="date", _test="meta.test")
    good = F.coalesce((F.col("_test") == F.col("test")) & F.col("date").between(F.col("since"), F.col("until")), F.lit(False))
    shares = met.join(asked.select("qid", "test", "since", "until"), "qid").groupBy("qid").agg(
        F.avg(good.cast("double")).alias("share"),
    )
    return asked.select("qid").join(shares, "qid", "left").fillna(0.0, ["share"])


def score(made: Batch, sid: str, about: DataFrame, cohorts: DataFrame, truth: DataFrame) -> DataFrame:
    """suite, n, value, secondary of one strategy: cases about one record each are answered together, and so are those
    about all records. Suites have the metrics of `evaluate.SUITES`; faithfulness is left to the engine, which writes answers."""
    answer = STRATEGIES[sid]
    out = answer(made, made.read(about), K)
    hits = materialise(out.hits.select("qid", "id", "rank"), "hits")
    place = F.col("place")
    hit, first = place.isNotNull().cast("double"), (place == 1).cast("double")
    ranked = about.filter("gold is not null").select("qid", "suite").join(
        first_places(about.filter("gold is not null"), hits), "qid",
    ).select(
        "suite", F.when(F.col("suite") == "latest", F.coalesce(first, F.lit(0.0))).otherwise(hit).alias("value"),
        F.when(F.col("suite") != "latest", F.coalesce(1 / place, F.lit(0.0))).alias("secondary"),
    ).filter("suite <> 'answerable'")
    timed = inside(made, about.filter("suite = 'window'"), hits).select(
        F.lit("window").alias("suite"), F.col("share").alias("value"), F.lit(None).cast("double").alias("secondary"),
    )
    silent = F.col("abstained").cast("double") if "abstained" in out.outcomes.columns else F.lit(0.0)
    kept = out.outcomes.withColumn("s", silent).select("qid", "s").join(about.select("qid", "suite"), "qid")
    quiet = kept.filter("suite in ('abstain', 'answerable')").select(
        F.lit("abstain").alias("suite"), F.when(F.col("suite") == "abstain", F.col("s")).alias("value"),
        F.when(F.col("suite") == "answerable", F.col("s")).alias("secondary"),
    )
    found = answer(made, made.read(cohorts), MANY).hits.select("qid", "id")
    owners = made._met(found, patient_id="patient_id").select("qid", "patient_id")
    sets = set_scores(cohorts, owners, truth).join(cohorts.select("qid", "suite"), "qid").select(
        "suite", F.col("f1").alias("value"), F.col("recall").alias("secondary"),
    )
    rows = ranked.unionByName(timed).unionByName(quiet).unionByName(sets)
    return rows.groupBy("suite").agg(
        F.count("value").alias("n"), F.round(F.avg("value"), 3).alias("value"),
        F.round(F.avg("secondary"), 3).alias("secondary"),
    )


def grid(
    records: DataFrame, made: Batch, strategies: list[str] | None = None, sizes: dict[str, int] | None = None,
) -> DataFrame:
    """strategy, suite, n, value, secondary, each strategy's scores written as they are done."""
    about, (cohorts, truth) = cases(made, sizes), cohort_cases(records)
    truth = materialise(truth, "truth")
    out = None
    for sid in strategies or list(STRATEGIES):
        rows = score(made, sid, about, cohorts, truth).select(F.lit(sid).alias("strategy"), "*")
        rows = materialise(rows.coalesce(1), "scores")  # one row a suite
        out = rows if out is None else out.unionByName(rows)
    return out
