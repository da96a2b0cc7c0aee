"""Per-patient analytics over records: newest labs, alerts, risk, timeline, cohort statistics, forecasts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.vocab import NSAID_LIKE, RAAS
from . import series as S

SEVERITY_POINTS = {"critical": 12, "high": 8, "medium": 4}


def filled(records: DataFrame) -> DataFrame:
    """records with empty arrays for missing ones."""
    kinds = dict(records.dtypes)
    return records.withColumns(
        {
            c: F.coalesce(F.col(c), F.array().cast(kinds[c]))
            for c in ("diagnoses", "medications", "labs", "encounters", "notes")
        }
    )


def labs(records: DataFrame) -> DataFrame:
    """patient_id, lab_ord, and the fields of each lab."""
    return records.select(
        "patient_id", F.posexplode("labs").alias("lab_ord", "x"),
    ).select("patient_id", "lab_ord", "x.*")


def lab_trends(records: DataFrame) -> DataFrame:
    return S.trends(labs(records), ["patient_id", "test"], "date", "lab_ord", "value")


def lab_forecasts(records: DataFrame, horizon: int = 90) -> DataFrame:
    days = F.datediff(F.to_date("date"), F.lit("1970-01-01").cast("date")).cast("double")
    got = S.forecasts(
        labs(records).withColumn("x", days).withColumnRenamed("value", "y"), ["patient_id", "test"], "x", "y",
        horizon,
    )
    return got.withColumn(
        "target_date", F.date_add(F.lit("1970-01-01").cast("date"), F.col("target_x").cast("int")).cast("string"),
    ).drop("target_x")


def lab_anomalies(records: DataFrame, threshold: float = 3.5) -> DataFrame:
    return S.anomalies(labs(records), ["patient_id", "test"], "date", "lab_ord", "value", threshold)


def _newest(test: str) -> Column:
    """The newest lab of a test, the last of equal dates, from the record's own array: no shuffle."""
    mine = F.filter(
        F.transform(
            "labs",
            lambda x, i: F.struct(
                x["date"].alias("date"), i.alias("i"), x["test"].alias("test"), x["value"].alias("value"),
                x["value_txt"].alias("txt"),
            ),
        ),
        lambda x: x["test"] == test,
    )
    return F.array_max(mine)


def with_alerts(records: DataFrame) -> DataFrame:
    """records with alerts: array of severity, title, detail, the gravest first and else in the order of the rules."""
    records = filled(records)
    names = F.transform(F.filter("medications", lambda m: m["active"]), lambda m: F.lower(m["name"]))
    on = lambda *words: F.exists(
        names,
        lambda n: F.coalesce(
            F.greatest(*[n.contains(w).cast("int") for w in words]) if len(words) > 1
            else n.contains(words[0]).cast("int"),
            F.lit(0),
        ) == 1,
    )
    k, egfr, a1c, spo2, hb = (_newest(t) for t in ("Serum Potassium", "eGFR", "HbA1c", "SpO2", "Hemoglobin"))
    worse = F.filter("diagnoses", lambda d: d["status"] == "worsening")
    text = lambda *parts: F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])
    # Severity, title, limits and wording of each rule.
    rules = [
        (
            0, "critical", "Allergy conflict", F.lower("allergies").contains("nsaids") & on(*NSAID_LIKE),
            text("Documented NSAID allergy while on an NSAID-class medication (e.g. aspirin)."),
        ),
        (
            1, "high", "Hyperkalaemia risk", (k["value"] > 5.0) & on(*RAAS),
            text("Potassium ", k["txt"], " mmol/L while on an ACE-inhibitor/ARB."),
        ),
        (
            1, "high", "Renal dose review", (egfr["value"] < 45) & on("metformin"),
            text("eGFR ", egfr["txt"], " with metformin: review dose or continuation."),
        ),
        (
            1, "high", "Methotrexate with reduced eGFR", (egfr["value"] < 45) & on("methotrexate"),
            text("eGFR ", egfr["txt"], ": methotrexate clearance may be impaired."),
        ),
        (
            2, "medium", "Poor glycaemic control", a1c["value"] >= 8.0,
            text("Latest HbA1c ", a1c["txt"], "% (target below 7-8% for most adults)."),
        ),
        (1, "high", "Low oxygen saturation", spo2["value"] < 90, text("SpO2 ", spo2["txt"], "%.")),
        (2, "medium", "Significant anaemia", hb["value"] < 9, text("Haemoglobin ", hb["txt"], " g/dL.")),
        (
            2, "medium", "Condition marked worsening", F.size(worse) > 0,
            F.array_join(F.transform(worse, lambda d: d["condition"]), ", "),
        ),
    ]
    # End of the fixed values.
    fired = [
        F.when(
            F.coalesce(cond, F.lit(False)),
            F.struct(
                F.lit(o).alias("o"), F.lit(i).alias("i"), F.lit(sev).alias("severity"), F.lit(title).alias("title"),
                detail.alias("detail"),
            ),
        )
        for i, (o, sev, title, cond, detail) in enumerate(rules)
    ]
    return records.withColumn(
        "alerts",
        F.transform(
            F.array_sort(F.array_compact(F.array(*fired))),
            lambda a: F.struct(
                a["severity"].alias("severity"), a["title"].alias("title"), a["detail"].alias("detail"),
            ),
        ),
    )


def with_risk(records: DataFrame) -> DataFrame:
    """records with alerts, score (0 to 100), band and factors (array of factor, points)."""
    rows = with_alerts(records)
    n_diag, n_meds = F.size("diagnoses"), F.size(F.filter("medications", lambda m: m["active"]))
    odd = F.size(F.filter("labs", lambda x: x["flag"] != "NORMAL"))
    acute = F.size(F.filter("encounters", lambda e: e["type"].isin("Admission", "Emergency visit")))
    worse = F.exists("diagnoses", lambda d: d["status"] == "worsening")
    part = lambda cond, name, points: F.when(
        cond,
        F.struct(
            (name if isinstance(name, Column) else F.lit(name)).alias("factor"),
            (points if isinstance(points, Column) else F.lit(points)).cast("int").alias("points"),
        ),
    )
    counted = lambda n, what: F.concat(n.cast("string"), F.lit(f" {what}"))
    own = F.array_compact(F.array(
        part(F.col("age") >= 65, "Age 65+", 12), part(F.col("age").between(50, 64), "Age 50-64", 6), part(
            F.lit(True), counted(n_diag, "chronic condition(s)"), n_diag * 8,
        ),
        part(n_meds >= 4, "Polypharmacy (4+ drugs)", 10), part(
            F.lit(True), counted(odd, "abnormal lab result(s)"), F.least(F.lit(25), odd * 2),
        ), part(acute > 0, counted(acute, "acute encounter(s)"), acute * 6), part(worse, "Worsening condition", 12),
    ))
    points = lambda a: F.when(a["severity"] == "critical", 12).when(a["severity"] == "high", 8).otherwise(4)
    alarm = F.transform(
        "alerts",
        lambda a: F.struct(F.concat(F.lit("Alert: "), a["title"]).alias("factor"), points(a).alias("points")),
    )
    rows = rows.withColumn("factors", F.concat(own, alarm))
    rows = rows.withColumn("score", F.least(F.lit(100), F.aggregate("factors", F.lit(0), lambda s, f: s + f["points"])))
    return rows.withColumn(
        "band", F.when(F.col("score") >= 60, "high").when(F.col("score") >= 35, "moderate").otherwise("low"),
    )


def timeline(records: DataFrame) -> DataFrame:
    """patient_id, place, date, kind, title, detail: encounters, notes and abnormal labs, the newest first."""
    records = filled(records)
    event = lambda b, i, date, kind, title, detail: F.struct(
        date.alias("date"), F.lit(-b).alias("b"), (-i).alias("i"), F.lit(kind).alias("kind"), title.alias("title"),
        detail.alias("detail"),
    )
    enc = F.transform(
        "encounters",
        lambda e, i: event(
            0, i, e["date"], "encounter", F.concat(e["type"], F.lit(" · "), e["department"]), e["reason"],
        ),
    )
    notes = F.transform(
        "notes",
        lambda n, i: event(1, i, n["date"], "note", n["type"], F.concat(F.substring(n["text"], 1, 140), F.lit("…"))),
    )
    odd = F.filter(
        F.transform(
            "labs",
            lambda x, i: event(
                2, i, x["date"], "lab", F.concat_ws(" ", x["test"], x["value_txt"], x["unit"]), x["flag"],
            ),
        ),
        lambda e: e["detail"] != "NORMAL",
    )
    rows = records.select(
        "patient_id", F.posexplode(F.sort_array(F.concat(enc, notes, odd), asc=False)).alias("place", "e"),
    )
    return rows.select("patient_id", "place", "e.date", "e.kind", "e.title", "e.detail")


# Ages at which the cohort's bins begin, bands of risk.
AGE_BINS = {"<40": 0, "40-59": 40, "60-74": 60, "75+": 75}
BANDS = ["low", "moderate", "high"]
# End of the fixed values.


def cohort_table(records: DataFrame) -> DataFrame:
    """part, name, value: patients, mean_age and female_pct (name null), then how many patients have each condition, are in
    each age bin and risk band, and how many alerts there are of each severity; bins, bands and severities are all there.
    One pass over the records, whose rows are counted where they are."""
    rows = with_risk(records)
    age_bin = F.lit(next(iter(AGE_BINS)))
    for name, least in list(AGE_BINS.items())[1:]:
        age_bin = F.when(F.col("age") >= least, name).otherwise(age_bin)
    counted = lambda part, name: F.struct(F.lit(part).alias("part"), name.alias("name"), F.lit(1.0).alias("x"))
    every = F.array(
        counted("patients", F.lit(None).cast("string")), F.struct(
            F.lit("mean_age").alias("part"), F.lit(None).cast("string").alias("name"),
            F.col("age").cast("double").alias("x"),
        ),
        F.struct(
            F.lit("female_pct").alias("part"), F.lit(None).cast("string").alias("name"),
            F.when(F.col("sex") == "F", 100.0).otherwise(0.0).alias("x"),
        ), counted("age_bin", age_bin), counted("risk_band", F.col("band")),
    )
    of = lambda part, values: F.transform(values, lambda v: counted(part, v))
    facts = F.concat(every, of("condition", F.col("diagnoses.condition")), of("alert", F.col("alerts.severity")))
    got = rows.select(F.explode(facts).alias("f")).groupBy("f.part", "f.name").agg(
        F.sum("f.x").alias("sum"), F.avg("f.x").alias("mean"),
    )
    value = F.when(F.col("part").isin("mean_age", "female_pct"), F.round("mean", 1)).otherwise(F.col("sum"))
    domain = [
        ("patients", None), ("mean_age", None), ("female_pct", None), *(("age_bin", b) for b in AGE_BINS),
        *(("risk_band", b) for b in BANDS), *(("alert", s) for s in SEVERITY_POINTS),
    ]
    wanted = records.sparkSession.createDataFrame(
        domain, "part string, name string",
    ).withColumnsRenamed({"part": "p", "name": "n"})
    met = got.select("part", "name", value.alias("value")).join(
        F.broadcast(wanted), F.col("part").eqNullSafe(F.col("p")) & F.col("name").eqNullSafe(F.col("n")), "full",
    )
    return met.select(
        F.coalesce("part", "p").alias("part"), F.coalesce("name", "n").alias("name"),
        F.coalesce("value", F.lit(0.0)).alias("value"),
    )


def cohort_stats(records: DataFrame) -> dict:
    """The cohort's table as a nested dict; conditions by falling count."""
    held = {(r["part"], r["name"]): r["value"] for r in cohort_table(records).collect()}
    of = lambda part, names: {n: int(held[part, n]) for n in names}
    conditions = sorted(
        ((n, int(v)) for (part, n), v in held.items() if part == "condition"), key=lambda x: (-x[1], x[0]),
    )
    return {
        "patients": int(held["patients", None]), "mean_age": held["mean_age", None], "female_pct": held[
            "female_pct", None
        ], "conditions": [{"name": n, "count": v} for n, v in conditions],
        "age_bins": [
            {"bin": b, "count": n} for b, n in of("age_bin", AGE_BINS).items()
        ], "risk_bands": of("risk_band", BANDS), "alerts": of("alert", SEVERITY_POINTS),
    }


def patient_list(records: DataFrame, q: str = "", sort: str = "risk") -> DataFrame:
    """Patients whose name, id and conditions hold q, by falling risk and name, or by name."""
    rows = with_risk(records).select(
        "patient_id", "name", "age", "sex", F.col("diagnoses.condition").alias("conditions"),
        F.col("score").alias("risk"), "band", F.size("alerts").alias("alerts"),
    )
    text = F.lower(F.concat("name", "patient_id", F.array_join("conditions", " ")))
    rows = rows.filter(F.contains(text, F.lit(q.lower()))) if q else rows
    return rows.orderBy("name", "patient_id") if sort == "name" else rows.orderBy(F.desc("risk"), "name", "patient_id")
