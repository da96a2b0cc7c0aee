"""Typed edges from patients to what their records say, and exact cohort queries over them as semi-joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.questions import Cohort, Limit
from .domains import few
from .nlp import entities


def edges(chunks: DataFrame) -> DataFrame:
    """patient_id, etype, target, chunk_id, date, value, flag, unit, ord: one for each patient, type and target. Of labs
    the newest counts (of equal dates the first), of symptoms the first note, of conditions and drugs the last
    chunk. One pass over the chunks, each of which names its edges."""
    kind, edge = F.col("kind"), lambda etype, target: F.struct(F.lit(etype).alias("etype"), target.alias("target"))
    drug = F.when(F.col("meta.current"), "takes_drug").otherwise("took_drug")
    said = F.filter(entities(F.col("text"), ("symptom",)), lambda e: ~e["negated"])
    named = (
        F.when(kind == "profile", F.array(edge("profile", F.lit("profile"))))
        .when(kind == "diagnosis", F.array(edge("has_condition", F.col("meta.condition"))))
        .when(
            kind == "medication",
            F.transform("meta.drugs", lambda d: F.struct(drug.alias("etype"), d.alias("target"))),
        )
        .when(kind == "lab", F.array(edge("has_lab", F.col("meta.test"))))
        .when(
            kind == "note",
            F.transform(
                F.array_distinct(F.transform(said, lambda e: e["text"])), lambda x: edge("reports_symptom", x),
            ),
        )
    )
    about = [
        "chunk_id", "date", F.col("meta.value").alias("value"), F.col("meta.flag").alias("flag"),
        F.col("meta.unit").alias("unit"), "ord",
    ]
    rows = chunks.select("patient_id", F.explode(named).alias("e"), *about).select(
        "patient_id", "e.*", "chunk_id", "date", "value", "flag", "unit", "ord",
    )
    last = F.format_string("%09d", F.col("ord"))
    first = F.format_string("%09d", 999_999_999 - F.col("ord"))
    order = F.when(
        F.col("etype") == "has_lab", F.concat("date", first),
    ).when(F.col("etype") == "reports_symptom", first).otherwise(last)
    columns = ["chunk_id", "date", "value", "flag", "unit", "ord"]
    best = rows.withColumn("_k", order).groupBy("patient_id", "etype", "target").agg(
        F.max_by(F.struct(*columns), "_k").alias("r")
    )
    return best.select("patient_id", "etype", "target", "r.*")


def known_drugs(edge_table: DataFrame) -> set[str]:
    """All drugs on record: a domain of few values, which is checked."""
    return set(few(edge_table.filter("etype IN ('takes_drug', 'took_drug')"), "target"))


def stats_table(edge_table: DataFrame) -> DataFrame:
    """etype, nodes (distinct targets), edges."""
    return edge_table.groupBy("etype").agg(F.countDistinct("target").alias("nodes"), F.count(F.lit(1)).alias("edges"))


def stats(edge_table: DataFrame, n_patients: int, n_drugs: int) -> dict:
    """Nodes and edges by kind, and their sums."""
    held = {r["etype"]: r for r in stats_table(edge_table).collect()}
    of = lambda etype, what: held[etype][what] if etype in held else 0
    nodes = {
        "patients": n_patients, "conditions": of("has_condition", "nodes"), "drugs": n_drugs,
        "lab tests": of("has_lab", "nodes"), "symptoms": of("reports_symptom", "nodes"),
    }
    links = {etype: of(etype, "edges") for etype in ("has_condition", "takes_drug", "has_lab", "reports_symptom")}
    return {"nodes": nodes, "edges": links, "total_nodes": sum(nodes.values()), "total_edges": sum(links.values())}


#: Kinds of limits that edges prove, and the edges' type.
_EDGES = {"condition": "has_condition", "drug": "takes_drug", "lab": "has_lab", "symptom": "reports_symptom"}


def _lab_holds(limit: Limit) -> Column:
    value, flag, number = F.col("value"), F.col("flag"), F.lit(limit.number)
    return {
        ">": value > number, "<": value < number, "high": flag == "HIGH", "low": flag == "LOW",
        "abnormal": flag != "NORMAL",
    }[limit.op]


def _proof(edge_table: DataFrame, limit: Limit) -> DataFrame:
    """patient_id, chunk_id, why: a row for each patient whose edges meet a limit. Of several drugs the first named is the
    proof, and all that are taken are the reason."""
    hits = edge_table.filter((F.col("etype") == _EDGES[limit.kind]) & F.col("target").isin(*limit.names))
    if limit.kind == "drug":
        place = F.array_position(F.array(*[F.lit(d) for d in limit.names]), F.col("target"))
        taken = hits.groupBy("patient_id").agg(
            F.array_sort(F.collect_list(F.struct(place.alias("p"), "target", "chunk_id"))).alias("h")
        )
        return taken.select(
            "patient_id", F.col("h")[0]["chunk_id"].alias("chunk_id"),
            F.concat(F.lit("on "), F.array_join("h.target", ", ")).alias("why"),
        )
    why = F.lit(f"reports {limit.names[0]}" if limit.kind == "symptom" else limit.names[0])
    if limit.kind == "lab":
        hits = hits.filter(_lab_holds(limit))
        why = F.concat_ws(
            "", "target", F.lit(" "), F.col("value").cast("string"), F.lit(" "), "unit", F.lit(" ("), "flag",
            F.lit(", "), "date", F.lit(")"),
        )
    return hits.select("patient_id", "chunk_id", why.alias("why"))


def _on_record(limit: Limit) -> tuple[Column, Column]:
    """(whether a record meets a limit on age, sex or allergies, the reason it gives)."""
    if limit.kind == "age":
        age = F.col("age")
        return age > limit.number if limit.op == ">" else age < limit.number, F.concat(
            F.lit("age "), age.cast("string"),
        )
    if limit.kind == "sex":
        return F.col("sex") == limit.names[0], F.lit(None).cast("string")
    return F.contains(F.lower("allergies"), F.lit(limit.names[0])), F.concat(F.lit("allergy: "), "allergies")


def match(records: DataFrame, edge_table: DataFrame, cohort: Cohort) -> DataFrame:
    """patient_id, name, age, sex, why (array), chunk_ids (array, distinct): the patients that meet all limits, with
    the reason and the evidence for each in the order of the cohort's limits.

    Limits on the record itself filter; each other one is a join on patient_id with the few edges that meet it, and
    what it proves rides along.
    """
    profile = edge_table.filter("etype = 'profile'").select("patient_id", F.col("chunk_id").alias("profile"))
    out = records.select("patient_id", "name", "age", "sex", "allergies").join(profile, "patient_id")
    proofs = []
    for i, limit in enumerate(cohort):
        if limit.kind in _EDGES:
            names = [f"chunk_{i}", f"why_{i}"]
            out = out.join(_proof(edge_table, limit).toDF("patient_id", *names), "patient_id")
            proofs.append((F.col(names[1]), F.col(names[0])))
        else:
            holds, why = _on_record(limit)
            out = out.filter(holds)
            proofs.append((why, F.col("profile")))
    texts = lambda found: F.array_compact(F.array(*found)) if found else F.array().cast("array<string>")
    why = texts([w for w, _ in proofs])
    ids = F.array_distinct(F.concat(F.array("profile"), texts([c for _, c in proofs])))
    found = out.select("patient_id", "name", "age", "sex", why.alias("why"), ids.alias("chunk_ids"))
    return found.orderBy(F.desc(F.size("why")), "name", "patient_id")
