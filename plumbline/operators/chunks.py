"""Records to typed, citable units of text, without a shuffle: one flattened array a record, then one explode."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What a chunk's meta can hold; what doesn't apply to its kind is null.
META = "struct<name:string,age:int,sex:string,allergy:string,condition:string,status:string,drugs:array<string>,current:boolean,test:string,value:double,unit:string,flag:string,department:string,reason:string,etype:string,note_type:string>"


def drug_base(name: Column) -> Column:
    """A drug's name up to its first digit, " inhaler" or " weekly", trimmed, in lower case."""
    return F.lower(F.trim(F.regexp_extract(name, r"^(.*?)(?:[0-9]| inhaler| weekly|$)", 1)))


def _piece(kind: str, date: Column, text: Column, **meta: Column) -> Column:
    fields = [f.split(":")[0] for f in META[7:-1].replace("array<string>", "a").split(",")]
    types = dict(f.replace("array<string>", "array<string>").split(":", 1) for f in META[7:-1].split(","))
    values = [(meta[f] if f in meta else F.lit(None)).cast(types[f]).alias(f) for f in fields]
    return F.struct(
        F.lit(kind).alias("kind"), date.cast("string").alias("date"), text.alias("text"),
        F.struct(*values).alias("meta"),
    )


def chunk_records(records: DataFrame) -> DataFrame:
    """chunk_id, patient_id, ord, kind, date, text, meta. ord counts a record's chunks in the order profile, diagnoses,
    current medication, stopped medications, labs, encounters, notes; a missing array has none."""
    none = F.lit(None).cast("string")
    arr = lambda c: F.coalesce(F.col(c), F.expr(f"slice({c}, 1, 0)"), F.filter(F.col(c), lambda x: F.lit(False)))
    c = F.col
    profile = _piece(
        "profile", none,
        F.concat(
            c("name"), F.lit(" is a "), c("age").cast("string"), F.lit(" year old "),
            F.when(c("sex") == "F", "female").otherwise("male"), F.lit(" patient. Documented allergies: "),
            c("allergies"), F.lit("."),
        ),
        name=c("name"), age=c("age"), sex=c("sex"), allergy=c("allergies"),
    )
    diagnoses = F.transform(
        arr("diagnoses"),
        lambda d: _piece(
            "diagnosis", d["onset"],
            F.concat(
                F.lit("Diagnosis: "), d["condition"], F.lit(" (code "), d["code"], F.lit("), onset "), d["onset"],
                F.lit(", status "), d["status"], F.lit("."),
            ),
            condition=d["condition"], status=d["status"],
        ),
    )
    taken = F.filter(arr("medications"), lambda m: m["active"])
    current = _piece(
        "medication", none,
        F.concat(
            F.lit("Current medications: "),
            F.array_join(F.transform(taken, lambda m: F.concat(m["name"], F.lit(" for "), m["for"])), "; "),
            F.lit("."),
        ),
        drugs=F.transform(taken, lambda m: drug_base(m["name"])), current=F.lit(True),
    )
    stopped = F.transform(
        F.filter(arr("medications"), lambda m: ~m["active"]),
        lambda m: _piece(
            "medication", m["started"],
            F.concat(F.lit("Discontinued medication: "), m["name"], F.lit(" (was for "), m["for"], F.lit(").")),
            drugs=F.array(drug_base(m["name"])), current=F.lit(False),
        ),
    )
    labs = F.transform(
        arr("labs"),
        lambda x: _piece(
            "lab", x["date"],
            F.concat(
                F.lit("Lab result "), x["test"], F.lit(": "), x["value_txt"], F.lit(" "), x["unit"], F.lit(" on "),
                x["date"], F.lit(" (reference "), x["ref_txt"], F.lit("), flagged "), x["flag"], F.lit("."),
            ),
            test=x["test"], value=x["value"], unit=x["unit"], flag=x["flag"],
        ),
    )
    encounters = F.transform(
        arr("encounters"),
        lambda e: _piece(
            "encounter", e["date"],
            F.concat(
                e["type"], F.lit(" at "), e["department"], F.lit(" on "), e["date"], F.lit(" for "), e["reason"],
                F.lit("."),
            ),
            department=e["department"], reason=e["reason"], etype=e["type"],
        ),
    )
    notes = F.transform(
        arr("notes"),
        lambda n: _piece(
            "note", n["date"],
            F.concat(n["type"], F.lit(" by "), n["author"], F.lit(" on "), n["date"], F.lit(": "), n["text"]),
            note_type=n["type"],
        ),
    )
    some = lambda a: F.coalesce(a, F.filter(F.array(profile), lambda x: F.lit(False)))
    every = F.concat(
        F.array(profile), some(diagnoses), F.when(F.size(taken) > 0, F.array(current)).otherwise(some(F.lit(None))),
        some(stopped), some(labs), some(encounters), some(notes),
    )
    rows = records.select("patient_id", F.posexplode(every).alias("ord", "x"))
    return rows.select(
        F.concat_ws(":", "patient_id", "x.kind", F.col("ord").cast("string")).alias("chunk_id"), "patient_id", "ord",
        "x.kind", "x.date", "x.text", "x.meta",
    )
