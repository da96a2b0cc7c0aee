"""Queries that run the record engine's own operators over records made of the star schema, with SQL that says the same
in its own way: customers are patients, their orders visits, diagnoses and notes, order lines medications and labs."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import batch
from ..functions import questions as Q
from ..functions import text as T
from ..functions.vocab import ANSWER_INTENTS, COHORT_WORDS, ENC_WORDS, LAB_WORDS, MED_WORDS, NEGATIONS, NSAID_LIKE, RAAS, SYMPTOMS, TERMINATORS
from ..operators import clinical, context, graph, nlp, privacy, similarity, verify
from ..operators.chunks import chunk_records
from ..scratch import materialise
from ..sources.records import page
from .queries import _POOL, _extra_free, _pool, _r, _sql_list, _toks, query, table

CONDITIONS = [
    "Type 2 Diabetes Mellitus", "Essential Hypertension", "Chronic Kidney Disease Stage 3", "Asthma",
    "Coronary Artery Disease", "Hyperlipidemia", "Iron Deficiency Anemia",
]
DRUGS = [
    "Metformin 500 mg", "Telmisartan 40 mg", "Aspirin 75 mg", "Atorvastatin 20 mg", "Losartan 50 mg",
    "Methotrexate 15 mg weekly", "Salbutamol inhaler", "Sertraline 50 mg", "Folic Acid 5 mg", "Naproxen 250 mg",
]
ALLERGIES = ["None known", "NSAIDs", "Penicillin", "None known", "Latex"]
#: test, unit, low, high, least value, step: steps are sums of powers of two, so that values are exact.
TESTS = [
    ("HbA1c", "%", 4.0, 6.0, 3.5, 0.125), ("eGFR", "mL/min", 60.0, 120.0, 20.0, 2.0), (
        "Serum Potassium", "mmol/L", 3.5, 5.0, 3.0, 0.0625,
    ), ("SpO2", "%", 94.0, 100.0, 84.0, 0.25), ("Hemoglobin", "g/dL", 12.0, 17.0, 7.0, 0.25),
    ("Creatinine", "mg/dL", 0.5, 1.5, 0.25, 0.0625), ("LDL Cholesterol", "mg/dL", 40.0, 110.0, 30.0, 3.0),
]
_SAID = sorted(SYMPTOMS)


def _pick(values: list, n: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (n % len(values) + 1).cast("int"))


def records(spark, sf_dir: str, until: date | None = None) -> DataFrame:
    """Records with the schema of sources.records, one for each customer: an order's first line is a medication, every
    other a lab result. until: the day of the last order to take. Rows are shuffled to their record with the columns they
    come from, and become visits, notes and results there."""
    k = F.col("k")
    told = {"day": F.col("day").cast("string"), "condition": _pick(CONDITIONS, k)}
    taken = F.lit(True) if until is None else F.to_date("o_orderdate") <= F.lit(until)
    orders = table(spark, sf_dir, "orders").filter(taken).select(
        F.col("o_custkey").alias("c"), F.col("o_orderkey").alias("k"), F.to_date("o_orderdate").alias("day"),
        "o_orderstatus", "o_orderpriority",
    )
    o = orders.repartition("c").withColumns(told)
    kind = F.when(
        F.col("o_orderpriority") == "1-URGENT", "Emergency visit",
    ).when(F.col("o_orderpriority") == "2-HIGH", "Admission").otherwise("Clinic visit")
    status = F.when(F.col("o_orderstatus") == "O", "active").when(
        F.col("o_orderstatus") == "F", "controlled",
    ).otherwise("worsening")
    said = F.concat(
        F.lit("Seen for "), "condition", F.lit(". Reports "), _pick(_SAID, k), F.lit("; no "),
        _pick(_SAID, k * 7 + 3), F.lit(". Denies "), _pick(_SAID, k * 5 + 1), F.lit(" but has "),
        _pick(_SAID, k * 3 + 2), F.lit(". Allergies: Latex."),
    )
    encounter = F.struct(
        F.col("day").alias("date"), kind.alias("type"), F.col("o_orderpriority").alias("department"),
        F.col("condition").alias("reason"),
    )
    note = F.struct(
        F.col("day").alias("date"), F.lit("Visit note").alias("type"), F.lit("Dr. Berg").alias("author"),
        said.alias("text"),
    )
    diagnosis = F.when(
        k % 3 == 0,
        F.struct(
            "condition", F.concat(F.lit("X"), (k % 7).cast("string")).alias("code"), F.col("day").alias("onset"),
            status.alias("status"),
        ),
    )
    in_order = lambda *parts: F.sort_array(F.collect_list(F.struct(*parts)))
    visits = o.groupBy("c").agg(in_order("k", encounter.alias("e"), note.alias("n"), diagnosis.alias("d")).alias("v"))
    visits = visits.select(
        "c", F.col("v.e").alias("encounters"), F.col("v.n").alias("notes"), F.array_compact("v.d").alias("diagnoses"),
    )

    li = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("k"), "l_linenumber", "l_partkey", "l_suppkey", "l_quantity",
        F.to_date("l_shipdate").alias("day"), "l_returnflag",
    )
    li = li.join(orders.select("k", "c"), "k").repartition("c").withColumns(told)
    test = F.get(
        F.array(
            *[
                F.struct(
                    *[
                        F.lit(v).alias(n)
                        for n, v in zip(("test", "unit", "lo", "hi", "least", "step"), t, strict=True)
                    ]
                )
                for t in TESTS
            ]
        ),
        (F.col("l_suppkey") % len(TESTS)).cast("int"),
    )
    li = li.withColumn("t", test).withColumn("value", F.col("t.least") + F.col("l_quantity") * F.col("t.step"))
    flag = F.when(
        F.col("value") > F.col("t.hi"), "HIGH",
    ).when(F.col("value") < F.col("t.lo"), "LOW").otherwise("NORMAL")
    span = F.concat(F.col("t.lo").cast("string"), F.lit("-"), F.col("t.hi").cast("string"))
    med = F.struct(
        _pick(DRUGS, F.col("l_partkey")).alias("name"), F.col("condition").alias("for"),
        F.col("day").alias("started"), (F.col("l_returnflag") != "R").alias("active"),
    )
    lab = F.struct(
        "t.test", "value", "t.unit", F.col("t.lo").alias("ref_low"), F.col("t.hi").alias("ref_high"),
        span.alias("ref_txt"), F.col("value").cast("string").alias("value_txt"), F.col("day").alias("date"),
        flag.alias("flag"),
    )
    at = [F.col(c) for c in ("k", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "day", "l_returnflag")]
    lines = li.groupBy("c").agg(
        in_order(
            *at, F.when(F.col("l_linenumber") == 1, med).alias("m"),
            F.when(F.col("l_linenumber") > 1, lab).alias("x"),
        ).alias("v")
    )
    lines = lines.select("c", F.array_compact("v.m").alias("medications"), F.array_compact("v.x").alias("labs"))

    c = F.col("c_custkey")
    who = table(spark, sf_dir, "customer").select(
        c.alias("c"), F.concat(
            F.lit("AUR-"), (c + 100000).cast("string"),
        ).alias("patient_id"), F.col("c_name").alias("name"), (c % 70 + 20).cast("int").alias("age"), F.when(F.col("c_nationkey") % 2 == 0, "F").otherwise("M").alias("sex"),
        _pick(ALLERGIES, c).alias("allergies"), F.lit("+49-300000000").alias("phone"),
    )
    return who.join(visits, "c", "left").join(lines, "c", "left").drop("c")


def _sql_pick(values: list, n: str) -> str:
    return f"({_sql_list(values)})[({n}) % {len(values)} + 1]"


_T = lambda i: "[" + ", ".join(
    repr(t[i]) if isinstance(t[i], str) else f"{t[i]}::DOUBLE" for t in TESTS
) + f"][l_suppkey % {len(TESTS)} + 1]"
#: pat, diag, med, lab, enc and note: what the records above hold, flat; i numbers a patient's rows of a kind.
_REC = f"""pat AS (SELECT c_custkey AS c, 'AUR-' || (100000 + c_custkey) AS pid, c_name AS name, (20 + c_custkey % 70)::INT AS age, CASE WHEN c_nationkey % 2 = 0 THEN 'F' ELSE 'M' END AS sex, {_sql_pick(ALLERGIES, "c_custkey")} AS allergies FROM customer),
ord AS (SELECT o_custkey AS c, o_orderkey AS k, o_orderdate::DATE::VARCHAR AS day, o_orderstatus AS st, o_orderpriority AS pr, {_sql_pick(CONDITIONS, "o_orderkey")} AS condition, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS i FROM orders),
diag AS (SELECT c, row_number() OVER (PARTITION BY c ORDER BY k) - 1 AS i, condition, 'X' || (k % 7) AS code, day AS onset, CASE st WHEN 'O' THEN 'active' WHEN 'F' THEN 'controlled' ELSE 'worsening' END AS status FROM ord WHERE k % 3 = 0),
enc AS (SELECT c, i, day AS date, CASE pr WHEN '1-URGENT' THEN 'Emergency visit' WHEN '2-HIGH' THEN 'Admission' ELSE 'Clinic visit' END AS type, pr AS department, condition AS reason FROM ord),
note AS (SELECT c, i, day AS date, 'Seen for ' || condition || '. Reports ' || {_sql_pick(_SAID, "k")} || '; no ' || {_sql_pick(_SAID, "k * 7 + 3")} || '. Denies ' || {_sql_pick(_SAID, "k * 5 + 1")} || ' but has ' || {_sql_pick(_SAID, "k * 3 + 2")} || '. Allergies: Latex.' AS text FROM ord),
ln AS (SELECT ord.c, ord.condition, lineitem.*, l_shipdate::DATE::VARCHAR AS day FROM lineitem JOIN ord ON k = l_orderkey),
med AS (SELECT c, row_number() OVER (PARTITION BY c ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, day, l_returnflag) - 1 AS i, {_sql_pick(DRUGS, "l_partkey")} AS name, condition AS why, day AS started, l_returnflag <> 'R' AS active FROM ln WHERE l_linenumber = 1),
lab0 AS (SELECT c, row_number() OVER (PARTITION BY c ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, day, l_returnflag) - 1 AS i, {_T(0)} AS test, {_T(1)} AS unit, {_T(2)} AS lo, {_T(3)} AS hi, {_T(4)} + l_quantity * {_T(5)} AS value, day AS date FROM ln WHERE l_linenumber > 1),
lab AS (SELECT *, CASE WHEN value > hi THEN 'HIGH' WHEN value < lo THEN 'LOW' ELSE 'NORMAL' END AS flag FROM lab0)"""
_BASE = "lower(trim(regexp_extract({n}, '^(.*?)(?:[0-9]| inhaler| weekly|$)', 1)))"
_CHUNKS = f"""u AS (SELECT c, 0 AS b, 0 AS i, 'profile' AS kind, NULL::VARCHAR AS date, name || ' is a ' || age || ' year old ' || CASE sex WHEN 'F' THEN 'female' ELSE 'male' END || ' patient. Documented allergies: ' || allergies || '.' AS text, NULL::VARCHAR AS what, NULL::DOUBLE AS value, NULL::VARCHAR AS flag FROM pat
UNION ALL SELECT c, 1, i, 'diagnosis', onset, 'Diagnosis: ' || condition || ' (code ' || code || '), onset ' || onset || ', status ' || status || '.', condition, NULL, NULL FROM diag
UNION ALL SELECT c, 2, 0, 'medication', NULL, 'Current medications: ' || string_agg(name || ' for ' || why, '; ' ORDER BY i) || '.', 'now', NULL, NULL FROM med WHERE active GROUP BY c
UNION ALL SELECT c, 3, i, 'medication', started, 'Discontinued medication: ' || name || ' (was for ' || why || ').', {
    _BASE.format(n="name")
}, NULL, NULL FROM med WHERE NOT active
UNION ALL SELECT c, 4, i, 'lab', date, 'Lab result ' || test || ': ' || value || ' ' || unit || ' on ' || date || ' (reference ' || lo || '-' || hi || '), flagged ' || flag || '.', test, value, flag FROM lab
UNION ALL SELECT c, 5, i, 'encounter', date, type || ' at ' || department || ' on ' || date || ' for ' || reason || '.', reason, NULL, NULL FROM enc
UNION ALL SELECT c, 6, i, 'note', date, 'Visit note by Dr. Berg on ' || date || ': ' || text, NULL, NULL, NULL FROM note),
ch AS (SELECT u.*, pid, row_number() OVER (PARTITION BY u.c ORDER BY b, i) - 1 AS ord FROM u JOIN pat USING (c)),
chunk AS (SELECT *, pid || ':' || kind || ':' || ord AS chunk_id FROM ch)"""


@query(
    f"WITH {_REC}, {_CHUNKS} SELECT chunk_id, pid AS patient_id, ord::BIGINT AS ord, kind, date, md5(text) AS text_md5 FROM chunk"
)
def flatten_records(spark, sf_dir):
    """Records as typed, numbered, citable texts."""
    return chunk_records(records(spark, sf_dir)).select(
        "chunk_id", "patient_id", F.col("ord").cast("long").alias("ord"), "kind", "date",
        F.md5("text").alias("text_md5"),
    )


@query(f"""WITH {_REC}, {_CHUNKS}, s AS (SELECT * FROM chunk WHERE ord % 10 = 4),
m AS (SELECT s.chunk_id AS seed, s.kind AS sk, x.*, row_number() OVER (PARTITION BY s.chunk_id ORDER BY CASE WHEN s.kind = 'lab' THEN x.date END DESC NULLS LAST, x.ord) AS place FROM s JOIN chunk x ON x.c = s.c AND (
  (s.kind = 'lab' AND x.kind = 'lab' AND x.what = s.what AND x.ord <> s.ord) OR (s.kind = 'note' AND x.kind = 'encounter' AND x.date = s.date) OR (s.kind = 'encounter' AND x.kind = 'note' AND x.date = s.date)
  OR (s.kind = 'diagnosis' AND x.kind = 'medication' AND x.what = 'now') OR (s.kind = 'medication' AND x.kind = 'diagnosis')))
SELECT seed, place, chunk_id FROM m WHERE place <= CASE sk WHEN 'diagnosis' THEN 1 ELSE 2 END""")
def window_expand(spark, sf_dir):
    """What stands beside every tenth chunk in its record."""
    chunks = chunk_records(records(spark, sf_dir))
    found = context.neighbours(chunks, chunks.filter("ord % 10 = 4"))
    return found.select("seed", F.col("place").cast("long").alias("place"), "chunk_id")


# ---------------------------------------------------------------- rules, scores, cohort statistics, timelines

_ON = "EXISTS (FROM med WHERE med.c = p.c AND active AND (" + "{}" + "))"
_LIKE = lambda words: " OR ".join(f"contains(lower(med.name), '{w}')" for w in words)
#: Each patient's newest value of a test, the last of equal dates.
_LAST = "last AS (SELECT c, test, arg_max(value, (date, i)) AS v FROM lab GROUP BY c, test)"


def _value(test: str) -> str:
    return f"(SELECT v FROM last WHERE last.c = p.c AND test = '{test}')"


_ALERTS = f"""{_LAST}, al AS (
SELECT c, 0 AS o, 0 AS i, 'critical' AS severity, 'Allergy conflict' AS title, 'Documented NSAID allergy while on an NSAID-class medication (e.g. aspirin).' AS detail FROM pat p WHERE contains(lower(allergies), 'nsaids') AND {
    _ON.format(_LIKE(NSAID_LIKE))
}
UNION ALL SELECT c, 1, 1, 'high', 'Hyperkalaemia risk', 'Potassium ' || {
    _value("Serum Potassium")
} || ' mmol/L while on an ACE-inhibitor/ARB.' FROM pat p WHERE {_value("Serum Potassium")} > 5.0 AND {_ON.format(_LIKE(RAAS))}
UNION ALL SELECT c, 1, 2, 'high', 'Renal dose review', 'eGFR ' || {_value("eGFR")} || ' with metformin: review dose or continuation.' FROM pat p WHERE {_value("eGFR")} < 45 AND {
    _ON.format(_LIKE(["metformin"]))
}
UNION ALL SELECT c, 1, 3, 'high', 'Methotrexate with reduced eGFR', 'eGFR ' || {_value("eGFR")} || ': methotrexate clearance may be impaired.' FROM pat p WHERE {_value("eGFR")} < 45 AND {
    _ON.format(_LIKE(["methotrexate"]))
}
UNION ALL SELECT c, 2, 4, 'medium', 'Poor glycaemic control', 'Latest HbA1c ' || {
    _value("HbA1c")
} || '% (target below 7-8% for most adults).' FROM pat p WHERE {_value("HbA1c")} >= 8.0
UNION ALL SELECT c, 1, 5, 'high', 'Low oxygen saturation', 'SpO2 ' || {
    _value("SpO2")
} || '%.' FROM pat p WHERE {_value("SpO2")} < 90
UNION ALL SELECT c, 2, 6, 'medium', 'Significant anaemia', 'Haemoglobin ' || {
    _value("Hemoglobin")
} || ' g/dL.' FROM pat p WHERE {_value("Hemoglobin")} < 9
UNION ALL SELECT c, 2, 7, 'medium', 'Condition marked worsening', string_agg(condition, ', ' ORDER BY i) FROM diag WHERE status = 'worsening' GROUP BY c)"""
_RISK = f"""{_ALERTS}, rk0 AS (SELECT c, pid, least(100, CASE WHEN age >= 65 THEN 12 WHEN age >= 50 THEN 6 ELSE 0 END + 8 * (SELECT count(*) FROM diag WHERE diag.c = p.c) + CASE WHEN (SELECT count(*) FROM med WHERE med.c = p.c AND active) >= 4 THEN 10 ELSE 0 END
+ least(25, 2 * (SELECT count(*) FROM lab WHERE lab.c = p.c AND flag <> 'NORMAL')) + 6 * (SELECT count(*) FROM enc WHERE enc.c = p.c AND type IN ('Admission', 'Emergency visit')) + CASE WHEN EXISTS (FROM diag WHERE diag.c = p.c AND status = 'worsening') THEN 12 ELSE 0 END
+ coalesce((SELECT sum(CASE severity WHEN 'critical' THEN 12 WHEN 'high' THEN 8 ELSE 4 END) FROM al WHERE al.c = p.c), 0))::BIGINT AS score FROM pat p),
rk AS (SELECT *, CASE WHEN score >= 60 THEN 'high' WHEN score >= 35 THEN 'moderate' ELSE 'low' END AS band FROM rk0)"""


@query(
    f"WITH {_REC}, {_ALERTS} SELECT pid AS patient_id, row_number() OVER (PARTITION BY c ORDER BY o, i) - 1 AS place, severity, title, detail FROM al JOIN pat USING (c)"
)
def alert_rules(spark, sf_dir):
    rows = clinical.with_alerts(records(spark, sf_dir)).select("patient_id", F.posexplode("alerts").alias("place", "a"))
    return rows.select("patient_id", F.col("place").cast("long").alias("place"), "a.severity", "a.title", "a.detail")


@query(f"WITH {_REC}, {_RISK} SELECT pid AS patient_id, score, band FROM rk")
def risk_score(spark, sf_dir):
    return clinical.with_risk(records(spark, sf_dir)).select(
        "patient_id", F.col("score").cast("long").alias("score"), "band",
    )


_STATS = f"""{_RISK}, st AS (SELECT 'patients' AS part, NULL AS name, count(*)::DOUBLE AS value FROM pat UNION ALL SELECT 'mean_age', NULL, round(avg(age), 1) FROM pat UNION ALL SELECT 'female_pct', NULL, round(100.0::DOUBLE * avg((sex = 'F')::INT), 1) FROM pat
UNION ALL SELECT 'condition', condition, count(*) FROM diag GROUP BY condition
UNION ALL SELECT 'age_bin', n, (SELECT count(*) FROM pat WHERE age >= lo AND age < hi) FROM (VALUES ('<40', 0, 40), ('40-59', 40, 60), ('60-74', 60, 75), ('75+', 75, 999)) v(n, lo, hi)
UNION ALL SELECT 'risk_band', n, (SELECT count(*) FROM rk WHERE band = n) FROM (VALUES ('low'), ('moderate'), ('high')) v(n)
UNION ALL SELECT 'alert', n, (SELECT count(*) FROM al WHERE severity = n) FROM (VALUES ('critical'), ('high'), ('medium')) v(n))"""


@query(f"WITH {_REC}, {_STATS} SELECT part, name, value FROM st")
def cohort_stats(spark, sf_dir):
    return clinical.cohort_table(records(spark, sf_dir))


@query(f"WITH {_REC}, {_STATS} SELECT name AS bin, value::BIGINT AS n FROM st WHERE part = 'age_bin'")
def age_bins_zero_fill(spark, sf_dir):
    """Of an empty cohort's bins, all are there."""
    return clinical.cohort_table(records(spark, sf_dir)).filter("part = 'age_bin'").select(
        F.col("name").alias("bin"), F.col("value").cast("long").alias("n"),
    )


@query(f"""WITH {_REC}, tl AS (SELECT c, date, 0 AS b, i, 'encounter' AS kind, type || ' · ' || department AS title, reason AS detail FROM enc UNION ALL SELECT c, date, 1, i, 'note', 'Visit note', substr(text, 1, 140) || '…' FROM note
UNION ALL SELECT c, date, 2, i, 'lab', test || ' ' || value || ' ' || unit, flag FROM lab WHERE flag <> 'NORMAL')
SELECT pid AS patient_id, row_number() OVER (PARTITION BY c ORDER BY date DESC, b, i) - 1 AS place, date, kind, title, detail FROM tl JOIN pat USING (c)""")
def timeline_union(spark, sf_dir):
    rows = clinical.timeline(records(spark, sf_dir))
    return rows.select("patient_id", F.col("place").cast("long").alias("place"), "date", "kind", "title", "detail")


@query(f"""WITH {_REC}, {_RISK} SELECT pid AS patient_id, name, score AS risk, row_number() OVER (ORDER BY score DESC, name, pid) AS place FROM rk JOIN pat USING (c, pid)
WHERE contains(lower(name || pid || coalesce((SELECT string_agg(condition, ' ' ORDER BY i) FROM diag WHERE diag.c = rk.c), '')), 'asthma') ORDER BY place LIMIT 200""")
def patient_search(spark, sf_dir):
    """The two hundred patients of the highest risk among those whose name, id or conditions hold a word."""
    found = clinical.patient_list(records(spark, sf_dir), "Asthma").limit(200)
    line = Window.orderBy(F.desc("risk"), "name", "patient_id")
    return found.select(
        "patient_id", "name", F.col("risk").cast("long").alias("risk"),
    ).withColumn("place", F.row_number().over(line).cast("long"))


@query(f"WITH {_REC} SELECT pid AS patient_id, name FROM pat ORDER BY pid LIMIT 100 OFFSET 50")
def paginate(spark, sf_dir):
    return page(records(spark, sf_dir), 100, 50)


# ---------------------------------------------------------------- series of labs


@query(f"""WITH {_REC}, g AS (SELECT c, test, count(*) AS n, arg_min(value, (date, i)) AS a, arg_max(value, (date, i)) AS b FROM lab GROUP BY c, test)
SELECT pid AS patient_id, test, n, a AS first_value, b AS last_value, CASE WHEN n < 2 THEN 'insufficient data' WHEN a = 0 THEN 'stable' WHEN (b - a) / abs(a) > 0.08::DOUBLE THEN 'rising' WHEN (b - a) / abs(a) < -0.08::DOUBLE THEN 'falling' ELSE 'stable' END AS trend FROM g JOIN pat USING (c)""")
def record_lab_trends(spark, sf_dir):
    return clinical.lab_trends(records(spark, sf_dir))


@query(f"""WITH {_REC}, r AS (SELECT *, row_number() OVER (PARTITION BY c, test ORDER BY date DESC, i DESC) AS rn, count(*) OVER (PARTITION BY c, test) AS n FROM lab),
m AS (SELECT c, test, median(value) AS med FROM r WHERE rn > 1 AND n >= 4 GROUP BY ALL),
d AS (SELECT c, test, any_value(med) AS med, median(abs(value - med)) * 1.4826::DOUBLE AS mad, stddev_pop(value) AS sd FROM r JOIN m USING (c, test) WHERE rn > 1 GROUP BY ALL)
SELECT pid AS patient_id, test, round(med, 4) AS median, value AS last, abs((value - med) / CASE WHEN mad <> 0 THEN mad WHEN sd <> 0 THEN sd ELSE 1e-9 END) > 3.5 AS flag FROM d JOIN r USING (c, test) JOIN pat USING (c) WHERE rn = 1""")
def record_lab_anomalies(spark, sf_dir):
    return clinical.lab_anomalies(records(spark, sf_dir)).select(
        "patient_id", "test", _r(F.col("median"), 4).alias("median"), "last", "flag",
    )


# ---------------------------------------------------------------- notes: sentences, entities, negation

_WS = r"[ \t\n\v\f\r]+"
_SENT = rf"list_filter(list_transform(string_split(regexp_replace(coalesce(text, ''), '([.;]){_WS}', '\1' || chr(1), 'g'), chr(1)), lambda s: trim(s)), lambda s: s <> '')"
_LEX = "lex(kind, name, pat) AS (VALUES " + ", ".join(
    "(" + ", ".join("'" + x.replace("'", "''") + "'" for x in entry) + ")" for entry in nlp.lexicon()
) + ")"
_ENT = f"""{_LEX}, sn AS (SELECT c, i, date, lower(unnest({_SENT})) AS s FROM note),
mn AS (SELECT c, i, date, s, kind, name, regexp_replace(regexp_extract(s, '^(.*?)' || pat, 1, 's'), '^.*{TERMINATORS}', '', 's') AS before FROM sn, lex WHERE regexp_matches(s, pat)),
ent AS (SELECT c, i, date, kind, name, regexp_matches(array_to_string((list_filter(regexp_split_to_array(before, '{_WS}'), lambda w: w <> ''))[-6:], ' '), '{NEGATIONS}') AS negated FROM mn)"""


@query(
    f"SELECT doc_id, len({_SENT})::BIGINT AS n_sentences, list_max(list_transform({_SENT}, lambda s: len(s)))::BIGINT AS longest FROM documents"
)
def sentence_split(spark, sf_dir):
    s = T.sentences(F.col("text"))
    return table(spark, sf_dir, "documents").select(
        "doc_id", F.size(s).cast("long").alias("n_sentences"),
        F.array_max(F.transform(s, lambda x: F.length(x))).cast("long").alias("longest"),
    )


def _notes(spark, sf_dir) -> DataFrame:
    return records(spark, sf_dir).select("patient_id", F.posexplode("notes").alias("i", "n")).select(
        "patient_id", F.col("i").cast("long").alias("i"), "n.date", "n.text",
    )


@query(
    f"WITH {_REC}, {_ENT} SELECT pid AS patient_id, i, kind, ent.name, negated, count(*)::BIGINT AS mentions FROM ent JOIN pat USING (c) GROUP BY ALL UNION ALL SELECT pid, i, 'allergen', 'Latex', false, 1 FROM note JOIN pat USING (c)"
)
def negation_flags(spark, sf_dir):
    """Every entity of every note, with whether it is denied."""
    rows = nlp.entity_rows(_notes(spark, sf_dir).select("patient_id", "i", "text"), "text")
    return rows.groupBy(
        "patient_id", "i", F.col("e.type").alias("kind"), F.col("e.text").alias("name"), "e.negated",
    ).agg(F.count(F.lit(1)).alias("mentions"))


@query(
    f"WITH {_REC}, {_ENT} SELECT pid AS patient_id, ent.name, negated, count(*)::BIGINT AS mentions, max(date) AS last FROM ent JOIN pat USING (c) WHERE kind = 'symptom' GROUP BY ALL"
)
def entity_counts(spark, sf_dir):
    """Every symptom of every patient's notes, said and denied."""
    return nlp.note_symptoms(_notes(spark, sf_dir), ["patient_id"], "date", "text")


# ---------------------------------------------------------------- edges and cohorts

_EDGE = f"""{_ENT}, eg AS (SELECT c, 'profile' AS etype, 'profile' AS target, chunk_id, date, value, flag FROM chunk WHERE kind = 'profile'
UNION ALL SELECT c, 'has_condition', what, arg_max(chunk_id, ord), arg_max(date, ord), NULL, NULL FROM chunk WHERE kind = 'diagnosis' GROUP BY c, what
UNION ALL SELECT DISTINCT med.c, 'takes_drug', {
    _BASE.format(n="med.name")
}, chunk_id, NULL, NULL, NULL FROM med JOIN chunk ON chunk.c = med.c AND what = 'now' WHERE active
UNION ALL SELECT c, 'took_drug', what, arg_max(chunk_id, ord), arg_max(date, ord), NULL, NULL FROM chunk WHERE kind = 'medication' AND what <> 'now' GROUP BY c, what
UNION ALL SELECT c, 'has_lab', what, arg_max(chunk_id, (date, -ord)), max(date), arg_max(value, (date, -ord)), arg_max(flag, (date, -ord)) FROM chunk WHERE kind = 'lab' GROUP BY c, what
UNION ALL SELECT c, 'reports_symptom', name, arg_min(chunk_id, ord), arg_min(date, ord), NULL, NULL FROM (SELECT e.c, e.name, chunk_id, chunk.date, ord FROM ent e JOIN chunk ON chunk.c = e.c AND chunk.kind = 'note' AND chunk.i = e.i WHERE e.kind = 'symptom' AND NOT negated) GROUP BY c, name)"""


def _edges(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Records and their edges; edges are written, as each limit of a cohort reads them."""
    held = records(spark, sf_dir)
    return held, materialise(graph.edges(chunk_records(held)), "edges")


@query(
    f"WITH {_REC}, {_CHUNKS}, {_EDGE} SELECT pid AS patient_id, etype, target, chunk_id, date, value, flag FROM eg JOIN pat USING (c)"
)
def record_edges(spark, sf_dir):
    return _edges(spark, sf_dir)[1].select("patient_id", "etype", "target", "chunk_id", "date", "value", "flag")


@query(
    f"WITH {_REC}, {_CHUNKS}, {_EDGE} SELECT etype, count(DISTINCT target)::BIGINT AS nodes, count(*)::BIGINT AS edges FROM eg GROUP BY etype"
)
def graph_stats(spark, sf_dir):
    return graph.stats_table(_edges(spark, sf_dir)[1])


def _cohort_sql(*proofs: str, where: str = "true") -> str:
    """proofs: (c, place, why, chunk_id) of each limit, in order; where: limits on the record itself."""
    parts = " UNION ALL ".join(f"SELECT c, {i} AS place, why, chunk_id FROM ({p})" for i, p in enumerate(proofs))
    met = " AND ".join(f"c IN (SELECT c FROM pr WHERE place = {i})" for i in range(len(proofs)))
    return f"""WITH {_REC}, {_CHUNKS}, {_EDGE}, pr AS ({parts}), me AS (SELECT * FROM pat WHERE {where} AND {met})
SELECT pid AS patient_id, name, age::BIGINT AS age, sex, (SELECT string_agg(why, '; ' ORDER BY place) FROM pr WHERE pr.c = me.c AND why IS NOT NULL) AS why,
(SELECT string_agg(chunk_id, ',' ORDER BY place) FROM (SELECT chunk_id, min(place) AS place FROM (SELECT chunk_id, -1 AS place FROM eg WHERE eg.c = me.c AND etype = 'profile' UNION ALL SELECT chunk_id, place FROM pr WHERE pr.c = me.c) GROUP BY chunk_id)) AS chunk_ids FROM me"""


def _has_sql(etype: str, target: str, why: str, more: str = "true") -> str:
    return f"SELECT c, {why} AS why, chunk_id FROM eg WHERE etype = '{etype}' AND target = '{target}' AND {more}"


def _lab_sql(test: str, more: str) -> str:
    unit = next(t[1] for t in TESTS if t[0] == test)
    return _has_sql("has_lab", test, f"'{test} ' || value || ' {unit} (' || flag || ', ' || date || ')'", more)


def _drugs_sql(*drugs: str) -> str:
    order = f"list_position({_sql_list(list(drugs))}, target)"
    return f"SELECT c, 'on ' || string_agg(target, ', ' ORDER BY {order}) AS why, arg_min(chunk_id, {order}) AS chunk_id FROM eg WHERE etype = 'takes_drug' AND target IN ({', '.join(repr(d) for d in drugs)}) GROUP BY c"


_PROFILE = "SELECT c, {why} AS why, chunk_id FROM eg JOIN pat USING (c) WHERE etype = 'profile'"


def _matched(spark, sf_dir, question: str) -> DataFrame:
    held, edges = _edges(spark, sf_dir)
    found = graph.match(
        held, edges, Q.parse_cohort(question, {"metformin", "telmisartan", "losartan", "atorvastatin", "salbutamol"}),
    )
    return found.select(
        "patient_id", "name", F.col("age").cast("long").alias("age"), "sex", F.array_join("why", "; ").alias("why"),
        F.array_join("chunk_ids", ",").alias("chunk_ids"),
    )


@query(
    _cohort_sql(
        _has_sql("has_condition", "Type 2 Diabetes Mellitus", "target"), _drugs_sql("metformin"),
        _lab_sql("eGFR", "value < 60"),
    )
)
def cohort_semi_join(spark, sf_dir):
    return _matched(spark, sf_dir, "which patients with diabetes on metformin have eGFR below 60?")


@query(_cohort_sql(_drugs_sql("losartan", "telmisartan"), _lab_sql("Serum Potassium", "flag = 'HIGH'")))
def cohort_or_group(spark, sf_dir):
    return _matched(spark, sf_dir, "patients on arbs with high potassium")


@query(
    _cohort_sql(
        _PROFILE.format(why="'allergy: ' || allergies"), _has_sql("reports_symptom", "fatigue", "'reports fatigue'"),
        where="contains(lower(allergies), 'penicillin')",
    )
)
def cohort_anti(spark, sf_dir):
    """Those who report a symptom, without those who deny it."""
    return _matched(spark, sf_dir, "who is allergic to penicillin and has fatigue")


@query(
    _cohort_sql(
        _lab_sql("Hemoglobin", "flag <> 'NORMAL'"), _PROFILE.format(why="'age ' || age"),
        _PROFILE.format(why="NULL::VARCHAR"), _has_sql("reports_symptom", "cough", "'reports cough'"),
        where="age > 50 AND sex = 'F'",
    )
)
def cohort_reasons(spark, sf_dir):
    return _matched(spark, sf_dir, "women over 50 with abnormal hemoglobin and cough")


# ---------------------------------------------------------------- likeness

_FEATURES = f"""{_RISK}, cs AS (SELECT list_sort(list_distinct(list(condition))) AS cs FROM diag), ts AS (SELECT list_sort(list_distinct(list(test))) AS ts FROM lab),
far AS (SELECT c, test, greatest(-3.0::DOUBLE, least(3.0::DOUBLE, (arg_max(value, (date, i)) - (any_value(lo) + any_value(hi)) / 2) / greatest(any_value(hi) - any_value(lo), 1e-6))) / 3 AS f FROM lab GROUP BY c, test),
hv AS (SELECT c, list_sort(list_distinct(list(condition))) AS have FROM diag GROUP BY c), dr AS (SELECT c, count(*) AS n, list_sort(list_distinct(list({_BASE.format(n="name")}))) AS drugs FROM med WHERE active GROUP BY c),
fm AS (SELECT c, map_from_entries(list((test, f))) AS m FROM far GROUP BY c),
ft AS (SELECT p.c, p.pid, coalesce(have, []) AS have, coalesce(drugs, []) AS drugs, list_concat([p.age / 100.0::DOUBLE, CASE p.sex WHEN 'F' THEN 1.0::DOUBLE ELSE 0 END, coalesce(n, 0) / 6.0::DOUBLE, score / 100.0::DOUBLE],
  list_transform(cs, lambda x: CASE WHEN list_contains(coalesce(have, []), x) THEN 1.5::DOUBLE ELSE 0 END), list_transform(ts, lambda x: coalesce(m[x], 0.0::DOUBLE))) AS f FROM pat p JOIN rk USING (c) LEFT JOIN hv USING (c) LEFT JOIN dr USING (c) LEFT JOIN fm USING (c), cs, ts)"""


@query(f"""WITH {_REC}, {_FEATURES}, me AS (SELECT * FROM ft WHERE pid = 'AUR-100007')
SELECT ft.pid AS patient_id, round(list_dot_product(ft.f, me.f) / (sqrt(list_dot_product(ft.f, ft.f)) * sqrt(list_dot_product(me.f, me.f))), 3) AS similarity, array_to_string(list_sort(list_intersect(ft.have, me.have)), ',') AS conditions,
array_to_string(list_sort(list_intersect(ft.drugs, me.drugs)), ',') AS medications FROM ft, me WHERE ft.pid <> me.pid ORDER BY similarity DESC, ft.pid LIMIT 15""")
def similar_entities(spark, sf_dir):
    found = similarity.similar(similarity.feature_vectors(records(spark, sf_dir)), "AUR-100007", 15)
    return found.select(
        "patient_id", "similarity", F.array_join("shared_conditions", ",").alias("conditions"),
        F.array_join("shared_medications", ",").alias("medications"),
    )


@query(
    f"WITH {_REC}, {_FEATURES} SELECT pid AS patient_id, len(f)::BIGINT AS n, round(list_sum(f), 6) AS total, round(list_dot_product(f, f), 6) AS norm2 FROM ft"
)
def feature_pivot(spark, sf_dir):
    f = F.col("features")
    rows = similarity.feature_vectors(records(spark, sf_dir))
    return rows.select(
        "patient_id", F.size(f).cast("long").alias("n"),
        F.round(F.aggregate(f, F.lit(0.0), lambda a, x: a + x), 6).alias("total"),
        F.round(T.dot(f, f), 6).alias("norm2"),
    )


# ---------------------------------------------------------------- privacy, audit

_UW, _UD, _US = r"\p{L}\p{M}\p{Nd}\p{Pc}", r"\p{Nd}", r"\s\v\p{Z}\x{85}"
_RED = rf"regexp_replace(regexp_replace(regexp_replace(regexp_replace(coalesce(text, ''), '\+?{_UD}[{_UD}\-{_US}]{{8,}}{_UD}', '[PHONE]', 'g'), '[{_UW}.+-]+@[{_UW}-]+\.[{_UW}.-]+', '[EMAIL]', 'g'), '\bAUR-\d{{6}}\b', '[MRN]', 'g'), '\bDr\.[{_US}]+[A-Z][a-z]+', 'Dr. [CLINICIAN]', 'g')"


@query(
    f"WITH r AS (SELECT doc_id, {_RED} AS t FROM documents) SELECT doc_id, md5(t) AS redacted_md5, len(regexp_extract_all(t, '\\[PHONE\\]'))::BIGINT AS n_phone FROM r"
)
def redact_text(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select(
        "doc_id", privacy.redacted(F.coalesce("text", F.lit(""))).alias("t"),
    )
    return rows.select(
        "doc_id", F.md5("t").alias("redacted_md5"),
        F.regexp_count("t", F.lit(r"\[PHONE\]")).cast("long").alias("n_phone"),
    )


@query("""WITH s AS (SELECT user_id || '/' || event_type || '/' || strftime(ts, '%Y-%m') AS segment, event_id, concat_ws('|', event_id, event_type, props) AS body FROM events),
n AS (SELECT *, row_number() OVER (PARTITION BY segment ORDER BY event_id) AS seq FROM s)
SELECT segment, count(*)::BIGINT AS entries, min(CASE WHEN event_id % 97 = 0 THEN seq END) AS broken_at,
  list_reduce(list_prepend(repeat('0', 64), list(body ORDER BY event_id)), lambda h, b: sha256(h || b)) AS head FROM n GROUP BY segment""")
def audit_chain_verify(spark, sf_dir):
    """A chained log for each user, type and month, some of whose entries were edited afterwards: where each breaks first."""
    at = F.concat_ws("/", F.col("user_id").cast("string"), "event_type", F.date_format("ts", "yyyy-MM"))
    events = table(spark, sf_dir, "events").select(
        at.alias("segment"), "event_id",
        F.concat_ws("|", F.col("event_id").cast("string"), "event_type", "props").alias("body"),
    )
    edited = F.when(F.col("event_id") % 97 == 0, F.concat("body", F.lit("!"))).otherwise(F.col("body"))
    log = privacy.chained(events, "segment", "event_id", "body").withColumn("body", edited)
    return privacy.verify_chain(log, "seq", "body", segment="segment")


# ---------------------------------------------------------------- questions and conversations

_INTENT = f"CASE WHEN regexp_matches(t, 'allerg') THEN 'allergy' WHEN regexp_matches(t, '{MED_WORDS}') THEN 'medication' WHEN regexp_matches(t, '{LAB_WORDS}') THEN 'lab' WHEN regexp_matches(t, '{ENC_WORDS}') THEN 'encounter' ELSE 'general' END"
_ANSWER = "CASE " + " ".join(
    f"WHEN regexp_matches(t, '{p}') THEN '{name}'" for name, p in ANSWER_INTENTS.items()
) + " ELSE 'general' END"


@query(
    f"SELECT conv_id, turn, {_INTENT} AS intent, {_ANSWER} AS answer_intent, regexp_matches(t, '{COHORT_WORDS}') AS cohort FROM (SELECT conv_id, turn, lower(coalesce(text, '')) AS t FROM conversations)"
)
def intent_label(spark, sf_dir):
    rows = batch.read(
        table(spark, sf_dir, "conversations"), "text",
        {
            "intent": ("string", Q.intent), "answer_intent": ("string", Q.answer_intent),
            "cohort": ("boolean", Q.is_cohort),
        },
    )
    return rows.select("conv_id", "turn", "intent", "answer_intent", "cohort")


_ASKING = "|".join(["what", "how", "is", "are", "does", "did", "show", "list", "who", "which"])
_CUT = rf"regexp_replace(regexp_replace(regexp_replace(coalesce(text, ''), '([?;])(\s)', chr(1) || '\2', 'g'), '(?i)(\s)(?:and also|as well as)(\s)', '\1' || chr(1) || '\2', 'g'), '(?i)([^\x01\s]\s+)and(\s+(?:{_ASKING})\b)', '\1' || chr(1) || '\2', 'g')"


@query(rf"""WITH p AS (SELECT conv_id, turn, text, list_filter(list_transform(string_split({_CUT}, chr(1)), lambda x: trim(x, ' ?.,' || chr(9) || chr(10))), lambda x: len({_extra_free("x")}) > 0) AS p FROM conversations)
SELECT conv_id, turn, greatest(len(p), 1)::BIGINT AS n_parts, md5(CASE WHEN len(p) > 1 THEN p[1] ELSE trim(coalesce(text, ''), ' ' || chr(9) || chr(10) || chr(13)) END) AS first_md5 FROM p""")
def decompose_turns(spark, sf_dir):
    rows = batch.read(
        table(spark, sf_dir, "conversations"), "text",
        {"n_parts": ("long", lambda q: len(Q.decompose(q))), "first": ("string", lambda q: Q.decompose(q)[0])},
    )
    return rows.select("conv_id", "turn", "n_parts", F.md5("first").alias("first_md5"))


_ITS = lambda c: "list_filter([" + ", ".join(
    f"trim(regexp_extract({c}, '(?i){p}', 0))" for p in Q._MODIFIERS
) + "], lambda m: m <> '')"
_OPENS = "(?i)^[^a-z0-9<>?;]*(?:" + "|".join(sorted(Q._OPENERS, key=len, reverse=True)) + r")\b"


@query(rf"""WITH l AS (SELECT conv_id, turn, coalesce(text, '') AS q, coalesce(lag(text) OVER (PARTITION BY conv_id, role ORDER BY turn), '') AS before FROM conversations),
m AS (SELECT *, len(list_filter(regexp_split_to_array(q, '{_WS}'), lambda w: w <> '')) <= {Q.SHORT} AND trim(before) <> '' AND len({_ITS("q")}) = 0 AND (regexp_matches(q, '{_OPENS}') OR regexp_matches(q, '(?i)(?:{"|".join(Q._POINTERS)})')) AS follows,
  list_filter({_ITS("before")}, lambda m: NOT contains(lower(q), lower(m))) AS carried FROM l)
SELECT conv_id, turn, follows AND len(carried) > 0 AS carries, md5(CASE WHEN follows AND len(carried) > 0 THEN trim(trim(regexp_replace(q, '{_OPENS}', ''), ' ?.,') || ' ' || array_to_string(carried, ' ')) ELSE q END) AS alone_md5 FROM m""")
def condense_followups(spark, sf_dir):
    """Each turn as a question of its own, with what it takes from the speaker's last one."""
    line = Window.partitionBy("conv_id", "role").orderBy("turn")
    turns = table(spark, sf_dir, "conversations").select(
        "conv_id", "turn", F.coalesce("text", F.lit("")).alias("q"),
        F.coalesce(F.lag("text").over(line), F.lit("")).alias("before"),
    )
    both = turns.select("conv_id", "turn", F.concat_ws("\u0001", "q", "before").alias("both"))
    condensed = lambda x: Q.condense(x.split("\u0001")[0], [x.split("\u0001")[1]])
    rows = batch.read(
        both, "both",
        {
            "alone": ("string", lambda x: condensed(x)[0]),
            "carries": ("boolean", lambda x: condensed(x)[1] is not None),
        },
    )
    return rows.select("conv_id", "turn", "carries", F.md5("alone").alias("alone_md5"))


_TEST_SQL = "[" + ", ".join(
    f"CASE WHEN regexp_matches(t, '(^|[^a-z0-9]){n}($|[^a-z0-9])') THEN '{k}' END"
    for k, n in (("eGFR", "e?gfr"), ("HbA1c", "(hb)?a1c"), ("Creatinine", "creatinine"))
) + "]"


@query(f"""WITH a AS (SELECT event_id, {_sql_pick(["latest egfr", "creatinine over 1.4 since 2024", "hba1c in the last 6 months", "any alerts or risk?", "is the hba1c trend rising and what is the gfr"], "event_id")} AS t FROM events)
SELECT event_id, array_to_string(list_sort(list_filter({_TEST_SQL}, lambda x: x IS NOT NULL)), ',') AS tests, CASE WHEN contains(t, 'last 6 months') THEN '2026-01-01' WHEN contains(t, 'since 2024') THEN '2024-01-01' END AS start, contains(t, 'latest') AS latest,
CASE WHEN regexp_matches(t, 'alert|risk|trend') THEN 'agentic' WHEN regexp_matches(t, 'latest|last 6|since') THEN 'temporal' ELSE 'corrective' END AS route, CASE WHEN contains(t, 'over 1.4') THEN 1.4 END AS over FROM a""")
def question_readings(spark, sf_dir):
    """What questions about one patient name and where they go: tests, time, route and limits."""
    asof = date(2026, 6, 30)
    asked = _pick(
        [
            "latest egfr", "creatinine over 1.4 since 2024", "hba1c in the last 6 months", "any alerts or risk?",
            "is the hba1c trend rising and what is the gfr"
        ],
        F.col("event_id"),
    )
    rows = table(spark, sf_dir, "events").select("event_id", asked.alias("t"))
    start = lambda q: w.start.isoformat() if (w := Q.parse_time(q, asof)).start else None
    over = lambda q: next((x.number for x in Q.parse_cohort(q, set()) if x.kind == "lab"), None)
    readers = {
        "tests": ("string", lambda q: ",".join(sorted(Q.named_tests(q)))), "start": ("string", start), "latest": ("boolean", lambda q: Q.parse_time(q, asof).latest), "route": (
            "string", lambda q: Q.route(q, Q.parse_cohort(q, set()), True, asof)[0],
        ), "over": ("double", over),
    }
    return batch.read(rows, "t", readers).drop("t")


# ---------------------------------------------------------------- verification

_NUMBERS = r"list_transform(regexp_extract_all({t}, '(?:^|[^A-Za-z0-9_.])([0-9]+(?:\.[0-9]+)?)', 1), lambda n: n)"


_CLAIMS = rf"""{_POOL}, y AS (SELECT item_id, rank + 1 AS place, CASE WHEN len(q) = 0 THEN 1 ELSE len(list_intersect(q, t))::DOUBLE / len(q) END AS overlap,
  len(list_filter({_NUMBERS.format(t="'- ' || regexp_replace(b.text, '[' || chr(10) || chr(13) || ']', ' ', 'g')")}, lambda n: NOT list_contains({_NUMBERS.format(t="d.text")}, n))) AS missing
  FROM x JOIN benchmark b USING (item_id) JOIN documents d USING (doc_id) WHERE rank < 3)"""


def _answers(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """answers and evidence: each benchmark passage, claimed once for each of its three best texts."""
    pool = _pool(spark, sf_dir, 3).select(
        F.col("item_id").alias("aid"), (F.col("rank") + 1).cast("int").alias("n"), "doc_id", "question", "passage",
    )
    claim = F.concat(
        F.lit("- "), F.regexp_replace("question", r"[\n\r]", " "), F.lit(" ["), F.col("n").cast("string"), F.lit("]"),
    )
    lines = F.sort_array(F.collect_list(F.struct("n", claim.alias("claim"))))["claim"]
    return pool.groupBy("aid").agg(F.array_join(lines, "\n").alias("answer")), pool.select(
        "aid", "n", F.col("passage").alias("text"),
    )


@query(
    f"{_CLAIMS} SELECT item_id, place::BIGINT AS place, round(overlap, 6) AS overlap, missing::BIGINT AS missing_numbers, overlap >= 0.5 AND missing = 0 AS supported FROM y"
)
def verify_claims(spark, sf_dir):
    found = verify.claims(*_answers(spark, sf_dir))
    return found.select(
        F.col("aid").alias("item_id"), (F.col("line_no") + 1).cast("long").alias("place"),
        _r(F.col("overlap")).alias("overlap"), F.col("missing").cast("long").alias("missing_numbers"), "supported",
    )


@query(
    f"{_CLAIMS} SELECT item_id, count(*)::BIGINT AS total, sum((overlap >= 0.5 AND missing = 0)::INT)::BIGINT AS supported, round(avg((overlap >= 0.5 AND missing = 0)::INT), 3) AS faithfulness FROM y GROUP BY item_id"
)
def faithfulness(spark, sf_dir):
    found = verify.verify_batch(*_answers(spark, sf_dir))
    return found.select(
        F.col("aid").alias("item_id"), F.col("total").cast("long").alias("total"),
        F.col("supported").cast("long").alias("supported"), "faithfulness",
    )
