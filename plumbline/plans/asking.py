"""Queries that ask tables of questions: every customer asks one about their own record, in words taken from it, and all are
answered together over the flattened records."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.vocab import ABNORMAL_WORDS
from ..operators import privacy
from ..operators.chunks import chunk_records
from .batched import RERANKED, Answers, Batch
from .clinic import _CHUNKS, _INTENT, _REC, CONDITIONS, TESTS, _pick, _sql_pick, records
from .queries import _BM25, _SYN, _content, _hash_sql, _r, _toks, query, table

_NAMES = [t[0] for t in TESTS]
#: Rankings are rounded to so many digits, so that SQL's order of summation doesn't show.
_DIGITS = 6


def questions(spark, sf_dir: str) -> DataFrame:
    """qid, text, patient_id: a question for each customer, about the condition, the test and the year of their last order by
    key; null for a customer without orders."""
    k, c = F.col("k"), F.col("c_custkey")
    last = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c")).agg(
        F.max(F.struct(F.col("o_orderkey").alias("k"), F.year("o_orderdate").cast("string").alias("year"))).alias("o"),
    ).select("c", "o.k", "o.year")
    test, condition = _pick(_NAMES, k), _pick(CONDITIONS, k)
    text = F.when(c % 4 == 0, F.concat(F.lit("What is the latest "), test, F.lit("?"))).when(
        c % 4 == 1, F.concat(F.lit("Any high "), test, F.lit(" since "), "year", F.lit("?")),
    ).when(c % 4 == 2, F.concat(F.lit("Which medication is given for "), condition, F.lit("?"))).otherwise(
        F.concat(F.lit("Was there a visit for "), condition, F.lit(" in "), "year", F.lit("?")),
    )
    rows = table(spark, sf_dir, "customer").join(last, c == F.col("c"), "left")
    return rows.select(
        c.alias("qid"), text.alias("text"), F.concat(F.lit("AUR-"), (c + 100000).cast("string")).alias("patient_id"),
    )


def _asked(spark, sf_dir: str) -> tuple[Batch, DataFrame]:
    made = Batch(chunk_records(records(spark, sf_dir)), digits=_DIGITS)
    return made, made.read(questions(spark, sf_dir))


_PAIRS = "list_transform(range(1, len({0})), lambda i: {0}[i] || '{1}' || {0}[i + 1])"
#: pool(c, id, score, rank): each customer's chunks by the fused ranks of their question, and what both are made of.
_ASKED = f"""{_REC}, {_CHUNKS},
lo AS (SELECT o_custkey AS c, max(o_orderkey) AS k, arg_max(year(o_orderdate), o_orderkey)::VARCHAR AS year FROM orders GROUP BY o_custkey),
ques AS (SELECT pat.c, pid, coalesce(CASE pat.c % 4 WHEN 0 THEN 'What is the latest ' || {_sql_pick(_NAMES, "k")} || '?' WHEN 1 THEN 'Any high ' || {_sql_pick(_NAMES, "k")} || ' since ' || year || '?'
  WHEN 2 THEN 'Which medication is given for ' || {_sql_pick(CONDITIONS, "k")} || '?' ELSE 'Was there a visit for ' || {_sql_pick(CONDITIONS, "k")} || ' in ' || year || '?' END, '') AS text FROM pat LEFT JOIN lo ON lo.c = pat.c),
tk AS (SELECT *, {_toks()} AS toks FROM chunk),
p AS (SELECT id, c, len, term, count(*) AS tf FROM (SELECT chunk_id AS id, c, len(toks)::BIGINT AS len, unnest(toks) AS term FROM tk) GROUP BY ALL),
st AS (SELECT count(*) AS n, avg(len(toks)) AS avg_len FROM tk), df AS (SELECT term, count(*) AS df FROM p GROUP BY term),
qt AS (SELECT *, list_concat(toks, flatten(list_transform(toks, lambda x: coalesce({_SYN}[x], [])))) AS ex FROM (SELECT *, {_toks()} AS toks FROM ques)),
q AS (SELECT DISTINCT c, unnest(ex) AS term FROM qt),
s AS (SELECT p.c, id, round(sum({_BM25}), 6) AS score FROM q JOIN p ON q.c = p.c AND q.term = p.term JOIN df ON df.term = p.term, st GROUP BY p.c, id),
r AS (SELECT *, row_number() OVER (PARTITION BY c ORDER BY score DESC, id) - 1 AS rank FROM s),
f0 AS (SELECT chunk_id AS id, c, unnest(list_concat(toks, {_PAIRS.format("toks", "_")})) AS feature FROM tk),
tf AS (SELECT id, c, feature, count(*) AS tf FROM f0 GROUP BY ALL), nn AS (SELECT count(*) AS n FROM chunk),
idf AS (SELECT feature, ln((n + 1.0::DOUBLE) / (count(*) + 1)) + 1 AS idf FROM tf, nn GROUP BY feature, n),
w AS ({_hash_sql("tf JOIN idf USING (feature)", "id, c")}),
v AS (SELECT id, c, bucket, w / sqrt(sum(w * w) OVER (PARTITION BY id)) AS weight FROM w),
qf AS (SELECT c, unnest(list_concat(ex, {_PAIRS.format("ex", "_")})) AS feature FROM qt),
qtf AS (SELECT c, feature, count(*) AS tf FROM qf GROUP BY ALL),
qi AS (SELECT c, feature, tf, coalesce(idf, ln(n + 1.0::DOUBLE) + 1) AS idf FROM qtf LEFT JOIN idf USING (feature), nn),
qw AS ({_hash_sql("qi", "c")}),
qv AS (SELECT c, bucket, w / sqrt(sum(w * w) OVER (PARTITION BY c)) AS weight FROM qw),
cs AS (SELECT v.c, id, round(sum(v.weight * qv.weight), 6) AS score FROM v JOIN qv ON v.c = qv.c AND v.bucket = qv.bucket GROUP BY v.c, id),
cr AS (SELECT *, row_number() OVER (PARTITION BY c ORDER BY score DESC, id) - 1 AS rank FROM cs),
ranks AS (SELECT c, id, rank FROM r UNION ALL SELECT c, id, rank FROM cr WHERE rank < 200 AND score > 0),
z AS (SELECT c, id, round(sum(1.0::DOUBLE / (60 + rank)) * 60, 6) AS score FROM ranks GROUP BY c, id),
pool AS (SELECT c, id, round(score, 4) AS score, row_number() OVER (PARTITION BY c ORDER BY score DESC, id) - 1 AS rank FROM z)"""
_RECENT = "coalesce(place::DOUBLE / max(place) OVER (PARTITION BY c), 0)"
_PLACE = "CASE WHEN date IS NOT NULL THEN dense_rank() OVER (PARTITION BY c ORDER BY date NULLS LAST) END AS place"
_SHARE = f"len(list_filter(list_distinct(ct), lambda x: list_contains(toks, x) OR list_has_any(coalesce({_SYN}[x], []), toks)))::DOUBLE / len(list_distinct(ct))"


@query(f"""WITH {_ASKED},
a AS (SELECT pool.*, qt.pid, kind, flag, tk.toks, {_PLACE.replace("PARTITION BY c", "PARTITION BY pool.c")}, {_content("qt.text")} AS ct, lower(qt.text) AS t FROM pool JOIN tk ON chunk_id = id JOIN qt ON qt.c = pool.c WHERE rank < 25),
b AS (SELECT *, {_INTENT} AS intent, list_distinct({_PAIRS.format("ct", " ")}) AS qb, list_distinct({_PAIRS.format("toks", " ")}) AS tb FROM a),
f AS (SELECT c, pid AS patient_id, id AS chunk_id, rank AS before, score / coalesce(nullif(max(score) OVER (PARTITION BY c), 0), 1) AS base, CASE WHEN len(ct) = 0 THEN 0 ELSE {_SHARE} END AS coverage,
  CASE WHEN len(qb) = 0 THEN 0 ELSE len(list_intersect(qb, tb))::DOUBLE / len(qb) END AS phrase, (kind = CASE intent WHEN 'allergy' THEN 'profile' WHEN 'general' THEN '' ELSE intent END)::INT::DOUBLE AS kind,
  (regexp_matches(t, '{ABNORMAL_WORDS}') AND coalesce(flag IN ('HIGH', 'LOW'), FALSE))::INT::DOUBLE AS abnormal, {_RECENT} AS recency FROM b),
g AS (SELECT *, round(round(0.35::DOUBLE * base + 0.35::DOUBLE * coverage + 0.1::DOUBLE * phrase + 0.12::DOUBLE * kind + 0.04::DOUBLE * abnormal + 0.04::DOUBLE * recency, 4) * 100, 2) AS score FROM f),
h AS (SELECT *, row_number() OVER (PARTITION BY c ORDER BY score DESC, before) - 1 AS rank FROM g)
SELECT patient_id, rank, chunk_id, round(base, 6) AS base, round(coverage, 6) AS coverage, round(phrase, 6) AS phrase, kind, abnormal, round(recency, 6) AS recency, score FROM h WHERE rank < 5""")
def batch_rerank(spark, sf_dir):
    """The five best chunks of each question out of a pool of 25, with all six features of the reranker."""
    made, asked = _asked(spark, sf_dir)
    rows = made.rerank(asked, made.search(asked, 25, **RERANKED), 5)
    return rows.join(asked.select("qid", "patient_id"), "qid").select(
        "patient_id", "rank", F.col("id").alias("chunk_id"), _r(F.col("base")).alias("base"),
        _r(F.col("coverage")).alias("coverage"), _r(F.col("phrase")).alias("phrase"), "kind", "abnormal",
        _r(F.col("recency")).alias("recency"), "score",
    )


def _told(asked: DataFrame, out: Answers) -> DataFrame:
    rows = out.hits.join(asked.select("qid", "patient_id"), "qid")
    return rows.select("patient_id", F.col("rank").cast("long").alias("rank"), F.col("id").alias("chunk_id"))


@query(f"""WITH {_ASKED},
seed AS (SELECT pool.rank, tk.* FROM pool JOIN tk ON chunk_id = id WHERE rank < 4),
m AS (SELECT s.c, s.rank, s.kind AS sk, x.chunk_id, row_number() OVER (PARTITION BY s.chunk_id ORDER BY CASE WHEN s.kind = 'lab' THEN x.date END DESC NULLS LAST, x.ord) AS place FROM seed s JOIN tk x ON x.c = s.c AND (
  (s.kind = 'lab' AND x.kind = 'lab' AND x.what = s.what AND x.ord <> s.ord) OR (s.kind = 'note' AND x.kind = 'encounter' AND x.date = s.date) OR (s.kind = 'encounter' AND x.kind = 'note' AND x.date = s.date)
  OR (s.kind = 'diagnosis' AND x.kind = 'medication' AND x.what = 'now') OR (s.kind = 'medication' AND x.kind = 'diagnosis'))),
n AS (SELECT c, chunk_id, min(rank * 10 + place) AS pos FROM m WHERE place <= CASE sk WHEN 'diagnosis' THEN 1 ELSE 2 END AND chunk_id NOT IN (SELECT chunk_id FROM seed) GROUP BY c, chunk_id),
o AS (SELECT c, chunk_id, row_number() OVER (PARTITION BY c ORDER BY pos) AS i FROM n),
a AS (SELECT c, rank, chunk_id FROM seed UNION ALL SELECT o.c, i - 1 + (SELECT count(*) FROM seed WHERE seed.c = o.c), chunk_id FROM o WHERE i <= 10)
SELECT pid AS patient_id, rank, chunk_id FROM a JOIN pat USING (c)""")
def batch_window(spark, sf_dir):
    """Four seeds of each question, then up to ten chunks that stand beside them."""
    made, asked = _asked(spark, sf_dir)
    return _told(asked, made.window(asked, 8))


@query(f"""WITH {_ASKED}, ends AS (SELECT max(date) AS last_day FROM chunk),
a AS (SELECT pool.*, kind, what, date, {_PLACE.replace("PARTITION BY c", "PARTITION BY pool.c")}, regexp_extract(ques.text, '(?:in|since) (20[0-9][0-9])', 1) AS y, contains(ques.text, ' since ') AS since, contains(ques.text, 'latest') AS latest,
  CASE kind WHEN 'lab' THEN what WHEN 'diagnosis' THEN what WHEN 'note' THEN 'note' WHEN 'medication' THEN (what = 'now')::VARCHAR ELSE '' END AS fact FROM pool JOIN tk ON chunk_id = id JOIN ques ON ques.c = pool.c WHERE rank < 40),
b AS (SELECT *, {_RECENT} AS recency, y <> '' AS spanned, y || '-01-01' AS lo, CASE WHEN since THEN last_day ELSE y || '-12-31' END AS hi, min(rank) OVER (PARTITION BY c, kind, fact) AS first, row_number() OVER (PARTITION BY c, kind, fact ORDER BY date DESC NULLS LAST, rank) AS age FROM a, ends),
d AS (SELECT c, id, row_number() OVER (PARTITION BY c ORDER BY CASE WHEN NOT spanned AND NOT latest THEN score * (1 + 0.5::DOUBLE * recency) ELSE 0 END DESC, CASE WHEN NOT spanned AND latest THEN first ELSE rank END) - 1 AS rank
  FROM b WHERE CASE WHEN spanned THEN coalesce(date BETWEEN lo AND hi, FALSE) WHEN latest THEN age = 1 ELSE TRUE END)
SELECT pid AS patient_id, rank, id AS chunk_id FROM d JOIN pat USING (c) WHERE rank < 5""")
def batch_temporal(spark, sf_dir):
    """A pool of 40 chunks of each question, cut to the time it asks for."""
    made, asked = _asked(spark, sf_dir)
    return _told(asked, made.temporal(asked, 5))


@query()
def batch_hyde(spark, sf_dir):
    """Passages that would answer each question, searched and fused with its own hits."""
    made, asked = _asked(spark, sf_dir)
    return _told(asked, made.hyde(asked, 5))


@query()
def batch_corrective(spark, sf_dir):
    """Each question's grade, and the stage that reached it: questions whose evidence stays low abstain."""
    made, asked = _asked(spark, sf_dir)
    out = made.corrective(asked, 5)
    found = out.hits.groupBy("qid").agg(F.count(F.lit(1)).alias("n_hits"))
    rows = out.outcomes.join(found, "qid", "left").join(asked.select("qid", "patient_id"), "qid")
    return rows.select(
        "patient_id", "stage", "coverage", "label", "abstained", F.array_join("uncovered", ",").alias("uncovered"),
        F.coalesce("n_hits", F.lit(0)).cast("long").alias("n_hits"),
    )


# ---------------------------------------------------------------- names of all records

_WITH = "'Customer#' || lpad(({0})::VARCHAR, 9, '0')"
_HID = "CASE WHEN {0} IN (SELECT c_name FROM customer) THEN '[PATIENT]' ELSE {0} END"


@query(f"""WITH o AS (SELECT o_orderkey AS k, c_name AS own, {_WITH.format("o_orderkey * 37 % (2 * (SELECT count(*) FROM customer))")} AS other FROM orders JOIN customer ON c_custkey = o_custkey),
m AS (SELECT k, {_HID.format("own")} AS a, {_HID.format("other")} AS b, other FROM o)
SELECT k AS o_orderkey, md5('Seen: ' || a || ', with ' || b || '. ' || b || ' (x' || other || ') agrees; ' || a || '#' || a || '?') AS masked_md5 FROM m""")
def mask_all_names(spark, sf_dir):
    """A note for each order that names its customer and another one, who may not exist: all customers' names masked in all
    notes, and nothing else."""
    customers = table(spark, sf_dir, "customer")
    n = customers.count()
    rows = table(spark, sf_dir, "orders").join(customers, F.col("c_custkey") == F.col("o_custkey")).select(
        "o_orderkey", F.col("c_name").alias("own"),
        F.concat(F.lit("Customer#"), F.lpad((F.col("o_orderkey") * 37 % (2 * n)).cast("string"), 9, "0")).alias("other"),
    )
    said = [
        F.lit("Seen: "), "own", F.lit(", with "), "other", F.lit(". "), "other", F.lit(" (x"), "other", F.lit(") agrees; "),
        "own", F.lit("#"), "own", F.lit("?"),
    ]
    notes = rows.select("o_orderkey", F.concat(*said).alias("text"))
    out = privacy.mask_names(notes, "o_orderkey", "text", customers.select(F.col("c_name").alias("name")))
    return out.select("o_orderkey", F.md5(F.col("text")).alias("masked_md5"))
