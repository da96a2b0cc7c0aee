"""Queries over the star-schema, event, document and conversation tables, one for each operator, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.vocab import EXTRA_STOP, STOP, SYNONYMS
from ..operators import blocks as K
from ..operators import index as X
from ..operators import series as S

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its function's name, with the SQL that has to give the same rows."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _sql_list(words: list[str]) -> str:
    return "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + "]"


_STOPS = _sql_list(STOP)
_EXTRA = _sql_list(EXTRA_STOP)
_SYN = "MAP {" + ", ".join(f"'{k}': {_sql_list(v)}" for k, v in SYNONYMS.items()) + "}"


def _toks(text: str = "text") -> str:
    return f"list_filter(list_transform(regexp_extract_all(lower(coalesce({text}, '')), '[a-z0-9.]+'), lambda x: trim(x, '.')), lambda x: x <> '' AND NOT list_contains({_STOPS}, x))"


def _content(text: str = "text") -> str:
    return f"list_filter({_toks(text)}, lambda x: NOT list_contains({_EXTRA}, x))"


def _extra_free(text: str) -> str:
    """SQL for the content tokens of a text."""
    return _content(text)


def _r(c: Column, digits: int = 6) -> Column:
    return F.round(c, digits)


# ---------------------------------------------------------------- tokens, terms and lexical search

_POSTS = f"""t AS (SELECT doc_id AS id, {_toks()} AS toks FROM documents),
p AS (SELECT id, len(toks)::BIGINT AS len, term, count(*) AS tf FROM (SELECT id, toks, unnest(toks) AS term FROM t) GROUP BY id, toks, term),
st AS (SELECT count(*) AS n, avg(len(toks)) AS avg_len FROM t),
df AS (SELECT term, count(*) AS df FROM p GROUP BY term)"""
_BM25 = "ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf * 2.4::DOUBLE / (tf + 1.4::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * len / avg_len))"


@query(
    f"SELECT doc_id, len({_toks()})::BIGINT AS n_tokens, len(list_distinct({_toks()}))::BIGINT AS n_terms FROM documents"
)
def tokenize_counts(spark, sf_dir):
    toks = T.tokens(F.col("text"))
    return table(spark, sf_dir, "documents").select(
        "doc_id", F.size(toks).cast("long").alias("n_tokens"),
        F.size(F.array_distinct(toks)).cast("long").alias("n_terms"),
    )


@query(
    f"WITH {_POSTS} SELECT term, df::BIGINT AS df, round(ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)), 6) AS idf FROM df, st ORDER BY df DESC, term LIMIT 200"
)
def doc_freq_topk(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    posts = X.postings(docs, "doc_id", "text")
    dfs = posts.groupBy("term").agg(F.count(F.lit(1)).alias("df")).crossJoin(F.broadcast(X.corpus_stats(docs, "text")))
    return dfs.select(
        "term", "df", _r(X.bm25_idf(F.col("n"), F.col("df"))).alias("idf"),
    ).orderBy(F.desc("df"), "term").limit(200)


def _bm25(spark, sf_dir, scoped: bool) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    terms = X.query_terms(table(spark, sf_dir, "benchmark"), "item_id", "text")
    scope = docs.filter("source = 'src1'").select(F.col("doc_id").alias("id")) if scoped else None
    return K.lexical_top(docs, "doc_id", "text", terms, 10, 6, scope)


_QT = f"q AS (SELECT DISTINCT item_id AS qid, unnest({_toks()}) AS term FROM benchmark)"


def _bm25_sql(scope: str) -> str:
    return f"""WITH {_POSTS}, {_QT},
s AS (SELECT qid, id, round(sum({_BM25}), 6) AS score FROM q JOIN p USING (term) JOIN df USING (term), st {scope} GROUP BY qid, id),
r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) - 1 AS rank FROM s)
SELECT qid, id AS doc_id, score, rank FROM r WHERE rank < 10"""


@query(_bm25_sql(""))
def bm25_topk(spark, sf_dir):
    return _bm25(spark, sf_dir, False).withColumnRenamed("id", "doc_id")


@query(_bm25_sql("WHERE id IN (SELECT doc_id FROM documents WHERE source = 'src1')"))
def bm25_topk_scoped(spark, sf_dir):
    return _bm25(spark, sf_dir, True).withColumnRenamed("id", "doc_id")


@query(f"""WITH t AS (SELECT conv_id, turn, {_toks()} AS toks FROM conversations)
SELECT conv_id, turn, len(toks)::BIGINT AS n_tokens, array_to_string(list_concat(toks, flatten(list_transform(toks, lambda x: coalesce({_SYN}[x], [])))), ' ') AS expanded FROM t""")
def synonym_expand(spark, sf_dir):
    toks = T.tokens(F.col("text"))
    return table(spark, sf_dir, "conversations").select(
        "conv_id", "turn", F.size(toks).cast("long").alias("n_tokens"),
        F.array_join(T.expanded(toks), " ").alias("expanded"),
    )


_FEATS = f"""t AS (SELECT doc_id AS id, {_toks()} AS toks FROM documents),
f0 AS (SELECT id, unnest(list_concat(toks, list_transform(range(1, len(toks)), lambda i: toks[i] || '_' || toks[i + 1]))) AS feature FROM t),
tf AS (SELECT id, feature, count(*) AS tf FROM f0 GROUP BY id, feature)"""


@query(f"WITH {_FEATS} SELECT feature, count(*)::BIGINT AS n_docs, sum(tf)::BIGINT AS n_times FROM tf GROUP BY feature")
def ngram_features(spark, sf_dir):
    """Every unigram and bigram."""
    tf = X.feature_counts(table(spark, sf_dir, "documents"), "doc_id", "text")
    return tf.groupBy("feature").agg(F.count(F.lit(1)).alias("n_docs"), F.sum("tf").alias("n_times"))


def _hash_sql(src: str, key: str) -> str:
    return f"SELECT {key}, (('0x' || substr(md5(feature), 1, 15))::BIGINT % 1024)::INT AS bucket, sum((CASE WHEN ('0x' || substr(md5(feature), 16, 1))::INT >= 8 THEN -1 ELSE 1 END) * (1 + ln(tf)) * idf) AS w FROM {src} GROUP BY ALL"


_VECS = f"""{_FEATS}, nn AS (SELECT count(*) AS n FROM documents),
idf AS (SELECT feature, ln((n + 1.0::DOUBLE) / (count(*) + 1)) + 1 AS idf FROM tf, nn GROUP BY feature, n),
w AS ({_hash_sql("tf JOIN idf USING (feature)", "id")}),
v AS (SELECT id, bucket, w / sqrt(sum(w * w) OVER (PARTITION BY id)) AS weight FROM w)"""


@query(
    f"WITH {_VECS} SELECT id AS doc_id, count(*)::BIGINT AS n_buckets, round(max(weight), 5) AS top, round(sum(weight * weight), 5) AS norm FROM v GROUP BY id"
)
def hash_tfidf_norms(spark, sf_dir):
    vecs, _ = K.feature_vectors(table(spark, sf_dir, "documents"), "doc_id", "text")
    return vecs.select(
        F.col("id").alias("doc_id"), F.size("buckets").cast("long").alias("n_buckets"),
        _r(F.array_max("weights"), 5).alias("top"), _r(T.dot(F.col("weights"), F.col("weights")), 5).alias("norm"),
    )


_QVECS = f"""qt AS (SELECT item_id AS qid, {_toks()} AS toks FROM benchmark),
qf AS (SELECT qid, unnest(list_concat(toks, list_transform(range(1, len(toks)), lambda i: toks[i] || '_' || toks[i + 1]))) AS feature FROM qt),
qtf AS (SELECT qid, feature, count(*) AS tf FROM qf GROUP BY qid, feature),
qi AS (SELECT qid, feature, tf, coalesce(idf, ln(n + 1.0::DOUBLE) + 1) AS idf FROM qtf LEFT JOIN idf USING (feature), nn),
qw AS ({_hash_sql("qi", "qid")}),
qv AS (SELECT qid, bucket, w / sqrt(sum(w * w) OVER (PARTITION BY qid)) AS weight FROM qw),
c AS (SELECT qid, id, round(sum(v.weight * qv.weight), 6) AS score FROM v JOIN qv USING (bucket) GROUP BY qid, id),
cr AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) - 1 AS rank FROM c)"""


def _cosine_ranks(spark, sf_dir, k: int) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    vecs, idf = K.feature_vectors(docs, "doc_id", "text")
    asked = X.encode(table(spark, sf_dir, "benchmark"), "item_id", "text", idf, docs.count(), expand=False)
    return K.cosine_top(vecs, asked, k, 6)


@query(f"WITH {_VECS}, {_QVECS} SELECT qid, id AS doc_id, score, rank FROM cr WHERE rank < 10")
def sparse_cosine_topk(spark, sf_dir):
    return _cosine_ranks(spark, sf_dir, 10).withColumnRenamed("id", "doc_id")


@query(f"""WITH {_POSTS}, {_VECS[_VECS.index("f0 AS"):]}, {_QVECS},
q AS (SELECT DISTINCT item_id AS qid, unnest({_toks()}) AS term FROM benchmark),
s AS (SELECT qid, id, round(sum({_BM25}), 6) AS score FROM q JOIN p USING (term) JOIN df USING (term), st GROUP BY qid, id),
r AS (SELECT qid, id, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) - 1 AS rank FROM s),
u AS (SELECT qid, id, rank FROM r UNION ALL SELECT qid, id, rank FROM cr WHERE rank < 200 AND score > 0),
z AS (SELECT qid, id, round(sum(1.0::DOUBLE / (60 + rank)) * 100, 6) AS score FROM u GROUP BY qid, id),
y AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) - 1 AS rank FROM z)
SELECT qid, id AS doc_id, score, rank FROM y WHERE rank < 10""")
def rrf_hybrid_topk(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    terms = X.query_terms(table(spark, sf_dir, "benchmark"), "item_id", "text")
    near = _cosine_ranks(spark, sf_dir, 200).filter("score > 0")
    return K.fused_top(docs, "doc_id", "text", terms, near, 10).withColumnRenamed("id", "doc_id")


@query(f"""WITH {_POSTS},
q0 AS (SELECT qid, toks, ct, list_concat(toks, flatten(list_transform(toks, lambda x: coalesce({_SYN}[x], [])))) AS ex FROM (SELECT item_id AS qid, {_toks()} AS toks, {_content()} AS ct FROM benchmark)),
q AS (SELECT DISTINCT qid, v, unnest(x) AS term FROM (SELECT qid, 0 AS v, toks AS x FROM q0 UNION ALL SELECT qid, 1, ex FROM q0 UNION ALL SELECT qid, 2, ct FROM q0)),
s AS (SELECT qid, v, id, round(sum({_BM25}), 6) AS score FROM q JOIN p USING (term) JOIN df USING (term), st GROUP BY qid, v, id),
r AS (SELECT *, row_number() OVER (PARTITION BY qid, v ORDER BY score DESC, id) - 1 AS rank FROM s),
z AS (SELECT qid, id, round(sum(1.0::DOUBLE / (60 + rank)) * 100, 6) AS score FROM r WHERE rank < 20 GROUP BY qid, id),
y AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) - 1 AS rank FROM z)
SELECT qid, id AS doc_id, score, rank FROM y WHERE rank < 10""")
def multi_query_rrf(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    toks = T.tokens(F.col("text"))
    parts = F.array(toks, T.expanded(toks), T.content_tokens(F.col("text")))
    variants = table(spark, sf_dir, "benchmark").select("item_id", F.posexplode(parts).alias("v", "x"))
    terms = variants.select(F.struct("item_id", "v").alias("qid"), F.explode(F.array_distinct("x")).alias("term"))
    hits = K.lexical_top(docs, "doc_id", "text", terms, 20, 6)
    return X.ranked(
        X.fuse(hits.withColumn("qid", F.col("qid.item_id"))), 10, digits=6,
    ).withColumnRenamed("id", "doc_id")


# ---------------------------------------------------------------- vectors


_DENSE = """WITH q AS (SELECT vec_id AS qid, embedding::DOUBLE[] AS q, label AS ql FROM embeddings WHERE vec_id % 50 = 0),
s AS (SELECT qid, vec_id AS id, round(list_dot_product(embedding::DOUBLE[], q), 5) AS score, rank FROM (SELECT *, 0 AS rank FROM embeddings, q {where}))
SELECT qid, id AS vec_id, score, rank FROM (SELECT qid, id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) - 1 AS rank FROM s) WHERE rank < 10"""


def _dense(spark, sf_dir, scoped: bool) -> DataFrame:
    emb = table(spark, sf_dir, "embeddings")
    asked = emb.filter("vec_id % 50 = 0").select(
        F.col("vec_id").alias("qid"), F.col("embedding").alias("qvector"), F.col("label").alias("ql"),
    )
    rows = emb.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), "label")
    return X.dense_top(rows, asked, 10, 5, scoped=scoped).withColumnRenamed("id", "vec_id")


@query(_DENSE.format(where=""))
def dense_topk(spark, sf_dir):
    return _dense(spark, sf_dir, False)


@query(_DENSE.format(where="WHERE label = ql"))
def dense_topk_scoped(spark, sf_dir):
    return _dense(spark, sf_dir, True)


# ---------------------------------------------------------------- reranking and grading

_POOL = f"""WITH {_POSTS}, {_QT},
s AS (SELECT qid, id, round(sum({_BM25}), 6) AS score FROM q JOIN p USING (term) JOIN df USING (term), st GROUP BY qid, id),
r AS (SELECT qid, id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) - 1 AS rank FROM s) WHERE rank < 25),
x AS (SELECT qid AS item_id, id AS doc_id, score, rank, source, list_distinct({_content("b.text")}) AS q, {_content("b.text")} AS ql, {_toks("d.text")} AS t
  FROM r JOIN benchmark b ON b.item_id = r.qid JOIN documents d ON d.doc_id = r.id)"""
_COV = f"(len(list_filter(q, lambda w: list_contains(t, w) OR list_has_any(coalesce({_SYN}[w], []), t)))::DOUBLE / len(q))"


def _pool(spark, sf_dir, k: int) -> DataFrame:
    """The k best texts of each benchmark passage: both texts, q and terms (the passage's content tokens, all and
    distinct) and t (the text's tokens). Tokens are made below joins, so that they are made once a row."""
    docs, bench = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    hits = K.lexical_top(docs, "doc_id", "text", X.query_terms(bench, "item_id", "text"), k, 6)
    hits = X.bounded(hits, k * bench.count()).join(
        docs.select(F.col("doc_id").alias("id"), "source", F.col("text").alias("passage")), "id",
    ).withColumn("t", T.tokens(F.col("passage")))
    q = T.content_tokens(F.col("text"))
    asked = bench.select(
        F.col("item_id").alias("qid"), F.col("text").alias("question"), q.alias("q"),
        F.array_distinct(q).alias("terms"),
    )
    return hits.join(X.bounded(asked, bench.count()), "qid").withColumnsRenamed({"qid": "item_id", "id": "doc_id"})


@query(f"""{_POOL}, e AS (SELECT item_id, any_value(q) AS q, list_distinct(flatten(list(t))) AS t FROM x WHERE rank < 3 GROUP BY item_id)
SELECT item_id, round(CASE WHEN len(q) = 0 THEN 1 ELSE {_COV} END, 6) AS coverage,
CASE WHEN len(q) = 0 OR {_COV} >= 0.6 THEN 'high' WHEN {_COV} >= 0.34 THEN 'medium' ELSE 'low' END AS label FROM e""")
def coverage_grade(spark, sf_dir):
    seen = _pool(spark, sf_dir, 3).groupBy("item_id", "terms").agg(
        F.array_distinct(F.flatten(F.collect_list("t"))).alias("t")
    )
    rows = seen.select("item_id", T.coverage(F.col("terms"), F.col("t"), 1.0).alias("c"))
    label = F.when(F.col("c") >= 0.6, "high").when(F.col("c") >= 0.34, "medium").otherwise("low")
    return rows.select("item_id", _r(F.col("c")).alias("coverage"), label.alias("label"))


@query(f"""{_POOL},
y AS (SELECT item_id, doc_id, source, score, CASE WHEN len(q) = 0 THEN 0 ELSE {_COV} END AS cov,
  list_distinct(list_transform(range(1, len(ql)), lambda i: ql[i] || ' ' || ql[i + 1])) AS qb, list_distinct(list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i + 1])) AS tb FROM x),
z AS (SELECT item_id, doc_id, cov, score, CASE WHEN len(qb) = 0 THEN 0 ELSE len(list_intersect(qb, tb))::DOUBLE / len(qb) END AS phrase,
  dense_rank() OVER (PARTITION BY item_id ORDER BY source) AS place FROM y),
w AS (SELECT *, place::DOUBLE / max(place) OVER (PARTITION BY item_id) AS recency, score / coalesce(nullif(max(score) OVER (PARTITION BY item_id), 0), 1) AS base FROM z)
SELECT item_id, doc_id, round(cov, 6) AS coverage, round(phrase, 6) AS phrase, round(recency, 6) AS recency,
  round(0.35::DOUBLE * base + 0.35::DOUBLE * cov + 0.10::DOUBLE * phrase + 0.04::DOUBLE * recency, 6) AS score FROM w""")
def rerank_features(spark, sf_dir):
    qb, tb = F.array_distinct(T.bigrams(F.col("q"), " ")), F.array_distinct(T.bigrams(F.col("t"), " "))
    phrase = F.when(F.size(qb) == 0, 0.0).otherwise(F.size(F.array_intersect(qb, tb)) / F.size(qb))
    rows = _pool(spark, sf_dir, 25).select(
        "item_id", "doc_id", "source", "score", T.coverage(F.col("terms"), F.col("t"), 0.0).alias("cov"),
        phrase.alias("phrase"),
    )
    rows = S.with_recency(rows, "source", ["item_id"])
    base = F.col("score") / F.coalesce(
        F.nullif(F.max("score").over(Window.partitionBy("item_id")), F.lit(0.0)), F.lit(1.0),
    )
    score = 0.35 * base + 0.35 * F.col("cov") + 0.10 * F.col("phrase") + 0.04 * F.col("recency")
    return rows.select(
        "item_id", "doc_id", _r(F.col("cov")).alias("coverage"), _r(F.col("phrase")).alias("phrase"),
        _r(F.col("recency")).alias("recency"), _r(score).alias("score"),
    )
