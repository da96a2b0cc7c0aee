"""Strategies over whole tables of questions: the control flow of one question becomes columns, and each of its steps one
DataFrame step over the questions that are still open. Nothing of a question, a hit or a grade passes through the driver.

Questions are rows (qid, text, patient_id); a question that names a patient meets that record's postings only, by a join on
term and record. A null or empty text asks for nothing: it finds nothing and is graded low.
"""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date
from functools import cached_property

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import batch
from ..functions import questions as Q
from ..functions import text as T
from ..functions.vocab import ABNORMAL_WORDS, KIND_FOR_INTENT
from ..operators import blocks, context
from ..operators import index as X
from ..operators import record_search as R
from ..operators import series as S
from ..scratch import materialise
from .search import NEAREST, SCALE
from .strategies import HIGH, MEDIUM, WEIGHTS


#: Hits by which a question is graded.
GRADED = 3
#: What strategies need to know of the chunks they find: to rerank them, to look beside them, to sort them by time.
RERANKED = {"kind": "kind", "date": "date", "flag": "meta.flag", "t": "toks"}
SEEDS = {"patient_id": "patient_id", "kind": "kind", "date": "date", "meta": "struct(meta.test)"}
DATED = {
    "patient_id": "patient_id", "kind": "kind", "date": "date",
    "fact": "coalesce(nullif(meta.test, ''), nullif(meta.condition, ''), nullif(meta.note_type, ''), string(meta.current), '')",
}


@dataclass(frozen=True)
class Answers:
    """outcomes: a row for each question. hits(qid, id, score, rank): what each is answered with."""

    outcomes: DataFrame
    hits: DataFrame


def _span(question: str, asof: date) -> Q.Window:
    """The time that a question asks for; none where it names a month that doesn't exist."""
    try:
        return Q.parse_time(question, asof)
    except ValueError:
        return Q.Window()


def read(questions: DataFrame, asof: date) -> DataFrame:
    """questions with what their texts ask for, written once: words (content words in order), terms (distinct), wanted (a
    kind of chunk), odd (abnormal values are meant), since and until (ISO dates) or latest, and rewrites: variants, every (the
    variants of all its parts) and passages."""
    day = lambda d: d.isoformat() if d else None
    bounds = lambda q: (w.start or date.min, w.end or date.max) if (w := _span(q, asof)).start or w.end else (None, None)
    texts = "array<string>"
    rows = batch.read(
        questions.select("qid", F.coalesce("text", F.lit("")).alias("text"), "patient_id"), "text",
        {
            "words": (texts, Q.content),
            "terms": (texts, lambda q: list(dict.fromkeys(Q.content(q)))),
            "wanted": ("string", lambda q: KIND_FOR_INTENT.get(Q.intent(q))),
            "odd": ("boolean", lambda q: Q.has(ABNORMAL_WORDS, q)),
            "since": ("string", lambda q: day(bounds(q)[0])),
            "until": ("string", lambda q: day(bounds(q)[1])),
            "latest": ("boolean", lambda q: _span(q, asof).latest),
            "variants": (texts, Q.variants),
            "every": (texts, lambda q: list(dict.fromkeys(v for p in Q.decompose(q) for v in Q.variants(p)))),
            "passages": (texts, Q.hypothetical),
        },
    )
    return materialise(rows, "questions")


def _rewrites(questions: DataFrame, col: str) -> DataFrame:
    """A search for each text in a column of arrays; its qid is (qid, v)."""
    rows = questions.select("qid", F.posexplode(col).alias("v", "text"), "patient_id")
    return rows.select(F.struct("qid", "v").alias("qid"), "text", "patient_id")


def _whole(hits: DataFrame) -> DataFrame:
    """Hits of rewrites as hits of their questions."""
    return hits.withColumn("qid", F.col("qid.qid"))


class Batch:
    """Chunks and their index as written tables, and the strategies over them."""

    def __init__(self, chunks: DataFrame, dim: int = 1024, digits: int = 9):
        self.dim, self.digits = dim, digits
        self.chunks = materialise(chunks.withColumn("toks", T.tokens(F.col("text"))), "chunks")
        n, asof, avg_len = self.chunks.agg(F.count(F.lit(1)), F.max("date"), F.avg(F.size("toks"))).first()
        self.n, self.asof, self.avg_len = n, date.fromisoformat(asof or "1970-01-01"), avg_len or 1.0

    # What an index holds is made when a search first needs it: questions about one record each need no postings and vectors.

    @cached_property
    def _keyed(self) -> DataFrame:
        return self.chunks.select(F.struct("patient_id", "chunk_id").alias("id"), "text")

    @cached_property
    def posts(self) -> DataFrame:
        return materialise(self._owned(X.postings(self._keyed, "id", "text")), "postings")

    @cached_property
    def stats(self) -> DataFrame:
        return materialise(X.corpus_stats(self.chunks, "text"), "stats")

    @cached_property
    def vectors(self) -> DataFrame:
        return materialise(self._owned(blocks.feature_weights(self._keyed, "id", "text", self.dim)[0]), "vectors")

    @cached_property
    def features(self) -> DataFrame:
        return materialise(R.features(self.chunks, self.n, self.dim), "features")

    @property
    def idf(self) -> DataFrame:
        return self.features.select("feature", "idf")

    @cached_property
    def _rare(self) -> tuple[DataFrame, object]:
        """The rare features of records, and the others as a broadcast table."""
        often, others = R.frequent(self.features)
        rows = often.select("feature", "idf", "bucket", "sign").toPandas()  # X.FEW rows at most
        table = {f: i for i, f in enumerate(rows["feature"])}
        of = [rows[c].to_numpy() for c in ("idf", "bucket", "sign")]
        known = self.chunks.sparkSession.sparkContext.broadcast((table, *of))
        return materialise(R.rare_features(self.chunks, known, others), "rare"), known

    @staticmethod
    def _owned(rows: DataFrame) -> DataFrame:
        return rows.withColumn("owner", F.col("id.patient_id")).withColumn("id", F.col("id.chunk_id"))

    def read(self, questions: DataFrame) -> DataFrame:
        return read(questions, self.asof)

    # ------------------------------------------------------------ searches

    def _apart(self, asked: DataFrame, score) -> DataFrame:
        """score of the questions about one record each and of those about all records, where there are any. A question's key
        carries the record through the tables of its terms."""
        kinds = {r[0] for r in asked.select(F.col("patient_id").isNull()).distinct().collect()}  # two rows at most
        out = None
        for everywhere in sorted(kinds):
            mine = asked.filter(F.col("patient_id").isNull() if everywhere else F.col("patient_id").isNotNull())
            key = F.struct("qid", F.col("patient_id").alias("owner"))
            keep = ["qid"] if everywhere else ["qid", "owner"]

            def lay(rows: DataFrame, *cols: str, keep=keep) -> DataFrame:
                return rows.select(*[F.col(f"qid.{c}").alias(c) for c in keep], *cols)

            rows = score(mine.select(key.alias("key"), "text"), lay)
            out = rows if out is None else out.unionByName(rows)
        if out is None:
            return asked.select("qid", F.lit("").alias("id"), F.lit(0.0).alias("score")).limit(0)
        return out

    def _lexical(self, asked: DataFrame) -> DataFrame:
        def score(keyed, lay):
            terms = materialise(lay(X.query_terms(keyed, "key", "text", True), "term"), "terms")
            return X.bm25(self.posts, self.stats, terms)

        return self._apart(asked, score)

    def _split(self, asked: DataFrame, about, everywhere) -> DataFrame:
        """about of the questions about one record each and everywhere of the others, where there are any."""
        kinds = {r[0] for r in asked.select(F.col("patient_id").isNull()).distinct().collect()}  # two rows at most
        null = F.col("patient_id").isNull()
        if len(kinds) == 2:
            return about(asked.filter(~null)).unionByName(everywhere(asked.filter(null)))
        return everywhere(asked) if True in kinds else about(asked)

    def _scored(self, asked: DataFrame, expand: bool, pick=None, carry: dict[str, str] | None = None) -> DataFrame:
        rares, known = self._rare
        return R.scored(
            self.chunks, asked, self.features, rares, known, self.n, self.avg_len, self.dim, expand, pick or R.all_pairs(),
            carry,
        )

    def _near(self, asked: DataFrame, k: int, expand: bool, **carry: str) -> DataFrame:
        """The nearest chunks of positive cosine, by rank."""
        def score(keyed, lay):
            vectors = X.encode(keyed, "key", "text", self.idf, self.n, self.dim, expand)
            return X.sparse_cosine(self.vectors, lay(vectors, "bucket", "weight"))

        def about(mine):
            rows = self._scored(mine, expand, R.by_vectors(k, self.digits), carry)
            return rows.withColumn("score", F.round("score", self.digits))

        def everywhere(rest):
            top = X.ranked(self._apart(rest, score), k, self.digits).filter("score > 0")
            return self._met(top, **carry).select("qid", "id", "score", "rank", *carry)

        return self._split(asked, about, everywhere)

    def search(self, asked: DataFrame, k: int, **carry: str) -> DataFrame:
        """qid, id, score, rank: the k best chunks of each question, words and vectors fused. All ranks of a question about
        one record are taken in the task that scores it. carry: more columns, of expressions of the chunks that are found."""
        def about(mine):
            rows = self._scored(mine, True, R.by_both(k, self.digits, NEAREST, SCALE), carry)
            return rows.withColumn("score", F.round("score", self.digits))

        def everywhere(rest):
            top = X.fused_top(self._lexical(rest), self._near(rest, NEAREST, True), k, self.digits, scale=SCALE)
            return self._met(top, **carry).select("qid", "id", "score", "rank", *carry)

        return self._split(asked, about, everywhere).withColumn("score", F.round("score", 4))

    def nearest(self, asked: DataFrame, k: int, **carry: str) -> DataFrame:
        """qid, id, score, rank: the k nearest chunks to each text as it is."""
        return self._near(asked, min(k, NEAREST), False, **carry)

    def fused(self, k: int, *rankings: DataFrame) -> DataFrame:
        """The k best of rankings by their reciprocal ranks; columns that the rankings carry stay."""
        carried = [c for c in rankings[0].columns if c not in ("qid", "id", "score", "rank")]
        rows = X.ranked(X.fuse(*rankings, scale=SCALE, carry=carried), k, self.digits)
        return rows.withColumn("score", F.round("score", 4))

    def _met(self, hits: DataFrame, **cols: str) -> DataFrame:
        """hits with columns of expressions of their chunks: those that a search carried, or else by a join."""
        if not cols.keys() - set(hits.columns):
            return hits
        mine = self.chunks.select(F.col("chunk_id").alias("id"), *[F.expr(e).alias(c) for c, e in cols.items()])
        return hits.drop(*cols).join(mine, "id")

    # ------------------------------------------------------------ reranking and grading

    def rerank(self, questions: DataFrame, pool: DataFrame, k: int | None = None) -> DataFrame:
        """pool by the six weighted features, which stay as columns; ties keep the order of the pool."""
        rows = self._met(pool, **RERANKED)
        asked = questions.select("qid", "words", "terms", "wanted", "odd")
        rows = T.once(rows.join(asked, "qid"), pairs=F.array_distinct(T.bigrams(F.col("words"), " ")))
        rows = S.with_recency(rows, "date", ["qid"])
        top = F.max("score").over(Window.partitionBy("qid"))
        met = F.size(F.array_intersect("pairs", F.array_distinct(T.bigrams(F.col("t"), " "))))
        true = lambda c: F.coalesce(c, F.lit(False)).cast("double")
        rows = rows.select(
            "qid", "id", F.col("rank").alias("_before"),
            (F.col("score") / F.coalesce(F.nullif(top, F.lit(0.0)), F.lit(1.0))).alias("base"),
            T.coverage(F.col("terms"), F.col("t"), 0.0).alias("coverage"),
            F.when(F.size("pairs") == 0, 0.0).otherwise(met / F.size("pairs")).alias("phrase"),
            true(F.col("wanted") == F.col("kind")).alias("kind"),
            true(F.col("odd") & F.col("flag").isin("HIGH", "LOW")).alias("abnormal"), "recency", "t",
        )
        total = F.lit(0.0)
        for name, weight in WEIGHTS.items():
            total = total + weight * F.col(name)
        rows = rows.withColumn("score", F.round(F.round(total, 4) * 100, 2))
        line = Window.partitionBy("qid").orderBy(F.col("score").desc(), "_before")
        rows = rows.withColumn("rank", F.row_number().over(line))
        rows = rows if k is None else rows.filter(F.col("rank") <= k)
        return rows.withColumn("rank", F.col("rank").cast("long") - 1).drop("_before")

    def grade(self, questions: DataFrame, hits: DataFrame, top: int = GRADED) -> DataFrame:
        """qid, coverage, label, uncovered for every question, by its first hits."""
        seen = self._met(hits.filter(F.col("rank") < top), t="toks")
        have = seen.groupBy("qid").agg(F.array_distinct(F.flatten(F.collect_list("t"))).alias("t"))  # of top texts
        rows = questions.select("qid", "terms").join(have, "qid", "left")
        found = F.when(F.col("t").isNull(), F.array().cast("array<string>")).otherwise(
            T.covered(F.col("terms"), F.col("t"))
        )
        rows = T.once(rows, uncovered=F.sort_array(F.array_except("terms", found)))
        share = F.when(F.col("t").isNull(), 0.0).when(F.size("terms") == 0, 1.0).otherwise(
            1 - F.size("uncovered") / F.size("terms")
        )
        rows = rows.withColumn("share", share)
        label = F.when(F.col("share") >= HIGH, "high").when(F.col("share") >= MEDIUM, "medium").otherwise("low")
        return rows.select("qid", F.round("share", 3).alias("coverage"), label.alias("label"), "uncovered")

    def _graded(self, questions: DataFrame, hits: DataFrame) -> Answers:
        seen = [F.when(F.col("rank") < GRADED, F.col("t")).alias("t")] if "t" in hits.columns else []
        hits = materialise(hits.select("qid", "id", "score", "rank", *seen), "hits")
        return Answers(self.grade(questions, hits), hits.drop("t"))

    # ------------------------------------------------------------ variety

    def varied(self, pool: DataFrame, k: int, weight: float = 0.7) -> DataFrame:
        """k of each question's pool by maximal marginal relevance: each round picks, for all questions at once, the chunk whose
        score, less its likeness to what is picked, is best; ties keep the order of the pool. The likeness of a pool's chunks
        is a join of their vectors within the question, so that it grows with the square of a pool and not of the chunks."""
        pool = materialise(pool.select("qid", "id", "score", "rank"), "pool")
        mine = materialise(pool.select("qid", "id").join(self.vectors, "id").select("qid", "id", "bucket", "weight"), "pooled")
        other = mine.select("qid", F.col("id").alias("picked"), "bucket", F.col("weight").alias("_w"))
        like = mine.join(other, ["qid", "bucket"]).groupBy("qid", "id", "picked").agg(
            F.sum(F.col("weight") * F.col("_w")).alias("like"),
        )
        like = materialise(like, "likeness")
        top = F.max("score").over(Window.partitionBy("qid"))
        left = pool.withColumn("_rel", F.col("score") / F.coalesce(F.nullif(top, F.lit(0.0)), F.lit(1.0))).withColumn(
            "_near", F.lit(None).cast("double"),
        )
        out = None
        gain = F.when(F.col("_near").isNull(), F.col("_rel")).otherwise(
            weight * F.col("_rel") - (1 - weight) * F.col("_near")
        )
        for place in range(k):
            line = Window.partitionBy("qid").orderBy(F.round(gain, 12).desc(), "rank")
            left = materialise(left.withColumn("_n", F.row_number().over(line)), "left")
            best = left.filter("_n = 1").select("qid", "id", "score", F.lit(place).cast("long").alias("rank"))
            out = best if out is None else out.unionByName(best)
            if place < k - 1:
                near = best.select("qid", F.col("id").alias("picked")).join(like, ["qid", "picked"]).drop("picked")
                left = left.filter("_n > 1").drop("_n").join(near, ["qid", "id"], "left").withColumn(
                    "_near", F.greatest("_near", F.coalesce("like", F.lit(0.0))),
                ).drop("like")
        return out

    # ------------------------------------------------------------ strategies

    def bm25(self, questions: DataFrame, k: int) -> Answers:
        return self._graded(questions, self.fused(k, X.ranked(self._lexical(questions), k, self.digits)))

    def naive(self, questions: DataFrame, k: int) -> Answers:
        return self._graded(questions, self.fused(k, self._near(questions, min(k, NEAREST), True)))

    def mmr(self, questions: DataFrame, k: int) -> Answers:
        """A pool, from which varied chunks are picked."""
        return self._graded(questions, self.varied(self.search(questions, max(4 * k, 20)), k))

    def hybrid(self, questions: DataFrame, k: int) -> Answers:
        return self._graded(questions, self.search(questions, k))

    def reranked(self, questions: DataFrame, k: int) -> Answers:
        """A wide pool, scored again against the question."""
        return self._graded(questions, self.rerank(questions, self.search(questions, max(5 * k, 25), **RERANKED), k))

    def multiquery(self, questions: DataFrame, k: int) -> Answers:
        """The variants of a question's parts, each searched, fused."""
        return self._graded(questions, self.fused(k, _whole(self.search(_rewrites(questions, "every"), 2 * k))))

    def hyde(self, questions: DataFrame, k: int) -> Answers:
        """What the record would say, searched by vectors, fused with the question's own hits."""
        said = _whole(self.nearest(_rewrites(questions, "passages"), 2 * k))
        return self._graded(questions, self.fused(k, said, self.search(questions, 2 * k)))

    def window(self, questions: DataFrame, k: int) -> Answers:
        """Seeds, then what stands beside them in their records, in the order of the seeds; each chunk once. Neighbours of a
        seed that several questions share are looked up once."""
        seeds = materialise(self.search(questions, max(2, k // 2), t="toks", **SEEDS), "seeds")
        mine = seeds.select(F.col("id").alias("chunk_id"), *SEEDS).dropDuplicates(["chunk_id"])
        seeds = seeds.drop(*SEEDS)
        beside = context.neighbours(self.chunks, mine)
        met = seeds.select("qid", F.col("id").alias("seed"), "rank").join(
            beside.select("seed", "place", F.col("chunk_id").alias("id")), "seed",
        )
        new = met.groupBy("qid", "id").agg(F.min(F.struct("rank", "place")).alias("at"))
        new = new.join(seeds.select("qid", "id"), ["qid", "id"], "left_anti")
        line = Window.partitionBy("qid").orderBy("at")
        new = new.withColumn("_n", F.row_number().over(line)).filter(F.col("_n") <= k + 2)
        last = seeds.groupBy("qid").agg(F.count(F.lit(1)).alias("_seeds"))
        extra = new.join(last, "qid").select(
            "qid", "id", F.lit(0.0).alias("score"), (F.col("_seeds") + F.col("_n") - 1).alias("rank"),
        )
        return Answers(self.grade(questions, seeds), seeds.drop("t").unionByName(extra))

    def temporal(self, questions: DataFrame, k: int) -> Answers:
        """A pool cut to the time that is asked for, or to the newest of each fact, else weighed by recency."""
        pool = self.search(questions, max(8 * k, 40), **DATED)
        rows = S.with_recency(pool.join(questions.select("qid", "since", "until", "latest"), "qid"), "date", ["qid"])
        same = Window.partitionBy("qid", "patient_id", "kind", "fact")
        rows = rows.select(
            "*", F.min("rank").over(same).alias("_first"),
            F.row_number().over(same.orderBy(F.col("date").desc_nulls_last(), "rank")).alias("_age"),
        )
        spanned = F.col("since").isNotNull()
        keep = F.when(spanned, F.col("date").between(F.col("since"), F.col("until"))).when(
            F.col("latest"), F.col("_age") == 1,
        ).otherwise(True)
        weighed = F.when(~spanned & ~F.col("latest"), F.col("score") * (1 + 0.5 * F.col("recency"))).otherwise(0.0)
        at = F.when(~spanned & F.col("latest"), F.col("_first")).otherwise(F.col("rank"))
        line = Window.partitionBy("qid").orderBy(weighed.desc(), at)
        rows = rows.filter(keep).withColumn("_n", F.row_number().over(line)).filter(F.col("_n") <= k)
        return self._graded(questions, rows.withColumn("rank", F.col("_n").cast("long") - 1))

    def corrective(self, questions: DataFrame, k: int) -> Answers:
        """Evidence is graded; questions whose best is still low go on: to their variants, then to passages fused with their
        first pool. What stays low abstains and keeps its two best hits. outcomes has the stage of the best attempt (0 to 2),
        and abstained. Each stage is written, so that a later one never repeats an earlier one."""
        wide = max(4 * k, 20)
        pool = materialise(self.search(questions, wide, **RERANKED), "pool")
        stages = [
            lambda _: pool,
            lambda left: self.fused(wide, _whole(self.search(_rewrites(left, "variants"), 3 * k, **RERANKED))),
            lambda left: self.fused(
                wide, _whole(self.nearest(_rewrites(left, "passages"), 3 * k, **RERANKED)),
                pool.join(left.select("qid"), "qid", "left_semi"),
            ),
        ]
        left, graded, hits = questions, None, None
        best = Window.partitionBy("qid").orderBy(F.col("coverage").desc(), "stage")
        for stage, find in enumerate(stages):
            tried = self._graded(left, self.rerank(left, find(left), k))
            now = materialise(tried.outcomes.withColumn("stage", F.lit(stage)), "graded")
            top = tried.hits.withColumn("stage", F.lit(stage))
            graded = now if graded is None else graded.unionByName(now)
            hits = top if hits is None else hits.unionByName(top)
            outcomes = graded.withColumn("_n", F.row_number().over(best)).filter("_n = 1").drop("_n")
            if stage < len(stages) - 1:
                weak = outcomes.filter("label = 'low'").select("qid")
                left = materialise(questions.join(weak, "qid", "left_semi"), "left")
                if left.isEmpty():
                    break
        outcomes = outcomes.withColumn("abstained", F.col("label") == "low")
        chosen = hits.join(outcomes.select("qid", "stage", "abstained"), ["qid", "stage"])
        return Answers(outcomes, chosen.filter("not abstained or rank < 2").select("qid", "id", "score", "rank"))
