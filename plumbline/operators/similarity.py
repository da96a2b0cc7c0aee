"""Patients as feature vectors: nearest ones, clusters with names, and a map in three dimensions."""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import PCA, StandardScaler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..scratch import materialise
from .chunks import drug_base
from .clinical import with_risk
from .domains import few

# Short names of conditions.
SHORT = {
    "Type 2 Diabetes Mellitus": "Diabetes", "Essential Hypertension": "Hypertension",
    "Chronic Kidney Disease Stage 3": "CKD", "Coronary Artery Disease": "CAD", "Iron Deficiency Anemia": "Anemia",
    "Chronic Obstructive Pulmonary Disease": "COPD", "Rheumatoid Arthritis": "RA",
    "Major Depressive Disorder": "Depression", "Hyperlipidemia": "Lipids",
}
# End of the fixed values.


def feature_vectors(records: DataFrame) -> DataFrame:
    """patient_id, name, age, sex, score, conditions, drugs, features (array): age, sex, drugs, risk, 1.5 for each condition
    had, and each test's newest value as clipped distance from the middle of its range. The domains of conditions
    and tests are those of the data. Records are read once: what features are made of is a short row each, which is written."""
    rows = with_risk(records)
    have = F.array_distinct("diagnoses.condition")
    active = F.filter("medications", lambda m: m["active"])

    placed = F.transform(
        "labs",
        lambda x, i: F.struct(
            x["date"].alias("d"), i.alias("i"), x["test"].alias("test"), x["value"].alias("v"), x["ref_low"].alias("lo"),
            x["ref_high"].alias("hi"),
        ),
    )
    rows = T.once(rows, _placed=placed)
    # A value that a lambda uses more than once is an element of an array, so that it is made once.
    tests = F.array_distinct(F.array_compact("labs.test"))
    newest = F.transform(tests, lambda t: F.array_max(F.filter("_placed", lambda x: x["test"] == t)))
    far = F.transform(
        newest,
        lambda n: F.struct(
            n["test"].alias("test"),
            ((n["v"] - (n["lo"] + n["hi"]) / 2) / F.greatest(n["hi"] - n["lo"], F.lit(1e-6))).alias("far"),
        ),
    )
    clipped = lambda x: F.least(F.greatest(x, F.lit(-3.0)), F.lit(3.0)) / 3
    far = F.transform(  # greatest passes over nulls
        far, lambda x: F.struct(x["test"].alias("test"), F.when(x["far"].isNotNull(), clipped(x["far"])).otherwise(0.0).alias("far")),
    )
    told = materialise(
        rows.select(
            "patient_id", "name", "age", "sex", "score", have.alias("conditions"),
            F.array_distinct(F.transform(active, lambda m: drug_base(m["name"]))).alias("drugs"),
            F.size(active).alias("_active"),
            far.alias("_newest"),
        ),
        "told",
    )
    conditions, tests = few(told, F.explode("conditions")), few(told, F.explode("_newest.test"))
    far = lambda t: F.coalesce(F.get(F.filter("_newest", lambda x: x["test"] == t), F.lit(0))["far"], F.lit(0.0))
    parts = [
        F.col("age") / 100, F.when(F.col("sex") == "F", 1.0).otherwise(0.0), F.col("_active") / 6, F.col("score") / 100,
    ]
    parts += [F.when(F.array_contains("conditions", c), 1.5).otherwise(0.0) for c in conditions] + [far(t) for t in tests]
    return told.select(
        "patient_id", "name", "age", "sex", "score", "conditions", "drugs",
        F.array(*[p.cast("double") for p in parts]).alias("features"),
    )


def similar(vectors: DataFrame, patient_id: str, k: int = 5) -> DataFrame:
    """The k patients of the highest cosine to one, with what they share; the one itself is left out."""
    me = vectors.filter(F.col("patient_id") == patient_id).select(
        F.col("features").alias("f"), F.col("conditions").alias("c"), F.col("drugs").alias("d"),
    )
    rows = vectors.filter(F.col("patient_id") != patient_id).crossJoin(F.broadcast(me))
    scored = rows.select(
        "patient_id", "name", "age", "sex", F.round(T.cosine(F.col("features"), F.col("f")), 3).alias("similarity"),
        F.array_sort(F.array_intersect("conditions", "c")).alias("shared_conditions"),
        F.array_sort(F.array_intersect("drugs", "d")).alias("shared_medications"),
    )
    return scored.orderBy(F.desc("similarity"), "patient_id").limit(k)


def clustered(vectors: DataFrame, features: str, id_col: str, k: int = 5, seed: int = 0) -> DataFrame:
    """vectors with cluster (0 is the largest; of equal sizes the one with the smallest id) and x, y, z: principal components of
    the centred features, each scaled by its largest absolute value, its largest value positive."""
    rows = vectors.withColumn("_v", array_to_vector(F.transform(features, lambda x: x.cast("double"))))
    dim = rows.select(F.size(features)).first()[0]
    axes = min(3, dim)
    stages = [
        KMeans(k=k, seed=seed, maxIter=60, featuresCol="_v", predictionCol="_c"),
        StandardScaler(withMean=True, withStd=False, inputCol="_v", outputCol="_m"),
        PCA(k=axes, inputCol="_m", outputCol="_p"),
    ]
    out = Pipeline(stages=stages).fit(rows).transform(rows).withColumn("_p", vector_to_array("_p"))
    order = out.groupBy("_c").agg(F.count(F.lit(1)).alias("_n"), F.min(id_col).alias("_i")).withColumn(
        "cluster", F.row_number().over(Window.orderBy(F.desc("_n"), "_i")) - 1,
    )
    span = out.agg(*[F.max_by(F.col("_p")[i], F.abs(F.col("_p")[i])).alias(f"_s{i}") for i in range(axes)])
    scaled = lambda i: F.coalesce(
        F.col("_p")[i] / F.nullif(F.col(f"_s{i}"), F.lit(0.0)), F.lit(0.0),
    ) if i < axes else F.lit(0.0)
    met = out.join(F.broadcast(order.select("_c", "cluster")), "_c").crossJoin(F.broadcast(span))
    return met.select(*vectors.columns, "cluster", *[scaled(i).alias(n) for i, n in enumerate("xyz")])


def cluster_names(points: DataFrame) -> list[dict]:
    """Each cluster's size, means and the two conditions whose share is furthest above the cohort's."""
    n = points.count()
    overall = points.select(F.explode("conditions").alias("c")).groupBy("c").agg((F.count(F.lit(1)) / n).alias("all"))
    size = points.groupBy("cluster").agg(
        F.count(F.lit(1)).alias("size"), F.round(F.avg("age"), 1).alias("mean_age"),
        F.round(F.avg("score"), 1).alias("mean_risk"),
    )
    share = points.select(
        "cluster", F.explode("conditions").alias("c"),
    ).groupBy("cluster", "c").agg(F.count(F.lit(1)).alias("m")).join(size, "cluster").join(overall, "c")
    top = share.withColumn(
        "r",
        F.row_number().over(
            Window.partitionBy("cluster").orderBy(F.desc(F.col("m") / F.col("size") - F.col("all")), "c")
        ),
    ).filter("r <= 2")
    rows = size.join(
        top.groupBy("cluster").agg(F.array_sort(F.collect_list(F.struct("r", "c"))).alias("t")), "cluster", "left",
    ).orderBy("cluster").collect()
    out = []
    for r in rows:
        names = [x["c"] for x in r["t"] or []]
        out.append(
            {
                "id": r["cluster"], "name": " + ".join(SHORT.get(x, x) for x in names) or "mixed", "size": r["size"],
                "top_conditions": names, "mean_age": r["mean_age"], "mean_risk": r["mean_risk"],
            }
        )
    return out
