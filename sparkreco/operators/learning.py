"""Training frames, models, embeddings and metrics."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import PCA, StandardScaler, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.recommendation import ALS, ALSModel
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkreco.functions.scalar import dot
from sparkreco.operators import sinks
from sparkreco.operators.signals import numbered, ranked
from sparkreco.operators.vectors import VectorIndex


def id_index(df: DataFrame, column: str) -> DataFrame:
    """Numbers 0, 1, ... of the sorted different ids."""
    return numbered(df.select(column).distinct(), [F.asc(column)], "idx")


def factorized(df: DataFrame, column: str) -> DataFrame:
    """df with a column code: 0, 1, ... by the sorted different values, null the first."""
    codes = id_index(df, column).select(F.col(column).alias("__c"), F.col("idx").cast("int").alias("code"))
    return df.join(codes, F.col(column).eqNullSafe(F.col("__c")), "left").drop("__c")


def factorize(weights: DataFrame, rank: int = 64, iterations: int = 5, reg: float = 1e-3, seed: int = 42) -> ALSModel:
    """Matrix factorisation of summed weights by alternating least squares."""
    return ALS(rank=rank, maxIter=iterations, regParam=reg, userCol="user_id", itemCol="item_id", ratingCol="weight", seed=seed, coldStartStrategy="drop").fit(weights)


def factorize_ids(weights: DataFrame, rank: int = 64, **options) -> tuple[ALSModel, DataFrame, DataFrame]:
    """Factors of rows whose ids may be any 64-bit numbers: they join their dense numbers first. Also the two indexes."""
    users, items = id_index(weights, "user_id"), id_index(weights, "item_id")
    return factorize(indexed(weights, users, items), rank, **options), users, items


def indexed(pairs: DataFrame, users: DataFrame, items: DataFrame) -> DataFrame:
    """pairs with the dense numbers of both ids in the ids' place; pairs with an unknown id go."""
    own = pairs.join(users.withColumnRenamed("idx", "__u"), "user_id").join(items.withColumnRenamed("idx", "__i"), "item_id")
    return own.withColumn("user_id", F.col("__u").cast("int")).withColumn("item_id", F.col("__i").cast("int")).drop("__u", "__i")


def factor_scores(model: ALSModel, pairs: DataFrame) -> DataFrame:
    return dot_scores(model.userFactors, model.itemFactors, pairs)


def dot_scores(users: DataFrame, items: DataFrame, pairs: DataFrame) -> DataFrame:
    """(user_id, item_id, score) of the pairs that have factors (id, features) on both sides."""
    u, i = users.select(F.col("id").alias("user_id"), F.col("features").alias("uf")), items.select(F.col("id").alias("item_id"), F.col("features").alias("vf"))
    return pairs.join(u, "user_id").join(i, "item_id").select("user_id", "item_id", dot("uf", "vf").alias("score"))


def embeddings(items: DataFrame) -> DataFrame:
    return items.filter("fclip_embed IS NOT NULL AND size(fclip_embed) > 0").select("item_id", F.transform("fclip_embed", lambda x: x.cast("double")).alias("vector"))


def embedding_columns(vectors: DataFrame, n: int) -> DataFrame:
    return vectors.select("item_id", *[F.get("vector", F.lit(k)).alias(f"emb_{k}") for k in range(n)])


def fit_pca(vectors: DataFrame, k: int, sample: int | None = None, seed: int = 42) -> PipelineModel:
    """Standardise and project; fitted on about `sample` rows, if given."""
    rows = vectors.select("item_id", array_to_vector("vector").alias("raw"))
    if sample:
        n = rows.count()
        rows = rows.sample(min(1.0, sample / max(1, n)), seed=seed)
    return Pipeline(stages=[StandardScaler(withMean=True, inputCol="raw", outputCol="scaled"), PCA(k=k, inputCol="scaled", outputCol="pca")]).fit(rows)


def project(model: PipelineModel, vectors: DataFrame) -> DataFrame:
    return model.transform(vectors.select("item_id", array_to_vector("vector").alias("raw"))).select("item_id", vector_to_array("pca").alias("vector"))


def explained_variance(model: PipelineModel, spark) -> DataFrame:
    """(component from 1, ratio, cumulative): what a variance plot shows."""
    ratios = [float(x) for x in model.stages[-1].explainedVariance]
    rows, total = [], 0.0
    for i, r in enumerate(ratios):
        total += r
        rows.append((i + 1, r, total))
    return spark.createDataFrame(rows, "component int, ratio double, cumulative double")


def components_for(variance: DataFrame, share: float = 0.95) -> DataFrame:
    return variance.filter(F.col("cumulative") >= share).agg(F.min("component").alias("k"))


def similar_items(queries: DataFrame, vectors: DataFrame, k: int, digits: int = 4) -> DataFrame:
    """The k items with the highest rounded cosine for each of a stated set of queries, by an index that is made for it."""
    return VectorIndex.build(vectors, sinks.scratch(vectors.sparkSession, "vectors")).search(queries, k, digits=digits)


def embedding_neighbours(vectors: DataFrame, wanted: DataFrame, k: int) -> DataFrame:
    """Neighbours of the wanted items."""
    return similar_items(vectors.join(wanted.select("item_id").distinct(), "item_id", "left_semi"), vectors, k)


def labels_of(candidates: DataFrame, holdout: DataFrame) -> DataFrame:
    """1 if the pair is in the holdout."""
    truth = holdout.select("user_id", "item_id").distinct().withColumn("__hit", F.lit(1))
    return candidates.join(truth, ["user_id", "item_id"], "left").withColumn("label", F.coalesce("__hit", F.lit(0))).drop("__hit")


def past_join(orders: DataFrame, events: DataFrame, literal: bool = False) -> DataFrame:
    """Orders with the user's earlier interactions with the item.

    An order without any keeps a row with nulls. literal: the time is tested after the left join, so an order whose
    interactions all come later loses its row.
    """
    e = events.select("user_id", "item_id", "weight", F.col("timestamp").alias("event_ts"))
    if literal:
        return orders.join(e, ["user_id", "item_id"], "left").filter("event_ts < created_timestamp OR event_ts IS NULL")
    o, e = orders.alias("o"), e.alias("e")
    on = (F.col("o.user_id") == F.col("e.user_id")) & (F.col("o.item_id") == F.col("e.item_id")) & (F.col("e.event_ts") < F.col("o.created_timestamp"))
    return o.join(e, on, "left").select("o.*", "e.weight", "e.event_ts")


def leaks(df: DataFrame) -> DataFrame:
    return df.filter("event_ts > created_timestamp").agg(F.count("*").alias("leaks"))


def training_set(orders: DataFrame, events: DataFrame, user_features: DataFrame, item_features: DataFrame, filled: bool = True, before: bool = True) -> DataFrame:
    """Orders with what was known before them and the feature tables of their users and items; filled: nulls are 0.

    before=False: with all interactions of the user and the item, whatever their time, for splits by user.
    """
    past = past_sums(orders, events, before)
    out = past.join(user_features, "user_id", "left").join(item_features, "item_id", "left")
    return out.na.fill(0) if filled else out


def past_sums(orders: DataFrame, events: DataFrame, before: bool = True) -> DataFrame:
    """Orders with past_weight and past_events: of the user's interactions with the item before the order, or of all (before=False)."""
    e = events.select("user_id", "item_id", "weight", F.col("timestamp").alias("event_ts"))
    met = past_join(orders, events) if before else orders.join(e, ["user_id", "item_id"], "left")
    return met.groupBy("user_id", "item_id", "last_status", "created_timestamp", "target").agg(F.coalesce(F.sum("weight"), F.lit(0.0)).alias("past_weight"), F.count("event_ts").alias("past_events"))


def shares(preferences: DataFrame) -> DataFrame:
    """(user_id, catalogid, cat_match_score): how much of a user's weight lies in a category; preferences: (user_id, catalogid, weight)."""
    total = F.sum("weight").over(Window.partitionBy("user_id"))
    return preferences.select("user_id", "catalogid", F.try_divide("weight", total).alias("cat_match_score"))


def scoring_frame(candidates: DataFrame, user_features: DataFrame, item_features: DataFrame, items: DataFrame, preferences: DataFrame) -> DataFrame:
    """Candidates with both feature tables and how much of the user's weight lies in the item's category."""
    cats = items.select("item_id", "catalogid")
    # what goes by item first: then the rows return to their users once, for the shares and the features
    out = candidates.join(item_features.join(cats, "item_id", "full"), "item_id", "left").join(shares(preferences), ["user_id", "catalogid"], "left").join(user_features, "user_id", "left")
    return out.drop("catalogid").na.fill(0)


def train_ranker(frame: DataFrame, features: list[str], label: str = "target", rounds: int = 50, depth: int = 6, seed: int = 42, validation: str | None = None, tolerance: float = 0.01) -> PipelineModel:
    """Gradient-boosted trees on the logistic loss: what ranks candidates.

    validation: a boolean column that marks rows to validate on; training stops when a round gains them less than tolerance.
    """
    gbt = GBTClassifier(labelCol=label, featuresCol="features", maxIter=rounds, maxDepth=depth, stepSize=0.05, subsamplingRate=0.8, seed=seed)
    if validation:
        gbt = gbt.setParams(validationIndicatorCol=validation, validationTol=tolerance)
    return Pipeline(stages=[VectorAssembler(inputCols=features, outputCol="features", handleInvalid="keep"), gbt]).fit(frame)


def predict(model: PipelineModel, frame: DataFrame) -> DataFrame:
    return model.transform(frame).withColumn("score", vector_to_array("probability")[1])


def marked(frame: DataFrame, features: list[str]) -> DataFrame:
    """Rows by target, and how many of them lack some feature."""
    missing = None
    for c in features:
        lacks = F.col(c).isNull() | F.isnan(F.col(c).cast("double"))
        missing = lacks if missing is None else missing | lacks
    return frame.groupBy("target").agg(F.count("*").alias("rows"), F.count_if(missing).alias("lacking"))


def importances(model: PipelineModel, features: list[str], spark, k: int = 20) -> DataFrame:
    values = model.stages[-1].featureImportances
    return spark.createDataFrame([(f, float(values[i])) for i, f in enumerate(features)], "feature string, importance double").orderBy(F.desc("importance"), "feature").limit(k)


def ndcg_lists(recs: DataFrame, truth: DataFrame, k: int = 100) -> DataFrame:
    """NDCG of each user's list against the set of true items; the ideal has min(size of the set, k) hits."""
    t = truth.select("user_id", "item_id").distinct()
    gain = recs.filter(F.col("pos") <= k).join(t, ["user_id", "item_id"]).groupBy("user_id").agg(F.sum(1 / F.log2(F.col("pos") + 1)).alias("dcg"))
    size = t.groupBy("user_id").agg(F.least(F.count("*"), F.lit(k)).alias("n"))
    ideal = F.aggregate(F.expr("sequence(1, cast(n as int))"), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1))
    return size.join(gain, "user_id", "left").select("user_id", F.round(F.coalesce(F.col("dcg"), F.lit(0.0)) / ideal, 6).alias("ndcg"))


def ndcg_grouped(scored: DataFrame, k: int = 100, fast: bool = False) -> DataFrame:
    """Mean NDCG over users from scores and labels; users without a positive count as 0.

    fast: groups of one row and groups without a positive among the first k don't count, and the ideal knows the first k only.
    """
    rows = ranked(scored, ["user_id"], [F.desc("score"), F.asc("item_id")], "at").withColumn("size", F.count("*").over(Window.partitionBy("user_id")))
    top = rows.filter(F.col("at") <= k) if fast else rows
    best = ranked(top, ["user_id"], [F.desc("label"), F.asc("at")], "ideal_at")
    part = lambda c: F.sum(F.when(F.col(c) <= k, F.col("label") / F.log2(F.col(c) + 1)).otherwise(0.0))
    per = best.groupBy("user_id").agg(part("at").alias("dcg"), part("ideal_at").alias("idcg"), F.max("size").alias("size"))
    per = per.filter("size > 1 AND idcg > 0") if fast else per
    return per.agg(F.round(F.coalesce(F.avg(F.when(F.col("idcg") > 0, F.col("dcg") / F.col("idcg")).otherwise(0.0)), F.lit(0.0)), 6).alias("ndcg"), F.count("*").alias("users"))


def uniqueness(recs: DataFrame) -> DataFrame:
    return recs.agg(F.round(100.0 * F.countDistinct("item_id") / F.count("*"), 6).alias("uniqueness"))
