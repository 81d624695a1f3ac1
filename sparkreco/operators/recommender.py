"""The recommender: feature tables, candidates and a ranking model under one name. Every step is a plan over all users at once."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkreco.operators import candidates as C
from sparkreco.operators import artifacts, clean, learning, signals, sinks
from sparkreco.operators.boosting import Booster, Ensemble, Fitted

#: Of the embeddings, so many first numbers are features.
EMBEDDED = 8
FEATURES = ["past_weight", "past_events", "user_count", "user_sum", "user_mean", "user_max", "user_min", "user_orders_count", "item_count", "item_sum", "item_mean", "item_max", "item_min", "item_orders_count", "covisit_strength", "cat_match_score", *[f"emb_{i}" for i in range(EMBEDDED)]]


def item_extras(items: DataFrame, strength: DataFrame) -> DataFrame:
    """(item_id, catalogid, covisit_strength, emb_0, ...): null where an item has none."""
    emb = learning.embedding_columns(learning.embeddings(items), EMBEDDED)
    return items.select("item_id", "catalogid").join(strength, "item_id", "left").join(emb, "item_id", "left")


def category_shares(weights: DataFrame, items: DataFrame) -> DataFrame:
    """(user_id, catalogid, cat_match_score): how much of a user's weight lies in a category."""
    return learning.shares(signals.category_preferences(weights, items))


@dataclass(frozen=True)
class Recommender:
    """user_features, item_features: tables by user_id and item_id. past: (user_id, item_id, past_weight, past_events). popular: (item_id, pop_rank).

    extras and shares: what item_extras() and category_shares() give, for training and serving alike; without them these features are 0.
    often: a bounded list (item_id) of the items that most candidates are.
    """

    user_features: DataFrame
    item_features: DataFrame
    past: DataFrame
    popular: DataFrame
    extras: DataFrame | None = None
    shares: DataFrame | None = None
    often: DataFrame | None = None
    model: PipelineModel | Ensemble | None = None
    features: list[str] = field(default_factory=lambda: list(FEATURES))

    def enriched(self, frame: DataFrame) -> DataFrame:
        """frame (user_id, item_id, ...) with what is known of its items and users and of the user's weight in the item's category; null where unknown.

        Rows go to their items once, where all item features are one row, and return to their users once: all that is known by user lies by
        user already. Frames that have past_weight keep it.
        """
        items = self.item_features if self.extras is None else self.item_features.join(self.extras, "item_id", "full")
        out = frame.join(items, "item_id", "left")
        if "past_weight" not in frame.columns:
            out = out.join(self.past, ["user_id", "item_id"], "left")
        if self.extras is not None:
            out = out.join(self.shares, ["user_id", "catalogid"], "left") if self.shares is not None else out
            out = out.drop("catalogid")
        out = out.join(self.user_features, "user_id", "left")
        return out.withColumns({c: F.lit(0.0) for c in self.features if c not in out.columns})

    def frame(self, candidates: DataFrame) -> DataFrame:
        """Candidates (user_id, item_id, ...) with all features; what isn't known is 0."""
        return (self.enriched(candidates) if self.often is None else self._enriched_in_place(candidates)).na.fill(0)

    def _enriched_in_place(self, candidates: DataFrame) -> DataFrame:
        """As enriched, of candidates that lie by user and stay there.

        The features of items that are candidates often are broadcast; only candidates with other items go to these and return. Rows are sorted by
        user and item before they have features, and not again: a user's shares are one row.
        """
        items = self.item_features if self.extras is None else self.item_features.join(self.extras, "item_id", "full")
        names = [c for c in items.columns if c != "item_id"]
        often = F.broadcast(self.often.select("item_id").distinct())
        known = items.join(often, "item_id", "left_semi").select("item_id", F.struct(*names).alias("__often"))
        rest = candidates.select("user_id", "item_id").join(often, "item_id", "left_anti").groupBy("user_id", "item_id").agg(F.lit(1).alias("__one")).drop("__one")
        rest = rest.join(items.select("item_id", F.struct(*names).alias("__rest")), "item_id")
        out = candidates.join(rest, ["user_id", "item_id"], "left").join(self.past, ["user_id", "item_id"], "left").join(self.user_features, "user_id", "left")
        out = out.join(F.broadcast(known), "item_id", "left").withColumn("__item", F.coalesce("__often", "__rest")).drop("__often", "__rest")
        out = out.select(*[c for c in out.columns if c != "__item"], *[F.col("__item")[c].alias(c) for c in names])
        if self.extras is not None and self.shares is not None:
            own = F.map_from_entries(F.collect_list(F.struct("catalogid", "cat_match_score"))).alias("__shares")
            own = self.shares.filter("catalogid IS NOT NULL").groupBy("user_id").agg(own)
            out = out.join(own, "user_id", "left").withColumn("cat_match_score", F.try_element_at("__shares", "catalogid")).drop("__shares")
        return out.drop("catalogid").withColumns({c: F.lit(0.0) for c in self.features if c not in out.columns})

    def training_frame(self, orders: DataFrame, interactions: DataFrame, filled: bool = True, before: bool = True) -> DataFrame:
        """Orders with the same features, of what was known before each (before=False: of all interactions); filled: nulls are 0."""
        out = self.enriched(learning.past_sums(orders, interactions, before))
        return out.na.fill(0) if filled else out

    def training_rows(self, orders: DataFrame, interactions: DataFrame) -> tuple[DataFrame, Callable[[], None]]:
        """The training frame, stored for those who read it more than once, and what frees it; validates: the users that the hash split leaves out."""
        split = clean.hash_split(self.training_frame(orders, interactions)).withColumn("validates", F.col("is_train") == 0)
        return sinks.staged(split.select("user_id", "item_id", "last_status", "target", "validates", *self.features), "training-set")

    def fit(self, orders: DataFrame, interactions: DataFrame, booster: Booster, start: Ensemble | None = None) -> Fitted:
        """Learns to order a user's delivered items before the others; the users that the hash split leaves out choose the round."""
        rows, free = self.training_rows(orders, interactions)
        found = self.fit_rows(rows, booster, start)
        free()
        return found

    def fit_rows(self, rows: DataFrame, booster: Booster, start: Ensemble | None = None) -> Fitted:
        return booster.fit(rows, self.features, keys=("user_id", "item_id", "last_status"), validation="validates", start=start)

    def train(self, orders: DataFrame, interactions: DataFrame, rounds: int = 50, depth: int = 6, patience: int | None = 10, start: Ensemble | None = None) -> Recommender:
        """With a ranking model of at most so many rounds; start: an ensemble to go on from."""
        return replace(self, model=self.fit(orders, interactions, Booster(rounds=rounds, depth=depth, patience=patience), start).ensemble)

    def train_pointwise(self, orders: DataFrame, interactions: DataFrame, rounds: int = 50, depth: int = 6) -> Recommender:
        """With trees on the logistic loss of each row."""
        # every round reads the frame again
        rows, free = self.training_rows(orders, interactions)
        model = self.pointwise(rows, rounds, depth)
        free()
        return model

    def pointwise(self, rows: DataFrame, rounds: int = 50, depth: int = 6) -> Recommender:
        return replace(self, model=learning.train_ranker(rows, self.features, rounds=rounds, depth=depth, validation="validates"))

    def score(self, frame: DataFrame) -> DataFrame:
        return self.model.score(frame) if isinstance(self.model, Ensemble) else learning.predict(self.model, frame)

    def evaluate(self, frame: DataFrame, label: str = "target", k: int = 100) -> DataFrame:
        """Mean NDCG of the scores of a frame with labels, such as a stored validation set."""
        scored = self.score(frame).select("user_id", "item_id", "score", F.col(label).alias("label"))
        return learning.ndcg_grouped(scored, k, fast=True)

    def scored(self, candidates: DataFrame) -> DataFrame:
        """(user_id, item_id, pos, score) of the candidates, each once."""
        first = candidates.groupBy("user_id", "item_id").agg(F.min("pos").alias("pos"))
        return self.score(self.frame(first)).select("user_id", "item_id", "pos", F.round("score", 9).alias("score"))

    def recommend(self, candidates: DataFrame, users: DataFrame, k: int = 100) -> DataFrame:
        """Each user's k best candidates (user_id, item_id, pos) by score, filled up by popularity: (user_id, item_id, pos)."""
        return C.final_ranking(self.scored(candidates), users, self.popular, k)

    def save(self, folder: str) -> None:
        tables = {"user_features": self.user_features, "item_features": self.item_features, "past": self.past, "popular": self.popular, "extras": self.extras, "shares": self.shares, "often": self.often}
        artifacts.save_artifacts(folder, {n: t for n, t in tables.items() if t is not None}, {"model": self.model} if self.model else {}, self.features)

    @classmethod
    def load(cls, spark: SparkSession, folder: str) -> Recommender:
        tables, models, features = artifacts.load_artifacts(spark, folder)
        return cls(**tables, model=models.get("model"), features=features)
