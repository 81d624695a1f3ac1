"""Matrix factors that learn batch by batch: each id's factor and its two moments of Adam are a row of a stored table.

A batch writes the rows of the ids that it touches as a generation of their own, and reads these ids only: they are broadcast (their
number is checked) or joined, and as the table is dealt to folders by a hash of the id, folders without any of them aren't read. What moves between
tasks is the touched rows. compact() makes one generation of all, now and then.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkreco.functions.scalar import dot
from sparkreco.operators.sinks import staged

#: Ids of a batch up to which they are broadcast.
MOST_IDS = 1 << 20
STATE = "id long, factor array<double>, m array<double>, v array<double>, step long, generation long, bucket int"
KINDS = ("user", "item")


@dataclass(frozen=True)
class FactorStore:
    """folder: in shared storage; each kind of id has a subfolder. The loss of a batch of n pairs is the mean squared error plus reg times the mean square of the factors' entries."""

    spark: SparkSession
    folder: str
    rank: int = 64
    rate: float = 0.005
    reg: float = 1e-3
    decay: tuple[float, float] = (0.9, 0.999)
    eps: float = 1e-8
    buckets: int = 64
    seed: int = 42

    def _bucket(self, c: Column | str) -> Column:
        return F.pmod(F.xxhash64(c), F.lit(self.buckets)).cast("int")

    def stored(self, kind: str) -> DataFrame:
        """All generations; empty before the first batch."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{kind}")
        if not path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
            return self.spark.createDataFrame([], STATE)
        return self.spark.read.schema(STATE).parquet(f"{self.folder}/{kind}")

    def current(self, kind: str, ids: DataFrame | None = None, before: int | None = None) -> DataFrame:
        """(id, factor, m, v, step): the latest row of each id, of these (id) or of all; before: as it was before this batch."""
        rows = self.stored(kind)
        if before is not None:
            rows = rows.filter(F.col("generation") < before)
        if ids is not None:
            asked = ids.select("id", self._bucket("id").alias("bucket"))
            met = [r["bucket"] for r in asked.select("bucket").distinct().collect()]  # no more than there are folders
            rows = rows.filter(F.col("bucket").isin(met))
            rows = rows.join(F.broadcast(asked) if asked.count() <= MOST_IDS else asked, ["bucket", "id"], "left_semi")
        own = F.struct("factor", "m", "v", "step")
        return rows.groupBy("id").agg(F.max_by(own, "generation").alias("s")).select("id", "s.*")

    def _start(self, kind: str) -> Column:
        """What an id starts from: numbers below 0.1 in size that its hash gives."""
        part = lambda d: (F.pmod(F.xxhash64("id", d, F.lit(kind), F.lit(self.seed)), F.lit(1 << 30)) / float(1 << 30) - 0.5) * 0.2
        return F.transform(F.sequence(F.lit(0), F.lit(self.rank - 1)), part)

    def _touched(self, kind: str, batch: DataFrame, number: int) -> DataFrame:
        ids = batch.select(F.col(f"{kind}_id").cast("long").alias("id")).distinct()
        zeros = F.array_repeat(F.lit(0.0), self.rank)
        found = ids.join(self.current(kind, ids, number), "id", "left")
        return found.select("id", F.coalesce("factor", self._start(kind)).alias("factor"), F.coalesce("m", zeros).alias("m"), F.coalesce("v", zeros).alias("v"), F.coalesce("step", F.lit(0).cast("long")).alias("step"))

    def _stepped(self, state: DataFrame, errors: DataFrame, n: int) -> DataFrame:
        """state (kind, id, ...) after one step of Adam on the gradients that errors (kind, id, e, other) add up to."""
        sums = errors.groupBy("kind", "id").agg(F.count("*").alias("pairs"), *[F.sum(F.col("e") * F.col("other")[d]).alias(f"g{d}") for d in range(self.rank)])
        g = sums.select("kind", "id", "pairs", F.array(*[f"g{d}" for d in range(self.rank)]).alias("g"))
        own = F.col("pairs") * (2 * self.reg / (n * self.rank)) + self.reg  # the loss's part, and weight decay
        b1, b2 = self.decay
        out = state.join(g, ["kind", "id"]).withColumn("step", F.col("step") + 1).withColumn("g", F.zip_with("g", "factor", lambda x, p: x * (2.0 / n) + p * own))
        out = out.withColumn("m", F.zip_with("m", "g", lambda m, x: m * b1 + x * (1 - b1))).withColumn("v", F.zip_with("v", "g", lambda v, x: v * b2 + x * x * (1 - b2)))
        c1, c2 = 1 - F.pow(F.lit(b1), F.col("step")), 1 - F.pow(F.lit(b2), F.col("step"))
        move = F.zip_with("m", "v", lambda m, v: self.rate * (m / c1) / (F.sqrt(v / c2) + self.eps))
        return out.withColumn("factor", F.zip_with("factor", move, lambda p, d: p - d)).select("kind", "id", "factor", "m", "v", "step")

    def _errors(self, pairs: DataFrame, state: DataFrame) -> DataFrame:
        """(kind, id, e, other): each pair's error for its user and for its item, with the other's factor.

        Both come from one join, in the tasks of the items: an item's rows add up there, and a user's go on as sums.
        """
        u, i = (state.filter(F.col("kind") == k).select(F.col("id").alias(f"{k}_id"), F.col("factor").alias(f"{k}_factor")) for k in KINDS)
        met = pairs.join(u, "user_id").join(i, "item_id").withColumn("e", dot("user_factor", "item_factor") - F.col("weight"))
        sides = [F.struct(F.lit(k).alias("kind"), F.col(f"{k}_id").cast("long").alias("id"), F.col(f"{other}_factor").alias("other")) for k, other in (KINDS, KINDS[::-1])]
        return met.select("e", F.explode(F.array(*sides)).alias("s")).select("s.kind", "s.id", "e", "s.other")

    def update(self, batch: DataFrame, number: int, iterations: int = 5) -> None:
        """Learn from (user_id, item_id, weight) rows, of which equal pairs add up. A batch that comes again with its number replaces what it wrote."""
        pairs, free_pairs = staged(batch.groupBy("user_id", "item_id").agg(F.sum("weight").alias("weight")).filter("user_id IS NOT NULL AND item_id IS NOT NULL AND weight IS NOT NULL"), "factor-batch")
        n = pairs.count()
        if n:
            users, items = (self._touched(k, pairs, number).select(F.lit(k).alias("kind"), "*") for k in KINDS)
            now, free = staged(users.unionByName(items), "factor-state")
            for _ in range(iterations):
                # nothing of a pair is stored but its weight: what moves is a user's factor to the item's task, and sums back
                after = staged(self._stepped(now, self._errors(pairs, now), n), "factor-state")
                free()
                now, free = after
            for k in KINDS:
                self._write(now.filter(F.col("kind") == k).drop("kind"), k, number)
            free()
        free_pairs()

    def _write(self, rows: DataFrame, kind: str, number: int) -> None:
        rows.withColumn("bucket", self._bucket("id")).repartition("bucket").sortWithinPartitions("bucket", "id").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.folder}/{kind}/generation={number}")

    def compact(self, number: int) -> None:
        """One generation, of this number, in place of those before it."""
        for kind in KINDS:
            whole, free = staged(self.current(kind, before=number + 1), f"factor-{kind}")
            root = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{kind}")
            fs = root.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
            self._write(whole, kind, number)
            for f in fs.listStatus(root) if fs.exists(root) else []:
                if (name := f.getPath().getName()).startswith("generation=") and int(name.partition("=")[2]) < number:
                    fs.delete(f.getPath(), True)
            free()

    def learn(self, iterations: int = 5) -> Callable[[DataFrame, int], None]:
        """For foreachBatch of a stream."""
        return lambda batch, number: self.update(batch, number, iterations)

    def scores(self, pairs: DataFrame) -> DataFrame:
        """(user_id, item_id, score) of the pairs whose ids are both known."""
        u, i = (self.current(k, pairs.select(F.col(f"{k}_id").cast("long").alias("id")).distinct()).select(F.col("id").alias(f"{k}_id"), F.col("factor").alias(k)) for k in KINDS)
        return pairs.select("user_id", "item_id").join(u, "user_id").join(i, "item_id").select("user_id", "item_id", dot("user", "item").alias("score"))
