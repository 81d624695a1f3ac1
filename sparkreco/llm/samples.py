"""Bounded samples of labelled and unlabelled documents for the classifiers."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def unused(name: str, columns: list[str]) -> str:
    """name, with underscores behind it until none of the columns has it."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def fold(id_col: str, n: int) -> Column:
    """crc32 of the id as text, modulo n; null for a null id."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % n


#: Longer texts are not learned from: it bounds what the driver holds. Scored are texts of any length.
LONGEST = 100_000


def labelled(docs: DataFrame, labels: DataFrame, label: str, allowed: Column, per_class: int, values: tuple[int, ...] = (0, 1), longest: int = LONGEST) -> pd.DataFrame:
    """text, lang (null if there is none) and label of up to per_class documents of each class, chosen by a hash of the id.

    Of these, the texts of up to `longest` characters. Only ids are sorted; the chosen ones, bounded by per_class, are broadcast, so the documents are scanned once and never shuffled.
    """
    known = labels.filter(allowed & F.col("doc_id").isNotNull()).select("doc_id", F.col(label).cast("int").alias("label"))
    chosen = None
    for value in values:
        some = known.filter(F.col("label") == value).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class)
        chosen = some if chosen is None else chosen.unionByName(some)
    lang = F.col("lang") if "lang" in docs.columns else F.lit(None)
    texts = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), lang.cast("string").alias("lang"))
    found = texts.filter(F.length("text") <= longest).join(F.broadcast(chosen), "doc_id").toPandas()
    return found.sort_values(["doc_id", "label"], kind="stable").reset_index(drop=True)


def unlabelled(docs: DataFrame, allowed: Column, bound: int, longest: int = LONGEST) -> pd.DataFrame:
    """text of about bound documents of up to `longest` characters, at most 2 * bound, chosen by a hash of the id, whatever their labels may be."""
    n = max(1, docs.count())
    share = max(1, min(1_000_000, round(1_000_000 * bound / n)))
    some = docs.filter(allowed & F.col("doc_id").isNotNull()).filter(F.pmod(F.xxhash64("doc_id", F.lit("unlabelled")), F.lit(1_000_000)) < share)
    some = some.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).filter(F.length("text") <= longest)
    found = some.orderBy(F.xxhash64("doc_id"), "doc_id").limit(2 * bound).toPandas()
    return found.sort_values("doc_id", kind="stable").reset_index(drop=True)
