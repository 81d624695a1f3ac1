"""Scalar expressions shared by the operators; all are JVM-side built-ins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# fixed values: what actions and statuses weigh
ACTION_WEIGHTS = {"page_view": 1.0, "favorite": 5.0, "to_cart": 10.0}
OLDER_ACTION_WEIGHTS = {"page_view": 2.0, "favorite": 5.0, "to_cart": 10.0}
SIMPLE_ACTION_WEIGHTS = {"page_view": 1.0, "favorite": 2.0, "to_cart": 3.0}
ORDER_WEIGHT = 5.0
TARGET_ROOTS = (7500, 17777, 7697)


def micros(column: str) -> Column:
    """Microseconds since 1970 of a timestamp without time zone, whatever the session's zone is."""
    return F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', `{column}`)")


def days_between(later: Column, earlier: Column) -> Column:
    """Whole units of 24 hours between two numbers of microseconds."""
    return F.floor((later - earlier) / F.lit(86400000000.0)).cast("bigint")


def lookup(column: str, values: dict[str, float], default: float = 0.0) -> Column:
    return F.coalesce(F.create_map(*[F.lit(x) for pair in values.items() for x in pair])[F.col(column)], F.lit(default))


def finite(column: str) -> Column:
    """Null, NaN and infinite become 0."""
    c = F.col(column).cast("double")
    return F.when(c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")), 0.0).otherwise(c)


def parse_vector(column: str) -> Column:
    """[0.1, 0.2] or [0.1 0.2] as an array; an unreadable part becomes null."""
    return parse_vector_of(F.col(column))


def parse_vector_of(text: Column) -> Column:
    parts = F.split(F.trim(F.regexp_replace(text, r"[\[\],]", " ")), r"\s+")
    return F.transform(F.filter(parts, lambda x: x != ""), lambda x: x.try_cast("float"))


def entry_vector(entry: Column, features: list[str]) -> Column:
    """A VARIANT entry as the numbers of the features: a record gives them by name (a list of one record too), a list by place, a number stands for
    all of them, and text may hold a list. What is missing, no number or of another kind is 0.
    """
    n, kind = len(features), F.schema_of_variant(entry)
    number = lambda path: F.try_variant_get(entry, path, "double")
    named = lambda prefix: F.array(*[number(f"{prefix}['{f}']") for f in features])
    listed = F.transform(F.try_variant_get(entry, "$", "array<variant>"), lambda x: F.try_variant_get(x, "$", "double"))
    one = F.size(F.try_variant_get(entry, "$", "array<variant>")) == 1
    found = (
        F.when(kind.startswith("OBJECT"), named("$"))
        .when(kind.startswith("ARRAY<OBJECT") & one, named("$[0]"))
        .when(kind.startswith("ARRAY"), listed)
        .when(kind == "STRING", parse_vector_of(F.try_variant_get(entry, "$", "string")))
        .when(kind.isin("BOOLEAN", "VOID"), None)
        .otherwise(F.array_repeat(number("$"), n))
    )
    return F.transform(resized(F.coalesce(found, F.array().cast("array<double>")), n), lambda x: F.when(x.isNull() | F.isnan(x), 0.0).otherwise(x))


def prefixed(columns: list[str], prefix: str) -> list[str]:
    """The columns of a family, such as emb_0, emb_1, ..., in the order of their numbers; what follows the prefix otherwise comes last."""
    rest = {c: c[len(prefix) :] for c in columns if c.startswith(prefix)}
    return sorted(rest, key=lambda c: (not rest[c].isdigit(), int(rest[c]) if rest[c].isdigit() else 0, rest[c]))


def dot(a: Column | str, b: Column | str) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column | str) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def normalized(column: str) -> Column:
    size = norm(column)
    return F.when(size > 0, F.transform(column, lambda x: x.cast("double") / size))


def resized(column: Column, n: int) -> Column:
    """Cut or filled with zeros to n numbers."""
    return F.slice(F.concat(F.transform(column, lambda x: x.cast("double")), F.array_repeat(F.lit(0.0), n)), 1, n)


def added(a: Column | str, b: Column | str) -> Column:
    return F.zip_with(a, b, lambda x, y: F.coalesce(x.cast("double"), F.lit(0.0)) + F.coalesce(y.cast("double"), F.lit(0.0)))


def parse_time(column: str) -> Column:
    """A time in text; what can't be read becomes null."""
    return F.try_to_timestamp(F.col(column))


def merged_arrays(first: Column | str, second: Column | str, n: int) -> Column:
    """The first n different elements: the second array's from its end, then the first's."""
    return F.slice(F.array_distinct(F.concat(F.reverse(second), first)), 1, n)


def aligned(df: DataFrame, features: list[str], keys: list[str]) -> DataFrame:
    """keys and the features in their order; a missing feature is 0."""
    return df.select(*keys, *[finite(c).alias(c) if c in df.columns else F.lit(0.0).alias(c) for c in features])
