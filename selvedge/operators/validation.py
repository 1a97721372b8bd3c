"""Contracts as violation tables.

Every check returns the rows that break it, with the reasons; require_empty()
turns one into an error where a pipeline must not go on.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from selvedge.functions.text import or_empty, strip


def violations(rows: DataFrame, keep: list[str], rules: dict[str, Column]) -> DataFrame:
    """The kept columns and a reasons array of every row that breaks a rule; a rule that is null is broken."""
    reasons = F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items()]))
    return rows.select(*keep, reasons.alias("reasons")).where(F.size("reasons") > 0)


def reason_counts(found: DataFrame, by: list[str] | None = None) -> DataFrame:
    return found.select(*(by or []), F.explode("reasons").alias("reason")).groupBy(*(by or []), "reason").agg(F.count(F.lit(1)).alias("n_rows"))


def repeated_keys(rows: DataFrame, key: str) -> DataFrame:
    """(key, n): values found more than once."""
    return rows.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def roles_are(messages: Column, roles: list[str], optional_first: str | None = None) -> Column:
    """Whether a message list has exactly these roles, perhaps after an optional first one."""
    got = F.transform(messages, lambda m: m["role"])
    same = got.eqNullSafe(F.array(*map(F.lit, roles)))
    if optional_first:
        same = same | got.eqNullSafe(F.array(*map(F.lit, [optional_first, *roles])))
    return F.coalesce(same, F.lit(False))


def contents_filled(messages: Column) -> Column:
    """Whether every message has content beyond white space."""
    return F.coalesce(F.forall(messages, lambda m: strip(or_empty(m["content"])) != ""), F.lit(False))


def first_reason(reasons: list[tuple[str, Column]], otherwise: str) -> Column:
    """The name of the first condition that holds; conditions are tried in order."""
    out = F.when(F.lit(False), "")
    for name, cond in reasons:
        out = out.when(F.coalesce(cond, F.lit(False)), name)
    return out.otherwise(otherwise)


def coverage(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Full outer comparison of two key sets: (key, side) of the keys that only one has."""
    a = left.select(key).distinct().withColumn("__a", F.lit(True))
    b = right.select(key).distinct().withColumn("__b", F.lit(True))
    side = F.when(F.col("__b").isNull(), "only_left").when(F.col("__a").isNull(), "only_right")
    return a.join(b, key, "full_outer").select(key, side.alias("side")).where("side is not null")


def drift(left: DataFrame, right: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """(key, changed): rows of equal key whose columns differ, with the names of those columns."""
    b = right.select(F.col(key), *[F.col(c).alias(f"__{c}") for c in columns])
    changed = F.array_compact(F.array(*[F.when(~F.col(c).eqNullSafe(F.col(f"__{c}")), F.lit(c)) for c in columns]))
    return left.join(b, key).select(key, changed.alias("changed")).where(F.size("changed") > 0)


def revision_diff(old: DataFrame, new: DataFrame, key: str, content: str) -> DataFrame:
    """(key, change): retained, changed, added or removed between two revisions with one row a key."""
    a = old.select(F.col(key), F.col(content).alias("__old"), F.lit(True).alias("__a"))
    b = new.select(F.col(key), F.col(content).alias("__new"), F.lit(True).alias("__b"))
    change = F.when(F.col("__b").isNull(), "removed").when(F.col("__a").isNull(), "added").when(F.col("__old").eqNullSafe(F.col("__new")), "retained").otherwise("changed")
    return a.join(b, key, "full_outer").select(key, change.alias("change"))


def quota_violations(rows: DataFrame, groups: list[str], expected: int, values: dict[str, list[str]] | None = None) -> DataFrame:
    """(groups, n): combinations that do not have exactly the expected number of rows; with values also combinations without any row."""
    counts = rows.groupBy(*groups).agg(F.count(F.lit(1)).alias("n"))
    if values:
        every = rows.sparkSession.range(1).select()
        for g in groups:
            every = every.withColumn(g, F.explode(F.array(*map(F.lit, values[g]))))
        counts = every.join(counts, groups, "full_outer").withColumn("n", F.coalesce("n", F.lit(0)))
    return counts.where(F.col("n") != expected)
