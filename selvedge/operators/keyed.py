"""Per-key facts brought back to the rows, safe for hot keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A key is hot with more than this share of the rows, so at most 1/HOT_SHARE keys are ever broadcast.
HOT_SHARE = 0.001


def with_group_facts(rows: DataFrame, keys: list[str], facts: dict[str, Column]) -> DataFrame:
    """rows (a materialised, narrow table) with aggregates of their key.

    Facts are aggregated before the shuffle. Hot keys are looked up in a
    broadcast of at most 1/HOT_SHARE rows, the others joined on the key, so no
    task gets all rows of a hot key. Null keys match each other.
    """
    total = rows.count()
    stats = rows.groupBy(*keys).agg(*[c.alias(n) for n, c in facts.items()], F.count(F.lit(1)).alias("__n"))
    is_hot = F.col("__n") > F.lit(max(1, int(total * HOT_SHARE)))
    hot = stats.where(is_hot).select(*[F.col(k).alias(f"__{k}") for k in keys], *facts, F.lit(True).alias("__hot"))
    cold = stats.where(~is_hot).select(*[F.col(k).alias(f"__{k}") for k in keys], *facts)
    on = [rows[k].eqNullSafe(F.col(f"__{k}")) for k in keys]
    looked = rows.join(F.broadcast(hot), on, "left")
    drop = [f"__{k}" for k in keys]
    done = looked.where("__hot").drop(*drop, "__hot")
    rest = looked.where("__hot is null").select(*rows.columns)
    on = [rest[k].eqNullSafe(F.col(f"__{k}")) for k in keys]
    return done.unionByName(rest.join(cold, on).drop(*drop))


def look_up(rows: DataFrame, facts: DataFrame, keys: list[str]) -> DataFrame:
    """Inner join of rows (a materialised table) with facts on keys, where a key may hold any share of the rows.

    Facts of keys with more than HOT_SHARE of the rows, at most 1/HOT_SHARE of
    them when facts has one row a key, are broadcast; the others are joined.
    """
    total = rows.count()
    hot = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") > max(1, int(total * HOT_SHARE))).select(*keys)
    found = hot.toArrow()
    if not found.num_rows:
        return rows.join(facts, keys)
    held = F.broadcast(rows.sparkSession.createDataFrame(found))
    return rows.join(F.broadcast(facts.join(held, keys)), keys).unionByName(rows.join(held, keys, "left_anti").join(facts, keys))


def cross_group_overlap(rows: DataFrame, group: str, key: str) -> DataFrame:
    """(left_group, right_group, shared): distinct keys found in both groups, for every pair of groups."""
    sets = rows.where((F.col(key) != "") & F.col(group).isNotNull()).groupBy(key).agg(F.sort_array(F.collect_set(group)).alias("groups")).where("size(groups) > 1")
    pairs = F.expr("flatten(transform(groups, (a, i) -> transform(slice(groups, i + 2, size(groups)), b -> struct(a as left_group, b as right_group))))")
    return sets.select(F.explode(pairs).alias("p")).groupBy("p.left_group", "p.right_group").agg(F.count(F.lit(1)).alias("shared"))


def spanning_keys(rows: DataFrame, key: str, group: str) -> DataFrame:
    """(key, groups): keys found in more than one group."""
    return rows.groupBy(key).agg(F.countDistinct(group).alias("groups")).where("groups > 1")
