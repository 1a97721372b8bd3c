"""Ranks and samples that stay distributed.

A window without a partition, or with one that a third of all rows share, is
one task. Ranks over a whole table therefore come from a range-partitioned sort:
rows are numbered where they lie, and the counts of the sort's partitions, one
number each, give the offsets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from selvedge.session import materialize


def global_rank(df: DataFrame, by: list[Column | str], name: str = "rank") -> DataFrame:
    """df with its 0-based place in the order of by; ties need a last column that tells them apart."""

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, at = TaskContext.get().partitionId(), 0
        for b in batches:
            n = b.num_rows
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.full(n, part, np.int32)), pa.array(np.arange(at, at + n, dtype=np.int64))], names=[*b.schema.names, "__part", "__at"])
            at += n

    schema = T.StructType([*df.schema.fields, T.StructField("__part", T.IntegerType()), T.StructField("__at", T.LongType())])
    placed = materialize(df.orderBy(*by).mapInArrow(number, schema))
    offsets, total = [], 0
    for r in sorted(placed.groupBy("__part").agg(F.count(F.lit(1)).alias("n")).collect()):
        offsets.append((r["__part"], total))
        total += r.n
    start = df.sparkSession.createDataFrame(offsets, "__part int, __start bigint")
    return placed.join(F.broadcast(start), "__part").withColumn(name, F.col("__start") + F.col("__at")).drop("__part", "__start", "__at")


def rank_within(df: DataFrame, group: str, by: list[Column | str], name: str = "rank") -> DataFrame:
    """df with its 0-based place within group; a hot group is ranked by many tasks."""
    ranked = global_rank(df, [group, *by], "__rank")
    first = ranked.groupBy(group).agg(F.min("__rank").alias("__first"))
    same = ranked[group].eqNullSafe(first[group])
    return ranked.join(first, same).drop(first[group]).withColumn(name, F.col("__rank") - F.col("__first")).drop("__rank", "__first")


def smallest(df: DataFrame, by: list[Column | str], n: int) -> DataFrame:
    """The first n rows by the given order: each task keeps n."""
    return df.orderBy(*by).limit(n)


def smallest_per_group(df: DataFrame, groups: list[str], by: list[Column | str], k: int, name: str = "rank") -> DataFrame:
    """The first k rows of each group, numbered from 1; each task keeps k of a group before the shuffle."""
    w = Window.partitionBy(*groups).orderBy(*by)
    return df.withColumn(name, F.row_number().over(w)).where(F.col(name) <= k)


def round_robin(df: DataFrame, group: str, by: list[Column | str], n: int) -> DataFrame:
    """The first n rows when groups take turns in name order: every first row, then every second."""
    ranked = smallest_per_group(df, [group], by, n, "turn")
    return ranked.orderBy("turn", group).limit(n)


def largest_remainder(sizes: list[tuple[str, int]], n: int) -> dict[str, int]:
    """How many of n go to each stratum in proportion to its size; remainders by size of the fraction, ties by name."""
    total = sum(s for _, s in sizes)
    if not 0 <= n <= total:
        raise ValueError("sample is larger than the population")
    share = {k: divmod(s * n, total) if total else (0, 0) for k, s in sizes}
    out = {k: q for k, (q, _) in share.items()}
    for k in sorted(share, key=lambda k: (-share[k][1], k))[: n - sum(out.values())]:
        out[k] += 1
    return out


def stratified(df: DataFrame, stratum: str, by: list[Column | str], n: int) -> DataFrame:
    """n rows spread over the strata by largest remainder, the first of each by the given order."""
    sizes = [(r[0], r[1]) for r in df.groupBy(stratum).count().where(F.col(stratum).isNotNull()).collect()]
    quota = largest_remainder(sizes, n)
    quotas = df.sparkSession.createDataFrame(list(quota.items()), f"{stratum} string, quota int")
    kept = smallest_per_group(df.where(F.col(stratum).isNotNull()), [stratum], by, max(quota.values(), default=0), "place")
    return kept.join(F.broadcast(quotas), stratum).where("place <= quota").drop("quota")


def quota_label(rank: Column, quotas: list[tuple[str, int]]) -> Column:
    """The label whose cumulative quota holds a 0-based rank; null past the last."""
    out, total = F.when(F.lit(False), ""), 0
    for label, n in quotas:
        total += n
        out = out.when(rank < total, label)
    return out


def batches(df: DataFrame, by: list[Column | str], size: int, name: str = "batch") -> DataFrame:
    """df cut into batches of size rows in the given order."""
    return global_rank(df, by, "place").withColumn(name, F.floor(F.col("place") / size).cast("bigint"))
