"""Greedy selection under duplicate keys and quotas.

The rule is sequential: rows are taken in digest order, a row is skipped when a
row taken before has its first or its second key, and taking stops at the
quota. Rows that are skipped block nothing. Three facts make it distributed:
only the first of the rows with both keys equal can ever be taken; a row that
comes first among the undecided rows of both its keys is taken; a row that
shares a key with a taken row is out. Rounds of these two steps give exactly
the sequential result.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from selvedge.operators.ranking import global_rank, smallest
from selvedge.session import discard, materialize


def greedy_by_two_keys(rows: DataFrame) -> DataFrame:
    """rows (ord, id, k1, k2) to the (ord, id, k1, k2) taken by the sequential rule without a quota.

    ord orders the rows, id breaks ties; rows with a null key are left out.
    """
    one = rows.where("k1 is not null and k2 is not null").groupBy("k1", "k2").agg(F.min(F.struct("ord", "id")).alias("o"))
    open_rows = materialize(one.select("o", "k1", "k2"))
    taken: list[DataFrame] = []
    while not open_rows.isEmpty():
        first1 = open_rows.groupBy("k1").agg(F.min("o").alias("o1"))
        first2 = open_rows.groupBy("k2").agg(F.min("o").alias("o2"))
        now = materialize(open_rows.join(first1, "k1").join(first2, "k2").where("o = o1 and o = o2").select("o", "k1", "k2"))
        rest = materialize(open_rows.join(now.select("k1"), "k1", "left_anti").join(now.select("k2"), "k2", "left_anti").select("o", "k1", "k2"))
        discard(open_rows)
        taken.append(now)
        open_rows = rest
    empty = rows.limit(0).select("ord", "id", "k1", "k2")
    return reduce(DataFrame.unionByName, [t.select("o.ord", "o.id", "k1", "k2") for t in taken], empty)


def select_sources(candidates: DataFrame, quotas: list[tuple[str, int]]) -> DataFrame:
    """candidates (source, ord, id, k1, k2) to the taken (source, ord, id, k1, k2), source after source.

    Keys taken by one source block the later ones; rows past a quota do not.
    A source that cannot fill its quota raises.
    """
    out: list[DataFrame] = []
    for source, quota in quotas:
        rows = candidates.where(F.col("source") == source).select("ord", "id", "k1", "k2")
        for before in out:
            rows = rows.join(before.select("k1"), "k1", "left_anti").join(before.select("k2"), "k2", "left_anti")
        taken = global_rank(greedy_by_two_keys(rows), ["ord", "id"], "place").where(F.col("place") < quota)  # a quota may be any share of a source
        got = materialize(taken.select(F.lit(source).alias("source"), "ord", "id", "k1", "k2"))
        if got.count() < quota:
            raise ValueError(f"source {source} has {got.count()} of {quota} records")
        out.append(got)
    return reduce(DataFrame.unionByName, out)


def first_of_key(rows: DataFrame, key: str, order: list[str], n: int | None = None) -> DataFrame:
    """The first row of each non-empty key by the given order, of these the first n."""
    kept = [c for c in rows.columns if c not in order and c != key]
    first = rows.where(F.col(key) != "").groupBy(key).agg(F.min(F.struct(*order, *kept)).alias("r")).select(key, "r.*")
    return smallest(first, order, n) if n is not None else first
