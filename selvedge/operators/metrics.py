"""Aggregates over model observations and audit logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from selvedge.operators.ranking import rank_within

LEVELS = ["deferred", "moderate", "maximum"]


def finite(*columns: str) -> Column:
    out = F.lit(True)
    for c in columns:
        v = F.col(c).cast("double")
        out = out & v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf"))
    return out


def loss_summary(losses: DataFrame, groups: list[list[str]], columns: list[str]) -> DataFrame:
    """Token-weighted losses for several groupings in one pass.

    Sums are decimal, so they do not depend on the order of the rows.
    """
    exact = lambda c: F.sum(F.col(c).cast("decimal(28,6)")).cast("double")
    tokens = F.sum("completion_tokens")
    nll = exact("completion_nll_sum") / tokens
    good = losses.where(finite("completion_nll_sum", "sequence_nll_sum") & (F.col("completion_tokens") > 0) & (F.col("sequence_tokens") > 0))
    return good.groupingSets([[F.col(c) for c in g] for g in groups], *columns).agg(
        F.grouping_id().alias("grouping"),
        F.count(F.lit(1)).alias("records"),
        tokens.alias("completion_tokens"),
        F.round(nll, 6).alias("completion_nll"),
        F.round(F.exp(F.least(nll, F.lit(700.0))), 6).alias("completion_perplexity"),
        F.round(exact("sequence_nll_sum") / F.sum("sequence_tokens"), 6).alias("sequence_nll"),
    )


def latest(rows: DataFrame, keys: list[str], order: list[str], values: list[str]) -> DataFrame:
    """The values of the last row per key by the given order; combined before the shuffle."""
    return rows.groupBy(*keys).agg(F.max(F.struct(*order, *[v for v in values if v not in order])).alias("r")).select(*keys, *[f"r.{v}" for v in values])


def paired_wins(losses: DataFrame, base: str) -> DataFrame:
    """Per variant: records shared with the base, records with a lower loss, and inputs that differ.

    losses has one row per (variant, record_id) with input_sha256 and completion_nll_sum.
    """
    b = losses.where(F.col("variant") == base).select("record_id", F.col("completion_nll_sum").alias("base_nll"), F.col("input_sha256").alias("base_input"))
    return losses.join(b, "record_id").groupBy("variant").agg(
        F.count(F.lit(1)).alias("paired"),
        F.sum((F.col("completion_nll_sum") < F.col("base_nll")).cast("bigint")).alias("lower_than_base"),
        F.sum((~F.col("input_sha256").eqNullSafe(F.col("base_input"))).cast("bigint")).alias("input_differs"),
    )


def in_every_variant(rows: DataFrame, key: str, variant: str, ok: Column, variants: int) -> DataFrame:
    """Keys with a row in each of the variants, all of them ok."""
    return rows.groupBy(key).agg(F.countDistinct(variant).alias("__v"), F.min(ok.cast("int")).alias("__ok")).where(f"__v = {variants} and __ok = 1").select(key)


def nearest_rank(rows: DataFrame, group: str, value: str, tie: str, percents: list[int]) -> DataFrame:
    """Nearest-rank percentiles (the ceil(n p / 100)-th value) and the upper median (value n div 2) per group.

    The group's values are ranked by a distributed sort, so a group of any size fits.
    """
    good = rows.where(finite(value)).select(group, value, tie)
    sizes = good.groupBy(group).agg(F.count(F.lit(1)).alias("n"))
    ranked = rank_within(good, group, [value, tie], "place").join(sizes, group)
    picks = [F.max(F.when(F.col("place") == F.ceil(F.col("n") * p / 100) - 1, F.col(value))).alias(f"p{p}") for p in percents]
    upper = F.max(F.when(F.col("place") == F.expr("n div 2"), F.col(value))).alias("upper_median")
    return ranked.groupBy(group).agg(F.max("n").alias("n"), *picks, upper)


def length_summary(lengths: DataFrame, column: str, limit: int, percents: list[int]) -> DataFrame:
    """Percentiles of whole numbers at the half-even rounded index, largest value and how many exceed a limit.

    Works on the histogram of the values, which has as many rows as there are
    distinct lengths, not on the rows.
    """
    histogram = lengths.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("v")).agg(F.count(F.lit(1)).alias("k"))
    total = histogram.agg(F.sum("k").alias("n"), F.max("v").alias("maximum"), F.sum(F.when(F.col("v") > limit, F.col("k")).otherwise(0)).alias("over_limit"))
    # a running sum over a table with one row a length
    upto = histogram.select("v", F.sum("k").over(Window.orderBy("v")).alias("upto"))
    both = upto.crossJoin(F.broadcast(total))
    picks = [F.min(F.when(F.col("upto") > F.bround((F.col("n") - 1) * p / 100.0), F.col("v"))).alias(f"p{p}") for p in percents]
    return both.agg(F.max("n").alias("n"), *picks, F.max("maximum").alias("maximum"), F.max("over_limit").alias("over_limit"))


def confusion(pairs: DataFrame, levels: list[str] = LEVELS) -> DataFrame:
    """(expected, predicted, n) for every pair of levels, zeros included; other levels are left out."""
    spark = pairs.sparkSession
    grid = spark.createDataFrame([(e, p) for e in levels for p in levels], "expected string, predicted string")
    counts = pairs.where(F.col("expected").isin(levels) & F.col("predicted").isin(levels)).groupBy("expected", "predicted").agg(F.count(F.lit(1)).alias("n"))
    return grid.join(counts, ["expected", "predicted"], "left").select("expected", "predicted", F.coalesce("n", F.lit(0)).alias("n"))


def level_metrics(pairs: DataFrame, levels: list[str] = LEVELS) -> DataFrame:
    """Exact rate, recall of the highest level (null without one), pairs ranked too low and too high, invalid pairs."""
    place = F.create_map(*[x for k, v in enumerate(levels) for x in (F.lit(v), F.lit(k))])
    e, p = F.try_element_at(place, F.col("expected")), F.try_element_at(place, F.col("predicted"))
    number = lambda c: F.sum(F.coalesce(c, F.lit(False)).cast("bigint"))
    top = F.col("expected") == levels[-1]
    return pairs.agg(
        F.count(F.lit(1)).alias("total"),
        (number(e == p) / F.count(F.lit(1))).alias("exact_rate"),
        F.try_divide(number(top & (e == p)), number(top)).alias("top_recall"),
        number(p < e).alias("too_low"),
        number(p > e).alias("too_high"),
        number(p.isNull() | e.isNull()).alias("invalid"),
    )


def pareto(metrics: DataFrame, base: str) -> DataFrame:
    """metrics (variant, metric, value, lower_is_better) to (variant, worse, better, selected).

    A variant is selected when no metric is worse than the base's and at least one is better.
    """
    b = metrics.where(F.col("variant") == base).select("metric", F.col("value").alias("base_value"))
    gain = F.when(F.col("lower_is_better"), F.col("base_value") - F.col("value")).otherwise(F.col("value") - F.col("base_value"))
    n = metrics.where(F.col("variant") != base).join(b, "metric").groupBy("variant").agg(F.sum((gain < 0).cast("bigint")).alias("worse"), F.sum((gain > 0).cast("bigint")).alias("better"))
    return n.withColumn("selected", (F.col("worse") == 0) & (F.col("better") > 0))


def generation_summary(rows: DataFrame, groups: list[str], tokens: str, output: str, reference: str, eos: list[int], cap: int) -> DataFrame:
    """Empty outputs, outputs ended by an end token or by the cap, exact matches and 4-gram repetition, rolled up over groups."""
    from selvedge.functions.arrays import repeated_ngram_fraction
    from selvedge.functions.text import norm_fast, or_empty, strip

    count = lambda c: F.sum(F.coalesce(c, F.lit(False)).cast("bigint"))
    last = F.try_element_at(F.col(tokens), F.lit(-1))
    return rows.rollup(*groups).agg(
        F.count(F.lit(1)).alias("records"),
        count(strip(or_empty(output)) == "").alias("empty_outputs"),
        count(last.isin(eos)).alias("ended"),
        count(F.size(tokens) == cap).alias("reached_cap"),
        count(norm_fast(or_empty(output)) == norm_fast(or_empty(reference))).alias("exact_matches"),
        F.round(F.avg(repeated_ngram_fraction(F.col(tokens), 4)), 6).alias("repetition"),
    )
