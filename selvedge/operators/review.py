"""Blinded review queues and decisions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from selvedge.functions.text import stable_key
from selvedge.operators.ranking import global_rank
from selvedge.session import materialize


def blinded_queue(responses: DataFrame, seed: int) -> tuple[DataFrame, DataFrame]:
    """responses (scenario_id, variant, response) to (queue, key).

    The queue has no variant and is in the order of a seeded digest; the key
    maps each review_id back. Repeated responses of one variant and scenario
    have one review_id and stay one entry.
    """
    digest = F.sha2(F.coalesce("response", F.lit("")), 256)
    review_id = F.substring(F.sha2(F.concat_ws("\u0000", F.col("variant"), F.col("scenario_id").cast("string"), digest), 256), 1, 24)
    rows = materialize(responses.select("scenario_id", "variant", "response", digest.alias("response_sha256"), review_id.alias("review_id")).dropDuplicates(["review_id"]))
    key = rows.select("review_id", "scenario_id", "variant", "response_sha256")
    order = rows.select("review_id", "scenario_id", "response", stable_key(str(seed), F.col("review_id")).alias("shuffle"))
    return global_rank(order, ["shuffle", "review_id"], "place").drop("shuffle"), key


def decision_violations(queue: DataFrame, clear: DataFrame, flagged: DataFrame, flags: list[str]) -> DataFrame:
    """(review_id, reason): ids not covered exactly once, unknown or repeated flags, missing rationale.

    clear (review_id), flagged (review_id, flags, rationale).
    """
    said = clear.select("review_id").unionByName(flagged.select("review_id")).groupBy("review_id").agg(F.count(F.lit(1)).alias("n"))
    ids = queue.select(F.col("review_id").alias("known")).distinct()
    both = ids.join(said, ids.known == said.review_id, "full_outer")
    cover = F.when(F.col("known").isNull(), "unknown_id").when(F.col("n").isNull(), "not_reviewed").when(F.col("n") > 1, "reviewed_twice")
    covered = both.select(F.coalesce("known", "review_id").alias("review_id"), cover.alias("reason"))
    bad = F.when(F.size("flags") == 0, "no_flag").when(F.size(F.array_except("flags", F.array(*map(F.lit, flags)))) > 0, "unknown_flag").when(F.size(F.array_distinct("flags")) < F.size("flags"), "repeated_flag").when(F.trim(F.coalesce("rationale", F.lit(""))) == "", "no_rationale")
    return covered.unionByName(flagged.select("review_id", bad.alias("reason"))).where("reason is not null")


def flag_counts(key: DataFrame, flagged: DataFrame, flags: list[str]) -> DataFrame:
    """Per variant: entries, entries with each flag, and entries with any flag."""
    joined = key.join(flagged.select("review_id", "flags"), "review_id", "left")
    has = lambda f: F.coalesce(F.array_contains("flags", f), F.lit(False)).cast("bigint")
    return joined.groupBy("variant").agg(F.count(F.lit(1)).alias("entries"), *[F.sum(has(f)).alias(f) for f in flags], F.sum((F.coalesce(F.size("flags"), F.lit(0)) > 0).cast("bigint")).alias("flagged"))
