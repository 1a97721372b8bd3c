"""Checks of rendered datasets, preference sets and recorded results, as violation tables."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from selvedge.functions.text import content_hash, norm_fast, or_empty, sha, strip
from selvedge.operators.ranking import global_rank
from selvedge.operators.validation import contents_filled, roles_are, violations


def rendered_violations(rendered: DataFrame) -> DataFrame:
    """(record_id, split, reason): repeated ids, lists that are not system, user, assistant, blank contents."""
    rules = {"roles": roles_are(F.col("messages"), ["system", "user", "assistant"]), "contents": contents_filled(F.col("messages"))}
    broken = violations(rendered, ["record_id", "split"], rules).select("record_id", "split", F.explode("reasons").alias("reason"))
    repeated = rendered.groupBy("record_id").agg(F.count(F.lit(1)).alias("n"), F.min("split").alias("split")).where("n > 1")
    return broken.unionByName(repeated.select("record_id", "split", F.lit("repeated_id").alias("reason")))


def artifact_violations(canonical: DataFrame, rendered: DataFrame, render: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(record_id, reason): rendered rows against a fresh rendering of the canonical ones.

    missing and unexpected ids, ids in another split, and contents that differ;
    a test record in the rendered set is unexpected, since none is rendered.
    """
    fresh = render(canonical).select("record_id", F.col("split").alias("want_split"), F.to_json("messages").alias("want"), F.lit(True).alias("__c"))
    found = rendered.select("record_id", F.col("split").alias("got_split"), F.to_json("messages").alias("got"), F.lit(True).alias("__r"))
    both = fresh.join(found, "record_id", "full_outer")
    reason = F.when(F.col("__r").isNull(), "missing").when(F.col("__c").isNull(), "unexpected").when(~F.col("want_split").eqNullSafe(F.col("got_split")), "other_split").when(~F.col("want").eqNullSafe(F.col("got")), "content_drift")
    return both.select("record_id", reason.alias("reason")).where("reason is not null")


def preference_violations(rows: DataFrame, protected: DataFrame, split_order: list[str]) -> DataFrame:
    """(record_id, reason) for a preference set (record_id, split, prompt, chosen, rejected) against protected hashes (h).

    A prompt may be in the set once; of repeated ones the first by split order and id stays.
    """
    place = F.coalesce(F.array_position(F.array(*map(F.lit, split_order)), F.col("split")), F.lit(0))
    keyed = rows.select("record_id", "split", "prompt", "chosen", "rejected", content_hash(F.col("prompt")).alias("h"), place.alias("place"))
    first = keyed.groupBy("h").agg(F.min(F.struct("place", "record_id")).alias("first"))
    ids = rows.groupBy("record_id").agg(F.count(F.lit(1)).alias("ids"))
    facts = keyed.join(first, "h").join(protected.select("h").distinct().withColumn("protected", F.lit(True)), "h", "left").join(ids, "record_id")
    rules = {
        "split": F.col("place") > 0,
        "repeated_id": F.col("ids") == 1,
        "blank": (strip(or_empty("prompt")) != "") & (strip(or_empty("chosen")) != "") & (strip(or_empty("rejected")) != ""),
        "identical_answers": norm_fast(or_empty("chosen")) != norm_fast(or_empty("rejected")),
        "protected_prompt": F.col("protected").isNull(),
        "repeated_prompt": (F.col("first.place") == F.col("place")) & (F.col("first.record_id") == F.col("record_id")),
    }
    return violations(facts, ["record_id"], rules).select("record_id", F.explode("reasons").alias("reason"))


def listed_rows(rows: DataFrame, key: str, ids: list[str]) -> DataFrame:
    """The rows of a short list of distinct ids, with their place in it; a missing or repeated id raises."""
    if len(set(ids)) != len(ids):
        raise ValueError("an id is listed twice")
    wanted = rows.sparkSession.createDataFrame(list(enumerate(ids)), f"place bigint, {key} string")
    found = rows.join(F.broadcast(wanted), key)
    n = found.select(key).distinct().count()
    if n != len(ids) or found.count() != n:
        raise ValueError(f"{n} of {len(ids)} listed ids are found once")
    return found


def positional_pairs(left: DataFrame, right: DataFrame, by_left: list[str], by_right: list[str]) -> DataFrame:
    """Row n of one table beside row n of the other; tables of different length raise."""
    a, b = global_rank(left, by_left, "place"), global_rank(right, by_right, "place")
    if a.count() != b.count():
        raise ValueError("the tables differ in length")
    return a.join(b, "place")


def selection_digest(rows: DataFrame, digest: str, by: list[str]) -> DataFrame:
    """One digest of a selection: the digests of its rows, a bounded sample, in the given order."""
    listed = F.sort_array(F.collect_list(F.struct(*by, F.col(digest).alias("__d"))))
    return rows.agg(sha(F.array_join(F.transform(listed, lambda x: x["__d"]), "")).alias("selection_sha256"), F.count(F.lit(1)).alias("n_rows"))


def threshold_checks(metrics: DataFrame, limits: dict[str, tuple[str, float]]) -> DataFrame:
    """metrics (variant, metric, value) to (variant, metric, value, passed); a limit is ("min", x) or ("max", x), null values fail."""
    spark = metrics.sparkSession
    listed = spark.createDataFrame([(m, kind, x) for m, (kind, x) in limits.items()], "metric string, kind string, bound double")
    ok = F.when(F.col("kind") == "min", F.col("value") >= F.col("bound")).otherwise(F.col("value") <= F.col("bound"))
    every = metrics.select("variant").distinct().crossJoin(F.broadcast(listed))  # variants times limits, both short lists
    return every.join(metrics, ["variant", "metric"], "left").select("variant", "metric", "value", F.coalesce(ok, F.lit(False)).alias("passed"))


def recomputed(recorded: DataFrame, computed: DataFrame, keys: list[str], values: list[str], tolerance: float = 0.0) -> DataFrame:
    """(keys, changed): recorded results that are missing, unexpected or other than those computed again."""
    b = computed.select(*keys, *[F.col(v).alias(f"__{v}") for v in values], F.lit(True).alias("__there"))
    a = recorded.select(*keys, *values, F.lit(True).alias("__here"))
    same = lambda v: F.col(v).eqNullSafe(F.col(f"__{v}")) | F.coalesce(F.abs(F.col(v) - F.col(f"__{v}")) <= tolerance, F.lit(False))
    changed = F.when(F.col("__here").isNull(), F.array(F.lit("unrecorded"))).when(F.col("__there").isNull(), F.array(F.lit("not_computed"))).otherwise(F.array_compact(F.array(*[F.when(~same(v), F.lit(v)) for v in values])))
    return a.join(b, keys, "full_outer").select(*keys, changed.alias("changed")).where(F.size("changed") > 0)


def last_with(rows: DataFrame, keys: list[str], step: str, filled: str) -> DataFrame:
    """The row with the largest step per key among those where a column is filled."""
    rest = [c for c in rows.columns if c not in (*keys, step)]
    return rows.where(F.col(filled).isNotNull()).groupBy(*keys).agg(F.max(F.struct(step, *rest)).alias("r")).select(*keys, "r.*")


def lexical_flags(text: Column, patterns: dict[str, list[str]]) -> Column:
    """Names of the pattern groups that a text matches, in order."""
    hit = lambda ps: reduce(lambda a, b: a | b, [or_empty(text).rlike(p) for p in ps])
    return F.array_compact(F.array(*[F.when(hit(ps), F.lit(name)) for name, ps in patterns.items()]))


def pending_fields(answered: Column, order: list[str], n: int) -> Column:
    """The first n fields of a fixed order that are not in an array of answered ones."""
    return F.slice(F.array_except(F.array(*map(F.lit, order)), F.coalesce(answered, F.array().cast("array<string>"))), 1, n)


def reconcile(expected: DataFrame, log: DataFrame, key: str, agree: dict[str, Column]) -> DataFrame:
    """(key, reasons): expected keys against an append log: missing, more than one entry, or a single entry that breaks a rule of agree."""
    facts = log.groupBy(key).agg(F.count(F.lit(1)).alias("__n"), *[F.min(F.coalesce(c, F.lit(False)).cast("int")).alias(f"__{k}") for k, c in agree.items()])
    once = expected.groupBy(key).agg(F.count(F.lit(1)).alias("__e"))
    single = F.col("__n") == 1
    reasons = [F.when(F.col("__e") > 1, F.lit("repeated_expected")), F.when(F.col("__n").isNull(), F.lit("missing_entry")), F.when(F.col("__n") > 1, F.lit("repeated_entry"))]
    reasons += [F.when(single & (F.col(f"__{k}") == 0), F.lit(k)) for k in agree]
    return once.join(facts, key, "left").select(key, F.array_compact(F.array(*reasons)).alias("reasons"))
