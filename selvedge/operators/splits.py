"""Split assignment, precedence and isolation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from selvedge.functions.text import content_hash, digest_int, norm_lower, or_empty, sha
from selvedge.operators.components import connected_components
from selvedge.operators.keyed import with_group_facts
from selvedge.operators.ranking import global_rank, quota_label, rank_within
from selvedge.session import materialize

#: Higher splits keep their records; lower ones give way.
PRECEDENCE = {"train": 0, "dev": 1, "validation": 1, "test": 2}


def split_rank(split: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in PRECEDENCE.items() for x in kv]), split)


def hash_split(text: Column, train: int = 70, validation: int = 85) -> Column:
    """Split by the first 8 hex digits of the lower-cased key's digest, in hundredths; equal keys share a split."""
    bucket = digest_int(sha(norm_lower(or_empty(text)))) % 100
    return F.when(bucket < train, "train").when(bucket < validation, "validation").otherwise("test")


def conversation_text(messages: Column) -> Column:
    """Contents of a message list, one a line; empty for a null list, null contents as empty."""
    return F.coalesce(F.array_join(F.transform(messages, lambda m: F.coalesce(m["content"], F.lit(""))), "\n"), F.lit(""))


def conversation_roles(messages: Column) -> Column:
    return F.coalesce(F.array_join(F.transform(messages, lambda m: F.coalesce(m["role"], F.lit("?"))), ","), F.lit(""))


def decision_index(triples: DataFrame) -> DataFrame:
    """One text-free row per preference triple with the decision on it.

    The order of the rules counts: empty prompt, test rows, prompts also in
    test, then dev rows (repeated or kept), prompts also in dev, repeated rows,
    kept rows. A repeated row is a later one of its split with equal prompt,
    chosen and rejected texts. The index is written once; facts of a prompt or
    text are aggregated before they are joined back.
    """
    texts = [or_empty("prompt"), conversation_text(F.col("chosen")), conversation_text(F.col("rejected"))]
    rows = materialize(
        triples.select(
            "split",
            "row_index",
            content_hash(F.col("prompt")).alias("prompt_group_sha256"),
            sha(F.to_json(F.struct(texts[1].alias("chosen"), texts[0].alias("prompt"), texts[2].alias("rejected")))).alias("preference_sha256"),
        )
    )
    ranked = with_group_facts(rows, ["prompt_group_sha256"], {"highest": F.max(split_rank(F.col("split")))})
    placed = with_group_facts(materialize(ranked), ["split", "preference_sha256"], {"first_row": F.min("row_index")})
    repeated = F.col("row_index") > F.col("first_row")
    decision = (
        F.when(F.col("prompt_group_sha256") == "", "excluded_empty_prompt")
        .when(F.col("split") == "test", "reserved_evaluation")
        .when(F.col("highest") == 2, "excluded_test_overlap")
        .when(F.col("split") == "dev", F.when(repeated, "excluded_exact_duplicate").otherwise("candidate_validation"))
        .when(F.col("highest") == 1, "excluded_dev_overlap")
        .when(repeated, "excluded_exact_duplicate")
        .otherwise("candidate_training")
    )
    return placed.select("split", "row_index", "prompt_group_sha256", "preference_sha256", repeated.alias("is_duplicate"), decision.alias("decision"))


def decision_counts(index: DataFrame) -> DataFrame:
    """Rows and distinct prompt groups per decision."""
    return index.groupBy("decision").agg(F.count(F.lit(1)).alias("n_rows"), F.countDistinct("prompt_group_sha256").alias("prompt_groups"))


def fill_split_quotas(records: DataFrame, source: str, previous: str, order: list, quotas: dict[str, dict[str, int]]) -> DataFrame:
    """records with assigned_split: a previous split is kept, the others fill what is left of their source's quotas in order.

    Records past the quotas, and those of a source without quotas, get null.
    """
    rows = materialize(records)
    taken = {(r[0], r[1]): r[2] for r in rows.where(F.col(previous).isNotNull()).groupBy(source, previous).count().collect()}
    left = {s: [(k, n - taken.get((s, k), 0)) for k, n in q.items()] for s, q in quotas.items()}
    if any(n < 0 for q in left.values() for _, n in q):
        raise ValueError("previous splits exceed the quotas")
    fresh = rank_within(rows.where(F.col(previous).isNull()), source, order, "place")
    label = F.lit(None).cast("string")
    for s, q in left.items():
        label = F.when(F.col(source) == s, quota_label(F.col("place"), q)).otherwise(label)
    filled = fresh.withColumn("assigned_split", label).drop("place")
    return rows.where(F.col(previous).isNotNull()).withColumn("assigned_split", F.col(previous)).unionByName(filled)


def group_splits(groups: DataFrame, group: str, protocol: str, counts: list[tuple[str, int]]) -> DataFrame:
    """(group, split): distinct groups in the order of their digest, cut into contiguous slices."""
    distinct = groups.select(group).where(F.col(group).isNotNull()).distinct().withColumn("key", sha(F.concat_ws(":", F.lit(protocol), F.col(group))))
    return global_rank(distinct, ["key", group], "place").select(group, quota_label(F.col("place"), counts).alias("split"))


def isolate_groups(records: DataFrame, keys: DataFrame) -> DataFrame:
    """records (record_id, split) and keys (record_id, key) to (record_id, split, component, kept).

    Records that share a key, directly or through others, are one component;
    only those of its highest split are kept. The component search runs on 128-bit
    digests of the ids and the component is the smallest of them; keys that only
    one record holds join nothing and are left out of it, and a record without
    keys is its own component.
    """
    node = F.md5(F.col("record_id"))
    ids = records.select("record_id", "split", node.alias("node"))
    held = keys.where("key is not null").select("key", node.alias("a")).distinct()
    owner = held.groupBy("key").agg(F.min("a").alias("b"), F.count(F.lit(1)).alias("n")).where("n > 1").select("key", "b")
    links = held.join(owner, "key").select("a", "b").distinct()
    found = connected_components(links)
    placed = materialize(ids.join(found, "node", "left").select("record_id", "split", F.coalesce("component", "node").alias("component"), split_rank(F.col("split")).alias("rank")))
    return with_group_facts(placed, ["component"], {"highest": F.max("rank")}).select("record_id", "split", "component", (F.col("rank") == F.col("highest")).alias("kept"))
