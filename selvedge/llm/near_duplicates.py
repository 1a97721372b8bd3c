"""Problem 6: groups of records that share most of their words.

Method: rare-first prefix filtering with length, positional and suffix filters,
joined on prefix n-grams and verified once per pair (see likeness.py), then
connected components of the verified links.

Records are instruction and response of sft_records together, null as empty.
Defined results: records with equal word sets, also without any word, are in one
group; a record like no other has no group; repeated rows are group members of
their own; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from selvedge.llm.likeness import LIKE_SQL, likeness_classes
from selvedge.session import materialize, table


def near_duplicate_groups(texts: DataFrame) -> DataFrame:
    """(id, group_id): every row of texts (id, text) that has a group; the smallest id of a group's sets names it."""
    members, classes = likeness_classes(texts)
    # sets without a link are groups only when they have more than one member
    copies = members.groupBy("set_id").agg(F.count(F.lit(1)).alias("copies"))
    sets = copies.join(classes, "set_id", "left").where("copies > 1 or class_id is not null").select("set_id", F.coalesce("class_id", "set_id").alias("group_id"))
    return members.select("id", "set_id").join(sets, "set_id").select("id", "group_id")


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat_ws(" ", F.coalesce("instruction", F.lit("")), F.coalesce("response", F.lit("")))
    return table(spark, sf_dir, "sft_records").select(F.col("row_index").cast("bigint").alias("id"), text.alias("text"))


def p6_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicate_groups(_records(spark, sf_dir))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    grouped = materialize(p6_groups(spark, sf_dir))
    a = grouped.select("group_id", F.col("id").alias("id_a"))
    b = grouped.select("group_id", F.col("id").alias("id_b"))
    return a.join(b, "group_id").where("id_a < id_b").select("id_a", "id_b")


QUERIES = {"p6_found": p6_found, "p6_groups": p6_groups}
_GROUPS = f"""WITH RECURSIVE t AS (SELECT row_index AS id, coalesce(instruction, '') || ' ' || coalesce(response, '') AS text FROM sft_records), {LIKE_SQL},
edges AS (SELECT a.id AS a, b.id AS b FROM alike JOIN w a ON a.k = alike.a JOIN w b ON b.k = alike.b WHERE a.id <> b.id UNION ALL SELECT x.id, y.id FROM w x JOIN w y ON x.k = y.k AND x.id <> y.id),
r(id, c) AS (SELECT id, id FROM w UNION SELECT edges.b, r.c FROM r JOIN edges ON r.id = edges.a WHERE r.c < edges.b), g AS (SELECT id, min(c) AS c FROM r GROUP BY id)"""
SQL = {
    "p6_found": f"{_GROUPS} SELECT x.id AS id_a, y.id AS id_b FROM g x JOIN g y ON x.c = y.c AND x.id < y.id",
    "p6_groups": f"{_GROUPS} SELECT id, c AS group_id FROM g WHERE c IN (SELECT c FROM g GROUP BY c HAVING count(*) > 1)",
}
