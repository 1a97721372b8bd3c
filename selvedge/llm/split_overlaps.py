"""Problem 7: records of evaluation splits that are also in train, exactly or almost.

Method: a bipartite join on rare shingles (see likeness.py): the prefixes of the
evaluation sets are matched with those of the training sets under length,
positional and suffix filters, and every pair of sets is verified once; verified
pairs of sets are then expanded to the rows that the report asks for.

Defined results: rows without a split are in neither side; a null or wordless
text overlaps nothing; equal rows each count; an empty table gives no rows;
other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from selvedge.llm.likeness import LIKE_SQL, likeness_links
from selvedge.session import table

TRAIN, HELD_OUT = 1, 2
TABLES = [("sft_records", "instruction"), ("preference_triples", "prompt")]


def overlapping_sets(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """rows (id, split, text) to (members (id, side, set_id, sides), ends (a, b)): training sets beside the held-out sets that they overlap."""
    side = F.when(F.col("split") == "train", TRAIN).when(F.col("split").isNotNull(), HELD_OUT)
    texts = rows.select("id", side.alias("side"), "text").where("side is not null and text rlike '[\\\\p{L}\\\\p{N}]'")
    members, links = likeness_links(texts)
    both = members.where("sides = 3").select(F.col("set_id").alias("a"), F.col("set_id").alias("b")).distinct()
    return members, links.unionAll(links.select("b", "a")).unionAll(both)


def cross_split_pairs(rows: DataFrame) -> DataFrame:
    """rows (id, split, text) to (train_id, held_out_id) of every overlapping pair of rows."""
    members, ends = overlapping_sets(rows)
    train = members.where(f"side = {TRAIN}").select(F.col("id").alias("train_id"), F.col("set_id").alias("a"))
    held_out = members.where(f"side = {HELD_OUT}").select(F.col("id").alias("held_out_id"), F.col("set_id").alias("b"))
    return ends.join(train, "a").join(held_out, "b").select("train_id", "held_out_id")


def overlap_report(rows: DataFrame) -> DataFrame:
    """rows (id, split, source, text) to (split, source, pairs, held_out_rows), counted from the rows of each set; no pair of rows is formed."""
    members, ends = overlapping_sets(rows)
    train = members.where(f"side = {TRAIN}").groupBy(F.col("set_id").alias("a")).agg(F.count(F.lit(1)).alias("n"))
    partners = ends.join(train, "a").groupBy("b").agg(F.sum("n").alias("n"))
    held_out = members.where(f"side = {HELD_OUT}").select("id", F.col("set_id").alias("b")).join(rows.select("id", "split", "source"), "id")
    held_out = held_out.groupBy("b", "split", "source").agg(F.count(F.lit(1)).alias("k"))
    return held_out.join(partners, "b").groupBy("split", "source").agg(F.sum(F.col("n") * F.col("k")).alias("pairs"), F.sum("k").alias("held_out_rows"))


def _pairs(spark: SparkSession, sf_dir: str, tbl: str, text: str) -> DataFrame:
    rows = table(spark, sf_dir, tbl).select(F.col("row_index").cast("bigint").alias("id"), "split", F.col(text).alias("text"))
    return cross_split_pairs(rows).select(F.lit(tbl).alias("tbl"), "train_id", "held_out_id")


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = [_pairs(spark, sf_dir, *t) for t in TABLES]
    return found[0].unionByName(found[1]).select("tbl", F.least("train_id", "held_out_id").alias("id_a"), F.greatest("train_id", "held_out_id").alias("id_b"))


def p7_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlaps per table, held-out split and source of the held-out row: pairs and held-out rows concerned."""
    parts = []
    for tbl, text in TABLES:
        source = F.col("source.source_dataset") if tbl == "sft_records" else F.substring_index("prompt_id", ",", 1)
        rows = table(spark, sf_dir, tbl).select(F.col("row_index").cast("bigint").alias("id"), "split", F.coalesce(source, F.lit("unknown")).alias("source"), F.col(text).alias("text"))
        parts.append(overlap_report(rows).select(F.lit(tbl).alias("tbl"), "split", "source", "pairs", "held_out_rows"))
    return parts[0].unionByName(parts[1])


QUERIES = {"p7_found": p7_found, "p7_report": p7_report}


def _sql(tbl: str, text: str) -> str:
    return f"""SELECT '{tbl}' AS tbl, least(a, b) AS id_a, greatest(a, b) AS id_b FROM (WITH t AS (SELECT row_index AS id, {text} AS text FROM {tbl} WHERE split IS NOT NULL AND {text} IS NOT NULL), {LIKE_SQL},
both_ends AS (SELECT a, b FROM alike UNION SELECT k, k FROM s WHERE k <> '')
SELECT x.id AS a, y.id AS b FROM both_ends JOIN w x ON x.k = both_ends.a JOIN w y ON y.k = both_ends.b JOIN {tbl} p ON p.row_index = x.id JOIN {tbl} q ON q.row_index = y.id WHERE p.split = 'train' AND q.split <> 'train')"""


_FOUND = " UNION ALL ".join(_sql(*t) for t in TABLES)
SQL = {
    "p7_found": _FOUND,
    "p7_report": f"""WITH f AS (SELECT tbl, id_a AS id, id_b AS other FROM ({_FOUND}) UNION ALL SELECT tbl, id_b, id_a FROM ({_FOUND})),
o AS (SELECT 'sft_records' AS tbl, row_index AS id, split, coalesce(source.source_dataset, 'unknown') AS source FROM sft_records UNION ALL SELECT 'preference_triples', row_index, split, coalesce(string_split(prompt_id, ',')[1], 'unknown') FROM preference_triples)
SELECT tbl, split, source, count(*) AS pairs, count(DISTINCT id) AS held_out_rows FROM f JOIN o USING (tbl, id) WHERE split <> 'train' GROUP BY ALL""",
}
