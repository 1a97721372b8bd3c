"""Problem 3: records that differ only in whitespace, case, punctuation or field order.

Method: an incremental ledger. Every record gets a 128-bit key of its canonical
form. A ledger is a table on disk with one row per (tbl, key): the number of
copies seen so far and the earliest representative, in hash buckets of one file
set each. A new delivery is aggregated by itself (map-side combine, so a hot key
costs one row per task); only the buckets that it touches are read, joined
full-outer with it and written anew; counts add up and the smaller id stays.

A ledger folder holds data/<version>/slot=<bucket> and manifests/<version>.json.
The manifest of the last version names the folder of every bucket and the
deliveries that are in. It appears by one rename when all its buckets are
written, so a delivery that fails leaves the ledger as it was, one that is
merged twice counts once, and of two writers one fails.

Defined results: a null text or invalid JSON has no key and is never a copy;
blank texts (nothing but whitespace and punctuation) share the empty key and are
copies of each other; repeated ids count once per row; an empty table gives an
empty ledger; other columns, whatever their names, are never read.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable, Iterator
from functools import reduce

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from selvedge.session import materialize, shared_dir, table, track

NOT_TEXT = r"[^\p{L}\p{N}\p{M}]+"
#: Ledger buckets; a ledger of B bytes is best kept in about B / 256 MB of them.
BUCKETS = 64
#: A key is hot when it holds more than this share of all rows, so there are at most 1/HOT_SHARE hot keys.
HOT_SHARE = 0.001

LEDGER = "bucket int, tbl string, key binary, copies bigint, keep_id bigint"

_STRIP = regex.compile(NOT_TEXT)


def canonical_text(c: Column) -> Column:
    """Letters and digits of the text without case; null stays null."""
    folded = F.translate(F.replace(F.lower(c), F.lit("ß"), F.lit("ss")), "ς", "σ")
    return F.regexp_replace(folded, NOT_TEXT, "")


def canonical_object(value) -> str:
    """One string per JSON value: fields sorted by name, scalars reduced to letters and digits."""
    if isinstance(value, dict):
        return "{" + ",".join(f"{json.dumps(k)}:{canonical_object(value[k])}" for k in sorted(value)) + "}"
    if isinstance(value, list):
        return "[" + ",".join(map(canonical_object, value)) + "]"
    if isinstance(value, str):
        return "s" + _STRIP.sub("", value.lower().replace("ß", "ss").replace("ς", "σ"))
    return "v" + json.dumps(value)


def _reject(token: str):
    raise ValueError(token)


@F.pandas_udf(T.StringType())
def canonical_json(payloads: pd.Series) -> pd.Series:
    """canonical_object() of each valid JSON object; null for anything else."""
    out = []
    for p in payloads:
        try:
            v = json.loads(p, parse_constant=_reject) if p is not None else None
            out.append(canonical_object(v) if isinstance(v, dict) else None)
        except (ValueError, RecursionError):
            out.append(None)
    return pd.Series(out, dtype=object)


def keyed(df: DataFrame, tbl: str, id_col: str, canonical: Column) -> DataFrame:
    """(tbl, id, key): the rows that have a canonical form, with its 128-bit key."""
    return df.select(
        F.lit(tbl).alias("tbl"), F.col(id_col).cast("bigint").alias("id"), F.unhex(F.md5(canonical)).alias("key")
    ).where(F.col("key").isNotNull())


def delivery_ledger(rows: DataFrame) -> DataFrame:
    """The ledger of one delivery of keyed rows."""
    return rows.groupBy("tbl", "key").agg(F.count(F.lit(1)).alias("copies"), F.min("id").alias("keep_id")).select(
        F.pmod(F.xxhash64("key"), F.lit(BUCKETS)).cast("int").alias("bucket"), "tbl", "key", "copies", "keep_id"
    )


def merge_ledgers(old: DataFrame, new: DataFrame) -> DataFrame:
    """Full outer join on bucket and key: counts add up, the earliest representative stays."""
    o, n = old.alias("o"), new.alias("n")
    on = [F.col(f"o.{c}") == F.col(f"n.{c}") for c in ("bucket", "tbl", "key")]
    both = [F.coalesce(f"o.{c}", f"n.{c}").alias(c) for c in ("bucket", "tbl", "key")]
    count = lambda side: F.coalesce(F.col(f"{side}.copies"), F.lit(0))
    return o.join(n, reduce(lambda a, b: a & b, on), "full_outer").select(
        *both, (count("o") + count("n")).alias("copies"), F.least("o.keep_id", "n.keep_id").alias("keep_id")
    )


def run_deliveries(deliveries: Iterable[DataFrame]) -> DataFrame:
    """The ledger of deliveries of keyed rows, in one plan and without a folder."""
    return reduce(merge_ledgers, map(delivery_ledger, deliveries))


class Ledger:
    """A ledger below path, which all executors share."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.fs = self._file("").getFileSystem(spark._jsc.hadoopConfiguration())

    def _file(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")

    def manifest(self) -> dict:
        """Version, deliveries and bucket folders of the last version; of an absent ledger version 0."""
        folder = self._file("manifests")
        found = [f.getPath().getName() for f in self.fs.listStatus(folder)] if self.fs.exists(folder) else []
        versions = sorted(int(n[:-5]) for n in found if n.endswith(".json") and n[:-5].isdigit())
        if not versions:
            return {"version": 0, "deliveries": [], "buckets": {}}
        text = self.spark.read.text(f"{self.path}/manifests/{versions[-1]}.json", wholetext=True).first()[0]
        return json.loads(text)

    def read(self, buckets: list[int] | None = None) -> DataFrame:
        """The rows of the given buckets, or of all; no other file is opened."""
        known = self.manifest()["buckets"]
        paths = [f"{self.path}/{folder}" for k, folder in known.items() if buckets is None or int(k) in buckets]
        if not paths:
            return self.spark.createDataFrame([], LEDGER)
        return self.spark.read.schema(LEDGER).parquet(*paths)

    def merge(self, rows: DataFrame, delivery: str) -> list[int]:
        """Add one delivery of keyed rows; returns the buckets it touched, none when the delivery is in already."""
        before = self.manifest()
        if delivery in before["deliveries"]:
            return []
        new = materialize(delivery_ledger(rows))
        touched = sorted(r.bucket for r in new.select("bucket").distinct().collect())  # BUCKETS at most
        version = before["version"] + 1
        merged = merge_ledgers(self.read(touched), new)
        folder = f"data/{version}-{uuid.uuid4().hex[:8]}"
        # one task writes a bucket, whose size BUCKETS bounds
        merged.withColumn("slot", F.col("bucket")).repartition("bucket").write.mode("errorifexists").partitionBy("slot").parquet(f"{self.path}/{folder}")
        after = {"version": version, "deliveries": [*before["deliveries"], delivery], "buckets": before["buckets"] | {str(k): f"{folder}/slot={k}" for k in touched}}
        self._publish(version, json.dumps(after))
        return touched

    def _publish(self, version: int, text: str) -> None:
        part = self._file(f"manifests/{version}.{uuid.uuid4().hex}.part")
        stream = self.fs.create(part)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()
        final = self._file(f"manifests/{version}.json")
        if self.fs.exists(final) or not self.fs.rename(part, final):
            raise RuntimeError(f"another delivery wrote version {version} of the ledger")


def copies_of(rows: DataFrame, ledger: DataFrame, total: int) -> DataFrame:
    """(tbl, keep_id, copy_id): every keyed row that is not the representative of its set.

    Keys with more than HOT_SHARE of all rows (at most 1/HOT_SHARE of them, so
    the broadcast is bounded whatever the data) are looked up map-side; the
    others are joined on bucket and key.
    """
    repeated = ledger.where("copies > 1")
    is_hot = F.col("copies") > F.lit(max(1, int(total * HOT_SHARE)))
    hot = repeated.where(is_hot).select("tbl", "key", F.col("keep_id").alias("hot_keep"))
    cold = repeated.where(~is_hot).select("tbl", "key", "keep_id")
    looked = rows.join(F.broadcast(hot), ["tbl", "key"], "left")
    hot_rows = looked.where("hot_keep is not null").select("tbl", F.col("hot_keep").alias("keep_id"), "id")
    cold_rows = looked.where("hot_keep is null").join(cold, ["tbl", "key"]).select("tbl", "keep_id", "id")
    return hot_rows.unionByName(cold_rows).where("id <> keep_id").select("tbl", "keep_id", F.col("id").alias("copy_id"))


def keyed_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keyed rows of the three tables, written once: 16 bytes of key a row instead of its text."""
    sft = table(spark, sf_dir, "sft_records")
    pref = table(spark, sf_dir, "preference_triples")
    raw = table(spark, sf_dir, "raw_payloads")
    parts = [
        keyed(sft, "sft_records", "row_index", canonical_text(F.col("instruction"))),
        keyed(pref, "preference_triples", "row_index", canonical_text(F.col("prompt"))),
        keyed(raw, "raw_payloads", "raw_id", canonical_json(F.col("payload"))),
    ]
    return materialize(reduce(DataFrame.unionByName, parts))


def deliveries_by_id(rows: DataFrame, tbl_bounds: dict[str, int]) -> Iterator[DataFrame]:
    """Two deliveries: the ids up to the given bound of each table, and the later ones."""
    early = reduce(lambda a, b: a | b, [(F.col("tbl") == t) & (F.col("id") <= b) for t, b in tbl_bounds.items()], F.lit(False))
    yield rows.where(early)
    yield rows.where(~early)


def _ledger(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, int]:
    rows = keyed_tables(spark, sf_dir)
    facts = rows.groupBy("tbl").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("lo"), F.max("id").alias("hi")).collect()
    bounds = {r.tbl: (r.lo + r.hi) // 2 for r in facts}
    path = f"{shared_dir(spark).rstrip('/')}/selvedge-ledger-{uuid.uuid4().hex}"
    track(path)
    ledger = Ledger(spark, path)
    for k, delivery in enumerate(deliveries_by_id(rows, bounds)):
        ledger.merge(delivery, f"part {k}")
    return rows, ledger.read(), sum(r.n for r in facts)


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, ledger, total = _ledger(spark, sf_dir)
    return copies_of(rows, ledger, total)


def p3_copy_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per distinct record with its number of copies."""
    return _ledger(spark, sf_dir)[1].select("tbl", "keep_id", "copies")


_TEXT_SQL = r"regexp_replace(replace(replace(lower({}), 'ß', 'ss'), 'ς', 'σ'), '[^\p{{L}}\p{{N}}\p{{M}}]+', '', 'g')"
_KEYED_SQL = f"""keyed AS (
  SELECT 'sft_records' AS tbl, row_index AS id, {_TEXT_SQL.format('instruction')} AS k FROM sft_records WHERE instruction IS NOT NULL
  UNION ALL
  SELECT 'preference_triples', row_index, {_TEXT_SQL.format('prompt')} FROM preference_triples WHERE prompt IS NOT NULL
  UNION ALL
  SELECT 'raw_payloads', raw_id, k FROM (
    SELECT raw_id, string_agg(path || '=' || {_TEXT_SQL.format('val')}, '|' ORDER BY path) AS k
    FROM (SELECT r.raw_id, t.fullkey AS path, coalesce(t.atom ->> '$', 'null') AS val
          FROM (SELECT raw_id, payload::JSON AS payload FROM raw_payloads WHERE json_valid(payload)) r, json_tree(r.payload) t
          WHERE t.type NOT IN ('OBJECT', 'ARRAY')) GROUP BY raw_id)
)"""

QUERIES = {"p3_found": p3_found, "p3_copy_counts": p3_copy_counts}
SQL = {
    "p3_found": f"""WITH {_KEYED_SQL}, m AS (SELECT tbl, id, min(id) OVER (PARTITION BY tbl, k) AS keep_id FROM keyed)
SELECT tbl, keep_id, id AS copy_id FROM m WHERE id <> keep_id""",
    "p3_copy_counts": f"""WITH {_KEYED_SQL} SELECT tbl, min(id) AS keep_id, count(*) AS copies FROM keyed GROUP BY tbl, k""",
}
