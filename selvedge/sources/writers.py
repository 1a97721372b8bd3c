"""Sinks: canonical JSON lines, batches, flat exports, file digests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from selvedge.functions.text import multiset_digest, sha
from selvedge.operators.ranking import batches


def _json_row(df: DataFrame):
    return F.to_json(F.struct(*[F.col(c) for c in sorted(df.columns)]), {"ignoreNullFields": "false"})


def write_jsonl(df: DataFrame, path: str) -> dict[str, object]:
    """Write rows as JSON with sorted fields to a fresh folder; returns path, rows, bytes and an order-free digest.

    An existing folder raises. The digest is that of the set of rows (see
    multiset_digest), so it does not depend on files or their order.
    """
    rows = df.select(_json_row(df).alias("value"))
    rows.write.mode("errorifexists").text(path)
    written = df.sparkSession.read.text(path).select(sha("value").alias("d"), (F.octet_length("value") + 1).alias("b"))
    total = written.agg(multiset_digest(F.col("d")).alias("sha256"), F.count(F.lit(1)).alias("n"), F.sum("b").alias("b")).first()
    return {"path": path, "sha256": total.sha256, "record_count": total.n, "byte_size": total.b or 0}


def write_partitioned(df: DataFrame, path: str, by: list[str]) -> None:
    """A fresh parquet table in folders by the given columns; rows of one folder are written by few tasks."""
    df.write.mode("errorifexists").partitionBy(*by).parquet(path)


def write_batches(df: DataFrame, path: str, order: list[str], size: int) -> DataFrame:
    """Batches of size rows in the given order as JSON lines, one folder a batch; returns (batch, n_rows, sha256)."""
    cut = batches(df, order, size)
    rows = cut.select("batch", "place", _json_row(df).alias("value"))
    rows.select("batch", "value").write.mode("errorifexists").partitionBy("batch").text(path)
    listed = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("place", "value"))), lambda x: x["value"]), "\n")
    return rows.groupBy("batch").agg(F.count(F.lit(1)).alias("n_rows"), sha(listed).alias("sha256"))


def write_flat_csv(df: DataFrame, path: str, separator: str = "|") -> None:
    """CSV with structs flattened one level and arrays of strings joined."""
    columns = []
    for field in df.schema:
        kind = field.dataType.typeName()
        if kind == "struct":
            columns += [F.col(f"{field.name}.{sub.name}").cast("string").alias(f"{field.name}_{sub.name}") for sub in field.dataType]
        elif kind == "array":
            columns.append(F.array_join(F.col(field.name).cast("array<string>"), separator).alias(field.name))
        else:
            columns.append(F.col(field.name))
    df.select(*columns).write.mode("errorifexists").option("header", True).csv(path)


def text_free_index(df: DataFrame, ids: list[str], texts: list[str]) -> DataFrame:
    """Ids and one content digest; the texts stay behind."""
    content = F.to_json(F.struct(*[F.col(t) for t in sorted(texts)]), {"ignoreNullFields": "false"})
    return df.select(*ids, sha(content).alias("content_sha256"))


def file_digests(spark: SparkSession, path: str, expected: DataFrame | None = None) -> DataFrame:
    """(file, bytes, sha256) of the files below path; with expected (file, sha256) also whether each is as expected."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select(F.regexp_extract("path", r"([^/]+)$", 1).alias("file"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))
    if expected is None:
        return found
    want = expected.select("file", F.col("sha256").alias("expected"))
    state = F.when(F.col("sha256").isNull(), "missing").when(F.col("expected").isNull(), "unexpected").when(F.col("sha256") == F.col("expected"), "same").otherwise("changed")
    return found.join(want, "file", "full_outer").withColumn("state", state)
