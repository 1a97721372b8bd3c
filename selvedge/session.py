"""Session, table and checkpoint helpers shared by every operator."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: int | str = "*", app: str = "selvedge", memory: str = "20g", partitions: int = 8) -> SparkSession:
    """A local session for tests and benchmarks; clusters bring their own."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.adaptive.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The named parquet table below sf_dir."""
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or where the session has none and runs locally a temporary one.

    On a cluster a session without the setting is refused: a temporary folder
    would be another one on every machine.
    """
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not found:
        found = sc.getCheckpointDir()
    if not found and not sc.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir is not set: name a folder that all executors share")
    if not found:
        found = tempfile.mkdtemp(prefix="selvedge-checkpoint-")
        sc.setCheckpointDir(found)
    return found


#: Tables written by materialize() in this process and not discarded yet.
_made: list[str] = []


def materialize(df: DataFrame, partition_by: list[str] | None = None) -> DataFrame:
    """Write df once to the shared folder and read it back.

    Cuts the lineage with a replicated table, so a lost executor costs a
    re-read and never a recomputation of everything before it.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/selvedge-{uuid.uuid4().hex}"
    writer = df.write.mode("errorifexists")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    _made.append(path)
    return spark.read.schema(df.schema).parquet(path)


def track(path: str) -> None:
    """Let discard_all() delete a folder that was written without materialize()."""
    _made.append(path)


def exists(spark: SparkSession, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Delete on leaving what materialize() and track() noted inside; results must be written or collected by then."""
    before = len(_made)
    try:
        yield
    finally:
        while len(_made) > before:
            _delete(spark, _made.pop())


def _delete(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def discard(df: DataFrame) -> None:
    """Delete the files of a table made by materialize(), once nothing reads it any more."""
    for folder in {os.path.dirname(f) for f in df.inputFiles()}:
        if os.path.basename(folder.rstrip("/")).startswith("selvedge-"):
            _delete(df.sparkSession, folder)
            _made[:] = [m for m in _made if os.path.basename(m) != os.path.basename(folder)]


def discard_all(spark: SparkSession) -> int:
    """Delete every table that materialize() wrote in this process; for the end of a job, when its results are written."""
    gone = len(_made)
    while _made:
        _delete(spark, _made.pop())
    return gone


class ContractViolation(ValueError):
    """A fail-closed check found rows that break its contract."""


def require_empty(violations: DataFrame, message: str, show: int = 5) -> None:
    """Raise ContractViolation when the violations table has any row."""
    rows = violations.take(show)
    if rows:
        raise ContractViolation(f"{message}: " + "; ".join(str(r.asDict(recursive=True)) for r in rows))
