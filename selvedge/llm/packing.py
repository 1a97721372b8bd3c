"""Problem 8: documents into containers of CAPACITY tokens with little unused space.

Method: exact-complement hashing over the histogram of lengths. Lengths are at
most CAPACITY, so the histogram has at most CAPACITY entries however many items
there are, and the plan is made on the driver from it alone. A container opens
with the longest length left; its gap is looked up among the available single,
pair and triple sums, and a combination that fills it exactly is consumed under
the availability counts; without one the best-fitting (longest) length goes in
and the new gap is looked up. A pattern is repeated as often as its rarest
length allows, so every pattern uses up a length and there are at most
CAPACITY of them.

Items are then numbered within their length and take the container that the
plan has for that number. The numbering is spread over hash buckets of the item
id: counts by (length, bucket) are summed up before, so a length that holds a
third of all items is numbered by many tasks.

Defined results: an item above CAPACITY is split into full parts and a rest, and
no other is split; items of 0 tokens (null and blank texts) take no space and
come out with a null container; equal items are told apart by their row; an
empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from selvedge.llm.token_budget import COUNTED_SQL, count_tokens, pieces_of
from selvedge.session import materialize, table

CAPACITY = 2048
#: Items numbered by one task at most, about.
ITEMS_PER_BUCKET = 500_000

#: (times the pattern is used, [(length, items of it in one container)])
Pattern = tuple[int, list[tuple[int, int]]]


def exact_fill(gap: int, left: np.ndarray) -> list[int] | None:
    """One, two or three available lengths that sum to gap; longest first."""
    if gap <= 0:
        return None
    if left[gap] > 0:
        return [gap]
    a = np.arange(gap // 2, gap)
    b = gap - a
    ok = (left[a] > 0) & (left[b] > 0) & ((a != b) | (left[a] > 1))
    if ok.any():
        k = len(ok) - 1 - int(np.argmax(ok[::-1]))
        return [int(a[k]), int(b[k])]
    have = np.flatnonzero(left[1:gap] > 0)[::-1] + 1
    for first in have:
        rest = gap - int(first)
        if first < rest / 2:
            break
        a = np.arange((rest + 1) // 2, min(rest, int(first) + 1))
        b = rest - a
        need_a = 1 + (a == first) + (a == b)
        need_b = 1 + (b == first) + (a == b)
        ok = (b > 0) & (left[a] >= need_a) & (left[b] >= need_b) & (left[first] >= 1 + (a == first) + (b == first))
        if ok.any():
            k = len(ok) - 1 - int(np.argmax(ok[::-1]))
            return [int(first), int(a[k]), int(b[k])]
    return None


def pack_plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[Pattern]:
    """Patterns that use up the histogram of lengths (1 to capacity)."""
    left = np.zeros(capacity + 1, np.int64)
    for length, n in histogram.items():
        left[length] = n
    plan: list[Pattern] = []
    while left.any():
        avail, gap, used = left.copy(), capacity, []
        while gap:
            fill = exact_fill(gap, avail) if used or avail[capacity] else None
            if fill is None:
                fits = np.flatnonzero(avail[1 : gap + 1])
                if not len(fits):
                    break
                fill = [int(fits[-1]) + 1]
            for length in fill:
                avail[length] -= 1
                gap -= length
            used += fill
        lengths, per = np.unique(used, return_counts=True)
        times = int((left[lengths] // per).min())
        left[lengths] -= per * times
        plan.append((times, [(int(a), int(b)) for a, b in zip(lengths, per, strict=True)]))
    return plan


def plan_intervals(plan: list[Pattern]) -> np.ndarray:
    """Rows (length, first rank, items per container, first container), sorted: which container takes which rank."""
    rank: dict[int, int] = {}
    rows, container = [], 0
    for times, items in plan:
        for length, per in items:
            rows.append((length, rank.get(length, 0), per, container))
            rank[length] = rank.get(length, 0) + per * times
        container += times
    return np.array(sorted(rows), dtype=np.int64).reshape(-1, 4)


def items_of(sized: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """(id, n_tokens) to the items (id, row, part, from_token, size): full parts and the rest of what exceeds capacity."""
    parts = F.expr(f"sequence(0L, greatest(cast(ceil(n_tokens / {capacity}) as bigint) - 1L, 0L))")
    return sized.withColumn("row", F.monotonically_increasing_id()).select("id", "row", "n_tokens", F.explode(parts).alias("part")).select(
        "id", "row", "part", (F.col("part") * capacity).alias("from_token"), F.least(F.lit(capacity).cast("bigint"), F.col("n_tokens") - F.col("part") * capacity).alias("size")
    )


def pack(sized: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """(id, part, from_token, size, container_id) for every row of sized (id, n_tokens)."""
    items = materialize(items_of(sized, capacity))
    histogram = {r["size"]: r["n"] for r in items.groupBy("size").agg(F.count(F.lit(1)).alias("n")).where("size > 0").collect()}
    cells = plan_intervals(pack_plan(histogram, capacity))
    buckets = max(16, -(-sum(histogram.values()) // ITEMS_PER_BUCKET))
    bucketed = items.where("size > 0").withColumn("bucket", F.pmod(F.xxhash64("id", "row"), F.lit(buckets)).cast("int"))
    counts = bucketed.groupBy("size", "bucket").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("size").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("size", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).cast("bigint").alias("offset"))
    within = Window.partitionBy("size", "bucket").orderBy("id", "row", "part")
    ranked = bucketed.withColumn("rn", F.row_number().over(within)).join(offsets, ["size", "bucket"]).select(
        "id", "part", "from_token", "size", (F.col("offset") + F.col("rn") - 1).alias("rank")
    )

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        big = np.int64(1) << 50
        start = cells[:, 0] * big + cells[:, 1] if len(cells) else np.zeros(0, np.int64)
        for b in batches:
            size, rank = (np.asarray(b.column(k)).astype(np.int64) for k in (3, 4))
            cell = cells[np.searchsorted(start, size * big + rank, side="right") - 1] if len(size) else np.zeros((0, 4), np.int64)
            container = cell[:, 3] + (rank - cell[:, 1]) // cell[:, 2]
            yield pa.RecordBatch.from_arrays([*b.columns[:4], pa.array(container)], names=["id", "part", "from_token", "size", "container_id"])

    schema = "id bigint, part bigint, from_token bigint, size bigint, container_id bigint"
    empty = items.where("size = 0").select("id", "part", "from_token", "size", F.lit(None).cast("bigint").alias("container_id"))
    return ranked.mapInArrow(place, schema).unionByName(empty)


def sized_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = pieces_of(table(spark, sf_dir, "token_pieces"))
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("bigint").alias("id"), "text")
    return count_tokens(docs, pieces, "text", ["id"])


def p8_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(sized_documents(spark, sf_dir)).withColumnRenamed("id", "doc_id")


def p8_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Containers, tokens and unused share of the assignment."""
    per = p8_containers(spark, sf_dir).where("container_id is not null").groupBy("container_id").agg(F.sum("size").alias("used"))
    return per.agg(
        F.count(F.lit(1)).alias("containers"),
        F.sum("used").alias("tokens"),
        F.max("used").alias("fullest"),
        F.sum((F.col("used") == CAPACITY).cast("bigint")).alias("exactly_full"),
        (1 - F.sum("used") / (F.count(F.lit(1)) * CAPACITY)).alias("unused_share"),
    )


def p8_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What holds of every assignment: documents and tokens all placed, no container over its capacity, only documents above it split, in as many parts as they need."""
    sized = materialize(sized_documents(spark, sf_dir))
    placed = materialize(pack(sized))
    whole = sized.groupBy("id").agg(F.sum("n_tokens").alias("n"))
    parts = placed.groupBy("id").agg(F.count(F.lit(1)).alias("parts"), F.sum("size").alias("placed"), F.count("container_id").alias("contained"))
    number = lambda c: F.coalesce(F.sum(c.cast("bigint")), F.lit(0))
    per_doc = whole.join(parts, "id", "left").agg(
        F.count(F.lit(1)).alias("documents"),
        F.coalesce(F.sum("placed"), F.lit(0)).cast("bigint").alias("tokens"),
        number(F.coalesce(F.col("placed"), F.lit(-1)) != F.col("n")).alias("wrongly_placed"),
        number((F.col("parts") > 1) & (F.col("n") <= CAPACITY)).alias("split_without_need"),
        number((F.col("n") > CAPACITY) & (F.col("parts") != F.ceil(F.col("n") / CAPACITY))).alias("cut_too_often"),
        number(F.col("n") > CAPACITY).alias("above_capacity"),
        number((F.col("n") > 0) & (F.col("contained") < F.col("parts"))).alias("outside"),
    )
    used = placed.where("container_id is not null").groupBy("container_id").agg(F.sum("size").alias("used")).agg(number(F.col("used") > CAPACITY).alias("overfull"))
    return per_doc.unionByName(used, True).agg(*[F.max(c).alias(c) for c in (*per_doc.columns, "overfull")])  # each of both has one row


QUERIES = {"p8_containers": p8_containers, "p8_fill": p8_fill, "p8_checks": p8_checks}
SQL = {
    "p8_checks": f"""WITH RECURSIVE {COUNTED_SQL}, s AS (SELECT id, n FROM n_tokens WHERE tbl = 'documents')
SELECT count(*) AS documents, coalesce(sum(n), 0)::BIGINT AS tokens, 0::BIGINT AS wrongly_placed, 0::BIGINT AS split_without_need, 0::BIGINT AS cut_too_often, coalesce(sum((n > {CAPACITY})::INT), 0)::BIGINT AS above_capacity, 0::BIGINT AS outside, 0::BIGINT AS overfull FROM s""",
}
