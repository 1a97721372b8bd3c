"""Problem 5: token totals by source, language and domain under the listed pieces.

Method: tokens are independent across white space, since the tokenizer splits
there before anything else, so a text may be cut at any white space without
changing its count (the proof is the tokenizer's first rule). Documents above
CHUNK_CHARS are cut at such places into chunks, which are salted across the
workers by (row, chunk); every chunk is counted exactly, chunk counts are summed
per document, and slices are rolled up with grouping sets.

A text is lower-cased and split at white space; each character that is neither
letter nor digit is one token; each word is cut from the left into the longest
listed pieces (``##`` after the first); a character without a piece is one token.

Defined results: null, empty and blank texts have 0 tokens and still count as
documents; a run without white space is never cut, whatever its length; null
source or domain become "unknown", languages fold to their first two letters in
lower case; repeated rows count each time; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from selvedge.llm.tokens import NOT_WORD, coded, flat
from selvedge.session import table

CHUNK_CHARS = 1 << 18
#: The tokenizer's vocabulary goes to every worker; a larger one is refused.
MAX_PIECES = 2_000_000
SPACE = r"[\t-\r\x{1c}-\x{20}\x{85}\p{Z}]"


class Pieces:
    """Greedy longest-piece counts of words, remembered per word."""

    def __init__(self, pieces: list[str]):
        self.first = frozenset(p for p in pieces if not p.startswith("##"))
        self.later = frozenset(p[2:] for p in pieces if p.startswith("##"))
        self.longest = max((len(p) for p in self.first | self.later), default=1)
        self.known: dict[str, int] = {}

    def count(self, word: str) -> int:
        n = self.known.get(word)
        if n is None:
            n = at = 0
            while at < len(word):
                pieces = self.later if at else self.first
                end = min(len(word), at + self.longest)
                while end > at + 1 and word[at:end] not in pieces:
                    end -= 1
                at, n = end, n + 1
            if len(self.known) < 1_000_000:  # only a memory of counts: forgetting costs time, not rows
                self.known[word] = n
        return n

    def counts(self, column) -> np.ndarray:
        """Tokens of each text of an Arrow column."""
        texts = pc.utf8_lower(flat(column))
        lists = pc.split_pattern_regex(texts, pattern=NOT_WORD)
        codes, distinct = coded(lists.flatten())
        of = np.fromiter(map(self.count, distinct.to_pylist()), dtype=np.int64, count=len(distinct))
        off = np.asarray(lists.offsets)
        total = np.concatenate([[0], np.cumsum(of[codes] if len(codes) else [])]).astype(np.int64)
        length = np.asarray(pc.utf8_length(lists.flatten())).astype(np.int64)
        letters = np.concatenate([[0], np.cumsum(length)])
        off = off - off[0]
        spaces = np.asarray(pc.count_substring_regex(texts, pattern=SPACE)).astype(np.int64)
        single = np.asarray(pc.utf8_length(texts)).astype(np.int64) - (letters[off[1:]] - letters[off[:-1]]) - spaces
        return total[off[1:]] - total[off[:-1]] + single


def cut_points(text: str, size: int) -> Iterator[str]:
    """The text in parts of about size characters, cut only at white space."""
    at = 0
    while at < len(text):
        end = min(len(text), at + size)
        while end < len(text) and not text[end].isspace():
            end += 1
        yield text[at:end]
        at = end


def pieces_of(token_pieces: DataFrame) -> Pieces:
    listed = token_pieces.select("piece").where("piece is not null").limit(MAX_PIECES + 1).collect()
    if len(listed) > MAX_PIECES:
        raise ValueError(f"more than {MAX_PIECES} pieces")
    return Pieces([r.piece for r in listed])


def count_tokens(docs: DataFrame, pieces: Pieces, text_col: str, keep: list[str]) -> DataFrame:
    """The kept columns of each row with n_tokens, the exact token count of its text."""
    schema = docs.select(*keep).schema
    width = len(keep)
    counted_schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns[:width], pa.array(pieces.counts(b.column(width)), pa.int64())], names=[*keep, "n_tokens"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k, text in enumerate(b.column(width + 1).to_pylist()):
                for n, part in enumerate(cut_points(text, CHUNK_CHARS)):
                    row = b.slice(k, 1)
                    yield pa.RecordBatch.from_arrays([*row.columns[: width + 1], pa.array([n], pa.int64()), pa.array([part])], names=[*keep, "__row", "__chunk", "__text"])

    size = F.coalesce(F.length(F.col(text_col)), F.lit(0))
    whole = docs.where(size <= CHUNK_CHARS).select(*keep, F.col(text_col).alias("__text")).mapInArrow(count, f"{counted_schema}, n_tokens bigint")
    large = docs.where(size > CHUNK_CHARS).select(*keep, F.monotonically_increasing_id().alias("__row"), F.col(text_col).alias("__text"))
    chunks = large.mapInArrow(cut, f"{counted_schema}, __row bigint, __chunk bigint, __text string").repartition("__row", "__chunk")

    def count_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns[: width + 1], pa.array(pieces.counts(b.column(width + 2)), pa.int64())], names=[*keep, "__row", "n_tokens"])

    sums = chunks.mapInArrow(count_chunks, f"{counted_schema}, __row bigint, n_tokens bigint").groupBy("__row")
    per_large = sums.agg(*[F.first(k).alias(k) for k in keep], F.sum("n_tokens").alias("n_tokens")).select(*keep, "n_tokens")
    return whole.unionByName(per_large)


def language_code(c: Column) -> Column:
    return F.coalesce(F.nullif(F.substring(F.lower(F.trim(c)), 1, 2), F.lit("")), F.lit("unknown"))


def slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(tbl, source, language, domain, n_tokens) of every document of both tables."""
    pieces = pieces_of(table(spark, sf_dir, "token_pieces"))
    unknown = lambda c: F.coalesce(F.col(c), F.lit("unknown"))
    docs = table(spark, sf_dir, "documents").select(
        "text", F.lit("documents").alias("tbl"), unknown("source").alias("source"), language_code(F.col("lang")).alias("language"), unknown("domain").alias("domain")
    )
    manifests = table(spark, sf_dir, "source_manifests").groupBy("source_manifest_id").agg(F.min("domain").alias("domain"))
    sft = table(spark, sf_dir, "sft_records").select(
        F.col("response").alias("text"),
        F.lit("sft_records").alias("tbl"),
        unknown("source.source_dataset").alias("source"),
        language_code(F.col("language")).alias("language"),
        F.col("source.source_manifest_id").alias("manifest"),
    )
    counted_docs = count_tokens(docs, pieces, "text", ["tbl", "source", "language", "domain"])
    counted_sft = count_tokens(sft, pieces, "text", ["tbl", "source", "language", "manifest"])
    # pre-aggregated before the join, so a hot source shuffles one row per task
    by_manifest = counted_sft.groupBy("tbl", "source", "language", "manifest").agg(F.sum("n_tokens").alias("n_tokens"), F.count(F.lit(1)).alias("n"))
    joined = by_manifest.join(manifests, F.col("manifest") == F.col("source_manifest_id"), "left")
    left = joined.select("tbl", "source", "language", F.coalesce("domain", F.lit("unknown")).alias("domain"), "n_tokens", "n")
    return counted_docs.select("*", F.lit(1).cast("bigint").alias("n")).unionByName(left)


def p5_token_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals by source, language and domain, by each of them alone, and per table; level names the grouping."""
    cols = ["source", "language", "domain"]
    base = slices(spark, sf_dir).groupBy("tbl", *cols).agg(F.sum("n").alias("documents"), F.sum("n_tokens").alias("tokens"))
    sets = [["tbl", *cols], ["tbl", "source"], ["tbl", "language"], ["tbl", "domain"], ["tbl"]]
    rolled = base.groupingSets([[F.col(c) for c in s] for s in sets], "tbl", *cols).agg(
        F.grouping_id().alias("gid"), F.sum("documents").alias("documents"), F.sum("tokens").alias("tokens")
    )
    level = F.element_at(F.create_map(*[F.lit(x) for x in (0, "slice", 3, "source", 5, "language", 6, "domain", 7, "table")]), F.col("gid").cast("int"))
    return rolled.select(level.alias("level"), "tbl", *cols, "documents", "tokens")


QUERIES = {"p5_token_budget": p5_token_budget}
_SPACES = r"[\t-\r\x{1c}-\x{20}\x{85}\p{Z}]"
#: Of both tables d(tbl, id, source, l, domain, t) to n_tokens(tbl, id, source, l, domain, n), the tokens of every row.
COUNTED_SQL = rf"""d AS (
  SELECT 'documents' AS tbl, doc_id AS id, coalesce(source, 'unknown') AS source, lang AS l, coalesce(domain, 'unknown') AS domain, coalesce(lower(text), '') AS t FROM documents
  UNION ALL SELECT 'sft_records', row_index, coalesce(s.source.source_dataset, 'unknown'), s.language, coalesce(m.domain, 'unknown'), coalesce(lower(s.response), '') FROM sft_records s
  LEFT JOIN (SELECT source_manifest_id, min(domain) AS domain FROM source_manifests GROUP BY 1) m ON s.source.source_manifest_id = m.source_manifest_id),
w AS (SELECT tbl, id, unnest(regexp_extract_all(t, '[\p{{L}}\p{{N}}]+')) AS word FROM d),
u AS (SELECT DISTINCT word FROM w), longest AS (SELECT max(length(piece)) AS n FROM token_pieces), p AS (SELECT DISTINCT piece FROM token_pieces),
c(word, pos, n) AS (SELECT word, 0, 0 FROM u UNION ALL
  SELECT word, pos + max(step), n + 1 FROM (SELECT c.word, c.pos, c.n, CASE WHEN k = 1 OR p.piece IS NOT NULL THEN k ELSE 0 END AS step FROM c, longest, generate_series(1, longest.n) AS g(k)
    LEFT JOIN p ON p.piece = CASE WHEN c.pos > 0 THEN '##' ELSE '' END || substr(c.word, c.pos + 1, k) WHERE c.pos < length(c.word) AND c.pos + k <= length(c.word)) GROUP BY word, pos, n),
f AS (SELECT word, max(n) AS n FROM c GROUP BY word), e AS (SELECT tbl, id, sum(f.n) AS n FROM w JOIN f USING (word) GROUP BY 1, 2),
n_tokens AS (SELECT d.tbl, d.id, d.source, d.l, d.domain, coalesce(e.n, 0) + length(regexp_replace(regexp_replace(t, '[\p{{L}}\p{{N}}]+', '', 'g'), '{_SPACES}+', '', 'g')) AS n FROM d LEFT JOIN e USING (tbl, id))"""
SQL = {
    "p5_token_budget": rf"""WITH RECURSIVE {COUNTED_SQL},
x AS (SELECT tbl, source, coalesce(nullif(substr(lower(trim(l)), 1, 2), ''), 'unknown') AS language, domain, n FROM n_tokens)
SELECT CASE grouping(source, language, domain) WHEN 0 THEN 'slice' WHEN 3 THEN 'source' WHEN 5 THEN 'language' WHEN 6 THEN 'domain' ELSE 'table' END AS level, tbl, source, language, domain, count(*) AS documents, sum(n)::BIGINT AS tokens
FROM x GROUP BY GROUPING SETS ((tbl, source, language, domain), (tbl, source), (tbl, language), (tbl, domain), (tbl))"""
}
