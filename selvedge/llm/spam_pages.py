"""Problem 10: pages made of repeated keywords, links or tags instead of sentences.

Method: every line is reduced to a shape (kind, bucketed word count, capitals,
separators, links). Shapes that no sentence can have are the non-sentence
shapes: link lines, tag lines, separated lists, keyword runs without the
punctuation of a sentence, and lines that say the same words again and again with
hardly a function word between them, whatever their punctuation. What stands in a
line after its last sentence is a line of its own. Lines are grouped by page and shape, and a page is
flagged when its non-sentence shapes hold more than half of its characters and
few shapes (SHAPES_COVER) make up most of that half.

Everything is decided from the page itself, so the operator is one narrow pass
without a shuffle. Defined results: null, empty and blank texts are never
flagged; a text of any length is read whole; repeated rows give repeated rows;
columns other than the id and the text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from selvedge.llm.tokens import coded, distinct_sorted, flat, rows_of
from selvedge.llm.tokens import words as split_words
from selvedge.session import table

#: More than this share of a page's characters must be in non-sentence shapes.
SHARE = 0.5
#: So many of a page's non-sentence shapes must cover COVERED of its non-sentence characters.
SHAPES_COVER, COVERED = 12, 0.8
#: A line repeats its keywords when so many of its words are in it before.
REPEATED = 0.3

URL = r"(?:https?:)?//[^\s<>()\[\]\"]+|www\.[^\s<>()\[\]\"]+"
LINKED = rf"(?i)<a\s[^>]*>[^<]*</a>|!?\[[^\]\n]*\]\([^)\s]*\)|{URL}|[\w.-]+\.[a-z]{{2,}}/[^\s]*"
TAG = r"(?:^|[\s,;|])#[\p{L}\p{N}_-]+"
SEPARATOR = r"[>|;,/•·»~]|\s[-–—]\s|\s::?\s"
STOP = r"[.!?…](?:[\s\"'»”’)\]]|$)"
#: A line whose last sentence is followed by something without an end.
TAILED = r"^(.*[.!?…][\"'»”’)\]]*)[ \t]+((?:[^.!?…\n\r]|[.!?…]+[^\s.!?…\"'»”’)\]]){40,})$"
WORD = r"[\p{L}\p{N}]+(?:['’-][\p{L}\p{N}]+)*"
CAPITAL = r"(?:^|[^\p{L}\p{N}'’-])\p{Lu}"
#: Short words that sentences of the four languages need and lists of keywords do without.
FUNCTION_WORDS = r"(?i)\b(?:the|of|to|and|is|are|in|for|with|may|when|not|a|an|on|by|or|that|this|le|la|les|de|des|du|un|une|et|est|sont|à|au|aux|pour|avec|que|qui|en|par|sur|der|die|das|und|ist|sind|nicht|ein|eine|zu|von|mit|bei|wird|werden|wenn|el|los|las|del|y|es|son|no|con|para|por|se|su|si|il|elle|vous|you|it|your|votre)\b"

SHAPE_SCHEMA = "id bigint, shape string, lines bigint, chars bigint, sentence boolean"
KINDS = np.array(["sentence", "links", "tags", "separated", "keywords"])


def _count(values, pattern: str) -> np.ndarray:
    return np.asarray(pc.count_substring_regex(values, pattern=pattern)).astype(np.int64)


def _length(values) -> np.ndarray:
    return np.asarray(pc.utf8_length(values)).astype(np.int64)


def repeated_words(lines: pa.Array) -> np.ndarray:
    """How many words of each line are in it before."""
    values, off = split_words(lines)
    codes, distinct = coded(values)
    width = max(1, len(distinct))
    different = np.bincount(distinct_sorted(rows_of(off) * width + codes) // width, minlength=len(lines))
    return np.diff(off) - different


def line_kinds(lines: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(kind code, shape code, characters) of each line."""
    chars = _length(lines)
    bare = pc.replace_substring_regex(lines, pattern=LINKED, replacement=" ")
    link_n = _count(lines, LINKED)
    link_chars = chars - _length(bare) + link_n
    words = _count(bare, WORD)
    tags = _count(lines, TAG)
    stops = _count(bare, STOP)
    seps = _count(bare, SEPARATOR)
    caps = _count(bare, CAPITAL)
    function = _count(bare, FUNCTION_WORDS)
    some = np.maximum(words, 1)
    per_sentence = words / np.maximum(stops, 1)
    prose = (function >= 0.12 * words) & (stops > 0) & (per_sentence <= 60)
    links = (link_n > 0) & ((link_chars >= 0.5 * chars) | (link_n >= 0.2 * some) & ~prose)
    tagged = ~links & (tags > 0) & (tags >= 0.5 * some)
    listed = (stops == 0) & (seps >= 2) | (per_sentence > 12) & (words >= 6)
    separated = ~links & ~tagged & listed & (seps >= 0.3 * some) & (function < 0.2 * words)
    short = (words > 0) & (words <= 6) & (stops == 0) & (function <= np.where(words <= 4, 0.5, 0.25) * words)
    endless = (stops == 0) | (per_sentence > 25)
    again = repeated_words(bare) >= REPEATED * words
    run = (words > 6) & ((function < 0.08 * words) & (endless | again) | (function < 0.2 * words) & endless & again)
    keywords = ~links & ~tagged & ~separated & (short | run)
    kind = np.select([links, tagged, separated, keywords], [1, 2, 3, 4], 0)
    bucket = np.minimum(np.ceil(np.log2(words + 1)), 9).astype(np.int64)
    cap = np.minimum((4 * caps) // some, 4)
    sep = np.minimum((4 * seps) // some, 3)
    shape = ((kind * 10 + bucket) * 5 + cap) * 4 + sep
    return kind, np.where(kind == 1, 200 + np.minimum(link_n, 3) * 1000, shape), chars


def page_lines(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The non-blank lines of all texts and the row of each."""
    lists = pc.split_pattern_regex(pc.replace_substring_regex(texts, pattern=f"(?m){TAILED}", replacement="\\1\n\\2"), pattern=r"[\n\r\x{2028}\x{2029}]+")
    off = np.asarray(lists.offsets)
    lines = pc.utf8_trim_whitespace(lists.flatten())
    keep = np.asarray(pc.not_equal(lines, ""))
    return lines.filter(pa.array(keep)), np.repeat(np.arange(len(off) - 1), np.diff(off))[keep]


def _shapes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        lines, row = page_lines(flat(b.column(1)))
        kind, shape, chars = line_kinds(lines)
        key, at, inv = np.unique(row * 100_000 + shape, return_index=True, return_inverse=True)
        ids = b.column(0).take(pa.array(row[at]))
        k = kind[at]
        name = [f"{KINDS[i]}/{s}" for i, s in zip(k, shape[at], strict=True)]
        yield pa.RecordBatch.from_arrays(
            [ids, pa.array(name, pa.string()), pa.array(np.bincount(inv, minlength=len(key)).astype(np.int64)), pa.array(np.bincount(inv, chars, len(key)).astype(np.int64)), pa.array(k == 0)],
            names=["id", "shape", "lines", "chars", "sentence"],
        )


def page_shapes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per page and line shape."""
    return docs.select(docs[id_col].cast("bigint").alias("id"), docs[text_col].alias("text")).mapInArrow(_shapes, SHAPE_SCHEMA)


def _flagged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        n = b.num_rows
        lines, row = page_lines(flat(b.column(1)))
        kind, shape, chars = line_kinds(lines)
        total = np.bincount(row, chars, n)
        bad = kind > 0
        junk = np.bincount(row[bad], chars[bad], n)
        share = junk / np.maximum(total, 1)
        # the largest SHAPES_COVER non-sentence shapes of each page
        key, inv = np.unique(row[bad] * 100_000 + shape[bad], return_inverse=True)
        mass = np.bincount(inv, chars[bad], len(key))
        owner = key // 100_000
        order = np.lexsort((-mass, owner))
        first = np.searchsorted(owner[order], owner[order])
        top = np.arange(len(order)) - first < SHAPES_COVER
        few = np.bincount(owner[order][top], mass[order][top], n)
        hit = (share > SHARE) & (few >= COVERED * junk) & (junk > 0)
        yield pa.RecordBatch.from_arrays([b.column(0).filter(pa.array(hit)), pa.array(share[hit])], names=["doc_id", "share"])


def spam_pages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, share): the flagged pages with their share of non-sentence characters."""
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("share", T.DoubleType())])
    return docs.select(docs[id_col].cast("bigint").alias("doc_id"), docs[text_col].alias("text")).mapInArrow(_flagged, schema)


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spam_pages(table(spark, sf_dir, "documents")).select("doc_id")


def p10_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many pages, lines and characters each line shape has in the corpus."""
    return page_shapes(table(spark, sf_dir, "documents")).groupBy("shape", "sentence").agg(
        {"id": "count", "lines": "sum", "chars": "sum"}
    ).toDF("shape", "sentence", "n_chars", "pages", "n_lines")


QUERIES = {"p10_found": p10_found, "p10_shapes": p10_shapes}
SQL: dict[str, str] = {}
