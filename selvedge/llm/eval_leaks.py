"""Problem 9: passages of evaluation items inside training documents.

Method: word n-grams of the items are counted over all documents; the rarest
n-gram of every RUN-word window of an item becomes a seed, so no run of RUN
words can miss one. Edited copies may break any of these, so for them every
shorter n-gram (EDITED_SEED_WORDS) that a document holds is a seed; a copy
without so many intact words in a row is not found. Documents are probed with the seeds, and around each seed a
Smith-Waterman alignment of the item against the document's words gives the
score of a copied, edited or paraphrased passage and its longest verbatim run.

Both passes are scans of the documents without a shuffle of text: only the
counts of item n-grams (bounded by the items) travel. Items are handled in
blocks of at most BLOCK_CHARS characters, so what a task holds is bounded
however many items there are.

A window around seeds is aligned only where its words allow the wanted score: no
alignment scores more than the best stretch of the window in which a word of the
item counts MATCH and any other costs a gap. Windows of like sizes are aligned
together, a whole stack of dynamic-programming rows at once.

Words are runs of letters and digits without case or accents. Defined results:
null or empty texts and items never match; items shorter than RUN words have a
single window, and so no verbatim run of RUN words; a repeated document or item
gives repeated rows; other columns are not read.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from selvedge.llm.tokens import coded, distinct_sorted, flat, hash64, rolling_hash, rows_of
from selvedge.session import table

RUN = 13
#: Words of a seed for verbatim runs, and for edited copies.
SEED_WORDS, EDITED_SEED_WORDS = 5, 4
BLOCK_CHARS = 8_000_000
MATCH, MISMATCH, GAP = 2, -1, 1
#: A passage counts as an edited copy from this alignment score on: RUN words matched, less a few edits.
EDITED_SCORE = 20
#: Cells of the dynamic-programming rows that are worked on at once.
STACK = 1 << 15
#: Words of windows whose bounds are worked out at once.
PART = 1 << 19

ALIGNED = "doc_id bigint, item_id bigint, score int, matched int, longest_run int"


def plain_word(w: str) -> str:
    if w.isascii():
        return w.lower()
    return "".join(ch for ch in unicodedata.normalize("NFKD", w) if not unicodedata.combining(ch)).casefold()


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every word without case and accents, offsets of each text's words)."""
    import pyarrow.compute as pc

    lists = pc.split_pattern_regex(texts, pattern=r"[^\p{L}\p{N}\p{M}]+")
    off = np.asarray(lists.offsets)
    codes, distinct = coded(lists.flatten())
    plain = [plain_word(w) for w in distinct.to_pylist()]
    keep = np.array([bool(p) for p in plain], dtype=bool)
    hashes = hash64(pa.array(plain, pa.large_string()))
    kept = keep[codes] if len(codes) else np.zeros(0, bool)
    return hashes[codes][kept], np.concatenate([[0], np.cumsum(kept)])[off - off[0]]


def item_blocks(items: list[tuple[int, str]]) -> Iterator[list[tuple[int, str]]]:
    block, size = [], 0
    for item in items:
        if block and size + len(item[1]) > BLOCK_CHARS:
            yield block
            block, size = [], 0
        block.append(item)
        size += len(item[1])
    if block:
        yield block


class ItemIndex:
    """Word hashes and n-grams of a block of items."""

    def __init__(self, items: list[tuple[int, str]], seed_words: int = SEED_WORDS):
        self.seed_words = seed_words
        self.ids = np.array([i for i, _ in items], dtype=np.int64)
        self.words, self.off = word_hashes(flat(pa.array([t for _, t in items], pa.string())))
        rows = rows_of(self.off)
        self.gram, self.gram_item = rolling_hash(self.words, rows, seed_words)
        self.distinct = distinct_sorted(self.gram)
        self.vocabulary = distinct_sorted(self.words)
        self.codes = np.searchsorted(self.vocabulary, self.words)
        #: item * len(vocabulary) + code of every word of every item
        self.held = distinct_sorted(rows * len(self.vocabulary) + self.codes)

    def coded(self, words: np.ndarray) -> np.ndarray:
        """Codes of words in the vocabulary, -1 for words of no item."""
        hit, place = _locate(self.vocabulary, words)
        out = np.full(len(words), -1, np.int64)
        out[hit] = place
        return out

    def seeds(self, counts: dict[int, int], edited: bool) -> tuple[np.ndarray, np.ndarray]:
        """(seed hashes, item of each), sorted by hash.

        For verbatim runs the rarest n-gram of every window; a window with an
        n-gram that is in no document is in none itself. For edited copies
        every n-gram that is in a document.
        """
        out: set[tuple[int, int]] = set()
        df = np.array([counts.get(int(g), 0) for g in self.gram], dtype=np.int64)
        first = np.searchsorted(self.gram_item, np.arange(len(self.ids) + 1))
        width = RUN - self.seed_words + 1
        for k in range(len(self.ids)):
            grams, n = self.gram[first[k] : first[k + 1]], df[first[k] : first[k + 1]]
            if edited:
                out.update((int(g), k) for g in grams[n > 0])
                continue
            for at in range(max(1, len(grams) - width + 1) if len(grams) else 0):
                rarest = at + int(np.argmin(n[at : at + width]))
                if n[rarest]:
                    out.add((int(grams[rarest]), k))
        seeds = np.array(sorted(out), dtype=np.int64).reshape(-1, 2)
        return seeds[:, 0], seeds[:, 1]


def _gram_counts(batches: Iterator[pa.RecordBatch], grams: np.ndarray, seed_words: int = SEED_WORDS) -> Iterator[pa.RecordBatch]:
    total = np.zeros(len(grams), np.int64)
    for b in batches:
        h, _ = _document_grams(b.column(0), seed_words)
        total += np.bincount(_locate(grams, h)[1], minlength=len(grams)).astype(np.int64)
    at = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(grams[at]), pa.array(total[at])], names=["gram", "n"])


def _document_grams(column, seed_words: int = SEED_WORDS) -> tuple[np.ndarray, np.ndarray]:
    words, off = word_hashes(flat(column))
    return rolling_hash(words, rows_of(off), seed_words)


def _slots(values: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return ((values.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(44)).astype(np.int64)


def _locate(sorted_keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(positions in values that occur in sorted_keys, first place of each there); a table of 20-bit hashes spares most searches."""
    if not len(sorted_keys) or not len(values):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    table = np.zeros(1 << 20, bool)
    table[_slots(sorted_keys)] = True
    maybe = np.flatnonzero(table[_slots(values)])
    place = np.searchsorted(sorted_keys, values[maybe])
    hit = sorted_keys[np.minimum(place, len(sorted_keys) - 1)] == values[maybe]
    return maybe[hit], place[hit]


def align_stack(item: np.ndarray, text: np.ndarray) -> np.ndarray:
    """(Smith-Waterman score, item words that are in the text, longest verbatim run) of each row of coded items and texts, filled up with -2 and -1."""
    # scores and steps stay below these sizes, so short sequences need but half the bytes
    kind = np.int16 if GAP * text.shape[1] + MATCH * item.shape[1] < 32_000 else np.int32
    step = (GAP * np.arange(1, text.shape[1] + 1)).astype(kind)
    above = np.zeros((len(text), text.shape[1] + 1), kind)
    run = np.zeros_like(above)
    out = np.zeros((len(text), 3), np.int64)
    for w in item.T:
        same = text == w[:, None]
        run[:, 1:] = (run[:, :-1] + kind(1)) * same
        row = np.maximum(above[:, :-1] + np.where(same, kind(MATCH), kind(MISMATCH)), above[:, 1:] - kind(GAP))
        np.maximum(row, 0, out=row)
        row += step
        np.maximum.accumulate(row, axis=1, out=row)
        row -= step
        above[:, 1:] = row
        out[:, 0] = np.maximum(out[:, 0], row.max(1))
        out[:, 1] += same.any(1)
        out[:, 2] = np.maximum(out[:, 2], run.max(1))
    return out


def align(item: np.ndarray, text: np.ndarray) -> tuple[int, int, int]:
    """align_stack() of one sequence of word hashes each."""
    _, codes = np.unique(np.concatenate([item, text]), return_inverse=True)
    score, matched, run = align_stack(codes[None, : len(item)].astype(np.int32), codes[None, len(item) :].astype(np.int32))[0]
    return int(score), int(matched), int(run)


class Windows:
    """Stretches lo to hi of coded document words, each around seeds of one item."""

    def __init__(self, index: ItemIndex, words: np.ndarray, row: np.ndarray, item: np.ndarray, lo: np.ndarray, hi: np.ndarray):
        self.index, self.words, self.row, self.item, self.lo, self.hi = index, words, row, item, lo, hi

    def take(self, keep: np.ndarray) -> Windows:
        return Windows(self.index, self.words, self.row[keep], self.item[keep], self.lo[keep], self.hi[keep])

    def bounds(self) -> np.ndarray:
        """No alignment of a window with its item scores more than this; windows are looked at in parts of about PART words."""
        place = (np.cumsum(self.hi - self.lo) - 1) // PART
        cuts = np.flatnonzero(np.diff(place)) + 1
        parts = np.split(np.arange(len(place)), cuts) if len(place) else []
        return np.concatenate([np.zeros(0, np.int64), *(self._bounds(self.item[k], self.lo[k], self.hi[k] - self.lo[k]) for k in parts)])

    def _bounds(self, item: np.ndarray, lo: np.ndarray, size: np.ndarray) -> np.ndarray:
        of = np.repeat(np.arange(len(size)), size)
        at = np.arange(len(of)) + np.repeat(lo - np.cumsum(size) + size, size)
        code = self.words[at]
        gain = np.full(len(of), -min(GAP, -MISMATCH), np.int64)
        known = np.flatnonzero(code >= 0)
        hit, _ = _locate(self.index.held, item[of[known]] * len(self.index.vocabulary) + code[known])
        gain[known[hit]] = MATCH
        # every window's sums lie below those of the window before, so one running minimum serves all
        total = np.cumsum(gain) - of * (int(size.max(initial=0)) + 1) * 2 * MATCH
        before = np.minimum.accumulate(total - gain)
        out = np.zeros(len(size), np.int64)
        if len(of):
            out = np.maximum(np.maximum.reduceat(total - before, np.cumsum(size) - size), 0)
        return out

    def align(self) -> np.ndarray:
        """Rows (score, matched words of the item at most, longest verbatim run) of the windows."""
        first, last = self.index.off[self.item], self.index.off[self.item + 1]
        length, size = last - first, self.hi - self.lo
        out = np.zeros((len(size), 3), np.int64)
        order = np.lexsort((size, length))
        cells = 0
        begin = 0
        for n in range(1, len(order) + 1):
            cells = max(cells, int(size[order[n - 1]]))
            if n < len(order) and cells * (n - begin) < STACK:
                continue
            k = order[begin:n]
            out[k] = self._stack(first[k], length[k], self.lo[k], size[k])
            begin, cells = n, 0
        return out

    def _stack(self, first: np.ndarray, length: np.ndarray, lo: np.ndarray, size: np.ndarray) -> np.ndarray:
        width, place = np.arange(int(size.max())), np.arange(int(length.max()))
        text = np.where(width < size[:, None], self.words[np.minimum(lo[:, None] + width, len(self.words) - 1)], -1)
        item = np.where(place < length[:, None], self.index.codes[np.minimum(first[:, None] + place, len(self.index.codes) - 1)], -2)
        return align_stack(item.astype(np.int32), text.astype(np.int32))


def seed_windows(index: ItemIndex, words: np.ndarray, off: np.ndarray, seed: np.ndarray, owner: np.ndarray) -> Windows:
    """Around each seed of an item in a document as many words as the item has to both sides; windows that touch are one."""
    rows = rows_of(off)
    m = max(0, len(words) - index.seed_words + 1)
    start = np.flatnonzero(rows[:m] == rows[index.seed_words - 1 :]) if m else np.zeros(0, np.int64)
    grams, _ = rolling_hash(words, rows, index.seed_words)
    hit, place = _locate(seed, grams)
    owners = np.searchsorted(seed, grams[hit], side="right") - place
    at = np.repeat(start[hit], owners)
    item = owner[np.repeat(place - np.cumsum(owners) + owners, owners) + np.arange(len(at))] if len(at) else np.zeros(0, np.int64)
    order = np.lexsort((at, item, rows[at]))
    at, item = at[order], item[order]
    row, length = rows[at], index.off[item + 1] - index.off[item]
    new = np.ones(len(at), bool)
    new[1:] = (row[1:] != row[:-1]) | (item[1:] != item[:-1]) | (at[1:] - length[1:] > at[:-1] + index.seed_words + length[1:])
    begin = np.flatnonzero(new)
    end = np.append(begin[1:], len(at))[: len(begin)] - 1
    lo = np.maximum(at[begin] - length[begin], off[row[begin]])
    hi = np.minimum(at[end] + index.seed_words + length[end], off[row[begin] + 1])
    return Windows(index, index.coded(words), row[begin], item[begin], lo, hi)


def _aligned(batches: Iterator[pa.RecordBatch], index: ItemIndex, seed: np.ndarray, owner: np.ndarray, least: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        words, off = word_hashes(flat(b.column(1)))
        found = seed_windows(index, words, off, seed, owner)
        found = found.take(found.bounds() >= least)
        key = found.row * len(index.ids) + found.item  # in order, so the windows of a document and item are together
        first = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
        scores = np.maximum.reduceat(found.align(), first, axis=0) if len(first) else np.zeros((0, 3), np.int64)
        good = scores[:, 0] >= least
        first, scores = first[good], scores[good].astype(np.int32)
        yield pa.RecordBatch.from_arrays(
            [b.column(0).take(pa.array(found.row[first])), pa.array(index.ids[found.item[first]]), *(pa.array(scores[:, k]) for k in range(3))],
            names=["doc_id", "item_id", "score", "matched", "longest_run"],
        )


def leak_alignments(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", edited: bool = True) -> DataFrame:
    """(doc_id, item_id, score, matched, longest_run) of every document and item that share a seed and align with EDITED_SCORE or more; without edited, of all verbatim runs of RUN words at least."""
    texts = docs.select(docs[id_col].cast("bigint").alias("doc_id"), docs[text_col].alias("text")).where("text is not null")
    listed = items.select("item_id", "text").where("item_id is not null and text is not null").orderBy("item_id")
    least = EDITED_SCORE if edited else RUN * MATCH
    parts = []
    for block in item_blocks([(r.item_id, r.text) for r in listed.toLocalIterator()]):
        index = ItemIndex(block, EDITED_SEED_WORDS if edited else SEED_WORDS)
        counted = texts.select("text").mapInArrow(lambda it, g=index.distinct, n=index.seed_words: _gram_counts(it, g, n), "gram bigint, n bigint")
        counts = {r.gram: r.n for r in counted.groupBy("gram").agg(F.sum("n").alias("n")).collect()}
        seed, owner = index.seeds(counts, edited)
        parts.append(texts.mapInArrow(lambda it, i=index, s=seed, o=owner: _aligned(it, i, s, o, least), ALIGNED))
    if not parts:
        return docs.sparkSession.createDataFrame([], ALIGNED)
    return reduce(DataFrame.unionAll, parts)


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = leak_alignments(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"), edited=False)
    return found.where(F.col("longest_run") >= RUN).select("doc_id", "item_id")


def p9_edited_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verbatim and edited passages with their alignment score."""
    return leak_alignments(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))


QUERIES = {"p9_found": p9_found, "p9_edited_copies": p9_edited_copies}
_WORDS = r"regexp_extract_all(strip_accents(lower({})), '[\p{{L}}\p{{N}}]+')"
SQL = {
    "p9_found": f"""WITH e AS (SELECT item_id, {_WORDS.format('text')} AS w FROM eval_items),
eg AS (SELECT DISTINCT item_id, array_to_string(w[i:i+12], ' ') AS g FROM (SELECT item_id, w, unnest(range(1, len(w) - 11)) AS i FROM e WHERE len(w) >= 13)),
d AS (SELECT doc_id, {_WORDS.format('text')} AS w FROM documents),
dg AS (SELECT doc_id, array_to_string(w[i:i+12], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM d WHERE len(w) >= 13))
SELECT DISTINCT doc_id, item_id FROM dg JOIN eg USING (g)"""
}
