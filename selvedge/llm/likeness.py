"""Similarity join of word sets, used by problems 6 and 7.

Two texts are alike when the distinct words they share are LIKE_NUM / LIKE_DEN
(0.65) or more of the distinct words in either. The join is built so that no
stage works on pairs of records that have nothing rare in common:

1. Rows with the same word set collapse into one set; only sets are joined, and
   a text delivered a million times is one row of the join.
2. Words are ordered rare-first: words found in at most RARE of the texts by
   hash, then the others by their count. There are at most (words per text /
   RARE) such frequent words however large the corpus is, so their counts are
   the only corpus statistic that is broadcast.
3. Sets are joined on the single words of their exact prefixes. Of two alike
   sets the shorter, of n words, holds a shared word in its first
   n - ceil(1.3 n / 1.65) + 1 and the longer, of m words, in its first
   m - ceil(0.65 m) + 1, whatever the order of their words and where they were
   edited. The first is the index prefix, the second the probe prefix.
4. Pairs of a posting list pass the length filter (a window of the list, which is
   sorted by length), the positional filter (ranks of the matching word in the
   rare-first order) and the suffix filter (Hamming distance of parity maps of the
   word sets, folded to 128 bits and then in full, a lower bound of their true
   difference). All are exact. The lists are compared in tiles of arrays, about
   two nanoseconds a pair.
5. Each remaining pair is verified once on its full word sets.

No step loses a pair. A word in m sets costs up to m * m / 2 comparisons of
maps, so the time grows with the square of the table where frequent words are in
the prefixes; the README gives the measured figures. The list of a word in more
than LIST_TEXTS texts is cut into blocks, and each two blocks are compared by
another task.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from selvedge.llm.tokens import coded, distinct_sorted, flat, hash64, rows_of, words
from selvedge.operators.components import connected_components
from selvedge.session import discard, materialize

LIKE_NUM, LIKE_DEN = 65, 100
#: Words in more than this share of the texts are ordered by their count, behind all others.
RARE = 0.001
#: In small tables words in up to so many texts are rare.
RARE_LEAST = 20
#: A text has BANDS leader keys, each of the words that come first under BAND_WORDS hashes; a key is used when CROWD sets have it.
BANDS, BAND_WORDS, CROWD = 8, 3, 32
#: A task compares posting lists of about so many texts; longer ones are cut into up to MOST_BLOCKS blocks.
LIST_TEXTS, MOST_BLOCKS = 100_000, 64
#: Distinct words that a task counts before it hands the counts on.
COUNTED_WORDS = 1_000_000
#: So many rows of one or two numbers are broadcast, 16 MB at most.
BROADCAST_ROWS = 1_000_000
#: Bits of the filter of wanted ids that verification broadcasts, 8 MB at most.
FILTER_BITS = 1 << 26
#: Rows and columns of a tile of a posting list; rows with up to FEW partners are expanded to pairs instead.
TILE_ROWS, TILE_COLUMNS, FEW = 64, 2048, 64
#: Pairs that the later filters take at once.
FLUSH = 1 << 18

MAPS = ["b0", "b1", "b2", "b3"]
SETS = "id bigint, side int, hash_a bigint, hash_b bigint, n int, b0 bigint, b1 bigint, b2 bigint, b3 bigint, posts array<struct<gram: bigint, pos: int>>, bands array<bigint>"
_MIX = [np.uint64(x) for x in (0xD6E8FEB86659FD93, 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)]


def _row_sets(column, rank=None) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """(rows, codes of the distinct words of each row, words); codes are those of the words, or their ranks where rank gives them."""
    values, off = words(flat(column))
    codes, distinct = coded(values)
    if rank is not None:
        codes = rank(distinct)[codes]
    width = max(1, len(distinct))
    key = distinct_sorted(rows_of(off) * width + codes)
    return key // width, key % width, distinct


def _document_frequency(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    count: dict[str, int] = {}
    texts = 0

    def counted(total: int) -> pa.RecordBatch:
        h = hash64(pa.array(list(count), pa.large_string()))
        out = [pa.array(np.append(h, 0)), pa.array([False] * len(h) + [True]), pa.array([*count.values(), total], pa.int64())]
        return pa.RecordBatch.from_arrays(out, names=["word", "total", "n"])

    for b in batches:
        _, code, distinct = _row_sets(b.column(0))
        texts += b.num_rows
        for w, n in zip(distinct.to_pylist(), np.bincount(code, minlength=len(distinct)).tolist(), strict=True):
            count[w] = count.get(w, 0) + n
        if len(count) > COUNTED_WORDS:
            yield counted(0)
            count.clear()
    yield counted(texts)


def frequent_words(texts: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words in more than RARE of the texts, sorted, and the number of texts with each."""
    counts = texts.select("text").mapInArrow(_document_frequency, "word bigint, total boolean, n bigint").groupBy("word", "total").agg(F.sum("n").alias("n"))
    counts = materialize(counts)
    n = (counts.where("total").agg(F.sum("n")).first()[0]) or 0
    found = sorted(counts.where(~F.col("total") & (F.col("n") > max(RARE * n, RARE_LEAST))).select("word", "n").collect())  # at most words per text / RARE
    discard(counts)
    return np.array([r.word for r in found], np.int64), np.array([r.n for r in found], np.int64)


def _mixed(u: np.ndarray, k: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        v = (u ^ (u >> np.uint64(31))) * _MIX[k % 3] + np.uint64(k) * _MIX[(k + 1) % 3]
        return (v ^ (v >> np.uint64(29))) * _MIX[(k + 1) % 3]


def _lists(values: np.ndarray | pa.Array, rows: np.ndarray, count: int) -> pa.Array:
    """One list per row of values that are in row order."""
    off = np.concatenate([[0], np.cumsum(np.bincount(rows, minlength=count))]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(off), values if isinstance(values, pa.Array) else pa.array(values))


def _cells(ids: np.ndarray, gram: np.ndarray, row: np.ndarray, pos: np.ndarray, blocks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Postings of words with several blocks, once for each pair of blocks that holds the row's own."""
    many = np.flatnonzero(blocks > 1)
    if not len(many):
        return gram, row, pos
    times = np.where(blocks > 1, blocks, 1)
    at = np.repeat(np.arange(len(gram)), times)
    other = np.arange(len(at)) - np.repeat(np.cumsum(times) - times, times)
    gram, row, pos, blocks = gram[at], row[at], pos[at], blocks[at]
    own = (_mixed(ids.view(np.uint64), 5)[row] % blocks.view(np.uint64)).astype(np.int64)
    cell = np.minimum(own, other) * MOST_BLOCKS + np.maximum(own, other) + 1
    return np.where(blocks > 1, _mixed((gram ^ (cell << 40)).view(np.uint64), 7).view(np.int64), gram), row, pos


def _signatures(batches: Iterator[pa.RecordBatch], frequent: np.ndarray, texts_with: np.ndarray) -> Iterator[pa.RecordBatch]:
    for b in batches:
        count = b.num_rows
        by_rank: list[np.ndarray] = []

        def rare_first(distinct: pa.Array, by_rank=by_rank) -> np.ndarray:
            hashed = hash64(distinct)
            weight, common = np.zeros(len(hashed), np.int64), np.isin(hashed, frequent)
            weight[common] = texts_with[np.searchsorted(frequent, hashed[common])]
            order = np.lexsort((hashed, weight))
            by_rank.extend((hashed[order], weight[order]))
            rank = np.empty(len(order), np.int64)
            rank[order] = np.arange(len(order))
            return rank

        row, word, _ = _row_sets(b.column(2), rare_first)
        hashed, weight = by_rank
        h = hashed[word]
        u = h.view(np.uint64)
        n = np.bincount(row, minlength=count)
        start = np.concatenate([[0], np.cumsum(n)])
        filled = np.flatnonzero(n)
        at = start[filled]

        def per_row(values: np.ndarray, op, filled=filled, at=at, count=count) -> np.ndarray:
            out = np.zeros(count, np.uint64)
            if len(filled):
                out[filled] = op.reduceat(values, at)
            return out

        hash_a, hash_b = (per_row(_mixed(u, k), np.add).view(np.int64) for k in (0, 1))
        bit = np.uint64(1) << (u & np.uint64(63))
        quarter = (u >> np.uint64(6)) & np.uint64(3)
        maps = [per_row(np.where(quarter == k, bit, np.uint64(0)), np.bitwise_xor).view(np.int64) for k in range(len(MAPS))]

        rank = np.arange(len(h)) - start[row]
        prefix = rank <= n[row] - -(-LIKE_NUM * n[row] // LIKE_DEN)
        blocks = np.minimum(-(-weight // LIST_TEXTS), MOST_BLOCKS)[word[prefix]]
        ids = np.asarray(b.column(0)).astype(np.int64)
        gram, gram_row, pos = _cells(ids, h[prefix], row[prefix], rank[prefix], blocks)
        distinct_hashes = hashed.view(np.uint64)
        bands = []
        for k in range(BANDS):
            band = np.full(count, np.uint64(k), np.uint64)
            for j in range(BAND_WORDS):
                band = _mixed(band ^ per_row(_mixed(distinct_hashes, 11 + k * BAND_WORDS + j)[word], np.minimum), 9)
            bands.append(band.view(np.int64))
        leaders = np.stack(bands, 1).reshape(-1) if count else np.zeros(0, np.int64)
        yield pa.RecordBatch.from_arrays(
            [
                b.column(0), b.column(1), pa.array(hash_a), pa.array(hash_b), pa.array(n.astype(np.int32)), *map(pa.array, maps),
                _lists(pa.StructArray.from_arrays([pa.array(gram), pa.array(pos.astype(np.int32))], names=["gram", "pos"]), gram_row, count), _lists(leaders, np.repeat(np.arange(count), BANDS), count),
            ],
            names=["id", "side", "hash_a", "hash_b", "n", *MAPS, "posts", "bands"],
        )


def _word_sets(batches: Iterator[pa.RecordBatch], wanted: np.ndarray) -> Iterator[pa.RecordBatch]:
    for b in batches:
        slot = _slots(np.asarray(b.column(0)).astype(np.int64))
        b = b.filter(pa.array((wanted[slot >> 3] >> (slot & 7)) & 1 == 1))
        set_row, set_code, distinct = _row_sets(b.column(1))
        yield pa.RecordBatch.from_arrays([b.column(0), _lists(hash64(distinct)[set_code], set_row, b.num_rows)], names=["id", "words"])


def _slots(ids: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return ((ids.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - (FILTER_BITS.bit_length() - 1))).astype(np.int64)


def wanted_filter(pairs: DataFrame) -> np.ndarray:
    """A bit filter of the ids in pairs, FILTER_BITS bits whatever their number; unwanted ids may pass, wanted ones always do."""

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            slots = distinct_sorted(_slots(np.concatenate([np.asarray(c).astype(np.int64) for c in b.columns])))
            yield pa.RecordBatch.from_arrays([pa.array(slots)], names=["slot"])

    slots = pairs.select("a", "b").mapInArrow(fill, "slot bigint")
    # a bitmap of the built-in aggregate has 32,768 bits
    parts = slots.groupBy(F.expr("slot div 32768").alias("bucket")).agg(F.bitmap_construct_agg(F.expr("slot % 32768")).alias("bits"))
    out = np.zeros(FILTER_BITS // 8, np.uint8)
    for r in parts.toLocalIterator():
        out[r.bucket * 4096 : (r.bucket + 1) * 4096] = np.frombuffer(bytes(r.bits), np.uint8)
    return out


@dataclass
class WordSets:
    """The distinct word sets of a table: its rows' membership, and one row with maps, prefix words and leader keys per set."""

    texts: DataFrame
    members: DataFrame
    sets: DataFrame


def _small(rows: DataFrame) -> DataFrame:
    """rows, to be broadcast where they are counted as few, so that the wide table they are joined with stays where it is."""
    return F.broadcast(rows) if rows.count() <= BROADCAST_ROWS else rows


def word_sets(texts: DataFrame) -> WordSets:
    """texts (id, side, text) with equal word sets collapsed; the smallest id names a set."""
    frequent, texts_with = frequent_words(texts)
    rows = materialize(texts.select("id", "side", "text").mapInArrow(lambda it: _signatures(it, frequent, texts_with), SETS))
    key = ["hash_a", "hash_b", "n"]
    sets = rows.groupBy(*key).agg(F.min("id").alias("set_id"), F.bit_or("side").alias("sides"))
    members = materialize(rows.select("id", "side", *key).join(sets, key).select("id", "side", "set_id", "sides"))
    again = _small(members.where("id <> set_id").select("id"))
    mixed = _small(members.where("id = set_id and sides <> side").select("id", "sides"))
    firsts = rows.join(again, "id", "left_anti").join(mixed, "id", "left")
    meta = (F.col("n").cast("bigint") * 4 + F.coalesce("sides", "side")) * (1 << 24)
    return WordSets(texts, members, firsts.select(F.col("id").alias("set"), *MAPS, meta.alias("meta"), "posts", "bands"))


def may_be_alike() -> str:
    """The length and suffix filters of two sets a and b as SQL."""
    size = lambda s: f"shiftright({s}.meta, 26)"
    total = f"({size('a')} + {size('b')})"
    # the most words that may be in only one of two alike sets
    apart = f"({total} - 2 * ((({LIKE_NUM} * {total}) + {LIKE_NUM + LIKE_DEN - 1}) div {LIKE_NUM + LIKE_DEN}))"
    checks = [
        f"least({size('a')}, {size('b')}) * {LIKE_DEN} >= greatest({size('a')}, {size('b')}) * {LIKE_NUM}",
        " + ".join(f"bit_count(a.{m} ^ b.{m})" for m in MAPS) + f" <= {apart}",
    ]
    return " and ".join(checks)


class _Postings:
    """Posting lists as arrays, each list sorted by group and length, and the comparison of parts of them.

    A group is a part of a list whose rows are not compared with each other: one
    side of a bipartite join, or the sets of one label. Only groups that fill
    more than a sixteenth of a long list are kept apart; the rows of all others
    are one part, and equal labels are sorted out pair by pair.
    """

    def __init__(self, gram: np.ndarray, sets: np.ndarray, label: np.ndarray, meta: np.ndarray, maps: np.ndarray):
        side = (meta >> 24) & 3
        label = np.where(side == 3, label, -side)  # ids and labels are not negative, so a one-sided set has a group of its own side
        order = np.lexsort((label, gram))
        g, lab = gram[order], label[order]
        new_list = np.append(True, g[1:] != g[:-1])
        new_group = new_list | np.append(True, lab[1:] != lab[:-1])
        list_rows = np.diff(np.append(np.flatnonzero(new_list), len(g)))[np.cumsum(new_list) - 1]
        group_rows = np.diff(np.append(np.flatnonzero(new_group), len(g)))[np.cumsum(new_group) - 1]
        part = np.empty(len(g), np.int64)
        part[order] = np.where(group_rows > np.maximum(FEW, list_rows // 16), np.cumsum(new_group), 0)
        n = meta >> 26
        order = np.lexsort((n, part, gram))
        self.sets, self.label, self.maps, self.n, self.pos = sets[order], label[order], maps[:, order], n[order], (meta & ((1 << 24) - 1))[order]
        gram, part = gram[order], part[order]
        new_list = np.append(True, gram[1:] != gram[:-1])
        new_part = new_list | np.append(True, part[1:] != part[:-1])
        self.section = np.cumsum(new_part) - 1
        self.bounds = np.append(np.flatnonzero(new_part), len(gram))
        self.pool = part[self.bounds[:-1]] == 0
        self.list_of = (np.cumsum(new_list) - 1)[self.bounds[:-1]]
        self.index = self.pos <= self.n - -(-2 * LIKE_NUM * self.n // (LIKE_NUM + LIKE_DEN))
        self.folded = self.maps[0] ^ self.maps[1], self.maps[2] ^ self.maps[3]
        # the limit of a pair is at most the sum of both of these; sums of at most 254
        self.half = np.minimum(-(-(LIKE_DEN - LIKE_NUM) * self.n // (LIKE_DEN + LIKE_NUM)), 127).astype(np.uint8)

    def pairs(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs of sets (smaller, larger) that pass all filters."""
        held, size = [], 0
        for part in self._near():
            held.append(part)
            size += len(part[0])
            if size >= FLUSH:
                yield self._close(*map(np.concatenate, zip(*held, strict=True)))
                held, size = [], 0
        if held:
            yield self._close(*map(np.concatenate, zip(*held, strict=True)))

    def _near(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        width = int(self.n.max()) + 2 if len(self.n) else 1
        key = self.section * width + self.n
        # the words before the first shared one are in only one of the sets, which bounds the other's length
        longest = np.clip((self.n - self.pos) * (LIKE_NUM + LIKE_DEN) // LIKE_NUM - self.n, 0, width - 1)
        own = np.flatnonzero(self.index & self.pool[self.section])
        yield from self._windows(own, own + 1, np.searchsorted(key, self.section[own] * width + longest[own], side="right"))
        sections = np.searchsorted(self.list_of, np.arange(self.list_of[-1] + 2)) if len(self.list_of) else np.zeros(1, np.int64)
        for at in np.flatnonzero(np.diff(sections) > 1):
            for a in range(sections[at], sections[at + 1]):
                i = np.flatnonzero(self.index[self.bounds[a] : self.bounds[a + 1]]) + self.bounds[a]
                for b in range(sections[at], sections[at + 1]):
                    if a != b:  # of two sets of one length the one in the earlier part is the shorter
                        first = np.searchsorted(key, b * width + self.n[i], side="left" if a < b else "right")
                        yield from self._windows(i, first, np.searchsorted(key, b * width + longest[i], side="right"))

    def _close(self, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n, pos = self.n, self.pos
        total = n[i] + n[j]
        apart = total - 2 * -(-LIKE_NUM * total // (LIKE_NUM + LIKE_DEN))
        off = np.abs(pos[i] - pos[j]) + np.abs((n[i] - pos[i]) - (n[j] - pos[j]))
        keep = (off <= apart) & (self.label[i] != self.label[j])
        i, j, apart = i[keep], j[keep], apart[keep]
        keep = sum(np.bitwise_count(m[i] ^ m[j]).astype(np.int64) for m in self.maps) <= apart
        a, b = self.sets[i[keep]], self.sets[j[keep]]
        return np.minimum(a, b), np.maximum(a, b)

    def _windows(self, rows: np.ndarray, first: np.ndarray, last: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs of each row with the rows from first to last; long windows without those that the folded maps rule out."""
        many = last - first
        few = np.flatnonzero((many > 0) & (many <= FEW))
        for at in range(0, len(few), 1 << 14):
            k = few[at : at + (1 << 14)]
            j = np.repeat(first[k] - np.cumsum(many[k]) + many[k], many[k]) + np.arange(many[k].sum())
            yield np.repeat(rows[k], many[k]), j
        large = np.flatnonzero(many > FEW)
        cuts = np.flatnonzero(np.diff(self.section[rows[large]])) + 1 if len(large) else []
        f0, f1 = self.folded
        for part in np.split(large, cuts):
            for top in range(0, len(part), TILE_ROWS):
                k = part[top : top + TILE_ROWS]
                i, low, high = rows[k], first[k], last[k]
                begin, end = int(low.min()), int(high.max())
                g0, g1, half = f0[i, None], f1[i, None], self.half[i, None]
                for left in range(begin, end, TILE_COLUMNS):
                    right = min(left + TILE_COLUMNS, end)
                    bits = np.bitwise_count(g0 ^ f0[left:right])
                    bits += np.bitwise_count(g1 ^ f1[left:right])
                    near = np.flatnonzero(bits <= half + self.half[left:right])
                    r, j = np.divmod(near, right - left)
                    j += left
                    inside = (j >= low[r]) & (j < high[r])
                    yield i[r[inside]], j[inside]


def _prefix_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Candidate pairs of postings sorted by gram; a list that goes on in the next batch is held."""
    held: list[list[np.ndarray]] = []
    for b in chain(batches, [None]):
        done: list[list[np.ndarray]] = []
        if b is None:
            done = held
        elif b.num_rows:
            columns = [np.asarray(c) for c in b.columns]
            gram = columns[0]
            cut = int(np.searchsorted(gram, gram[-1]))  # where the last list begins
            if cut or held and held[-1][0][-1] != gram[-1]:
                done, held = [*held, [c[:cut] for c in columns]], []
            held.append([c[cut:] for c in columns])
        if done:
            gram, sets, label, meta, *maps = (np.concatenate(c) for c in zip(*done, strict=True))
            for a, b2 in _Postings(gram, sets, label, meta, np.stack([m.view(np.uint64) for m in maps])).pairs():
                if len(a):
                    yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b2)], names=["a", "b"])


def candidate_pairs(sets: DataFrame, label: str = "set") -> DataFrame:
    """(a, b), a < b, of all sets that share a word of their exact prefixes and pass the filters, unless they have one label; pairs may repeat."""
    posted = sets.select("set", F.expr(label).alias("label"), *MAPS, "meta", F.explode("posts").alias("g"))
    posted = posted.select("g.gram", "set", "label", (F.col("meta") + F.col("g.pos")).alias("meta"), *MAPS)
    return posted.repartition("gram").sortWithinPartitions("gram").mapInArrow(_prefix_pairs, "a bigint, b bigint")


def verified(texts: DataFrame, pairs: DataFrame) -> DataFrame:
    """The pairs (a, b) whose texts are alike, as a table; each is verified once on its full word sets.

    Only texts whose id passes a filter of bounded size are tokenised and shuffled.
    """
    pairs = materialize(pairs.distinct())
    wanted = wanted_filter(pairs)
    sets_of = materialize(texts.select("id", "text").mapInArrow(lambda it: _word_sets(it, wanted), "id bigint, words array<bigint>"))
    left = sets_of.select(F.col("id").alias("a"), F.col("words").alias("wa"))
    right = sets_of.select(F.col("id").alias("b"), F.col("words").alias("wb"))
    shared = F.size(F.array_intersect("wa", "wb"))
    either = F.size("wa") + F.size("wb") - shared
    found = materialize(pairs.join(left, "a").join(right, "b").where(shared * LIKE_DEN >= either * LIKE_NUM).select("a", "b"))
    discard(pairs)
    discard(sets_of)
    return found


def likeness_links(texts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """texts (id, side, text) to (members (id, side, set_id, sides), links (a, b) between set ids, a < b).

    side is a bit mask; two sets are compared when one holds side 1 and the
    other side 2, so a side of 3 everywhere compares all of them. Null is the
    empty text; texts without words form one set that is like no other.
    """
    found = word_sets(texts)
    return found.members, verified(texts, candidate_pairs(found.sets))


def leader_pairs(sets: DataFrame) -> DataFrame:
    """(a, b) of every set b with the leader a, the smallest set, of each of its keys that a crowd of sets has, where the two may be alike."""
    keyed = sets.select(F.explode("bands").alias("band"), "set")
    leader = keyed.groupBy("band").agg(F.min("set").alias("leader"), F.count(F.lit(1)).alias("n")).where(F.col("n") >= CROWD)
    stars = keyed.join(leader, "band").where("set > leader").select(F.col("leader").alias("a"), F.col("set").alias("b")).distinct()
    maps = sets.select("set", *MAPS, "meta")
    left = stars.join(maps.alias("a"), F.col("a") == F.col("a.set")).select(F.struct("a.*").alias("a"), "b")
    return left.join(maps.alias("b"), F.col("b") == F.col("b.set")).select("a", F.struct("b.*").alias("b")).where(may_be_alike()).select(F.col("a.set").alias("a"), F.col("b.set").alias("b"))


def likeness_classes(texts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """texts (id, text) to (members (id, side, set_id, sides), classes (set_id, class_id)) of the sets that have a link.

    Classes need no more links than those that join them. First every set that
    has a leader key in common with a crowd is compared with the crowd's leader;
    then the exact prefix join leaves out the pairs inside the classes found so
    far. A large class is never compared pair by pair, and every pair between
    different classes still is.
    """
    texts = texts.select("id", F.lit(3).alias("side"), "text")
    found = word_sets(texts)
    stars = materialize(leader_pairs(found.sets))
    sets, label = found.sets, "set"
    if stars.take(1):
        stars = verified(texts, stars)
        known = materialize(connected_components(stars).select(F.col("node").alias("set"), "component"))
        sets, label = sets.join(known, "set", "left"), "coalesce(component, set)"
    links = verified(texts, candidate_pairs(sets, label))
    classes = connected_components(stars.unionAll(links))
    return found.members, classes.select(F.col("node").alias("set_id"), F.col("component").alias("class_id"))


#: Of rows t(id, text): w (id, word list, key of the word set) and alike (a, b), the pairs of different sets by counting shared words.
LIKE_SQL = r"""v AS (SELECT id, list_sort(list_distinct(regexp_extract_all(lower(text), '[\p{L}\p{N}]+'))) AS l FROM t),
w AS (SELECT id, l, array_to_string(l, ' ') AS k FROM v), s AS (SELECT k, any_value(l) AS l FROM w GROUP BY k), x AS (SELECT k, len(l) AS n, unnest(l) AS word FROM s),
alike AS (SELECT a.k AS a, b.k AS b FROM x a JOIN x b ON a.word = b.word AND a.k <> b.k GROUP BY 1, 2, a.n, b.n HAVING count(*) * 100 >= 65 * (a.n + b.n - count(*)))"""
