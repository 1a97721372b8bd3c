import random
import re

import pytest
from pyspark.sql import functions as F

from selvedge.llm.near_duplicates import near_duplicate_groups
from selvedge.llm.split_overlaps import cross_split_pairs

VOCABULARY = [f"w{k:03d}" for k in range(400)]


def bag(t):
    return frozenset(re.findall(r"[^\W_]+", (t or "").lower()))


def like(a, b):
    return a == b or bool(a | b) and len(a & b) / len(a | b) >= 0.65


def corpus(seed, n=60):
    r = random.Random(seed)
    out = []
    for k in range(n):
        words = r.choices(VOCABULARY, k=r.choice([3, 6, 12, 40, 90]))
        out.append(" ".join(words))
        for _ in range(r.choice([0, 0, 1, 3])):
            edited = list(words)
            for _ in range(max(1, len(words) // 12)):
                at = r.randrange(len(edited))
                r.choice([lambda: edited.pop(at) if len(edited) > 2 else None, lambda: edited.insert(at, r.choice(VOCABULARY)), lambda: edited.__setitem__(at, r.choice(VOCABULARY))])()
            out.append(" ".join(edited).capitalize() + ".")
    return out + [out[0], None, "", "  ", "?!", "same words here", "Here, same words", "one"]


@pytest.mark.parametrize("seed", range(3))
def test_groups_are_those_of_all_pairs(spark, seed):
    texts = corpus(seed)
    sets = [bag(t) for t in texts]
    group = list(range(len(texts)))

    def find(x):
        while group[x] != x:
            x = group[x]
        return x

    for a in range(len(texts)):
        for b in range(a):
            if like(sets[a], sets[b]):
                group[find(a)] = find(b)
    want = {}
    for k in range(len(texts)):
        want.setdefault(find(k), set()).add(k)
    df = spark.createDataFrame(list(enumerate(texts)), "id bigint, text string").withColumn("set_hash", F.lit(1)).withColumn("side", F.lit("x"))
    got = {}
    for r in near_duplicate_groups(df).collect():
        got.setdefault(r.group_id, set()).add(r.id)
    assert {frozenset(v) for v in got.values()} == {frozenset(v) for v in want.values() if len(v) > 1}


@pytest.mark.parametrize("seed", range(2))
def test_cross_split_pairs_are_all_of_them(spark, seed):
    r = random.Random(seed)
    rows = [(k, r.choice(["train", "train", "test", "dev", None]), t) for k, t in enumerate(corpus(seed + 50))]
    want = {(a, b) for a, s, t in rows for b, u, v in rows if s == "train" and u not in ("train", None) and bag(t) and like(bag(t), bag(v))}
    df = spark.createDataFrame(rows, "id bigint, split string, text string").withColumn("sides", F.lit(7))
    got = [(x.train_id, x.held_out_id) for x in cross_split_pairs(df).collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_many_copies_and_long_texts(spark):
    long = " ".join(f"x{k}" for k in range(30_000))
    texts = ["the same short text again"] * 500 + [long, long + " more", "other"]
    got = near_duplicate_groups(spark.createDataFrame(list(enumerate(texts)), "id bigint, text string")).groupBy("group_id").count().collect()
    assert sorted(r["count"] for r in got) == [2, 500]


def test_a_large_class_is_not_compared_pair_by_pair(spark, monkeypatch):
    from selvedge.llm import likeness

    r = random.Random(8)
    base = r.choices([f"b{k}" for k in range(3000)], k=80)
    texts = []
    for _ in range(1500):
        words = list(base)
        for at in r.sample(range(80), 8):
            words[at] = r.choice(VOCABULARY)
        texts.append(" ".join(words))
    texts += [" ".join(r.choices([f"c{k}" for k in range(5000)], k=60)) for _ in range(1500)]
    seen = []
    check = likeness.verified
    monkeypatch.setattr(likeness, "verified", lambda t, p: (seen.append(p.count()), check(t, p))[1])
    df = spark.createDataFrame(list(enumerate(texts)), "id bigint, text string")
    got = near_duplicate_groups(df).groupBy("group_id").count().collect()
    assert [x["count"] for x in got] == [1500]
    assert sum(seen) < 60_000  # of 1.1 million pairs in the class


def test_empty_tables(spark):
    assert near_duplicate_groups(spark.createDataFrame([], "id bigint, text string")).count() == 0
    assert cross_split_pairs(spark.createDataFrame([], "id bigint, split string, text string")).count() == 0


def test_a_hot_class_of_reordered_copies_stays_one_group(spark):
    r = random.Random(11)
    base = [f"h{k}" for k in range(40)]
    texts = []
    for k in range(60):  # a third of the rows, likeness 0.67 of any two
        words = [*base[:36], *(f"e{k}x{j}" for j in range(4))] if k % 2 else [*base[4:], *(f"e{k}x{j}" for j in range(4))]
        r.shuffle(words)
        texts.append(" ".join(words))
    texts += [" ".join(r.choices([f"c{k}" for k in range(3000)], k=40)) for _ in range(120)]
    sets = [bag(t) for t in texts]
    assert sum(like(a, b) for a in sets[:60] for b in sets[:60]) > 60 * 20
    got = near_duplicate_groups(spark.createDataFrame(list(enumerate(texts)), "id bigint, text string"))
    assert sorted(x.id for x in got.collect()) == list(range(60))


def test_pairs_of_unlike_lengths_and_orders(spark):
    r = random.Random(12)
    common = [f"k{k}" for k in range(12)]
    longer = [w for k in range(12) for w in ([common[k], f"new{k}"] if k % 3 == 2 else [common[k]])]
    base = [f"l{k}" for k in range(50)]
    moved = [*base[:45], "other"]
    r.shuffle(moved)
    rows = [(1, "train", " ".join(common)), (2, "test", " ".join(longer)), (3, "train", " ".join(base)), (4, "dev", " ".join(moved))]
    rows += [(10 + k, "train", " ".join([*r.sample(common, 6), *r.sample(base, 20), *(f"f{k}x{j}" for j in range(30))])) for k in range(100)]
    got = {(x.train_id, x.held_out_id) for x in cross_split_pairs(spark.createDataFrame(rows, "id bigint, split string, text string")).collect()}
    assert got == {(1, 2), (3, 4)}


@pytest.mark.parametrize("list_texts, sides", [(100_000, 3), (15, 3), (15, None)])
def test_candidates_hold_every_alike_pair_also_when_lists_are_cut(monkeypatch, list_texts, sides):
    import numpy as np
    import pyarrow as pa

    from selvedge.llm import likeness as L

    monkeypatch.setattr(L, "LIST_TEXTS", list_texts)
    r = random.Random(list_texts)
    few = [f"q{k}" for k in range(60)]
    texts = []
    for _ in range(60):
        words = r.sample(few, r.randint(4, 40))
        texts.append(words)
        for _ in range(3):
            other = list(words)
            for _ in range(r.randint(0, 1 + len(words) // 5)):
                r.choice([lambda o=other: o.pop(r.randrange(len(o))) if len(o) > 2 else None, lambda o=other: o.append(r.choice(few))])()
            r.shuffle(other)
            texts.append(other)
    texts = [" ".join(t) for t in texts]
    side = [sides or r.choice([1, 2, 3]) for _ in texts]
    column = pa.array(texts, pa.large_string())
    counts = {}
    for out in L._document_frequency(iter([pa.RecordBatch.from_arrays([column], names=["text"])])):
        counts |= {w: n for w, t, n in zip(*(c.to_pylist() for c in out.columns), strict=True) if not t and n > 20}
    hashes = sorted(counts)
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(side, pa.int32()), column], names=["id", "side", "text"])
    rows = [x for out in L._signatures(iter([batch]), np.array(hashes, np.int64), np.array([counts[h] for h in hashes], np.int64)) for x in out.to_pylist()]
    posted = sorted((p["gram"], x["id"], x["id"], (x["n"] * 4 + x["side"]) * (1 << 24) + p["pos"], *(x[m] for m in L.MAPS)) for x in rows for p in x["posts"])
    columns = [pa.array(c, pa.int64()) for c in zip(*posted, strict=True)]
    half = len(posted) // 2
    table = pa.RecordBatch.from_arrays(columns, names=["gram", "set", "label", "meta", *L.MAPS])
    found = {(a, b) for out in L._prefix_pairs(iter([table.slice(0, half), table.slice(half)])) for a, b in zip(*(c.to_pylist() for c in out.columns), strict=True)}
    sets = [bag(t) for t in texts]
    may = lambda a, b: bool(side[a] & 1 and side[b] & 2 or side[a] & 2 and side[b] & 1)
    want = {(a, b) for b in range(len(texts)) for a in range(b) if like(sets[a], sets[b]) and may(a, b)}
    assert len(want) > 50 and want <= found
