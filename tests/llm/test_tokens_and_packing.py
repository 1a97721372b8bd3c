import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from selvedge.llm import token_budget
from selvedge.llm.packing import exact_fill, pack, pack_plan, plan_intervals
from selvedge.llm.token_budget import Pieces, count_tokens, cut_points

PIECES = ["a", "ab", "abc", "b", "##a", "##b", "##bc", "##c", "é", "c", "12", "##3"]


def brute(text):
    vocabulary, n = set(PIECES), 0
    for part in (text or "").lower().split():
        word = ""
        for ch in part + "\0":
            if ch.isalnum():
                word += ch
                continue
            at = 0
            while at < len(word):
                end = next((e for e in range(len(word), at, -1) if ("##" if at else "") + word[at:e] in vocabulary), at + 1)
                n, at = n + 1, end
            word = ""
            n += ch != "\0"
    return n


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet="abcABCé123 .,-\n\t ​中", max_size=25), max_size=4))
def test_counts(texts):
    import pyarrow as pa

    assert Pieces(PIECES).counts(pa.array(texts, pa.string())).tolist() == [brute(t) for t in texts]


@settings(max_examples=100, deadline=None)
@given(st.text(alphabet="abc .\n", max_size=80), st.integers(1, 20))
def test_cuts_change_no_count(text, size):
    parts = list(cut_points(text, size))
    assert "".join(parts) == text and sum(map(brute, parts)) == brute(text)


def test_large_documents_are_counted_in_chunks(spark, monkeypatch):
    monkeypatch.setattr(token_budget, "CHUNK_CHARS", 50)
    texts = ["ab abc. " * 40, "abc", None, "", "a" * 400, "ab abc. " * 40]
    df = spark.createDataFrame(list(enumerate(texts)), "id bigint, text string").withColumnRenamed("text", "body")
    got = {r.id: r.n_tokens for r in count_tokens(df, Pieces(PIECES), "body", ["id"]).collect()}
    assert got == {k: brute(t) for k, t in enumerate(texts)}
    assert count_tokens(df.limit(0), Pieces(PIECES), "body", ["id"]).count() == 0


@pytest.mark.parametrize("seed", range(6))
def test_plan_uses_every_item_once(seed):
    r = random.Random(seed)
    capacity = 64
    histogram = {}
    for _ in range(400):
        n = min(capacity, max(1, int(r.lognormvariate(2.2, 0.9))))
        histogram[n] = histogram.get(n, 0) + 1
    used = dict.fromkeys(histogram, 0)
    containers = 0
    for times, items in pack_plan(histogram, capacity):
        assert sum(a * b for a, b in items) <= capacity
        containers += times
        for length, per in items:
            used[length] += per * times
    assert used == histogram
    best = -(-sum(a * b for a, b in histogram.items()) // capacity)
    assert containers <= best + 1


def test_exact_fill_finds_three():
    import numpy as np

    left = np.zeros(65, np.int64)
    left[[5, 7, 20]] = 1
    assert sorted(exact_fill(32, left)) == [5, 7, 20] and exact_fill(10, left) is None
    left[5] = 2
    assert sorted(exact_fill(10, left)) == [5, 5]
    assert len(plan_intervals([])) == 0


def test_packing(spark):
    r = random.Random(3)
    rows = [(k, min(500, int(r.expovariate(1 / 20)))) for k in range(800)] + [(k, 17) for k in range(10_000, 10_400)] + [(20_000, 0), (20_001, 257), (5, 3)]
    got = pack(spark.createDataFrame(rows, "id bigint, n_tokens bigint"), 100).collect()
    used = {}
    for x in got:
        if x.size:
            used[x.container_id] = used.get(x.container_id, 0) + x.size
        else:
            assert x.container_id is None
    total = sum(n for _, n in rows)
    assert sum(used.values()) == total and max(used.values()) <= 100 and len(used) <= -(-total // 100) + 2
    assert sorted(x.size for x in got if x.id == 20_001) == [57, 100, 100]
    assert all(x.part == 0 for x in got if dict(rows).get(x.id, 0) <= 100 and x.id != 5)
    assert len([x for x in got if x.id == 20_000]) == 1
    assert pack(spark.createDataFrame([], "id bigint, n_tokens bigint"), 100).count() == 0
