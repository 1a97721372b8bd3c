import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from selvedge.llm.tokens import distinct_sorted, flat, rolling_hash, rows_of, words


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="aÉß 1_,.-\n中", max_size=30), max_size=5))
def test_words_of_a_batch(texts):
    values, off = words(flat(pa.array(texts, pa.string())))
    got = [values.to_pylist()[a:b] for a, b in zip(off, off[1:], strict=False)]
    assert got == [re.findall(r"[^\W_]+", t.lower()) for t in texts]


def test_rolling_hash_stays_within_rows():
    h, rows = rolling_hash(np.array([1, 2, 3, 1, 2, 3], np.int64), rows_of(np.array([0, 3, 6])), 2)
    assert rows.tolist() == [0, 0, 1, 1] and h[0] == h[2] and h[1] == h[3]
    assert len(rolling_hash(np.zeros(0, np.int64), np.zeros(0, np.int64), 3)[0]) == 0


def test_distinct_values_in_order():
    assert distinct_sorted(np.array([3, 1, 3, 2, 1])).tolist() == [1, 2, 3] and distinct_sorted(np.zeros(0, np.int64)).tolist() == []


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet=st.characters(exclude_categories=("Cs", "Cn", "Co")), max_size=20)), max_size=6), st.integers(0, 3))
def test_words_are_runs_of_letters_and_digits(texts, skip):
    import pyarrow.compute as pc
    import regex

    array = flat(pa.array(texts, pa.string())).slice(min(skip, len(texts)))
    values, off = words(array)
    got = [values.to_pylist()[a:b] for a, b in zip(off, off[1:], strict=False)]
    assert got == [regex.findall(r"[\p{L}\p{N}]+", t) for t in pc.utf8_lower(array).to_pylist()]
