import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from loomwork.llm.text import grams, gram_mask, slices, words

texts = st.lists(st.one_of(st.none(), st.text(alphabet="ab \t\n\x0b\x0c\r\x1c\x85é中", max_size=40)), min_size=1, max_size=8)


@settings(max_examples=150, deadline=None)
@given(texts, st.integers(0, 3))
def test_words_are_those_of_the_pattern(column, skip):
    array = pa.array([None, "x y", "z", *column], pa.string())[skip:]
    w = words(array)
    got = [[w.data[w.starts[j] : w.ends[j]].tobytes() for j in range(w.first[i], w.first[i + 1])] for i in range(len(array))]
    assert got == [re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode()) for t in array.to_pylist()]
    h, flat = w.hashes(), [x for d in got for x in d]
    assert len(set(h.tolist())) == len(set(flat)) and len(h) == len(flat)


@settings(max_examples=60, deadline=None)
@given(texts)
def test_grams_are_equal_where_words_are(column):
    w = words(pa.array(column, pa.string()))
    h = w.hashes()
    ok = gram_mask(w.first, 3)
    g = grams(h, 3)[ok]
    runs = [tuple(h[j : j + 3].tolist()) for i in range(len(column)) for j in range(w.first[i], w.first[i + 1] - 2)]
    assert len(g) == len(runs) and len(set(g.tolist())) == len(set(runs))


def test_slices_keep_all_rows_in_order():
    b = pa.RecordBatch.from_arrays([pa.array(range(9)), pa.array(["x" * 10, None, "", "y" * 100, "z"] + ["w" * 7] * 4)], ["i", "text"])
    parts = list(slices([b, b.slice(0, 0)], most=20))
    assert sum((p.column("i").to_pylist() for p in parts), []) == list(range(9)) and len(parts) > 3
    assert all(p.num_rows == 1 or sum(len(t or "") for t in p.column("text").to_pylist()) <= 20 for p in parts)


def test_hashes_do_not_depend_on_the_slice():
    a, b = words(pa.array(["q", "alpha beta"])), words(pa.array(["alpha beta"]))
    assert np.array_equal(a.hashes()[1:], b.hashes())
