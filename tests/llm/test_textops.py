import numpy as np
import pyarrow as pa
import pytest

from marketlens.llm import suffix_dedup, textops
from marketlens.llm.textops import IMAGE, WORD_BASE, Texts

TEXTS = [None, "", " ", "a", "a\n\nb ", "one two\tthree one two", "é è\x0bé", "x" * 50, "b a", "one two"]


def test_words_and_hashes():
    t = Texts.of(pa.array(TEXTS))
    start, end, at = t.words()
    want = [(x or "").encode().split() for x in TEXTS]
    data = t.data.tobytes()
    assert [data[i:j] for i, j in zip(start, end)] == [w for ws in want for w in ws]
    assert np.diff(at).tolist() == [len(ws) for ws in want]
    hashes = textops.span_hashes(IMAGE[t.data], start, end)
    flat = [w for ws in want for w in ws]
    assert len(set(hashes.tolist())) == len(set(flat)) and len({*zip(hashes.tolist(), flat)}) == len(set(flat))
    where = textops.windows(at, 2)
    pairs = [tuple(flat[i : i + 2]) for i in where]
    assert pairs == [p for ws in want for p in zip(ws, ws[1:])]
    h = textops.span_hashes(hashes, where, where + 2, WORD_BASE)
    assert len({*zip(h.tolist(), pairs)}) == len(set(pairs)) == len(set(h.tolist()))


def test_slices_of_arrays():
    column = pa.array(TEXTS).slice(3, 4)
    t = Texts.of(column)
    assert [t.data[a:b].tobytes().decode() for a, b in zip(t.at, t.at[1:])] == TEXTS[3:7]
    assert Texts.of(pa.array([], pa.string())).at.tolist() == [0]


def test_runs():
    assert textops.covered(6, np.array([1, 2]), 2).tolist() == [False, True, True, True, False, False]
    assert textops.chunks(np.array([3, 3, 9, 1, 1]), 6) == [(0, 2), (2, 3), (3, 5)] and textops.chunks(np.array([], int), 6) == []


@pytest.mark.parametrize("n", [0, 1, 1000])
def test_packed_numbers(n):
    rng = np.random.default_rng(n)
    x = np.unique(rng.integers(0, 2**63, n).astype(np.uint64) * np.uint64(2))
    assert np.array_equal(textops.unpack_sorted(textops.pack_sorted(x)), x)
    y = rng.integers(0, 2**32, n)
    assert np.array_equal(textops.unpack_numbers(textops.pack_numbers(y)), y)


@pytest.mark.parametrize("size, width", [(0, 3), (2, 3), (3, 3), (10, 3), (50, 7), (49, 1)])
def test_sliding_min(size, width):
    x = np.random.default_rng(size).integers(0, 100, size).astype(np.uint64)
    assert suffix_dedup.sliding_min(x, width).tolist() == [min(x[i : i + width]) for i in range(size - width + 1)]
