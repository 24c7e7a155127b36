import hashlib
from collections import Counter
from itertools import compress

import numpy as np
import pytest

from marketlens.llm import block_dedup, suffix_dedup
from marketlens.llm.suffix_dedup import front_code, front_decode, merge

NUMBERS = " ".join(map(str, range(300)))
WORDS = [
    (1, " ".join(["a"] * 50)), (2, None), (3, ""), (4, " ".join(["a"] * 30)), (4, "x " + " ".join(["a"] * 25)), (4, "x " + " ".join(["a"] * 25)), (5, NUMBERS),
    (6, " ".join(map(str, range(100, 140))) + " q " + " ".join(map(str, range(150, 169)))), (7, " ".join(map(str, range(280, 300)))), (8, "éè   " + NUMBERS[:200]),
]
BYTES = [
    (1, "a" * 500), (2, None), (3, ""), (4, "ab" * 300), (4, "ab" * 300), (5, "".join(map(str, range(300)))), (6, "".join(map(str, range(100, 190))) + "q" + "".join(map(str, range(150, 249)))),
    (7, "z" * 199), (8, "z" * 199), (9, "é" * 60 + "x" * 30 + "é" * 100), (10, "é" * 160),
]


def sha(b):
    return hashlib.sha256(b).hexdigest()


def brute_words(rows, size=20):
    seen, out = set(), []
    for d, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        w = (t or "").encode().split()
        gone = [False] * len(w)
        for i in range(len(w) - size + 1):
            k = tuple(w[i : i + size])
            if k in seen:
                gone[i : i + size] = [True] * size
            seen.add(k)
        out.append((d, len(w), sum(gone), sha(b" ".join(x for x, g in zip(w, gone) if not g))))
    return out


def brute_bytes(rows, size=200):
    texts = [(d, (t or "").encode()) for d, t in rows]
    count = Counter(b[i : i + size] for _, b in texts for i in range(len(b) - size + 1))
    out = []
    for d, b in texts:
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - size + 1):
            if count[b[i : i + size]] > 1:
                gone[i : i + size] = True
        edges = np.diff(np.concatenate([[0], gone.astype(int), [0]]))
        out.append((d, len(b), int(gone.sum()), int((edges == 1).sum()), sha(bytes(compress(b, ~gone)))))
    return out


def check(got, want):
    key = lambda r: (r[0] is not None, r[0] or 0, *r[1:])
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)


@pytest.mark.parametrize("operator, cases, brute", [(block_dedup, WORDS, brute_words), (suffix_dedup, BYTES, brute_bytes)])
def test_cases(table, operator, cases, brute):
    rows = [*cases, (None, cases[0][1]), (None, None)]
    check(operator.digest(table(rows, clash=True)).collect(), brute(rows))
    assert operator.digest(table([])).collect() == []


@pytest.mark.parametrize("operator, brute", [(block_dedup, brute_words), (suffix_dedup, brute_bytes)])
def test_documents(documents, operator, brute):
    rows = [tuple(r) for r in documents.select("doc_id", "text").collect()]
    check(operator.digest(documents).collect(), brute(rows))


@pytest.mark.parametrize("operator, brute", [(block_dedup, brute_words), (suffix_dedup, brute_bytes)])
def test_hot_copies_and_a_long_text(table, operator, brute):
    rows = [(i, "".join(f"w{j} " for j in range(60))) for i in range(200)] + [(1000, " ".join(f"v{i * i % 7919}" for i in range(30_000)))]
    check(operator.digest(table(rows)).collect(), brute(rows))


def test_spans_and_texts_of_the_operators(table):
    r = {x.doc_id: x for x in block_dedup.remove_repeats(table(WORDS)).collect()}
    assert r[7].kept == "" and r[7].removed == [0, 20] and r[6].kept.startswith("q 150")
    s = {x.doc_id: x for x in suffix_dedup.remove_repeats(table(BYTES)).collect()}
    assert s[1].kept == b"" and s[1].removed == [0, 500] and s[7].removed == []


def test_merge_is_a_sort_with_common_prefixes():
    rng = np.random.default_rng(1)
    for runs in (1, 2, 3, 7):
        keys = [sorted({bytes(rng.integers(97, 99, rng.integers(0, 9)).astype(np.uint8)) for _ in range(40)}) for _ in range(runs)]
        out = list(merge([front_decode(front_code(k), len(k)) for k in keys]))
        texts = [t for *_, t in out]
        assert texts == sorted(x for k in keys for x in k)
        for a, (_, n, b) in zip(texts, out[1:]):
            assert a[:n] == b[:n] and (n == min(len(a), len(b)) or a[n] != b[n])
        for run in range(runs):
            assert [t for r, _, t in out if r == run] == keys[run]


def test_the_block_index_decides_which_windows_are_compared():
    import pyarrow as pa

    own = [f"w{i}" for i in range(60)]
    texts = [" ".join(own), " ".join(["x1", "x2", "x3", *own[13:47], *(f"y{i}" for i in range(30))]), " ".join(f"z{i}" for i in range(50)), " ".join(own[:15] + ["q"] * 3)]
    g = block_dedup.Group(pa.table([pa.array(range(4), pa.int64()), pa.array(texts)], names=["doc_id", "text"]), 20)
    g.probe()
    g.extend(g.blocks > 0, g.blocks > 1)
    at = g.at.tolist()
    found = set(g.found.tolist())
    # every window that occurs twice holds a hit, and texts without a repeated block have none
    assert {13 + i for i in range(15)} | {at[1] + 3 + i for i in range(15)} <= found
    assert not [x for x in found if at[2] <= x < at[3]] and len(found) < 60
    g.extend(np.zeros(len(g.probes), bool), np.zeros(len(g.probes), bool))
    assert not len(g.found)
