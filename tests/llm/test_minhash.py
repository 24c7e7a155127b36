import numpy as np
import pytest

from marketlens.llm import components, minhash

TEXT = " ".join(map(str, range(300)))
CASES = [
    (1, "a b c d e f g"), (2, None), (3, ""), (4, "A b c d e f g"), (4, "x y"), (5, "X  y"), (6, " "), (7, TEXT), (8, " ".join(map(str, range(295)))), (9, " ".join(map(str, range(20, 300)))),
    (10, "É b c d e f"), (11, "é b c d e f"),
]


def brute(rows, percent=85):
    sets = []
    for d, t in rows:
        w = (t or "").encode().lower().split()  # bytes: only A-Z change
        sets.append((d, {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()))
    parent = list(range(len(sets)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, (_, a) in enumerate(sets):
        for j in range(i):
            b = sets[j][1]
            if a and b and 100 * min(len(a), len(b)) >= percent * max(len(a), len(b)) and 100 * len(a & b) >= percent * len(a | b):
                parent[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(sets):
        least[root(i)] = min(least.get(root(i), d), d)
    return sorted((d, len(s), least[root(i)], d == least[root(i)]) for i, (d, s) in enumerate(sets))


def test_cases(table):
    assert sorted(map(tuple, minhash.near_duplicates(table(CASES, clash=True)).collect())) == brute(CASES)
    assert minhash.near_duplicates(table([])).collect() == []


def test_documents_without_an_id(table):
    got = minhash.near_duplicates(table([(None, TEXT), (None, None), (3, TEXT), (5, TEXT)])).collect()
    assert sorted((r.doc_id or 0, r.component_id, r.kept) for r in got if r.doc_id) == [(3, 3, True), (5, 3, False)]
    assert all(r.component_id is None and r.kept for r in got if r.doc_id is None)


def test_documents(documents):
    rows = [tuple(r) for r in documents.select("doc_id", "text").collect()]
    assert sorted(map(tuple, minhash.near_duplicates(documents).collect())) == brute(rows)


def test_a_large_group_edited_apart(table):
    rng = np.random.default_rng(5)
    base = [f"w{i}" for i in range(200)]
    rows = []
    for d in range(150):  # most are linked to some, few to all
        words = list(base)
        for i in rng.choice(200, rng.integers(0, 5), replace=False):
            words[i] = f"e{d}.{i}"
        rows.append((d, " ".join(words)))
    got = sorted(map(tuple, minhash.near_duplicates(table(rows)).collect()))
    assert got == brute(rows) and len({r[2] for r in got}) > 1


def test_keys_meet_under_the_threshold():
    rng = np.random.default_rng(2)
    a = rng.integers(0, 256, (300, minhash.POSITIONS)).astype(np.uint8)
    b = a.copy()
    for x in b:
        at = rng.choice(minhash.POSITIONS, minhash.THRESHOLD, replace=False)
        x[at] = x[at] + 1
    assert (minhash._keys(a) == minhash._keys(b)).any(1).all()


@pytest.mark.parametrize("edges, want", [([], {}), ([(1, 1)], {}), ([(5, 2), (2, 5), (9, 5), (7, 8)], {2: 2, 5: 2, 9: 2, 7: 7, 8: 7}), ([(i, i + 1) for i in range(60)], {i: 0 for i in range(61)})])
def test_components(spark, edges, want):
    got = components.components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert {r.node: r.component for r in got} == want


def test_components_say_that_the_rounds_ran_out(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(60)], "a long, b long")
    with pytest.raises(RuntimeError):
        components.components(chain, rounds=1)


@pytest.mark.parametrize("percent", [80, 85])
def test_pairs_at_the_bound_are_under_the_threshold(percent):
    """Of 4,000 pairs just as similar as they must be, none has signatures that differ in more positions than are allowed."""
    rng = np.random.default_rng(11)
    positions, _, threshold = minhash.layout(percent)
    n = 200
    both = -(-2 * n * percent // (100 + percent))  # shared by two sets of n, for a similarity of percent
    worst = 0
    for _ in range(20):
        common, mine, other = (rng.integers(0, 2**63, (200, k)).astype(np.uint64) for k in (both, n - both, n - both))
        at = np.arange(201) * n
        a, b = (minhash.signatures(np.concatenate([common, x], 1).ravel(), at, positions) for x in (mine, other))
        worst = max(worst, int((a != b).sum(1).max()))
    assert 100 * both >= percent * (2 * n - both) and positions * (100 - percent) // 100 < worst <= threshold


def test_a_group_whose_edits_recur(table):
    """Copies that share edits in pairs: linked to each other, and not to the hub."""
    rng, rows = np.random.default_rng(6), []
    base = [f"w{i}" for i in range(160)]
    for k in range(60):
        words = list(base)
        for i in rng.choice(31, rng.integers(0, 7), replace=False):
            words[5 * i + 2] = f"e{k // 2}.{i}"
        rows.append((2 * k, " ".join(words)))
        words[int(rng.integers(0, 160))] = "own"
        rows.append((2 * k + 1, " ".join(words)))
    want = brute(rows)
    assert sorted(map(tuple, minhash.near_duplicates(table(rows)).collect())) == want and len({r[2] for r in want}) > 5


def test_rare_shingles_leave_out_no_pair():
    """The members that a bucket names, against all pairs that are similar enough."""
    rng = np.random.default_rng(12)
    base = rng.integers(0, 2**62, 150)
    sets = []
    for _ in range(120):
        keep = rng.random(150) > rng.choice([0.0, 0.03, 0.1])
        sets.append(np.unique(np.concatenate([base[keep], rng.choice(500, rng.integers(0, 14)) + 7])))
    every, count = np.unique(np.concatenate(sets), return_counts=True)
    times = dict(zip(every.tolist(), count.tolist()))
    lists, known = [], []
    for x in sets:
        order = sorted(x.tolist(), key=lambda h: (times[h], h))
        own = sum(times[h] == 1 for h in order)
        known.append(len(x) - own)
        lists.append(np.array(order[own : len(x) + 1 + -85 * len(x) // 100], np.uint64).astype("<u4").tobytes())
    n = len(sets)
    import pyarrow as pa

    from marketlens.llm import exchange
    from marketlens.llm.textops import pack_sorted

    planes = lambda x: minhash._planes(np.array(x, np.int64))
    row = (0, pack_sorted(np.full(n, 5, np.uint64)), np.arange(n).astype("<u2").view(np.uint8).reshape(-1, 2).T.tobytes(), planes(range(n)), planes(range(n)), planes([len(x) for x in sets]), planes(known), b"".join(lists), planes([len(x) // 4 for x in lists]))
    got = pa.Table.from_batches([exchange.batch([row], minhash.KEYS)])
    found = {tuple(x) for x in zip(*minhash._pairs("rare", 0, 85)((None,), got).to_pydict().values())}
    want = {(i, j) for i in range(n) for j in range(i + 1, n) if 100 * len(np.intersect1d(sets[i], sets[j])) >= 85 * len(np.union1d(sets[i], sets[j]))}
    assert want <= found and len(want) > 100 and len(found) < n * (n - 1) // 2
