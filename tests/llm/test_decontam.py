import random
from collections import Counter, defaultdict
from itertools import combinations

from marketlens.llm import decontam
from marketlens.llm.decontam import AT_LEAST, LEAST, MASKS, SPAN, WINDOW


def brute(docs, items):
    out = set()
    for d, t in docs:
        w = (t or "").lower().split()
        places = defaultdict(list)
        for i, x in enumerate(w):
            places[x].append(i)
        for k, item in items:
            v = (item or "").lower().split()
            if len(v) < LEAST:
                continue
            size = min(WINDOW, len(v))
            need = size if size < SPAN else size - size * (WINDOW - AT_LEAST) // WINDOW
            offsets = Counter(i - j for j, x in enumerate(v) for i in places.get(x, ()))
            for off, c in offsets.items():
                same = [0 <= off + j < len(w) and w[off + j] == v[j] for j in range(len(v))]
                if c >= need and any(0 <= off + i and off + i + size <= len(w) and sum(same[i : i + size]) >= need for i in range(len(v) - size + 1)):
                    out.add((d, k))
    return out


def test_masks_hit_every_window_with_three_substitutions():
    shifted = [{i + s for i in m} for m in MASKS for s in range(WINDOW - max(m))]
    assert max(map(max, MASKS)) < SPAN
    for gone in combinations(range(WINDOW), WINDOW - AT_LEAST):
        assert any(not m.intersection(gone) for m in shifted)


def test_planted(spark, data, table):
    items = spark.read.parquet(f"{data}/benchmark.parquet")
    its = [tuple(r) for r in items.select("item_id", "text").collect()]
    rnd, rows = random.Random(3), [(5, None), (6, ""), (7, "  ")]
    for n in range(60):
        v = rnd.choice(its)[1].split()
        a = rnd.randrange(max(1, len(v) - 15))
        v = v[a : a + rnd.choice([15, 20, 30])]
        for _ in range(rnd.choice([0, 2, 3, 4, 5])):
            v[rnd.randrange(len(v))] = "zzz"
        rows.append((1000 + n, " ".join(["Pre"] * rnd.choice([0, 5, 50]) + v + ["post"] * rnd.choice([0, 3]))))
    rows += [(2000, its[0][1].upper()), (2000, its[0][1])]
    got = [(r.doc_id, r.item_id) for r in decontam.overlaps(table(rows, clash=True), items).collect()]
    assert set(got) == brute(rows, its) and len(got) == len(set(got)) and (2000, its[0][0]) in got


def test_documents(spark, data, documents):
    items = spark.read.parquet(f"{data}/benchmark.parquet")
    rows, its = ([tuple(r) for r in t.collect()] for t in (documents.select("doc_id", "text"), items.select("item_id", "text")))
    bad = brute(rows, its)
    assert {(r.doc_id, r.item_id) for r in decontam.overlaps(documents, items).collect()} == bad
    kept = {r.doc_id for r in decontam.decontaminated(documents, items).collect()}
    assert kept == {d for d, _ in rows} - {d for d, _ in bad}


def test_without_a_broadcast(spark, data, documents, monkeypatch):
    items = spark.read.parquet(f"{data}/benchmark.parquet")
    some = spark.createDataFrame([(900 + k, " ".join(r.text.split()[2 : 7 + k])) for k, r in enumerate(documents.filter("length(text) > 100").orderBy("doc_id").limit(8).collect())], "item_id long, text string")
    items = items.unionByName(some)
    want = sorted(map(tuple, decontam.overlaps(documents, items).collect()))
    assert {r[1] for r in want} & set(range(900, 908))
    monkeypatch.setattr(decontam, "BROADCAST_ROWS", 0)
    assert sorted(map(tuple, decontam.overlaps(documents, items).collect())) == want


def test_empty_and_odd_items(spark, table):
    text = " ".join(f"w{i}" for i in range(12))
    items = spark.createDataFrame([(1, None), (2, ""), (3, "too short"), (None, text), (4, text), (4, text)], "item_id long, text string")
    rows = [(1, f"a {text} b"), (1, f"a {text} b"), (None, text), (2, text.replace("w3", "x").replace("w7", "y")), (3, " ".join(text.split()[:9]))]
    got = sorted((r.doc_id or 0, r.item_id, r.start, r.n_tokens, r.n_equal) for r in decontam.overlaps(table(rows), items).collect())
    assert got == [(0, 4, 0, 12, 12), (1, 4, 1, 12, 12), (2, 4, 0, 12, 10)]
    assert decontam.overlaps(table([]), items).collect() == []
    assert decontam.overlaps(table(rows), items.limit(0)).collect() == []


def test_all_substitutions_that_are_allowed_are_found(spark, table):
    items, rows = [], []
    for n in range(1, SPAN):  # whole, at the start, within and at the end of a text, with and without a difference
        words = [f"i{n}.{j}" for j in range(n)]
        items.append((n, " ".join(words)))
        for k, gone in enumerate([None, *range(n)]):
            text = " ".join("x" if j == gone else w for j, w in enumerate(words))
            rows += [(100_000 * n + 10 * k + i, f"{a}{text}{b}") for i, (a, b) in enumerate([("", ""), ("pre ", ""), ("", " post"), ("a b c d e f g ", " h i j")])]
    assert {k for _, k in brute(rows, items)} == {5, 6, 7, 8, 9}
    for n in range(SPAN, WINDOW + 1):
        words = [f"i{n}.{j}" for j in range(n)]
        items.append((n, " ".join(words)))
        for gone in combinations(range(n), n * (WINDOW - AT_LEAST) // WINDOW):
            rows.append((1000 * n + len(rows), " ".join("x" if j in gone else w for j, w in enumerate(words))))
        rows.append((1000 * n + len(rows), " ".join(words[:-3] + ["x"] * 4)) if n < WINDOW else (7, " ".join(words[:-4] + ["x"] * 5)))  # one too many
    its = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontam.overlaps(table(rows), its).collect()}
    assert got == brute(rows, items) and len(got) == 5 * 4 + 45 + 55 + 66 + 78 + 91 + 455


def test_rows_that_repeat_an_id_are_judged_apart(spark, table):
    text = " ".join(f"w{i}" for i in range(16))
    items = spark.createDataFrame([(1, text)], "item_id long, text string")
    rows = [(1, f"a {text} b"), (1, "clean words"), (None, text), (None, "clean"), (2, None)]
    kept = [(r.doc_id, r.text) for r in decontam.decontaminated(table(rows, clash=True), items).collect()]
    assert sorted(kept, key=str) == sorted([(1, "clean words"), (None, "clean"), (2, None)], key=str)
