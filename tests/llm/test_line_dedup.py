import hashlib
from collections import defaultdict

from marketlens.llm import line_dedup

BASE = "one two three four five six seven eight nine ten"
CASES = [
    (1, BASE + "\n\n a b \nBe."), (2, BASE.replace("five", "5") + "\na  b\nEr."), (3, None), (4, ""), (5, BASE + " more\nx"), (6, "zero " + BASE),
    (7, BASE.replace("five", "5").replace("two", "2")), (8, " \n \n"), (9, BASE.replace("ten", "11") + "\n" + BASE.replace("one ", "") + "\n" + BASE),
]


def near(a, b):
    if a == b:
        return True
    fine = len(a) < line_dedup.LEAST
    if fine != (len(b) < line_dedup.LEAST):
        return False
    if fine:
        a, b = " ".join(a), " ".join(b)
        if min(len(a), len(b)) < line_dedup.FINE_LEAST:
            return False
    a, b = sorted((a, b), key=len)
    i = 0
    while i < len(a) and a[i] == b[i]:
        i += 1
    return a[i + 1 :] == b[i + 1 :] if len(a) == len(b) else a[i:] == b[i + 1 :]


def brute(rows):
    split = lambda line: tuple(x.decode() for x in line.encode().split())
    first, sizes = {}, defaultdict(list)
    for d, t in rows:
        for p, line in enumerate((t or "").split("\n")):
            if w := split(line):
                first[w] = min(first.get(w, (d, p)), (d, p))
    size = lambda w: (True, len(" ".join(w))) if len(w) < line_dedup.LEAST else (False, len(w))
    for w in first:
        sizes[size(w)].append(w)
    bad = {b for (k, n), ws in sizes.items() for b in ws if any(first[a] < first[b] and near(a, b) for m in (n - 1, n, n + 1) for a in sizes.get((k, m), ()) if a != b)}
    out = []
    for d, t in rows:
        n = r = 0
        keep = []
        for p, line in enumerate((t or "").split("\n")):
            if w := split(line):
                n += 1
                if w in bad or first[w] != (d, p):
                    r += 1
                    continue
            keep.append(line)
        out.append((d, n, r, hashlib.sha256("\n".join(keep).encode()).hexdigest()))
    return sorted(out)


def rows_of(df):
    return sorted(map(tuple, df.collect()))


def test_cases(table):
    assert rows_of(line_dedup.digest(table(CASES))) == brute(CASES)


def test_short_lines(table):
    rows = [
        (1, "The anhely eran of it."), (2, "The, anhely eran of it."), (3, "The anhely eran of it"), (4, "The anhely eran of ït."), (5, "The anhelyeran of it."), (6, "The anhely  eran\tof it."),
        (7, "Chapter 1\nChapter 2"), (8, "fifteen letters"), (9, "fifteen lettersx"), (10, "sixteen letters!"), (11, "sixteen letters?"), (12, "abcdefghijklmnopq"), (13, " ".join("abcdefghijklmnopq")),
        (14, "😀 a face of its own"), (15, "😁 a face of its own"), (16, "a b c d e f gggggggg"), (17, "a b c d e f g ggggggg"),
    ]
    got = rows_of(line_dedup.digest(table(rows)))
    assert got == brute(rows) and [d for d, _, r, _ in got if r] == [2, 3, 4, 5, 6, 11, 15]


def test_documents(documents):
    few = documents.filter("doc_id < 120")
    assert rows_of(line_dedup.digest(few)) == brute([tuple(r) for r in few.select("doc_id", "text").collect()])


def test_columns_nulls_and_empty_table(table):
    df = table([*CASES, (None, BASE), (None, None)], clash=True)
    out = line_dedup.remove_lines(df)
    assert out.columns == [*df.columns, "n_lines", "n_removed"]
    by = {r.doc_id: r for r in out.collect() if r.doc_id}
    assert by[2].text == "Er." and by[2].gone == "gone" and by[3].text is None
    assert sorted(r.text or "" for r in out.collect() if r.doc_id is None) == ["", BASE]
    assert line_dedup.digest(table([])).collect() == []


def test_many_equal_and_one_long_line(table):
    rows = [(i, BASE) for i in range(300)] + [(1000, " ".join(map(str, range(4000)))), (1001, " ".join(map(str, range(1, 4000))))]
    got = {r.doc_id: r.n_removed for r in line_dedup.digest(table(rows)).collect()}
    assert got[0] == 0 and sum(got.values()) == 300 and got[1001] == 1
