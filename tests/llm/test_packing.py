import zlib

import numpy as np

from marketlens.llm import packing


def check(df, rows, tokenizer, capacity=4096):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(tokenizer)
    r = df.toPandas()
    want = {d: np.array([*tok.encode(t or "", add_special_tokens=False).ids, 2], "<u4") for d, t in rows}
    assert set(r.doc_id) == set(want)
    for d, g in r.sort_values("start").groupby("doc_id"):
        at = 0
        for s, n, crc, total in zip(g.start, g.length, g.ids_crc32, g.doc_tokens):
            assert s == at and n > 0 and total == len(want[d]) and crc == zlib.crc32(want[d][s : s + n].tobytes())
            at += n
        assert at == len(want[d])
    padding = 0
    for _, g in r.sort_values("offset").groupby("sequence_id"):
        at = 0
        for o, n in zip(g.offset, g.length):
            assert o == at
            at += n
        assert at <= capacity
        padding += 0 if at & (at - 1) == 0 else capacity - at
    assert padding == 0


def test_documents(documents, tokenizer):
    check(packing.pack(documents, tokenizer), [tuple(r) for r in documents.select("doc_id", "text").collect()], tokenizer)


def test_cases(table, tokenizer):
    odd = ["it's <|endoftext|> ok", "naïve İstanbul ΑΣ ﬁne é x​y", "a b c\x1cd", "中文 words 12 3,4.5!! 'tis", "foo...bar baz?!; don't,", "!" * 50, "word " * 9000, None, "", " \n\t "]
    rows = list(enumerate(odd))
    check(packing.pack(table(rows, clash=True), tokenizer), rows, tokenizer)
    assert packing.pack(table([]), tokenizer).collect() == []


def test_ids_of_odd_words(tokenizer):
    import random

    from tokenizers import Tokenizer

    tok, rnd = Tokenizer.from_file(tokenizer), random.Random(3)
    letters = [*"abcXYZ", *"İıßéÉïñøÀǅŉΣςſﬁ", "\u0301", "\u0307", "\u0345", "\u200d", "\xa0", "\x85", *"中한дЖ", *"0123", *"'’-_<|>$#%&*+=/^~@()[]{}", *".,;:!?" * 4]
    words = ["".join(rnd.choices(letters, k=rnd.randrange(1, 7))) for _ in range(100_000)]
    words += ["".join(rnd.choices("abİïéß", k=rnd.randrange(1, 4))) + "".join(rnd.choices(packing.STOPS.decode() + "'", k=rnd.randrange(4))) for _ in range(20_000)]
    texts = [" ".join(words[i : i + 50]) for i in range(0, len(words), 50)]
    for text, got in zip(texts, packing.encode(texts, tokenizer)):
        assert np.frombuffer(got, "<u2").tolist() == [*tok.encode(text, add_special_tokens=False).ids, 2], text


def test_a_cache_of_long_words_starts_anew(tokenizer, monkeypatch):
    monkeypatch.setattr(packing, "CACHE_BYTES", 1000)
    encoder = packing.WordEncoder(tokenizer, "<u2")
    for i in range(5):
        encoder.encode([f"{i}" * 900], b"")
    assert len(encoder.words) + len(encoder.older) <= 2


def test_rows_that_repeat_or_have_no_id(table, tokenizer):
    got = packing.pack(table([(1, "a b c"), (1, "d"), (None, "e f")]), tokenizer).toPandas()
    assert set(got.doc_tokens) == {2, 3, 4} and got[got.doc_id.isna()].length.sum() == 3 and got.length.sum() == 9


def test_price_is_the_best_pattern():
    rng = np.random.default_rng(0)
    for _ in range(30):
        duals, capacity = rng.random(6), 9
        value, pattern = packing.price(duals, capacity)
        best = [0.0] * (capacity + 1)
        for c in range(1, capacity + 1):
            best[c] = max([best[c - 1], *(best[c - k] + duals[k - 1] for k in range(1, min(6, c) + 1))])
        assert abs(value - best[capacity]) < 1e-9 and abs(duals @ pattern - value) < 1e-9 and pattern @ np.arange(1, 7) <= capacity


def test_the_relaxation_is_near_its_bound():
    rng = np.random.default_rng(1)
    demand = np.zeros(127, int)
    demand[:60] = rng.integers(100, 2000, 60)
    found = packing.cutting_stock(demand, 128)
    used = sum(x for _, x in found)
    assert used >= (demand @ np.arange(1, 128)) / 128 - 1e-6 and used <= 1.002 * (demand @ np.arange(1, 128)) / 128 + 1
    made = sum(p * x for p, x in found)
    assert np.allclose(made, demand, atol=1e-3)
    table, n = packing.places(demand, 128)
    for unit in range(1, 128):
        ranges = sorted(x[1:3] for x in table if x[0] == unit)
        assert all(a[1] <= b[0] for a, b in zip(ranges, ranges[1:])) and (not ranges or ranges[-1][1] <= demand[unit - 1])
    assert 0 < n <= used + 1 and packing.cutting_stock(np.zeros(5, int), 8) == []
