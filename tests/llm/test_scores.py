import math
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from marketlens.llm import lm_score, toxicity


def test_subwords_are_shared_by_misspellings():
    grams, at = toxicity.subwords(["worthless", "wortless", "é", ""])
    sets = [set(grams[a:b]) for a, b in zip(at, at[1:])]
    assert len(sets[0] & sets[1]) >= 5 and all(sets)


def test_held_out_accuracy(spark):
    rng = np.random.default_rng(0)
    plain, bad = [f"word{i}" for i in range(300)], ["horrid", "dreadful", "vilest", "awfully"]
    texts, labels = [], []
    for i in range(600):
        w = list(rng.choice(plain, 40))
        if i % 4 == 0:
            for k in range(3):
                w[k * 7] = str(rng.choice(bad))
        texts.append(" ".join(w))
        labels.append(int(i % 4 == 0))
    model = toxicity.train(texts[:400], labels[:400])
    score = toxicity.score_texts(texts[400:], *model)
    assert ((score >= 0.5) == np.array(labels[400:])).mean() > 0.95
    odd = toxicity.score_texts([None, "", " ".join(plain[:30]), " ".join([*plain[:30], "horridd", "dreadfull", "viilest"])], *model, key="odd")
    assert odd[0] == odd[1] and odd[3] > odd[2]


def test_every_document_is_scored(spark, data, documents):
    labels = spark.read.parquet(f"{data}/labels.parquet")
    rows = toxicity.held_out_scores(documents, labels).collect()
    assert len(rows) == documents.count()
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5)


def test_labels_of_held_out_rows_are_not_read(spark, data, documents):
    labels = spark.read.parquet(f"{data}/labels.parquet")
    out = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    turned = labels.withColumn("toxic", F.when(out, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = (toxicity.fit(documents, x) for x in (labels, turned))
    assert np.array_equal(a[0], b[0]) and a[1] == b[1]


def test_columns_nulls_and_no_labels(spark, table):
    df = table([(1, "a b"), (2, None), (None, "c")], clash=True).drop("score", "predicted")
    none = spark.createDataFrame([(1, None), (None, 1), (2, 0), (2, 1)], "doc_id long, toxic int")
    model = toxicity.fit(df, none)
    out = toxicity.score(df, model)
    assert out.columns == [*df.columns, "score", "predicted"] and {r.score for r in out.collect()} == {0.5}
    assert toxicity.held_out_scores(table([]), none).collect() == []


def brute(rows, quality, words=lm_score.LEAST_WORDS):
    """(background, target) of each row, from models of all other rows."""
    split = [(t or "").encode().lower().split() for _, t in rows]
    good = [quality.get(d) == 1 for d, _ in rows]
    tokens = [sum(map(len, split)), sum(len(w) for w, g in zip(split, good) if g)]
    models = []
    for k in (0, 1):
        alone, both = Counter(), Counter()
        for w, g in zip(split, good):
            if w and (k == 0 or g):
                alone.update([None, *w])
                both.update(zip([None, *w], w))
        models.append((alone, both))
    out = []
    for w, g in zip(split, good):
        mean = []
        own_alone, own_both = Counter([None, *w]), Counter(zip([None, *w], w))
        for k in (0, 1):
            weight = min(1, tokens[1] / max(tokens[0], 1)) if k == 0 else 1
            mine = k == 0 or g
            alone = lambda y: weight * (models[k][0][y] - mine * own_alone[y])  # noqa: B023, E731
            both = lambda x, y: weight * (models[k][1][x, y] - mine * own_both[x, y])  # noqa: B023, E731
            p = lambda y: (alone(y) + 1) / (weight * (tokens[k] - mine * len(w)) + words)  # noqa: B023, E731
            mean.append(sum(-math.log((both(x, y) + lm_score.PRIOR * p(y)) / (max(alone(x), both(x, y)) + lm_score.PRIOR)) for x, y in zip([None, *w], w)) / max(len(w), 1))
        out.append(mean)
    return out


def test_cross_entropy_of_few_words_is_exact(spark, table):
    rng = np.random.default_rng(4)
    rows = [(i, " ".join(rng.choice(list("abcdefgh"), rng.integers(1, 30)))) for i in range(80)] + [(100, None), (101, "")]
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(80)], "doc_id long, quality int")
    want = dict(zip((d for d, _ in rows), brute(rows, {i: int(i % 3 == 0) for i in range(80)})))
    got = lm_score.cross_entropy_difference(table(rows, clash=True), labels).collect()
    assert len(got) == len(rows)
    for r in got:
        b, t = want[r.doc_id]
        assert (r.background_loss, r.target_loss, r.difference) == pytest.approx((b, t, t - b), abs=1e-9)
    assert lm_score.cross_entropy_difference(table([]), labels).collect() == []
    assert {r.difference for r in lm_score.cross_entropy_difference(table(rows), labels.filter("quality = 0")).collect()} == {0.0}


def test_rows_that_repeat_or_have_no_id(spark, table):
    rows = [(1, "a b c"), (1, "a b c"), (1, "d"), (None, "a b"), (None, None), (2, "a b d")]
    labels = spark.createDataFrame([(1, 1), (2, 1), (2, 0), (None, 1)], "doc_id long, quality int")
    got = lm_score.cross_entropy_difference(table(rows), labels).collect()
    want = [(d, len((t or "").split()), round(b, 9), round(x, 9)) for (d, t), (b, x) in zip(rows, brute(rows, {1: 1}))]
    assert sorted([(r.doc_id, r.n_tokens, round(r.background_loss, 9), round(r.target_loss, 9)) for r in got], key=str) == sorted(want, key=str)


def test_a_second_copy_is_known_to_the_background(spark, table):
    rng = np.random.default_rng(2)
    rows = [(i, " ".join(f"w{k}" for k in rng.integers(0, 4000, 40))) for i in range(300)]
    rows += [(1000 + i, t) for i, t in rows[:20]]
    labels = spark.createDataFrame([(i, int(i >= 20)) for i in range(120)], "doc_id long, quality int")
    got = {r.doc_id: r.difference for r in lm_score.cross_entropy_difference(table(rows), labels).collect()}
    assert min(got[i] for i in [*range(20), *range(1000, 1020)]) > max(got[i] for i in range(20, 300)) + 1


def test_a_run_without_spaces_is_read_to_its_end():
    plain, bad = [f"wort{i}" for i in range(40)], "abscheulich"
    texts = [" ".join(plain[i % 7 :: 7] + ([bad] * 3 if i % 2 else [])) for i in range(80)]
    numbers, bias = toxicity.train(texts, [i % 2 for i in range(80)])
    head = "".join(plain)
    clean, late = toxicity.score_texts([head, head + bad * 40], numbers, bias, "runs")
    assert late > clean and len(head) > 64 and toxicity.core(f"({head})") == head
    assert toxicity.means([head * 2000], numbers) == pytest.approx([float(numbers[toxicity.subwords([head * 2000])[0]].mean(dtype=float))])
    assert not any(len(w) > toxicity.CACHE_LENGTH for w in toxicity._cache["words"])


def test_the_models_grow_with_the_corpus(table, spark):
    rng = np.random.default_rng(9)
    rows = [(i, " ".join(f"w{k}" for k in rng.integers(0, 300_000, 150))) for i in range(2000)]
    good = {i: int(i % 3 == 0) for i in range(2000)}
    vocabulary = len({w for _, t in rows for w in t.split()})
    assert vocabulary > lm_score.LEAST_WORDS
    want = dict(zip((d for d, _ in rows), brute(rows, good, vocabulary)))
    for r in lm_score.cross_entropy_difference(table(rows), spark.createDataFrame(list(good.items()), "doc_id long, quality int")).collect():
        assert [r.background_loss, r.target_loss] == pytest.approx(want[r.doc_id], abs=1e-9)


def test_held_out_rows_of_the_table(spark, data):
    from pathlib import Path

    larger = Path(data).parent / "sf0.1"
    if not larger.exists():
        pytest.skip("no larger table")
    docs, labels = (spark.read.parquet(f"{larger}/{t}.parquet") for t in ("documents", "labels"))
    held = docs.join(labels, "doc_id").filter("crc32(cast(doc_id as string)) % 5 = 0 and toxic in (0, 1)")
    rows = toxicity.score(held, toxicity.fit(docs, labels), ["toxic"]).collect()
    bad, good = (np.array([r.score for r in rows if r.toxic == k]) for k in (1, 0))
    assert len(bad) > 50 and len(good) > 500
    auc = np.mean([(b > good).mean() + 0.5 * (b == good).mean() for b in bad])
    assert auc > 0.93 and sum(r.predicted == r.toxic for r in rows) / len(rows) > 0.93
