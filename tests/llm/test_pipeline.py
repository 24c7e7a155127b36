import importlib.util

import pytest

import corpus_pipeline


@pytest.fixture(scope="module")
def stages(spark, data):
    """The output of each stage on the test data."""
    from marketlens.llm import shared

    if importlib.util.find_spec("public_tokenizers") is None:
        pytest.skip("no tokenizer files")
    docs, out = spark.read.parquet(f"{data}/documents.parquet"), []
    out.append(docs)
    for name, stage in corpus_pipeline.STAGES:
        docs = shared.staged(stage(spark, docs, data), "test")
        out.append(docs)
    return out


def test_stages_keep_the_columns_and_only_take_away(stages):
    first = stages[0].columns
    for before, after in zip(stages[:-2], stages[1:-1]):
        assert after.columns == first and [f.dataType for f in after.schema] == [f.dataType for f in stages[0].schema]
        assert {r.doc_id for r in after.select("doc_id").collect()} <= {r.doc_id for r in before.select("doc_id").collect()}
    assert all(r.n_chars == len(r.text) for r in stages[2].collect() if r.text)


def test_each_stage_against_brute_force(spark, data, stages):
    from marketlens.llm import toxicity
    from tests.llm import test_decontam, test_line_dedup, test_minhash, test_packing

    rows = [[tuple(r) for r in s.select("doc_id", "text").collect()] for s in stages[:5]]
    ids = [{d for d, _ in r} for r in rows]
    model = toxicity.fit(stages[0], spark.read.parquet(f"{data}/labels.parquet"))
    score = toxicity.score_texts([t for _, t in rows[0]], *model, key="pipeline")
    assert ids[1] == {d for (d, _), s in zip(rows[0], score) if s < 0.5}
    lines = {d: (n, r) for d, n, r, _ in test_line_dedup.brute(rows[1])}
    assert ids[2] == {d for d, (n, r) in lines.items() if r == 0 or r < n}
    assert ids[3] == {d for d, _, _, kept in test_minhash.brute(rows[2]) if kept}
    items = [tuple(r) for r in spark.read.parquet(f"{data}/benchmark.parquet").select("item_id", "text").collect()]
    assert ids[4] == ids[3] - {d for d, _ in test_decontam.brute(rows[3], items)}
    from marketlens.llm.queries import tokenizer_path

    test_packing.check(stages[5], rows[4], tokenizer_path())


def test_run_gives_the_last_stage(spark, data, stages):
    got = corpus_pipeline.run(spark, data)
    assert got.columns == stages[-1].columns and got.count() == stages[-1].count()


def test_queries_are_registered():
    import __spark_entry__

    names = set(__spark_entry__.queries())
    assert {f"op{n}_" for n in range(1, 11)} == {x.split("_")[0] + "_" for x in names if x.startswith("op")} and "pipeline" in names


def test_near_duplicates_from_four_fifths(spark):
    import numpy as np

    from tests.llm import test_minhash

    rng, rows = np.random.default_rng(8), []
    for k in range(40):  # a copy without its first words shares 80 to 84 of 100 shingles
        words = [f"w{k}.{i}" for i in range(104)]
        rows += [(2 * k, " ".join(words)), (2 * k + 1, " ".join(words[int(rng.integers(16, 21)) :]))]
    rows.append((90, " ".join(f"w0.{i}" for i in range(24, 104))))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, docs, "").collect()}
    assert got == {d for d, _, _, kept in test_minhash.brute(rows, 80) if kept}
    assert len(got) < sum(kept for *_, kept in test_minhash.brute(rows))


def test_signatures_are_as_safe_at_four_fifths():
    from math import comb

    from marketlens.llm import minhash

    def missed(percent):
        n, _, most = minhash.layout(percent)
        p = (100 - percent) / 100
        return sum(comb(n, k) * p**k * (1 - p) ** (n - k) for k in range(most + 1, n + 1))

    assert missed(80) <= missed(85) < 2e-5


def test_no_document_goes_when_nothing_can_be_learned(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"plain words of document {i}") for i in range(1, 30)], "doc_id long, text string")
    for k, rows in enumerate(([], [(1, None), (2, 0), (2, 1)], [(i, 1) for i in range(1, 9)])):
        spark.createDataFrame(rows, "doc_id long, toxic int").write.parquet(f"{tmp_path}/{k}/labels.parquet")
        assert corpus_pipeline.drop_toxic(spark, docs, f"{tmp_path}/{k}").count() == 29


def test_a_giant_labelled_text_leaves_the_rest_of_the_sample(spark, monkeypatch):
    from pyspark.sql import functions as F

    from marketlens.llm import toxicity

    monkeypatch.setattr(toxicity, "SAMPLE_BYTES", 1000)
    ids = spark.range(1, 40).filter(F.crc32(F.col("id").cast("string")) % 5 != 0).orderBy(F.xxhash64("id"))
    first, *rest = [r.id for r in ids.collect()]
    labels = spark.createDataFrame([(i, i % 2) for i in [first, *rest]], "doc_id long, toxic int")
    for giant in ([(first, "x" * 2000)], [(first, "x" * 600), (first, "x" * 600)], [(first, "x"), (rest[0], "x" * 1000)]):
        docs = spark.createDataFrame([*giant, *[(i, "ten bytes.") for i in rest if i != giant[-1][0]]], "doc_id long, text string")
        got = {r.id for r in toxicity.labelled_sample(docs, labels, 20).collect()}
        assert len(got) >= 19 and giant[-1][0] not in got


ODD = {"p": 1, "n": 2, "rid": "r", "gone": "g", "all": "a", "rest": "x", "node": 3, "judge": 4, "line": "l", "score": 0.25, "predicted": 1, "tokens": "t", "key": "k", "component_id": 9, "kept": False, "n_removed": 7, "n_lines": 8, "text_hash": 5, "_gone": 6, "_hash": 6, "_bad": 2, "_id": 1}


def odd_table(spark, rows):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(d, t, "en", "src", None if t is None else len(t)) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    return df.withColumns({c: F.lit(v) for c, v in ODD.items()})


def folder(spark, path, labels, items):
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return str(path)


LONG = " ".join(f"long{i}" for i in range(30_000))
ITEM = " ".join(f"item{i}" for i in range(16))
BASE = " ".join(f"b{i}" for i in range(60))


def test_odd_rows_in_each_stage(spark, tmp_path):
    where = folder(spark, tmp_path, [(None, 1, 1), (500, None, None)], [(1, ITEM), (None, ITEM), (2, None), (3, "tiny")])
    rows = [
        (1, BASE), (2, None), (3, ""), (4, " \n\t\n"), (5, BASE), (5, "another text of the same id, which nothing else has"), (5, BASE), (6, BASE + " more"),
        (None, BASE), (None, None), (7, LONG), (8, f"a {ITEM} b"), (9, f"x\n{BASE}"), (10, f"a {ITEM} b"), (11, "its own"), (11, "its own"),
    ]
    docs = odd_table(spark, rows)
    texts = lambda df: sorted(((r.doc_id, r.text) for r in df.collect()), key=str)
    assert texts(corpus_pipeline.drop_toxic(spark, docs, where)) == sorted(rows, key=str)
    lines = corpus_pipeline.drop_lines(spark, docs, where)
    own = "another text of the same id, which nothing else has"
    assert texts(lines) == sorted([(1, BASE), (2, None), (3, ""), (4, " \n\t\n"), (5, own), (None, BASE), (None, None), (7, LONG), (8, f"a {ITEM} b"), (9, "x"), (11, "its own"), (11, "its own")], key=str)
    near = corpus_pipeline.drop_near_duplicates(spark, docs, where)
    assert texts(near) == sorted([(1, BASE), (2, None), (3, ""), (4, " \n\t\n"), (5, own), (None, BASE), (None, None), (7, LONG), (8, f"a {ITEM} b"), (11, "its own")], key=str)
    clean = corpus_pipeline.drop_contaminated(spark, docs, where)
    assert texts(clean) == sorted([x for x in rows if x[0] not in (8, 10)], key=str)
    for out in (lines, near, clean):
        assert out.columns == docs.columns
        for r in out.collect():
            assert {c: r[c] for c in ODD} == ODD


def test_empty_tables(spark, tmp_path, tokenizer):
    where = folder(spark, tmp_path, [], [])
    docs = odd_table(spark, [])
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, where).collect() == []
    docs = odd_table(spark, [(1, "a b c d e f"), (2, None)])
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, where).count() == 2


def by_hand(text, numbers, bias):
    """The score of a text, a subword at a time."""
    import math
    import re
    import zlib

    from marketlens.llm import toxicity

    mask, total, words = (1 << 64) - 1, 0.0, (text or "").lower().split()
    for word in words:
        form = ("<" + (re.sub(r"^\W+|\W+$", "", word) or word) + ">").encode()
        values = [float(numbers[zlib.crc32(form) % toxicity.BUCKETS])]
        for n in toxicity.GRAMS:
            for i in range(len(form) - n + 1):
                h = n
                for byte in form[i : i + n]:
                    h = (h + byte) * 0x9E3779B97F4A7C15 & mask
                    h ^= h >> 29
                values.append(float(numbers[(h >> 20) % toxicity.BUCKETS]))
        total += sum(values) / len(values)
    return 1 / (1 + math.exp(-max(-50.0, min(50.0, total / max(len(words), 1) + bias))))


def test_the_toxicity_stage_by_hand(spark, data):
    from marketlens.llm import toxicity

    docs = spark.read.parquet(f"{data}/documents.parquet")
    model = toxicity.fit(docs, spark.read.parquet(f"{data}/labels.parquet"))
    want = {r.doc_id for r in docs.collect() if by_hand(r.text, *model) < 0.5}
    assert {r.doc_id for r in corpus_pipeline.drop_toxic(spark, docs, data).collect()} == want
    assert len(want) < docs.count()
