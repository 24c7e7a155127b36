"""Toxicity scores from subword-bag embeddings and a linear softmax.

A word is the bag of its character n-grams and itself, hashed into `BUCKETS`
rows of an embedding table; a document is the average of its words, a word the
average of its subwords; a linear softmax over two classes reads that average.
Embeddings and softmax are trained together in numpy, by Adam on the full batch
of a bounded sample of labelled rows (`SAMPLE`, the rows whose hashed id comes
first). As both layers are linear, a trained bucket is one number a class, and a
document's logit is the mean of its words' numbers: scoring is a scan.

Defined cases: a null or empty text has no words and gets the score of the bias
alone; labels that are null or not 0 or 1 are not learned from; an id with several
labels that differ is not learned from; rows without an id are scored, not held out and not
learned from; with no labels, or none but of class 1, every score is 0.5; a text that would take the
sample over SAMPLE_BYTES is left out of it and those after it are not; rows
that repeat an id are scored each; other columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketlens.llm.textops import chunks

BUCKETS, DIMENSIONS, GRAMS = 1 << 18, 16, (3, 4, 5)
#: The most labelled documents, and bytes of their texts, that are learned from.
SAMPLE, SAMPLE_BYTES = 8_000, 64 << 20
STEPS, RATE, DECAY = 150, 0.05, 1.0
#: Words of fewer sample documents tell one document from another, not a class, and train nothing.
LEAST_DOCUMENTS = 2
#: Factor between the average and the softmax, so that few words among many can tell.
SHARPEN = 60.0
#: Words that a worker keeps the numbers of, if they have no more characters than this.
CACHE_WORDS, CACHE_LENGTH = 250_000, 64
#: Characters of the words that are taken apart at once.
FORMS = 1 << 18
EDGES = re.compile(r"^\W+|\W+$")

_cache: dict = {}


def _gram_buckets(data: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    h = np.full(len(at), n, np.uint64)
    for j in range(n):
        h = (h + data[at + j]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return ((h >> np.uint64(20)) % np.uint64(BUCKETS)).astype(np.int32)


def subwords(forms: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(buckets, starts): of each form itself and of its n-grams of UTF-8 bytes, with marks at its ends."""
    marked = [b"<%b>" % w.encode() for w in forms]
    data = np.frombuffer(b"".join(marked) or b"", np.uint8).astype(np.uint64)
    size = np.fromiter(map(len, marked), np.int64, len(marked))
    end = np.cumsum(size)
    owner = np.repeat(np.arange(len(marked), dtype=np.int32), size)
    left = (np.repeat(end, size) - np.arange(len(data))).astype(np.int32)
    ids = [(np.fromiter(map(zlib.crc32, marked), np.int64, len(marked)) % BUCKETS).astype(np.int32)]
    owners = [np.arange(len(marked), dtype=np.int32)]
    for n in GRAMS:
        at = np.flatnonzero(left >= n)
        ids.append(_gram_buckets(data, at, n))
        owners.append(owner[at])
    owners, ids = np.concatenate(owners), np.concatenate(ids)
    order = np.argsort(owners, kind="stable")
    return ids[order], np.concatenate([[0], np.cumsum(np.bincount(owners, minlength=len(marked)))])


def words(text: str | None) -> list[str]:
    return (text or "").lower().split()


def core(word: str) -> str:
    """A word without the punctuation around it; punctuation alone stays."""
    return EDGES.sub("", word) or word


def means(forms: list[str], numbers: np.ndarray) -> list[float]:
    """The mean number of each form's subwords, of all of them however long it is; forms are taken apart some at a time."""
    out: list[float] = []
    for a, b in chunks(np.fromiter(map(len, forms), np.int64, len(forms)), FORMS):
        if len(forms[a]) > FORMS:  # one long form: its n-grams, a piece at a time
            out.append(_long_mean(forms[a], numbers))
            continue
        grams, at = subwords(forms[a:b])
        out += (_segment_sums(numbers[grams], at) / np.maximum(np.diff(at), 1)).tolist()
    return out


def _long_mean(form: str, numbers: np.ndarray) -> float:
    marked = np.frombuffer(b"<%b>" % form.encode(), np.uint8)
    total, count = float(numbers[zlib.crc32(marked) % BUCKETS]), 1
    for at in range(0, len(marked), FORMS):
        data = marked[at : at + FORMS + max(GRAMS) - 1].astype(np.uint64)
        for n in GRAMS:
            h = _gram_buckets(data, np.arange(min(FORMS, len(data) - n + 1)), n)
            total, count = total + float(numbers[h].sum(dtype=np.float64)), count + len(h)
    return total / count


def _segment_sums(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    sums = np.concatenate([[0.0], np.cumsum(values, dtype=np.float64)])
    return sums[starts[1:]] - sums[starts[:-1]]


def train(texts: list[str | None], labels: list[int], seed: int = 7) -> tuple[np.ndarray, float]:
    """(one number a bucket, bias): the trained layers, multiplied out for class 1 against class 0."""
    y = np.array(labels, float)
    spread = Counter(w for t in texts for w in set(map(core, words(t))))
    vocabulary = {w: k for k, w in enumerate(sorted(w for w, n in spread.items() if n >= LEAST_DOCUMENTS))}
    del spread
    doc_at, word_of, weight = [0], array("i"), array("f")
    for text in texts:  # one bag of words at a time: all of them would not fit a small driver
        bag = Counter(map(core, words(text)))
        total = sum(bag.values())
        for w, c in bag.items():
            if w in vocabulary:
                word_of.append(vocabulary[w])
                weight.append(c / total)
        doc_at.append(len(word_of))
    word_of, weight, doc_at = np.array(word_of, np.int32), np.array(weight, np.float32), np.array(doc_at)
    doc_of = np.repeat(np.arange(len(texts), dtype=np.int32), np.diff(doc_at))
    grams, gram_at = subwords(list(vocabulary))
    grams = grams.astype(np.int32)
    word_of_gram = np.repeat(np.arange(len(vocabulary), dtype=np.int32), np.diff(gram_at))
    share = 1 / np.maximum(np.diff(gram_at), 1)

    rng = np.random.default_rng(seed)
    table = rng.normal(0, 0.1, (BUCKETS, DIMENSIONS)).astype(np.float32)
    used = np.unique(grams)
    layer = rng.normal(0, 0.1, (DIMENSIONS, 2)).astype(np.float32)
    bias = np.zeros(2)
    position = np.searchsorted(used, grams).astype(np.int32)
    del grams
    e = table[used]
    state = [np.zeros_like(x) for x in (e, e, layer, layer, bias, bias)]
    onehot = np.stack([1 - y, y], 1)
    for step in range(1, STEPS + 1):
        per_gram = e @ layer
        logits = np.empty((len(texts), 2))
        for c in (0, 1):
            per_word = _segment_sums(per_gram[position, c], gram_at) * share
            logits[:, c] = np.bincount(doc_of, per_word[word_of] * weight, len(texts))
        logits = logits * SHARPEN + bias
        p = np.exp(logits - logits.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        delta = (p - onehot) / len(texts)
        flow = np.empty((len(used), 2), np.float32)
        for c in (0, 1):
            to_word = np.bincount(word_of, delta[doc_of, c] * weight * SHARPEN, len(vocabulary)) * share
            flow[:, c] = np.bincount(position, to_word[word_of_gram], len(used))
        grads = (flow @ layer.T + DECAY / len(used) * e, (e.T @ flow), delta.sum(0))
        for k, (value, grad) in enumerate(zip((e, layer, bias), grads)):
            m, v = state[2 * k], state[2 * k + 1]
            m += 0.1 * (grad - m)
            v += 0.01 * (grad * grad - v)
            value -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-9)
    numbers = np.zeros(BUCKETS, np.float32)
    numbers[used] = (e @ (layer[:, 1] - layer[:, 0])) * SHARPEN
    return numbers, float(bias[1] - bias[0])


def score_texts(texts: list[str | None], numbers: np.ndarray, bias: float, key: object = None) -> np.ndarray:
    if _cache.get("key") != key or "words" not in _cache or len(_cache["words"]) > CACHE_WORDS:
        _cache.update(key=key, words={})
    known = _cache["words"]
    split, out = [words(t) for t in texts], np.empty(len(texts))
    new = list(set().union(*split).difference(known))
    known.update(zip(new, means([core(w) for w in new], numbers)))
    for i, tokens in enumerate(split):
        out[i] = sum(map(known.__getitem__, tokens)) / max(len(tokens), 1) + bias
    for w in new:
        if len(w) > CACHE_LENGTH:  # seldom seen again, and large
            del known[w]
    return 1 / (1 + np.exp(-np.clip(out, -50, 50)))


def labelled_sample(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(id, text, toxic) of at most `sample` labelled rows and SAMPLE_BYTES of text, without the held-out fifth."""
    rest = F.crc32(F.col("doc_id").cast("string")) % 5
    one = labels.filter("toxic in (0, 1) and doc_id is not null").groupBy(F.col("doc_id").alias("id")).agg(F.min("toxic").alias("toxic"), F.max("toxic").alias("most")).filter("toxic = most")
    ids = one.join(docs.select(F.col("doc_id").cast("long").alias("id"), F.octet_length("text").alias("size")), "id").filter(F.crc32(F.col("id").cast("string")) % 5 != 0)
    # an id's rows are learned from together; a text over SAMPLE_BYTES takes no place among the first
    ids = ids.groupBy("id", "toxic").agg(F.coalesce(F.sum("size"), F.lit(0)).alias("size")).filter(F.col("size") <= SAMPLE_BYTES)
    # the first by a hash are a sample; the driver gets their ids and sizes only
    total, keep = 0, {}
    for row in ids.orderBy(F.xxhash64("id"), "id").limit(sample).collect():
        if total + row["size"] <= SAMPLE_BYTES:
            total += row["size"]
            keep[row.id] = row.toxic
    picked = docs.sparkSession.createDataFrame([(k, int(v)) for k, v in keep.items()], "id long, toxic int")
    return docs.filter(rest != 0).select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text")).join(F.broadcast(picked), "id")


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> tuple[np.ndarray, float]:
    """The model of a labelled sample, trained by one task: the driver gets BUCKETS numbers and no text."""

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("id", "ascending"), ("text", "ascending")])
        toxic = rows.column("toxic").to_pylist()
        # without a clean text nothing tells the classes apart
        numbers, bias = train(rows.column("text").to_pylist(), toxic) if 0 in toxic else (np.zeros(BUCKETS, np.float32), 0.0)
        return pa.table([pa.array([numbers.astype("<f4").tobytes()], pa.binary()), pa.array([bias])], names=["numbers", "bias"])

    found = labelled_sample(docs, labels, sample).groupBy(F.lit(0).alias("all")).applyInArrow(run, "numbers binary, bias double").first()
    if found is None:
        return np.zeros(BUCKETS, np.float32), 0.0
    return np.frombuffer(found.numbers, "<f4").copy(), float(found.bias)


def score(docs: DataFrame, model: tuple[np.ndarray, float], keep: list[str] | None = None) -> DataFrame:
    """docs' columns `keep` (all by default) with score double and predicted int."""
    numbers, bias = model
    shared = docs.sparkSession.sparkContext.broadcast(numbers)  # BUCKETS floats, however large the input
    names = keep or docs.columns
    key = zlib.crc32(numbers.tobytes())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                got = score_texts(part.column(len(names)).to_pylist(), shared.value, bias, key)
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(got), pa.array((got >= 0.5).astype(np.int32))], names=[*part.schema.names[:-1], "score", "predicted"])

    kept = docs.select(*[F.col(f"`{c}`").alias(f"_{i}") for i, c in enumerate(names)], F.col("text").cast("string").alias("_text"))
    schema = ", ".join(f"_{i} {kept.schema[i].dataType.simpleString()}" for i in range(len(names)))
    out = kept.mapInArrow(run, f"{schema}, score double, predicted int")
    return out.toDF(*names, "score", "predicted")


def held_out_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    model = fit(docs, labels)
    out = score(docs.select("doc_id", "text"), model, ["doc_id"])
    return out.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False)).alias("held_out"), "score", "predicted")
