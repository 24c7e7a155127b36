"""Cross-entropy difference of two matched n-gram models over one vocabulary.

The target model counts the documents labelled as good, the background model all
documents. Both are interpolated word bigram models of real words and word pairs, by 56-bit
hashes, so the models grow with the corpus and the counts cover every
document. They are matched: the background's counts are weighed by the target's tokens over its own,
so that both weigh as many tokens against the same PRIOR, and the difference doesn't tell how much text either saw.
A pair's conditional probability is (pair count + PRIOR * p(word)) /
(context count + PRIOR), and p(word) is smoothed by one over the vocabulary: all distinct words of the
corpus, or LEAST_WORDS if they are fewer. A document's score is its
mean loss a token under the target model minus that under the background model:
lower is closer to the target. Each document is scored by the counts of all others: its own are taken
off first, in both models if it is in both. So a document that occurs twice is known to the background.

Documents are dealt into groups. A group sends each judge (a range of hashes) its
distinct words and pairs with their counts; the judge answers with the corpus' counts, the
tokens and the words of its range, and the group, read again, scores its documents. So no task
holds a whole model.

Defined cases: a null, empty or word-less text has no tokens and scores 0 in all
columns; labels that are null or contradict each other mark no target; without a
target both models know nothing and each difference is 0;
rows that repeat a doc_id, or have none, are counted and scored each; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketlens.llm import exchange
from marketlens.llm.shared import partitions
from marketlens.llm.textops import BASE, IMAGE, LOWER, WORD_BASE, Texts, mix, pack_numbers, pack_sorted, span_hashes, unpack_numbers, unpack_sorted

LEAST_WORDS = 1 << 17
PRIOR = 2.0
#: Bits of a hash that don't travel: 56 tell the n-grams of any corpus apart but for some in a million.
SHIFT = np.uint64(8)
#: Text of a group, and text whose n-grams one judge gets; counts are wider than hashes alone.
GROUP_BYTES, JUDGE_BYTES = 2 << 20, 8 << 20
_U = np.uint64

SENT = "judge int, p int, words binary, word_counts binary, word_targets binary, pairs binary, pair_counts binary, pair_targets binary"
ANSWERED = "p int, judge int, words binary, pairs binary, totals array<long>"
SCORES = "doc_id long, n_tokens long, background_loss double, target_loss double, difference double"


def ngrams(texts: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(word, pair, context, first token of each text and the end), as hashes; a text's first word follows the boundary, the hash 0."""
    start, end, at = texts.words()
    word = span_hashes(IMAGE[LOWER[texts.data]], start, end, BASE)
    context = np.zeros(len(word), np.uint64)
    context[1:] = word[:-1]
    context[at[:-1][np.diff(at) > 0]] = 0
    short = lambda x: x >> SHIFT << SHIFT
    return short(word), short(mix((context * WORD_BASE) ^ word)), short(context), at


class Group:
    """A group's n-grams, the same whenever it is read."""

    def __init__(self, group: pa.Table):
        word, pair, context, self.at = ngrams(Texts.of(exchange.column(group, "text")))
        self.n = np.diff(self.at)
        self.full = np.flatnonzero(self.n)
        self.doc = np.repeat(np.arange(len(self.n)), self.n)
        # the boundary is a word that each text with words has once
        self.words, which = np.unique(np.concatenate([np.zeros(len(self.full), np.uint64), word]), return_inverse=True)
        self.boundaries, self.word = which[: len(self.full)], which[len(self.full) :]
        self.pairs, self.pair = np.unique(pair, return_inverse=True)
        self.before = np.searchsorted(self.words, context)

    def own(self, which: np.ndarray, size: int) -> np.ndarray:
        """How often each token's n-gram occurs in its own document."""
        _, at, count = np.unique(self.doc * np.int64(size + 1) + which, return_inverse=True, return_counts=True)
        return count[at]


def _send(judges: int):
    def run(key: tuple, group: pa.Table, good: pa.Table) -> pa.Table:
        rows = []
        if group.num_rows:
            g = Group(group)
            targets = set(good.column("doc_id").to_pylist())
            target = np.array([d in targets for d in group.column("doc_id").to_pylist()], bool)
            sides = []
            for hashes, which, marks in ((g.words, np.concatenate([g.boundaries, g.word]), np.concatenate([target[g.full], target[g.doc]])), (g.pairs, g.pair, target[g.doc])):
                sides.append((hashes, np.bincount(which, minlength=len(hashes)), np.bincount(which[marks], minlength=len(hashes)), exchange.judge_cuts(hashes, judges)))
            for j in range(judges):  # a row for every judge: its totals are part of the answer
                row = []
                for hashes, count, marked, cuts in sides:
                    a, b = cuts[j], cuts[j + 1]
                    row += [pack_sorted(hashes[a:b] >> SHIFT), pack_numbers(count[a:b]), pack_numbers(marked[a:b])]
                rows.append((j, key[0].as_py(), *row))
        return pa.Table.from_batches([exchange.batch(rows, SENT)])

    return run


def _planes(x: np.ndarray) -> bytes:
    return np.ascontiguousarray(x).astype("<i8").view(np.uint8).reshape(-1, 8).T.tobytes()


def _unplanes(blob: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(blob, np.uint8).reshape(8, -1).T).view("<i8").ravel()


def _judge(key: tuple, got: pa.Table) -> pa.Table:
    """To each group, the corpus' counts of its words and pairs in all documents and in the target, and this range's tokens in both and its words."""
    p = got.column("p").to_pylist()
    blobs, totals = [], None
    for name in ("word", "pair"):
        parts = [unpack_sorted(x) for x in got.column(f"{name}s").to_pylist()]
        every, which = np.unique(np.concatenate(parts), return_inverse=True)
        sums = [np.bincount(which, np.concatenate([unpack_numbers(x) for x in got.column(c).to_pylist()]), len(every)).astype(np.int64) for c in (f"{name}_counts", f"{name}_targets")]
        if totals is None:
            real = every != 0
            totals = [int(sums[0][real].sum()), int(sums[1][real].sum()), int(real.sum())]
        at = np.concatenate([[0], np.cumsum([len(x) for x in parts])]).astype(int)
        blobs.append([_planes(np.concatenate([sums[0][which[a:b]], sums[1][which[a:b]]])) for a, b in zip(at, at[1:])])
    rows = [(q, key[0].as_py(), w, x, totals) for q, w, x in zip(p, *blobs)]
    return pa.Table.from_batches([exchange.batch(rows, ANSWERED)])


def _score(key: tuple, group: pa.Table, told: pa.Table) -> pa.Table:
    schema = _score_schema()
    if not group.num_rows:
        return schema.empty_table()
    g = Group(group)
    targets = {d for d in told.column("doc_id").to_pylist() if d is not None}
    target = np.array([d in targets for d in group.column("doc_id").to_pylist()], bool)
    answers = told.filter(pc.is_valid(told.column("judge"))).sort_by("judge")
    counts = [np.concatenate([np.zeros((2, 0), np.int64), *(_unplanes(x).reshape(2, -1) for x in answers.column(c).to_pylist())], axis=1) for c in ("words", "pairs")]
    tokens, target_tokens, vocabulary = np.sum(answers.column("totals").to_pylist(), axis=0)
    mean = np.zeros((len(g.n), 2))
    if len(g.word):
        own_word, own_pair = g.own(g.word, len(g.words)), g.own(g.pair, len(g.pairs))
        own_before = np.ones(len(g.word), np.int64)
        own_before[1:] = own_word[:-1]
        own_before[g.at[:-1][g.full]] = 1
        for k, (total, weight) in enumerate(((tokens, min(1.0, target_tokens / tokens)), (target_tokens, 1.0))):
            mine = (target if k else np.ones(len(target), bool))[g.doc]  # whose counts are in this model
            alone = weight * (counts[0][k][g.word] - own_word * mine)
            both = weight * (counts[1][k][g.pair] - own_pair * mine)
            before = weight * (counts[0][k][g.before] - own_before * mine)
            p = (alone + 1) / (weight * (total - g.n[g.doc] * mine) + max(LEAST_WORDS, vocabulary))
            loss = -np.log((both + PRIOR * p) / (np.maximum(before, both) + PRIOR))
            mean[g.full, k] = np.add.reduceat(loss, g.at[:-1][g.full]) / g.n[g.full]
    return pa.table([exchange.column(group, "doc_id"), pa.array(g.n, pa.int64()), pa.array(mean[:, 0]), pa.array(mean[:, 1]), pa.array(mean[:, 1] - mean[:, 0])], schema=schema)


def _score_schema() -> pa.Schema:
    return pa.schema([(x.split(" ")[0], pa.int64() if x.endswith("long") else pa.float64()) for x in SCORES.split(", ")])


def cross_entropy_difference(docs: DataFrame, labels: DataFrame, column: str = "quality") -> DataFrame:
    """doc_id, n_tokens, background_loss, target_loss (means a token) and difference of every document; the target are those whose label is 1."""
    good = labels.filter(f"{column} is not null and doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min(column).alias("least")).filter("least = 1")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    n, groups = partitions(docs.sparkSession), exchange.number_of_groups(rows, GROUP_BYTES)
    judges = max(n, groups * GROUP_BYTES // JUDGE_BYTES)
    place = lambda key: F.pmod(F.xxhash64(F.lit(11), key), F.lit(groups)).cast("int")
    # rows without an id are dealt by their texts
    dealt = rows.withColumn("p", place(F.coalesce("doc_id", F.xxhash64("text")))).repartition(n, "p").groupBy("p")
    good = good.select("doc_id", place(F.col("doc_id")).alias("p"))
    sent = dealt.cogroup(good.groupBy("p")).applyInArrow(_send(judges), SENT)
    answers = sent.groupBy("judge").applyInArrow(_judge, ANSWERED).withColumn("doc_id", F.lit(None).cast("long"))
    told = answers.unionByName(good, allowMissingColumns=True)
    return dealt.cogroup(told.groupBy("p")).applyInArrow(_score, SCORES)
