"""Benchmark passages in documents, by spaced-seed hashing, in DataFrame functions only.

Tokens are lower-cased words. A document overlaps an item if, laid side by side at
some offset, WINDOW consecutive tokens of both agree in AT_LEAST or more; an item
of fewer tokens counts whole, with the same number of differences allowed for as
many tokens (rounded down), and with none if it has fewer than SPAN. Fixed masks pick some of SPAN tokens and ignore the rest:
MASKS, each at all positions where its own last token exists, hit every window of 15 tokens
with up to 3 substitutions, wherever they are, SHORT_MASKS with them every item of 10 to 14
tokens with up to 2, and EXACT every item of 5 to 9 (the tests try them all); documents have masks only for items that there are.
Hashes of the masked tokens at each position of the
items are joined with those of the documents, and around each hit the two are compared token
by token at that offset.

The items' hashes are broadcast only if a count shows that they fit BROADCAST_ROWS. Beyond that, 2^SLOT_BITS slots
of bits that say which hashes there are go to the documents (a broadcast of a fixed size), and hashes that
pass are joined by a shuffle, a number each; hits then meet the tokens of their documents and items.

Defined cases: null and empty texts overlap nothing, nor do items without an id;
documents without an id are reported under null; items of under LEAST
tokens can't be told from chance and are left out; repeated items are reported each; rows
that repeat a doc_id are reported together, but `decontaminated` judges each by its text; of several overlaps of one document and
item the longest is given, the first of equals; other columns are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Token positions that a mask reads.
MASKS = ((0, 1, 3, 7, 8, 9), (0, 1, 4, 6, 7, 8), (0, 1, 2, 6, 7, 9))
SHORT_MASKS = ((0, 1, 2, 3, 5), (0, 3, 4, 6, 7))
EXACT = ((0, 1, 2, 3, 4),)
LEAST, SPAN, WINDOW, AT_LEAST = 5, 10, 15, 12
BROADCAST_ROWS = 500_000
#: Slots of the bits that stand for a large benchmark's hashes, 64 in a row: at most 2^21 rows are broadcast.
SLOT_BITS = 27


def _tokens(text: Column) -> Column:
    words = F.array_remove(F.split(F.lower(text.cast("string")), r"[\x20\x09-\x0D]+"), "")
    return F.transform(words, lambda w: F.xxhash64(w))


def _seeds(table: DataFrame, masks: tuple[tuple[int, ...], ...] = MASKS) -> DataFrame:
    """A row for each position and mask of a table with `tokens`: at (from 0) and key. A mask is at every position from which it lies within the text."""
    least, widest = min(map(max, masks)) + 1, max(map(max, masks)) + 1
    # no filter on tokens, here or inferred from the generator: it would split each text once more
    n = f"greatest(size(tokens) - {least - 1}, 0)"
    shifted = [F.expr(f"slice(tokens, {j + 1}, {n})").alias(f"t{j}") for j in range(widest)]
    at = F.expr(f"if(size(tokens) < {least}, array(), sequence(0, size(tokens) - {least}))").alias("at")
    rows = table.select("*", F.arrays_zip(at, *shifted).alias("z")).select(*table.columns, F.inline_outer("z")).filter("at is not null")
    # past the end of a text its tokens are null, and so is the key of a mask that would read them
    keys = F.array(*[F.when(F.col(f"t{max(mask)}").isNotNull(), F.xxhash64(F.lit(str(mask)), *[F.col(f"t{j}") for j in mask])) for mask in masks])
    return rows.select(*table.columns, "at", F.explode(keys).alias("key")).filter("key is not null")


def _row_name() -> Column:
    return F.xxhash64(F.col("doc_id").cast("long"), F.col("text").cast("string"))


def _marked(seeds: DataFrame) -> DataFrame:
    """(slot, bits) of the keys that there are."""
    slot, bit = _slot()
    return seeds.select(slot, bit).groupBy("slot").agg(F.bit_or(F.expr("shiftleft(1L, cast(bit as int))")).alias("bits"))


def _slot() -> tuple[Column, Column]:
    return F.expr(f"key & {(1 << SLOT_BITS - 6) - 1}L").alias("slot"), F.expr(f"shiftright(key, {SLOT_BITS}) & 63").alias("bit")


def _found(docs: DataFrame, items: DataFrame) -> DataFrame:
    """doc_id, rid (a row's name), item_id, start, n_tokens, n_equal of all overlaps, some of them repeated."""
    bench = items.filter("item_id is not null").select(F.col("item_id").cast("long").alias("item_id"), _tokens(F.col("text")).alias("tokens"))
    kinds = [(MASKS, f"size(tokens) >= {SPAN}"), (SHORT_MASKS, f"size(tokens) between {SPAN} and {WINDOW - 1}"), (EXACT, f"size(tokens) between {LEAST} and {SPAN - 1}")]
    kinds = [kinds[0], *(k for k in kinds[1:] if not bench.filter(k[1]).isEmpty())]
    seeds = reduce(DataFrame.unionByName, [_seeds(bench.filter(which), masks).filter("true" if masks != EXACT else "at = 0") for masks, which in kinds])
    seeds = seeds.select("item_id", F.col("at").alias("item_at"), "key")
    masks = sum((masks for masks, _ in kinds), ())
    whole = bench.select("item_id", F.col("tokens").alias("item_tokens")).distinct()
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), _row_name().alias("rid"), _tokens(F.col("text")).alias("tokens"))
    offset = (F.col("at") - F.col("item_at")).alias("offset")
    if seeds.count() <= BROADCAST_ROWS:
        hits = _seeds(rows, masks).join(F.broadcast(seeds), "key").select("doc_id", "rid", "tokens", "item_id", offset).join(F.broadcast(whole), "item_id")
    else:
        keys = _seeds(rows, masks).select("rid", "at", "key", *_slot()).join(F.broadcast(_marked(seeds)), "slot").filter("shiftright(bits, cast(bit as int)) & 1 = 1")
        hits = keys.select("rid", "at", "key").join(seeds.hint("shuffle_hash"), "key").select("rid", "item_id", offset).distinct()
        hits = rows.join(hits, "rid").join(whole, "item_id")
    # from here a hit has the part of its document that lies beside the item
    hits = hits.withColumn("from", F.greatest(F.col("offset"), F.lit(0))).withColumn("skip", F.greatest(-F.col("offset"), F.lit(0)))
    beside = hits.select(
        "doc_id", "rid", "item_id", "from", F.size("item_tokens").alias("size"),
        F.expr("zip_with(slice(tokens, from + 1, greatest(least(size(item_tokens) - skip, size(tokens) - from), 0)), slice(item_tokens, skip + 1, greatest(least(size(item_tokens) - skip, size(tokens) - from), 0)), (x, y) -> if(x = y, 1, 0))").alias("equal"),
    ).distinct()
    beside = beside.withColumn("window", F.least(F.lit(WINDOW), F.col("size"))).withColumn("enough", F.expr(f"if(window < {SPAN}, window, window - window * {WINDOW - AT_LEAST} div {WINDOW})"))
    windows = F.expr("if(size(equal) < window, array(), filter(transform(sequence(0, size(equal) - window), i -> struct(i as i, aggregate(slice(equal, i + 1, window), 0, (a, x) -> a + x) as n)), y -> y.n >= enough))")
    found = beside.withColumn("good", windows).filter("size(good) > 0")
    first, last = F.expr("good[0].i"), F.expr("good[size(good) - 1].i")
    return found.select("doc_id", "rid", "item_id", (F.col("from") + first).cast("long").alias("start"), (last - first + F.col("window")).cast("long").alias("n_tokens"), F.expr("aggregate(slice(equal, good[0].i + 1, good[size(good) - 1].i - good[0].i + window), 0, (a, x) -> a + x)").cast("long").alias("n_equal"))


def overlaps(docs: DataFrame, items: DataFrame) -> DataFrame:
    """doc_id, item_id, start (first token of the document that is part of the overlap), n_tokens, n_equal."""
    best = F.max(F.struct("n_equal", "n_tokens", (-F.col("start")).alias("back"))).alias("best")
    return _found(docs, items).groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", (-F.col("best.back")).alias("start"), "best.n_tokens", "best.n_equal")


def decontaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """docs without the rows whose text overlaps an item."""
    bad = _found(docs, items).select(F.col("rid").alias("_bad")).distinct()
    return docs.join(bad, F.xxhash64(docs["doc_id"].cast("long"), docs["text"].cast("string")) == bad["_bad"], "left_anti")
