"""Near-equal lines by a deletion-neighbourhood join, in DataFrame functions only.

Lines are sequences of units: words (space and 0x09-0x0D part them) if there are LEAST or more, else the characters of
the words with a space between them. Two lines are near if
one edit of a unit (change, insertion or deletion) makes them equal, their units are of one kind, and both have
LEAST words or FINE_LEAST characters; lines of fewer are near only if equal, as an edit is too large a part of them.
A line goes if a line that is near or equal comes earlier, by doc_id and place; lines are judged on the
input, so a line that goes still counts as earlier.

Equal lines become one, with their first place. Of two near lines, one half (the
first or the last floor(n / 2) units) is the same; lines that share no half with
another line have no near one. For the rest, every variant with one unit left out is
emitted as a hashed key, next to the line itself; equal keys join. Near lines
are those with equal keys and the same place left out (a change) or none in one of
them (an insertion), so each key and place needs its earliest line only and a
group of any size gives one comparison a line. The units of each such pair are then
compared.

Defined cases: a null text has no lines and stays null; lines without words are never
removed; rows that repeat a doc_id are documents of their own, in the order of a hash of
their texts, but rows that also repeat the text are one; rows without a
doc_id neither lose lines nor make others lose any; an empty table gives no rows; other columns are kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketlens.llm import shared

#: Words of a line whose units are words, and characters of one whose units are these.
LEAST, FINE_LEAST = 8, 16
SOLID = r"[^\x20\x09-\x0D]"


def _words(line: Column) -> Column:
    return F.array_remove(F.split(line, r"[\x20\x09-\x0D]+"), "")


def _units(words: Column, least: int) -> Column:
    """The words, or the characters of a line that has few."""
    return F.when(F.size(words) >= least, words).otherwise(F.split(F.array_join(words, " "), ""))


def _halves(n: str, words: str, fine: str) -> str:
    """Hashes of the leading and trailing halves; of both lengths that a line one unit longer or shorter has."""
    sizes = [f"({n} div 2)", f"(({n} - 1) div 2)"]
    first = [f"xxhash64('first', {fine}, {h}, slice({words}, 1, cast({h} as int)))" for h in sizes]
    last = [f"xxhash64('last', {fine}, {h}, slice({words}, cast({n} - {h} + 1 as int), cast({h} as int)))" for h in sizes]
    return f"array_distinct(array({', '.join(first + last)}))"


def line_table(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """(doc_id, rid, at, line, check, halves) of all lines with words; line and check are hashes of the words."""
    # no filter on words, here or inferred from the generator: it would split each line once more
    lines = docs.select("doc_id", "rid", F.posexplode_outer(F.split("text", "\n", -1)).alias("at", "raw")).filter(F.col("raw").rlike(SOLID))
    lines = lines.select("doc_id", "rid", "at", _words(F.col("raw")).alias("w"))
    lines = lines.select("doc_id", "rid", "at", F.xxhash64("w").alias("line"), F.hash("w").alias("check"), (F.size("w") < least).alias("fine"), _units(F.col("w"), least).alias("u"))
    halves = F.expr(f"if(size(u) >= if(fine, {FINE_LEAST}, {least}), {_halves('size(u)', 'u', 'fine')}, null)")
    return lines.select("doc_id", "rid", "at", "line", "check", halves.alias("halves"))


def near_lines(live: DataFrame) -> DataFrame:
    """Those `first` of live (first, fine, w: the units, characters if fine) that have an earlier near line; `first` names a line."""
    # units as numbers, so that a variant is a hash of numbers
    numbered = live.select("first", F.expr("transform(w, x -> xxhash64(fine, x))").alias("h"))
    # a row a place, 0 for the line itself: hashed one by one in generated code, which the same within an array would not be
    places = numbered.select("first", "h", F.explode_outer(F.expr("sequence(0, size(h))")).alias("place"))
    variants = places.select("first", "place", F.expr("xxhash64(slice(h, 1, greatest(place - 1, 0)), slice(h, place + 1, size(h)))").alias("key"))
    variants = shared.staged(variants, "variants")  # read twice, and each costs a hash of its line
    twice = variants.groupBy("key").agg(F.count(F.lit(1)).alias("lines")).filter("lines > 1").select("key")
    variants = shared.staged(variants.join(twice, "key"), "equal")

    me = F.struct("first", "place")
    by_key = variants.groupBy("key").agg(F.min(F.when(F.col("place") == 0, me)).alias("whole"), F.min(F.when(F.col("place") > 0, me)).alias("less"))
    by_place = variants.filter("place > 0").groupBy("key", "place").agg(F.min(me).alias("mate"))
    one = variants.join(by_key, "key").select("first", "place", F.expr("if(place = 0, less, whole)").alias("mate"))
    two = variants.join(by_place, ["key", "place"]).select("first", "place", "mate")
    pairs = one.unionByName(two).filter("mate is not null and mate.first < first").distinct()

    both = pairs.join(live, "first").join(live.select(F.col("first").alias("m"), F.col("fine").alias("m_fine"), F.col("w").alias("m_w")), F.col("mate.first") == F.col("m"))
    without = lambda w, i: f"if({i} = 0, {w}, concat(slice({w}, 1, {i} - 1), slice({w}, {i} + 1, size({w}))))"
    return both.filter("fine = m_fine").filter(F.expr(f"{without('w', 'place')} = {without('m_w', 'mate.place')}")).select("first").distinct()


def removed_lines(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """(doc_id, rid, gone array<int>): the places of the lines that go, of documents that lose any. docs: doc_id, rid, text."""
    lines = shared.staged(line_table(docs, least), "lines")  # the only step that takes all lines apart
    first = F.min(F.struct("doc_id", "rid", "at")).alias("first")
    distinct = shared.staged(lines.groupBy("line", "check").agg(first, F.count(F.lit(1)).alias("times"), F.first("halves").alias("halves")), "distinct")

    keys = distinct.filter("halves is not null").select("line", F.explode("halves").alias("half"))
    halves = keys.groupBy("half").agg(F.count(F.lit(1)).alias("lines")).filter("lines > 1").select("half")
    live = distinct.select("line", "first").join(keys.join(halves, "half").select("line").distinct(), "line").select("first")

    wanted = live.groupBy(F.col("first.doc_id").alias("doc_id"), F.col("first.rid").alias("rid")).agg(F.collect_list("first").alias("firsts"))
    texts = docs.join(wanted, ["doc_id", "rid"]).select(F.split("text", "\n", -1).alias("all"), F.explode("firsts").alias("first"))
    texts = texts.select("first", _words(F.expr("all[first.at]")).alias("w"))
    texts = shared.staged(texts.select("first", (F.size("w") < least).alias("fine"), _units(F.col("w"), least).alias("w")), "texts")

    near = near_lines(texts).select("first", F.lit(True).alias("near"))
    known = distinct.select("line", "check", "first", "times").join(near, "first", "left").filter("times > 1 or near")
    gone = lines.select("doc_id", "rid", "at", "line", "check").join(known, ["line", "check"]).filter("near or first <> struct(doc_id, rid, at)")
    gone = shared.staged(gone.groupBy("doc_id", "rid").agg(F.sort_array(F.collect_list("at")).alias("gone")), "gone")
    return gone


def remove_lines(docs: DataFrame, least: int = LEAST, counts: tuple[str, str] = ("n_lines", "n_removed")) -> DataFrame:
    """docs with `text` without the lines that go, and its lines with words and those that went, under the names `counts`, which replace docs' own."""
    own = [c for c in docs.columns if c not in counts]
    rid = F.xxhash64(F.col("doc_id"), F.col("text").cast("string"))
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), rid.alias("rid"), F.col("text").cast("string").alias("text"))
    gone = removed_lines(slim.filter("text is not null and doc_id is not null"), least)
    extra = [c for c in own if c not in ("doc_id", "text")]
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), rid.alias("rid"), F.col("text").cast("string").alias("text"), F.struct(*[F.col(f"`{c}`") for c in extra]).alias("rest") if extra else F.lit(None).alias("rest"))
    out = rows.join(gone, ["doc_id", "rid"], "left").withColumn("all", F.split("text", "\n", -1))
    # a line's place is looked up in a map of places, so many removed lines cost no more each
    kept = F.expr("if(gone is null, text, array_join(transform(filter(transform(all, (x, i) -> struct(x as x, i as i)), y -> not map_contains_key(map_from_arrays(gone, gone), y.i)), y -> y.x), '\n'))")
    lines = F.coalesce(F.size(F.filter("all", lambda x: x.rlike(SOLID))), F.lit(0))
    out = out.select("doc_id", kept.alias("text"), "rest", lines.cast("long").alias(counts[0]), F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias(counts[1]))
    column = {"doc_id": F.col("doc_id"), "text": F.col("text")} | {c: F.col(f"rest.`{c}`") for c in extra}
    return out.select(*[column[c].alias(c) for c in own], *counts)


def digest(docs: DataFrame) -> DataFrame:
    return remove_lines(docs.select("doc_id", "text")).select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))
