"""Benchmark decontamination with DataFrame operations only.

Windows start at every word.  Those as long as a benchmark item, where the places
of shingles shared with it weigh enough for a match, get a SimHash of their words.
Fingerprints within a Hamming radius of R agree in at least one of R + 1 blocks, so
an index on the blocks finds all of them.  A similar window may lie outside the
radius, so a window and the item for which it weighs enough are a pair whatever their
fingerprints.  The exact weighted similarity of the shingle sets decides.
A union weighs as much as the item at least, so no match is lost by not
fingerprinting windows whose shared shingles weigh less than the share of it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from furrow.llm.storage import Scratch, small
from furrow.llm.substring_dedup import NO_ID, keyed

SHINGLE = 5
PERCENT = 80
BITS = 64
#: Two words in fifty differ in about six of 64 bits.  Similarity 0.8 on shingles allows more, beyond the radius at times.
RADIUS = 16
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: One bit in each of four 16-bit lanes: four counters are added at once.
_LANES = 0x0001000100010001


def words_of(text: Column) -> Column:
    """The words of a text, A-Z lower-cased; none for null."""
    return F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER), F.lit(r"([^\x20\x09-\x0D]+)"), F.lit(1))


def shingles(words: Column, n: int, make: Callable[..., Column]) -> Column:
    """``make`` of the n words from each place on; the array is empty for fewer words."""
    places = F.sequence(F.lit(0), F.greatest(F.size(words) - n, F.lit(0)))
    return F.when(F.size(words) >= n, F.transform(places, lambda i: make(*(F.get(words, i + j) for j in range(n))))).otherwise(F.array())


def simhash(words: Column) -> Column:
    """The 64-bit SimHash of a list of up to 65,535 words: the majority of each bit of their hashes."""
    hashes = F.transform(words, lambda x: F.xxhash64(x))
    lanes = F.transform(F.sequence(F.lit(0), F.lit(15)), lambda k: F.aggregate(hashes, F.lit(0).cast("long"), lambda acc, h: acc + F.call_function("shiftrightunsigned", h, k).bitwiseAND(F.lit(_LANES))))
    count = lambda sums, j: F.call_function("shiftrightunsigned", F.get(sums, j % 16), F.floor(j / 16).cast("int") * 16).bitwiseAND(F.lit(0xFFFF))
    majority = lambda sums: F.aggregate(F.sequence(F.lit(0), F.lit(BITS - 1)), F.lit(0).cast("long"), lambda acc, j: acc.bitwiseOR(F.call_function("shiftleft", (2 * count(sums, j) > F.size(words)).cast("long"), j)))
    return F.transform(F.array(lanes), majority)[0]


def blocks(fingerprint: Column, radius: int) -> Column:
    """Structs (block, bits) of the radius + 1 blocks that a fingerprint is cut into."""
    cuts = [BITS * i // (radius + 1) for i in range(radius + 2)]
    return F.array(*(F.struct(F.lit(i).alias("block"), F.shiftrightunsigned(fingerprint, a).bitwiseAND(F.lit((1 << (b - a)) - 1)).alias("bits")) for i, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False))))


def find_leaks(docs: DataFrame, benchmark: DataFrame, n: int = SHINGLE, percent: int = PERCENT, radius: int = RADIUS) -> DataFrame:
    """Rows (doc_id, did, th, item_id, start, n_words, similarity, level) of every window that matches an item.

    A window has as many words as the item, or all of a shorter document's; ``level``:
    it shares a shingle with the item at the same place of both.
    Shingles weigh as many as they have characters; a match has
    100 * weight of the intersection >= percent * weight of the union.  An item of
    fewer words than a shingle is one shingle; items and documents without
    words, null or empty, match nothing.  Repeated rows give one; null ids
    stay null.  Other columns are not read.  The benchmark travels to the readers
    if its shingles are few, and is shuffled beyond that.
    """
    scratch = Scratch(docs.sparkSession, "leaks")
    items = benchmark.select("item_id", words_of(F.col("text")).alias("item")).filter(F.size("item") > 0)
    items = items.withColumn("size", F.size("item")).withColumn("m", F.least(F.lit(n), F.col("size")))
    items = scratch.keep(items.withColumn("fp", simhash(F.col("item"))), "items")
    lengths = sorted(r["m"] for r in items.select("m").distinct().collect())  # at most n numbers
    n_shingles = items.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]

    text = lambda *w: F.concat_ws(" ", *w)
    weight = lambda a: F.aggregate(a, F.lit(0).cast("long"), lambda acc, s: acc + F.length(s))
    whole = docs.select("doc_id", F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("did"), F.xxhash64("text").alias("th"), "text")
    given = whole.select("did", "th", words_of(F.col("text")).alias("ws"))
    places = []
    for m in lengths:
        # The shingles of an item, each once, with its places, its weight and the item's.
        cells = items.filter(F.col("m") == m).withColumn("s", shingles(F.col("item"), m, text)).withColumn("whole", weight(F.array_distinct("s")))
        cells = cells.select("item_id", "size", "whole", F.posexplode(F.arrays_zip(shingles(F.col("item"), m, F.xxhash64).alias("h"), F.col("s"))).alias("off", "x"))
        of_items = cells.groupBy("item_id", "size", "whole", "x.h").agg(F.max(F.length("x.s")).alias("w"), F.collect_set("off").alias("offs"))
        found = given.select("did", "th", F.size("ws").alias("len"), F.posexplode(shingles(F.col("ws"), m, F.xxhash64)).alias("pos", "h"))
        hit = found.join(small(of_items, 64 * n_shingles), "h")
        end = F.greatest(F.lit(0), F.col("len") - F.col("size"))
        level = F.transform("offs", lambda off: F.greatest(F.lit(0), F.least(F.col("pos") - off, end)))
        starts = F.sequence(F.greatest(F.lit(0), F.col("pos") + m - F.col("size")), F.least(F.col("pos"), end))
        hit = hit.select("did", "th", "item_id", "size", "whole", "w", level.alias("levels"), F.explode(starts).alias("start"))
        # A union is at least the item, so a window whose places of shared shingles weigh less is no match.
        enough = hit.groupBy("did", "th", "item_id", "size", "whole", "start").agg(F.sum("w").alias("w"), F.max(F.array_contains("levels", F.col("start"))).alias("level"))
        places.append(enough.filter(100 * F.col("w") >= percent * F.col("whole")).select("did", "th", "start", "size", "item_id", "level"))
    if not places:
        return docs.sparkSession.createDataFrame([], f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, did long, th long, item_id {benchmark.schema['item_id'].dataType.simpleString()}, start int, n_words int, similarity double, level boolean")
    at = places[0]
    for more in places[1:]:
        at = at.unionByName(more)
    likely = scratch.keep(at, "likely")
    at = likely.select("did", "th", "start", "size").distinct().groupBy("did", "th").agg(F.collect_list(F.struct("start", "size")).alias("places"))
    at = scratch.keep(at, "places")

    windows = whole.join(small(at, at.agg(F.coalesce(F.sum(48 + 16 * F.size("places")), F.lit(0))).first()[0]), ["did", "th"]).dropDuplicates(["did", "th"]).select("doc_id", "did", "th", words_of(F.col("text")).alias("ws"), F.explode("places").alias("p"))
    windows = windows.select("doc_id", "did", "th", "p.start", "p.size", F.slice("ws", F.col("p.start") + 1, F.col("p.size")).alias("window"))
    windows = scratch.keep(windows.withColumn("fp", simhash(F.col("window"))), "windows")
    held = windows.agg(F.coalesce(F.sum(64 + 24 * F.size("window")), F.lit(0))).first()[0]
    index = items.select("item_id", "size", F.col("fp").alias("item_fp"), F.inline(blocks(F.col("fp"), radius)))
    near = windows.select("did", "th", "start", "size", "fp", F.inline(blocks(F.col("fp"), radius))).join(index, ["size", "block", "bits"])
    near = near.filter(F.bit_count(F.col("fp").bitwiseXOR(F.col("item_fp"))) <= radius).select("did", "th", "start", "size", "item_id")
    near = near.withColumn("level", F.lit(False)).unionByName(likely).groupBy("did", "th", "start", "size", "item_id").agg(F.max("level").alias("level"))

    both = near.join(small(windows.drop("fp"), held), ["did", "th", "start", "size"]).join(items.select("item_id", "item", "m"), "item_id")
    one, other = (F.coalesce(*(F.when(F.col("m") == m, F.array_distinct(shingles(F.col(c), m, text))) for m in lengths)) for c in ("window", "item"))
    both = both.withColumn("x", one).withColumn("y", other).withColumn("shared", weight(F.array_intersect("x", "y"))).withColumn("total", weight(F.array_union("x", "y")))
    match = both.filter((F.col("total") > 0) & (100 * F.col("shared") >= percent * F.col("total")))
    return match.select("doc_id", "did", "th", "item_id", "start", F.size("window").alias("n_words"), (F.col("shared") / F.col("total")).alias("similarity"), "level")


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Rows (doc_id, item_id, start, n_words, similarity) of each document and item that match.

    The window is the best of those that share a shingle at the same place, or of all
    if none of these matches; the first of equals.
    """
    found = find_leaks(docs, benchmark)
    best = found.groupBy("did", "th", "item_id").agg(F.max(F.struct("level", "similarity", (-F.col("start")).alias("back"), "n_words")).alias("b"), F.first("doc_id").alias("doc_id"))
    return best.select("doc_id", "item_id", (-F.col("b.back")).alias("start"), "b.n_words", "b.similarity")


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents, with all their columns, that hold no benchmark item.

    A leak takes away the rows of its id and text, all of them if they are repeated; rows
    that share an id, null or not, are judged by their own text.  Null and empty texts,
    and all documents if the benchmark is empty, stay.
    """
    scratch = Scratch(docs.sparkSession, "leaking")
    gone = scratch.keep(find_leaks(docs, benchmark).select("did", "th").distinct(), "ids")
    left = keyed(docs).drop("text").join(small(gone, 32 * gone.count()), ["did", "th"], "left_anti")
    return left.select(*(F.col(f"row.`{c}`").alias(c) for c in docs.columns))
