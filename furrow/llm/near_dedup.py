"""MinHash near-dedup by bottom-k sketches of one hash function.

A document is the set of its distinct shingles.  Documents with equal sets form
a class.  A sketch keeps the k smallest hashes of a set; all of it if it has no
more.  Inverted lists of the retained values yield the classes that overlap; the
union of two sketches estimates their Jaccard similarity; pairs within the
estimate's error of the threshold are verified on full sets.

Overlap is bounded from below for linked sets, so each sketch indexes only as
many of its values as the bound demands, the rarest first: values that many
classes share stay out of the lists unless a class has little else.  A list that
is long nevertheless holds classes that are near each other, so its members
are compared with one centre, and what is linked becomes one component.

Members of a list that are still apart meet again on their full sets.  Only
shingles that two components hold can be the overlap of a link, so a class
is indexed by the rarest of these, and only at places from which on it has enough
of them left for a partner of the list's sizes.  That loses no link between them.
While these lists are long and links are found, centres are compared first; the pairs
across components that remain are all compared.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from furrow.llm import textcore as tc
from furrow.llm.components import components
from furrow.llm.storage import Scratch, small
from furrow.llm.substring_dedup import NO_ID, keyed

SHINGLE = 5
PERCENT = 80
K = 128
#: Standard errors that an estimate may be off before a pair is lost: about one link in three million.
SIGMAS = 5.0
#: Lists count as long if their pairs are more than so many times their members.
LONG = 4


def shingle_sets(w: tc.Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(document, hash) of the distinct shingles, in order of both; a shorter text is one shingle."""
    h = w.hashes()
    key = w.grams(h, n)
    valid = w.left >= n
    for short in np.flatnonzero((w.count > 0) & (w.count < n)):
        first, count = w.first[short], w.count[short]
        key[first] = tc.gram_hashes(h[first : first + count], int(count))[0] + np.uint64(count)
        valid[first] = True
    at = np.flatnonzero(valid)
    order = np.lexsort((key[at], w.doc[at]))
    doc, key = w.doc[at][order], key[at][order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (key[1:] != key[:-1])
    return doc[new], key[new]


def _lists(values: np.ndarray, size: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(size))).astype(np.int32)), pa.array(values.view(np.int64)))


def sketch_rows(docs: DataFrame, n: int, k: int) -> DataFrame:
    """Rows (doc_id, did, th, n_shingles, d1, d2, sketch); (d1, d2) is a digest of the whole set, and the sketch is in order."""
    given = keyed(docs).select(F.col("row.doc_id").alias("doc_id"), "did", "th", "text")
    kind = given.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in tc.row_chunks(batch):
                doc, key = shingle_sets(tc.Words(part.column("text"), lower=True), n)
                size = np.bincount(doc, minlength=part.num_rows)
                first = np.concatenate(([0], np.cumsum(size)))
                digest = []
                for salt in (1, 2):
                    run = np.concatenate((np.zeros(1, np.uint64), np.cumsum(tc.mix(key * np.uint64(2 * salt + 1) + np.uint64(salt)), dtype=np.uint64)))
                    digest.append(pa.array(tc.mix(run[first[1:]] - run[first[:-1]] + size.astype(np.uint64)).view(np.int64)))
                keep = np.arange(len(doc)) - first[doc] < k
                yield pa.RecordBatch.from_arrays([*part.columns[:3], pa.array(size), *digest, _lists(key[keep], np.minimum(size, k))], names=["doc_id", "did", "th", "n_shingles", "d1", "d2", "sketch"])

    return given.mapInArrow(run, f"doc_id {kind}, did long, th long, n_shingles long, d1 long, d2 long, sketch array<long>")


def inverted_lists(classes: DataFrame, k: int, percent: int, scratch: Scratch) -> DataFrame:
    """Rows (value, rep, n_shingles, shared): the indexed values of each class, and how many values it shares at all.

    A class indexes as many values, in the common order of rarity, as two linked
    sketches must share one among: exactly so for sets that are retained whole
    together with all they may be linked to, else by the least overlap of two
    linked sketches, ``SIGMAS`` standard errors below its mean.
    """
    rows = classes.select("rep", "n_shingles", F.explode("sketch").alias("value"))
    often = scratch.keep(rows.groupBy("value").agg(F.count("*").alias("df")).filter("df > 1"), "df")
    held = rows.join(often, "value").groupBy("rep", "n_shingles").agg(F.sort_array(F.collect_list(F.struct("df", "value"))).alias("held"))
    t = percent / 100
    least = max(1, math.floor(t * k - SIGMAS * math.sqrt(t * (1 - t) * k)))
    whole = F.col("n_shingles") - F.ceil(F.col("n_shingles") * percent / 100) + 1
    length = F.when(F.col("n_shingles") <= math.floor(t * k), whole).otherwise(F.least("n_shingles", F.lit(k)) - least + 1)
    # Values that no other class retains come first in the order and make no list.
    free = length - (F.least("n_shingles", F.lit(k)) - F.size("held"))
    held = held.withColumn("free", free.cast("int")).filter("free > 0").select("rep", "n_shingles", F.size("held").alias("shared"), F.explode(F.slice("held", F.lit(1), F.col("free"))).alias("x"))
    lists = scratch.keep(held.select("x.value", "rep", "n_shingles", "shared"), "lists")
    scratch.drop(often)
    return lists


def close_pairs(pairs: DataFrame, classes: DataFrame, k: int, percent: int) -> DataFrame:
    """Rows (a, b, exact) of the pairs whose union sketch estimates the threshold within its error; exact: estimated on whole sets."""
    side = classes.select("rep", F.col("n_shingles").alias("n"), "sketch")
    both = pairs.join(side.withColumnsRenamed({"rep": "a", "n": "na", "sketch": "sa"}), "a").join(side.withColumnsRenamed({"rep": "b", "n": "nb", "sketch": "sb"}), "b")
    t = percent / 100

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            na, nb = batch.column("na").to_numpy(), batch.column("nb").to_numpy()
            close, exact = np.zeros(batch.num_rows, bool), (na <= k) & (nb <= k)
            for i, (sa, sb) in enumerate(zip(batch.column("sa"), batch.column("sb"), strict=True)):
                x, y = (s.values.to_numpy().view(np.uint64) for s in (sa, sb))
                union = np.union1d(x, y)
                common = np.intersect1d(x, y, assume_unique=True)
                if exact[i]:
                    close[i] = 100 * len(common) >= percent * len(union)
                else:
                    top = union[:k]
                    found = np.searchsorted(common, top[-1], side="right")
                    error = SIGMAS * math.sqrt(t * (1 - t) / len(top) * max(0.0, 1 - len(top) * (1 + t) / (na[i] + nb[i])))
                    close[i] = found / len(top) >= t - error
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(exact)], names=["a", "b", "exact"]).filter(pa.array(close))

    return both.mapInArrow(run, "a long, b long, exact boolean")


def full_sets(classes: DataFrame, docs: DataFrame, n: int) -> DataFrame:
    """Rows (rep, shingles) of the given classes, from the text of their first document."""
    wanted = keyed(docs).select("did", "th", "text").join(small(classes.select("rep", "copies", "did", "th"), 48 * classes.count()), ["did", "th"])
    # Only a class of copies can have repeated rows.
    single, several = (wanted.filter(c).select("rep", "text") for c in ("copies = 1", "copies > 1"))

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in tc.row_chunks(batch):
                doc, key = shingle_sets(tc.Words(part.column("text"), lower=True), n)
                yield pa.RecordBatch.from_arrays([part.column("rep"), _lists(key, np.bincount(doc, minlength=part.num_rows))], names=["rep", "shingles"])

    return single.unionByName(several.dropDuplicates(["rep"])).mapInArrow(sets, "rep long, shingles array<long>")


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Rows (a, b) of the pairs whose full sets are linked."""
    both = pairs.join(sets.withColumnsRenamed({"rep": "a", "shingles": "sa"}), "a").join(sets.withColumnsRenamed({"rep": "b", "shingles": "sb"}), "b").select("a", "b", "sa", "sb")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            linked = []
            for sa, sb in zip(batch.column("sa"), batch.column("sb"), strict=True):
                x, y = sa.values.to_numpy(), sb.values.to_numpy()
                both = len(np.intersect1d(x, y, assume_unique=True))
                linked.append(100 * both >= percent * (len(x) + len(y) - both))
            yield batch.select(["a", "b"]).filter(pa.array(linked, pa.bool_()))

    return both.mapInArrow(compare, "a long, b long")


def sizes_fit(percent: int) -> Column:
    return 100 * F.least("na", "nb") >= percent * F.greatest("na", "nb")


def enough(left: Column, na: Column, nb: Column, percent: int) -> Column:
    """Whether as many common shingles link sets of these sizes."""
    return (100 + percent) * left >= percent * (na + nb)


def across(lists: DataFrame) -> DataFrame:
    """Members of the lists that hold more than one component."""
    mixed = lists.groupBy("value").agg(F.min("root").alias("r0"), F.max("root").alias("r1")).filter("r0 < r1").select("value")
    return lists.join(mixed, "value")


def rooted(members: DataFrame, roots: DataFrame) -> DataFrame:
    """The members (rep, ...) with their component as ``root``: itself for a class that is not linked."""
    named = roots.select(F.col("node").alias("rep"), F.col("root").alias("__root"))
    return members.join(named, "rep", "left").withColumn("root", F.coalesce("__root", "rep")).drop("__root")


def star_pairs(lists: DataFrame, percent: int, first: Column) -> DataFrame:
    """Rows (a, b), a < b: each member of a list (value, rep, root, n_shingles, most) and the list's centre.

    The centre is the member that comes last in the order of ``first``, the smallest of
    equals; ``most`` bounds what a member shares with others.
    """
    lists = lists.withColumn("first", first)
    centre = F.max(F.struct("first", (-F.col("rep")).alias("minus"), "n_shingles", "root", "most")).alias("c")
    centres = lists.groupBy("value").agg(centre, F.count("*").alias("m")).filter("m > 1")
    centres = centres.select("value", (-F.col("c.minus")).alias("centre"), F.col("c.n_shingles").alias("nb"), F.col("c.root").alias("rb"), F.col("c.most").alias("mb"))
    stars = lists.withColumnsRenamed({"n_shingles": "na", "root": "ra"}).join(centres, "value").filter(F.col("ra") != F.col("rb"))
    stars = stars.filter(sizes_fit(percent) & enough(F.least("most", "mb"), F.col("na"), F.col("nb"), percent))
    return stars.select(F.least("rep", "centre").alias("a"), F.greatest("rep", "centre").alias("b")).distinct()


def exact_lists(nodes: DataFrame, sets: DataFrame, percent: int, scratch: Scratch) -> DataFrame:
    """Rows (value, rep, root, n_shingles, most): the index of full sets of nodes (rep, root, n_shingles).

    A link across components is made of shingles that two components hold, here
    in the order of their frequency among the nodes.  ``most`` is how many of them a
    class has from this one on; a pair's first common shingle stands where both
    have enough left, so shingles further back are not indexed.
    """
    cells = sets.join(nodes, "rep").select("rep", "root", "n_shingles", F.explode("shingles").alias("value"))
    shared = cells.groupBy("value").agg(F.count("*").alias("df"), F.min("root").alias("r0"), F.max("root").alias("r1")).filter("r0 < r1").select("value", "df")
    shared = scratch.keep(shared, "shared")
    held = cells.join(shared, "value").groupBy("rep", "root", "n_shingles").agg(F.sort_array(F.collect_set(F.struct("df", "value"))).alias("held"))
    # The smallest partner of n shingles has t * n, and shares all of them.
    least = F.ceil(F.col("n_shingles") * percent / 100)
    indexed = held.withColumn("n", (F.size("held") - least + 1).cast("int")).filter("n > 0")
    indexed = indexed.select("rep", "root", "n_shingles", F.size("held").alias("size"), F.posexplode(F.slice("held", F.lit(1), F.col("n"))).alias("place", "x"))
    lists = scratch.keep(indexed.select("x.value", "rep", "root", "n_shingles", (F.col("size") - F.col("place")).cast("long").alias("most")), "exact")
    low = lists.groupBy("value").agg(F.min("n_shingles").alias("low"))
    fits = enough(F.col("most"), F.col("n_shingles"), F.greatest(F.col("low"), F.ceil(F.col("n_shingles") * percent / 100)), percent)
    kept = scratch.keep(across(lists.join(low, "value").filter(fits).drop("low")), "exact")
    scratch.drop(shared, lists)
    return kept


def cross_pairs(lists: DataFrame, percent: int) -> DataFrame:
    """Rows (a, b), a < b: the members of a list in different components that have enough left to be linked."""
    x = lists.withColumnsRenamed({"rep": "a", "n_shingles": "na", "root": "ra", "most": "ma"})
    y = lists.withColumnsRenamed({"rep": "b", "n_shingles": "nb", "root": "rb", "most": "mb"})
    apart = (F.col("a") < F.col("b")) & (F.col("ra") != F.col("rb"))
    return x.join(y, "value").filter(apart & sizes_fit(percent) & enough(F.least("ma", "mb"), F.col("na"), F.col("nb"), percent)).select("a", "b").distinct()


def linked_classes(classes: DataFrame, docs: DataFrame, n: int, percent: int, k: int, scratch: Scratch) -> DataFrame:
    """Rows (node, root): the component of each class that is linked to another."""
    lists = inverted_lists(classes, k, percent, scratch)
    # What a cut sketch shares bounds nothing, so a member of these lists may share all it has.
    free = lists.withColumn("root", F.col("rep")).withColumn("most", F.col("n_shingles"))
    stars = scratch.keep(star_pairs(free, percent, F.col("shared")), "stars")
    close = scratch.keep(close_pairs(stars, classes, k, percent), "close")
    unsure = close.filter("NOT exact").select("a", "b")
    ids = unsure.select(F.col("a").alias("rep")).unionByName(unsure.select(F.col("b").alias("rep"))).distinct()
    sets = scratch.keep(full_sets(scratch.keep(ids.join(classes.drop("sketch"), "rep"), "ids"), docs, n), "sets")
    roots = components(close.filter("exact").select("a", "b").unionByName(verified(unsure, sets, percent)), scratch)
    roots = scratch.keep(roots, "roots")
    scratch.drop(stars, close, sets)

    nodes = scratch.keep(across(rooted(lists, roots)).select("rep", "root").distinct().join(classes.drop("sketch"), "rep"), "nodes")
    sets = scratch.keep(full_sets(nodes, docs, n), "sets")
    exact = exact_lists(nodes.select("rep", "root", "n_shingles"), sets, percent, scratch)
    scratch.drop(lists, nodes)
    centres, turn = True, 0
    while True:
        members, pairs = exact.groupBy("value").agg(F.count("*").alias("m")).agg(F.coalesce(F.sum("m"), F.lit(0)), F.coalesce(F.sum(F.col("m") * (F.col("m") - 1) / 2), F.lit(0))).first()
        centres = centres and pairs > LONG * members
        met = star_pairs(exact, percent, F.xxhash64("rep", F.lit(turn)) if turn else F.col("most")) if centres else cross_pairs(exact, percent)
        met = scratch.keep(met, "pairs")
        links = scratch.keep(verified(met, sets, percent), "links")
        n_links = links.count()
        if n_links:
            # Contract what is joined: links between components are few.
            ends = rooted(links.withColumnRenamed("a", "rep"), roots).select(F.col("root").alias("a"), F.col("b").alias("rep"))
            ends = rooted(ends, roots).select("a", F.col("root").alias("b"))
            merged = scratch.keep(components(ends.unionByName(roots.select(F.col("node").alias("a"), F.col("root").alias("b"))), scratch), "roots")
            scratch.drop(roots)
            roots = merged
        scratch.drop(met, links)
        if not centres:
            break
        shorter = scratch.keep(across(rooted(exact.drop("root"), roots)), "exact")
        scratch.drop(exact)
        # Centres go on as long as a round links one member in twenty.
        exact, centres, turn = shorter, 20 * n_links >= members, turn + 1
    scratch.drop(exact, sets)
    return roots


def _grouped(docs: DataFrame, n: int, percent: int, k: int) -> DataFrame:
    """Rows (doc_id, did, th, n_shingles, first): ``first`` is (did, th) of the first document of the component, null without words."""
    scratch = Scratch(docs.sparkSession, "near")
    sketched = scratch.keep(sketch_rows(docs, n, k), "sketched")
    classes = sketched.filter("n_shingles > 0").groupBy("d1", "d2").agg(F.min(F.struct("did", "th")).alias("key"), F.count("*").alias("copies"), F.first("n_shingles").alias("n_shingles"), F.first("sketch").alias("sketch"))
    classes = scratch.keep(classes.select(F.monotonically_increasing_id().alias("rep"), "d1", "d2", "key.did", "key.th", "copies", "n_shingles", "sketch"), "classes")
    members = scratch.keep(sketched.drop("sketch"), "members")
    scratch.drop(sketched)
    roots = linked_classes(classes, docs, n, percent, k, scratch)
    named = rooted(classes.select("rep", "d1", "d2", F.struct("did", "th").alias("key")), roots)
    linked = scratch.keep(roots.join(classes.select(F.col("rep").alias("node"), "did", "th"), "node").groupBy("root").agg(F.min(F.struct("did", "th")).alias("least")), "least")
    named = scratch.keep(named.join(linked, "root", "left").select("d1", "d2", F.coalesce("least", "key").alias("first")), "named")
    scratch.drop(classes, linked)
    return members.join(named, ["d1", "d2"], "left").select("doc_id", "did", "th", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("first")).alias("first"))


def near_groups(docs: DataFrame, n: int = SHINGLE, percent: int = PERCENT, k: int = K) -> DataFrame:
    """Rows (doc_id, n_shingles, component_id, kept) of every row of the documents.

    A-Z are lower-cased.  A text of fewer words than a shingle is one shingle; one
    without words, empty or null, has none and is linked with nothing.
    Documents with 100 * intersection >= percent * union are linked;
    ``component_id`` is the smallest id reachable, the document's own included;
    ``kept``: it is the document's own.  A null id counts as larger than any other
    and is given as null.  Rows that share an id, null or not, are documents of their own;
    repeated rows give repeated rows; an empty table gives none.  Other columns are left out.
    """
    own = _grouped(docs, n, percent, k).withColumn("root", F.coalesce("first.did", "did"))
    component = F.when(F.col("root") != NO_ID, F.col("root"))
    return own.select("doc_id", "n_shingles", component.alias("component_id"), (F.col("did") == F.col("root")).alias("kept"))


def near_dedup(docs: DataFrame, n: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """One document, with all its columns, of each group: that of the smallest id; null ids count as the largest.

    Of several texts with that id, the one of the smallest hash stays; of repeated
    rows, one, whichever if their other columns differ.  Texts without words all stay.
    """
    scratch = Scratch(docs.sparkSession, "gone")
    own = scratch.keep(_grouped(docs.select("doc_id", "text"), n, percent, K).filter("n_shingles > 0").groupBy("did", "th", "first").agg(F.count("*").alias("n")), "own")
    gone = scratch.keep(own.filter((F.col("first.did") != F.col("did")) | (F.col("first.th") != F.col("th"))).select("did", "th"), "gone")
    again = scratch.keep(own.filter((F.col("first.did") == F.col("did")) & (F.col("first.th") == F.col("th")) & (F.col("n") > 1)).select("did", "th"), "again")
    scratch.drop(own)
    left = keyed(docs).drop("text").join(small(gone, 16 * gone.count()), ["did", "th"], "left_anti")
    n_again = again.count()
    if n_again:
        once, more = (left.join(small(again, 16 * n_again), ["did", "th"], how) for how in ("left_anti", "left_semi"))
        left = once.unionByName(more.dropDuplicates(["did", "th"]))
    return left.select(*(F.col(f"row.`{c}`").alias(c) for c in docs.columns))
