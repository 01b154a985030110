"""Mixing sources to target weights, with DataFrame operations only.

The words of a source form one stream, cut into blocks of a fixed length.  Each
output shard has a fixed number of slots; their sources are a multinomial draw
with the whole parts of the expectations fixed, which keeps a source's total
within a few slots of its target.  The k-th slot of a source holds the block
at place k of a pseudorandom permutation of the source's block indices, anew in
each round through the source.  Slots meet their blocks by a join on
(source, block), whose keys are even however large one source is.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from furrow.llm.storage import Scratch

BLOCK_WORDS = 128
SHARD_SLOTS = 1 << 14
MAX_REPEAT = 3
SEED = 42
#: Rows of a source that one window sums, and such windows that the next level sums.
ROWS_AT_ONCE, WINDOWS_AT_ONCE = 512, 4096
#: Primes above 2**40: coprime with every block count up to that.
PRIMES = (1099511627791, 1100511627793, 1101511627807, 1102511627849)


@dataclass
class Mix:
    """``sources`` (sid, source, source_size, target, blocks, ...), ``slots`` (shard, sid, place, block),
    ``spans`` (sid, start, size, doc_id, block, words): which words of which row lie in a block."""

    rows: DataFrame
    sources: DataFrame
    slots: DataFrame
    spans: DataFrame


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long"), F.lit(0).cast("long"))


def source_targets(sized: DataFrame, weights: tuple[int, ...] = (1, 2, 3), max_repeat: int = MAX_REPEAT) -> DataFrame:
    """Rows (sid, source, n_rows, source_size, weight, target).

    Sources in order of code point, null last, weigh the given weights in turn
    and share the sum of all sizes.  A target stops at ``max_repeat`` times the
    source's size; what is cut off is shared again by weight.  Taken in order of
    size over weight, the sources that stop are the first ones, so one running sum finds them.
    The table has one row a source.
    """
    per_source = sized.groupBy("source").agg(F.count("*").alias("n_rows"), F.sum("size").alias("source_size"))
    turn = F.element_at(F.array(*map(F.lit, weights)), ((F.col("sid") - 1) % len(weights) + 1).cast("int"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    t = per_source.withColumn("sid", F.row_number().over(order)).withColumn("weight", turn.cast("long"))
    t = t.withColumn("cap", max_repeat * F.col("source_size"))
    by_ratio = Window.orderBy(F.col("cap") / F.col("weight"), "sid")
    whole = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before, after = by_ratio.rowsBetween(Window.unboundedPreceding, -1), by_ratio.rowsBetween(0, Window.unboundedFollowing)
    t = t.withColumn("total", F.sum("source_size").over(whole))
    t = t.withColumn("left", F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0))).withColumn("weight_left", F.sum("weight").over(after))
    t = t.withColumn("stops", F.col("cap") * F.col("weight_left") <= F.col("weight") * F.col("left"))
    free = F.col("total") - F.sum(F.when(F.col("stops"), F.col("cap")).otherwise(0)).over(whole)
    share = F.col("weight") * free.cast("double") / F.sum(F.when(F.col("stops"), 0).otherwise(F.col("weight"))).over(whole)
    t = t.withColumn("target", F.when(F.col("stops"), F.col("cap").cast("double")).otherwise(F.when(F.col("total") > 0, share).otherwise(0.0)))
    return t.select("sid", "source", "n_rows", "source_size", "weight", "target")


def uniform(*keys: Column) -> Column:
    """A number in [0, 1) that depends on the keys alone."""
    return F.pmod(F.xxhash64(F.lit(SEED), *keys), F.lit(1 << 53)) / F.lit(float(1 << 53))


def _let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is computed once, however often f names it."""
    return F.transform(F.array(value), f)[0]


def permuted(place: Column, n: Column, *keys: Column) -> Column:
    """Where a pseudorandom permutation of 0 .. n-1, one for each value of the keys, puts a place; n up to 2**40.

    Two rounds of an affine map modulo n and an xor-shift of the largest power of two in n are each one to one.
    """

    def affine(at: Column, key: Column) -> Column:
        a = F.element_at(F.array(*map(F.lit, PRIMES)), (F.pmod(key, F.lit(len(PRIMES))) + 1).cast("int")) % n
        return (F.shiftleft(a * F.shiftright(at, 20) % n, 20) + a * at.bitwiseAND(F.lit((1 << 20) - 1)) + F.pmod(F.xxhash64(key), n)) % n

    def fold(at: Column, bits: Column) -> Column:
        half = F.call_function("shiftright", at, F.greatest(F.lit(1), F.ceil(bits / 2).cast("int")))
        return F.when(at < F.call_function("shiftleft", F.lit(1).cast("long"), bits), at.bitwiseXOR(half)).otherwise(at)

    bits = F.floor(F.log2(n.cast("double") + 0.5)).cast("int")
    for r in (0, 1):
        key = F.xxhash64(F.lit(SEED), F.lit(r), *keys)
        place = _let(_let(place, lambda x, key=key: affine(x, key)), lambda x: fold(x, bits))
    return place


def stream_starts(sized: DataFrame) -> DataFrame:
    """Adds ``start``, the words of the source before a row; rows (sid, n_rows, doc_id, size, ...) with size above 0.

    Rows are dealt to windows of about ``ROWS_AT_ONCE`` by a hash, sums of
    windows to windows again, so that no source is summed in one task.
    """
    rows = sized.withColumn("w", F.pmod(F.xxhash64(F.lit(SEED), "doc_id", "size"), F.ceil(F.col("n_rows") / ROWS_AT_ONCE)))
    inner = Window.partitionBy("sid", "w").orderBy("doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    per_w = rows.groupBy("sid", "w").agg(F.sum("size").alias("w_size")).withColumn("v", F.floor(F.col("w") / WINDOWS_AT_ONCE))
    per_v = per_w.groupBy("sid", "v").agg(F.sum("w_size").alias("v_size"))
    v_start = F.coalesce(F.sum("v_size").over(Window.partitionBy("sid").orderBy("v").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    w_start = F.coalesce(F.sum("w_size").over(Window.partitionBy("sid", "v").orderBy("w").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = per_w.withColumn("w_start", w_start).join(per_v.withColumn("v_start", v_start), ["sid", "v"]).select("sid", "w", (F.col("w_start") + F.col("v_start")).alias("w_start"))
    rows = rows.withColumn("inner", F.coalesce(F.sum("size").over(inner), F.lit(0)))
    return rows.join(starts, ["sid", "w"]).withColumn("start", F.col("w_start") + F.col("inner")).drop("w", "w_start", "inner")


def mix_sources(docs: DataFrame, block_words: int = BLOCK_WORDS, shard_slots: int = SHARD_SLOTS, max_repeat: int = MAX_REPEAT) -> Mix:
    """Plans the mix of all documents (doc_id, text, source).

    A null text has no words, a null source is a source of its own.  Repeated
    rows each hold their own place in the stream.  Other columns are not read.
    An empty table, or one without words, gives no slots.  Reruns agree.
    """
    scratch = Scratch(docs.sparkSession, "mix")
    sized = scratch.keep(docs.select("doc_id", "source", word_count(F.col("text")).alias("size")), "sizes")
    sources = source_targets(sized, max_repeat=max_repeat)
    blocks = F.ceil(F.col("source_size") / block_words)
    sources = sources.withColumn("blocks", blocks).withColumn("expected", F.when(F.col("source_size") > 0, F.col("blocks") * F.col("target") / F.col("source_size")).otherwise(0.0))
    sources = scratch.keep(sources, "sources")
    rows = sized.join(sources, sized["source"].eqNullSafe(sources["source"])).select("doc_id", "size", *(sources[c] for c in ("sid", "n_rows", "source_size", "target")))
    rows = scratch.keep(stream_starts(rows.filter("size > 0")), "rows").unionByName(rows.filter("size = 0").withColumn("start", F.lit(None).cast("long")))

    # Slots of each source in each shard: the whole part of the expectation, and draws of the rest.
    whole = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    plan = sources.filter("expected > 0").withColumn("all", F.sum("expected").over(whole)).withColumn("n_slots", F.round("all").cast("long"))
    plan = plan.withColumn("shard", F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.col("n_slots") / shard_slots) - 1)))
    in_shard = F.least(F.lit(shard_slots).cast("long"), F.col("n_slots") - F.col("shard") * shard_slots)
    mean = in_shard * F.col("expected") / F.col("all")
    cells = plan.select("shard", "sid", "blocks", F.floor(mean).alias("fixed"), (mean - F.floor(mean)).alias("rest"), in_shard.alias("in_shard"))
    per_shard = Window.partitionBy("shard")
    cells = cells.withColumn("upto", F.sum("rest").over(per_shard.orderBy("sid"))).withColumn("rests", F.sum("rest").over(per_shard)).withColumn("draws", F.col("in_shard") - F.sum("fixed").over(per_shard))
    cells = scratch.keep(cells.withColumn("is_last", F.row_number().over(per_shard.orderBy(F.desc("sid"))) == 1), "cells")
    draws = cells.filter("is_last AND draws > 0").select("shard", "rests", F.explode(F.sequence(F.lit(1).cast("long"), "draws")).alias("d"))
    draws = draws.select(F.col("shard").alias("s"), (uniform(F.col("shard"), F.col("d")) * F.col("rests")).alias("u"))
    hit = cells.join(draws, (F.col("shard") == F.col("s")) & ((F.col("u") < F.col("upto")) | F.col("is_last")) & (F.col("u") >= F.col("upto") - F.col("rest")))
    drawn = hit.groupBy("shard", "sid").agg(F.count("*").alias("drawn"))
    counts = cells.join(drawn, ["shard", "sid"], "left").select("shard", "sid", "blocks", (F.col("fixed") + F.coalesce("drawn", F.lit(0))).alias("m"))
    first = F.coalesce(F.sum("m").over(Window.partitionBy("sid").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = counts.withColumn("first", first).filter("m > 0")
    slots = counts.select("shard", "sid", "blocks", F.explode(F.sequence("first", F.col("first") + F.col("m") - 1)).alias("place")).filter(F.col("place") < max_repeat * F.col("blocks"))
    turn = F.floor(F.col("place") / F.col("blocks"))
    block = permuted(F.col("place") % F.col("blocks"), F.col("blocks"), F.col("sid"), turn)
    slots = slots.select("shard", "sid", "place", block.alias("block"))

    end = F.col("start") + F.col("size")
    spans = rows.filter("size > 0").withColumn("block", F.explode(F.sequence(F.floor(F.col("start") / block_words), F.floor((end - 1) / block_words))))
    words = F.least(end, (F.col("block") + 1) * block_words) - F.greatest(F.col("start"), F.col("block") * block_words)
    spans = spans.select("sid", "start", "size", "doc_id", "block", words.alias("words"))
    return Mix(rows, sources, slots, spans)


def taken_words(mix: Mix) -> DataFrame:
    """Rows (doc_id, size, source_size, target, taken) of every document: the words that the mix takes of it."""
    uses = mix.slots.groupBy("sid", "block").agg(F.count("*").alias("uses"))
    taken = mix.spans.join(uses, ["sid", "block"]).groupBy("sid", "start").agg(F.sum(F.col("words") * F.col("uses")).alias("taken"))
    out = mix.rows.join(taken, ["sid", "start"], "left")
    return out.select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0).cast("long")).alias("taken"))
