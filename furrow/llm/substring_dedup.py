"""Substring dedup: windows of words that also start in a document with a smaller id.

A window's anchor is the smallest hash among its runs of ``ANCHOR_WORDS`` words,
so equal windows have equal anchors, and an anchor's count is never below its
windows' counts.  Each partition counts the documents of its anchors in a
Count-min sketch of its own, and the sketches are added counter by counter;
merged, they overestimate how many documents hold a window.  A second pass
groups exactly only the windows whose estimate is two or more.  A sketch may
keep a window too many and loses none, whatever its width.

The second pass first groups whole stretches of windows that share an anchor: in
a copy of a stretch, every window also starts where the stretch was first.  Only the
windows of stretches that no smaller id holds as a whole are then grouped one by one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from furrow.llm import textcore as tc
from furrow.llm.storage import Scratch, small

WINDOW = 50
ANCHOR_WORDS = 16
#: Rows of the sketch, and counters of a row for each anchor: an anchor of one document is kept
#: for nothing with a chance of at most (1 / LOAD) ** DEPTH, about one in 64.
DEPTH, LOAD = 2, 8
#: A row of the sketch is cut into so many pages, each merged by itself, and more where a page would have more counters than this.
PAGES, MAX_PAGE = 256, 1 << 24
#: Anchors that one sketch of a partition takes; a partition with more of them makes several.
SKETCH_ANCHORS = 1 << 20
#: What a counter takes in the driver's memory when it is broadcast.
CELL_BYTES = 64
NO_ID = (1 << 63) - 1


def keyed(docs: DataFrame) -> DataFrame:
    """Rows (did, th, text) and the whole row: an id that is never null, the last for null, and a hash of the text."""
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("did"), F.xxhash64("text").alias("th"), F.col("text"), row)


def anchors(w: tc.Words, window: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The first words of the windows and the hash of the anchor of each."""
    starts = np.flatnonzero(w.left >= window)
    if not len(starts):
        return starts, np.empty(0, np.uint64)
    grams = w.grams(w.hashes(), size)
    # Minima over `span` values by doubling.
    span, have, low = window - size + 1, 1, grams.copy()
    while have < span:
        step = min(have, span - have)
        low[: len(low) - step] = np.minimum(low[: len(low) - step], low[step:])
        have += step
    return starts, low[starts]


def anchor_rows(docs: DataFrame, window: int, size: int) -> DataFrame:
    """Rows (did, th, anchor): the distinct anchors of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in tc.row_chunks(batch):
                w = tc.Words(part.column("text"))
                starts, anchor = anchors(w, window, size)
                # A run of windows mostly shares its anchor.
                new = np.ones(len(starts), bool)
                new[1:] = (anchor[1:] != anchor[:-1]) | (w.doc[starts[1:]] != w.doc[starts[:-1]])
                pairs = np.unique(np.stack([w.doc[starts[new]].astype(np.uint64), anchor[new]]), axis=1)
                at = pa.array(pairs[0].astype(np.int64))
                yield pa.RecordBatch.from_arrays([part.column("did").take(at), part.column("th").take(at), pa.array(pairs[1].view(np.int64))], names=["did", "th", "anchor"])

    return docs.select("did", "th", "text").mapInArrow(run, "did long, th long, anchor long")


def sketch_width(n_anchors: int) -> int:
    """Counters in a row: the power of two that ``n_anchors`` fill to one in ``LOAD`` at most."""
    return max(PAGES, 1 << (LOAD * n_anchors - 1).bit_length())


def page_size(width: int) -> int:
    return max(1, min(width // PAGES, MAX_PAGE))


def partition_sketches(rows: DataFrame, depth: int, width: int) -> DataFrame:
    """Rows (row, page, at, n): the counters above 0 of each page of each partition's sketch, as 32-bit places and 8-bit counts.

    A count stops at 255, and an estimate needs to tell no more than one from two.
    """
    page = page_size(width)
    names = [f"c{r}" for r in range(depth)]

    def packed(anchors: list[list[np.ndarray]]) -> pa.RecordBatch:
        out: dict[str, list] = {"row": [], "page": [], "at": [], "n": []}
        for r, parts in enumerate(anchors):
            cell, n = np.unique(np.concatenate(parts), return_counts=True)
            pages, first = np.unique(cell // page, return_index=True)
            at, n = (cell % page).astype("<u4"), np.minimum(n, 255).astype(np.uint8)
            for p, a, b in zip(pages.tolist(), first, [*first[1:], len(cell)], strict=True):
                for name, value in (("row", r), ("page", p), ("at", at[a:b].tobytes()), ("n", n[a:b].tobytes())):
                    out[name].append(value)
        return pa.RecordBatch.from_arrays([pa.array(out["row"], pa.int32()), pa.array(out["page"], pa.int64()), pa.array(out["at"], pa.binary()), pa.array(out["n"], pa.binary())], names=list(out))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = [[] for _ in names]
        size = 0
        for batch in batches:
            for r, name in enumerate(names):
                held[r].append(batch.column(name).to_numpy())
            size += batch.num_rows
            if size >= SKETCH_ANCHORS:
                yield packed(held)
                held, size = [[] for _ in names], 0
        if size:
            yield packed(held)

    return rows.select(*(_cell(r, width).alias(name) for r, name in enumerate(names))).mapInArrow(run, "row int, page long, at binary, n binary")


def sketch(rows: DataFrame, depth: int, width: int) -> DataFrame:
    """The merged Count-min sketch, the sum of the partitions' own: (row, cell, n) of the counters at two or more."""
    page = page_size(width)

    def add(key: tuple, parts: pa.Table) -> pa.Table:
        total = np.zeros(page, np.uint16)
        for at, n in zip(parts.column("at").to_pylist(), parts.column("n").to_pylist(), strict=True):
            cells = np.frombuffer(at, "<u4")  # each cell once in a part
            total[cells] = np.minimum(total[cells] + np.frombuffer(n, np.uint8), 255)
        hot = np.flatnonzero(total > 1)
        row, first = key[0].as_py(), key[1].as_py() * page
        return pa.table({"row": pa.array(np.full(len(hot), row), pa.int32()), "cell": pa.array(hot + first, pa.int64()), "n": pa.array(total[hot].astype(np.int64))})

    return partition_sketches(rows, depth, width).groupBy("row", "page").applyInArrow(add, "row int, cell long, n long")


def _cell(row: int, width: int):
    return F.pmod(F.xxhash64(F.lit(row), "anchor"), F.lit(width))


def estimated_repeated(rows: DataFrame, merged: DataFrame, depth: int, width: int) -> DataFrame:
    """The anchors whose smallest counter is two or more, as one list for each document that has any.

    The counters grow with the input and compress well, so they are counted before a join may broadcast them.
    """
    sizes = {r["row"]: r["count"] for r in merged.groupBy("row").count().collect()}  # one number for each row of the sketch
    for r in range(depth):
        hot = small(merged.filter(F.col("row") == r).select("cell"), CELL_BYTES * sizes.get(r, 0))
        rows = rows.withColumn("cell", _cell(r, width)).join(hot, "cell").drop("cell")
    return rows.groupBy("did", "th").agg(F.collect_list("anchor").alias("hot"))


def stretch_rows(docs: DataFrame, window: int, size: int) -> DataFrame:
    """Rows (k1, k2, n, did, th, pos): stretches of n windows, one word apart, that share an anchor of the document's list.

    A stretch has ``window`` windows at most, so that its first and last hold all its words; their hashes are the key of 128 bits.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in tc.row_chunks(batch):
                w = tc.Words(part.column("text"))
                starts, anchor = anchors(w, window, size)
                hot = part.column("hot")
                mark = np.uint64(0x9FB21C651E98DF25)
                doc_of = np.repeat(np.arange(w.n_docs), hot.value_lengths().to_numpy())
                among = np.sort(hot.flatten().to_numpy().view(np.uint64) ^ tc.mix(doc_of.astype(np.uint64) + mark))
                key = anchor ^ tc.mix(w.doc[starts].astype(np.uint64) + mark)
                ok = among[np.minimum(np.searchsorted(among, key), len(among) - 1)] == key if len(among) else np.zeros(len(key), bool)
                starts, anchor = starts[ok], anchor[ok]
                new = np.ones(len(starts), bool)
                new[1:] = (starts[1:] != starts[:-1] + 1) | (anchor[1:] != anchor[:-1]) | (w.doc[starts[1:]] != w.doc[starts[:-1]])
                place = np.arange(len(starts))
                new |= (place - np.maximum.accumulate(np.where(new, place, 0))) % window == 0
                first = starts[new]
                n = np.diff(np.append(np.flatnonzero(new), len(starts)))
                keys = []
                for k in (0, 1):
                    grams = w.grams(w.hashes(k), window, k)
                    keys.append(pa.array(tc.mix(grams[first] + tc.mix(grams[first + n - 1])).view(np.int64)))
                at = pa.array(w.doc[first])
                yield pa.RecordBatch.from_arrays([*keys, pa.array(n.astype(np.int32)), part.column("did").take(at), part.column("th").take(at), pa.array((first - w.first[w.doc[first]]).astype(np.int32))], names=["k1", "k2", "n", "did", "th", "pos"])

    return docs.select("did", "th", "text", "hot").mapInArrow(run, "k1 long, k2 long, n int, did long, th long, pos int")


def window_rows(docs: DataFrame, window: int) -> DataFrame:
    """Rows (w1, w2, did, th, pos) of the windows of the document's list of stretches ``leading``; the key has 96 bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in tc.row_chunks(batch):
                w = tc.Words(part.column("text"))
                leading = part.column("leading")
                doc_of = np.repeat(np.arange(w.n_docs), leading.value_lengths().to_numpy())
                pos, n = (leading.flatten().field(name).to_numpy() for name in ("pos", "n"))
                starts = np.repeat(w.first[doc_of] + pos - np.cumsum(n) + n, n) + np.arange(n.sum())
                one, two = (w.grams(w.hashes(k), window, k)[starts] for k in (0, 1))
                at = pa.array(w.doc[starts])
                yield pa.RecordBatch.from_arrays([pa.array(one.view(np.int64)), pa.array((two >> np.uint64(32)).astype(np.uint32).view(np.int32)), part.column("did").take(at), part.column("th").take(at), pa.array((starts - w.first[w.doc[starts]]).astype(np.int32))], names=["w1", "w2", "did", "th", "pos"])

    return docs.select("did", "th", "text", "leading").mapInArrow(run, "w1 long, w2 int, did long, th long, pos int")


def as_runs(found: DataFrame, window: int) -> DataFrame:
    """Rows (did, th, starts, ends): the stretches of words that the listed (pos, n), n windows from a position on, cover."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            starts, ends = [], []
            for part in batch.column("found"):
                p, n = (part.values.field(name).to_numpy() for name in ("pos", "n"))
                order = np.argsort(p, kind="stable")
                p, end = p[order], np.maximum.accumulate((p + n - 1 + window)[order])
                new = np.append(0, np.flatnonzero(p[1:] > end[:-1]) + 1)
                starts.append(p[new])
                ends.append(end[np.append(new[1:] - 1, len(p) - 1)])
            kind = pa.list_(pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column("did"), batch.column("th"), pa.array(starts, kind), pa.array(ends, kind)], names=["did", "th", "starts", "ends"])

    return found.mapInArrow(run, "did long, th long, starts array<int>, ends array<int>")


def first_ids(rows: DataFrame, key: list[str]) -> DataFrame:
    """Rows (key, first): the smallest id of the keys that several ids hold."""
    return rows.groupBy(*key).agg(F.min("did").alias("first"), F.max("did").alias("last")).filter("last > first").select(*key, "first")


def repeated_runs(docs: DataFrame, scratch: Scratch, window: int = WINDOW, size: int = ANCHOR_WORDS, depth: int = DEPTH, width: int | None = None) -> DataFrame:
    """Rows (did, th, starts, ends) of the documents that hold repeats: word stretches covered by
    windows that also start in a document with a smaller id.  Null ids count as the largest.
    The sketch's width follows from the number of anchors, if it is not given."""
    docs = keyed(docs)
    rows = scratch.keep(anchor_rows(docs, window, size), "anchors")
    width = width or sketch_width(rows.count())
    merged = scratch.keep(sketch(rows, depth, width), "sketch")
    hot = scratch.keep(estimated_repeated(rows, merged, depth, width), "hot")
    n_hot = hot.agg(F.coalesce(F.sum(F.size("hot") + 4), F.lit(0))).first()[0]
    scratch.drop(rows, merged)
    texts = docs.select("did", "th", "text")
    stretches = scratch.keep(stretch_rows(texts.join(small(hot, 8 * n_hot), ["did", "th"]), window, size), "stretches")
    key = ["k1", "k2", "n"]
    first = scratch.keep(first_ids(stretches, key), "first-of-stretches")
    place, copied = F.struct("pos", "n"), F.col("did") > F.col("first")
    # Without a first id, no other id holds the stretch.
    split = stretches.join(first, key, "left").groupBy("did", "th").agg(F.collect_list(F.when(copied, place)).alias("copied"), F.collect_list(F.when(F.coalesce(~copied, F.lit(True)), place)).alias("leading"))
    split = scratch.keep(split, "split")
    scratch.drop(stretches, first, hot)
    leading = split.filter(F.size("leading") > 0).select("did", "th", "leading")
    n_leading = leading.agg(F.coalesce(F.sum(F.size("leading") + 4), F.lit(0))).first()[0]
    windows = scratch.keep(window_rows(texts.join(small(leading, 16 * n_leading), ["did", "th"]), window), "windows")
    first = scratch.keep(first_ids(windows, ["w1", "w2"]), "first-of-windows")
    later = windows.join(first, ["w1", "w2"]).filter("did > first").select("did", "th", "pos", F.lit(1).alias("n"))
    later = later.unionByName(split.select("did", "th", F.inline("copied")))
    runs = scratch.keep(as_runs(later.groupBy("did", "th").agg(F.collect_list(place).alias("found")), window), "runs")
    scratch.drop(windows, first, split)
    return runs


def cut(docs: DataFrame, runs: DataFrame, digest: bool) -> DataFrame:
    """Every row of the documents with what is left of its words.

    Columns: ``row`` (the whole input row), ``n_words``, ``n_removed``, and
    ``kept``: the kept words joined by one space, or with ``digest`` the
    lowercase hex SHA-256 of that.
    """
    given = keyed(docs).select("did", "th", "text", F.col("row.doc_id").alias("doc_id") if digest else F.col("row"))
    size = runs.agg(F.coalesce(F.sum(48 + 8 * F.size("starts")), F.lit(0))).first()[0]
    given = given.join(small(runs, size), ["did", "th"], "left").select(given.columns[3], "text", "starts", "ends")
    name = given.columns[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in tc.row_chunks(batch):
                w = tc.Words(part.column("text"))
                gone = np.zeros(len(w.starts) + 1, np.int64)
                for column, sign in (("starts", 1), ("ends", -1)):
                    lists = part.column(column)
                    at = lists.flatten().to_numpy(zero_copy_only=False) + np.repeat(w.first[:-1], np.nan_to_num(lists.value_lengths().to_numpy(zero_copy_only=False)).astype(np.int64))
                    np.add.at(gone, at.astype(np.int64), sign)
                kept = np.flatnonzero(np.cumsum(gone[:-1]) == 0)
                a, size = w.starts[kept], w.ends[kept] - w.starts[kept] + 1
                off = np.concatenate(([0], np.cumsum(size)))
                take = np.repeat(a - off[:-1], size) + np.arange(off[-1])
                out = np.append(w.data, np.uint8(0x20))[take]
                out[off[1:] - 1] = 0x20
                n_kept = np.bincount(w.doc[kept], minlength=w.n_docs)
                upto = np.concatenate(([0], np.cumsum(n_kept)))
                raw = out.tobytes()
                texts = [raw[off[i] : max(off[i], off[j] - 1)] for i, j in zip(upto[:-1], upto[1:], strict=True)]
                result = [hashlib.sha256(t).hexdigest() for t in texts] if digest else [t.decode() for t in texts]
                yield pa.RecordBatch.from_arrays([part.column(name), pa.array(w.count), pa.array(w.count - n_kept), pa.array(result, pa.string())], names=[name, "n_words", "n_removed", "kept"])

    return given.mapInArrow(run, f"{name} {given.schema[name].dataType.simpleString()}, n_words long, n_removed long, kept string")


def substring_dedup(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """The documents, with all their columns, without the words that repeat an earlier document's.

    Earlier means a smaller id.  Texts that lose nothing stay as they are;
    others hold their kept words joined by one space.  A document that loses all
    its words goes.  ``n_chars``, where there is one, follows the text.  Texts of
    fewer words than a window, null and empty ones stay.
    """
    runs = repeated_runs(docs, Scratch(docs.sparkSession, "substring"), window)
    left = cut(docs, runs, digest=False).filter("n_removed = 0 OR n_removed < n_words")
    text = F.when(F.col("n_removed") > 0, F.col("kept")).otherwise(F.col("row.text"))
    fresh = {"text": text} | ({"n_chars": F.when(F.col("n_removed") > 0, F.length("kept").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("row.n_chars"))} if "n_chars" in docs.columns else {})
    return left.select(*(fresh.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns))


def substring_digest(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """Rows (doc_id, n_words, n_removed, kept_sha256) of every document.

    A null or empty text has no words and the digest of the empty string.
    Repeated rows give repeated rows: neither has the smaller id.
    """
    runs = repeated_runs(docs, Scratch(docs.sparkSession, "substring"), window)
    return cut(docs, runs, digest=True).withColumnRenamed("kept", "kept_sha256")
