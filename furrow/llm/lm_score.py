"""Language-model scores: marginal likelihood over a subword lattice.

The pieces of an existing vocabulary file weigh all segmentations of a text; no
piece crosses a word's border, so a text's probability is the product of its
words' marginal probabilities and that of one end.  The file at hand holds
merge ranks instead of unigram scores: they give the weights to start from, and
expectation-maximisation over the word counts of the training documents fits
them.  The vocabulary itself is never changed.

A frequent head of the word table, of a fixed size, goes to every worker; only
words beyond it are shuffled to meet their counts, so no hot word gathers in a
task and no part of the table is left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from furrow.llm import textcore as tc
from furrow.llm.lattice import Lattice, Pieces
from furrow.llm.storage import Scratch

#: Words of the head, at most.
HEAD_WORDS = 1 << 18
#: Words are counted by steps of this many to a doubling of their uses; the head is made of whole steps.
STEPS = 16
ROUNDS = 2
SMOOTHING = 0.1
_CHUNK = 4 << 20
_WORDS_AT_ONCE = 50_000


def _uniques(words: tc.Words, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """First places of the distinct keys, the distinct key of each word, and the words' texts."""
    _, at, inverse = np.unique(keys, return_index=True, return_inverse=True)
    return at, inverse, _texts(words, at)


def _texts(words: tc.Words, at: np.ndarray) -> pa.Array:
    a, b = words.starts[at], words.ends[at]
    size = b - a
    off = np.concatenate(([0], np.cumsum(size)))
    data = words.data[np.repeat(a - off[:-1], size) + np.arange(off[-1])]
    return pa.StringArray.from_buffers(len(at), pa.py_buffer(off.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data)))


def word_table(docs: DataFrame, train: Column) -> DataFrame:
    """Rows (word, c, n) of all words of all documents: uses in training documents and in all.

    A-Z are lower-cased.  The end of a text is the empty word.  A null text has
    an end and no word.
    """
    given = docs.select(F.coalesce(train, F.lit(True)).alias("train"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in tc.row_chunks(batch, limit=_CHUNK):
                train = part.column("train").to_numpy(zero_copy_only=False).astype(bool)
                w = tc.Words(part.column("text"), lower=True)
                at, of, texts = _uniques(w, w.hashes())
                c = np.bincount(of, weights=train[w.doc], minlength=len(at)).astype(np.int64)
                n = np.bincount(of, minlength=len(at))
                yield pa.RecordBatch.from_arrays([texts, pa.array(c), pa.array(n)], names=["word", "c", "n"])
                yield pa.RecordBatch.from_arrays([pa.array([""]), pa.array([int(train.sum())]), pa.array([len(train)])], names=["word", "c", "n"])

    rows = given.mapInArrow(run, "word string, c long, n long")
    return rows.groupBy("word").agg(F.sum("c").alias("c"), F.sum("n").alias("n"))


def expected_uses(words: DataFrame, pieces: list[bytes], log_weight: np.ndarray) -> np.ndarray:
    """Expected uses of each piece over the training words; the result is as long as the vocabulary."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice, total = Lattice(pieces), np.zeros(len(log_weight))
        for batch in batches:
            for k in range(0, batch.num_rows, _WORDS_AT_ONCE):
                part = batch.slice(k, _WORDS_AT_ONCE)
                total += lattice.run([x.as_py() for x in part.column("word").cast(pa.binary())], log_weight, part.column("c").to_numpy().astype(float))[1]
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["piece", "uses"])

    rows = words.filter("c > 0 AND word <> ''").select("word", "c").mapInArrow(run, "piece long, uses double")
    uses = np.zeros(len(log_weight))
    for r in rows.groupBy("piece").agg(F.sum("uses").alias("uses")).toPandas().itertuples():
        uses[r.piece] = r.uses
    return uses


def fit(words: DataFrame, pieces: Pieces, ends: int, rounds: int = ROUNDS) -> np.ndarray:
    """Natural-log weights of the pieces, and of the end at their close."""
    log_weight = pieces.start
    for _ in range(rounds):
        uses = expected_uses(words, pieces.texts, log_weight)
        uses[pieces.end] = ends
        log_weight = np.log((uses + SMOOTHING) / (uses.sum() + SMOOTHING * len(uses)))
    return log_weight


def word_scores(words: DataFrame, pieces: list[bytes], log_weight: np.ndarray) -> DataFrame:
    """The word table with ``lp``, the model's log10 probability of each word or of the end."""
    end = len(pieces)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = Lattice(pieces)
        for batch in batches:
            for k in range(0, batch.num_rows, _WORDS_AT_ONCE):
                part = batch.slice(k, _WORDS_AT_ONCE)
                texts = [x.as_py() for x in part.column("word").cast(pa.binary())]
                lp = lattice.run(texts, log_weight)[0] / np.log(10)
                lp[[not t for t in texts]] = log_weight[end] / np.log(10)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(lp)], names=[*part.schema.names, "lp"])

    return words.select("word", "c", "n").mapInArrow(run, "word string, c long, n long, lp double")


def hashed(words: DataFrame) -> DataFrame:
    """Rows (key, c, lp): the words by the hash that ``textcore`` gives them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(tc.Words(batch.column("word")).hashes().view(np.int64)), batch.column("c"), batch.column("lp")], names=["key", "c", "lp"])

    return words.select("word", "c", "lp").mapInArrow(run, "key long, c long, lp double")


def lm_scores(docs: DataFrame, train: Column, model_file: str, head_words: int = HEAD_WORDS, rounds: int = ROUNDS) -> DataFrame:
    """Rows (doc_id, n_tokens, n_known, train_tokens, base_score, score) of every document.

    ``train`` says which rows are learnt from; where it is null, they are.  Tokens
    are words with A-Z lower-cased and one end.  ``base_score`` sums
    log10((c + 0.1) / (N + 0.1 * (V + 1))) over them, ``score`` the model's
    log10 probabilities.  A null or empty text has the end only.  Repeated rows
    give repeated rows; other columns are left out.  Without training rows all
    counts are 0 and the weights stay as they start.  An empty table gives an
    empty result.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "lm")
    counted = scratch.keep(word_table(docs, train), "words")
    sums = counted.agg(F.sum("c").alias("N"), F.sum((F.col("c") > 0).cast("long")).alias("V"), F.sum(F.when(F.col("word") == "", F.col("c"))).alias("ends")).first()
    n_all, distinct, ends = (int(x or 0) for x in sums)
    pieces = Pieces(model_file)
    log_weight = fit(counted, pieces, ends, rounds if n_all else 0)
    words = scratch.keep(word_scores(counted, pieces.texts, log_weight), "scored")
    below = float(n_all + 0.1 * (distinct + 1))

    # The most frequent words, a fixed number at most, looked up by a 64-bit hash of their text.
    step = F.floor(F.log2("n") * STEPS).cast("int")
    sizes = sorted(words.filter("word <> ''").groupBy(step.alias("step")).count().collect(), reverse=True)  # a few hundred steps at most
    upto = np.cumsum([r["count"] for r in sizes])
    fit_in = int(np.searchsorted(upto, head_words, side="right"))
    least = sizes[fit_in - 1]["step"] if fit_in else 1 << 30
    top = hashed(words.filter("word <> ''").filter(step >= least)).toPandas()
    keys = top["key"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(keys)
    end = words.filter("word = ''").select("c", "lp").first()
    head = spark.sparkContext.broadcast({"key": keys[order], "c": top["c"].to_numpy(np.float64)[order], "lp": top["lp"].to_numpy(np.float64)[order], "end": (float(end["c"]), float(end["lp"])) if end else (0.0, 0.0)})
    kind = docs.schema["doc_id"].dataType.simpleString()
    names = ["row", "doc_id", "word", "uses", "n_tokens", "n_known", "base_score", "score"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, row = head.value, TaskContext.get().partitionId() << 40
        for batch in batches:
            for part in tc.row_chunks(batch, limit=_CHUNK):
                w = tc.Words(part.column("text"), lower=True)
                keys = w.hashes()
                slot = np.minimum(np.searchsorted(table["key"], keys), max(0, len(table["key"]) - 1))
                known = table["key"][slot] == keys if len(table["key"]) else np.zeros(len(keys), bool)
                c, lp = (np.where(known, table[x][slot], 0.0) if len(table["key"]) else np.zeros(len(keys)) for x in ("c", "lp"))
                base = np.where(known, np.log10((c + 0.1) / below), 0.0)
                total = [np.bincount(w.doc, weights=x, minlength=w.n_docs) for x in (known & (c > 0), base, lp)]
                end_c, end_lp = table["end"]
                ids, size = row + np.arange(w.n_docs), w.n_docs
                row += size
                yield pa.RecordBatch.from_arrays([pa.array(ids), part.column("doc_id"), pa.nulls(size, pa.string()), pa.nulls(size, pa.int64()), pa.array(w.count + 1), pa.array(total[0].astype(np.int64) + (end_c > 0)), pa.array(total[1] + np.log10((end_c + 0.1) / below)), pa.array(total[2] + end_lp)], names=names)
                rare = np.flatnonzero(~known)
                key = keys[rare] ^ tc.mix(w.doc[rare].astype(np.uint64) + tc._LEN)
                _, at, uses = np.unique(key, return_index=True, return_counts=True)
                at = rare[at]
                size = len(at)
                yield pa.RecordBatch.from_arrays([pa.array(ids[w.doc[at]]), pa.nulls(size, part.column("doc_id").type), _texts(w, at), pa.array(uses), *(pa.nulls(size, t) for t in (pa.int64(), pa.int64(), pa.float64(), pa.float64()))], names=names)

    schema = f"row long, doc_id {kind}, word string, uses long, n_tokens long, n_known long, base_score double, score double"
    found = scratch.keep(docs.select("doc_id", "text").mapInArrow(run, schema), "found")
    rare = found.filter("word IS NOT NULL").select("row", "word", "uses").join(words.select("word", "c", "lp"), "word")
    rare = rare.select("row", F.lit(None).cast(kind).alias("doc_id"), F.lit(None).cast("long").alias("n_tokens"), F.when(F.col("c") > 0, F.col("uses")).otherwise(0).alias("n_known"), (F.col("uses") * F.log10((F.col("c") + 0.1) / below)).alias("base_score"), (F.col("uses") * F.col("lp")).alias("score"))
    every = found.filter("word IS NULL").select(rare.columns).unionByName(rare)
    sums = every.groupBy("row").agg(F.max("doc_id").alias("doc_id"), *(F.sum(x).alias(x) for x in ("n_tokens", "n_known")), F.lit(n_all).cast("long").alias("train_tokens"), *(F.sum(x).alias(x) for x in ("base_score", "score")))
    return sums.drop("row")
