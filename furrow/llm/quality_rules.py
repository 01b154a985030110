"""Quality rules by repetition coverage.

Rolling hashes of several n-gram lengths mark the words that lie in an n-gram
found twice or more in the same document, and line hashes mark repeated lines.
A document is rejected if the marked characters cover too much of it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from furrow.llm import textcore as tc

#: Percent of a document's word characters that duplicated n-grams of this length may cover.  Well below
#: ``MAX_REPEAT_PERCENT``, as a word in a repeated longer window is in a repeated 3-word window too.
MAX_GRAM_PERCENT = {5: 40, 8: 30, 12: 20}
#: Percent of a document's word characters that lines equal to an earlier line may cover.
MAX_LINE_PERCENT = 30
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True

_SCHEMA = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, dup_line_chars long"


def measure(docs: DataFrame, gram_lengths: tuple[int, ...] = tuple(MAX_GRAM_PERCENT), keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """One row per document with the kept columns and its counts.

    ``n_words``; ``word_chars`` (code points in words); ``n_symbols``;
    ``n_dup_lines`` (lines with a word that equal an earlier line);
    ``n_repeat_words`` (words in 3-word windows found twice or more);
    ``dup_line_chars`` (word code points in those lines); ``dup_chars_<n>``
    (word code points inside duplicated n-grams).  A null or empty text has
    zeros everywhere.  Repeated rows give repeated rows; other columns,
    whatever their names, are left out unless kept.
    """
    names = [*_SCHEMA.replace(" long", "").split(", "), *(f"dup_chars_{n}" for n in gram_lengths)]
    given = docs.select(*(F.col(f"`{c}`") for c in keep), F.col("text").alias("__text"))
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in given.schema.fields[:-1]] + [f"{n} long" for n in names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in tc.row_chunks(batch, "__text"):
                counts = _counts(part.column("__text"), gram_lengths)
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], *(pa.array(c, pa.int64()) for c in counts)], names=[*part.schema.names[:-1], *names])

    return given.mapInArrow(run, schema)


def _counts(texts: pa.Array, gram_lengths: tuple[int, ...]) -> list[np.ndarray]:
    w = tc.Words(texts)
    h, chars = w.hashes(), w.code_points()
    symbols = np.concatenate(([0], np.cumsum(_SYMBOL[w.data])))
    a, b, of = tc.lines(w)
    line = np.empty(len(a), np.uint64)
    line[:] = tc.mix(tc.span_hashes(w.data, a, b) + of.astype(np.uint64) * np.uint64(0xD1B54A32D192ED03))
    order = np.argsort(line, kind="stable")
    later = np.zeros(len(a), bool)
    later[order[1:]] = line[order[1:]] == line[order[:-1]]
    word_run = np.concatenate(([0], np.cumsum(chars)))
    line_chars = word_run[np.searchsorted(w.starts, b)] - word_run[np.searchsorted(w.starts, a)]
    out = [
        w.count,
        w.per_doc(chars),
        symbols[w.off[1:]] - symbols[w.off[:-1]],
        np.bincount(of[later], minlength=w.n_docs),
        w.per_doc(w.repeated(w.grams(h, 3), 3)),
        np.bincount(of[later], weights=line_chars[later], minlength=w.n_docs).astype(np.int64),
    ]
    return out + [w.per_doc(chars * w.repeated(w.grams(h, n), n)) for n in gram_lengths]


def judge(measured: DataFrame, max_gram: dict[int, int] | None = None, max_line: int = MAX_LINE_PERCENT) -> DataFrame:
    """Adds ``base_failed`` and ``kept``.  A document without words fails the base and is not kept."""
    max_gram = MAX_GRAM_PERCENT if max_gram is None else max_gram
    base = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    bad = 100 * F.col("dup_line_chars") > max_line * F.col("word_chars")
    for n, most in max_gram.items():
        bad = bad | (100 * F.col(f"dup_chars_{n}") > most * F.col("word_chars"))
    return measured.withColumn("base_failed", base).withColumn("kept", ~(base | bad))


def quality_rules(docs: DataFrame) -> DataFrame:
    """Counts and verdict of every document; see ``measure`` and ``judge``."""
    return judge(measure(docs))


def keep_good(docs: DataFrame) -> DataFrame:
    """The documents, with all their columns, that the rules keep."""
    packed = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("__row"), F.col("text"))
    return judge(measure(packed, keep=("__row",))).filter("kept").select("__row.*")
