"""Token counts of a byte-level BPE tokenizer by the whole-token shortcut.

The tokenizer first cuts a text into pre-tokens and merges inside each.  Before
any document is read, every vocabulary string is put through the library: those
that are one pre-token and come out as one token are proved to count one.
Documents are cut into pre-tokens; a proved one counts directly, and only the
rest are merged; a worker remembers the counts of the stretches it has met.
"""

from __future__ import annotations

import re
import sys
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from furrow.llm import textcore as tc

#: Merged stretches that a worker remembers before it forgets them all.
MAX_REMEMBERED = 400_000
#: Longer stretches are merged but not remembered.
MAX_LENGTH_REMEMBERED = 64
_WHITE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"


def _ranges(points: list[int]) -> str:
    out, i = [], 0
    while i < len(points):
        j = i
        while j + 1 < len(points) and points[j + 1] == points[j] + 1:
            j += 1
        out.append(rf"\U{points[i]:08x}" + (rf"-\U{points[j]:08x}" if j > i else ""))
        i = j + 1
    return "".join(out)


@lru_cache(1)
def pretoken_pattern(pre_tokenize: Callable[[str], list] | None = None) -> str:
    """The GPT-2 pre-token pattern for the standard library's engine.

    Which code points are letters and numbers is asked of the library itself:
    a letter joins the letter before it, a number the digit after it.
    """
    import regex

    every = "".join(map(chr, (*range(0xD800), *range(0xE000, sys.maxunicode + 1))))
    points = regex.findall(r"[\p{L}\p{N}]", every)  # a newer Unicode than the library's: all that it may take for either
    letters, numbers = [], []
    for k in range(0, len(points), 512):
        some = points[k : k + 512]
        spans = {span for _, span in pre_tokenize("".join(f"a{c}1\n" for c in some))}
        letters += [ord(c) for i, c in enumerate(some) if (4 * i, 4 * i + 2) in spans]
        numbers += [ord(c) for i, c in enumerate(some) if (4 * i + 1, 4 * i + 3) in spans]
    letter, number = _ranges(letters), _ranges(numbers)
    return rf"'(?:[sdmt]|ll|ve|re)| ?[{letter}]+| ?[{number}]+| ?[^{_WHITE}{letter}{number}]+|[{_WHITE}]+(?![^{_WHITE}])|[{_WHITE}]+"


#: White space and stretches without it, as the pre-token pattern sets them apart: no pre-token crosses these.
STRETCH = rf" ?[^{_WHITE}]+|[{_WHITE}]+(?![^{_WHITE}])|[{_WHITE}]+"


def byte_characters() -> list[str]:
    """The printable stand-ins of byte-level BPE for the 256 bytes."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    extra = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(extra)) for b in range(256)]


def whole_tokens(tokenizer: Tokenizer, pattern: str) -> frozenset[str]:
    """Vocabulary strings proved to encode alone as one pre-token and one token."""
    back = {c: b for b, c in enumerate(byte_characters())}
    special = {t.content for t in tokenizer.get_added_tokens_decoder().values()}
    texts = []
    for token in tokenizer.get_vocab():
        if token not in special and all(c in back for c in token):
            try:
                texts.append(bytes(back[c] for c in token).decode())
            except UnicodeDecodeError:
                continue
    cut = re.compile(pattern)
    texts = [t for t in texts if (m := cut.match(t)) and m.end() == len(t)]
    return frozenset(t for t, e in zip(texts, tokenizer.encode_batch(texts, add_special_tokens=False), strict=True) if len(e.ids) == 1)


class Counts(dict):
    """Tokens of a stretch of text; proved whole tokens are there from the start.

    Another stretch is cut into pre-tokens when first met: each proved one
    counts one, and only the rest are merged.
    """

    def __init__(self, proved: frozenset[str], pattern: str, tokenizer: Tokenizer):
        super().__init__(dict.fromkeys(proved, 1))
        self.proved, self.merge, self.cut = proved, tokenizer.model.tokenize, re.compile(pattern).findall
        self.table = str.maketrans({chr(b): c for b, c in enumerate(byte_characters())})

    def __missing__(self, stretch: str) -> int:
        n = sum(1 if p in self.proved else len(self.merge(p.encode().decode("latin-1").translate(self.table))) for p in self.cut(stretch))
        if len(stretch) <= MAX_LENGTH_REMEMBERED:
            if len(self) > len(self.proved) + MAX_REMEMBERED:
                self.clear()
                self.update(dict.fromkeys(self.proved, 1))
            self[stretch] = n
        return n


_worker: dict[int, Counts] = {}


def remembered(proved: frozenset[str], pattern: str, model: str) -> Counts:
    """The counts of this Python worker, which serves one task after another."""
    key = hash((model, pattern))
    if key not in _worker:
        _worker.clear()
        _worker[key] = Counts(proved, pattern, Tokenizer.from_str(model))
    return _worker[key]


def token_counts(docs: DataFrame, tokenizer_file: str, limit: int) -> DataFrame:
    """Rows (doc_id, n_bytes, n_tokens, over_limit) of every document.

    Counts are those of the library without begin, end or added special
    tokens; the strings of special tokens inside a text count one token each,
    as is the library's default.  A null or empty text has no bytes and no
    tokens.  Repeated rows give repeated rows; other columns are left out.
    The vocabulary travels with the tasks: its size is fixed by the file.
    """
    tokenizer = Tokenizer.from_file(tokenizer_file)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    added = list(tokenizer.get_added_tokens_decoder().values())
    if any(t.lstrip or t.rstrip or t.single_word or t.normalized for t in added):
        raise ValueError("added tokens with stripping, word borders or normalisation are not supported")
    special = "|".join(re.escape(t.content) for t in sorted(added, key=lambda t: -len(t.content)))
    pattern = pretoken_pattern(tokenizer.pre_tokenizer.pre_tokenize_str)
    proved, model = whole_tokens(tokenizer, pattern), tokenizer.to_str()
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut, counts = re.compile(STRETCH).findall, remembered(proved, pattern, model)
        part_of, get = re.compile(special).split if special else None, counts.__getitem__
        for batch in batches:
            for part in tc.row_chunks(batch):
                texts = pc.fill_null(part.column("text"), "")
                tokens = []
                for text in texts:
                    text = text.as_py()
                    pieces = part_of(text) if part_of else [text]
                    tokens.append(len(pieces) - 1 + sum(sum(map(get, cut(p))) for p in pieces))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pc.binary_length(texts).cast(pa.int64()), pa.array(tokens, pa.int64())], names=["doc_id", "n_bytes", "n_tokens"])

    counted = docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
