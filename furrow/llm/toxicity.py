"""Toxicity by a weighted finite-state pattern grammar.

Words become symbols: insult, threat, target, object, negation, reported speech,
plain.  Two composed transducers read each clause that holds an insult or a
threat, one from its front and one from its back.  At every hit their states
say what stands before and after it, and the insult's or the threat's own
machine turns them into a pattern, for example a targeted insult that is not
negated.  Patterns are weighted, and the clause takes its heaviest, marked if
it holds several hits as much negated and reported as that one.  A document's score is the logistic function of the weighted counts of its
matched clauses.  Which words insult is learnt from labelled rows, as whole
words and as word beginnings, and so are the final weights.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from furrow.llm import learning
from furrow.llm import textcore as tc

PLAIN, INSULT, THREAT, TARGET, OBJECT, NEGATION, REPORT = range(7)
N_SYMBOLS = 7
#: Closed word classes in English, German, French and Spanish.
WORDS = {
    THREAT: "kill hurt destroy beat murder strangle stab shoot töten vernichten verprügeln tuer frapper détruire matar golpear destruir",
    TARGET: "you your you're they their he his she her du dein ihr tu toi vous votre usted ustedes vosotros",
    OBJECT: "them him dich euch te",
    NEGATION: "not never no isn't aren't don't won't nicht nie kein keine ne pas jamais nunca jamás tampoco",
    REPORT: "said says wrote quoted called reported claimed sagte schrieb zitierte dit disait écrit dijo escribió citó",
}
#: How many words a negation reaches forwards, and a target either way unless a word of reported speech stands between.
REACH = {NEGATION: 3, TARGET: 6}
PREFIX_BYTES = (4, 5, 6, 7, 8)
#: A learnt word is in this many toxic sample rows at least, and this share of the rows that hold it is toxic.
MIN_ROWS, MIN_PURITY = 3, 0.9
THRESHOLD = 0.7
#: (several such hits in the clause?, threat?, negated?, reported?, targeted?)
PATTERNS = list(product((False, True), repeat=5))

_LETTER = np.zeros(256, bool)
_LETTER[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
_STOP = np.zeros(256, bool)
_STOP[list(b".!?;:")] = True


class Transducer:
    """A deterministic machine over symbols: ``delta[state, symbol]``; each state carries an output."""

    def __init__(self, delta: np.ndarray, outputs: list[tuple[int, ...]]):
        self.delta, self.outputs = delta, outputs

    @staticmethod
    def within(symbols: tuple[int, ...], reach: int, stop: int | None = None) -> Transducer:
        """Its state says how many further words the symbols reach, 0 after ``stop``; its output, whether they reach any."""
        delta = np.tile(np.maximum(np.arange(reach + 1) - 1, 0)[:, None], (1, N_SYMBOLS))
        delta[:, symbols] = reach
        if stop is not None:
            delta[:, stop] = 0
        return Transducer(delta, [(int(left > 0),) for left in range(reach + 1)])

    @staticmethod
    def since(symbol: int) -> Transducer:
        """1 from a symbol on to the clause's end."""
        delta = np.array([[0] * N_SYMBOLS, [1] * N_SYMBOLS])
        delta[0, symbol] = 1
        return Transducer(delta, [(0,), (1,)])

    def compose(self, other: Transducer) -> Transducer:
        """The product machine; a state is ``mine * other's states + other's``, its output both outputs."""
        n = len(other.delta)
        delta = (self.delta[:, None, :] * n + other.delta[None, :, :]).reshape(-1, N_SYMBOLS)
        return Transducer(delta, [a + b for a in self.outputs for b in other.outputs])


@dataclass
class Grammar:
    """The machines that read a clause from its front and from its back, and for each hit the pattern of a pair of states."""

    front: list[list[int]]
    back: list[list[int]]
    patterns: dict[int, np.ndarray]


def insult_pattern(negated: int, reported: int, subject: int, object_: int, reported_after: int, target_after: int) -> int:
    """An insult meets its target on either side."""
    return 4 * negated + 2 * (reported | reported_after) + (subject | object_ | target_after)


def threat_pattern(negated: int, reported: int, subject: int, object_: int, reported_after: int, target_after: int) -> int:
    """Who threatens stands before the verb: there only an object is a target, after it each target."""
    return 8 + 4 * negated + 2 * (reported | reported_after) + (object_ | target_after)


def grammar() -> Grammar:
    near = lambda *symbols: Transducer.within(symbols, REACH[TARGET], REPORT)
    front = Transducer.within((NEGATION,), REACH[NEGATION]).compose(Transducer.since(REPORT)).compose(near(TARGET)).compose(near(OBJECT))
    back = Transducer.since(REPORT).compose(near(TARGET, OBJECT))
    machines = {INSULT: insult_pattern, THREAT: threat_pattern}
    patterns = {s: np.array([[machine(*a, *b) for b in back.outputs] for a in front.outputs]) for s, machine in machines.items()}
    return Grammar(front.delta.tolist(), back.delta.tolist(), patterns)


def read_clause(symbols: list[int], machines: Grammar) -> list[int]:
    """The pattern of each insult and threat of a clause, in order."""
    state, before = 0, []
    for s in symbols:
        before.append(state)
        state = machines.front[state][s]
    state, found = 0, []
    for s, was in zip(reversed(symbols), reversed(before), strict=True):
        if s in machines.patterns:
            found.append(int(machines.patterns[s][was, state]))
        state = machines.back[state][s]
    return found[::-1]


@dataclass
class Model:
    """Learnt words and beginnings by hash, and pattern weights; ``bias`` last."""

    words: np.ndarray = field(default_factory=lambda: np.empty(0, np.uint64))
    weights: np.ndarray = field(default_factory=lambda: prior())


def prior() -> np.ndarray:
    """Weights before learning: negated and reported patterns say little, several hits more than one."""
    w = [0.5 if negated or reported else 3.0 + targeted + 2 * several for several, _, negated, reported, targeted in PATTERNS]
    return np.array([*w, -3.0])


def _keys(w: tc.Words) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """Hashes of the words in lower case without punctuation at their ends, and (word, hash) of their beginnings."""
    n = len(w.data)
    at = np.arange(n)
    letter = _LETTER[w.data]
    nxt = np.minimum.accumulate(np.where(letter, at, n)[::-1])[::-1] if n else at
    prv = np.maximum.accumulate(np.where(letter, at, -1)) if n else at
    a, b = nxt[w.starts], prv[w.ends - 1] + 1
    b = np.maximum(a, b)
    a = np.where(b > w.ends, w.ends, a)
    b = np.minimum(np.maximum(a, b), w.ends)
    whole = tc.span_hashes(w.data, a, b)
    begins = []
    for k in PREFIX_BYTES:
        long = np.flatnonzero(b - a > k)
        begins.append((long, tc.span_hashes(w.data, a[long], a[long] + k) ^ np.uint64(k)))
    return whole, begins


def _fixed() -> tuple[np.ndarray, np.ndarray]:
    texts, symbols = zip(*((word, s) for s, words in WORDS.items() for word in words.split()), strict=True)
    keys = _keys(tc.Words(pa.array(texts), lower=True))[0]
    order = np.argsort(keys)
    return keys[order], np.array(symbols)[order]


def word_rows(sample: DataFrame) -> DataFrame:
    """Rows (key, label, n): in how many sample texts of each label a word or beginning stands."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in tc.row_chunks(batch):
                w = tc.Words(part.column("text"), lower=True)
                whole, begins = _keys(w)
                key = np.concatenate([whole, *(h for _, h in begins)])
                doc = np.concatenate([w.doc, *(w.doc[i] for i, _ in begins)])
                pairs = np.unique(np.stack([key, doc.astype(np.uint64)]), axis=1) if len(key) else np.empty((2, 0), np.uint64)
                label = part.column("label").to_numpy()[pairs[1].astype(np.int64)]
                both, n = np.unique(np.stack([pairs[0], label.astype(np.uint64)]), axis=1, return_counts=True) if len(label) else (np.empty((2, 0), np.uint64), np.empty(0, np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(both[0].view(np.int64)), pa.array(both[1].astype(np.int32)), pa.array(n)], names=["key", "label", "n"])

    return sample.mapInArrow(run, "key long, label int, n long")


def pattern_counts(docs: DataFrame, words: np.ndarray, keep: tuple[str, ...]) -> DataFrame:
    """The kept columns and ``patterns``: how many clauses of the whole text have each pattern as their heaviest."""
    given = docs.select(*keep, "text")
    schema = ", ".join([*(f"{f.name} {f.dataType.simpleString()}" for f in given.schema.fields[:-1]), "patterns array<int>"])
    insults = np.sort(words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machines = grammar()
        fixed = _fixed()
        for batch in batches:
            for part in tc.row_chunks(batch):
                counts = _patterns(tc.Words(part.column("text"), lower=True), insults, fixed, machines)
                flat = pa.FixedSizeListArray.from_arrays(pa.array(counts.ravel(), pa.int32()), len(PATTERNS)).cast(pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], flat], names=[*part.schema.names[:-1], "patterns"])

    return given.mapInArrow(run, schema)


def _member(keys: np.ndarray, among: np.ndarray) -> np.ndarray:
    if not len(among):
        return np.zeros(len(keys), bool)
    return among[np.minimum(np.searchsorted(among, keys), len(among) - 1)] == keys


def _patterns(w: tc.Words, insults: np.ndarray, fixed: tuple[np.ndarray, np.ndarray], machines: Grammar) -> np.ndarray:
    whole, begins = _keys(w)
    symbol = np.full(len(whole), PLAIN)
    known = _member(whole, fixed[0])
    symbol[known] = fixed[1][np.searchsorted(fixed[0], whole[known])]
    symbol[_member(whole, insults)] = INSULT
    for at, key in begins:
        symbol[at[_member(key, insults)]] = INSULT
    counts = np.zeros((w.n_docs, len(PATTERNS)), np.int32)
    hits = np.flatnonzero((symbol == INSULT) | (symbol == THREAT))
    if not len(hits):
        return counts
    # A clause ends at a word with a closing mark, at a line's end and at the document's.
    breaks = np.concatenate(([0], np.cumsum(w.data == 0x0A)))
    last = len(whole) - 1
    gap = np.append(breaks[w.starts[1:]] > breaks[w.ends[:-1]], True) | _STOP[w.data[w.ends - 1]] | (w.left == 1)
    clause = np.concatenate(([0], np.cumsum(gap)[:-1]))
    begin = np.flatnonzero(np.diff(clause, prepend=-1))
    weight = prior()
    for c in np.unique(clause[hits]):
        a, b = begin[c], begin[c + 1] if c + 1 < len(begin) else last + 1
        found = read_clause(symbol[a:b].tolist(), machines)
        counts[w.doc[a], clause_pattern(found, weight)] += 1
    return counts


def clause_pattern(found: list[int], weight: np.ndarray) -> int:
    """The heaviest pattern of a clause's hits, the last of equal ones, and 16 more if several hits are negated and reported alike."""
    best = max(found, key=lambda p: (weight[p], p))
    return best + 16 * (sum(p & 6 == best & 6 for p in found) > 1)


def features(patterns: np.ndarray) -> np.ndarray:
    return np.hstack([np.log2(1.0 + patterns), np.ones((len(patterns), 1))])


def fit(sample: DataFrame) -> Model:
    """Learns words and weights from rows (doc_id, label, text); without rows of both labels, no words are learnt.

    The sample bounds the lexicon that is sent to every task.
    """
    per_key = word_rows(sample).groupBy("key").agg(F.sum(F.when(F.col("label") == 1, F.col("n")).otherwise(0)).alias("bad"), F.sum("n").alias("n"))
    per_key = per_key.filter((F.col("bad") >= MIN_ROWS) & (F.col("bad") >= MIN_PURITY * F.col("n")))
    words = np.sort(np.array([r["key"] for r in per_key.select("key").collect()], np.int64).view(np.uint64))
    found = pattern_counts(sample, words, ("label",)).toPandas()
    if found["label"].nunique() < 2:
        return Model(words if found["label"].eq(1).any() else np.empty(0, np.uint64))
    x = features(np.stack(found["patterns"].to_numpy()))
    return Model(words, learning.fit_logistic(x, found["label"].to_numpy(float), penalty=0.5, prior=prior()))


def toxicity(docs: DataFrame, model: Model) -> DataFrame:
    """Rows (doc_id, score, predicted, patterns) of every document.

    A null or empty text has no pattern and the score of none.  Repeated rows
    give repeated rows; other columns are left out.
    """
    found = pattern_counts(docs, model.words, ("doc_id",))
    z = F.lit(float(model.weights[-1]))
    for i, weight in enumerate(model.weights[:-1]):
        z = z + F.lit(float(weight)) * F.log2(1.0 + F.col("patterns")[i])
    score = 1.0 / (1.0 + F.exp(-z))
    return found.withColumn("score", score).withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
