"""URL filters: pattern rules indexed by their rarest literal token.

A rule is a host-and-path prefix (``net/``: the host and all its subdomains) or
a pattern with ``*`` wildcards that is looked for anywhere in the URL.  Each rule is indexed
under the one of its literal tokens that the fewest URLs hold; the tokens of a
URL fetch candidate rules, and only those run their regular expression.  Rules
without a whole literal token are candidates for every URL.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_LITERAL = "[a-z0-9]+"


@dataclass(frozen=True)
class Rule:
    """``kind`` host: text is host and path prefix; ``kind`` pattern: text with ``*`` wildcards."""

    action: str
    text: str
    kind: str = "pattern"

    def regex(self) -> str:
        """For hosts over ``host`` + ``path``; for patterns over the URL in lower case."""
        if self.kind == "host":
            host, slash, path = self.text.partition("/")
            return rf"^(?:[^/?#]*\.)?{re.escape(host.translate(_FOLD))}{re.escape(slash + path)}"
        return ".*".join(re.escape(x) for x in self.text.translate(_FOLD).split("*"))

    def tokens(self) -> list[str]:
        """Literal tokens that every fitting URL holds as whole tokens."""
        text, inside = self.text.translate(_FOLD), lambda c: c not in ("", "*")
        # A host rule starts at a label's border; elsewhere an open end may continue a longer token.
        whole = [m[0] for m in re.finditer(_LITERAL, text) if (inside(text[max(0, m.start() - 1) : m.start()]) or self.kind == "host" and not m.start()) and inside(text[m.end() : m.end() + 1])]
        return sorted(set(whole))


_FOLD = str.maketrans(_UPPER, _LOWER)


def url_host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; null or without it: empty."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), _UPPER, _LOWER)


def url_path(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def token_frequency(pages: DataFrame, tokens: list[str]) -> dict[str, int]:
    """In how many URLs each of the given tokens stands; the result has one row a token at most."""
    if not tokens:
        return {}
    low = F.translate(F.coalesce(F.col("url"), F.lit("")), _UPPER, _LOWER)
    held = F.array_intersect(F.regexp_extract_all(low, F.lit(f"({_LITERAL})"), F.lit(1)), F.array(*map(F.lit, tokens)))
    return {r["t"]: r["count"] for r in pages.select(F.explode(held).alias("t")).groupBy("t").count().collect()}


class RuleIndex:
    """Candidate rules by token, in order of precedence: longest first, then by text."""

    def __init__(self, rules: list[Rule], frequency: dict[str, int]):
        self.by_token: dict[str, list[Rule]] = {}
        self.untokened: list[Rule] = []
        for r in rules:
            tokens = r.tokens()
            if tokens:
                self.by_token.setdefault(min(tokens, key=lambda t: (frequency.get(t, 0), t)), []).append(r)
            else:
                self.untokened.append(r)
        self.compiled = {r: re.compile(r.regex(), re.S) for r in rules}

    def best(self, low: str, place: str) -> tuple[Rule | None, Rule | None]:
        """The winning host rule over ``place`` (host + path) and the winning pattern rule over the URL."""
        rules = [*self.untokened, *(r for t in set(re.findall(_LITERAL, f"{low} {place.translate(_FOLD)}")) for r in self.by_token.get(t, ()))]
        fits = {k: [r for r in rules if r.kind == k and self.compiled[r].search(place if k == "host" else low)] for k in ("host", "pattern")}
        host, pattern = (min(fits[k], key=lambda r: (-len(r.text), r.text), default=None) for k in ("host", "pattern"))
        return host, pattern


def url_filter(pages: DataFrame, rules: list[Rule], default: str = "allow") -> DataFrame:
    """Rows (page_id, host, path, rule, verdict, pattern) of every page.

    A fitting host rule decides, the longest first; ``rule`` names it.  Where
    none fits, ``verdict`` is that of the longest fitting pattern rule, named
    in ``pattern``, or the default.  Ties in length fall to the smaller text.
    A null or empty URL, or one without ``://``, has an empty host and path
    and fits no host rule; patterns still run over it.  Repeated pages give
    repeated rows; other columns are left out.  No rules: every page gets the
    default.  Rules are configuration that the driver already holds; each
    Python worker compiles them once.
    """
    frequency = token_frequency(pages, sorted({t for r in rules for t in r.tokens()}))
    url = F.coalesce(F.col("url"), F.lit(""))
    given = pages.select("page_id", url_host(F.col("url")).alias("host"), url_path(F.col("url")).alias("path"), F.translate(url, _UPPER, _LOWER).alias("low"))
    kind = given.schema["page_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = RuleIndex(rules, frequency)
        for batch in batches:
            page, host, path, low = batch.columns
            rule, verdict, pattern = [], [], []
            for h, p, u in zip(host.to_pylist(), path.to_pylist(), low.to_pylist(), strict=True):
                by_host, by_pattern = index.best(u, h + p)
                rule.append(by_host.text if by_host else None)
                pattern.append(by_pattern.text if by_pattern and not by_host else None)
                verdict.append((by_host or by_pattern).action if by_host or by_pattern else default)
            yield pa.RecordBatch.from_arrays([page, host, path, *(pa.array(x, pa.string()) for x in (rule, verdict, pattern))], names=["page_id", "host", "path", "rule", "verdict", "pattern"])

    return given.mapInArrow(run, f"page_id {kind}, host string, path string, rule string, verdict string, pattern string")
