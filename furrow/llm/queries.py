"""The contract queries of the training-data operators, and their DuckDB SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from furrow.llm import decontamination, learning, lm_score, mixing, near_dedup, quality_classifier, quality_rules, substring_dedup, token_count, toxicity, url_filter
from furrow.llm.storage import Scratch, doc_crc, table

Query = Callable[[SparkSession, str], DataFrame]

TOKEN_LIMIT = 512
URL_RULES = [
    url_filter.Rule("block", "net/", "host"),
    url_filter.Rule("allow", "example.net/en/", "host"),
    url_filter.Rule("block", "example.com/de/", "host"),
    url_filter.Rule("allow", "org/fr/", "host"),
    url_filter.Rule("block", "/ads/"),
    url_filter.Rule("block", "/login/"),
    url_filter.Rule("block", "?utm_source=*&utm_medium="),
    url_filter.Rule("block", "//casino."),
]


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row of documents: its words, how many a smaller id's window takes away, and the digest of the rest.  Nulls, repeats and empty tables: see ``substring_digest``."""
    return substring_dedup.substring_digest(table(spark, sf_dir, "documents"))


def op2_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row of documents with its group of near copies.  Nulls, shared ids, repeats and empty tables: see ``near_groups``."""
    return near_dedup.near_groups(table(spark, sf_dir, "documents"), n=3, percent=85)


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row of documents: the words that the mix of sources takes of it.  A null text has no words, a null source is one of its own; an empty table gives none."""
    return mixing.taken_words(mixing.mix_sources(table(spark, sf_dir, "documents")))


def _held_out(folds: int, fold: int) -> Column:
    return F.coalesce(doc_crc("doc_id") % folds == fold, F.lit(False))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row of documents with its score; a null id is in no fold that is held out.  Null and empty texts: see ``toxicity``."""
    docs = table(spark, sf_dir, "documents")
    sample = learning.labelled_sample(docs, table(spark, sf_dir, "labels"), "toxic", ~_held_out(3, 1))
    scored = toxicity.toxicity(docs, toxicity.fit(sample))
    return scored.select("doc_id", _held_out(3, 1).alias("held_out"), "score", "predicted", "patterns")


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row of documents with its bytes and tokens; a null text counts as empty, an empty table gives none."""
    import public_tokenizers

    return token_count.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), TOKEN_LIMIT)


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row of documents with its score; a null id is in no fold that is held out, a null text counts as empty."""
    docs = table(spark, sf_dir, "documents")
    chosen = learning.chosen_labels(table(spark, sf_dir, "labels"), "quality", ~_held_out(4, 2))
    features = Scratch(spark, "features").keep(quality_classifier.measured(docs, "doc_id"), "features")
    scored = quality_classifier.score(features, quality_classifier.fit_labelled(features, chosen))
    return scored.select("doc_id", _held_out(4, 2).alias("held_out"), "score", "predicted")


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row of documents with its counts and verdict; a null text has no words."""
    return quality_rules.quality_rules(table(spark, sf_dir, "documents"))


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row of pages with its verdict; a null url has an empty host and path and is judged by no rule."""
    return url_filter.url_filter(table(spark, sf_dir, "pages"), URL_RULES)


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best window of each document and benchmark item that match; null ids stay null, null and empty texts match nothing."""
    return decontamination.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row of documents with its base and model scores; a null text has the end token alone, a null id is in no fold and learnt from by neither."""
    import public_tokenizers

    docs = table(spark, sf_dir, "documents")
    scored = lm_score.lm_scores(docs, doc_crc("doc_id") % 10 != 0, public_tokenizers.path("piece_bpe_32k.model"))
    return scored.withColumn("held_out", _held_out(10, 0))


_LOW_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+')"
_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"


def _op1_sql() -> str:
    n = substring_dedup.WINDOW
    return rf"""
WITH docs AS (SELECT doc_id, {_WORDS} AS ws FROM documents),
words AS (SELECT doc_id, unnest(range(len(ws))) AS i, unnest(ws) AS w FROM docs),
wins AS (SELECT doc_id, unnest(range(len(ws) - {n - 1})) AS i, ws FROM docs WHERE len(ws) >= {n}),
named AS (SELECT doc_id, i, md5(array_to_string(ws[i + 1 : i + {n}], ' ')) AS g FROM wins),
later AS (SELECT doc_id, i FROM named QUALIFY doc_id > min(doc_id) OVER (PARTITION BY g)),
steps AS (SELECT doc_id, i AS pos, 1 AS d FROM later UNION ALL SELECT doc_id, i + {n}, -1 FROM later),
borders AS (SELECT doc_id, pos, sum(d) AS d FROM steps GROUP BY ALL),
runs AS (SELECT doc_id, pos, lead(pos) OVER w AS upto, sum(d) OVER w AS depth FROM borders WINDOW w AS (PARTITION BY doc_id ORDER BY pos)),
gone AS (SELECT doc_id, unnest(range(pos, upto)) AS i FROM runs WHERE depth > 0),
kept AS (SELECT doc_id, string_agg(w, ' ' ORDER BY i) AS t, count(*) AS n FROM words ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
SELECT doc_id, len(ws)::BIGINT AS n_words, (len(ws) - coalesce(k.n, 0))::BIGINT AS n_removed, sha256(coalesce(k.t, '')) AS kept_sha256
FROM docs LEFT JOIN kept k USING (doc_id)
"""


def _op2_sql() -> str:
    return rf"""
WITH RECURSIVE docs AS (SELECT doc_id, {_LOW_WORDS} AS ws FROM documents),
shingles AS (SELECT DISTINCT doc_id, CASE WHEN len(ws) < 3 THEN array_to_string(ws, ' ') ELSE array_to_string(ws[i : i + 2], ' ') END AS s FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 1, least(len(ws), 1) + 1))) AS i FROM docs)),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM shared JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * shared.n >= 85 * (x.n + y.n - shared.n)),
ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT doc_id, doc_id AS node FROM docs UNION SELECT r.doc_id, ways.b FROM reach r JOIN ways ON ways.a = r.node),
least AS (SELECT doc_id, min(node) AS component_id FROM reach GROUP BY doc_id)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id, doc_id = component_id AS kept FROM docs JOIN least USING (doc_id) LEFT JOIN sizes USING (doc_id)
"""


def _op7_sql() -> str:
    grams = ", ".join(map(str, (3, *quality_rules.MAX_GRAM_PERCENT)))
    bad = " OR ".join(f"100 * dup_chars_{n} > {most} * word_chars" for n, most in quality_rules.MAX_GRAM_PERCENT.items())
    return rf"""
WITH docs AS (SELECT doc_id, text, {_WORDS} AS ws FROM documents),
words AS (SELECT doc_id, unnest(range(len(ws))) AS i, unnest(ws) AS w FROM docs),
wins AS (SELECT doc_id, n, unnest(range(len(ws) - n + 1)) AS i, ws FROM docs, (SELECT unnest([{grams}]) AS n) WHERE len(ws) >= n),
named AS (SELECT doc_id, n, i, array_to_string(ws[i + 1 : i + n], ' ') AS g FROM wins),
hit AS (SELECT doc_id, n, i FROM named QUALIFY count(*) OVER (PARTITION BY doc_id, n, g) > 1),
steps AS (SELECT doc_id, n, i AS pos, 1 AS d FROM hit UNION ALL SELECT doc_id, n, i + n, -1 FROM hit),
borders AS (SELECT doc_id, n, pos, sum(d) AS d FROM steps GROUP BY ALL),
runs AS (SELECT doc_id, n, pos, lead(pos) OVER w AS upto, sum(d) OVER w AS depth FROM borders WINDOW w AS (PARTITION BY doc_id, n ORDER BY pos)),
cover AS (SELECT r.doc_id, r.n, count(*) AS n_words, sum(length(x.w)) AS n_chars FROM runs r JOIN words x ON x.doc_id = r.doc_id AND x.i >= r.pos AND x.i < r.upto WHERE r.depth > 0 GROUP BY ALL),
lines AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS l, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS k FROM docs),
later AS (SELECT doc_id, l FROM lines WHERE regexp_matches(l, '[^\x20\x09-\x0D]') QUALIFY row_number() OVER (PARTITION BY doc_id, l ORDER BY k) > 1),
dup_lines AS (SELECT doc_id, count(*) AS n, sum(length(regexp_replace(l, '[\x20\x09-\x0D]', '', 'g'))) AS chars FROM later GROUP BY doc_id),
counts AS (SELECT doc_id, len(ws)::BIGINT AS n_words,
  coalesce(length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')), 0)::BIGINT AS word_chars,
  coalesce(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')), 0)::BIGINT AS n_symbols,
  coalesce(d.n, 0)::BIGINT AS n_dup_lines, coalesce(c3.n_words, 0)::BIGINT AS n_repeat_words, coalesce(d.chars, 0)::BIGINT AS dup_line_chars,
  {", ".join(f"coalesce(c{n}.n_chars, 0)::BIGINT AS dup_chars_{n}" for n in quality_rules.MAX_GRAM_PERCENT)}
  FROM docs LEFT JOIN dup_lines d USING (doc_id) LEFT JOIN (FROM cover WHERE n = 3) c3 USING (doc_id)
  {" ".join(f"LEFT JOIN (FROM cover WHERE n = {n}) c{n} USING (doc_id)" for n in quality_rules.MAX_GRAM_PERCENT)}),
based AS (SELECT *, n_words < {quality_rules.MIN_WORDS} OR 100 * n_repeat_words > {quality_rules.MAX_REPEAT_PERCENT} * n_words AS base_failed FROM counts)
SELECT *, NOT (base_failed OR 100 * dup_line_chars > {quality_rules.MAX_LINE_PERCENT} * word_chars OR {bad}) AS kept FROM based
"""


def _op8_sql() -> str:
    hosts = [r for r in URL_RULES if r.kind == "host"]
    rules = ", ".join(f"('{r.text}', '{r.text.partition('/')[0]}', '/{r.text.partition('/')[2]}', '{r.action}')" for r in hosts)
    patterns = ", ".join(f"('{r.text}', '{r.regex()}', '{r.action}')" for r in URL_RULES if r.kind != "host")
    return rf"""
WITH low AS (SELECT page_id, coalesce(url, '') AS url, translate(coalesce(url, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS low FROM pages),
parts AS (SELECT page_id, low, translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path FROM low),
rules(rule, h, p, action) AS (VALUES {rules}),
patterns(pattern, regex, action) AS (VALUES {patterns}),
judged AS (SELECT page_id, host, path,
  (SELECT arg_max(struct_pack(r := rule, a := action), length(rule)) FROM rules WHERE (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)) AS by_host,
  (SELECT first(struct_pack(r := pattern, a := action) ORDER BY length(pattern) DESC, pattern) FROM patterns WHERE regexp_matches(low, regex)) AS by_pattern FROM parts)
SELECT page_id, host, path, by_host.r AS rule, coalesce(by_host.a, by_pattern.a, 'allow') AS verdict, CASE WHEN by_host IS NULL THEN by_pattern.r END AS pattern FROM judged
"""


def _op9_sql() -> str:
    words = _LOW_WORDS
    n = decontamination.SHINGLE
    return rf"""
WITH docs AS (SELECT doc_id, {words} AS ws FROM documents),
items AS (SELECT item_id, {words} AS it, len(it) AS size, least({n}, len(it)) AS m FROM benchmark WHERE len(it) > 0),
item_s AS (SELECT item_id, size, m, i, array_to_string(it[i : i + m - 1], ' ') AS s FROM (SELECT *, unnest(range(1, size - m + 2)) AS i FROM items)),
doc_s AS (SELECT doc_id, len(ws) AS n, m, i, array_to_string(ws[i : i + m - 1], ' ') AS s FROM (SELECT doc_id, ws, m, unnest(range(1, len(ws) - m + 2)) AS i FROM docs, (SELECT DISTINCT m FROM items) WHERE len(ws) >= m)),
places AS (SELECT DISTINCT doc_id, item_id, greatest(0, least(d.i - x.i, n - size)) AS start FROM doc_s d JOIN item_s x USING (m, s)),
wins AS (SELECT p.*, i.m, ws[start + 1 : start + i.size] AS win FROM places p JOIN docs USING (doc_id) JOIN items i USING (item_id)),
win_s AS (SELECT DISTINCT doc_id, item_id, start, array_to_string(win[k : k + m - 1], ' ') AS s FROM (SELECT *, unnest(range(1, len(win) - m + 2)) AS k FROM wins)),
item_d AS (SELECT DISTINCT item_id, s FROM item_s),
item_w AS (SELECT item_id, sum(length(s)) AS w FROM item_d GROUP BY item_id),
win_w AS (SELECT doc_id, item_id, start, sum(length(s)) AS w, sum(CASE WHEN d.s IS NOT NULL THEN length(win_s.s) ELSE 0 END) AS shared FROM win_s LEFT JOIN item_d d USING (item_id, s) GROUP BY ALL),
match AS (SELECT doc_id, item_id, start, shared::BIGINT AS shared, (win_w.w + i.w - shared)::BIGINT AS total FROM win_w JOIN item_w i USING (item_id) WHERE 100 * shared >= {decontamination.PERCENT} * (win_w.w + i.w - shared)),
best AS (SELECT * FROM match QUALIFY row_number() OVER (PARTITION BY doc_id, item_id ORDER BY shared / total DESC, start) = 1)
SELECT doc_id, item_id, best.start::INTEGER AS start, len(win)::INTEGER AS n_words, best.shared / best.total AS similarity FROM best JOIN wins USING (doc_id, item_id, start)
"""


QUERIES: dict[str, Query] = {
    "op1_substring_dedup": op1_substring_dedup,
    "op2_near_dedup": op2_near_dedup,
    "op3_mixing": op3_mixing,
    "op4_toxicity": op4_toxicity,
    "op5_token_counts": op5_token_counts,
    "op6_quality_classifier": op6_quality_classifier,
    "op7_quality_rules": op7_quality_rules,
    "op8_url_filter": op8_url_filter,
    "op9_decontamination": op9_decontamination,
    "op10_lm_score": op10_lm_score,
}
ORACLES: dict[str, str] = {"op1_substring_dedup": _op1_sql(), "op2_near_dedup": _op2_sql(), "op7_quality_rules": _op7_sql(), "op8_url_filter": _op8_sql(), "op9_decontamination": _op9_sql()}
