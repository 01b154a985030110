"""The training-data operators against brute force on small fixtures, with nulls, ties, repeats and empty tables."""

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from furrow.llm import components, decontamination, learning, lm_score, mixing, near_dedup, quality_classifier, quality_rules, queries, substring_dedup, token_count, toxicity, url_filter
from furrow.llm import textcore as tc
from furrow.llm.lattice import Lattice, Pieces
from furrow.llm.storage import Scratch

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n_words string"
SYLLABLES = "th er an in on re he nt ed ea st ti é ü or es".split()


def words(rng, n):
    return ["".join(rng.choices(SYLLABLES, k=rng.randint(1, 4))) for _ in range(n)]


def corpus(seed=1):
    """Copies, near copies, shared passages, nulls, empty, odd white space, one long text, and a clashing column."""
    rng = random.Random(seed)
    texts = [None, "", " \t\n", "one", "one two", "Two  TWO\u00a0x"]
    base = words(rng, 130)
    passage = words(rng, 60)
    texts += [" ".join(base), " ".join(base), "\n".join(base)]
    for k in (1, 3, 9):
        near = list(base)
        for i in rng.sample(range(130), k):
            near[i] = "zz" + near[i]
        texts.append(" ".join(near))
    for _ in range(4):
        texts.append(" ".join([*words(rng, rng.randint(5, 80)), *passage, *words(rng, rng.randint(0, 40))]))
    texts += [" ".join(words(rng, rng.randint(1, 90))) for _ in range(12)] + ["a " * 300, " ".join(words(rng, 3000))]
    return [(i * 3, t, "en", None if i % 5 == 0 else f"s{i % 3}", len(t or ""), "clash") for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def rows(df):
    return {r["doc_id"]: r for r in df.collect()}


def without_repeats(texts):
    """The words of each text that no window of 50, also starting in a text of a smaller id, covers."""
    first, kept = {}, {}
    for d in sorted(texts):
        for i in range(len(texts[d]) - 49):
            first.setdefault(tuple(texts[d][i : i + 50]), d)
    for d, w in texts.items():
        gone = set()
        for i in range(len(w) - 49):
            if first[tuple(w[i : i + 50])] < d:
                gone |= set(range(i, i + 50))
        kept[d] = [x for i, x in enumerate(w) if i not in gone]
    return kept


def test_substring_dedup(docs, empty):
    got = rows(substring_dedup.substring_digest(docs))
    texts = {d: WORD.findall(t or "") for d, t, *_ in corpus()}
    for d, kept in without_repeats(texts).items():
        digest = hashlib.sha256(" ".join(kept).encode()).hexdigest()
        assert (got[d]["n_words"], got[d]["n_removed"], got[d]["kept_sha256"]) == (len(texts[d]), len(texts[d]) - len(kept), digest)
    assert any(r["n_removed"] for r in got.values())
    left = substring_dedup.substring_dedup(docs)
    assert left.columns == docs.columns
    assert all(r["n_chars"] == len(r["text"] or "") for r in left.collect())
    assert substring_dedup.substring_digest(empty).count() == 0


def test_substring_sketch_of_any_width_loses_no_window(spark, docs, monkeypatch):
    monkeypatch.setattr(substring_dedup, "SKETCH_ANCHORS", 50)  # several sketches a partition
    runs = lambda width: sorted(map(tuple, substring_dedup.repeated_runs(docs, Scratch(spark, "test"), width=width).collect()))
    want = runs(None)
    assert want and all(runs(width) == want for width in (1, 7, 512))


def test_copies_of_a_stretch_add_no_windows(spark, monkeypatch):
    rng = random.Random(4)
    text = words(rng, 200)
    texts = {i: list(text) for i in range(2, 22)} | {1: [*words(rng, 30), *text[40:150], *words(rng, 30)]}
    counts, keep = {}, Scratch.keep

    def counted(self, df, name):
        kept = keep(self, df, name)
        counts[name] = kept.count()
        return kept

    monkeypatch.setattr(Scratch, "keep", counted)
    table = spark.createDataFrame([(d, " ".join(w)) for d, w in texts.items()], "doc_id long, text string").repartition(3)
    got = rows(substring_dedup.substring_digest(table))
    assert {d: r["n_words"] - r["n_removed"] for d, r in got.items()} == {d: len(w) for d, w in without_repeats(texts).items()}
    assert 0 < counts["windows"] <= 151 + 121


def test_stretches_equal_trying_every_window(spark):
    """Few words, so that one anchor serves long stretches; rows that share an id; more text than a chunk takes."""
    rng = random.Random(6)
    base = [rng.choices("ab" if i % 3 else "abcdefgh", k=rng.randint(3, 120)) for i in range(40)]
    made = [(i // 2, [*rng.choice(base)[: rng.randint(0, 90)], *rng.choice(base), *["a"] * rng.choice([0, 0, 30])]) for i in range(160)]
    made += [(200 + i, [f"{x}{'z' * 3000}" for x in rng.choice(base)]) for i in range(20)]
    table = spark.createDataFrame([(d, " ".join(w)) for d, w in made], "doc_id long, text string").coalesce(1)
    window = 9
    first = {}
    for d, w in made:
        for i in range(len(w) - window + 1):
            first[tuple(w[i : i + window])] = min(d, first.get(tuple(w[i : i + window]), d))
    want = []
    for d, w in made:
        gone = {j for i in range(len(w) - window + 1) if first[tuple(w[i : i + window])] < d for j in range(i, i + window)}
        want.append((d, len(w), hashlib.sha256(" ".join(x for i, x in enumerate(w) if i not in gone).encode()).hexdigest()))
    runs = substring_dedup.repeated_runs(table, Scratch(spark, "test"), window, 3)
    got = substring_dedup.cut(table, runs, digest=True).select("doc_id", "n_words", "kept").collect()
    assert sorted(map(tuple, got)) == sorted(want)


@pytest.mark.parametrize("width", [3, 1 << 12])
def test_merged_sketch_equals_counting_every_cell(spark, width):
    rows = spark.range(400).select((F.col("id") % 150).alias("anchor")).repartition(5)
    got = sorted(map(tuple, substring_dedup.sketch(rows, 2, width).collect()))
    cells = [F.struct(F.lit(r).alias("row"), substring_dedup._cell(r, width).alias("cell")) for r in (0, 1)]
    count = rows.select(F.inline(F.array(*cells))).groupBy("row", "cell").count().filter("count > 1").collect()
    assert got == sorted((r["row"], r["cell"], min(r["count"], 255)) for r in count)


def groups(texts, n, percent):
    sets = {}
    for d, t in texts.items():
        w = WORD.findall((t or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))
        sets[d] = {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} or ({tuple(w)} if w else set())
    root = {d: d for d in texts}
    for a, b in itertools.combinations(sorted(texts), 2):
        both = len(sets[a] & sets[b])
        if sets[a] and sets[b] and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
            old, new = sorted((root[a], root[b]), reverse=True)
            root = {d: new if r == old else r for d, r in root.items()}
    return sets, root


@pytest.mark.parametrize(("n", "percent"), [(3, 85), (5, 80)])
def test_near_groups(docs, n, percent):
    got = rows(near_dedup.near_groups(docs, n, percent))
    sets, root = groups({d: t for d, t, *_ in corpus()}, n, percent)
    assert {d: (r["n_shingles"], r["component_id"], r["kept"]) for d, r in got.items()} == {d: (len(sets[d]), root[d], d == root[d]) for d in sets}


def test_near_groups_of_many_variants(spark):
    """A large group of near copies, few of which are linked with the smallest id."""
    rng = random.Random(4)
    base, texts = words(rng, 150), {}
    for d in range(160):
        w = list(base)
        for i in rng.sample(range(150), rng.randint(0, 6)):
            w[i] = f"x{d}y{i}"
        texts[d] = " ".join(w)
    _, root = groups(texts, 3, 85)
    got = rows(near_dedup.near_groups(spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(4), 3, 85))
    assert {d: r["component_id"] for d, r in got.items()} == root and len(set(root.values())) > 1


def test_near_groups_link_a_cut_copy_whose_lists_have_other_centres(spark):
    """A cut copy of 130 shingles and its source of 152 meet only in lists whose centre is a third document."""
    texts, common = {}, [[f"o{i}z{j}" for i in range(84)] for j in range(2)]
    for f in range(10):
        whole = [f"w{f}x{i}" for i in range(154)]
        for d, w in enumerate((whole, whole[:132], whole[:68] + common[0], whole[66:132] + common[1])):
            texts[4 * f + d] = " ".join(w)
    _, root = groups(texts, 3, 85)
    got = rows(near_dedup.near_groups(spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(4), 3, 85))
    assert {d: r["component_id"] for d, r in got.items()} == root
    assert all(root[4 * f + 1] == 4 * f for f in range(10))


def test_near_groups_with_null_shared_and_repeated_ids(spark):
    """Rows that share an id are documents of their own; one of each group stays."""
    rng = random.Random(6)
    a, b, c = (" ".join(words(rng, 150)) for _ in range(3))
    near = c + " more"
    data = [(1, a, 0), (None, a, 1), (None, b, 2), (None, c, 3), (2, near, 4), (7, a, 5), (7, b, 6), (7, b, 6), (None, None, 7), (None, "", 8), (9, None, 9)]
    table = spark.createDataFrame(data, "doc_id long, text string, did long").repartition(3)
    got = Counter((r["doc_id"], r["n_shingles"] > 0, r["component_id"], r["kept"]) for r in near_dedup.near_groups(table).collect())
    want = [(1, True, 1, True), (None, True, 1, False), (None, True, 7, False), (None, True, 2, False), (2, True, 2, True), (7, True, 1, False), (7, True, 7, True), (7, True, 7, True), (None, False, None, True), (None, False, None, True), (9, False, 9, True)]
    assert got == Counter(want)
    left = near_dedup.near_dedup(table)
    assert left.columns == ["doc_id", "text", "did"]
    assert sorted(r["did"] for r in left.collect()) == [0, 4, 6, 7, 8, 9]


def test_near_dedup_keeps_one_and_all_columns(docs, empty):
    left = near_dedup.near_dedup(docs)
    assert left.columns == docs.columns
    _, root = groups({d: t for d, t, *_ in corpus()}, 5, 80)
    assert {r["doc_id"] for r in left.collect()} == set(root.values())
    assert near_dedup.near_groups(empty).count() == 0


def test_components(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (5, 4), (3, 9), (7, 7), (9, 1)], "a long, b long")
    found = {r["node"]: r["root"] for r in components.components(edges, Scratch(spark, "test")).collect()}
    assert found == {1: 1, 2: 1, 3: 1, 9: 1, 4: 4, 5: 4}


def targets(sizes):
    """Shares by weight, taken again from what is open until no source is above 3 times its size."""
    names = sorted(s for s in sizes if s is not None) + [None] * (None in sizes)
    weight, target, open_, left = {s: i % 3 + 1 for i, s in enumerate(names)}, {}, set(sizes), sum(sizes.values())
    while open_:
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = {s for s in open_ if share[s] > 3 * sizes[s]}
        if not over:
            return target | share
        target |= {s: 3.0 * sizes[s] for s in over}
        left -= sum(3 * sizes[s] for s in over)
        open_ -= over
    return target


def test_mixing_targets_and_bounds(spark, docs, empty):
    mix = mixing.mix_sources(docs, block_words=8, shard_slots=64)
    got = mixing.taken_words(mix).collect()
    assert len(got) == docs.count()
    sizes = {}
    for d, t, _, s, *_ in corpus():
        sizes[s] = sizes.get(s, 0) + len(WORD.findall(t or ""))
    target = targets(sizes)
    source = {d: s for d, _, _, s, *_ in corpus()}
    taken = Counter()
    for r in got:
        s = source[r["doc_id"]]
        assert r["source_size"] == sizes[s] and r["target"] == pytest.approx(target[s]) and r["taken"] <= 3 * r["size"]
        taken[s] += r["taken"]
    assert all(abs(taken[s] - target[s]) <= 0.05 * target[s] + 16 for s in sizes)
    again = mixing.taken_words(mixing.mix_sources(docs.repartition(5), block_words=8, shard_slots=64))
    assert sorted(map(str, got)) == sorted(map(str, again.collect()))
    assert mixing.taken_words(mixing.mix_sources(empty)).count() == 0


def test_mixing_takes_the_words_of_its_slots(spark, docs):
    """Every source's words laid out one by one, and every slot's block read from them."""
    mix = mixing.mix_sources(docs.unionByName(docs.filter("doc_id % 2 = 0")), block_words=8, shard_slots=64)
    streams, slots = {}, [(r["sid"], r["place"], r["block"]) for r in mix.slots.collect()]
    for r in sorted((r for r in mix.rows.collect() if r["size"]), key=lambda r: (r["sid"], r["start"])):
        stream = streams.setdefault(r["sid"], [])
        assert r["start"] == len(stream)
        stream += [(r["start"], r["doc_id"])] * r["size"]
    want, turns = Counter(), {}
    for sid, place, block in slots:
        n = math.ceil(len(streams[sid]) / 8)
        turns.setdefault((sid, place // n), []).append(block)
        want.update((sid, *w) for w in streams[sid][8 * block : 8 * block + 8])
    assert all(len(set(b)) == len(b) for b in turns.values()) and len(slots) == len({s[:2] for s in slots})
    got = Counter()
    for r in mixing.taken_words(mix).collect():
        got[r["doc_id"]] += r["taken"]
    by_doc = Counter()
    for (_, _, d), n in want.items():
        by_doc[d] += n
    assert +got == by_doc and sum(by_doc.values()) > 0


@pytest.mark.parametrize("n", [1, 2, 7, 64, 1000])
def test_permutation(spark, n):
    df = spark.range(n).select(mixing.permuted(F.col("id"), F.lit(n).cast("long"), F.lit(1), F.lit(0).cast("long")).alias("p"))
    assert sorted(r["p"] for r in df.collect()) == list(range(n))


def test_toxicity_learns_words_and_grammar(spark, empty):
    rng = random.Random(2)
    data = []
    for i in range(200):
        w = words(rng, 40)
        if i % 4 == 0:
            w[20] = rng.choice(["moron", "grobian" + rng.choice(["en", "heit", "lich", "isch"])])
        data.append((i, " ".join(w), int(i % 4 == 0)))
    sample = spark.createDataFrame(data, "doc_id long, text string, label int")
    model = toxicity.fit(sample)
    tests = spark.createDataFrame([(1, "you are a moron"), (2, "plain words here"), (3, None), (4, ""), (5, "A Grobianung."), (5, "A Grobianung.")], "doc_id long, text string")
    got = toxicity.toxicity(tests, model).collect()
    score = {r["doc_id"]: r["predicted"] for r in got}
    assert score == {1: 1, 2: 0, 3: 0, 4: 0, 5: 1} and len(got) == 6 and all(0 <= r["score"] <= 1 for r in got)
    assert toxicity.toxicity(empty, toxicity.Model()).count() == 0
    assert toxicity.fit(sample.limit(0)).words.size == 0


def test_grammar_equals_reading_every_clause():
    """All clauses of up to four words against the rules read one hit at a time."""
    t = toxicity
    machines = t.grammar()
    for n in range(1, 5):
        for clause in itertools.product(range(7), repeat=n):
            want = []
            for i, s in enumerate(clause):
                if s not in (t.INSULT, t.THREAT):
                    continue
                before, after = clause[:i][::-1], clause[i + 1 :]
                near = lambda words, symbols: next((w for w in words[:6] if w in (*symbols, t.REPORT)), t.REPORT) != t.REPORT  # noqa: B023, E731
                front = (t.OBJECT,) if s == t.THREAT else (t.TARGET, t.OBJECT)
                targeted = near(before, front) or near(after, (t.TARGET, t.OBJECT))
                want.append(8 * (s == t.THREAT) + 4 * (t.NEGATION in before[:3]) + 2 * (t.REPORT in clause[:i] + after) + targeted)
            assert t.read_clause(list(clause), machines) == want


@pytest.mark.parametrize(("text", "threat", "negated", "reported", "targeted"), [
    ("I will kill you", 1, 0, 0, 1),
    ("moron you", 0, 0, 0, 1),
    ("you kill", 1, 0, 0, 0),
    ("moron, said he", 0, 0, 1, 0),
    ("he called you a moron", 0, 0, 1, 1),
    ("you are not a moron", 0, 1, 0, 1),
    ("ich werde dich töten", 1, 0, 0, 1),
    ("moron! said he", 0, 0, 0, 0),
])
def test_clauses_count_once_with_their_heaviest_pattern(spark, text, threat, negated, reported, targeted):
    insults = toxicity._keys(tc.Words(pa.array(["moron"]), lower=True))[0]
    row = spark.createDataFrame([(text,)], "text string")
    counts = toxicity.pattern_counts(row, insults, ()).first()["patterns"]
    assert [i for i, n in enumerate(counts) if n] == [8 * threat + 4 * negated + 2 * reported + targeted] and sum(counts) == 1
    again = toxicity.pattern_counts(row.selectExpr("concat(text, ' moron. ', text) AS text"), insults, ()).first()["patterns"]
    assert sum(again) == 2 + text.count("!")  # two hits of a clause count once


def test_several_hits_mark_a_clause():
    weight = toxicity.prior()
    assert toxicity.clause_pattern([0], weight) == 0 and toxicity.clause_pattern([0, 1], weight) == 17
    assert toxicity.clause_pattern([0, 4], weight) == 0  # the negated one adds nothing
    assert toxicity.clause_pattern([8, 0], weight) == 24  # the last of equal weight
    assert toxicity.clause_pattern([2, 3], weight) == 19


def test_token_counts_equal_the_library(spark, docs, empty):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    odd = ["a<|endoftext|>b <|endoftext|>", "it's  we'll\n\n x\r\n", "日本語のテキスト 1234567", "\u00a0\u2003é\u0301 🤖🤖", "  ", "x" * 500, "don''t ' s"]
    df = docs.select("doc_id", "text").unionByName(spark.createDataFrame([(1000 + i, t) for i, t in enumerate(odd)], "doc_id long, text string"))
    got = rows(token_count.token_counts(df, path, 5))
    tok = Tokenizer.from_file(path)
    for r in df.collect():
        n = len(tok.encode(r["text"] or "", add_special_tokens=False).ids)
        assert (got[r["doc_id"]]["n_tokens"], got[r["doc_id"]]["n_bytes"], got[r["doc_id"]]["over_limit"]) == (n, len((r["text"] or "").encode()), n > 5)
    assert token_count.token_counts(empty, path, 5).count() == 0


def test_quality_classifier_separates_held_out(spark, empty):
    rng = random.Random(5)
    good = [(i, " ".join(words(rng, 80)) + ".", 1) for i in range(80)]
    bad = [(100 + i, " ".join(w + "$$$ &&&" for w in words(rng, 60)), 0) for i in range(20)]
    sample = spark.createDataFrame(good[:60] + bad[:15], "doc_id long, text string, label int")
    model = quality_classifier.fit_sample(sample)
    held = spark.createDataFrame([x[:2] for x in good[60:] + bad[15:]] + [(900, None), (901, "")], "doc_id long, text string")
    got = rows(quality_classifier.quality(held, model))
    assert all(got[d]["predicted"] == y for d, _, y in good[60:] + bad[15:])
    assert all(0 <= r["score"] <= 1 for r in got.values()) and len(got) == 27
    assert quality_classifier.quality(empty, quality_classifier.fit_sample(sample.limit(0))).count() == 0


def test_quality_weights_minimise_the_loss_of_all_pairs(spark):
    rng = np.random.default_rng(3)
    y = (np.arange(130) % 5 > 0).astype(int)
    x = rng.normal(size=(130, len(quality_classifier.FEATURES))) + 0.4 * y[:, None] * (np.arange(len(quality_classifier.FEATURES)) % 3 == 0)
    x[:7, 2] = 40.0
    table = spark.createDataFrame([(int(b), a.tolist()) for a, b in zip(x, y)], "label int, x array<double>").repartition(3)
    model = quality_classifier.fit(table)
    z = np.clip((x - x.mean(axis=0)) / (x.std(axis=0) + 1e-6), -8, 8)
    d = (z[y == 1][:, None] - z[y == 0]).reshape(-1, z.shape[1])
    scale = quality_classifier.PAIRS_EACH / (y == 1).sum()

    def loss(w):
        return scale * np.logaddexp(0, -d @ w).sum() + w @ w / 2

    w = model.weights
    assert np.abs(w - scale * d.T @ (1 / (1 + np.exp(d @ w)))).max() < 1e-3 and loss(w) < loss(np.zeros(len(w))) - 1
    s = np.sort(z @ w)
    assert model.cut == pytest.approx((s[(y == 0).sum() - 1] + s[(y == 0).sum()]) / 2, abs=1e-9)
    sums = quality_classifier.moments(table, model)
    value, gradient, _ = quality_classifier.all_pairs(sums)
    assert value == pytest.approx(np.logaddexp(0, -d @ w).sum(), rel=1e-9) and gradient == pytest.approx(-d.T @ (1 / (1 + np.exp(d @ w))), rel=1e-7, abs=1e-7)


@pytest.mark.parametrize("rank", [1, 2, 3, 4, 499, 500])
def test_strength_at_a_rank_equals_sorting(spark, monkeypatch, rank):
    monkeypatch.setattr(quality_classifier, "CUTS", 4)
    s = sorted([1.0] * 3 + [math.nextafter(1.0, 2.0)] + [(i * 37 % 497) / 7 + 1.5 for i in range(496)])
    got = quality_classifier.at_rank(spark.createDataFrame([(v,) for v in s], "s double"), rank)
    assert got == (s[rank - 1] + s[min(rank, 499)]) / 2


def test_labels_for_quality_are_all_taken(spark, tmp_path, monkeypatch):
    rng = random.Random(8)
    texts = [(i, " ".join(words(rng, 60)) + ("." if i % 4 else " $$$" * (i % 9))) for i in range(120)]
    spark.createDataFrame(texts, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, int(i % 4 > 0)) for i, _ in texts], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    taken, fit = [], quality_classifier.fit
    monkeypatch.setattr(quality_classifier, "fit", lambda rows: taken.append(rows.count()) or fit(rows))
    monkeypatch.setattr(learning, "labelled_sample", None)
    assert queries.op6_quality_classifier(spark, str(tmp_path)).count() == 120
    assert taken == [sum(zlib.crc32(str(i).encode()) % 4 != 2 for i in range(120))]


def test_labelled_sample_is_bounded(spark, docs):
    labels = spark.createDataFrame([(0, 1), (3, 0), (3, 1), (None, 1), (6, None)], "doc_id long, toxic int")
    found = {r["doc_id"]: r["label"] for r in learning.labelled_sample(docs, labels, "toxic", F.lit(True), 10).collect()}
    assert found == {0: 1, 3: 1}
    assert learning.labelled_sample(docs, labels, "toxic", F.lit(True), 1).count() == 1


def repeated(w, n):
    """The places of the words that windows of n, found twice or more, cover."""
    seen = Counter(tuple(w[i : i + n]) for i in range(len(w) - n + 1))
    return {j for i in range(len(w) - n + 1) if seen[tuple(w[i : i + n])] > 1 for j in range(i, i + n)}


def test_quality_rules(docs, empty):
    got = rows(quality_rules.quality_rules(docs))
    for d, t, *_ in corpus():
        w = WORD.findall(t or "")
        cover = {n: repeated(w, n) for n in (3, *quality_rules.MAX_GRAM_PERCENT)}
        assert got[d]["n_words"] == len(w) and got[d]["n_repeat_words"] == len(cover[3])
        assert all(got[d][f"dup_chars_{n}"] == sum(len(w[j]) for j in cover[n]) for n in quality_rules.MAX_GRAM_PERCENT)
    assert quality_rules.keep_good(docs).columns == docs.columns
    assert quality_rules.quality_rules(empty).count() == 0


def test_quality_rules_reject_boilerplate_that_the_base_keeps(spark):
    """45 of 100 words in a passage of 15 that is there three times."""
    passage = [f"p{i:02}" for i in range(15)]
    own = [f"w{i:02}" for i in range(55)]
    texts = [passage + own[:20] + passage + own[20:40] + passage + own[40:], own + [f"v{i:02}" for i in range(45)]]
    got = rows(quality_rules.quality_rules(spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(texts)], "doc_id long, text string")))
    assert [(got[d]["base_failed"], got[d]["kept"]) for d in (0, 1)] == [(False, False), (False, True)]
    assert got[0]["dup_chars_12"] == 45 * 3 and got[0]["word_chars"] == 300


def test_url_rules_equal_trying_every_rule(spark):
    rules = [url_filter.Rule("block", "net/", "host"), url_filter.Rule("allow", "example.net/en/", "host"), url_filter.Rule("block", "/ads/"), url_filter.Rule("allow", "*ok*"), url_filter.Rule("block", "?id=*&x=")]
    urls = [None, "", "x", "http://Example.NET/en/a?b", "http://a.example.net/en", "http://net/q", "http://xnet/ads/", "ftp://h?u=/ads/", "HTTP://h/ads/ok", "a://b/c?id=1&x=2", "http://net", "http://h/adsx/"]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = {r["page_id"]: r for r in url_filter.url_filter(df, rules).collect()}
    for i, u in enumerate(urls):
        low, r = (u or "").lower(), got[i]
        fits = [x for x in rules if re.search(x.regex(), r["host"] + r["path"] if x.kind == "host" else low, re.S)]
        host = sorted((x for x in fits if x.kind == "host"), key=lambda x: -len(x.text))
        pattern = sorted((x for x in fits if x.kind != "host"), key=lambda x: (-len(x.text), x.text))
        assert r["rule"] == (host[0].text if host else None)
        assert r["verdict"] == (host or pattern)[0].action if host or pattern else "allow"
    assert (got[3]["host"], got[3]["path"], got[3]["rule"]) == ("example.net", "/en/a", "example.net/en/")
    assert url_filter.url_filter(df, []).filter("verdict <> 'allow'").count() == 0


def leaking(texts, items):
    """(id, item) of every text with a window, as long as the item, of weighted shingle similarity 0.8."""
    found = set()
    for d, t in texts.items():
        for i, item in enumerate(items):
            m = min(5, len(item))
            y = {tuple(item[j : j + m]) for j in range(len(item) - m + 1)}
            for s in range(max(1, len(t) - len(item) + 1)):
                w = t[s : s + len(item)]
                x = {tuple(w[j : j + m]) for j in range(len(w) - m + 1)}
                size = lambda g: sum(len(" ".join(s)) for s in g)
                if x and 100 * size(x & y) >= 80 * size(x | y):
                    found.add((d, i))
    return found


def test_decontamination_equals_trying_every_window(spark, docs, empty):
    rng = random.Random(9)
    items = [words(rng, n) for n in (3, 15, 30, 50)]
    changed = list(items[3])
    changed[7] = "changed"
    texts = [words(rng, 40) + items[1] + words(rng, 5), changed + words(rng, 30), words(rng, 60), items[2][:14] + words(rng, 40), items[0], words(rng, 10) + items[0], items[2]]
    table = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)] + [(50, None), (51, "")], "doc_id long, text string")
    bench = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(items)] + [(9, None), (10, "")], "item_id long, text string")
    want = leaking(dict(enumerate(texts)), items)
    got = decontamination.leaks(table, bench).collect()
    assert {(r["doc_id"], r["item_id"]) for r in got} == want and len(want) >= 4
    assert decontamination.decontaminate(docs, bench.limit(0)).count() == docs.count()
    assert decontamination.leaks(empty, bench).count() == 0


def test_decontamination_finds_windows_outside_the_fingerprint_radius(spark):
    """Five short words of forty changed at the end: similarity 0.808, at times beyond the radius."""
    rng = random.Random(12)
    word = lambda n: "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=n))
    item = [word(6) for _ in range(35)] + [word(3) for _ in range(5)]
    edited = [item[:35] + [word(3) for _ in range(5)] for _ in range(400)]
    table = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(edited)], "doc_id long, text string")
    bench = spark.createDataFrame([(0, " ".join(item))], "item_id long, text string")
    own, its = (df.select(decontamination.simhash(decontamination.words_of(F.col("text"))).alias(n)) for df, n in ((table, "own"), (bench, "its")))
    assert own.crossJoin(its).filter(F.bit_count(F.col("own").bitwiseXOR(F.col("its"))) > decontamination.RADIUS).count() > 0
    got = decontamination.leaks(table, bench).collect()
    assert sorted(r["doc_id"] for r in got) == list(range(400))
    assert all(r["similarity"] == pytest.approx(1054 / 1304) for r in got)


def test_hamming_blocks_find_all_within_the_radius(spark):
    rng = random.Random(8)
    a = rng.getrandbits(63)
    flipped = [a ^ sum(1 << b for b in rng.sample(range(63), k)) for k in range(decontamination.RADIUS + 1)]
    df = spark.createDataFrame([(x,) for x in flipped], "fp long").withColumn("own", decontamination.blocks(F.lit(a), decontamination.RADIUS)).withColumn("its", decontamination.blocks(F.col("fp"), decontamination.RADIUS))
    assert df.filter(F.arrays_overlap("own", "its")).count() == len(flipped)


def test_lattice_equals_enumeration():
    pieces = Pieces(public_tokenizers.path("piece_bpe_32k.model"))
    weight = dict(zip(pieces.texts, pieces.start, strict=False))
    for word in (b"the", "été".encode(), b"zq", b"hello"):
        def total(rest):
            return 1.0 if not rest else sum(math.exp(weight[rest[:n]]) * total(rest[n:]) for n in range(1, len(rest) + 1) if rest[:n] in weight)

        found = Lattice(pieces.texts).run([word], pieces.start, np.ones(1))
        assert found[0][0] == pytest.approx(math.log(total(b" " + word)))
    assert Lattice(pieces.texts).run([], pieces.start)[0].size == 0


def test_lm_scores(docs, empty):
    path = public_tokenizers.path("piece_bpe_32k.model")
    train = F.col("doc_id") % 2 == 0
    got = rows(lm_score.lm_scores(docs, train, path, head_words=20, rounds=1))
    fold = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    tokens = {d: [*WORD.findall((t or "").translate(fold)), ""] for d, t, *_ in corpus()}
    c = Counter(x for d, w in tokens.items() if d % 2 == 0 for x in w)
    n, v = sum(c.values()), len(c)
    for d, w in tokens.items():
        base = sum(math.log10((c[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w)
        assert (got[d]["n_tokens"], got[d]["n_known"], got[d]["train_tokens"]) == (len(w), sum(c[x] > 0 for x in w), n)
        assert got[d]["base_score"] == pytest.approx(base) and got[d]["score"] < 0
    whole = rows(lm_score.lm_scores(docs, train, path, rounds=1))
    assert all(whole[d]["score"] == pytest.approx(got[d]["score"]) for d in got)
    assert lm_score.lm_scores(empty, train, path).count() == 0


def test_pipeline_stages(spark):
    import corpus_pipeline

    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    before = docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, docs, d)
        assert after.columns == docs.columns
        docs = Scratch(spark, "test").keep(after, name.replace(" ", "-"))
        assert 0 < docs.count() <= before
        before = docs.count()
    assert corpus_pipeline.STAGES[-1][1](spark, docs, d).count() == before


def good_by_hand(text):
    w = WORD.findall(text or "")
    chars = sum(map(len, w))
    again, seen = 0, set()
    for line in (text or "").split("\n"):
        of_line = WORD.findall(line)
        if of_line and line in seen:
            again += sum(map(len, of_line))
        seen.add(line)
    if len(w) < 50 or 100 * len(repeated(w, 3)) > 50 * len(w) or 100 * again > quality_rules.MAX_LINE_PERCENT * chars:
        return False
    return all(100 * sum(len(w[j]) for j in repeated(w, n)) <= most * chars for n, most in quality_rules.MAX_GRAM_PERCENT.items())


def pipeline_rows(rng, items):
    """Copies, shared passages, leaks, junk and nulls; a repeated row, null ids, and a text that is nothing but a shared passage."""
    base, passage, line = words(rng, 130), words(rng, 60), " ".join(words(rng, 12))
    near = [[w + "x" if i % 130 < k else w for i, w in enumerate(base)] for k in (1, 4, 20)]
    texts = [words(rng, 70) + passage + words(rng, 30), base, *near, passage, passage + words(rng, 80), words(rng, 90)]
    texts += [words(rng, 60) + items[0] + words(rng, 40), items[1][:1] + ["other"] + items[1][2:] + words(rng, 50), items[1][:8] + words(rng, 60), words(rng, 49), words(rng, 50), ["a"] * 300]
    found = [(i * 7, " ".join(t)) for i, t in enumerate(texts)]
    found += [(500, "\n".join([line] * 4 + [" ".join(words(rng, 90))])), (501, None), (502, ""), (None, " ".join(base)), (None, " ".join(words(rng, 200))), found[7], (600, " ".join(words(rng, 1500)))]
    return [(d, t, "en", None if k % 4 == 0 else f"s{k % 3}", len(t or ""), "clash") for k, (d, t) in enumerate(found[:-2])] + [(*found[7], "en", "s1", len(found[7][1]), "clash"), (*found[-1], "en", "s2", len(found[-1][1]), "clash")]


def test_pipeline_equals_brute_force(spark, tmp_path):
    """Every stage on its own input, by trying everything; of the mix, targets and bounds, as its draws are its own."""
    import corpus_pipeline

    rng, last = random.Random(4), 1 << 62
    items = [words(rng, n) for n in (20, 40)]
    spark.createDataFrame(pipeline_rows(rng, items), SCHEMA).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(items)] + [(9, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    table = spark.read.parquet(f"{tmp_path}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    scratch = Scratch(spark, "chain")

    def run(name, docs):
        after = scratch.keep(stages[name](spark, docs, str(tmp_path)), name.replace(" ", "-"))
        assert name == "mixing" or after.columns == docs.columns
        return after, sorted(map(tuple, after.collect()), key=str)

    def by_id(found):
        return {(last if r[0] is None else r[0]): r for r in found}

    given = list(map(tuple, table.collect()))
    docs, got = run("quality rules", table)
    assert got == sorted((r for r in given if good_by_hand(r[1])), key=str) and 10 < len(got) < len(given)

    units = {(last if r[0] is None else r[0], r[1]): r for r in got}
    root = groups({u: u[1] for u in units}, 5, 80)[1]
    docs, after = run("near-dedup", docs)
    rest = lambda r: (r[0], r[1])  # noqa: E731  of repeated rows any may stay
    assert sorted(map(rest, after), key=str) == sorted((rest(units[u]) for u in units if root[u] == u), key=str) and len(after) < len(units) < len(got)

    given = by_id(after)
    kept = without_repeats({d: WORD.findall(r[1]) for d, r in given.items()})
    want = []
    for d, r in given.items():
        text = r[1] if len(kept[d]) == len(WORD.findall(r[1])) else " ".join(kept[d])
        if kept[d]:
            want.append((r[0], text, *r[2:4], r[4] if text == r[1] else len(text), r[5]))
    docs, after = run("substring dedup", docs)
    assert after == sorted(want, key=str) and len(after) < len(given) and any(r[1] != given[d][1] for d, r in by_id(after).items())

    given = by_id(after)
    gone = {d for d, _ in leaking({d: WORD.findall(r[1]) for d, r in given.items()}, items)}
    docs, after = run("benchmark decontamination", docs)
    assert after == sorted((r for d, r in given.items() if d not in gone), key=str) and len(gone) == 2

    sizes = {}
    for r in after:
        sizes[r[3]] = sizes.get(r[3], 0) + len(WORD.findall(r[1]))
    target, source, size = targets(sizes), {r[0]: r[3] for r in after}, {r[0]: len(WORD.findall(r[1])) for r in after}
    mixed, out = run("mixing", docs)
    assert {r["doc_id"]: r["size"] for r in mixed.collect()} == size and len(out) == len(after)
    for r in mixed.collect():
        assert r["source_size"] == sizes[source[r["doc_id"]]] and r["target"] == pytest.approx(target[source[r["doc_id"]]]) and 0 <= r["taken"] <= 3 * r["size"]
    assert sum(r["taken"] for r in mixed.collect()) == pytest.approx(sum(sizes.values()), abs=2 * mixing.BLOCK_WORDS * len(sizes))
    # Repeated rows differ in source here, and which of them stays decides what the mix sees.
    whole = {r["doc_id"]: r["size"] for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert whole == size


def test_decontamination_finds_windows_level_with_no_shingle(spark):
    """Two insertions close together: only the window between the two level ones is similar enough."""
    item = [f"w{i}" for i in range(60)]
    item[5], item[54] = "a" * 65, "b" * 65
    text = [f"x{i}" for i in range(10)] + item[:28] + ["X"] + item[28:32] + ["Y"] + item[32:] + [f"y{i}" for i in range(10)]
    lower = [w.lower() for w in text]
    docs = spark.createDataFrame([(1, " ".join(text)), (2, " ".join(reversed(text)))], "doc_id long, text string")
    bench = spark.createDataFrame([(7, " ".join(item))], "item_id long, text string")
    assert leaking({1: lower, 2: lower[::-1]}, [item]) == {(1, 0)}
    found = decontamination.leaks(docs, bench).collect()
    assert [(r["doc_id"], r["item_id"], r["start"]) for r in found] == [(1, 7, 11)] and found[0]["similarity"] > 0.8
    assert [r["doc_id"] for r in decontamination.decontaminate(docs, bench).collect()] == [2]


def test_growing_tables_are_not_broadcast_by_their_compressed_size(spark):
    """A file of sorted numbers is small; joins with it, inside a kept job or by ``small`` beyond its limit, do not send it through the driver."""
    from furrow.llm.storage import small

    scratch = Scratch(spark, "sizes")
    cells = scratch.keep(spark.range(400_000).select(F.col("id").alias("cell")), "cells")
    rows = spark.range(400_000).select(F.col("id").alias("cell"), F.lit(1).alias("n"))
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan(rows.join(cells, "cell"))
    assert "BroadcastHashJoin" not in plan(rows.join(small(cells, substring_dedup.CELL_BYTES * 400_000, 1 << 20), "cell"))
    assert "BroadcastHashJoin" in plan(rows.join(small(cells, 1000), "cell"))
