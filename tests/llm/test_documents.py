"""Operators on whole documents against brute force."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from footlamp.llm import language, mixing, quality, simhash, toxicity
from footlamp.llm.components import components

SF = "/root/testdata/sf0.001"
COLUMNS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
ODD = [
    (1, None, "en", "a", 0), (2, "", "en", None, 0), (3, " \n\t ", None, "a", 3), (None, "one two", "en", "b", 7), (4, "one two", "en", "b", 7),
    (4, "one two", "en", "b", 7), (5, "A b\x0bC\x0cd\re", "fr", "c", 9), (6, "12 34 -- 56", "fr", "c", 9), (7, "w" * 300_000, "en", "a", 1),
    (8, "the cat sat on the mat. " * 4000, "en", "a", 1), (9, "é日本語 ünï", "de", "", 1),
]


@pytest.fixture(scope="module")
def odd(spark):
    extra = {c: F.lit("clash") for c in ("size", "key", "fp", "kept", "score", "row", "pattern", "start", "n_words", "block")}
    return spark.createDataFrame(ODD, COLUMNS).withColumns(extra)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def plain_fingerprint(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = words(low)
    grams = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([" ".join(w)] if w else [])
    counts = [0] * 64
    for g in grams:
        h = xxhash.xxh64_intdigest(g.encode(), 42)
        for b in range(64):
            counts[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * counts[b] > len(grams))


def plain_components(ids, fps):
    parent = list(range(len(ids)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(ids)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= 3:
                parent[find(i)] = find(j)
    group = {}
    for i in range(len(ids)):
        group.setdefault(find(i), []).append(i)
    return {i: min((ids[j] for j in g if ids[j] is not None), default=None) for g in group.values() for i in g}


def test_simhash_odd(odd):
    got = simhash.near_duplicates(odd).collect()
    fps = [plain_fingerprint(t) for _, t, *_ in ODD]
    want = plain_components([r[0] for r in ODD], fps)
    assert sorted(((r.doc_id or -1), r.fp & (2**64 - 1), r.component_id or -1) for r in got) == sorted(
        ((row[0] or -1), fps[i], want[i] or -1) for i, row in enumerate(ODD)
    )
    assert simhash.near_duplicates(odd.limit(0)).count() == 0


def test_simhash_slices(monkeypatch):
    text = (" ".join(f"w{i % 37}" for i in range(5000)) + "\n x").encode()
    whole = simhash.fingerprint(text)
    monkeypatch.setattr(simhash, "SLICE", 50)
    assert simhash.fingerprint(text) == whole == int(np.uint64(plain_fingerprint(text.decode())).view(np.int64))


def test_simhash_dense_cells_lose_no_link(spark):
    """Chains and balls of fingerprints, with cells cut into parts of a few members."""
    rng = np.random.default_rng(1)
    base = rng.integers(0, 2**64, 6, dtype=np.uint64)
    fps = set()
    for b in base:
        for _ in range(60):
            x = int(b)
            for bit in rng.integers(0, 64, rng.integers(0, 7)):
                x ^= 1 << int(bit)
            fps.add(x)
    fps = sorted(fps)
    table = spark.createDataFrame([(simhash.signed(x),) for x in fps], "fp bigint")
    got = {r.node: r.root for r in components(simhash.links(table, part=5)).collect()}
    want = plain_components(list(range(len(fps))), fps)
    names = {}
    for i, x in enumerate(fps):
        names.setdefault(got.get(simhash.signed(x), ("alone", i)), set()).add(want[i])
    assert all(len(v) == 1 for v in names.values()) and len(names) == len(set(want.values()))


def test_deduplicate_keeps_one_of_each(docs, odd):
    found = simhash.near_duplicates(docs).collect()
    kept = simhash.deduplicate(docs).collect()
    assert sorted(r.doc_id for r in kept) == sorted({r.component_id for r in found})
    assert docs.columns == simhash.deduplicate(docs).columns
    # 1, 2 and 3 share fingerprint zero; the null id goes with 4, whose rows are equal
    assert sorted(r.doc_id for r in simhash.deduplicate(odd).collect()) == [1, 4, 5, 6, 7, 8, 9]


def test_components_of_a_chain_and_a_star(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 160)] + [(7, 7)]
    got = {r.node: r.root for r in components(spark.createDataFrame(chain, "u bigint, v bigint")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{i: 100 for i in range(100, 160)}}


def test_mixing_odd(odd):
    got = mixing.taken_words(mixing.plan_mix(mixing.sized_documents(odd))).collect()
    assert len(got) == len(ODD) and sum(r.size for r in got) == sum(len(words(r[1])) for r in ODD)
    assert all(0 <= r.taken <= 3 * r.size for r in got)
    assert mixing.taken_words(mixing.plan_mix(mixing.sized_documents(odd.limit(0)))).count() == 0
    nothing = odd.where("text IS NULL OR text = ''")
    assert [r.taken for r in mixing.taken_words(mixing.plan_mix(mixing.sized_documents(nothing))).collect()] == [0, 0]


def test_mixing_targets_and_slots(spark, docs):
    mix = mixing.plan_mix(mixing.sized_documents(docs))
    sources = mix.sources.collect()
    total = sum(r.source_size for r in sources)
    assert abs(sum(r.target for r in sources) - total) < 1e-6 * total and all(r.target <= 3 * r.source_size for r in sources)
    slots = mix.slots.collect()
    assert len(slots) == sum(r.quota for r in sources) == len({(s.shard, s.slot) for s in slots})
    per_pass = Counter((s.source_no, s.pass_no, s.block_no) for s in slots)
    assert max(per_pass.values()) == 1  # a pass is a permutation
    taken = mixing.taken_words(mix).toPandas().groupby(["source_size", "target"]).taken.sum()
    assert all(abs(t - target) <= mixing.BLOCK for (_, target), t in taken.items())


def test_mixed_documents_have_the_taken_words(docs, odd):
    for table in (docs, odd):
        rows = mixing.mix_documents(table).collect()
        words_of = sum(len(words(r.text)) for r in rows)
        taken = sum(r.taken for r in mixing.taken_words(mixing.plan_mix(mixing.sized_documents(table))).collect())
        assert words_of == taken and all(r.n_chars == len(r.text) for r in rows)


def plain_counts(text):
    w = words(text)
    grams = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    n = Counter(grams)
    covered = {j for i, g in enumerate(grams) if n[g] > 1 for j in range(i, i + 5)}
    lines = [l for l in (text or "").split("\n") if words(l)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered)


def test_quality_counts(odd, docs):
    texts = {r.doc_id: r.text for r in docs.collect()}
    got = quality.base_counts(docs.select("doc_id", "text")).collect()
    for r in got:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == plain_counts(texts[r.doc_id])
    kept = quality.filter_documents(odd).collect()
    assert quality.filter_documents(odd).columns == odd.columns and kept == []  # all too short or too repetitive
    assert quality.filter_documents(odd.limit(0)).count() == 0


def test_quality_votes_decide(spark):
    clean = [(i, " ".join(f"word{chr(97 + (i * 7 + j) % 26)}{chr(97 + j % 25)}x" for j in range(80))) for i in range(200)]
    clean = [(i, re.sub(r"\d", "", t)) for i, t in clean]
    noisy = [(1000 + i, " ".join(w + "#$%" for w in t.split())) for i, t in clean[:20]]
    rows = spark.createDataFrame(clean + noisy, "doc_id bigint, text string")
    from footlamp.plans.storage import cut_lineage

    got = {r.doc_id: (r.base_failed, r.kept) for r in quality.judge(cut_lineage(quality.base_counts(rows))).collect()}
    assert all(got[i][1] for i, _ in clean if not got[i][0])
    assert not any(got[i][1] for i, _ in noisy)


def held(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 3 == 1


def test_language(spark, docs, odd):
    model = language.fit(docs)
    got = {r.doc_id: r for r in language.identify(docs, model, keep=["doc_id", "lang"]).collect()}
    mine = [r for i, r in got.items() if held(i) and r.lang is not None]
    assert sum(r.lang == r.lang_pred for r in mine) >= 0.95 * len(mine)
    told = language.identify(odd, model)
    assert told.columns[:-2] == odd.columns
    und = {r.doc_id for r in told.select("doc_id", "lang_pred").collect() if r.lang_pred == "und"}
    assert und == {1, 2, 3, 6}
    empty = language.fit(docs.limit(0))
    assert {r.lang_pred for r in language.identify(docs, empty, keep=["doc_id"]).select("lang_pred").collect()} == {"und"}
    assert language.identify(docs.limit(0), model).count() == 0


def test_language_slices_and_many_languages(spark, monkeypatch):
    text = "Älter als the rest, 12 of them.  ... " * 50
    whole = np.concatenate(list(language.ngrams(text.encode())))
    for size in (1, 5, 64):
        monkeypatch.setattr(language, "SLICE", size)
        assert np.array_equal(np.concatenate(list(language.ngrams(text.encode()))), whole)
    names = [f"l{i:02d}" for i in range(70)]
    rows = [(i * 100 + j, (name[1:].translate(str.maketrans("0123456789", "qwertyuiop")) * 3 + " ") * 30, name) for i, name in enumerate(names) for j in range(6)]
    many = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    model = language.fit(many)
    got = language.identify(many, model, keep=["doc_id", "lang"]).collect()
    assert len(model.languages) == 70 and sum(r.lang == r.lang_pred for r in got) > 0.9 * len(got)


def test_language_filter_is_a_bloom_filter(docs):
    """Every n-gram that a language contains is found: no false negatives, and the fill gives the false positives."""
    model = language.fit(docs)
    rng = np.random.default_rng(3)
    a, b = language.slots(rng.integers(0, 2**32, 200_000, dtype=np.uint32))
    found = (model.masks[a] & model.masks[b])[:, 0]
    for i in range(len(model.languages)):
        assert abs(((found >> i) & 1).mean() - model.fill[i] ** 2) < 0.005


@pytest.fixture(scope="module")
def toxic_model(spark, docs):
    return toxicity.fit(docs, spark.read.parquet(f"{SF}/labels.parquet"))


def test_toxicity_search_is_exact():
    rng = np.random.default_rng(5)
    n, v = 700, 60
    model = toxicity.ToxicityModel({f"t{i}": i for i in range(v)}, rng.uniform(1, 5, v), np.arange(n) * 2, rng.integers(0, 2, n) * 1.0, np.ones(n), 0.1)
    counts = [Counter({int(t): int(c) for t, c in zip(rng.integers(0, v, 6), rng.integers(1, 9, 6))}) for _ in range(n)]
    counts[10] = counts[20] = counts[30]
    vectors = [model.vector(c) for c in counts]
    model.index(vectors)
    dense = np.zeros((n, v))
    for i, (t, w) in enumerate(vectors):
        dense[i, t] = w
    for q in [counts[10], *counts[:50]]:
        t, w = model.vector(q)
        want = np.round(dense[:, t] @ w, 12)
        order = [i for i in np.lexsort((model.ids, -want)) if want[i] > 0][: toxicity.K]
        at, cosine = model.nearest(t, w)
        assert at.tolist() == order and np.allclose(cosine, want[order])


def test_toxicity_rows(spark, docs, odd, toxic_model):
    got = toxicity.score(odd, toxic_model).collect()
    assert len(got) == len(ODD) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in got)
    assert all(r.held_out == (r.doc_id is not None and held(r.doc_id)) for r in got)
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    nothing = toxicity.fit(docs, labels.limit(0))
    assert {r.score for r in toxicity.score(docs, nothing).collect()} == {0.0}
    assert toxicity.score(docs.limit(0), toxic_model).count() == 0


def test_toxicity_accuracy(spark):
    from footlamp.llm import QUERIES

    sf = "/root/testdata/sf0.01"
    got = QUERIES["op8_toxicity"](spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out").collect()
    toxic, clean = [r for r in got if r.toxic], [r for r in got if not r.toxic]
    assert sum(r.predicted for r in toxic) >= 0.6 * len(toxic) and sum(r.predicted for r in clean) <= 0.05 * len(clean)
    assert all(len(r.neighbours) == len(r.cosines) <= toxicity.K for r in got)


def plain_toxicity(texts, learnt):
    """Scores by comparing every text with every example, with vectors as dictionaries."""

    def terms(text):
        found = Counter()
        for token in (text or "").lower().split():
            letters = [i for i, c in enumerate(token) if c.isalpha()]
            if letters:
                found[token[letters[0] : letters[-1] + 1]] += 1
        return found

    learnt = [(i, label, terms(text)) for i, label, text in learnt]
    n = [sum(label == c for _, label, _ in learnt) for c in (0, 1)]
    df, held = Counter(), [Counter(), Counter()]
    for text in texts.values():
        df.update(set(terms(text)))
    for _, label, found in learnt:
        held[label].update(set(found))

    def factor(term):
        seen = [held[c][term] for c in (0, 1)]
        rate = sum(seen) / sum(n)
        g = sum(x * math.log(x / e) for c in (0, 1) for x, e in ((seen[c], n[c] * rate), (n[c] - seen[c], n[c] * (1 - rate))) if x > 0)
        return (math.log((1 + len(texts)) / (1 + df[term])) + 1) * math.sqrt(max(0.0, 2 * g))

    factors = {t: factor(t) for t in held[0] | held[1]}

    def vector(found):
        v = {t: (1 + math.log(c)) * factors[t] for t, c in found.items() if t in factors}
        norm = math.sqrt(sum(x * x for x in v.values()))
        return {t: x / norm for t, x in v.items()} if norm else {}

    examples = [(i, label, vector(found)) for i, label, found in learnt]
    base = n[1] / sum(n)
    out = {}
    for id_, text in texts.items():
        v = vector(terms(text))
        near = sorted((-round(sum(x * e.get(t, 0.0) for t, x in v.items()), 12), i, label) for i, label, e in examples)[: toxicity.K]
        near = [(-c, label) for c, _, label in near if c < 0]
        votes = [(c / near[0][0]) ** toxicity.VOTE_POWER for c, _ in near]
        heads = sum(x * label for x, (_, label) in zip(votes, near))
        out[id_] = (heads + toxicity.PRIOR_WEIGHT * base) / (sum(votes) + toxicity.PRIOR_WEIGHT) if near else base
    return out


def test_toxicity_query_brute_force(spark, docs):
    from footlamp.llm import QUERIES

    texts = {r.doc_id: r.text for r in docs.collect()}
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF}/labels.parquet").collect() if r.toxic is not None}
    learnt = [(i, int(labels[i]), texts[i]) for i in sorted(labels) if not held(i) and texts.get(i) is not None]
    want = plain_toxicity(texts, learnt)
    got = {r.doc_id: r.score for r in QUERIES["op8_toxicity"](spark, SF).collect()}
    assert got.keys() == want.keys() and all(abs(got[i] - want[i]) < 1e-6 for i in want)


def rare_word_rows(n, n_toxic):
    """Clean-looking texts of a common vocabulary; toxic ones also have one of a hundred words that few of them share."""
    rng = np.random.default_rng(8)
    rows = []
    for i in range(n):
        words_ = [f"w{chr(97 + x % 26)}{chr(97 + x // 26 % 26)}{chr(97 + x // 676)}" for x in rng.zipf(1.3, 60) % 3000]
        if i < n_toxic:
            words_[int(rng.integers(60))] = f"zq{chr(97 + i % 10)}{chr(97 + i // 10 % 10)}"
        rows.append((i * 7, " ".join(words_), int(i < n_toxic)))
    return rows


def test_toxicity_words_of_few_examples_and_calibration(spark):
    rows = spark.createDataFrame(rare_word_rows(4000, 800), "doc_id bigint, text string, toxic int")
    model = toxicity.fit(rows.drop("toxic"), rows.select("doc_id", "toxic"), examples=5000)
    got = toxicity.score(rows.drop("toxic"), model).join(rows.select("doc_id", "toxic"), "doc_id").where("held_out").collect()
    toxic, clean = [r for r in got if r.toxic], [r for r in got if not r.toxic]
    assert sum(r.predicted for r in toxic) >= 0.9 * len(toxic) and sum(r.predicted for r in clean) <= 0.01 * len(clean)
    for low, high in ((0.0, 0.3), (0.3, 0.7), (0.7, 1.01)):
        part = [r for r in got if low <= r.score < high]
        if len(part) >= 30:
            assert abs(sum(r.score for r in part) / len(part) - sum(r.toxic for r in part) / len(part)) < 0.15


def plain_model(patterns, n_rules):
    """The rounds of ``quality.estimate`` over ``pattern: n`` in plain Python, patterns in order."""
    digits = {p: [p // 3**i % 3 for i in range(n_rules)] for p in patterns}
    good, on_good, on_bad = quality.START_GOOD, [quality.START_ON_GOOD] * n_rules, [quality.START_ON_BAD] * n_rules
    for _ in range(quality.ROUNDS):
        p = {}
        for k, d in digits.items():
            a, b = good, 1 - good
            for v, g, w in zip(d, on_good, on_bad):
                a, b = a * (1 - g, 1.0, g)[v], b * (w, 1.0, 1 - w)[v]
            p[k] = a / (a + b)
        say = lambda i, v, f: sum(n * f(p[k]) for k, n in patterns.items() if digits[k][i] == v)
        bad_of, size = (lambda x: 1 - x), quality.PSEUDO
        gs = [(say(i, 2, float), say(i, 0, float)) for i in range(n_rules)]
        bs = [(say(i, 0, bad_of), say(i, 2, bad_of)) for i in range(n_rules)]
        on_good = [quality.bounded((a + size * quality.START_ON_GOOD) / (a + b + size), quality.LEAST_ON_GOOD, quality.MOST_ON_GOOD) for a, b in gs]
        on_bad = [quality.bounded((a + size * quality.START_ON_BAD) / (a + b + size), max(quality.LEAST_ON_BAD, 1 - g), quality.MOST_ON_BAD) for (a, b), g in zip(bs, on_good)]
        share = (sum(n * p[k] for k, n in patterns.items()) + size * quality.START_GOOD) / (sum(patterns.values()) + size)
        good = quality.bounded(share, quality.LEAST_GOOD, quality.MOST_GOOD)
    return [good, *on_good, *on_bad]


def test_votes_are_estimated_as_in_plain_python(spark):
    """Patterns in which every rule votes, and in which some votes never occur."""
    rng = np.random.default_rng(11)
    for patterns in ({int(k): int(rng.integers(1, 5000)) for k in rng.choice(3**4, 40, replace=False)}, {3**4 - 1: 7, 3**4 // 2: 2}):
        rows = spark.createDataFrame(list(patterns.items()), "pattern int, n bigint").select(quality.slots(4).alias("slots"), "n").coalesce(1)
        m = quality.estimate(rows, 4)
        assert np.allclose([m.good, *m.on_good, *m.on_bad], plain_model(patterns, 4), rtol=1e-12, atol=0)
    assert quality.estimate(rows.limit(0), 4).good == quality.START_GOOD


def plan_size(df, capsys):
    capsys.readouterr()
    df.explain(True)
    return len(capsys.readouterr().out)


def test_driver_holds_small_plans(spark, capsys, monkeypatch):
    """Every round of the votes and the cells of fingerprints had a plan of 47,000 characters and more, which the driver had to plan and compile."""
    rounds, model = [], quality.VoteModel(0.9, (0.9,) * len(quality.RULES), (0.4,) * len(quality.RULES))
    monkeypatch.setattr(quality, "estimate", lambda patterns, n_rules: rounds.append(patterns) or model)
    counts = "1L doc_id, 60L n_words, 300L word_chars, 0L n_symbols, 0L n_dup_lines, 0L n_repeat_words, 5L n_lines, 290L n_letters, false base_failed"
    counted = spark.range(9).selectExpr(*counts.replace("L ", "L AS ").replace("false ", "false AS ").split(", "))
    from footlamp.plans.storage import cut_lineage

    fps = cut_lineage(spark.range(9).select(F.xxhash64("id").alias("fp")))
    assert plan_size(simhash.links(fps), capsys) < 60_000
    assert plan_size(quality.judge(cut_lineage(counted)), capsys) < 40_000
    assert plan_size(quality.vote_sums(rounds[0], model), capsys) < 20_000
