"""License scans, importance resampling and spelling variants against brute force."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pytest
from compare import _key, duck
from pyspark.sql import functions as F

from footlamp.llm import SQL, importance, license_scan, spelling
from footlamp.llm.byte_words import slices_of_words

SF = "/root/testdata/sf0.001"
COLUMNS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
LICENSED = [
    (1, None), (2, ""), (3, " \n.-"), (None, "MIT License"), (4, "MIT License"), (4, "MIT License"),
    (5, "mit-LICENSE mit license\nApache   License, GNU Lesser General Public License"), (6, "emit license, mit licenses"),
    (7, "// SPDX-License-Identifier: (MIT OR Apache-2.0) AND GPL-3.0-only WITH Classpath-exception-2.0 */"),
    (8, "spdx-license-identifier: MIT OR\nSPDX-License-Identifier: BSD-3-Clause"), (9, "word " * 300_000 + "apache license"), (10, "é" * 300_000),
    (11, "mitİ license ünï mit license"), (12, "Licensed under CC BY-NC 4.0."), (13, "GNU General\x00Public License general public license"),
]


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def plain_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text))


def spread(spark, rows):
    extra = {c: F.lit("clash") for c in ("score", "weight", "rank", "n", "word", "row", "labels", "part", "size", "spans")}
    return spark.createDataFrame([(i, t, "en", "a", 0) for i, t in rows], COLUMNS).withColumns(extra)


@pytest.mark.parametrize("text", ["", "a", "One  two\tTHREE", "x" * 50 + " y " + "é" * 40, "ab " * 30])
def test_slices(text):
    for size in (1, 3, 7, 1000):
        assert [w.decode() for s in slices_of_words(text.encode(), size) for w in s] == plain_words(text)


def plain_places(text, phrases):
    w = plain_words(text)
    return sorted((i, p.words, p.label) for p in phrases for k in [p.words.split()] for i in range(len(w) - len(k) + 1) if w[i : i + len(k)] == k)


def test_license_rows(spark):
    got = {}
    for r in license_scan.scan(spread(spark, LICENSED)).collect():
        got.setdefault(r.doc_id, []).append(r)
    for id_, text in LICENSED:
        r = got[id_][0]
        base = plain_places(text, license_scan.BASE)
        assert (r.n_words, r.n_base) == (len(plain_words(text)), len(base))
        assert (r.first_word, r.last_word) == ((base[0][0], base[-1][0]) if base else (None, None))
        assert r.base_labels == ",".join(sorted({b[2] for b in base}))
        assert set(filter(None, r.base_labels.split(","))) <= set(filter(None, r.labels.split(",")))
        assert 0 <= r.score <= 1 and (r.score > 0) == bool(r.labels)
    assert len(got[4]) == 2 and got[4][0] == got[4][1]
    assert got[7][0].labels == "apache,gpl,mit" and got[7][0].expressions[0].valid and not got[7][0].expressions[0].permitted
    assert [e.valid for e in got[8][0].expressions] == [False, True] and got[8][0].labels == "bsd"
    assert got[5][0].labels == "apache,gpl,lgpl,mit" and got[12][0].labels == "cc-by-nc"
    assert license_scan.scan(spread(spark, LICENSED).limit(0)).count() == 0


def test_license_slices():
    rng = random.Random(5)
    pool = sorted({w for p in license_scan.BASE + license_scan.NOTICES for w in p.words.split()})
    phrases = (*license_scan.BASE, *license_scan.NOTICES)
    for _ in range(30):
        text = " ".join(rng.choice(phrases).words if rng.random() < 0.3 else rng.choice(pool) for _ in range(60))
        want = [(a, b, c) for a, b, c in plain_places(text, phrases)]
        for size in (5, 40, 1 << 20):
            n, places = license_scan.Scanner(size=size).places(text.encode())
            assert n == len(text.split())
            assert sorted((first, name, p.label) for first, _, name, same in places for p in same) == want


@pytest.mark.parametrize(
    ("text", "valid", "permitted"),
    [
        ("mit", True, True), ("mit or gpl-2.0", True, True), ("mit and gpl-2.0", True, False), ("mit or gpl-2.0 and lgpl-2.1", True, True),
        ("(mit or gpl-2.0) and lgpl-2.1", True, False), ("apache-2.0 with llvm-exception", True, True), ("gpl-2.0+ with x or mit", True, True),
        ("", False, False), ("mit or", False, False), ("or mit", False, False), ("(mit", False, False), ("mit)", False, False), ("mit apache-2.0", False, False),
        ("(mit or isc) with x", False, False), ("mit or ()", False, False), ("((mit))", True, True), ("mit ? isc", False, False),
    ],
)
def test_expressions(text, valid, permitted):
    tokens = license_scan.postfix(text)
    value = license_scan.evaluate(tokens, license_scan.ACCEPTED) if tokens else None
    assert (value is not None, bool(value and value[0])) == (valid, permitted)


def test_expressions_against_python():
    rng = random.Random(3)
    for _ in range(300):
        names = [rng.choice(["mit", "isc", "gpl-2.0", "epl-1.0"]) for _ in range(rng.randint(1, 7))]
        plain, text = "", ""
        depth = 0
        for i, name in enumerate(names):
            if i:
                op = rng.choice([" and ", " or "])
                plain, text = plain + op, text + op
            if rng.random() < 0.3:
                plain, text, depth = plain + "(", text + "(", depth + 1
            plain, text = plain + str(license_scan.family(name) in license_scan.ACCEPTED), text + name
            if depth and rng.random() < 0.4:
                plain, text, depth = plain + ")", text + ")", depth - 1
        plain, text = plain + ")" * depth, text + ")" * depth
        assert license_scan.evaluate(license_scan.postfix(text), license_scan.ACCEPTED)[0] == eval(plain)


def plain_importance(docs, target, longest, buckets, percent, least, seed="2024"):
    def features(text):
        w = plain_words(text)
        return [zlib.crc32(" ".join(w[i : i + k]).encode()) % buckets for k in range(1, longest + 1) for i in range(len(w) - k + 1)], len(w)

    s, t = Counter(), Counter()
    for _, text in docs:
        s.update(features(text)[0])
    for _, text in target:
        t.update(features(text)[0])
    S, T = sum(s.values()), sum(t.values())
    rows = []
    for id_, text in docs:
        f, n = features(text)
        gain = [math.floor(1000 * math.log((t[b] + 1) * (S + buckets) / ((s[b] + 1) * (T + buckets)))) for b in f]
        weight = sum(gain) // len(gain) if gain else 0
        h = int(hashlib.sha256(f"{seed}:{'' if id_ is None else id_}".encode()).hexdigest()[:8], 16)
        rows.append((id_, n, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    fit = sorted((r for r in rows if r[1] >= least), key=lambda r: (-r[4], r[0] is None, r[0] or 0))
    drawn = fit[: percent * len(fit) // 100]
    return Counter(rows), [(r[4], r[0]) for r in drawn]


@pytest.mark.parametrize(("longest", "percent", "least"), [(1, 40, 2), (3, 100, 1), (2, 10, 3), (2, 0, 1)])
def test_importance_rows(spark, longest, percent, least):
    rng = random.Random(longest)
    rows = [(i, " ".join(rng.choice(["one", "Two", "drei-4", "ünf", "x"]) for _ in range(rng.randint(0, 12)))) for i in range(60)]
    rows += [(None, "one two three"), (None, "one two three"), (7, rows[7][1]), (70, None), (71, ""), (72, "a b " * 400_000)]
    target = [(0, "one two two"), (1, None), (2, "ünf")]
    docs, goal = spread(spark, rows), spark.createDataFrame(target, "item_id bigint, text string")
    got = importance.importance(docs, goal, longest, 50, percent, least).collect()
    want, drawn = plain_importance(rows, target, longest, 50, percent, least)
    assert Counter((r.doc_id, r.n_words, r.n_features, r.weight, r.score) for r in got) == want
    ranked = sorted((r for r in got if r["rank"] is not None), key=lambda r: r["rank"])
    assert [r["rank"] for r in ranked] == list(range(1, len(drawn) + 1))
    assert [(r.score, r.doc_id) for r in ranked] == drawn
    assert importance.importance(docs.limit(0), goal, longest).count() == 0
    taken = importance.resample(docs, goal, longest=longest, buckets=50, percent=percent, least_words=least)
    assert set(r.doc_id for r in taken.collect()) == {d for _, d in drawn} and "lang" in taken.columns


def test_importance_slices():
    text = ("ab cd " * 50).encode()
    codes = importance.Codes()
    whole = [c for _, f in importance.feature_codes(text, codes, 3) for c in f.tolist()]
    import footlamp.llm.importance as module

    kept = module.slices_of_words
    try:
        module.slices_of_words = lambda t: slices_of_words(t, 7)
        cut = [c for _, f in importance.feature_codes(text, codes, 3) for c in f.tolist()]
    finally:
        module.slices_of_words = kept
    assert Counter(whole) == Counter(cut) and len(whole) == 100 + 99 + 98


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def plain_variants(counts):
    out = {}
    for w, n in counts.items():
        near = [(-m, v) for v, m in counts.items() if v != w and edits(w, v) == 1]
        best = min(near, default=None)
        form = best[1] if best and -best[0] >= 2 * n else None
        out[w] = (n, len(near), form, counts[form] if form else None)
    roots = {}
    for w in out:
        r = w
        while out[r][2]:
            r = out[r][2]
        roots[w] = r
    return {(w, f, roots[w], n, k, m) for w, (n, k, f, m) in out.items()}


def crowd(n, seed=1):
    rng = random.Random(seed)
    words = set()
    while len(words) < n:
        w = "".join(rng.choice("abé") for _ in range(rng.randint(5, 9)))
        words.add(w)
    return {w: rng.randint(3, 40) for w in sorted(words)}


def test_position_index():
    counts = crowd(400)
    words = list(counts)
    index = spelling.PositionIndex(words)
    for w in words:
        near = {words[k] for k in spelling.members(index.near(w))}
        assert near == {v for v in words if edits(w, v) == 1}
        assert {words[k] for k in spelling.members(index.near(w, 2))} == {v for v in near if v[:2] != w[:2]}


@pytest.mark.parametrize("part", [7, 100_000])
def test_near_words(spark, part):
    counts = crowd(500, 2)
    words = spark.createDataFrame(list(counts.items()), "word string, n bigint")
    got = {r.word: (r.n_near, r.best_n, r.best) for r in spelling.near_words(words, part=part).collect()}
    for w, n in counts.items():
        near = [(-m, v) for v, m in counts.items() if v != w and edits(w, v) == 1]
        assert got.get(w) == ((len(near), -min(near)[0], min(near)[1]) if near else None)


def test_variants_odd(spark):
    rng = random.Random(9)
    pool = ["Thethe", "thethe", "thethé", "th×the", "abcde", "abcdef", "bcdef", "ÀBCDEÀ", "àBCDEÀ", "four", "fives1fives"]
    rows = [(i, " ".join(rng.choice(pool) for _ in range(80))) for i in range(40)] + [(None, "thethe abcde"), (None, "thethe abcde"), (50, None), (51, ""), (52, "1 2 3"), (53, "w" * 200_000 + " thethe" * 9)]
    counts = Counter()
    for id_, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", lower(text)):
            h = zlib.crc32(f"{'' if id_ is None else id_}:{run}".encode())
            counts[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 97 == 0 else run] += 1
    kept = {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}
    got = spelling.variants(spread(spark, rows)).collect()
    assert {(r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in got} == plain_variants(kept)
    assert spelling.variants(spread(spark, rows).limit(0)).count() == 0


def test_runs_in_slices():
    text = "abcdé-fghij klmnopqrstuvwxyzÀ 1 x " * 5
    for size in (1, 4, 9):
        assert [w for p in spelling.slices(text, size) for w in spelling.RUN.findall(p)] == spelling.RUN.findall(text)


@pytest.mark.parametrize("name", ["op12_importance", "op13_spelling"])
def test_queries_equal_sql(spark, name):
    from footlamp.llm import QUERIES

    got = QUERIES[name](spark, SF)
    cols = got.columns
    want = duck(SF).sql(SQL[name]).to_arrow_table().select(cols).to_pydict()
    assert sorted(map(tuple, got.collect()), key=_key) == sorted(zip(*(want[c] for c in cols)), key=_key)


def test_license_query(spark):
    from footlamp.llm import QUERIES

    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = QUERIES["op11_license_scan"](spark, SF).collect()
    assert len(rows) == len(texts)
    for r in rows:
        base = plain_places(texts[r.doc_id], license_scan.BASE)
        assert (r.n_words, r.n_base, r.base_labels) == (len(plain_words(texts[r.doc_id])), len(base), ",".join(sorted({b[2] for b in base})))
        assert sorted((s.first, s.phrase, s.label) for s in r.spans if s.phrase in {p.words for p in license_scan.BASE}) == base
