"""Near copies of the pipeline against brute force."""

import itertools
import random
import uuid

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from footlamp.llm import near_copies, simhash
from footlamp.plans import storage

COLUMNS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def plain_set(text):
    w = (text or "").lower().split()
    return {" ".join(w[i : i + 5]) for i in range(len(w) - 4)} or ({" ".join(w)} if w else set())


def plain_kept(rows):
    sets = [plain_set(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    pairs = 0
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a == b or 5 * len(a & b) >= 4 * len(a | b) > 0:
                pairs += a != b
                parent[find(i)] = find(j)
    first = {}
    for i, (doc_id, _) in enumerate(rows):
        first[find(i)] = min(doc_id, first.get(find(i), doc_id))
    return sorted(first.values()), pairs


def edited(rng, words, edits):
    out = list(words)
    for _ in range(edits):
        out[rng.randrange(len(out))] = f"x{rng.random()}"
    return out


def test_edited_copies_from_four_fifths_on(spark):
    """Copies on both sides of 0.8, chains, a common passage, short and blank texts."""
    rng = random.Random(3)
    passage = [f"p{i}" for i in range(30)]
    rows = []
    for _ in range(25):
        base = [f"w{rng.randrange(3000)}" for _ in range(rng.choice((4, 5, 9, 40, 200)))]
        base = base + passage * rng.randrange(2)
        for _ in range(5):
            rows.append(edited(rng, base, rng.randrange(1 + len(base) // 30)))
        for _ in range(3):
            base = edited(rng, base, len(base) // 60)
            rows.append(base)
    texts = [" ".join(r) for r in rows] + [None, "", " \n", "one", "One", "a b c d e f g h", "a b c d e f g h i"]
    rows = list(enumerate(texts))
    rng.shuffle(rows)
    docs = spark.createDataFrame([(i, t, "en", "a", 0) for i, t in rows], COLUMNS)
    kept, pairs = plain_kept(rows)
    assert pairs > 50
    assert sorted(r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, docs, "").collect()) == kept
    assert near_copies.deduplicate(docs.limit(0)).count() == 0


def test_stage_keeps_what_brute_force_keeps(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select(*COLUMNS.replace(",", "").split()[::2])
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert sorted(r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, docs, "").collect()) == plain_kept(rows)[0]


def test_texts_not_asked_for_are_not_shuffled(spark):
    """Whole texts were shuffled for a few pairs; now those that no pair asks for stay out, and none that is asked for is lost."""
    texts = spark.range(20_000).selectExpr("id % 7 = 0 AS no_id", "id", "hash(id) AS key", "CAST(concat('text ', id) AS BINARY) AS text")
    for few in (texts.where("id % 400 = 3"), texts.where("id < 0")):
        asked = few.drop("text")
        kept = near_copies.only_asked(texts, asked)
        n = asked.count()
        assert n <= kept.count() <= n + 40
        assert kept.join(asked, ["no_id", "id", "key"]).count() == n


def test_pairs_grow_with_a_group_not_with_its_square(spark, monkeypatch):
    """Copies of one text that are like it but not each other, and copies of a text that is not there."""
    rng = random.Random(8)
    bases = [[f"w{rng.randrange(3000)}" for _ in range(150)] for _ in range(2)]
    texts = [" ".join(edited(rng, b, rng.choice((2, 3, 3)))) for b in bases for _ in range(200)] + [" ".join(bases[0])]
    rows = list(enumerate(texts))
    asked, verified = [], near_copies.verified

    def counted(pairs, nodes, whole):
        asked.append(pairs.count())
        return verified(pairs, nodes, whole)

    monkeypatch.setattr(near_copies, "verified", counted)
    docs = spark.createDataFrame([(i, t, "en", "a", 0) for i, t in rows], COLUMNS)
    kept = sorted(r.doc_id for r in near_copies.deduplicate(docs).collect())
    assert kept == plain_kept(rows)[0]
    assert sum(asked) < 8 * len(rows), asked


def test_fingerprints_are_linked_by_the_pivot_cells_first(spark, monkeypatch):
    """The stage left SimHash and its pivot cells out; their links are measured first, and copies beyond 3 bits are still found."""
    rng = random.Random(9)
    base = [f"w{rng.randrange(3000)}" for _ in range(3000)]
    texts = [" ".join(edited(rng, base, edits)) for edits in (0, 1, 1, 1, 2, 60, 60, 300)]
    asked, links = [], simhash.links
    monkeypatch.setattr(simhash, "links", lambda distinct: asked.append(links(distinct).count()) or links(distinct))
    docs = spark.createDataFrame([(i, t, "en", "a", 0) for i, t in enumerate(texts)], COLUMNS)
    kept = sorted(r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, docs, "").collect())
    assert kept == plain_kept(list(enumerate(texts)))[0] and len(kept) < len(texts) - 4
    assert len(asked) == 1 and asked[0] > 0


def test_candidates_are_those_of_every_pair():
    """Pairs of a list, whatever the slices of it, against a loop over all pairs."""
    rng = np.random.default_rng(5)
    lists = []
    for size in (2, 5, 0, 1, 60):
        n = rng.integers(20, 26, size)
        lists.append([{"node": int(rng.integers(1 << 40)), "n": int(k), "at": int(rng.integers(4)), "root": int(rng.integers(3)), "small": [int(x) for x in rng.integers(0, 16, near_copies.SMALL) // 8]} for k in n])
    member = pa.struct([("node", pa.int64()), ("n", pa.int64()), ("at", pa.int32()), ("root", pa.int64()), ("small", pa.list_(pa.int64()))])
    want = set()
    for members in lists:
        for a, b in itertools.combinations(members, 2):
            apart = sum((x ^ y).bit_count() for x, y in zip(a["small"], b["small"]))
            most = min(a["n"] - a["at"], b["n"] - b["at"], a["n"], b["n"], (a["n"] + b["n"] - apart) / 2)
            if a["root"] != b["root"] and 9 * most >= 4 * (a["n"] + b["n"]):
                want.add((a["node"], b["node"]))
    for pairs in (1, 7, 10_000):
        with pytest.MonkeyPatch.context() as patch:
            patch.setattr(near_copies, "PAIRS", pairs)
            got = [p for u, v, _ in near_copies._candidates(pa.array(lists, pa.list_(member))) for p in zip(u.tolist(), v.tolist())]
        assert set(got) == want and len(got) == len(want) > 100


def test_sets_of_a_step_are_deleted_before_the_next(spark, monkeypatch, tmp_path):
    """Sets, pairs and rooted postings of all four steps lay on disk until the last one ended."""
    rng = random.Random(12)
    bases = [[f"w{rng.randrange(3000)}" for _ in range(150)] for _ in range(3)]
    rows = list(enumerate(" ".join(edited(rng, b, rng.choice((0, 1, 3)))) for b in bases for _ in range(20)))
    left, compared = [], near_copies.compared

    def looked(postings, nodes, nearest):
        tables = [spark.read.parquet(str(p)).columns for p in tmp_path.iterdir()]
        left.append((sum("members" in t for t in tables), sum({"shingle", "root"} <= set(t) for t in tables)))
        return compared(postings, nodes, nearest)

    monkeypatch.setattr(near_copies, "compared", looked)
    monkeypatch.setattr(storage, "scratch_dir", lambda spark, purpose: f"{tmp_path}/{purpose}-{uuid.uuid4().hex}")
    docs = spark.createDataFrame([(i, t, "en", "a", 0) for i, t in rows], COLUMNS)
    assert sorted(r.doc_id for r in near_copies.deduplicate(docs).collect()) == plain_kept(rows)[0]
    assert left == [(0, 1)] * (near_copies.ROUNDS + 1)
