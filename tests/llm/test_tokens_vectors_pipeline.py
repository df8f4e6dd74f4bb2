"""Encoding against the library, token files, neighbours against brute force, and the pipeline."""

import re

import numpy as np
import pyarrow as pa
import pytest
import sentencepiece
from pyspark.sql import functions as F
from sentencepiece import sentencepiece_model_pb2

import corpus_pipeline
from footlamp.llm import language, mixing, neighbours, quality, sentencepiece_lattice, token_files
from footlamp.plans.storage import scratch_dir
from test_near_copies import plain_kept

SF = "/root/testdata/sf0.001"
TEXTS = [
    "  Hello  world \n x\t日本 \U0001f600 é ﬁ <s> a \x00 ", "", None, " ", "a" * 200 + " " + "ab" * 20, "don't   stop²..", "x" * 47, "x" * 48, "x" * 49,
    "ééé日本語テキスト", "12345 67 3.14", "the " * 3000, "A\u0301 क्षि",
]


@pytest.fixture(scope="module")
def model():
    return sentencepiece_lattice.load_model(sentencepiece_lattice.model_path())


def texts(spark, rows=TEXTS):
    return spark.createDataFrame(list(enumerate(rows)), "doc_id bigint, text string").withColumn("block", F.lit("clash")).withColumn("ids", F.lit(1))


def test_encoding_is_the_library_s(spark, model):
    library = sentencepiece.SentencePieceProcessor(model_file=sentencepiece_lattice.model_path())
    got = {r.doc_id: r for r in sentencepiece_lattice.encode(texts(spark), model, block_chars=500).collect()}
    for i, t in enumerate(TEXTS):
        assert got[i].ids == (None if t is None else library.encode(t)), t
        assert got[i].round_trip == (None if t is None else True)
    marked = sentencepiece_lattice.encode(texts(spark, ["a▁b"]), model).collect()[0]
    assert marked.ids == library.encode("a▁b") and not marked.round_trip
    assert sentencepiece_lattice.encode(texts(spark).limit(0), model).count() == 0
    bare = sentencepiece_lattice.encode(texts(spark, ["", None, "z" * 60]), model).collect()
    assert sorted((r.doc_id, r.n_tokens) for r in bare) == [(0, 0), (1, 0), (2, len(library.encode("z" * 60)))]


def test_tokens_are_cut_where_words_are(model):
    for t in [*[t for t in TEXTS if t], "a b", " a b", "a  b ", "日本ab c", "a▁b c", "x\n y", " ", "▁"]:
        assert [w for k in model.tokens(t) for w in re.findall(model.pattern, k)] == re.findall(model.pattern, model.normalise(t)), t


def test_ids_are_packed_by_block_before_the_shuffle(spark, model):
    """Ids of words that many blocks share go as few rows, not one for each word and block."""
    names = [f"{a}{b}" for a in ("stage", "lamp", "curtain") for b in ("", "s", "light")]
    coded = sentencepiece_lattice.encode(texts(spark, [" ".join(names[i % 3 :]) for i in range(60)]), model, block_chars=200)
    plan = coded._jdf.queryExecution().executedPlan().toString()
    assert "explode(blocks" not in plan and "places" in plan
    library = sentencepiece.SentencePieceProcessor(model_file=sentencepiece_lattice.model_path())
    assert all(r.ids == library.encode(" ".join(names[r.doc_id % 3 :])) and r.round_trip for r in coded.collect())
    place = [(b << sentencepiece_lattice.PLACE_BITS) + p for b, p in [(0, 3), (1, 0), (5, 70_000)]]
    rows = [pa.record_batch({"places": pa.array([place, place[1:2]]), "ids": pa.array([[7, 8], [70_000]], pa.list_(pa.int32()))})]
    out = {b.column(0)[0].as_py(): b for b in sentencepiece_lattice._pack_ids(iter(rows))}
    assert sorted(out) == [0, 1, 5] and sum(b.num_rows for b in out.values()) == 3


def test_decoding(spark, model):
    coded = sentencepiece_lattice.encode(texts(spark), model).withColumn("decoded2", F.lit(0))
    back = {r.doc_id: r.decoded for r in sentencepiece_lattice.decode(coded, model).collect()}
    assert back == dict(enumerate(TEXTS))


@pytest.mark.parametrize("fallback", [True, False])
def test_unigram_model_folds_viterbi(spark, tmp_path, fallback):
    """A small hand-written unigram model: the fold finds the library's paths."""
    proto = sentencepiece_model_pb2.ModelProto()
    proto.trainer_spec.model_type = 1
    proto.trainer_spec.byte_fallback = fallback
    proto.normalizer_spec.name, proto.normalizer_spec.remove_extra_whitespaces = "identity", False

    def add(piece, score, kind=1):
        proto.pieces.add(piece=piece, score=score, type=kind)

    add("<unk>", 0, 2)
    if fallback:
        for b in range(256):
            add(f"<0x{b:02X}>", -20.0, 6)
    rng = np.random.default_rng(2)
    for i, piece in enumerate(["▁", *"abcde", "ab", "bc", "abc", "cd", "cde", "▁a", "▁ab", "de", "ea", "eab", "▁▁", "bcd"]):
        add(piece, float(-3 - len(piece) * rng.uniform(0.2, 2) - i / 1000))
    path = tmp_path / "m.model"
    path.write_bytes(proto.SerializeToString())
    own = sentencepiece_lattice.load_model(str(path))
    library = sentencepiece.SentencePieceProcessor(model_file=str(path))
    rows = ["".join(rng.choice(list("abcde "), rng.integers(1, 30))) for _ in range(60)] + ["aéb", "", "   "]
    got = {r.doc_id: r.ids for r in sentencepiece_lattice.encode(texts(spark, rows), own).collect()}
    for i, t in enumerate(rows):
        want = library.encode(t)
        if not fallback:  # the library joins neighbouring unknown characters
            assert [x for x in got[i] if x] == [x for x in want if x], t
        else:
            assert got[i] == want, t


def test_token_scan_across_blocks(spark, tmp_path):
    ends = [[5, 6, 7], [], [1] * 40, [9], []]
    flat = np.array([t for d in ends for t in [*d, 50256]] + [3, 3], dtype="<u2")
    (tmp_path / "a.bin").write_bytes(flat.tobytes())
    (tmp_path / "b.bin").write_bytes(np.array([50256], dtype="<u2").tobytes())
    (tmp_path / "c.bin").write_bytes(np.array([1] * 10, dtype="<u2").tobytes())
    (tmp_path / "empty.bin").write_bytes(b"")
    for size in (1, 2, 3, 7, 1000):
        got = token_files.count_tokens(spark, str(tmp_path), block_tokens=size).orderBy("file", "doc_no").collect()
        assert [(r.file, r.doc_no, r.n_tokens, r.closed) for r in got] == [
            *[("a.bin", i, len(d), True) for i, d in enumerate(ends)], ("a.bin", 5, 2, False), ("b.bin", 0, 0, True), ("c.bin", 0, 10, False),
        ]
    (tmp_path / "odd.bin").write_bytes(b"\x01\x02\x03")
    with pytest.raises(Exception, match="inside a token"):
        token_files.count_tokens(spark, str(tmp_path)).count()


def test_token_counts_are_the_tokenizer_s(spark, monkeypatch):
    import base64

    import public_tokenizers as P
    import tiktoken

    with open(P.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    plain = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    path = scratch_dir(spark, "tokens-test")
    written = token_files.write_token_files(texts(spark), path, P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    got = {r.doc_id: r.n_tokens for r in written.join(token_files.count_tokens(spark, path, block_tokens=64), ["file", "doc_no"]).collect()}
    assert got == {i: len(plain.encode_ordinary(t or "")) for i, t in enumerate(TEXTS)}


def test_neighbours_small_and_odd(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (100, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [1.0, 1.0]), (4, None), (5, [0.0, 0.0]), (6, [nan, 1.0]), (7, [inf, 1.0]),
            (8, [None, 1.0]), (9, [1.0]), (10, []), (None, [1.0, 2.0]), (3, [1.0, 1.0])]
    table = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>").withColumn("node", F.lit("clash"))
    got = neighbours.nearest(table, F.col("vec_id") % 100 == 0).orderBy("query_id", "rank").collect()
    assert [(r.query_id, r.rank, r.vec_id, r.score) for r in got] == [
        (0, 1, 1, 0.0), (0, 2, 100, 0.0), (0, 3, 3, 1.0), (0, 4, 2, 2**0.5), (100, 1, 0, 0.0), (100, 2, 1, 0.0), (100, 3, 3, 1.0), (100, 4, 2, 2**0.5),
    ]
    assert neighbours.nearest(table.limit(0), F.col("vec_id") % 100 == 0).count() == 0


def test_neighbours_recall(spark):
    table = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    t = table.toArrow()
    ids, x = t.column("vec_id").to_numpy(), np.array(t.column("embedding").to_pylist(), dtype=float)
    got = neighbours.nearest(table, F.col("vec_id") % 100 == 0).toPandas()
    right = 0
    for q, g in got.groupby("query_id"):
        d = np.sqrt(((x - x[ids == q][0]) ** 2).sum(1))
        want = [i for i in ids[np.lexsort((ids, d))] if i != q][:10]
        right += len(set(want) & set(g.vec_id))
        assert np.allclose(g.sort_values("rank").score, [d[ids == v][0] for v in g.sort_values("rank").vec_id], rtol=0, atol=1e-12)
    assert right / len(got) >= 0.9 and len(got) == 10 * sum(i % 100 == 0 for i in ids)


def test_pipeline_stages(spark):
    """Each stage against its operator on its own input, and the whole run against the last stage."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, inputs = docs.columns, []
    for name, stage in corpus_pipeline.STAGES:
        inputs.append(docs)
        docs = corpus_pipeline.cut_lineage(stage(spark, docs, SF))
        assert name == "sentencepiece" or docs.columns == columns
    ids = [{r.doc_id for r in d.select("doc_id").collect()} for d in inputs]
    counted = corpus_pipeline.cut_lineage(quality.base_counts(inputs[0].select("doc_id", "text")))
    assert ids[1] == {r.doc_id for r in quality.judge(counted).where("kept").collect()}
    told = language.identify(inputs[1], language.fit(inputs[1])).where("lang_pred <> 'und' AND score >= 0.2")
    assert ids[2] == {r.doc_id for r in told.collect()}
    assert ids[3] == set(plain_kept([(r.doc_id, r.text) for r in inputs[2].select("doc_id", "text").collect()])[0])
    taken = mixing.taken_words(mixing.plan_mix(mixing.sized_documents(inputs[3]))).where("taken > 0")
    assert ids[4] == {r.doc_id for r in taken.collect()}
    assert docs.count() == inputs[4].count() and docs.where("NOT round_trip").count() == 0
    got, want = corpus_pipeline.run(spark, SF), docs
    assert sorted((r.doc_id, r.n_tokens) for r in got.collect()) == sorted((r.doc_id, r.n_tokens) for r in want.collect())


def test_neighbours_undrawn_links_stay_fresh(spark):
    """A round ages only links whose node drew them; a star's centre draws ``SAMPLE`` of its many members."""
    rng = np.random.default_rng(2)
    n = 60
    nodes = spark.createDataFrame([(i, rng.standard_normal(4).tolist()) for i in range(n)], "node bigint, vec array<double>")
    star = spark.createDataFrame([(0, i, 0.0, True, True) for i in range(1, n)], "node bigint, nbr bigint, d double, fresh boolean, improved boolean")
    after = neighbours.descend(star, nodes, 0, degree=n).where("node = 0").collect()
    assert len(after) == n - 1 and sum(not r.fresh for r in after) == neighbours.SAMPLE
    with pytest.raises(RuntimeError):
        neighbours.build_graph(nodes, degree=4, rounds=0)
