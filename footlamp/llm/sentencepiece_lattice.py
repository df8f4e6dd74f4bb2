"""SentencePiece encoding and decoding over a relational lattice.

1. Texts are cut into words that no piece crosses; the distinct words of each block of documents are gathered.
2. Every distinct word of the corpus is exploded into its substrings of the sizes that pieces with the same first characters
   have, which are joined to the piece table. The matches are the edges of the word's lattice; they are grouped by word.
3. Each lattice is folded by a higher-order aggregate. For a unigram model the fold is Viterbi's. For a BPE model the best sum
   of scores is not what the model means, so the fold merges: it takes, again and again, the best edge that
   spans exactly two segments. Both give the ids that the sentencepiece library gives.
4. Blocks of documents meet the ids of their words and are put together. Ids are packed by block before they are shuffled and
   go by the word's place among the block's sorted words, so no word is sent back.

Words of more than ``LONG`` characters without a space, whose lattices have no bound, are encoded by the library itself
when their block is put together.
"""

from __future__ import annotations

import re
from array import array
from collections import defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from footlamp.llm.registry import query, table
from footlamp.llm.words import once, text_key

SPACE_PIECE = "▁"
#: Characters of a lattice at most; its boundaries are the bits of one integer.
LONG = 48
#: Characters of text in a block of documents.
BLOCK_CHARS = 20_000_000
#: Characters of text for each partition of words. A word's edges are gathered by hash, without a sort, so partitions are kept small.
WORD_CHARS = 4_000_000
HASHED_GROUPS = "spark.sql.objectHashAggregate.sortBased.fallbackThreshold"
#: A word's place in a corpus: its block, then its place among the block's sorted words. Places that are packed at once.
PLACE_BITS = 32
PLACE_MASK = (1 << PLACE_BITS) - 1
PACKED_IDS = 2_000_000
#: The piece table is broadcast, so it is held to this size.
MAX_PIECES = 1_000_000
#: Fixed values of the format: kinds of pieces, kinds of models, and how far below the worst piece an unknown character scores.
NORMAL, UNKNOWN, BYTE = 1, 2, 6
UNIGRAM, BPE = 1, 2
UNKNOWN_PENALTY = 10.0
LATIN = "A-Za-zÀ-ɏ"
BY_SCRIPT = f"{SPACE_PIECE}*[{LATIN}]+|{SPACE_PIECE}*[^{LATIN}{SPACE_PIECE}]+|{SPACE_PIECE}+"
BY_SPACE = f"{SPACE_PIECE}*[^{SPACE_PIECE}]+|{SPACE_PIECE}+"


@dataclass(frozen=True)
class PieceModel:
    """A model file's pieces: ``pieces`` are those that text can match; ``byte_ids`` is empty without byte fallback."""

    kind: int
    pieces: tuple[tuple[str, int, float], ...]
    byte_ids: tuple[int, ...]
    unknown_id: int
    surfaces: tuple[bytes | None, ...]
    dummy_prefix: bool
    longest: int
    pattern: str
    file: bytes

    def normalise(self, text: str) -> str:
        """Spaces as the space piece, with one in front of a text that is not empty."""
        return (SPACE_PIECE if self.dummy_prefix and text else "") + text.replace(" ", SPACE_PIECE)

    def tokens(self, text: str) -> list[str]:
        """Parts of the normalised text that no word crosses, each cut into words by ``pattern``: mostly what is between spaces."""
        if SPACE_PIECE in text or "  " in text or text[:1] in ("", " ") or text[-1] == " ":
            return re.findall(self.pattern, self.normalise(text))
        return ((SPACE_PIECE if self.dummy_prefix else "") + text.replace(" ", " " + SPACE_PIECE)).split(" ")


def load_model(path: str) -> PieceModel:
    """Read a model file on the driver. Models that normalise characters, or whose pieces cross spaces, are refused."""
    from sentencepiece import sentencepiece_model_pb2

    with open(path, "rb") as f:
        data = f.read()
    proto = sentencepiece_model_pb2.ModelProto()
    proto.ParseFromString(data)
    norm, kind = proto.normalizer_spec, proto.trainer_spec.model_type
    if kind not in (UNIGRAM, BPE) or norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.escape_whitespaces:
        raise ValueError("only unigram and BPE models with identity normalisation are supported")
    if len(proto.pieces) > MAX_PIECES:
        raise ValueError("the piece table is larger than its bound")
    pieces, surfaces, by_byte = [], [], {}
    unknown = 0
    for i, p in enumerate(proto.pieces):
        surfaces.append(p.piece.replace(SPACE_PIECE, " ").encode() if p.type == NORMAL else None)
        if p.type == NORMAL:
            pieces.append((p.piece, i, p.score))
        elif p.type == BYTE:
            by_byte[int(p.piece[1:-1], 16)] = i
            surfaces[-1] = bytes([int(p.piece[1:-1], 16)])
        elif p.type == UNKNOWN:
            unknown = i
            surfaces[-1] = proto.trainer_spec.unk_surface.encode()
        elif p.type in (4, 5):
            raise ValueError("user-defined and unused pieces are not supported")
    whole = re.compile(BY_SPACE)
    if any(not whole.fullmatch(p) for p, _, _ in pieces):
        raise ValueError("a piece crosses a space")
    script = re.compile(BY_SCRIPT)
    pattern = BY_SCRIPT if all(script.fullmatch(p) for p, _, _ in pieces) else BY_SPACE
    bytes_ = tuple(by_byte[b] for b in range(256)) if len(by_byte) == 256 else ()
    return PieceModel(kind, tuple(pieces), bytes_, unknown, tuple(surfaces), norm.add_dummy_prefix, max(len(p) for p, _, _ in pieces), pattern, data)


def piece_table(spark: SparkSession, model: PieceModel) -> DataFrame:
    """``piece, id, score, place``; ``place`` orders the pieces by score, equal scores alike."""
    names, ids, scores = zip(*model.pieces)
    place = np.unique(-np.array(scores), return_inverse=True)[1]
    return spark.createDataFrame(
        pa.table({"piece": pa.array(names), "id": pa.array(ids, pa.int32()), "score": pa.array(scores, pa.float64()), "place": pa.array(place, pa.int64())})
    )


#: Bits of an edge of a BPE lattice: place of the piece, start, size, and the id plus one (0: no piece).
START_BITS, SIZE_BITS, ID_BITS = 6, 6, 21
NO_PLACE = MAX_PIECES


#: Characters by which the sizes of the pieces that may start at a place are looked up.
HEAD = 3


def head_table(spark: SparkSession, model: PieceModel) -> DataFrame:
    """``head, sizes``: sizes of the pieces that start with the ``HEAD`` characters, and those of shorter substrings."""
    sizes: dict[str, set[int]] = {}
    for p, _, _ in model.pieces:
        if len(p) >= HEAD:
            sizes.setdefault(p[:HEAD], set(range(1, HEAD))).add(len(p))
    schema = pa.schema([("head", pa.string()), ("sizes", pa.list_(pa.int32()))])
    return spark.createDataFrame(pa.table([pa.array(list(sizes), pa.string()), pa.array(map(sorted, sizes.values()), pa.list_(pa.int32()))], schema=schema))


def packed_piece(place: Column, id_: Column) -> Column:
    """The bits of an edge that its piece gives."""
    return F.shiftleft(place.cast("bigint"), START_BITS + SIZE_BITS + ID_BITS).bitwiseOR(F.coalesce(id_ + 1, F.lit(0)).cast("bigint"))


def packed_span(start: Column, size: Column) -> Column:
    """The bits of an edge that its place gives. With those of the piece it is one integer, whose order is best first, then leftmost."""
    return F.shiftleft(F.shiftleft(start.cast("bigint"), SIZE_BITS).bitwiseOR(size.cast("bigint")), ID_BITS)


def start_of(e: Column) -> Column:
    return F.shiftright(e, ID_BITS + SIZE_BITS).bitwiseAND(F.lit((1 << START_BITS) - 1)).cast("int")


def stop_of(e: Column) -> Column:
    return start_of(e) + F.shiftright(e, ID_BITS).bitwiseAND(F.lit((1 << SIZE_BITS) - 1)).cast("int")


def id_of(e: Column) -> Column:
    return F.nullif(e.bitwiseAND(F.lit((1 << ID_BITS) - 1)).cast("int"), F.lit(0)) - 1


def edges(words: DataFrame, model: PieceModel) -> DataFrame:
    """The words' rows with ``edges``: best first, then leftmost. A character that is no piece has an edge with a null id.

    The edges of a BPE lattice are structs ``edge, ends, inner``: the packed edge, its two boundaries and those inside it, one
    bit each. Those of a unigram lattice are structs ``cost, start, stop, id``. Words are distinct and already partitioned by word, so grouping their edges again needs no shuffle.
    """
    n = F.length("word")
    rest = [c for c in words.columns if c != "word"]
    starts = words.select("word", *rest, F.explode(F.sequence(F.lit(0), n - 1)).alias("start")).withColumn("head", F.expr(f"substring(word, start + 1, {HEAD})"))
    short = F.array(*[F.lit(i) for i in range(1, HEAD)])
    heads = F.broadcast(head_table(words.sparkSession, model))  # no more rows than pieces
    spans = starts.join(heads, "head", "left").select("word", *rest, "start", F.explode(F.coalesce("sizes", short)).alias("size"))
    parts = spans.where(F.col("size") <= n - F.col("start")).withColumn("piece", F.expr("substring(word, start + 1, size)"))
    pieces = piece_table(words.sparkSession, model)
    # whatever needs no piece is computed before the join and the piece's bits beside it, since an aggregate evaluates its argument without generated code
    if model.kind == BPE:
        low, high = bit(F.col("start")), bit(F.col("start") + F.col("size"))
        parts = parts.select("*", packed_span(F.col("start"), F.col("size")).alias("span"), low.bitwiseOR(high).alias("ends"), (high - F.shiftleft(low, 1)).alias("inner"))
        pieces = pieces.select("piece", packed_piece(F.col("place"), F.col("id")).alias("bits"))
        none = packed_piece(F.lit(NO_PLACE), F.lit(None).cast("int"))
        edge, known = F.struct(F.coalesce("bits", none).bitwiseOR(F.col("span")).alias("edge"), "ends", "inner"), F.col("bits")
    else:
        parts = parts.withColumn("stop", (F.col("start") + F.col("size")).cast("int"))
        worst = min(s for _, _, s in model.pieces) - UNKNOWN_PENALTY
        edge, known = F.struct((-F.coalesce("score", F.lit(worst))).alias("cost"), "start", "stop", "id"), F.col("id")
    hits = parts.join(F.broadcast(pieces), "piece", "left").where(known.isNotNull() | (F.col("size") == 1))  # at most MAX_PIECES short rows
    return hits.groupBy("word").agg(F.sort_array(F.collect_list(edge)).alias("edges"), *[F.first(c).alias(c) for c in rest])


def bit(i: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("bigint"), i)


def merged(lattice: Column, n: Column) -> Column:
    """Path of a BPE lattice as structs. State: the segment boundaries, one bit each, negative once no edge is left to merge."""

    def fold(s: Column) -> Column:
        def step(bounds: Column, _: Column) -> Column:
            free = F.filter(s, lambda e: (bounds.bitwiseAND(e["ends"]) == e["ends"]) & (F.bit_count(bounds.bitwiseAND(e["inner"])) == 1))
            merge = once(F.get(free, F.lit(0))["inner"], lambda i: F.when(i.isNull(), -bounds).otherwise(bounds.bitwiseAND(F.bitwise_not(i))))
            return F.when(bounds < 0, bounds).otherwise(merge)

        return F.aggregate(F.sequence(F.lit(1), n), bit(n + 1) - 1, step, lambda b: F.abs(b))

    def path(bounds: Column) -> Column:
        on = F.filter(lattice, lambda e: (bounds.bitwiseAND(e["ends"]) == e["ends"]) & (bounds.bitwiseAND(e["inner"]) == 0))
        return F.sort_array(F.transform(on, lambda e: F.struct(start_of(e["edge"]).alias("start"), stop_of(e["edge"]).alias("stop"), id_of(e["edge"]).alias("id"))))

    return once(once(F.filter(lattice, lambda e: e["inner"] != 0), fold), path)


def best_sum(lattice: Column, n: Column) -> Column:
    """Path of a unigram lattice with the largest sum of scores, by Viterbi over the character positions."""
    node = "struct<cost:double,start:int,stop:int,id:int>"
    origin = F.array(F.struct(F.lit(0.0).alias("cost"), F.lit(-1).alias("start"), F.lit(0).alias("stop"), F.lit(None).cast("int").alias("id")).cast(node))

    def forward(nodes: Column, at: Column) -> Column:
        ending = F.transform(
            F.filter(lattice, lambda e: e["stop"] == at),
            lambda e: F.struct((F.element_at(nodes, e["start"] + 1)["cost"] + e["cost"]).alias("cost"), e["start"].alias("start"), e["stop"].alias("stop"), e["id"].alias("id")).cast(node),
        )
        return F.concat(nodes, F.array(F.array_min(ending)))

    def back(nodes: Column) -> Column:
        def step(path: Column, _: Column) -> Column:
            at = F.when(F.size(path) == 0, n).otherwise(F.element_at(path, F.greatest(F.size(path), F.lit(1)))["start"])
            return F.when(at <= 0, path).otherwise(F.concat(path, F.array(F.element_at(nodes, F.greatest(at, F.lit(0)) + 1))))

        return F.reverse(F.aggregate(F.sequence(F.lit(1), n), F.array().cast(f"array<{node}>"), step))

    found = once(F.aggregate(F.sequence(F.lit(1), n), origin, forward), back)
    return F.transform(found, lambda e: F.struct(e["start"].alias("start"), e["stop"].alias("stop"), e["id"].alias("id")))


def fallback_ids(char: Column, model: PieceModel) -> Column:
    """Ids of a character that is no piece: its bytes, or the unknown piece."""
    if not model.byte_ids:
        return F.array(F.lit(model.unknown_id))
    hexed = F.hex(F.encode(char, "UTF-8"))
    at = F.sequence(F.lit(1), F.length(hexed), F.lit(2))
    table_ = F.array(*[F.lit(i) for i in model.byte_ids])
    return F.transform(at, lambda i: F.element_at(table_, F.conv(hexed.substr(i, F.lit(2)), 16, 10).cast("int") + 1))


def encode_words(words: DataFrame, model: PieceModel) -> DataFrame:
    """The rows with ``ids``. ``word`` is normalised, distinct, and has 1 to ``LONG`` characters."""
    rest = [c for c in words.columns if c != "word"]
    fold = merged if model.kind == BPE else best_sum
    path = fold(F.col("edges"), F.length("word"))
    ids = F.flatten(
        F.transform(
            path,
            lambda e: F.when(e["id"].isNotNull(), F.array(e["id"])).otherwise(fallback_ids(F.col("word").substr(e["start"] + 1, F.lit(1)), model)),
        )
    )
    return edges(words, model).select("word", *rest, ids.cast("array<int>").alias("ids"))


def library(module, file: bytes):
    """The library's encoder for a word that is normalised already: without the space in front."""
    from sentencepiece import sentencepiece_model_pb2

    proto = sentencepiece_model_pb2.ModelProto()
    proto.ParseFromString(file)
    proto.normalizer_spec.add_dummy_prefix = False
    return module.SentencePieceProcessor(model_proto=proto.SerializeToString())


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents of a batch by block, compressed: the only form in which texts are shuffled."""
    press = zstandard.ZstdCompressor(level=3)
    for batch in batches:
        block = batch.column(0).to_numpy()
        order = np.argsort(block, kind="stable")
        cuts = np.nonzero(np.diff(block[order]))[0] + 1
        kept = batch.select(list(range(1, batch.num_columns)))
        for rows in np.split(order, cuts) if len(order) else []:
            part = kept.take(pa.array(rows))
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, part.schema) as out:
                out.write_batch(part)
            yield pa.RecordBatch.from_arrays([pa.array([int(block[rows[0]])], pa.int64()), pa.array([press.compress(sink.getvalue())], pa.binary())], ["block", "docs"])


def _planes(values: np.ndarray) -> bytes:
    """Integers by byte, highest bytes apart from lowest, so that they compress well."""
    return np.ascontiguousarray(values.astype("<i4").view(np.uint8).reshape(-1, 4).T).tobytes()


def _from_planes(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, dtype=np.uint8).reshape(4, -1).T).view("<i4").ravel()


def _pack_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``places, ids`` of words to ``block, places, sizes, ids`` of blocks, compressed: the only form in which ids are shuffled."""
    press = zstandard.ZstdCompressor(level=3)
    held: list[tuple[np.ndarray, ...]] = []
    n_held = 0

    def packed() -> Iterator[pa.RecordBatch]:
        where, sizes, starts, flat = [], [], [], []
        at = 0
        for w, z, f, o in held:
            where.append(w), sizes.append(z), flat.append(f), starts.append(o + at)
            at += len(f)
        held.clear()
        where, sizes, starts, flat = map(np.concatenate, (where, sizes, starts, flat))
        order = np.argsort(where)
        where, sizes, starts = where[order], sizes[order], starts[order]
        cuts = [0, *(np.nonzero(np.diff(where >> PLACE_BITS))[0] + 1), len(where)]
        for a, b in zip(cuts[:-1], cuts[1:]):
            own, stop = sizes[a:b], np.cumsum(sizes[a:b])
            ids = flat[np.arange(stop[-1]) + np.repeat(starts[a:b] - (stop - own), own)]
            parts = [np.diff(where[a:b] & PLACE_MASK, prepend=0), own, ids]
            columns = [pa.array([int(where[a] >> PLACE_BITS)], pa.int64()), *(pa.array([press.compress(_planes(x))], pa.binary()) for x in parts)]
            yield pa.RecordBatch.from_arrays(columns, ["block", "places", "sizes", "ids"])

    for batch in batches:
        if not batch.num_rows:
            continue
        blocks, coded = batch.column(0), batch.column(1)
        repeats, starts, sizes = np.diff(blocks.offsets.to_numpy()), coded.offsets.to_numpy().astype(np.int64), np.diff(coded.offsets.to_numpy()).astype(np.int64)
        places = blocks.flatten().to_numpy(zero_copy_only=False)
        held.append((places, np.repeat(sizes, repeats), coded.flatten().to_numpy(zero_copy_only=False), np.repeat(starts[:-1] - starts[0], repeats)))
        n_held += len(places)
        if n_held >= PACKED_IDS:
            yield from packed()
            n_held = 0
    if n_held:
        yield from packed()


def _unpack(blob: bytes) -> pa.Table:
    return pa.ipc.open_stream(zstandard.ZstdDecompressor().decompress(blob)).read_all()


def blocks_of(docs: DataFrame, key: str, text: str, n: int) -> DataFrame:
    """``block, docs``: documents dealt into ``n`` blocks by a hash, packed and shuffled once."""
    rows = docs.select(F.col(key).cast("bigint").alias("doc_id"), F.col(text).cast("string").alias("text"))
    dealt = rows.select(F.pmod(F.xxhash64("doc_id", text_key(F.col("text"))), F.lit(n)).alias("block"), "doc_id", "text")
    return dealt.mapInArrow(_pack, "block bigint, docs binary").repartition(max(n, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))), "block")


def encode(docs: DataFrame, model: PieceModel, key: str = "doc_id", text: str = "text", block_chars: int = BLOCK_CHARS) -> DataFrame:
    """``doc_id, ids, n_tokens, round_trip`` of every row.

    ``round_trip`` tells whether decoding the ids gives the text back (a text that has the space piece's own character does
    not). A null text has null ids, no tokens and a null ``round_trip``; an empty text has no ids. Repeated rows get equal
    results; null ids stay null. Texts are whole, however long, but a document is encoded in one task.
    """
    total = docs.agg(F.sum(F.length(text))).first()[0] or 0
    blocks = blocks_of(docs, key, text, max(1, -(-total // block_chars)))
    word_parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // WORD_CHARS))
    splitter = re.compile(model.pattern)
    tokens, surfaces, dummy = model.tokens, model.surfaces, model.dummy_prefix

    def words_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: set[str] = set()
        current = None

        def told() -> Iterator[pa.RecordBatch]:
            words = block_words({w for t in own for w in splitter.findall(t)})
            own.clear()
            for i in range(0, len(words), 50_000):
                part = words[i : i + 50_000]
                places = (current << PLACE_BITS) + np.arange(i, i + len(part), dtype=np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(places), pa.array(part, pa.string())], ["place", "word"])

        for batch in batches:
            for block, blob in zip(batch.column(0).to_pylist(), batch.column(1)):
                if block != current:
                    yield from told()
                    current = block
                for t in _unpack(blob.as_py()).column("text"):
                    if t.is_valid:
                        own.update(tokens(t.as_py()))
        yield from told()

    file = model.file

    def put_together(left: pa.Table, right: pa.Table) -> pa.Table:
        import sentencepiece

        token, number = numbers(), numbers()
        seen: list[np.ndarray] = []
        for blob in left.column("docs"):
            for t in _unpack(blob.as_py()).column("text"):
                if t.is_valid:
                    own = tokens(t.as_py())
                    seen.append(np.fromiter(map(token.__getitem__, own), dtype=np.int32, count=len(own)))
        n_words, words = array("i"), array("i")
        for t in token:
            own = splitter.findall(t)
            n_words.append(len(own))
            words.extend(map(number.__getitem__, own))
        # the ids of known words come by their places among the block's sorted words; those of long words are added here
        known = block_words(number)
        starts, sizes = np.zeros(len(number), dtype=np.int64), np.full(len(number), -1, dtype=np.int64)
        order = np.fromiter(map(number.__getitem__, known), dtype=np.int64, count=len(known))
        flat, end = [], 0
        for row in right.select(["places", "sizes", "ids"]).to_batches():
            for blobs in zip(*row.columns):
                places, own, ids = (_from_planes(zstandard.ZstdDecompressor().decompress(b.as_py())) for b in blobs)
                at = order[np.cumsum(places, dtype=np.int64)]
                sizes[at], starts[at] = own, end + np.cumsum(own, dtype=np.int64) - own
                flat.append(ids)
                end += len(ids)
        long_words = [w for w in number if len(w) > LONG]
        lib = library(sentencepiece, file) if long_words else None
        for w in long_words:
            ids = np.array(lib.encode(w), dtype=np.int32)
            starts[number[w]], sizes[number[w]] = end, len(ids)
            flat.append(ids)
            end += len(ids)
        if (sizes < 0).any():
            raise ValueError("a word of the block has no ids")
        number.clear()
        flat = np.concatenate([*flat, np.zeros(0, dtype=np.int32)])
        words = np.frombuffer(words, dtype=np.int32) if words else np.zeros(0, dtype=np.int32)
        stops = np.concatenate([[0], np.cumsum(sizes[words])])[np.concatenate([[0], np.cumsum(n_words, dtype=np.int64)])]
        flat, starts, sizes = gathered(flat, starts, sizes, words), stops[:-1], np.diff(stops)
        whole = np.array([decode_ids(flat[a:b].tolist(), surfaces, False) == t.replace(SPACE_PIECE, " ") for t, a, b in zip(token, stops[:-1], stops[1:])], dtype=bool)
        token.clear()

        def trips(text: str, at: np.ndarray, ids: np.ndarray) -> bool:
            """Whether the ids decode to the text: if each token's do, without decoding the text itself."""
            return (SPACE_PIECE not in text and bool(whole[at].all())) or decode_ids(ids.tolist(), surfaces, dummy) == text

        out: list[pa.Table] = []
        numbered = iter(seen)
        for blob in left.column("docs"):
            docs_ = _unpack(blob.as_py())
            found, n, trip = [], [], []
            for t in docs_.column("text"):
                at = next(numbered) if t.is_valid else None
                own = None if at is None else gathered(flat, starts, sizes, at)
                found.append(own)
                n.append(0 if own is None else len(own))
                trip.append(None if own is None else trips(t.as_py(), at, own))
            out.append(
                pa.table({"doc_id": docs_.column("doc_id"), "ids": pa.array(found, pa.list_(pa.int32())), "n_tokens": pa.array(n, pa.int64()), "round_trip": pa.array(trip, pa.bool_())})
            )
        return pa.concat_tables(out) if out else ENCODED.empty_table()

    spark = docs.sparkSession
    spark.conf.set(HASHED_GROUPS, str(max(WORD_CHARS, int(spark.conf.get(HASHED_GROUPS)))))
    pairs = blocks.sortWithinPartitions("block").mapInArrow(words_of, "place bigint, word string").repartition(word_parts, "word")
    where = pairs.groupBy("word").agg(F.collect_list("place").alias("places"))
    meant = encode_words(where, model).select("places", "ids").mapInArrow(_pack_ids, "block bigint, places binary, sizes binary, ids binary")
    both = blocks.groupBy("block").cogroup(meant.groupBy("block"))
    return both.applyInArrow(put_together, "doc_id bigint, ids array<int>, n_tokens bigint, round_trip boolean")


def numbers() -> defaultdict[str, int]:
    """A table that numbers strings as they are asked for."""
    found: defaultdict[str, int] = defaultdict()
    found.default_factory = found.__len__
    return found


def gathered(flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The runs ``at`` of ``flat`` one after the other; run ``i`` has ``sizes[i]`` values from ``starts[i]`` on."""
    n = sizes[at]
    ends = np.cumsum(n)
    return flat[np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts[at] - (ends - n), n)]


def block_words(words: Iterable[str]) -> list[str]:
    """The words of at most ``LONG`` characters in the order that gives their places in a block."""
    return sorted(w for w in words if len(w) <= LONG)


ENCODED = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32())), ("n_tokens", pa.int64()), ("round_trip", pa.bool_())])


def decode_ids(ids: list[int], surfaces: tuple[bytes | None, ...], dummy_prefix: bool) -> str:
    """The text of ids: surfaces and fallback bytes in order, without the space in front; wrong bytes become U+FFFD."""
    text = b"".join([surfaces[i] or b"" for i in ids])
    if dummy_prefix and text[:1] == b" ":
        text = text[1:]
    return text.decode("utf-8", "replace")


def decode(rows: DataFrame, model: PieceModel, ids: str = "ids") -> DataFrame:
    """Add ``decoded`` to rows with an array of ids. Null gives null, an empty array an empty text."""
    names = rows.columns
    surfaces, dummy = model.surfaces, model.dummy_prefix
    fields = ", ".join(f"c{i} {t}" for i, (_, t) in enumerate(rows.dtypes))
    at = names.index(ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [None if v is None else decode_ids(v, surfaces, dummy) for v in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], [f"c{i}" for i in range(len(names))] + ["decoded"])

    return rows.toDF(*[f"c{i}" for i in range(len(names))]).mapInArrow(run, f"{fields}, decoded string").toDF(*names, "decoded")


def model_path() -> str:
    """The installed public model; the path is a parameter of every function above."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


@query("op1_sentencepiece")
def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's ids, and whether they decode to its text."""
    return encode(table(spark, sf_dir, "documents"), load_model(model_path()))
