"""SimHash near-duplicates with pivot distance tables.

Fingerprints at ``RADIUS`` or fewer differing bits are linked. Two such fingerprints agree on at least 3 of 6
blocks of bits, and so have equal distances, inside those blocks, to every reference fingerprint. The pivot
table holds these distances; equal ones make a cell, and only fingerprints that share a cell are compared. In
a cell a pair is discarded when its distances to some full-width reference differ by more than the radius (the
triangle inequality), and the survivors are verified bit by bit. No link is lost, whatever the fingerprints are.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from footlamp.llm.components import components
from footlamp.llm.registry import query, table
from footlamp.llm.words import text_key
from footlamp.plans.storage import cut_lineage

SHINGLE = 3
RADIUS = 3
SEED = 42
BLOCKS = 6
#: References inside a cell's blocks, five bits each of the cell number, and references of full width.
CELL_REFERENCES = 11
WIDE_REFERENCES = 16
#: Members of a cell that one task compares at once are at most twice as many.
CELL_PART = 2048
#: Bytes of text that are split into words at once.
SLICE = 4_000_000

_rng = np.random.default_rng(20240229)
REFERENCES = _rng.integers(0, 1 << 64, CELL_REFERENCES + WIDE_REFERENCES, dtype=np.uint64)


def word_slices(text: bytes) -> Iterator[list[bytes]]:
    """The words of a text, a slice of bounded size at a time, cut at white space."""
    at = 0
    while at < len(text):
        end = at + SLICE
        while end < len(text) and text[end] not in b" \t\n\x0b\f\r":
            end += 1
        yield text[at:end].split()
        at = end


def fingerprint(text: bytes, width: int = SHINGLE) -> int:
    """The 64-bit SimHash of the word shingles of a UTF-8 text, as a signed integer."""
    counts, total, tail, short = np.zeros(64, dtype=np.int64), 0, [], True
    for words in word_slices(text.lower()):
        words = tail + words
        if len(words) >= width:
            short = False
            shingles = map(b" ".join, zip(*(words[i:] for i in range(width))))
            h = np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(SEED)), dtype=np.uint64)
            counts += np.unpackbits(h.astype(">u8").view(np.uint8)).reshape(-1, 64).sum(axis=0, dtype=np.int64)
            total += len(h)
        tail = words[-(width - 1) :] if width > 1 else []
    if short:
        if not tail:
            return 0
        whole = xxhash.xxh64_intdigest(b" ".join(tail), SEED)
        return whole - (1 << 64) if whole >> 63 else whole
    return int.from_bytes(np.packbits(2 * counts > total).tobytes(), "big", signed=True)


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = [fingerprint(t.as_py()) if t.is_valid else 0 for t in batch.column(2)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.int64())], ["doc_id", "key", "fp"])


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, key, fp`` of every row; ``key`` is a hash of the text. Null and wordless texts have fingerprint zero."""
    rows = docs.select(F.col(key).cast("bigint").alias("doc_id"), text_key(F.col(text)).alias("key"), F.col(text).cast("binary").alias("text"))
    return rows.mapInArrow(_fingerprints, "doc_id bigint, key bigint, fp bigint")


def signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def cells(distinct: DataFrame) -> DataFrame:
    """``fp, cell``: a cell number for each choice of 3 of 6 blocks, the distances to the references inside those blocks.

    The choices are exploded first, so the plan holds one number's distances and not those of all.
    """
    edges = [64 * i // BLOCKS for i in range(BLOCKS + 1)]
    blocks = [((1 << edges[i + 1]) - (1 << edges[i])) for i in range(BLOCKS)]
    chosen = [signed(sum(c)) for c in combinations(blocks, BLOCKS - RADIUS)]
    each = distinct.select("fp", F.posexplode(F.lit(chosen).cast("array<bigint>")).alias("n", "mask"))
    distances = [F.bit_count(F.col("fp").bitwiseXOR(F.lit(signed(int(r)))).bitwiseAND(F.col("mask"))).cast("bigint") for r in REFERENCES[:CELL_REFERENCES]]
    packed = reduce(lambda a, d: F.shiftleft(a, 5).bitwiseOR(d.bitwiseAND(F.lit(31))), distances, F.col("n").cast("bigint"))
    return each.select("fp", packed.alias("cell"))


def forest(members: np.ndarray, radius: int = RADIUS, rows: int = 256) -> tuple[np.ndarray, np.ndarray]:
    """Links that join the members of a cell exactly as all its near pairs do, at most one fewer than members."""
    wide = REFERENCES[CELL_REFERENCES:]
    table_ = np.bitwise_count(members[:, None] ^ wide[None, :]).astype(np.int8)
    n = len(members)
    label = np.arange(n)
    for at in range(0, n, rows):
        part = slice(at, min(n, at + rows))
        near = np.ones((part.stop - at, n - at), dtype=bool)
        for c in range(WIDE_REFERENCES):
            if c == 4 and not near.any():
                break
            near &= np.abs(table_[part, c][:, None] - table_[None, at:, c]) <= radius
        i, j = np.nonzero(near)
        keep = i < j
        i, j = i[keep] + at, j[keep] + at
        linked = np.bitwise_count(members[i] ^ members[j]) <= radius
        i, j = i[linked], j[linked]
        while True:  # smallest label over the links found so far, with shortcuts
            a, b = label[i], label[j]
            low = np.minimum(a, b)
            if (a == b).all():
                break
            np.minimum.at(label, a, low)
            np.minimum.at(label, b, low)
            while (label[label] != label).any():
                label = label[label]
    moved = np.nonzero(label != np.arange(n))[0]
    return members[moved], members[label[moved]]


def _forests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        us, vs = [np.empty(0, np.uint64)], [np.empty(0, np.uint64)]
        lists = batch.column(0)
        flat = lists.values.to_numpy(zero_copy_only=False).view(np.uint64)
        ends = lists.offsets.to_numpy()
        for a, b in zip(ends[:-1], ends[1:]):
            u, v = forest(np.unique(flat[a:b]))
            us.append(u)
            vs.append(v)
        u, v = np.concatenate(us).view(np.int64), np.concatenate(vs).view(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["u", "v"])


def links(distinct: DataFrame, part: int = CELL_PART) -> DataFrame:
    """Spanning links ``u, v`` of distinct fingerprints ``fp``.

    A cell of more than ``part`` members is dealt into parts and every two of them are compared in a task of
    their own, so no task gets more than about twice ``part`` members and no comparison is left out.
    """
    members = cells(distinct)
    full = members.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    parts = F.ceil(F.col("n") / F.lit(part)).cast("int")
    own = F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int")
    dealt = members.join(full, "cell").withColumn("parts", parts).withColumn("own", own)
    others = F.filter(F.sequence(F.lit(0), F.col("parts") - 1), lambda o: (o != F.col("own")) | (F.col("parts") == 1))
    dealt = dealt.select("cell", "fp", "own", F.explode(others).alias("other"))
    groups = dealt.groupBy("cell", F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b"))
    lists = groups.agg(F.collect_list("fp").alias("members")).where("size(members) > 1").select("members")
    return lists.mapInArrow(_forests, "u bigint, v bigint").distinct()


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, key, fp, component_id`` of every row; ``component_id`` is the smallest id reachable over links.

    Equal fingerprints are one node, however many rows have it. Null ids never name a component that has another
    id; a component of null ids only has a null name. Null, empty and blank texts share fingerprint zero, which
    is linked like any other. Repeated rows get equal results. No rows give no rows.
    """
    rows = cut_lineage(fingerprints(docs, key, text))
    distinct = cut_lineage(rows.groupBy("fp").agg(F.min("doc_id").alias("first")))
    roots = components(links(distinct))
    named = distinct.join(roots, distinct["fp"] == roots["node"], "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    lowest = named.groupBy("root").agg(F.min("first").alias("component_id"))
    names = named.join(lowest, "root").select("fp", "component_id")
    return rows.join(names, "fp").select("doc_id", "key", "fp", "component_id")


def keep_first(docs: DataFrame, found: DataFrame) -> DataFrame:
    """The row of ``docs`` of the smallest id, then the smallest text hash, of each group ``g`` of ``found`` (``doc_id, key, g``)."""
    place = F.struct(F.col("doc_id").isNull(), "doc_id", "key")
    best = found.groupBy("g").agg(F.min(place).alias("best")).select("best.doc_id", "best.key")
    best = best.select(F.coalesce("doc_id", F.lit(0)).alias("id"), F.col("doc_id").isNull().alias("no_id"), "key").distinct()
    ids = {"id": F.coalesce(F.col("doc_id"), F.lit(0)), "no_id": F.col("doc_id").isNull(), "key": text_key(F.col("text"))}
    names = docs.columns
    tagged = docs.select(F.struct(*names).alias("row"), *[c.alias(n) for n, c in ids.items()])
    kept = tagged.join(best, list(ids)).dropDuplicates(list(ids))
    return kept.select("row.*")


def deduplicate(docs: DataFrame) -> DataFrame:
    """One row of each component: the one of the smallest id, then the smallest text hash; other columns stay.

    ``docs`` has the columns of ``documents``. A component of null ids only keeps one of its rows too.
    """
    # a component of null ids has no name, so it goes by its root, which is the fingerprint's own here
    group = F.coalesce(F.col("component_id").cast("string"), F.concat(F.lit("fp"), F.col("fp").cast("string")))
    return keep_first(docs, near_duplicates(docs).withColumn("g", group))


@query("op4_simhash")
def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's fingerprint and component."""
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
