"""Near copies by exact Jaccard similarity of word shingles, found by prefix filtering.

A text is its set of five-word shingles. Two sets of Jaccard 4/5 or more share one of their first ``n - ceil(4n/5) + 1``
shingles in any order that is the same for all texts, so only sets that share such a shingle are compared, and every one of
them is measured on its whole set. No pair is lost and no link is unverified. The order puts shingles that are common in a
sample last; it decides how many pairs are measured, not which are found. Before that a pair is discarded when parity bitmaps
of the sets differ in more bits than similar sets can (each shingle of one set only changes one bit).

Links are wanted for their components only. So the pivot cells of ``simhash`` come first: sets whose SimHash fingerprints they link
are measured. Then each set is measured against the nearest set, by small bitmaps, that shares a prefix shingle and is not joined
to it yet. What fingerprints and nearest sets leave open is found by comparing all sets of a shingle that are not joined. Sets of
a shingle are compared in parts inside tasks, and only pairs that sizes, places and small bitmaps allow become rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from footlamp.llm import simhash
from footlamp.llm.components import components
from footlamp.llm.simhash import SEED, keep_first, word_slices
from footlamp.llm.words import text_key
from footlamp.plans.storage import cut_lineage, result_only

SHINGLE = 5
#: Least similarity, as a fraction of whole numbers so that it is compared exactly.
LEAST, OF = 4, 5
#: One distinct text of so many is looked at for common shingles; the commonest, at most so many, come last in the order.
SAMPLE = 32
COMMON = 200_000
#: Slots by which texts that are not asked for are left out before a shuffle; so many rows at most are sent to all executors.
SLOTS = 2**20
#: Bits of a set's parity bitmap, and words of 64 bits of the small one, which folds it.
BITS = 2048
SMALL = 8
#: Members of a shingle that one task compares at once are at most about twice as many; so many pairs are compared at once.
PART = 512
PAIRS = 2**19
#: Times each set is measured against its nearest open one.
ROUNDS = 2


def shingle_set(text: bytes, width: int = SHINGLE) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles of a UTF-8 text; a shorter text is one shingle, a wordless one none."""
    parts, tail, short = [], [], True
    for words in word_slices(text.lower()):
        words = tail + words
        if len(words) >= width:
            short = False
            shingles = map(b" ".join, zip(*(words[i:] for i in range(width))))
            parts.append(np.unique(np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(SEED)), dtype=np.uint64)))
            tail = words[-(width - 1) :]
        else:
            tail = words
    if short and tail:
        return np.array([xxhash.xxh64_intdigest(b" ".join(tail), SEED)], dtype=np.uint64)
    return np.unique(np.concatenate(parts)) if parts else np.zeros(0, dtype=np.uint64)


def set_name(members: np.ndarray) -> int:
    """A 64-bit name of a set, as a signed integer."""
    return int(np.uint64(xxhash.xxh64_intdigest(members.tobytes(), SEED)).view(np.int64))


def prefix(members: np.ndarray, common: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The first shingles of a set in the shared order: uncommon ones by hash, then ``common`` ones (sorted) by count."""
    n = len(members)
    if not n:
        return members
    rank = np.zeros(n, dtype=np.int64)
    if len(common):
        at = np.minimum(np.searchsorted(common, members), len(common) - 1)
        rank = np.where(common[at] == members, counts[at], 0)
    return members[np.lexsort((members, rank))[: n - -(-LEAST * n // OF) + 1]]


def bitmap(members: np.ndarray) -> np.ndarray:
    """Parity of the number of shingles that fall on each of ``BITS`` places, packed."""
    odd = (np.bincount((members % np.uint64(BITS)).astype(np.int64), minlength=BITS) & 1).astype(np.uint8)
    return np.packbits(odd).view(np.uint64)


def fingerprint(members: np.ndarray) -> int:
    """The 64-bit SimHash of a set of shingle hashes, as a signed integer; zero for none."""
    counts = np.zeros(64, dtype=np.int64)
    for at in range(0, len(members), 65536):
        counts += np.unpackbits(members[at : at + 65536].astype(">u8").view(np.uint8)).reshape(-1, 64).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > len(members)).tobytes(), "big", signed=True)


def _lists(sets: list[np.ndarray]) -> pa.Array:
    flat = np.concatenate([*sets, np.zeros(0, dtype=np.uint64)]).view(np.int64)
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, sets)]), pa.int32()), pa.array(flat))


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``node, members`` of the first column's texts."""
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            sets = [shingle_set(t.as_py() or b"") for t in batch.column(0).slice(at, 256)]
            yield pa.RecordBatch.from_arrays([pa.array([set_name(s) for s in sets], pa.int64()), _lists(sets)], ["node", "members"])


SET = "node bigint, members array<bigint>"


def common_shingles(docs: DataFrame, text: str = "text") -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes and counts of shingles that several distinct texts of a sample have."""
    some = docs.where(F.pmod(text_key(F.col(text)), F.lit(SAMPLE)) == 0).select(F.col(text).cast("binary").alias("text"))
    members = some.mapInArrow(_sets, SET).dropDuplicates(["node"]).select(F.explode("members").alias("shingle"))
    often = members.groupBy("shingle").agg(F.count(F.lit(1)).alias("n")).where("n > 1").orderBy(F.desc("n"), "shingle").limit(COMMON).toArrow()
    shingle, n = often.column("shingle").to_numpy().view(np.uint64), often.column("n").to_numpy()
    order = np.argsort(shingle)
    return shingle[order], n[order]


def prefixes(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, key, node, n, fp, bits, prefix`` of every row; ``node`` names the text's set, which has ``n`` shingles."""
    shared = docs.sparkSession.sparkContext.broadcast(common_shingles(docs, text))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common, counts = shared.value
        for batch in batches:
            nodes, sizes, prints, bits, first = [], [], [], [], []
            for t in batch.column(2):
                members = shingle_set(t.as_py() or b"")
                nodes.append(set_name(members))
                sizes.append(len(members))
                prints.append(fingerprint(members))
                bits.append(bitmap(members))
                first.append(prefix(members, common, counts))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), *(pa.array(x, pa.int64()) for x in (nodes, sizes, prints)), _lists(bits), _lists(first)],
                ["doc_id", "key", "node", "n", "fp", "bits", "prefix"],
            )

    rows = docs.select(F.col(key).cast("bigint").alias("doc_id"), text_key(F.col(text)).alias("key"), F.col(text).cast("binary").alias("text"))
    return rows.mapInArrow(run, "doc_id bigint, key bigint, node bigint, n bigint, fp bigint, bits array<bigint>, prefix array<bigint>")


def enough(overlap: Column, n: Column, m: Column) -> Column:
    """Whether sets of ``n`` and ``m`` with so many common shingles are similar enough."""
    return (LEAST + OF) * overlap >= LEAST * (n + m)


def _candidates(lists: pa.ListArray) -> Iterator[tuple[np.ndarray, ...]]:
    """``u, v, apart`` of pairs inside lists of members that are not joined and may be similar enough; ``PAIRS`` or so at a time.

    The first shingle that two sets share has only later ones besides, so a pair that is similar enough passes there.
    """
    node, n, at, root, small = lists.flatten().flatten()
    node, n, at, root = (x.to_numpy() for x in (node, n, at, root))
    small = small.flatten().to_numpy().view(np.uint64).reshape(-1, SMALL)
    lengths = lists.value_lengths().to_numpy()
    after = np.repeat(np.cumsum(lengths), lengths) - np.arange(len(node)) - 1
    ends = np.cumsum(after)
    first = 0
    while first < len(node):
        last = max(first + 1, int(np.searchsorted(ends, ends[first] - after[first] + PAIRS, "right")))
        i = np.repeat(np.arange(first, last), after[first:last])
        j = i + 1 + np.arange(len(i)) - np.repeat(ends[first:last] - after[first:last] - (ends[first] - after[first]), after[first:last])
        first = last
        both = n[i] + n[j]
        most = np.minimum(np.minimum(n[i] - at[i], n[j] - at[j]), np.minimum(n[i], n[j]))
        fit = (root[i] != root[j]) & ((LEAST + OF) * most >= LEAST * both)
        i, j, both = i[fit], j[fit], both[fit]
        apart = np.bitwise_count(small[i] ^ small[j]).sum(axis=1, dtype=np.int64)
        fit = (LEAST + OF) * (both - apart) >= 2 * LEAST * both
        yield node[i[fit]], node[j[fit]], apart[fit]


def _all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for u, v, _ in _candidates(batch.column(0)):
            pairs = np.unique(np.stack([np.minimum(u, v), np.maximum(u, v)]), axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(pairs[1])], ["u", "v"])


def _nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One pair at most for each member of a batch: the one with the nearest other."""
    for batch in batches:
        best = [np.empty(0, np.int64)] * 3
        for u, v, apart in _candidates(batch.column(0)):
            u, v, apart = (np.concatenate([b, *x]) for b, x in zip(best, ((u, v), (v, u), (apart, apart))))
            order = np.lexsort((v, apart, u))
            u, v, apart = u[order], v[order], apart[order]
            first = np.append(True, u[1:] != u[:-1])[: len(u)]
            best = [u[first], v[first], apart[first]]
        pairs = np.unique(np.stack([np.minimum(best[0], best[1]), np.maximum(best[0], best[1])]), axis=1)
        yield pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(pairs[1])], ["u", "v"])


def compared(postings: DataFrame, nodes: DataFrame, nearest: bool) -> DataFrame:
    """Distinct pairs ``u, v`` that share a shingle of ``postings`` (``shingle, node, n, at, root``), have two roots and may be similar.

    All of them, or only some of the nearest. A shingle of more than ``PART`` members is dealt into parts and every two of
    them are compared, so no task gets more than about twice ``PART`` members at once and no comparison is left out.
    """
    full = postings.groupBy("shingle").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count(F.lit(1)).alias("count"))
    full = full.where("low <> high").select("shingle", F.ceil(F.col("count") / F.lit(PART)).cast("int").alias("parts"))
    dealt = postings.join(full, "shingle").join(nodes.select("node", "small"), "node")
    dealt = dealt.withColumn("own", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
    others = F.filter(F.sequence(F.lit(0), F.col("parts") - 1), lambda o: (o != F.col("own")) | (F.col("parts") == 1))
    dealt = dealt.select("shingle", F.struct("node", "n", "at", "root", "small").alias("member"), "own", F.explode(others).alias("other"))
    groups = dealt.groupBy("shingle", F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b"))
    lists = groups.agg(F.collect_list("member").alias("members")).where("size(members) > 1").select("members")
    return lists.mapInArrow(_nearest if nearest else _all, "u bigint, v bigint").distinct()


def alike(nodes: DataFrame) -> DataFrame:
    """Pairs ``u, v`` of nodes by the pivot cells of ``simhash``: each with the first of its fingerprint, and first ones of linked fingerprints."""
    firsts = cut_lineage(nodes.groupBy("fp").agg(F.min("node").alias("first")))
    same = nodes.join(firsts, "fp").where("node <> first").select(F.col("first").alias("u"), F.col("node").alias("v"))
    a, b = (firsts.select(F.col("fp").alias(x), F.col("first").alias(f"first_{x}")) for x in "uv")
    linked = simhash.links(firsts.select("fp")).join(a, "u").join(b, "v")
    return same.unionByName(linked.select(F.least("first_u", "first_v").alias("u"), F.greatest("first_u", "first_v").alias("v")))


def bits_allow(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """The ``pairs`` whose bitmaps allow enough common shingles."""
    a = nodes.select(F.col("node").alias("u"), F.col("n"), F.col("bits").alias("a"))
    b = nodes.select(F.col("node").alias("v"), F.col("n").alias("m"), F.col("bits").alias("b"))
    apart = F.aggregate(F.zip_with("a", "b", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)
    both = pairs.join(a, "u").join(b, "v")
    return both.where(enough((F.col("n") + F.col("m") - apart) / 2, F.col("n"), F.col("m"))).select("u", "v")


def only_asked(texts: DataFrame, asked: DataFrame) -> DataFrame:
    """Rows of ``texts`` that ``asked`` names, and few others: those that share a slot. An exact join has to follow."""
    slot = F.pmod(F.xxhash64("no_id", "id", "key"), F.lit(SLOTS))
    return texts.withColumn("slot", slot).join(F.broadcast(asked.select(slot.alias("slot")).distinct()), "slot", "left_semi").drop("slot")


def verified(pairs: DataFrame, nodes: DataFrame, texts: DataFrame) -> DataFrame:
    """The ``pairs`` whose whole sets are similar enough; sets are made again from one of ``texts`` for each node asked for."""
    pairs = cut_lineage(bits_allow(pairs, nodes))
    asked = cut_lineage(pairs.select(F.explode(F.array("u", "v")).alias("node")).distinct().join(nodes.select("node", "first"), "node").select("first.*"))
    sets = cut_lineage(only_asked(texts, asked).join(asked, ["no_id", "id", "key"]).select("text").mapInArrow(_sets, SET).dropDuplicates(["node"]))
    a = sets.select(F.col("node").alias("u"), F.col("members").alias("a"))
    b = sets.select(F.col("node").alias("v"), F.col("members").alias("b"))
    both = pairs.join(a, "u").join(b, "v")
    return both.where(enough(F.size(F.array_intersect("a", "b")), F.size("a"), F.size("b"))).select("u", "v")


def links(postings: DataFrame, nodes: DataFrame, texts: DataFrame) -> DataFrame:
    """Links ``u, v`` that join the nodes of ``postings`` (``shingle, node, n, at``) exactly as all similar pairs do.

    The pairs, sets and rooted postings of a step are deleted before the next one, so only the links of all steps add up on disk.
    """
    spark = postings.sparkSession
    open_ = nodes.join(postings.select("node").distinct(), "node", "left_semi")
    found = result_only(spark, lambda: verified(alike(open_.select("node", "fp")), nodes, texts))
    for nearest in [True] * ROUNDS + [False]:
        found = found.unionByName(result_only(spark, lambda: verified(open_pairs(postings, found, nodes, nearest), nodes, texts)))
    return found


def open_pairs(postings: DataFrame, found: DataFrame, nodes: DataFrame, nearest: bool) -> DataFrame:
    """``compared`` pairs of nodes that the links ``found`` do not join yet."""
    roots = cut_lineage(components(found)).select("node", "root")
    rooted = postings.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    return compared(cut_lineage(rooted), nodes, nearest)


def near_copies(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, key, g`` of every row; rows of one ``g`` are joined by texts of Jaccard 4/5 or more.

    Null, empty and blank texts have the empty set, which equals only itself. Null ids stay, repeated rows are in one group,
    and an empty table gives no rows. Postings, pairs and sets are deleted once the groups are written.
    """
    return result_only(docs.sparkSession, lambda: grouped(docs, key, text))


def grouped(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """As ``near_copies``, with all tables on the way left in the scratch folder."""
    rows = cut_lineage(prefixes(docs, key, text))
    place = F.struct(F.col("doc_id").isNull().alias("no_id"), F.coalesce("doc_id", F.lit(0)).alias("id"), "key")
    nodes = rows.groupBy("node").agg(F.min(place).alias("first"), *[F.first(c).alias(c) for c in ("n", "fp", "bits")])
    words = [reduce(Column.bitwiseXOR, [F.col("bits")[at] for at in range(w, BITS // 64, SMALL)]) for w in range(SMALL)]
    nodes = cut_lineage(nodes.withColumn("small", F.array(*words)))
    postings = rows.select("node", "n", F.posexplode("prefix").alias("at", "shingle"))
    shared = postings.groupBy("shingle").agg(F.min("node").alias("low"), F.max("node").alias("high")).where("low <> high").select("shingle")
    postings = cut_lineage(postings.join(cut_lineage(shared), "shingle").distinct())
    texts = docs.select(
        F.col(key).isNull().alias("no_id"), F.coalesce(F.col(key).cast("bigint"), F.lit(0)).alias("id"), text_key(F.col(text)).alias("key"), F.col(text).cast("binary").alias("text")
    )
    roots = components(links(postings, nodes, texts))
    named = rows.select("doc_id", "key", "node").join(roots, "node", "left")
    return named.select("doc_id", "key", F.coalesce("root", "node").alias("g"))


def deduplicate(docs: DataFrame) -> DataFrame:
    """One row of each group of near copies: the one of the smallest id, then the smallest text hash; other columns stay.

    Repeated rows and null ids as in ``simhash.keep_first``; an empty table gives no rows.
    """
    return keep_first(docs, near_copies(docs))
