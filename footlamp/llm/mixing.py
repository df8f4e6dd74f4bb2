"""Mixing sources to target weights by permuted blocks, in DataFrame functions only.

1. The words of a source, document after document, are packed into blocks of ``block`` words.
2. A source's target is a whole number of its blocks: its quota of slots.
3. Every slot of an output shard draws its source by the target shares, so a shard's counts are one
   multinomial draw. Where a source was drawn past its quota, the surplus slots are dealt to the sources that
   were drawn too seldom, so the totals over all shards are the quotas exactly.
4. Slot ``k`` of a source is in pass ``k div blocks`` and reads block ``perm(k mod blocks)``; the permutation
   is a pseudorandom one for each source and pass. Slots and blocks are then joined by block number.

Everything depends on ids and seeds only, so reruns agree.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from footlamp.llm.registry import query, table
from footlamp.llm.words import n_words, once, text_key, word_array
from footlamp.plans.storage import cut_lineage

#: Words in a block and slots in an output shard.
BLOCK = 64
SHARD_SLOTS = 4096
#: No source, block or document is used more often than this.
CAP = 3
#: Equal parts of the line of quotas, by which a draw finds its source with an equi-join.
LOOKUP = 1024
#: Fixed weights, repeating over the sources in code point order, null last.
WEIGHTS = (5, 2, 1)
#: Odd primes above any usual block count; a factor that divides the count is passed over.
PRIMES = (2654435761, 2246822519, 3266489917)


@dataclass
class Mix:
    """``sources``: a row a source. ``placed``: documents with their place in the source's word stream.
    ``slots``: shard, slot, source_no, pass_no, block_no. ``pieces``: the words of a document in a block."""

    sources: DataFrame
    placed: DataFrame
    slots: DataFrame
    pieces: DataFrame


def source_targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP, block: int = BLOCK) -> DataFrame:
    """A row per source: number, size, target, number of blocks and quota of slots.

    Targets share the total of all sizes by weight. A source stops at ``cap`` times its size and the excess is
    shared by weight among the others until none is above: with the sources sorted by cap per weight, the level
    is found at the first source that stays below its cap. The windows see one row a source.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(w).cast("bigint") for w in weights]), (F.col("source_no") % len(weights) + 1).cast("int"))
    per_source = (
        sized.groupBy("source")
        .agg(F.sum("size").alias("source_size"))
        .withColumn("source_no", (F.row_number().over(order) - 1).cast("bigint"))
        .withColumn("weight", weight)
    )
    by_room = Window.orderBy((F.col("source_size") * cap / F.col("weight")).asc(), "source_no")
    before = by_room.rowsBetween(Window.unboundedPreceding, -1)
    from_here = by_room.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    every = Window.partitionBy(F.lit(0))
    level = (F.sum("source_size").over(every) - F.coalesce(F.sum(F.col("source_size") * cap).over(before), F.lit(0))) / F.sum(
        "weight"
    ).over(from_here)
    room = F.col("source_size") * cap / F.col("weight")
    levels = per_source.withColumn("level", level)
    first = F.min(F.when(room >= F.col("level"), F.struct(room.alias("room"), "source_no", "level"))).over(every)
    chosen = levels.withColumn("final", first["level"])
    target = F.least(F.col("source_size") * F.lit(float(cap)), F.coalesce(F.col("final"), F.lit(0.0)) * F.col("weight"))
    blocks = F.ceil(F.col("source_size") / F.lit(block)).cast("bigint")
    quota = F.round(F.try_divide(F.col("target") * F.col("blocks"), F.col("source_size"))).cast("bigint")
    return (
        chosen.withColumn("target", target)
        .withColumn("blocks", blocks)
        .withColumn("quota", F.when(F.col("source_size") > 0, F.least(F.col("blocks") * cap, quota)).otherwise(F.lit(0).cast("bigint")))
        .select("source", "source_no", "source_size", "target", "blocks", "quota")
    )


def place(sized: DataFrame, sources: DataFrame) -> DataFrame:
    """Add ``source_no``, totals and ``start``, the document's first word in its source's stream.

    The stream is ordered by the MD5 of the id. A source is cut into 65,536 ranges of that hash, so that no
    window holds a whole source; range totals carry the sums across.
    """
    joined = sized.join(sources, sized["source"].eqNullSafe(sources["source"])).drop(sources["source"])
    keyed = joined.withColumn("order", F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")))
    keyed = keyed.withColumn("range", F.substring("order", 1, 4))
    inside = Window.partitionBy("source_no", "range").orderBy("order", "doc_id", "size", "key").rowsBetween(Window.unboundedPreceding, -1)
    earlier = Window.partitionBy("source_no").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    local = keyed.withColumn("local", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    ranges = (
        keyed.groupBy("source_no", "range")
        .agg(F.sum("size").alias("words"))
        .select("source_no", "range", F.coalesce(F.sum("words").over(earlier), F.lit(0)).alias("carry"))
    )
    return local.join(ranges, ["source_no", "range"]).withColumn("start", F.col("carry") + F.col("local")).drop("carry", "local", "order", "range")


def unit(seed: int, *of: Column) -> Column:
    """A pseudorandom double in [0, 1) of the given columns."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), *of), 11) / F.lit(float(1 << 53))


def draw_slots(spark: SparkSession, sources: DataFrame, shard_slots: int = SHARD_SLOTS, seed: int = 0) -> DataFrame:
    """``shard, slot, source_no, k``: every source gets each ``k`` below its quota exactly once.

    The running number of a source's slots is a sum of one count for each shard and source, plus the rank
    inside the shard, which has ``shard_slots`` rows.
    """
    total = sources.agg(F.sum("quota")).first()[0] or 0
    quotas = sources.where("quota > 0").select("source_no", "quota")
    line = Window.orderBy("source_no").rowsBetween(Window.unboundedPreceding, -1)
    shares = quotas.select(
        "source_no", "quota",
        F.coalesce(F.sum("quota").over(line), F.lit(0)).alias("low"),
    )
    width = max(1, -(-total // LOOKUP))
    spans = F.sequence(F.floor(F.col("low") / width), F.floor((F.col("low") + F.col("quota") - 1) / width))
    lookup = shares.select("source_no", "low", (F.col("low") + F.col("quota")).alias("high"), F.explode(spans).alias("part"))
    u = F.floor(unit(seed, F.col("id")) * F.lit(total)).cast("bigint")
    drawn = spark.range(total).select("id", u.alias("u")).withColumn("part", F.floor(F.col("u") / width))
    drawn = drawn.join(lookup, "part").where("low <= u AND u < high")
    drawn = drawn.select(
        "source_no", F.floor(F.col("id") / shard_slots).cast("bigint").alias("shard"), (F.col("id") % shard_slots).cast("int").alias("slot")
    )
    counts = drawn.groupBy("source_no", "shard").agg(F.count(F.lit(1)).alias("n"))
    earlier = Window.partitionBy("source_no").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("source_no", "shard", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"))
    inside = Window.partitionBy("source_no", "shard").orderBy("slot")
    ranked = drawn.withColumn("rank", F.row_number().over(inside) - 1).join(bases, ["source_no", "shard"])
    ranked = ranked.join(quotas, "source_no").withColumn("k", F.col("base") + F.col("rank"))
    within = ranked.where("k < quota").select("shard", "slot", "source_no", "k")
    totals = quotas.join(counts.groupBy("source_no").agg(F.sum("n").alias("n")), "source_no", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    totals = totals.select(
        "source_no", "quota", "n",
        F.coalesce(F.sum(F.greatest(F.col("n") - F.col("quota"), F.lit(0))).over(line), F.lit(0)).alias("over"),
        F.coalesce(F.sum(F.greatest(F.col("quota") - F.col("n"), F.lit(0))).over(line), F.lit(0)).alias("under"),
    )
    surplus = ranked.where("k >= quota").join(totals.select("source_no", "over"), "source_no")
    surplus = surplus.select("shard", "slot", (F.col("over") + F.col("k") - F.col("quota")).alias("nth"))
    wanting = totals.where("n < quota").select("source_no", "under", "n", F.explode(F.sequence(F.col("n"), F.col("quota") - 1)).alias("k"))
    wanting = wanting.select("source_no", "k", (F.col("under") + F.col("k") - F.col("n")).alias("nth"))
    return within.unionByName(surplus.join(wanting, "nth").select("shard", "slot", "source_no", "k"))


def permuted(k: Column, blocks: Column, source_no: Column) -> tuple[Column, Column]:
    """Pass number and block number of a source's slot ``k``; products are decimals, so they never overflow."""
    wide = "decimal(19,0)"
    pass_no = ((k - k % blocks) / blocks).cast("bigint")
    turn = [F.element_at(F.array(*[F.lit(PRIMES[(i + j) % 3]) for i in range(3)]), ((source_no + pass_no) % 3 + 1).cast("int")) for j in range(3)]
    factor = F.coalesce(*[F.when(blocks % t != 0, t) for t in turn])
    shift = (source_no + 1) * F.lit(668265263) + pass_no * F.lit(374761393)
    moved = (k % blocks).cast(wide) * factor.cast(wide) + shift.cast(wide)
    return pass_no, (moved % blocks.cast(wide)).cast("bigint")


def plan_mix(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP, block: int = BLOCK, seed: int = 0) -> Mix:
    """Mix documents given as ``doc_id, source, key, size`` (see the module text for the steps).

    A null source is a source of its own, the last. Documents of size 0 (null, empty and blank texts) stay with nothing
    taken. Repeated rows have places of their own. Without a word, or without rows, all targets are 0.
    """
    spark = sized.sparkSession
    sources = cut_lineage(source_targets(sized, weights, cap, block))
    placed = cut_lineage(place(sized, sources))
    pass_no, block_no = permuted(F.col("k"), F.col("blocks"), F.col("source_no"))
    slots = draw_slots(spark, sources, seed=seed).join(sources.select("source_no", "blocks"), "source_no")
    slots = slots.select("shard", "slot", "source_no", pass_no.alias("pass_no"), block_no.alias("block_no"))
    numbers = F.sequence(F.floor(F.col("start") / block).cast("bigint"), F.floor((F.col("start") + F.col("size") - 1) / block).cast("bigint"))
    pieces = placed.where("size > 0").select("source_no", "start", "size", F.explode(numbers).alias("block_no"))
    first = F.greatest(F.col("start"), F.col("block_no") * block)
    last = F.least(F.col("start") + F.col("size"), (F.col("block_no") + 1) * block)
    pieces = pieces.select("source_no", "block_no", "start", (first - F.col("start")).alias("skip"), (last - first).alias("words"))
    return Mix(sources, placed, slots, pieces)


def sized_documents(docs: DataFrame) -> DataFrame:
    """``doc_id, source, key, size`` of documents: one pass over the texts, kept in the shared folder."""
    return cut_lineage(docs.select("doc_id", "source", text_key(F.col("text")).alias("key"), n_words(F.col("text")).alias("size")))


def taken_words(mix: Mix) -> DataFrame:
    """``doc_id, size, source_size, target, taken`` of every row, 0 taken where no block of it is used; null ids stay."""
    used = mix.pieces.join(mix.slots.select("source_no", "block_no"), ["source_no", "block_no"])
    used = used.groupBy("source_no", "start").agg(F.sum("words").alias("taken"))
    used = used.select("source_no", "start", "taken", F.lit(True).alias("full"))
    rows = mix.placed.withColumn("full", F.col("size") > 0).join(used, ["source_no", "start", "full"], "left")
    return rows.select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("bigint").alias("taken"))


def real_keys(rows: DataFrame) -> DataFrame:
    """Add ``no_id, id, no_source, name``: the id and the source as columns without nulls, for joins on them."""
    return rows.select(
        "*", F.col("doc_id").isNull().alias("no_id"), F.coalesce("doc_id", F.lit(0)).alias("id"),
        F.col("source").isNull().alias("no_source"), F.coalesce("source", F.lit("")).alias("name"),
    )


def mix_documents(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP, block: int = BLOCK, seed: int = 0) -> DataFrame:
    """The mix as documents: ``doc_id, text, lang, source, n_chars``, a row for each document and pass.

    A pass that takes a whole document keeps its text; one that takes some of its blocks keeps their words,
    joined by single spaces. Documents of no taken word have no row; so do null, empty and blank texts. Rows
    equal in id, source and text share one text and the smallest language and keep their own blocks. No documents
    give no rows. Whole texts are shuffled once: repeated rows go by the columns that the blocks are then joined on.
    """
    docs = docs.select("doc_id", "text", "lang", "source", "n_chars")
    mix = plan_mix(sized_documents(docs), weights, cap, block, seed)
    used = mix.pieces.join(mix.slots, ["source_no", "block_no"])
    spans = used.groupBy("source_no", "start", "pass_no").agg(
        F.array_sort(F.collect_list(F.struct(F.col("skip").cast("int").alias("skip"), F.col("words").cast("int").alias("words")))).alias("spans"),
        F.sum("words").alias("taken"),
    )
    rows = mix.placed.where("size > 0").join(spans, ["source_no", "start"])
    same = ["no_id", "id", "no_source", "name", "key"]
    texts = real_keys(docs.withColumn("key", text_key(F.col("text")))).groupBy(*same)
    texts = texts.agg(F.first("text").alias("text"), F.min("lang").alias("lang"))
    met = texts.join(real_keys(rows).select(*same, "size", "pass_no", "spans", "taken"), same)
    met = met.withColumn("doc_id", F.when(~F.col("no_id"), F.col("id"))).withColumn("source", F.when(~F.col("no_source"), F.col("name")))
    cut = once(
        word_array(F.col("text")),
        lambda w: F.array_join(F.flatten(F.transform("spans", lambda s: F.slice(w, s["skip"] + 1, s["words"]))), " "),
    )
    text = F.when(F.col("taken") == F.col("size"), F.col("text")).otherwise(cut)
    return met.withColumn("text", text).select("doc_id", "text", "lang", "source", F.length("text").cast("bigint").alias("n_chars"))


SQL = f"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, source, md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS h,
    CAST(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS BIGINT) AS size
  FROM documents),
s0 AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS source_no
  FROM d GROUP BY source),
s1 AS (
  SELECT *, (CASE source_no % 3 WHEN 0 THEN {WEIGHTS[0]} WHEN 1 THEN {WEIGHTS[1]} ELSE {WEIGHTS[2]} END) AS weight FROM s0),
s2 AS (
  SELECT *, source_size * {CAP} / weight AS room,
    (sum(source_size) OVER () - coalesce(sum(source_size * {CAP}) OVER (
       ORDER BY source_size * {CAP} / weight, source_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(weight) OVER (ORDER BY source_size * {CAP} / weight, source_no ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM s1),
s3 AS (
  SELECT *, least(source_size * {CAP}e0, coalesce((SELECT level FROM s2 WHERE room >= level ORDER BY room, source_no LIMIT 1), 0) * weight) AS target,
    CAST(ceil(source_size / {BLOCK}) AS BIGINT) AS blocks
  FROM s2),
s AS (
  SELECT *, CASE WHEN source_size > 0 THEN least(blocks * {CAP}, CAST(round(target * blocks / source_size) AS BIGINT)) ELSE 0 END AS quota
  FROM s3),
k AS (SELECT source_no, blocks, unnest(range(CAST(quota AS BIGINT))) AS k FROM s WHERE quota > 0),
f AS (
  SELECT source_no, blocks, k, (CASE (source_no + k // blocks) % 3 WHEN 0 THEN {PRIMES[0]} WHEN 1 THEN {PRIMES[1]} ELSE {PRIMES[2]} END) AS factor,
    (source_no + 1) * 668265263 + (k // blocks) * 374761393 AS shift FROM k),
used AS (
  SELECT source_no, CAST((CAST(k % blocks AS HUGEINT) * factor + shift) % blocks AS BIGINT) AS block_no, count(*) AS times
  FROM f GROUP BY ALL),
p AS (
  SELECT d.*, s.source_no, s.source_size, s.target,
    CAST(sum(size) OVER (PARTITION BY s.source_no ORDER BY h, doc_id, size, r) - size AS BIGINT) AS start
  FROM d JOIN s ON d.source IS NOT DISTINCT FROM s.source),
b AS (
  SELECT r, source_no, start, size, unnest(range(start // {BLOCK}, (start + size - 1) // {BLOCK} + 1)) AS block_no FROM p WHERE size > 0),
t AS (
  SELECT b.r, sum(used.times * (least(b.start + b.size, (b.block_no + 1) * {BLOCK}) - greatest(b.start, b.block_no * {BLOCK}))) AS taken
  FROM b JOIN used USING (source_no, block_no) GROUP BY b.r)
SELECT p.doc_id, p.size, p.source_size, p.target, CAST(coalesce(t.taken, 0) AS BIGINT) AS taken
FROM p LEFT JOIN t USING (r)
"""


@query("op5_mixing", SQL)
def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words that the mix takes from every document."""
    return taken_words(plan_mix(sized_documents(table(spark, sf_dir, "documents"))))
