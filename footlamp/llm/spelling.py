"""Spelling variant grouping by a bit-sliced position index.

For each position and letter the index has a bitset over the words: bit ``k`` is set if word ``k`` has that letter there. A query
word is read letter by letter. The set of words that agree so far, and the three sets that differ by one replaced, one extra or
one missing letter so far, are each a few operations on whole bitsets away from the sets before; words with an extra or missing
letter are looked up one position further or back.

The vocabulary is dealt into groups, each with an index of its own. Of two words that differ by one edit and whose shorter one has
``c`` letters, either the first ``c div 2`` letters are equal or the last ``c - c div 2``. So a word stands in the groups of its first
and of its last letters, for ``c`` its length and one less, and each near pair meets in one of them: in a group of last letters only
pairs with unequal first letters count. A group above ``PART`` words is dealt into parts, and every two parts meet in a task.
"""

from __future__ import annotations

import re
import string
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from footlamp.llm.byte_words import LOWER
from footlamp.llm.importance import CRC32_SQL
from footlamp.llm.registry import query, table
from footlamp.plans.storage import cut_lineage

LETTER = "A-Za-zÀ-ÿ"
RUN = re.compile(f"[{LETTER}]+")
OTHER = re.compile(f"[^{LETTER}]")
#: One run in so many of a document loses a letter.
MODULUS = 97
LEAST_LENGTH = 5
LEAST_COUNT = 3
#: A form has at least so many times the word's count.
RATIO = 2
#: Words of one index, characters of a text looked at together, and words a task counts before it sends them on.
PART = 16_384
SLICE = 1 << 20
HELD = 300_000


def slices(text: str, size: int = SLICE) -> Iterator[str]:
    """Parts of a text of about ``size`` characters that cut no run."""
    at = 0
    while at < len(text):
        cut = at + size
        if cut < len(text):
            found = OTHER.search(text, cut)
            cut = found.start() if found else len(text)
        yield text[at:cut]
        at = cut


def spell(run: str, seed: int) -> str:
    """The run, or without one letter where its CRC-32, which goes on from ``seed``, says so."""
    code = zlib.crc32(run.encode(), seed)
    if code % MODULUS:
        return run
    at = code % len(run)
    return run[:at] + run[at + 1 :]


def document_words(doc_id: int | None, text: str, least: int = LEAST_LENGTH) -> Counter:
    """Counts of a document's words of at least ``least`` letters; a null id counts as empty."""
    runs: Counter = Counter()
    for part in slices(text):
        runs.update(RUN.findall(part.encode().translate(LOWER).decode()))
    seed = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
    words: Counter = Counter()
    for run, n in runs.items():
        word = spell(run, seed)
        if len(word) >= least:
            words[word] += n
    return words


def vocabulary(docs: DataFrame, key: str = "doc_id", text: str = "text", least: int = LEAST_LENGTH, count: int = LEAST_COUNT) -> DataFrame:
    """``word, n`` of all words of at least ``least`` letters that occur ``count`` times or more in all texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def sent(words: Counter) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(words), pa.string()), pa.array(list(words.values()), pa.int64())], ["word", "n"])

        held: Counter = Counter()
        for batch in batches:
            for id_, value in zip(batch.column(0).to_pylist(), batch.column(1)):
                held.update(document_words(id_, value.as_py(), least))
                if len(held) >= HELD:
                    yield sent(held)
                    held = Counter()
        yield sent(held)

    rows = docs.where(F.col(text).isNotNull()).select(F.col(key).cast("bigint").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(run, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= count)


class PositionIndex:
    """Bitsets, as whole numbers, of the words that have a letter at a position, and of those of a length."""

    def __init__(self, words: list[str]):
        width = len(words) + 7 >> 3
        at: dict[tuple[int, str], bytearray] = {}
        lengths: dict[int, bytearray] = {}
        for k, word in enumerate(words):
            byte, bit = k >> 3, 1 << (k & 7)
            for place in enumerate(word):
                bits = at.get(place)
                if bits is None:
                    bits = at[place] = bytearray(width)
                bits[byte] |= bit
            lengths.setdefault(len(word), bytearray(width))[byte] |= bit
        self.at = {place: int.from_bytes(bits, "little") for place, bits in at.items()}
        self.lengths = {n: int.from_bytes(bits, "little") for n, bits in lengths.items()}
        self.every = (1 << len(words)) - 1

    def near(self, word: str, apart: int = 0) -> int:
        """The words one edit away, as a bitset; with ``apart``, only those whose first so many letters are not the word's."""
        at, none = self.at.get, 0
        exact, replaced, extra, missing = self.every, none, none, none
        same = none
        for i, letter in enumerate(word):
            here = at((i, letter), none)
            missing = (missing | exact) & at((i + 1, letter), none)
            extra = extra & at((i - 1, letter), none) | exact
            replaced = replaced & here | exact & ~here
            exact &= here
            if i + 1 == apart:
                same = exact
        n, of = len(word), self.lengths.get
        return (replaced & of(n, none) | extra & of(n - 1, none) | (missing | exact) & of(n + 1, none)) & ~same


def members(bits: int) -> Iterator[int]:
    """Numbers of the set bits."""
    while bits:
        low = bits & -bits
        yield low.bit_length() - 1
        bits ^= low


def group_links(words: list[str], counts: list[int], own: list[bool], shorter: int, first: bool, whole: bool) -> Iterator[tuple[str, int, int, str]]:
    """``word, number of near words, count and name of the best of them`` within one group, for words with any.

    ``shorter`` is the length of the pairs' shorter word. Unless ``whole``, only pairs of a word with ``own`` and one without count.
    """
    index = PositionIndex(words)
    mine = sum(1 << k for k, o in enumerate(own) if o) if not whole else 0
    short, half = index.lengths.get(shorter, 0), 0 if first else shorter // 2
    for word, is_own in zip(words, own):
        found = index.near(word, half)
        if len(word) > shorter:
            found &= short
        if not whole:
            found &= ~mine if is_own else mine
        if found:
            near = [(-counts[k], words[k]) for k in members(found)]
            n, name = min(near)
            yield word, len(near), -n, name


def _group_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lists = batch.column("members")
        flat, ends = lists.values, lists.offsets.to_pylist()
        words, counts, own = (flat.field(c).to_pylist() for c in ("word", "n", "own"))
        out: list[tuple[str, int, int, str]] = []
        for i, (c, first, whole) in enumerate(zip(*(batch.column(x).to_pylist() for x in ("c", "first", "whole")))):
            part = slice(ends[i], ends[i + 1])
            out.extend(group_links(words[part], counts[part], own[part], c, first, whole))
        cols = list(zip(*out)) or [[]] * 4
        types = (pa.string(), pa.int64(), pa.int64(), pa.string())
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(cols, types)], ["word", "n_near", "best_n", "best"])


def near_words(words: DataFrame, least: int = LEAST_LENGTH, part: int = PART) -> DataFrame:
    """``word, n_near, best_n, best`` for the words of ``words`` (``word, n``, distinct) that have a near word."""
    size = F.length("word")
    short, long_ = F.floor(F.col("c") / 2).cast("int"), F.ceil(F.col("c") / 2).cast("int")
    classes = words.select("word", "n", F.explode(F.filter(F.array(size, size - 1), lambda c: c >= least)).alias("c"))
    sides = F.array(F.struct(F.lit(True).alias("first"), F.substring("word", F.lit(1), short).alias("part")), F.struct(F.lit(False).alias("first"), F.substring("word", -long_, long_).alias("part")))
    rows = classes.select("word", "n", "c", F.explode(sides).alias("s")).select("word", "n", "c", "s.first", "s.part")
    keys = ["c", "first", "part"]
    full = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    dealt = rows.join(full, keys).withColumn("parts", F.ceil(F.col("size") / part).cast("int"))
    dealt = dealt.withColumn("mine", F.pmod(F.xxhash64("word"), F.col("parts")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    dealt = dealt.select(
        *keys, F.least("mine", "other").alias("a"), F.greatest("mine", "other").alias("b"),
        F.struct("word", "n", (F.col("mine") <= F.col("other")).alias("own")).alias("member"),
    )
    spread = [*keys, "a", "b"]
    groups = dealt.repartition(*spread).groupBy(*spread).agg(F.collect_list("member").alias("members")).where("size(members) > 1")
    found = groups.select("c", "first", (F.col("a") == F.col("b")).alias("whole"), "members")
    found = found.mapInArrow(_group_links, "word string, n_near bigint, best_n bigint, best string")
    best = F.min(F.struct((-F.col("best_n")).alias("n"), F.col("best").alias("word")))
    per = found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("b"))
    return per.select("word", "n_near", (-F.col("b.n")).alias("best_n"), F.col("b.word").alias("best"))


def roots(forms: DataFrame, rounds: int = 64) -> DataFrame:
    """``word, root`` of ``forms`` (``word, form``): the end of the chain of forms, found by doubling the steps.

    A form has a multiple of the word's count, so chains have no circle and are short.
    """
    at = cut_lineage(forms.select("word", F.coalesce("form", "word").alias("root")))
    for _ in range(rounds):
        further = at.select(F.col("word").alias("root"), F.col("root").alias("next"))
        at = cut_lineage(at.join(further, "root").select("word", F.col("next").alias("root"), (F.col("next") != F.col("root")).alias("moved")))
        if not at.where("moved").limit(1).count():
            return at.select("word", "root")
        at = at.select("word", "root")
    raise RuntimeError(f"forms did not end in {rounds} rounds")


def variants(docs: DataFrame, key: str = "doc_id", text: str = "text", ratio: int = RATIO) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` of every word of the vocabulary of ``docs``.

    Null, empty and letterless texts add no word; no word gives no rows. Repeated rows count as often as they stand. A null id
    counts as an empty one. Only ``key`` and ``text`` are read. Ties go to the word that is first in code-point order.
    """
    words = cut_lineage(vocabulary(docs, key, text))
    joined = words.join(near_words(words), "word", "left")
    has = F.col("best_n") >= ratio * F.col("n")
    found = cut_lineage(joined.select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"), F.when(has, F.col("best")).alias("form"), F.when(has, F.col("best_n")).alias("form_n"),
    ))
    return found.join(roots(found), "word").select("word", "form", "root", "n", "n_near", "form_n")


_UPPER, _LOWER = string.ascii_uppercase, string.ascii_lowercase
SQL = f"""
WITH RECURSIVE r AS (
  SELECT doc_id, run, count(*) AS n FROM (
    SELECT doc_id, unnest(regexp_extract_all(translate(text, '{_UPPER}', '{_LOWER}'), '[A-Za-zÀ-ÿ]+')) AS run FROM documents WHERE text IS NOT NULL)
  GROUP BY doc_id, run),
k AS (SELECT *, coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run AS k FROM r),
h AS (SELECT run, n, {CRC32_SQL.format(x="k")} AS h FROM k),
w AS (SELECT CASE WHEN h % {MODULUS} = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, n FROM h),
v AS MATERIALIZED (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM w WHERE length(word) >= {LEAST_LENGTH} GROUP BY word HAVING sum(n) >= {LEAST_COUNT}),
x AS MATERIALIZED (SELECT word, n, i, substr(word, 1, i) || substr(word, i + 2) AS cut FROM (SELECT *, unnest(range(length(word))) AS i FROM v)),
e AS (
  SELECT a.word, b.word AS other, b.n AS other_n FROM x a JOIN x b ON a.cut = b.cut AND a.i = b.i AND a.word <> b.word AND length(a.word) = length(b.word)
  UNION SELECT x.word, v.word, v.n FROM x JOIN v ON v.word = x.cut
  UNION SELECT v.word, x.word, x.n FROM x JOIN v ON v.word = x.cut),
b AS (SELECT word, count(*) AS n_near, arg_min(other, struct_pack(n := -other_n, w := other)) AS best, max(other_n) AS best_n FROM e GROUP BY word),
f AS MATERIALIZED (
  SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN best_n >= {RATIO} * v.n THEN best END AS form, CASE WHEN best_n >= {RATIO} * v.n THEN best_n END AS form_n
  FROM v LEFT JOIN b USING (word)),
p AS (
  SELECT word, word AS root, form AS next FROM f
  UNION ALL SELECT p.word, p.next, f.form FROM p JOIN f ON f.word = p.next)
SELECT f.word, f.form, p.root, f.n, CAST(f.n_near AS BIGINT) AS n_near, f.form_n FROM f JOIN p USING (word) WHERE p.next IS NULL
"""


@query("op13_spelling", SQL)
def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Variants and forms of all words of the documents."""
    return variants(table(spark, sf_dir, "documents"))
