"""Resampling towards a target distribution by importance weights of hashed word n-grams.

Words come from a 256-byte table and ``bytes.split`` (``byte_words``). A feature is a run of one to ``n`` words joined by blanks; its
CRC-32 is that of the run one word shorter, extended by a blank and the next word, so an n-gram costs one short call. Counters
reduce the features of a task to one number a bucket. The corpus and the target then give each bucket a gain, a document's weight
is the floored mean of its features' gains, and adding Gumbel noise to the weights and keeping the highest sums draws documents
without replacement in proportion to their exponentiated weights.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from footlamp.llm.byte_words import slices_of_words
from footlamp.llm.registry import query, table
from footlamp.plans.ordered import number_rows
from footlamp.plans.storage import cut_lineage

#: Words in the longest feature and number of buckets.
LONGEST = 1
BUCKETS = 10_000
#: Percent of the documents of at least ``LEAST_WORDS`` words that is drawn.
PERCENT = 10
LEAST_WORDS = 20
SEED = "2024"
#: Words whose CRC-32 a task remembers; the memory is emptied when full.
MEMORY = 400_000


class Codes(dict):
    """CRC-32 by word, with a bounded memory."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= MEMORY:
            self.clear()
        code = self[word] = zlib.crc32(word)
        return code


def feature_codes(text: bytes, codes: Codes, longest: int = LONGEST) -> Iterator[tuple[int, np.ndarray]]:
    """Number of words and CRC-32 of all features, slice by slice; each feature is in the slice that its last word is in."""
    tail: list[bytes] = []
    for words in slices_of_words(text):
        row = tail + words
        level = [codes[w] for w in row]
        out = level[len(tail) :]
        for k in range(1, longest):
            level = [zlib.crc32(b" " + w, c) for c, w in zip(level, row[k:])]
            out = out + level[max(0, len(tail) - k) :]
        yield len(words), np.fromiter(out, dtype=np.int64, count=len(out))
        tail = row[max(0, len(row) - longest + 1) :] if longest > 1 else []


def bucket_counts(docs: DataFrame, longest: int = LONGEST, buckets: int = BUCKETS, text: str = "text") -> np.ndarray:
    """How many features of all texts fall in each bucket. Tasks send a sum a bucket; the driver gets ``buckets`` rows at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, seen = Codes(), Counter()
        total = np.zeros(buckets, dtype=np.int64)
        for batch in batches:
            for value in batch.column(0):
                for _, found in feature_codes(value.as_py(), codes, longest):
                    seen.update((found % buckets).tolist())
            for bucket, n in seen.items():
                total[bucket] += n
            seen.clear()
        at = np.nonzero(total)[0]
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at], pa.int64())], ["bucket", "n"])

    texts = docs.where(F.col(text).isNotNull()).select(F.col(text).cast("string").cast("binary").alias("text"))
    got = texts.mapInArrow(run, "bucket int, n bigint").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(buckets, dtype=np.int64)
    out[got.column("bucket").to_numpy()] = got.column("n").to_numpy()
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousand times the log ratio of a bucket's smoothed shares of the target and of the corpus, floored."""
    all_s, all_t, b = float(corpus.sum()), float(target.sum()), float(len(corpus))
    ratio = ((target + 1.0) * (all_s + b)) / ((corpus + 1.0) * (all_t + b))
    return np.array([math.floor(1000 * math.log(r)) for r in ratio], dtype=np.int64)


def weigh(docs: DataFrame, gain: np.ndarray, longest: int = LONGEST, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, n_words, n_features, weight`` of every row. The gains, one number a bucket, are broadcast."""
    shared = docs.sparkSession.sparkContext.broadcast(gain)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, codes = shared.value, Codes()
        for batch in batches:
            words, features, weights = [], [], []
            for value in batch.column(1):
                n = many = total = 0
                for count, found in feature_codes(value.as_py() or b"", codes, longest):
                    n += count
                    many += len(found)
                    total += int(own[found % len(own)].sum())
                words.append(n)
                features.append(many)
                weights.append(total // many if many else 0)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(x, pa.int64()) for x in (words, features, weights))], ["doc_id", "n_words", "n_features", "weight"]
            )

    rows = docs.select(F.col(key).cast("bigint").alias("doc_id"), F.col(text).cast("string").cast("binary").alias("text"))
    return rows.mapInArrow(run, "doc_id bigint, n_words bigint, n_features bigint, weight bigint")


def add_noise(weighed: DataFrame, seed: str = SEED) -> DataFrame:
    """Add ``score``: the weight and Gumbel noise that depends on the seed and the id only (a null id counts as empty)."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"), 256)
    u = (F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint") + F.lit(0.5)) / F.lit(4294967296.0)
    return weighed.withColumn("score", F.col("weight") + F.floor(F.lit(-1000.0) * F.log(-F.log(u))).cast("bigint"))


def draw(scored: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS) -> DataFrame:
    """Add ``rank``: 1, 2, 3... for the drawn rows, null for the others.

    Scores are whole numbers in a range that the counts' logarithms bound, so a count a score finds the score that the draw ends
    in. Only rows from there on are numbered, by ranges of equal size and sums of the ranges before; ids break ties, null ids last.
    """
    rows = cut_lineage(scored)
    fit = rows.where(F.col("n_words") >= least_words)
    per = cut_lineage(fit.groupBy("score").agg(F.count(F.lit(1)).alias("n")))
    wanted = (per.agg(F.sum("n")).first()[0] or 0) * percent // 100
    down = Window.orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    last = per.withColumn("upto", F.sum("n").over(down)).where(F.col("upto") >= wanted).agg(F.max("score")).first()[0]
    none = F.lit(None).cast("bigint")
    if not wanted:
        return rows.withColumn("rank", none)
    high = (F.col("n_words") >= least_words) & (F.col("score") >= last)
    top = rows.where(high).withColumn("row", F.monotonically_increasing_id())
    numbered = number_rows(top, [], [F.desc("score"), F.col("doc_id").asc_nulls_last(), "row"], None, "rank").drop("row")
    numbered = numbered.withColumn("rank", F.when(F.col("rank") < wanted, F.col("rank") + 1))
    return numbered.unionByName(rows.where(~high).withColumn("rank", none))


def importance(
    docs: DataFrame, target: DataFrame, longest: int = LONGEST, buckets: int = BUCKETS, percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: str = SEED
) -> DataFrame:
    """``doc_id, n_words, n_features, weight, score, rank`` of every row of ``docs`` against the texts of ``target``.

    Null and wordless texts have no feature, weight 0 and are not drawn while ``least_words`` is above 0. Repeated rows are rows of
    their own with equal scores. Empty tables give no rows or count nothing. Only ``doc_id`` and ``text`` are read.
    """
    gain = gains(bucket_counts(docs, longest, buckets), bucket_counts(target, longest, buckets))
    return draw(add_noise(weigh(docs, gain, longest), seed), percent, least_words)


def resample(docs: DataFrame, target: DataFrame, **options) -> DataFrame:
    """The drawn rows of ``docs``, whole, with ``rank``. Ids should be unique: each row of a drawn id comes once."""
    ranked = importance(docs, target, **options).where("rank IS NOT NULL").groupBy("doc_id").agg(F.min("rank").alias("rank"))
    ranked = ranked.select(F.col("doc_id").alias("drawn_id"), "rank")
    return docs.drop("rank").join(ranked, F.col("doc_id").cast("bigint").eqNullSafe(F.col("drawn_id"))).drop("drawn_id")


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: CRC-32 of UTF-8 bytes, bit by bit, as a DuckDB macro body; ``{x}`` is the text.
CRC32_SQL = (
    "xor(CAST(4294967295 AS BIGINT), list_reduce(list_concat([CAST(4294967295 AS BIGINT)], list_transform(range(octet_length(encode({x}))), "
    "lambda i: CAST(('0x' || substr(hex(encode({x})), CAST(2 * i + 1 AS BIGINT), 2)) AS BIGINT))), "
    "lambda c, b: list_reduce(list_concat([xor(c, b)], range(8)), lambda a, i: CASE WHEN a & 1 = 1 THEN xor(a >> 1, CAST(3988292384 AS BIGINT)) ELSE a >> 1 END)))"
)

SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
g AS (SELECT regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark),
dw AS (SELECT r, word, count(*) AS n FROM (SELECT r, unnest(w) AS word FROM d) GROUP BY r, word),
gw AS (SELECT word, count(*) AS n FROM (SELECT unnest(w) AS word FROM g) GROUP BY word),
words AS MATERIALIZED (SELECT word, {CRC32_SQL.format(x="word")} % {BUCKETS} AS bucket FROM (SELECT word FROM dw UNION SELECT word FROM gw)),
s AS (SELECT bucket, sum(n) AS s FROM dw JOIN words USING (word) GROUP BY bucket),
t AS (SELECT bucket, sum(n) AS t FROM gw JOIN words USING (word) GROUP BY bucket),
totals AS (SELECT (SELECT coalesce(sum(n), 0) FROM dw) AS ss, (SELECT coalesce(sum(n), 0) FROM gw) AS tt),
gain AS (
  SELECT bucket, CAST(floor(1000 * ln(((coalesce(t, 0) + 1)::DOUBLE * (ss + {BUCKETS})::DOUBLE) / ((s + 1)::DOUBLE * (tt + {BUCKETS})::DOUBLE))) AS BIGINT) AS gain
  FROM s LEFT JOIN t USING (bucket), totals),
m AS (
  SELECT r, CAST(sum(n) AS BIGINT) AS n_features, CAST(sum(n * gain) AS BIGINT) AS total
  FROM dw JOIN words USING (word) JOIN gain USING (bucket) GROUP BY r),
x AS (
  SELECT d.r, doc_id, coalesce(n_features, 0) AS n_features,
    CASE WHEN n_features IS NULL THEN 0 WHEN total % n_features < 0 THEN total // n_features - 1 ELSE total // n_features END AS weight,
    CAST(('0x' || substr(sha256('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8)) AS BIGINT) AS h
  FROM d LEFT JOIN m USING (r)),
y AS (SELECT *, weight + CAST(floor(-1000e0 * ln(-ln((h + 0.5e0) / 4294967296e0))) AS BIGINT) AS score FROM x),
z AS (
  SELECT r, row_number() OVER (ORDER BY score DESC, doc_id NULLS LAST, r) AS rank, count(*) OVER () AS n FROM y WHERE n_features >= {LEAST_WORDS})
SELECT y.doc_id, y.n_features, CAST(y.weight AS BIGINT) AS weight, CAST(y.score AS BIGINT) AS score, CASE WHEN z.rank <= z.n * {PERCENT} // 100 THEN z.rank END AS rank
FROM y LEFT JOIN z USING (r)
"""


@query("op12_importance", SQL)
def op12_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's weight against the benchmark texts, and the rank of the drawn ones."""
    found = importance(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_features", "weight", "score", "rank")
