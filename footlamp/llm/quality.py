"""Quality by weak supervision, in DataFrame functions only.

Each rule votes good or bad on a document, or abstains. Expectation-maximisation on the counts of vote patterns
estimates how many documents are good, and how accurate a rule that votes is on good and on bad documents. A
document is kept by its posterior probability of being good, not by passing every rule. No label is used.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from footlamp.llm.registry import query, table
from footlamp.llm.words import SPACE, once, word_array
from footlamp.plans.storage import cut_lineage

SYMBOLS = r"[#*$%&|<>]"
WINDOW = 5
ROUNDS = 20
#: Start values: share of good documents, accuracy of votes on good and on bad documents.
START_GOOD = 0.9
START_ON_GOOD = 0.95
START_ON_BAD = 0.4
#: Bounds. A vote for good never speaks against a document, and most documents are held to be good.
LEAST_ON_GOOD, MOST_ON_GOOD = 0.6, 0.99
LEAST_ON_BAD, MOST_ON_BAD = 0.01, 0.9
LEAST_GOOD, MOST_GOOD = 0.5, 0.98
#: Imagined documents at the start values, so that a rule which seldom votes moves little.
PSEUDO = 20.0
THRESHOLD = 0.5
MAX_REPEAT_PERCENT = 20
LEAST_WORDS = 10


@dataclass(frozen=True)
class Rule:
    """SQL conditions over the base columns, exact in integers; a document that meets neither is no vote."""

    name: str
    good: str
    bad: str


#: A rule's place in this list is its digit in a vote pattern.
RULES = [
    Rule("length", "n_words >= 50", "n_words < 20"),
    Rule("word_size", "word_chars >= 3 * n_words AND word_chars <= 12 * n_words", "word_chars < 2 * n_words OR word_chars > 40 * n_words"),
    Rule("symbols_per_word", "50 * n_symbols <= n_words", "5 * n_symbols >= n_words"),
    Rule("symbols_per_character", "200 * n_symbols <= word_chars", "20 * n_symbols >= word_chars"),
    Rule("lines", "10 * n_dup_lines <= n_lines", "10 * n_dup_lines >= 3 * n_lines AND n_dup_lines >= 2"),
    Rule("repeats", "100 * n_repeat_words <= 5 * n_words", "100 * n_repeat_words > 12 * n_words"),
    Rule("letters", "100 * n_letters >= 94 * word_chars", "100 * n_letters < 90 * word_chars"),
]


def repeat_words(words: Column) -> Column:
    """Words that lie in a 5-word window found twice or more, the first finding included.

    Windows are hashed to 64 bits. Only a document with an equal pair is looked at further: its windows are sorted
    by hash, those with an equal neighbour are put in order of place, and their union is measured.
    """
    hashes = F.transform(
        F.sequence(F.lit(1), F.size(words) - (WINDOW - 1)),
        lambda i: F.xxhash64(*[F.element_at(words, i + j) for j in range(WINDOW)]),
    )

    def covered(h: Column) -> Column:
        placed = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))

        def union(s: Column) -> Column:
            last = F.size(s)
            same = F.transform(
                s,
                lambda x, k: F.when(
                    ((k > 0) & (F.element_at(s, F.greatest(k, F.lit(1)))["h"] == x["h"]))
                    | ((k + 1 < last) & (F.element_at(s, F.least(k + 2, last))["h"] == x["h"])),
                    x["i"],
                ),
            )
            starts = F.array_sort(F.filter(same, lambda i: i.isNotNull()))
            return F.aggregate(
                starts,
                F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")),
                lambda a, i: F.struct(
                    (a["n"] + F.lit(WINDOW) - F.greatest(a["end"] - i, F.lit(0))).alias("n"), (i + F.lit(WINDOW)).alias("end")
                ),
                lambda a: a["n"],
            )

        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(once(placed, union))

    return F.when(F.size(words) < WINDOW, F.lit(0)).otherwise(once(hashes, covered))


def duplicate_lines(lines: Column) -> Column:
    """Number of lines with a word, and of those equal to an earlier one."""
    worded = F.filter(lines, lambda l: l.rlike(rf"[^{SPACE}]"))
    return once(worded, lambda w: F.struct(F.size(w).alias("n_lines"), (F.size(w) - F.size(F.array_distinct(w))).alias("n_dup_lines")))


def base_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add ``n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, n_letters, base_failed``.

    A null text counts as empty. Everything is computed inside a row; nothing is shuffled.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    words = once(word_array(t), lambda w: F.struct(F.size(w).alias("n"), repeat_words(w).alias("repeats")))
    out = docs.select(
        "*",
        words.alias("__w"),
        duplicate_lines(F.split(t, "\n")).alias("__l"),
        (F.length(t) - F.regexp_count(t, F.lit(rf"[{SPACE}]"))).cast("bigint").alias("word_chars"),
        F.regexp_count(t, F.lit(SYMBOLS)).cast("bigint").alias("n_symbols"),
        F.regexp_count(t, F.lit(r"\p{L}")).cast("bigint").alias("n_letters"),
    )
    out = out.withColumns(
        {
            "n_words": F.col("__w.n").cast("bigint"),
            "n_repeat_words": F.col("__w.repeats").cast("bigint"),
            "n_lines": F.col("__l.n_lines").cast("bigint"),
            "n_dup_lines": F.col("__l.n_dup_lines").cast("bigint"),
        }
    )
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return out.drop("__w", "__l").withColumn("base_failed", failed)


def vote_pattern(rules: list[Rule] = RULES) -> Column:
    """The votes as one number: a base-3 digit a rule, 0 bad, 1 none, 2 good."""
    digits = [F.when(F.expr(r.bad), 0).when(F.expr(r.good), 2).otherwise(1) * F.lit(3**i) for i, r in enumerate(rules)]
    return sum(digits[1:], digits[0]).cast("int")


def digit(i: int) -> Column:
    return F.floor(F.col("pattern") / F.lit(3**i)).cast("int") % 3


def slots(n_rules: int) -> Column:
    """0, which every pattern has, then ``3 * rule + digit + 1`` for each rule of column ``pattern``."""
    return F.array(F.lit(0), *[F.lit(3 * i + 1) + digit(i) for i in range(n_rules)])


@dataclass(frozen=True)
class VoteModel:
    """Share of good documents, and a rule's accuracy on good and on bad ones when it votes."""

    good: float
    on_good: tuple[float, ...]
    on_bad: tuple[float, ...]

    def posterior(self, slots: Column) -> Column:
        """Probability of being good for an array of ``slots``; rules count as independent given the truth.

        The numbers go in as two arrays, so that the plan and its code are small and the same whatever they are.
        """
        good = [self.good, *[x for g in self.on_good for x in (1 - g, 1.0, g)]]
        bad = [1 - self.good, *[x for b in self.on_bad for x in (b, 1.0, 1 - b)]]
        g, b = (F.aggregate(F.transform(slots, lambda s: F.element_at(F.lit(of), s + 1)), F.lit(1.0), lambda p, x: p * x) for of in (good, bad))
        return g / (g + b)


def bounded(value: float, least: float, most: float) -> float:
    return min(most, max(least, value))


def vote_sums(patterns: DataFrame, model: VoteModel) -> DataFrame:
    """``slot, n, good, bad``: documents of ``patterns`` (``slots, n``) with each slot, and how many of them are good and bad by the model."""
    p = patterns.select("slots", "n", model.posterior(F.col("slots")).alias("p"))
    each = p.select(F.explode("slots").alias("slot"), "n", (F.col("n") * F.col("p")).alias("good"), (F.col("n") * (1 - F.col("p"))).alias("bad"))
    return each.groupBy("slot").agg(*[F.sum(c).alias(c) for c in ("n", "good", "bad")])


def estimate(patterns: DataFrame, n_rules: int, rounds: int = ROUNDS) -> VoteModel:
    """Expectation-maximisation over ``slots, n``; a round is one aggregate and gives a row for each rule and vote.

    There are at most ``3 ** n_rules`` patterns however many documents there are. Accuracy on bad documents is
    at least what makes a vote for good no evidence against: the share of good votes on good ones, turned round.
    """
    model = VoteModel(START_GOOD, (START_ON_GOOD,) * n_rules, (START_ON_BAD,) * n_rules)
    for _ in range(rounds):
        sums = {r.slot: r for r in vote_sums(patterns, model).collect()}
        if not sums:
            break

        def times(column: str, rule: int, vote: int) -> float:
            return sums[s][column] if (s := 3 * rule + vote + 1) in sums else 0.0

        on_good = [
            bounded((times("good", i, 2) + PSEUDO * START_ON_GOOD) / (times("good", i, 2) + times("good", i, 0) + PSEUDO), LEAST_ON_GOOD, MOST_ON_GOOD)
            for i in range(n_rules)
        ]
        on_bad = [
            bounded((times("bad", i, 0) + PSEUDO * START_ON_BAD) / (times("bad", i, 2) + times("bad", i, 0) + PSEUDO), max(LEAST_ON_BAD, 1 - on_good[i]), MOST_ON_BAD)
            for i in range(n_rules)
        ]
        share = (sums[0]["good"] + PSEUDO * START_GOOD) / (sums[0]["n"] + PSEUDO)
        model = VoteModel(bounded(share, LEAST_GOOD, MOST_GOOD), tuple(on_good), tuple(on_bad))
    return model


def judge(counted: DataFrame, rules: list[Rule] = RULES) -> DataFrame:
    """Add ``kept`` to documents with their base counts, which should be stored: they are read twice.

    The model is estimated on documents that pass the base rules. A document on which no rule votes bad is kept,
    since every rule is held to be better than a coin and most documents to be good.
    """
    voted = counted.withColumn("pattern", vote_pattern(rules))
    patterns = voted.where(~F.col("base_failed")).groupBy("pattern").agg(F.count(F.lit(1)).alias("n"))
    patterns = cut_lineage(patterns.select(slots(len(rules)).alias("slots"), "n").coalesce(1))
    model = estimate(patterns, len(rules))
    kept = ~F.col("base_failed") & (model.posterior(slots(len(rules))) >= THRESHOLD)
    return voted.withColumn("kept", kept).drop("pattern")


def filter_documents(docs: DataFrame) -> DataFrame:
    """The documents that are kept, with their columns; texts are read once and stored with their counts.

    Null, empty and blank texts have no word and go. Repeated rows are judged alike. An empty table stays empty.
    """
    inside = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("text").alias("text"))
    counted = cut_lineage(base_counts(inside).drop("text"))
    return judge(counted).where("kept").select("row.*")


COUNTS = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]


def _sql() -> str:
    """Check SQL: the same counts by lists, and the same rounds of estimation unrolled over the vote patterns."""
    n = len(RULES)
    word = r"[^\x20\x09-\x0D]+"
    votes = " + ".join(f"(CASE WHEN {r.bad} THEN 0 WHEN {r.good} THEN 2 ELSE 1 END) * {3**i}" for i, r in enumerate(RULES))

    def post(m: str) -> str:
        def case(i: int, two: str, none: str) -> str:
            return f"(CASE (pattern // {3**i}) % 3 WHEN 2 THEN {two} WHEN 0 THEN {none} ELSE 1e0 END)"

        good = " * ".join([f"{m}.good"] + [case(i, f"{m}.g{i}", f"(1 - {m}.g{i})") for i in range(n)])
        bad = " * ".join([f"(1 - {m}.good)"] + [case(i, f"(1 - {m}.b{i})", f"{m}.b{i}") for i in range(n)])
        return f"({good}) / ({good} + {bad})"

    def total(i: int, vote: int, weight: str) -> str:
        return f"coalesce(sum(CASE WHEN (pattern // {3**i}) % 3 = {vote} THEN n * {weight} ELSE 0e0 END), 0)"

    start = ", ".join(f"{START_ON_GOOD}e0 AS g{i}, {START_ON_BAD}e0 AS b{i}" for i in range(n))
    steps = [f"m0 AS (SELECT {START_GOOD}e0 AS good, {start})"]
    for k in range(ROUNDS):
        g = ", ".join(
            f"least({MOST_ON_GOOD}e0, greatest({LEAST_ON_GOOD}e0, ({total(i, 2, 'p')} + {PSEUDO * START_ON_GOOD}) / ({total(i, 2, 'p')} + {total(i, 0, 'p')} + {PSEUDO}))) AS g{i}"
            for i in range(n)
        )
        b = ", ".join(
            f"({total(i, 0, '(1 - p)')} + {PSEUDO * START_ON_BAD}) / ({total(i, 2, '(1 - p)')} + {total(i, 0, '(1 - p)')} + {PSEUDO}) AS r{i}" for i in range(n)
        )
        last = ", ".join(f"g{i}, least({MOST_ON_BAD}e0, greatest(greatest({LEAST_ON_BAD}e0, 1 - g{i}), r{i})) AS b{i}" for i in range(n))
        steps.append(
            f"p{k} AS MATERIALIZED (SELECT pattern, n, {post(f'm{k}')} AS p FROM patterns, m{k}),\n"
            f"q{k} AS MATERIALIZED (SELECT least({MOST_GOOD}e0, greatest({LEAST_GOOD}e0, (coalesce(sum(n * p), 0) + {PSEUDO * START_GOOD}) / (coalesce(sum(n), 0) + {PSEUDO}))) AS good, {g}, {b} FROM p{k}),\n"
            f"m{k + 1} AS MATERIALIZED (SELECT good, {last} FROM q{k})"
        )
    return f"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{word}') AS w FROM documents),
g AS (
  SELECT r, i, w[i:i + {WINDOW - 1}] AS g FROM (SELECT r, w, unnest(range(1, len(w) - {WINDOW - 2})) AS i FROM d)),
h AS (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS times FROM g),
s AS (SELECT r, i, lag(i) OVER (PARTITION BY r ORDER BY i) AS before FROM h WHERE times > 1),
x AS (SELECT r, sum(least({WINDOW}, i - coalesce(before, i - {WINDOW}))) AS n_repeat_words FROM s GROUP BY r),
l AS (
  SELECT r, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines
  FROM (SELECT r, unnest(string_split(t, chr(10))) AS line FROM d) WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]') GROUP BY r),
c AS (
  SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
    CAST(len(regexp_extract_all(t, '{SYMBOLS}')) AS BIGINT) AS n_symbols, CAST(len(regexp_extract_all(t, '\\pL')) AS BIGINT) AS n_letters,
    CAST(coalesce(n_lines, 0) AS BIGINT) AS n_lines, CAST(coalesce(n_dup_lines, 0) AS BIGINT) AS n_dup_lines,
    CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words
  FROM d LEFT JOIN x USING (r) LEFT JOIN l USING (r)),
b AS (
  SELECT *, n_words < {LEAST_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words AS base_failed, {votes} AS pattern FROM c),
patterns AS MATERIALIZED (SELECT pattern, count(*) AS n FROM b WHERE NOT base_failed GROUP BY pattern),
{', '.join(steps)}
SELECT {', '.join(COUNTS[:-1])}, NOT base_failed AND {post(f'm{ROUNDS}')} >= {THRESHOLD} AS kept FROM b, m{ROUNDS}
"""


@query("op6_quality_rules", _sql())
def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's counts and whether it is kept."""
    counted = base_counts(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")
    return judge(cut_lineage(counted)).select(*COUNTS)
