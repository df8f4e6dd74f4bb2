"""URL filter rules by hash-prefix lookup, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from footlamp.llm.registry import query, table
from footlamp.llm.words import ascii_lower

#: Hex digits of the short hash that the join uses; the full digest is confirmed afterwards.
PREFIX_HEX = 8
PARTS = r"://([^/?#]*)([^?#]*)"


def url_host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without ``://`` or for null."""
    return F.coalesce(ascii_lower(F.regexp_extract(url, PARTS, 1)), F.lit(""))


def url_path(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; empty without ``://`` or for null."""
    return F.coalesce(F.regexp_extract(url, PARTS, 2), F.lit(""))


def expressions(host: Column, path: Column, labels: list[int], lengths: list[int]) -> Column:
    """All host-suffix and path-prefix expressions of the wanted shapes.

    Only label counts and path lengths that occur in a rule are made, so long hosts and paths cost no more
    than the rules ask for, and none that could match is left out.
    """
    parts = F.split(host, r"\.")
    suffixes = F.filter(
        F.array(*[F.when(F.size(parts) >= n, F.array_join(F.slice(parts, -n, n), ".")) for n in labels]),
        lambda s: s.isNotNull() & (s != ""),
    )
    prefixes = F.filter(
        F.array(*[F.when(F.length(path) >= n, F.substring(path, 1, n)) for n in lengths]), lambda p: p.isNotNull()
    )
    return F.flatten(F.transform(suffixes, lambda s: F.transform(prefixes, lambda p: F.concat(s, p))))


def judge_urls(pages: DataFrame, rules: DataFrame, key: str = "page_id", url: str = "url", default: str = "allow") -> DataFrame:
    """Judge every url: ``key, host, path, rule, verdict``, one row per input row.

    ``rules`` has ``host, path, verdict``. A rule fits its host and all subdomains if the url's path starts
    with the rule's path. The longest rule (host plus path) wins, then the longer host, then ``block``. Without a
    fitting rule ``rule`` is null and ``verdict`` is ``default``.

    Each url is expanded to the expressions that a rule could equal; their SHA-256 is joined with the rules
    on a short prefix and then confirmed in full. Rows are summed per task before that, so a repeated url costs
    one row a task. Rules are joined without a hint: Spark broadcasts them only below its size threshold.

    Null urls, urls without ``://`` and empty hosts fit no rule. Null keys and repeated rows stay, each with
    its verdict. No rules, or no pages, give every page the default, or no rows. Other columns are ignored.
    """
    shapes = rules.select(F.size(F.split("host", r"\.")).alias("n"), F.length("path").alias("l")).distinct().collect()
    wanted_labels = sorted({s["n"] for s in shapes if s["n"] is not None})
    wanted_lengths = sorted({s["l"] for s in shapes if s["l"] is not None})
    base = (
        pages.select(F.col(key).alias("k"), url_host(F.col(url)).alias("host"), url_path(F.col(url)).alias("path"))
        .groupBy("k", "host", "path", F.spark_partition_id().alias("part"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    if not wanted_labels:
        rule, verdict = F.lit(None).cast("string"), F.lit(default)
        judged = base.select("k", "host", "path", "n", rule.alias("rule"), verdict.alias("verdict"))
    else:
        text = F.explode_outer(expressions(F.col("host"), F.col("path"), wanted_labels, wanted_lengths))
        asked = base.select("*", text.alias("text")).withColumn("digest", F.sha2("text", 256))
        asked = asked.withColumn("short", F.substring("digest", 1, PREFIX_HEX))
        known = rules.where(F.col("host").isNotNull() & F.col("path").isNotNull()).select(
            F.sha2(F.concat("host", "path"), 256).alias("rule_digest"),
            F.struct(
                F.length(F.concat("host", "path")).alias("size"),
                F.length("host").alias("host_size"),
                (F.col("verdict") == "block").alias("blocks"),
                F.concat("host", "path").alias("rule"),
                F.col("verdict").alias("verdict"),
            ).alias("found"),
        )
        known = known.withColumn("rule_short", F.substring("rule_digest", 1, PREFIX_HEX))
        confirmed = F.when(F.col("digest") == F.col("rule_digest"), F.col("found"))
        judged = (
            asked.join(known, F.col("short") == F.col("rule_short"), "left")
            .groupBy("k", "host", "path", "part", "n")
            .agg(F.max(confirmed).alias("best"))
            .select(
                "k", "host", "path", "n",
                F.col("best.rule").alias("rule"),
                F.coalesce("best.verdict", F.lit(default)).alias("verdict"),
            )
        )
    repeated = judged.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("n"))))
    return repeated.select(F.col("k").alias(key), "host", "path", "rule", "verdict")


#: Host, path, verdict.
RULES = [
    ("com", "/en/", "block"),
    ("example.com", "/en/7", "allow"),
    ("net", "/de/", "allow"),
    ("example.net", "/de/8", "block"),
    ("org", "/es/", "block"),
]

SQL = """
WITH rules(host, path, verdict) AS (VALUES
  ('com', '/en/', 'block'), ('example.com', '/en/7', 'allow'), ('net', '/de/', 'allow'),
  ('example.net', '/de/8', 'block'), ('org', '/es/', 'block')),
p AS (
  SELECT row_number() OVER () AS r, page_id,
    coalesce(translate(regexp_extract(url, '://([^/?#]*)([^?#]*)', 1),
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
    coalesce(regexp_extract(url, '://([^/?#]*)([^?#]*)', 2), '') AS path
  FROM pages),
m AS (
  SELECT p.r, rules.host || rules.path AS rule, rules.verdict,
    row_number() OVER (PARTITION BY p.r ORDER BY length(rules.host || rules.path) DESC, length(rules.host) DESC) AS n
  FROM p JOIN rules ON (p.host = rules.host OR ends_with(p.host, '.' || rules.host)) AND starts_with(p.path, rules.path))
SELECT p.page_id, p.host, p.path, m.rule, coalesce(m.verdict, 'allow') AS verdict
FROM p LEFT JOIN m ON p.r = m.r AND m.n = 1
"""


@query("op3_url_filters", SQL)
def op3_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's url under the production rules."""
    rows = ", ".join(str(rule) for rule in RULES)
    rules = spark.sql(f"SELECT * FROM VALUES {rows} AS rules(host, path, verdict)")
    return judge_urls(table(spark, sf_dir, "pages"), rules)
