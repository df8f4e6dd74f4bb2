"""Error classification, recovery choice and recovery reports."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from footlamp.functions.scalars import any_of, codes
from footlamp.plans.ordered import asof_last


@dataclass(frozen=True)
class Rule:
    """An error matches when its type is listed and a keyword occurs in its message."""

    types: tuple[str, ...]
    keywords: tuple[str, ...]
    category: str
    severity: str


# Classification rules in priority order.
RULES = [
    Rule(("MemoryError", "OutOfMemoryError"), ("memory", "out of memory", "allocation failed"), "system", "high"),
    Rule(("FileNotFoundError", "PermissionError", "IOError"), ("file not found", "permission denied", "no such file"), "input", "medium"),
    Rule(("RuntimeError", "CudaError"), ("cuda", "gpu", "device", "out of memory"), "system", "high"),
    Rule(("ConnectionError", "TimeoutError", "URLError"), ("connection", "timeout", "network", "download"), "network", "medium"),
    Rule(("ImportError", "ModuleNotFoundError"), ("import", "module", "package", "dependency"), "dependency", "high"),
    Rule(("ValueError", "TypeError", "IndexError"), ("invalid", "unsupported", "format", "codec"), "processing", "medium"),
    Rule(("KeyError", "AttributeError", "ConfigurationError"), ("config", "setting", "parameter", "missing"), "configuration", "medium"),
]

# Keyword-only variant.
KEYWORD_RULES = [
    (("config", "setting", "parameter", "invalid"), "configuration", "high"),
    (("memory", "disk", "space", "resource", "gpu", "cuda"), "resource", "medium"),
    (("permission", "access", "network", "connection"), "system", "high"),
    (("process", "encode", "decode", "frame", "audio", "video"), "processing", "high"),
]

# Fixed values: (category, severity) -> primary action, fallbacks, retries.
STRATEGIES = {
    ("system", "high"): ("restore_checkpoint", ["fallback", "abort"], 1),
    ("system", "medium"): ("retry", ["fallback"], 2),
    ("input", "medium"): ("user_intervention", ["skip"], 1),
    ("processing", "medium"): ("fallback", ["retry", "skip"], 3),
    ("network", "medium"): ("retry", ["skip"], 5),
    ("dependency", "high"): ("user_intervention", ["abort"], 1),
    ("configuration", "medium"): ("fallback", ["user_intervention"], 2),
}
DEFAULT_STRATEGY = ("user_intervention", [], 1)


def _class(category: str, severity: str) -> Column:
    return F.struct(F.lit(category).alias("category"), F.lit(severity).alias("severity"))


def classify_errors(errors: DataFrame, rules: list[Rule] | None = None) -> DataFrame:
    """First matching rule per error, over the whole message; no match is unknown / medium.

    Rules are a short list, so they become one CASE expression: the errors are never shuffled or joined.
    """
    text = F.lower("message")
    out = _class("unknown", "medium")
    for rule in reversed(rules or RULES):
        hit = F.col("exception_type").isin(*rule.types) & any_of([text.contains(k) for k in rule.keywords])
        out = F.when(hit, _class(rule.category, rule.severity)).otherwise(out)
    return errors.withColumn("__c", out).select(*errors.columns, "__c.*")


def classify_by_keyword(errors: DataFrame, rules: list | None = None) -> DataFrame:
    """Variant on the message alone; no match is system / medium."""
    text = F.lower("message")
    out = _class("system", "medium")
    for words, category, severity in reversed(rules or KEYWORD_RULES):
        out = F.when(any_of([text.contains(k) for k in words]), _class(category, severity)).otherwise(out)
    return errors.withColumn("__c", out).select(*errors.columns, "__c.*")


def recovery_strategy(classified: DataFrame) -> DataFrame:
    """Primary action, ordered fallbacks and retries per classified error."""

    def as_struct(primary: str, fallbacks: list[str], retries: int) -> Column:
        names = F.array(*[F.lit(f) for f in fallbacks]).cast("array<string>")
        return F.struct(F.lit(primary).alias("primary"), names.alias("fallbacks"), F.lit(retries).alias("retries"))

    pick = as_struct(*DEFAULT_STRATEGY)
    known = F.lit(False)
    for (category, severity), plan in STRATEGIES.items():
        hit = (F.col("category") == category) & (F.col("severity") == severity)
        pick = F.when(hit, as_struct(*plan)).otherwise(pick)
        known = known | hit
    df = classified.withColumn("__s", pick).withColumn("__known", known)
    s = F.col("__s")
    late = (
        F.col("__known")
        & (F.col("progress") > 0.8)
        & (s["primary"] != "restore_checkpoint")
        & ~F.array_contains(s["fallbacks"], "restore_checkpoint")
    )
    step1 = F.when(late, F.array_prepend(s["fallbacks"], F.lit("restore_checkpoint"))).otherwise(s["fallbacks"])
    df = df.withColumn("__f", step1)
    model = F.col("__known") & F.lower("operation").contains("ai_model") & (s["primary"] == "retry")
    return df.select(
        *classified.columns,
        s["primary"].alias("primary_action"),
        F.when(model, F.array_prepend(F.col("__f"), F.lit("fallback"))).otherwise(F.col("__f")).alias("fallbacks"),
        s["retries"].alias("max_retries"),
    )


def resolve_errors(planned: DataFrame, outcomes: DataFrame) -> DataFrame:
    """First action that worked: primary, then fallbacks; skip always works, abort never does.

    ``outcomes`` is (error_id, action, success).
    """
    tries = planned.select(
        "error_id",
        F.posexplode(F.concat(F.array("primary_action"), F.col("fallbacks"))).alias("pos", "action"),
    )
    joined = tries.join(outcomes, ["error_id", "action"], "left")
    worked = (
        F.when(F.col("action") == "skip", True)
        .when(F.col("action") == "abort", False)
        .otherwise(F.coalesce("success", F.lit(False)))
    )
    first = joined.withColumn("__ok", worked).groupBy("error_id").agg(
        F.min_by("action", F.when(F.col("__ok"), F.col("pos"))).alias("resolution"),
        F.bool_or("__ok").alias("resolved"),
        F.min(F.when(F.col("__ok"), F.col("pos") + 1)).alias("n_tried"),
    )
    return first.withColumn("resolution", F.when(F.col("resolved"), F.col("resolution")))


def restore_point(events: DataFrame) -> DataFrame:
    """For every error of an input: the newest checkpoint at or before it, if that one is intact.

    ``events`` holds both kinds: (input, ts, event_id, kind 'checkpoint' | 'error', intact).
    """
    ckpt = F.when(F.col("kind") == "checkpoint", F.struct("event_id", "intact"))
    df = asof_last(events, ["input"], ["ts", "event_id"], None, ckpt, "__ckpt")
    c = F.col("__ckpt")
    return df.where(F.col("kind") == "error").select(
        "event_id",
        "input",
        c["event_id"].alias("newest_checkpoint"),
        F.when(c["intact"], c["event_id"]).alias("restore_from"),
    )


def newest_checkpoint(events: DataFrame) -> DataFrame:
    """Newest checkpoint of each input over all time, usable only when intact."""
    newest = (
        events.where(F.col("kind") == "checkpoint")
        .groupBy("input")
        .agg(F.max_by(F.struct("event_id", "intact"), F.struct("ts", "event_id")).alias("c"))
    )
    return newest.select("input", "c.event_id", F.col("c.intact").alias("usable"))


# Declaration order decides ties.
CATEGORIES = ["system", "input", "processing", "network"]
ACTIONS = ["retry", "fallback", "restore_checkpoint"]


def _rank(name: str, order: list[str]) -> Column:
    return F.coalesce(F.array_position(F.array(*[F.lit(o) for o in order]), F.col(name)), F.lit(999))


def error_stats(resolved: DataFrame) -> DataFrame:
    """Totals by category, by severity and overall in one pass of grouping sets."""
    ok = F.col("resolved")
    per = resolved.groupingSets([["category"], ["severity"], []], "category", "severity").agg(
        F.count(F.lit(1)).alias("n_errors"),
        F.count_if(ok).alias("n_recovered"),
        F.count_if(~ok).alias("n_failed"),
        F.grouping_id().alias("level"),
    )
    return per.withColumn("rate_pct", F.round(F.col("n_recovered") / F.col("n_errors") * 100, 2))


def recovery_metrics(attempts: DataFrame, sessions: DataFrame, since: Column) -> DataFrame:
    """One row of recovery figures since a point in time; no input gives the fixed defaults.

    Grouping sets read the attempts once; their few result rows and the session row fold into one.
    """
    a, s = attempts.where(F.col("ts") >= since), sessions.where(F.col("ts") >= since)
    ok = F.avg(F.col("success").cast("int"))
    per = a.groupingSets([["category"], ["action"], []], "category", "action").agg(
        F.count(F.lit(1)).alias("n"), ok.alias("share"), F.avg("duration_s").alias("seconds"), F.grouping_id().cast("int").alias("level")
    )
    of_sessions = s.agg(
        F.lit(None).cast("string").alias("category"),
        F.lit(None).cast("string").alias("action"),
        F.count(F.lit(1)).alias("n"),
        F.avg(F.col("has_checkpoint").cast("int")).alias("share"),
        F.lit(None).cast("double").alias("seconds"),
        F.lit(-1).alias("level"),
    )
    level = F.col("level")

    def only(value: int, c: str) -> Column:
        return F.max(F.when(level == value, F.col(c)))

    by_count = F.when(level == 1, F.struct("n", -_rank("category", CATEGORIES)))
    by_share = F.when(level == 2, F.struct("share", -_rank("action", ACTIONS)))
    df = per.unionByName(of_sessions).agg(
        F.coalesce(only(3, "n"), F.lit(0)).alias("total_attempts"),
        only(3, "share").alias("success_rate"),
        only(3, "seconds").alias("avg_recovery_s"),
        F.coalesce(only(-1, "n"), F.lit(0)).alias("total_errors"),
        only(-1, "share").alias("checkpoint_rate"),
        F.max_by("category", by_count).alias("most_common_category"),
        F.max_by("action", by_share).alias("best_action"),
    )
    some = (F.col("total_attempts") > 0) & (F.col("total_errors") > 0)

    def kept(c: Column | str, default) -> Column:
        c = F.col(c) if isinstance(c, str) else c
        return F.when(some, c).otherwise(F.lit(default))

    return df.select(
        kept("total_errors", 0).alias("total_errors"),
        kept("total_attempts", 0).alias("total_attempts"),
        kept("success_rate", 0.0).alias("success_rate"),
        kept(F.col("total_attempts") / F.col("total_errors"), 0.0).alias("attempts_per_error"),
        kept("avg_recovery_s", 0.0).alias("avg_recovery_s"),
        kept("checkpoint_rate", 0.0).alias("checkpoint_rate"),
        kept("most_common_category", "system").alias("most_common_category"),
        kept("best_action", "retry").alias("best_action"),
    )


def session_shares(sessions: DataFrame, since: Column) -> DataFrame:
    """Share of sessions by operation and by stage; the window runs over the few result rows."""
    s = sessions.where(F.col("ts") >= since)
    per = s.groupingSets([["operation"], ["stage"]], "operation", "stage").agg(
        F.count(F.lit(1)).alias("n"), F.grouping_id().alias("level")
    )
    total = F.sum("n").over(Window.partitionBy("level"))
    return per.select("operation", "stage", "n", (F.col("n") / total).alias("share"))


def recovery_report(sessions: DataFrame, since: Column, n: int = 10) -> DataFrame:
    """The most frequent operation:stage patterns among unresolved sessions (a top-n report)."""
    bad = sessions.where((F.col("ts") >= since) & (F.col("outcome") != "resolved"))
    pattern = F.concat_ws(":", "operation", "stage")
    counts = bad.groupBy(pattern.alias("pattern")).agg(F.count(F.lit(1)).alias("n"))
    return counts.orderBy(F.desc("n"), "pattern").limit(n)


def recovery_advice(metrics: DataFrame) -> DataFrame:
    return metrics.withColumn(
        "advice",
        codes(
            F.when(F.col("success_rate") < 0.7, F.lit("review_strategies")),
            F.when(F.col("attempts_per_error") > 3.0, F.lit("too_many_attempts")),
            F.when(F.col("checkpoint_rate") < 0.3, F.lit("use_checkpoints")),
        ),
    )
