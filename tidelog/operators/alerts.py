"""Rules, their evaluation, and firing/resolved transitions."""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from datetime import datetime

from pyspark import inheritable_thread_target
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from tidelog import schemas
from tidelog.functions import text as X
from tidelog.functions.timing import instant, recent
from tidelog.operators.conditions import CONDITIONS, KEY_SEP, Tables, fires

Moment = datetime | str

# -- fixed values --------------------------------------------------------------------------
MESSAGES = {
    "error_rate": "{service}: {value} errors in the last {window}",
    "crash_loop": "{service}: restarted {value} times in the last {window}",
    "service_down": "{service}: not running",
    "unhealthy": "{service}: health check failing",
    "disk": "disk {value}% full",
    "cpu": "{service}: CPU {value}% sustained",
    "memory": "{service}: memory {value}% of host",
    "latency_p95": "{service}: p95 latency {value} ms",
    "endpoint_latency": "{service}: p95 latency {value} ms",
    "endpoint_errors": "{service}: {value}% of calls failing",
    "traffic_drop": "{service}: requests {value}% below the same {window} last week",
    "cert_expiry": "{service}: TLS certificate expires in {value} days",
}
FIRING_MARK = "🔴 "
RECOVERED_TEXT = "✅ {service}: {name} recovered"

# Kinds whose key is a host or a domain: a service scope does not apply to them.
HOST_KINDS = ["disk", "cert_expiry"]
# Kinds that only see services whose logs are collected.
LOG_KINDS = ["error_rate", "latency_p95", "endpoint_latency", "endpoint_errors", "traffic_drop"]

# (name, kind, threshold, window_secs)
FIRST_RULES = [
    ("Error spike", "error_rate", 20.0, 300),
    ("Crash loop", "crash_loop", 5.0, 600),
    ("Service down", "service_down", 1.0, 60),
    ("Container unhealthy", "unhealthy", 1.0, 300),
    ("Disk pressure", "disk", 85.0, 300),
    ("CPU sustained", "cpu", 90.0, 900),
]
LATER_RULES = [
    ("Certificate expiry", "cert_expiry", 14.0, 86400),
    ("Latency p95", "latency_p95", 2000.0, 900),
    ("Memory sustained", "memory", 90.0, 900),
]
DEFAULT_WINDOW_SECONDS = 300
ANY_SERVICE = "*"
PATCHABLE = ["threshold", "window_secs", "enabled", "silenced_until", "channels"]


# -- evaluation ------------------------------------------------------------------------------


def in_scope(kind: Column, scope: Column, key: Column) -> Column:
    """Does a result key belong to the service a rule was written for?"""
    return (
        (scope == ANY_SERVICE)
        | kind.isin(*HOST_KINDS)
        | (key == scope)
        | F.startswith(key, F.concat(scope, F.lit(KEY_SEP)))
    )


@dataclass
class Evaluation:
    """`firing` (rule_id, kind, key, value), the rules it speaks for, and what went wrong."""

    firing: DataFrame
    evaluated: list[int] = field(default_factory=list)
    failures: dict[int, str] = field(default_factory=dict)


STAGED_AT_ONCE = 4
FIRING_DDL = "rule_id int, kind string, key string, value double"


def evaluate(
    rules: DataFrame,
    tables: Tables,
    as_of: Moment,
    stage: Callable[[DataFrame], DataFrame] | None = None,
) -> Evaluation:
    """All enabled rules against the tables.

    Rules are configuration and choose which plans are built. Rules of one kind and window
    share one plan: its result rows are fanned out to the rules, so nothing is scanned once
    per rule. A rule whose plan cannot be built is reported in `failures` and not counted
    as evaluated, so its state stays as it is. `stage` (such as `session.cut_lineage`) writes the
    result of each plan by a job of its own, a few at a time: then the same holds for a
    condition that fails while it runs.
    """
    spark = rules.sparkSession
    enabled = (
        rules.filter(F.col("enabled"))
        .select(
            "id",
            "kind",
            F.coalesce("threshold", F.lit(0.0)).alias("threshold"),
            F.coalesce("window_secs", F.lit(DEFAULT_WINDOW_SECONDS)).alias("window"),
            F.coalesce("target.service", F.lit(ANY_SERVICE)).alias("scope"),
        )
        .orderBy("id")
        .collect()
    )
    shared: dict[tuple[str, int], list[Row]] = {}
    for rule in enabled:
        if rule["kind"] in CONDITIONS:
            shared.setdefault((rule["kind"], rule["window"]), []).append(rule)

    def measure(one: tuple[tuple[str, int], list[Row]]) -> DataFrame | Exception:
        (kind, window), members = one
        try:
            part = _fan_out(kind, CONDITIONS[kind](tables, window, as_of), members)
            part.schema  # analysed here, so a broken condition only costs its own rules
            return stage(part) if stage else part
        except Exception as problem:  # noqa: BLE001 - one broken rule must not stop the rest
            return problem

    result = Evaluation(spark.createDataFrame([], FIRING_DDL))
    with ThreadPoolExecutor(STAGED_AT_ONCE if stage else 1) as pool:
        parts = list(pool.map(inheritable_thread_target(spark)(measure), shared.items()))
    for members, part in zip(shared.values(), parts):
        ids = [rule["id"] for rule in members]
        if isinstance(part, Exception):
            result.failures.update({i: str(part) for i in ids})
            continue
        result.firing = result.firing.unionByName(part)
        result.evaluated += ids
    return result


def _fan_out(kind: str, measured: DataFrame, members: list[Row]) -> DataFrame:
    as_structs = [
        F.struct(
            F.lit(r["id"]).cast("int").alias("id"),
            F.lit(float(r["threshold"])).alias("threshold"),
            F.lit(r["scope"]).alias("scope"),
        )
        for r in members
    ]
    return (
        measured.filter(F.col("key").isNotNull() & (F.col("key") != ""))
        .withColumn("rule", F.explode(F.array(*as_structs)))
        .filter(fires(kind, F.col("rule.threshold")))
        .filter(in_scope(F.lit(kind), F.col("rule.scope"), F.col("key")))
        .select(F.col("rule.id").alias("rule_id"), F.lit(kind).alias("kind"), "key", "value")
    )


# -- transitions -----------------------------------------------------------------------------


def _value_text(kind: Column, value: Column) -> Column:
    return F.when(kind == "cpu", value.cast("decimal(20,1)").cast("string")).otherwise(
        value.cast("decimal(20,0)").cast("string")
    )


def message(kind: Column, key: Column, value: Column, window_secs: Column) -> Column:
    """Text of a firing alert."""
    template = F.lit("{service}: {value}")
    for name, words in MESSAGES.items():
        template = F.when(kind == name, F.lit(words)).otherwise(template)
    filled = F.replace(template, F.lit("{service}"), key)
    filled = F.replace(filled, F.lit("{value}"), F.coalesce(_value_text(kind, value), F.lit("")))
    return F.replace(filled, F.lit("{window}"), X.human_window(window_secs))


def transitions(
    state: DataFrame,
    firing: DataFrame,
    rules: DataFrame,
    as_of: Moment,
    evaluated: list[int] | None = None,
    host: str = "unknown",
) -> tuple[DataFrame, DataFrame]:
    """(new state, events). Only changes make events: started firing, or recovered.

    State of rules outside `evaluated` is passed on untouched. Silenced rules change state
    and record events too, with `notify` false.
    """
    now = instant(as_of)
    s = state.select(
        "rule_id", F.col("service").alias("key"), F.col("state").alias("was"), "since",
        "notified_at",
    )
    f = firing.select("rule_id", "key", "value", F.lit(True).alias("firing"))
    both = s.join(f, ["rule_id", "key"], "full_outer")
    judged = F.lit(True) if evaluated is None else F.col("rule_id").isin(evaluated)
    is_firing = F.coalesce("firing", F.lit(False))
    was_firing = F.coalesce(F.col("was") == "firing", F.lit(False))
    change = F.when(judged & is_firing & ~was_firing, F.lit("firing")).when(
        judged & ~is_firing & was_firing, F.lit("resolved")
    )
    marked = both.withColumn("change", change)
    new_state = marked.filter(F.col("was").isNotNull() | F.col("change").isNotNull()).select(
        "rule_id",
        F.col("key").alias("service"),
        F.coalesce("change", "was").alias("state"),
        F.when(F.col("change").isNotNull(), now).otherwise(F.col("since")).alias("since"),
        F.when(F.col("change") == "firing", now)
        .otherwise(F.col("notified_at"))
        .alias("notified_at"),
    )
    described = rules.select(
        F.col("id").alias("rule_id"),
        "name",
        "kind",
        "channels",
        F.coalesce("window_secs", F.lit(DEFAULT_WINDOW_SECONDS)).alias("window_secs"),
        F.coalesce(F.col("silenced_until") < now, F.lit(True)).alias("notify"),
    )
    recovered = F.replace(
        F.replace(F.lit(RECOVERED_TEXT), F.lit("{service}"), F.col("key")),
        F.lit("{name}"),
        F.col("name"),
    )
    started = F.concat(
        F.lit(FIRING_MARK),
        message(F.col("kind"), F.col("key"), F.col("value"), F.col("window_secs")),
    )
    is_start = F.col("change") == "firing"
    events = (
        marked.filter(F.col("change").isNotNull())
        .join(described, "rule_id", "left")
        .select(
            now.alias("ts"),
            "rule_id",
            F.col("key").alias("service"),
            F.lit(host).alias("host"),
            F.when(is_start, F.col("value")).alias("value"),
            F.col("change").alias("state"),
            "name",
            "kind",
            F.coalesce("notify", F.lit(True)).alias("notify"),
            "channels",
            F.when(is_start, started).otherwise(recovered).alias("message"),
        )
    )
    return new_state, events


# -- rules -----------------------------------------------------------------------------------


def kinds(spark: SparkSession) -> DataFrame:
    """Kinds the evaluator can run, with their message templates."""
    rows = [(k, MESSAGES.get(k, "")) for k in sorted(CONDITIONS)]
    return spark.createDataFrame(rows, "kind string, describes string")


def _seed(spark: SparkSession, rows: list[tuple], first_id: int) -> DataFrame:
    filled = [
        (first_id + i, name, kind, (ANY_SERVICE,), threshold, secs, [], True, None)
        for i, (name, kind, threshold, secs) in enumerate(rows)
    ]
    return spark.createDataFrame(filled, schemas.schema("alert_rules"))


def seed_default_rules(rules: DataFrame) -> DataFrame:
    """The default rules, each set only where it is missing: six into an empty table, three
    more where no certificate rule exists. Nothing the user changed is added back."""
    spark = rules.sparkSession
    present = rules.agg(
        F.count("*").alias("n"),
        F.coalesce(F.max("id"), F.lit(0)).alias("top"),
        F.count_if(F.col("kind") == "cert_expiry").alias("certs"),
    ).first()
    out, next_id = rules, present["top"] + 1
    if present["n"] == 0:
        out = out.unionByName(_seed(spark, FIRST_RULES, next_id))
        next_id += len(FIRST_RULES)
    if present["certs"] == 0:
        out = out.unionByName(_seed(spark, LATER_RULES, next_id))
    return out


RULE_CHANGE_DDL = (
    "op string, seq int, id int, fields array<string>, name string, kind string, "
    "service string, threshold double, window_secs int, channels array<string>, "
    "enabled boolean, silenced_until timestamp"
)


def apply_rule_changes(
    rules: DataFrame, state: DataFrame, changes: DataFrame
) -> tuple[DataFrame, DataFrame]:
    """(rules, state) after a table of changes (see RULE_CHANGE_DDL).

    op `create` makes a rule (needs a name and a known kind; id is the greatest so far plus
    its `seq` 1, 2, ...), `patch` sets those of the five writable columns that are listed in
    `fields` (NULL is a value), `delete` removes the rule and its state.
    """
    top = rules.agg(F.coalesce(F.max("id"), F.lit(0)).alias("top")).first()["top"]
    name = F.trim(F.coalesce("name", F.lit("")))
    kind = F.trim(F.coalesce("kind", F.lit("")))
    scope = F.coalesce(F.nullif(F.trim("service"), F.lit("")), F.lit(ANY_SERVICE))
    checked_kind = (
        F.when(name == "", F.raise_error(F.lit("name is required")))
        .when(
            ~kind.isin(*CONDITIONS),
            F.raise_error(F.concat(F.lit("no evaluator for kind "), kind)),
        )
        .otherwise(kind)
    )
    created = changes.filter(F.col("op") == "create").select(
        (F.lit(top) + F.col("seq")).cast("int").alias("id"),
        name.alias("name"),
        checked_kind.alias("kind"),
        F.struct(scope.alias("service")).alias("target"),
        "threshold",
        F.coalesce(F.nullif("window_secs", F.lit(0)), F.lit(DEFAULT_WINDOW_SECONDS)).alias(
            "window_secs"
        ),
        F.coalesce("channels", F.array().cast("array<string>")).alias("channels"),
        F.coalesce("enabled", F.lit(True)).alias("enabled"),
        F.lit(None).cast("timestamp").alias("silenced_until"),
    )
    patches = changes.filter(F.col("op") == "patch").select(
        "id",
        F.col("fields").alias("_fields"),
        *[F.col(c).alias(f"_{c}") for c in PATCHABLE],
    )
    gone = changes.filter(F.col("op") == "delete").select("id").distinct()

    patched = rules.join(patches, "id", "left")
    for column in PATCHABLE:
        given = F.coalesce(F.array_contains("_fields", column), F.lit(False))
        patched = patched.withColumn(
            column, F.when(given, F.col(f"_{column}")).otherwise(F.col(column))
        )
    kept = patched.join(gone, "id", "left_anti").select(*rules.columns)
    state_kept = state.join(
        gone.select(F.col("id").alias("rule_id")), "rule_id", "left_anti"
    ).select(*state.columns)
    return kept.unionByName(created), state_kept


def silence(rules: DataFrame, rule_id: int, until: Moment | None) -> DataFrame:
    """No notifications of a rule until a moment; None lifts it."""
    value = F.lit(None).cast("timestamp") if until is None else instant(until)
    return rules.withColumn(
        "silenced_until", F.when(F.col("id") == rule_id, value).otherwise(F.col("silenced_until"))
    )


# -- listings ----------------------------------------------------------------------------------


def list_rules(rules: DataFrame, state: DataFrame) -> DataFrame:
    """Rules with the number of keys firing now."""
    firing = (
        state.filter(F.col("state") == "firing")
        .groupBy(F.col("rule_id").alias("id"))
        .agg(F.count("*").alias("firing"))
    )
    return rules.join(firing, "id", "left").select(
        "id", "name", "kind", "threshold", "window_secs", "enabled", "silenced_until", "channels",
        F.coalesce("firing", F.lit(0)).cast("bigint").alias("firing"),
    ).orderBy("id")


def event_history(events: DataFrame, rules: DataFrame, limit: int = 100) -> DataFrame:
    """The newest events with the rule's name; events of removed rules stay."""
    newest = events.orderBy(F.desc("ts"), "rule_id", "service").limit(limit)
    named = rules.select(F.col("id").alias("rule_id"), "name", "kind")
    return (
        newest.select("ts", "service", "host", "value", "state", "rule_id")
        .join(named, "rule_id", "left")
        .orderBy(F.desc("ts"), "rule_id", "service")
        .select("ts", "service", "host", "value", "state", "name", "kind")
    )


def firing_now(state: DataFrame, rules: DataFrame) -> DataFrame:
    named = rules.select(F.col("id").alias("rule_id"), "name", "kind")
    return (
        state.filter(F.col("state") == "firing")
        .join(named, "rule_id")
        .select("service", "since", "name", "kind")
        .orderBy(F.desc("since"), "service", "name")
    )


def coverage(
    metrics: DataFrame, rules: DataFrame, selected: DataFrame, as_of: Moment
) -> DataFrame:
    """Per service seen in the last hour: which enabled rules see it, and which cannot.

    The rule kinds are configuration and become two literal arrays, so no join with the
    rules is needed.
    """
    enabled = sorted(r["kind"] for r in rules.filter("enabled").select("kind").collect())

    def names(items: list[str]) -> Column:
        return F.array(*[F.lit(i) for i in items]).cast("array<string>")

    log_only = [k for k in enabled if k in LOG_KINDS]
    without_logs = [k for k in enabled if k not in LOG_KINDS]
    services = recent(metrics, as_of, 3600).filter(F.col("service") != "").select("service")
    chosen = selected.select("service").distinct().withColumn("logs", F.lit(True))
    joined = services.distinct().join(chosen, "service", "left")
    logs = F.coalesce("logs", F.lit(False))
    return joined.select(
        "service",
        F.lit(True).alias("metrics"),
        logs.alias("logs"),
        F.when(logs, names(enabled)).otherwise(names(without_logs)).alias("rules"),
        F.when(logs, names([])).otherwise(names(log_only)).alias("unavailable"),
    ).orderBy("service")
