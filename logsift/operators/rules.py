"""Detection rules over events: failed-login bursts, source spikes, odd ports, risky commands."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from logsift import fixed
from logsift.functions.arrays import kept
from logsift.operators.numbering import micros


@dataclass(frozen=True)
class RuleSettings:
    failed_login_threshold: int = fixed.FAILED_LOGIN_THRESHOLD
    failed_login_seconds: int = fixed.FAILED_LOGIN_WINDOW_SECONDS
    spike_threshold: int = fixed.SPIKE_THRESHOLD
    spike_seconds: int = fixed.SPIKE_WINDOW_SECONDS
    slab_seconds: int = 60


def auth_failure() -> Column:
    """Failure named in the action or type, or an error in an authentication event."""
    low = lambda c: F.lower(F.coalesce(F.col(c), F.lit("")))
    action, kind = low("action"), low("event_type")
    return (
        F.contains(action, F.lit("fail")) | F.contains(kind, F.lit("fail"))
        | ((low("severity") == "error") & kind.rlike("auth|login"))
    )


def trailing_counts(df: DataFrame, key: str, time: str, event_id: str, counts: dict[str, tuple[Column, int]],
                    slab_seconds: int = 60) -> DataFrame:
    """Add one column per entry of `counts`: name -> (which rows count, window in seconds).

    The value is how many such rows of the same key lie in the trailing window, both ends
    included, up to and including this row; rows at the same time are taken in `event_id` order.

    Each counted row is +1 at its time and -1 once its window has passed, so a running sum is the
    answer: one sort, no per-row rescan of the window. All windows share that one sort. Every key is
    cut into time slabs, whose net sums, aggregated before they are shuffled, are carried forward, so
    a key with most of the rows is many groups. Rows without key or time get null and are spread by
    a hash.
    """
    placed = df.withColumn("_t", micros(F.col(time)))
    usable = (F.coalesce(F.col(key), F.lit("")) != "") & F.col("_t").isNotNull()
    placed = placed.withColumn("_ok", usable)

    names = list(counts)
    for name in names:
        rows, _seconds = counts[name]
        placed = placed.withColumn(f"_d_{name}", (F.col("_ok") & F.coalesce(rows, F.lit(False))).cast("int"))

    # One row per event (step 0) and per expiry of a counted event (step 1), without a second scan.
    zero = {n: F.lit(0) for n in names}
    steps = [(F.lit(True), F.struct(F.lit(0).alias("step"), F.col("_t").alias("at"),
                                    *[F.col(f"_d_{n}").alias(f"d_{n}") for n in names]))]
    for name in names:
        delta = {**zero, name: F.lit(-1)}
        steps.append((F.col(f"_d_{name}") == 1, F.struct(
            F.lit(1).alias("step"), (F.col("_t") + counts[name][1] * 1_000_000).alias("at"),
            *[delta[n].alias(f"d_{n}") for n in names])))
    payload = [c for c in df.columns if c != key]
    moves = placed.withColumn("_s", F.explode(kept(steps)))
    is_event = F.col("_s.step") == 0
    width = slab_seconds * 1_000_000
    slab = (
        F.when(~F.col("_ok"), -1 - F.pmod(F.xxhash64(F.col(event_id)), F.lit(4096)))
        .otherwise(F.floor(F.col("_s.at") / width))
    )
    moves = moves.select(
        F.col(key), F.col("_ok"), slab.alias("_slab"), F.col("_s.at").alias("_at"), F.col("_s.step").alias("_step"), F.col(event_id).alias("_id"),
        *[F.col(f"_s.d_{n}").alias(f"_d_{n}") for n in names],
        *[F.when(is_event, F.col(c)).alias(c) for c in payload],
    )
    sums = [f"_d_{n}" for n in names]
    net = moves.filter("_ok").groupBy(key, "_slab").agg(*[F.sum(s).alias(s) for s in sums])
    earlier = W.partitionBy(key).orderBy("_slab").rowsBetween(W.unboundedPreceding, -1)
    carried = net.select(key, "_slab", *[F.coalesce(F.sum(s).over(earlier), F.lit(0)).alias(f"{s}_b") for s in sums])
    inside = W.partitionBy(key, "_slab").orderBy("_at", "_step", "_id").rowsBetween(W.unboundedPreceding, 0)
    run = moves
    for s in sums:
        run = run.withColumn(f"{s}_r", F.sum(s).over(inside))
    run = run.filter("_step = 0").join(carried, [key, "_slab"], "left")
    total = lambda n: F.when(
        F.col("_ok"), (F.col(f"_d_{n}_r") + F.coalesce(F.col(f"_d_{n}_b"), F.lit(0))).cast("bigint"))
    return run.select(*df.columns, *[total(n).alias(n) for n in names])


def with_rule_counts(events: DataFrame, settings: RuleSettings = RuleSettings(), time: str = "event_ts") -> DataFrame:
    """Add `auth_failed`, `failed_count` and `spike_count`."""
    marked = events.withColumn("auth_failed", auth_failure())
    return trailing_counts(
        marked, "source_ip", time, "event_id",
        {"failed_count": (F.col("auth_failed"), settings.failed_login_seconds),
         "spike_count": (F.lit(True), settings.spike_seconds)},
        settings.slab_seconds,
    )


def rule_failed_login(events: DataFrame, settings: RuleSettings = RuleSettings(), time: str = "event_ts") -> DataFrame:
    """Failed logins that complete a burst from one source, with the number in the window."""
    failures = events.filter(auth_failure())
    counted = trailing_counts(failures, "source_ip", time, "event_id",
                              {"failed_count": (F.lit(True), settings.failed_login_seconds)},
                              settings.slab_seconds)
    return counted.filter(F.col("failed_count") >= settings.failed_login_threshold)


def rule_ip_spike(events: DataFrame, settings: RuleSettings = RuleSettings(), time: str = "event_ts") -> DataFrame:
    """Events of a source that has sent too many within the window."""
    counted = trailing_counts(events, "source_ip", time, "event_id",
                              {"spike_count": (F.lit(True), settings.spike_seconds)},
                              settings.slab_seconds)
    return counted.filter(F.col("spike_count") >= settings.spike_threshold)


def abnormal_port() -> Column:
    port, protocol = F.col("destination_port"), F.lower(F.col("protocol"))
    odd = ((protocol == "http") & ~port.isin(*fixed.HTTP_PORTS)) | ((protocol == "ssh") & (port != fixed.SSH_PORT))
    return F.coalesce((port != 0) & odd, F.lit(False))


def command_text() -> Column:
    """The command of an event in lower case, empty where there is none."""
    ext = F.col("extensions")
    return F.lower(F.coalesce(F.nullif(ext["command"], F.lit("")), ext["process_command_line"], F.lit("")))


def suspicious_command() -> Column:
    found = F.lit(False)
    for part in fixed.SUSPICIOUS_COMMANDS:
        found = found | F.contains(command_text(), F.lit(part))
    return found


def rule_abnormal_port(events: DataFrame) -> DataFrame:
    return events.filter(abnormal_port())


def rule_suspicious_command(events: DataFrame) -> DataFrame:
    return events.filter(suspicious_command())


def apply_rules(counted: DataFrame, settings: RuleSettings = RuleSettings()) -> DataFrame:
    """Add rule_matches, rule_reasons, detected and rule_command to the output of `with_rule_counts`.

    The reason shows the beginning of a risky command; `rule_command` has the whole of it.
    """
    text = lambda *parts: F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])
    num = lambda c: F.col(c).cast("string")
    ip = F.col("source_ip")
    rules = [
        ("repeated_failed_login",
         F.col("auth_failed") & (F.col("failed_count") >= settings.failed_login_threshold),
         text(num("failed_count"), " failed login events from ", ip, f" within {settings.failed_login_seconds}s")),
        ("source_ip_spike", F.col("spike_count") >= settings.spike_threshold,
         text("Excessive activity: ", num("spike_count"), " events from ", ip, f" within {settings.spike_seconds}s")),
        ("abnormal_destination_port", abnormal_port(),
         text("Port ", num("destination_port"), " is unusual for protocol ", F.lower(F.col("protocol")))),
        ("suspicious_command", suspicious_command(),
         text("Suspicious command execution detected: ", F.substring(command_text(), 1, 50))),
    ]
    hits = kept([(test, F.struct(F.lit(name).alias("name"), reason.alias("reason"))) for name, test, reason in rules])
    found = counted.withColumn("_hits", hits)
    # A field of an array of structs is the array of that field.
    return (
        found.withColumn("rule_matches", F.col("_hits.name")).withColumn("rule_reasons", F.col("_hits.reason"))
        .withColumn("detected", F.size("_hits") > 0)
        .withColumn("rule_command", F.when(suspicious_command(), command_text())).drop("_hits")
    )
