"""Counts and rates kept in keyed state, by Spark's state processors."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from logsift.operators.anomaly import AnomalySettings, judged
from logsift.operators.numbering import micros
from logsift.operators.rules import RuleSettings, auth_failure

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def own_or_storage_time(events: DataFrame, time: str) -> Column:
    """The event's own time, else its time of storage where the table has that."""
    return F.coalesce(F.col(time), F.col("created_at")) if "created_at" in events.columns and time != "created_at" else F.col(time)


def use_state_store(spark: SparkSession) -> None:
    """State processors need the RocksDB store, which also keeps large state off the heap."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)


class TrailingCounts(StatefulProcessor):
    """How many events, and how many failed logins, a source has in the windows that end with each of its events.

    A key is a bucket of sources: a call of the processor and its state costs tens of milliseconds, so a key for each source would take
    longer than all counting. State: the sources, times and failures by slab, so that a batch rewrites only the slabs that get new
    times, and old slabs go as they are. A timer at the time when the last window has passed clears a bucket that has fallen silent.
    """

    def __init__(self, login: int, spike: int, slab: int) -> None:
        self.login, self.spike, self.slab = login, spike, slab

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.slabs = handle.getMapState("slabs", "slab long", "source array<string>, seen array<long>, failed array<boolean>")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        new = pd.concat(list(rows)).sort_values(["source_ip", "t", "event_id"], kind="stable")
        source, t, bad = new["source_ip"].to_numpy(object), new["t"].to_numpy(), new["failed"].to_numpy().astype(bool)
        first, last, longest = int(t.min()), int(t.max()), max(self.login, self.spike)
        there = sorted(k[0] for k in self.slabs.keys())
        state = {s: self.slabs.getValue((s,)) for s in there if s >= (first - longest) // self.slab}
        old = [np.array([x for s in sorted(state) for x in state[s][i]], kind) for i, kind in enumerate((object, np.int64, bool))]
        codes = pd.factorize(np.concatenate((old[0], source)), sort=True)[0]
        were, are = codes[:len(old[0])], codes[len(old[0]):]
        spikes = self._counts(were, old[1], are, t, self.spike)
        logins = np.zeros(len(t), np.int64)
        logins[bad] = self._counts(were[old[2]], old[1][old[2]], are[bad], t[bad], self.login)

        at = np.argsort(t // self.slab, kind="stable")
        slabs, starts = np.unique((t // self.slab)[at], return_index=True)
        for s, inside in zip(slabs.tolist(), np.split(at, starts[1:])):
            sources, seen, failed = state.get(s, ([], [], []))
            self.slabs.updateValue((s,), ([*sources, *source[inside].tolist()], [*seen, *t[inside].tolist()], [*failed, *bad[inside].tolist()]))
        floor = timerValues.getCurrentWatermarkInMs() * 1000 - longest
        for s in there:
            if (s + 1) * self.slab < floor:
                self.slabs.removeKey((s,))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        end = max([last, *[(s + 1) * self.slab for s in there]])
        self.handle.registerTimer(max(end + longest, timerValues.getCurrentWatermarkInMs() * 1000) // 1000 + 1)
        yield pd.DataFrame({"source_ip": source, "event_id": new["event_id"].values, "event_ts": new["at"].values, "failed_count": logins, "spike_count": spikes})

    @staticmethod
    def _counts(old_source: np.ndarray, old: np.ndarray, source: np.ndarray, new: np.ndarray, span: int) -> np.ndarray:
        """For each of `new`, in order of source and time: the times of its source from `span` before it, among `old` and `new` up to
        itself. A source and the rank of a time make one number, which stays small whatever the times are."""
        ranks = np.unique(np.concatenate((old, new, new - span)), return_inverse=True)[1]
        width = int(ranks.max(initial=0)) + 1
        a, b, since = np.split(ranks, [len(old), len(old) + len(new)])
        there, here, since = np.sort(old_source * width + a), source * width + b, source * width + since
        upto = np.searchsorted(there, here, "right") + np.arange(1, len(new) + 1)
        return upto - np.searchsorted(there, since, "left") - np.searchsorted(here, since, "left")

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.slabs.clear()
        return iter(())

    def close(self) -> None:
        pass


def streaming_rules(events: DataFrame, settings: RuleSettings = RuleSettings(), time: str = "event_ts",
                    delay: str = "10 minutes", buckets: int = 256) -> DataFrame:
    """(source_ip, event_id, event_ts, failed_count, spike_count) of every event with a source and a time.

    Events without a time of their own are counted at their time of storage. Events later than `delay` are left out; a late
    event within it is counted itself, counts already given stay. The state is kept by `buckets` of sources, a number that a
    checkpoint is bound to; a bucket, so a source too, is one task of a micro-batch, over arrays of times; see `start_rules`
    where that is too much.
    """
    use_state_store(events.sparkSession)
    timed = events.withColumn("at", own_or_storage_time(events, time))
    usable = timed.filter((F.coalesce(F.col("source_ip"), F.lit("")) != "") & F.col("at").isNotNull())
    marked = usable.select(F.pmod(F.xxhash64("source_ip"), F.lit(buckets)).alias("bucket"), "source_ip", "event_id", "at",
                           micros(F.col("at")).alias("t"), auth_failure().alias("failed"))
    login, spike = settings.failed_login_seconds * 1_000_000, settings.spike_seconds * 1_000_000
    counts = TrailingCounts(login, spike, max(1_000_000, max(login, spike) // 8))
    return marked.withWatermark("at", delay).groupBy("bucket").transformWithStateInPandas(
        counts, "source_ip string, event_id string, event_ts timestamp, failed_count long, spike_count long", "append", "EventTime")


class RateBaseline(StatefulProcessor):
    """Each event as the n-th of its bucket against the last buckets' counts.

    State: a ring of the counts of the last `history` closed buckets that had events, and the open bucket with its count. An event
    of an earlier bucket than the open one counts in the open one.
    """

    def __init__(self, width: int, history: int, min_samples: int) -> None:
        self.width, self.history, self.min_samples = width, history, min_samples

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.ring = handle.getListState("ring", "n long")
        self.open = handle.getValueState("open", "bucket long, n long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        new = pd.concat(list(rows)).sort_values(["t", "event_id"], kind="stable")
        ring = [r[0] for r in self.ring.get()]
        bucket, n = self.open.get() or (None, 0)
        at = new["t"].to_numpy() // self.width
        at = np.maximum.accumulate(at if bucket is None else np.maximum(at, bucket))
        starts = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
        samples, sds, zs = np.zeros(len(at), np.int64), np.full(len(at), np.nan), np.full(len(at), np.nan)
        for a, z in zip(starts.tolist(), [*starts[1:].tolist(), len(at)]):
            if bucket is not None and at[a] != bucket:
                ring, n = [*ring, n][-self.history:], 0
            bucket, k = int(at[a]), len(ring)
            samples[a:z] = k
            if k:
                # Whole-number sums: a flat baseline has a spread of exactly zero.
                total, squares = sum(ring), sum(x * x for x in ring)
                sd = math.sqrt(float(k * squares - total * total) / (float(k) * float(k)))
                sds[a:z] = sd
                if k >= self.min_samples and sd > 0:
                    zs[a:z] = (np.arange(n + 1, n + 1 + z - a) - total / k) / sd
            n += z - a
        self.ring.put([(x,) for x in ring]) if ring else self.ring.clear()
        self.open.update((bucket, n))
        yield pd.DataFrame({"series": key[0], "event_id": new["event_id"].values, "event_ts": new["at"].values, "bucket": at, "samples": samples, "sd": sds, "zscore": zs})

    def close(self) -> None:
        pass


def streaming_rate_events(events: DataFrame, settings: AnomalySettings = AnomalySettings(), time: str = "event_ts",
                          series: Column | None = None) -> DataFrame:
    """(series, event_id, event_ts, bucket, anomaly, anomaly_score, anomaly_reason) of every event with a time, at once.

    Nothing stored is read again: the state is at most `history` + 1 counts. One series is one task of a micro-batch, over
    two narrow columns; name a `series` column, such as the source type, for baselines of their own.
    """
    use_state_store(events.sparkSession)
    timed = events.withColumn("at", own_or_storage_time(events, time)).filter(F.col("at").isNotNull())
    rows = timed.select((F.lit("all") if series is None else series.cast("string")).alias("series"), "event_id", "at", micros(F.col("at")).alias("t"))
    baseline = RateBaseline(settings.bucket_seconds * 1_000_000, settings.history, settings.min_samples)
    found = rows.groupBy("series").transformWithStateInPandas(
        baseline, "series string, event_id string, event_ts timestamp, bucket long, samples long, sd double, zscore double", "append", "None")
    number = lambda c: F.when(~F.isnan(c), F.col(c)).alias(c)
    return judged(found.withColumns({c: number(c) for c in ("sd", "zscore")}), settings, "sd", "zscore").drop("samples", "sd", "zscore")
