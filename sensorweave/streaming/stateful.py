"""Stateful operators on streams: as-of alignment by event time, bounded pairing with timeouts.

Both use Spark's arbitrary state with timers, so state survives a restart from the query's checkpoint, and
what waits is let go by a timer and not by a later row.  The state of a key is a window of bounded time,
read and written once a batch.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from sensorweave.operators.pairing import Associator

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def with_timers(spark: SparkSession) -> None:
    """Sets the kind of state store that arbitrary state needs; before a query is started."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)


class _Align(StatefulProcessor):
    """Holds a key's samples from the one before its oldest waiting probe on, and its waiting probes.

    A probe is settled once the watermark shows that its bracketing samples are known: when it reaches
    the first sample at or after the probe, or the end of the probe's wait.
    """

    def __init__(self, wait: int, columns: list[str]):
        self.wait, self.row = wait, Row(*columns)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("held", "ts array<bigint>, v array<array<float>>, probe array<bigint>, id array<string>, timer bigint")

    def _load(self) -> tuple[list, list, list, int | None]:
        """Samples, waiting probes and the timer that is set; each call of a state or timer is a message to the JVM."""
        found = self.held.get()
        if found is None:
            return [], [], [], None
        ts, values, probes, ids, timer = found
        return list(ts), list(values), list(zip(probes, ids, strict=True)), timer

    def _settle(self, key: tuple, ts: list, values: list, probes: list, timer: int | None, watermark_ms: int) -> Iterator[Row]:
        """Rows of the probes that are settled, if any; what is still needed goes back to the state."""
        out, waiting, due = [], [], []
        for at, row in probes:
            low, high = bisect_right(ts, at) - 1, bisect_left(ts, at)
            found = ts[high] if high < len(ts) and ts[high] <= at + self.wait else None
            ready = -(-(found if found is not None else at + self.wait) // 1000)
            if ready > watermark_ms:
                waiting.append((at, row))
                due.append(ready)
                continue
            v0, v1 = values[low] if low >= 0 else None, values[high] if found is not None else None
            t0 = ts[low] if low >= 0 else None
            if v0 is None or v1 is None or t0 == found:
                mixed, between = v1 if v0 is None else v0, False
            else:
                share, between = (at - t0) / (found - t0), True
                mixed = [a + (b - a) * share for a, b in zip(v0, v1)]
            out.append(self.row(*key, at, row, mixed, between))
        # a probe that comes later is newer than the watermark
        oldest = min([1000 * watermark_ms, *(at for at, _ in waiting)])
        first = max(bisect_right(ts, oldest) - 1, 0)
        due = min(due) - 1 if due else None  # it goes off once the watermark has passed it
        self.held.update((ts[first:], values[first:], [at for at, _ in waiting], [row for _, row in waiting], due))
        if timer != due:
            if timer is not None:
                self.handle.deleteTimer(timer)
            if due is not None:
                self.handle.registerTimer(due)
        yield from out

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        ts, values, probes, timer = self._load()
        held = dict(zip(ts, values, strict=True))
        for r in rows:
            if r.align_probe:
                probes.append((r.align_at, r.align_row))
            elif r.align_values is not None:
                new = list(r.align_values)
                held[r.align_at] = max(new, list(held[r.align_at])) if r.align_at in held else new
        ts = sorted(held)
        yield from self._settle(key, ts, [list(held[t]) for t in ts], sorted(probes), timer, timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[Row]:
        ts, values, probes, _ = self._load()  # Spark takes the timer away that went off
        yield from self._settle(key, ts, values, probes, None, timerValues.getCurrentWatermarkInMs())

    def close(self) -> None:
        pass


def align_stream(probes: DataFrame, samples: DataFrame, by: list[str], ts: str, values: str, wait: int, delay: str = "0 seconds") -> DataFrame:
    """As-of alignment with interpolation of two streams, as ``temporal.align`` gives it for tables.

    ``ts`` is a BIGINT of microseconds since 1970, which is the event time too; rows more than ``delay``
    behind the newest one are late and go.  A probe waits for the first sample at or after it, at most
    ``wait`` microseconds of event time; then the sample before it stands alone.  Probes come out with
    their other columns once the watermark has settled them; those after it wait in the state.
    """
    with_timers(probes.sparkSession)
    # Spark hands rows over as named tuples, whose names must not begin with an underscore
    extra = [c for c in probes.columns if c not in (*by, ts)]
    when = F.timestamp_micros(F.col(ts))
    fields = [probes.schema[c] for c in extra]
    row = F.to_json(F.struct(*[F.col(c) for c in extra] or [F.lit(1).alias("none")]), {"ignoreNullFields": "false"})
    asked = probes.select(*by, F.col(ts).alias("align_at"), F.lit(True).alias("align_probe"), row.alias("align_row"), F.lit(None).cast("array<float>").alias("align_values"), when.alias("align_when"))
    given = samples.select(*by, F.col(ts).alias("align_at"), F.lit(False).alias("align_probe"), F.lit(None).cast("string").alias("align_row"), F.col(values).cast("array<float>").alias("align_values"), when.alias("align_when"))
    rows = asked.unionByName(given).withWatermark("align_when", delay)
    out = T.StructType([*(rows.schema[c] for c in by), T.StructField(ts, T.LongType()), T.StructField("align_row", T.StringType()), T.StructField(values, T.ArrayType(T.FloatType())), T.StructField("is_interpolated", T.BooleanType())])
    found = rows.groupBy(*by).transformWithState(_Align(wait, out.names), out, "Append", "EventTime")
    parsed = F.from_json("align_row", T.StructType(fields or [T.StructField("none", T.IntegerType())]))
    return found.withColumn("align_row", parsed).select(*by, ts, *[F.col(f"align_row.{c}").alias(c) for c in extra], values, "is_interpolated")


DRAIN = "drain"


class _Pair(StatefulProcessor):
    """``Associator``'s buffers as state; a timer lets go what has waited too long although nothing arrives."""

    def __init__(self, most: int, timeout_ms: int):
        self.most, self.timeout_ms = most, timeout_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("held", "side array<string>, at array<bigint>, arrived array<bigint>, seen array<bigint>")

    def _load(self) -> tuple[Associator, dict]:
        pairs, seen = Associator(self.most, self.timeout_ms), {}
        for side, at, arrived, when in zip(*self.held.get(), strict=True) if self.held.exists() else ():
            pairs.pending[side][at] = arrived
            seen[side, at] = when
        return pairs, seen

    def _store(self, pairs: Associator, seen: dict) -> None:
        rows = [(side, at, arrived, seen[side, at]) for side, entries in pairs.pending.items() for at, arrived in entries.items()]
        self.held.update(tuple(list(c) for c in zip(*rows)) if rows else ([], [], [], []))
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old)
        if rows:
            self.handle.registerTimer(min(r[3] for r in rows) + self.timeout_ms + 1)

    def _rows(self, key: tuple, found: list) -> pd.DataFrame:
        return pd.DataFrame([(*key, *x) for x in found], columns=["stream", "outcome", "side", "timestamp_ns"])

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        pairs, seen = self._load()
        now, out = timerValues.getCurrentProcessingTimeInMs(), []
        for side, at, arrived in pd.concat(list(rows)).sort_values(["arrival_ms", "timestamp_ns", "side"])[["side", "timestamp_ns", "arrival_ms"]].itertuples(index=False):
            if side == DRAIN:
                out += [("pending", name, k) for name, entries in pairs.pending.items() for k in entries]
                pairs = Associator(self.most, self.timeout_ms)
                continue
            out += pairs.arrive(side, int(at), int(arrived))
            seen[side, int(at)] = now
        self._store(pairs, seen)
        yield self._rows(key, out)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        pairs, seen = self._load()
        now, out = timerValues.getCurrentProcessingTimeInMs(), []
        for side, entries in pairs.pending.items():
            for at in [k for k in entries if now - seen[side, k] > self.timeout_ms]:
                del entries[at]
                out.append(("dropped", side, at))
        self._store(pairs, seen)
        yield self._rows(key, out)

    def close(self) -> None:
        pass


def pair_timed_stream(arrivals: DataFrame, by: str = "stream", max_pending: int = 30, timeout_ms: int = 1000) -> DataFrame:
    """Bounded pairing of a live stream: (stream, outcome, side, timestamp_ns) of ``paired`` and ``dropped`` entries.

    As ``pairing.pair_bounded_stream``, and an entry that waits longer than ``timeout_ms`` of the clock leaves as
    dropped even if its stream is silent.  As the clock goes on, such a query has no last batch: run it by
    a trigger of time, not by one that ends with what is there.  An arrival of side ``drain`` gives what its stream holds as
    ``pending`` and empties it.
    """
    with_timers(arrivals.sparkSession)
    rows = arrivals.select(F.col(by).alias("stream"), "side", "timestamp_ns", "arrival_ms")
    schema = T.StructType([rows.schema["stream"], T.StructField("outcome", T.StringType()), T.StructField("side", T.StringType()), T.StructField("timestamp_ns", T.LongType())])
    return rows.groupBy("stream").transformWithStateInPandas(_Pair(max_pending, timeout_ms), schema, "Append", "ProcessingTime")
