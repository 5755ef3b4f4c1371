"""Pairing of two out-of-order streams on an exact time, as a batch and under bounded, timed buffers."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def pair_exact(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Full outer join on equal keys with ``status``: paired, left_only or right_only."""
    joined = left.withColumn("_l", F.lit(True)).join(right.withColumn("_r", F.lit(True)), keys, "full")
    status = F.when(F.col("_l") & F.col("_r"), "paired").when(F.col("_l"), "left_only").otherwise("right_only")
    return joined.withColumn("status", status).drop("_l", "_r")


class Associator:
    """Two buffers by time; one arrival at a time.  Stale entries leave only when something arrives."""

    def __init__(self, max_pending: int = 30, timeout_ms: int = 1000):
        self.max_pending, self.timeout_ms = max_pending, timeout_ms
        self.pending: dict[str, dict[int, int]] = {"image": {}, "result": {}}

    def arrive(self, side: str, key: int, at_ms: int) -> list[tuple[str, str, int]]:
        """(what, side, key) of what an arrival causes: paired, or dropped as stale or for room."""
        out = []
        for name, held in self.pending.items():
            for old in [k for k, t in held.items() if at_ms - t > self.timeout_ms]:
                del held[old]
                out.append(("dropped", name, old))
        other = self.pending["result" if side == "image" else "image"]
        if key in other:
            del other[key]
            return [*out, ("paired", side, key)]
        mine = self.pending[side]
        if len(mine) >= self.max_pending:  # the smallest time makes room, however lately it came
            least = min(mine)
            del mine[least]
            out.append(("dropped", side, least))
        mine[key] = at_ms
        return out


def pair_bounded(arrivals: DataFrame, by: str = "stream", max_pending: int = 30, timeout_ms: int = 1000) -> DataFrame:
    """Replays arrivals (stream, side, timestamp_ns, arrival_ms) of each stream: (stream, outcome, side, timestamp_ns).

    Order matters, so a stream is one sequence; its rows pass through in batches, sorted by arrival, and
    only the two bounded buffers are held.  Entries that never leave are ``pending``.
    """
    rows = arrivals.select(F.col(by).alias("stream"), "side", "timestamp_ns", "arrival_ms").repartition("stream").sortWithinPartitions("stream", "arrival_ms", "timestamp_ns", "side")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, state = None, None

        def rest() -> list[tuple]:
            return [(now, "pending", side, k) for side, held in state.pending.items() for k in held] if state else []

        for batch in batches:
            out = []
            for stream, side, key, at in batch[["stream", "side", "timestamp_ns", "arrival_ms"]].itertuples(index=False):
                if state is None or stream != now:
                    out += rest()
                    now, state = stream, Associator(max_pending, timeout_ms)
                out += [(stream, what, s, k) for what, s, k in state.arrive(side, key, at)]
            yield pd.DataFrame(out, columns=["stream", "outcome", "side", "timestamp_ns"])
        yield pd.DataFrame(rest(), columns=["stream", "outcome", "side", "timestamp_ns"])

    return rows.mapInPandas(run, f"stream {rows.schema['stream'].dataType.simpleString()}, outcome string, side string, timestamp_ns bigint")


def lifecycle_counts(outcomes: DataFrame, by: str = "stream") -> DataFrame:
    """Per stream: associated, dropped and pending; images acquired, closed for room or age, and outstanding."""
    image = F.col("side") == "image"
    found = outcomes.groupBy(by).agg(
        *[F.count_if(F.col("outcome") == o).alias(n) for o, n in (("paired", "associated"), ("dropped", "dropped"), ("pending", "pending"))],
        F.count_if((F.col("outcome") == "paired") | image).alias("acquired"),
        F.count_if((F.col("outcome") == "dropped") & image).alias("closed"),
    )
    return found.withColumn("outstanding", F.col("acquired") - F.col("closed"))


#: Entries of both buffers as JSON: side to pairs of key and arrival.
_STATE = "pending string"


def pair_bounded_stream(arrivals: DataFrame, by: str = "stream", max_pending: int = 30, timeout_ms: int = 1000) -> DataFrame:
    """``pair_bounded`` on a stream: the same buffers, kept as Spark's state of each key between batches.

    Arrivals of a batch are taken in order of arrival.  What is still pending has not come out.
    """
    names = ["stream", "outcome", "side", "timestamp_ns"]

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = Associator(max_pending, timeout_ms)
        if state.exists:
            held.pending = {side: dict(map(tuple, pairs)) for side, pairs in json.loads(state.get[0]).items()}
        rows = pd.concat(list(batches)).sort_values(["arrival_ms", "timestamp_ns", "side"])
        out = [(key[0], what, side, k) for row in rows[["side", "timestamp_ns", "arrival_ms"]].itertuples(index=False) for what, side, k in held.arrive(row[0], int(row[1]), int(row[2]))]
        state.update((json.dumps({side: list(p.items()) for side, p in held.pending.items()}),))
        yield pd.DataFrame(out, columns=names)

    rows = arrivals.select(F.col(by).alias("stream"), "side", "timestamp_ns", "arrival_ms")
    schema = f"stream {rows.schema['stream'].dataType.simpleString()}, outcome string, side string, timestamp_ns bigint"
    return rows.groupBy("stream").applyInPandasWithState(run, schema, _STATE, "append", GroupStateTimeout.NoTimeout)
