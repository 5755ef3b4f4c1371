"""Streams: pairing with watermarks, keyframes, state machines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sensorweave.operators import pieces
from sensorweave.sources.catalogs import TRANSITIONS


def event_time(ntz: Column) -> Column:
    """A timestamp without zone as one that watermarks accept, taken as UTC."""
    return F.to_utc_timestamp(ntz.cast("timestamp"), "UTC")


def pair_streams(images: DataFrame, results: DataFrame, key: str, at: str, delay: str = "1 second") -> DataFrame:
    """Stream-stream full outer join on equal keys within ``delay`` of event time; what stays alone comes out after the watermark.

    Works on streaming and on static DataFrames alike.
    """
    a = images.withWatermark(at, delay).select(F.col(key).alias("_a"), F.col(at).alias("_ta"))
    b = results.withWatermark(at, delay).select(F.col(key).alias("_b"), F.col(at).alias("_tb"))
    near = (F.col("_a") == F.col("_b")) & (F.col("_ta") >= F.col("_tb") - F.expr(f"interval {delay}")) & (F.col("_ta") <= F.col("_tb") + F.expr(f"interval {delay}"))
    joined = a.join(b, near, "full")
    status = F.when(F.col("_a").isNotNull() & F.col("_b").isNotNull(), "paired").when(F.col("_a").isNotNull(), "left_only").otherwise("right_only")
    return joined.select(F.coalesce("_a", "_b").alias(key), status.alias("status"))


def keyframes(frames: DataFrame, by: list[str], seq: str, every: int = 15, recording: Column | None = None) -> DataFrame:
    """Adds ``is_dropped`` and ``is_enhanced``: every 15th frame counted from 1 while recording; frames outside are dropped and not counted.

    Frames are counted within pieces of a key, which start from the counts of the pieces before.
    """
    on = F.coalesce(recording, F.lit(False)) if recording is not None else F.lit(True)
    rows = pieces.cut(frames.withColumn("_on", on), by, [seq])
    own = F.sum(F.col("_on").cast("bigint"))
    before = pieces.carried(rows, by, {"_n": own}, {"_before": F.sum("_n")})
    count = own.over(pieces.within(by, seq).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    rows = pieces.join_carried(rows.withColumn("_count", count), before, by)
    count = F.col("_count") + F.coalesce("_before", F.lit(0))
    return rows.withColumn("is_dropped", ~F.col("_on")).withColumn("is_enhanced", F.col("_on") & (count % every == 0)).drop("_on", "_count", "_before", pieces.PIECE)


def legal(source: Column, target: Column) -> Column:
    """Whether a state may follow another."""
    out = F.lit(False)
    for state, targets in TRANSITIONS.items():
        out = F.when(source == state, target.isin(*targets)).otherwise(out)
    return out


#: Requests that are folded together at once.
FOLDED = 1024


def replay_states(requests: DataFrame, by: str, seq: str = "seq", requested: str = "requested", forced: str | None = None, initial: str = "UNINITIALIZED") -> DataFrame:
    """(by, final_state, accepted, rejected): requests in order; a refused one keeps the state, a forced one goes to ERROR.

    A run of requests is a map from the state before it to the state after it and what it accepts and
    refuses.  Such maps are put together in any grouping as long as their order holds, so a session is cut
    into pieces and these into runs of ``FOLDED``; runs are folded apart, then pieces, then the session,
    whose start is known.  A request that names no state, or is null, is refused.
    """
    states = list(TRANSITIONS)
    number = F.create_map(*[F.lit(x) for i, name in enumerate(states) for x in (name, i)])
    target = F.coalesce(F.try_element_at(number, F.col(requested)), F.lit(-1))
    force = F.coalesce(F.col(forced), F.lit(False)) if forced else F.lit(False)
    rows = requests.select(F.col(by), F.col(seq).alias("_s"), F.when(force, F.lit(states.index("ERROR"))).otherwise(target).alias("_to"), force.alias("_forced"), F.col(requested).alias("_r"))
    order = ["_s", "_r", "_forced"]
    cut = pieces.cut(rows, [by], ["_s"])
    cut = cut.withColumn("_run", F.floor((F.row_number().over(pieces.within([by], *order)) - 1) / FOLDED))
    allowed = F.array(*[F.array(*[F.lit(t in TRANSITIONS[s]) for t in states]) for s in states])
    start = F.array(*[F.struct(F.lit(i).alias("at"), F.lit(0).cast("bigint").alias("yes"), F.lit(0).cast("bigint").alias("no")) for i in range(len(states))])

    def step(table: Column, x: Column) -> Column:
        """The map ``table`` followed by one request."""
        ok = F.col("_allowed")

        def one(e: Column) -> Column:
            good = x["_forced"] | ((x["_to"] >= 0) & F.get(F.get(ok, e["at"]), x["_to"]))
            return F.struct(F.when(good, x["_to"]).otherwise(e["at"]).alias("at"), (e["yes"] + good.cast("bigint")).alias("yes"), (e["no"] + (~good).cast("bigint")).alias("no"))

        return F.transform(table, one)

    def then(first: Column, second: Column) -> Column:
        """One map followed by another."""
        return F.transform(first, lambda e: F.struct(F.get(second, e["at"])["at"].alias("at"), (e["yes"] + F.get(second, e["at"])["yes"]).alias("yes"), (e["no"] + F.get(second, e["at"])["no"]).alias("no")))

    def together(maps: DataFrame, keys: list[str], place: str) -> DataFrame:
        held = maps.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(F.col(place), F.col("_map")))).alias("_maps"))
        return held.select(*keys, F.aggregate("_maps", start, lambda acc, m: then(acc, m["_map"])).alias("_map"))

    runs = cut.groupBy(by, pieces.PIECE, "_run").agg(F.array_sort(F.collect_list(F.struct(*order, "_to"))).alias("_all")).withColumn("_allowed", allowed)
    runs = runs.select(by, pieces.PIECE, "_run", F.aggregate("_all", start, step).alias("_map"))
    whole = together(together(runs, [by, pieces.PIECE], "_run"), [by], pieces.PIECE)
    found = F.get("_map", F.lit(states.index(initial)))
    names = F.array(*[F.lit(s) for s in states])
    return whole.select(by, F.get(names, found["at"]).alias("final_state"), found["yes"].alias("accepted"), found["no"].alias("rejected"))
