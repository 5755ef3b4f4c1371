"""Registered queries over the driver's tables, and the SQL that checks them.

Each query applies an operator to the driver's tables as an analog of sensor and frame data: events
stand for samples, logs and frames, embeddings for small image planes, orders and parts for keys and
sizes.  Fixed catalogs are only looked up in.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sensorweave.functions import bands
from sensorweave.functions import labels as L
from sensorweave.functions import planes as P
from sensorweave.operators import metrics as M
from sensorweave.operators import pairing, ranking, retention, temporal
from sensorweave.plans import rules as R
from sensorweave.sources import catalogs as C
from sensorweave.session import scratch
from sensorweave.sources import readers, sinks
from sensorweave.sources.stores import KeyedStore
from sensorweave.streaming import logs, stateful
from sensorweave.streaming import streams as S

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a function under its name, with its SQL if it has one."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with their time as microseconds since 1970, whatever the session's time zone."""
    return table(spark, sf_dir, "events").withColumn("us", F.expr("timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', ts)")).drop("ts")


def arriving(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table as a stream of its files; a pattern, as a table may be one file, which a stream's path may not."""
    return spark.readStream.schema(table(spark, sf_dir, name).schema).parquet(f"{sf_dir}/{name[:-1]}[{name[-1]}].parquet")


def points(spark: SparkSession, sf_dir: str, kind: str) -> tuple[DataFrame, DataFrame]:
    """Probes (purchases) and samples of one kind, with their value as an array of one float."""
    rows = events(spark, sf_dir)
    probes = rows.where("event_type = 'purchase'").select("event_id", "user_id", F.col("us").alias("ts"))
    samples = rows.where(F.col("event_type") == kind).select("user_id", F.col("us").alias("ts"), F.array(F.col("value").cast("float")).alias("values"))
    return probes, samples


def asof_sql(kind: str, by_user: bool) -> str:
    """A common table expression part: probes with the samples of ``kind`` before (t0, v0) and after (t1, v1)."""
    on = "p.user_id = s.user_id AND " if by_user else ""
    return f"""
        (SELECT a.event_id, a.user_id, a.ts, a.t0, a.v0, s.ts AS t1, s.v AS v1 FROM
            (SELECT p.*, s.ts AS t0, s.v AS v0 FROM probes p ASOF LEFT JOIN (SELECT * FROM samples WHERE kind = '{kind}') s ON {on}p.ts >= s.ts) a
            ASOF LEFT JOIN (SELECT * FROM samples WHERE kind = '{kind}') s ON {on.replace('p.', 'a.')}a.ts <= s.ts)"""


POINTS_SQL = """
    probes AS (SELECT event_id, user_id, epoch_us(ts) AS ts FROM events WHERE event_type = 'purchase'),
    samples AS (SELECT event_type AS kind, user_id, epoch_us(ts) AS ts, CAST(value AS FLOAT) AS v FROM events)"""
VALUE_SQL = """
    CASE WHEN {x}t0 IS NULL THEN {x}v1 WHEN {x}t1 IS NULL OR {x}t0 = {x}t1 THEN {x}v0
         ELSE CAST(CAST({x}v0 AS DOUBLE) + (CAST({x}v1 AS DOUBLE) - CAST({x}v0 AS DOUBLE)) * (CAST({x}ts - {x}t0 AS DOUBLE) / CAST({x}t1 - {x}t0 AS DOUBLE)) AS FLOAT) END"""
DAY_US = 86_400_000_000


def rounded(x: Column, places: int = 4) -> Column:
    return F.round(x.cast("double"), places)


# -- time series ---------------------------------------------------------------------------------


@query(f"WITH {POINTS_SQL} SELECT event_id, ts, round(CAST({VALUE_SQL.format(x='b.')} AS DOUBLE), 4) AS value, coalesce(t0 <> t1, FALSE) AS is_interpolated FROM {asof_sql('click', False)} b")
def imu_interpolate(spark: SparkSession, sf_dir: str) -> DataFrame:
    probes, samples = points(spark, sf_dir, "click")
    found = temporal.align(probes.drop("user_id"), samples.drop("user_id"), [], bucket=DAY_US)
    return found.select("event_id", "ts", rounded(found["values"][0]).alias("value"), "is_interpolated")


WAIT_US = 12 * 3_600_000_000


@query(f"""WITH {POINTS_SQL}, b AS (SELECT event_id, user_id, ts, t0, v0, CASE WHEN t1 <= ts + {WAIT_US} THEN t1 END AS t1, CASE WHEN t1 <= ts + {WAIT_US} THEN v1 END AS v1 FROM {asof_sql('click', True)} x)
    SELECT event_id, user_id, ts, round(CAST({VALUE_SQL.format(x='b.')} AS DOUBLE), 3) AS value, coalesce(t0 <> t1, FALSE) AS is_interpolated FROM b
    WHERE (coalesce(t1, ts + {WAIT_US}) + 999) // 1000 <= (SELECT max(epoch_us(ts)) // 1000 FROM events WHERE event_type IN ('click', 'purchase'))""")  # fmt: skip
def imu_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's purchases aligned with their clicks as both stream in; those whose next click can still come are left out."""
    rows = arriving(spark, sf_dir, "events").withColumn("ts", F.expr("timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', ts)"))
    probes = rows.where("event_type = 'purchase'").select("event_id", "user_id", "ts")
    samples = rows.where("event_type = 'click'").select("user_id", "ts", F.array(F.col("value").cast("float")).alias("values"))
    found = stateful.align_stream(probes, samples, ["user_id"], "ts", "values", WAIT_US)
    out = scratch(spark, "imu-stream")
    found.writeStream.format("parquet").option("path", out).option("checkpointLocation", scratch(spark, "imu-stream-checkpoint")).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(found.schema).parquet(out).select("event_id", "user_id", "ts", rounded(F.col("values")[0], 3).alias("value"), "is_interpolated")


@query(f"WITH {POINTS_SQL} SELECT event_id, user_id, ts, coalesce(t0, t1) AS matched_ts FROM {asof_sql('click', True)} b")
def imu_floor_offset(spark: SparkSession, sf_dir: str) -> DataFrame:
    probes, samples = points(spark, sf_dir, "click")
    return temporal.floor_else_ceiling(probes, samples, ["user_id"], bucket=DAY_US).select("event_id", "user_id", "ts", "matched_ts")


@query(f"""WITH {POINTS_SQL}, m AS (SELECT user_id, coalesce(ts > lag(ts) OVER (PARTITION BY user_id ORDER BY event_id), TRUE) AS rise, abs(ts - coalesce(t0, t1)) AS off FROM {asof_sql('click', True)} b)
    SELECT user_id, count(off) = 0 OR bool_and(rise) AS is_monotonic, CAST(coalesce(trunc(avg(off)), 0) AS BIGINT) AS avg_offset, coalesce(max(off), 0) AS max_offset,
           count(*) FILTER (off > 3600000000) AS missing_intervals, count(off) AS sample_count,
           bool_and(rise) AND count(off) > 0 AND CAST(coalesce(trunc(avg(off)), 0) AS BIGINT) < 36000000000 AS is_verified FROM m GROUP BY user_id""")  # fmt: skip
def clock_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    probes, samples = points(spark, sf_dir, "click")
    return temporal.clock_report(temporal.floor_else_ceiling(probes, samples, ["user_id"], bucket=DAY_US), ["user_id"], "event_id", gap=3_600_000_000, mean_limit=36_000_000_000)


@query(f"""WITH {POINTS_SQL}, g AS (SELECT event_id, {VALUE_SQL.format(x='')} AS gyro, coalesce(t0 <> t1, FALSE) AS i FROM {asof_sql('click', True)} b),
    a AS (SELECT event_id, {VALUE_SQL.format(x='')} AS accel, coalesce(t0 <> t1, FALSE) AS i FROM {asof_sql('view', True)} b)
    SELECT event_id, round(CAST(gyro AS DOUBLE), 4) AS gyro, round(CAST(accel AS DOUBLE), 4) AS accel, g.i OR a.i AS is_interpolated FROM g JOIN a USING (event_id)""")  # fmt: skip
def dual_sensor_sync(spark: SparkSession, sf_dir: str) -> DataFrame:
    probes, gyro = points(spark, sf_dir, "click")
    found = temporal.align_two(probes, gyro, points(spark, sf_dir, "view")[1], ["user_id"], bucket=DAY_US)
    return found.select("event_id", rounded(found["gyro"][0]).alias("gyro"), rounded(found["accel"][0]).alias("accel"), "is_interpolated")


@query("SELECT event_id, event_type, epoch_us(ts) AS us FROM events QUALIFY epoch_us(ts) >= max(epoch_us(ts)) OVER (PARTITION BY event_type) - 432000000000")
def trailing_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return temporal.trailing_window(events(spark, sf_dir).select("event_id", "event_type", "us"), ["event_type"], 5 * DAY_US, "us")


@query("""WITH e AS (SELECT event_id, event_type, epoch_us(ts) AS us, max(epoch_us(ts)) OVER (PARTITION BY event_type ORDER BY event_id * 7919 % 10007, event_id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS newer,
        row_number() OVER (PARTITION BY event_type, ts ORDER BY event_id * 7919 % 10007 DESC, event_id DESC) AS nth FROM events)
    SELECT event_id, event_type, us FROM e WHERE nth = 1 AND (newer IS NULL OR us >= newer - 432000000000)""")
def sensor_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events that arrive far out of order: what each type's window of five days holds in the end."""
    arrival = F.col("event_id") * 7919 % 10007 * 1_000_000_000_000 + F.col("event_id")
    rows = events(spark, sf_dir).select("event_id", "event_type", "us", arrival.alias("arrival"))
    return temporal.retained_window(rows, ["event_type"], 5 * DAY_US, "arrival", "us").select("event_id", "event_type", "us")


# -- pairing -------------------------------------------------------------------------------------


@query("""SELECT coalesce(o.k, l.k) AS order_key, CASE WHEN l.k IS NULL THEN 'left_only' WHEN o.k IS NULL THEN 'right_only' ELSE 'paired' END AS status
    FROM (SELECT c_custkey AS k FROM customer) o FULL JOIN (SELECT DISTINCT p_partkey AS k FROM part) l ON o.k = l.k""")
def pair_full_outer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys of two whole tables of unlike size, so that some have no partner."""
    left = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("order_key"))
    right = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("order_key")).distinct()
    return pairing.pair_exact(left, right, ["order_key"])


@query("""SELECT coalesce(o.k, l.k) AS order_key, CASE WHEN l.k IS NULL THEN 'left_only' WHEN o.k IS NULL THEN 'right_only' ELSE 'paired' END AS status
    FROM (SELECT o_orderkey AS k FROM orders) o FULL JOIN (SELECT DISTINCT l_orderkey AS k FROM lineitem) l ON o.k = l.k""")
def pair_full_outer_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``pair_full_outer`` over all keys of both tables."""
    left = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("order_key"))
    right = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("order_key")).distinct()
    return pairing.pair_exact(left, right, ["order_key"])


def arrivals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of each type as arrivals: images and results of a user within an hour share a key."""
    return events(spark, sf_dir).select(F.col("event_type").alias("stream"), F.when(F.col("event_id") % 2 == 0, "image").otherwise("result").alias("side"), F.floor(F.col("us") / 3_600_000_000).alias("timestamp_ns"), F.floor(F.col("us") / 3_600_000).alias("arrival_ms"))


@query()
def pair_bounded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairing.pair_bounded(arrivals(spark, sf_dir), "stream", 30, 1000)


@query()
def lifecycle_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairing.lifecycle_counts(pair_bounded(spark, sf_dir))


@query("""SELECT coalesce(a.user_id, b.user_id) AS user_id, CASE WHEN b.user_id IS NULL THEN 'left_only' WHEN a.user_id IS NULL THEN 'right_only' ELSE 'paired' END AS status, count(*) AS n
    FROM (SELECT user_id, ts FROM events WHERE event_type = 'click') a FULL JOIN (SELECT user_id, ts FROM events WHERE event_type = 'view') b
    ON a.user_id = b.user_id AND a.ts >= b.ts - INTERVAL 6 HOUR AND a.ts <= b.ts + INTERVAL 6 HOUR GROUP BY ALL""")
def pair_stream_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").withColumn("at", F.col("ts").cast("timestamp"))
    found = S.pair_streams(rows.where("event_type = 'click'"), rows.where("event_type = 'view'"), "user_id", "at", "6 hours")
    return found.groupBy("user_id", "status").agg(F.count("*").alias("n"))


# -- retention -----------------------------------------------------------------------------------


@query("""WITH r AS (SELECT event_id, user_id, epoch_us(ts) AS us, length(props) AS bytes, row_number() OVER w AS rn, sum(length(props)) OVER w AS held
        FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts DESC ROWS UNBOUNDED PRECEDING))
    SELECT event_id, user_id, us, bytes FROM r WHERE rn = 1 OR (rn <= 16 AND held <= 200)""")
def ring_retained(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = events(spark, sf_dir).select("event_id", "user_id", "us", F.length("props").alias("bytes"))
    return retention.ring_retained(rows, ["user_id"], "us", "bytes", 16, 200)


@query("SELECT event_id, user_id, epoch_us(ts) AS us FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC) <= 5")
def recent_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retention.last_n(events(spark, sf_dir).select("event_id", "user_id", "us"), ["user_id"], "us", 5)


@query("SELECT user_id, arg_max(event_id, ts) AS event_id, arg_max(event_type, ts) AS event_type, epoch_us(max(ts)) AS us FROM events GROUP BY user_id")
def latest_event(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retention.latest(events(spark, sf_dir).select("user_id", "event_id", "event_type", "us"), ["user_id"], "us")


@query("""WITH l AS (SELECT event_type, event_id % 500 AS frame_sequence, arg_max(event_id, ts) AS event_id FROM events GROUP BY ALL)
    SELECT * FROM l QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY frame_sequence DESC) <= 200""")
def keyed_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = events(spark, sf_dir).select("event_type", (F.col("event_id") % 500).alias("frame_sequence"), "event_id", "us")
    return retention.last_n(retention.latest(rows, ["event_type", "frame_sequence"], "us"), ["event_type"], "frame_sequence", 200).drop("us")


@query("""WITH a AS (SELECT c_custkey AS k, 0 AS seq, c_mktsegment AS v FROM customer UNION ALL SELECT o_custkey, o_orderkey + 1, o_orderpriority FROM orders)
    SELECT k, max(seq) AS seq, arg_max(v, seq) AS v FROM a GROUP BY k""")
def upsert_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.lit(0).cast("bigint").alias("seq"), F.col("c_mktsegment").alias("v"))
    changes = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k"), (F.col("o_orderkey") + 1).alias("seq"), F.col("o_orderpriority").alias("v"))
    return retention.upsert(base, changes, ["k"], "seq")


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'O')")
def delete_by_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    gone = table(spark, sf_dir, "orders").where("o_orderstatus = 'O'").select(F.col("o_custkey").alias("c_custkey"))
    return retention.delete_by_id(table(spark, sf_dir, "customer").select("c_custkey", "c_name"), gone, "c_custkey")


@query("""WITH a AS (SELECT c_custkey AS k, 0 AS seq, c_mktsegment AS v, 0 AS gone FROM customer UNION ALL SELECT o_custkey, o_orderkey + 1, o_orderpriority, 0 FROM orders UNION ALL SELECT o_custkey, o_orderkey + 1, NULL, 1 FROM orders WHERE o_orderstatus = 'P'),
    l AS (SELECT * FROM a QUALIFY row_number() OVER (PARTITION BY k ORDER BY seq DESC, gone DESC) = 1)
    SELECT k, v FROM l WHERE gone = 0""")
def stored_by_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers stored in folders, written over by their orders, taken away by pending ones, compacted twice."""
    base = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.col("c_mktsegment").alias("v"), F.lit(0).alias("seq"))
    orders = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k"), F.col("o_orderpriority").alias("v"), (F.col("o_orderkey") + 1).alias("seq"), "o_orderstatus")
    store = KeyedStore(spark, scratch(spark, "stored-by-id"), base.select("k", "v").schema, ["k"], 16)
    store.put(base, "seq")
    store.compact()
    store.put(orders, "seq")
    store.delete(orders.where("o_orderstatus = 'P'"), "seq")
    store.compact()
    return store.read()


@query("SELECT event_id, epoch_us(ts) AS us FROM events WHERE event_type = 'signup' ORDER BY ts DESC")
def newest_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retention.newest_first(events(spark, sf_dir).where("event_type = 'signup'").select("event_id", "us"), "us", "event_id")


# -- metrics and logs ----------------------------------------------------------------------------


@query("""WITH g AS (SELECT event_type AS stage_name, list_sort(list(value)) AS l, count(value) AS n, max(length(props)) AS peak_memory FROM events GROUP BY 1),
    p AS (SELECT stage_name, n AS iterations, l[n // 2 + 1] AS median, l[least(CAST(trunc(n * CAST(0.95 AS DOUBLE)) AS BIGINT), n - 1) + 1] AS p95, l[least(CAST(trunc(n * CAST(0.99 AS DOUBLE)) AS BIGINT), n - 1) + 1] AS p99, peak_memory FROM g),
    b AS (SELECT *, CASE WHEN stage_name = 'click' THEN CAST(50 AS DOUBLE) ELSE median END AS baseline FROM p)
    SELECT *, CASE WHEN baseline <= 0 THEN 0 ELSE round((baseline - median) / baseline * 100, 3) END AS gain_percent FROM b""")
def stage_latency_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = events(spark, sf_dir).select(F.col("event_type").alias("stage_name"), "value", F.length("props").alias("bytes"))
    found = M.stage_summary(rows, "stage_name", "value", "bytes", {"click": 50.0})
    return found.withColumn("gain_percent", F.when(F.col("baseline") <= 0, 0.0).otherwise(F.round((F.col("baseline") - F.col("median")) / F.col("baseline") * 100, 3)))


SCENES_SQL = "(VALUES " + ", ".join(f"('{s[0]}', '{s[1]}', CAST({s[4]} AS FLOAT), {i})" for i, s in enumerate(C.SCENES)) + ") s(scene_id, category, base, i)"
MEASURED_SQL = "(SELECT CAST(label AS BIGINT) + 2 AS i, CAST(25 + count(*) % 15 AS FLOAT) AS psnr FROM embeddings GROUP BY label)"


def measured(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A made-up measure of ten scenes: by label, the number of embeddings modulo 15 above 25."""
    ids = F.array(*[F.lit(s[0]) for s in C.SCENES])
    return table(spark, sf_dir, "embeddings").groupBy("label").agg(F.count("*").alias("n")).select(F.element_at(ids, F.col("label").cast("int") + 3).alias("scene_id"), (25 + F.col("n") % 15).cast("float").alias("psnr"))


@query(f"SELECT s.scene_id, s.category, coalesce(m.psnr, s.base) AS measured, coalesce(m.psnr, s.base) < s.base - CAST(0.5 AS FLOAT) AS is_regression FROM {SCENES_SQL} LEFT JOIN {MEASURED_SQL} m ON m.i = s.i")
def regression_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.regression_rows(C.scenes(spark), measured(spark, sf_dir)).select("scene_id", "category", "measured", "is_regression")


@query(f"""WITH r AS (SELECT s.scene_id, coalesce(m.psnr, s.base) < s.base - CAST(0.5 AS FLOAT) AS bad FROM {SCENES_SQL} LEFT JOIN {MEASURED_SQL} m ON m.i = s.i)
    SELECT count(*) AS total_scenes, count(*) FILTER (NOT bad) AS passed_scenes, coalesce(string_agg(scene_id, ',' ORDER BY scene_id) FILTER (bad), '') AS regressions, bool_and(NOT bad) AS is_regression_free FROM r""")
def regression_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.regression_verdict(C.scenes(spark), measured(spark, sf_dir)).withColumn("regressions", F.array_join("regressions", ","))


@query("""WITH l AS (SELECT conv_id * 1000 + turn AS seq, role AS category, CASE WHEN conv_id % 7 = 0 THEN 'Raw FramePlane ' || text WHEN conv_id % 7 = 1 THEN 'frameplane ' || text ELSE text END AS message, turn % 5 AS rank FROM conversations QUALIFY row_number() OVER (ORDER BY conv_id * 1000 + turn DESC) <= 1000)
    SELECT seq, category, CASE WHEN contains(message, 'ByteArray') OR contains(message, 'FramePlane') THEN '[PIXEL_DATA_REDACTED]' ELSE message END AS message
    FROM l WHERE category = 'user' AND rank >= 2 ORDER BY seq DESC LIMIT 100""")
def log_filter_redact(spark: SparkSession, sf_dir: str) -> DataFrame:
    level = F.element_at(F.array(*[F.lit(x) for x in C.LOG_LEVELS]), (F.col("turn") % 5 + 1).cast("int"))
    message = F.when(F.col("conv_id") % 7 == 0, F.concat(F.lit("Raw FramePlane "), "text")).when(F.col("conv_id") % 7 == 1, F.concat(F.lit("frameplane "), "text")).otherwise(F.col("text"))
    logs = table(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("seq"), F.col("role").alias("category"), message.alias("message"), level.alias("level"))
    return M.filter_logs(logs, "user", "INFO", 100, "seq").select("seq", "category", "message")


@query("SELECT event_id, 'METRIC' AS tag, value FROM events WHERE event_type = 'view' QUALIFY row_number() OVER (ORDER BY ts DESC) <= 500")
def telemetry_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    event = M.log_metric(F.col("event_type"), F.col("value"), F.floor(F.col("us") / 1000))
    rows = M.recent_events(events(spark, sf_dir).where("event_type = 'view'").select("event_id", "us", event.alias("event")), "us")
    return rows.select("event_id", F.col("event")["tag"].alias("tag"), F.col("event")["value"].cast("double").alias("value"))


@query("SELECT event_id, 'METRIC' AS tag, event_type AS name, value FROM events QUALIFY row_number() OVER (ORDER BY ts DESC) <= 500")
def telemetry_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a stream of metrics, appended batch by batch to a log that holds the last 500."""
    us = F.expr("timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', ts)")
    rows = arriving(spark, sf_dir, "events").withColumn("us", us)
    event = M.log_metric(F.col("event_type"), F.col("value"), F.floor(F.col("us") / 1000))
    log = logs.RollingLog(spark, scratch(spark, "telemetry"), M.EVENTS_HELD, "us")
    log.follow(rows.select("event_id", "us", event.alias("event")), scratch(spark, "telemetry-checkpoint"), available_now=True).awaitTermination()
    return log.read().select("event_id", *[F.col("event")[k].alias(k) for k in ("tag", "name")], F.col("event")["value"].cast("double").alias("value"))


@query("""SELECT event_id, 'ERROR_' || event_type AS tag, 'user ' || user_id AS error_msg, CASE WHEN user_id % 2 = 0 THEN 'Failure' END AS throwable, CASE WHEN user_id % 2 = 0 THEN substr(repeat(props, 20), 1, 500) END AS stacktrace,
    CAST(epoch_us(ts) // 1000 AS VARCHAR) AS timestamp_ms FROM events WHERE event_type = 'error'""")
def error_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    throwable = F.when(F.col("user_id") % 2 == 0, "Failure")
    event = M.log_error(F.col("event_type"), F.concat(F.lit("user "), F.col("user_id").cast("string")), throwable, F.repeat("props", 20), F.floor(F.col("us") / 1000))
    rows = events(spark, sf_dir).where("event_type = 'error'").select("event_id", event.alias("event"))
    return rows.select("event_id", *[F.try_element_at("event", F.lit(k)).alias(k) for k in ("tag", "error_msg", "throwable", "stacktrace", "timestamp_ms")])


# -- planes: embeddings of 64 values as planes of 8 by 8 ------------------------------------------

TILE, EDGE = 4, 8
PLANE_SQL = "planes AS (SELECT vec_id, label, i - 1 AS idx, least(greatest(CAST(trunc((CAST(embedding[i] AS DOUBLE) + 1) * 127.5) AS BIGINT), 0), 255) AS v FROM (SELECT vec_id, label, embedding, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings))"
#: Tiles of each plane with their confidence at ISO 400.
TILES_SQL = f"""tiles AS (SELECT vec_id, idx // {EDGE} // {TILE} AS ty, idx % {EDGE} // {TILE} AS tx, sum(v) // count(*) AS avg FROM planes GROUP BY ALL),
    conf AS (SELECT *, least(greatest(CAST(CASE WHEN avg > 245 THEN 0.2 WHEN avg < 12 THEN 0.3 WHEN avg BETWEEN 40 AND 215 THEN 0.95 ELSE 0.7 END AS FLOAT) - CAST(4 AS FLOAT) / CAST(64 AS FLOAT), CAST(0.05 AS FLOAT)), CAST(1 AS FLOAT)) AS conf FROM tiles)"""


def planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    value = F.transform("embedding", lambda e: P.clamp(((e.cast("double") + 1) * 127.5).cast("int"), F.lit(0), F.lit(255)))
    return table(spark, sf_dir, "embeddings").select("vec_id", "label", value.alias("plane"))


@query(f"WITH {PLANE_SQL} SELECT label, idx, sum(v) // count(*) AS fused FROM planes GROUP BY ALL")
def temporal_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.temporal_fusion(planes(spark, sf_dir), ["label"], "plane", "vec_id")


@query(f"WITH {PLANE_SQL} SELECT vec_id, idx, CAST(trunc((v / 255.0::DOUBLE) * (v / 255.0::DOUBLE) * (3 - 2 * (v / 255.0::DOUBLE)) * 255.0::DOUBLE) AS BIGINT) AS toned FROM planes")
def tone_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    rgb = planes(spark, sf_dir).select("vec_id", P.tone_rgb(F.col("plane")).alias("rgb"))
    return rgb.select("vec_id", F.posexplode("rgb").alias("at", "toned")).where("at % 3 = 1").select("vec_id", F.expr("at div 3").alias("idx"), "toned")


@query(f"""WITH {PLANE_SQL}, s AS (SELECT vec_id, count(*) AS n, sum(v) AS a, sum(v * v) AS b, count(*) FILTER (v <= 2 OR v >= 253) AS clipped FROM planes WHERE idx % 4 = 0 GROUP BY vec_id),
    q AS (SELECT *, CAST(n * b - a * a AS DOUBLE) / CAST(n * n AS DOUBLE) AS variance FROM s)
    SELECT vec_id, n, clipped, variance, round(least(greatest(1 - sqrt(variance) / 128, 0.1), 1), 4) AS noise_score, round(least(greatest(sqrt(variance) / 64, 0.1), 1), 4) AS sharp_score, clipped > n * 0.5 AS is_clipped FROM q""")
def plane_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = P.with_quality(planes(spark, sf_dir), "plane")
    return found.select("vec_id", "n", "clipped", "variance", rounded(F.col("noise_score")).alias("noise_score"), rounded(F.col("sharp_score")).alias("sharp_score"), (F.col("artifact_risk") > 0.5).alias("is_clipped"))


@query(f"WITH {PLANE_SQL}, {TILES_SQL} SELECT vec_id, ty, tx, avg, round(CAST(conf AS DOUBLE), 4) AS conf FROM conf")
def tile_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    tiles = P.tile_averages(planes(spark, sf_dir), ["vec_id"], "plane", F.lit(EDGE), TILE)
    return tiles.withColumn("conf", rounded(P.tile_confidence(F.col("avg"), F.lit(400))))


@query(f"""WITH {PLANE_SQL}, {TILES_SQL}, f AS (SELECT label, idx, sum(v) // count(*) AS r FROM planes GROUP BY ALL),
    x AS (SELECT p.vec_id, abs(p.v - f.r) > 45 AS far, c.conf >= CAST(0.75 AS FLOAT) AS high FROM planes p JOIN f USING (label, idx)
          JOIN conf c ON c.vec_id = p.vec_id AND c.ty = p.idx // {EDGE} // {TILE} AND c.tx = p.idx % {EDGE} // {TILE} WHERE p.idx // {EDGE} % 2 = 0 AND p.idx % {EDGE} % 2 = 0),
    n AS (SELECT vec_id, count(*) FILTER (high) AS n_high, count(*) FILTER (high AND far) AS n_far FROM x GROUP BY vec_id),
    r AS (SELECT *, CASE WHEN n_high > 0 THEN CAST(n_far AS FLOAT) / CAST(n_high AS FLOAT) ELSE CAST(0 AS FLOAT) END AS ratio FROM n)
    SELECT vec_id, n_high, n_far, CASE WHEN ratio > CAST(0.2 AS FLOAT) THEN 'REVERT_TO_ORIGINAL' WHEN ratio > CAST(0.05 AS FLOAT) THEN 'BLEND_WITH_ORIGINAL' ELSE 'KEEP_RECONSTRUCTED' END AS action, ratio > CAST(0.2 AS FLOAT) AS hallucination FROM r""")
def guard_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = planes(spark, sf_dir)
    fused = P.temporal_fusion(rows, ["label"], "plane", "vec_id").groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("idx", "fused"))), lambda x: x["fused"]).alias("recon"))
    both = rows.join(fused, "label")
    return P.guard_decisions(both, ["vec_id"], "plane", "recon", F.lit(EDGE), F.lit(400), TILE, 2).select("vec_id", "n_high", "n_far", "action", "hallucination")


_HEX = "strpos('0123456789ABCDEF', substr(h, CAST({at} AS BIGINT), 1)) - 1"
#: Pages as frames: four in a burst, 64 wide, their text as bytes; tiles of 8, every fourth place compared.
_BYTES_SQL = f"""f AS (SELECT page_id, page_id // 4 AS burst, hex(encode(coalesce(html, ''))) AS h FROM pages),
    v AS (SELECT page_id, burst, i, 16 * ({_HEX.format(at='2 * i + 1')}) + ({_HEX.format(at='2 * i + 2')}) AS v FROM (SELECT *, unnest(range(length(h) // 2)) AS i FROM f))"""


@query(f"""WITH {_BYTES_SQL}, b AS (SELECT burst, count(*) AS frames, max(page_id) AS last FROM f GROUP BY burst),
    o AS (SELECT v.burst, i, v, i // 64 // 8 AS ty, i % 64 // 8 AS tx FROM v JOIN b ON b.burst = v.burst AND v.page_id = b.last),
    r AS (SELECT v.burst, i, sum(v) // any_value(frames) AS r FROM v JOIN b ON b.burst = v.burst GROUP BY v.burst, i),
    t AS (SELECT burst, ty, tx, sum(v) // count(*) AS avg FROM o GROUP BY ALL),
    c AS (SELECT *, least(greatest(CAST(CASE WHEN avg > 245 THEN 0.2 WHEN avg < 12 THEN 0.3 WHEN avg BETWEEN 40 AND 215 THEN 0.95 ELSE 0.7 END AS FLOAT) - CAST(4 AS FLOAT) / CAST(64 AS FLOAT), CAST(0.05 AS FLOAT)), CAST(1 AS FLOAT)) AS conf FROM t),
    m AS (SELECT burst, round(sum(CAST(conf AS DOUBLE)) / count(*), 4) AS confidence_mean FROM c GROUP BY burst),
    g AS (SELECT o.burst, count(*) AS n_high, count(*) FILTER (abs(v - r) > 45) AS n_far FROM o JOIN r ON r.burst = o.burst AND r.i = o.i JOIN c ON c.burst = o.burst AND c.ty = o.ty AND c.tx = o.tx WHERE conf >= 0.75 AND o.i // 64 % 4 = 0 AND o.i % 64 % 4 = 0 GROUP BY o.burst),
    a AS (SELECT b.burst, frames, coalesce(n_high, 0) AS n_high, coalesce(n_far, 0) AS n_far, coalesce(confidence_mean, 0.5) AS confidence_mean, CASE WHEN n_high > 0 THEN CAST(n_far AS FLOAT) / CAST(n_high AS FLOAT) ELSE 0 END AS ratio FROM b LEFT JOIN m ON m.burst = b.burst LEFT JOIN g ON g.burst = b.burst)
    SELECT burst, frames, n_high, n_far, CAST(confidence_mean AS DOUBLE) AS confidence_mean, CASE WHEN ratio > CAST(0.2 AS FLOAT) THEN 'REVERT_TO_ORIGINAL' WHEN ratio > CAST(0.05 AS FLOAT) THEN 'BLEND_WITH_ORIGINAL' ELSE 'KEEP_RECONSTRUCTED' END AS action FROM a""")
def burst_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fusion, tile confidence and the guard's decision over the bytes of pages."""
    frames = table(spark, sf_dir, "pages").select("page_id", F.expr("page_id div 4").alias("burst"), F.encode("html", "utf-8").alias("plane"))
    found = bands.burst_guard(frames, ["burst"], "page_id", "plane", F.lit(64), F.lit(400), 8, 4)
    return found.select("burst", "frames", "n_high", "n_far", rounded(F.col("confidence_mean")).alias("confidence_mean"), "action")


@query(f"""WITH {_BYTES_SQL}, s AS (SELECT page_id, CAST(count(*) AS BIGINT) AS n, CAST(sum(v) AS BIGINT) AS sum, CAST(sum(v * v) AS BIGINT) AS sq, count(*) FILTER (v <= 2 OR v >= 253) AS clipped FROM v WHERE i % 4 = 0 GROUP BY page_id)
    SELECT f.page_id, coalesce(n, 0) AS n, coalesce(clipped, 0) AS clipped, round(CASE WHEN n > 0 THEN CAST(n * sq - sum * sum AS DOUBLE) / CAST(n * n AS DOUBLE) ELSE 0 END, 4) AS variance FROM f LEFT JOIN s ON s.page_id = f.page_id""")
def binary_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    frames = table(spark, sf_dir, "pages").select("page_id", F.encode("html", "utf-8").alias("plane"))
    return bands.with_binary_quality(frames, "plane").select("page_id", "n", "clipped", F.round("variance", 4).alias("variance"))


@query(f"""WITH {PLANE_SQL}, l AS (SELECT vec_id, label, lag(vec_id) OVER (PARTITION BY label ORDER BY vec_id) AS before FROM embeddings),
    d AS (SELECT l.vec_id, CAST(sum(abs(a.v - b.v)) AS FLOAT) / CAST(count(*) AS FLOAT) AS diff FROM l JOIN planes a ON a.vec_id = l.vec_id JOIN planes b ON b.vec_id = l.before AND b.idx = a.idx WHERE a.idx % 16 = 0 GROUP BY l.vec_id)
    SELECT l.vec_id, round(CAST(coalesce(d.diff * CAST(0.1 AS FLOAT), 0) AS DOUBLE), 4) AS delta, coalesce(d.diff < 2, TRUE) AS is_tripod FROM l LEFT JOIN d USING (vec_id)""")
def motion_vector(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = P.motion_vectors(planes(spark, sf_dir), ["label"], "vec_id", "plane")
    return found.select("vec_id", rounded(F.col("delta")).alias("delta"), "is_tripod")


@query(f"""WITH {PLANE_SQL}, l AS (SELECT vec_id, label, lag(vec_id) OVER (PARTITION BY label ORDER BY vec_id) AS before FROM embeddings),
    d AS (SELECT l.vec_id, CAST(sum(abs(a.v - b.v)) AS FLOAT) / CAST(count(*) AS FLOAT) AS diff FROM l JOIN planes a ON a.vec_id = l.vec_id JOIN planes b ON b.vec_id = l.before AND b.idx = a.idx WHERE a.idx % 16 = 0 GROUP BY l.vec_id),
    g AS (SELECT vec_id, CAST(vec_id % 3 + vec_id % 5 AS DOUBLE) / 50 AS turn FROM embeddings)
    SELECT l.vec_id, round(turn, 4) AS angular_velocity, CASE WHEN d.diff IS NULL THEN turn < 0.05 ELSE turn < 0.03 AND d.diff < 2 END AS is_tripod FROM l JOIN g USING (vec_id) LEFT JOIN d USING (vec_id)""")
def motion_gyro(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Motion with a gyroscope that turns about two axes."""
    turn = F.array(*[(x / F.lit(50)).cast("float") for x in (F.col("vec_id") % 3, F.lit(0), F.col("vec_id") % 5)])
    found = P.motion_vectors(planes(spark, sf_dir), ["label"], "vec_id", "plane", turn)
    return found.select("vec_id", rounded(F.col("angular_velocity")).alias("angular_velocity"), "is_tripod")


@query(f"""WITH {PLANE_SQL}, f AS (SELECT label, idx, sum(v) // count(*) AS r FROM planes GROUP BY ALL)
    SELECT vec_id, idx, CAST(trunc(CAST(r AS FLOAT) * CAST(0.65 AS FLOAT) + CAST(v AS FLOAT) * (CAST(1 AS FLOAT) - CAST(0.65 AS FLOAT))) AS BIGINT) AS blended FROM planes JOIN f USING (label, idx)""")
def guard_blend(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = planes(spark, sf_dir)
    fused = P.temporal_fusion(rows, ["label"], "plane", "vec_id")
    pixels = rows.select("vec_id", "label", F.posexplode("plane").alias("idx", "v")).join(fused, ["label", "idx"])
    return pixels.select("vec_id", "idx", P.blend(F.array("fused"), F.array("v"))[0].alias("blended"))


@query("SELECT doc_id, 'FFD8FFE0' || hex(encode(text)) AS jpeg, '49492A00' || hex(encode(text)) AS dng FROM documents")
def encode_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.encode("text", "utf-8")
    return table(spark, sf_dir, "documents").select("doc_id", F.hex(P.encode_jpeg(raw)).alias("jpeg"), F.hex(P.encode_dng(raw)).alias("dng"))


@query("SELECT doc_id, 'FFD8FFE0' || hex(encode(text)) AS jpeg, '49492A00' || hex(encode(text)) AS dng FROM documents")
def encode_headers_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``encode_headers`` over buffers of any length."""
    raw = F.encode("text", "utf-8")
    return table(spark, sf_dir, "documents").select("doc_id", F.hex(P.encode_jpeg(raw)).alias("jpeg"), F.hex(P.encode_dng(raw)).alias("dng"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN o_orderkey * 10 ELSE coalesce(b, 0) END AS bytes FROM orders LEFT JOIN (SELECT l_orderkey, sum(length(l_returnflag || l_linestatus)) AS b FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey")
def frame_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_list(F.struct(F.concat("l_returnflag", "l_linestatus").alias("buffer"))).alias("planes"))
    rows = table(spark, sf_dir, "orders").join(held, F.col("l_orderkey") == F.col("o_orderkey"), "left")
    handle = F.when(F.col("o_orderkey") % 4 == 0, F.col("o_orderkey") * 10)
    return rows.select("o_orderkey", P.frame_bytes(handle, F.coalesce("planes", F.array().cast("array<struct<buffer:string>>"))).alias("bytes"))


# -- streams -------------------------------------------------------------------------------------


@query("""WITH e AS (SELECT event_id, user_id, event_type <> 'error' AS rec, sum(CASE WHEN event_type <> 'error' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS n FROM events)
    SELECT event_id, user_id, NOT rec AS is_dropped, rec AND n % 15 = 0 AS is_enhanced FROM e""")
def keyframes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = events(spark, sf_dir).select("event_id", "user_id", "us", "event_type")
    return S.keyframes(rows, ["user_id"], "us", 15, F.col("event_type") != "error").select("event_id", "user_id", "is_dropped", "is_enhanced")


STATE_OF = {"signup": "INITIALIZING", "view": "READY", "click": "CAPTURING", "purchase": "PROCESSING", "error": "ERROR"}
_STATE_SQL = "CASE event_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in STATE_OF.items()) + " END"
_LEGAL_SQL = "(VALUES " + ", ".join(f"('{a}', '{b}')" for a, bs in C.TRANSITIONS.items() for b in bs) + ") t(source, target)"


def state(kind: Column) -> Column:
    return F.create_map(*[F.lit(x) for kv in STATE_OF.items() for x in kv])[kind]


@query(f"""WITH e AS (SELECT event_id, user_id, {_STATE_SQL} AS target, lag({_STATE_SQL}) OVER (PARTITION BY user_id ORDER BY ts) AS source FROM events)
    SELECT event_id, user_id, source, target, (source, target) IN (SELECT (source, target) FROM {_LEGAL_SQL}) AS is_legal FROM e WHERE source IS NOT NULL""")
def state_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    rows = events(spark, sf_dir).withColumn("target", state(F.col("event_type")))
    rows = rows.withColumn("source", F.lag("target").over(Window.partitionBy("user_id").orderBy("us"))).where("source is not null")
    return rows.select("event_id", "user_id", "source", "target", S.legal(F.col("source"), F.col("target")).alias("is_legal"))


@query(f"""WITH RECURSIVE e AS (SELECT user_id AS session, {_STATE_SQL} AS requested, row_number() OVER (PARTITION BY user_id ORDER BY ts) AS i FROM events),
    r AS (SELECT DISTINCT session, CAST(0 AS BIGINT) AS i, 'UNINITIALIZED' AS state, CAST(0 AS BIGINT) AS yes FROM e UNION ALL
        SELECT r.session, e.i, CASE WHEN t.source IS NULL THEN r.state ELSE e.requested END, r.yes + CASE WHEN t.source IS NULL THEN 0 ELSE 1 END
        FROM r JOIN e ON e.session = r.session AND e.i = r.i + 1 LEFT JOIN {_LEGAL_SQL} ON t.source = r.state AND t.target = e.requested)
    SELECT session, arg_max(state, i) AS final_state, max(yes) AS accepted, max(i) - max(yes) AS rejected FROM r GROUP BY session""")
def state_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = events(spark, sf_dir).select(F.col("user_id").alias("session"), F.col("us").alias("seq"), state(F.col("event_type")).alias("requested"))
    return S.replay_states(rows, "session")


# -- rules ---------------------------------------------------------------------------------------

_PROFILES = [p[0] for p in C.PROFILES]
_MODES = ["AUTO", "PRO", "MASTER", "AUTHENTIC"]
_PROFILE_SQL = "CASE event_id % 3 " + " ".join(f"WHEN {i} THEN '{p}'" for i, p in enumerate(_PROFILES)) + " END"
_BURST_SQL = "(VALUES " + ", ".join(f"('{p[0]}', {12 if p[6] is None else p[6]}, {4 if p[7] is None else p[7]})" for p in C.PROFILES) + ") b(profile_id, normal, throttled)"
_RAW_SQL = "(VALUES " + ", ".join(f"('{c[0]}', {c[4]})" for c in C.CAMERAS if c[1] == "0") + ") c(profile_id, has_raw)"


def pick(values: list[str], at: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (at + 1).cast("int"))


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as capture requests: the value, scaled, as light; every eleventh has manual values."""
    manual = F.col("event_id") % 11 == 0
    return events(spark, sf_dir).select(
        "event_id", pick(_MODES, F.col("event_id") % 4).alias("mode"), (F.col("value") * (F.col("event_id") % 20)).cast("float").alias("lux"), (F.col("event_id") % 8).cast("float").alias("delta_x"),
        ((F.col("event_id") % 10) * F.lit(0.06)).cast("float").alias("angular_velocity"), pick(_PROFILES, F.col("event_id") % 3).alias("profile_id"),
        F.when(manual, 123).alias("manual_iso"), F.when(manual & (F.col("event_id") % 2 == 0), F.lit(777).cast("bigint")).alias("manual_exposure_ns"),
    )


@query(f"""WITH q AS (SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'AUTO' WHEN 1 THEN 'PRO' WHEN 2 THEN 'MASTER' ELSE 'AUTHENTIC' END AS mode, CAST(value * (event_id % 20) AS FLOAT) AS lux, CAST(event_id % 8 AS FLOAT) AS dx,
        CAST((event_id % 10) * CAST(0.06 AS DOUBLE) AS FLOAT) AS av, {_PROFILE_SQL} AS profile_id, event_id % 11 = 0 AND event_id % 2 = 0 AS manual FROM events),
    f AS (SELECT *, lux < 30 AS low, av > CAST(0.4 AS FLOAT) OR dx > 5 AS fast FROM q JOIN {_BURST_SQL} USING (profile_id) JOIN {_RAW_SQL} USING (profile_id)),
    n AS (SELECT *, CASE WHEN manual THEN 123 WHEN lux > 1000 THEN 50 WHEN lux > 200 THEN 100 WHEN lux > 30 THEN 400 WHEN fast THEN 1600 ELSE 800 END AS iso,
        CASE WHEN manual THEN 777 WHEN lux > 1000 THEN 1000000 WHEN lux > 200 THEN 4000000 WHEN lux > 30 OR fast THEN 16000000 ELSE 40000000 END AS exposure_ns,
        CASE mode WHEN 'AUTO' THEN CASE WHEN fast THEN 3 WHEN low THEN least(8, normal) ELSE 4 END WHEN 'PRO' THEN CASE WHEN fast THEN 1 ELSE 3 END
             WHEN 'MASTER' THEN CASE WHEN fast THEN least(5, normal) ELSE least(12, normal) END ELSE CASE WHEN low THEN 4 ELSE 2 END END AS frame_count FROM f)
    SELECT event_id, mode, low AS is_low_light, fast AS is_high_motion, iso, exposure_ns, frame_count, CASE WHEN mode = 'MASTER' AND (low OR lux > 1000) THEN 3 ELSE 0 END AS bracket_count,
        CASE WHEN mode = 'AUTO' THEN has_raw AND low ELSE has_raw END AS use_raw, mode = 'MASTER' OR frame_count > 1 AS enable_fusion, '0' AS target_camera FROM n""")  # fmt: skip
def capture_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = R.capture_plans(requests(spark, sf_dir), C.cameras(spark), C.device_profiles(spark))
    return found.select("event_id", "mode", "is_low_light", "is_high_motion", "iso", "exposure_ns", "frame_count", F.size("bracket_steps").alias("bracket_count"), "use_raw", "enable_fusion", "target_camera")


@query(f"""WITH q AS (SELECT event_id, event_id % 7 AS level, {_PROFILE_SQL} AS profile_id FROM events)
    SELECT event_id, level, CASE WHEN level <= 1 THEN normal WHEN level = 2 THEN greatest(normal // 2, 3) ELSE throttled END AS max_burst, level >= 2 AS throttle FROM q JOIN {_BURST_SQL} USING (profile_id)""")
def thermal_burst(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = requests(spark, sf_dir).select("event_id", "profile_id", (F.col("event_id") % 7).cast("int").alias("level")).join(F.broadcast(C.device_profiles(spark)), "profile_id")
    return rows.select("event_id", "level", R.burst_limit(F.col("level"), F.col("burst_normal"), F.col("burst_throttled")).alias("max_burst"), R.throttles(F.col("level")).alias("throttle"))


_MODEL_IDS = [m[0] for m in C.MODELS] + ["no-such-model"]
_MODELS_SQL = "(VALUES " + ", ".join(f"('{m[0]}', {m[12]}, {'NULL' if m[16] is None else repr(m[16])}, {m[17]}, {'NPU' in ' '.join(m[11])}, {'GPU' in ' '.join(m[11])}, {m[5]}, {m[13]})" for m in C.MODELS) + ") m(model_id, mem, fb, classical, npu, gpu, size, latency)"
_USABLE_SQL = "(VALUES " + ", ".join(f"('{p}', {any(b[0] == p and b[1] == C.NPU for b in C.BACKENDS)}, {any(b[0] == p and b[1] == C.GPU for b in C.BACKENDS)})" for p in _PROFILES) + ") u(profile_id, has_npu, has_gpu)"
_ASKED_SQL = "CASE event_id % 6 " + " ".join(f"WHEN {i} THEN '{m}'" for i, m in enumerate(_MODEL_IDS)) + " END"
_SCHEDULE_SQL = f"""q AS (SELECT event_id, {_ASKED_SQL} AS model_id, event_id % 5 AS level, event_id % 3000 * 1000000 AS held, 2621440000 AS budget, {_PROFILE_SQL} AS profile_id FROM events),
    j AS (SELECT q.*, normal, throttled, m.mem, m.classical, coalesce(m.fb, '{C.CLASSICAL}') AS fallback, CASE WHEN has_npu AND npu THEN '{C.NPU}' WHEN has_gpu AND gpu THEN '{C.GPU}' ELSE '{C.CPU}' END AS backend, m.model_id IS NULL AS unknown,
        level >= 3 AS hot, held + m.mem > budget AS tight, CASE WHEN level <= 1 THEN normal WHEN level = 2 THEN greatest(normal // 2, 3) ELSE throttled END AS frames
        FROM q JOIN {_BURST_SQL} USING (profile_id) JOIN {_USABLE_SQL} USING (profile_id) LEFT JOIN {_MODELS_SQL} ON m.model_id = q.model_id),
    s AS (SELECT event_id, model_id, profile_id, CASE WHEN unknown THEN '{C.CLASSICAL}' WHEN hot OR tight THEN fallback ELSE model_id END AS selected_model, CASE WHEN unknown OR hot OR tight THEN '{C.CPU}' ELSE backend END AS selected_backend,
        CASE WHEN unknown THEN 1 WHEN hot THEN frames WHEN tight THEN 2 ELSE frames END AS max_frames, CASE WHEN unknown OR hot OR tight THEN TRUE ELSE classical END AS use_fallback,
        CASE WHEN unknown THEN 'unknown model' WHEN hot THEN 'thermal' WHEN tight THEN 'memory pressure' ELSE 'scheduled' END AS reason FROM j)"""


def schedule_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).select("event_id", pick(_MODEL_IDS, F.col("event_id") % 6).alias("model_id"), (F.col("event_id") % 5).cast("int").alias("thermal_level"), (F.col("event_id") % 3000 * 1_000_000).alias("allocated_bytes"), F.lit(2500 * C.MIB).cast("bigint").alias("budget_bytes"), pick(_PROFILES, F.col("event_id") % 3).alias("profile_id"))


@query(f"WITH {_SCHEDULE_SQL} SELECT * FROM s")
def schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = R.schedules(schedule_requests(spark, sf_dir), C.models(spark), C.device_profiles(spark), C.backends(spark))
    return found.drop("thermal_level", "allocated_bytes", "budget_bytes")


@query(f"WITH {_SCHEDULE_SQL} SELECT event_id, CASE WHEN selected_backend <> '{C.NPU}' THEN selected_backend ELSE 'PASSTHROUGH' END AS ran_on FROM s")
def dispatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = R.schedules(schedule_requests(spark, sf_dir), C.models(spark), C.device_profiles(spark), C.backends(spark))
    return R.dispatch(found, [C.GPU, C.CPU]).select("event_id", "ran_on")


@query(f"SELECT p_partkey, p_size - 10 AS fps, CASE WHEN p_size <= 10 THEN 33 ELSE 1000 // (p_size - 10) END AS budget_ms, model_id, latency <= CASE WHEN p_size <= 10 THEN 33 ELSE 1000 // (p_size - 10) END AS is_within FROM part JOIN {_MODELS_SQL} ON model_id = list_value({', '.join(repr(m) for m in _MODEL_IDS[:5])})[p_partkey % 5 + 1]")
def latency_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").select("p_partkey", (F.col("p_size") - 10).alias("fps"), pick(_MODEL_IDS[:5], F.col("p_partkey") % 5).alias("model_id"))
    rows = rows.join(F.broadcast(C.models(spark).select("model_id", "expected_latency_ms")), "model_id").withColumn("budget_ms", R.latency_budget_ms(F.col("fps")))
    return rows.select("p_partkey", "fps", "budget_ms", "model_id", (F.col("expected_latency_ms") <= F.col("budget_ms")).alias("is_within"))


_SIZES_SQL = "(SELECT p_brand, p_partkey AS pos, p_size * 60 AS w, CAST(floor(p_retailprice) AS BIGINT) % 1500 + 100 AS h FROM part)"


def sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_brand", F.col("p_partkey").alias("input_pos"), (F.col("p_size") * 60).alias("width"), (F.floor("p_retailprice") % 1500 + 100).cast("int").alias("height"))


@query(f"""WITH s AS (SELECT *, w * h AS area, abs(CAST(w AS FLOAT) / CAST(h AS FLOAT) - CAST({16 / 9} AS FLOAT)) AS off FROM {_SIZES_SQL})
    SELECT p_brand, coalesce(first(w || 'x' || h ORDER BY off, pos) FILTER (w <= 1920 AND h <= 1080), first(w || 'x' || h ORDER BY pos)) AS preview,
        coalesce(first(w || 'x' || h ORDER BY area DESC, pos) FILTER (w <= 1280), first(w || 'x' || h ORDER BY area, pos)) AS analysis, first(w || 'x' || h ORDER BY area DESC, pos) AS largest FROM s GROUP BY p_brand""")
def size_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = R.best_sizes(sizes(spark, sf_dir), ["p_brand"])
    return found.select("p_brand", *[L.size_label(F.col(f"{c}.width"), F.col(f"{c}.height")).alias(c) for c in ("preview", "analysis", "largest")])


@query(f"SELECT p_brand, count(*) AS n FROM (SELECT DISTINCT p_brand, w, h FROM {_SIZES_SQL}) GROUP BY p_brand")
def distinct_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sizes(spark, sf_dir).select("p_brand", "width", "height").distinct().groupBy("p_brand").agg(F.count("*").alias("n"))


@query("""WITH m AS (SELECT p_partkey, CASE WHEN p_size % 7 = 0 THEN ' ' ELSE p_brand END AS id, CASE WHEN p_size % 5 = 0 THEN '' ELSE p_name END AS license, p_size % 3 = 0 AS classical, p_size - 10 AS size, p_size % 4 AS backends, CAST(floor(p_retailprice) AS BIGINT) % 6 AS mem, p_size - 25 AS latency,
        CASE WHEN p_size % 2 = 0 THEN p_type END AS fb FROM part),
    i AS (SELECT p_partkey, list_filter([CASE WHEN trim(id) = '' THEN 'modelId cannot be blank' END, CASE WHEN trim(license) = '' THEN 'license cannot be blank' END, CASE WHEN NOT classical AND size <= 0 THEN 'Neural model size must be greater than 0 bytes' END,
        CASE WHEN backends = 0 THEN 'supportedBackends cannot be empty' END, CASE WHEN mem <= 0 THEN 'memoryRequirement must be positive' END, CASE WHEN latency <= 0 THEN 'latencyExpectation must be positive' END,
        CASE WHEN NOT classical AND fb IS NULL THEN 'Neural models should specify a fallbackModelId for reliability' END], lambda x: x IS NOT NULL) AS issues FROM m)
    SELECT p_partkey, array_to_string(issues, '; ') AS issues, len(issues) = 0 AS is_valid FROM i""")
def manifest_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as manifests."""
    size = F.col("p_size")
    manifests = table(spark, sf_dir, "part").select(
        "p_partkey", F.when(size % 7 == 0, " ").otherwise(F.col("p_brand")).alias("model_id"), F.when(size % 5 == 0, "").otherwise(F.col("p_name")).alias("license"), (size % 3 == 0).alias("is_classical_fallback"), (size - 10).cast("bigint").alias("file_size_bytes"),
        F.slice(F.array(*[F.lit(b) for b in (C.NPU, C.GPU, C.CPU)]), F.lit(1), (size % 4).cast("int")).alias("supported_backends"), (F.floor("p_retailprice") % 6).alias("memory_requirement_bytes"), (size - 25).alias("expected_latency_ms"), F.lit("RAW").alias("input_format"), F.lit("RGB").alias("output_format"), F.when(size % 2 == 0, F.col("p_type")).alias("fallback_model_id"),
    )
    return R.manifest_issues(manifests).select("p_partkey", F.array_join("issues", "; ").alias("issues"), "is_valid")


_ASKED_SQL = "[" + ", ".join(f"'{m}'" for m in _MODEL_IDS) + "]"


def asked_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as requests for a model, known or not, on a device."""
    key = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select(key.alias("request_id"), pick(_MODEL_IDS, key % len(_MODEL_IDS)).alias("model_id"), pick(_PROFILES, key % len(_PROFILES)).alias("profile_id"))


@query(f"""SELECT o_orderkey AS request_id, q.model_id, CASE WHEN m.model_id IS NULL THEN '{C.CLASSICAL}' WHEN fb IS NULL AND classical THEN NULL ELSE coalesce(fb, '{C.CLASSICAL}') END AS fallback
    FROM (SELECT o_orderkey, {_ASKED_SQL}[o_orderkey % {len(_MODEL_IDS)} + 1] AS model_id FROM orders) q LEFT JOIN {_MODELS_SQL} ON m.model_id = q.model_id""")
def model_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.model_fallbacks(asked_models(spark, sf_dir).select("request_id", "model_id"), C.models(spark)).select("request_id", "model_id", "fallback")


@query(f"""SELECT o_orderkey AS request_id, q.profile_id, q.model_id, CASE WHEN has_npu AND npu THEN '{C.NPU}' WHEN has_gpu AND gpu THEN '{C.GPU}' ELSE '{C.CPU}' END AS backend
    FROM (SELECT o_orderkey, {_ASKED_SQL}[o_orderkey % {len(_MODEL_IDS)} + 1] AS model_id, {_PROFILES}[o_orderkey % {len(_PROFILES)} + 1] AS profile_id FROM orders) q
    LEFT JOIN {_USABLE_SQL} ON u.profile_id = q.profile_id LEFT JOIN {_MODELS_SQL} ON m.model_id = q.model_id""")
def backend_pick(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.with_backend(asked_models(spark, sf_dir), C.models(spark), C.backends(spark)).select("request_id", "profile_id", "model_id", "backend")


@query("""WITH c AS (SELECT o_custkey AS device_id, o_orderkey AS camera_id, ['BACK_WIDE', 'FRONT', 'EXTERNAL'][o_orderkey % 3 + 1] AS facing, CASE o_orderkey % 4 WHEN 1 THEN [o_orderkey, o_orderkey + 1, o_orderkey - 1] WHEN 2 THEN [o_orderkey + 32] ELSE [o_orderkey] END AS ids FROM orders),
    x AS (SELECT device_id, camera_id AS logical_id, unnest(ids) AS physical_id FROM c)
    SELECT x.device_id, logical_id, physical_id, c.facing FROM x JOIN c ON c.device_id = x.device_id AND c.camera_id = x.physical_id""")
def lens_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as devices, orders as their cameras, some of them logical ones over others that may not be there."""
    key = F.col("o_orderkey")
    physical = F.when(key % 4 == 1, F.array(key, key + 1, key - 1)).when(key % 4 == 2, F.array(key + 32)).otherwise(F.array().cast("array<bigint>"))
    cameras = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("device_id"), key.alias("camera_id"), pick(["BACK_WIDE", "FRONT", "EXTERNAL"], key % 3).alias("facing"), physical.alias("physical_ids"))
    return R.lens_map(cameras, ["device_id"]).select("device_id", "logical_id", "physical_id", "facing")


_FORMATS = ["PRIVATE", "YUV_420_888", "JPEG", "RAW_SENSOR", "RAW10"]


def listed_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as the sizes that a device (container) lists for a format; by its size, a device lacks some."""
    rows = table(spark, sf_dir, "part").where(F.pmod(F.length("p_type") + F.col("p_partkey") % 5, F.lit(4)) != 0)
    return rows.select(F.col("p_type").alias("device"), pick(_FORMATS, F.col("p_partkey") % 5).alias("format"), F.col("p_partkey").alias("input_pos"), (F.col("p_size") * 60).alias("width"), (F.floor("p_retailprice") % 1500 + 100).cast("int").alias("height"))


_PLANS_SQL = f"""s AS (SELECT p_type AS device, {_FORMATS}[p_partkey % 5 + 1] AS format, p_partkey AS pos, p_size * 60 AS w, CAST(floor(p_retailprice) AS INTEGER) % 1500 + 100 AS h FROM part WHERE (length(p_type) + p_partkey % 5) % 4 <> 0),
    o AS (SELECT *, w * h AS area, abs(CAST(w AS FLOAT) / CAST(h AS FLOAT) - CAST({16 / 9} AS FLOAT)) AS off FROM s),
    best AS (SELECT device, format, coalesce(first([w, h] ORDER BY off, pos) FILTER (w <= 1920 AND h <= 1080), first([w, h] ORDER BY pos)) AS preview,
        coalesce(first([w, h] ORDER BY area DESC, pos) FILTER (w <= 1280), first([w, h] ORDER BY area, pos)) AS analysis, first([w, h] ORDER BY area DESC, pos) AS largest FROM o GROUP BY ALL),
    u AS (SELECT * FROM (VALUES {", ".join(f"('{u}', {i}, '{x[0]}', '{x[1]}', '{x[2]}')" for u, xs in R.SESSION_STREAMS.items() for i, x in enumerate(xs))}) u(use_case, pos, role, format, sized)),
    d AS (SELECT p_type AS device, bool_or(p_partkey % 5 = 3 AND (length(p_type) + 3) % 4 <> 0) AS has_raw FROM part GROUP BY ALL),
    plans AS (SELECT d.device, use_case, pos, role, CASE WHEN format = 'RAW_SENSOR' AND NOT has_raw THEN 'RAW10' ELSE format END AS format, sized, count(*) OVER (PARTITION BY d.device, use_case) <= 3 AS is_supported FROM d, u)"""


@query(f"""WITH {_PLANS_SQL}, x AS (SELECT p.*, CASE sized WHEN 'preview' THEN coalesce(preview, [1920, 1080]) WHEN 'analysis' THEN coalesce(analysis, [640, 480]) ELSE coalesce(largest, [4000, 3000]) END AS z FROM plans p LEFT JOIN best b ON b.device = p.device AND b.format = p.format)
    SELECT device, use_case, pos, role, format, z[1] AS width, z[2] AS height, is_supported FROM x""")
def session_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Containers as devices whose parts are the sizes that they list."""
    devices = table(spark, sf_dir, "part").select(F.col("p_type").alias("device"))
    return R.session_plans(devices, ["device"], listed_sizes(spark, sf_dir)).select("device", "use_case", "pos", "role", "format", "width", "height", "is_supported")


@query(f"""WITH {_PLANS_SQL} SELECT p.device, use_case, CASE WHEN bool_and(is_supported) AND bool_and(b.format IS NOT NULL) THEN 'SUPPORTED' ELSE 'FAILED' END AS state
    FROM plans p LEFT JOIN best b ON b.device = p.device AND b.format = p.format GROUP BY ALL""")
def stream_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    devices, listed = table(spark, sf_dir, "part").select(F.col("p_type").alias("device")), listed_sizes(spark, sf_dir)
    return R.stream_matrix(R.session_plans(devices, ["device"], listed), listed, ["device"])


@query("""SELECT l_orderkey AS pipeline_id, coalesce(sum(l_partkey) FILTER (l_returnflag <> 'N'), 0) AS per_frame_bytes, CASE WHEN coalesce(sum(l_partkey) FILTER (l_returnflag <> 'N'), 0) = 0 THEN 'PASS' ELSE 'PARTIAL' END AS status FROM lineitem GROUP BY l_orderkey""")
def copy_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as pipelines, their items as copies, those returned or accepted for each frame."""
    often = F.when(F.col("l_returnflag") != "N", "Per Frame (30 FPS)").otherwise("Per Still Capture")
    copies = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("pipeline_id"), F.col("l_partkey").alias("bytes_moved"), often.alias("frequency"))
    return R.copy_audit(copies, ["pipeline_id"])


@query("""WITH RECURSIVE a AS (SELECT l_suppkey AS ledger, l_orderkey * 10 + l_linenumber AS seq, (CASE WHEN l_returnflag = 'R' THEN -1 ELSE 1 END) * CAST(l_quantity AS BIGINT) AS x FROM lineitem),
    o AS (SELECT ledger, x, row_number() OVER (PARTITION BY ledger ORDER BY seq, x) AS i FROM a),
    r AS (SELECT DISTINCT ledger, CAST(0 AS BIGINT) AS i, CAST(0 AS BIGINT) AS held, CAST(0 AS BIGINT) AS granted FROM o UNION ALL
        SELECT r.ledger, o.i, CASE WHEN x < 0 THEN greatest(held + x, 0) WHEN held + x <= 200 THEN held + x ELSE held END, granted + CASE WHEN x >= 0 AND held + x <= 200 THEN 1 ELSE 0 END
        FROM r JOIN o ON o.ledger = r.ledger AND o.i = r.i + 1)
    SELECT ledger, max(granted) AS granted, arg_max(held, i) AS allocated FROM r GROUP BY ledger""")
def memory_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("ledger"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"), (F.when(F.col("l_returnflag") == "R", -1).otherwise(1) * F.col("l_quantity").cast("bigint")).alias("amount"))
    return R.memory_ledger(rows, ["ledger"], "seq", 200)


# -- catalogs, sinks and labels ------------------------------------------------------------------


@query(f"SELECT event_id, scene_id, category, base AS baseline_psnr_min FROM events JOIN {SCENES_SQL} ON s.i = event_id % {len(C.SCENES)} WHERE category IN ('TEXT', 'SKIN')")
def scenes_by_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as shots of the scenes; those of two categories."""
    shots = events(spark, sf_dir).select("event_id", pick([x[0] for x in C.SCENES], F.col("event_id") % len(C.SCENES)).alias("scene_id"))
    return shots.join(F.broadcast(C.scenes(spark).where(F.col("category").isin("TEXT", "SKIN"))), "scene_id").select("event_id", "scene_id", "category", "baseline_psnr_min")


_ERRORS_SQL = "(VALUES " + ", ".join(f"({i}, '{a}', '{b}', {c})" for i, (a, b, c) in enumerate(C.ERRORS)) + ") e(i, family, code, is_recoverable)"


@query(f"SELECT family, count(*) AS n, count(*) FILTER (is_recoverable) AS n_recoverable, count(DISTINCT code) AS n_codes FROM events JOIN {_ERRORS_SQL} ON e.i = event_id % {len(C.ERRORS)} WHERE event_type = 'error' GROUP BY family")
def error_taxonomy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Error events by the family of their code."""
    met = events(spark, sf_dir).where("event_type = 'error'").select(pick([x[1] for x in C.ERRORS], F.col("event_id") % len(C.ERRORS)).alias("code"))
    known = met.join(F.broadcast(C.errors(spark)), "code")
    return known.groupBy("family").agg(F.count("*").alias("n"), F.count_if("is_recoverable").alias("n_recoverable"), F.count_distinct("code").alias("n_codes"))


def version_places(parts: DataFrame) -> DataFrame:
    rows = parts.select("p_partkey", (F.col("p_size") % 3).alias("major"), (F.col("p_size") % 5).alias("minor"), (F.col("p_size") % 7).alias("patch"))
    return ranking.places(rows, ["major", "minor", "patch", "p_partkey"]).select("p_partkey", "place")


@query("SELECT p_partkey, CAST(row_number() OVER (ORDER BY p_size % 3, p_size % 5, p_size % 7, p_partkey) AS BIGINT) AS place FROM part")
def version_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return version_places(table(spark, sf_dir, "part"))


@query("SELECT p_partkey, CAST(row_number() OVER (ORDER BY p_size % 3, p_size % 5, p_size % 7, p_partkey) AS BIGINT) AS place FROM part")
def version_order_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``version_order`` over all parts."""
    return version_places(table(spark, sf_dir, "part"))


@query("""SELECT 'c' || c_custkey AS profile_id, CASE WHEN c_nationkey = 0 THEN CAST(8589934592 AS BIGINT) ELSE c_custkey * 1024 END AS total_ram_bytes, CASE WHEN c_custkey % 3 = 0 THEN 34 ELSE c_nationkey END AS os_version_sdk, 1 AS profile_version, c_custkey % 2 = 0 AS verified FROM customer""")
def profile_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as device profiles, written as text and read back; some values are lost on the way."""
    fields = C.device_profiles(spark).schema
    key = F.col("c_custkey")
    given = {"profile_id": F.concat(F.lit("c"), key.cast("string")), "manufacturer": F.col("c_mktsegment"), "device_model": F.col("c_name"), "soc_family": F.col("c_mktsegment"), "total_ram_bytes": key * 1024, "os_version_sdk": F.col("c_nationkey"), "verified": key % 2 == 0}
    profiles = table(spark, sf_dir, "customer").select(*[given.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in fields], (F.col("c_nationkey") == 0).alias("_no_ram"), (key % 3 == 0).alias("_bad_sdk"))
    cameras = table(spark, sf_dir, "orders").select(F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("profile_id"))
    lost = profiles.select("profile_id", "_no_ram", "_bad_sdk")
    stored = sinks.to_key_values(profiles.drop("_no_ram", "_bad_sdk"), cameras).join(lost, "profile_id")
    kept = F.map_filter("data", lambda k, v: ~((k == "totalRamBytes") & F.col("_no_ram")))
    changed = F.transform_values(kept, lambda k, v: F.when((k == "osVersionSdk") & F.col("_bad_sdk"), F.lit("unreadable")).otherwise(v))
    return stored.select(changed.alias("data")).select(*sinks.from_key_values(F.col("data"))).select("profile_id", "total_ram_bytes", "os_version_sdk", "profile_version", "verified")


@query("""SELECT 'c' || c_custkey || '_' || x.n AS name, x.c AS content FROM customer, LATERAL (VALUES ('ORIGINAL.jpg', c_name), ('MASTER.jpg', c_mktsegment), ('META.json', '{"media_id": "c' || c_custkey || '", "capture": {"n": ' || c_nationkey || '}, "processing": {}}')) x(n, c)""")
def media_bundle(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer").select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("media_id"), F.encode("c_name", "utf-8").alias("original"), F.encode("c_mktsegment", "utf-8").alias("master"), F.concat(F.lit('{"n": '), F.col("c_nationkey").cast("string"), F.lit("}")).alias("capture_json"), F.lit("{}").alias("processing_json"), F.lit("jpg").alias("format"), F.col("c_custkey").alias("seq"))
    return sinks.media_files(rows, "seq").select("name", F.decode("content", "utf-8").alias("content"))


@query("""SELECT '{"n_nationkey":' || n_nationkey || ',"n_name":"' || n_name || '"}' AS value FROM nation""")
def json_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sinks.json_lines(table(spark, sf_dir, "nation").select("n_nationkey", "n_name"))


_LEVELS_SQL = " ".join(f"WHEN {k} THEN '{v}'" for k, v in readers.HARDWARE_LEVELS.items())
_FORMATS_SQL = " ".join(f"WHEN {k} THEN '{v}'" for k, v in readers.FORMATS.items())


@query(f"""SELECT CAST(c_custkey AS VARCHAR) AS camera_id, CASE c_nationkey {_LEVELS_SQL} ELSE 'UNKNOWN_' || c_nationkey END AS hardware_level, CASE 30 + c_nationkey {_FORMATS_SQL} ELSE 'FORMAT_' || (30 + c_nationkey) END AS format, CASE WHEN c_custkey % 2 = 0 THEN c_custkey ELSE 100 END AS iso_lo, 3200 AS iso_hi,
    90 AS sensor_orientation, CASE WHEN c_custkey % 4 > 0 THEN round(1.0::DOUBLE / (c_custkey % 4), 6) ELSE 0.1 END AS focus_distance, 'AE_MODE_' || c_nationkey AS ae_mode, 30 + c_nationkey IN (32, 37) AS has_raw FROM customer""")
def camera_discovery(spark: SparkSession, sf_dir: str) -> DataFrame:
    none = F.lit(None).cast("bigint")
    raw = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").cast("string").alias("camera_id"), F.col("c_nationkey").alias("level"), F.array(F.lit(30) + F.col("c_nationkey")).alias("formats"), F.when(F.col("c_custkey") % 2 == 0, F.col("c_custkey")).alias("iso_lo"), none.alias("iso_hi"),
        none.alias("exposure_lo"), none.alias("exposure_hi"), none.alias("orientation"), (F.col("c_custkey") % 4).alias("min_focus"), F.array("c_nationkey").alias("ae_modes"),
    )
    found = readers.camera_profiles(raw)
    return found.select("camera_id", "hardware_level", F.col("formats")[0].alias("format"), F.col("iso_range.lo").alias("iso_lo"), F.col("iso_range.hi").alias("iso_hi"), "sensor_orientation", F.round("focus_distance", 6).alias("focus_distance"), F.col("ae_modes")[0].alias("ae_mode"), "has_raw")


@query(f"""SELECT CAST(c_custkey AS VARCHAR) AS camera_id, CASE c_nationkey {_LEVELS_SQL} ELSE 'UNKNOWN_' || c_nationkey END AS hardware_level, 30 + c_nationkey IN (32, 37) AS has_raw, c_nationkey % 2 = 1 AS stabilised FROM customer WHERE c_custkey % 10 > 0""")
def camera_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as cameras in files of JSON lines, a tenth of them cut off: each whole line is a camera."""
    code = F.col("c_nationkey")
    line = F.to_json(F.struct(F.col("c_custkey").cast("string").alias("camera_id"), code.alias("level"), F.array(F.lit(30) + code).alias("formats"), F.array(code % 2).alias("ois")))
    path = scratch(spark, "camera-files")
    table(spark, sf_dir, "customer").select(F.when(F.col("c_custkey") % 10 == 0, F.substring(line, 1, 12)).otherwise(line).alias("value")).write.text(path)
    found = readers.camera_records(readers.camera_scan(spark, path), [])
    return found.select("camera_id", "hardware_level", "has_raw", F.array_contains("ois_modes", "ON").alias("stabilised"))


_BUNDLE_SQL = """WITH o AS (SELECT o_custkey AS d, CAST(o_orderkey AS VARCHAR) AS id, o_orderkey % 3 AS lv, o_orderkey % 4 AS fo, o_orderkey % 5 AS wl, left(o_orderpriority, 1) AS pr FROM orders),
    c AS (SELECT d, CAST(count(*) AS VARCHAR) AS n,
        string_agg('{"cameraId":"' || id || '","hardwareLevel":"' || CASE lv WHEN 0 THEN 'LIMITED' WHEN 1 THEN 'FULL' ELSE 'LEGACY' END || '","lensFacing":"' || CASE lv WHEN 0 THEN 'FRONT' ELSE 'BACK_WIDE' END
            || '","sensorOrientation":90,"isLogical":' || CASE fo WHEN 1 THEN 'true,"physicalCameraIds":["' || id || 'a"]' ELSE 'false,"physicalCameraIds":[]' END
            || ',"sensor":{"activeArrayWidth":4000,"activeArrayHeight":3000,"pixelArrayWidth":4000,"pixelArrayHeight":3000,"physicalWidthMm":6.4,"physicalHeightMm":4.8,"isoRange":[' || (100 + wl) || ',3200],"exposureTimeRangeNs":[100000,1000000000],"colorFilterArrangement":"RGGB"}'
            || ',"lens":{"focalLengthsMm":[5.59],"apertures":[1.6],"minimumFocusDistanceMeters":' || CASE fo WHEN 0 THEN '0.1' WHEN 1 THEN '1.0' WHEN 2 THEN '0.5' ELSE '0.3333333333333333' END || ',"oisModes":["' || CASE lv WHEN 1 THEN 'ON' ELSE 'OFF' END || '"]}'
            || ',"threeA":{"aeModes":["AE_MODE_' || wl || '"],"afModes":[],"awbModes":[]}}', ',' ORDER BY id) AS cams,
        string_agg('"' || id || '":{"supportedProfiles":["SDR"' || CASE lv WHEN 0 THEN ',"HLG10"' WHEN 1 THEN ',"HDR10"' ELSE ',"HDR10_PLUS"' END || '],"constraints":{"SDR":["' || pr || '"]}}', ',' ORDER BY id) AS dyn,
        string_agg('{"cameraId":"' || id || '","activeArray":[4000,3000],"pixelArray":[4000,3000],"physicalSizeMm":[6.4,4.8],"blackLevelPattern":' || CASE fo WHEN 0 THEN 'null' ELSE '[' || fo || ',' || fo || ']' END || ',"whiteLevel":' || CASE wl WHEN 0 THEN 1023 ELSE wl END || '}', ',' ORDER BY id) AS sens,
        string_agg('{"combination":"' || id || '","streams":["P' || pr || '","YUV"],"state":"' || CASE wl WHEN 1 THEN 'FAILED' ELSE 'SUPPORTED' END || '","latencyMs":' || fo || '}', ',' ORDER BY id) AS strs FROM o GROUP BY d)
    SELECT c_custkey AS device_id, x.name, x.content FROM customer LEFT JOIN c ON c.d = c_custkey, LATERAL (VALUES
        ('device_profile.json', '{"timestamp":' || c_custkey || ',"deviceModel":"' || c_name || '","manufacturer":"' || c_mktsegment || '","brand":"b","product":"p","androidRelease":"14","sdkInt":34,"cameraCount":' || coalesce(n, '0') || ',"zeroCopyDesign":true,"zeroCopyHardwareState":"NOT_VERIFIED"}'),
        ('camera_profile.json', '{"cameras":[' || coalesce(cams, '') || ']}'), ('stream_profile.json', '{"streamMatrix":[' || coalesce(strs, '') || ']}'), ('dynamic_range_profile.json', '{"cameraDynamicRange":{' || coalesce(dyn, '') || '}}'), ('sensor_profile.json', '{"sensors":[' || coalesce(sens, '') || ']}'),
        ('verification.json', '{"phase":1,"timestamp":' || c_custkey || ',"status":"VERIFIED","device":"' || c_name || '","zeroCopyDesign":"PASS","zeroCopyHardware":"NOT_VERIFIED","actualBufferCopies":["none"],"notes":"a \\"quoted\\" note"}')) x(name, content)"""


@query(_BUNDLE_SQL)
def verification_bundle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as devices, their orders as cameras and as tested combinations."""
    order = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("device_id"), F.col("o_orderkey").cast("string").alias("id"), *[(F.col("o_orderkey") % n).cast("int").alias(x) for n, x in ((3, "lv"), (4, "fo"), (5, "wl"))], F.substring("o_orderpriority", 1, 1).alias("pr"))
    known = {
        "camera_id": F.col("id"), "level": F.col("lv"), "facing": F.col("lv"), "capabilities": F.when(F.col("fo") == 1, F.array(F.lit(11))), "physical_ids": F.when(F.col("fo") == 1, F.array(F.concat("id", F.lit("a")))), "ois": F.array("lv"),
        "ae_modes": F.array("wl"), "iso_lo": F.lit(100) + F.col("wl"), "min_focus": F.col("fo").cast("float"), "white_level": F.when(F.col("wl") > 0, F.col("wl")), "dynamic_ranges": F.array(F.expr("shiftleft(2, lv)")).cast("array<bigint>"),
    }
    fields = T.StructType.fromDDL(readers.CAMERA_SCHEMA).fields
    raw = order.select("device_id", F.when(F.col("fo") > 0, F.array("fo", "fo")).alias("black_level"), F.create_map(F.lit("SDR"), F.array("pr")).alias("constraints"), *[known.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in fields])
    cameras = readers.camera_records(raw, ["device_id", "black_level", "constraints"])
    streams = order.select("device_id", F.col("id").alias("combination"), F.array(F.concat(F.lit("P"), "pr"), F.lit("YUV")).alias("streams"), F.when(F.col("wl") == 1, "FAILED").otherwise("SUPPORTED").alias("state"), F.col("fo").alias("latency_ms"))
    devices = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("device_id"), F.col("c_custkey").alias("timestamp"), F.col("c_name").alias("device_model"), F.col("c_mktsegment").alias("manufacturer"), F.lit("b").alias("brand"), F.lit("p").alias("product"), F.lit("14").alias("android_release"), F.lit(34).alias("sdk_int"),
        F.lit(True).alias("zero_copy_design"), F.lit("NOT_VERIFIED").alias("zero_copy_state"), F.array(F.lit("none")).alias("buffer_copies"), F.lit('a "quoted" note').alias("notes"),
    )
    return sinks.verification_bundle(devices, cameras, streams)


@query("""SELECT sensor_type, timestamp_ns, event_id FROM (SELECT CASE event_type WHEN 'click' THEN 'GYROSCOPE' WHEN 'view' THEN 'ACCELEROMETER' ELSE 'OTHER' END AS sensor_type, user_id AS timestamp_ns, max(event_id) AS event_id FROM events GROUP BY ALL) WHERE sensor_type <> 'OTHER'""")
def imu_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("event_type") == "click", "GYROSCOPE").when(F.col("event_type") == "view", "ACCELEROMETER").otherwise("OTHER")
    return readers.imu_samples(events(spark, sf_dir).select(kind.alias("sensor_type"), F.col("user_id").alias("timestamp_ns"), "event_id"), "event_id")


@query("SELECT DISTINCT o_custkey % 100 AS frame_sequence, o_custkey % 7 AS timestamp_ns, o_orderstatus AS physical_camera_id FROM orders")
def frame_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select((F.col("o_custkey") % 100).alias("frame_sequence"), (F.col("o_custkey") % 7).alias("timestamp_ns"), F.col("o_orderstatus").alias("physical_camera_id"))
    return readers.distinct_frames(rows)


@query("SELECT p_partkey, p_size * 60 || 'x' || p_size AS size, CASE WHEN p_size > 25 THEN '+' ELSE '' END || (p_size - 25) AS ev, CAST(trunc(p_size * 60 * p_size * 1.5) AS BIGINT) AS yuv_bytes, '1/' || (1000000000 // (p_size * 1000000)) || 's' AS shutter, p_size || ' ms (1/' || (1000000000 // (p_size * 1000000)) || 's)' AS exposure FROM part")
def display_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.col("p_size")
    return table(spark, sf_dir, "part").select("p_partkey", L.size_label(size * 60, size).alias("size"), L.ev_label(size - 25).alias("ev"), L.yuv_bytes(size * 60, size).alias("yuv_bytes"), L.shutter_label(size.cast("bigint") * 1_000_000).alias("shutter"), L.exposure_label(size.cast("bigint") * 1_000_000).alias("exposure"))
