"""Event and change logs: batch forms, and the same as Structured Streaming.

Late events are dropped behind WATERMARK; that policy is this engine's own. Streams read a folder of
Parquet files, keep their progress in a checkpoint of the shared folder, and write each version of
their result there.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from leafline.plans.registry import register
from leafline.plans.scratch import scratch
from leafline.plans.tables import load

WATERMARK, KEPT_EVENTS = "1 hour", 50


def byte_totals(df: DataFrame, kind: str, size: str, by: list[Column]) -> DataFrame:
    """Bytes per group: to servers, directly between peers, and visits."""
    part = lambda k: F.sum(F.when(k, F.col(size)).otherwise(0)).alias
    direct, visit = F.col(kind).isin("peer", "click"), F.col(kind) == "view"
    return df.groupBy(*by).agg(part(~direct & ~visit)("server"), part(direct)("direct"), part(visit)("visit"))


def events(spark: SparkSession, sf_dir: str, stream: bool = False) -> DataFrame:
    batch = load(spark, sf_dir, "events")
    df = spark.readStream.schema(batch.schema).parquet(f"{sf_dir}/events*.parquet") if stream else batch
    return df.withColumns({"ts": F.col("ts").cast("timestamp"), "size": (F.col("event_id") % 997 + 1).cast("long")})


def run_to_end(df: DataFrame, name: str) -> DataFrame:
    """Runs a stream over what is there and gives its last complete result."""
    spark = df.sparkSession
    out = scratch(spark, name)

    def put(part: DataFrame, batch: int) -> None:
        part.write.mode("overwrite").parquet(f"{out}/result")

    query = df.writeStream.outputMode("complete").option("checkpointLocation", f"{out}/progress").trigger(availableNow=True).foreachBatch(put).start()
    try:
        query.awaitTermination()
    finally:
        query.stop()
    return spark.read.parquet(f"{out}/result")


DAY_SQL = """SELECT CAST(ts AS DATE) AS day, CAST(sum(CASE WHEN event_type NOT IN ('peer', 'click', 'view') THEN event_id % 997 + 1 ELSE 0 END) AS BIGINT) AS server,
  CAST(sum(CASE WHEN event_type IN ('peer', 'click') THEN event_id % 997 + 1 ELSE 0 END) AS BIGINT) AS direct, CAST(sum(CASE WHEN event_type = 'view' THEN event_id % 997 + 1 ELSE 0 END) AS BIGINT) AS visit FROM events GROUP BY 1"""


@register("meter_totals", DAY_SQL)
def meter_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_totals(events(spark, sf_dir), "event_type", "size", [F.to_date("ts").alias("day")])


@register("meter_totals_stream", DAY_SQL)
def meter_totals_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = events(spark, sf_dir, stream=True).withWatermark("ts", WATERMARK)
    out = run_to_end(byte_totals(df, "event_type", "size", [F.window("ts", "1 day").alias("w")]), "meter")
    return out.select(F.to_date("w.start").alias("day"), "server", "direct", "visit")


SESSIONS_SQL = """WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 1 HOUR THEN 0 ELSE 1 END AS s FROM events),
  n AS (SELECT *, sum(s) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
  SELECT user_id, min(ts) AS started, count(*) AS events FROM n GROUP BY user_id, k"""


@register("sessions", SESSIONS_SQL)
def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of a user that follow within an hour are one session."""
    out = events(spark, sf_dir).groupBy("user_id", F.session_window("ts", "1 hour").alias("w")).agg(F.count(F.lit(1)).alias("events"))
    return out.select("user_id", F.col("w.start").alias("started"), "events")


@register("newest_events", f"SELECT event_id FROM events ORDER BY ts DESC, event_id DESC LIMIT {KEPT_EVENTS}")
def newest_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "events").orderBy(F.desc("ts"), F.desc("event_id")).limit(KEPT_EVENTS).select("event_id")


@register("daily_limit", "SELECT event_id, row_number() OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY ts, event_id) <= 2 AS allowed FROM events")
def daily_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first two of each user and day are allowed."""
    n = F.row_number().over(Window.partitionBy("user_id", F.to_date("ts")).orderBy("ts", "event_id"))
    return load(spark, sf_dir, "events").select("event_id", (n <= 2).alias("allowed"))


def last_state(ops: DataFrame, key: list[str], seq: list[str], op: str, value: str) -> DataFrame:
    """What a log of puts and removes leaves: the last write of each key wins, keys whose last one removes are gone."""
    last = ops.groupBy(*key).agg(F.max(F.struct(*seq, op, value)).alias("last"))
    return last.where(F.col(f"last.{op}") != "remove").select(*key, F.col(f"last.{value}").alias(value))


@register("log_state", "SELECT user_id, value FROM (SELECT user_id, value, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1 AND event_type <> 'refund'")
def log_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    ops = load(spark, sf_dir, "events").select("user_id", "ts", "event_id", F.when(F.col("event_type") == "refund", "remove").otherwise("put").alias("op"), "value")
    return last_state(ops, ["user_id"], ["ts", "event_id"], "op", "value")


@register("log_state_stream", "SELECT user_id, arg_max(value, struct_pack(a := ts, b := event_id)) AS value FROM events GROUP BY 1")
def log_state_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last value of each user, kept by the stream's own state."""
    df = events(spark, sf_dir, stream=True)
    return run_to_end(df.groupBy("user_id").agg(F.max(F.struct("ts", "event_id", "value")).alias("last")), "log").select("user_id", "last.value")


@register("undo_log", "SELECT event_id, lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events")
def undo_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each write replaced."""
    return load(spark, sf_dir, "events").select("event_id", F.lag("value").over(Window.partitionBy("user_id").orderBy("ts", "event_id")).alias("before"))


def joined_parts(parts: DataFrame, key: str, i: str, n: str, data: str) -> DataFrame:
    """Messages of which all n parts are there, in order."""
    got = parts.dropDuplicates([key, i]).groupBy(key).agg(F.sort_array(F.collect_list(F.struct(i, data))).alias("all"), F.max(n).alias("n"))
    return got.where(F.size("all") == F.col("n")).select(key, F.array_join(F.transform("all", lambda x: x[data]), "").alias(data))


@register("joined_parts", "SELECT conv_id, string_agg(text, '' ORDER BY turn) AS text FROM conversations GROUP BY conv_id HAVING conv_id % 3 <> 0")
def joined_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as parts; of every third conversation one part is lost."""
    n = F.count(F.lit(1)).over(Window.partitionBy("conv_id"))
    parts = load(spark, sf_dir, "conversations").select("conv_id", "turn", n.alias("n"), "text").where("conv_id % 3 <> 0 or turn > 0")
    return joined_parts(parts, "conv_id", "turn", "n", "text")


def received_files(chunks: DataFrame, timeout: str = "no") -> DataFrame:
    """A stream of (file, kind, announced, size) to (file, size) of files whose sizes add up to what was announced at their end."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        announced, got = state.get if state.exists else (-1, 0)
        done = False
        for frame in frames:
            heads = frame[frame.kind == "file"]
            announced = int(heads.announced.iloc[-1]) if len(heads) else announced
            got += int(frame[frame.kind == "chunk"]["size"].sum())
            done = done or bool((frame.kind == "end").any())
        if done:
            if state.exists:
                state.remove()
            if got == announced:
                yield pd.DataFrame({"file": [key[0]], "size": [got]})
        else:
            state.update((announced, got))

    return chunks.groupBy("file").applyInPandasWithState(step, "file string, size long", "announced long, got long", "append", GroupStateTimeout.NoTimeout)
