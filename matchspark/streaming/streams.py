"""Streams over match logs: new files once, sessions by gap, tumbling buckets, changed sets, lives as state.

Event times are seconds of a match, taken as seconds of an epoch for windows and
watermarks. Each form gives what its batch form gives once its input has ended.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Columns of the log as a stream reads it.
LOG = "match_id int, player_id int, row_id long, t int, event_type int, x int, y int, z int, wool_id int"


#: Event times begin a day after the epoch, as a stream takes what is not after its first watermark, the epoch, for late.
DAY = 86_400
#: Second of the closing mark: later than any event.
CLOSED = 2_000_000_000


def read_log(spark: SparkSession, folder: str, files: int = 1) -> DataFrame:
    """A stream of the Parquet files below ``folder``, ``files`` a batch, oldest first; files seen before are skipped."""
    return spark.readStream.schema(LOG).option("maxFilesPerTrigger", files).parquet(folder)


def close_log(spark: SparkSession, folder: str) -> None:
    """Append the closing mark, a row without a match after all others: it moves watermarks past every open window and life."""
    spark.createDataFrame([(None, None, None, CLOSED, 6, None, None, None, None)], LOG).write.mode("append").parquet(folder)


def timed(log: DataFrame, late: str = "10 minutes") -> DataFrame:
    """The log with its event time ``ts``; what comes ``late`` after later events is left out, and state behind it goes."""
    return log.withColumn("ts", F.timestamp_seconds(F.col("t") + DAY)).withWatermark("ts", late)


def ingest_new(stream: DataFrame, target: str, checkpoint: str) -> None:
    """Append what the stream has not delivered yet to ``target``, then end; running it again adds only new files."""
    stream.writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def touch_sessions(log: DataFrame, gap: int) -> DataFrame:
    """Sessions of touches of one objective that follow each other within ``gap`` seconds; each is given once, when it can grow no more."""
    touches = timed(log.where("event_type = 6"))
    rows = touches.groupBy("match_id", "wool_id", F.session_window("ts", f"{gap} seconds").alias("w")).agg(F.count("*").alias("touches"), F.min("t").alias("start_timestamp"), F.max("t").alias("end_timestamp"))
    return rows.drop("w")


def buckets(log: DataFrame, seconds: int = 60) -> DataFrame:
    """Events of each match and bucket of time, and how many are kills; each is given once, when its time is over."""
    rows = timed(log).groupBy("match_id", F.window("ts", f"{seconds} seconds").alias("w")).agg(F.count("*").alias("events"), F.count_if(F.col("event_type") == 3).alias("kills"))
    return rows.select("match_id", (F.unix_timestamp("w.start") - DAY).cast("int").alias("start"), "events", "kills")


def lives(log: DataFrame, longest: int = 4 * 3600) -> DataFrame:
    """Lives ``match_id, player_id, start, end`` as keyed state: a spawn opens one, the nth death closes the nth.

    Files must bring a player's events in order; a batch is sorted before it is applied.
    A player's state goes once the watermark is ``longest`` seconds past the last event,
    and the lives still open then are given with a null end.
    """

    def step(key: tuple, rows: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        spawns, deaths = (list(x) for x in state.get) if state.exists else ([], [])
        if state.hasTimedOut:
            state.remove()
            closed = [(s, None) for s in spawns]
        else:
            last = 0
            for part in sorted((r for df in rows for r in df.itertuples()), key=lambda r: (r.t, r.row_id)):
                (spawns if part.event_type == 2 else deaths).append(part.t)
                last = max(last, int(part.t))
            n = min(len(spawns), len(deaths))
            closed = list(zip(spawns[:n], deaths[:n], strict=True))
            state.update((spawns[n:], deaths[n:]))
            state.setTimeoutTimestamp(max(1000 * (DAY + last + longest), state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame([(*key, s, e) for s, e in closed], columns=["match_id", "player_id", "start", "end"]).astype({"start": "Int64", "end": "Int64"})

    events = timed(log.where("event_type in (2, 4) or match_id is null")).groupBy("match_id", "player_id")

    def known(key: tuple, rows: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if key[0] is not None and key[0] == key[0]:  # not the closing mark
            yield from step(key, rows, state)

    return events.applyInPandasWithState(known, "match_id int, player_id int, start int, end int", "spawns array<int>, deaths array<int>", "append", "EventTimeTimeout")


def drained(rows: DataFrame, checkpoint: str, target: str) -> DataFrame:
    """Run a stream over all that is there into ``target`` and read it."""
    ingest_new(rows, target, checkpoint)
    return rows.sparkSession.read.parquet(target)


def set_state(log: DataFrame, key: str, row: list[str]) -> DataFrame:
    """``key, rows, fingerprint`` of all rows of a key that the stream has delivered so far, in update mode: keys without new rows are not given again.

    The fingerprint is the sum of two 64-bit hashes of each row's columns ``row``: it does
    not depend on order or on the batches that brought the rows, and repeated rows count
    each time. The sums are the stream's own keyed state.
    """
    total = lambda seed: F.sum(F.xxhash64(F.lit(seed), *row).cast("decimal(38,0)"))
    sums = log.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("rows"), total(1).alias("a"), total(2).alias("b"))
    return sums.select(key, "rows", F.concat_ws(":", "rows", "a", "b").alias("fingerprint"))


def on_change(stream: DataFrame, checkpoint: str, key: str, row: list[str], act: Callable[[DataFrame, int], None]) -> None:
    """Call ``act`` with ``key, rows, fingerprint`` of the keys whose set of rows a batch has changed, and the batch's number.

    A batch that is tried again has the same number and the same rows, so an ``act`` that
    replaces what that number wrote before acts once.
    """
    changed = set_state(stream, key, row)
    changed.writeStream.outputMode("update").foreachBatch(act).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def write_batch(target: str) -> Callable[[DataFrame, int], None]:
    """An ``act`` that writes each batch to a folder of its number, in place of what it held."""
    return lambda rows, n: rows.write.mode("overwrite").parquet(f"{target}/batch={n}")
