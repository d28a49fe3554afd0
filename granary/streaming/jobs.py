"""Structured Streaming jobs over growing folders of parquet files.

Each job processes what has arrived (`availableNow`) and keeps its progress in a
checkpoint folder, so it can be run again after every arrival, or left running.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from granary.functions import dates
from granary.sources.tables import exists, new_path, remove


def feed(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return spark.readStream.schema(schema).parquet(path)


def run_available(stream: DataFrame, checkpoint: str, sink: str | None = None,
                  each: Callable[[DataFrame, int], None] | None = None) -> None:
    """Process everything that has arrived, into a parquet folder or through `each`."""
    writer = stream.writeStream.option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True)
    started = writer.foreachBatch(each).start() if each else writer.format("parquet").option("path", sink).start()
    started.awaitTermination()


class KeyedState:
    """A table in buckets by a hash of its key, of which a micro-batch rewrites only those it touches.

    Batch n reads the touched buckets as manifest n-1 names them, writes them under its own
    number, and then manifest n: one row per bucket with the batch that wrote it last. So a
    batch costs what its buckets hold, not what the table holds. A batch that is run again
    reads the same buckets and overwrites its own, so the state is exact. What manifest n-1
    alone named is deleted by batch n+1. All that is known lies in the folder, so a restarted
    driver goes on from there. `buckets` stays as it is for the life of the table.
    """

    def __init__(self, spark: SparkSession, path: str, key: Sequence[str], load: Callable[[DataFrame | None, DataFrame], DataFrame], buckets: int = 16):
        self.spark, self.path, self.key, self.load, self.buckets = spark, path, list(key), load, buckets

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.key), F.lit(self.buckets)).cast("int")

    def manifest(self, version: int) -> dict[int, int]:
        """Bucket -> batch that wrote it, as of batch `version`; at most `buckets` entries."""
        path = f"{self.path}/manifest/v={version}"
        return dict(self.spark.read.parquet(path).select("bucket", "batch").collect()) if exists(self.spark, path) else {}

    def _place(self, bucket: int, batch: int) -> str:
        return f"{self.path}/data/v={batch}/bucket={bucket}"

    def _read(self, held: dict[int, int]) -> DataFrame | None:
        return self.spark.read.parquet(*[self._place(b, v) for b, v in sorted(held.items())]) if held else None

    def apply(self, batch: DataFrame, batch_id: int) -> None:
        before = self.manifest(batch_id - 1)
        touched = {r[0] for r in batch.select(self._bucket()).distinct().collect()}
        after = self.load(self._read({b: v for b, v in before.items() if b in touched}), batch)
        target = f"{self.path}/data/v={batch_id}"
        after.withColumn("bucket", self._bucket()).write.mode("overwrite").partitionBy("bucket").parquet(target)
        now = {b: v for b, v in before.items() if b not in touched}
        now |= {b: batch_id for b in touched if exists(self.spark, self._place(b, batch_id))}
        rows = self.spark.createDataFrame(sorted(now.items()), "bucket int, batch long")
        rows.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/manifest/v={batch_id}")
        for bucket, batch in self.manifest(batch_id - 2).items():  # batch n may still be run again, and reads manifest n-1
            if before.get(bucket) != batch:
                remove(self.spark, self._place(bucket, batch))
        remove(self.spark, f"{self.path}/manifest/v={batch_id - 2}")

    def latest(self) -> DataFrame:
        """The table as of the newest batch."""
        newest = self.spark.read.parquet(f"{self.path}/manifest").agg(F.max("v")).first()[0]
        return self._read(self.manifest(newest))


def stateful_load(spark: SparkSession, arrivals: Sequence[DataFrame], tag: str, key: Sequence[str],
                  load: Callable[[DataFrame | None, DataFrame], DataFrame]) -> DataFrame:
    """Append each arrival to a feed folder, let the stream pick it up, return the final state.

    `load` gets the state of the batch's buckets and must work key by key.
    """
    source, progress, stored = (new_path(spark, f"{tag}-{n}") for n in ("feed", "progress", "state"))
    state = KeyedState(spark, stored, key, load)
    for part in arrivals:
        part.write.mode("append").parquet(source)
        run_available(feed(spark, source, part.schema), progress, each=state.apply)
    return state.latest()


def close_feed(spark: SparkSession, path: str, schema: T.StructType, ts: str, after: str) -> None:
    """Append the closing arrival of a bounded feed: one row that has nothing but a time, `after` the last one.

    With `after` longer than window and delay together, the watermark then passes every
    window with data. The row's own window stays open, so the row is never given out. An
    empty feed is left as it is.
    """
    last = spark.read.schema(schema).parquet(path).agg(F.max(ts).alias(ts))
    closing = last.where(F.col(ts).isNotNull()).withColumn(ts, F.col(ts) + F.expr(f"interval {after}"))
    others = [F.lit(None).cast(f.dataType).alias(f.name) if f.name != ts else F.col(ts) for f in schema]
    closing.select(*others).coalesce(1).write.mode("append").parquet(path)


def run_bounded(spark: SparkSession, arrivals: Sequence[DataFrame], tag: str, ts: str, after: str, job: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """What a windowed streaming job gives out for a feed of these arrivals, from the first row to the last."""
    source, progress, sink = (new_path(spark, f"{tag}-{n}") for n in ("feed", "progress", "sink"))
    for part in arrivals:
        part.write.mode("append").parquet(source)
        run_available(job(feed(spark, source, part.schema)), progress, sink)
    close_feed(spark, source, arrivals[-1].schema, ts, after)
    run_available(job(feed(spark, source, arrivals[-1].schema)), progress, sink)
    return spark.read.parquet(sink)


def _instant(ts: str):
    """A zone-less time as an instant in UTC: event time must be an instant."""
    return F.timestamp_micros(dates.epoch_micros(F.col(ts)))


def _zoneless(c: str):
    return dates.from_micros(F.unix_micros(c))


def daily_partials(events: DataFrame, ts: str, keys: Sequence[str], delay: str) -> DataFrame:
    """Counts per day and distinct `keys`, given out when the watermark has passed the day.

    The state holds one row per distinct key combination of an open day. Distinct counts
    are taken from these rows later, so no growing set is kept per user.
    """
    timed = events.withColumn("__at", _instant(ts)).withWatermark("__at", delay)
    counts = timed.groupBy(F.window("__at", "1 day").alias("w"), *keys).agg(F.count(F.lit(1)).alias("n"))
    return counts.select(F.to_date(_zoneless("w.start")).alias("event_date"), *keys, "n")


def gap_sessions(events: DataFrame, ts: str, key: str, gap: str, delay: str) -> DataFrame:
    """Sessions of a key that end when no event follows within `gap`."""
    timed = events.withColumn("__at", _instant(ts)).withWatermark("__at", delay)
    found = timed.groupBy(F.session_window("__at", gap).alias("s"), key).agg(F.count(F.lit(1)).alias("n_events"))
    return found.select(key, _zoneless("s.start").alias("session_start"), _zoneless("s.end").alias("session_end"), "n_events")
