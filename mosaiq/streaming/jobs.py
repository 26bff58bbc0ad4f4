"""Streams: failures as they come, an index rebuilt after every batch, tallies and uniformity by time window."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from mosaiq.sources import store


def keep_failures(stream: DataFrame, root: str, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Rows of a stream (pair_id, status, error, ...) that aren't OK, appended to ``root``/failures.

    A file sink with its own log: each batch counts once even if it is run again.
    """
    failed = stream.filter(~F.col("status").eqNullSafe("OK"))
    return failed.writeStream.format("parquet").option("path", f"{root}/failures").option("checkpointLocation", checkpoint).outputMode("append").trigger(**(trigger or {"availableNow": True})).start()


def keep_results(stream: DataFrame, root: str, checkpoint: str, key: str = "pair_id", trigger: dict | None = None) -> StreamingQuery:
    """Results of a stream saved batch by batch, the index rebuilt from all that is stored after each.

    A batch that is run again overwrites its own partitions, so the store ends the same. Of a key that a
    batch holds more than once the row of the largest JSON text stays, whatever order rows come in.
    """

    def save(batch: DataFrame, _: int) -> None:
        if batch.isEmpty():
            return
        row = F.struct(*batch.columns)
        one = batch.filter(F.col(key).isNotNull()).groupBy(F.col(key).alias("_k")).agg(F.max_by(row, F.to_json(row)).alias("r")).select("r.*")
        store.save_results(one, root, key, overwrite=True)

    return stream.writeStream.foreachBatch(save).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def window_tally(events: DataFrame, time: str, status: str, value: str, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """(start, status, n, total): counts and sums by tumbling window, final once the watermark has passed it.

    The same plan serves a stream and a table; state is bounded by windows within ``late`` times statuses.
    """
    by = events.withWatermark(time, late).groupBy(F.window(time, width).alias("w"), status)
    return by.agg(F.count("*").alias("n"), F.sum(value).alias("total")).select(F.col("w.start").alias("start"), status, "n", "total")


def first_seen(events: DataFrame, key: str, time: str, late: str = "2 hours") -> DataFrame:
    """Events less the repeats of a key that arrive within ``late`` of each other; state is bounded by the watermark."""
    return events.withWatermark(time, late).dropDuplicatesWithinWatermark([key])
