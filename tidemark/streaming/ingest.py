"""Streams into tables, and the latest value per key as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.table import VersionedTable


def ingest(stream: DataFrame, table: VersionedTable, app: str, checkpoint: str, ordinal: str | None = None, trigger: dict | None = None):
    """Writes each micro-batch of (key, value) as one atomic commit.

    The commit record names the app and the batch, so a batch that Spark replays after a failure is
    recognised and skipped: exactly once, without a transaction across systems.
    """

    def commit(rows: DataFrame, batch: int) -> None:
        table.write_frame(rows, app, batch, ordinal)
        table.maintain()

    return stream.writeStream.foreachBatch(commit).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def latest_values(stream: DataFrame) -> DataFrame:
    """A stream of (key, ts, value) to the newest version of each key, for the output mode "update".

    A streaming aggregate: the state is one version a key, in the JVM, and a batch is shrunk to one row a key
    before the shuffle.  A late version changes nothing; the key's row comes again as it stands.  Of versions
    with one timestamp the largest value counts, a deletion only if alone.
    """
    rows = stream.select(F.col("key").cast("string"), F.col("ts").cast("long"), F.col("value").cast("string"))
    best = F.max(F.struct("ts", F.col("value").isNotNull().alias("stored"), "value")).alias("_v")
    return rows.groupBy("key").agg(best).select("key", "_v.ts", "_v.value")
