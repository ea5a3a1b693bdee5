"""Ingest as Structured Streaming: exact dedup per session, metering of everything, session windows, idempotent batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.listener import StreamingQueryListener
from pyspark.sql.streaming.state import GroupState
from pyspark.sql.types import StructType

from depotlens.operators.index_store import PackIndex
from depotlens.session import Workspace, exists

#: A session ends this long after its last upload.
SESSION_GAP = "30 minutes"


def read_uploads(spark: SparkSession, folder: str, schema: StructType | str, max_files: int | None = None) -> DataFrame:
    """Upload requests as they arrive as Parquet files."""
    reader = spark.readStream.schema(schema)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.parquet(folder)


def unique_uploads(uploads: DataFrame, at: str = "sent_at", late: str = SESSION_GAP) -> DataFrame:
    """First upload of each checksum in its session; state is dropped once the watermark has passed."""
    return uploads.where(F.col("checksum").isNotNull()).withWatermark(at, late).dropDuplicatesWithinWatermark(["session_id", "checksum"])


def unique_in_session(uploads: DataFrame) -> DataFrame:
    """First upload of each checksum in its session, however far apart repeats come; state lasts as long as the stream's checkpoint."""
    return uploads.where(F.col("checksum").isNotNull()).dropDuplicates(["session_id", "checksum"])


#: States of a session; the last two are terminal.
CREATED, IN_PROGRESS, COMPLETED, EXPIRED = "Created", "InProgress", "Completed", "Expired"
_OUTCOMES = "request_id bigint, session_id string, outcome string, state string"


def session_outcomes(uploads: DataFrame, gap_seconds: int = 1800) -> DataFrame:
    """What becomes of every upload: (request_id, session_id, outcome, state after it), a side output for the rejected.

    A session is created by its first upload and in progress from then on.  An upload that comes ``gap_seconds`` or more after the last
    accepted one finds the session expired and is rejected (`late`), and so is all that follows; one without a time is `invalid`
    and changes nothing.  Uploads of one trigger are taken in order of (sent_at, request_id)."""

    def run(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now, last = state.get if state.exists else (CREATED, -1)
        rows = pd.concat(list(parts)).sort_values(["at", "request_id"], na_position="first")
        outcomes, states = [], []
        for at in rows["at"].tolist():
            if at is None or at != at:
                outcome = "invalid"
            elif now == EXPIRED or (last >= 0 and at - last >= gap_seconds * 1_000_000):
                now, outcome = EXPIRED, "late"
            else:
                now, last, outcome = IN_PROGRESS, int(at), "accepted"
            outcomes.append(outcome)
            states.append(now)
        state.update((now, last))
        yield pd.DataFrame({"request_id": rows["request_id"], "session_id": key[0], "outcome": outcomes, "state": states})

    keyed = uploads.where(F.col("session_id").isNotNull()).select("session_id", "request_id", F.unix_micros("sent_at").cast("double").alias("at"))
    return keyed.groupBy("session_id").applyInPandasWithState(run, _OUTCOMES, "state string, last bigint", "append", "NoTimeout")


class Progress(StreamingQueryListener):
    """Keeps, or hands on to ``tell``, the progress of every stream: (name, batch, rows, seconds)."""

    def __init__(self, tell: Callable[[tuple], None] | None = None):
        self.seen: list[tuple] = []
        self.tell = tell or self.seen.append

    def onQueryStarted(self, event) -> None:
        self.tell((event.name, -1, 0, 0.0))

    def onQueryProgress(self, event) -> None:
        p = event.progress
        self.tell((p.name, p.batchId, p.numInputRows, p.batchDuration / 1000))

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass


def metered(uploads: DataFrame) -> DataFrame:
    """Bytes and chunks by session, duplicates too: metering comes before dedup."""
    return uploads.groupBy("session_id").agg(F.count("*").alias("chunks_total"), F.sum("data_length").alias("metered_bytes"))


def sessions(uploads: DataFrame, at: str = "sent_at", gap: str = SESSION_GAP) -> DataFrame:
    """Uploads by session window; each upload extends its session.  Late ones beyond the watermark are rejected."""
    s = uploads.where(F.col(at).isNotNull()).withWatermark(at, gap).groupBy("session_id", F.session_window(at, gap).alias("w"))
    return s.agg(F.count("*").alias("uploads"), F.sum("data_length").alias("bytes")).select("session_id", F.col("w.start").alias("started"), F.col("w.end").alias("expires"), "uploads", "bytes")


def append_new(uploads: DataFrame, store: str, checkpoint: str) -> StreamingQuery:
    """Writes chunks that the store lacks, one row a checksum.  What is stored is looked up in an index beside it, so a batch reads the row
    groups that its checksums touch, not the store.  A batch that is repeated after a failure overwrites its own folder, and its own
    index entries do not count against it, so each chunk is written once."""

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        index = PackIndex(spark, f"{store}-index", "batch bigint")
        first = batch.where("checksum is not null").groupBy("checksum").agg(F.min(F.struct("request_id", "data_length")).alias("f")).select("checksum", "f.request_id", "f.data_length")
        before = index.find(first).where(F.col("batch") != number).select("checksum")
        first.join(before, "checksum", "left_anti").write.mode("overwrite").parquet(f"{store}/batch={number}")
        written = spark.read.schema("checksum binary, request_id bigint, data_length int").parquet(f"{store}/batch={number}")
        index.add(written.select("checksum", F.lit(number).cast("bigint").alias("batch")))

    return uploads.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def run_to_table(stream: DataFrame, name: str, mode: str = "append", every: str | None = None) -> DataFrame:
    """Runs a stream into a table of the shared folder and gives it: over what is there, or, with ``every`` (such as "1 hour"), as a
    periodic job that the caller stops.  A batch that is repeated overwrites its own folder; a complete result is its newest batch."""
    spark = stream.sparkSession
    path = Workspace(spark).path(name)

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/table/batch={0 if mode == 'complete' else number}")

    writer = stream.writeStream.foreachBatch(write).outputMode(mode).option("checkpointLocation", f"{path}/progress")
    query = (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()
    if every is None:
        query.awaitTermination()
    if not exists(spark, f"{path}/table"):
        return spark.createDataFrame([], stream.schema)
    return spark.read.schema(stream.schema).parquet(f"{path}/table").select(*stream.columns)
