"""Progress per key as a stream: latest status and counts; events that come again are counted once, in whatever order."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..sources.files import scratch

PROGRESS = "user_id long, rows long, last_event long, last_type string"


class ProgressState(StatefulProcessor):
    """Rows counted so far, and the last event by id, of each key; each event comes once."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("progress", "rows long, last_event long, last_type string")

    def handleInputRows(self, key, rows, timerValues):  # noqa: N802, N803  names of the interface
        import pandas as pd

        n, last, kind = self.state.get() if self.state.exists() else (0, None, None)
        for pdf in rows:
            n += len(pdf)
            top = pdf.loc[pdf.event_id.idxmax()]
            if last is None or top.event_id > last:
                last, kind = int(top.event_id), top.event_type
        self.state.update((n, last, kind))
        yield pd.DataFrame({"user_id": [key[0]], "rows": [n], "last_event": [last], "last_type": [kind]})

    def close(self) -> None:
        pass


def progress_stream(events: DataFrame) -> DataFrame:
    """A stream of (user_id, rows, last_event, last_type): a row for each key that a batch brings new events of.

    Events may come in any order and again, in the same batch or a later one:
    an event is what its user and id say, and its first row counts. The ids
    that were seen are state of their own, one entry for each event, which
    stays on the executors' disks. Rows without an id are no events.
    """
    once = events.where("event_id is not null").dropDuplicates(["user_id", "event_id"])
    return once.groupBy("user_id").transformWithStateInPandas(ProgressState(), outputStructType=PROGRESS, outputMode="Append", timeMode="None")


def run_to_table(spark: SparkSession, stream: DataFrame, path: str, checkpoint: str) -> None:
    """Runs a stream over what there is; each batch replaces its keys' rows in a table at ``path``."""

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number:08d}")  # a batch that is run again replaces itself

    q = stream.writeStream.outputMode("append").foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()


def latest_of_batches(spark: SparkSession, path: str, key: list[str]) -> DataFrame:
    """The rows of the last batch that has a key."""
    df = spark.read.parquet(path)
    rest = [c for c in df.columns if c not in (*key, "batch")]
    return df.groupBy(*key).agg(F.max_by(F.struct(*rest), "batch").alias("r")).select(*key, "r.*")


@contextmanager
def rocks_db(spark: SparkSession) -> Iterator[None]:
    """The state store that the states here need, for streams that start meanwhile."""
    key = "spark.sql.streaming.stateStore.providerClass"
    old = spark.conf.get(key, None)
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(key, old) if old is not None else spark.conf.unset(key)


def stream_progress(spark: SparkSession, source: str) -> DataFrame:
    """Runs :func:`progress_stream` over a Parquet file or folder, one file a batch, and returns the final progress."""
    base = scratch(spark, "stream")
    schema = spark.read.parquet(source).schema
    folder, name = source.rsplit("/", 1)
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1)
    single = spark.read.format("binaryFile").load(source).select("path").limit(2).count() == 1
    events = reader.option("pathGlobFilter", name).parquet(folder) if single else reader.parquet(source)
    with rocks_db(spark):
        run_to_table(spark, progress_stream(events.select("user_id", "event_id", "event_type")), f"{base}/out", f"{base}/state")
    return latest_of_batches(spark, f"{base}/out", ["user_id"])
