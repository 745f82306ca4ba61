"""Digest changes over a stream of observations."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from telelake.operators.changes import BASELINE, DELETED, NOT_UPDATED, UPDATED, observed_digest
from telelake.session import ship

OBSERVATIONS = (
    "image string, ts_us bigint, failed boolean, repo_digests array<string>, image_id string"
)
LABELLED = "image string, ts_us bigint, digest string, previous string, outcome string"
Labelled = Row(*(c.split()[0] for c in LABELLED.split(", ")))
STATE = "known string"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def label(observations: Iterable[Row], seen: bool, known: str | None) -> Iterator[Row]:
    """Observations of one image, in order of time, with the last good digest before each and the outcome.

    ``seen`` and ``known``: whether there were any before, and the last good digest of those.
    Times that are absent come last.
    """
    for row in sorted(observations, key=lambda r: (r.ts_us is None, r.ts_us or 0)):
        digest = row.digest
        if not seen:
            outcome = BASELINE
        elif digest is None:
            outcome = DELETED
        else:
            outcome = NOT_UPDATED if digest == known else UPDATED
        yield Labelled(row.image, row.ts_us, digest, known, outcome)
        seen, known = True, known if digest is None else digest


class LastGoodDigest(StatefulProcessor):
    """One value per image: its last good digest, NULL while it has only failed."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("known", STATE)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:  # noqa: N802, N803 - Spark's names
        state = self.state.get()
        before = known = state[0] if state else None
        for row in label(rows, state is not None, known):
            known = known if row.digest is None else row.digest
            yield row
        if state is None or known != before:
            self.state.update((known,))

    def close(self) -> None:
        pass


def labelled_stream(observations: DataFrame) -> DataFrame:
    """Label a stream of observations; the state of an image is kept by the engine, by key.

    A micro-batch reads and writes the state of its own images only. The observations that
    one micro-batch has of an image are put in order in one task, as ``(ts_us, digest)``;
    ``maxFilesPerTrigger`` or ``maxBytesPerTrigger`` bounds them.
    """
    narrow = observed_digest(observations).select("image", "ts_us", "digest")
    return narrow.groupBy("image").transformWithState(
        statefulProcessor=LastGoodDigest(), outputStructType=LABELLED, outputMode="Append", timeMode="None"
    )


def digest_stream(
    spark: SparkSession,
    source: str,
    target: str,
    checkpoint: str,
    *,
    trigger: dict | None = None,
    **source_options,
) -> StreamingQuery:
    """Label observations from JSON files and append them to the table at ``target``.

    State lives in RocksDB next to the checkpoint, output goes through the file sink: a
    repeated micro-batch changes neither. Observations that arrive after later ones of
    the same image count as coming after them.
    """
    ship(spark)
    reader = spark.readStream.schema(OBSERVATIONS)
    for key, value in source_options.items():
        reader = reader.option(key, value)
    writer = (
        labelled_stream(reader.json(source))
        .writeStream.format("parquet")
        .option("path", target)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"processingTime": "30 seconds"}))
    )
    # The query takes its settings when it starts.
    before = spark.conf.get(PROVIDER)
    spark.conf.set(PROVIDER, ROCKSDB)
    try:
        return writer.start()
    finally:
        spark.conf.set(PROVIDER, before)
