"""Incremental learning: ``partial_fit`` on micro-batches, once a batch, with saved state."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.sources import tables


class StreamingFit:
    """Feeds each micro-batch of a stream to ``model.partial_fit``.

    ``foreachBatch`` may deliver a batch again; the last batch's number is kept with the
    model, and saved with it, so that a batch counts once.
    """

    def __init__(self, model, features, label: str | None = None, state: str | None = None, **arguments: Any) -> None:
        self.model, self.features, self.label, self.state, self.arguments, self.last = model, features, label, state, arguments, -1

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        if batch_id <= self.last or batch.isEmpty():
            return
        own = [self.label] if self.label else []
        self.model.partial_fit(batch, self.features, *own, **self.arguments)
        self.last = batch_id
        if self.state:
            self.model.last_batch = batch_id
            tables.save_model(self.model, batch.sparkSession, f"{self.state}/{batch_id % 2}")

    @classmethod
    def resume(cls, spark: SparkSession, state: str, features, label: str | None = None, **arguments: Any) -> StreamingFit:
        """From the newer of the two saved states."""
        found = []
        for k in (0, 1):
            try:
                found.append(tables.load_model(spark, f"{state}/{k}"))
            except Exception:  # noqa: BLE001, S112  (a state that wasn't written, or not whole)
                continue
        if not found:
            raise ValueError("no saved state")
        model = max(found, key=lambda m: m.__dict__.get("last_batch", -1))
        out = cls(model, features, label, state, **arguments)
        out.last = model.__dict__.get("last_batch", -1)
        return out

    def run(self, stream: DataFrame, checkpoint: str):
        """Reads all that is there, then stops; the same checkpoint goes on from there."""
        query = stream.writeStream.foreachBatch(self).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        query.awaitTermination()
        return self.model


def stream_table(spark: SparkSession, sf_dir: str, name: str, files: int = 1) -> DataFrame:
    """A table as a stream of its files."""
    schema = tables.table(spark, sf_dir, name).schema
    # A table may be one file: a glob that matches it makes it a stream of one file.
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(f"{sf_dir}/{name}.parque[t]")


def windowed_moments(stream: DataFrame, time: str, value: str, width: str, late: str) -> DataFrame:
    """Count, mean and population variance of event-time windows; rows later than ``late`` don't count."""
    return stream.withWatermark(time, late).groupBy(F.window(time, width)).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.var_pop(value).alias("var"))
