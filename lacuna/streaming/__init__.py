"""De-identification of streams: the batch plan is stateless, so it runs on a streaming DataFrame as it is."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from lacuna.plans.deidentify import Config, deidentify


def redact_stream(notes: DataFrame, config: Config = Config(), text_col: str = "text") -> DataFrame:
    return notes.transform(deidentify(config, text_col))


def start(notes: DataFrame, path: str, checkpoint: str, config: Config = Config(), text_col: str = "text", **trigger) -> StreamingQuery:
    """Write redacted notes as Parquet, exactly once; ``trigger`` as for DataStreamWriter.trigger."""
    writer = redact_stream(notes, config, text_col).drop(text_col).writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start()
