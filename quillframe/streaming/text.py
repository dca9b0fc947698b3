"""Streams of artifacts: an extension, not part of the measured feature set's definition.

The per-artifact expressions need no state, so they run on a stream unchanged. Counts over event time are kept with a
watermark, which bounds their state.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillframe.operators import text


def measured(stream: DataFrame) -> DataFrame:
    """Stateless text measures of a stream of artifacts (artifact_id, text, ...)."""
    rows = text.structured(text.tokenized(stream))
    return rows.select(
        "artifact_id", F.octet_length("text").cast("bigint").alias("byte_count"), F.length("text").cast("bigint").alias("character_count"), F.size("words").cast("bigint").alias("word_count"),
        (F.size("tokens") - F.size("words")).cast("bigint").alias("number_count"), F.size("paragraphs").cast("bigint").alias("paragraph_count"), F.size(F.flatten("sentences")).cast("bigint").alias("sentence_count"),
    )


def windowed(events: DataFrame, time: str, keys: list[str], width: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Events per window of event time; windows older than the watermark are dropped from the state."""
    return events.withWatermark(time, late).groupBy(F.window(time, width), *keys).agg(F.count(F.lit(1)).alias("n"))
