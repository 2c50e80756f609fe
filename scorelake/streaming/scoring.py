"""Measures on streams: the row-local measures need no state, and statistics of groups run over windows of event time."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import writing


def read_texts(spark: SparkSession, path: str, schema: str, files: int = 64) -> DataFrame:
    """A stream of JSON lines from a folder, so many new files at a time."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).json(path)


def scored(stream: DataFrame, keys: Iterable[str], text: str = "text") -> DataFrame:
    """keys, readability and lexical richness of every text, as it comes."""
    keys = list(keys)
    facts = writing.word_facts(stream, keys, text)
    own = [c for c in facts.columns if c not in keys]
    return writing.lexis(writing.readability(facts, [*keys, *own]), [*keys, "readability_score"])


def windowed(stream: DataFrame, time: str, group: str, value: str, window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Statistics of a value by group and window of event time; rows later than `late` are left out, and state is bounded by it."""
    v = F.col(value)
    rows = stream.withWatermark(time, late).groupBy(F.window(time, window), group)
    return rows.agg(F.count(v).alias("n"), F.avg(v).alias("mean"), F.stddev_pop(v).alias("std"), F.min(v).alias("low"), F.max(v).alias("high"))


def run(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Writes what there is to Parquet and stops; begun again with the same checkpoint folder, it goes on after the last file."""
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
