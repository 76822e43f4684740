"""The line job on Structured Streaming: stateless, so there is no watermark.

A stream keeps the dictionary it started with; restart it from its checkpoint to
use another.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..operators.dictionary import Dictionary
from ..sources.lines import segmented_lines


def line_stream(spark: SparkSession, path: str, files_per_trigger: int = 100) -> DataFrame:
    """Lines of the text files that appear in a folder."""
    return spark.readStream.option("maxFilesPerTrigger", files_per_trigger).text(path)


def segment_stream(lines: DataFrame, dictionary: Dictionary, target: str, checkpoint: str, delimiter: str = "|", safe: bool = False, once: bool = False) -> StreamingQuery:
    """Writes delimited lines as text files; ``once`` stops after what is there."""
    out = segmented_lines(lines, dictionary, delimiter, safe).writeStream.format("text").option("checkpointLocation", checkpoint)
    return (out.trigger(availableNow=True) if once else out).start(target)
