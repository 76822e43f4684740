"""Segmentation of columns: an Arrow function, a table function, SQL names."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.dictionary import Dictionary
from ..operators.lattice import segment_text

TOKENS = T.ArrayType(T.StringType(), False)


def segmenter(dictionary: Dictionary, safe: bool = False):
    """A vectorised function text -> tokens; null and empty texts have none."""
    lexicon = dictionary.compiled

    @F.arrow_udf(TOKENS)
    def segment_column(texts: pa.Array) -> pa.Array:
        known = lexicon.value
        return pa.array([segment_text(t, known, safe) for t in texts.to_pylist()], pa.list_(pa.field("element", pa.string(), False)))

    return segment_column


def segment(text: Column | str, dictionary: Dictionary, safe: bool = False) -> Column:
    return segmenter(dictionary, safe)(F.col(text) if isinstance(text, str) else text)


def spread(rows: DataFrame, splits_most: int = 4) -> DataFrame:
    """``rows`` dealt over all cores, if they come in few partitions: segmenting
    takes far longer than a shuffle, but large tables have splits enough."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    if rows._jdf.rdd().getNumPartitions() >= splits_most * cores:
        return rows
    return rows.repartition(splits_most * cores)


def register(spark: SparkSession, dictionary: Dictionary, name: str = "segment") -> None:
    """SQL names: ``name(text)``, ``name_safe(text)`` and the table function
    ``name_rows(text)`` with rows (pos, token), for LATERAL."""
    spark.udf.register(name, segmenter(dictionary))
    spark.udf.register(f"{name}_safe", segmenter(dictionary, safe=True))
    lexicon = dictionary.compiled

    @F.udtf(returnType="pos: bigint, token: string")
    class Rows:
        def eval(self, text: str):
            yield from enumerate(segment_text(text, lexicon.value))

    spark.udtf.register(f"{name}_rows", Rows)
