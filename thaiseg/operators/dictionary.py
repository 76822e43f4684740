"""Dictionaries as DataFrames of distinct words.

A Dictionary never changes: adding or removing words gives a new one.  Words are
trimmed, empty ones dropped and repeated ones kept once.
"""

from __future__ import annotations

from collections.abc import Iterable
from functools import cached_property

from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from ..functions.text import trimmed
from .lattice import Lexicon

#: Segmenting needs the words in each Python worker; more are refused.
COMPILED_MOST = 2_000_000
#: Words, and bytes of them, that a join broadcasts at most.
FEW_WORDS, FEW_BYTES = 500_000, 16_000_000


class Dictionary:
    def __init__(self, words: DataFrame):
        self.words = words

    @classmethod
    def from_column(cls, rows: DataFrame, column: Column | str) -> "Dictionary":
        return cls(rows.select(trimmed(column).alias("word")).where("word <> ''").distinct())

    @classmethod
    def from_file(cls, spark: SparkSession, path: str) -> "Dictionary":
        """One word a line, UTF-8; a path without a file raises AnalysisException."""
        return cls.from_column(spark.read.text(path), "value")

    @classmethod
    def from_words(cls, spark: SparkSession, words: Iterable[str]) -> "Dictionary":
        return cls.from_column(_frame(spark, words), "word")

    def add(self, words: Iterable[str] | DataFrame) -> "Dictionary":
        return Dictionary(self.words.union(self._clean(words)).distinct())

    def remove(self, words: Iterable[str] | DataFrame) -> "Dictionary":
        """Without these words; words that it doesn't hold make no difference."""
        return Dictionary(self.words.join(self._clean(words), "word", "left_anti"))

    def contains(self, rows: DataFrame, column: str, name: str = "contained") -> DataFrame:
        """``rows`` with a boolean column ``name``: exact membership, not trimmed, and
        false for null.  ValueError if ``rows`` has a column of that name."""
        if name in rows.columns:
            raise ValueError(f"the rows have a column {name}")
        known = self.words.select(F.struct("word").alias("known"))
        row = rows.select(F.struct(*[F.col(f"`{c}`") for c in rows.columns]).alias("row"))
        both = row.join(known, F.col("row").getField(column) == F.col("known.word"), "left")
        return both.select(*[F.col("row").getField(c).alias(c) for c in rows.columns], F.col("known").isNotNull().alias(name))

    def count(self) -> int:
        return self.words.count()

    @cached_property
    def extent(self) -> Row:
        """Number of words, bytes of them and their distinct lengths, found once for this dictionary."""
        size = F.coalesce(F.sum(F.octet_length("word")), F.lit(0))
        return self.words.agg(F.count("*").alias("words"), size.alias("bytes"), F.array_sort(F.collect_set(F.length("word"))).alias("lengths")).first()

    @property
    def few(self) -> bool:
        """Whether a join may broadcast the words."""
        return self.extent.words <= FEW_WORDS and self.extent.bytes <= FEW_BYTES

    def _clean(self, words: Iterable[str] | DataFrame) -> DataFrame:
        rows = words if isinstance(words, DataFrame) else _frame(self.words.sparkSession, words)
        return Dictionary.from_column(rows, rows.columns[0]).words

    @cached_property
    def compiled(self) -> Broadcast:
        """A broadcast Lexicon, built once for this dictionary."""
        rows = self.words.limit(COMPILED_MOST + 1).collect()
        if len(rows) > COMPILED_MOST:
            raise ValueError(f"the dictionary has more than {COMPILED_MOST} words")
        return self.words.sparkSession.sparkContext.broadcast(Lexicon(r.word for r in rows))


def _frame(spark: SparkSession, words: Iterable[str]) -> DataFrame:
    return spark.createDataFrame([(w,) for w in words], "word string")
