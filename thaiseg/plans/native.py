"""Plans without a Python boundary."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..operators.dictionary import Dictionary
from ..operators.prefixes import edges


def plain_tokens(text: Column | str) -> Column:
    """Segmentation with an empty dictionary, for text without Thai letters or
    digits and without carriage returns: one regular expression."""
    c = F.col(text) if isinstance(text, str) else text
    return F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(P.PLAIN_SCAN), F.lit(0))


def token_counts(tokens: DataFrame, column: str = "token") -> DataFrame:
    return tokens.groupBy(column).agg(F.count("*").alias("n"))


def shortest_segmentations(rows: DataFrame, key: str, text: str, dictionary: Dictionary, steps: int) -> DataFrame:
    """Fewest-words segmentations as a chain of joins, to cross-check the lattice.

    For texts that the dictionary covers in at most ``steps`` words without
    passing the edge bound.  Each step extends every open prefix by one word and
    keeps the best prefix for each end: key, tokens.
    """
    words = edges(rows, key, text, dictionary).cache()
    goal = rows.select(F.col(key).alias(key), F.length(text).alias("goal"))
    open_ = goal.where("goal > 0").select(key, F.lit(0).alias("end"), F.array().cast("array<int>").alias("ends"), F.array().cast("array<string>").alias("tokens"))
    done = None
    for _ in range(steps):
        longer = open_.join(words.withColumnRenamed("end", "to"), [key]).where("pos = end").select(key, F.col("to").alias("end"), F.concat("ends", F.array("to")).alias("ends"), F.concat("tokens", F.array("word")).alias("tokens"))
        open_ = longer.groupBy(key, "end").agg(F.min(F.struct("ends", "tokens")).alias("best")).select(key, "end", "best.ends", "best.tokens")
        reached = open_.join(goal, key).where("end = goal").select(key, F.size("tokens").alias("n"), "tokens")
        done = reached if done is None else done.union(reached)
    return done.groupBy(key).agg(F.min(F.struct("n", "tokens")).alias("best")).select(key, "best.tokens")
