"""Prefix lookup as a join: dictionary words that start at positions of texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import cluster_bounds
from .dictionary import Dictionary


def words_at(rows: DataFrame, key: str, text: str, dictionary: Dictionary) -> DataFrame:
    """key, pos, word, end for each position of each text and each word there.
    ValueError if ``key`` is one of the other columns of the result."""
    return _words_to(F.sequence(F.lit(1), F.length("_probed_text")), rows, key, text, dictionary)


def edges(rows: DataFrame, key: str, text: str, dictionary: Dictionary) -> DataFrame:
    """The words of ``words_at`` that end where a cluster of their text ends."""
    return _words_to(cluster_bounds("_probed_text"), rows, key, text, dictionary)


def _words_to(ends: Column, rows: DataFrame, key: str, text: str, dictionary: Dictionary) -> DataFrame:
    """The words up to any of ``ends``.

    The words' distinct lengths are few, so each end probes one substring a
    length: an equi-join on the substring, in place of a join on startswith.
    Spark takes the probes for small, as explode made them, so the join says
    itself what is built: all words if they are few, else a task's share of
    them.  Probes only pass by; common ones aren't sorted or broadcast.
    """
    if key in ("pos", "word", "end"):
        raise ValueError(f"the key may not be called {key}")
    lengths = F.array(*[F.lit(n) for n in dictionary.extent.lengths]).cast("array<int>")
    probes = (
        rows.select(F.col(key).alias(key), F.col(text).alias("_probed_text"))
        .where(F.length("_probed_text") > 0)
        .select(key, "_probed_text", F.explode(ends).alias("end"))
        .select(key, "_probed_text", "end", F.explode(lengths).alias("_probed_n"))
        .select(key, "_probed_text", "end", "_probed_n", (F.col("end") - F.col("_probed_n")).alias("pos"))
        .where("pos >= 0")
        .select(key, "pos", F.expr("substring(_probed_text, pos + 1, _probed_n)").alias("word"), "end")
    )
    return probes.join(dictionary.words.hint("broadcast" if dictionary.few else "shuffle_hash"), "word").select(key, "pos", "word", "end")
