"""Native expressions over text columns: trimming, clusters, runs, characters."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import patterns as P


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def trimmed(word: Column | str) -> Column:
    """Without the trimmed code points at either end."""
    return F.regexp_replace(_col(word), f"^[{P.TRIMMED}]+|[{P.TRIMMED}]+$", "")


def clusters(text: Column | str) -> Column:
    """Thai character clusters in order; a null text has none."""
    return F.regexp_extract_all(F.coalesce(_col(text), F.lit("")), F.lit(P.CLUSTER), F.lit(0))


def cluster_bounds(text: Column | str) -> Column:
    """Offsets (code points) at which clusters end, ascending."""
    sizes = F.transform(clusters(text), F.length)
    start = F.struct(F.lit(0).alias("end"), F.array().cast("array<int>").alias("ends"))
    step = lambda acc, n: F.struct((acc["end"] + n).alias("end"), F.concat(acc["ends"], F.array(acc["end"] + n)).alias("ends"))
    return F.aggregate(sizes, start, step, lambda acc: acc["ends"])


def leading_run(text: Column | str) -> Column:
    """The run at the start of the text, or the empty string."""
    return F.regexp_extract(_col(text), f"^(?:{P.RUN})", 0)


def run_class(text: Column | str) -> Column:
    """Name of the kind of run that the text starts with; null if none."""
    out = F.lit(None).cast("string")
    for name, pattern in reversed(list(zip(P.RUN_NAMES, P.RUNS))):
        out = F.when(_col(text).rlike(f"^(?:{pattern})"), name).otherwise(out)
    return out


def is_bare_consonants(text: Column | str) -> Column:
    """At most two consonants and nothing else."""
    return _col(text).rlike(P.BARE_CONSONANTS)


def ends_on_bound(bounds: Column | str, end: Column | str) -> Column:
    return F.array_contains(_col(bounds), _col(end))


def chars_len(text: Column | str) -> Column:
    return F.length(_col(text))


def char_slice(text: Column | str, start: int, end: int) -> Column:
    """Code points [start, end)."""
    return F.substring(_col(text), start + 1, end - start)


def char_at(text: Column | str, index: int) -> Column:
    return F.substring(_col(text), index + 1, 1)


def last_space(text: Column | str) -> Column:
    """Offset of the last U+0020, null if there is none."""
    c = _col(text)
    found = F.locate(" ", F.reverse(c))
    return F.when(found > 0, F.length(c) - found)


def is_empty(text: Column | str) -> Column:
    return F.length(_col(text)) == 0


def joined(tokens: Column | str, delimiter: str = "|") -> Column:
    return F.array_join(_col(tokens), delimiter)
