"""Mixing sources to target weights.

A source's texts, in a fixed pseudorandom order of ids, form one stream of
words that is packed into blocks of ``block`` words (the last one is shorter).
Targets are set by water-filling: the total is shared by weight, no source gets
more than ``most`` times what it has, and the excess is shared again.

Output shards have a fixed number of slots.  Each shard's source counts are one
multinomial draw; the probabilities are what remains of every source's quota,
so the draws over all shards add up to the quotas.  The j-th slot of a source
with n blocks maps to block ``permutation(j mod n)`` of pass ``j div n``, a keyed
Feistel permutation of 0..n-1 for each source and pass, and slots join blocks by
(source, block).  A block is thus used at most ``ceil(quota / n)`` times.

Only totals of the sources (a row each) and the counts of shards (at most
MOST_SHARDS rows) reach the driver; documents, blocks and slots stay distributed.

Defined results: null and empty texts have size 0 and are not taken; a null
source is a source of its own, last in order; rows with a null or repeated
``doc_id`` are kept and counted apart by their text; an empty table gives an
empty result; other columns are ignored.  Reruns agree.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from .bytekernel import trim
from .storage import Tables, local_table, only, partitions_for

WORD = r"[^\x20\x09-\x0D]+"
MOST_SHARDS = 4096
_KNOWN = pa.schema([("source_no", pa.int32()), ("known", pa.string()), ("target", pa.float64()), ("source_size", pa.int64())])
_DRAWN = pa.schema([("shard", pa.int64()), ("source_no", pa.int32()), ("start", pa.int64()), ("count", pa.int64())])


@dataclass(frozen=True)
class Mix:
    weights: tuple[int, ...] = (3, 1, 2)  # repeating, by the order of sources
    share: float = 1.5
    most: float = 2.0
    block: int = 64
    slots: int = 4096  # of an output shard, at least
    seed: int = 20240501


def targets(sizes: list[int], weights: list[float], total: float, most: float) -> list[float]:
    """Water-filling: shares by weight, none above ``most`` times its size."""
    out, open_, left = [0.0] * len(sizes), set(range(len(sizes))), total
    while open_:
        unit = left / sum(weights[i] for i in open_)
        over = [i for i in open_ if weights[i] * unit > most * sizes[i]]
        if not over:
            for i in open_:
                out[i] = weights[i] * unit
            return out
        for i in over:
            out[i] = most * sizes[i]
            left -= out[i]
            open_.discard(i)
    return out


def shard_counts(quotas: np.ndarray, slots: int, seed: int) -> np.ndarray:
    """A row for each shard, a column for each source; columns add up to quotas."""
    total, rows, left = int(quotas.sum()), [], quotas.astype(np.int64).copy()
    size = max(slots, -(-total // MOST_SHARDS))
    rng = np.random.default_rng(seed)
    while left.sum() > 0:
        n = min(size, int(left.sum()))
        drawn = np.minimum(rng.multinomial(n, left / left.sum()), left)
        while drawn.sum() < n:  # what went beyond a source's rest is drawn again
            rest = left - drawn
            drawn = np.minimum(drawn + rng.multinomial(n - drawn.sum(), rest / rest.sum()), left)
        rows.append(drawn)
        left -= drawn
    return np.array(rows, np.int64).reshape(-1, len(quotas))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def permuted(index: np.ndarray, n: int, key: int) -> np.ndarray:
    """A keyed permutation of 0..n-1: four Feistel rounds, walked until inside."""
    half = max(1, (max(n - 1, 1).bit_length() + 1) // 2)
    mask, shift = np.uint64((1 << half) - 1), np.uint64(half)
    x = index.astype(np.uint64)
    todo = np.ones(len(x), bool)
    while todo.any():
        left, right = x[todo] >> shift, x[todo] & mask
        for r in range(4):
            salt = np.uint64((key * 4 + r) * 0x9E3779B97F4A7C15 % (1 << 64))
            left, right = right, left ^ (_mixed(right + salt) & mask)
        x[todo] = (left << shift) | right
        todo = x >= np.uint64(n)
    return x.astype(np.int64)


def slot_task(n_blocks: list[int], seed: int):
    """Slots of (shard, source) draws: input shard, source, start, count."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for shard, source, start, count in frame[["shard", "source_no", "start", "count"]].itertuples(index=False):
                n = n_blocks[source]
                for a in range(start, start + count, 1 << 16):
                    j = np.arange(a, min(a + (1 << 16), start + count))
                    block = np.empty(len(j), np.int64)
                    for turn in np.unique(j // n):
                        own = j // n == turn
                        block[own] = permuted(j[own] % n, n, seed + 1_000_003 * source + int(turn))
                    yield pd.DataFrame({"shard": shard, "source_no": source, "slot": j, "turn": j // n, "block": block})
        trim()

    return run


class Plan:
    """The written tables of one mix: ``docs`` places texts in the streams,
    ``slots`` says which blocks each output shard takes."""

    def __init__(self, spark: SparkSession, docs: DataFrame, mix: Mix):
        self.mix, self.tables = mix, Tables(spark, "source-mix")
        docs = only(docs, "doc_id", "text", "source")
        sized = docs.select(
            F.col("doc_id").cast("long").alias("doc_id"),
            "source",
            F.xxhash64("text").alias("text_hash"),
            F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        )
        sized = self.tables.write(sized.withColumn("place", F.xxhash64("doc_id", "text_hash", F.lit(mix.seed))), "sized")
        # a few values for each source
        sources = sized.groupBy("source").agg(F.sum("size").alias("size"), F.count("*").alias("docs")).collect()
        sources.sort(key=lambda r: (r.source is None, r.source or ""))
        self.sources = [r.source for r in sources]
        self.sizes = [r["size"] for r in sources]
        weights = [mix.weights[i % len(mix.weights)] for i in range(len(sources))]
        self.targets = targets(self.sizes, weights, mix.share * sum(self.sizes), mix.most) if sources else []
        self.blocks = [-(-s // mix.block) for s in self.sizes]
        quotas = np.array([min(round(t / s * b), int(mix.most * b)) if s else 0 for t, s, b in zip(self.targets, self.sizes, self.blocks)], np.int64)
        known = local_table(spark, _KNOWN, [(i, s, float(t), n) for i, (s, t, n) in enumerate(zip(self.sources, self.targets, self.sizes))])
        numbered = sized.join(known, F.expr("source <=> known")).drop("known")
        # Words before each text: sums inside chunks of the fixed order, then over the chunks.
        n = sum(r.docs for r in sources)
        chunks = max(1, n // 2048)
        numbered = numbered.withColumn("chunk", F.pmod("place", F.lit(chunks)))
        inside = Window.partitionBy("source_no", "chunk").orderBy("place", "doc_id", "text_hash").rowsBetween(Window.unboundedPreceding, -1)
        numbered = numbered.withColumn("before", F.coalesce(F.sum("size").over(inside), F.lit(0)))
        over = Window.partitionBy("source_no").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
        sums = numbered.groupBy("source_no", "chunk").agg(F.sum("size").alias("words")).withColumn("base", F.coalesce(F.sum("words").over(over), F.lit(0))).drop("words")
        placed = numbered.join(sums, ["source_no", "chunk"]).withColumn("start", F.col("base") + F.col("before"))
        self.docs = self.tables.write(placed.select("doc_id", "text_hash", "source", "source_no", "size", "source_size", "target", "start"), "docs")
        draws = shard_counts(quotas, mix.slots, mix.seed) if quotas.sum() else np.zeros((0, max(1, len(quotas))), np.int64)
        starts = np.cumsum(draws, 0) - draws
        rows = [(int(a), int(b), int(starts[a, b]), int(draws[a, b])) for a, b in zip(*np.nonzero(draws))]
        drawn = local_table(spark, _DRAWN, rows).repartition(partitions_for(spark), "shard")
        self.slots = self.tables.write(drawn.mapInPandas(slot_task(self.blocks, mix.seed), "shard long, source_no int, slot long, turn long, block long"), "slots")

    def pieces(self) -> DataFrame:
        """Parts of texts in blocks, joined with the slots that take them: a row
        for each (text, slot) with the part's words [from_word, to_word)."""
        width = self.mix.block
        parts = self.docs.where("size > 0").withColumn("block", F.explode(F.sequence(F.floor(F.col("start") / width), F.floor((F.col("start") + F.col("size") - 1) / width))))
        parts = parts.withColumn("from_word", F.greatest(F.lit(0), F.col("block") * width - F.col("start"))).withColumn("to_word", F.least("size", (F.col("block") + 1) * width - F.col("start")))
        return parts.join(self.slots, ["source_no", "block"])


def taken_words(spark: SparkSession, docs: DataFrame, mix: Mix = Mix()) -> DataFrame:
    """doc_id, size, source_size, target, taken of every row."""
    plan = Plan(spark, docs, mix)
    key = ["source_no", "start", "doc_id", "text_hash"]
    uses = plan.slots.groupBy("source_no", "block").agg(F.count("*").alias("uses"))
    width = mix.block
    taken = (
        plan.docs.where("size > 0")
        .withColumn("block", F.explode(F.sequence(F.floor(F.col("start") / width), F.floor((F.col("start") + F.col("size") - 1) / width))))
        .withColumn("words", F.least(F.col("start") + F.col("size"), (F.col("block") + 1) * width) - F.greatest("start", F.col("block") * width))
        .join(uses, ["source_no", "block"])
        .groupBy(*key)
        .agg(F.sum(F.col("words") * F.col("uses")).alias("taken"))
    )
    # texts with words have starts of their own in a source
    out = plan.docs.where("size > 0").join(taken.select("source_no", "start", "taken"), ["source_no", "start"], "left")
    whole = out.unionByName(plan.docs.where("size = 0").withColumn("taken", F.lit(0).cast("long")))
    return whole.select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))


def _cut_task(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    import re

    word = re.compile(WORD)
    for frame in frames:
        texts = []
        for text, spans in zip(frame.text, frame.spans):
            ends = [m.span() for m in word.finditer(text)]
            merged: list[list[int]] = []
            for a, b in sorted((int(s["from_word"]), int(s["to_word"])) for s in spans):
                if merged and merged[-1][1] == a:
                    merged[-1][1] = b
                else:
                    merged.append([a, b])
            whole = len(merged) == 1 and merged[0] == [0, len(ends)]
            texts.append(text if whole else "\n".join(text[ends[a][0] : ends[b - 1][1]] for a, b in merged))
        yield pd.DataFrame({"doc_id": frame.doc_id, "text": texts, "lang": frame.lang, "source": frame.source})
    trim()


def mixed_documents(spark: SparkSession, docs: DataFrame, mix: Mix = Mix()) -> DataFrame:
    """The mix as documents: for each pass over a source, a row for each text
    with the words that the pass takes of it, in order (columns of documents)."""
    plan = Plan(spark, docs, mix)
    spans = plan.pieces().groupBy("source_no", "start", "turn").agg(F.first("doc_id").alias("id"), F.first("text_hash").alias("th"), F.first("source").alias("of"), F.collect_list(F.struct("from_word", "to_word")).alias("spans"))
    texts = only(docs, "doc_id", "text", "lang", "source").withColumn("own", F.xxhash64("text"))
    # equal rows have spans each, so one text is enough for them
    if plan.docs.groupBy("doc_id", "text_hash", "source").count().where("count > 1").limit(1).count():
        texts = texts.dropDuplicates(["doc_id", "own", "source"])
    both = texts.join(spans.select("id", "th", "of", "spans"), F.expr("own = th AND doc_id <=> id AND source <=> of"))
    cut = both.select("doc_id", "text", "lang", "source", "spans").mapInPandas(_cut_task, "doc_id long, text string, lang string, source string")
    return cut.withColumn("n_chars", F.length("text").cast("long"))
