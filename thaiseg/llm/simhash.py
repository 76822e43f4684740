"""Document fingerprints: 128-bit SimHash, in DataFrame functions throughout.

The terms of a text are its runs of up to three neighbouring words.  A term
votes with 1 plus the number of its words of four or more letters; each
occurrence votes, so a term's weight is that times its frequency.  A term's
128 hash bits say for each fingerprint bit whether it votes for or against, and
a bit is on if more than half of the text's weight is for it.

Votes are counted two bits to a long (bits i and i + 32 in lanes of 32 bits), so
that one aggregation of 64 sums fingerprints all texts; map-side sums leave one
row for each text in the shuffle.

``near_counts`` and ``neighbours`` find all distinct fingerprints within a Hamming
radius of each other by permuted block tables: with b blocks, two fingerprints
within radius r agree on b - r blocks at least, and each choice of b - r blocks is
one table.

Defined results: null and empty texts and texts without words have the
fingerprint of no votes, zero; equal texts have equal fingerprints; rows with
equal doc_id are ordered by text, null doc_ids come last; the next document of a
single row is itself; an empty table gives an empty result; other columns are
ignored.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .storage import Tables, hot_values, only, partitions_for, salted_join

BITS, LANES = 128, 32
#: Ranges of ids for the next document: of about so many bytes, and so many at most.
PART_BYTES, PARTS_MOST = 64 << 20, 4096
#: The block tables of the query: 28 of two blocks of 16 bits each.
RADIUS, BLOCKS = 6, 8
#: Rows of a key that are compared in one group, and tables at most (a power of two).
GROUP, TABLES_MOST = 4096, 256
_SPACES = r"[\x20\x09-\x0D]+"
_PAIR = (1 << 32) + 1


def votes(texts: DataFrame, text: str, *keys: str) -> DataFrame:
    """keys, weight and the sums v0 to v63 of each row; keys identify rows."""
    words = F.filter(F.split(F.col(text), _SPACES), lambda w: w != "")
    rows = texts.select(*keys, words.alias("w")).select(*keys, F.inline_outer(F.arrays_zip(F.col("w").alias("a"), F.slice("w", 2, 1 << 30).alias("b"), F.slice("w", 3, 1 << 30).alias("c"))).alias("a", "b", "c"))
    long_ = lambda c: F.coalesce((F.length(c) >= 4).cast("long"), F.lit(0).cast("long"))
    # a text without words has one row of nulls, without weight
    weight = F.when(F.col("a").isNull(), F.lit(0).cast("long")).otherwise(long_("a") + long_("b") + long_("c") + 1)
    hashed = rows.select(*keys, weight.alias("weight"), F.xxhash64(F.lit(1), "a", "b", "c").alias("h0"), F.xxhash64(F.lit(2), "c", "b", "a").alias("h1"))
    sums = [F.sum(F.expr(f"(shiftrightunsigned(h{k}, {i}) & {_PAIR}L) * weight")).alias(f"v{k * LANES + i}") for k in (0, 1) for i in range(LANES)]
    return hashed.groupBy(*keys).agg(F.sum("weight").alias("weight"), *sums)


def _word(k: int) -> Column:
    """The 64 bits of half k from its sums."""
    out = F.lit(0).cast("long")
    for i in range(LANES):
        v = f"v{k * LANES + i}"
        low = f"if(2 * ({v} & 4294967295L) > weight, shiftleft(1L, {i}), 0L)"
        high = f"if(2 * shiftrightunsigned({v}, 32) > weight, shiftleft(1L, {i + 32}), 0L)"
        out = out.bitwiseOR(F.expr(low)).bitwiseOR(F.expr(high))
    return out


def fingerprint_words(texts: DataFrame, text: str, *keys: str) -> DataFrame:
    """keys, hi, lo: the two halves of each row's fingerprint."""
    return votes(texts, text, *keys).select(*keys, _word(0).alias("hi"), _word(1).alias("lo"))


def as_hex(hi: str, lo: str) -> Column:
    return F.lower(F.concat(F.lpad(F.hex(hi), 16, "0"), F.lpad(F.hex(lo), 16, "0")))


def likeness(hi: str, lo: str, other_hi: str, other_lo: str) -> Column:
    return F.expr(f"1D - (bit_count({hi} ^ {other_hi}) + bit_count({lo} ^ {other_lo})) / {BITS}D")


def fingerprints(texts: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """key, fingerprint (32 hex digits), hi, lo; rows are told apart by key."""
    return fingerprint_words(only(texts, key, text), text, key).select(key, as_hex("hi", "lo").alias("fingerprint"), "hi", "lo")


def _linked(tables: Tables, prints: DataFrame, radius: int, blocks: int) -> DataFrame:
    """hi, lo, other_hi, other_lo, distance of all distinct fingerprints within
    radius, each pair in both orders and once.

    A pair is found in the first table whose blocks it agrees on.  The rows of a
    key are dealt in groups of GROUP, each compared with all rows of the key in
    a task's merge join, which holds them in memory or spills.
    """
    same = blocks - radius
    choices = list(combinations(range(blocks), max(same, 1)))
    if same < 1 or radius < 0 or len(choices) > TABLES_MOST:
        raise ValueError(f"radius {radius} of {blocks} blocks: more blocks than radius, and {TABLES_MOST} tables at most")
    edges = [round(i * BITS / blocks) for i in range(blocks + 1)]

    def masks(i: int) -> list[tuple[str, int]]:
        out = []
        for half, word in enumerate(("hi", "lo")):
            x, y = max(edges[i] - 64 * half, 0), min(edges[i + 1] - 64 * half, 64)
            if x < y:
                mask = ((1 << (y - x)) - 1) << x
                out.append((word, mask - (1 << 64) if mask >> 63 else mask))
        return out

    def key(no: int, choice: tuple[int, ...]) -> Column:
        hashed = F.xxhash64(*[F.col(w).bitwiseAND(F.lit(m).cast("long")) for i in choice for w, m in masks(i)])
        return hashed.bitwiseAND(F.lit(-TABLES_MOST).cast("long")).bitwiseOR(F.lit(no).cast("long"))

    distinct = tables.write(prints.select("hi", "lo").distinct(), "distinct")
    keyed = distinct.select("hi", "lo", F.explode(F.array(*[key(no, c) for no, c in enumerate(choices)])).alias("key"))
    large = tables.write(keyed.groupBy("key").count().where(F.col("count") > GROUP).select("key", F.ceil(F.col("count") / GROUP).cast("int").alias("groups")), "large")
    if large.isEmpty():
        left = keyed.withColumn("group", F.lit(0))
        right = left
    else:
        sized = salted_join(keyed, large, "key", hot_values(large, "key", "groups"), "hi", "lo", how="left").withColumn("groups", F.coalesce("groups", F.lit(1)))
        left = sized.select("hi", "lo", "key", F.expr("CAST(pmod(xxhash64(lo, hi), groups) AS INT)").alias("group"))
        right = sized.select("hi", "lo", "key", F.explode(F.sequence(F.lit(0), F.col("groups") - 1)).alias("group"))
    other = right.select("key", "group", F.col("hi").alias("other_hi"), F.col("lo").alias("other_lo"))
    # by the set of blocks that agree, the first table that has only such blocks
    numbers = {c: no for no, c in enumerate(choices)}
    found_in = [numbers.get(tuple(i for i in range(blocks) if agree >> i & 1)[:same], -1) for agree in range(1 << blocks)]
    agree = " + ".join("if(" + " AND ".join(f"(({w} ^ other_{w}) & {m}L) = 0" for w, m in masks(i)) + f", {1 << i}, 0)" for i in range(blocks))
    # Spark's guess of the size leaves out that explode makes a row for each table, so it would send all of them to the driver to broadcast them
    pairs = left.join(other.hint("merge"), ["key", "group"]).withColumn("distance", F.expr("bit_count(hi ^ other_hi) + bit_count(lo ^ other_lo)"))
    first = F.element_at(F.array(*[F.lit(no) for no in found_in]), F.expr(f"1 + {agree}"))
    pairs = pairs.where(F.col("distance").between(1, radius) & (first == F.expr(f"CAST(key & {TABLES_MOST - 1} AS INT)")))
    return pairs.select("hi", "lo", "other_hi", "other_lo", "distance")


def neighbours(prints: DataFrame, radius: int = 3, blocks: int = 5) -> DataFrame:
    """hi, lo, other_hi, other_lo, distance of all pairs of distinct fingerprints
    within radius.  ``near_counts`` has a row for each fingerprint instead."""
    pairs = _linked(Tables(prints.sparkSession, "simhash"), prints, radius, blocks)
    return pairs.where("hi < other_hi OR (hi = other_hi AND lo < other_lo)")


def near_counts(prints: DataFrame, radius: int, blocks: int) -> DataFrame:
    """hi, lo, n_near, nearest of the fingerprints with others within radius: how
    many there are and the least distance.  Pairs are counted where they are
    found, so none of them is shuffled or written."""
    pairs = _linked(Tables(prints.sparkSession, "simhash"), prints, radius, blocks)
    return pairs.groupBy("hi", "lo").agg(F.count("*").alias("n_near"), F.min("distance").cast("int").alias("nearest"))


def with_neighbours(found: DataFrame, radius: int, blocks: int, tables: Tables) -> DataFrame:
    """``found`` (fingerprint, hi, lo and more) with n_near and nearest: the other
    fingerprints within radius, equal ones not counted; nearest is null if none."""
    found = tables.write(found, "found")
    near = near_counts(found, radius, blocks).select(as_hex("hi", "lo").alias("fingerprint"), "n_near", "nearest")
    near = tables.write(near, "near")
    out = salted_join(found.drop("hi", "lo"), near, "fingerprint", hot_values(found, "fingerprint"), "doc_id", "edited_sha256", how="left")
    return out.withColumn("n_near", F.coalesce("n_near", F.lit(0).cast("long")))


def _ranges(docs: DataFrame, n: int) -> list[int]:
    if n < 2:
        return []
    found = docs.agg(F.percentile_approx("doc_id", [k / n for k in range(1, n)], 100 * n)).first()[0]
    return sorted(set(found or []))


def _above(column: Column, bounds: list[int]) -> Column:
    """How many bounds are at or above the id: ranges of descending ids."""
    if not bounds:
        return F.lit(0)
    mid = len(bounds) // 2
    return F.when(column > F.lit(bounds[mid]), _above(column, bounds[mid + 1 :])).otherwise(F.lit(len(bounds) - mid) + _above(column, bounds[:mid]))


def fingerprints_with_edits(spark: SparkSession, docs: DataFrame, radius: int = RADIUS, blocks: int = BLOCKS) -> DataFrame:
    """Every text's fingerprint beside that of its edited text and the next document,
    with the number of other fingerprints within radius and the least distance.

    Ids are cut into ranges; a range's first document is also put at the end of
    the range before, so "the next document" never leaves a range.
    """
    docs = only(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bounds = _ranges(docs, max(partitions_for(spark), min(PARTS_MOST, size // PART_BYTES)))
    part = F.coalesce(_above(F.col("doc_id"), bounds), F.lit(len(bounds)))
    placed = docs.withColumn("part", part.cast("int"))
    # a few values for each range; null ids stand last
    heads = {r.part: r.head for r in placed.groupBy("part").agg(F.max("doc_id").alias("head")).collect()}
    used = sorted(heads)
    before = {p: used[i - 1] for i, p in enumerate(used)}
    copies = F.array(F.struct(F.col("part").alias("p"), F.lit(True).alias("own")))
    head_of = F.create_map(*[x for p in used for x in (F.lit(p), F.lit(heads[p]).cast("long"))]) if used else None
    prev_of = F.create_map(*[x for p in used for x in (F.lit(p), F.lit(before[p]))]) if used else None
    if used:
        is_head = F.col("doc_id").eqNullSafe(F.element_at(head_of, F.col("part")))
        copies = F.when(is_head, F.array(F.struct(F.col("part").alias("p"), F.lit(True).alias("own")), F.struct(F.element_at(prev_of, F.col("part")).alias("p"), F.lit(False).alias("own")))).otherwise(copies)
    rows = placed.select("doc_id", "text", F.explode(copies).alias("c")).select("doc_id", "text", F.col("c.p").alias("part"), F.col("c.own").alias("own"))
    # a task for each range: by hash several ranges would share one
    rows = rows.repartitionById(len(bounds) + 1, F.col("part"))
    order = Window.partitionBy("part").orderBy(F.desc("own"), F.desc_nulls_last("doc_id"), "text")
    rows = rows.withColumn("pos", F.row_number().over(order)).withColumn("next", F.lead("text").over(order))
    edited = F.concat(F.expr("substring(text, 1, length(text) - CAST(floor(length(text) / 2) AS INT))"), F.expr("substring(next, 1, CAST(floor(length(text) / 2) AS INT))"))
    both = rows.select("part", "pos", F.explode(F.array(F.struct(F.lit(0).alias("kind"), "own", "doc_id", F.length("text").cast("long").alias("n_chars"), F.lit(None).cast("string").alias("sha"), F.col("text").alias("t")), F.struct(F.lit(1).alias("kind"), "own", "doc_id", F.length("text").cast("long").alias("n_chars"), F.sha2(edited, 256).alias("sha"), edited.alias("t")))).alias("x"))
    both = both.select("part", "pos", "x.*").where("kind = 0 OR own")
    keys = ["part", "pos", "kind", "own", "doc_id", "n_chars", "sha"]
    made = fingerprint_words(both, "t", *keys)
    one = made.groupBy("part", "pos").agg(
        F.first("own").alias("own"),
        F.first("doc_id").alias("doc_id"),
        F.first("n_chars").alias("n_chars"),
        F.max("sha").alias("edited_sha256"),
        *[F.max(F.when(F.col("kind") == k, F.col(c))).alias(f"{c}{k}") for k in (0, 1) for c in ("hi", "lo")],
    )
    after = Window.partitionBy("part").orderBy("pos")
    one = one.withColumn("hi2", F.lead("hi0").over(after)).withColumn("lo2", F.lead("lo0").over(after)).where("own")
    made = one.select("doc_id", "n_chars", "edited_sha256", as_hex("hi0", "lo0").alias("fingerprint"), as_hex("hi1", "lo1").alias("edited_fingerprint"), likeness("hi0", "lo0", "hi1", "lo1").alias("near_edited"), likeness("hi0", "lo0", "hi2", "lo2").alias("near_next"), F.col("hi0").alias("hi"), F.col("lo0").alias("lo"))
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "n_near", "nearest"]
    return with_neighbours(made, radius, blocks, Tables(spark, "simhash")).select(*names)
