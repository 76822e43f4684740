"""Line dedup: an exact set-similarity join over lines.

A line's tokens are its distinct five-word shingles (A-Z folded; fewer words are
one token).  A line is removed if an earlier line, in order of (doc_id, line
number), has a Jaccard similarity of 3/4 or more with it; that includes equal
lines.  Whether the earlier line is itself removed makes no difference.

1. *Rarity.*  Tokens stand rarest first: those outside the (bounded) table of
   tokens that many lines share by hash, then the table's by ascending count.
2. *Prefix filter.*  A set of n tokens posts its first n - ceil(3n/4) + 1; two
   similar sets share a token there.  Of a group of sets whose tokens before the
   shared one are the same as well, nothing is taken: that token's group has it.
3. *Length and positional filters.*  A pair goes on if its sizes allow 3/4, and
   if the tokens from the shared one on can still make up the needed overlap.
4. *Parity sketches*, then verification on the whole sets.
5. Groups of many sets first try one member each; then every line that still
   lacks an earlier match tries the earlier member of each block with the
   nearest sketch, and at last every one that is left.

Equal sets are one node throughout.

Defined results: null texts have no lines, an empty text has one; lines without
words stay; lines at equal places of rows with one doc_id don't remove each
other; rows with a null doc_id come first, by the hash of their text, each text
being a document of its own; repeated rows are each returned; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .bytekernel import finalise, slices, utf8
from .set_pairs import BUCKET_POSTINGS, CANDIDATES_DDL, HELD, SMALL_GROUP, Identity, Ratio, Recurring, Seen, Sketches, Verifier, blocks, by_bucket, check_ratio, common_table, distinct_pairs, first_pairs, group_batches, groups_of, near_pairs, packed_postings, pair_batches, picked, rarest, sets_of, settled, sketches, small_pairs, uncovered, whole_groups, within
from .storage import Tables, hot_values, only, salted_join

SKETCH = 256
_FIRST = -(1 << 63)
#: What orders lines: document, text hash of documents without id, line number.
PLACE = ("doc", "tie", "line")


def lines(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of all lines of all texts; breaks belong to the line before."""
    raw, offsets = utf8(column)
    return raw, _line_offsets(raw, offsets)


def _line_offsets(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    # a text that ends in a break has an empty last line, as has an empty text
    return np.sort(np.concatenate([offsets, np.flatnonzero(raw == 10) + 1]), kind="stable")


def line_numbers(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Text and number of each line of ``lines``."""
    breaks = np.concatenate([[0], np.cumsum(raw == 10)])
    counts = breaks[offsets[1:]] - breaks[offsets[:-1]] + 1
    owner = np.repeat(np.arange(len(counts)), counts)
    return owner, np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)


_PROFILE = pa.schema([("doc_id", pa.int64()), ("th", pa.int64()), ("n_lines", pa.int64()), ("line", pa.int64()), ("n", pa.int64()), ("set", pa.int64()), ("check", pa.int64()), ("sketch", pa.binary()), ("shingle", pa.int64()), ("times", pa.int64())])
_PROFILE_DDL = "doc_id long, th long, n_lines long, line long, n long, set long, check long, sketch binary, shingle long, times long"


def _profile(rows: int, **columns: pa.Array) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([columns.get(f.name, pa.nulls(rows, f.type)) for f in _PROFILE], schema=_PROFILE)


def profile_task(width: int, identity: Identity):
    """Rows of documents, rows of their lines with words, counts of recurring tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, recurring = Seen(), Recurring()
        for batch in slices(batches):
            ids, th, texts = batch.column("doc_id").cast(pa.int64()), batch.column("th"), batch.column("text")
            owner, number = line_numbers(*utf8(texts))
            counts = np.where(texts.is_null(), 0, np.bincount(owner, minlength=len(batch)))
            yield _profile(len(batch), doc_id=ids, th=th, n_lines=pa.array(counts))
            elements, offsets = sets_of(texts, width, lines)
            sets, checks = identity.ids(elements, offsets)
            full = np.flatnonzero(np.diff(offsets))
            new = np.zeros(len(sets), bool)
            new[full] = seen.new(sets[full])
            recurring.add(picked(elements, offsets, new)[0])
            at = pa.array(owner[full])
            made = sketches(elements, offsets, new, SKETCH).take(pa.array(full))
            yield _profile(len(full), doc_id=ids.take(at), th=th.take(at), line=pa.array(number[full]), n=pa.array(np.diff(offsets)[full]), set=pa.array(sets[full]), check=pa.array(checks[full]), sketch=made)
        keys, counts = recurring.counted()
        yield _profile(len(keys), shingle=pa.array(keys.view(np.int64)), times=pa.array(counts))

    return run


def prefix_size(n, ratio: Ratio):
    """How many tokens, rarest first, a set of n posts."""
    num, den = ratio
    return n - -(-n * num // den) + 1


_POSTINGS = pa.schema([("bucket", pa.int32()), ("signatures", pa.binary()), ("sets", pa.binary()), ("places", pa.binary()), ("before", pa.binary())])


def posting_task(width: int, ratio: Ratio, common, buckets: int, identity: Identity):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, held, pending = Seen(), 0, []

        def flushed():
            tokens, sets, place, before = (np.concatenate(x) for x in zip(*pending))
            yield from packed_postings([sets, place, before], finalise(tokens ^ np.uint64(0x7F4A7C15)), buckets, _POSTINGS)

        for batch in slices(batches):
            elements, offsets = sets_of(batch.column("text"), width, lines)
            sets, _ = identity.ids(elements, offsets)
            new = offsets[1:] > offsets[:-1]
            new[new] = seen.new(sets[new])
            if not new.any():
                continue
            elements, offsets = picked(elements, offsets, new)
            n = np.diff(offsets)
            tokens, of = rarest(elements, offsets, common.value.rank(elements), prefix_size(n, ratio))
            pos = np.arange(len(of)) - np.searchsorted(of, of)
            place = (np.minimum(n[of], 65535).astype(np.uint32) << np.uint32(16)) | np.minimum(pos, 65535).astype(np.uint32)
            before = np.where(pos > 0, np.concatenate([tokens[:1], tokens[:-1]]), np.uint64(0))
            pending.append((tokens, sets[new][of], place, before))
            held += len(tokens)
            if held > HELD:
                yield from flushed()
                pending, held = [], 0
        if pending:
            yield from flushed()

    return run


def passes(na: np.ndarray, pa_: np.ndarray, nb: np.ndarray, pb: np.ndarray, ratio: Ratio) -> np.ndarray:
    """The length and positional filters; sizes of 65535 are not known exactly."""
    num, den = ratio
    length = np.minimum(na, nb) * den >= np.maximum(na, nb) * num
    needed = -(-(na + nb) * num // (den + num))
    position = 1 + np.minimum(na - pa_ - 1, nb - pb - 1) >= needed
    return (length & position) | (na >= 65535) | (nb >= 65535)


def candidate_task(ratio: Ratio):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for parts in by_bucket(batches, [np.uint32, np.int64, np.uint32, np.uint64]):
            pairs, told = [], set()
            for tokens, sets, place, before in parts:
                n, pos = (place >> np.uint32(16)).astype(np.int64), (place & np.uint32(65535)).astype(np.int64)
                first, size = groups_of(tokens)
                more = uncovered(before, first, size)
                first, size = first[more], size[more]
                i, j = small_pairs(first, size)
                good = passes(n[i], pos[i], n[j], pos[j], ratio)
                pairs.append(distinct_pairs(sets[i[good]], sets[j[good]]))
                yield from group_batches(sets, first[size > SMALL_GROUP], size[size > SMALL_GROUP], told)
            yield from pair_batches(pairs)

    return run


def rest_task(ratio: Ratio, nearest: bool):
    """Possible pairs of a line without an earlier match and an earlier one, or
    each such line's nearest one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, group in whole_groups(batches, ["gid", "p", "q"]):
            table = table.combine_chunks()
            order = np.lexsort((table.column("n").to_numpy(), group))
            n, s, side, open_ = (table.column(c).to_numpy(zero_copy_only=False)[order] for c in ("n", "set", "side", "open"))
            group = group[order]
            at = [table.column(c).to_numpy()[order] for c in PLACE]
            by_place = np.lexsort(at[::-1])
            moved = np.zeros(len(n), np.int64)
            for x in at:
                moved[1:] |= x[by_place][1:] != x[by_place][:-1]
            place = np.empty(len(n), np.int64)
            place[by_place] = np.cumsum(moved)
            made = Sketches(table.column("sketch").take(pa.array(order)))

            def wanted(i: np.ndarray, j: np.ndarray) -> np.ndarray:
                later = np.where(place[i] > place[j], i, j)
                return open_[later] & (place[i] != place[j]) & ((side[i] != side[j]) | (side[i] == 2))

            best, other = np.full(len(n), 1 << 40), np.zeros(len(n), np.int64)
            for i, j, apart in near_pairs(group, n, made, ratio, wanted):
                if nearest:
                    later = np.where(place[i] > place[j], i, j)
                    by = np.lexsort((apart, later))
                    by = by[np.flatnonzero(np.diff(later[by], prepend=-1))]
                    by = by[apart[by] < best[later[by]]]
                    best[later[by]], other[later[by]] = apart[by], np.where(later == i, j, i)[by]
                else:
                    yield _pairs(s[i], s[j])
            if nearest:
                found = np.flatnonzero(best < 1 << 40)
                yield _pairs(s[found], s[other[found]])

    return run


def _pairs(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])


def _matched(links: DataFrame, info: DataFrame) -> DataFrame:
    """Sets with an earlier match among ``links``."""
    place = info.select(F.col("set"), F.struct(*PLACE).alias("at"))
    ends = links.join(place.toDF("a", "at_a"), "a").join(place.toDF("b", "at_b"), "b")
    return ends.where("at_a <> at_b").select(F.when(F.col("at_a") < F.col("at_b"), F.col("b")).otherwise(F.col("a")).alias("set")).distinct()


def _rest(groups: DataFrame, info: DataFrame, matched: DataFrame, ratio: Ratio, nearest: bool) -> DataFrame:
    members = groups.select("gid", "size", F.explode("members").alias("set"))
    members = members.join(matched.withColumn("matched", F.lit(True)), "set", "left").join(info.select("set", "n", "sketch", *PLACE), "set").withColumn("open", F.col("matched").isNull()).drop("matched")
    # a line can only match in the group if some member, open or not, is earlier
    place = F.struct(*PLACE)
    undecided = members.groupBy("gid").agg(F.min(place).alias("first"), F.max(F.when(F.col("open"), place)).alias("last_open"), F.max("size").alias("size")).where("last_open > first").select("gid", "size")
    rows = within(members, undecided)
    return blocks(rows).mapInArrow(rest_task(ratio, nearest), "a long, b long").distinct()


def _place(doc: str, th: str, line: str) -> Column:
    """Rows without id are told apart by their texts."""
    tie = F.when(F.col(doc).isNull(), F.col(th)).otherwise(F.lit(0).cast("long"))
    return F.struct(F.coalesce(doc, F.lit(_FIRST)).alias("doc"), tie.alias("tie"), F.col(line).alias("line"))


def removed_lines(spark: SparkSession, docs: DataFrame, width: int = 5, ratio: Ratio = (3, 4), id_bits: int = 64) -> DataFrame:
    """doc_id, th (hash of the text), n_lines, removed (ascending line numbers from 0) of every row."""
    check_ratio(ratio)
    tables = Tables(spark, "line-dedup")
    docs = only(docs, "doc_id", "text").withColumn("th", F.xxhash64("text"))
    texts = docs.select("text")

    def write(identity: Identity) -> DataFrame:
        return tables.write(docs.mapInArrow(profile_task(width, identity), _PROFILE_DDL), f"profile-{len(identity.collided)}")

    profile, rows, identity = settled(write, id_bits)
    handle = spark.sparkContext.broadcast(common_table(profile.where("shingle is not null")))
    at = _place("doc_id", "th", "line")
    info = rows.groupBy("set").agg(F.first("n").alias("n"), F.first("sketch", ignorenulls=True).alias("sketch"), F.min(at).alias("at"), F.count("*").alias("copies"))
    info = tables.write(info.select("set", "n", "sketch", "at.*", "copies"), "info")
    total = info.agg(F.sum("n")).first()[0] or 0
    buckets = max(1, int(total * 0.3 / BUCKET_POSTINGS))
    postings = texts.mapInArrow(posting_task(width, ratio, handle, buckets, identity), "bucket int, signatures binary, sets binary, places binary, before binary")
    found = tables.write(postings.repartition(buckets, "bucket").sortWithinPartitions("bucket").mapInArrow(candidate_task(ratio), CANDIDATES_DDL), "candidates")
    verifier = Verifier(spark, tables, texts, info, width, ratio, identity, lines)
    groups = tables.write(found.where("gid is not null").select("gid", "size", "members").distinct(), "groups")
    pairs = verifier.possible(first_pairs(found), "first")
    verifier.prepare(pairs, groups)
    matched = tables.write(_matched(verifier.links(pairs, "first"), info), "matched")
    tables.drop("candidates", "first-possible")
    if groups.limit(1).count():
        near = tables.write(_rest(groups, info, matched, ratio, True), "nearest")
        matched = tables.write(matched.union(_matched(verifier.links(near, "nearest"), info)).distinct(), "matched-nearest")
        rest = tables.write(_rest(groups, info, matched, ratio, False).join(near, ["a", "b"], "left_anti"), "rest")
        if rest.limit(1).count():
            matched = tables.write(matched.union(_matched(verifier.links(rest, "rest"), info)).distinct(), "matched-rest")
        tables.drop("nearest", "rest", "groups", "elements")
    # of the others each line stays
    fate = info.join(matched.withColumn("matched", F.lit(True)), "set", "left").where("matched OR copies > 1").select("set", F.struct(*PLACE).alias("first"), F.col("matched").isNotNull().alias("matched"))
    hot = hot_values(info, "set", "copies")
    gone = salted_join(rows.select("doc_id", "th", "line", "set"), fate, "set", hot, "doc_id", "th", "line").where((at != F.col("first")) | F.col("matched"))
    gone = gone.groupBy("doc_id", "th").agg(F.array_sort(F.collect_set("line")).alias("removed")).toDF("gone_id", "gone_th", "removed")
    counts = profile.where("n_lines is not null").select("doc_id", "th", "n_lines")
    return counts.join(gone, F.expr("doc_id <=> gone_id AND th <=> gone_th"), "left").select("doc_id", "th", "n_lines", F.coalesce("removed", F.array().cast("array<long>")).alias("removed"))


def without_repeated_lines(spark: SparkSession, docs: DataFrame, width: int = 5, ratio: Ratio = (3, 4)) -> DataFrame:
    """``docs`` (columns doc_id and text at least) with the lines that stay."""
    gone = removed_lines(spark, docs, width, ratio).where(F.size("removed") > 0).dropDuplicates(["doc_id", "th"])
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("doc_id").cast("long").alias("id"), F.xxhash64("text").alias("own"))
    both = rows.join(gone.select("doc_id", "th", "removed"), F.expr("id <=> doc_id AND own = th"), "left")
    kept = F.array_join(F.filter(F.split("row.text", "\n"), lambda x, i: ~F.array_contains("removed", i.cast("long"))), "\n")
    text = F.when(F.col("removed").isNull(), F.col("row.text")).otherwise(kept).alias("text")
    return both.select(*[text if c == "text" else F.col("row").getField(c).alias(c) for c in docs.columns])


def digests(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_removed, removed as text, of every row."""
    found = removed_lines(spark, docs)
    return found.select("doc_id", "n_lines", F.size("removed").cast("long").alias("n_removed"), F.array_join(F.col("removed").cast("array<string>"), ",").alias("removed"))
