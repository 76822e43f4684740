"""N-gram Jaccard join by PartEnum signatures.

Every text becomes its set of distinct word shingles.  Two sets link when their
Jaccard similarity reaches the threshold (3/4).  The join is exact:

1. *Size bands.*  Sets of size (B/2, B] form a band; a set that may have a
   partner in the next band is signed for that band as well, so any two
   sufficiently similar sets meet in one band.
2. *Partitions.*  A band cuts the domain of shingle hashes into n1 first-level
   partitions, and each of these into n2 second-level ones.  Similar sets of
   sizes a <= b differ in at most k = floor(a / 3) shingles.  Of any
   floor(k / (k2 + 1)) + 1 first-level partitions, one has at most k2 shingles that
   differ; so one of the C(n2, k2) subsets of n2 - k2 of its second-level
   partitions holds the same shingles in both sets.  A set enumerates these
   subsets as signatures, for its partitions in order up to the
   (floor(k / (k2 + 1)) + 1)-th that has shingles in more than k2 second-level
   ones.  The order is of the partitions that either set has, so both see the
   same one: its place among a set's own can't be later.  PLANS has n1, n2, k2 by
   band: subsets of two of three up to SUBSETS_TO shingles, and one-level
   partitions beyond, where subsets cost twice the postings for as many candidates.
3. *Sparse sets.*  Of two similar sets without so many such partitions between
   them, neither has them alone.  Such sets enumerate the finest case as
   well (a partition for each hash, k2 = 0): k + 1 shingles, the rarest first.
   Shingles that very many texts share belong to this case alone and come last
   in it, so that a shared passage signs hardly any text.
4. *Candidates.*  Postings (signature, set) travel as packed arrays to the task
   that owns the signature, with the set's signature before it: a group whose
   members all have the same one before adds nothing to the group of that one.  Small groups give all their pairs; large groups
   give the pairs with one of their members and are kept.  Pairs stay if sizes
   and parity sketches leave them possible.
5. *Verification* of pairs on the whole sets, then connected components.
6. *The rest of the large groups*: possible pairs whose members are still in
   different components.  First each block of a group only gives a spanning
   forest of these, from its best connected members on, which joins what is
   similar without listing it pair by pair, and names the members of each other
   possible pair; then what is still open among these is listed and verified, but
   for the pairs that were refuted.  Texts that share much share many groups; a
   pair is listed by the first of those that name both, which they know from the
   first FIRST_GROUPS groups that name each.  Blocks of a large group are tasks of
   their own.

Equal sets are one node throughout, so copies cost one row each.

Defined results: null and empty texts, and texts without words, have size 0 and
link with nothing; a row with a null ``doc_id`` counts for its text, and gets
the component of its text (null if no row of it has an id); repeated rows stay
repeated; an empty table gives an empty result; other columns are ignored; a
threshold below 1/2 raises ValueError.  Sets are known by 128 bits, shingles by 64.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bytekernel import distinct_within, finalise, slices
from .components import components
from .set_pairs import BUCKET_POSTINGS, CANDIDATES_DDL, HELD, SMALL_GROUP, Common, Identity, Ratio, Recurring, Seen, Sketches, Verifier, blocks, by_bucket, check_ratio, common_table, distinct_pairs, first_pairs, group_batches, groups_of, near_pairs, packed_postings, pair_batches, picked, rarest, sets_of, settled, sketches, small_pairs, uncovered, whole_groups, within
from .storage import Tables, hot_values, only, salted_join


@dataclass(frozen=True)
class Plan:
    """How a band of sets of up to B shingles is partitioned: n1 = B * level[0] //
    level[1], n2 = second, k2 = left_out."""

    to: int
    level: tuple[int, int]
    second: int
    left_out: int


SUBSETS_TO = 256
PLANS = (Plan(SUBSETS_TO, (2, 7), 3, 1), Plan(1 << 62, (1, 2), 1, 0))
SKETCH_BITS = 1 << 10
#: So many of its groups a set knows; and pairs whose groups are compared together.
FIRST_GROUPS, FIRST_PAIRS = 32, 1 << 12


# --- signatures ---------------------------------------------------------------


def signatures(elements: np.ndarray, offsets: np.ndarray, common: Common, ratio: Ratio) -> tuple[np.ndarray, np.ndarray]:
    """Signatures of non-empty sets, and which set each belongs to."""
    num, den = ratio
    sizes = np.diff(offsets)
    # |A ^ B| <= (a + b)(1 - 2 j / (1 + j)) with b <= a / j, hence a (1 - j) / j
    differing = sizes * (den - num) // num
    band = (1 << np.ceil(np.log2(sizes)).astype(np.int64)).astype(np.int64)
    ranks = common.rank(elements)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    rare, owners = elements[ranks < 0], owner[ranks < 0]
    out, whose = [], []
    for top, inside in ((band, np.ones(len(sizes), bool)), (2 * band, sizes * den // num > band)):
        least = 0
        for plan in PLANS:
            now = inside & (top > least) & (top <= plan.to)
            least = plan.to
            if not now.any():
                continue
            own = now[owners]
            needed = differing // (plan.left_out + 1) + 1
            sig, of, full = subset_signatures(rare[own], owners[own], top, needed, plan)
            # sets that lack partitions, for their partners that lack them too
            short = now & (full < needed)
            values, at = picked(elements, offsets, short)
            value, place = rarest(values, at, ranks[np.repeat(short, sizes)], differing[short] + 1)
            place = np.flatnonzero(short)[place]
            out += [sig, finalise(value + finalise(top[place].astype(np.uint64) * np.uint64(8)))]
            whose += [of, place]
    return np.concatenate(out), np.concatenate(whose)


def subset_signatures(values: np.ndarray, owner: np.ndarray, top: np.ndarray, needed: np.ndarray, plan: Plan) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Signatures of the subsets, their owners, and how many partitions each set
    has with shingles in more than ``left_out`` second-level ones."""
    if not len(values):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(len(top), np.int64)
    n2 = plan.second
    level = np.maximum(1, top * plan.level[0] // plan.level[1]).astype(np.uint64)
    part = ((values >> np.uint64(32)) * level[owner]) >> np.uint64(32)
    sub = ((values & np.uint64(0xFFFFFFFF)) * np.uint64(n2)) >> np.uint64(32)
    first = np.flatnonzero(np.concatenate([[True], (part[1:] != part[:-1]) | (owner[1:] != owner[:-1])]))
    of, part = owner[first], part[first]
    mixed = finalise(values)
    sums = np.stack([np.add.reduceat(np.where(sub == j, mixed, np.uint64(0)), first) for j in range(n2)])
    held = np.stack([np.bitwise_or.reduceat(sub == j, first) for j in range(n2)])
    full = held.sum(0) > plan.left_out
    per_set = np.bincount(of, full, len(top)).astype(np.int64)
    # the full partitions of the same set before this one
    before = np.cumsum(full) - full - (np.cumsum(per_set) - per_set)[of]
    chosen = np.flatnonzero(before < needed[of])
    sums, held, of, part = sums[:, chosen], held[:, chosen], of[chosen], part[chosen]
    tag = finalise(part * np.uint64(64) + finalise(top[of].astype(np.uint64) * np.uint64(8) + np.uint64(1)))
    out, whose = [], []
    for k, gone in enumerate(combinations(range(n2), plan.left_out)):
        kept = [j for j in range(n2) if j not in gone]
        some = np.flatnonzero(held[kept].any(0))
        out.append(finalise(sums[kept][:, some].sum(0, dtype=np.uint64) + finalise(tag[some] + np.uint64(k + 1))))
        whose.append(of[some])
    return np.concatenate(out), np.concatenate(whose), per_set


# --- tasks over texts ---------------------------------------------------------

_PROFILE = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("set", pa.int64()), ("check", pa.int64()), ("sketch", pa.binary()), ("shingle", pa.int64()), ("times", pa.int64())])
_PROFILE_DDL = "doc_id long, n long, set long, check long, sketch binary, shingle long, times long"


def profile_task(width: int, identity: Identity):
    """Rows of documents, then counts of the shingles that recur in the task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, recurring = Seen(), Recurring()
        for batch in slices(batches):
            elements, offsets = sets_of(batch.column("text"), width)
            sets, checks = identity.ids(elements, offsets)
            new = seen.new(sets) & (offsets[1:] > offsets[:-1])
            recurring.add(picked(elements, offsets, new)[0])
            nothing = pa.nulls(len(sets), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(np.diff(offsets)), pa.array(sets), pa.array(checks), sketches(elements, offsets, new, SKETCH_BITS), nothing, nothing], schema=_PROFILE)
        keys, counts = recurring.counted()
        k = len(keys)
        if k:
            none = pa.nulls(k, pa.int64())
            yield pa.RecordBatch.from_arrays([none, none, none, none, pa.nulls(k, pa.binary()), pa.array(keys.view(np.int64)), pa.array(counts)], schema=_PROFILE)

    return run


#: Sizes from this on are not known exactly.
_SIZE_MOST = 65535
_POSTINGS = pa.schema([("bucket", pa.int32()), ("signatures", pa.binary()), ("sets", pa.binary()), ("sizes", pa.binary()), ("before", pa.binary())])


def posting_task(width: int, ratio: Ratio, common, buckets: int, identity: Identity):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, held, pending = Seen(), 0, []

        def flushed():
            sig, sets, n, before = (np.concatenate(x) for x in zip(*pending))
            yield from packed_postings([sets, n, before], sig, buckets, _POSTINGS)

        for batch in slices(batches):
            elements, offsets = sets_of(batch.column("text"), width)
            sets, _ = identity.ids(elements, offsets)
            new = (offsets[1:] > offsets[:-1]) & seen.new(sets)
            if not new.any():
                continue
            elements, offsets = picked(elements, offsets, new)
            sig, of = signatures(elements, offsets, common.value, ratio)
            order = np.argsort(of, kind="stable")
            sig, at = distinct_within(sig[order], np.concatenate([[0], np.cumsum(np.bincount(of, minlength=len(offsets) - 1))]))
            of = np.repeat(np.arange(len(at) - 1), np.diff(at))
            before = np.concatenate([np.zeros(1, np.uint64), sig[:-1]])
            before[at[:-1][np.diff(at) > 0]] = 0
            pending.append((sig, sets[new][of], np.minimum(np.diff(offsets), _SIZE_MOST)[of].astype(np.uint16), before))
            held += len(sig)
            if held > HELD:
                yield from flushed()
                pending, held = [], 0
        if pending:
            yield from flushed()

    return run


def candidate_task(ratio: Ratio):
    """Groups of the sets that share a signature; the input is sorted by bucket."""
    num, den = ratio

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for parts in by_bucket(batches, [np.uint32, np.int64, np.uint16, np.uint64]):
            pairs, told = [], set()
            for sigs, sets, n, before in parts:
                first, size = groups_of(sigs)
                more = uncovered(before, first, size)
                first, size = first[more], size[more]
                i, j = small_pairs(first, size)
                x, y = n[i].astype(np.int64), n[j].astype(np.int64)
                fits = (np.minimum(x, y) * den >= np.maximum(x, y) * num) | (np.maximum(x, y) == _SIZE_MOST)
                pairs.append(distinct_pairs(sets[i[fits]], sets[j[fits]]))
                yield from group_batches(sets, first[size > SMALL_GROUP], size[size > SMALL_GROUP], told)
            yield from pair_batches(pairs)

    return run


# --- the rest of large groups -------------------------------------------------


_REST = pa.schema([("a", pa.int64()), ("b", pa.int64())])
_FOREST = pa.schema([*_REST, ("gid", pa.int64()), ("size", pa.int64()), ("set", pa.int64())])
_FOREST_DDL = "a long, b long, gid long, size long, set long"


def rest_task(ratio: Ratio, forest: bool):
    """Open pairs of each block of a large group that no group before it lists; or
    spanning forests of the open pairs of blocks that are read together, then the
    members of each other pair in one of these."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, group in whole_groups(batches, ["gid", "p", "q"]):
            table = table.combine_chunks()
            n, comp, side, s = (table.column(c).to_numpy() for c in ("n", "comp", "side", "set"))
            order = np.lexsort((n, group))
            n, comp, side, s, group = n[order], comp[order], side[order], s[order], group[order]
            made = Sketches(table.column("sketch").take(pa.array(order)))
            open_ = lambda i, j: (comp[i] != comp[j]) & ((side[i] != side[j]) | (side[i] == 2))
            gid, left = table.column("gid").to_numpy()[order], np.zeros(len(s), bool)
            if forest:
                size = table.column("whole").to_numpy()[order]
            else:
                firsts = padded(table.column("firsts").take(pa.array(order)))
            for i, j, _ in near_pairs(group, n, made, ratio, open_):
                if forest:
                    kept = spanning_forest(i, j, comp)
                    other = unlisted(s[i], s[j], kept)
                    left[i[other]] = left[j[other]] = True
                else:
                    kept = np.flatnonzero(~share_earlier(firsts, gid, i, j))
                x, y = s[i[kept]], s[j[kept]]
                pairs = [pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y))]
                yield pa.RecordBatch.from_arrays(pairs + [pa.nulls(len(x), pa.int64())] * 3, schema=_FOREST) if forest else pa.RecordBatch.from_arrays(pairs, schema=_REST)
            if left.any():
                none = pa.nulls(int(left.sum()), pa.int64())
                yield pa.RecordBatch.from_arrays([none, none, pa.array(gid[left]), pa.array(size[left]), pa.array(s[left])], schema=_FOREST)

    return run


_NO_GROUP = np.iinfo(np.int64).max


def padded(lists: pa.Array) -> np.ndarray:
    """Lists of up to FIRST_GROUPS groups as rows of a table."""
    lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    sizes = lists.value_lengths().to_numpy(zero_copy_only=False)
    out = np.full((len(lists), FIRST_GROUPS), _NO_GROUP)
    out[np.arange(FIRST_GROUPS) < sizes[:, None]] = lists.flatten().to_numpy()
    return out


def share_earlier(firsts: np.ndarray, gid: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Which pairs of a group surely share a lesser one, which lists them.  The
    least group that two sets share is in the first ones of both if any shared one is."""
    out = np.zeros(len(i), bool)
    for k in range(0, len(i), FIRST_PAIRS):
        x, y = firsts[i[k : k + FIRST_PAIRS]], firsts[j[k : k + FIRST_PAIRS]]
        before = x < gid[i[k : k + FIRST_PAIRS]][:, None]
        out[k : k + FIRST_PAIRS] = ((x[:, :, None] == y[:, None, :]).any(2) & before).any(1)
    return out


def spanning_forest(a: np.ndarray, b: np.ndarray, comp: np.ndarray) -> np.ndarray:
    """Positions of those of the edges (a, b) that join components, hubs first."""
    degree = np.bincount(a, minlength=len(comp)) + np.bincount(b, minlength=len(comp))
    order = np.argsort(-np.maximum(degree[a], degree[b]), kind="stable")
    lo, hi = np.minimum(comp[a], comp[b])[order], np.maximum(comp[a], comp[b])[order]
    # of the edges between two components only the first one counts
    at = np.lexsort((np.arange(len(lo)), hi, lo))
    first = np.ones(len(at), bool)
    first[1:] = (lo[at][1:] != lo[at][:-1]) | (hi[at][1:] != hi[at][:-1])
    root: dict[int, int] = {}

    def find(c: int) -> int:
        while root.setdefault(c, c) != c:
            root[c] = root[root[c]]
            c = root[c]
        return c

    kept = []
    for k in np.sort(at[first]).tolist():
        x, y = find(int(lo[k])), find(int(hi[k]))
        if x != y:
            root[x] = y
            kept.append(order[k])
    return np.array(kept, np.int64)


def unlisted(a: np.ndarray, b: np.ndarray, kept: np.ndarray) -> np.ndarray:
    """Of the pairs (a, b), in either order, the first places of those that aren't
    equal to one of the ``kept``."""
    pairs, first, number = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], 1), axis=0, return_index=True, return_inverse=True)
    listed = np.zeros(len(pairs), bool)
    listed[number[kept]] = True
    return first[~listed]


def _rest(members: DataFrame, info: DataFrame, comps: DataFrame, ratio: Ratio, forest: bool) -> DataFrame:
    """Distinct possible pairs (a, b) across components inside the large groups with
    ``members`` (gid, size, set); or rows of their forests and what these leave."""
    known = members.join(comps, "set", "left").withColumn("comp", F.coalesce("comp", "set"))
    mixed = known.groupBy("gid").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.max("size").alias("size")).where("lo <> hi").select("gid", "size")
    rows = within(known, mixed).join(info.select("set", "n", "sketch"), "set")
    if forest:
        return blocks(rows.withColumn("whole", F.col("size"))).mapInArrow(rest_task(ratio, True), _FOREST_DDL)
    firsts = members.groupBy("set").agg(F.slice(F.array_sort(F.collect_set("gid")), 1, FIRST_GROUPS).alias("firsts"))
    return blocks(rows.join(firsts, "set")).mapInArrow(rest_task(ratio, False), "a long, b long").distinct()


def similar_documents(spark: SparkSession, docs: DataFrame, width: int = 5, ratio: Ratio = (3, 4), id_bits: int = 64) -> DataFrame:
    """doc_id, n_shingles, component_id of every row of ``docs`` (doc_id, text)."""
    check_ratio(ratio)
    tables, docs = Tables(spark, "ngram-join"), only(docs, "doc_id", "text")
    texts = docs.select("text")

    def write(identity: Identity) -> DataFrame:
        return tables.write(docs.mapInArrow(profile_task(width, identity), _PROFILE_DDL), f"profile-{len(identity.collided)}")

    profile, rows, identity = settled(write, id_bits)
    table = common_table(profile.where("shingle is not null"))
    rows = rows.select("doc_id", "n", "set", "sketch")
    info = tables.write(rows.where("n > 0").groupBy("set").agg(F.first("n").alias("n"), F.first("sketch", ignorenulls=True).alias("sketch"), F.min("doc_id").alias("first"), F.count("*").alias("copies")), "info")
    total = info.agg(F.sum("n")).first()[0] or 0
    buckets = max(1, int(total * 0.6 / BUCKET_POSTINGS))
    handle = spark.sparkContext.broadcast(table)
    postings = texts.mapInArrow(posting_task(width, ratio, handle, buckets, identity), "bucket int, signatures binary, sets binary, sizes binary, before binary")
    found = tables.write(postings.repartitionById(buckets, F.col("bucket")).sortWithinPartitions("bucket").mapInArrow(candidate_task(ratio), CANDIDATES_DDL), "candidates")
    verifier = Verifier(spark, tables, texts, info, width, ratio, identity)
    links = verifier.links(verifier.possible(first_pairs(found), "first"), "first")
    groups = tables.write(found.where("gid is not null").select("gid", "size", "members").distinct(), "groups")
    comps = components(spark, tables, "first", links)
    tables.drop("candidates", "first-possible")
    if groups.limit(1).count():
        members = groups.select("gid", "size", F.explode("members").alias("set"))
        named = tables.write(_rest(members, info, comps, ratio, True), "forest")
        forest = tables.write(named.where("a is not null").select("a", "b").distinct(), "forest-pairs")
        left = tables.write(named.where("set is not null").select("gid", "size", "set").distinct(), "left")
        tables.drop("forest", "groups")
        more = verifier.links(forest, "forest")
        comps = components(spark, tables, "second", links.union(more))
        rest = tables.write(_rest(left, info, comps, ratio, False).join(forest, ["a", "b"], "left_anti"), "rest")
        if rest.limit(1).count():
            last = verifier.links(rest, "rest")
            comps = components(spark, tables, "third", links.union(more).union(last))
        tables.drop("forest-pairs", "left", "rest")
    named = info.select("set", "first", "copies").join(comps, "set", "left").withColumn("comp", F.coalesce("comp", "set"))
    hot = hot_values(comps, "comp")
    lowest = named.groupBy("comp").agg(F.min("first").alias("component_id"))
    by_set = salted_join(named, lowest, "comp", hot, "set").select("set", "component_id")
    hot = hot_values(info, "set", "copies")
    filled = salted_join(rows.where("n > 0"), by_set, "set", hot, "doc_id").select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    return filled.union(rows.where("n = 0").select("doc_id", "n", F.col("doc_id").alias("component_id")))
