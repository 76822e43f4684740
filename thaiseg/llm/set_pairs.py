"""Sets of shingles, parity sketches and exact verification: what the set
similarity joins over texts and over lines share.

A set's identity is 128 bits: ``set`` is a 64-bit hash and, where two sets have
the same one but unlike second hashes (``checks``), both get new ids of both
hashes (``Identity``).  Pairs of sets are verified on the whole sets.

A parity sketch holds the parities of the counts of elements in slots.  Bits
that differ can't outnumber the elements that differ, so a pair whose sketches
are too far apart is no link.  A longer sketch folds onto a shorter one.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bytekernel import Words, distinct_within, finalise, shingles, slices, trim, utf8
from .storage import Tables

#: A shingle of at least so many sets of a task's counts is common; the table
#: of common ones has a fixed bound.  It only orders partitions and tokens.
COMMON_MIN, COMMON_MOST = 12, 1 << 17
#: Groups of more sets than SMALL_GROUP don't list their pairs; those of more
#: than BLOCK are cut into blocks.
SMALL_GROUP, BLOCK = 6, 2048
FLUSH, BUCKET_POSTINGS = 1 << 20, 3 << 19
#: Postings of a bucket that are sorted together, in so many parts at most.
PART_POSTINGS, PARTS_MOST = 1 << 18, 64
#: Postings that a task holds before it sends them.
HELD = 1 << 18
SEEN_MOST = 1 << 18
BITMAP_BITS = 1 << 23
#: Rows and pairs that are looked at together.
ROWS, PAIRS, WORDS = 1 << 14, 1 << 18, 1 << 20
#: Of sets that share one 64-bit hash, so many hashes at most: expected are
#: n**2 / 2**65, so 300 for 10**11 sets.
COLLIDED_MOST = 1 << 16

Ratio = tuple[int, int]


def check_ratio(ratio: Ratio) -> None:
    if not 0 < ratio[1] <= 2 * ratio[0] <= 2 * ratio[1]:
        raise ValueError(f"the similarity {ratio[0]}/{ratio[1]} is not between 1/2 and 1")


# --- sets ---------------------------------------------------------------------


class Identity:
    """Ids of sets.  ``bits`` below 64 is for tests of collisions."""

    def __init__(self, collided: list[int], bits: int = 64):
        self.collided, self.bits = np.array(sorted(collided), np.int64), bits

    def ids(self, elements: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids and second hashes."""
        sets, checks = (_set_hashes(elements, offsets, salt) for salt in (0x5851F42D4C957F2D, 0xD6E8FEB86659FD93))
        if self.bits < 64:
            sets &= (1 << self.bits) - 1
        if len(self.collided):
            again = np.isin(sets, self.collided)
            sets[again] = finalise(finalise(sets[again].view(np.uint64)) + checks[again].view(np.uint64)).view(np.int64)
        return sets, checks


def _set_hashes(elements: np.ndarray, offsets: np.ndarray, salt: int) -> np.ndarray:
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(finalise(elements ^ np.uint64(salt)), dtype=np.uint64)])
    return finalise(sums[offsets[1:]] - sums[offsets[:-1]] + np.diff(offsets).astype(np.uint64)).view(np.int64)


def sets_of(column: pa.Array, width: int, units=utf8) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingles of all units (texts, unless ``units`` cuts the
    column's bytes otherwise), and n + 1 offsets."""
    return distinct_within(*shingles(Words(*units(column)), width))


def settled(write: Callable[[Identity], DataFrame], bits: int) -> tuple[DataFrame, DataFrame, Identity]:
    """``write`` gives a written table with set and checks (null: no row of a set).
    Writes it again, in the rare case that sets collide: (table, sets, identity)."""
    known: list[int] = []
    while True:
        identity = Identity(known, bits)
        table = write(identity)
        rows = table.where("set is not null")
        both = rows.groupBy("set").agg(F.min("check").alias("lo"), F.max("check").alias("hi")).where("lo <> hi").select("set")
        found = [r.set for r in both.limit(COLLIDED_MOST + 1).collect()]
        if not found:
            return table, rows, identity
        if len(found) > COLLIDED_MOST or set(found) & set(known):
            raise ValueError("too many sets have equal hashes")
        known += found


class Seen:
    """Whether a set came before in this task; forgets when it is full."""

    def __init__(self):
        self.known: set[int] = set()

    def new(self, keys: np.ndarray) -> np.ndarray:
        """Which of the keys are new."""
        out = np.zeros(len(keys), bool)
        for i, key in enumerate(keys.tolist()):
            if key not in self.known:
                if len(self.known) >= SEEN_MOST:
                    self.known.clear()
                self.known.add(key)
                out[i] = True
        return out


def picked(values: np.ndarray, offsets: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The segments for which ``which`` is true."""
    sizes = np.diff(offsets)
    return values[np.repeat(which, sizes)], np.concatenate([[0], np.cumsum(sizes[which])])


class Recurring:
    """Counts of the commonest values of many sets, in bounded memory."""

    def __init__(self):
        self.keys, self.counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.pending, self.held = [], 0

    def add(self, values: np.ndarray) -> None:
        self.pending.append(values)
        self.held += len(values)
        if self.held > FLUSH:
            self._merge()

    def _merge(self) -> None:
        if not self.pending:
            return
        new = np.concatenate(self.pending)
        new.sort()
        first = np.flatnonzero(np.concatenate([[True], new[1:] != new[:-1]])) if len(new) else np.zeros(0, np.int64)
        n = np.diff(np.concatenate([first, [len(new)]]))
        new, n = new[first[n > 1]], n[n > 1]
        both, at = np.unique(np.concatenate([self.keys, new]), return_inverse=True)
        total = np.bincount(at, np.concatenate([self.counts, n]), len(both)).astype(np.int64)
        if len(both) > 2 * COMMON_MOST:
            top = np.sort(np.argpartition(-total, 2 * COMMON_MOST)[: 2 * COMMON_MOST])
            both, total = both[top], total[top]
        self.keys, self.counts, self.pending, self.held = both, total, [], 0

    def counted(self, least: int = 3) -> tuple[np.ndarray, np.ndarray]:
        self._merge()
        return self.keys[self.counts >= least], self.counts[self.counts >= least]


class Common:
    """The table of common shingles: ranks by ascending count."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray):
        order = np.lexsort((keys, counts))
        at = np.argsort(keys[order])
        self.keys, self.ranks = keys[order][at], at
        self.slots = np.zeros(1 << 22, bool)
        self.slots[self._slot(keys)] = True

    @staticmethod
    def _slot(values: np.ndarray) -> np.ndarray:
        return (values & np.uint64((1 << 22) - 1)).astype(np.int64)

    def rank(self, values: np.ndarray) -> np.ndarray:
        """-1 for what isn't common."""
        out = np.full(len(values), -1)
        if len(self.keys):
            may = np.flatnonzero(self.slots[self._slot(values)])
            at = np.minimum(np.searchsorted(self.keys, values[may]), len(self.keys) - 1)
            hit = self.keys[at] == values[may]
            out[may[hit]] = self.ranks[at[hit]]
        return out


def common_table(counts: DataFrame) -> Common:
    """Of rows (shingle, times) with partial counts."""
    total = counts.groupBy("shingle").agg(F.sum("times").alias("times")).where(F.col("times") >= COMMON_MIN)
    rows = total.orderBy(F.desc("times"), "shingle").limit(COMMON_MOST).toPandas()
    return Common(rows.shingle.to_numpy(np.int64).view(np.uint64), rows.times.to_numpy(np.int64))


def rarest(elements: np.ndarray, offsets: np.ndarray, ranks: np.ndarray, most: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first ``most`` elements of every set, in order of rarity: those that
    aren't common by hash, then the common ones by rank; and their owners."""
    sizes = np.diff(offsets)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    mixed = np.zeros(len(sizes), bool)
    mixed[owner[ranks >= 0]] = True
    at = np.flatnonzero(mixed[owner])
    order = np.arange(len(elements))
    order[at] = at[np.lexsort((ranks[at], owner[at]))]
    place = np.arange(len(elements)) - np.repeat(offsets[:-1], sizes)
    kept = place < np.repeat(most, sizes)
    return elements[order[kept]], owner[kept]


# --- sketches -----------------------------------------------------------------


def sketches(elements: np.ndarray, offsets: np.ndarray, which: np.ndarray, least: int) -> pa.Array:
    """Parity sketches of ``least`` bits, or as many as elements if these are more."""
    sizes, out = np.diff(offsets), [None] * (len(offsets) - 1)
    for k in range(0, len(out), 1 << 13):
        own = k + np.flatnonzero((which & (sizes <= least))[k : k + (1 << 13)])
        if not len(own):
            continue
        mask = np.zeros(len(out), bool)
        mask[own] = True
        values, at = picked(elements, offsets, mask)
        slot = np.repeat(np.arange(len(own)) * least, np.diff(at)) + (values & np.uint64(least - 1)).astype(np.int64)
        odd = (np.bincount(slot, minlength=len(own) * least) & 1).astype(np.uint8)
        flat, step = np.packbits(odd).tobytes(), least // 8
        for j, i in enumerate(own.tolist()):
            out[i] = flat[j * step : (j + 1) * step]
    for i in np.flatnonzero(which & (sizes > least)).tolist():
        own = elements[offsets[i] : offsets[i + 1]]
        bits = 1 << (len(own) - 1).bit_length()
        odd = np.bincount((own & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
        out[i] = np.packbits(odd.astype(np.uint8)).tobytes()
    return pa.array(out, pa.binary())


class Sketches:
    def __init__(self, *columns: pa.Array):
        """All sketches of the columns, one after the other."""
        flat, sizes = [], []
        for column in columns:
            column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
            column = column.cast(pa.large_binary())
            offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
            data = column.buffers()[2]
            flat.append(np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8))
            sizes.append(np.diff(offsets))
        self.flat = np.concatenate(flat).view(np.uint64)
        self.sizes = np.concatenate(sizes) // 8
        self.starts = np.cumsum(self.sizes) - self.sizes

    def apart(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """In how many bits each pair's sketches differ."""
        out = np.zeros(len(i), np.int64)
        kinds = self.sizes[i] * (1 << 32) + self.sizes[j]
        for kind in np.unique(kinds).tolist():
            own = np.flatnonzero(kinds == kind)
            a, b = kind >> 32, kind & ((1 << 32) - 1)
            step, least = max(1, WORDS // max(a, b)), min(a, b)
            for k in range(0, len(own), step):
                part = own[k : k + step]
                x, y = (self._rows(z[part], size, least) for z, size in ((i, a), (j, b)))
                out[part] = np.bitwise_count(x ^ y).sum(1, dtype=np.int64)
        return out

    def _rows(self, at: np.ndarray, size: int, least: int) -> np.ndarray:
        rows = self.flat[self.starts[at][:, None] + np.arange(size)]
        return rows if size == least else np.bitwise_xor.reduce(rows.reshape(len(at), size // least, least), axis=1)

    def possible(self, i: np.ndarray, j: np.ndarray, ni: np.ndarray, nj: np.ndarray, ratio: Ratio) -> tuple[np.ndarray, np.ndarray]:
        """Which pairs the sketches leave possible, and their distances."""
        apart = self.apart(i, j)
        return apart <= (ni + nj) * (ratio[1] - ratio[0]) // (ratio[1] + ratio[0]), apart


def near_pairs(group: np.ndarray, n: np.ndarray, made: Sketches, ratio: Ratio, wanted: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Pairs i < j of one group that are wanted and possible, with the distances
    of their sketches.  Rows are sorted by group and size."""
    key = group * (1 << 32) + n
    hi = np.searchsorted(key, group * (1 << 32) + n * ratio[1] // ratio[0], "right")
    counts = hi - np.arange(len(n)) - 1
    ends = np.cumsum(counts)
    at = 0
    while at < len(n):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PAIRS, "right")))
        own = counts[at:to]
        i = np.repeat(np.arange(at, to), own)
        j = i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(own) - own, own)
        at = to
        keep = wanted(i, j)
        i, j = i[keep], j[keep]
        if len(i):
            good, apart = made.possible(i, j, n[i], n[j], ratio)
            if good.any():
                yield i[good], j[good], apart[good]


def whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str], rows: int = ROWS) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of whole groups of a partition sorted by ``keys``, and group numbers."""
    held: list[pa.RecordBatch] = []

    def numbered(table: pa.Table) -> np.ndarray:
        new = np.zeros(len(table), bool)
        for k in keys:
            x = table.column(k).to_numpy()
            new[1:] |= x[1:] != x[:-1]
        return np.cumsum(new)

    for batch in batches:
        if len(batch):
            held.append(batch)
        if sum(map(len, held)) >= rows:
            table = pa.Table.from_batches(held)
            numbers = numbered(table)
            last = int(np.searchsorted(numbers, numbers[-1]))
            if last:
                yield table.slice(0, last), numbers[:last]
            held = table.slice(last).to_batches()
    if held:
        table = pa.Table.from_batches(held)
        yield table, numbered(table)
    trim()


# --- candidates ---------------------------------------------------------------

CANDIDATES = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("gid", pa.int64()), ("size", pa.int64()), ("members", pa.list_(pa.int64()))])
CANDIDATES_DDL = "a long, b long, gid long, size long, members array<long>"


def distinct_pairs(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct pairs, the lesser set first."""
    a, b = np.minimum(a, b), np.maximum(a, b)
    order = np.lexsort((b, a))
    a, b = a[order], b[order]
    keep = np.ones(len(a), bool)
    keep[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    return a[keep], b[keep]


def pair_batches(pairs: list[tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
    """The distinct ones of all these pairs."""
    if not pairs:
        return
    a, b = distinct_pairs(*(np.concatenate(x) for x in zip(*pairs)))
    for k in range(0, len(a), 1 << 16):
        n = len(a[k : k + (1 << 16)])
        yield pa.RecordBatch.from_arrays([pa.array(a[k : k + n]), pa.array(b[k : k + n]), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.list_(pa.int64()))], schema=CANDIDATES)


def group_batches(sets: np.ndarray, first: np.ndarray, size: np.ndarray, told: set[int]) -> Iterator[pa.RecordBatch]:
    """Large groups, as rows of up to BLOCK members, with the first one as ``a``;
    equal groups once, and none that was ``told`` before."""
    gids = []
    for f, n in zip(first.tolist(), size.tolist()):
        gids.append(int(finalise(sets[f : f + n].view(np.uint64)).sum(dtype=np.uint64).view(np.int64)))
    for f, n, gid in zip(first.tolist(), size.tolist(), gids):
        if gid in told:
            continue
        told.add(gid)
        cuts = np.append(np.arange(0, n, BLOCK), n).astype(np.int32)
        members = pa.ListArray.from_arrays(pa.array(cuts), pa.array(sets[f : f + n]))
        k = len(members)
        yield pa.RecordBatch.from_arrays([pa.array([int(sets[f])] * k), pa.nulls(k, pa.int64()), pa.array([gid] * k), pa.array([n] * k), members], schema=CANDIDATES)


def small_pairs(first: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of all pairs of the small groups."""
    i, j = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for n in range(2, SMALL_GROUP + 1):
        own = first[size == n]
        for x in range(n):
            for y in range(x + 1, n):
                i.append(own + x)
                j.append(own + y)
    return np.concatenate(i), np.concatenate(j)


def first_pairs(found: DataFrame) -> DataFrame:
    """Distinct pairs (a, b): those listed, and of large groups those with the first member."""
    stars = found.where("gid is not null").select("a", F.explode("members").alias("b")).where("a <> b")
    return found.where("b is not null").select("a", "b").union(stars.select(F.least("a", "b"), F.greatest("a", "b"))).distinct()


def uncovered(before: np.ndarray, first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Which groups have members with unlike signatures before this one.  Where all
    have the same, they share that one too, and its group has all their pairs."""
    if not len(first):
        return np.zeros(0, bool)
    own = before[np.repeat(first - (np.cumsum(size) - size), size) + np.arange(size.sum())]
    at = np.cumsum(size) - size
    return (np.minimum.reduceat(own, at) != np.maximum.reduceat(own, at)) | (own[at] == 0)


def packed_postings(columns: list[np.ndarray], signatures: np.ndarray, buckets: int, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Postings as a row for each bucket: the low halves of the signatures and the
    columns, as packed arrays."""
    bucket = ((signatures >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)
    order = np.argsort(bucket, kind="stable")
    bucket = bucket[order]
    columns = [signatures[order].astype(np.uint32), *(c[order] for c in columns)]
    cuts = np.concatenate([[0], np.flatnonzero(bucket[1:] != bucket[:-1]) + 1, [len(bucket)]])
    for k in range(0, len(cuts) - 1, 64):
        part = range(k, min(k + 64, len(cuts) - 1))
        blobs = [pa.array([c[cuts[j] : cuts[j + 1]].tobytes() for j in part], pa.binary()) for c in columns]
        yield pa.RecordBatch.from_arrays([pa.array([int(bucket[cuts[j]]) for j in part], pa.int32()), *blobs], schema=schema)


def by_bucket(batches: Iterator[pa.RecordBatch], kinds: list) -> Iterator[Iterator[list[np.ndarray]]]:
    """The unpacked columns of each bucket, in parts by ranges of its signatures,
    the input being sorted by bucket; rows of one signature stand together in order
    of the second column, once each."""
    now, held = None, []

    def parts() -> Iterator[list[np.ndarray]]:
        n = min(PARTS_MOST, -(-sum(len(x[0]) for x in held) // PART_POSTINGS))
        part = [((x[0] >> np.uint32(16)) * np.uint32(n) >> np.uint32(16)).astype(np.uint8) for x in held]
        for k in range(n):
            own = [np.flatnonzero(p == k) for p in part]
            columns = [np.concatenate([c[at] for c, at in zip(x, own)]) for x in zip(*held)]
            order = np.lexsort((columns[1], columns[0]))
            same = (columns[0][order][1:] == columns[0][order][:-1]) & (columns[1][order][1:] == columns[1][order][:-1])
            order = order[np.concatenate([[True], ~same])[: len(order)]]
            if len(order):
                yield [c[order] for c in columns]
        held.clear()

    for batch in batches:
        for row in zip(batch.column(0).to_pylist(), *(batch.column(k) for k in range(1, batch.num_columns))):
            if row[0] != now and held:
                yield parts()
            now = row[0]
            held.append([np.frombuffer(x.as_buffer(), kind) for x, kind in zip(row[1:], kinds)])
    if held:
        yield parts()
    trim()


def groups_of(signatures: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First places and sizes of the runs of more than one."""
    first = np.flatnonzero(np.concatenate([[True], signatures[1:] != signatures[:-1]]))
    size = np.diff(np.concatenate([first, [len(signatures)]]))
    return first[size > 1], size[size > 1]


#: A group in a join is copied once for each SALTED_BY members, SALTS_MOST times at most.
SALTED_BY, SALTS_MOST = 128, 16


def within(members: DataFrame, groups: DataFrame) -> DataFrame:
    """The members (gid, size, set, ...) whose gid is in ``groups`` (gid, size), with
    large groups salted.  Spark's guess of the size leaves the copies out, so that it
    would broadcast more than the driver holds."""
    salts = F.least(F.lit(SALTS_MOST).cast("long"), 1 + F.floor(F.col("size") / SALTED_BY))
    copied = groups.select("gid", F.explode(F.sequence(F.lit(0).cast("long"), salts - 1)).alias("salt"))
    return members.withColumn("salt", F.pmod("set", salts)).join(copied.hint("merge"), ["gid", "salt"]).drop("salt")


def blocks(members: DataFrame) -> DataFrame:
    """Members (gid, size, set, ...) of large groups, once for each pair (p, q) of
    blocks with theirs; side: 0 or 1, or 2 where p = q."""
    n = F.ceil(F.col("size") / BLOCK).cast("int")
    own = F.pmod(F.xxhash64("set"), n).cast("int")
    rows = members.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), n - 1)))
    side = F.when(F.col("own") == F.col("other"), 2).otherwise((F.col("own") > F.col("other")).cast("int"))
    rows = rows.withColumn("p", F.least("own", "other")).withColumn("q", F.greatest("own", "other")).withColumn("side", side).drop("own", "other", "size")
    return rows.repartition("gid", "p", "q").sortWithinPartitions("gid", "p", "q")


# --- verification -------------------------------------------------------------

_ELEMENTS = pa.schema([("set", pa.int64()), ("elements", pa.binary())])


def element_task(width: int, identity: Identity, wanted, units=utf8):
    """Whole sets of the units whose set's bit is on in a bitmap of fixed size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, seen = wanted.value, Seen()
        for batch in slices(batches):
            elements, offsets = sets_of(batch.column("text"), width, units)
            sets, _ = identity.ids(elements, offsets)
            slot = sets & (BITMAP_BITS - 1)
            hit = np.flatnonzero((((bits[slot >> 6] >> (slot & 63).astype(np.uint64)) & np.uint64(1)) == 1) & (offsets[1:] > offsets[:-1]))
            hit = hit[seen.new(sets[hit])]
            if len(hit):
                which = np.zeros(len(sets), bool)
                which[hit] = True
                values, at = picked(elements, offsets, which)
                packed = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(hit), [None, pa.py_buffer(at.astype(np.int64) * 8), pa.py_buffer(values)])
                yield pa.RecordBatch.from_arrays([pa.array(sets[hit]), packed.cast(pa.binary())], schema=_ELEMENTS)

    return run


def verify_task(ratio: Ratio):
    num, den = ratio

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for x, y in zip(batch.column(2), batch.column(3)):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                z = np.concatenate([x, y])
                z.sort()
                both = int(np.count_nonzero(z[1:] == z[:-1]))
                good.append(den * both >= num * (len(z) - both))
            yield batch.select([0, 1]).filter(pa.array(good, pa.bool_()))
        trim()

    return run


def possible_task(ratio: Ratio):
    num, den = ratio

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            na, nb = batch.column("na").to_numpy(), batch.column("nb").to_numpy()
            fits = np.flatnonzero(np.minimum(na, nb) * den >= np.maximum(na, nb) * num)
            if len(fits):
                part = batch.take(pa.array(fits))
                at = np.arange(len(fits))
                good, _ = Sketches(part.column("sa"), part.column("sb")).possible(at, at + len(fits), na[fits], nb[fits], ratio)
                yield part.select(["a", "b"]).filter(pa.array(good))

    return run


class Verifier:
    """Verifies pairs of sets of ``texts``; ``info`` has set, n and sketch."""

    def __init__(self, spark: SparkSession, tables: Tables, texts: DataFrame, info: DataFrame, width: int, ratio: Ratio, identity: Identity, units=utf8):
        self.spark, self.tables, self.texts, self.info = spark, tables, texts, info.select("set", "n", "sketch")
        self.width, self.ratio, self.identity, self.units = width, ratio, identity, units

        self.prepared: DataFrame | None = None

    def _elements(self, wanted: DataFrame) -> DataFrame:
        """The sets of column s.  The bitmap has a fixed size, whatever the input."""
        slot = f"(s & {BITMAP_BITS - 1})"
        words = wanted.selectExpr(f"shiftright({slot}, 6) AS w", f"shiftleft(1L, CAST({slot} & 63 AS INT)) AS v")
        found = words.groupBy("w").agg(F.bit_or("v").alias("v")).toPandas()
        bits = np.zeros(BITMAP_BITS // 64, np.uint64)
        bits[found.w.to_numpy(np.int64)] = found.v.to_numpy(np.int64).view(np.uint64)
        handle = self.spark.sparkContext.broadcast(bits)
        made = self.texts.mapInArrow(element_task(self.width, self.identity, handle, self.units), "set long, elements binary")
        return made.groupBy("set").agg(F.first("elements").alias("elements"))

    def possible(self, pairs: DataFrame, name: str) -> DataFrame:
        """The pairs that sizes and sketches leave possible, as a written table."""
        sketched = pairs.join(self.info.toDF("a", "na", "sa"), "a").join(self.info.toDF("b", "nb", "sb"), "b")
        return self.tables.write(sketched.select("a", "b", "na", "nb", "sa", "sb").mapInArrow(possible_task(self.ratio), "a long, b long"), f"{name}-possible")

    def prepare(self, pairs: DataFrame, groups: DataFrame) -> None:
        """Reads the sets of pairs and large groups once, for all calls of ``links``."""
        members = groups.select(F.explode("members").alias("s"))
        self.prepared = self.tables.write(self._elements(pairs.select(F.explode(F.array("a", "b")).alias("s")).union(members)), "elements")

    def links(self, pairs: DataFrame, name: str) -> DataFrame:
        """Of possible pairs those that reach the threshold, as a written table."""
        elements = self.prepared
        if elements is None:
            elements = self.tables.write(self._elements(pairs.select(F.explode(F.array("a", "b")).alias("s"))), f"{name}-elements")
        both = pairs.join(elements.toDF("a", "ea"), "a").join(elements.toDF("b", "eb"), "b").select("a", "b", "ea", "eb")
        out = self.tables.write(both.mapInArrow(verify_task(self.ratio), "a long, b long"), f"{name}-links")
        if self.prepared is None:
            self.tables.drop(f"{name}-elements")
        return out
