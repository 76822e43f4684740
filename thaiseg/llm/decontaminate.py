"""Benchmark decontamination: passages of benchmark items in documents.

A document is contaminated by an item if some run of its words lies within a
word edit distance of ``floor(max_edits * words of the item)`` of the item.
Words are runs of letters, digits and other non-ASCII characters, A-Z folded.

1. *Windows.*  For every place where a document shares a short run of words
   with an item, the item-sized window that starts where the item would start.
   Runs have q words, the largest q up to 3 with L - q + 1 - q k >= 1: by the
   q-gram lemma every contaminated place shares at least one, so no window that
   matters is left out.
2. *CGK embedding.*  ``repeats`` random walks read a window: at step t they
   output the word they are at, and move on if a random bit of (t, word) says
   so (bits are hashes, so nothing is kept for each step).  Sequences at a small edit distance give walks that meet again, hence
   outputs at a small Hamming distance.
3. *Bit sampling.*  Each walk keeps ``samples`` of its outputs, at steps drawn
   once for each item length; the hash of these is its bucket.  Windows look
   their buckets up in the items' tables; more repeats raise recall.
4. *Verification.*  The least edit distance of the item to any run inside the
   window with k words more at either end, by dynamic programming.

Items are a stated query set against all documents.  They are broadcast in
blocks of about ITEMS_MOST items and WORDS_MOST words, one pass over the documents
each, so what is broadcast has a fixed bound (or is one item).  Windows are
looked at CELLS words at a time, however long items are or often a run recurs.

Defined results: null and empty texts and items (or those without words) match
nothing; repeated rows are each reported; rows without doc_id or item_id are
reported with null; empty tables give an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bytekernel import Words, alphanumeric, finalise, folded, slices, utf8
from .storage import only

ITEMS_MOST, WORDS_MOST = 20_000, 1 << 20
CELLS = 1 << 18
_PAD = np.uint64(0x1234567)


@dataclass(frozen=True)
class Search:
    max_edits: float = 0.2
    repeats: int = 48
    samples: int = 2
    seed: int = 11


def words_of(column: pa.Array) -> Words:
    return Words(*utf8(column), folded, alphanumeric)


def gram_width(length: int, edits: int) -> int:
    return next((q for q in (3, 2, 1) if length - q + 1 - q * edits >= 1), 1)


class Items:
    """A block of items: their words, run tables and bucket tables."""

    def __init__(self, ids: list, column: pa.Array, search: Search):
        self.search = search
        w = words_of(column)
        keep = np.flatnonzero(w.counts > 0)
        self.ids = [ids[i] for i in keep]
        self.words = [w.hashes[w.first[i] : w.first[i + 1]] for i in keep]
        self.lengths = np.array([len(x) for x in self.words], np.int64)
        self.edits = np.floor(self.lengths * search.max_edits + 1e-9).astype(np.int64)
        grams: dict[int, list] = {1: [], 2: [], 3: []}
        for i, x in enumerate(self.words):
            q = gram_width(len(x), int(self.edits[i]))
            grams[q] += [(g, i, o) for o, g in enumerate(runs(x, q).tolist())]
        self.grams = {}
        for q, rows in grams.items():
            if rows:
                rows.sort()
                key = np.array([r[0] for r in rows], np.uint64)
                self.grams[q] = (key, np.array([r[1] for r in rows]), np.array([r[2] for r in rows]))
        buckets = np.zeros((len(keep), search.repeats), np.uint64)
        order = np.argsort(self.lengths, kind="stable")
        for own in portions(order, self.lengths[order]):
            rows = np.full((len(own), int(self.lengths[own].max())), _PAD)
            for k, i in enumerate(own.tolist()):
                rows[k, : self.lengths[i]] = self.words[i]
            buckets[own] = self.buckets(rows, self.lengths[own])
        order = np.argsort(buckets.ravel(), kind="stable")
        self.bucket_keys, self.bucket_items = buckets.ravel()[order], np.repeat(np.arange(len(keep)), search.repeats)[order]

    def buckets(self, rows: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Bucket of every row (padded words) and walk."""
        n, walks = len(rows), self.search.repeats
        # which steps of 2 * length a walk keeps, by item length and walk
        tags = finalise(np.arange(walks, dtype=np.uint64) + lengths[:, None].astype(np.uint64) * np.uint64(1 << 20) + np.uint64(self.search.seed) * np.uint64(1 << 50))
        draws = [finalise(tags + np.uint64(j + 1)) for j in range(self.search.samples)]
        kept = [(d % (2 * lengths[:, None]).astype(np.uint64)).astype(np.int64) for d in draws]
        weights = [finalise(d) | np.uint64(1) for d in draws]
        at, sums = np.zeros((n, walks), np.int64), np.zeros((n, walks), np.uint64)
        padded = np.concatenate([rows, np.full((n, 1), _PAD)], 1)
        row = np.arange(n)[:, None]
        walk = np.arange(walks, dtype=np.uint64) * np.uint64(1 << 32)
        for t in range(2 * int(lengths.max())):
            y = padded[row, at]
            for k, w in zip(kept, weights):
                hit = np.nonzero(k == t)
                sums[hit] += y[hit] * w[hit]
            moves = ((y ^ finalise(walk + np.uint64(t + 1))) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(63)
            at = np.minimum(at + moves.astype(np.int64), lengths[:, None])
        return finalise(sums + tags)


def portions(order: np.ndarray, lengths: np.ndarray) -> Iterator[np.ndarray]:
    """Consecutive parts of ``order`` of CELLS words at most, at their (ascending)
    greatest length, and one row at least."""
    at = 0
    while at < len(order):
        to = at + 1
        step = max(1, CELLS // max(1, int(lengths[at])))
        fits = np.flatnonzero(lengths[at : at + step] * np.arange(1, len(lengths[at : at + step]) + 1) <= CELLS)
        to = at + (int(fits[-1]) + 1 if len(fits) else 1)
        yield order[at:to]
        at = to


def runs(h: np.ndarray, q: int) -> np.ndarray:
    out = np.zeros(max(0, len(h) - q + 1), np.uint64)
    for j in range(q):
        out = out * np.uint64(0xD6E8FEB86659FD93) + h[j : j + len(out)]
    return finalise(out + np.uint64(q))


def least_distance(item: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row the least edit distance of the item to a run of the row's
    words, and where the first such run ends.  Sellers' algorithm on all rows."""
    n, width = rows.shape
    m = len(item)
    now = np.repeat(np.arange(m + 1)[None, :], n, 0)
    best, end = now[:, m].copy(), np.zeros(n, np.int64)
    steps = np.arange(m + 1)
    for j in range(width):
        cost = (item[None, :] != rows[:, j : j + 1]).astype(np.int64)
        new = np.zeros_like(now)
        new[:, 1:] = np.minimum(now[:, :-1] + cost, now[:, 1:] + 1)
        # insertions along the item: a running minimum of new - steps
        now = np.minimum.accumulate(new - steps, 1) + steps
        better = now[:, m] < best
        best[better], end[better] = now[better, m], j + 1
    return best, end


_HITS = pa.schema([("doc_id", pa.int64()), ("item", pa.int64()), ("distance", pa.int64()), ("end_word", pa.int64())])


def found_in(items: Items, texts: pa.Array) -> dict[tuple[int, int], tuple[int, int]]:
    """(text, item) -> (distance, end word) of the matches in a column of texts."""
    w = words_of(texts)
    owner = np.repeat(np.arange(len(texts)), w.counts)
    windows = [np.zeros((0, 3), np.int64)]
    for q, (keys, of, offset) in items.grams.items():
        grams = runs(w.hashes, q)
        at = np.searchsorted(keys, grams)
        at[at == len(keys)] = 0
        hit = np.flatnonzero((keys[at] == grams) & (owner[: len(grams)] == owner[q - 1 :])) if len(grams) else np.zeros(0, np.int64)
        lo, hi = np.searchsorted(keys, grams[hit]), np.searchsorted(keys, grams[hit], "right")
        ends = np.cumsum(hi - lo)
        done = 0
        while done < len(hit):
            to = max(done + 1, int(np.searchsorted(ends, (ends[done - 1] if done else 0) + CELLS, "right")))
            many = np.repeat(hit[done:to], (hi - lo)[done:to])
            place = np.repeat(lo[done:to] - (ends - (hi - lo))[done:to], (hi - lo)[done:to]) + np.arange(len(many)) + (ends[done - 1] if done else 0)
            windows.append(np.unique(np.stack([items.lengths[of[place]], owner[many], many - offset[place]], 1), axis=0))
            done = to
    windows = np.unique(np.concatenate(windows), axis=0)
    found: dict[tuple[int, int], tuple[int, int]] = {}
    for part in portions(np.arange(len(windows)), windows[:, 0]):
        _search(items, w, windows[part], found)
    return found


def search_task(handle):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items: Items = handle.value
        for batch in slices(batches, most=1 << 19) if len(items.lengths) else ():
            rows = sorted(found_in(items, batch.column("text")).items())
            if rows:
                ids = batch.column("doc_id").take(pa.array([d for (d, _), _ in rows])).cast(pa.int64())
                yield pa.RecordBatch.from_arrays([ids, pa.array([i for (_, i), _ in rows]), pa.array([v[0] for _, v in rows]), pa.array([v[1] for _, v in rows])], schema=_HITS)

    return run


def clean_task(handle):
    """The rows in which nothing is found, with all their columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items: Items = handle.value
        for batch in slices(batches, most=1 << 19):
            keep = np.ones(len(batch), bool)
            if len(items.lengths):
                keep[[d for d, _ in found_in(items, batch.column("text"))]] = False
            yield batch.filter(pa.array(keep))

    return run


def _gather(w: Words, docs: np.ndarray, starts: np.ndarray, width: int, lengths: np.ndarray) -> np.ndarray:
    at = starts[:, None] + np.arange(width)[None, :]
    inside = (at >= w.first[docs][:, None]) & (at < w.first[docs + 1][:, None]) & (np.arange(width)[None, :] < lengths[:, None])
    return np.where(inside, w.hashes[np.clip(at, 0, len(w.hashes) - 1)], _PAD)


def _search(items: Items, w: Words, windows: np.ndarray, found: dict) -> None:
    lengths, docs, starts = windows.T
    buckets = items.buckets(_gather(w, docs, starts, int(lengths.max()), lengths), lengths)
    lo, hi = np.searchsorted(items.bucket_keys, buckets.ravel()), np.searchsorted(items.bucket_keys, buckets.ravel(), "right")
    hit = np.flatnonzero(hi > lo)
    pairs = {(int(b) // items.search.repeats, int(i)) for b in hit for i in items.bucket_items[lo[b] : hi[b]]}
    by_item: dict[int, list[int]] = {}
    for window, item in pairs:
        by_item.setdefault(item, []).append(window)
    for item, own in ((i, part) for i, own in by_item.items() for part in portions(np.array(sorted(own)), np.full(len(own), 2 * items.lengths[i]))):
        k, m = int(items.edits[item]), int(items.lengths[item])
        rows = _gather(w, docs[own], starts[own] - k, m + 2 * k, np.full(len(own), m + 2 * k))
        best, end = least_distance(items.words[item], rows)
        for j in np.flatnonzero(best <= k).tolist():
            d = int(docs[own[j]])
            value = (int(best[j]), int(starts[own[j]] - k + end[j] - w.first[d]))
            found[d, item] = min(found.get((d, item), value), value)


def blocks_of(spark: SparkSession, benchmark: DataFrame, search: Search):
    """The items in blocks of bounded size, each broadcast."""
    items = only(benchmark, "item_id", "text").where("text is not null")
    counts = items.agg(F.count("*").alias("n"), F.sum(F.regexp_count("text", F.lit("[0-9A-Za-z\\x{80}-\\x{10FFFF}]+"))).alias("words")).first()
    n = max(-(-counts.n // ITEMS_MOST), -(-(counts.words or 0) // WORDS_MOST))
    for k in range(max(1, n)):
        block = items if n <= 1 else items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k)
        rows = block.toPandas()  # about ITEMS_MOST rows
        made = Items([None if x is None else int(x) for x in rows.item_id.astype(object).where(rows.item_id.notna(), None)], pa.array(rows.text.tolist(), pa.string()), search)
        yield made, spark.sparkContext.broadcast(made)


def contaminations(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, search: Search = Search()) -> DataFrame:
    """doc_id, item_id, distance, end_word: each (document, item) that matches, at
    its best place (end_word: words of the document up to the passage's end)."""
    out = None
    for items, handle in blocks_of(spark, benchmark, search):
        hits = only(docs, "doc_id", "text").mapInArrow(search_task(handle), "doc_id long, item long, distance long, end_word long")
        names = spark.createDataFrame(list(enumerate(items.ids)), "item long, item_id long")
        part = hits.join(F.broadcast(names), "item").select("doc_id", "item_id", "distance", "end_word")
        out = part if out is None else out.union(part)
    return out


def without_contaminated(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, search: Search = Search()) -> DataFrame:
    """The rows of ``docs`` in which no item is found, in one pass for each block of items."""
    for _, handle in blocks_of(spark, benchmark, search):
        docs = docs.mapInArrow(clean_task(handle), docs.schema)
    return docs
