"""Word and shingle hashing over whole Arrow string columns with numpy.

Words are the runs of bytes between separators, so a text is never sliced into
Python strings.  A word is read in blocks of eight bytes; each block goes with
its place through a 64-bit finaliser, and so does their sum with the length.  No
hash is linear in the bytes, so texts made to cancel out don't collide.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401

#: Fixed odd multipliers for the words of a shingle.
_MIX = np.random.default_rng(20240229).integers(1, 1 << 63, 8, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_GOLDEN = np.uint64(0x9E3779B97F4A7C15)
#: Keep the first k bytes of a block, k = 0 to 8.
_KEEP = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)



# Bytes of words, by array: everything but space and U+0009 to U+000D, the
# separators of every word contract here; letters, digits and non-ASCII
# characters; everything but the space.
def not_space(raw: np.ndarray) -> np.ndarray:
    return (raw != 0x20) & (raw - np.uint8(9) > 4)


def alphanumeric(raw: np.ndarray) -> np.ndarray:
    return (raw >= 0x80) | (raw - np.uint8(48) < 10) | ((raw | np.uint8(0x20)) - np.uint8(97) < 26)


def not_blank(raw: np.ndarray) -> np.ndarray:
    return raw != 0x20


# Byte values: with A-Z folded onto a-z, and as they are.
def folded(raw: np.ndarray) -> np.ndarray:
    return raw | ((raw - np.uint8(65) < 26).view(np.uint8) << np.uint8(5))


def exact(raw: np.ndarray) -> np.ndarray:
    return raw


def finalise(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(33)
    return h


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts joined, and n + 1 offsets; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    n = len(column)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + n + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


class Words:
    """Words of a batch of texts: starts, ends (byte positions), hashes, and
    ``first``: n + 1 positions of each text's first word."""

    def __init__(self, raw: np.ndarray, offsets: np.ndarray, values=folded, in_word=not_space, hashes: bool = True):
        self.raw, self.offsets = raw, offsets
        n = len(raw)
        inside = np.zeros(n + 2, bool)
        inside[1 : n + 1] = in_word(raw)
        cuts = offsets[1:-1]
        cuts = cuts[(cuts > 0) & (cuts < n)]
        cuts = cuts[inside[cuts] & inside[cuts + 1]]  # no word spans two texts
        edges = np.flatnonzero(inside[1:] != inside[:-1])
        if len(cuts):
            cuts = cuts[np.concatenate([[True], cuts[1:] != cuts[:-1]])]
            edges = np.sort(np.concatenate([edges, cuts, cuts]), kind="stable")
        self.starts, self.ends = edges[::2], edges[1::2]
        self.first = np.searchsorted(self.starts, offsets)
        self.sizes = self.ends - self.starts
        if hashes:
            # eight bytes from any place on; the padding is for the last ones
            own = np.concatenate([values(raw), np.zeros(8, np.uint8)])
            blocks = np.ndarray(n + 1, np.dtype("<u8"), own, strides=(1,))
            self.heads = blocks[self.starts] & _KEEP[np.minimum(self.sizes, 8)]
            self._tails(blocks)
            self.hashes = finalise(finalise(self.heads + _GOLDEN) + self._tail[0] + self.sizes.astype(np.uint64) * _GOLDEN)

    def _tails(self, blocks: np.ndarray) -> None:
        """Two sums for each word over its blocks after the first."""
        self._tail = np.zeros((2, len(self.starts)), np.uint64)
        long = np.flatnonzero(self.sizes > 8)
        if not len(long):
            return
        more = (self.sizes[long] - 1) // 8
        first = np.cumsum(more) - more
        place = np.arange(first[-1] + more[-1]) - np.repeat(first, more) + 1
        rest = np.minimum(np.repeat(self.sizes[long], more) - 8 * place, 8)
        x = blocks[np.repeat(self.starts[long], more) + 8 * place] & _KEEP[rest]
        place = place.astype(np.uint64)
        for k, salt in enumerate((np.uint64(0x5851F42D4C957F2D), np.uint64(0xD6E8FEB86659FD93))):
            self._tail[k, long] = np.add.reduceat(finalise(x ^ finalise(place * salt)), first)

    @property
    def checks(self) -> np.ndarray:
        """Second hashes: with the size, a word of up to eight bytes itself."""
        return self.heads + self._tail[1]

    def prefixes(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the words' first ``size`` bytes (8 at most), and which words are so long."""
        return finalise((self.heads & _KEEP[size]) + np.uint64(size * int(_GOLDEN) % (1 << 64))), self.sizes >= size

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)


def shingles(words: Words, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each text's word shingles in order, and n + 1 offsets.

    A text with fewer words than ``width`` has its whole sequence as one
    shingle; a text without words has none.
    """
    h, first = words.hashes, words.first
    counts = np.diff(first)
    sizes = np.where(counts >= width, counts - width + 1, (counts > 0).astype(counts.dtype))
    offsets = np.concatenate([[0], np.cumsum(sizes)])
    padded = np.concatenate([h, np.zeros(width, np.uint64)])
    at = np.repeat(first[:-1] - offsets[:-1], sizes) + np.arange(offsets[-1])
    total = np.full(len(at), width * int(_GOLDEN) % (1 << 64), np.uint64)
    for j in range(width):
        total += padded[at + j] * _MIX[j]
    for i in np.flatnonzero((counts > 0) & (counts < width)):
        own = h[first[i] : first[i + 1]]
        total[offsets[i]] = (own * _MIX[: len(own)]).sum(dtype=np.uint64) ^ np.uint64(len(own) * 0x5851F42D4C957)
    return finalise(total), offsets


#: Segments up to so long are sorted as rows of one matrix.
_ROW_MOST = 512


def distinct_within(values: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct values of each segment, and the new offsets."""
    sizes = np.diff(offsets)
    out = values.copy()
    width = 2
    while width <= _ROW_MOST:
        own = np.flatnonzero((sizes > width // 2) & (sizes <= width))
        if len(own):
            at = offsets[own][:, None] + np.arange(width)[None, :]
            inside = np.arange(width)[None, :] < sizes[own][:, None]
            rows = np.where(inside, values[np.minimum(at, len(values) - 1)], np.uint64(0xFFFFFFFFFFFFFFFF))
            rows.sort(axis=1)
            out[at[inside]] = rows[inside]
        width *= 2
    for i in np.flatnonzero(sizes > _ROW_MOST).tolist():
        out[offsets[i] : offsets[i + 1]].sort()
    keep = np.ones(len(out), bool)
    np.not_equal(out[1:], out[:-1], out=keep[1:])
    keep[offsets[:-1][sizes > 0]] = True
    kept = np.concatenate([[0], np.cumsum(keep)])
    return out[keep], kept[offsets]


def trim() -> None:
    """Gives what a task has freed back to the system: workers outlive their tasks,
    and share the executor's memory with the JVM."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


#: How to drop what a task left in its worker for the next ones of its kind, by kind.
LEFT: dict[str, Callable[[], None]] = {}


def slices(batches, column: str = "text", most: int = 1 << 18, kind: str = ""):
    """Parts of record batches with about ``most`` bytes of text each (one text at least)."""
    for other in [k for k in LEFT if k != kind]:
        LEFT.pop(other)()
    for batch in batches:
        texts = batch.column(column)
        sizes = np.asarray(pa.compute.binary_length(texts).fill_null(0), np.int64)
        ends = np.cumsum(sizes)
        at = 0
        while at < len(sizes):
            before = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, before + most, "right")))
            yield batch.slice(at, to - at)
            at = to
    trim()
