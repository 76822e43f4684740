"""Token-ID output as length-delimited binary records with an offset index.

A shard ``NNNNN.rec`` is a run of records; all integers are little-endian:

    uint64  length of the payload
    uint32  masked CRC-32 of those eight bytes
    bytes   payload: int64 doc_id, uint8 flags, ids
    uint32  masked CRC-32 of the payload

flags: 1 if the ids are uint16, 2 if they are uint32; plus 4 if doc_id is null.
The mask rotates a checksum right by 15 bits and adds 0xA282EAD8, so that data
which holds checksums gets a different one.  ``NNNNN.idx`` holds, for each
record, uint64 offset and uint64 number of ids: a reader that wants a shuffled
order seeks to any record without reading the shard.

Texts are cut into shards by ranges of doc_id and written in ascending order.
Each task writes under a name of its own and renames at the end, so a repeated
or speculative attempt leaves whole files only.

Encoding: byte-level BPE never merges across a single space that a non-space
follows, so a text is the concatenation of its space-led pieces, and each
distinct piece is encoded by the tokenizers library once for a worker (the memo
is bounded in pieces and in ids, finds a piece by two hashes and its length, and
goes when the worker turns to texts of another operator).  Texts in which a space is followed by white space or by nothing go
through the library whole.

Defined results: null and empty texts give just the end id; null doc_ids come
first; rows with equal doc_id are ordered by text; an empty table writes no
shard; other columns are ignored.  Strings of special tokens are ordinary text.
"""

from __future__ import annotations

import posixpath
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import new_folder
from .bytekernel import LEFT, Words, exact, not_blank, slices, utf8
from .storage import local_table, only, partitions_for

END_ID = 0
#: The memo is emptied beyond so many pieces, or ids of pieces.
MEMO_MOST, POOL_MOST = 1 << 20, 1 << 23
ROWS_PER_SHARD = 20_000
#: Characters that the library encodes at a time, or one text.
CHARS = 1 << 16
_MASK = 0xA282EAD8
#: A piece with such a first byte may start with (Unicode) white space.
_ODD = np.zeros(256, bool)
_ODD[[*range(0x09, 0x0E), *range(0x1C, 0x21), 0xC2, 0xE1, 0xE2, 0xE3]] = True


def masked_crc(data: bytes) -> int:
    crc = zlib.crc32(data)
    return (((crc >> 15) | (crc << 17)) + _MASK) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    head = struct.pack("<Q", len(payload))
    return b"".join((head, struct.pack("<I", masked_crc(head)), payload, struct.pack("<I", masked_crc(payload))))


def unframe(raw: bytes, at: int = 0) -> tuple[bytes, int]:
    """The payload at an offset, and the next offset; raises ValueError if damaged."""
    head = raw[at : at + 8]
    if len(head) < 8 or struct.unpack_from("<I", raw, at + 8)[0] != masked_crc(head):
        raise ValueError(f"damaged length at {at}")
    end = at + 12 + struct.unpack("<Q", head)[0]
    payload = raw[at + 12 : end]
    if len(raw) < end + 4 or struct.unpack_from("<I", raw, end)[0] != masked_crc(payload):
        raise ValueError(f"damaged payload at {at}")
    return payload, end + 4


class Encoder:
    """Ids of many texts at once; remembers distinct pieces up to a bound."""

    _open: dict[str, "Encoder"] = {}

    @classmethod
    def of(cls, path: str) -> "Encoder":
        LEFT[__name__] = cls._open.clear
        return cls._open.setdefault(path, cls._open.get(path) or cls(path))

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        self.model.encode_special_tokens = True
        size = self.model.get_vocab_size()
        self.dtype = np.dtype("<u2") if size <= 1 << 16 else np.dtype("<u4")
        #: Each character of a byte-level token stands for one byte.
        self.token_bytes = np.array([len(self.model.id_to_token(i) or "") for i in range(size)])
        self.clear()

    def clear(self) -> None:
        self.known, self.known_at = np.zeros(0, np.uint64), np.zeros(0, np.int32)
        self.pool, self.used = np.zeros(1 << 16, self.dtype), 0
        # by place: second hashes, lengths, and where the ids end in the pool (a place more)
        self.checks, self.spans, self.bounds = np.zeros(1 << 14, np.uint64), np.zeros(1 << 14, np.uint32), np.zeros(1 << 14, np.int64)

    def _find(self, keys: np.ndarray) -> np.ndarray:
        """Memo places of ascending keys, -1 if absent."""
        if not len(self.known):
            return np.full(len(keys), -1)
        at = np.minimum(np.searchsorted(self.known, keys), len(self.known) - 1)
        return np.where(self.known[at] == keys, self.known_at[at], -1)

    def whole(self, texts: list[str]) -> list[np.ndarray]:
        # in groups: the library's results hold far more than the ids
        out, at = [], 0
        ends = np.cumsum([len(t) for t in texts])
        while at < len(texts):
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + CHARS, "right")))
            out += [np.array(e.ids, self.dtype) for e in self.model.encode_batch_fast(texts[at:to], add_special_tokens=False)]
            at = to
        return out

    def _learn(self, keys: np.ndarray, checks: np.ndarray, pieces: list[bytes]) -> None:
        """Encodes spaced pieces joined to texts of bounded size and cuts the ids at their bytes."""
        ends = np.cumsum([len(p) for p in pieces])
        bounds = [0, *(np.flatnonzero(np.diff(ends // CHARS)) + 1).tolist(), len(pieces)]
        ids = np.concatenate(self.whole([b"".join(pieces[i:j]).decode() for i, j in zip(bounds, bounds[1:])]))
        cuts = np.searchsorted(np.cumsum(self.token_bytes[ids]), ends) + 1
        reached = np.concatenate([[0], np.cumsum(self.token_bytes[ids])])
        if not np.array_equal(reached[cuts], ends):
            raise ValueError("a token crosses two pieces")
        self._add(keys, checks, ids, np.diff(np.concatenate([[0], cuts])))

    def _add(self, keys: np.ndarray, checks: np.ndarray, ids: np.ndarray, sizes: np.ndarray) -> None:
        n = len(self.known)
        for array, least in ((self.pool, self.used + len(ids)), *((x, n + len(keys) + 1) for x in (self.checks, self.spans, self.bounds))):
            if least > len(array):
                array.resize(max(least, len(array) * 5 // 4), refcheck=False)  # in place: no second copy
        self.pool[self.used : self.used + len(ids)] = ids
        self.bounds[n + 1 : n + 1 + len(keys)] = self.used + np.cumsum(sizes)
        self.checks[n : n + len(keys)], self.spans[n : n + len(keys)] = checks.T
        self.used += len(ids)
        # both are ascending, so the memo isn't sorted again
        at = np.searchsorted(self.known, keys)
        self.known = np.insert(self.known, at, keys)
        self.known_at = np.insert(self.known_at, at, np.arange(n, n + len(keys), dtype=np.int32))

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts joined, and n + 1 offsets."""
        raw, offsets = utf8(column)
        words = Words(raw, offsets, exact, not_blank)
        n = len(offsets) - 1
        # a piece is a word with the one space before it; a text's first has none
        leads = np.zeros(len(words.starts), bool)
        leads[words.first[:-1][words.counts > 0]] = True
        spaces = np.concatenate([[0], np.cumsum(raw == 0x20)])
        gaps = spaces[offsets[1:]] - spaces[offsets[:-1]]
        owner = np.repeat(np.arange(n), words.counts)
        odd = (gaps != words.counts - 1) & (offsets[1:] > offsets[:-1])
        np.logical_or.at(odd, owner[~leads & _ODD[raw[words.starts]]], True)
        keys = np.where(leads, words.hashes ^ np.uint64(0xA5A5A5A5A5A5A5A5), words.hashes)
        checks = np.stack([words.checks, words.sizes.astype(np.uint64) * np.uint64(2) + leads.astype(np.uint64)], 1)
        if not alike_within(keys, checks):  # two pieces with one hash: no memo for this batch
            odd[:] = offsets[1:] > offsets[:-1]
        places = np.flatnonzero(~odd[owner])
        keys, checks = keys[places], checks[places]
        distinct, first, back = np.unique(keys, return_index=True, return_inverse=True)
        if len(self.known) + len(distinct) > MEMO_MOST or self.used > POOL_MOST:
            self.clear()
        index = self._find(distinct)
        there, here = index[index >= 0], checks[first[index >= 0]]
        if ((self.checks[there] != here[:, 0]) | (self.spans[there] != here[:, 1])).any():
            self.clear()  # it holds another piece with the hash of one of these
            index = self._find(distinct)
        new = np.flatnonzero(index < 0)
        if len(new):
            at = places[first[new]]
            alone = leads[at]
            data = raw.tobytes()
            if (~alone).any():
                self._learn(distinct[new[~alone]], checks[first[new[~alone]]], [b" " + data[s:e] for s, e in zip(words.starts[at[~alone]].tolist(), words.ends[at[~alone]].tolist())])
            if alone.any():
                got = self.whole([data[s:e].decode() for s, e in zip(words.starts[at[alone]].tolist(), words.ends[at[alone]].tolist())])
                self._add(distinct[new[alone]], checks[first[new[alone]]], np.concatenate(got), np.array([len(g) for g in got]))
            index = self._find(distinct)
        index = index[back]
        starts = self.bounds[index]
        sizes = self.bounds[index + 1] - starts
        ends = np.cumsum(sizes)
        flat = self.pool[np.repeat(starts - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)]
        per_text = np.bincount(owner[places], sizes, n).astype(np.int64)
        if odd.any():
            whole = dict(zip(np.flatnonzero(odd).tolist(), self.whole([raw[offsets[i] : offsets[i + 1]].tobytes().decode() for i in np.flatnonzero(odd)])))
            cuts = np.concatenate([[0], np.cumsum(per_text)])
            flat = np.concatenate([whole[i] if i in whole else flat[cuts[i] : cuts[i + 1]] for i in range(n)])
            for i, ids in whole.items():
                per_text[i] = len(ids)
        return flat, np.concatenate([[0], np.cumsum(per_text)])


def alike_within(keys: np.ndarray, checks: np.ndarray) -> bool:
    """Whether equal keys always have equal checks."""
    order = np.argsort(keys, kind="stable")
    same = keys[order][1:] == keys[order][:-1]
    return bool((checks[order][1:][same] == checks[order][:-1][same]).all())


def open_store(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system and path of a folder; ValueError if pyarrow can't reach it."""
    try:
        return fs.FileSystem.from_uri(uri.replace("s3a://", "s3://", 1))
    except pa.ArrowInvalid as e:
        raise ValueError(f"records can be written to local, s3, gs and hdfs folders, not to {uri}") from e


_SHARDS = pa.schema([("shard", pa.int64()), ("path", pa.string()), ("records", pa.int64()), ("tokens", pa.int64())])


def write_task(folder: str, tokenizer: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = open_store(folder)
        encoder, out, index, at, records, tokens, shard = None, None, [], 0, 0, 0, 0
        own = uuid.uuid4().hex
        for batch in slices(batches, kind=__name__):
            encoder = encoder or Encoder.of(tokenizer)
            shard = TaskContext.get().partitionId()
            out = out or store.open_output_stream(posixpath.join(root, f"{own}.rec.part"))
            ids, offsets = encoder.encode(batch.column("text"))
            kind = 1 if encoder.dtype.itemsize == 2 else 2
            end = np.array([END_ID], encoder.dtype).tobytes()
            framed = []
            for i, key in enumerate(batch.column("doc_id").to_pylist()):
                payload = struct.pack("<qB", key or 0, kind + 4 * (key is None)) + ids[offsets[i] : offsets[i + 1]].tobytes() + end
                n = int(offsets[i + 1] - offsets[i]) + 1
                framed.append(frame(payload))
                index.append((at, n))
                at, records, tokens = at + len(framed[-1]), records + 1, tokens + n
            out.write(b"".join(framed))
        if out is not None:
            out.close()
            with store.open_output_stream(posixpath.join(root, f"{own}.idx.part")) as f:
                f.write(np.array(index, "<u8").tobytes())
            for kind in ("idx", "rec"):
                store.move(posixpath.join(root, f"{own}.{kind}.part"), posixpath.join(root, f"{shard:05d}-{own}.{kind}"))
            yield pa.RecordBatch.from_arrays([pa.array([shard]), pa.array([f"{folder}/{shard:05d}-{own}"]), pa.array([records]), pa.array([tokens])], schema=_SHARDS)

    return run


def write_records(spark: SparkSession, docs: DataFrame, folder: str, tokenizer: str) -> DataFrame:
    """Writes all texts; a row for each shard: shard, path (without suffix), records, tokens."""
    docs = only(docs, "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("long"))
    store, root = open_store(folder)
    store.create_dir(root, recursive=True)
    n = docs.count()
    shards = max(1, min(n, max(partitions_for(spark), n // ROWS_PER_SHARD)))
    # ranges of (id, beginning of the text), so that rows of one id are dealt as well
    order = [F.asc_nulls_first("doc_id"), F.asc_nulls_first(F.substring("text", 1, 16))]
    parts = docs.repartitionByRange(shards, *order).sortWithinPartitions(F.asc_nulls_first("doc_id"), F.asc_nulls_first("text"))
    made = parts.mapInArrow(write_task(folder, tokenizer), "shard long, path string, records long, tokens long").collect()
    return local_table(spark, _SHARDS, made)


def read_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path, start in zip(batch.column("path").to_pylist(), batch.column("start").to_pylist()):
            store, root = open_store(path)
            with store.open_input_stream(root + ".idx") as f:
                index = np.frombuffer(f.read(), "<u8").reshape(-1, 2).astype(np.int64)
            with store.open_input_file(root + ".rec") as f:
                for k in range(0, len(index), 512):
                    part = index[k : k + 512]
                    end = int(index[k + 512][0]) if k + 512 < len(index) else f.size()
                    f.seek(int(part[0][0]))
                    raw = f.read(end - int(part[0][0]))
                    keys, crcs = [], []
                    for at, n in (part - [part[0][0], 0]).tolist():
                        payload, _ = unframe(raw, at)
                        key, flags = struct.unpack_from("<qB", payload)
                        ids = np.frombuffer(payload, "<u2" if flags & 1 else "<u4", offset=9)
                        if len(ids) != n:
                            raise ValueError(f"{path}: the index does not fit record {key}")
                        keys.append(None if flags & 4 else key)
                        crcs.append(zlib.crc32(ids.astype("<u4").tobytes()))
                    starts = start + np.cumsum(part[:, 1]) - part[:, 1]
                    start += int(part[:, 1].sum())
                    yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(starts), pa.array(part[:, 1]), pa.array(crcs, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])


def read_records(spark: SparkSession, shards: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every record; checks all checksums."""
    rows = shards.orderBy("shard").collect()  # a few values for each shard
    start, placed = 0, []
    for r in rows:
        placed.append((r.path, start))
        start += r.tokens
    frame_ = local_table(spark, pa.schema([("path", pa.string()), ("start", pa.int64())]), placed)
    return frame_.repartition(max(1, min(len(placed), 4 * partitions_for(spark)))).mapInArrow(read_task, "doc_id long, start long, n_tokens long, ids_crc32 long")


def tokenized(spark: SparkSession, docs: DataFrame, tokenizer: str) -> DataFrame:
    """Writes ``docs`` into the shared folder and reads the records back."""
    return read_records(spark, write_records(spark, docs, new_folder(spark, "token-records"), tokenizer))
