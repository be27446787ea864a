"""Token ids in patched frame-of-reference blocks.

File format (little-endian), one file per range of document ids:

    blocks   of BLOCK ids each, the last one padded with its own minimum:
             minimum u32 | width u8 | unused u8 | exceptions u16
             packed      width * 32 bytes: 8 lanes of 32 values, `width` bits each
             positions   u8 per exception
             high bits   u32 per exception: (value - minimum) >> width
    footer   documents: known u8, doc_id i64, ids u32 each (three arrays) | block starts u64 each, and the end
    trailer  footer start u64 | ids u64 | documents u64 | blocks u64 | MAGIC

A block's width is the bit length at a percentile of its values less the minimum; longer values keep their low bits in
place and their high bits in the exception lists.
"""

from __future__ import annotations

import re
import struct
import sys
import uuid
import zlib
from array import array

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import Workspace, filesystem, partitions
from .words import raw, trimmed

BLOCK, LANES = 256, 8
MAGIC = b"KTPFOR1\n"
_HEAD, _TRAILER = struct.Struct("<IBBH"), struct.Struct("<QQQQ8s")
_LIMITS = np.array([1 << i for i in range(33)], np.uint64)
CHUNK = 4096


def encode_blocks(ids: np.ndarray, percentile: float = 0.9) -> tuple[bytes, np.ndarray]:
    """Bytes of the blocks of ids (a multiple of BLOCK of them) and each block's length."""
    values = ids.reshape(-1, BLOCK).astype(np.uint32)
    low = values.min(1)
    away = values - low[:, None]
    bits = np.searchsorted(_LIMITS, away.ravel(), "right").reshape(away.shape).astype(np.uint8)
    at = min(BLOCK - 1, int(percentile * BLOCK))
    width = np.partition(bits, at, axis=1)[:, at]
    rows, cols = np.nonzero(bits > width[:, None])
    high = (away[rows, cols] >> width[rows].astype(np.uint32)).astype("<u4")
    first = np.searchsorted(rows, np.arange(len(values) + 1))
    cols = cols.astype(np.uint8)
    packed: list[bytes] = [b""] * len(values)
    for w in np.unique(width):
        some = np.flatnonzero(width == w)
        w = int(w)
        if not w:
            continue
        v = (away[some] & np.uint32(2**w - 1)).reshape(len(some), 32, LANES)
        out = np.zeros((len(some), w, LANES), np.uint32)
        for r in range(32):
            word, shift = divmod(r * w, 32)
            out[:, word] |= v[:, r] << np.uint32(shift)
            if shift + w > 32:
                out[:, word + 1] |= v[:, r] >> np.uint32(32 - shift)
        for i, b in zip(some, out.astype("<u4").reshape(len(some), -1), strict=True):
            packed[i] = b.tobytes()
    parts, lengths = [], np.empty(len(values), np.int64)
    for i in range(len(values)):
        a, b = first[i], first[i + 1]
        one = _HEAD.pack(int(low[i]), int(width[i]), 0, int(b - a)) + packed[i] + cols[a:b].tobytes() + high[a:b].tobytes()
        parts.append(one)
        lengths[i] = len(one)
    return b"".join(parts), lengths


def decode_blocks(data: bytes, starts: np.ndarray) -> np.ndarray:
    """The ids of the blocks that begin at ``starts`` in data."""
    n = len(starts)
    low, width = np.empty(n, np.uint32), np.empty(n, np.uint8)
    at: list[tuple] = []
    for i, s in enumerate(starts):
        low[i], width[i], _, count = _HEAD.unpack_from(data, s)
        if count:
            at.append((i, int(s) + _HEAD.size + int(width[i]) * 32, count))
    out = np.zeros((n, BLOCK), np.uint32)
    for w in np.unique(width):
        some = np.flatnonzero(width == w)
        w = int(w)
        if not w:
            continue
        words = np.frombuffer(b"".join(data[s + _HEAD.size : s + _HEAD.size + w * 32] for s in starts[some]), "<u4").reshape(len(some), w, LANES)
        v = np.empty((len(some), 32, LANES), np.uint32)
        for r in range(32):
            word, shift = divmod(r * w, 32)
            v[:, r] = words[:, word] >> np.uint32(shift)
            if shift + w > 32:
                v[:, r] |= words[:, word + 1] << np.uint32(32 - shift)
        out[some] = (v & np.uint32(2**w - 1)).reshape(len(some), BLOCK)
    for i, p, count in at:
        cols = np.frombuffer(data, np.uint8, count, p)
        out[i, cols] |= np.frombuffer(data, "<u4", count, p + count) << np.uint32(width[i])
    return (out + low[:, None]).ravel()


class ShardWriter:
    """Writes one file; ids are held back until a chunk of blocks is full."""

    def __init__(self, path: str, percentile: float):
        fs, self.name = filesystem(path)
        fs.create_dir(self.name.rpartition("/")[0], recursive=True)
        self.out, self.percentile = fs.open_output_stream(self.name, compression=None), percentile
        self.held, self.n_held, self.n_ids, self.at = [], 0, 0, 0
        self.docs, self.counts, self.lengths, self.open = [], [], [], 0

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.extend([doc_id], ids, np.array([len(ids)]))

    def extend(self, docs: list, ids: np.ndarray, ends: np.ndarray) -> None:
        """More ids; those of ``docs`` end at ``ends`` in them, and what follows belongs to a document not yet at its end."""
        if docs:
            self.docs += docs
            counts = np.diff(ends, prepend=0)
            counts[0] += self.open
            self.counts += counts.tolist()
        self.open = len(ids) - int(ends[-1]) if docs else self.open + len(ids)
        self.held.append(ids)
        self.n_held += len(ids)
        self.n_ids += len(ids)
        if self.n_held >= CHUNK * BLOCK:
            self._flush(self.n_held // BLOCK * BLOCK)

    def _flush(self, n: int) -> None:
        ids = np.concatenate(self.held)
        self.held, self.n_held = [ids[n:]], len(ids) - n
        data, lengths = encode_blocks(ids[:n], self.percentile)
        self.out.write(data)
        self.lengths.append(lengths)

    def close(self) -> None:
        if self.n_held:
            ids = np.concatenate(self.held)
            pad = -len(ids) % BLOCK
            self.held, self.n_held = [ids, np.full(pad, ids[-(len(ids) % BLOCK or BLOCK) :].min(), ids.dtype)], len(ids) + pad
            self._flush(self.n_held)
        starts = np.concatenate(([0], np.cumsum(np.concatenate(self.lengths)) if self.lengths else [])).astype("<u8")
        known = np.array([d is not None for d in self.docs], np.uint8)
        self.out.write(known.tobytes() + np.array([d or 0 for d in self.docs], "<i8").tobytes() + np.array(self.counts, "<u4").tobytes() + starts.tobytes())
        self.out.write(_TRAILER.pack(int(starts[-1]), self.n_ids, len(self.docs), len(starts) - 1, MAGIC))
        self.out.close()


def read_shard(path: str):
    """(doc_id, start within the file, ids) of each document of a file, read chunk by chunk."""
    fs, name = filesystem(path)
    with fs.open_input_file(name) as f:
        f.seek(f.size() - _TRAILER.size)
        end, n_ids, n_docs, n_blocks, magic = _TRAILER.unpack(f.read(_TRAILER.size))
        if magic != MAGIC:
            raise ValueError(f"{path} is no token file")
        f.seek(end)
        footer = f.read(n_docs * 13 + (n_blocks + 1) * 8)
        known = np.frombuffer(footer, np.uint8, n_docs)
        docs = np.frombuffer(footer, "<i8", n_docs, n_docs)
        counts = np.frombuffer(footer, "<u4", n_docs, 9 * n_docs).astype(np.int64)
        starts = np.frombuffer(footer, "<u8", n_blocks + 1, 13 * n_docs).astype(np.int64)
        held, at, doc, block = np.zeros(0, np.uint32), 0, 0, 0
        while doc < n_docs:
            need = counts[doc]
            if len(held) < need and block < n_blocks:
                to = min(n_blocks, block + CHUNK)
                f.seek(int(starts[block]))
                ids = decode_blocks(f.read(int(starts[to] - starts[block])), starts[block:to] - starts[block])
                held, block = np.concatenate((held, ids)), to
                continue
            pos = 0
            while doc < n_docs and pos + counts[doc] <= len(held):
                n = int(counts[doc])
                yield (int(docs[doc]) if known[doc] else None), at, held[pos : pos + n]
                pos, at, doc = pos + n, at + n, doc + 1
            held = held[pos:]
            if doc < n_docs and block >= n_blocks and len(held) < counts[doc]:
                raise ValueError(f"{path} ends early")
        if at != n_ids:
            raise ValueError(f"{path} has {at} ids, not {n_ids}")


_SAFE = re.compile(r"[!-~À-ÖØ-öø-ÿ]+")
_PIECE = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-z0-9ß-öø-ÿ]+")
#: Pieces that a worker's cache holds twice over, unless fewer are asked for.
CACHE = 200_000
#: Bytes of texts that are cut and looked up at once; a stretch ends between words or texts.
STRETCH = 1 << 20
_LOADED: dict[tuple[str, int], ChunkEncoder] = {}

_BLANK = np.zeros(256, bool)
_BLANK[[0x20, 0x0A]] = True
#: Classes of bytes: letters (a Latin-1 letter's lead byte among them), digits, signs, and what needs a closer look.
_LETTER, _DIGIT, _SIGN, _OTHER = range(4)
_CLASS = np.full(256, _OTHER, np.uint8)
_CLASS[0x21:0x7F] = _SIGN
_CLASS[[*range(0x41, 0x5B), *range(0x61, 0x7B), 0xC3]] = _LETTER
_CLASS[0x30:0x3A] = _DIGIT
_CLASS[0x27] = _OTHER
_CLASS[[0x20, 0x0A]] = _SIGN
#: Bytes that end a Latin-1 letter after 0xC3; those that end a capital one.
_TRAIL, _CAPITAL = np.zeros(256, bool), np.zeros(256, bool)
_TRAIL[0x80:0xC0] = True
_CAPITAL[0x80:0x9F] = True
_TRAIL[[0x97, 0xB7]] = _CAPITAL[0x97] = False
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32


class Recent(dict):
    """A bounded cache that computes what it misses; entries used since the last turnover survive the next one."""

    def __init__(self, compute, limit: int):
        super().__init__()
        self.compute, self.limit, self.old = compute, limit, {}

    def __missing__(self, key: str) -> bytes:
        value = self.old.get(key)
        if value is None:
            value = self.compute(key)
            if len(key) > 64:
                return value
        if len(self) >= self.limit:
            self.old = dict(self)
            self.clear()
        self[key] = value
        return value


class ChunkEncoder:
    """Ids of columns of texts; a bounded cache over the tokenizer for the pieces that texts are cut into.

    Tokenizers that drop white space never look across it, so a text's ids are those of its chunks.  With word BPE of the
    known pattern, chunks of printable ASCII and Latin-1 letters are cut further where that pattern cuts them, and their
    pieces go to the model directly; any other chunk goes through the whole tokenizer.  A stretch of texts is cut as one
    array, its distinct pieces are looked up once each, and ids are gathered by the pieces' numbers.  Other tokenizers get
    whole texts.
    """

    def __init__(self, path: str, cache: int = CACHE):
        from tokenizers import Tokenizer, pre_tokenizers

        self.whole = Tokenizer.from_file(path)
        self.model = self.whole.model
        self.kind = np.dtype("<u2" if self.whole.get_vocab_size() < 65536 else "<u4")
        as_text = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.bytes_as_text = {c: as_text.pre_tokenize_str(chr(c))[0][0] for c in range(0xC0, 0x100)}
        self.by_chunk, self.direct = _kind(self.whole)
        self.known = Recent(self._ids, cache)
        self.code = "H" if self.kind.itemsize == 2 else "I"

    def _packed(self, ids: list[int]) -> bytes:
        packed = array(self.code, ids)
        if sys.byteorder == "big":
            packed.byteswap()
        return packed.tobytes()

    def _ids(self, chunk: str) -> bytes:
        """The ids of a chunk or of a piece of one."""
        if self.direct:
            if chunk.isascii() and chunk.isalpha():
                return self._piece(chunk.lower())
            if _SAFE.fullmatch(chunk) and "<|" not in chunk:
                return b"".join([self._piece(p) for p in _PIECE.findall(chunk.lower())])
        return self._packed(self.whole.encode(chunk, add_special_tokens=False).ids)

    def _piece(self, piece: str) -> bytes:
        text = piece if piece.isascii() else piece.translate(self.bytes_as_text)
        return self._packed([t.id for t in self.model.tokenize(text)])

    def _cut(self, data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where pieces start, and the bytes with letters lower-cased as far as that changes no ids; texts end at ``ends``."""
        blank = _BLANK[data]
        start = np.ones(len(data), bool)
        start[1:] = blank[:-1]
        start[ends[ends < len(data)]] = True
        start &= ~blank
        if not self.direct:
            return start, data
        kind, low = _CLASS[data], _LOWER[data]
        latin = np.zeros(len(data), bool)
        latin[1:] = data[:-1] == 0xC3
        latin &= _TRAIL[data]
        kind[latin] = _LETTER
        low[latin & _CAPITAL[data]] += 32
        # Special tokens begin so, and are told by their case.
        kind[:-1][(data[:-1] == 0x3C) & (data[1:] == 0x7C)] = _OTHER
        chunk = np.cumsum(start, dtype=np.int32)
        whole = np.zeros(int(chunk[-1]) + 1, bool)
        whole[chunk[kind == _OTHER]] = True
        cut = ~whole[chunk]
        change = kind == _DIGIT
        change[1:] |= kind[1:] != kind[:-1]
        return start | (change & cut & ~blank), np.where(cut, low, data)

    def _stretch(self, data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the texts in data, and how many of them stand before each of ``ends``."""
        if not len(data):
            return np.zeros(0, self.kind), np.zeros(len(ends), np.int64)
        start, low = self._cut(data, ends)
        starts = np.flatnonzero(start)
        full = ~_BLANK[data]
        packed = low[full]
        offsets = np.append(np.cumsum(full, dtype=np.int32)[starts] - 1, len(packed)).astype(np.int32)
        pieces = pa.StringArray.from_buffers(len(starts), pa.py_buffer(offsets), pa.py_buffer(packed)).dictionary_encode()
        at = pieces.indices.to_numpy()
        found = list(map(self.known.__getitem__, pieces.dictionary.to_numpy(zero_copy_only=False).tolist()))
        size = np.fromiter(map(len, found), np.int64, len(found)) // self.kind.itemsize
        ids, n = np.frombuffer(b"".join(found), self.kind), size[at]
        edge = np.concatenate(([0], np.cumsum(n)))
        out = ids[np.repeat((np.cumsum(size) - size)[at] - edge[:-1], n) + np.arange(edge[-1])]
        return out, edge[np.searchsorted(starts, ends)]

    def stream(self, column: pa.Array):
        """(ids, ends) of stretches of the column's texts: ids in order, and where in them each text that ends there does.

        Nulls are empty; a text may span several stretches.
        """
        if not self.by_chunk:
            for text in column:
                ids = np.array(self.whole.encode(text.as_py() or "", add_special_tokens=False).ids, self.kind)
                yield ids, np.array([len(ids)])
            return
        data, offsets = raw(column)
        at, row, last = int(offsets[0]), 1, int(offsets[-1])
        while row < len(offsets):
            to = min(last, at + STRETCH)
            if to < last:
                bound = int(offsets[np.searchsorted(offsets, to)])
                while to < bound:
                    near = np.flatnonzero(_BLANK[data[to : min(bound, to + 4096)]])
                    if len(near):
                        to += int(near[0])
                        break
                    to = min(bound, to + 4096)
            done = int(np.searchsorted(offsets, to, "right"))
            yield self._stretch(data[at:to], offsets[row:done] - at)
            at, row = to, max(row, done)

    def encode(self, text: str | None) -> bytes:
        """The ids of one text, as little-endian bytes."""
        return b"".join(ids.tobytes() for ids, _ in self.stream(pa.array([text], pa.string())))


def _kind(tokenizer) -> tuple[bool, bool]:
    """Whether the tokenizer drops white space between words, and whether its pattern is the one that _PIECE follows."""
    import json

    spec = json.loads(tokenizer.to_str())
    norm, pre = spec.get("normalizer") or {}, spec.get("pre_tokenizer") or {}
    kinds = [x.get("type") for x in norm.get("normalizers", [])]
    split = (pre.get("pretokenizers") or [{}])[0]
    by_chunk = kinds == ["NFC", "Replace", "Lowercase"] and split.get("behavior") == "Removed"
    pattern = {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}
    return by_chunk, by_chunk and split["pattern"] == pattern and spec["model"].get("end_of_word_suffix") == "</w>"


def _encoder(path: str, cache: int) -> ChunkEncoder:
    if (path, cache) not in _LOADED:
        _LOADED[path, cache] = ChunkEncoder(path, cache)
    return _LOADED[path, cache]


def _write(folder: str, tokenizer: str, end_id: int, percentile: float, cache: int):
    def run(batches):
        encoder, writer = None, None
        for batch in batches:
            if writer is None:
                encoder = _encoder(tokenizer, cache)
                # A name for each attempt: a repeated task never overwrites what an earlier one has reported.
                path = f"{folder}/shard-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex[:8]}.pfor"
                writer = ShardWriter(path, percentile)
            ids, at = batch.column(0).to_pylist(), 0
            for found, ends in encoder.stream(batch.column(1)):
                writer.extend(ids[at : at + len(ends)], np.insert(found, ends, end_id), ends + np.arange(1, len(ends) + 1))
                at += len(ends)
        if writer is not None:
            writer.close()
            yield pa.RecordBatch.from_arrays(
                [pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([path]), pa.array([writer.n_ids], pa.int64()), pa.array([len(writer.docs)], pa.int64())],
                names=["shard", "path", "n_ids", "n_docs"],
            )

    return trimmed(run)


def _read(batches):
    for batch in batches:
        for path, before in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            rows = []
            for doc_id, start, ids in read_shard(path):
                rows.append((doc_id, before + start, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                if len(rows) >= 1 << 14:
                    yield _batch(rows)
                    rows = []
            if rows:
                yield _batch(rows)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=["doc_id", "start", "n_tokens", "ids_crc32"])


def write_tokens(docs: DataFrame, folder: str, tokenizer: str, *, doc_id: str = "doc_id", text: str = "text", end_id: int = 2, percentile: float = 0.9, cache: int = CACHE, work: Workspace | None = None) -> DataFrame:
    """Writes token files of ascending doc_id to ``folder``; returns the manifest: shard, path, n_ids, n_docs, before.

    Rows are dealt by ranges of (doc_id, hash of the text) and sorted by these and the text, nulls first, so repeated ids
    have one order and don't gather in one task; ``before`` counts ids of earlier files.  Whole texts are encoded, however
    long.  Null text is an empty document, which still gets ``end_id``.  A null doc_id is kept as null; equal rows are written
    each.  An empty table gives no files; other columns are not read.
    """
    work = work or Workspace(docs.sparkSession, "tokens")
    ordered = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    ordered = ordered.withColumn("h", F.xxhash64("text")).repartitionByRange(partitions(docs.sparkSession), "doc_id", "h").sortWithinPartitions("doc_id", "h", "text")
    ordered = ordered.select("doc_id", "text")
    files = work.write(ordered.mapInArrow(_write(folder, tokenizer, end_id, percentile, cache), "shard int, path string, n_ids long, n_docs long"), "manifest")
    # One row per file.
    before = F.coalesce(F.sum("n_ids").over(W.orderBy("shard").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return files.withColumn("before", before)


def read_tokens(manifest: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each document, read back from the files of a manifest."""
    dealt = manifest.select("path", "before").repartition(partitions(manifest.sparkSession))
    return dealt.mapInArrow(_read, "doc_id long, start long, n_tokens long, ids_crc32 long")
