"""Documents as token ids in sorted-string-table shards that answer lookups by binary search.

A shard is one binary value:

    blocks   each zstd-compressed: entries of varint shared, varint unshared, varint value length, key suffix, value;
             a block's first key is whole, each other shares a prefix with the one before it
    index    per block: u64 offset, u32 stored length, u32 raw length, u16 key length, last key
    bloom    u8 number of probes, u32 bytes, bits
    footer   u64 index offset, u64 bloom offset, u64 entries, u32 blocks, u8 bytes a token, u8 meta columns, u8 kind of key,
             u32 CRC of all before it, 8 bytes of magic

A key of kind 0 is a whole number's 8 bytes, big-endian with the sign flipped, so that bytes sort as numbers; one of kind 1
is a 1 and the identifier's UTF-8 bytes. A null identifier is the empty key, before all others. A value holds the meta
columns and the token ids.
"""

from __future__ import annotations

import bisect
import struct
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliospark.llm import bpe
from foliospark.llm.common import chunks, id_type, only, table

MAGIC = b"FSSTABL2"
FOOTER = struct.Struct("<QQQIBBBI8s")
PROBES, BITS_A_KEY = 7, 10
NUMBER, TEXT = 0, 1
#: Identifiers that one lookup takes; they go to every task.
MOST_IDS = 1_000_000


def _schema(kind: str) -> str:
    return f"first_doc_id {kind}, last_doc_id {kind}, n_docs bigint, n_tokens bigint, n_blocks bigint, sst binary"


def key_of(doc_id: int | str | None) -> bytes:
    return b"" if doc_id is None else b"\1" + doc_id.encode() if isinstance(doc_id, str) else struct.pack(">Q", doc_id + (1 << 63))


def id_of(key: bytes, kind: int = NUMBER) -> int | str | None:
    return None if not key else key[1:].decode() if kind == TEXT else struct.unpack(">Q", key)[0] - (1 << 63)


def varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def read_varint(data: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        b = data[at]
        at += 1
        n |= (b & 127) << shift
        shift += 7
        if b < 128:
            return n, at


def _probes(key: bytes, bits: int) -> list[int]:
    h = xxhash.xxh3_128_intdigest(key)
    a, b = h & (1 << 64) - 1, (h >> 64) | 1
    return [(a + i * b) % bits for i in range(PROBES)]


def value_of(meta: tuple, ids: np.ndarray | None, width: int) -> bytes:
    parts = []
    for m in meta:
        raw = None if m is None else str(m).encode()
        parts.append(b"\0" if raw is None else varint(len(raw) + 1) + raw)
    parts.append(b"\0" if ids is None else b"\1" + ids.astype("<u2" if width == 2 else "<u4").tobytes())
    return b"".join(parts)


def parse_value(data: bytes, n_meta: int, width: int) -> tuple[tuple, list[int] | None]:
    at, meta = 0, []
    for _ in range(n_meta):
        n, at = read_varint(data, at)
        meta.append(None if n == 0 else data[at : at + n - 1].decode())
        at += max(0, n - 1)
    return tuple(meta), None if data[at] == 0 else np.frombuffer(data, "<u2" if width == 2 else "<u4", offset=at + 1).tolist()


class Writer:
    """Takes entries in the order of their keys; finish() gives the shard's bytes."""

    def __init__(self, block_bytes: int, width: int, n_meta: int = 2, kind: int = NUMBER):
        self.block_bytes, self.width, self.n_meta, self.kind = block_bytes, width, n_meta, kind
        self.press = zstandard.ZstdCompressor(level=1)
        self.out: list[bytes] = []
        self.offset = self.n = self.raw = 0
        self.index: list[bytes] = []
        self.keys: list[bytes] = []
        self.block = bytearray()
        self.last: bytes | None = None

    def add(self, key: bytes, value: bytes) -> None:
        shared = 0
        if self.block:
            last = self.last
            while shared < len(key) and shared < len(last) and key[shared] == last[shared]:
                shared += 1
        self.block += varint(shared) + varint(len(key) - shared) + varint(len(value)) + key[shared:] + value
        self.raw += len(key) + len(value)
        self.n += 1
        if key != self.last:
            self.keys.append(key)
        self.last = key
        if len(self.block) >= self.block_bytes:
            self._flush()

    def _flush(self) -> None:
        data = self.press.compress(bytes(self.block))
        self.index.append(struct.pack("<QIIH", self.offset, len(data), len(self.block), len(self.last)) + self.last)
        self.out.append(data)
        self.offset += len(data)
        self.block = bytearray()

    def finish(self) -> bytes:
        if self.block:
            self._flush()
        index = b"".join(self.index)
        bits = max(64, (len(self.keys) * BITS_A_KEY + 7) // 8 * 8)
        bloom = bytearray(bits // 8)
        for k in self.keys:
            for p in _probes(k, bits):
                bloom[p >> 3] |= 1 << (p & 7)
        body = b"".join([*self.out, index, struct.pack("<BI", PROBES, len(bloom)), bytes(bloom)])
        return body + FOOTER.pack(self.offset, self.offset + len(index), self.n, len(self.index), self.width, self.n_meta, self.kind, zlib.crc32(body), MAGIC)


class SSTable:
    """Reads a shard; a lookup asks the Bloom filter, bisects the block index and unpacks one block, or more where a key goes on."""

    def __init__(self, data: bytes):
        self.data = bytes(data)
        index, bloom, self.n, blocks, self.width, self.n_meta, self.kind, crc, magic = FOOTER.unpack(self.data[-FOOTER.size :])
        if magic != MAGIC or zlib.crc32(self.data[: -FOOTER.size]) != crc:
            raise ValueError("not a shard, or a damaged one")
        self.last, self.blocks, at = [], [], index
        for _ in range(blocks):
            offset, size, raw, n = struct.unpack_from("<QIIH", self.data, at)
            at += 18
            self.last.append(self.data[at : at + n])
            self.blocks.append((offset, size, raw))
            at += n
        _, n = struct.unpack_from("<BI", self.data, bloom)
        self.bloom = self.data[bloom + 5 : bloom + 5 + n]

    def block(self, i: int) -> Iterator[tuple[bytes, bytes]]:
        offset, size, raw = self.blocks[i]
        data = zstandard.ZstdDecompressor().decompress(self.data[offset : offset + size], max_output_size=raw)
        at, key = 0, b""
        while at < len(data):
            shared, at = read_varint(data, at)
            own, at = read_varint(data, at)
            n, at = read_varint(data, at)
            key = key[:shared] + data[at : at + own]
            at += own
            yield key, data[at : at + n]
            at += n

    def may_have(self, doc_id: int | str | None) -> bool:
        return all(self.bloom[p >> 3] >> (p & 7) & 1 for p in _probes(key_of(doc_id), len(self.bloom) * 8))

    def get(self, doc_id: int | str | None) -> list[tuple[tuple, list[int] | None]]:
        """(meta, token ids) of every row with this identifier."""
        if not self.may_have(doc_id):
            return []
        key, out = key_of(doc_id), []
        for i in range(bisect.bisect_left(self.last, key), len(self.blocks)):
            for k, v in self.block(i):
                if k == key:
                    out.append(parse_value(v, self.n_meta, self.width))
                elif k > key:
                    return out
        return out

    def scan(self) -> Iterator[tuple[int | str | None, tuple, list[int] | None]]:
        for i in range(len(self.blocks)):
            for k, v in self.block(i):
                yield id_of(k, self.kind), *parse_value(v, self.n_meta, self.width)


def _row(w: Writer, first: bytes, tokens: int) -> pa.RecordBatch:
    data, kind = w.finish(), pa.string() if w.kind == TEXT else pa.int64()
    ends = [pa.array([id_of(k, w.kind)], kind) for k in (first, w.last)]
    return pa.record_batch([*ends, *(pa.array([x], pa.int64()) for x in (w.n, tokens, len(w.index))), pa.array([data], pa.binary())], names=["first_doc_id", "last_doc_id", "n_docs", "n_tokens", "n_blocks", "sst"])


def write_shards(batches, own: bpe.Bpe, meta: tuple[str, ...], width: int, shard_bytes: int, block_bytes: int, kind: int = NUMBER) -> Iterator[pa.RecordBatch]:
    """The shards of one sorted partition."""
    w, first, tokens = None, b"", 0
    for b in chunks(batches, "text"):
        texts = b.column("text")
        ids, cut = own.encode(texts)
        null = texts.is_null().to_pylist()
        for i, (doc_id, no_text, *rest) in enumerate(zip(b.column("doc_id").to_pylist(), null, *(b.column(m).to_pylist() for m in meta), strict=True)):
            if w is not None and w.raw >= shard_bytes:
                yield _row(w, first, tokens)
                w = None
            if w is None:
                w, first, tokens = Writer(block_bytes, width, len(meta), kind), key_of(doc_id), 0
            mine = None if no_text else ids[cut[i] : cut[i + 1]]
            tokens += 0 if no_text else len(mine)
            w.add(key_of(doc_id), value_of(tuple(rest), mine, width))
    if w is not None:
        yield _row(w, first, tokens)


def sstable_shards(docs: DataFrame, ranks_path: str | None = None, meta: tuple[str, ...] = ("lang", "source"), shard_bytes: int = 16 << 20, block_bytes: int = 64 << 10) -> DataFrame:
    """One row a shard: first and last identifier, documents, tokens, blocks, and the shard's bytes.

    docs goes through one exchange by ranges of doc_id and the text's hash, so shards are in key order and a task
    streams its sorted rows, encodes them and closes a shard at ``shard_bytes``. The rows of an identifier that many share,
    or of no identifier, are parted among tasks and shards like others: a shard may begin with the identifier that the one
    before ends with, and overlaps it in nothing else. Only rows alike in identifier and text stay in one task, which streams
    them. Whole numbers are identifiers as bigint, all else as strings.

    Rows with the same identifier are all kept, next to each other, ordered by the text's hash; rows without identifier have
    the empty key, first of all. A null text is stored as null, an empty one as no tokens, a long one whole; a value ends
    at 2 GB, which a text of 1 GB never reaches. A null meta value stays null. No rows give no shards. Columns beside
    doc_id, text and meta are left out.
    """
    spark = docs.sparkSession
    vocabulary = bpe.loaded(ranks_path or bpe.default_vocabulary())
    shared = spark.sparkContext.broadcast(vocabulary)
    width = 2 if max(vocabulary[0].values()) < 1 << 16 else 4
    meta, kind = tuple(meta), id_type(docs)

    def run(batches):
        return write_shards(batches, bpe.on_worker(shared), meta, width, shard_bytes, block_bytes, NUMBER if kind == "bigint" else TEXT)

    docs = only(docs, "doc_id", "text", *meta)
    order = ["doc_id", F.xxhash64("text")]
    return docs.withColumn("doc_id", docs.doc_id.cast(kind)).repartitionByRange(*order).sortWithinPartitions(*order, "text").mapInArrow(run, _schema(kind))


def _entries(rows: list[tuple], kind: str) -> pa.RecordBatch:
    columns = [pa.array([r[0] for r in rows], pa.int64() if kind == "bigint" else pa.string()), pa.array([r[1] for r in rows], pa.list_(pa.string())), pa.array([r[2] for r in rows], pa.list_(pa.int32()))]
    return pa.record_batch(columns, names=["doc_id", "meta", "token_ids"])


def _read(shards: DataFrame, rows_of) -> DataFrame:
    kind = id_type(shards, "first_doc_id")

    def run(batches):
        for b in batches:
            for data in b.column("sst"):
                held, size = [], 0
                for row in rows_of(SSTable(data.as_py())):
                    held.append(row)
                    size += len(row[2] or ())
                    if size > 1 << 20:
                        yield _entries(held, kind)
                        held, size = [], 0
                if held:
                    yield _entries(held, kind)

    return only(shards, "sst").mapInArrow(run, f"doc_id {kind}, meta array<string>, token_ids array<int>")


def entries(shards: DataFrame) -> DataFrame:
    """doc_id, meta and token_ids of every row of the shards, to join larger sets of identifiers with. Narrow."""
    return _read(shards, lambda t: t.scan())


def lookup(shards: DataFrame, ids: Iterable[int | str | None]) -> DataFrame:
    """doc_id, meta and token_ids of every row with one of the identifiers, of which there are at most MOST_IDS.

    Shards whose range has none of them aren't read: the range is a filter on two columns. In each other one the Bloom
    filter and the block index decide which blocks are unpacked. None stands for rows without identifier; an identifier
    that isn't there gives no row, one that is repeated among ``ids`` counts once, no identifiers give no rows.
    """
    wanted = set(ids)
    if len(wanted) > MOST_IDS:
        raise ValueError(f"{len(wanted)} identifiers are too many for a lookup; join entries() with them")
    known = sorted(i for i in wanted if i is not None)
    first, last = F.col("first_doc_id"), F.col("last_doc_id")
    within = (first.isNull() | (first <= known[-1])) & (last >= known[0]) if known else F.lit(False)
    if None in wanted:
        within = within | first.isNull()

    def rows_of(t: SSTable):
        mine = known
        if known and t.blocks:
            head, tail = next(t.block(0))[0], t.last[-1]
            mine = known[bisect.bisect_left(known, head, key=key_of) : bisect.bisect_right(known, tail, key=key_of)]
        for i in [*([None] if None in wanted else []), *mine]:
            for meta, tokens in t.get(i):
                yield i, meta, tokens

    return _read(shards.where(F.coalesce(within, F.lit(False))), rows_of)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sstable_shards(table(spark, sf_dir, "documents"))
