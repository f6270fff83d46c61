"""Token ids in a binary file format: a static range asymmetric numeral system over interleaved lanes.

Documents are dealt to shards by ranges of their id, so shard after shard holds them in ascending order.  A shard is a
sequence of segments of whole documents, about ``SEGMENT`` ids each; a segment is one row of a Parquet table (any shared
store can hold it, and rows are read in parallel), and its payload is:

    magic, counts, bytes of an id | frequency table | document ids and lengths | block index | blocks

The frequency table counts all ids of the segment and is shared by its blocks.  Each block codes ``BLOCK`` ids in ``LANES``
interleaved lanes with 32-bit words, on its own: the block index has its size, its checksum and that of its ids, and the
lanes' states and the word position every ``SECTION`` steps, so that sections of a block can be decoded apart.  Ids take two
bytes, or four where the vocabulary is larger than 65,536.  Frequencies sum to ``2**BITS``, or to the power of two that is
twice as many as a segment has different ids, if that is more; the sum itself tells which.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from findmark.llm.shared import lean, scratch_dir
from findmark.llm.tokens import encoder

MAGIC = b"FMRANS02"
#: Bits of the frequencies' common total, at least.
BITS = 18
LANES, BLOCK, SECTION, SEGMENT = 1024, 1 << 17, 64, 1 << 20
_LOW = np.uint64(1 << 31)
_U = np.uint64
FILE_SCHEMA = "shard int, segment int, first_id long, last_id long, n_docs int, n_tokens long, payload binary"


def frequencies(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct ids and their frequencies, at least one each, with a sum of a power of two."""
    counts = np.bincount(ids)
    symbols = np.flatnonzero(counts)
    n = counts[symbols]
    total = max(1 << BITS, 1 << (2 * len(symbols) - 1).bit_length())
    f = np.maximum(1, n * total // n.sum())
    over = int(f.sum()) - total
    if over < 0:
        f[np.argmax(f)] -= over
    while over > 0:
        at = np.argsort(-f, kind="stable")[: max(1, min(over, int((f > 1).sum())))]
        cut = np.minimum(f[at] - 1, np.maximum(1, over // len(at)))
        cut = np.minimum(cut, np.maximum(0, over - (np.cumsum(cut) - cut)))
        f[at] -= cut
        over -= int(cut.sum())
    return symbols.astype(ids.dtype), f.astype("<u4")


class Table:
    """Look-ups of a frequency table for both directions."""

    def __init__(self, symbols: np.ndarray, f: np.ndarray):
        begin = np.cumsum(f, dtype=np.uint64) - f
        self.rank = np.zeros(int(symbols.max(initial=0)) + 1, np.int32)
        self.rank[symbols] = np.arange(len(symbols))
        self.symbols, self.f, self.begin = symbols, f.astype(np.uint64), begin
        self.bits = int(f.sum(dtype=np.int64)).bit_length() - 1
        self.at_slot = np.repeat(np.arange(len(symbols), dtype=np.int32), f)


def encode_block(ids: np.ndarray, table: Table) -> bytes:
    """One block: its words, with the lanes' states at each section's start."""
    r = table.rank[ids]
    f, begin = table.f[r], table.begin[r]
    bits = _U(table.bits)
    most = f << (_U(63) - bits)
    x = np.full(LANES, _LOW, np.uint64)
    steps = -(-len(ids) // LANES)
    words, states = [], []
    for t in range(steps - 1, -1, -1):
        a, b = t * LANES, min((t + 1) * LANES, len(ids))
        own, ft = x[: b - a], f[a:b]
        over = own >= most[a:b]
        words.append(own[over].astype("<u4"))
        own = np.where(over, own >> _U(32), own)
        q = own // ft
        x[: b - a] = (q << bits) + (own - q * ft) + begin[a:b]
        if t % SECTION == 0:
            states.append(x.copy())
    words.reverse()
    states.reverse()
    at = np.cumsum([0] + [len(w) for w in words])[: steps : SECTION]
    stream = np.concatenate(words) if words else np.zeros(0, "<u4")
    return struct.pack("<II", len(ids), len(states)) + at.astype("<u4").tobytes() + np.concatenate(states).astype("<u8").tobytes() + stream.tobytes()


def decode_block(raw: bytes, table: Table, section: int | None = None) -> np.ndarray:
    """The ids of a block, or of one of its sections."""
    n, sections = struct.unpack_from("<II", raw)
    at = np.frombuffer(raw, "<u4", sections, 8)
    states = np.frombuffer(raw, "<u8", sections * LANES, 8 + 4 * sections).reshape(sections, LANES)
    words = np.frombuffer(raw, "<u4", offset=8 + 4 * sections + 8 * sections * LANES).astype(np.uint64)
    out = np.empty(n, np.int32)
    bits, mask = _U(table.bits), _U((1 << table.bits) - 1)
    for s in range(sections) if section is None else [section]:
        x, w = states[s].astype(np.uint64), int(at[s])
        for t in range(s * SECTION, min((s + 1) * SECTION, -(-n // LANES))):
            a, b = t * LANES, min((t + 1) * LANES, n)
            own = x[: b - a]
            slot = own & mask
            r = table.at_slot[slot]
            own = table.f[r] * (own >> bits) + slot - table.begin[r]
            need = np.flatnonzero(own < _LOW)
            own[need] = (own[need] << _U(32)) | words[w : w + len(need)]
            w += len(need)
            x[: b - a] = own
            out[a:b] = r
    if section is not None:
        out = out[section * SECTION * LANES : (section + 1) * SECTION * LANES]
    return table.symbols[out]


def pack_segment(doc_ids: np.ndarray, lengths: np.ndarray, ids: np.ndarray) -> bytes:
    """The payload of a segment."""
    symbols, f = frequencies(ids)
    table = Table(symbols, f)
    heads = [zlib.compress(symbols.tobytes() + f.tobytes(), 1), zlib.compress(doc_ids.astype("<i8").tobytes() + lengths.astype("<u4").tobytes(), 1)]
    blocks, index = [], []
    for a in range(0, len(ids), BLOCK):
        blocks.append(encode_block(ids[a : a + BLOCK], table))
        index.append(struct.pack("<III", len(blocks[-1]), zlib.crc32(blocks[-1]), zlib.crc32(ids[a : a + BLOCK].tobytes())))
    return b"".join([MAGIC, struct.pack("<IIIIII", len(symbols), len(doc_ids), len(blocks), ids.itemsize, *map(len, heads)), *heads, *index, *blocks])


def unpack_segment(raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(document ids, lengths, ids)`` of a segment; a wrong checksum raises ``ValueError``."""
    if raw[:8] != MAGIC:
        raise ValueError("not a segment of token ids")
    n_symbols, n_docs, n_blocks, width, a, b = struct.unpack_from("<IIIIII", raw, 8)
    at, kind = 32, f"<u{width}"
    head = zlib.decompress(raw[at : at + a])
    table = Table(np.frombuffer(head, kind, n_symbols), np.frombuffer(head, "<u4", n_symbols, width * n_symbols))
    docs = zlib.decompress(raw[at + a : at + a + b])
    at += a + b
    index = [struct.unpack_from("<III", raw, at + 12 * i) for i in range(n_blocks)]
    at += 12 * n_blocks
    parts = []
    for size, crc, crc_ids in index:
        block = raw[at : at + size]
        if zlib.crc32(block) != crc:
            raise ValueError("a block's checksum is wrong")
        parts.append(decode_block(block, table))
        if zlib.crc32(parts[-1].tobytes()) != crc_ids:
            raise ValueError("a block's ids do not have their checksum")
        at += size
    ids = np.concatenate(parts) if parts else np.zeros(0, kind)
    return np.frombuffer(docs, "<i8", n_docs), np.frombuffer(docs, "<u4", n_docs, 8 * n_docs), ids


def write_token_ids(docs: DataFrame, tokenizer_path: str, path: str | None = None, end_id: int = 0) -> str:
    """Encodes the texts of ``docs(doc_id, text)`` and writes the ids; returns the table's path.

    Null text is the empty text; rows without ``doc_id`` have no place in the order and are left out; rows that share an
    id stand beside each other, ordered by a hash of the text; an empty table gives an empty table of segments.  A text of any
    length is encoded whole and stays in one segment.  Other columns are not read.
    """
    path = path or f"{scratch_dir(docs.sparkSession)}/token-ids-{uuid.uuid4().hex}"

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, segment = TaskContext.get().partitionId(), 0
        tokens = encoder(tokenizer_path, end_id)
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

        def closed() -> pa.RecordBatch:
            doc_ids, lengths, ids = (np.concatenate(x) for x in zip(*held))
            row = [shard, segment, int(doc_ids[0]), int(doc_ids[-1]), len(doc_ids), len(ids), pack_segment(doc_ids, lengths, ids)]
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary()]
            return pa.record_batch([pa.array([v], k) for v, k in zip(row, kinds)], ["shard", "segment", "first_id", "last_id", "n_docs", "n_tokens", "payload"])

        size = 0
        for batch in batches:
            ids, ends = tokens.encode(batch.column(1))
            begins = np.append(0, ends[:-1]) if len(ends) else ends
            doc_ids, a = batch.column(0).to_numpy(), 0
            while a < len(ends):
                b = max(a + 1, int(np.searchsorted(ends, begins[a] + SEGMENT - size, "right")))
                held.append((doc_ids[a:b], (ends[a:b] - begins[a:b]), ids[begins[a] : ends[b - 1]]))
                size += int(ends[b - 1] - begins[a])
                a = b
                if size >= SEGMENT * 0.9:
                    yield closed()
                    held, size, segment = [], 0, segment + 1
        if held:
            yield closed()

    ranged = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text")).where("doc_id is not null").repartitionByRange("doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", F.xxhash64("text"))
    ranged.mapInArrow(lean(encode, keeps=True), FILE_SCHEMA).write.option("compression", "none").parquet(path)
    return path


def read_token_ids(spark, path: str) -> DataFrame:
    """What ``write_token_ids`` wrote: ``doc_id, start, n_tokens, width, ids``: binary, little-endian, ``width`` bytes an id.

    ``start`` counts the ids of all documents before it.
    """
    files = spark.read.schema(FILE_SCHEMA).parquet(path)

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, segment, raw in zip(*(batch.column(i).to_pylist() for i in range(3))):
                doc_ids, lengths, ids = unpack_segment(raw)
                ends = np.cumsum(lengths, dtype=np.int64)
                begins = ends - lengths
                n = len(doc_ids)
                yield pa.record_batch(
                    [pa.array(np.full(n, shard, np.int32)), pa.array(np.full(n, segment, np.int32)), pa.array(doc_ids), pa.array(begins), pa.array(lengths.astype(np.int64)), pa.array(np.full(n, ids.itemsize, np.int32)), pa.array([ids[a:b].tobytes() for a, b in zip(begins.tolist(), ends.tolist())], pa.binary())],
                    ["shard", "segment", "doc_id", "local", "n_tokens", "width", "ids"],
                )

    rows = files.select("shard", "segment", "payload").mapInArrow(decode, "shard int, segment int, doc_id long, local long, n_tokens long, width int, ids binary")
    return rows.join(segment_starts(files), ["shard", "segment"]).select("doc_id", (F.col("base") + F.col("local")).alias("start"), "n_tokens", "width", "ids")


def segment_starts(files: DataFrame) -> DataFrame:
    """``(shard, segment, base)``: ids before each segment, by sums within shards, within runs of shards, and over the runs."""
    run = F.expr("shard div 1024").alias("run")
    segments = files.select("shard", "segment", "n_tokens", run)
    shards = segments.groupBy("run", "shard").agg(F.sum("n_tokens").alias("n"))
    runs = shards.groupBy("run").agg(F.sum("n").alias("n"))
    before = lambda n, w: F.coalesce(F.sum(n).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    runs = runs.select("run", before("n", Window.orderBy("run")).alias("base_run"))
    shards = shards.select("run", "shard", before("n", Window.partitionBy("run").orderBy("shard")).alias("base_shard"))
    within = segments.select("run", "shard", "segment", before("n_tokens", Window.partitionBy("shard").orderBy("segment")).alias("base_segment"))
    return within.join(shards, ["run", "shard"]).join(runs, "run").select("shard", "segment", (F.col("base_run") + F.col("base_shard") + F.col("base_segment")).alias("base"))


def token_digests(spark, path: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` read back from the files; the checksum is over four-byte ids."""
    files = spark.read.schema(FILE_SCHEMA).parquet(path)

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, segment, raw in zip(*(batch.column(i).to_pylist() for i in range(3))):
                doc_ids, lengths, ids = unpack_segment(raw)
                ends = np.cumsum(lengths, dtype=np.int64)
                begins, wide = ends - lengths, memoryview(ids.astype("<u4").tobytes())
                n = len(doc_ids)
                crc = [zlib.crc32(wide[4 * a : 4 * b]) for a, b in zip(begins.tolist(), ends.tolist())]
                yield pa.record_batch(
                    [pa.array(np.full(n, shard, np.int32)), pa.array(np.full(n, segment, np.int32)), pa.array(doc_ids), pa.array(begins), pa.array(lengths.astype(np.int64)), pa.array(crc, pa.int64())],
                    ["shard", "segment", "doc_id", "local", "n_tokens", "crc"],
                )

    rows = files.select("shard", "segment", "payload").mapInArrow(digest, "shard int, segment int, doc_id long, local long, n_tokens long, crc long")
    return rows.join(segment_starts(files), ["shard", "segment"]).select("doc_id", (F.col("base") + F.col("local")).alias("start"), "n_tokens", F.col("crc").alias("ids_crc32"))
