"""Token-id output: static range asymmetric numeral system (op 1).

One frequency table over the whole corpus is shared by all blocks. A block holds the ids of whole
documents and is coded by up to ``LANES`` interleaved coders, one per column of the id matrix, so that
numpy advances all of them at once. A block stands alone: it carries a checksum of its table, of its
bytes and of every segment, and the coder states at each checkpoint, from which a reader can start.

Block layout, little-endian: header ``HEADER``; per checkpoint the word offset (u32), crc32 of the
segment's ids (u32) and the lanes' states (u64 each); the code words (u32 each); crc32 of all before.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folio.llm.common import documents_of, gone_with_driver, scratch_path, shuffle_partitions, staged
from folio.llm.word_tokens import default_tokenizer, encoder, slices

MAGIC = b"FRA1"
#: magic, ids, lanes, scale bits, rows a segment, segments, words, crc32 of the table
HEADER = struct.Struct("<4s7I")
LANES = 2048
BLOCK_IDS = 1 << 20
SEGMENT_ROWS = 256
SCALE_BITS = 20
LOW = 1 << 31


class Table:
    """Frequencies scaled to a sum of ``2**bits``; every symbol that occurs keeps at least one."""

    def __init__(self, symbols: np.ndarray, freqs: np.ndarray, bits: int) -> None:
        self.symbols, self.freqs, self.bits = symbols.astype("<u4"), freqs.astype("<u4"), bits
        self.crc = zlib.crc32(self.freqs.tobytes(), zlib.crc32(self.symbols.tobytes()))
        size = int(self.symbols.max()) + 1
        starts = np.concatenate(([0], np.cumsum(freqs)[:-1]))
        self.freq, self.start = np.zeros(size, np.uint64), np.zeros(size, np.uint64)
        self.freq[self.symbols], self.start[self.symbols] = freqs, starts
        self.slots: np.ndarray | None = None

    @classmethod
    def fit(cls, symbols: np.ndarray, counts: np.ndarray, bits: int = SCALE_BITS) -> Table:
        order = np.argsort(symbols)
        symbols, counts = symbols[order], counts[order].astype(np.float64)
        while (1 << bits) < 2 * len(symbols):
            bits += 1
        total = 1 << bits
        freqs = np.maximum(1, np.floor(counts / counts.sum() * total)).astype(np.int64)
        excess = int(freqs.sum()) - total
        if excess < 0:
            freqs[np.argmax(freqs)] -= excess
        while excess > 0:  # take from the largest, where a unit costs least
            for i in np.argsort(-freqs, kind="stable"):
                take = min(excess, int(freqs[i]) // 2)
                freqs[i] -= take
                excess -= take
                if excess == 0:
                    break
        return cls(symbols, freqs, bits)

    def slot_symbols(self) -> np.ndarray:
        if self.slots is None:
            self.slots = np.repeat(self.symbols, self.freqs)
        return self.slots

    def __getstate__(self):
        return self.symbols, self.freqs, self.bits

    def __setstate__(self, state):
        self.__init__(state[0], state[1].astype(np.int64), state[2])


def encode_block(ids: np.ndarray, table: Table, lanes: int = LANES, segment_rows: int = SEGMENT_ROWS) -> bytes:
    n = len(ids)
    lanes = max(1, min(lanes, n // 64))
    rows = -(-n // lanes)
    grid = np.full(rows * lanes, table.symbols[np.argmax(table.freqs)], np.uint32)
    grid[:n] = ids
    grid = grid.reshape(rows, lanes)
    bits, low32, shift = np.uint64(table.bits), np.uint64(0xFFFFFFFF), np.uint64(32)
    room = np.uint64((LOW >> table.bits) << 32)
    state = np.full(lanes, LOW, np.uint64)
    words: list[np.ndarray] = []
    at, marks = 0, []
    for row in range(rows - 1, -1, -1):
        symbols = grid[row]
        freq = table.freq[symbols]
        full = state >= freq * room
        if full.any():
            out = (state[full] & low32).astype("<u4")
            words.append(out)
            at += len(out)
            state[full] >>= shift
        whole, rest = np.divmod(state, freq)
        state = (whole << bits) + rest + table.start[symbols]
        if row % segment_rows == 0:
            crc = zlib.crc32(ids[row * lanes : min(n, (row + segment_rows) * lanes)].astype("<u4").tobytes())
            marks.append((at, crc, state.astype("<u8").tobytes()))
    body = [HEADER.pack(MAGIC, n, lanes, table.bits, segment_rows, len(marks), at, table.crc)]
    body += [struct.pack("<2I", at - before, crc) + states for before, crc, states in reversed(marks)]
    body += [w.tobytes() for w in reversed(words)]
    out = b"".join(body)
    return out + struct.pack("<I", zlib.crc32(out))


def decode_block(data: bytes, table: Table, first: int = 0, last: int | None = None) -> np.ndarray:
    """Ids of segments ``first`` to ``last`` (all by default). Raises ValueError on any damage.

    The whole block's checksum is verified when all of it is decoded; from a checkpoint on, each segment's.
    """
    magic, n, lanes, bits, segment_rows, segments, n_words, crc = HEADER.unpack_from(data)
    whole = first == 0 and last is None
    if magic != MAGIC or whole and zlib.crc32(data[:-4]) != struct.unpack("<I", data[-4:])[0]:
        raise ValueError("damaged block")
    if crc != table.crc:
        raise ValueError("the block was written with another table")
    mark = 8 + 8 * lanes
    words = np.frombuffer(data, "<u4", n_words, HEADER.size + segments * mark).astype(np.uint64)
    rows = -(-n // lanes)
    slots, mask, shift, scale = table.slot_symbols(), np.uint64((1 << bits) - 1), np.uint64(32), np.uint64(bits)
    out, low = [], np.uint64(LOW)
    for k in range(first, segments if last is None else last):
        at, want = struct.unpack_from("<2I", data, HEADER.size + k * mark)
        state = np.frombuffer(data, "<u8", lanes, HEADER.size + k * mark + 8).copy()
        part = np.empty((min(rows, (k + 1) * segment_rows) - k * segment_rows, lanes), np.uint32)
        for row in range(len(part)):
            slot = state & mask
            symbols = slots[slot]
            part[row] = symbols
            state = table.freq[symbols] * (state >> scale) + slot - table.start[symbols]
            short = state < low
            need = int(np.count_nonzero(short))
            if need:
                state[short] = (state[short] << shift) | words[at : at + need]
                at += need
        flat = part.ravel()[: n - k * segment_rows * lanes].astype("<u4")
        if zlib.crc32(flat.tobytes()) != want:
            raise ValueError(f"damaged segment {k}")
        out.append(flat)
    return np.concatenate(out) if out else np.empty(0, "<u4")


def segment_ids(data: bytes) -> int:
    """Ids between two checkpoints of a block."""
    _, _, lanes, _, segment_rows, _, _, _ = HEADER.unpack_from(data)
    return lanes * segment_rows


def ordered_blocks(docs: DataFrame, tokenizer: str) -> DataFrame:
    """Blocks of whole documents' ids in ascending ``doc_id`` order, not yet coded.

    ``part, block, start`` (ids before it in its part), ``doc_ids``, ``lengths``, and ``ids`` in two bytes
    each, or four for a vocabulary over 65,536.
    """

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part = encoder(tokenizer), TaskContext.get().partitionId()
        kind = _kind(enc.size)
        ids: list[bytes] = []
        names: list[int | None] = []
        size = number = start = 0

        def close() -> pa.RecordBatch:
            nonlocal ids, names, size, number, start
            row = {
                "part": pa.array([part], pa.int32()),
                "block": pa.array([number], pa.int32()),
                "start": pa.array([start], pa.int64()),
                "n_ids": pa.array([size], pa.int64()),
                "doc_ids": pa.array([names], pa.list_(pa.int64())),
                "lengths": pa.array([[len(x) // 4 for x in ids]], pa.list_(pa.int64())),
                "payload": pa.array([np.frombuffer(b"".join(ids), "<u4").astype(kind).tobytes()], pa.binary()),
            }
            start, number, size, ids, names = start + size, number + 1, 0, [], []
            return pa.RecordBatch.from_pydict(row)

        for batch in batches:
            texts, keys = batch.column("text").to_pylist(), batch.column("doc_id").to_pylist()
            for i, j in slices(texts):
                for key, data in zip(keys[i:j], enc.encode(texts[i:j]), strict=True):
                    if size and size + len(data) // 4 > BLOCK_IDS:
                        yield close()
                    ids.append(data)
                    names.append(key)
                    size += len(data) // 4
        if size:
            yield close()

    keyed = docs.withColumn("tie", F.xxhash64("text")).withColumn("row", F.monotonically_increasing_id())
    return (
        keyed.repartitionByRange(shuffle_partitions(docs.sparkSession), "doc_id", "tie", "row")
        .sortWithinPartitions("doc_id", "tie", "row")
        .select("doc_id", "text")
        .mapInArrow(blocks, BLOCK_ROW)
    )


BLOCK_ROW = "part int, block int, start long, n_ids long, doc_ids array<long>, lengths array<long>, payload binary"


def _kind(vocabulary: int) -> str:
    return "<u2" if vocabulary <= 1 << 16 else "<u4"


def _raw_ids(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
    """Ids of each block that isn't coded yet."""
    for n, data in zip(batch.column("n_ids").to_pylist(), batch.column("payload"), strict=True):
        buffer = data.as_buffer()
        yield np.frombuffer(buffer, "<u2" if len(buffer) == 2 * n else "<u4")


def token_counts(blocks: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Symbols and their counts over all documents. The driver gets one row per vocabulary entry at most."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1, np.int64)
        for batch in batches:
            for ids in _raw_ids(batch):
                found = np.bincount(ids)
                if len(found) > len(total):
                    total = np.concatenate([total, np.zeros(len(found) - len(total), np.int64)])
                total[: len(found)] += found
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"id": pa.array(seen, pa.int64()), "n": pa.array(total[seen], pa.int64())})

    counted = blocks.select("n_ids", "payload").mapInArrow(count, "id long, n long")
    rows = counted.groupBy("id").agg(F.sum("n").alias("n")).toPandas()
    return rows["id"].to_numpy(np.int64), rows["n"].to_numpy(np.int64)


def write_token_file(docs: DataFrame, path: str, tokenizer: str | None = None, lanes: int = LANES, segment_rows: int = SEGMENT_ROWS) -> None:
    """Encode all documents and write ``path/table`` and ``path/blocks`` in ascending ``doc_id`` order.

    Null text counts as empty; a null ``doc_id`` sorts first; rows with equal ids keep a fixed order by
    text hash. An empty input writes a table and no blocks. Ties are split over partitions, so one
    repeated id does not land in one task. Texts are encoded once: the ids wait in a staged table while
    they are counted. Blocks are rows of binary in Parquet: Spark's commit protocol then covers lost
    executors on any file system. Texts of any length are encoded whole; other columns are left out.
    """
    spark = docs.sparkSession
    raw = staged(ordered_blocks(documents_of(docs), tokenizer or default_tokenizer()), "raw-ids", "zstd")
    symbols, counts = token_counts(raw)
    if not len(symbols):
        symbols, counts = np.array([1]), np.array([1])
    table = Table.fit(symbols, counts)
    spark.createDataFrame(
        [(table.bits, table.symbols.tobytes(), table.freqs.tobytes(), table.crc)],
        "bits int, symbols binary, freqs binary, crc long",
    ).coalesce(1).write.parquet(f"{path}/table")
    shared = spark.sparkContext.broadcast(table)

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, ids in enumerate(_raw_ids(batch)):
                one = batch.slice(k, 1)
                payload = pa.array([encode_block(ids.astype("<u4"), shared.value, lanes, segment_rows)], pa.binary())
                yield pa.RecordBatch.from_arrays([*one.columns[:-1], payload], names=one.schema.names)

    raw.mapInArrow(code, BLOCK_ROW).write.option("compression", "none").parquet(f"{path}/blocks")


def read_token_file(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id, start, ids`` of every document, ``ids`` as little-endian unsigned 32-bit integers in binary.

    ``start`` is the number of ids before the document in the whole file. Only the totals of the
    writing partitions, a number each, pass through the driver.
    """
    row = spark.read.parquet(f"{path}/table").first()
    table = Table(np.frombuffer(row.symbols, "<u4"), np.frombuffer(row.freqs, "<u4").astype(np.int64), row.bits)
    shared = spark.sparkContext.broadcast(table)
    blocks = spark.read.parquet(f"{path}/blocks")
    totals = blocks.groupBy("part").agg(F.sum("n_ids").alias("n")).orderBy("part").collect()
    before, sums = {}, 0
    for part in totals:
        before[part["part"]] = sums
        sums += part["n"]

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        for batch in batches:
            for k in range(batch.num_rows):
                one = batch.slice(k, 1)
                ids = decode_block(one.column("payload")[0].as_py(), table)
                lengths = np.array(one.column("lengths")[0].as_py(), np.int64)
                ends = np.cumsum(lengths)
                first = before[one.column("part")[0].as_py()] + one.column("start")[0].as_py()
                data = ids.tobytes()
                yield pa.RecordBatch.from_pydict(
                    {
                        "doc_id": pa.array(one.column("doc_ids")[0].as_py(), pa.int64()),
                        "start": pa.array(first + ends - lengths, pa.int64()),
                        "ids": pa.array([data[4 * (e - n) : 4 * e] for e, n in zip(ends, lengths, strict=True)], pa.binary()),
                    }
                )

    return blocks.select("part", "start", "doc_ids", "lengths", "payload").mapInArrow(
        decode, "doc_id long, start long, ids binary"
    )


def read_documents(spark: SparkSession, path: str, doc_ids: list[int]) -> DataFrame:
    """``doc_id, ids`` of some documents: only their blocks are read, and of these only their segments decoded."""
    row = spark.read.parquet(f"{path}/table").first()
    table = Table(np.frombuffer(row.symbols, "<u4"), np.frombuffer(row.freqs, "<u4").astype(np.int64), row.bits)
    shared = spark.sparkContext.broadcast((table, frozenset(doc_ids)))

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, wanted = shared.value
        for batch in batches:
            for k in range(batch.num_rows):
                data, names = batch.column("payload")[k].as_py(), batch.column("doc_ids")[k].as_py()
                ends = np.cumsum(batch.column("lengths")[k].as_py())
                size = segment_ids(data)
                found, ids = [], []
                for i, name in enumerate(names):
                    if name in wanted:
                        low, high = int(ends[i - 1]) if i else 0, int(ends[i])
                        first, last = low // size, -(-high // size)
                        part = decode_block(data, table, first, last)
                        found.append(name)
                        ids.append(part[low - first * size : high - first * size].tobytes())
                yield pa.RecordBatch.from_pydict({"doc_id": pa.array(found, pa.int64()), "ids": pa.array(ids, pa.binary())})

    blocks = spark.read.parquet(f"{path}/blocks").where(F.arrays_overlap("doc_ids", F.lit(list(doc_ids)).cast("array<bigint>")))
    return blocks.select("doc_ids", "lengths", "payload").mapInArrow(decode, "doc_id long, ids binary")


def token_file_digest(docs: DataFrame, tokenizer: str | None = None, path: str | None = None) -> DataFrame:
    """Write ``docs`` to a token file, read it back, and return ``doc_id, start, n_tokens, ids_crc32``.

    Nulls, ties, repeated rows and empty tables as in ``write_token_file``; texts of any length are encoded whole;
    other columns, whatever their names, are left out. Without a ``path`` the file goes with the driver.
    """
    spark = docs.sparkSession
    at = path or scratch_path(spark, "token-file")
    write_token_file(docs, at, tokenizer)
    if path is None:
        gone_with_driver(spark, at)
    return read_token_file(spark, at).select(
        "doc_id", "start", F.expr("cast(octet_length(ids) / 4 as bigint)").alias("n_tokens"), F.crc32("ids").alias("ids_crc32")
    )
