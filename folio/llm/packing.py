"""Best-fit decreasing packing of documents into fixed-length sequences (op 8).

Best-fit decreasing looks at lengths only, and bins with equal room are interchangeable. So the plan
is made once for the counts of each length (at most ``capacity`` of them): groups of equal bins sit in
a segment tree over remaining capacities, which finds the tightest open room in logarithmic time, and
a step places as many pieces of one length as that room has bins. The plan's size depends on the
capacity, not on the number of documents; each piece then looks up its place by its rank among the
pieces of its length. The result is that of the serial algorithm over all pieces.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folio.llm.common import documents_of, staged
from folio.llm.word_tokens import default_tokenizer, encoder, slices

CAPACITY = 4096


class RoomTree:
    """Segment tree over rooms 0..capacity: which rooms have open bins."""

    def __init__(self, capacity: int) -> None:
        self.leaves = 1 << (capacity + 1 - 1).bit_length()
        if self.leaves < capacity + 1:
            self.leaves *= 2
        self.open = [0] * (2 * self.leaves)

    def set(self, room: int, bins: int) -> None:
        i = room + self.leaves
        self.open[i] = bins
        while i > 1:
            i //= 2
            self.open[i] = self.open[2 * i] + self.open[2 * i + 1]

    def tightest(self, least: int) -> int | None:
        """The smallest room of at least ``least`` that has an open bin."""
        i = least + self.leaves
        if self.open[i]:
            return least
        while i > 1:
            if i % 2 == 0 and self.open[i + 1]:
                i += 1
                while i < self.leaves:
                    i *= 2
                    if not self.open[i]:
                        i += 1
                return i - self.leaves
            i //= 2
        return None


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int]]:
    """Rows ``(length, first_rank, pieces, first_bin, offset)``: pieces ``first_rank + i`` go to bins ``first_bin + i``."""
    tree = RoomTree(capacity)
    groups: dict[int, list[tuple[int, int]]] = {}
    rows, bins = [], 0

    def add(room: int, first: int, n: int) -> None:
        if room:
            groups.setdefault(room, []).append((first, n))
            tree.set(room, tree.open[room + tree.leaves] + n)

    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]
        while left:
            room = tree.tightest(length)
            if room is None:
                # full bins of this length: each takes as many as fit before the next bin opens
                room, fit = capacity, capacity // length
                n = -(-left // fit)
                whole = left // fit
                for k in range(fit):
                    m = n if whole == n or k < left - whole * fit else whole
                    if m:
                        rows.append((length, rank, m, bins, k * length))
                        rank += m
                if whole:
                    add(capacity - fit * length, bins, whole)
                if n > whole:
                    add(capacity - (left - whole * fit) * length, bins + whole, 1)
                bins += n
                left = 0
                continue
            first, n = groups[room].pop()
            take = min(n, left)
            tree.set(room, tree.open[room + tree.leaves] - n)
            if take < n:
                add(room, first + take, n - take)
            rows.append((length, rank, take, first, capacity - room))
            add(room - length, first, take)
            rank, left = rank + take, left - take
    return rows


def pieces_of(docs: DataFrame, tokenizer: str, capacity: int) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32`` and ``part, rank``: its rank among equal lengths in its partition."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part = encoder(tokenizer), TaskContext.get().partitionId()
        seen: Counter[int] = Counter()
        for batch in batches:
            texts, keys = batch.column("text").to_pylist(), batch.column("doc_id").to_pylist()
            out: list[tuple] = []
            for i, j in slices(texts):
                for key, data in zip(keys[i:j], enc.encode(texts[i:j]), strict=True):
                    n = len(data) // 4
                    for piece, start in enumerate(range(0, n, capacity)):
                        length = min(capacity, n - start)
                        crc = zlib.crc32(data[4 * start : 4 * (start + length)])
                        out.append((key, piece, start, length, crc, part, seen[length]))
                        seen[length] += 1
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64())
            names = ("doc_id", "piece", "start", "length", "ids_crc32", "part", "rank")
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(zip(*out, strict=True) if out else [[]] * 7, kinds, strict=True)], names=names
            )

    return documents_of(docs).mapInArrow(
        cut, "doc_id long, piece int, start long, length long, ids_crc32 long, part int, rank long"
    )


def pack(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """Pack whole documents (ids and an end id) into as few sequences of ``capacity`` as best fit finds.

    Null text counts as empty (one end id); a null ``doc_id`` stays null; repeated rows are packed each
    for itself; an empty table gives no rows; other columns are left out. Only documents longer than
    ``capacity`` are cut. The driver sees the counts of each length and the plan, both bounded by the
    capacity.
    """
    spark = docs.sparkSession
    pieces = staged(pieces_of(docs, tokenizer or default_tokenizer(), capacity), "pieces")
    local = pieces.groupBy("length", "part").agg(F.count(F.lit(1)).alias("n"))
    local = staged(local, "lengths")
    counts = {r["length"]: r["n"] for r in local.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    rows = sorted(plan(counts, capacity))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = local.select("length", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    ranked = pieces.join(base, ["length", "part"]).withColumn("rank", F.col("rank") + F.col("before"))
    table = np.array(rows, np.int64).reshape(-1, 5)
    # one sorted key per plan row: rank ranges of equal lengths lie side by side
    width = int(max(counts.values(), default=0)) + 1
    shared = spark.sparkContext.broadcast((table[:, 0] * width + table[:, 1], table, width))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, table, width = shared.value
        for batch in batches:
            length, rank = (batch.column(c).to_numpy() for c in ("length", "rank"))
            at = np.searchsorted(keys, length * width + rank, "right") - 1
            row = table[at]
            columns = {c: batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")}
            columns["sequence_id"] = pa.array(row[:, 3] + rank - row[:, 1], pa.int64())
            columns["offset"] = pa.array(row[:, 4], pa.int64())
            yield pa.RecordBatch.from_pydict(columns)

    return ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "rank").mapInArrow(
        place,
        "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long",
    )
