"""Chat formatting: conversations rendered by a compiled template, in bounded pieces, and read back (op 13).

Turns are dealt by ranges of their order, so that a conversation of any length spreads over tasks, and each
turn is rendered by itself: its place in the loop (first, last, the roles beside it) comes from its own
partition and, at a partition's ends, from one summary row a partition. Pieces hold whole turns of one
conversation; in the order of ``at`` they make up its formatted text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folio.llm.chat_template import Sink, Template
from folio.llm.common import gone_with_driver, shuffle_partitions, staged
from folio.session import scratch_path

PIECE_CHARS = 1 << 16
BATCH_CHARS = 1 << 21
PIECE = "conv_id long, at long, whole boolean, n_turns long, text string, loss array<struct<start:int,stop:int>>"
PLACED = "conv_id long, role string, text string, part int, row long, run long, edge boolean, previous_role string, last boolean, next_role string"
DIGEST = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def ordered_turns(conversations: DataFrame) -> DataFrame:
    """``conv_id, role, text`` in order of conversation and turn over all partitions; null role and text are empty.

    Null ``conv_id`` and ``turn`` come first. Turns of equal number go by role, the text's first 64 letters, the
    text's hash, and then their place in the table, which parts equal rows over partitions.
    """
    text = F.coalesce(conversations["text"].cast("string"), F.lit(""))
    rows = conversations.select(
        conversations["conv_id"].cast("long").alias("conv_id"),
        conversations["turn"].cast("long").alias("turn"),
        F.coalesce(conversations["role"].cast("string"), F.lit("")).alias("role"),
        text.alias("text"),
        F.substring(text, 1, 64).alias("head"),
        F.xxhash64(text).alias("hash"),
        F.monotonically_increasing_id().alias("place"),
    )
    order = ["conv_id", "turn", "role", "head", "hash", "place"]
    ranged = rows.repartitionByRange(shuffle_partitions(conversations.sparkSession), *order)
    return ranged.sortWithinPartitions(*order).select("conv_id", "role", "text")


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            yield from zip(*(c.to_pylist() for c in part.columns), strict=True)


def _bounded(rows: Iterator[tuple], schema: pa.Schema, weight: int) -> Iterator[pa.RecordBatch]:
    """Batches of about ``BATCH_CHARS`` letters in column ``weight``."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += len(row[weight]) + 64
        if size > BATCH_CHARS:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)


_SPANS = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))
_PIECE = pa.schema([("conv_id", pa.int64()), ("at", pa.int64()), ("whole", pa.bool_()), ("n_turns", pa.int64()), ("text", pa.string()), ("loss", _SPANS)])
_PLACED = pa.schema(
    [("conv_id", pa.int64()), ("role", pa.string()), ("text", pa.string()), ("part", pa.int32()), ("row", pa.int64()), ("run", pa.int64())]
    + [("edge", pa.bool_()), ("previous_role", pa.string()), ("last", pa.bool_()), ("next_role", pa.string())]
)
_DIGEST = pa.schema(
    [("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string())]
    + [("formatted_chars", pa.int64())]
)


def _placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each turn with its number in its conversation within this partition and what stands beside it; null where the partition ends.

    ``edge`` marks the partition's first conversation, which may have begun in an earlier one.
    """
    from pyspark import TaskContext

    part = TaskContext.get().partitionId()

    def rows():
        now, run, edge = None, 0, True
        for row, after in enumerate(_rows(batches)):
            same = now is not None and after[0] == now[0]
            if now is not None:
                yield (*now, not same, after[1] if same else "")
                edge = edge and same
            run = run + 1 if same else 0
            now = (*after, part, row, run, edge, (now[1] if same else "") if now is not None else None)
        if now is not None:
            yield (*now, None, None)

    return _bounded(rows(), _PLACED, 2)


class _Borders:
    """What each partition's first conversation had before it, and its last turn has after it."""

    def __init__(self, summaries: list) -> None:
        self.before: dict[int, tuple[int, str]] = {}
        self.after: dict[int, str | None] = {}
        runs, role, conv, seen = 0, "", None, False
        for s in summaries:
            same = seen and s["first_conv"] == conv
            self.before[s["part"]] = (runs, role) if same else (0, "")
            runs = (runs if same and s["last_edge"] else 0) + s["last_run"] + 1
            role, conv, seen = s["last_role"], s["last_conv"], True
        follows, conv, seen = None, None, False
        for s in reversed(summaries):
            self.after[s["part"]] = follows if seen and conv == s["last_conv"] else None
            follows, conv, seen = s["first_role"], s["first_conv"], True


def _borders(placed: DataFrame) -> _Borders:
    """One row a partition of turns reaches the driver."""
    first = F.struct("row", "conv_id", "role")
    last = F.struct("row", "conv_id", "role", "run", "edge")
    rows = placed.groupBy("part").agg(F.min(first).alias("f"), F.max(last).alias("l")).orderBy("part")
    return _Borders(
        rows.select(
            "part", F.col("f.conv_id").alias("first_conv"), F.col("f.role").alias("first_role"), F.col("l.conv_id").alias("last_conv"),
            F.col("l.role").alias("last_role"), F.col("l.run").alias("last_run"), F.col("l.edge").alias("last_edge"),
        ).collect()
    )


def format_conversations(conversations: DataFrame, template: Template | None = None, piece_chars: int = PIECE_CHARS) -> DataFrame:
    """``conversations(conv_id, turn, role, text)`` as pieces ``conv_id, at, whole, n_turns, text, loss``.

    ``loss`` are spans of code points of ``text`` that the template marks as generated. A piece ends with a turn,
    once it holds ``piece_chars`` letters; ``whole`` says that it is surely its conversation's only one. Null
    roles and texts are empty, a null ``conv_id`` is a conversation of its own, repeated turns all stay, an empty
    table has no pieces, and other columns are not looked at. A turn of any length is rendered whole.
    """
    template = template or Template()
    turns = ordered_turns(conversations)
    borders = None
    placed = turns.mapInArrow(_placed, PLACED)
    if template.needs_place:
        placed = staged(placed, "turns", "zstd")
        borders = _borders(placed)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def pieces():
            sink, turns, at, conv, opened, began = Sink(), 0, 0, None, False, False

            def piece(whole: bool):
                return conv, at, whole, turns, "".join(sink.parts), [{"start": a, "stop": b} for a, b in sink.spans]

            # pieces of a stretch's first and last conversation may have more elsewhere
            first, cut, stretch = True, False, None
            for conv_id, role, text, part, row, run, edge, previous, last, following in _rows(batches):
                broken = stretch != (part, row)
                if turns and (broken or conv_id != conv):
                    yield piece(not (first or cut or broken))
                    first, cut, turns = broken, False, 0
                elif turns and sink.size >= piece_chars:
                    yield piece(False)
                    cut, turns = True, 0
                stretch = (part, row + 1)
                if not turns:
                    sink, at, conv = Sink(), part << 33 | row, conv_id
                loop = None
                if borders:
                    earlier, role_before = borders.before[part] if edge else (0, "")
                    if last is None:
                        following = borders.after[part]
                        last = following is None
                    loop = (run + earlier == 0, last, run + earlier, role_before if previous is None else previous, following or "")
                    if loop[0]:
                        template.head(sink, None, None)
                template.turn(sink, (role, text), loop)
                turns += 1
                if loop and last:
                    template.tail(sink, None, None)
            if turns:
                yield piece(False)

        return _bounded(pieces(), _PIECE, 4)

    return placed.mapInArrow(run, PIECE)


def write_conversations(conversations: DataFrame, path: str, template: Template | None = None) -> None:
    """The pieces of ``format_conversations`` as Parquet, those that are whole conversations apart from the others."""
    format_conversations(conversations, template).write.option("compression", "zstd").partitionBy("whole").parquet(path)


def read_turns(pieces: DataFrame, template: Template | None = None) -> DataFrame:
    """``conv_id, at, k, role, text`` of the turns that the formatted text of pieces holds, ``k`` counted in each piece."""
    read = (template or Template()).reader()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turns = ((c, at, k, *turn) for c, at, text in _rows(batches) for k, turn in enumerate(read(text)))
        return _bounded(turns, pa.schema([("conv_id", pa.int64()), ("at", pa.int64()), ("k", pa.int64()), ("role", pa.string()), ("text", pa.string())]), 4)

    return pieces.select("conv_id", "at", "text").mapInArrow(run, "conv_id long, at long, k long, role string, text string")


def read_digests(spark: SparkSession, path: str, template: Template | None = None) -> DataFrame:
    """What was written to ``path``, read from its text and spans: a row a conversation.

    Hashes are over a conversation's turns in order, so one that spans several pieces goes through one task,
    piece by piece; all others are digested where they lie.
    """
    template = template or Template()
    read, show = template.reader(), template.guard.show

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            now = None
            for conv_id, text, loss in _rows(batches):
                if now is None or now[0] != conv_id:
                    if now is not None:
                        yield tuple(h.hexdigest() if hasattr(h, "hexdigest") else h for h in now)
                    now = [conv_id, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for role, said in read(text):
                    now[1] += 1
                    now[2].update(f"{role}\n{said}\n".encode())
                for span in loss or ():
                    masked = show(text[span["start"] : span["stop"]])
                    now[3] += len(masked)
                    now[4].update(masked.encode())
                now[5] += len(text)
            if now is not None:
                yield tuple(h.hexdigest() if hasattr(h, "hexdigest") else h for h in now)

        return _bounded(rows(), _DIGEST, 2)

    pieces = spark.read.schema(PIECE).parquet(path)
    columns = ["conv_id", "text", "loss"]
    whole = pieces.where("whole").select(*columns).mapInArrow(run, DIGEST)
    rest = pieces.where("not whole").repartition("conv_id").sortWithinPartitions("conv_id", "at").select(*columns)
    return whole.unionByName(rest.mapInArrow(run, DIGEST))


#: a conversation whose texts are control strings
PLANTED = "conv_id long, turn long, role string, text string"
PLANTED_ROWS = [(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")]


def formatted_digest(conversations: DataFrame) -> DataFrame:
    """All conversations and the planted one, written with the chat template, read back and digested."""
    spark = conversations.sparkSession
    ours = conversations.select(
        conversations["conv_id"].cast("long").alias("conv_id"), conversations["turn"].cast("long").alias("turn"),
        conversations["role"].cast("string").alias("role"), conversations["text"].cast("string").alias("text"),
    )
    path = scratch_path(spark, "chats")
    write_conversations(ours.unionByName(spark.createDataFrame(PLANTED_ROWS, PLANTED)), path)
    gone_with_driver(spark, path)
    return read_digests(spark, path)
