"""A zip archive of many rows, written and read by ranges, so that no task takes in all of it.

Rows are sorted by ranges of their names. A task deflates its range into a segment beside the target; once the
segments' sizes are known, every segment has its place in the file, and so have its entries of the directory at the
end. On a local or mounted file system each is written there by a task of its own; other stores take a file only from
front to end, so there one task passes the segments on, a member at a time. Only a finished file gets the name, so
tasks that are tried again, or two that run at once, leave one whole archive.
"""

from __future__ import annotations

import io
import itertools
import shutil
import struct
import tempfile
import uuid
import zipfile
import zlib
from collections.abc import Iterator
from typing import BinaryIO

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folio.sources import storage

#: fixed values of the format: signatures of a member, a directory entry and the ends, UTF-8 names, deflated, 1 January 1980
MEMBER, ENTRY, END, END64, LOCATOR = 0x04034B50, 0x02014B50, 0x06054B50, 0x06064B50, 0x07064B50
UTF8, DEFLATED, DATE = 0x800, 8, 0x21
FULL, MANY = 0xFFFFFFFF, 0xFFFF
#: members whose places are within as many bytes are read by one task, which takes several such pieces
PIECE, READ = 1 << 17, 32 << 20


def _entry(name: bytes, crc: int, size: int, packed: int, at: int, wide: bool = False) -> bytes:
    more = struct.pack("<HHQ", 1, 8, at) if wide or at >= FULL else b""
    head = struct.pack("<IHHHHHHIIIHHHHHII", ENTRY, 45, 45, UTF8, DEFLATED, 0, DATE, crc, packed, size, len(name), len(more), 0, 0, 0, 0, FULL if more else at)
    return head + name + more


def _end(count: int, size: int, at: int) -> bytes:
    out = b""
    if count >= MANY or size >= FULL or at >= FULL:
        out = struct.pack("<IQHHIIQQQQ", END64, 44, 45, 45, 0, 0, count, count, size, at) + struct.pack("<IIQI", LOCATOR, 0, at + size, 1)
    few = min(count, MANY)
    return out + struct.pack("<IHHHHIIH", END, 0, 0, few, few, min(size, FULL), min(at, FULL), 0)


def _local(place: str) -> str | None:
    """The path of a place on a local or mounted file system, else none."""
    return "/" + place.removeprefix("file:").lstrip("/") if place.startswith("file:") else None


def _store(place: str):
    from pyarrow import fs

    return (fs.LocalFileSystem(), path) if (path := _local(place)) else fs.FileSystem.from_uri(place)


def _pass_on(segment: str, out: BinaryIO, at: int, listing: BinaryIO, wide: bool) -> None:
    """A segment's members to ``out``, whose place in the archive is ``at``, and their entries to ``listing``."""
    files, where = _store(segment)
    with files.open_input_stream(where, buffer_size=1 << 20) as members:
        while head := members.read(30):
            crc, packed, size, length = struct.unpack("<IIIH", head[14:28])
            name = members.read(length)
            listing.write(_entry(name, crc, size, packed, at, wide))
            out.write(head + name)
            out.write(members.read(packed))
            at += 30 + length + packed


def write_archive(members: DataFrame, path: str) -> tuple[int, int]:
    """``members(name, body)`` as one zip file at ``path``, in order of their names; how many there are, and the file's bytes.

    Names should be unique (``registry_ops.package`` makes them so); rows without a name are left out, null bodies
    are empty. Bodies are text or binary, whole. What was at ``path`` is replaced.
    """
    spark = members.sparkSession
    fs, at = storage.file_system(spark, path)
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(fs.makeQualified(at).getParent(), f".{at.getName()}.{uuid.uuid4().hex}")
    fs.mkdirs(folder)
    beside = folder.toString()

    def deflate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task = TaskContext.get()
        to, out, count, size, names = f"{beside}/{task.taskAttemptId()}", None, 0, 0, 0
        for batch in batches:
            for k in range(batch.num_rows):
                title, body = batch.column("name")[k].as_py().encode(), batch.column("body")[k].as_py()
                packer = zlib.compressobj(6, zlib.DEFLATED, -15)
                data = packer.compress(body) + packer.flush()
                if out is None:
                    files, where = _store(to)
                    out = files.open_output_stream(where)
                out.write(struct.pack("<IHHHHHIIIHH", MEMBER, 45, UTF8, DEFLATED, 0, DATE, zlib.crc32(body), len(data), len(body), len(title), 0) + title)
                out.write(data)
                count, size, names = count + 1, size + 30 + len(title) + len(data), names + len(title)
        if out:
            out.close()
            yield pa.RecordBatch.from_pydict({"part": [task.partitionId()], "segment": [to], "count": [count], "size": [size], "names": [names]})

    try:
        rows = members.where("name is not null").select("name", F.coalesce(F.col("body").cast("binary"), F.lit(b"")).alias("body"))
        segments = rows.orderBy("name", F.crc32("body")).mapInArrow(deflate, "part long, segment string, count long, size long, names long").collect()  # a row a task
        placed, start, entry, total = [], 0, 0, sum(s["size"] for s in segments)
        for s in sorted(segments, key=lambda s: s["part"]):
            wide = start + s["size"] >= FULL
            placed.append((s["segment"], start, total + entry, wide))
            start, entry = start + s["size"], entry + (58 if wide else 46) * s["count"] + s["names"]
        count = sum(s["count"] for s in segments)
        end, whole = _end(count, entry, total), f"{beside}/whole"
        if path_here := _local(whole):
            with open(path_here, "xb") as out:
                out.seek(total + entry)
                out.write(end)

            def put(one: tuple) -> None:
                segment, start, entry, wide = one
                with open(path_here, "r+b") as out, open(path_here, "r+b") as listing:
                    out.seek(start)
                    listing.seek(entry)
                    _pass_on(segment, out, start, listing, wide)

            if placed:
                spark.sparkContext.parallelize(placed, len(placed)).foreach(put)
        else:

            def put_all(all_of_them: Iterator[list]) -> None:
                for each in all_of_them:
                    files, where = _store(whole)
                    with files.open_output_stream(where) as out, tempfile.TemporaryFile() as listing:
                        for segment, start, _, wide in each:
                            _pass_on(segment, out, start, listing, wide)
                        listing.seek(0)
                        shutil.copyfileobj(listing, out)
                        out.write(end)

            spark.sparkContext.parallelize([placed], 1).foreachPartition(put_all)
        fresh = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(whole)
        if fs.exists(at):
            fs.delete(at, False)
        if not fs.rename(fresh, at):
            raise OSError(f"{fresh} could not be renamed")
    finally:
        fs.delete(folder, True)
    return count, fs.getFileStatus(at).getLen()


def _listed(f: BinaryIO) -> Iterator[tuple[int, int, bytes]]:
    """Place, packed size and directory entry of each member of a zip file, entry by entry."""
    length = f.seek(0, io.SEEK_END)
    began = f.seek(max(0, length - 22 - MANY))
    tail = f.read()
    plain, wide = struct.pack("<I", END), struct.pack("<I", END64)
    k = len(tail) - 22 if tail[-22:-18] == plain and tail[-2:] == b"\0\0" else tail.rfind(plain)
    if k < 0 or len(tail) < k + 22:
        raise zipfile.BadZipFile("File is not a zip file")
    (size, at), until = struct.unpack_from("<II", tail, k + 12), began + k
    if until >= 76:
        f.seek(until - 76)
        record = f.read(76)
        if record[:4] == wide and record[56:60] == struct.pack("<I", LOCATOR):
            (size, at), until = struct.unpack_from("<QQ", record, 40), until - 76
    before = until - size - at  # bytes that were put before the archive
    if before < 0:
        raise zipfile.BadZipFile("Bad offset for central directory")
    f.seek(until - size)
    while size > 0:
        head = f.read(46)
        if len(head) < 46 or head[:4] != struct.pack("<I", ENTRY):
            raise zipfile.BadZipFile("Bad magic number for central directory")
        packed, plain_size, name, extra, comment = struct.unpack_from("<IIHHH", head, 20)
        rest = f.read(name + extra + comment)
        (place,) = struct.unpack_from("<I", head, 42)
        k = name
        while k + 4 <= name + extra:
            tag, n = struct.unpack_from("<HH", rest, k)
            if tag == 1:
                big = iter(struct.unpack_from(f"<{n // 8}Q", rest, k + 4))
                plain_size = next(big) if plain_size == FULL else plain_size
                packed = next(big) if packed == FULL else packed
                place = next(big) if place == FULL else place
            k += 4 + n
        yield place + before, packed, head + rest
        size -= 46 + len(rest)


def _member(f: BinaryIO, at: int, packed: int, entry: bytes) -> tuple[str, bytes]:
    """Name and body of the member at a place, which is read as an archive of its own."""
    f.seek(at)
    head = f.read(30)
    if len(head) < 30:
        raise zipfile.BadZipFile("Truncated file header")
    alone = head + f.read(sum(struct.unpack_from("<HH", head, 26)) + packed)
    with zipfile.ZipFile(io.BytesIO(alone + entry[:42] + bytes(4) + entry[46:] + _end(1, len(entry), len(alone)))) as z:
        (member,) = z.infolist()
        return member.filename, z.read(member)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """``archive, name, body`` of the members of zip files.

    On a local or mounted file system a task an archive reads its directory, and members are dealt by their places.
    On other stores an archive is read by one task and must fit it.
    """
    files = spark.read.format("binaryFile").load(path)
    shape = "archive string, name string, body binary"

    def row(source: str, name: str, body: bytes) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"archive": [source], "name": [name], "body": pa.array([body], pa.binary())})

    if storage.file_system(spark, path)[0].getScheme() != "file":

        def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for source, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                    for one in _listed(io.BytesIO(content)):
                        yield row(source, *_member(io.BytesIO(content), *one))

        return files.select("path", "content").mapInArrow(whole, shape)

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for source in batch.column("path").to_pylist():
                with open(_local(source), "rb", buffering=PIECE) as f:
                    entries = _listed(f)
                    while some := list(itertools.islice(entries, 1000)):
                        at, packed, entry = zip(*some, strict=True)
                        yield pa.RecordBatch.from_pydict({"archive": [source] * len(some), "at": at, "packed": packed, "entry": pa.array(entry, pa.binary())})

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = None
        for batch in batches:
            for source, *one in zip(*(batch.column(c).to_pylist() for c in ("archive", "at", "packed", "entry")), strict=True):
                if f is None or f.name != _local(source):
                    if f is not None:
                        f.close()
                    f = open(_local(source), "rb", buffering=PIECE // 4)
                yield row(source, *_member(f, *one))
        if f is not None:
            f.close()

    parts = max(spark.sparkContext.defaultParallelism, (files.agg(F.sum("length")).first()[0] or 0) // READ + 1)
    entries = files.select("path").mapInArrow(listed, "archive string, at long, packed long, entry binary")
    piece = F.pmod(F.crc32(F.col("archive").cast("binary")) + F.expr(f"at div {PIECE}"), F.lit(parts)).cast("int")
    return entries.repartitionById(parts, piece).sortWithinPartitions("archive", "at").mapInArrow(read, shape)
