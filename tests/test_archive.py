"""Zip archives written from rows."""

import io
import random
import zipfile
import zlib

import pytest
from pyspark.sql import functions as F

from folio.operators import registry_ops as ops
from folio.sources import archive


def test_an_archive_opens_with_a_standard_reader(spark, tmp_path):
    rows = [(i, f"dossier/é {i % 40}.md", None if i == 7 else "" if i == 8 else f"texte {i} " * (i * 50)) for i in range(100)]
    docs = spark.createDataFrame(rows, "id long, filename string, raw_text string").repartition(5)
    found, missing = ops.package(docs, spark.createDataFrame([(i,) for i in (*range(0, 100, 2), 7, 500)], "id long"))
    path = str(tmp_path / "out" / "package.zip")
    for _ in range(2):  # the second replaces the first
        n, size = archive.write_archive(found.selectExpr("target AS name", "raw_text AS body"), path)
    assert n == 51 and [r["id"] for r in missing.collect()] == [500]
    with zipfile.ZipFile(path) as z:
        assert z.testzip() is None and len(z.namelist()) == len(set(z.namelist())) == 51 and z.namelist() == sorted(z.namelist())
        plain = {r["target"]: (r["raw_text"] or "").encode() for r in found.collect()}
        assert {m.filename: (m.CRC, m.file_size) for m in z.infolist()} == {k: (zlib.crc32(v), len(v)) for k, v in plain.items()}
        assert all(z.read(k) == v for k, v in plain.items())
    assert [p.name for p in (tmp_path / "out").iterdir() if not p.name.startswith(".")] == ["package.zip"] and size == (tmp_path / "out" / "package.zip").stat().st_size
    assert {r["name"]: bytes(r["body"]) for r in archive.read_archives(spark, path).collect()} == plain


def test_empty_archives_and_many_members(spark, tmp_path):
    empty = spark.createDataFrame([], "name string, body string")
    assert archive.write_archive(empty, str(tmp_path / "empty.zip"))[0] == 0
    assert zipfile.ZipFile(tmp_path / "empty.zip").namelist() == []
    many = spark.range(66_000).selectExpr("concat('m', id) AS name", "cast(id AS string) AS body")  # more than the plain end can count
    assert archive.write_archive(many, str(tmp_path / "many.zip"))[0] == 66_000
    with zipfile.ZipFile(tmp_path / "many.zip") as z:
        assert len(z.namelist()) == 66_000 and z.read("m65999") == b"65999"


def test_offsets_beyond_four_gigabytes():
    entry = archive._entry(b"a", 1, 2, 3, 1 << 33)
    assert entry.endswith((1 << 33).to_bytes(8, "little")) and entry[42:46] == b"\xff\xff\xff\xff"
    assert archive._end(1, 10, 1 << 33)[:4] == archive.END64.to_bytes(4, "little")


@pytest.fixture(scope="module")
def noise():
    """Forty bodies of 100 kB that can't be deflated, so that their archive has several pieces."""
    return {f"n{i:02}": random.Random(i).randbytes(100_000) for i in range(40)}


def test_no_task_takes_in_a_whole_archive(spark, tmp_path, noise):
    context, path = spark.sparkContext, str(tmp_path / "noise.zip")
    context.setJobGroup("noise", "")
    archive.write_archive(spark.createDataFrame(list(noise.items()), "name string, body binary").repartition(4), path)
    context.setLocalProperty("spark.jobGroup.id", None)
    told = context.statusTracker()
    last = told.getJobInfo(max(told.getJobIdsForGroup("noise")))
    assert told.getStageInfo(max(last.stageIds)).numTasks > 1  # one task wrote all of it before
    rows = archive.read_archives(spark, path).select("*", F.spark_partition_id().alias("task")).collect()
    assert {r["name"]: bytes(r["body"]) for r in rows} == noise and len(rows) == 40
    assert len({r["task"] for r in rows}) > 1  # and one read it


def test_members_of_one_name_keep_their_bodies(spark, tmp_path):
    path = str(tmp_path / "same.zip")
    archive.write_archive(spark.createDataFrame([("a", "one"), ("a", "two"), (None, "x"), ("b", None)], "name string, body string"), path)
    assert sorted((r["name"], bytes(r["body"])) for r in archive.read_archives(spark, path).collect()) == [("a", b"one"), ("a", b"two"), ("b", b"")]


def test_archives_by_other_writers(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "1.zip", "w") as z:
        for k, how in enumerate((zipfile.ZIP_STORED, zipfile.ZIP_DEFLATED, zipfile.ZIP_BZIP2, zipfile.ZIP_LZMA)):
            z.writestr(f"é/{k}", f"{how} " * 1000, how)
        z.mkdir("folder")
        z.comment = b"a comment"
    (tmp_path / "2.zip").write_bytes(b"#!/bin/sh\n" * 99 + (tmp_path / "1.zip").read_bytes()[: -len(z.comment) - 2] + b"\0\0")  # behind a program
    with zipfile.ZipFile(tmp_path / "3.zip", "w") as z, z.open("wide", "w", force_zip64=True) as f:
        f.write(b"w")
    plain = {f"é/{k}": f"{how} ".encode() * 1000 for k, how in enumerate((0, 8, 12, 14))} | {"folder/": b""}
    rows = archive.read_archives(spark, f"{tmp_path}/[123].zip").collect()
    told = {(r["archive"][-5:], r["name"]): bytes(r["body"]) for r in rows}
    assert told == {(a, k): v for a in ("1.zip", "2.zip") for k, v in plain.items()} | {("3.zip", "wide"): b"w"} and len(rows) == 11
    (tmp_path / "no.zip").write_bytes(b"none")
    with pytest.raises(Exception, match="not a zip file"):
        archive.read_archives(spark, str(tmp_path / "no.zip")).collect()


def test_entries_beyond_four_gigabytes_are_found(spark, tmp_path, noise, monkeypatch):
    path = str(tmp_path / "wide.zip")
    monkeypatch.setattr(archive, "FULL", 1_500_000)  # on the driver: segments from there on get long places
    n, size = archive.write_archive(spark.createDataFrame(list(noise.items()), "name string, body binary").repartition(4), path)
    monkeypatch.undo()
    with zipfile.ZipFile(path) as z:
        assert z.testzip() is None and {k: z.read(k) for k in z.namelist()} == noise and z.namelist() == sorted(noise)
        assert len({len(m.extra) for m in z.infolist()}) == 2 and n == 40
    assert {r["name"]: bytes(r["body"]) for r in archive.read_archives(spark, path).collect()} == noise
    far, segment = tmp_path / "far.zip", tmp_path / "segment"
    data = zlib.compress(b"far", wbits=-15)
    segment.write_bytes(archive.struct.pack("<IHHHHHIIIHH", archive.MEMBER, 45, archive.UTF8, archive.DEFLATED, 0, archive.DATE, zlib.crc32(b"far"), len(data), 3, 1, 0) + b"f" + data)
    with open(far, "wb") as out, io.BytesIO() as listing:  # a file with a hole
        out.seek(5 << 30)
        archive._pass_on(f"file:{segment}", out, 5 << 30, listing, True)
        end = out.tell()
        out.write(listing.getvalue() + archive._end(1, len(listing.getvalue()), end))
    with open(far, "rb") as f:
        assert [archive._member(f, *one) for one in archive._listed(f)] == [("f", b"far")]


def test_a_store_that_takes_files_only_from_front_to_end(spark, tmp_path, noise, monkeypatch):
    df = spark.createDataFrame(list(noise.items()), "name string, body binary").repartition(4)
    told = archive.write_archive(df, str(tmp_path / "placed.zip"))
    monkeypatch.setattr(archive, "_local", lambda place: None)  # on the driver
    assert archive.write_archive(df, str(tmp_path / "passed.zip")) == told
    assert archive.write_archive(df.limit(0), str(tmp_path / "none.zip"))[0] == 0 and zipfile.ZipFile(tmp_path / "none.zip").namelist() == []
    assert (tmp_path / "placed.zip").read_bytes() == (tmp_path / "passed.zip").read_bytes()
    assert sorted(p.name for p in tmp_path.iterdir() if not p.name.endswith(".crc")) == ["none.zip", "passed.zip", "placed.zip"]


def test_archives_on_another_store(spark, tmp_path):
    archive.write_archive(spark.createDataFrame([("a", "one"), ("b", "two")], "name string, body string"), str(tmp_path / "in" / "x.zip"))
    spark.sparkContext._jsc.hadoopConfiguration().set("fs.viewfs.mounttable.folio.link./in", f"file://{tmp_path}/in")
    assert sorted((r["name"], bytes(r["body"])) for r in archive.read_archives(spark, "viewfs://folio/in/x.zip").collect()) == [("a", b"one"), ("b", b"two")]
