"""Numbers within groups, and names that meet neither each other nor files that are there."""

import random

import pytest
from pyspark.sql import functions as F

from folio.operators import registry_ops as ops
from folio.operators.ordering import numbered
from folio.sources import files


def plain_names(rows, occupied=(), mark="_dup"):
    """``rows`` of ``(id, name)``: serial, one row after the other, after the rows that keep their names."""
    taken, out, waiting = {o.lower() for o in occupied}, {}, []
    for i, name in sorted(rows):
        if name.lower() not in taken and name.lower() not in {out[k].lower() for k in out}:
            out[i] = name
        else:
            waiting.append((name.lower(), i, name))
    taken |= {v.lower() for v in out.values()}
    for _, i, name in sorted(waiting):
        stem, dot, end = name.rpartition(".")
        stem, end = (stem, dot + end) if dot and "/" not in end else (name, "")
        k = 1
        while f"{stem}{mark}{k}{end}".lower() in taken:
            k += 1
        out[i] = f"{stem}{mark}{k}{end}"
        taken.add(out[i].lower())
    return out


def named(spark, rows, occupied=(), mark="_dup"):
    files_ = spark.createDataFrame([(o,) for o in occupied], "name string")
    out = ops.free_names(spark.createDataFrame(rows, "id long, filename string"), "filename", "id", files_, mark).collect()
    assert len(out) == len(rows)
    return {r["id"]: r["target"] for r in out}


def test_numbers_equal_row_numbers(spark):
    rng = random.Random(1)
    rows = [(rng.choice(["hot"] * 5 + ["a", "b", None]), rng.randrange(40)) for _ in range(3000)]
    df = spark.createDataFrame(rows, "g string, o int").repartition(5)
    found = numbered(df, ["g"], ["o"]).collect()
    for g in {r[0] for r in rows}:
        mine = sorted((r["n"], r["o"]) for r in found if r["g"] == g)
        assert [n for n, _ in mine] == list(range(1, len(mine) + 1)) and [o for _, o in mine] == sorted(o for k, o in rows if k == g)
    assert numbered(df.limit(0), ["g"], ["o"]).count() == 0


def test_a_name_that_looks_numbered_is_not_given_twice(spark):
    rows = [(1, "a.pdf"), (2, "a.pdf"), (3, "a_dup1.pdf")]
    assert named(spark, rows) == {1: "a.pdf", 2: "a_dup2.pdf", 3: "a_dup1.pdf"}
    assert named(spark, rows, ["A_dup2.PDF", "a_dup4.pdf"]) == {1: "a.pdf", 2: "a_dup3.pdf", 3: "a_dup1.pdf"}


@pytest.mark.parametrize("seed", range(3))
def test_names_are_unique_and_free(spark, seed):
    rng = random.Random(seed)
    stems = ["a", "A", "a_dup1", "a_dup2", "a_dup1_dup1", "b.c", "b", "", "x/y.z/b"]
    rows = [(i, rng.choice(stems) + rng.choice([".pdf", ".PDF", ""])) for i in range(120)]
    occupied = [rng.choice(stems) + rng.choice(["", "_dup1", "_dup3", "_dup07", "_dup4"]) + rng.choice([".pdf", ""]) for _ in range(15)]
    found = named(spark, rows, occupied)
    lower = [v.lower() for v in found.values()]
    assert len(set(lower)) == len(lower) and not set(lower) & {o.lower() for o in occupied}
    assert {i: v.lower() for i, v in found.items()} == {i: v.lower() for i, v in plain_names(rows, occupied).items()}


def test_moves_never_land_on_files(spark):
    moves = spark.createDataFrame([(1, "/x/a.pdf"), (2, "/x/a.pdf"), (3, "/x/b.pdf")], "id long, target string")
    there = spark.createDataFrame([("/x/a_1.pdf",), ("/x/b.pdf",), ("/x/b_20240630000000.pdf",)], "path string")
    out = {r["id"]: r["placed"] for r in ops.without_overwrite(moves, there, F.to_timestamp(F.lit("2024-06-30 00:00:00"))).collect()}
    assert out == {1: "/x/a.pdf", 2: "/x/a_2.pdf", 3: "/x/b_20240630000000_1.pdf"}


def test_markdown_names_clash_after_cleaning(spark):
    rows = [(1, "a b"), (2, "a_b"), (3, "t_4"), (4, "t"), (5, "T"), (6, None), (7, "one")]
    df = spark.createDataFrame(rows, "id long, title string")
    out = {r["id"]: r["name"] for r in files.markdown_names(df).collect()}
    assert len({v.lower() for v in out.values()}) == len(rows)
    assert out == {1: "a_b_1.md", 2: "a_b_2.md", 3: "t_4.md", 4: "t_4_1.md", 5: "T_5.md", 6: ".md", 7: "one.md"}


def test_packages_and_nulls(spark):
    docs = spark.createDataFrame([(1, "a.pdf"), (2, "a.pdf"), (3, "a_1.pdf"), (4, None), (5, None)], "id long, filename string")
    found, missing = ops.package(docs, spark.createDataFrame([(1,), (2,), (3,), (4,), (5,), (9,)], "id long"))
    assert {r["id"]: r["target"] for r in found.collect()} == {1: "a.pdf", 2: "a_2.pdf", 3: "a_1.pdf", 4: None, 5: None} and [r["id"] for r in missing.collect()] == [9]
