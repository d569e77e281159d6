"""Near-duplicate embeddings by random-hyperplane sign hashing (op 9).

Equal vectors of a label are one class. In each of several tables a class's bucket is the signs of
its vector against the table's random hyperplanes; members of a bucket are compared exactly, in blocks.
A pair counts in the first table whose buckets agree, so links add up without pairs being listed; only
a spanning star of each block's links goes on to the distributed connected components.

Tables and hyperplanes follow from the number of classes and ``recall``: a bucket keeps about
``bucket`` classes of unrelated directions, and a pair right at the threshold is met in some table with
probability ``recall`` or more.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folio.llm.common import connected_components, shuffle_partitions, staged
from folio.llm.vectors import groups, matrix, unit, vectors_of

THRESHOLD = 0.93
RECALL = 0.9995
BUCKET = 64
BLOCK = 1024
SEED = 20240630


def plan_tables(n: int, threshold: float = THRESHOLD, recall: float = RECALL, bucket: int = BUCKET) -> tuple[int, int]:
    """Hyperplanes a table and tables for ``n`` vectors."""
    bits = max(6, min(30, math.ceil(math.log2(max(2, n / bucket)))))
    meet = (1 - math.acos(threshold) / math.pi) ** bits
    return bits, math.ceil(math.log(1 - recall) / math.log(1 - meet))


def signs(rows: np.ndarray, bits: int, tables: int, seed: int = SEED) -> np.ndarray:
    """Bucket of each row in each table."""
    planes = np.random.default_rng([seed, rows.shape[1]]).normal(size=(rows.shape[1], tables * bits))
    on = (rows @ planes > 0).reshape(len(rows), tables, bits)
    return (on * (1 << np.arange(bits))).sum(axis=2).astype(np.int32)  # at most 30 bits


def spanning_roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest member index of each node's component under edges ``a, b``."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def key_kind(bits: int) -> str:
    """A bucket's number as it travels."""
    return "<u2" if bits <= 16 else "<u4"


def block_links(left: pa.Table, right: pa.Table | None, table: int, threshold: float, kind: str):
    """Links of one block pair: for each row with one, the weight of its partners and its root."""
    both = left if right is None else pa.concat_tables([left, right]).combine_chunks()
    n, split = len(both), len(left)
    v = unit(matrix(both.column("embedding").combine_chunks()))
    rep, weight = both.column("rep").to_numpy(), both.column("weight").to_numpy()
    a, b = (v, v) if right is None else (v[:split], v[split:])
    near = a @ b.T >= threshold
    if right is None:
        near = np.triu(near, 1)
    i, j = np.nonzero(near)
    j = j + (0 if right is None else split)
    if not len(i):
        return None
    mine = np.unique(np.concatenate([i, j]))
    keys = np.frombuffer(b"".join(both.column("keys").take(pa.array(mine)).to_pylist()), kind).reshape(len(mine), -1)
    first = np.empty(len(i), np.int64)
    for at in range(0, len(i), 200_000):
        part = slice(at, at + 200_000)
        first[part] = (keys[np.searchsorted(mine, i[part])] == keys[np.searchsorted(mine, j[part])]).argmax(axis=1)
    mine = first == table
    links = np.bincount(i[mine], weight[j[mine]], n) + np.bincount(j[mine], weight[i[mine]], n)
    order = np.argsort(rep, kind="stable")
    place = np.empty(n, np.int64)
    place[order] = np.arange(n)
    roots = rep[order[spanning_roots(n, place[i], place[j])[place]]]
    hit = np.zeros(n, bool)
    hit[i] = hit[j] = True
    return rep[hit], links[hit].astype(np.int64), roots[hit]


def near_duplicates(table: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL, block: int = BLOCK) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` of every row.

    Vectors with equal non-null labels and cosine ``>= threshold`` in double precision link. Null labels
    and ids, and vectors that are null, zero or hold null or non-finite components, link with nothing: no
    links, themselves as component, kept. Vectors of different lengths don't compare. Rows that share an
    id share its links. An empty table gives no rows; other columns, whatever their names, are left out.
    """
    spark = table.sparkSession
    base = vectors_of(table, "label").withColumn("usable", F.col("usable") & F.col("label").isNotNull())
    base = staged(base.withColumn("label", F.col("label").cast("string")), "vectors")
    live = base.where("usable")
    classes = staged(
        live.groupBy("label", "h1", "h2").agg(
            F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("weight"), F.min_by("embedding", "vec_id").alias("embedding")
        ),
        "classes",
    )
    bits, tables = plan_tables(classes.count(), threshold, recall)
    kind = key_kind(bits)

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = np.array([len(x) for x in batch.column("embedding")], np.int64)
            for size in np.unique(sizes):
                part = batch.take(pa.array(np.flatnonzero(sizes == size)))
                keys = signs(matrix(part.column("embedding")), bits, tables)
                packed = pa.array([row.astype(kind).tobytes() for row in keys], pa.binary())
                listed = pa.ListArray.from_arrays(np.arange(0, keys.size + 1, tables, dtype=np.int32), pa.array(keys.ravel()))
                yield pa.RecordBatch.from_arrays([part.column("rep"), part.column("group"), packed, listed], names=["rep", "group", "keys", "buckets"])

    group = F.xxhash64("label", F.size("embedding")).alias("group")
    keyed = staged(classes.select("rep", group, "embedding").mapInArrow(hashed, "rep long, group long, keys binary, buckets array<int>"), "signs")
    # light rows first: who meets in which bucket, and in which blocks of it
    bucket = ["group", "table", "bucket"]
    met = keyed.select("rep", "group", F.posexplode("buckets").alias("table", "bucket"))
    shared = met.groupBy(*bucket).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    met = (
        met.join(shared, bucket)
        .withColumn("slices", F.ceil(F.col("n") / block).cast("int"))
        .withColumn("slice", F.pmod(F.xxhash64("rep", "table"), F.col("slices")).cast("int"))
    )
    pairs = met.select(
        "rep", "group", "table", "bucket", "slice", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)).alias("other")
    ).select(
        "rep",
        F.xxhash64("group", "table", "bucket", F.least("slice", "other"), F.greatest("slice", "other")).alias("cell"),
        "table",
        F.when(F.col("slice") == F.col("other"), 0).when(F.col("slice") < F.col("other"), 1).otherwise(2).alias("side"),
    )

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (_, number), rows in groups(batches, "cell", "table"):
            side = rows.column("side").to_numpy()
            parts = [rows.filter(pa.array(side == s)) for s in (0, 1, 2)]
            out = []
            if len(parts[0]) > 1:
                out.append(block_links(parts[0], None, int(number), threshold, kind))
            if len(parts[1]) and len(parts[2]):
                out.append(block_links(parts[1], parts[2], int(number), threshold, kind))
            for found in out:
                if found is not None:
                    yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in found], names=["rep", "links", "root"])

    found = (
        pairs.join(classes.select("rep", "weight", "embedding"), "rep")
        .join(keyed.select("rep", "keys"), "rep")
        .repartition(shuffle_partitions(spark), "cell", "table")
        .sortWithinPartitions("cell", "table")
        .mapInArrow(compare, "rep long, links long, root long")
    )
    found = staged(found, "links")
    links = found.groupBy("rep").agg(F.sum("links").alias("links"))
    components = connected_components(found.select(F.col("rep").alias("a"), F.col("root").alias("b")))
    of_class = (
        classes.select("label", "h1", "h2", "rep", "weight")
        .join(links, "rep", "left")
        .join(components.withColumnRenamed("node", "rep"), "rep", "left")
        .select(
            "label",
            "h1",
            "h2",
            (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"),
            F.coalesce("component", "rep").alias("component_id"),
        )
    )
    joined = live.select("vec_id", "label", "h1", "h2").join(of_class, ["label", "h1", "h2"])
    rest = base.where("not usable").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return joined.select("vec_id", "n_links", "component_id").unionByName(rest).withColumn(
        "kept", F.col("vec_id").eqNullSafe(F.col("component_id"))
    )
