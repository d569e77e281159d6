"""Shared pieces: scratch space, staged tables, document input, union-find, connected components."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folio.session import scratch_path


def staged(df: DataFrame, name: str, codec: str = "snappy") -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and read it back: cuts lineage, survives lost executors.

    The table goes when the driver ends, or earlier by ``unstaged``.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.option("compression", codec).parquet(path)
    gone_with_driver(df.sparkSession, path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.staged_at = path
    return out


def gone_with_driver(spark: SparkSession, path: str) -> None:
    """Have what lies at ``path`` deleted when the driver ends."""
    files, at = _file_system(spark, path)
    files.deleteOnExit(at)


def unstaged(*tables: DataFrame) -> None:
    """Delete staged tables whose last reader has been written itself."""
    for table in tables:
        files, at = _file_system(table.sparkSession, table.staged_at)
        files.delete(at, True)


def _file_system(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


_holder: list = []


def hold(name: str, release: Callable[[], None]) -> None:
    """The caches of a worker process belong to one operator at a time: those of the one before go."""
    if _holder and _holder[0] != name:
        _holder[1]()
    _holder[:] = [name, release]


def documents_of(docs: DataFrame) -> DataFrame:
    """``doc_id`` long and ``text`` string of a document table, whatever else it holds."""
    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"))


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


class Forest:
    """Union-find over hashable, ordered keys; the root of a set is its smallest key."""

    def __init__(self) -> None:
        self.up: dict = {}

    def find(self, x):
        up, root = self.up, x
        while (above := up.get(root, root)) != root:
            root = above
        while (above := up.get(x, x)) != root:
            up[x] = root
            x = above
        return root

    def union(self, a, b) -> bool:
        """True if ``a`` and ``b`` were apart."""
        a, b = self.find(a), self.find(b)
        if a == b:
            return False
        self.up[max(a, b)] = min(a, b)
        return True

    def edges(self):
        return [(x, self.find(x)) for x in self.up]


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``edges(a, b)`` to ``(node, component)``, the component being the smallest node reachable.

    Alternating large-star and small-star steps; every round is one staged table, and only a count
    and a checksum of the edge set reach the driver. A node without edges has no row. The hot centre
    of a star is one group of an aggregation that combines map-side and one key of a join whose
    many-rowed side adaptive execution may split.
    """
    spark = edges.sparkSession

    def star(pairs: DataFrame, large: bool) -> DataFrame:
        if large:
            near = pairs.select("a", "b").union(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
        else:
            near = pairs.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least = near.groupBy("a").agg(F.min("b").alias("least")).select("a", F.least("a", "least").alias("root"))
        joined = near.join(least, "a")
        if large:
            out = joined.where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("root").alias("b"))
        else:
            out = joined.select(F.col("b").alias("a"), F.col("root").alias("b")).union(
                least.select("a", F.col("root").alias("b"))
            )
        return out.where("a <> b").distinct()

    def seal(pairs: DataFrame):
        row = pairs.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        return tuple(row)

    now = staged(
        edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "cc"
    )
    before = seal(now)
    for _ in range(max_rounds if before[0] else 0):
        last, now = now, staged(star(star(now, True), False), "cc")
        unstaged(last)
        after = seal(now)
        if after == before:
            break
        before = after
    else:
        if before[0]:
            raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = now.select(F.col("b").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(roots)
