"""Tables in versions: immutable files by bucket, and one small manifest a commit that is put exactly once.

``path/commit=<name>/bucket=<k>`` hold rows whose key falls into a bucket; ``path/_manifest/<version>`` says
which of them a commit adds and removes, and every ``SNAPSHOT``-th one what is live altogether. A version is
what its manifests say, whatever is written meanwhile, so a reader keeps the version that it began with. Two
writers that aim at one number are told apart by the file system; the later one looks whether the other
touched its buckets, and only then has to look at the table again.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folio.sources import storage

BUCKETS = 64
SNAPSHOT = 16
KEPT = 100


class Conflict(RuntimeError):
    """Another commit touched the same buckets since the version that this one was made from."""


class Fenced(RuntimeError):
    """A later owner of the table's lease has committed; this writer has lost it."""


@dataclass(frozen=True)
class State:
    """A version: its live folders ``(commit, bucket)``, each writer's last batch, and the highest fencing number."""

    version: int = -1
    live: frozenset[tuple[str, int]] = frozenset()
    writers: dict[str, tuple[int, str]] = field(default_factory=dict)  # writer: (batch, commit)
    fence: int = 0

    def after(self, change: dict) -> State:
        live = (self.live - {tuple(x) for x in change["removed"]}) | {tuple(x) for x in change["added"]}
        writers = dict(self.writers)
        if change.get("writer") is not None:
            writers[change["writer"]] = (change["number"], change["commit"])
        return State(change["version"], live, writers, max(self.fence, change.get("fence") or 0))

    def has(self, writer: str, number: int) -> bool:
        """Whether a batch was committed; a writer's batches come in order."""
        return writer in self.writers and self.writers[writer][0] >= number


def state_of(spark: SparkSession, path: str, version: int | None = None) -> State:
    """The newest version or a given one. Without any manifest the table is empty; a manifest that can't be read raises."""
    numbers = [int(n) for n in storage.names_in(spark, f"{path}/_manifest")]
    if version is not None:
        numbers = [n for n in numbers if n <= version]
        if version >= 0 and version not in numbers:
            raise ValueError(f"no version {version} of {path}")
    chain: list[dict] = []
    state = State()
    for n in reversed(numbers):
        change = json.loads(storage.read_text(spark, f"{path}/_manifest/{n:010d}"))
        if "live" in change:
            live = frozenset((c, b) for c, b in change["live"])
            state = State(n, live, {w: tuple(v) for w, v in change["writers"].items()}, change["fence"])
            break
        chain.append(change)
    for change in reversed(chain):
        state = state.after(change)
    return state


def bucket_of(key: Column, buckets: int = BUCKETS) -> Column:
    """The bucket of a key; rows without one share bucket 0."""
    return F.coalesce(F.pmod(F.crc32(key.cast("string").cast("binary")), F.lit(buckets)), F.lit(0)).cast("int")


def write_files(rows: DataFrame, path: str, key: str, buckets: int = BUCKETS) -> tuple[str, list[int]]:
    """Write ``rows`` beside the live ones: the new folder's name and its buckets. Nothing sees it before its commit."""
    spark, commit = rows.sparkSession, uuid.uuid4().hex
    at = f"{path}/commit={commit}"
    # a bucket's rows may be many: the rebalance splits them over tasks, so none is collected
    rows.withColumn("bucket", bucket_of(F.col(key), buckets)).hint("rebalance", "bucket").write.partitionBy("bucket").parquet(at)
    return commit, [int(n.removeprefix("bucket=")) for n in storage.names_in(spark, at) if n.startswith("bucket=")]


def commit(
    spark: SparkSession,
    path: str,
    base: State,
    added: set[tuple[str, int]],
    removed: set[tuple[str, int]] = frozenset(),
    writer: str | None = None,
    number: int | None = None,
    touched: set[int] | None = None,
    fence: int | None = None,
    note: str | None = None,
) -> State:
    """Put the next version. ``touched`` are the buckets whose rows the change depends on, by default those it adds to or removes from.

    A batch that ``writer`` has committed before changes nothing. Raises ``Conflict`` if another commit since
    ``base`` changed a touched bucket, ``Fenced`` if one had a higher fencing number than the given one.
    """
    touched = touched if touched is not None else {b for _, b in added | removed}
    now = base
    while True:
        if writer is not None and now.has(writer, number):
            return now
        if fence is not None and fence < now.fence:
            raise Fenced(path)
        change = {
            "version": now.version + 1, "commit": next(iter(c for c, _ in added), ""), "added": sorted(added), "removed": sorted(removed),
            "writer": writer, "number": number, "fence": fence, "note": note,
        }
        after = now.after(change)
        if after.version % SNAPSHOT == 0:
            change |= {"live": sorted(after.live), "writers": after.writers, "fence": after.fence}
        if storage.put_once(spark, f"{path}/_manifest/{after.version:010d}", json.dumps(change)):
            return after
        now = state_of(spark, path)
        ours = writer is not None and now.has(writer, number)
        if not ours and {b for _, b in base.live ^ now.live} & touched:
            raise Conflict(path)


def rows_of(spark: SparkSession, path: str, schema: str, state: State | None = None, buckets: set[int] | None = None, without: str | None = None) -> DataFrame:
    """``schema`` and ``bucket`` of a version's rows, of some buckets and without one commit's: only their folders are read."""
    state = state if state is not None else state_of(spark, path)
    return _folders(spark, path, schema, {(c, b) for c, b in state.live if (buckets is None or b in buckets) and c != without})


def _folders(spark: SparkSession, path: str, schema: str, live: set[tuple[str, int]]) -> DataFrame:
    if not live:
        return spark.createDataFrame([], f"{schema}, bucket int")
    reader = spark.read.schema(f"{schema}, commit string, bucket int").option("basePath", path)
    return reader.parquet(*(f"{path}/commit={c}/bucket={b}" for c, b in sorted(live))).drop("commit")


def append(rows: DataFrame, path: str, key: str, writer: str | None = None, number: int | None = None, fence: int | None = None, note: str | None = None) -> State:
    """Add rows, whatever the table holds."""
    spark = rows.sparkSession
    state = state_of(spark, path)
    if writer is not None and state.has(writer, number):
        return state
    name, found = write_files(rows, path, key)
    return commit(spark, path, state, {(name, b) for b in found}, frozenset(), writer, number, set(), fence, note)


def update(
    spark: SparkSession, path: str, schema: str, key: str, change: Callable[[DataFrame], DataFrame], touched: Callable[[DataFrame], DataFrame] | None = None, note: str | None = None, attempts: int = 5
) -> State:
    """Replace the rows of some buckets by what ``change`` makes of them.

    ``touched`` picks the rows that change, from a table of the whole version; only buckets that hold one are
    rewritten, and only the columns that it looks at are read to find them. By default all buckets are.
    ``change`` must leave each row's key in its bucket, or the row in any: new rows go where their key says.
    """
    for _ in range(attempts):
        state = state_of(spark, path)
        buckets = {b for _, b in state.live}
        if touched is not None:
            found = touched(rows_of(spark, path, schema, state)).select("bucket").distinct().collect()
            buckets = {r["bucket"] for r in found}
        if touched is not None and not buckets:
            return state
        old = {(c, b) for c, b in state.live if b in buckets}
        name, fresh = write_files(change(rows_of(spark, path, schema, state, buckets).drop("bucket")), path, key)
        try:
            return commit(spark, path, state, {(name, b) for b in fresh}, old, touched=buckets | set(fresh), note=note)
        except Conflict:
            storage.delete(spark, f"{path}/commit={name}")
    raise Conflict(path)


def compact(spark: SparkSession, path: str, schema: str, key: str, most: int = 8) -> State:
    """Rewrite the buckets that lie in more than ``most`` folders as one folder each; rows stay what they are."""
    state = state_of(spark, path)
    folders: dict[int, int] = {}
    for _, b in state.live:
        folders[b] = folders.get(b, 0) + 1
    crowded = {b for b, n in folders.items() if n > most}
    if not crowded:
        return state
    name, fresh = write_files(rows_of(spark, path, schema, state, crowded).drop("bucket"), path, key)
    old = {(c, b) for c, b in state.live if b in crowded}
    return commit(spark, path, state, {(name, b) for b in fresh}, old, touched=crowded, note="compact")


def changes(spark: SparkSession, path: str, schema: str, since: int, until: int | None = None, key: str = "id") -> DataFrame:
    """``change, key`` columns and the newer row of every row that differs between two versions: ``insert``, ``update`` or ``delete``.

    Only folders that one of the versions has and the other has not are read. ``key`` names a row; rows that were
    rewritten as they were are no change. Rows of equal key are told apart by their content, as inserted and deleted.
    """
    columns = [c.strip().split(" ")[0] for c in _top_level(schema)]
    before, after = state_of(spark, path, since), state_of(spark, path, until)
    row = F.struct(*columns)
    # occurrences of each row on both sides; what is on both sides as often cancels out
    old = _folders(spark, path, schema, set(before.live - after.live)).select(row.alias("row"), F.lit(-1).alias("n"))
    new = _folders(spark, path, schema, set(after.live - before.live)).select(row.alias("row"), F.lit(1).alias("n"))
    seal = F.sha2(F.to_json("row", {"ignoreNullFields": "false"}), 256)
    left = old.union(new).groupBy(seal.alias("seal")).agg(F.sum("n").alias("n"), F.any_value("row").alias("row")).where("n <> 0")
    sides = left.groupBy(F.col(f"row.{key}").alias("key")).agg(
        F.coalesce(F.sum(F.when(F.col("n") > 0, F.col("n"))), F.lit(0)).alias("came"),
        F.coalesce(F.sum(F.when(F.col("n") < 0, -F.col("n"))), F.lit(0)).alias("went"),
    )
    joined = left.join(sides, left[f"row.{key}"].eqNullSafe(sides["key"]))
    one = (F.col("came") == 1) & (F.col("went") == 1)
    kind = F.when(one & (F.col("n") > 0), "update").when(F.col("n") > 0, "insert").when(~one, "delete")
    return joined.select(kind.alias("change"), "key", F.abs("n").alias("times"), "row.*").where("change is not null")


def _top_level(schema: str) -> list[str]:
    """The fields of a schema string, split at its outer commas."""
    out, depth = [""], 0
    for c in schema:
        depth += (c in "<(") - (c in ">)")
        if c == "," and not depth:
            out.append("")
        else:
            out[-1] += c
    return out


def vacuum(spark: SparkSession, path: str, keep: int = KEPT) -> int:
    """Delete folders that none of the last ``keep`` versions has; how many went. Readers of older versions lose theirs.

    Folders of writers at work have no version yet: run it when none is.
    """
    last = state_of(spark, path).version
    live = {x for v in range(max(last - keep + 1, 0), last + 1) for x in state_of(spark, path, v).live} if last >= 0 else set()
    gone = 0
    for folder in [n for n in storage.names_in(spark, path) if n.startswith("commit=")]:
        name, at = folder.removeprefix("commit="), f"{path}/{folder}"
        buckets = [n for n in storage.names_in(spark, at) if n.startswith("bucket=")]
        dead = [n for n in buckets if (name, int(n.removeprefix("bucket="))) not in live]
        for n in [f"{at}/{n}" for n in dead] if len(dead) < len(buckets) else [at]:
            storage.delete(spark, n)
        gone += len(dead)
    return gone


# -- whole tables behind one pointer -----------------------------------------------------------------


def publish(spark: SparkSession, path: str, write: Callable[[str], None], keep: int = KEPT) -> int:
    """Write a table anew beside the old one and put the next pointer to it: readers have the old version or the new one, whole.

    The last ``keep`` versions stay for readers that began with them. Returns the version.
    """
    name = uuid.uuid4().hex
    write(f"{path}/{name}")
    while True:
        numbers = [int(n) for n in storage.names_in(spark, f"{path}/_manifest")]
        version = numbers[-1] + 1 if numbers else 0
        if storage.put_once(spark, f"{path}/_manifest/{version:010d}", name):
            break
    for n in [n for n in numbers if n <= version - keep]:
        old = storage.read_text(spark, f"{path}/_manifest/{n:010d}")
        storage.delete(spark, f"{path}/_manifest/{n:010d}")
        storage.delete(spark, f"{path}/{old}")
    return version


def current(spark: SparkSession, path: str, version: int | None = None) -> str | None:
    """Where the newest version, or a given one, of a published table lies; None before the first. Hold on to it while reading."""
    numbers = [int(n) for n in storage.names_in(spark, f"{path}/_manifest")]
    if version is not None and version not in numbers:
        raise ValueError(f"no version {version} of {path}")
    if not numbers:
        return None
    return f"{path}/{storage.read_text(spark, f'{path}/_manifest/{numbers[-1] if version is None else version:010d}')}"
