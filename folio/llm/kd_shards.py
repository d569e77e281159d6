"""K-d tree partitioning into shards of near-equal bytes (op 7), with DataFrame operations only.

A node is split across its widest dimension, at the key where the bytes before it come closest to the
share of the shards on that side, until every leaf is one shard of the target size. The metadata is
written once; a row's node follows from the tree so far, inside each query. One aggregation finds the
widest dimension and the median's bin of all nodes of a level, the next ones narrow the bins down; a
histogram has a fixed number of bins, whatever the number of rows.

A key is a dimension's coordinate, then a hash of the text, then a hash of the row. The coordinates are
measures of the text, so equal texts are neighbours in every dimension: no cut falls among them as long
as they weigh ``WHOLE`` of a shard at most (a group that straddles a median goes to one side and the
median moves), and a larger group can be cut anywhere.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folio.llm.common import staged

SHARDS = 40
ROW_BYTES = 16
BINS = 4096
#: share of a shard's bytes that a median may be off, and up to which a group of equal texts stays whole
TOLERANCE, WHOLE = 0.002, 0.25
COORDINATE_BITS, TEXT_BITS, ROW_BITS = 16, 28, 19
#: steps of a measure's binary logarithm
STEPS = 1 << 10
#: bits of a coordinate that the first histogram tells apart
COARSE = 10
#: rows of a shard that are numbered together
SLOT_ROWS = 250_000
DIMENSIONS = ("size", "word_length", "line_length", "wide_share")


@dataclass
class Node:
    shards: int
    first: int
    dimension: int = 0
    key: int = 0
    #: groups that go left or right whole, whatever their keys
    lefts: list[int] = field(default_factory=list)
    rights: list[int] = field(default_factory=list)
    left: Node | None = None
    right: Node | None = None


@dataclass
class Search:
    """Where a node's cut lies: in ``low..high``, which has ``rows`` and ``before`` bytes below it, at ``target`` bytes."""

    low: int
    high: int
    before: float
    target: float
    rows: int


def measure(docs: DataFrame, name: str) -> Column:
    """A dimension's value, 1 or more: a measure of the text, or the magnitude of a column (a hash for strings)."""
    text = F.coalesce(docs["text"].cast("string"), F.lit(""))
    size, chars = F.octet_length(text).cast("double"), F.length(text).cast("double")
    parts = lambda mark: F.length(text) - F.length(F.replace(text, F.lit(mark), F.lit(""))) + 1
    of_text = {
        "size": lambda: size + ROW_BYTES,
        "word_length": lambda: 1 + size / parts(" "),
        "line_length": lambda: 1 + size / parts("\n"),
        "wide_share": lambda: 1 + 1024 * (size - chars) / (size + 1),
    }
    if name in of_text:
        return of_text[name]()
    kinds = dict(docs.dtypes)
    if name not in kinds:
        return F.lit(1.0)
    if kinds[name] == "string":
        return F.coalesce(F.crc32(docs[name].cast("binary")).cast("double"), F.lit(0.0)) + 1
    return F.abs(F.coalesce(docs[name].cast("double"), F.lit(0.0))) + 1


def metadata(docs: DataFrame, dimensions: tuple[str, ...] = DIMENSIONS) -> DataFrame:
    """``doc_id, size, text_crc32`` and one key ``k0, k1, ...`` a dimension. Null texts have no bytes and checksum 0."""
    text = docs["text"].cast("string").cast("binary")
    size = F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + ROW_BYTES
    rows = docs.select(
        docs["doc_id"].cast("long").alias("doc_id"),
        size.alias("size"),
        F.coalesce(F.crc32(text), F.lit(0)).alias("text_crc32"),
        F.shiftrightunsigned(F.xxhash64(F.coalesce(text, F.lit(b""))), 64 - TEXT_BITS).alias("group"),
        F.shiftrightunsigned(F.xxhash64(docs["doc_id"], F.monotonically_increasing_id()), 64 - ROW_BITS).alias("row"),
        *(measure(docs, name).alias(f"v{k}") for k, name in enumerate(dimensions)),
    )
    tie = F.col("group") * (1 << ROW_BITS) + F.col("row")
    top = (1 << COORDINATE_BITS) - 1
    place = lambda k: F.least(F.floor(F.log2(f"v{k}") * STEPS).cast("long"), F.lit(top))
    keys = [(F.coalesce(place(k), F.lit(0)) * (1 << (TEXT_BITS + ROW_BITS)) + tie).alias(f"k{k}") for k in range(len(dimensions))]
    return rows.select("doc_id", "size", "text_crc32", *keys)


def _pick(values: list, kind: str = "long") -> Column:
    """The value at the row's ``node``."""
    one = lambda v: F.array(*map(F.lit, v)).cast(kind) if isinstance(v, list) else F.lit(v).cast(kind)
    return F.get(F.array(*map(one, values)), F.col("node"))


def _own_key(level: list[Node], dimensions: int) -> Column:
    """The row's key in the dimension of its node."""
    return F.get(F.array(*(F.col(f"k{k}") for k in range(dimensions))), _pick([x.dimension for x in level], "int"))


def _descend(table: DataFrame, level: list[Node], dimensions: int) -> tuple[DataFrame, list[Node]]:
    """Rows move from the nodes of ``level`` to the next one; a leaf moves on as it is."""
    below: list[Node] = []
    first = []
    for x in level:
        first.append(len(below))
        below += [x.left, x.right] if x.left and x.right else [x]
    table = table.withColumn("__key", _own_key(level, dimensions))
    right = F.col("__key") > _pick([x.key for x in level])
    if any(x.lefts or x.rights for x in level):
        group = F.shiftright("__key", ROW_BITS)
        inside = lambda lists: F.array_contains(_pick(lists, "array<bigint>"), group)
        right = F.when(inside([x.lefts for x in level]), False).when(inside([x.rights for x in level]), True).otherwise(right)
    right = right & ~_pick([x.left is None for x in level], "boolean")
    return table.withColumn("node", _pick(first, "int") + right.cast("int")).drop("__key"), below


def _binned(rows: DataFrame, *keys: str):
    """Bytes and rows a bin, on the driver: a few thousand bins a node. Rows without a size count for nothing.

    A filter on the node would be pushed below every level of the tree and repeat its expression there.
    """
    sums = rows.groupBy(*keys, "bin").agg(F.sum("size").alias("size"), F.count("size").alias("n")).where("size is not null")
    return sums.toPandas().sort_values([*keys, "bin"])


def _start(own: DataFrame, level: list[Node], dimensions: int) -> dict[int, Search]:
    """The widest dimension of each node that is to be split, and the coarse bin of its median."""
    shift = TEXT_BITS + ROW_BITS + COORDINATE_BITS - COARSE
    coarse = F.array(*(F.struct(F.lit(k).alias("k"), F.shiftright(f"k{k}", shift).alias("bin")) for k in range(dimensions)))
    counted = F.when(~_pick([x.shards == 1 for x in level], "boolean"), F.col("size"))
    bins = _binned(own.select("node", counted.alias("size"), F.explode(coarse).alias("c")).select("node", "size", "c.k", "c.bin"), "node", "k")
    out = {}
    for i, of_node in bins.groupby("node"):
        node = level[int(i)]
        spread = of_node.groupby("k")["bin"].agg(lambda x: x.iloc[-1] - x.iloc[0])
        node.dimension = int(spread.idxmax())
        mine = of_node[of_node["k"] == node.dimension]
        upto = mine["size"].to_numpy(float).cumsum()
        target = upto[-1] * (node.shards // 2) / node.shards
        j = min(int(upto.searchsorted(target)), len(upto) - 1)
        low = int(mine["bin"].iloc[j]) << shift
        out[int(i)] = Search(low, low + (1 << shift) - 1, upto[j] - float(mine["size"].iloc[j]), target, int(mine["n"].iloc[j]))
    return out


def _narrow(own: DataFrame, level: list[Node], dimensions: int, open_: dict[int, Search], leaf: float) -> dict[int, Search]:
    """One histogram over every open range; settles the cuts that are near enough and returns the others."""
    group = 1 << ROW_BITS
    lows, highs, widths = [0] * len(level), [-1] * len(level), [1] * len(level)
    for i, s in open_.items():
        width = -(-(s.high - s.low + 1) // BINS)
        if s.high - s.low >= group:  # bins of whole groups, one each if the rows are few
            width = group if s.rows <= BINS else -(-width // group) * group
        lows[i], highs[i], widths[i] = s.low, s.high, width
    inside = own.select("node", "size", _own_key(level, dimensions).alias("__key"), _pick(lows).alias("__low"), _pick(highs).alias("__high"), _pick(widths).alias("__width"))
    inside = inside.withColumn("in", F.expr("__key between __low and __high"))
    bins = _binned(
        inside.select("node", F.when(F.col("in"), F.col("size")).alias("size"), F.when(F.col("in"), F.expr("(__key - __low) div __width")).alias("bin")), "node"
    )
    found = dict(list(bins.groupby("node")))
    still = {}
    for i, s in open_.items():
        node = level[i]
        if i not in found:  # nothing lies here
            node.key = s.high
            continue
        starts = (s.low + found[i]["bin"].to_numpy() * widths[i]).tolist()
        sizes = found[i]["size"].to_numpy(float)
        upto = s.before + sizes.cumsum()
        j = int(upto.searchsorted(s.target))
        if j == len(sizes):
            node.key = s.high
            continue
        below, end = upto[j] - sizes[j], min(s.high, starts[j] + widths[i] - 1)
        left = upto[j] - s.target <= s.target - below
        if widths[i] == 1 or min(upto[j] - s.target, s.target - below) <= TOLERANCE * leaf or (node.lefts or node.rights) and widths[i] == group:
            # the cut before or after this bin, whichever leaves the sides nearer to their shares
            node.key = end if left else starts[j] - 1
        elif widths[i] == group and sizes[j] <= WHOLE * leaf:
            # one group of equal texts goes to its better side whole, and the cut moves to make up for it
            (node.lefts if left else node.rights).append(starts[j] >> ROW_BITS)
            if left:
                before = (upto - sizes)[: j + 1]
                c = int(abs(before - (s.target - sizes[j])).argmin())
                node.key, edge = starts[c] - 1, c == 0
                again = Search(0, starts[j] - 1, 0.0, s.target - sizes[j], 1 << 62)
            else:
                after = upto[j:] - sizes[j]
                c = int(abs(after - s.target).argmin())
                node.key, edge = starts[j + c] + group - 1, j + c == len(sizes) - 1
                again = Search(end + 1, (1 << 63) - 1, below, s.target, 1 << 62)
            if edge and s.rows > BINS:  # what makes up for it lies beyond this range
                still[i] = again
        else:
            still[i] = Search(starts[j], end, below, s.target, int(found[i]["n"].iloc[j]))
    return still


def shards_of(docs: DataFrame, shards: int = SHARDS, dimensions: tuple[str, ...] = DIMENSIONS) -> DataFrame:
    """``doc_id, size, text_crc32, law, shard, slot, grown_shard`` of every row, shards 0 to ``shards - 1``.

    Size is the text's UTF-8 bytes (null: none) plus ``ROW_BYTES``; sizes of shards are near equal. Rows
    of equal texts share a shard unless together they weigh more than ``WHOLE`` of one, given that all
    ``dimensions`` are measures of the text; a column's name may stand among them too. Null ids and
    repeated rows are placed like any other; dimensions that the table lacks are one point; other
    columns are left out; an empty table gives no rows. Slots number a shard's rows from 0 without gaps.
    """
    n = len(dimensions)
    meta = staged(metadata(docs, dimensions), "meta")
    rows, total = meta.agg(F.count(F.lit(1)), F.coalesce(F.sum("size"), F.lit(0))).first()
    table = meta.withColumn("node", F.lit(0))
    level = [Node(shards, 0)]
    while any(x.shards > 1 for x in level):
        open_ = _start(table, level, n)
        while open_:
            open_ = _narrow(table, level, n, open_, total / shards)
        for x in level:
            if x.shards > 1:
                half = x.shards // 2
                x.left, x.right = Node(half, x.first), Node(x.shards - half, x.first + half)
        table, level = _descend(table, level, n)
    placed = table.select("doc_id", "size", "text_crc32", _pick([x.first for x in level], "int").alias("shard"), F.col("k0").alias("order"))
    placed = staged(placed, "shards")
    # slots in two steps, so that a shard isn't sorted in one task
    parts = max(1, -(-rows // (shards * SLOT_ROWS)))
    grouped = placed.withColumn("part", F.pmod(F.xxhash64("order"), F.lit(parts)).cast("int"))
    counts = grouped.groupBy("shard", "part").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select("shard", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    within = F.row_number().over(Window.partitionBy("shard", "part").orderBy("order", "doc_id")) - 1
    return (
        grouped.withColumn("within", within)
        .join(base, ["shard", "part"])
        .select(
            "doc_id",
            "size",
            "text_crc32",
            F.lit("bytes").alias("law"),
            "shard",
            (F.col("base") + F.col("within")).alias("slot"),
            F.lit(None).cast("int").alias("grown_shard"),
        )
    )
