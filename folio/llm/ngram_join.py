"""N-gram Jaccard join by signature trees (op 5), exact and without pairs of a group being listed.

A signature is a bitmap with a bit for each shingle's hash, wide enough for its set. A tree's nodes hold
the OR of the bitmaps below and the range of set sizes; two trees are walked together, and a pair of
nodes is dropped when no two sets below could overlap enough.

Trees need documents that belong together, so the join runs in steps, each a superset of the links:

1. Equal sets are one class; its representative stands for it.
2. Classes that share a shingle among the first few in a fixed order (the prefix that any similar pair
   must share) meet in a tree of bitmaps. Only a spanning forest of the pairs that stay leaves a tree.
   A first round with the first three shingles finds most; the second drops every shingle whose classes
   are together by then, and classes that no other one of about their size shares a shingle with. The
   order puts shingles of many documents last.
3. Components of that forest hold every link. Each component's whole texts meet once, in blocks of a
   bounded number of shingles and pairs of such blocks; there a tree finds pairs, the exact sets decide,
   and pairs already linked through others are skipped.
4. Components of the exact links are the result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folio.llm.common import connected_components, documents_of, hold, shuffle_partitions, staged, unstaged
from folio.llm.embed_dedup import spanning_roots
from folio.llm.vectors import groups
from folio.llm.word_tokens import slices

FANOUT = 8
QUICK_KEYS = 3
#: shingles that are counted together, and how many of those found again the order knows as frequent
COUNTED, FREQUENT_LIST = 6_000_000, 1 << 19
#: classes in a block of one key; shingles (and as many a document besides) in a block of one component
KEY_BLOCK = 2048
TEXT_BLOCK, TEXT_ROW = 1_500_000, 500
PAIRS = 100_000


class _Words(dict):
    """Hash of each word, computed when first asked for."""

    def __missing__(self, word: bytes) -> int:
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h


_words = _Words()


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_sets(texts: list[str | None], k: int) -> list[np.ndarray]:
    """Sorted distinct 64-bit shingle hashes of each text: A-Z lowered, words between white space, ``k`` words a shingle."""
    hold("n-grams", _words.clear)
    if len(_words) > 400_000:
        _words.clear()
    split = [(t or "").encode("utf-8", "surrogatepass").lower().split() for t in texts]
    sizes = np.array([len(w) for w in split], np.int64)
    total = int(sizes.sum())
    h = np.fromiter(map(_words.__getitem__, (w for ws in split for w in ws)), np.uint64, total)
    ends = np.cumsum(sizes)
    out = []
    with np.errstate(over="ignore"):
        if total >= k:
            rolled = np.zeros(total - k + 1, np.uint64)
            for j in range(k):
                rolled = rolled * np.uint64(0x9E3779B97F4A7C15) + _mix(h[j : total - k + 1 + j])
            rolled = _mix(rolled)
        for end, n in zip(ends.tolist(), sizes.tolist(), strict=True):
            if n >= k:
                out.append(np.unique(rolled[end - n : end - k + 1]))
            elif n:
                one = np.uint64(n)
                for x in _mix(h[end - n : end]):
                    one = one * np.uint64(0xC2B2AE3D27D4EB4F) + x
                out.append(_mix(np.array([one], np.uint64)))
            else:
                out.append(np.empty(0, np.uint64))
    return out


def width_of(n: int) -> int:
    """Bits of the signature of a set of ``n``: a power of two, one to two a shingle."""
    return max(6, (max(n, 1) - 1).bit_length())


def signature(hashes: np.ndarray) -> np.ndarray:
    """Bitmap by the hashes' leading bits, so that halving the width joins neighbouring bits."""
    bits = width_of(len(hashes))
    on = np.zeros(1 << bits, bool)
    on[hashes >> np.uint64(64 - bits)] = True
    return np.packbits(on, bitorder="little").view(np.uint64)


def folded(rows: np.ndarray, bits: int) -> np.ndarray:
    """Bitmaps (rows of words) halved to ``2**bits`` bits."""
    while rows.shape[1] * 64 > 1 << bits:
        on = np.unpackbits(rows.view(np.uint8), axis=1, bitorder="little")
        rows = np.packbits(on[:, 0::2] | on[:, 1::2], axis=1, bitorder="little").view(np.uint64)
    return rows


class SignatureTree:
    """Levels of nodes over rows of one width, from the rows themselves up to one node."""

    def __init__(self, maps: np.ndarray, sizes: np.ndarray, order: np.ndarray) -> None:
        self.rows = order
        maps, low = maps[order], sizes[order].astype(np.int64)
        spare = low - np.bitwise_count(maps).sum(axis=1).astype(np.int64)
        self.levels = [(maps, low, low, spare)]
        while len(low) > 1:
            maps, low, high, spare = self.levels[-1]
            starts = np.arange(0, len(low), FANOUT)
            self.levels.append(
                (
                    np.bitwise_or.reduceat(maps, starts, axis=0),
                    np.minimum.reduceat(low, starts),
                    np.maximum.reduceat(high, starts),
                    np.maximum.reduceat(spare, starts),
                )
            )
            low = self.levels[-1][1]


def tree_pairs(a: SignatureTree, b: SignatureTree, percent: int, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Pairs of rows of two trees that may be similar, and the bound on their overlap. ``same``: one tree with itself."""
    depth = max(len(a.levels), len(b.levels)) - 1

    def walk(level: int, x: np.ndarray, y: np.ndarray):
        for at in range(0, len(x), PAIRS):
            i, j = x[at : at + PAIRS], y[at : at + PAIRS]
            ma, la, ha, sa = a.levels[min(level, len(a.levels) - 1)]
            mb, lb, hb, sb = b.levels[min(level, len(b.levels) - 1)]
            ok = (100 * ha[i] >= percent * lb[j]) & (100 * hb[j] >= percent * la[i])
            i, j = i[ok], j[ok]
            step = max(1, 4_000_000 // max(1, ma.shape[1]))
            common = np.concatenate(
                [np.bitwise_count(ma[i[c : c + step]] & mb[j[c : c + step]]).sum(axis=1) for c in range(0, len(i), step)] or [np.empty(0)]
            ).astype(np.int64)
            # a shingle in both sets has its bit in both maps; `spare` shingles share a bit with another one
            bound = np.minimum(common + np.minimum(sa[i], sb[j]), np.minimum(ha[i], hb[j]))
            ok = bound * (100 + percent) >= percent * (la[i] + lb[j])
            i, j, bound = i[ok], j[ok], bound[ok]
            if not len(i):
                continue
            if level == 0:
                yield a.rows[i], b.rows[j], bound
                continue
            x2, y2 = _children(a, level, i), _children(b, level, j)
            ci = np.repeat(x2[:, :, None], y2.shape[1], 2).reshape(len(i), -1)
            cj = np.repeat(y2[:, None, :], x2.shape[1], 1).reshape(len(j), -1)
            keep = (ci >= 0) & (cj >= 0)
            if same:
                keep &= (ci < cj) if level == 1 else (ci <= cj)
            yield from walk(level - 1, ci[keep], cj[keep])

    yield from walk(depth, np.zeros(1, np.int64), np.zeros(1, np.int64)) if not (same and depth == 0) else iter(())


def _children(tree: SignatureTree, level: int, nodes: np.ndarray) -> np.ndarray:
    if level >= len(tree.levels):  # the other tree is deeper: this one's top stays
        return nodes[:, None]
    below = nodes[:, None] * FANOUT + np.arange(FANOUT)
    return np.where(below < len(tree.levels[level - 1][1]), below, -1)


def candidate_pairs(maps: list[bytes], sizes: np.ndarray, side: np.ndarray, percent: int):
    """Row pairs of a block (side 0), or across two blocks (sides 1 and 2), that may be similar."""
    widths = np.array([len(m) for m in maps])
    for width in np.unique(widths):
        # sizes of a similar pair differ by less than half, so widths by one step at most
        mine = np.flatnonzero((widths == width) | (widths == 2 * width))
        raw = [np.frombuffer(maps[i], np.uint64)[None, :] for i in mine.tolist()]
        bits = int(width * 8).bit_length() - 1
        narrow = widths[mine] == width
        rows = np.empty((len(mine), width // 8), np.uint64)
        for wide in (True, False):
            at = np.flatnonzero(narrow != wide)
            if len(at):
                rows[at] = folded(np.concatenate([raw[i] for i in at.tolist()]), bits)
        local = sizes[mine]
        # rows that look alike lie side by side: by their first set bits
        order = np.lexsort((local, rows[:, 0]))
        groups_ = [order[side[mine][order] == s] for s in (0, 1, 2)]
        if len(groups_[0]) > 1:
            t = SignatureTree(rows, local, groups_[0])
            for i, j, bound in tree_pairs(t, t, percent, True):
                yield from _not_both_wide(mine, narrow, i, j, bound)
        if len(groups_[1]) and len(groups_[2]):
            t, u = SignatureTree(rows, local, groups_[1]), SignatureTree(rows, local, groups_[2])
            for i, j, bound in tree_pairs(t, u, percent, False):
                yield from _not_both_wide(mine, narrow, i, j, bound)


def _not_both_wide(mine, narrow, i, j, bound):
    ok = narrow[i] | narrow[j]
    if ok.any():
        yield mine[i[ok]], mine[j[ok]], bound[ok]


def forest_of_block(names: np.ndarray, labels: np.ndarray, sizes: np.ndarray, maps: list[bytes], side: np.ndarray, percent: int):
    """Edges ``(name, root)`` that span the pairs that may be similar; rows of one label count as joined."""
    order = np.argsort(names, kind="stable")
    place = np.empty(len(names), np.int64)
    place[order] = np.arange(len(names))
    _, first, inverse = np.unique(labels[order], return_index=True, return_inverse=True)
    root = first[inverse]
    start = root.copy()
    for i, j, _ in candidate_pairs(maps, sizes, side, percent):
        a, b = place[i], place[j]
        apart = root[a] != root[b]
        if apart.any():
            n = len(root)
            root = spanning_roots(n, np.concatenate([np.arange(n), a[apart]]), np.concatenate([root, b[apart]]))
    moved = np.flatnonzero((root != np.arange(len(root))) & (root != start))
    return names[order[moved]], names[order[root[moved]]]


def exact_links(names: list[int], sets: list[np.ndarray], side: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Edges ``(name, root)`` of the exact links in a block or across two; linked pairs aren't compared again."""
    n = len(names)
    key = np.array(names, np.int64)
    order = np.argsort(key, kind="stable")
    place = np.empty(n, np.int64)
    place[order] = np.arange(n)
    sizes = np.array([len(s) for s in sets], np.int64)
    root = np.arange(n)
    for i, j, bound in candidate_pairs([signature(s).tobytes() for s in sets], sizes, side, percent):
        best = np.argsort(-(bound / np.maximum(sizes[i] + sizes[j], 1)), kind="stable")
        i, j = i[best], j[best]
        at = 0
        while at < len(i):
            hits = []
            for x, y in zip(i[at : at + 128].tolist(), j[at : at + 128].tolist(), strict=True):
                a, b = sets[x], sets[y]
                if len(a) > len(b):
                    a, b = b, a
                pos = np.searchsorted(b, a)
                pos[pos == len(b)] = len(b) - 1
                common = int(np.count_nonzero(b[pos] == a))
                if 100 * common >= percent * (len(a) + len(b) - common):
                    hits.append((place[x], place[y]))
            at += 128
            if hits:
                h = np.array(hits)
                root = spanning_roots(n, np.concatenate([np.arange(n), h[:, 0]]), np.concatenate([root, h[:, 1]]))
                apart = root[place[i[at:]]] != root[place[j[at:]]]
                i, j, at = i[at:][apart], j[at:][apart], 0
    moved = np.flatnonzero(root != np.arange(n))
    return [(int(key[order[m]]), int(key[order[root[m]]])) for m in moved.tolist()]


def frequent_shingles(docs: DataFrame, k: int) -> np.ndarray:
    """Hashes of the shingles that most documents hold, all documents counted. They only shape the order, not the result.

    Each task counts its documents by a few million shingles at a time, equal sets once, and passes on
    what it met twice or more.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        met: set[int] = set()
        size = 0

        def flush() -> pa.RecordBatch:
            nonlocal held, size
            values, counts = np.unique(np.concatenate(held), return_counts=True)
            again = counts > 1
            held, size = [], 0
            met.clear()
            return pa.RecordBatch.from_pydict(
                {"h": pa.array(values[again].view(np.int64)), "n": pa.array(counts[again], pa.int64())}
            )

        for batch in batches:
            texts = batch.column("text").to_pylist()
            for i, j in slices(texts):
                for s in shingle_sets(texts[i:j], k):
                    if (name := xxhash.xxh64_intdigest(s.tobytes())) not in met:
                        met.add(name)
                        held.append(s)
                        size += len(s)
                if size > COUNTED:
                    yield flush()
        if held:
            yield flush()

    found = docs.select("text").mapInArrow(count, "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))
    rows = found.where("n > 2").orderBy(F.col("n").desc(), "h").limit(FREQUENT_LIST).select("h").toArrow()
    return np.sort(rows.column("h").to_numpy().astype(np.int64).view(np.uint64))


def profiles(docs: DataFrame, k: int, percent: int, frequent: np.ndarray) -> DataFrame:
    """``doc_id, n, d1, d2`` (size and digest of the set), ``prefix`` (first shingles in the order), ``map``."""
    shared = docs.sparkSession.sparkContext.broadcast(frequent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often = shared.value
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for i, j in slices(texts):
                sets = shingle_sets(texts[i:j], k)
                d1, d2, prefix, maps = [], [], [], []
                for s in sets:
                    data = s.tobytes()
                    d1.append(xxhash.xxh64_intdigest(data, 1) - (1 << 63))
                    d2.append(xxhash.xxh64_intdigest(data, 2) - (1 << 63))
                    if not len(s):
                        prefix.append(s.view(np.int64))
                        maps.append(b"")
                        continue
                    length = len(s) - -(-percent * len(s) // 100) + 1
                    head = s[:length]
                    if len(often):
                        pos = np.minimum(np.searchsorted(often, s), len(often) - 1)
                        late = often[pos] == s
                        if late.any():
                            head = np.concatenate([s[~late], s[late]])[:length]
                    prefix.append(head.view(np.int64))
                    maps.append(signature(s).tobytes())
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").slice(i, j - i),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array(d1, pa.int64()),
                        pa.array(d2, pa.int64()),
                        _listed(prefix),
                        pa.array(maps, pa.binary()),
                    ],
                    names=["doc_id", "n", "d1", "d2", "prefix", "map"],
                )

    return docs.mapInArrow(run, "doc_id long, n long, d1 long, d2 long, prefix array<long>, map binary")


def _listed(rows: list[np.ndarray]) -> pa.ListArray:
    offsets = np.concatenate(([0], np.cumsum([len(r) for r in rows]))).astype(np.int32)
    return pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(rows) if rows else np.empty(0, np.int64), pa.int64()))


def _cells(rows: DataFrame, key: str, block: int, cost, percent: int, *carry: str) -> DataFrame:
    """Rows dealt to blocks of their key by size, and each block to the cells of its pairs: ``cell, side`` and ``carry``.

    A row goes to the cells of those blocks only that hold rows of a size that can be similar to its own.
    """
    own = Window.partitionBy(key).orderBy("n", "rep")
    cut = rows.withColumn("slice", F.floor((F.sum(cost).over(own) - 1) / block).cast("int"))
    # sizes on a logarithmic scale, so that a similar one lies within a fixed distance
    scale = 1 << 20
    cut = cut.withColumn("__log", F.floor(F.log("n") * scale).cast("long"))
    reach = math.ceil(math.log(100 / percent) * scale) + 2
    up = Window.partitionBy(key).orderBy("__log").rangeBetween(Window.unboundedPreceding, reach)
    down = Window.partitionBy(key).orderBy(F.col("__log").desc()).rangeBetween(Window.unboundedPreceding, reach)
    cut = cut.withColumn("__to", F.max("slice").over(up)).withColumn("__from", F.min("slice").over(down))
    cut = cut.withColumn("other", F.explode(F.sequence("__from", "__to")))
    side = F.when(F.col("slice") == F.col("other"), 0).when(F.col("slice") < F.col("other"), 1).otherwise(2)
    cell = F.xxhash64(key, F.least("slice", "other"), F.greatest("slice", "other"))
    return cut.select(cell.alias("cell"), side.alias("side"), *carry)


def _forest(keys: DataFrame, maps: DataFrame, percent: int) -> DataFrame:
    """``keys(key, rep, n, label)`` to spanning edges ``a, b`` of the classes that may be similar."""
    spark = keys.sparkSession
    cells = _cells(keys, "key", KEY_BLOCK, F.lit(1), percent, "rep", "label")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in groups(batches, "cell"):
            names, labels, n, side = (rows.column(c).to_numpy() for c in ("rep", "label", "n", "side"))
            if len(names) > 1:
                a, b = forest_of_block(names, labels, n, rows.column("map").to_pylist(), side, percent)
                if len(a):
                    yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return (
        cells.join(maps, "rep")
        .repartition(shuffle_partitions(spark), "cell")
        .sortWithinPartitions("cell", "rep")
        .mapInArrow(run, "a long, b long")
    )


def jaccard_classes(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """``doc_id, n_shingles, component_id`` of every row: documents linked at ``100 * common >= percent * all`` shingles.

    The whole word sequence is the one shingle of shorter texts; null texts and texts without a word have
    none and link with nothing; texts of any length count whole. Rows that share an id share its component.
    Rows without an id take no part and have no component. An empty table gives no rows; other columns,
    whatever their names, are left out.
    """
    spark = docs.sparkSession
    docs = documents_of(docs)
    base = staged(profiles(docs, k, percent, frequent_shingles(docs, k)), "profiles")
    live = base.where("n > 0 and doc_id is not null")
    classes = staged(
        live.groupBy("d1", "d2").agg(
            F.min("doc_id").alias("rep"), F.min("n").alias("n"), F.min_by(F.struct("prefix", "map"), "doc_id").alias("x")
        ).select("d1", "d2", "rep", "n", "x.prefix", "x.map"),
        "classes",
    )
    maps = classes.select("rep", "n", "map")
    quick = classes.select(F.explode(F.slice("prefix", 1, QUICK_KEYS)).alias("key"), "rep", "n", F.col("rep").alias("label"))
    shared = quick.withColumn("many", F.count(F.lit(1)).over(Window.partitionBy("key"))).where("many > 1").drop("many")
    first = staged(_forest(shared, maps, percent), "forest")
    labels = first.groupBy(F.col("a").alias("rep")).agg(F.min("b").alias("found"))
    keys = (
        classes.select("rep", "n", "prefix")
        .join(labels, "rep", "left")
        .select(F.explode("prefix").alias("key"), "rep", "n", F.coalesce("found", "rep").alias("label"))
    )
    whole = Window.partitionBy("key")
    by_size = whole.orderBy("n")
    apart = (
        keys.withColumn("below", F.lag("n").over(by_size))
        .withColumn("above", F.lead("n").over(by_size))
        .withColumn("low", F.min("label").over(whole))
        .withColumn("high", F.max("label").over(whole))
        .where(F.col("low") < F.col("high"))
        .where((100 * F.col("below") >= percent * F.col("n")) | (100 * F.col("n") >= percent * F.col("above")))
        .drop("low", "high", "below", "above")
    )
    second = staged(_forest(apart, maps, percent), "forest")
    groups_of = staged(connected_components(first.union(second)), "groups")
    unstaged(first, second)
    members = groups_of.select(F.col("node").alias("rep"), F.col("component").alias("key")).join(classes.select("rep", "n"), "rep")
    cells = _cells(members, "key", TEXT_BLOCK, F.col("n") + TEXT_ROW, percent, "rep")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in groups(batches, "cell"):
            names, side = rows.column("rep").to_pylist(), rows.column("side").to_numpy()
            if len(names) > 1:
                edges = exact_links(names, shingle_sets(rows.column("text").to_pylist(), k), side, percent)
                if edges:
                    a, b = zip(*edges, strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    links = (
        cells.join(docs.withColumnRenamed("doc_id", "rep"), "rep")
        .repartition(shuffle_partitions(spark), "cell")
        .sortWithinPartitions("cell", "rep")
        .mapInArrow(verify, "a long, b long")
    )
    found = connected_components(staged(links, "links"))
    of_class = classes.select("d1", "d2", "rep").join(found.withColumnRenamed("node", "rep"), "rep", "left").select(
        "d1", "d2", F.coalesce("component", "rep").alias("component_id")
    )
    linked = live.select("doc_id", "n", "d1", "d2").join(of_class, ["d1", "d2"])
    rest = base.where("n = 0 or doc_id is null").select("doc_id", "n", F.col("doc_id").alias("component_id"))
    return linked.select("doc_id", "n", "component_id").unionByName(rest).select("doc_id", F.col("n").alias("n_shingles"), "component_id")


def one_of_each(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` that stand for their class: the smallest id's, once. Rows without an id all stay."""
    kept = jaccard_classes(docs, k, percent).where("doc_id = component_id").select("doc_id").distinct()
    named = docs.where(docs["doc_id"].isNotNull())
    key = named["doc_id"].cast("long").alias("__id")
    once = named.select(key, *(named[c] for c in docs.columns)).join(kept.withColumnRenamed("doc_id", "__id"), "__id", "left_semi")
    return once.dropDuplicates(["__id"]).drop("__id").unionByName(docs.where(docs["doc_id"].isNull()))
