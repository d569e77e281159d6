"""A stored inverted index in segments: immutable postings, tombstones, and one small manifest a version.

A posting is a term's positions in one column of one document. A row of a segment holds the postings of a term and
column, as far as these were met together: of a frequent term those in one block of 128 neighbouring ids, of a
rarer one those in several (``wide``). Beside them lies what the term can weigh at most in a block, and is read
alone where that is enough. Rows lie in folders by the term's hash, sorted by
term and block inside, so a search reads the row groups of its own terms; lengths and filter columns a document lie
beside them. A changed document gets a posting list in a new, small segment and a tombstone in the old
one; segments of like size are merged when there are several. Weights apply when searching.
"""

from __future__ import annotations

import hashlib
import json
import math
import uuid
import zlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folio.operators.retrieval import B, FILTERED, K1, WEIGHTS, _tokens, indexed, nothing, ranked, request, token_lengths
from folio.plans.query import FACETS, StructuredQuery
from folio.sources import storage

BUCKETS = 64
#: ids that share a block are equal but for their last seven bits
BLOCK_BITS = 7
#: segments whose numbers of postings are of one power of this are merged once there are as many
TIER = 4
#: postings a block that a term has at least, on average, for a row a block
DENSE = 8
#: wide rows of merged segments end with so many blocks, as a power of two
SPAN_BITS = 6
TOKENS_AT_ONCE = 2_000_000
#: how rows are laid out; an index of another layout counts as drifted
LAYOUT = 2
#: ``block`` is a wide row's first; ``first``: whether no earlier column of the document holds the term
BLOCKS = "term string, column string, wide boolean, block long, most int, short int, n long, firsts long, id array<long>, words array<int>, times array<int>, first array<boolean>"
POSTINGS = f"{BLOCKS}, at array<array<int>>"
NAMES = [c.split(" ")[0] for c in POSTINGS.split(", ")]


def bucket_of(term: Column) -> Column:
    return (F.crc32(term.cast("binary")) % BUCKETS).cast("int")


def seal(docs: DataFrame, weights: dict[str, float] = WEIGHTS) -> str:
    """A figure of all that an index holds, whatever the order of rows; it reads all of it."""
    content = F.xxhash64("id", *indexed(docs, weights), *(c for c in FILTERED if c in docs.columns))
    row = docs.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(content.cast("decimal(38,0)")), F.lit(0)).cast("string").alias("seal")).first()
    return f"{row['n']} {row['seal']}"


def version_of(docs: DataFrame, weights: dict[str, float] = WEIGHTS) -> str | None:
    """What files ``docs`` comes from, their sizes and times, and how it is made of them; None if it doesn't come from files."""
    files = docs.inputFiles()
    if not files:
        return None
    fs, _ = storage.file_system(docs.sparkSession, files[0])
    path = docs.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path
    found = [fs.getFileStatus(path(f)) for f in files]
    listing = sorted((s.getPath().toString(), s.getLen(), s.getModificationTime()) for s in found)
    return hashlib.sha256(json.dumps([listing, docs.semanticHash(), list(indexed(docs, weights))]).encode()).hexdigest()


# -- state -------------------------------------------------------------------------------------------


def state_of(spark: SparkSession, path: str) -> dict | None:
    """The newest manifest: segments, tombstones, and the source's version; None without an index."""
    names = storage.names_in(spark, f"{path}/_manifest")
    return json.loads(storage.read_text(spark, f"{path}/_manifest/{names[-1]}")) if names else None


def _put(spark: SparkSession, path: str, before: dict | None, after: dict) -> dict:
    after = {**after, "version": before["version"] + 1 if before else 0}
    if not storage.put_once(spark, f"{path}/_manifest/{after['version']:010d}", json.dumps(after)):
        raise RuntimeError(f"another writer changed the index at {path}")
    # the version before stays for searches under way, older ones go
    if before:
        live = {s["name"] for m in (before, after) for s in m["segments"]} | {t["name"] for m in (before, after) for t in m["tombstones"]}
        for kind in ("postings", "documents", "tombstones"):
            for name in storage.names_in(spark, f"{path}/{kind}"):
                if name.partition("=")[2] not in live:
                    storage.delete(spark, f"{path}/{kind}/{name}")
    return after


def _live(state: dict) -> tuple[int, dict[str, int]]:
    """Documents and words a column, without those that are dead."""
    n, words = 0, {}
    for s in state["segments"]:
        dead = [t["of"][s["name"]] for t in state["tombstones"] if s["name"] in t["of"]]
        n += s["n"] - sum(d["n"] for d in dead)
        for c, w in s["words"].items():
            words[c] = words.get(c, 0) + w - sum(d["words"].get(c, 0) for d in dead)
    return n, words


def figures(spark: SparkSession, path: str) -> DataFrame:
    """One row: ``n`` documents and the mean words of each indexed column, from the manifest alone."""
    n, words = _live(state_of(spark, path))
    kind = ", ".join(["n long", *(f"avg_{c} double" for c in words)])
    return spark.createDataFrame([(n, *(w / n if n else None for w in words.values()))], kind)


# -- writing -----------------------------------------------------------------------------------------


def _postings(docs: DataFrame, weights: dict[str, float]) -> DataFrame:
    """Postings of every indexed column: words are found by the same expression as in a scan, positions inside the row.

    A row holds no more than what was met at once, so it is bounded; a block whose documents are apart is in several.
    """
    columns = list(indexed(docs, weights))

    def part(ids: np.ndarray, lists: list[pa.ListArray]) -> pa.RecordBatch:
        if (ids[1:] < ids[:-1]).any():  # neighbouring ids meet in one row
            order = np.argsort(ids, kind="stable")
            ids, lists = ids[order], [x.take(pa.array(order)) for x in lists]
        lengths = [np.diff(x.offsets.to_numpy()) for x in lists]
        values = pa.chunked_array([x.flatten() for x in lists], pa.string()).combine_chunks().dictionary_encode()
        code, names = values.indices.to_numpy(zero_copy_only=False), values.dictionary
        doc = np.concatenate([np.repeat(np.arange(len(ids)), n) for n in lengths])
        column = np.repeat(np.arange(len(lists)), [n.sum() for n in lengths])
        pos = np.concatenate([np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) for n in lengths])
        order = np.argsort(code, kind="stable")  # inside a term they lie by column, document and position already
        doc, code, column, pos = doc[order], code[order], column[order], pos[order]
        new = lambda *keys: np.flatnonzero(np.concatenate(([True], reduce(np.logical_or, [k[1:] != k[:-1] for k in keys])))) if len(keys[0]) else np.zeros(0, int)
        start = new(code, column, doc)
        ends = np.append(start, len(pos)).astype(np.int32)
        d, c, t, times = doc[start], column[start], code[start], np.diff(ends)
        words = np.stack(lengths)[c, d] if len(start) else np.zeros(0, int)
        order = np.lexsort((c, d, t)) if len(lists) > 1 else np.arange(len(start))
        first = np.zeros(len(start), bool)
        first[order[new(t[order], d[order])]] = True
        block = ids[d] >> BLOCK_BITS
        run, row = new(t, c), new(t, c, block)
        of = np.searchsorted(run, row, "right") - 1  # the run of each block
        blocks = np.bincount(of, minlength=len(run))
        wide = (blocks > 1) & (np.diff(np.append(run, len(start))) < DENSE * blocks)
        keep = ~wide[of] | np.isin(row, run)
        row, wide = row[keep], wide[of[keep]]
        rows = np.append(row, len(start)).astype(np.int32)
        per = lambda x: pa.ListArray.from_arrays(rows, x)
        least = lambda f, x: f.reduceat(x, row) if len(row) else x[:0]
        return pa.RecordBatch.from_arrays(
            [
                names.take(pa.array(t[row])), pa.array(columns, pa.string()).take(pa.array(c[row])), pa.array(wide), pa.array(block[row], pa.int64()),
                pa.array(least(np.maximum, times), pa.int32()), pa.array(least(np.minimum, words), pa.int32()), pa.array(np.diff(rows), pa.int64()),
                pa.array(least(np.add, first.astype(np.int64)), pa.int64()),
                per(pa.array(ids[d], pa.int64())), per(pa.array(words, pa.int32())), per(pa.array(times, pa.int32())), per(pa.array(first)), per(pa.ListArray.from_arrays(ends, pa.array(pos, pa.int32()))),
            ],
            names=NAMES,
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = [batch.column(f"w_{c}") for c in columns]
            size = np.cumsum(sum(pc.list_value_length(x).to_numpy(zero_copy_only=False) for x in lists)) if columns else np.zeros(0)
            at = 0
            while at < batch.num_rows:  # so many words at once, a longer document alone
                done = size[at - 1] if at else 0
                end = max(at + 1, int(np.searchsorted(size, done + TOKENS_AT_ONCE, "right")))
                ids = batch.column("id").slice(at, end - at).to_numpy(zero_copy_only=False)
                found = [pa.ListArray.from_arrays(pc.subtract(x.offsets, x.offsets[0]), x.flatten()) for x in (y.slice(at, end - at) for y in lists)]
                yield part(ids, found)
                at = end

    rows = docs.where("id is not null").select(F.col("id").cast("long").alias("id"), *(_tokens(docs, c).alias(f"w_{c}") for c in columns))
    return rows.mapInArrow(run, POSTINGS)


def _clustered(rows: DataFrame, to: str, *order: str) -> None:
    dealt = rows.withColumn("bucket", bucket_of(F.col("term"))).hint("rebalance", "bucket")
    dealt.sortWithinPartitions("bucket", "term", *order).write.partitionBy("bucket").parquet(to)


def _finish(spark: SparkSession, path: str, name: str, columns: list[str]) -> dict:
    """What the manifest says of a segment whose postings and documents are written."""
    postings = spark.read.schema("n long").parquet(f"{path}/postings/segment={name}").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    documents = spark.read.parquet(f"{path}/documents/segment={name}")
    sums = documents.agg(F.count(F.lit(1)).alias("n"), *(F.coalesce(F.sum(f"len_{c}"), F.lit(0)).alias(c) for c in columns)).first()
    return {"name": name, "n": sums["n"], "words": {c: sums[c] for c in columns}, "postings": postings}


def _segment(docs: DataFrame, path: str, weights: dict[str, float]) -> dict:
    """Write one segment of ``docs``: one shuffle of postings, together where neighbouring ids hold a term."""
    spark, name = docs.sparkSession, uuid.uuid4().hex
    _clustered(_postings(docs, weights), f"{path}/postings/segment={name}", "block")
    carried = [c for c in FILTERED if c in docs.columns]
    lengths = token_lengths(docs, weights)
    rows = docs.where("id is not null").select(F.col("id").cast("long").alias("id"), *carried, *(n.alias(f"len_{c}") for c, n in lengths.items()))
    rows.write.parquet(f"{path}/documents/segment={name}")
    return _finish(spark, path, name, list(lengths))


def build(docs: DataFrame, path: str, weights: dict[str, float] = WEIGHTS) -> dict:
    """Index ``docs`` anew as one segment; what was there goes with the next change. Rows without an id are left out."""
    spark = docs.sparkSession
    before = state_of(spark, path)
    one = _segment(docs, path, weights)
    return _put(spark, path, before, {"layout": LAYOUT, "segments": [one], "tombstones": [], "columns": list(indexed(docs, weights)), "source": version_of(docs, weights), "seal": seal(docs, weights)})


def drifted(docs: DataFrame, path: str, weights: dict[str, float] = WEIGHTS) -> bool:
    """Whether the index at ``path`` is missing or tells of other documents.

    Equal files made use of in an equal way settle it without reading them; only otherwise all is read.
    """
    state = state_of(docs.sparkSession, path)
    if state is None or state.get("layout") != LAYOUT or state["columns"] != list(indexed(docs, weights)):
        return True
    source = version_of(docs, weights)
    return (source is None or source != state["source"]) and seal(docs, weights) != state["seal"]


def ensure(docs: DataFrame, path: str, weights: dict[str, float] = WEIGHTS) -> bool:
    """Build the index if it has drifted; True if it had."""
    stale = drifted(docs, path, weights)
    if stale:
        build(docs, path, weights)
    return stale


def update(docs: DataFrame, path: str, gone: DataFrame | None = None, weights: dict[str, float] = WEIGHTS) -> dict:
    """Index ``docs(id, ..)``, new or changed, in a segment of their own, and forget the ids of ``gone``.

    Older postings of these ids get tombstones; only the ids and lengths of older segments are read. Afterwards
    the source's version is unknown, so that ``ensure`` compares contents.
    """
    spark = docs.sparkSession
    before = state_of(spark, path)
    if before.get("layout") != LAYOUT:
        raise ValueError(f"the index at {path} has an older layout and must be built anew")
    ids = docs.select(F.col("id").cast("long").alias("id"))
    ids = (ids if gone is None else ids.union(gone.select(F.col("id").cast("long")))).where("id is not null").distinct()
    columns = before["columns"]
    old = _documents(spark, path, before).join(ids, "id", "left_semi")
    name = uuid.uuid4().hex
    old.select("segment", "id", *(f"len_{c}" for c in columns)).write.parquet(f"{path}/tombstones/name={name}")
    dead = spark.read.parquet(f"{path}/tombstones/name={name}").groupBy("segment").agg(F.count(F.lit(1)).alias("n"), *(F.sum(f"len_{c}").alias(c) for c in columns)).collect()
    of = {r["segment"]: {"n": r["n"], "words": {c: r[c] for c in columns}} for r in dead}
    one = _segment(docs, path, weights)
    tombstones = [*before["tombstones"], {"name": name, "of": of}] if of else before["tombstones"]
    after = {**before, "segments": [*before["segments"], one] if one["n"] else before["segments"], "tombstones": tombstones, "source": None, "seal": None}
    return merge(spark, path, _put(spark, path, before, after))


def merge(spark: SparkSession, path: str, state: dict | None = None) -> dict:
    """Merge segments of like size once there are ``TIER`` of them, and all of them once a fifth of the documents is dead."""
    state = state or state_of(spark, path)
    tiers: dict[int, list[dict]] = {}
    for s in state["segments"]:
        tiers.setdefault(int(math.log(max(s["postings"], 1), TIER)), []).append(s)
    chosen = next((t for _, t in sorted(tiers.items()) if len(t) >= TIER), [])
    dead = sum(o["n"] for t in state["tombstones"] for o in t["of"].values())
    if 5 * dead > sum(s["n"] for s in state["segments"]):
        chosen = state["segments"]
    if not chosen:
        return state
    some, name = {**state, "segments": chosen}, uuid.uuid4().hex
    _clustered(_in_rows(_without_dead(spark, path, some, _each(_read(spark, path, "postings", some, POSTINGS)))), f"{path}/postings/segment={name}", "block")
    _documents(spark, path, some).drop("segment").write.parquet(f"{path}/documents/segment={name}")
    one = _finish(spark, path, name, state["columns"])
    lost = {s["name"] for s in chosen}
    tombstones = [{**t, "of": {s: o for s, o in t["of"].items() if s not in lost}} for t in state["tombstones"]]
    segments = [s for s in state["segments"] if s["name"] not in lost] + [one]
    return merge(spark, path, _put(spark, path, state, {**state, "segments": segments, "tombstones": [t for t in tombstones if t["of"]]}))


# -- reading -----------------------------------------------------------------------------------------


def _read(spark: SparkSession, path: str, kind: str, state: dict, schema: str) -> DataFrame:
    names = [f"{path}/{kind}/segment={s['name']}" for s in state["segments"]]
    if not names:
        return spark.createDataFrame([], f"{schema}, segment string")
    return spark.read.schema(f"{schema}, segment string").option("basePath", f"{path}/{kind}").parquet(*names)


def _without_dead(spark: SparkSession, path: str, state: dict, rows: DataFrame) -> DataFrame:
    names = [f"{path}/tombstones/name={t['name']}" for t in state["tombstones"]]
    if not names:
        return rows
    dead = spark.read.schema("segment string, id long").parquet(*names)
    return rows.join(dead, ["segment", "id"], "left_anti")


def _documents(spark: SparkSession, path: str, state: dict) -> DataFrame:
    names = [f"{path}/documents/segment={s['name']}" for s in state["segments"]]
    return _without_dead(spark, path, state, spark.read.option("basePath", f"{path}/documents").parquet(*names).withColumn("segment", F.col("segment").cast("string")))


def _each(rows: DataFrame) -> DataFrame:
    """A row a posting."""
    each = rows.select("segment", "term", "column", F.inline(F.arrays_zip("id", "words", "at", "first")))
    return each.withColumn("block", F.shiftright("id", BLOCK_BITS))


def _each_block(rows: DataFrame) -> DataFrame:
    """``term, column, block, most, short, n, firsts`` without positions; a block may have several rows."""
    whole = F.array(F.struct("block", "most", "short", "n", "firsts"))
    one = lambda x: F.struct(F.shiftright(x["id"], BLOCK_BITS).alias("block"), x["times"].alias("most"), x["words"].alias("short"), F.lit(1).cast("long").alias("n"), x["first"].cast("long").alias("firsts"))
    return rows.select("term", "column", F.inline(F.when(F.col("wide"), F.transform(F.arrays_zip("id", "times", "words", "first"), one)).otherwise(whole)))


def _in_rows(postings: DataFrame) -> DataFrame:
    """Postings in rows again, as ``_postings`` makes them; a group is a term's in ``2 ** SPAN_BITS`` blocks at most."""
    near = Window.partitionBy("term", "column", F.shiftright("block", SPAN_BITS))
    blocks = F.size(F.collect_set("block").over(near))
    wide = (blocks > 1) & (F.count(F.lit(1)).over(near) < DENSE * blocks)
    first = F.min("block").over(near)
    rows = postings.withColumns({"wide": wide, "block": F.when(wide, first).otherwise(F.col("block")), "times": F.size("at")})
    key = ["term", "column", "wide", "block"]
    before = Window.partitionBy(*key).orderBy("id").rowsBetween(Window.unboundedPreceding, -1)
    piece = F.floor(F.coalesce(F.sum("times").over(before), F.lit(0)) / TOKENS_AT_ONCE)
    figures = [F.max("times").alias("most"), F.min("words").alias("short"), F.count(F.lit(1)).alias("n"), F.count_if("first").alias("firsts")]
    lists = NAMES[NAMES.index("id") :]
    found = rows.withColumn("piece", piece).groupBy(*key, "piece").agg(*figures, F.sort_array(F.collect_list(F.struct(*lists))).alias("p"))
    return found.select(*(F.col(f"p.{c}").alias(c) if c in lists else c for c in NAMES))


def _of_words(rows: DataFrame, words: list[str]) -> DataFrame:
    buckets = sorted({zlib.crc32(w.encode()) % BUCKETS for w in words})
    return rows.where(F.col("bucket").isin(buckets) & F.col("term").isin(words))


def terms_of(spark: SparkSession, path: str, words: list[str], state: dict | None = None, blocks: list[int] | DataFrame | None = None) -> DataFrame:
    """Postings of some words, of some blocks or all: their buckets and row groups are read, no others."""
    state = state or state_of(spark, path)
    found = _of_words(_read(spark, path, "postings", state, f"{POSTINGS}, bucket int"), words)
    if isinstance(blocks, list):
        found = found.where(F.col("wide") | F.col("block").isin(blocks))
    each = _each(found)
    if isinstance(blocks, list):
        each = each.where(F.col("block").isin(blocks))
    elif blocks is not None:
        each = each.join(blocks, "block", "left_semi")
    return _without_dead(spark, path, state, each).drop("segment")


def term_statistics(spark: SparkSession, path: str, words: list[str], columns: tuple[str, ...] | None = None) -> DataFrame:
    """``term, df, cf``: documents that hold a word, and its occurrences, in some columns or in all."""
    rows = terms_of(spark, path, words)
    rows = rows if columns is None else rows.where(F.col("column").isin(*columns))
    return rows.groupBy("term").agg(F.count_distinct("id").alias("df"), F.sum(F.size("at")).alias("cf"))


def search(
    spark: SparkSession, path: str, query: StructuredQuery, limit: int | None = 10, weights: dict[str, float] = WEIGHTS, k1: float = K1, b: float = B, relax: bool = False, prune: bool = True
) -> DataFrame:
    """``id, score, rung`` as ``folio.operators.retrieval.search`` gives them, from the index at ``path``.

    With a limit and single words, blocks that cannot reach the limit's last score are not read (see ``pruned``).
    """
    rungs, terms = request(query, relax)
    if not terms:
        return nothing(spark)
    state = state_of(spark, path)
    plan = pruned(spark, path, state, query, limit, weights, k1, b) if prune and limit and len(rungs) == 1 else None
    blocks, frequencies = (plan["blocks"], plan["frequencies"]) if plan else (None, None)
    return _ranked(spark, path, state, query, rungs, terms, limit, weights, k1, b, blocks, frequencies)


def _ranked(spark, path, state, query, rungs, terms, limit, weights, k1, b, blocks=None, frequencies=None) -> DataFrame:
    words = sorted({w for ws in terms.values() for w in ws})
    names = {t: f"f{i}" for i, t in enumerate(terms)}
    here = terms_of(spark, path, words, state, blocks).where(F.col("column").isin([c for c, w in weights.items() if w > 0]))
    place = lambda w: F.max(F.when(F.col("term") == w, F.col("at")))
    at = {w: f"p{i}" for i, w in enumerate(words)}
    columns = here.groupBy("id", "column").agg(*(F.coalesce(place(w), F.array().cast("array<int>")).alias(at[w]) for w in words))
    weight = F.coalesce(*(F.when(F.col("column") == c, F.lit(w)) for c, w in weights.items()))

    def times(ws: list[str]) -> Column:
        if len(ws) == 1:
            return F.size(at[ws[0]])
        follows = lambda p: reduce(lambda x, y: x & y, [F.array_contains(F.col(at[w]), p + i) for i, w in enumerate(ws[1:], 1)])
        return F.size(F.filter(F.col(at[ws[0]]), follows))

    table = columns.groupBy("id").agg(*(F.sum(weight * times(ws)).alias(names[t]) for t, ws in terms.items()))
    documents = _documents(spark, path, state)
    used = [c for c in state["columns"] if weights.get(c, 0) > 0]
    n, total = _live(state)
    mean = sum(total[c] for c in used) / n if n else None
    length = reduce(lambda x, y: x + y, [F.col(f"len_{c}") for c in used])
    carried = [c for c in FILTERED if c in documents.columns]
    rows = table.join(documents.select("id", *carried, length.alias("len")), "id")
    collection = spark.createDataFrame([(n, mean)], "n long, avg double")
    counted = None if frequencies is None else {names[t]: frequencies[t] for t in terms}
    return ranked(rows, query, rungs, names, limit, k1, b, collection, counted)


def pruned(
    spark: SparkSession, path: str, state: dict, query: StructuredQuery, limit: int, weights: dict[str, float] = WEIGHTS, k1: float = K1, b: float = B
) -> dict | None:
    """Which blocks a search for the best ``limit`` rows has to read: ``blocks``, ``frequencies``, ``read`` and ``all`` postings.

    From a term's largest frequency and shortest column in a block follows what any document of the block can
    score at most. The blocks that promise most are ranked first; what the last of the best ``limit`` found there
    scores, a block must be able to reach. The rows are those of a full search. None where that does not hold or
    pay: phrases, weights for some columns only (unless it is a single one), tombstones, or few blocks.
    """
    rungs, terms = request(query)
    used = [c for c in state["columns"] if weights.get(c, 0) > 0]
    whole = len(used) == len(state["columns"])
    if state["tombstones"] or not (whole or len(used) == 1) or any(len(ws) > 1 for ws in terms.values()):
        return None
    words = {ws[0] for ws in terms.values()}
    meta = _each_block(_of_words(_read(spark, path, "postings", state, f"{BLOCKS}, bucket int"), sorted(words)).where(F.col("column").isin(used)))
    counts = {r["term"]: r for r in meta.groupBy("term").agg(F.sum("firsts" if whole else "n").alias("df"), F.sum("n").alias("n"), F.count_distinct("block").alias("blocks")).collect()}
    first = max(4 * limit, 32)
    if max((r["blocks"] for r in counts.values()), default=0) <= 2 * first:
        return None
    frequencies = {t: counts[ws[0]]["df"] if ws[0] in counts else 0 for t, ws in terms.items()}
    n, total = _live(state)
    mean = sum(total[c] for c in used) / n
    positive = {terms[t.lower()][0] for f in FACETS for t in query.facet(f) if t.lower() in terms}
    weight = F.coalesce(*(F.when(F.col("column") == c, F.lit(float(w))) for c, w in weights.items()))
    # a block's documents may lie in several segments, so its figures are put together first
    column = meta.where(F.col("term").isin(*positive)).groupBy("block", "term", "column").agg(F.max("most").alias("most"), F.min("short").alias("short"), F.sum("n").alias("n"))
    term = column.groupBy("block", "term").agg(F.sum(weight * F.col("most")).alias("f"), F.min("short").alias("len"), F.sum("n").alias("n"))
    idf = F.coalesce(*(F.when(F.col("term") == w, F.lit(math.log(1 + (n - r["df"] + 0.5) / (r["df"] + 0.5)))) for w, r in counts.items()), F.lit(0.0))
    part = idf * F.col("f") * (k1 + 1) / (F.col("f") + k1 * (1 - b + b * F.col("len") / mean))
    bounds = term.groupBy("block").agg(F.sum(part).alias("most"), F.sum("n").alias("n"))
    best = [r["block"] for r in bounds.orderBy(F.col("most").desc()).limit(first).collect()]
    found = _ranked(spark, path, state, query, rungs, terms, limit, weights, k1, b, best, frequencies).collect()
    least = found[-1]["score"] if len(found) == limit else 0.0
    # sums in another order may differ in their last digits
    needed = bounds.where(F.col("most") >= least * (1 - 1e-9))
    row = needed.agg(F.count(F.lit(1)).alias("blocks"), F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()
    blocks = [r["block"] for r in needed.select("block").collect()] if row["blocks"] <= 10_000 else needed.select("block")
    return {"blocks": blocks, "frequencies": frequencies, "read": row["n"], "all": sum(r["n"] for w, r in counts.items() if w in positive)}
