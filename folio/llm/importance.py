"""Importance resampling towards a target: hashed word n-grams, collapsed texts, noise by document (op 11).

Equal texts are grouped by their full text first; features and weight are computed once a text, its counts
multiply by its copies, and the weight goes back to every copy before the noise, which depends on the document
alone. A text's features are kept as one byte each or little more (gaps of sorted buckets).
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folio.llm.common import shuffle_partitions, staged, unstaged
from folio.llm.word_tokens import slices

BUCKETS = 10_000
LONGEST = 3
PERCENT = 5
LEAST_WORDS = 20
SEED = 42
PIECE = 1 << 20

#: letters A-Z in lower case, everything that no word holds as a space
WORDS = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)


def feature_hashes(text: str | None, longest: int = LONGEST) -> tuple[int, np.ndarray]:
    """Words of a text and the crc32 of every run of 1 to ``longest`` of them, joined by one space."""
    data = (text or "").encode("utf-8", "surrogatepass").translate(WORDS)
    words, found, at, tail = 0, [], 0, []
    while at < len(data):
        end = data.find(b" ", at + PIECE) if len(data) - at > PIECE else -1
        end = end if end >= 0 else len(data)
        fresh = data[at:end].split()
        at, run = end, tail + fresh
        words += len(fresh)
        # a run of one more word goes on from the checksum of the run before it; what ends in the tail was counted
        spaced, sums = [b" " + w for w in run], list(map(crc32, run))
        found.append(np.array(sums[len(tail) :], np.uint32))
        for n in range(1, longest):
            sums = list(map(crc32, spaced[n:], sums))
            found.append(np.array(sums[max(len(tail) - n, 0) :], np.uint32))
        tail = run[len(run) - longest + 1 :] if len(run) >= longest else run
    return words, np.concatenate(found) if found else np.zeros(0, np.uint32)


def pack_gaps(values: np.ndarray) -> bytes:
    """Whole numbers from 0, sorted, as gaps of one byte; 255 says that the gap goes on."""
    gaps = np.diff(np.sort(values), prepend=0)
    full = gaps // 255
    out = np.full(len(gaps) + int(full.sum()), 255, np.uint8)
    out[np.cumsum(full + 1) - 1] = gaps % 255
    return out.tobytes()


def unpack_gaps(data: bytes) -> np.ndarray:
    steps = np.frombuffer(data, np.uint8)
    return np.cumsum(steps, dtype=np.int64)[steps != 255]


FEATURES = "key binary, copies long, words long, n_features long, gaps binary"


def text_features(texts: Column, table: DataFrame, buckets: int = BUCKETS, longest: int = LONGEST) -> DataFrame:
    """One row a distinct text: ``key`` (its sha256), ``copies``, ``words``, ``n_features`` and its packed buckets."""
    distinct = table.select(F.coalesce(texts.cast("string"), F.lit("")).alias("text")).groupBy("text").agg(F.count(F.lit(1)).alias("copies"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = batch.column("text")
            for i, j in slices(found.to_pylist()):
                words, sizes, gaps = [], [], []
                for text in found.slice(i, j - i).to_pylist():
                    n, hashes = feature_hashes(text, longest)
                    words.append(n)
                    sizes.append(len(hashes))
                    gaps.append(pack_gaps((hashes % np.uint32(buckets)).astype(np.int64)))
                part = batch.slice(i, j - i)
                made = [pa.array(words, pa.int64()), pa.array(sizes, pa.int64()), pa.array(gaps, pa.binary())]
                yield pa.RecordBatch.from_arrays([part.column("key"), part.column("copies"), *made], names=["key", "copies", "words", "n_features", "gaps"])

    return distinct.select(text_key(F.col("text")).alias("key"), "copies", "text").mapInArrow(run, FEATURES)


def text_key(text: Column) -> Column:
    return F.unhex(F.sha2(F.coalesce(text.cast("string"), F.lit("")), 256))


def bucket_counts(features: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """Features in each bucket over all copies of all texts; the driver gets ``buckets`` numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for n, data in zip(batch.column("copies").to_pylist(), batch.column("gaps").to_pylist(), strict=True):
                total += n * np.bincount(unpack_gaps(data), minlength=buckets)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"bucket": pa.array(seen, pa.int32()), "n": pa.array(total[seen], pa.int64())})

    rows = features.select("copies", "gaps").mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(buckets, np.int64)
    for row in rows:
        out[row["bucket"]] = row["n"]
    return out


def bucket_gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the logarithm of each bucket's smoothed share in the target over that in the source, rounded down."""
    n, all_source, all_target = len(source), float(source.sum() + len(source)), float(target.sum() + len(target))
    ratio = lambda s, t: ((t + 1.0) * all_source) / ((s + 1.0) * all_target)
    return np.array([math.floor(1000 * math.log(ratio(int(source[i]), int(target[i])))) for i in range(n)], np.int64)


def noise(doc_id: Column, seed: int = SEED) -> Column:
    """A Gumbel draw in thousandths, rounded down, that depends on the seed and the document's id alone."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(name, 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / F.lit(4294967296.0)))).cast("long")


def ranked(rows: DataFrame, first: list[Column], most: Column) -> DataFrame:
    """``rows`` with ``rank`` from 1 in the order of ``first``, null beyond ``most``.

    Ranges of the order are numbered by themselves; one number a partition makes the ranks run through.
    """
    spark = rows.sparkSession
    ranged = rows.repartitionByRange(shuffle_partitions(spark), *first).sortWithinPartitions(*first)
    place = ranged.withColumn("__at", F.monotonically_increasing_id())
    place = staged(place.withColumn("__part", F.shiftrightunsigned("__at", 33)).withColumn("__at", F.col("__at").bitwiseAND((1 << 33) - 1)), "ranked")
    sizes = place.groupBy("__part").agg(F.count(F.lit(1)).alias("n")).orderBy("__part").collect()
    starts, total = [], 0
    for row in sizes:
        starts.append((row["__part"], total))
        total += row["n"]
    start = spark.createDataFrame(starts, "__part long, __start long")
    rank = F.col("__start") + F.col("__at") + 1
    # one row a partition
    return place.join(F.broadcast(start), "__part").withColumn("rank", F.when(rank <= most, rank)).drop("__part", "__at", "__start")


def importance_weights(docs: DataFrame, target: DataFrame, buckets: int = BUCKETS, longest: int = LONGEST) -> DataFrame:
    """``doc_id, key, words, n_features, weight`` of every row of ``docs(doc_id, text)`` for ``target(text)``.

    ``weight`` is the sum of its features' gains. A null text is empty and weighs nothing, as is a text without
    words; equal texts weigh the same and each copy counts; a text of any length is read piece by piece; without
    documents there are no rows, without a target its counts are 0. Other columns are not looked at.
    """
    features = staged(text_features(docs["text"], docs, buckets, longest), "features", "zstd")
    goal = bucket_counts(text_features(target["text"], target, buckets, longest), buckets)
    gains = docs.sparkSession.sparkContext.broadcast(bucket_gains(bucket_counts(features, buckets), goal))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            weights = [int(gains.value[unpack_gaps(data)].sum()) for data in batch.column("gaps").to_pylist()]
            kept = [batch.column(c) for c in ("key", "words", "n_features")]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(weights, pa.int64())], names=["key", "words", "n_features", "weight"])

    weighed = features.select("key", "words", "n_features", "gaps").mapInArrow(run, "key binary, words long, n_features long, weight long")
    names = docs.select(docs["doc_id"].cast("long").alias("doc_id"), text_key(docs["text"]).alias("key"))
    # adaptive execution splits the copies of a hot text; a text's own row stands once on the other side
    joined = staged(names.join(weighed, "key"), "weights")
    unstaged(features)
    return joined


def importance_ranks(
    docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: int = SEED, buckets: int = BUCKETS, longest: int = LONGEST
) -> DataFrame:
    """``doc_id, key, n_features, weight, score, rank`` of every document; ``rank`` is null for those not drawn.

    Drawn are the ``percent`` of the documents with ``least_words`` words whose score is highest, ties by the
    smaller id. Scores are weights plus noise. A null ``doc_id`` has the noise of an empty name; rows that repeat
    each stand for themselves.
    """
    weighed = importance_weights(docs, target, buckets, longest)
    rows = weighed.withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed)).withColumn("enough", F.col("words") >= least_words)
    n = rows.where("enough").count()
    out = ranked(rows, [F.col("enough").desc(), F.col("score").desc(), F.col("doc_id"), F.col("key")], F.lit(percent * n // 100))
    return out.select("doc_id", "key", "n_features", "weight", "score", "rank")


def resampled(docs: DataFrame, target: DataFrame, **options) -> DataFrame:
    """``doc_id, text, rank`` of the documents drawn, for training; ``options`` as in ``importance_ranks``."""
    drawn = importance_ranks(docs, target, **options).where("rank is not null").select("doc_id", "key", "rank")
    texts = docs.select(text_key(docs["text"]).alias("key"), F.coalesce(docs["text"].cast("string"), F.lit("")).alias("text"))
    texts = texts.join(drawn.select("key").distinct(), "key", "left_semi").groupBy("text").agg(F.first("key").alias("key"))
    return drawn.join(texts, "key").select("doc_id", "text", "rank")
