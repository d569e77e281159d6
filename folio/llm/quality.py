"""Quality classifier: random Fourier features, ridge regression, isotonic calibration (op 10).

Statistics of the whole text (never its label, language, source or id) are scaled, mapped to random
cosines that approximate a Gaussian kernel, and scored by a ridge fit whose normal equations are summed
per partition. Isotonic regression on the training rows turns the sums into probabilities.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from folio.llm.common import shuffle_partitions, staged
from folio.llm.langid import fold
from folio.llm.word_tokens import slices

STATISTICS = (
    "log_chars", "log_words", "mean_word", "std_word", "distinct_words", "log_lines", "distinct_lines",
    "lower", "upper", "digits", "spaces", "marks", "bars", "signs", "high_bytes", "words_a_char",
    "signed_words", "upper_words", "bare_words", "top_word", "stop_lines", "bang_words",
)
FEATURES = 384
WIDTH = 4.0
RIDGE = 1e-3
BINS = 2048
SEED = 20240630
THRESHOLD = 0.3

#: classes of ASCII bytes: letter lower 0, upper 1, digit 2, white space 3, sentence marks 4, bar 5, other signs 6, not ASCII 7
KINDS = np.full(256, 6, np.uint8)
KINDS[ord("a") : ord("z") + 1] = 0
KINDS[ord("A") : ord("Z") + 1] = 1
KINDS[ord("0") : ord("9") + 1] = 2
KINDS[[9, 10, 11, 12, 13, 32]] = 3
KINDS[[ord(c) for c in ".,;:?'\"-()"]] = 4
KINDS[ord("|")] = 5
KINDS[128:] = 7


def statistics(texts: list[str | None]) -> np.ndarray:
    """One row of ``STATISTICS`` a text; an empty or null text has zeros."""
    data = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    n = len(data)
    out = np.zeros((n, len(STATISTICS)))
    sizes = np.array([len(d) for d in data], np.int64)
    buffer = np.frombuffer(b"".join([d + b"\n" for d in data]), np.uint8)
    owner = np.repeat(np.arange(n), sizes + 1)
    kind = KINDS[buffer]
    counts = np.bincount(owner * 8 + kind, minlength=8 * n).reshape(n, 8).astype(np.float64)
    counts[:, 3] -= 1
    chars = np.maximum(sizes, 1)
    # words: runs of anything but white space; every text ends in white space here
    space = kind == 3
    start = np.flatnonzero(~space & np.concatenate(([True], space[:-1])))
    end = np.flatnonzero(space & np.concatenate(([False], ~space[:-1])))
    w_owner, w_len = owner[start], (end - start).astype(np.float64)
    words = np.bincount(w_owner, minlength=n).astype(np.float64)
    some = np.maximum(words, 1)
    mean = np.bincount(w_owner, w_len, n) / some
    square = np.bincount(w_owner, w_len**2, n) / some
    is_lower, is_upper, is_letter = kind == 0, kind == 1, (kind <= 1) | (kind == 7)
    total = lambda flag: np.concatenate(([0], np.cumsum(flag)))
    per = lambda flag: (lambda t: t[end] - t[start])(total(flag))
    lower, upper, letters = per(is_lower), per(is_upper), per(is_letter)
    final = kind[end - 1]
    out[:, 0], out[:, 1] = np.log1p(sizes), np.log1p(words)
    out[:, 2], out[:, 3] = mean, np.sqrt(np.maximum(square - mean**2, 0))
    out[:, 7:15] = counts / chars[:, None]
    out[:, 15] = words / chars
    out[:, 16] = np.bincount(w_owner, final == 6, n) / some
    out[:, 17] = np.bincount(w_owner, (upper > 1) & (lower == 0), n) / some
    out[:, 18] = np.bincount(w_owner, letters == 0, n) / some
    out[:, 21] = np.bincount(w_owner, buffer[end - 1] == ord("!"), n) / some
    for i, d in enumerate(data):
        if not d:
            continue
        ws = d.split()
        if ws:
            tally: dict[bytes, int] = {}
            for w in ws:
                tally[w] = tally.get(w, 0) + 1
            out[i, 4], out[i, 19] = len(tally) / len(ws), max(tally.values()) / len(ws)
        lines = [x for x in d.split(b"\n") if x.strip()]
        out[i, 5] = np.log1p(len(lines))
        out[i, 6] = len(set(lines)) / max(1, len(lines))
        out[i, 20] = sum(x.rstrip()[-1:] in b".!?" for x in lines) / max(1, len(lines))
    out[sizes == 0] = 0
    return out


def with_statistics(docs: DataFrame, keep: list[str]) -> DataFrame:
    """The columns ``keep`` of ``docs`` and ``stats``, the statistics of its ``text``."""
    kept = docs.select(*keep, docs["text"].cast("string").alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("__text").to_pylist()
            for i, j in slices(texts, 2_000_000):
                part, rows = batch.slice(i, j - i), statistics(texts[i:j])
                stats = pa.ListArray.from_arrays(
                    np.arange(0, rows.size + 1, rows.shape[1], dtype=np.int32), pa.array(rows.ravel(), pa.float64())
                )
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), stats], names=[*keep, "stats"])

    return kept.mapInArrow(run, kept.drop("__text").schema.add("stats", ArrayType(DoubleType())))


@dataclass(frozen=True)
class QualityModel:
    center: np.ndarray
    scale: np.ndarray
    weights: np.ndarray  # random frequencies, one column a feature
    phase: np.ndarray
    ridge: np.ndarray
    knots: np.ndarray  # of the calibration: raw score, probability
    levels: np.ndarray

    def features(self, stats: np.ndarray) -> np.ndarray:
        x = np.clip((stats - self.center) / self.scale, -6, 6)
        z = np.cos(x @ self.weights + self.phase) * np.sqrt(2 / len(self.phase))
        return np.concatenate([z, np.ones((len(z), 1))], axis=1)

    def raw(self, stats: np.ndarray) -> np.ndarray:
        return self.features(stats) @ self.ridge

    def score(self, stats: np.ndarray) -> np.ndarray:
        return np.clip(np.interp(self.raw(stats), self.knots, self.levels), 0, 1)


def isotonic(x: np.ndarray, hits: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators over sorted ``x`` with ``hits`` of ``rows``: knots and levels that never fall."""
    blocks: list[list[float]] = []
    for value, h, n in zip(x, hits, rows, strict=True):
        blocks.append([value * n, h, n])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][2] >= blocks[-1][1] * blocks[-2][2]:
            last = blocks.pop()
            blocks[-1] = [a + b for a, b in zip(blocks[-1], last, strict=True)]
    return np.array([b[0] / b[2] for b in blocks]), np.array([b[1] / b[2] for b in blocks])


def _stack(batch: pa.RecordBatch) -> np.ndarray:
    column = batch.column("stats")
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def fit(rows: DataFrame, features: int = FEATURES, width: float = WIDTH, ridge: float = RIDGE, seed: int = SEED) -> QualityModel:
    """Fit on all ``rows(stats, label)``, label 0 or 1. The driver gets sums whose size depends on ``features`` only.

    Without rows every score is 0.5; with one class it is that class.
    """
    spark = rows.sparkSession
    d = len(STATISTICS)
    at = [F.col("stats")[k] for k in range(d)]
    moments = rows.select(
        F.count(F.lit(1)), *(F.avg(c) for c in at), *(F.stddev_pop(c) for c in at)
    ).first()
    rng = np.random.default_rng(seed)
    weights = rng.normal(size=(d, features)) / width
    phase = rng.uniform(0, 2 * np.pi, features)
    if not moments[0]:
        flat = np.array([0.0])
        return QualityModel(np.zeros(d), np.ones(d), weights, phase, np.zeros(features + 1), flat, flat + 0.5)
    center, scale = np.array(moments[1 : d + 1], float), np.array(moments[d + 1 :], float)
    model = QualityModel(center, np.where(scale > 1e-9, scale, 1.0), weights, phase, np.zeros(0), np.zeros(0), np.zeros(0))
    shared = spark.sparkContext.broadcast(model)
    size = features + 1

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((size, size + 1))
        for batch in batches:
            if batch.num_rows:
                z = shared.value.features(_stack(batch))
                y = batch.column("label").to_numpy().astype(np.float64)
                total[:, :size] += z.T @ z
                total[:, size] += z.T @ y
        if total.any():
            yield pa.RecordBatch.from_pydict(
                {"row": pa.array(np.arange(size), pa.int32()), "sums": pa.array([r.tobytes() for r in total], pa.binary())}
            )

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, np.ndarray] = {}
        for batch in batches:
            for row, sums in zip(batch.column("row").to_pylist(), batch.column("sums").to_pylist(), strict=True):
                found[row] = found.get(row, 0) + np.frombuffer(sums)
        yield pa.RecordBatch.from_pydict(
            {"row": pa.array(list(found), pa.int32()), "sums": pa.array([v.tobytes() for v in found.values()], pa.binary())}
        )

    sums = (
        rows.mapInArrow(partial, "row int, sums binary")
        .repartition(min(size, shuffle_partitions(spark)), "row")
        .mapInArrow(summed, "row int, sums binary")
        .collect()
    )
    matrix = np.array([np.frombuffer(r.sums) for r in sorted(sums, key=lambda r: r.row)])
    n = moments[0]
    normal = matrix[:, :size] + ridge * n / features * np.diag([1.0] * features + [0.0])
    model = QualityModel(model.center, model.scale, weights, phase, np.linalg.solve(normal, matrix[:, size]), np.zeros(0), np.zeros(0))
    shared = spark.sparkContext.broadcast(model)

    def binned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                raw = shared.value.raw(_stack(batch))
                bins = np.clip(np.floor((raw + 0.5) / 2 * BINS), 0, BINS - 1).astype(np.int64)
                yield pa.RecordBatch.from_pydict({"bin": pa.array(bins), "label": batch.column("label")})

    bins = (
        rows.select("stats", "label")
        .mapInArrow(binned, "bin long, label int")
        .groupBy("bin")
        .agg(F.sum("label").alias("hits"), F.count(F.lit(1)).alias("n"))
        .orderBy("bin")
        .toPandas()
    )
    middle = (bins["bin"].to_numpy() + 0.5) / BINS * 2 - 0.5
    knots, levels = isotonic(middle, bins["hits"].to_numpy(float), bins["n"].to_numpy(float))
    return QualityModel(model.center, model.scale, weights, phase, model.ridge, knots, levels)


def score(stats: DataFrame, model: QualityModel, keep: list[str]) -> DataFrame:
    """The columns ``keep`` and ``score`` of a table with ``stats``."""
    shared = stats.sparkSession.sparkContext.broadcast(model)
    kept = stats.select(*keep, "stats")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = shared.value.score(_stack(batch)) if batch.num_rows else np.empty(0)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(s, pa.float64())], names=[*keep, "score"])

    return kept.mapInArrow(run, kept.drop("stats").schema.add("score", "double"))


def scored_texts(docs: DataFrame, model: QualityModel, keep: list[str], name: str = "quality_score") -> DataFrame:
    """The columns ``keep`` of ``docs`` and the score of its ``text``, in one pass."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kept = docs.select(*(docs[c] for c in keep), *([] if "text" in keep else [docs["text"]]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for i, j in slices(texts, 2_000_000):
                part, s = batch.slice(i, j - i), shared.value.score(statistics(texts[i:j]))
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), pa.array(s, pa.float64())], names=[*keep, name])

    return kept.mapInArrow(run, kept.select(*keep).schema.add(name, "double"))


def labelled(stats: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows of ``stats(doc_id, stats)`` with a label 0 or 1; a document labelled twice counts twice."""
    marks = labels.select(labels["doc_id"].cast("long").alias("doc_id"), labels["quality"].cast("int").alias("label"))
    return stats.select("doc_id", "stats").join(marks.where("label in (0, 1)"), "doc_id").select("stats", "label")


def held_out_quality(docs: DataFrame, labels: DataFrame, folds: int = 5, held: int = 0, threshold: float = THRESHOLD) -> DataFrame:
    """Learn from labelled rows of all folds but ``held``, score every row: ``doc_id, held_out, score, predicted``.

    A null id has no label and is not held out; null and empty texts are scored like any other, long ones
    whole; repeated rows are scored each; an empty table gives none; other columns, whatever their names,
    are left out. Labels that are null or neither 0 nor 1 count for nothing; without any, scores are 0.5.
    """
    ids = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"])
    stats = staged(with_statistics(ids, ["doc_id"]), "stats").withColumn("held_out", fold(F.col("doc_id"), folds) == held)
    model = fit(staged(labelled(stats.where(~F.col("held_out")), labels), "labelled"))
    out = score(stats, model, ["doc_id", "held_out"])
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def good_documents(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs``, all columns, that score ``threshold`` or more, learned from all labelled rows among them.

    Null, empty and long texts, repeated rows and null ids are scored like any other; an empty table gives
    none, and without labels all rows stay.
    """
    ids = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"])
    model = fit(staged(labelled(staged(with_statistics(ids, ["doc_id"]), "stats"), labels), "labelled"))
    return scored_texts(docs, model, docs.columns, "__quality").where(F.col("__quality") >= threshold).select(*docs.columns)
