"""Language identification by hyperdimensional letter profiles (op 3).

Every letter has a random vector of +1 and -1, drawn from its code point. A letter n-gram is bound into
one vector: the letters' vectors, each rotated by its place, multiplied together. A document is the
bundle (sum) of its n-grams' vectors, a language the bundle of its training documents, each scaled to
unit length. The language whose prototype has the largest cosine with a document is predicted.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folio.llm.common import hold
from folio.llm.word_tokens import slices

DIMENSIONS = 1024
GRAM = 3
SEED = 20240630
#: about five standard deviations of the cosine of unrelated vectors of 1,024 dimensions
FLOOR = 0.15
#: characters from which on texts of a learned language lie well above that
SURE_CHARS = 200
UNDETERMINED = "und"
#: integer steps of one unit length: sums over partitions are then the same in any order
STEPS = 1 << 20
#: vectors kept of n-grams and of letters, n-grams that are bundled together, characters of a text that are
GRAM_CACHE, LETTER_CACHE, GROUP, LONG = 40_000, 32_768, 8_192, 1_000_000

_profilers: dict = {}


class Profiler:
    """Turns texts into document vectors; keeps a bounded number of vectors of letters and n-grams it has met."""

    def __init__(self, dimensions: int = DIMENSIONS, gram: int = GRAM, seed: int = SEED) -> None:
        self.dimensions, self.gram, self.seed = dimensions, gram, seed
        self.letters = np.zeros((0, dimensions), np.int8)
        self.letter_row: dict[int, int] = {}
        self.is_letter = np.array([chr(c).isalpha() for c in range(0x30000)], bool)
        self.gram_row: dict[tuple, int] = {}
        self.grams = np.zeros((0, dimensions), np.int8)

    def _letter_rows(self, codes: list[int]) -> list[int]:
        new = [c for c in codes if c not in self.letter_row]
        if new and len(self.letter_row) + len(new) > LETTER_CACHE:
            self.letter_row, self.letters = {}, self.letters[:0]
            new = codes
        if new:
            rows = [np.random.default_rng([self.seed, c]).integers(0, 2, self.dimensions, np.int8) * 2 - 1 for c in new]
            self.letter_row.update((c, len(self.letters) + k) for k, c in enumerate(new))
            self.letters = np.concatenate([self.letters, np.array(rows, np.int8)])
        return [self.letter_row[c] for c in codes]

    def _bind(self, grams: np.ndarray) -> np.ndarray:
        """Vectors of n-grams given as rows of code points."""
        bound = np.ones((len(grams), self.dimensions), np.int8)
        for place in range(self.gram):
            values, inverse = np.unique(grams[:, place], return_inverse=True)
            found = self._letter_rows(values.tolist())
            bound *= np.roll(self.letters[found], self.gram - 1 - place, axis=1)[inverse]
        return bound

    def _gram_vectors(self, grams: np.ndarray) -> np.ndarray:
        """Vectors of at most ``GROUP`` n-grams; those of texts with few distinct ones are kept."""
        keys = [g.tobytes() for g in grams]
        if len(self.gram_row) + len(keys) > GRAM_CACHE:
            self.gram_row, self.grams = {}, self.grams[:0]
        new = [i for i, k in enumerate(keys) if k not in self.gram_row]
        if new:
            self.gram_row.update((keys[i], len(self.grams) + k) for k, i in enumerate(new))
            self.grams = np.concatenate([self.grams, self._bind(grams[new])])
        return self.grams[[self.gram_row[k] for k in keys]]

    def _is_letter(self, codes: np.ndarray) -> np.ndarray:
        letter = np.zeros(len(codes), bool)
        known = codes < len(self.is_letter)
        letter[known] = self.is_letter[codes[known]]
        for i in np.flatnonzero(~known):
            letter[i] = chr(codes[i]).isalpha()
        return letter

    def vectors(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """One row a text, and whether it has a letter. Anything but letters is one gap; gaps stand at both ends.

        Longer texts than ``LONG`` are bundled piece by piece; the pieces overlap by an n-gram less one letter.
        """
        out = np.zeros((len(texts), self.dimensions), np.float32)
        has = np.zeros(len(texts), bool)
        short = [i for i, t in enumerate(texts) if t and len(t) <= LONG]
        if short:
            out[short], has[short] = self._bundled([texts[i] for i in short])
        for i, t in enumerate(texts):
            if t and len(t) > LONG:
                out[i], has[i] = self._bundled_long(t)
        return out, has

    def _bundled(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        n = len(texts)
        low = [t.lower() for t in texts]
        sizes = np.array([len(t) for t in low], np.int64) + 1
        codes = np.frombuffer("".join([t + " " for t in low]).encode("utf-32-le", "surrogatepass"), "<u4")
        owner = np.repeat(np.arange(n), sizes)
        letter = self._is_letter(codes)
        has = np.bincount(owner[letter], minlength=n) > 0
        # a gap stays if a letter stands before it; one more opens each text
        keep = letter | np.concatenate(([False], letter[:-1]))
        seq, own = np.where(letter, codes, 0)[keep], owner[keep]
        opens = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1]))) if len(own) else np.empty(0, int)
        return self._summed(np.insert(seq, opens, 0), np.insert(own, opens, own[opens]), n), has

    def _bundled_long(self, text: str) -> tuple[np.ndarray, bool]:
        total, has, held = np.zeros(self.dimensions), False, np.zeros(1, np.uint32)
        for at in range(0, len(text), LONG):
            piece = text[at : at + LONG].lower() + ("" if at + LONG < len(text) else " ")
            codes = np.frombuffer(piece.encode("utf-32-le", "surrogatepass"), "<u4")
            letter = self._is_letter(codes)
            has |= bool(letter.any())
            keep = letter | np.concatenate(([held[-1] != 0], letter[:-1]))
            seq = np.concatenate([held, np.where(letter, codes, 0)[keep]])
            total += self._summed(seq, np.zeros(len(seq), np.int64), 1)[0]
            held = seq[-(self.gram - 1) :] if len(seq) >= self.gram - 1 else seq
        return total, has

    def _summed(self, seq: np.ndarray, own: np.ndarray, n: int) -> np.ndarray:
        """Sums of the n-gram vectors of letter sequences laid end to end, ``own`` naming the text of each letter."""
        g = self.gram
        out = np.zeros((n, self.dimensions), np.float32)
        if len(seq) < g:
            return out
        inside = own[: len(own) - g + 1] == own[g - 1 :]
        values, local = np.unique(seq, return_inverse=True)
        base = len(values)
        code = np.zeros(len(seq) - g + 1, np.int64)
        for place in range(g):
            code = code * base + local[place : len(seq) - g + 1 + place]
        code, own = code[inside], own[: len(own) - g + 1][inside]
        if base**g <= 1 << 24:
            seen = np.zeros(base**g, bool)
            seen[code] = True
            distinct = np.flatnonzero(seen)
            index = np.zeros(base**g, np.int32)
            index[distinct] = np.arange(len(distinct))
            column = index[code]
        else:
            distinct, column = np.unique(code, return_inverse=True)
        for low in range(0, len(distinct), GROUP):  # so many n-grams have vectors at a time
            some = distinct[low : low + GROUP]
            rows = np.empty((len(some), g), np.int64)
            rest = some.copy()
            for place in range(g - 1, -1, -1):
                rest, r = np.divmod(rest, base)
                rows[:, place] = values[r]
            vectors = self._gram_vectors(rows).astype(np.float32)
            mine, at = own, column
            if len(some) < len(distinct):
                here = (column >= low) & (column < low + GROUP)
                mine, at = own[here], column[here] - low
            step = max(1, 4_000_000 // len(some))
            for i in range(0, n, step):  # counts of a few texts at a time, as a dense matrix
                j = min(n, i + step)
                a, b = np.searchsorted(mine, [i, j])
                counts = np.bincount((mine[a:b] - i) * len(some) + at[a:b], minlength=(j - i) * len(some))
                out[i:j] += counts.reshape(j - i, len(some)).astype(np.float32) @ vectors
        return out


def profiler(dimensions: int, gram: int, seed: int) -> Profiler:
    hold("language id", _profilers.clear)
    key = dimensions, gram, seed
    if key not in _profilers:
        _profilers[key] = Profiler(*key)
    return _profilers[key]


@dataclass(frozen=True)
class LanguageModel:
    languages: tuple[str, ...]
    prototypes: np.ndarray  # one unit row a language
    dimensions: int
    gram: int
    seed: int

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """Language and cosine (cut to 0..1); ``und`` and 0 for texts without a letter or without a learned language."""
        h, has = profiler(self.dimensions, self.gram, self.seed).vectors(texts)
        if not self.languages:
            return [UNDETERMINED] * len(texts), np.zeros(len(texts))
        norm = np.linalg.norm(h, axis=1)
        cosine = (h @ self.prototypes.T.astype(np.float32)) / np.maximum(norm, 1e-12)[:, None]
        best = cosine.argmax(axis=1)
        score = np.clip(cosine[np.arange(len(texts)), best].astype(np.float64), 0, 1)
        names = [self.languages[b] if ok else UNDETERMINED for b, ok in zip(best.tolist(), has.tolist(), strict=True)]
        return names, np.where(has, score, 0.0)


def fit(docs: DataFrame, dimensions: int = DIMENSIONS, gram: int = GRAM, seed: int = SEED) -> LanguageModel:
    """Prototypes from ``text`` and non-null ``lang`` of all rows. The driver gets ``languages x dimensions`` sums."""

    def bundle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = profiler(dimensions, gram, seed)
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            texts, langs = batch.column("text").to_pylist(), batch.column("lang").to_pylist()
            for i, j in slices(texts, 2_000_000):
                h, has = p.vectors(texts[i:j])
                norm = np.linalg.norm(h, axis=1)
                unit = np.rint(h / np.maximum(norm, 1e-12)[:, None] * STEPS).astype(np.int64)
                names = np.array(langs[i:j], object)
                for lang in set(langs[i:j]):
                    mine = unit[(names == lang) & has].sum(axis=0)
                    sums[lang] = sums.get(lang, 0) + mine
        for lang, total in sorted(sums.items()):
            yield pa.RecordBatch.from_pydict(
                {
                    "lang": pa.array([lang] * dimensions),
                    "at": pa.array(np.arange(dimensions), pa.int32()),
                    "total": pa.array(total, pa.int64()),
                }
            )

    rows = (
        docs.select(docs["text"].cast("string").alias("text"), docs["lang"].cast("string").alias("lang"))
        .where("text is not null and lang is not null")
        .mapInArrow(bundle, "lang string, at int, total long")
        .groupBy("lang", "at")
        .agg(F.sum("total").alias("total"))
        .toPandas()
    )
    languages, prototypes = [], []
    for lang, group in sorted(rows.groupby("lang")):
        v = group.sort_values("at")["total"].to_numpy(np.float64)
        if v.any():
            languages.append(lang)
            prototypes.append(v / np.linalg.norm(v))
    return LanguageModel(tuple(languages), np.array(prototypes).reshape(-1, dimensions), dimensions, gram, seed)


def predict(docs: DataFrame, model: LanguageModel, keep: list[str], names: tuple[str, str] = ("lang_pred", "lang_score")) -> DataFrame:
    """The columns ``keep`` of ``docs`` (which has ``text``), then language and cosine under ``names``.

    Null texts and texts without a letter give ``und`` and 0. Rows stay rows; an empty table gives none.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kept = docs.select(*(docs[c] for c in keep), *([] if "text" in keep else [docs["text"]]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for i, j in slices(texts, 2_000_000):
                langs, score = shared.value.predict(texts[i:j])
                part = batch.slice(i, j - i)
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(c) for c in keep), pa.array(langs, pa.string()), pa.array(score, pa.float64())], names=[*keep, *names]
                )

    schema = kept.select(*keep).schema.add(names[0], "string").add(names[1], "double")
    return kept.mapInArrow(run, schema)


def fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; -1 for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("long").cast("string").cast("binary")) % folds, F.lit(-1))


def held_out_languages(docs: DataFrame, folds: int = 4, held: int = 2) -> DataFrame:
    """Learn from all folds but ``held``, predict every row: ``doc_id, held_out, lang_pred, score``.

    A null id is not held out; null texts and texts without a letter are ``und`` with score 0; long texts
    count whole; repeated rows are predicted each; an empty table gives none; without any learned language
    all rows are ``und``; other columns, whatever their names, are left out.
    """
    ids = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"], docs["lang"])
    ids = ids.withColumn("held_out", fold(F.col("doc_id"), folds) == held)
    model = fit(ids.where(~F.col("held_out")))
    return predict(ids, model, ["doc_id", "held_out"]).withColumnRenamed("lang_score", "score")


def identified(docs: DataFrame, model: LanguageModel, floor: float = FLOOR, sure: int = SURE_CHARS) -> DataFrame:
    """The rows of ``docs``, all columns, in some learned language.

    Rejected are null texts, texts without a letter, and texts of ``sure`` characters or more whose cosine with
    every prototype is under ``floor``, as letters of no learned language have it. Shorter texts say too little
    and stay. While no language is learned nothing is in one. Repeated rows and null ids stay as they are; an
    empty table gives none.
    """
    judged = predict(docs, model, docs.columns, ("__lang", "__cosine"))
    near = (F.col("__cosine") >= floor) | (F.char_length(F.col("text").cast("string")) < sure)
    return judged.where((F.col("__lang") != UNDETERMINED) & near).select(*docs.columns)
