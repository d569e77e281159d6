"""Greedy word-piece lengths by a linear longest-match automaton (op 4).

The vocabulary is a trie over bytes, a word's last byte being a symbol of its own where pieces mark
word ends (so a piece without the mark never reaches the end of a word). Where a letter has no child, the greedy
algorithm would cut off pieces and start again; each node's failure link names the node it would
stand at then, and a count says how many pieces were cut off. So a word is read once, left to right,
and only counts are added: no piece is ever built.
"""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from folio.llm.common import documents_of
from folio.llm.word_tokens import slices, default_tokenizer

LAST = 256  # added to the last byte of a word
SYMBOLS = 512
DEAD = -1
CACHE_CHUNKS = 400_000
CACHE_CHARS = 48
LONG_WORD = 512

_counters: dict = {}


class Automaton:
    """Trie with failure links over pieces (tuples of symbols); ``rest`` are the pieces inside a word.

    Without ``rest`` the same pieces start and continue a word. A word that greedy longest match cannot
    cover counts as one unknown piece.
    """

    def __init__(self, pieces: list[tuple[int, ...]], rest: list[tuple[int, ...]] | None = None, marks: bool = True) -> None:
        self.go: dict[int, int] = {}
        self.last = LAST if marks else 0
        nodes, final = 1, {0: False}
        self.root = 0
        if rest is None:
            self.inner = 0
            sets = [(0, pieces)]
        else:
            self.inner, nodes = 1, 2
            final[1] = False
            sets = [(0, pieces), (1, rest)]
        for root, group in sets:
            for piece in group:
                node = root
                for c in piece:
                    key = node * SYMBOLS + c
                    if (to := self.go.get(key)) is None:
                        to = self.go[key] = nodes
                        final[nodes] = False
                        nodes += 1
                    node = to
                if piece:
                    final[node] = True
        self.fail, self.popped = np.full(nodes, DEAD, np.int64), np.zeros(nodes, np.int64)
        self._link(final)
        keys = np.array(sorted(self.go), np.int64)
        self.keys, self.to = keys, np.array([self.go[k] for k in keys.tolist()], np.int64)

    def _link(self, final: dict[int, bool]) -> None:
        children: dict[int, list[tuple[int, int]]] = {}
        for key, to in self.go.items():
            children.setdefault(key // SYMBOLS, []).append((key % SYMBOLS, to))
        level = [self.root] if self.inner == self.root else [self.root, self.inner]
        fail, popped = self.fail, self.popped
        while level:
            below = []
            for node in level:
                for c, child in children.get(node, ()):
                    below.append(child)
                    if final[child]:
                        fail[child], popped[child] = self.inner, 1
                        continue
                    at, n = int(fail[node]), int(popped[node])
                    while at != DEAD and (to := self.go.get(at * SYMBOLS + c)) is None:
                        n += int(popped[at])
                        at = int(fail[at])
                    if at != DEAD:
                        fail[child], popped[child] = to, n
            level = below

    def count_one(self, word: bytes) -> int:
        """Pieces of one word that is not empty: the same walk, letter by letter."""
        go, fail, popped = self.go, self.fail, self.popped
        at, n = self.root, 0
        for c in (*word[:-1], word[-1] + self.last):
            while (to := go.get(at * SYMBOLS + c)) is None:
                n += int(popped[at])
                at = int(fail[at])
                if at == DEAD:
                    return 1
            at = to
        while at != self.inner:
            n += int(popped[at])
            at = int(fail[at])
            if at == DEAD:
                return 1
        return n

    def count(self, words: list[bytes]) -> np.ndarray:
        """Pieces of each word, all words advancing one letter at a time."""
        out = np.zeros(len(words), np.int64)
        short = []
        for i, w in enumerate(words):
            if len(w) > LONG_WORD:
                out[i] = self.count_one(w)
            else:
                short.append(i)
        short.sort(key=lambda i: -len(words[i]))
        lengths = np.array([len(words[i]) for i in short], np.int64)
        data = np.frombuffer(b"".join(words[i] for i in short), np.uint8)
        starts = np.cumsum(lengths) - lengths
        n, state = np.zeros(len(short), np.int64), np.full(len(short), self.root, np.int64)
        lost = np.zeros(len(short), bool)
        for t in range(int(lengths.max(initial=0))):
            live = int(np.searchsorted(-lengths, -t, "left"))
            symbol = data[starts[:live] + t].astype(np.int64)
            symbol[lengths[:live] == t + 1] += self.last
            todo = np.flatnonzero(~lost[:live])
            while len(todo):
                key = state[todo] * SYMBOLS + symbol[todo]
                pos = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
                hit = self.keys[pos] == key
                state[todo[hit]] = self.to[pos[hit]]
                todo = todo[~hit]
                todo = self._fall(todo, state, n, lost)
        todo = np.flatnonzero(~lost & (state != self.inner))
        while len(todo):
            todo = self._fall(todo, state, n, lost)
            todo = todo[state[todo] != self.inner]
        n[lost] = 1
        out[short] = n
        return out

    def _fall(self, todo, state, n, lost) -> np.ndarray:
        at = state[todo]
        n[todo] += self.popped[at]
        state[todo] = self.fail[at]
        gone = state[todo] == DEAD
        lost[todo[gone]] = True
        return todo[~gone]


class WordPieceCounter:
    """Word pieces of whole texts under a word-splitting vocabulary whose pieces mark the word end.

    Normalising and word splitting are those of the vocabulary's file: composed form, lower case, runs
    of letters, single digits, runs of other signs; white space is dropped.
    """

    PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"

    def __init__(self, path: str) -> None:
        import regex

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocabulary, suffix = spec["model"]["vocab"], spec["model"]["end_of_word_suffix"]
        if self.PATTERN not in json.dumps(spec["pre_tokenizer"], ensure_ascii=False).replace("\\\\", "\\"):
            raise ValueError("the vocabulary splits words in another way")
        byte_of = {c: b for b, c in byte_letters().items()}
        special = {t["content"] for t in spec["added_tokens"]}
        pieces = []
        for text in vocabulary:
            if text in special:
                continue
            end = text.endswith(suffix) and text != suffix
            body = text[: -len(suffix)] if end else text
            piece = [byte_of[c] for c in body]
            piece[-1] += LAST if end else 0
            pieces.append(tuple(piece))
        self.automaton = Automaton(pieces)
        self.find = regex.compile(self.PATTERN).findall
        self.cache: dict[str, tuple[int, int]] = {"": (0, 0)}

    def words(self, text: str) -> list[bytes]:
        text = unicodedata.normalize("NFC", text)
        text = text.lower() if text.isascii() else "".join([c.lower() for c in text])
        return [w.encode("utf-8", "surrogatepass") for w in self.find(text)]

    def _learn(self, chunks: list[str]) -> dict[str, tuple[int, int]]:
        split = [self.words(c) for c in chunks]
        number: dict[bytes, int] = {}
        for ws in split:
            for w in ws:
                number.setdefault(w, len(number))
        counts = self.automaton.count(list(number)).tolist()
        return {c: (len(ws), sum(counts[number[w]] for w in ws)) for c, ws in zip(chunks, split, strict=True)}

    def count(self, texts: list[str | None]) -> list[tuple[int, int]]:
        """Words and pieces of each text."""
        split = [(t or "").replace("\n", " ").split(" ") for t in texts]
        cache = self.cache
        found = self._learn(list({c for cs in split for c in cs if c not in cache}))
        if len(cache) + len(found) > CACHE_CHUNKS:
            found |= {c: cache[c] for cs in split for c in cs if c in cache}
            cache.clear()
            cache[""] = (0, 0)
        if len(cache) + len(found) <= CACHE_CHUNKS:
            cache.update((c, v) for c, v in found.items() if len(c) <= CACHE_CHARS)
            found = {c: v for c, v in found.items() if len(c) > CACHE_CHARS}
        out = []
        for cs in split:
            pairs = [found[c] if c in found else cache[c] for c in cs] if found else list(map(cache.__getitem__, cs))
            out.append((sum(p[0] for p in pairs), sum(p[1] for p in pairs)))
        return out


def byte_letters() -> dict[int, str]:
    """The printable letter that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(rest)}


def counter(path: str) -> WordPieceCounter:
    """One per worker process and vocabulary."""
    if path not in _counters:
        _counters[path] = WordPieceCounter(path)
    return _counters[path]


def count_tokens(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """``doc_id, n_words, n_tokens`` of every whole text.

    Null and empty texts have none; rows stay rows, repeated or not, also without an id; an empty table gives
    none; other columns, whatever their names, are left out. Texts of any length are counted whole, a very long
    word letter by letter.
    """
    path = vocabulary or default_tokenizer()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = counter(path)
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for i, j in slices(texts, 16_000_000):
                counts = c.count(texts[i:j])
                yield pa.RecordBatch.from_pydict(
                    {
                        "doc_id": batch.column("doc_id").slice(i, j - i),
                        "n_words": pa.array([a for a, _ in counts], pa.int64()),
                        "n_tokens": pa.array([b for _, b in counts], pa.int64()),
                    }
                )

    return documents_of(docs).mapInArrow(run, "doc_id long, n_words long, n_tokens long")
