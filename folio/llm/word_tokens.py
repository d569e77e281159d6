"""Exact ids of a word-splitting tokenizer, with one library call per distinct word.

The tokenizer splits at white space before anything else and drops it, so the ids of a text are the
ids of its chunks between spaces and newlines put together. A text of plain letters and signs is
split into lower-case words here, by the tokenizer's own pattern, and so is a plain chunk of any other
text; other chunks go to the library whole. Both chunks and words repeat, so each worker keeps bounded caches of their ids. New words go to
the library side by side, through its model and byte letters only, since their form is settled: only
the last id of a word is one that ends words, so the ids fall apart again.
"""

from __future__ import annotations

import json
import os
import re

import numpy as np

from folio.llm.common import hold

END_ID = 1
CACHE_CHUNKS = 400_000
CACHE_WORDS = 1_200_000
CACHE_CHARS = 48
#: characters on which the pattern below, lower case and composed form agree with the tokenizer's
PLAIN = re.compile(r"[!-~À-ÖØ-öø-ÿ¡¿«»]*")
WORD = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-zß-öø-ÿ0-9]+")
#: the same for whole texts of such characters, spaces and line ends: no word goes over one of these
PLAIN_TEXT = re.compile(r"[ \n!-~À-ÖØ-öø-ÿ¡¿«»]*")
TEXT_WORD = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^ \na-zß-öø-ÿ0-9]+")
PIECE_CHARS = 1_000_000

_encoders: dict[str, ChunkEncoder] = {}


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class ChunkEncoder:
    def __init__(self, path: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        suffix = spec["model"].get("end_of_word_suffix") or ""
        pattern = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
        #: whether chunks may be split here; otherwise the library gets each chunk whole
        self.splits = bool(suffix) and json.dumps(pattern) in json.dumps(spec["pre_tokenizer"])
        self.ends = np.zeros(self.size, bool)
        for text, i in spec["model"]["vocab"].items():
            self.ends[i] = bool(suffix) and text.endswith(suffix)
        #: how the strings of added tokens begin; chunks that hold one go to the library whole
        self.special = {t["content"][:2] for t in spec.get("added_tokens", [])}
        self.lean = Tokenizer.from_file(path)
        self.lean.normalizer = normalizers.Sequence([])
        self.lean.pre_tokenizer = pre_tokenizers.Sequence(
            [pre_tokenizers.Split(" ", "removed"), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)]
        )
        self.chunks: dict[str, bytes] = {"": b""}
        self.words: dict[str, bytes] = {}

    def _library(self, texts: list[str]) -> list[bytes]:
        out: list[bytes] = []
        for at in range(0, len(texts), 5_000):
            found = self.tokenizer.encode_batch_fast(texts[at : at + 5_000], add_special_tokens=False)
            out.extend(np.array(e.ids, "<u4").tobytes() for e in found)
        return out

    def _learn_words(self, words: list[str]) -> None:
        known = self.words
        lists = [words[at : at + 100] for at in range(0, len(words), 100)]
        for at in range(0, len(lists), 50):
            some = lists[at : at + 50]
            coded = self.lean.encode_batch_fast([" ".join(ws) for ws in some], add_special_tokens=False)
            for ws, one in zip(some, coded, strict=True):
                ids = np.array(one.ids, "<u4")
                last = np.flatnonzero(self.ends[ids]) + 1
                if len(last) == len(ws) and last[-1] == len(ids):
                    data, start = ids.tobytes(), 0
                    for word, end in zip(ws, (4 * last).tolist(), strict=True):
                        known[word] = data[start:end]
                        start = end
                else:
                    known.update(zip(ws, self._library(ws), strict=True))

    def _learn(self, chunks: set[str]) -> None:
        split, whole = [], []
        for c in chunks:
            if self.splits and c.isascii() and c.isalpha():
                split.append((c, [c.lower()]))
            elif self.splits and PLAIN.fullmatch(c) and not any(s in c for s in self.special):
                split.append((c, WORD.findall(c.lower())))
            else:
                whole.append(c)
        self.chunks.update(zip(whole, self._library(whole), strict=True))
        words = self.words
        self._learn_words(list({w for _, ws in split for w in ws if w not in words}))
        for c, ws in split:
            self.chunks[c] = words[ws[0]] if len(ws) == 1 else b"".join([words[w] for w in ws])
        if len(words) > CACHE_WORDS:
            words.clear()

    def _plain(self, texts: list[str]) -> list[bytes]:
        """Ids of plain texts: their words at once, each looked up."""
        found = [TEXT_WORD.findall(t.lower()) for t in texts]
        known = self.words
        missing = set().union(*found).difference(known)
        self._learn_words(list(missing))
        out = [b"".join(map(known.__getitem__, words)) for words in found]
        if len(known) > CACHE_WORDS:
            known.clear()
        else:
            for w in missing:
                if len(w) > CACHE_CHARS:
                    del known[w]
        return out

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text, then ``END_ID``, as little-endian unsigned 32-bit integers."""
        end = END_ID.to_bytes(4, "little")
        out, plain, other = [b""] * len(texts), [], []
        for i, t in enumerate(texts):
            if t:
                whole = self.splits and PLAIN_TEXT.fullmatch(t) and not any(s in t for s in self.special)
                (plain if whole else other).append(i)
        for i in [i for i in plain if len(texts[i]) > PIECE_CHARS]:
            out[i] = b"".join(self._plain([piece])[0] for piece in _pieces(texts[i]))
        short = [i for i in plain if len(texts[i]) <= PIECE_CHARS]
        for i, ids in zip(short, self._plain([texts[i] for i in short]), strict=True):
            out[i] = ids
        for i, ids in zip(other, self._chunked([texts[i] for i in other]), strict=True):
            out[i] = ids
        return [ids + end for ids in out]

    def _chunked(self, texts: list[str]) -> list[bytes]:
        split = [t.replace("\n", " ").split(" ") for t in texts]
        known = self.chunks
        missing = {c for chunks in split for c in chunks if c not in known}
        self._learn(missing)
        out = [b"".join(map(known.__getitem__, chunks)) for chunks in split]
        if len(known) > CACHE_CHUNKS:
            known.clear()
            known[""] = b""
        else:
            for c in missing:
                if len(c) > CACHE_CHARS:
                    del known[c]
        return out


def _pieces(text: str):
    """A long text in pieces that end where a space or line end follows."""
    at = 0
    while at < len(text):
        end = len(text)
        if end - at > PIECE_CHARS:
            stops = [x for x in (text.find(" ", at + PIECE_CHARS), text.find("\n", at + PIECE_CHARS)) if x >= 0]
            end = min(stops, default=end)
        yield text[at:end]
        at = end


def encoder(path: str) -> ChunkEncoder:
    """One per worker process and file."""
    hold("word tokens", _encoders.clear)
    if path not in _encoders:
        _encoders[path] = ChunkEncoder(path)
    return _encoders[path]


def slices(texts: list[str | None], chars: int = 1_000_000):
    """Index ranges whose texts hold about ``chars`` characters, a longer text alone."""
    start = size = 0
    for i, t in enumerate(texts):
        n = len(t) if t else 0
        if size and size + n > chars:
            yield start, i
            start, size = i, 0
        size += n
    if start < len(texts):
        yield start, len(texts)
