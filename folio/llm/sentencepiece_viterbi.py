"""SentencePiece encoding and decoding by a batched numpy Viterbi search (op 2).

Words of equal length advance together, one end position at a time. Every substring that ends there is
probed in the sorted hashes of the pieces, and the best way to reach the position is kept as a
backpointer by a vectorised maximum.

Unigram models: the maximum of summed piece scores. BPE models: by the merge rule, a piece ``t`` can
follow the piece ``s`` that ends the encoding of the prefix only if no merge would cross their
boundary in ``s + t``; exactly one piece passes at each position, and scoring it 0 and the others
minus infinity lets the same maximum give the library's own ids. Whether a pair passes is decided for
whole arrays by undoing the two pieces' merges along the boundary, latest first.

Words longer than ``WINDOW`` (texts without spaces) are cut where no piece spans two letters. What is
still longer is coded in overlapping windows that advance together. By the merge rule pieces follow each
other if every neighbouring pair does, so two windows join exactly at a piece that both have.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from folio.llm.common import documents_of
from folio.llm.word_tokens import slices

SPACE = "▁"
CACHE_WORDS = 600_000
CACHE_CHARS = 32
#: letters of a window, and from one window's start to the next one's
WINDOW, STRIDE = 128, 72
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15 | 1)

_coders: dict = {}


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class HashIndex:
    """Fixed uint64 keys to their positions, by array operations: keys that share a slot move on to the next table."""

    def __init__(self, keys: np.ndarray) -> None:
        self.tables = []
        left = np.arange(len(keys))
        for level in range(64):
            if not len(left):
                break
            bits = max(8, (8 * len(left)).bit_length())
            turn, shift = np.uint64((0xD6E8FEB86659FD93 + 2 * level * 0x9E3779B97F4A7C15) % (1 << 64)), np.uint64(64 - bits)
            with np.errstate(over="ignore"):
                slot = (keys[left] * turn) >> shift
            where = np.full(1 << bits, -1, np.int32)
            where[slot] = left
            kept = where[slot] == left
            self.tables.append((turn, shift, where, keys[np.maximum(where, 0)]))
            left = left[~kept]
        if len(left):
            raise ValueError("equal keys")

    def find(self, h: np.ndarray) -> np.ndarray:
        """Position of each key, or -1."""
        out = np.full(len(h), -1, np.int64)
        for turn, shift, where, keys in self.tables:
            with np.errstate(over="ignore"):
                slot = (h * turn) >> shift
            same = np.flatnonzero(keys[slot] == h)
            out[same] = np.where(where[slot[same]] >= 0, where[slot[same]], out[same])
        return out


class PieceCoder:
    """Encodes and decodes with the pieces of one model; takes a model's path or its bytes."""

    def __init__(self, model: str | bytes) -> None:
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2 as proto

        data = model if isinstance(model, bytes) else open(model, "rb").read()  # noqa: SIM115
        spec = proto.ModelProto()
        spec.ParseFromString(data)
        self.sp = sentencepiece.SentencePieceProcessor(model_proto=data)
        self.bpe = spec.trainer_spec.model_type == proto.TrainerSpec.BPE
        norm = spec.normalizer_spec
        self.plain = norm.name == "identity" and not norm.remove_extra_whitespaces and norm.escape_whitespaces
        self.prefix = SPACE if norm.add_dummy_prefix else ""
        kinds = proto.ModelProto.SentencePiece
        normal = [i for i, p in enumerate(spec.pieces) if p.type == kinds.NORMAL]
        if any(p.type in (kinds.USER_DEFINED, kinds.UNUSED) for p in spec.pieces):
            raise ValueError("models with user-defined or unused pieces are not supported")
        self.unknown = self.sp.unk_id()
        self.byte_ids = [self.sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)] if spec.trainer_spec.byte_fallback else None
        self.text = [spec.pieces[i].piece for i in normal]
        self.ids = np.array(normal, np.int64)
        self.score = np.array([spec.pieces[i].score for i in normal], np.float64)
        self.number = {t: k for k, t in enumerate(self.text)}
        self.max_len = max(map(len, self.text))
        crossing = re.compile(f"[^{SPACE}]{SPACE}")
        #: no piece holds a space after another character, so words are coded apart
        self.words = None if any(crossing.search(t) for t in self.text) else re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")
        self.spans = {(a, b) for t in self.text for a, b in zip(t, t[1:], strict=False)}
        self._hash_pieces()
        if self.bpe:
            self._merge_tables()
        self.surface: list[bytes] = []
        for i, p in enumerate(spec.pieces):
            if p.type == kinds.BYTE:
                self.surface.append(bytes([int(p.piece[3:5], 16)]))
            elif p.type == kinds.NORMAL:
                self.surface.append(p.piece.replace(SPACE, " ").encode())
            else:
                self.surface.append(" ⁇ ".encode() if i == self.unknown else b"")
        self.cache: dict[str, bytes] = {}

    # -- pieces as hashes -------------------------------------------------------------------------

    def _hash_pieces(self) -> None:
        n = len(self.text)
        self.chars = np.zeros((n, self.max_len), np.uint32)
        lengths = np.array([len(t) for t in self.text])
        for k, t in enumerate(self.text):
            self.chars[k, : len(t)] = np.frombuffer(t.encode("utf-32-le"), "<u4")
        h = np.zeros(n, np.uint64)
        with np.errstate(over="ignore"):
            for j in range(self.max_len):
                on = lengths > j
                h[on] = h[on] * MULTIPLIER + (self.chars[on, j].astype(np.uint64) + np.uint64(1))
            self.powers = np.ones(self.max_len + 1, np.uint64)
            for j in range(self.max_len):
                self.powers[j + 1] = self.powers[j] * MULTIPLIER
        #: sorted piece keys, and an index that finds a key's place among them
        self.sorted_to_piece = np.argsort(h, kind="stable")
        self.keys = HashIndex(h[self.sorted_to_piece])

    def _probe(self, h: np.ndarray, codes: np.ndarray, at: int, length: int) -> np.ndarray:
        """Piece number of each word's substring ``at - length : at``, or -1; hits are compared letter by letter."""
        piece = self.keys.find(h)
        hit = np.flatnonzero(piece >= 0)
        piece[hit] = self.sorted_to_piece[piece[hit]]
        if len(hit):
            same = (self.chars[piece[hit], :length] == codes[hit, at - length : at]).all(axis=1)
            if length < self.max_len:
                same &= self.chars[piece[hit], length] == 0
            piece[hit[~same]] = -1
        return piece

    # -- merges -----------------------------------------------------------------------------------

    def _merge_tables(self) -> None:
        """Of each piece: whether it encodes to itself, and the parts of its last merge. Of each pair: the merge's rank."""
        n = len(self.text)
        atoms = sorted({c for t in self.text for c in t if c not in self.number})
        number = self.number | {c: n + k for k, c in enumerate(atoms)}  # letters that are no piece themselves
        self.atom = {ord(c): n + k for k, c in enumerate(atoms)}
        size = n + len(atoms)
        self.rank = np.concatenate([-self.score, np.full(len(atoms), -np.inf)])
        self.rank[[k for t, k in number.items() if len(t) == 1]] = -np.inf
        self.left, self.right = np.full(size, -1), np.full(size, -1)
        self.valid = np.zeros(size, bool)
        #: a piece is odd if a part of it is merged at a later rank than the piece
        self.odd = np.zeros(size, bool)
        self.odd_pairs: dict[tuple[int, int], bool] = {}
        score, pairs = {t: -self.score[k] for t, k in self.number.items()}, {}
        self.piece_rank = score
        for t, k in self.number.items():
            for c in range(1, len(t)):
                if (a := number.get(t[:c])) is not None and (b := number.get(t[c:])) is not None:
                    pairs[a * size + b] = -self.score[k]
            parts, last, worst = self._merged(t)
            if len(parts) == 1:
                self.valid[k] = True
                self.odd[k] = worst >= score[t]
                if last:
                    self.left[k], self.right[k] = number[last[0]], number[last[1]]
        self.size = size
        self.pair_keys = HashIndex(np.array(sorted(pairs), np.uint64))
        self.pair_rank = np.array([*(pairs[k] for k in sorted(pairs)), np.inf])

    def _merged(self, text: str) -> tuple[list[str], tuple[str, str] | None, float]:
        """The merge rule letter by letter: the parts left, the last merge, and the highest rank before it."""
        rank = self.piece_rank
        parts, last, worst, late = list(text), None, -np.inf, -np.inf
        while len(parts) > 1:
            best = min(((rank[x + y], i) for i, (x, y) in enumerate(zip(parts, parts[1:], strict=False)) if x + y in rank), default=None)
            if best is None:
                break
            r, i = best
            last, worst, late = (parts[i], parts[i + 1]), late, max(late, r)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return parts, last, worst

    def _odd_stays(self, a: int, b: int) -> bool:
        if (a, b) not in self.odd_pairs:
            x, y = self.text[a], self.text[b]
            self.odd_pairs[a, b] = self._merged(x + y)[0] == [x, y]
        return self.odd_pairs[a, b]

    def _stays(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether pieces ``a`` and ``b`` next to each other stay apart; -1 stands for a letter in no piece."""
        ok = np.ones(len(a), bool)
        known = (a >= 0) & (b >= 0)
        odd = known & (self.odd[np.maximum(a, 0)] | self.odd[np.maximum(b, 0)])
        odd &= (a < len(self.text)) & (b < len(self.text))
        for i in np.flatnonzero(odd):
            ok[i] = self._odd_stays(int(a[i]), int(b[i]))
        live = np.flatnonzero(known & ~odd)
        x, y = a[live].copy(), b[live].copy()
        limit, tie = np.full(len(live), np.inf), np.zeros(len(live), bool)
        first = True
        while len(live):
            r = self.pair_rank[self.pair_keys.find((x * self.size + y).astype(np.uint64))]
            # a merge across wins if it is due before the merge that used up its part; of equals the left one goes first
            crossed = (r < np.inf) if first else (r < limit) | ((r == limit) & tie & (r < np.inf))
            first = False
            ok[live[crossed]] = False
            rx, ry = self.rank[x], self.rank[y]
            split_left = rx > ry
            limit, tie = np.maximum(rx, ry), ~split_left
            keep = ~crossed & (limit > -np.inf)
            x, y = np.where(split_left, self.right[x], x), np.where(split_left, y, self.left[y])
            live, x, y, limit, tie = live[keep], x[keep], y[keep], limit[keep], tie[keep]
        return ok

    # -- the search -------------------------------------------------------------------------------

    def _paths(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Pieces of words of one length, end to end, where each ends in its word, and each word's range of them.

        A single letter that no piece covers is minus its end.
        """
        size = len(words[0])
        codes = np.frombuffer("".join(words).encode("utf-32-le"), "<u4").reshape(len(words), size)
        n, width = codes.shape
        with np.errstate(over="ignore"):
            prefix = np.zeros((width + 1, n), np.uint64)
            for j in range(width):
                prefix[j + 1] = prefix[j] * MULTIPLIER + (codes[:, j].astype(np.uint64) + np.uint64(1))
        best = np.full((width + 1, n), -np.inf)
        best[0] = 0
        last, step = np.full((width + 1, n), -1, np.int64), np.ones((width + 1, n), np.int32)
        unknown = self.score.min() - 10
        for j in range(1, width + 1):
            found: list[tuple[int, np.ndarray, np.ndarray]] = []
            for length in range(1, min(self.max_len, j) + 1):
                with np.errstate(over="ignore"):
                    h = prefix[j] - prefix[j - length] * self.powers[length]
                piece = self._probe(h, codes, j, length)
                if length == 1:
                    bare = np.flatnonzero(piece < 0)
                    if self.bpe and len(bare):
                        piece[bare] = [self.atom.get(c, -1) for c in codes[bare, j - 1].tolist()]
                    hit = np.arange(n)
                else:
                    hit = np.flatnonzero(piece >= 0)
                if self.bpe:
                    p = piece[hit]
                    hit = hit[(p < 0) | (p >= len(self.text)) | self.valid[np.maximum(p, 0)]]
                if len(hit):
                    found.append((length, hit, piece[hit]))
            if self.bpe:
                where = np.concatenate([h for _, h, _ in found])
                piece = np.concatenate([p for _, _, p in found])
                length = np.concatenate([np.full(len(h), k, np.int32) for k, h, _ in found])
                start = j - length
                value = best[start, where] + np.where((start == 0) | self._stays(last[start, where], piece), 0.0, -np.inf)
                np.maximum.at(best[j], where, value)
                more = value > -np.inf
                w = where[more]
                last[j, w], step[j, w] = piece[more], length[more]
                continue
            for length, hit, piece in reversed(found):  # of equal sums the longest piece stays, as in the library
                value = best[j - length, hit] + np.where(piece >= 0, self.score[np.maximum(piece, 0)], unknown)
                more = value > best[j, hit]
                w = hit[more]
                best[j, w], last[j, w], step[j, w] = value[more], piece[more], length
        trail = []
        at, rows, count = np.full(n, width), np.arange(n), np.zeros(n, np.int64)
        while len(rows):
            piece = last[at, rows]
            trail.append((rows, np.where((piece >= 0) & (piece < len(self.text)), piece, -at), at))
            count[rows] += 1
            at = at - step[at, rows]
            rows, at = rows[at > 0], at[at > 0]
        ends = np.cumsum(count)
        flat, stops = np.empty(int(ends[-1]), np.int64), np.empty(int(ends[-1]), np.int64)
        for k, (rows, piece, stop) in enumerate(trail):
            flat[ends[rows] - 1 - k], stops[ends[rows] - 1 - k] = piece, stop
        return flat, stops, ends - count, ends

    def _segments(self, word: str) -> list[str]:
        """A long word cut between letters that no piece holds side by side; letters in no piece stay together."""
        known, spans = self.number, self.spans
        cuts = [
            i + 1
            for i, pair in enumerate(zip(word, word[1:], strict=False))
            if pair not in spans and (self.byte_ids or pair[0] in known or pair[1] in known)
        ]
        return [word[i:j] for i, j in zip([0, *cuts], [*cuts, len(word)], strict=True)]

    def _windowed(self, words: list[str]) -> dict[str, bytes]:
        """Ids of words longer than a window, by the merge rule. The windows of all words advance together."""
        memo: dict[str, tuple[np.ndarray, np.ndarray]] = {}

        def learn(texts: list[str]) -> None:
            """Pieces and their ends of texts of one length."""
            for at in range(0, len(texts), 20_000):
                some = texts[at : at + 20_000]
                flat, stops, low, high = self._paths(some)
                memo.update((t, (flat[i:j], stops[i:j])) for t, i, j in zip(some, low.tolist(), high.tolist(), strict=True))

        grid = {w: [*range(0, len(w) - WINDOW, STRIDE), len(w) - WINDOW] for w in words}
        learn(list({w[at : at + WINDOW] for w, places in grid.items() for at in places}))
        return {w: self._joined(w, places, memo, learn) for w, places in grid.items()}

    def _joined(self, word: str, grid: list[int], memo: dict, learn) -> bytes:
        """Ids of a word from its windows' pieces."""

        def coded(at: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            """Pieces, ends and starts of the window that begins at ``at``."""
            text = word[at : at + WINDOW]
            if text not in memo:
                learn([text])
            piece, stop = memo[text]
            return np.where(piece < 0, -(stop + at), piece), stop + at, np.concatenate(([at], stop[:-1] + at))

        done: list[np.ndarray] = []
        piece, stop, start = coded(0)
        for at in grid[1:]:
            while at + WINDOW > stop[-1]:
                other = coded(at)
                mine = np.flatnonzero(start >= at)
                shared, i, j = np.intersect1d(start[mine] * 4096 + stop[mine] - start[mine], other[2] * 4096 + other[1] - other[2], return_indices=True)
                if len(shared):
                    done.append(piece[: mine[i[0]]])
                    piece, stop, start = (x[j[0] :] for x in other)
                    break
                # no common piece (a period that the windows don't share): go on from one of the own pieces
                for k in range(len(stop) - 1, 0, -1):
                    if stop[k] + 2 * self.max_len <= stop[-1] and start[k] + WINDOW > stop[-1]:
                        other = coded(int(start[k]))
                        if other[1][0] == stop[k]:
                            done.append(piece[:k])
                            piece, stop, start = other
                            break
                else:  # nothing to hold on to: letter by letter
                    flat, _, low, high = self._paths([word])
                    return self._ids([word], flat, low, high)[0]
        flat = np.concatenate([*done, piece])
        return self._ids([word], flat, np.zeros(1, np.int64), np.array([len(flat)]))[0]

    def _ids(self, words: list[str], flat: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> list[bytes]:
        """Ids of words whose pieces lie in ``flat``; minus ``e`` there is the uncovered letter that ends at ``e``."""
        data = self.ids[np.maximum(flat, 0)].astype("<u4").tobytes()
        out = [data[4 * i : 4 * j] for i, j in zip(starts.tolist(), ends.tolist(), strict=True)]
        bare = np.searchsorted(ends, np.flatnonzero(flat < 0), "right")
        for w in np.unique(bare).tolist():
            ids: list[int] = []
            before = 0
            for p in flat[starts[w] : ends[w]].tolist():
                if p >= 0:
                    ids.append(int(self.ids[p]))
                elif self.byte_ids:
                    ids.extend(self.byte_ids[b] for b in words[w][-p - 1].encode())
                elif before >= 0:  # neighbouring unknown letters are one unknown piece
                    ids.append(self.unknown)
                before = p if p < 0 else 0
            out[w] = np.array(ids, "<u4").tobytes()
        return out

    def _learn(self, words: set[str]) -> dict[str, bytes]:
        long = {w: self._segments(w) for w in words if len(w) > WINDOW}
        words = words - long.keys() | {part for parts in long.values() for part in parts}
        huge = [w for w in words if self.bpe and len(w) > WINDOW]
        found = self._windowed(huge) if huge else {}
        by_length: dict[int, list[str]] = {}
        for w in words.difference(found):
            by_length.setdefault(len(w), []).append(w)
        for size, group in by_length.items():
            step = max(1, 4_000_000 // (size + 1))
            for i in range(0, len(group), step):
                some = group[i : i + step]
                found.update(zip(some, self._ids(some, *(x for k, x in enumerate(self._paths(some)) if k != 1)), strict=True))
        return found | {w: b"".join([found[part] for part in parts]) for w, parts in long.items()}

    def normalize(self, text: str) -> str:
        if not self.plain:
            return self.sp.normalize(text)
        return self.prefix + text.replace(" ", SPACE) if text else ""

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        split = []
        for t in texts:
            t = self.normalize(t or "")
            split.append((self.words.findall(t) if self.words else [t]) if t else [])
        cache = self.cache
        missing = {w for ws in split for w in ws if w not in cache}
        found = self._learn(missing)
        if len(cache) + len(found) > CACHE_WORDS:
            found |= {w: cache[w] for ws in split for w in ws if w in cache}
            cache.clear()
        if len(cache) + len(found) <= CACHE_WORDS:
            cache.update((w, v) for w, v in found.items() if len(w) <= CACHE_CHARS)
            found = {w: v for w, v in found.items() if len(w) > CACHE_CHARS}
        if not found:
            return [b"".join(map(cache.__getitem__, ws)) for ws in split]
        return [b"".join([found[w] if w in found else cache[w] for w in ws]) for ws in split]

    def decode(self, ids: bytes) -> str:
        data = b"".join([self.surface[i] for i in np.frombuffer(ids, "<u4").tolist()])
        if self.prefix and data.startswith(b" "):
            data = data[1:]
        return data.decode("utf-8", "replace")


def coder(model: str) -> PieceCoder:
    """One per worker process and model."""
    if model not in _coders:
        _coders[model] = PieceCoder(model)
    return _coders[model]


def encode_documents(docs: DataFrame, model: str | None = None) -> DataFrame:
    """``doc_id, n_ids, ids, ids_crc32, decoded_crc32``: ids of every whole text, and the crc32 of the text decoded from them.

    ``ids`` is binary, little-endian unsigned 32-bit. Null and empty texts have no ids; rows stay rows,
    repeated or not, also without an id; an empty table gives none; other columns, whatever their names, are left
    out. Long texts are coded whole, a long word in windows that join exactly.
    """
    model = model or default_model()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = coder(model)
        for batch in batches:
            texts = batch.column("text").to_pylist()
            keys = batch.column("doc_id")
            for i, j in slices(texts, 16_000_000):
                ids = c.encode(texts[i:j])
                yield pa.RecordBatch.from_pydict(
                    {
                        "doc_id": keys.slice(i, j - i),
                        "n_ids": pa.array([len(x) // 4 for x in ids], pa.int64()),
                        "ids": pa.array(ids, pa.binary()),
                        "ids_crc32": pa.array([zlib.crc32(x) for x in ids], pa.int64()),
                        "decoded_crc32": pa.array([zlib.crc32(c.decode(x).encode()) for x in ids], pa.int64()),
                    }
                )

    return documents_of(docs).mapInArrow(
        run, "doc_id long, n_ids long, ids binary, ids_crc32 long, decoded_crc32 long"
    )


def decode_documents(encoded: DataFrame, model: str | None = None) -> DataFrame:
    """``doc_id, ids`` to ``doc_id, text``; null ids give null."""
    model = model or default_model()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = coder(model)
        for batch in batches:
            texts = [None if x is None else c.decode(x) for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "text": pa.array(texts, pa.string())})

    return encoded.select(encoded["doc_id"].cast("long").alias("doc_id"), "ids").mapInArrow(run, "doc_id long, text string")
