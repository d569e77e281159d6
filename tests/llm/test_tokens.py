"""Token files, packing, piece coding and token counts against the libraries and serial versions."""

import bisect
import json
import random
import zlib

import numpy as np
import pytest
from conftest import SF

from folio.llm import packing, rans, sentencepiece_viterbi, token_counts
from folio.llm.common import scratch_path
from folio.llm.word_tokens import ChunkEncoder, default_tokenizer

random.seed(7)
ALPHABET = "abcDEFéÀß'sn't 0123\n\t.,!<|>²½ªº́İΣσς…’—日本\x1c\x85 µ_~`"
NOISE = ["".join(random.choice(ALPHABET) for _ in range(80)) for _ in range(400)]
NOISE += ["", "<|endoftext|>", "a<|endoftext|>b <|startoftext|>", "don't I'LL we've", "  ", "x"]


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(default_tokenizer())


def wanted_ids(library, text):
    return [*library.encode(text or "", add_special_tokens=False).ids, 1]


@pytest.fixture(scope="module")
def small(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def test_word_ids_equal_the_library(library):
    got = ChunkEncoder(default_tokenizer()).encode([None, *NOISE])
    assert [np.frombuffer(g, "<u4").tolist() for g in got] == [wanted_ids(library, t) for t in [None, *NOISE]]


def test_word_cache_is_bounded(library, monkeypatch):
    import folio.llm.word_tokens as w

    monkeypatch.setattr(w, "CACHE_CHUNKS", 50)
    monkeypatch.setattr(w, "CACHE_WORDS", 50)
    e = ChunkEncoder(default_tokenizer())
    for t in NOISE[:60]:
        assert np.frombuffer(e.encode([t])[0], "<u4").tolist() == wanted_ids(library, t)
        assert len(e.chunks) <= 50 + 80


@pytest.mark.parametrize("n", [1, 2, 63, 64, 1000, 70_001])
def test_block_round_trip(n):
    ids = np.random.default_rng(n).zipf(1.3, n).astype(np.int64) % 49_000
    symbols, counts = np.unique(ids, return_counts=True)
    table = rans.Table.fit(symbols, counts)
    assert table.freqs.sum() == 1 << table.bits and table.freqs.min() >= 1
    data = rans.encode_block(ids.astype("<u4"), table, lanes=64, segment_rows=8)
    assert (rans.decode_block(data, table) == ids).all()
    segments = rans.HEADER.unpack_from(data)[5]
    lanes = rans.HEADER.unpack_from(data)[2]
    tail = rans.decode_block(data, table, segments - 1)  # starts at a checkpoint
    assert (tail == ids[(segments - 1) * 8 * lanes :]).all()
    assert len(data) < 4 * n + 1024 + 10 * lanes * segments
    for at in (0, len(data) // 2, len(data) - 1):
        with pytest.raises(ValueError, match="damaged"):
            rans.decode_block(data[:at] + bytes([data[at] ^ 1]) + data[at + 1 :], table)
    with pytest.raises(ValueError, match="another table"):
        rans.decode_block(data, rans.Table.fit(np.array([1, 2]), np.array([1, 3])))


def test_token_file(small, library):
    rows = rans.token_file_digest(small).orderBy("doc_id").collect()
    start = 0
    for r, d in zip(rows, small.orderBy("doc_id").collect(), strict=True):
        ids = np.array(wanted_ids(library, d["text"]), "<u4")
        assert tuple(r) == (d["doc_id"], start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)


def test_token_file_odd(spark, odd, empty, library):
    path = scratch_path(spark, "test")
    rans.write_token_file(odd, path)
    rows = rans.read_token_file(spark, path).orderBy("start").collect()
    keys = [r["doc_id"] for r in rows]
    assert keys[0] is None and keys[1:] == sorted(keys[1:])
    texts = {(d["doc_id"], d["text"]) for d in odd.collect()}
    assert {(r["doc_id"], bytes(r["ids"])) for r in rows} == {(i, np.array(wanted_ids(library, t), "<u4").tobytes()) for i, t in texts}
    assert all(a["start"] + len(a["ids"]) // 4 == b["start"] for a, b in zip(rows, rows[1:], strict=False))
    assert rans.token_file_digest(empty).count() == 0


def test_some_documents_from_their_checkpoints(spark, small, library):
    path = scratch_path(spark, "test")
    rans.write_token_file(small, path, lanes=64, segment_rows=4)  # many segments
    texts = {d["doc_id"]: d["text"] for d in small.collect()}
    some = sorted(texts)[::17]
    got = {r["doc_id"]: np.frombuffer(r["ids"], "<u4").tolist() for r in rans.read_documents(spark, path, some).collect()}
    assert got == {i: wanted_ids(library, texts[i]) for i in some} and rans.read_documents(spark, path, [-5]).count() == 0


def test_a_damaged_segment_is_found_from_its_checkpoint():
    ids = np.random.default_rng(1).integers(0, 50, 20_000).astype("<u4")
    table = rans.Table.fit(*np.unique(ids, return_counts=True))
    data = rans.encode_block(ids, table, lanes=64, segment_rows=8)
    bad = data[:-300] + bytes(x ^ 255 for x in data[-300:-150]) + data[-150:]
    last = rans.HEADER.unpack_from(data)[5] - 1
    assert (rans.decode_block(data, table, last) == ids[last * 8 * 64 :]).all()
    with pytest.raises(ValueError, match="damaged"):
        rans.decode_block(bad, table, last - 1)


def serial_best_fit(lengths, capacity):
    rooms, bins = [], 0
    for n in sorted(lengths, reverse=True):
        i = bisect.bisect_left(rooms, n)
        room = rooms.pop(i) if i < len(rooms) else capacity
        bins += room == capacity
        if room > n:
            bisect.insort(rooms, room - n)
    return bins


@pytest.mark.parametrize("seed", range(8))
def test_plan_is_best_fit_decreasing(seed):
    rng = random.Random(seed)
    lengths = [rng.choice([rng.randint(1, 64), rng.randint(1, 9), 33, 64]) for _ in range(rng.choice([1, 40, 700]))]
    counts = {n: lengths.count(n) for n in set(lengths)}
    fill, ranks = {}, {}
    for length, first, n, start, offset in packing.plan(counts, 64):
        assert ranks.get(length, 0) == first
        ranks[length] = first + n
        for b in range(start, start + n):
            assert fill.get(b, 0) == offset
            fill[b] = offset + length
    assert ranks == counts and max(fill.values()) <= 64 and len(fill) == serial_best_fit(lengths, 64)


def check_packing(docs, got, library, capacity):
    ids = {}
    for d in docs:
        ids.setdefault(d["doc_id"], []).append(np.array(wanted_ids(library, d["text"]), "<u4"))
    for r in got:
        same = [x[r["start"] : r["start"] + r["length"]] for x in ids[r["doc_id"]]]
        assert any(len(s) == r["length"] and zlib.crc32(s.tobytes()) == r["ids_crc32"] for s in same) and r["start"] == r["piece"] * capacity
    assert sum(r["length"] for r in got) == sum(len(x) for xs in ids.values() for x in xs)
    by_bin = {}
    for r in got:
        by_bin.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in by_bin.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    assert len(by_bin) == serial_best_fit([r["length"] for r in got], capacity)


def test_packing(small, odd, empty, library):
    check_packing(small.collect(), packing.pack(small).collect(), library, 4096)
    check_packing(odd.collect(), packing.pack(odd, capacity=64).collect(), library, 64)
    assert packing.pack(empty).count() == 0


@pytest.fixture(scope="module")
def coder():
    return sentencepiece_viterbi.PieceCoder(sentencepiece_viterbi.default_model())


def piece_texts(small):
    random.seed(1)
    texts = [r["text"] for r in small.collect()] + NOISE + [" ", "▁x y▁▁ z", "\t\ttab      indent        deep", "a" * 500, "-----====== !!!!"]
    return texts + ["".join(random.choice("aab ▁") for _ in range(100)) for _ in range(200)]


def test_pieces_equal_the_library(small, coder):
    texts = piece_texts(small)
    got = coder.encode(texts)
    assert [np.frombuffer(g, "<u4").tolist() for g in got] == coder.sp.encode(texts)
    assert [coder.decode(g) for g in got] == [coder.sp.decode(w) for w in coder.sp.encode(texts)]
    assert all(coder.decode(g) == t for g, t in zip(got, texts, strict=True) if "▁" not in t)


def test_texts_without_spaces(coder):
    import base64
    import time

    rng = random.Random(2)
    texts = {
        "one letter": "x" * 20_000,
        "period": "abc" * 5_000 + "b" * 777,
        "two letters": "".join(rng.choice("ab") for _ in range(5_000)),
        "base64": base64.b64encode(rng.randbytes(15_000)).decode(),
        "large script": "".join(chr(rng.randint(0x4E00, 0x9FA5)) for _ in range(20_000)),
        "lines": "-" * 3_001 + "=" * 900,
    }
    coder.encode(["warm " + "up" * 200])
    for name, text in texts.items():
        began = time.perf_counter()
        got = coder.encode([text])[0]
        assert np.frombuffer(got, "<u4").tolist() == coder.sp.encode(text) and coder.decode(got) == text, name
        assert time.perf_counter() - began < 5, name  # a busy machine; alone each takes well under a second or two


def test_unigram_pieces_equal_the_library(small):
    from sentencepiece import sentencepiece_model_pb2 as proto

    m = proto.ModelProto()
    m.ParseFromString(open(sentencepiece_viterbi.default_model(), "rb").read())  # noqa: SIM115
    m.trainer_spec.model_type = proto.TrainerSpec.UNIGRAM
    for p in m.pieces:
        p.score = max(p.score, -40_000)
    u = sentencepiece_viterbi.PieceCoder(m.SerializeToString())
    texts = [t[:120] for t in piece_texts(small)]  # the library adds scores in single precision
    same = [np.frombuffer(g, "<u4").tolist() == w for g, w in zip(u.encode(texts), u.sp.encode(texts), strict=True)]
    assert np.mean(same) == 1


def test_piece_query(spark, odd, empty, coder):
    rows = sentencepiece_viterbi.encode_documents(odd)
    got = {(r["doc_id"], bytes(r["ids"])) for r in rows.collect()}
    assert got == {(d["doc_id"], coder.encode([d["text"]])[0]) for d in odd.collect()}
    back = {(r["doc_id"], r["text"]) for r in sentencepiece_viterbi.decode_documents(rows).collect()}
    assert back == {(d["doc_id"], d["text"] or "") for d in odd.collect()}
    assert sentencepiece_viterbi.encode_documents(empty).count() == 0


def greedy(word, pieces, rest):
    """Longest match over symbols; None: no cover."""
    at = n = 0
    while at < len(word):
        group = pieces if at == 0 else rest
        size = next((k for k in range(len(word) - at, 0, -1) if tuple(word[at : at + k]) in group), 0)
        if not size:
            return 1
        at, n = at + size, n + 1
    return n


@pytest.mark.parametrize("seed", range(10))
def test_automaton_is_greedy(seed):
    rng = random.Random(seed)
    piece = lambda: tuple(rng.choice(b"abc") for _ in range(rng.randint(1, 5)))
    pieces, rest = {piece() for _ in range(12)}, {piece() for _ in range(12)}
    words = [bytes(rng.choice(b"abcd" if rng.random() < 0.1 else b"abc") for _ in range(rng.randint(1, 30))) for _ in range(300)]
    words.append(b"abc" * 400)
    for own in (rest, None):
        a = token_counts.Automaton(sorted(pieces), sorted(own) if own else None, marks=False)
        want = [greedy(w, pieces, own or pieces) for w in words]
        assert a.count(words).tolist() == want and [a.count_one(w) for w in words] == want


def test_counts_equal_greedy_matching(small, odd, empty):
    c = token_counts.WordPieceCounter(default_tokenizer())
    letters = token_counts.byte_letters()
    with open(default_tokenizer(), encoding="utf-8") as f:
        vocabulary = set(json.load(f)["model"]["vocab"])

    def pieces(word):
        at = n = 0
        s = "".join(letters[b] for b in word)
        while at < len(s):
            k = next(k for k in range(min(len(s) - at, 80), 0, -1) if s[at : at + k] + "</w>" * (at + k == len(s)) in vocabulary)
            at, n = at + k, n + 1
        return n

    def want(text):
        ws = c.words((text or "").replace("\n", " "))
        return len(ws), sum(map(pieces, ws))

    texts = [None, *NOISE, *(r["text"] for r in small.collect())]
    assert c.count(texts) == [want(t) for t in texts]
    got = {(r["doc_id"], r["n_words"], r["n_tokens"]) for r in token_counts.count_tokens(odd).collect()}
    assert got == {(d["doc_id"], *want(d["text"])) for d in odd.collect()}
    assert token_counts.count_tokens(empty).count() == 0


def test_plain_texts_by_words_equal_the_library(monkeypatch):
    """Plain texts go by words at once, long ones in pieces, and others by chunks: the ids are the library's."""
    import random

    from tokenizers import Tokenizer

    from folio.llm import word_tokens

    monkeypatch.setattr(word_tokens, "PIECE_CHARS", 50)
    monkeypatch.setattr(word_tokens, "CACHE_WORDS", 400)
    rng, letters = random.Random(7), list("abzÀÉßöÿ ' ''sstrevmlld 0123 .,;:!?<|>[]«»¡¿×÷ªº\t\n ’")
    texts = ["".join(rng.choice(letters) for _ in range(rng.randrange(120))) for _ in range(1_500)]
    texts += ["it's we'LL they'Re I'M 'D don'T\nend", "a" * 3_000, "Ab, " * 500 + "\n" + "x" * 60 + " y", "<|endoftext|> x", "a<|startoftext|>b", "", None]
    path = word_tokens.default_tokenizer()
    coder, library = word_tokens.ChunkEncoder(path), Tokenizer.from_file(path)
    for at in range(0, len(texts), 300):
        part = texts[at : at + 300]
        want = library.encode_batch([t or "" for t in part], add_special_tokens=False)
        assert [np.frombuffer(x, "<u4").tolist() for x in coder.encode(part)] == [[*w.ids, 1] for w in want]
