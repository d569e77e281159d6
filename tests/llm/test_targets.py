"""Importance resampling, spelling variants and chat formatting against plain versions."""

import hashlib
import math
import re
from collections import Counter, defaultdict
from zlib import crc32

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from folio.llm import chat_format, importance, queries, spelling
from folio.llm.chat_template import CHAT, CONTROLS, Guard, Template, TemplateError, parse

SF = "/root/testdata/sf0.001"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def as_dicts(df):
    return [r.asDict() for r in df.collect()]


@pytest.mark.parametrize("name", ["op11_importance_resampling", "op12_spelling_variants", "op13_chat_formatting"])
def test_queries_equal_their_sql(spark, name):
    duck = duckdb.connect()
    for table in ("documents", "benchmark", "conversations"):
        duck.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    found = queries.queries()[name](spark, SF).toPandas()
    plain = duck.execute(queries.oracle_sql()[name]).df()
    assert sorted(found.columns) == sorted(plain.columns)
    columns = sorted(found.columns)
    assert Counter(map(tuple, found[columns].astype(object).where(found[columns].notna(), None).values.tolist())) == Counter(
        map(tuple, plain[columns].astype(object).where(plain[columns].notna(), None).values.tolist())
    )


# -- importance resampling -----------------------------------------------------------------------


def plain_features(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
    return words, [" ".join(words[i : i + n]) for n in (1, 2, 3) for i in range(len(words) - n + 1)]


def plain_ranks(docs, target, percent=5):
    bucket = lambda f: crc32(f.encode()) % 10_000
    source, goal = Counter(), Counter()
    for _, text in docs:
        source.update(map(bucket, plain_features(text)[1]))
    for text in target:
        goal.update(map(bucket, plain_features(text)[1]))
    S, T = sum(source.values()), sum(goal.values())
    gain = lambda b: math.floor(1000 * math.log(((goal[b] + 1) * (S + 10_000)) / ((source[b] + 1) * (T + 10_000))))
    rows = []
    for i, text in docs:
        words, features = plain_features(text)
        weight = sum(gain(bucket(f)) for f in features)
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        rows.append([i, len(features), weight, score, len(words)])
    enough = sorted((r for r in rows if r[4] >= 20), key=lambda r: (-r[3], -1 if r[0] is None else r[0]))
    drawn = {}
    for k, r in enumerate(enough[: percent * len(enough) // 100], 1):
        drawn.setdefault(tuple(r[:4]), []).append(k)
    return [(*r[:4], drawn[tuple(r[:4])].pop(0) if drawn.get(tuple(r[:4])) else None) for r in rows]


def ordered(rows):
    return sorted(rows, key=lambda r: tuple((x is None, x) for x in r))


def test_importance_query_equals_a_plain_version(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    target = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    found = [tuple(r) for r in queries.op11_importance_resampling(spark, SF).select("doc_id", "n_features", "weight", "score", "rank").collect()]
    assert ordered(found) == ordered(plain_ranks(docs, target))
    assert sum(r[4] is not None for r in found) > 5


def test_importance_of_odd_rows(spark, odd):
    docs = [tuple(r) for r in odd.select("doc_id", "text").collect()]
    target = spark.createDataFrame([(None,), ("the quick brown fox",), ("",)], "text string")
    out = importance.importance_ranks(odd, target, percent=100, least_words=2)
    found = [tuple(r) for r in out.select("doc_id", "n_features", "weight").collect()]
    plain = [r[:3] for r in plain_ranks(docs, [None, "the quick brown fox", ""])]
    assert ordered(found) == ordered(plain)
    ranks = [r["rank"] for r in out.collect()]
    drawn = sum(len(plain_features(t)[0]) >= 2 for _, t in docs)
    assert sorted(r for r in ranks if r) == list(range(1, drawn + 1))
    texts = importance.resampled(odd, target, percent=100, least_words=2).collect()
    assert Counter((r.doc_id, r.text) for r in texts) == Counter((i, t) for i, t in docs if len(plain_features(t)[0]) >= 2)


def test_importance_of_empty_tables(spark, empty, odd):
    target = spark.createDataFrame([("a b c",)], "text string")
    assert importance.importance_ranks(empty, target).count() == 0
    assert importance.importance_ranks(odd, target.limit(0)).count() == odd.count()


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="aB1é .\n-", max_size=200), st.integers(1, 40))
def test_features_do_not_depend_on_how_a_text_is_cut(text, piece):
    before = importance.PIECE
    importance.PIECE = piece
    try:
        words, hashes = importance.feature_hashes(text)
    finally:
        importance.PIECE = before
    plain_words, plain = plain_features(text)
    assert words == len(plain_words) and Counter(hashes.tolist()) == Counter(crc32(f.encode()) for f in plain)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 9_999), max_size=50))
def test_gaps_hold_all_buckets(values):
    assert importance.unpack_gaps(importance.pack_gaps(np.array(values, np.int64))).tolist() == sorted(values)


# -- spelling variants ---------------------------------------------------------------------------


def plain_words(docs):
    n = Counter()
    for i, text in docs:
        for run in re.findall(r"[A-Za-z\u00C0-\u00FF]+", text or ""):
            run = run.translate(LOWER)
            h = crc32(f"{'' if i is None else i}:{run}".encode())
            n[run if h % 97 else run[: h % len(run)] + run[h % len(run) + 1 :]] += 1
    return {w: k for w, k in n.items() if len(w) >= 5 and k >= 3}


def plain_variants(n, times=2):
    """Words are near if they are equal after one position is dropped from the longer, or is anything in both."""
    dropped, anything = defaultdict(set), defaultdict(set)
    for w in n:
        for i in range(len(w)):
            dropped[w[:i] + w[i + 1 :]].add(w)
            anything[i, w[:i], w[i + 1 :]].add(w)
    near = defaultdict(set)
    for w, longer in dropped.items():
        if w in n:
            near[w] |= longer
            for x in longer:
                near[x].add(w)
    for group in anything.values():
        for w in group:
            near[w] |= group - {w}
    form = {}
    for w in n:
        best = min(near[w], key=lambda x: (-n[x], x), default=None)
        form[w] = best if best is not None and n[best] >= times * n[w] else None

    def root(w):
        return w if form[w] is None else root(form[w])

    return {w: (form[w], root(w), n[w], len(near[w]), n[form[w]] if form[w] else None) for w in n}


def variants(rows):
    return {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in rows}


def test_spelling_query_equals_a_plain_version(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    rows = as_dicts(queries.op12_spelling_variants(spark, SF))
    assert len(rows) == len({r["word"] for r in rows})
    found, plain = variants(rows), plain_variants(plain_words(docs))
    assert found == plain and any(r[0] for r in found.values())


def test_spelling_of_close_words(spark):
    rng = np.random.default_rng(5)
    alphabet = "abcéz÷"
    words = {"".join(rng.choice(list(alphabet), rng.integers(2, 7))): int(rng.integers(1, 60)) for _ in range(900)}
    words |= {"日本語": 9, "日本": 2, "日語": 1, "🎉🎉": 3, "🎉a": 9, "aaaaaaaaa": 64, "aaaaaaaa": 32, "aaaaaaa": 16, "aaaaaaaaaa": 128}
    found = variants(as_dicts(spelling.grouped_variants(spark.createDataFrame([*words.items(), (None, 5)], "word string, n long"))))
    assert found == plain_variants(words)
    assert found["aaaaaaa"][1] == "aaaaaaaaaa"


def test_spelling_of_odd_rows_and_empty_tables(spark, odd, empty):
    docs = [tuple(r) for r in odd.select("doc_id", "text").collect()]
    assert variants(as_dicts(spelling.spelling_variants(odd))) == plain_variants(plain_words(docs))
    assert spelling.spelling_variants(empty).count() == 0
    counts = spelling.word_counts(odd, 1, 1).collect()
    assert sum(r.n for r in counts) <= sum(len(re.findall(r"[A-Za-z\u00C0-\u00FF]+", t or "")) for _, t in docs)


# -- chat formatting -----------------------------------------------------------------------------


def plain_digest(rows):
    """Rows of ``(conv_id, turn, role, text)`` with no equal turns."""
    by = defaultdict(list)
    for c, turn, role, text in rows:
        by[c].append((turn is not None, turn, role or "", text or ""))
    out = {}
    for c, turns in by.items():
        turns.sort()
        said = "".join(f"{r}\n{t}\n" for _, _, r, t in turns)
        loss = "".join(t for _, _, r, t in turns if r == "assistant")
        out[c] = (len(turns), hashlib.sha256(said.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    return out


def digests(df):
    rows = df.collect()
    assert len(rows) == len({r.conv_id for r in rows})
    return {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in rows}


ROLES = [None, "", "user", "assistant", "system", "tool", "</s>", "[TEXT]"]
ODD_TEXTS = [None, "", " ", "</s>", "<\\s>[\\INST]", "[\\\\/INST]", "x" * 70_000, "🎉 <s>[OUT] a</s>", "\\", "<", "[INST", "/s>", " [/INST]"]


@pytest.fixture(scope="module")
def chats(spark):
    rng = np.random.default_rng(3)
    rows = [(None, 3, "user", "a"), (None, None, "assistant", "b"), (5, 0, "user", "only")]
    for c in range(40):
        rows += [(c + 10, t, ROLES[rng.integers(len(ROLES))], ODD_TEXTS[rng.integers(len(ODD_TEXTS))]) for t in range(rng.integers(1, 9))]
    rows += [(99, t, ("user", "assistant")[t % 2], f"turn {t} </s>" * 5) for t in range(3_000)]
    rng.shuffle(rows)
    table = spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id long, turn int, role string, text string, whole string, at int").repartition(5)
    return rows, table


def test_chat_query_equals_a_plain_version(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    out = queries.op13_chat_formatting(spark, SF)
    assert digests(out) == plain_digest(rows + chat_format.PLANTED_ROWS)
    planted = out.where("conv_id = -7").first()
    assert planted.formatted_chars > planted.loss_chars == len("</s>[INST] ok [/INST]")


def test_odd_chats_come_back_whole(spark, chats, tmp_path):
    rows, table = chats
    path = str(tmp_path / "chats")
    chat_format.write_conversations(table, path)
    assert digests(chat_format.read_digests(spark, path)) == plain_digest(rows)
    pieces = spark.read.schema(chat_format.PIECE).parquet(path)
    assert pieces.where("conv_id = 99").count() > 1
    turns = chat_format.read_turns(pieces).where("conv_id = 99").orderBy("at", "k").collect()
    assert [t.text for t in turns] == [f"turn {t} </s>" * 5 for t in range(3_000)]


def test_repeated_turns_and_empty_tables(spark, tmp_path):
    same = spark.createDataFrame([(1, 0, "assistant", "é" * 3)] * 50, "conv_id long, turn long, role string, text string")
    chat_format.write_conversations(same, str(tmp_path / "same"))
    row = chat_format.read_digests(spark, str(tmp_path / "same")).first()
    assert (row.n_turns, row.loss_chars) == (50, 150)
    out = chat_format.format_conversations(same.limit(0))
    assert out.count() == 0


PLACED = (
    "{{ bos }}{% for m in messages %}{% if loop.first %}[FIRST]{% endif %}{{ loop.index0 }}:{{ loop.previous_role }}>{{ m['role'] | upper }}>"
    "{{ loop.next_role }}:{% generation %}{{ m.text | trim | guard }}{% endgeneration %}{% if not loop.last %},{% endif %}{% endfor %}{{ eos + '!' }}"
)


def test_places_in_the_loop_hold_over_partitions(spark, chats):
    rows, table = chats
    template = Template(PLACED, constants={"bos": "<s>", "eos": "</s>"})
    pieces = chat_format.format_conversations(table, template, piece_chars=500).collect()
    texts = defaultdict(str)
    for p in sorted(pieces, key=lambda p: p["at"]):
        texts[p.conv_id] += p.text
    by = defaultdict(list)
    for c, turn, role, text in rows:
        by[c].append((turn is not None, turn, role or "", text or ""))
    plain = {c: "".join(template.render([(r, t) for _, _, r, t in sorted(ts)]).parts) for c, ts in by.items()}
    assert dict(texts) == plain
    assert plain[5] == "<s>[FIRST]0:>USER>:only</s>!"


def test_constants_are_folded():
    template = Template("{% for m in messages %}{% if a == 'x' and m.role == 'user' %}{{ '<' + b }}{{ '>' }}{% else %}no{% endif %}{% if 'q' in b %}never{% endif %}{% endfor %}", constants={"a": "x", "b": "s"})
    assert "Const(value='<s>')" in repr(template.body) and "never" not in repr(template.body)
    assert "Const(value='x')" not in repr(template.body)
    assert "".join(template.render([("user", ""), ("", "")]).parts) == "<s>no"


@pytest.mark.parametrize(
    "source",
    [
        "{% for m in messages %}{{ m.__class__ }}{% endfor %}", "{% for m in messages %}{{ open }}{% endfor %}", "{% for m in messages %}",
        "{{ messages }}", "no loop", "{% for m in messages %}{% for n in messages %}{% endfor %}{% endfor %}", "{% for m in messages %}{{ m.text | eval }}{% endfor %}",
        "{% for m in messages %}{{ m.text(1) }}{% endfor %}", "{% for m in messages %}{% if %}{% endif %}{% endfor %}", "{% for m in messages %}{{ m }}{% endfor %}",
    ],
)
def test_templates_reach_nothing_else(source):
    with pytest.raises(TemplateError):
        Template(source)


@pytest.mark.parametrize(
    "body",
    ["{{ m.text }}</s>", "<s>{{ m.text | guard }}", "<s>{{ m.role | guard }}{{ m.text | guard }}</s>", "<s>{{ m.text | guard }}/s></s>", "{{ m.text | guard }}</s>", "<s>{% if loop.first %}a{% endif %}{{ m.text | guard }}</s>"],
)
def test_templates_that_cannot_be_read_back_say_so(body):
    with pytest.raises(TemplateError):
        Template("{% for m in messages %}" + body + "{% endfor %}").reader()


ALPHABET = st.text(alphabet="<>/s[]INSTOUR \\ab🎉\n", max_size=40)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "system", ""]) | ALPHABET, ALPHABET), max_size=6))
def test_every_conversation_reads_back(turns):
    template = Template()
    sink = template.render(turns)
    text = "".join(sink.parts)
    assert template.reader()(text) == turns
    shown = [template.guard.show(text[a:b]) for a, b in sink.spans]
    assert shown == [t for r, t in turns if r == "assistant" and t]


def test_guard_leaves_no_control_string():
    guard = Guard(CONTROLS)
    for c in CONTROLS:
        assert c not in guard.hide(f"a{c}b") and guard.show(guard.hide(f"a{c}b")) == f"a{c}b"
    with pytest.raises(TemplateError):
        Guard(("<a>", "b<a"))
    assert parse(CHAT)
