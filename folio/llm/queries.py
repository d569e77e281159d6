"""Registered queries of this subpackage: thin wrappers that apply an operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from folio.llm.common import read_table
from folio.session import ship


def op1_rans_token_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    from folio.llm.rans import token_file_digest

    return token_file_digest(read_table(spark, sf_dir, "documents"))


def op2_sentencepiece_viterbi(spark: SparkSession, sf_dir: str) -> DataFrame:
    from folio.llm.sentencepiece_viterbi import encode_documents

    return encode_documents(read_table(spark, sf_dir, "documents"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from folio.llm.langid import held_out_languages

    return held_out_languages(read_table(spark, sf_dir, "documents"))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from folio.llm.token_counts import count_tokens

    return count_tokens(read_table(spark, sf_dir, "documents"))


def op5_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from folio.llm.ngram_join import jaccard_classes

    return jaccard_classes(read_table(spark, sf_dir, "documents"), k=4, percent=85)


def op6_hnsw_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from folio.llm.hnsw import search

    return search(read_table(spark, sf_dir, "embeddings"))


def op7_kd_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from folio.llm.kd_shards import shards_of

    return shards_of(read_table(spark, sf_dir, "documents"))


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from folio.llm.packing import pack

    return pack(read_table(spark, sf_dir, "documents"))


def op9_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from folio.llm.embed_dedup import near_duplicates

    return near_duplicates(read_table(spark, sf_dir, "embeddings"))


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from folio.llm.quality import held_out_quality

    return held_out_quality(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    from folio.llm.importance import importance_ranks

    return importance_ranks(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark")).drop("key")


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    from folio.llm.spelling import spelling_variants

    return spelling_variants(read_table(spark, sf_dir, "documents"))


def op13_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    from folio.llm.chat_format import formatted_digest

    return formatted_digest(read_table(spark, sf_dir, "conversations"))


OPERATORS = (
    op1_rans_token_file,
    op2_sentencepiece_viterbi,
    op3_language_id,
    op4_token_counts,
    op5_ngram_jaccard_join,
    op6_hnsw_search,
    op7_kd_sharding,
    op8_best_fit_packing,
    op9_embedding_near_dedup,
    op10_quality_classifier,
    op11_importance_resampling,
    op12_spelling_variants,
    op13_chat_formatting,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: lambda spark, sf_dir, f=f: f(ship(spark), sf_dir) for f in OPERATORS}


def oracle_sql() -> dict[str, str]:
    return {
        "op5_ngram_jaccard_join": NGRAM_JOIN_SQL,
        "op9_embedding_near_dedup": EMBEDDING_SQL,
        "op11_importance_resampling": IMPORTANCE_SQL,
        "op12_spelling_variants": SPELLING_SQL,
        "op13_chat_formatting": CHAT_SQL,
    }


#: smallest id reachable over `links(a, b)`, both ways; `nodes(id)` are all ids
_REACH = """
reach(id, other) AS (
    SELECT id, id FROM nodes
    UNION
    SELECT r.id, l.b FROM reach r JOIN links l ON l.a = r.other
)"""

NGRAM_JOIN_SQL = rf"""
WITH RECURSIVE words AS (
    SELECT doc_id, list_filter(
        regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'),
        lambda w: w <> '') AS w
    FROM documents
), shingles AS (
    SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
        ELSE list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) END) AS s
    FROM words
), sizes AS (
    SELECT d.doc_id AS id, count(s.s) AS n FROM documents d LEFT JOIN shingles s USING (doc_id) GROUP BY d.doc_id
), common AS (
    SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c
    FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2
), links AS (
    SELECT c.a, c.b FROM common c JOIN sizes x ON x.id = c.a JOIN sizes y ON y.id = c.b
    WHERE 100 * c.c >= 85 * (x.n + y.n - c.c)
), nodes AS (SELECT id FROM sizes), {_REACH}
SELECT s.id AS doc_id, s.n AS n_shingles, min(r.other) AS component_id
FROM sizes s JOIN reach r ON r.id = s.id GROUP BY s.id, s.n
"""

EMBEDDING_SQL = f"""
WITH RECURSIVE v AS (
    SELECT vec_id AS id, label, embedding::DOUBLE[] AS e FROM embeddings
), links AS (
    SELECT x.id AS a, y.id AS b FROM v x JOIN v y ON x.label = y.label AND x.id <> y.id
    WHERE list_cosine_similarity(x.e, y.e) >= 0.93
), nodes AS (SELECT id FROM v), {_REACH}
SELECT v.id AS vec_id, (SELECT count(*) FROM links l WHERE l.a = v.id) AS n_links,
       min(r.other) AS component_id, v.id = min(r.other) AS kept
FROM v JOIN reach r ON r.id = v.id GROUP BY v.id
"""


#: remainders of the cyclic check of 32 bits for each byte, one row with the list `t`
_CHECK_TABLE = """
remainders AS MATERIALIZED (
    SELECT list(t ORDER BY i) AS t FROM (
        SELECT i, list_reduce([i]::BIGINT[] || range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS t
        FROM (SELECT unnest(range(256))::BIGINT AS i)))"""


def _crc32(digits: str) -> str:
    """Unsigned crc32 of the bytes that a string of hexadecimal digits names; the query has ``remainders`` among its tables."""
    digit = lambda at: f"instr('123456789ABCDEF', {digits}[{at}])"
    octets = f"list_transform(range(1, length({digits}) // 2 + 1), lambda i: ({digit('2 * i - 1')} * 16 + {digit('2 * i')})::BIGINT)"
    return f"xor(list_reduce([4294967295]::BIGINT[] || {octets}, lambda c, b: xor(c >> 8, remainders.t[(xor(c, b) & 255) + 1])), 4294967295)"


def _lower(text: str) -> str:
    return f"translate({text}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


IMPORTANCE_SQL = rf"""
WITH {_CHECK_TABLE}, texts AS (
    SELECT true AS ours, row_number() OVER () AS nr, doc_id, text FROM documents
    UNION ALL SELECT false, row_number() OVER (), NULL, text FROM benchmark
), words AS (
    SELECT ours, nr, doc_id, regexp_extract_all({_lower("coalesce(text, '')")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM texts
), features AS MATERIALIZED (
    SELECT ours, nr, unnest(list_transform(range(1, len(w) - n + 2), lambda i: array_to_string(w[i:i + n - 1], ' '))) AS f
    FROM words, (SELECT unnest([1, 2, 3]) AS n)
), buckets AS MATERIALIZED (
    SELECT f, {_crc32("x")} % 10000 AS b FROM (SELECT DISTINCT f, hex(encode(f)) AS x FROM features), remainders
), hits AS MATERIALIZED (
    SELECT ours, nr, b, count(*) AS n FROM features JOIN buckets USING (f) GROUP BY ALL
), counts AS (
    SELECT b, sum(n) FILTER (ours) AS s, sum(n) FILTER (NOT ours) AS t FROM hits GROUP BY b
), totals AS (
    SELECT coalesce(sum(s), 0)::DOUBLE AS s, coalesce(sum(t), 0)::DOUBLE AS t FROM counts
), gains AS (
    SELECT b, floor(1000 * ln(((coalesce(c.t, 0)::DOUBLE + 1) * (totals.s + 10000)) / ((coalesce(c.s, 0)::DOUBLE + 1) * (totals.t + 10000))))::BIGINT AS gain
    FROM counts c, totals
), weights AS (
    SELECT nr, sum(n)::BIGINT AS n_features, sum(n * gain)::BIGINT AS weight FROM hits JOIN gains USING (b) WHERE ours GROUP BY nr
), scores AS (
    SELECT d.nr, d.doc_id, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight, len(d.w) >= 20 AS enough,
           coalesce(weight, 0) + floor(-1000 * ln(-ln((list_reduce([0]::BIGINT[] || list_transform(range(1, 9),
               lambda i: instr('123456789abcdef', substr(sha256('42:' || coalesce(d.doc_id::VARCHAR, '')), i, 1))::BIGINT), lambda a, x: a * 16 + x) + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score
    FROM words d LEFT JOIN weights USING (nr) WHERE d.ours
), places AS (
    SELECT nr, row_number() OVER (ORDER BY score DESC, doc_id NULLS FIRST) AS rank, count(*) OVER () AS n FROM scores WHERE enough
)
SELECT doc_id, n_features, weight, score, CASE WHEN rank <= 5 * n // 100 THEN rank END AS rank FROM scores LEFT JOIN places USING (nr)
"""

SPELLING_SQL = rf"""
WITH RECURSIVE {_CHECK_TABLE}, runs AS (
    SELECT doc_id, unnest(regexp_extract_all({_lower("text")}, '[a-z\x{{C0}}-\x{{FF}}]+')) AS run FROM documents
), tallied AS (
    SELECT run, count(*) AS n, hex(encode(coalesce(doc_id::VARCHAR, '') || ':' || run)) AS x FROM runs GROUP BY doc_id, run
), checked AS (
    SELECT run, n, {_crc32("x")} AS h FROM tallied, remainders
), words AS MATERIALIZED (
    SELECT word, sum(n)::BIGINT AS n FROM (
        SELECT CASE WHEN h % 97 = 0 THEN left(run, (h % length(run))::BIGINT) || substr(run, (h % length(run) + 2)::BIGINT) ELSE run END AS word, n FROM checked)
    WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3
), cut AS MATERIALIZED (
    SELECT word, n, i, left(word, i - 1) AS a, substr(word, i + 1) AS z FROM words, LATERAL (SELECT unnest(range(1, length(word) + 1)) AS i)
), near AS (
    SELECT DISTINCT c.word, w.word AS other, w.n AS m FROM cut c JOIN words w ON c.a || c.z = w.word
    UNION SELECT DISTINCT w.word, c.word, c.n FROM cut c JOIN words w ON c.a || c.z = w.word
    UNION SELECT DISTINCT x.word, y.word, y.n FROM cut x JOIN cut y ON x.i = y.i AND x.a = y.a AND x.z = y.z AND x.word <> y.word
), best AS (
    SELECT word, count(*) AS n_near, arg_min(other, struct_pack(m := -m, other := encode(other))) AS other, max(m) AS m FROM near GROUP BY word
), formed AS MATERIALIZED (
    SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN b.m >= 2 * w.n THEN b.other END AS form, CASE WHEN b.m >= 2 * w.n THEN b.m END AS form_n
    FROM words w LEFT JOIN best b USING (word)
), followed AS (
    SELECT word, word AS root FROM formed
    UNION ALL
    SELECT f.word, l.form FROM followed f JOIN formed l ON l.word = f.root WHERE l.form IS NOT NULL
)
SELECT f.word, f.form, r.root, f.n, f.n_near, f.form_n
FROM formed f JOIN followed r USING (word) JOIN formed e ON e.word = r.root AND e.form IS NULL
"""

CHAT_SQL = r"""
WITH turns AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
    UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), written AS (
    SELECT *, len(regexp_extract_all(text, '<\\*/?s>|\[\\*(?:/?INST|OUT|ROLE|TEXT)\]')) AS hidden,
           len(regexp_extract_all(role, '<\\*/?s>|\[\\*(?:/?INST|OUT|ROLE|TEXT)\]')) AS hidden_role
    FROM turns
)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(length(text) + hidden + CASE role WHEN 'user' THEN length('<s>[INST]  [/INST]') WHEN 'assistant' THEN length('<s>[OUT] </s>')
           ELSE length('<s>[ROLE]  [TEXT] </s>') + length(role) + hidden_role END)::BIGINT AS formatted_chars
FROM written GROUP BY conv_id
"""
