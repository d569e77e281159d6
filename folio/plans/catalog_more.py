"""More registered queries: rules and taxonomy, functions, text repair, retrieval tools, registry operations, streams."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from folio.functions import dates, geometry, markdown, paths, text
from folio.operators import registry_ops as ops
from folio.operators import retrieval, rules, search_index
from folio.plans.catalog import _DICTIONARY, _TAXONOMY_SQL, _taxonomy, index, load, now, query, table, worked
from folio.plans.query import StructuredQuery, limit_of, match_text, plan, plan_with, relaxed
from folio.registry import TODAY
from folio.session import scratch_folder
from folio.sources import files, versions
from folio.streaming import ingest as streams

S = lambda v: F.lit(v)


def text_of(c: str) -> Column:
    return F.col(c).cast("string")


def pick(key, *values):
    """One of several values by the key's remainder."""
    out = F.when(F.lit(False), F.lit(None).cast("string"))
    for i, v in enumerate(values):
        out = out.when(key % len(values) == i, v if not isinstance(v, (str, type(None))) else F.lit(v))
    return out



def _key():
    return F.col("p_partkey")


# -- ranked search --------------------------------------------------------------------------------

_COLUMNS = """col AS (SELECT id, date, category, unnest([struct_pack(w := 10.0, x := title), struct_pack(w := 6.0, x := array_to_string(tags, ' ')), struct_pack(w := 2.0, x := category), struct_pack(w := 2.0, x := subcategory),
struct_pack(w := 1.0, x := filename), struct_pack(w := 0.5, x := raw_text)]) AS c FROM reg), tok AS (SELECT id, date, category, CAST(c.w AS DOUBLE) AS w, regexp_extract_all(lower(coalesce(c.x, '')), '[\\p{L}\\p{N}]+') AS r FROM col)"""


def bm25_sql(words: list[str]) -> str:
    """CTEs ``{reg}`` to ``hits(id, date, category, score)`` of rows that hold any of the words."""
    n = range(len(words))
    f = ", ".join(f"sum(w * len(list_filter(r, lambda x: x = '{w}'))) AS f{i}" for i, w in enumerate(words))
    d = ", ".join(f"count(*) FILTER (f{i} > 0) AS d{i}" for i in n)
    score = " + ".join(f"ln(1 + (n - d{i} + 0.5) / (d{i} + 0.5)) * f{i} * 2.2 / (f{i} + 1.2 * (0.25 + 0.75 * len / av))" for i in n)
    return f"""{{reg}}, {_COLUMNS}, f AS (SELECT id, any_value(date) AS date, any_value(category) AS category, sum(len(r)) AS len, {f} FROM tok GROUP BY id),
s AS (SELECT count(*) AS n, avg(len) AS av, {d} FROM f), hits AS (SELECT id, date, category, {score} AS score FROM f, s WHERE {' OR '.join(f'f{i} > 0' for i in n)})"""


@query(f"WITH {bm25_sql(['the', 'rights', 'und'])} SELECT id, round(score, 6) AS score FROM hits WHERE category = 'src1' AND date >= '2023-03-01' AND date <= '2024-01-31' ORDER BY hits.score DESC, id LIMIT 10")
def filtered_search(spark, d):
    """Category and dates hold before the limit; collection figures cover all documents."""
    q = StructuredQuery(keywords=("the", "rights", "und"), category="SRC1", date_from="2023-03-01", date_to="2024-01-31")
    return search_index.search(spark, index(spark, d), q, 10).select("id", F.round("score", 6).alias("score"))


@query(f"""WITH {bm25_sql(['derniers', 'documents', 'apache', 'license'])}, top AS (SELECT * FROM hits WHERE date >= '2023-01-01' AND date <= '2023-12-31' ORDER BY score DESC, id LIMIT 30)
SELECT id, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY substr(date, 1, 7) ORDER BY id DESC) AS rn FROM top) WHERE rn = 1 ORDER BY score DESC, id LIMIT 3""")
def retrieve_message(spark, d):
    find = lambda q, n, relax: search_index.search(spark, index(spark, d), q, n, relax=relax)
    hits = retrieval.retrieve(load(spark, d), "les 3 derniers documents Apache License 2023", find=find)
    return hits.select("id", F.round("score", 6).alias("score"))


@query(f"""WITH {bm25_sql(['dossier', 'license'])}, top AS (SELECT * FROM hits ORDER BY score DESC, id LIMIT 30),
one AS (SELECT id, score FROM (SELECT *, row_number() OVER (PARTITION BY substr(date, 1, 7) ORDER BY id DESC) AS rn FROM top) WHERE rn = 1 ORDER BY score DESC, id LIMIT 10)
SELECT o.id, r.category, r.date, round(o.score, 6) AS score FROM (SELECT * FROM one ORDER BY score DESC, id LIMIT 4) o JOIN reg r ON r.id = o.id""")
def dossier(spark, d):
    find = lambda q, n, relax: search_index.search(spark, index(spark, d), q, n, relax=relax)
    out = retrieval.prepare_dossier(load(spark, d), "dossier License", 4, find=find)
    return out.select("id", "category", "date", F.round("score", 6).alias("score"))


@query("WITH {reg} SELECT id FROM reg WHERE id % 2 = 0 AND category = 'src2' ORDER BY date DESC, id LIMIT 20")
def file_type_search(spark, d):
    docs = load(spark, d).withColumn("file_type", F.when(F.col("id") % 2 == 0, "PDF").otherwise("IMAGE"))
    return retrieval.search_documents(docs, category="src2", file_type="pdf").select("id")


@query("WITH {reg} SELECT count(*) AS n, round(avg(len(regexp_extract_all(lower(raw_text), '[\\p{L}\\p{N}]+'))), 6) AS words, false AS drifted, true AS drifted_after FROM reg")
def index_figures(spark, d):
    """The stored index tells whether it still fits its documents."""
    path, docs = index(spark, d), load(spark, d)
    changed = docs.withColumn("title", F.when(F.col("id") == 1, "changed").otherwise(F.col("title")))
    rows = search_index.figures(spark, path)
    return rows.select("n", F.round("avg_raw_text", 6).alias("words"), S(search_index.drifted(docs, path)).alias("drifted"), S(search_index.drifted(changed, path)).alias("drifted_after"))


@query("WITH {reg}, h AS (SELECT * FROM reg WHERE id < 6) SELECT string_agg('#' || id || ' ' || title || chr(10) || substr(raw_text, 1, 80), chr(10) || chr(10) ORDER BY id DESC) AS context FROM h")
def prompt_context(spark, d):
    docs = load(spark, d)
    return retrieval.prompt_context(docs, docs.where("id < 6").select("id", F.col("id").cast("double").alias("score")), 80)


@query("WITH {reg}, h AS (SELECT id, id IN (3, 12) AS cited FROM reg WHERE id < 30), p AS (SELECT *, row_number() OVER (ORDER BY cited DESC, id DESC) AS place FROM h) SELECT id, cited FROM p WHERE cited OR place <= 4")
def cited_hits(spark, d):
    hits = load(spark, d).where("id < 30").select("id", F.col("id").cast("double").alias("score"))
    return retrieval.cited(hits, S("See #12, and #3."), 4).select("id", "cited")


@query("SELECT doc_id AS id, CASE WHEN doc_id % 5 = 0 THEN 0 ELSE 2 END AS n, CASE WHEN doc_id % 5 <> 0 THEN CAST(length(substr(text, 1, 1000)) AS FLOAT) END AS first FROM documents")
def embedding_write(spark, d):
    """An embedding function that fails on every fifth row; those get an empty vector."""
    docs = load(spark, d)
    embed = lambda c: F.when(F.col("id") % 5 != 0, F.array(F.length(c).cast("float"), S(1.0).cast("float")))
    return retrieval.with_embedding(docs, embed).select("id", F.size("embedding").alias("n"), F.get("embedding", S(0)).alias("first"))


@query("""WITH c AS (SELECT c_custkey AS i, c_custkey % 9 + 1 AS n, 2000 + c_custkey % 25 AS y FROM customer)
SELECT i, CASE i % 5 WHEN 0 THEN 'sfr' WHEN 2 THEN 'edf' ELSE '' END AS entities, CASE i % 5 WHEN 0 THEN 'derniers,bulletins' WHEN 1 THEN 'last,invoice' WHEN 2 THEN 'deux,factures' WHEN 3 THEN '' ELSE 'contrat' END AS keywords,
CASE WHEN i % 5 IN (0, 4) THEN y || '-01-01' END AS date_from, CASE i % 5 WHEN 0 THEN n WHEN 1 THEN 1 WHEN 2 THEN 2 ELSE 10 END AS n,
CASE i % 5 WHEN 0 THEN '("sfr") AND ("derniers" OR "bulletins")' WHEN 1 THEN '("last" OR "invoice")' WHEN 2 THEN '("edf") AND ("deux" OR "factures")' WHEN 4 THEN '("contrat")' END AS expression,
CASE i % 5 WHEN 0 THEN 'sfr|' WHEN 2 THEN 'edf|' WHEN 3 THEN '' ELSE '|' END AS looser FROM c""")
def request_plans(spark, d):
    """A request a customer, planned without a model (every other one after a model that fails): its limit, its expression, and a step looser."""
    n, year = (F.col("c_custkey") % 9 + 1).cast("string"), (2000 + F.col("c_custkey") % 25).cast("string")
    said = F.lit("")
    for i, m in enumerate((F.concat(S("les "), n, S(" derniers bulletins SFR "), year), S("find my last invoice"), S("deux factures EDF"), S("the and of"), F.concat(S("contrat "), year))):
        said = F.when(F.col("c_custkey") % 5 == i, m).otherwise(said)

    def broken(message):
        raise RuntimeError(message)

    def run(frames):
        for frame in frames:
            rows = []
            for i, m in zip(frame["i"].tolist(), frame["message"].tolist(), strict=True):
                p = plan_with(m, broken, ("sfr", "edf")) if i % 2 else plan(m, ("sfr", "edf"))
                looser = relaxed(p)
                rows.append((i, ",".join(p.entities), ",".join(p.keywords), p.date_from, limit_of(m, p), match_text(p), "" if looser is None else f"{','.join(looser.entities)}|{','.join(looser.keywords)}"))
            yield pd.DataFrame(rows, columns=["i", "entities", "keywords", "date_from", "n", "expression", "looser"])

    kind = "i long, entities string, keywords string, date_from string, n int, expression string, looser string"
    return worked(spark, d, "customer").select(F.col("c_custkey").alias("i"), said.alias("message")).mapInPandas(run, kind)


# -- rules and taxonomy ---------------------------------------------------------------------------


@query("""SELECT p_partkey AS id, CASE p_partkey % 8 WHEN 0 THEN 'cdi' WHEN 2 THEN 'cdi' WHEN 4 THEN 'w-2' WHEN 6 THEN 'n°' END AS found FROM part""")
def rule_edges(spark, d):
    """A keyword counts unless a letter touches it; digits may, and an end that is a sign needs no guard."""
    body = pick(_key(), "un CDI signé", "acdi", "12cdi34", "cdisse", "form W-2 2023", "w-2form", "facture n°x", "nothing")
    found = F.coalesce(*(F.when(rules.rule_match(rules.Rule(1, (k,), "x"), body, S("f.pdf")), k) for k in ("cdi", "w-2", "n°")))
    return worked(spark, d, "part").select(_key().alias("id"), found.alias("found"))


@query("""SELECT p_partkey AS id, CASE p_partkey % 8 WHEN 0 THEN 'bank' WHEN 1 THEN 'administrative' WHEN 2 THEN 'administrative' WHEN 3 THEN 'housing' WHEN 4 THEN 'housing' WHEN 5 THEN 'bulletin_salaire' WHEN 6 THEN 'housing' WHEN 7 THEN 'identity' END AS category,
CASE p_partkey % 8 WHEN 1 THEN 'impot' WHEN 2 THEN 'impot' WHEN 3 THEN 'foncia' WHEN 4 THEN 'foncia' WHEN 6 THEN 'foncia' WHEN 7 THEN 'carte_grise' END AS subcategory FROM part""")
def rule_anchors(spark, d):
    """A personal rule stands first but gives way to a bank, tax or pay anchor of another category; a statement blocks the tax rule."""
    overlay = rules.overlay_rules([{"keywords": ["Foncia"], "category": "housing", "subcategory": "foncia"}])
    body = pick(_key(), "Relevé de compte foncia avis d'impôt", "avis d'impôt foncia", "Taxe foncière, Finances publiques, foncia", "foncia taxe foncière", "quittance foncia", "Payslip foncia gross pay", "foncia invoice", "carte grise")
    rule = rules.first_rule(body, S("f.pdf"), (*overlay, *rules.DEFAULT_RULES))
    return worked(spark, d, "part").select(_key().alias("id"), rule["category"].alias("category"), rule["subcategory"].alias("subcategory"))


_CATALOGUE = """STEP 1: FIRST
- Search document header for "Cold", "Red thing".
- IF MATCH: -> Category = 'cool', Subcategory = Exact name (e.g. 'a', 'b').
STEP 2B: SECOND
- Search document for "Small", "Hot".
- IF MATCH: -> Category = 'size', Subcategory = 'little'.
"""


@query("""SELECT p_partkey AS id, CASE WHEN starts_with(p_name, 'cold ') THEN 10 WHEN starts_with(p_name, 'small ') OR starts_with(p_name, 'hot ') THEN 25 END AS priority,
CASE WHEN starts_with(p_name, 'cold ') THEN 'cool' WHEN starts_with(p_name, 'small ') OR starts_with(p_name, 'hot ') THEN 'size' END AS category, CASE WHEN starts_with(p_name, 'small ') OR starts_with(p_name, 'hot ') THEN 'little' END AS subcategory FROM part""")
def rule_catalogue(spark, d):
    """Rules read from a catalogue in prose."""
    rule = rules.first_rule(F.col("p_name"), S("f.pdf"), rules.read_catalogue(_CATALOGUE))
    return worked(spark, d, "part").select(_key().alias("id"), rule["priority"].alias("priority"), rule["category"].alias("category"), rule["subcategory"].alias("subcategory"))


@query("SELECT c_custkey AS id, 'w' || c_custkey AS slug FROM customer WHERE c_custkey < 2700")
def entity_dictionary(spark, d):
    """A dictionary of 2,700 surfaces, met in texts by their longest words."""
    entries = spark.createDataFrame([("banks", i, f"w{i}", 0, f"Customer#{i:09d}") for i in range(2700)], "domain string, entry int, slug string, ordinal int, surface string")
    texts = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.concat(S("compte de "), F.col("c_name"), S(", client")).alias("raw_text"))
    return rules.first_by_join(texts, F.broadcast(rules.entity_table(entries))).select("id", "slug")


def _dated(pattern: str, order: str) -> str:
    edge = "(^|[^A-Za-z0-9_])"
    return f"regexp_extract(x, '{edge}{pattern}($|[^A-Za-z0-9_])', [{order}])"


_Y, _M, _D = "(20\\d{2})", "(0[1-9]|1[0-2])", "(0[1-9]|[12]\\d|3[01])"
_EDGE = "[^\\p{L}\\p{N}]"


def _whole(surface: str) -> str:
    return f"regexp_matches(x, '(^|{_EDGE}){surface}($|{_EDGE})')"


def _keyword(word: str) -> str:
    return f"regexp_matches(x, '(^|[^\\p{{L}}]){word}($|[^\\p{{L}}])')"


@query(f"""WITH {{reg}}, t AS (SELECT id, lower(filename || ' ' || substr(raw_text, 1, 4000)) AS x FROM reg),
r AS (SELECT *, CASE WHEN {_keyword('apache license')} THEN 'apache' WHEN {_keyword('mit license')} THEN 'mit' WHEN {_keyword('gnu general public license')} THEN 'gpl' WHEN {_keyword('cc by-nc')} THEN 'cc_by_nc' WHEN {_keyword('all rights reserved')} THEN 'reserved' END AS rule,
CASE WHEN {_whole('the and')} OR {_whole('of the')} THEN 'administrative/the_and' WHEN {_whole('all rights reserved')} THEN 'health/copyright' WHEN {_whole('apache license')} OR {_whole('version 2[.]0')} THEN 'health/apache' WHEN {_whole('und der')} OR {_whole('der die')} THEN 'bank/der' END AS entity,
{_dated(_Y + _M + _D, "'e', 'y', 'm', 'd', 'f'")} AS c, {_dated(_Y + '[-/]' + _M + '[-/]' + _D, "'e', 'y', 'm', 'd', 'f'")} AS y, {_dated(_D + '[-/]' + _M + '[-/]' + _Y, "'e', 'd', 'm', 'y', 'f'")} AS z FROM t)
SELECT id, CASE WHEN rule IS NOT NULL THEN 'license' ELSE coalesce(split_part(entity, '/', 1), 'administrative') END AS rule_category, coalesce(rule, split_part(entity, '/', 2), 'general') AS rule_subcategory, 'doc ' || id AS rule_title,
CASE WHEN c.y <> '' THEN c.y || '-' || c.m || '-' || c.d WHEN y.y <> '' THEN y.y || '-' || y.m || '-' || y.d WHEN z.y <> '' THEN z.y || '-' || z.m || '-' || z.d ELSE '{TODAY}' END AS rule_date FROM r""")
def classify_documents(spark, d):
    out = rules.classify(load(spark, d), now(), rules.LICENSE_RULES, _DICTIONARY)
    return out.select("id", "rule_category", "rule_subcategory", "rule_title", "rule_date")


_SEGMENTS = [{"id": "furniture", "aliases": []}, {"id": "vehicles", "aliases": ["auto", "motor"]}, {"id": "household", "aliases": ["house", "build"]}]


@query("""SELECT c_custkey AS id, CASE WHEN s = 'furniture' THEN s WHEN contains(s, 'auto') THEN 'vehicles' WHEN contains(s, 'house') OR contains(s, 'build') THEN 'household' ELSE s END AS category,
s <> 'furniture' AND NOT contains(s, 'auto') AND NOT contains(s, 'house') AND NOT contains(s, 'build') AS is_new,
CASE WHEN s <> 'furniture' AND NOT contains(s, 'auto') AND NOT contains(s, 'house') AND NOT contains(s, 'build') THEN upper(s[1]) || s[2:] END AS new_name
FROM (SELECT c_custkey, CASE WHEN c_custkey % 10 = 0 THEN 'administrative' ELSE lower(c_mktsegment) END AS s FROM customer)""")
def resolve_categories(spark, d):
    raw = F.when(F.col("c_custkey") % 10 == 0, "").otherwise(F.concat(S(" "), F.col("c_mktsegment")))
    found = rules.resolve_category(raw, _SEGMENTS)
    return worked(spark, d, "customer").select(F.col("c_custkey").alias("id"), found["id"].alias("category"), found["is_new"].alias("is_new"), found["new_name"].alias("new_name"))


_KINDS = [
    {"id": "economy", "subcategories": [{"id": "widgets", "aliases": ["widget"]}, {"id": "cold_bolt"}]},
    {"id": "standard", "subcategories": [{"id": "gears", "aliases": ["gear"]}]},
]


@query("""SELECT id, CASE WHEN id % 9 = 0 THEN 'other' WHEN c = 'economy' AND contains(s, 'widget') THEN 'widgets' WHEN c = 'economy' AND s = 'cold_bolt' THEN s WHEN c = 'standard' AND contains(s, 'gear') THEN 'gears' WHEN id % 4 <> 0 THEN s ELSE 'general' END AS subcategory,
id % 9 <> 0 AND id % 4 <> 0 AND NOT (c = 'economy' AND (contains(s, 'widget') OR s = 'cold_bolt')) AND NOT (c = 'standard' AND contains(s, 'gear')) AS is_new
FROM (SELECT p_partkey AS id, lower(p_type) AS c, replace(p_name, ' ', '_') AS s FROM part)""")
def resolve_subcategories(spark, d):
    """Known within the category, else new if the text names it (three rows of four do), else ``general``."""
    raw = F.when(_key() % 9 == 0, "Other").otherwise(F.concat(F.upper("p_name"), S("_202301")))
    body = F.when(_key() % 4 == 0, "nothing").otherwise(F.concat(S("une "), F.replace("p_name", S(" "), S("-")), S("!")))
    found = rules.resolve_subcategory(F.lower("p_type"), raw, _KINDS, body, S("scan.pdf"))
    return worked(spark, d, "part").select(_key().alias("id"), found["id"].alias("subcategory"), found["is_new"].alias("is_new"))


@query("""SELECT p_partkey AS id, CASE p_partkey % 6 WHEN 0 THEN 'economy' WHEN 1 THEN 'economy' WHEN 2 THEN 'standard' WHEN 3 THEN 'other' WHEN 4 THEN 'other' ELSE 'other' END AS category,
CASE p_partkey % 6 WHEN 0 THEN 'widgets' WHEN 1 THEN 'widgets' WHEN 2 THEN 'shared' WHEN 3 THEN 'cold_bolt' WHEN 4 THEN 'general' ELSE 'unknown_thing' END AS slug,
CASE p_partkey % 6 WHEN 1 THEN 'owned elsewhere' WHEN 3 THEN 'spelling' WHEN 4 THEN 'category name' END AS hint FROM part""")
def placements(spark, d):
    """Owned here, owned elsewhere, owned by several, a spelling variant, a category's own name, unknown; beside 150 other entries."""
    many = [{"id": f"c{i}", "subcategories": [{"id": f"entry_number_{i}_of_many"}]} for i in range(150)]
    shared = [{"id": c, "subcategories": [{"id": "shared"}]} for c in ("economy", "standard")]
    guard = rules.placement_guard(
        pick(_key(), "economy", "other", "standard", "other", "other", "other"), pick(_key(), "widgets", "widgets", "shared", "cold_bolts", "economy", "unknown_thing"), [*_KINDS, *shared, *many], ["economy", "standard"]
    )
    return worked(spark, d, "part").select(_key().alias("id"), guard["category"].alias("category"), guard["slug"].alias("slug"), guard["hint"].alias("hint"))


@query("""SELECT o_orderkey AS id, CASE WHEN o_orderkey % 3 = 0 OR o_orderkey % 3 = 1 THEN 'keep' WHEN (o_orderkey % 100) / 100.0 >= CASE WHEN o_orderkey % 2 = 0 THEN 0.85 ELSE 0.6 END THEN 'override' ELSE 'block' END AS action FROM orders""")
def confidence_actions(spark, d):
    k = F.col("o_orderkey")
    action = rules.confidence_action(F.when(k % 3 == 0, F.lit(True)).when(k % 3 == 2, F.lit(False)), k % 100 / 100.0, k % 2 == 0)
    return table(spark, d, "orders").select(k.alias("id"), action.alias("action"))


@query("""SELECT p_partkey AS id, CASE p_partkey % 5 WHEN 0 THEN 'administrative' WHEN 1 THEN 'bank' WHEN 2 THEN 'administrative' WHEN 3 THEN 'correspondence' ELSE 'invoices' END AS category, CASE p_partkey % 5 WHEN 0 THEN 'impot' WHEN 1 THEN 'impot' WHEN 2 THEN 'letters' WHEN 3 THEN 'letters' ELSE 'sfr' END AS subcategory FROM part""")
def refined_answers(spark, d):
    out = rules.refine(
        pick(_key(), "personal", "bank", "correspondence", "correspondence", "invoices"), pick(_key(), "general", "general", "letters", "letters", "sfr"), pick(_key(), "a.pdf", "a.pdf", "IMPOT.pdf", "a.pdf", "tax.pdf"), S("administrative"), S("impot")
    )
    return table(spark, d, "part").select(_key().alias("id"), out["category"].alias("category"), out["subcategory"].alias("subcategory"))


@query("""WITH n AS (SELECT * FROM events ORDER BY ts DESC, event_id DESC LIMIT 25) SELECT unnest(['user' || user_id, 'k' || event_id]) AS keyword, 'filename' AS scope, 'cat' AS category, event_type AS subcategory FROM n WHERE event_id % 4 <> 0""")
def decision_rules(spark, d):
    """Rules of the newest decisions, none to a forbidden place."""
    rows = table(spark, d, "events").select(
        F.col("event_id").alias("id"), F.col("ts").alias("created_at"), S(1).alias("enabled"), S("cat").alias("new_category"), F.when(F.col("event_id") % 4 == 0, "divers").otherwise(F.col("event_type")).alias("new_subcategory"),
        F.array(F.concat(S("user"), text_of("user_id")), F.concat(S("k"), text_of("event_id"))).alias("rule_keywords"),
    )
    return ops.decision_rules(rows)


@query("""WITH {reg}, e AS (SELECT DISTINCT category, subcategory AS slug FROM reg WHERE category IS NOT NULL AND subcategory IS NOT NULL)
SELECT category, '- Category ' || chr(39) || category || chr(39) || ' (' || upper(category) || '): . Existing subcategories: [' || string_agg(slug, ', ' ORDER BY slug) || '].' ||
CASE WHEN category = 'src1' THEN ' Known real-world entities: copyright (all rights reserved), apache (Apache License).' ELSE '' END AS line FROM e GROUP BY category""")
def prompt_lines(spark, d):
    """What a prompt is told of each category: the subcategories in use and the entities that belong there."""
    hints = {"src1": rules.entity_hint("health", _DICTIONARY)}
    entries = load(spark, d).select("category", F.col("subcategory").alias("slug"), F.upper("category").alias("name"))
    return rules.category_lines(entries, hints)


@query("""WITH e AS (SELECT 'c' || (p_partkey // 4) AS category, 's' || p_partkey AS slug, p_partkey AS k, p_name AS alias FROM part)
SELECT w.category, w.slug, array_to_string(list_sort(list_distinct(CASE WHEN l.slug IS NULL THEN [w.alias] ELSE [w.alias, l.slug, l.alias] END)), ',') AS aliases
FROM e w LEFT JOIN e l ON w.k % 4 = 1 AND l.k = w.k + 1 WHERE w.k % 4 <> 2""")
def folded_aliases(spark, d):
    """Every fourth entry loses to its neighbour, which takes its slug and aliases."""
    slug = F.concat(S("s"), _key().cast("string"))
    entries = table(spark, d, "part").select(F.concat(S("c"), F.floor(_key() / 4).cast("string")).alias("category"), slug.alias("slug"), F.array("p_name").alias("aliases"), _key().alias("k"))
    merges = entries.where("k % 4 = 2").select("category", F.col("slug").alias("loser"), F.concat(S("s"), (F.col("k") - 1).cast("string")).alias("winner"))
    return ops.fold_aliases(entries.drop("k"), merges).select("category", "slug", F.array_join("aliases", ",").alias("aliases"))


@query(f"""WITH {{reg}}, {_TAXONOMY_SQL}, c AS (SELECT lower(category) AS category, lower(subcategory) AS slug, count(*) AS n FROM reg GROUP BY 1, 2),
e AS (SELECT coalesce(m.category, c.category) AS category, coalesce(m.slug, c.slug) AS subcategory, coalesce(m.name, upper(c.slug[1]) || c.slug[2:]) AS name, m.name IS NOT NULL AS configured FROM merged m FULL OUTER JOIN c ON m.category = c.category AND m.slug = c.slug)
SELECT category, subcategory, row_number() OVER (PARTITION BY category ORDER BY CASE WHEN configured THEN 0 ELSE 1 END, CASE WHEN configured THEN lower(strip_accents(name)) END, subcategory) AS position FROM e""")
def menu_positions(spark, d):
    entries = ops.counts_with_taxonomy(ops.merge_taxonomy(*_taxonomy(spark)), ops.category_counts(load(spark, d)))
    return ops.menu_order(entries).select("category", "subcategory", "position")


@query(f"""WITH {{reg}}, {_TAXONOMY_SQL}, c AS (SELECT lower(category) AS category, lower(subcategory) AS slug, count(*) AS n FROM reg WHERE id % 2 = 1 GROUP BY 1, 2)
SELECT coalesce(m.category, c.category) AS category, coalesce(m.slug, c.slug) AS subcategory, coalesce(c.n, 0) AS count FROM merged m FULL OUTER JOIN c ON m.category = c.category AND m.slug = c.slug WHERE coalesce(c.n, 0) > 0 OR coalesce(m.category, c.category) = 'src2'""")
def shown_categories(spark, d):
    """Entries in use, and those of the active category."""
    counts = ops.category_counts(load(spark, d).where("id % 2 = 1"))
    return ops.shown(ops.counts_with_taxonomy(ops.merge_taxonomy(*_taxonomy(spark)), counts), "src2").select("category", "subcategory", "count")


@query("SELECT p_partkey AS id, CASE p_partkey % 4 WHEN 0 THEN 'bank' WHEN 2 THEN 'tax' END AS owner FROM part")
def canonical_owners(spark, d):
    owners = F.when(_key() % 4 == 2, F.array(S("tax"))).otherwise(F.array(S("bank"), S("tax")))
    current = F.when(_key() % 4 == 0, "bank").otherwise("housing")
    return table(spark, d, "part").select(_key().alias("id"), ops.owner_of(current, owners).alias("owner"))


@query("WITH {reg} SELECT category, 'entry' || lower(regexp_replace(title[1:6], '[^A-Za-z]+', '', 'g')) AS slug, min(path) AS first_path FROM reg WHERE title IS NOT NULL GROUP BY 1, 2")
def proposed_entries(spark, d):
    """Entries that a batch would add, each once, by the first path."""
    word = F.concat(S("Entry"), F.regexp_replace(F.substring("title", 1, 6), "[^A-Za-z]+", ""))
    rows = load(spark, d).where("title is not null").select(F.upper("category").alias("category"), word.alias("subcategory"), "path")
    return ops.new_entries(rows).select("category", "slug", "first_path")


# -- functions ------------------------------------------------------------------------------------


@query("SELECT p_partkey AS id, p_partkey % 4 < 2 AS is_year FROM part")
def year_strings(spark, d):
    v = pick(_key(), F.format_string("%d", 1990 + _key() % 40), " 2024\n", "20245", F.col("p_name"))
    return table(spark, d, "part").select(_key().alias("id"), text.is_year(v).alias("is_year"))


@query("""SELECT p_partkey AS id, CASE p_partkey % 4 WHEN 0 THEN replace(p_name, ' ', '_') WHEN 1 THEN replace(p_name, ' ', '_') WHEN 2 THEN 'general' ELSE 'general' END AS bare,
upper(p_name[1]) || substr(p_name, 2, strpos(p_name, ' ') - 1) || upper(split_part(p_name, ' ', 2)[1]) || split_part(p_name, ' ', 2)[2:] AS title, p_partkey % 2 = 0 AS echo FROM part""")
def slug_functions(spark, d):
    slug = F.replace("p_name", S(" "), S("_"))
    dated = pick(_key(), F.concat(slug, S("_202301")), slug, "20230115", "2023_2024")
    echo = text.is_filename_echo(slug, F.when(_key() % 2 == 0, F.concat(S("scan_"), slug, S(".pdf"))).otherwise("other.pdf"))
    return worked(spark, d, "part").select(_key().alias("id"), text.strip_date_tail(dated).alias("bare"), text.title_case(slug).alias("title"), echo.alias("echo"))


@query("""SELECT p_partkey AS id, 'Facture ' || p_name AS title, 'facture-' || replace(p_name, ' ', '_') AS stem, 'facture,' || replace(p_name, ' ', ',') AS words, p_partkey % 3 = 1 OR p_partkey % 3 = 0 AS generic,
CASE WHEN p_partkey % 3 = 1 OR p_partkey % 3 = 0 THEN '2024-01-02_Sfr_' || replace(p_name, ' ', '_') || '.pdf' ELSE 'facture-' || replace(p_name, ' ', '_') || '.PDF' END AS informed, CASE p_partkey % 2 WHEN 0 THEN 'PDF' ELSE 'IMAGE' END AS kind FROM part""")
def filename_functions(spark, d):
    slug = F.replace("p_name", S(" "), S("_"))
    name = F.concat(S("facture-"), slug, S(".PDF"))
    camera = pick(_key(), F.concat(S("IMG_"), _key().cast("string"), S(".pdf")), "scan 12.pdf", name)
    return worked(spark, d, "part").select(
        _key().alias("id"),
        paths.title_of(F.concat(S("Facture-"), slug, S(".pdf"))).alias("title"),
        text.stem(name).alias("stem"),
        F.array_join(text.filename_tokens(name), ",").alias("words"),
        paths.is_generic_name(camera).alias("generic"),
        paths.informed_name(camera, S("telecom/sfr"), F.col("p_name"), S("2024-01-02")).alias("informed"),
        text.file_type(F.when(_key() % 2 == 0, "a.PDF").otherwise("b.Jpeg")).alias("kind"),
    )


@query("""SELECT p_partkey AS id, CASE WHEN p_partkey % 5 = 0 THEN 'autre' ELSE 'ecole_' || replace(p_name, ' ', '_') END AS segment, '&lt;' || p_name || '&gt; &amp; &quot;x&#039;' AS escaped, 'Ecole_' || p_name AS ascii,
'%C3%89cole%2F' || replace(p_name, ' ', '%20') AS encoded, 'inv' || p_partkey || ',' || replace(p_name, ' ', ',') AS keywords, replace(p_name, ' ', ',') || ',facture' AS words FROM part""")
def text_functions(spark, d):
    name = F.col("p_name")
    down = text.download_name(F.concat(S("École/"), name))
    return worked(spark, d, "part").select(
        _key().alias("id"),
        text.sanitize_segment(F.when(_key() % 5 == 0, "!!!").otherwise(F.concat(S("École "), name)), "autre").alias("segment"),
        text.escape_html(F.concat(S("<"), name, S("> & \"x'"))).alias("escaped"),
        down["ascii"].alias("ascii"),
        down["encoded"].alias("encoded"),
        F.array_join(text.rule_keywords(F.concat(S("INV"), _key().cast("string"), S("_2024_scan.pdf")), F.concat(name, S(" 2023"))), ",").alias("keywords"),
        F.array_join(text.search_tokens(F.concat(S("the "), name, S(", une Facture?"))), ",").alias("words"),
    )


@query("""SELECT doc_id AS id, CASE WHEN length(b) < 10 THEN '' ELSE b END AS cleaned FROM (SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(text, '\\n{3,}', chr(10) || chr(10), 'g'), '^\\s+', ''), '\\s+$', '') AS b FROM documents)""")
def cleaned_text(spark, d):
    noisy = F.concat(S("\x00"), F.replace("raw_text", S("\n"), S("\r\n")))
    return load(spark, d).select("id", text.clean_text(noisy, after=True).alias("cleaned"))


@query("""SELECT p_partkey AS id, CASE p_partkey % 3 WHEN 0 THEN p_name || ' by hand' WHEN 1 THEN 'a fresh text' ELSE p_name END AS chosen, p_partkey % 2 = 0 AS refresh, p_partkey % 4 < 2 AS generic, 'bank' AS tree_category, CASE WHEN p_partkey % 2 = 0 THEN 'sfr' END AS tree_subcategory FROM part""")
def text_choice(spark, d):
    chosen = ops.chosen_text(pick(_key(), F.concat("p_name", S(" by hand")), "old", F.col("p_name")), pick(_key(), "a fresh text", "a fresh text", "short"), _key() % 3 == 0)
    refresh = ops.needs_text(F.when(_key() % 2 == 0, "[no text]").otherwise("a stored text of some length"), S("a stored text of some length"))
    generic = ops.is_generic_place(pick(_key(), "personal", "bank", "bank", "bank"), pick(_key(), "sfr", "Divers", "sfr", "edf"))
    hint = paths.tree_hint(F.when(_key() % 2 == 0, "bank/sfr/2024/a.pdf").otherwise("bank/a.pdf"))
    return table(spark, d, "part").select(
        _key().alias("id"), chosen.alias("chosen"), refresh.alias("refresh"), generic.alias("generic"), hint["category"].alias("tree_category"), hint["subcategory"].alias("tree_subcategory")
    )


@query("""SELECT o_orderkey AS id, CASE o_orderkey % 3 WHEN 0 THEN '2021-' WHEN 1 THEN '2032-' ELSE '2020-' END || CASE WHEN o_orderkey % 3 = 0 AND strftime(o_orderdate, '%m-%d') = '02-29' THEN '02-28' ELSE strftime(o_orderdate, '%m-%d') END AS date,
CASE WHEN o_orderkey % 2 = 0 THEN strftime(o_orderdate, '%Y-%m') END AS period, round(o_totalprice, 2) AS amount FROM orders""")
def date_functions(spark, d):
    """A future date takes the year of the title; where that has no such day, the month's last."""
    rows = table(spark, d, "orders")
    k, day = F.col("o_orderkey"), F.date_format("o_orderdate", "-MM-dd")
    date = F.concat(F.when(k % 3 == 2, "2020").otherwise("2032"), day)
    title = F.when(k % 3 == 0, "Bulletin 2021 mai").otherwise("Bulletin mai")
    cents = F.round(F.col("o_totalprice") * 100).cast("long")
    shown = F.concat(F.format_string("%,d", F.floor(cents / 100)), S(","), F.lpad((cents % 100).cast("string"), 2, "0"), S(" €"))
    return rows.select(
        k.alias("id"),
        dates.reconcile_date(date, title, now()).alias("date"),
        dates.pay_period(F.when(k % 2 == 0, F.date_format("o_orderdate", "yyyy-MM-dd")).otherwise("soon")).alias("period"),
        dates.money(F.regexp_replace(shown, r",(\d{3})", " $1")).cast("double").alias("amount"),
    )


# -- text repair ----------------------------------------------------------------------------------


@query("""SELECT p_partkey AS id, CASE p_partkey % 4 WHEN 0 THEN '{"a": ' || p_partkey || ', "b": [1, 2]}' WHEN 1 THEN '{"name": "' || p_name || '"}' WHEN 2 THEN '{"c": {"d": "' || p_name || '"}}' END AS json FROM part""")
def repaired_json(spark, d):
    key, name = _key().cast("string"), F.col("p_name")
    raw = pick(_key(), F.concat(S('```json\n{"a": '), key, S(', "b": [1, 2')), F.concat(S('Here: {"name": "'), name, S('",} done')), F.concat(S('{"c": {"d": "'), name), "no object")
    return worked(spark, d, "part").select(_key().alias("id"), markdown.clean_json(raw).alias("json"))


@query("SELECT p_partkey AS id, p_name AS titre, '' AS summary, 0 AS tags FROM part")
def metadata_records(spark, d):
    from folio.schema import metadata_defaults

    rows = metadata_defaults(table(spark, d, "part").select(F.col("p_name").alias("titre"), _key().alias("id"), F.lit(None).cast("string").alias("summary")))
    both = table(spark, d, "part").select(_key().alias("id"), F.col("p_name").alias("titre"))
    return both.join(rows.dropDuplicates(["titre"]), "titre").select("id", "titre", "summary", F.size("tags").alias("tags"))


@query("""SELECT p_partkey AS id, '| ' || p_name || ' | b |' || chr(10) || '| --- | --- |' || chr(10) || '| x | y |' || chr(10) || 'end' AS fixed, '| ' || p_name || ' | b |' AS open_header,
'| h |' || chr(10) || '| ' || p_name || ' |' || chr(10) || '| z |' || chr(10) || chr(10) || 'after' AS joined FROM part""")
def repaired_tables(spark, d):
    name, header = F.col("p_name"), F.concat(S("| "), F.col("p_name"), S(" | b |"))
    chunks = F.array(F.concat(S("| h |\n| "), name, S(" |\n")), S("\n| z |\n"), S("\nafter"))
    return worked(spark, d, "part").select(
        _key().alias("id"),
        markdown.fix_tables(F.concat(header, S("\n| x | y |\nend"))).alias("fixed"),
        markdown.open_header(F.concat(S("| old |\n\n"), header, S("\n| --- | --- |\n| x | y |"))).alias("open_header"),
        markdown.join_chunks(chunks).alias("joined"),
    )


@query("""WITH h AS (SELECT p_partkey AS id, CASE WHEN p_partkey % 2 = 0 THEN '| ' || p_name || ' | b |' END AS header FROM part) SELECT id, NULL AS first, header AS second, CASE WHEN id % 3 > 0 THEN header END AS third, NULL AS fourth FROM h""")
def handed_headers(spark, d):
    """The header that each chunk has to be told of: of a table over three chunks, where the first has its separator and none breaks it."""
    header = F.concat(S("text\n| "), F.col("p_name"), S(" | b |\n"), F.when(_key() % 2 == 0, "| --- | :-: |\n").otherwise(""), S("| 1 | 2 |\n\n"))
    middle = F.concat(S("| 3 | 4 |\n"), F.when(_key() % 3 == 0, "a note\n").otherwise(""), F.concat(S("| "), F.col("p_type"), S(" | 6 |")))
    heads = markdown.handed_headers(F.array(header, middle, S("| 7 | 8 |\n\nend"), S("| new |")))
    return worked(spark, d, "part").select(_key().alias("id"), *(F.get(heads, S(i)).alias(n) for i, n in enumerate(("first", "second", "third", "fourth"))))


@query("""SELECT p_partkey AS id, 'a' || chr(10) || CASE WHEN p_partkey % 3 = 0 THEN '> ' ELSE '' END || repeat('| c ', 13 + CASE WHEN p_partkey % 3 = 0 THEN 1 ELSE 0 END) || '|' || chr(10) || CASE WHEN p_partkey % 3 = 0 THEN '> ' ELSE '' END || '| ' || p_name || ' |' || chr(10) || 'b' || chr(10) || '| d |' AS body FROM part""")
def quoted_charts(spark, d):
    header = F.concat(F.repeat(S("| c "), F.when(_key() % 3 == 0, 14).otherwise(13)), S("|"))
    body = F.concat(S("a\n"), header, S("\n| "), F.col("p_name"), S(" |\nb\n| d |"))
    return worked(spark, d, "part").select(_key().alias("id"), markdown.quote_charts(body).alias("body"))


@query("""SELECT p_partkey AS id, '| a | b |' || chr(10) || '| --- | --- |' || chr(10) || '| x | ' || p_name || '|' || chr(10) || '| 1 | 2 |' AS rows, '| a |  |' || chr(10) || '| --- | --- |' AS header FROM part""")
def malformed_tables(spark, d):
    body = F.concat(S("| a | b |\n| --- | --- |\n| x | "), F.col("p_name"), S("\n\n| 1 | 2 |"))
    return worked(spark, d, "part").select(_key().alias("id"), markdown.repair_tables(body).alias("rows"), markdown.repair_tables(S("| a |\n| --- | --- |")).alias("header"))


@query("""SELECT p_partkey AS id, '<h4>' || p_name || '</h4><br>a <strong>b</strong> <em>c</em> <code>d</code> &lt;i&gt;<br><table><thead><tr><th>h</th><th>' || p_name || '</th></tr></thead><tbody><tr><td>1</td><td>2</td></tr></tbody></table><br><li>item</li>' AS html FROM part""")
def markdown_html(spark, d):
    body = F.concat(S("## "), F.col("p_name"), S("\na **b** *c* `d` <i>\n| h | "), F.col("p_name"), S(" |\n| 1 | 2 |\n- item"))
    return worked(spark, d, "part").select(_key().alias("id"), markdown.to_html(body).alias("html"))


@query("SELECT p_partkey AS id, CAST(ceil((1 + p_size) / 13.0) AS INTEGER) AS n, CASE WHEN 1 + p_size >= 13 THEN 1312 ELSE (1 + p_size) * 101 - 1 END AS longest FROM part")
def chunk_counts(spark, d):
    """Lines of 100 characters: thirteen fill a chunk."""
    body = F.array_join(F.array_repeat(F.repeat(S("x"), 100), 1 + F.col("p_size")), "\n")
    chunks = worked(spark, d, "part").select(_key().alias("id"), markdown.chunk_text(body).alias("c"))
    return chunks.select("id", F.size("c").alias("n"), F.array_max(F.transform("c", F.length)).alias("longest"))


@query("""WITH b AS (SELECT doc_id AS id, text, length(text) AS n, length(regexp_replace(text, '[\\p{L}\\p{N}\\s.,;:!?''"()|-]', '', 'g')) AS signs FROM documents),
l AS (SELECT id, i, ls[i] AS line, regexp_matches(ls[i], '^\\s*\\|.*\\|\\s*$') AS pipe, regexp_matches(ls[i], '^\\s*\\|(?:\\s*:?-+:?\\s*\\|)+\\s*$') AS rule, len(string_split(ls[i], '|')) - 2 AS n FROM (SELECT id, ls, unnest(range(1, len(ls) + 1)) AS i FROM (SELECT id, regexp_split_to_array(text, '\\r?\\n') AS ls FROM b))),
k AS (SELECT *, sum(CASE WHEN pipe AND NOT coalesce(prev, false) THEN 1 ELSE 0 END) OVER (PARTITION BY id ORDER BY i) AS block FROM (SELECT *, lag(pipe) OVER (PARTITION BY id ORDER BY i) AS prev FROM l)),
r AS (SELECT *, row_number() OVER (PARTITION BY id, block ORDER BY i) AS pos, first_value(n) OVER (PARTITION BY id, block ORDER BY i) AS width, lead(rule) OVER (PARTITION BY id ORDER BY i) AS next_rule FROM k),
a AS (SELECT id, bool_or(regexp_matches(line, '^\\s*\\|') AND NOT regexp_matches(line, '\\|\\s*$')) AS malformed, bool_or(pipe AND pos > 1 AND NOT rule AND n <> width) AS ragged, bool_or(pipe AND pos = 1 AND NOT coalesce(next_rule, false)) AS headerless FROM r GROUP BY id)
SELECT b.id, reasons = '' AS ok, reasons FROM b JOIN (SELECT b.id, concat_ws(',', CASE WHEN signs / greatest(n, 1) > 0.3 THEN 'noise' END, CASE WHEN contains(text, chr(65533)) THEN 'corruption' END, CASE WHEN malformed THEN 'malformed rows' END, CASE WHEN ragged THEN 'ragged' END, CASE WHEN headerless THEN 'headerless' END) AS reasons FROM b JOIN a USING (id)) q USING (id)""")
def extraction_quality(spark, d):
    docs = load(spark, d).select("id", markdown.assess(F.col("raw_text"), F.col("raw_text")).alias("q"))
    return docs.select("id", "q.ok", F.array_join("q.reasons", ",").alias("reasons"))


@query("""WITH {reg}, w AS (SELECT id, list_filter(regexp_split_to_array(raw_text, '\\s+'), lambda x: x <> '') AS w, list_filter(list_distinct(regexp_extract_all(lower(raw_text), '[\\p{L}\\p{N}]+')), lambda x: length(x) >= 4) AS a,
list_filter(list_distinct(regexp_extract_all(lower(replace(raw_text, 'th', '')), '[\\p{L}\\p{N}]+')), lambda x: length(x) >= 4) AS b FROM reg),
m AS (SELECT id, len(list_intersect(a, b)) / nullif(len(a), 0) AS recall, len(w) > 0 AND (list_sum(list_transform(w, lambda x: length(x))) / nullif(len(w), 0) >= 9 OR len(list_filter(w, lambda x: length(x) >= 15)) / nullif(len(w), 0) >= 0.15 OR len(list_filter(w, lambda x: regexp_matches(x, '\\p{Ll}\\p{Lu}'))) / nullif(len(w), 0) >= 0.08) AS fused FROM w)
SELECT id, coalesce(recall < 0.8, false) AND NOT coalesce(fused, false) AS warned FROM m""")
def recall_warnings(spark, d):
    """Content loss that a fused text layer doesn't explain."""
    raw, lossy = F.col("raw_text"), F.replace("raw_text", S("th"), S(""))
    warned = F.coalesce(markdown.content_recall(raw, lossy) < 0.8, S(False)) & ~markdown.fusion(raw)["suspected"]
    return load(spark, d).select("id", warned.alias("warned"))


# -- images ---------------------------------------------------------------------------------------


@query("""SELECT id, s[2] AS black, s[99] AS white, CASE WHEN (s[99] - s[2]) / 255.0 < 0.05 THEN 0 ELSE CAST(round(greatest(-50, least(50, (CASE WHEN (s[2] + s[99]) / 255.0 > 0.01 THEN 255.0 / (s[2] + s[99]) ELSE 1 END - 1) * 100))) AS INTEGER) END AS brightness,
CASE WHEN (s[99] - s[2]) / 255.0 < 0.05 THEN 0 ELSE CAST(round(greatest(-50, least(50, (CASE WHEN (s[2] + s[99]) / 255.0 > 0.01 THEN (s[2] + s[99]) / (s[99] - s[2]) ELSE 1 END - 1) * 100))) AS INTEGER) END AS contrast
FROM (SELECT c_custkey AS id, list_sort(list_transform(range(0, 100), lambda i: CAST((i * c_custkey) % (20 + c_custkey % 236) AS INTEGER))) AS s FROM customer)""")
def gray_levels(spark, d):
    levels = F.transform(F.sequence(S(0), S(99)), lambda i: ((i * F.col("c_custkey")) % (20 + F.col("c_custkey") % 236)).cast("int"))
    rows = worked(spark, d, "customer").select(F.col("c_custkey").alias("id"), geometry.histogram(levels).alias("h")).select("id", geometry.clip_points(F.col("h")).alias("p"))
    auto = geometry.auto_levels(F.col("p.black"), F.col("p.white"))
    return rows.select("id", "p.black", "p.white", auto["brightness"].alias("brightness"), auto["contrast"].alias("contrast"))


@query("SELECT l_orderkey, l_linenumber, round(greatest(0, least(255, 3 * l_quantity * 4 - 0.5 * (l_tax * 100 + l_discount * 100 + l_quantity + 7))), 6) AS level FROM lineitem")
def sharpened_levels(spark, d):
    level = geometry.sharpened(F.col("l_quantity") * 4, F.col("l_tax") * 100, F.col("l_discount") * 100, F.col("l_quantity"), S(7.0), 50)
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.round(level, 6).alias("level"))


@query("""SELECT l_orderkey, l_linenumber, px < 2 * l_quantity AND py < 30 AS inside, least(100 - 2 * l_quantity, 20.0) AS left_x, CAST(20 AS DOUBLE) AS turned_x, l_quantity >= 49 AS whole FROM (SELECT *, l_tax * 500 + 0.25 AS px, l_discount * 400 + 0.25 AS py FROM lineitem)""")
def crop_quads(spark, d):
    rows = table(spark, d, "lineitem")
    w = F.col("l_quantity") * 2
    quad = geometry.full_frame(w, 30)
    turned = geometry.rotated(F.array(geometry.point(1, 10), geometry.point(2, 0), geometry.point(2, 3), geometry.point(3, 10)), 20)
    return rows.select(
        "l_orderkey",
        "l_linenumber",
        geometry.contains(quad, F.col("l_tax") * 500 + 0.25, F.col("l_discount") * 400 + 0.25).alias("inside"),
        geometry.moved(quad, 20.0, 0.0, 100.0, 60.0)[0]["x"].alias("left_x"),
        (turned[0]["x"] + 10).alias("turned_x"),
        geometry.is_full_frame(quad, 100.0, 30.0).alias("whole"),
    )


@query("""WITH f AS (SELECT doc_id, doc_id % 50 AS g, doc_id % 50 < 20 OR doc_id % 3 = 0 AS img FROM documents), ok AS (SELECT g FROM f GROUP BY g HAVING count(*) FILTER (img) >= 2 AND bool_and(img))
SELECT '/in/' || g AS folder, row_number() OVER (PARTITION BY g ORDER BY doc_id) AS page, '/in/' || g || '/IMG_' || doc_id || '.png' AS path FROM f WHERE g IN (SELECT g FROM ok)""")
def bundle_pages(spark, d):
    img = (F.col("id") % 50 < 20) | (F.col("id") % 3 == 0)
    path = F.concat(S("/in/"), (F.col("id") % 50).cast("string"), S("/IMG_"), text_of("id"), F.when(img, ".png").otherwise(".pdf"))
    return ops.bundle_pages(load(spark, d).select(path.alias("path")))


# -- registry -------------------------------------------------------------------------------------


@query("SELECT p_partkey AS id, p_partkey % 4 < 2 AS confined FROM part")
def confined_paths(spark, d):
    path = pick(_key(), "/archive/x/a.pdf", "/Input/b.pdf", "/archive_old/c.pdf", "/archive/../etc/d.pdf")
    return table(spark, d, "part").select(_key().alias("id"), paths.is_confined(path, ("/archive", "/input")).alias("confined"))


@query("SELECT c_custkey AS id FROM customer WHERE contains(c_name, '0012') UNION ALL SELECT -c_custkey - 1 AS id FROM customer WHERE c_mktsegment = 'FURNITURE'")
def contact_and_tag_filters(spark, d):
    rows = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.upper("c_name").alias("contact_name"), F.lower("c_mktsegment").alias("subcategory"), F.array(S("automobile")).alias("tags"))
    tagged = ops.tag_filter(rows, "Furniture").select((-F.col("id") - 1).alias("id"))
    return ops.contact_filter(rows, "0012").select("id").unionByName(tagged)


@query("WITH {reg} SELECT id, filename FROM reg WHERE id IN (1, 5, 77) UNION ALL SELECT id, filename FROM reg WHERE checksum = (SELECT checksum FROM reg WHERE id = 9) UNION ALL SELECT id, filename FROM reg WHERE path = (SELECT path FROM reg WHERE id = 12)")
def lookups(spark, d):
    """By id, by checksum, by path."""
    docs = load(spark, d)
    row = docs.where("id in (9, 12)").select("id", "checksum", "path").collect()
    of = {r["id"]: r for r in row}
    parts = [ops.lookup(docs, "id", 1, 5, 77), ops.lookup(docs, "checksum", of[9]["checksum"]), ops.lookup(docs, "path", of[12]["path"])]
    return parts[0].union(parts[1]).union(parts[2]).select("id", "filename")


@query("SELECT DISTINCT '/raw/' || user_id AS original_path FROM events WHERE user_id % 4 <> 1")
def blocked_delete(spark, d):
    rows = table(spark, d, "events").select(F.concat(S("/raw/"), text_of("user_id")).alias("original_path")).distinct()
    gone = table(spark, d, "events").where("user_id % 4 = 1").select(F.concat(S("/raw/"), text_of("user_id")).alias("original_path"))
    return ops.delete(rows, gone, "original_path")


@query("""WITH {reg}, t AS (SELECT id, '/archive/' || category || '/' || CASE WHEN id % 2 = 0 THEN 'a' ELSE CAST(id AS VARCHAR) END || '.pdf' AS target FROM reg),
p AS (SELECT id, CASE WHEN id % 2 = 1 AND id % 3 = 0 THEN replace(target, '.pdf', '_20240630000000.pdf') ELSE target END AS placed FROM t)
SELECT id, CASE WHEN n = 1 THEN placed ELSE replace(placed, '.pdf', '') || '_' || (n - 1) || '.pdf' END AS placed FROM (SELECT *, row_number() OVER (PARTITION BY lower(placed) ORDER BY id) AS n FROM p)""")
def moves_without_overwrite(spark, d):
    docs = load(spark, d)
    name = F.when(F.col("id") % 2 == 0, "a").otherwise(text_of("id"))
    moves = docs.select("id", F.concat(S("/archive/"), "category", S("/"), name, S(".pdf")).alias("target"))
    files_ = moves.where("id % 2 = 1 and id % 3 = 0").select(F.upper("target").alias("path"))
    return ops.without_overwrite(moves, files_, F.to_timestamp(S(f"{TODAY} 00:00:00"))).select("id", "placed")


@query("WITH {reg} SELECT id, CASE WHEN n = 1 THEN name ELSE replace(name, '.pdf', '') || '_' || (n - 1) || '.pdf' END AS target FROM (SELECT id, name, row_number() OVER (PARTITION BY name ORDER BY id) AS n FROM (SELECT id, category || '.pdf' AS name FROM reg WHERE id % 3 = 0))")
def package_names(spark, d):
    """Files of a package whose names collide."""
    docs = load(spark, d).withColumn("filename", F.concat("category", S(".pdf")))
    return ops.package(docs, docs.where("id % 3 = 0").select("id"))[0].select("id", "target")


@query("WITH {reg} SELECT id, category, title FROM reg WHERE lower(category) = 'src3' AND lower(subcategory) = 'fr'")
def csv_export(spark, d):
    """Filtered rows written as CSV and read back."""
    path = f"{scratch_folder(spark, 'export')}/csv"
    files.write_csv(load(spark, d).select("id", "category", "subcategory", "title", "tags"), path, category="SRC3", subcategory="FR")
    rows = spark.read.option("header", True).option("escape", '"').option("multiLine", True).csv(path)
    first = rows.columns[0]
    return rows.select(F.col(f"`{first}`").cast("long").alias("id"), "category", "title")


@query("WITH {reg}, n AS (SELECT id, category, regexp_replace(title, '[\\\\/:*?\"<>|\\s]+', '_', 'g') AS name, count(*) OVER (PARTITION BY lower(title)) AS k, raw_text FROM (SELECT id, category, title[1:12] AS title, raw_text FROM reg)) SELECT category, CASE WHEN k > 1 THEN name || '_' || id ELSE name END || '.md' AS name, length(raw_text) AS size FROM n")
def markdown_export(spark, d):
    path = f"{scratch_folder(spark, 'export')}/md"
    files.write_markdown(load(spark, d).withColumn("title", F.substring("title", 1, 12)), path)
    return spark.read.parquet(path).select("category", "name", F.length("body").alias("size"))


@query("WITH {reg} SELECT id, title, (SELECT count(*) FROM reg) AS total_count FROM reg")
def registry_mirror(spark, d):
    """The JSON mirror, written twice over itself, and its envelope."""
    path = f"{scratch_folder(spark, 'export')}/mirror"
    docs = load(spark, d).select("id", "title")
    files.write_registry(docs.limit(1), path, TODAY)
    files.write_registry(docs, path, TODAY)
    now_at = versions.current(spark, path)
    total = spark.read.json(f"{now_at}/envelope").select("total_count")
    return spark.read.schema("id long, title string").json(f"{now_at}/documents").crossJoin(total)  # one row


@query("""WITH {reg}, s AS (SELECT count(*) AS documents, CAST(sum(strlen(raw_text)) AS BIGINT) AS text_bytes FROM reg) SELECT documents, text_bytes, (SELECT count(*) FROM orders) AS files, (SELECT CAST(sum(o_orderkey) AS BIGINT) FROM orders) AS bytes, 2 AS formats FROM s""")
def system_stats(spark, d):
    name = F.when(F.col("o_orderkey") % 2 == 0, "a.PDF").otherwise("b.png")
    return ops.system_stats(load(spark, d), table(spark, d, "orders").select(name.alias("filename"), F.col("o_orderkey").alias("size")))


@query("SELECT (SELECT count(*) FROM orders) AS blocked, count(*) AS decisions, count(*) FILTER (event_id % 3 <> 0) AS enabled FROM events")
def learning_totals(spark, d):
    enabled = F.when(F.col("event_id") % 3 == 0, 0).when(F.col("event_id") % 3 == 1, 1)
    return ops.learning_totals(table(spark, d, "orders"), table(spark, d, "events").select(enabled.alias("enabled")))


@query("""SELECT count(*) AS scanned, count(*) FILTER (id % 10 = 7) AS repaired, count(*) FILTER (id % 10 IN (2, 3)) AS updated, count(*) FILTER (id % 10 = 4) AS relocalized, count(*) FILTER (id % 10 IN (0, 8, 9)) AS moved_to_raws FROM (SELECT doc_id AS id FROM documents)""")
def repair_counters(spark, d):
    """A file without text, an unknown one that the rules don't place and a known one that stays generic go back; stale text and a generic place are updated."""
    k = F.col("id") % 10
    base = load(spark, d).select("id", text_of("id").alias("checksum"), F.date_format(F.to_date("date"), "yyyy-MM-dd").alias("date"), "filename")
    full = F.concat(S("a text of some length "), text_of("id"))
    docs = base.where("id % 10 not in (7, 8)").select(
        "id", "checksum", "date", S("bank").alias("category"), F.when(k.isin(3, 9), "general").otherwise("sfr").alias("subcategory"), F.when(k == 2, "[no text]").otherwise(full).alias("raw_text")
    )
    folder = F.when(k == 4, "/archive/old/").otherwise(F.concat(S("/archive/bank/sfr/"), F.substring("date", 1, 4), S("/")))
    year = F.when(k == 7, S(f"/archive/bank/sfr/{TODAY[:4]}/")).otherwise(folder)
    found = base.select(
        F.concat(year, "filename").alias("path"), "checksum", F.when(k == 0, " ").otherwise(full).alias("fresh_text"), S("bank").alias("rule_category"), F.when(k.isin(8, 9), "general").otherwise("sfr").alias("rule_subcategory")
    )
    return ops.repair_counters(ops.repair_plan(found, docs, now()))


@query("SELECT user_id AS filename, count(*) AS entries, arg_max(event_type, (ts, event_id)) AS status, arg_max(CASE WHEN event_id % 2 = 0 THEN event_type END, (ts, event_id)) AS category FROM events GROUP BY 1")
def log_session_categories(spark, d):
    rows = table(spark, d, "events").select(F.col("user_id").alias("filename"), "ts", "event_id", F.col("event_type").alias("status"), F.when(F.col("event_id") % 2 == 0, F.col("event_type")).alias("category"))
    return ops.log_sessions(rows).select("filename", "entries", "status", "category")


@query("SELECT 'hint ' || user_id AS hint FROM events GROUP BY user_id ORDER BY max(ts) DESC, max(event_id) DESC LIMIT 50")
def newest_hints(spark, d):
    """The newest hints, each text once."""
    hint = F.concat(S("hint "), text_of("user_id"))
    return ops.newest_hints(table(spark, d, "events").select(F.col("event_id").alias("id"), hint.alias("hint"), F.col("ts").alias("created_at"))).select("hint")


@query("SELECT c_custkey AS id, CASE WHEN c_custkey % 2 = 0 THEN 'c' WHEN c_custkey % 3 = 0 THEN 'a' ELSE c_name END AS title FROM customer")
def patched_twice(spark, d):
    """Several patches of one row, the last one's fields first; rows stay rows."""
    rows = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("title"))
    patches = rows.where("id % 2 = 0").select("id", S("c").alias("title"), S(3).alias("n")).unionByName(rows.where("id % 2 = 0").select("id", S("b").alias("title"), S(2).alias("n")))
    patches = patches.unionByName(rows.where("id % 3 = 0").select("id", S("a").alias("title"), S(1).alias("n")))
    return ops.patch(rows, patches, order="n")


# -- sources --------------------------------------------------------------------------------------


@query("SELECT DISTINCT 'src=' || source AS folder, 1 AS files, true AS sized FROM documents")
def scanned_files(spark, d):
    """A recursive scan that leaves out dot folders, duplicates, blocked files and an ignored subtree."""
    base = f"{scratch_folder(spark, 'scan')}/in"
    load(spark, d).select(F.col("category").alias("src"), "title").repartition(1).write.partitionBy("src").parquet(base)
    for folder in ("__duplicates", "__blocked_files/x", "out/src=src1"):
        spark.range(1).coalesce(1).write.parquet(f"{base}/{folder}")
    inside = F.regexp_replace(S(base), "^[a-z]+:/+", "/")
    rows = files.list_files(spark, base, ("parquet",)).where(~paths.is_inside(F.col("path"), F.concat(inside, S("/out"))))
    return rows.groupBy(F.regexp_extract("path", "/([^/]*)/[^/]*$", 1).alias("folder")).agg(F.count(F.lit(1)).cast("int").alias("files"), F.bool_and((F.col("size") > 0) & F.col("filename").endswith(".parquet")).alias("sized"))


def _json_file(df, whole: str | None = None) -> str:
    """One row, or one column of it, as the text of a JSON file."""
    path = f"{scratch_folder(df.sparkSession, 'source')}/json"
    df.select(F.to_json(F.struct(*df.columns) if whole is None else F.col(whole)).alias("value")).coalesce(1).write.text(path)
    return path


@query("""WITH {reg}, p AS (SELECT DISTINCT category, subcategory AS slug FROM reg WHERE category IS NOT NULL AND subcategory IS NOT NULL), l AS (SELECT slug, min(category) AS first FROM p GROUP BY slug), c AS (SELECT category, count(*) AS n FROM p GROUP BY 1)
SELECT 'taxonomy' AS kind, category, slug, upper(slug) AS name, slug || category AS more FROM p UNION ALL SELECT 'taxonomy', category, slug || '/z', 'Z', '' FROM p
UNION ALL SELECT 'entity', 'banks', slug, upper(slug), '0' FROM l UNION ALL SELECT 'entity', 'banks', slug, first, '1' FROM l UNION ALL SELECT 'entity', 'gov', slug, slug, '0' FROM l
UNION ALL SELECT 'overlay', category, 'sub', category || '1', 'filename' FROM c UNION ALL SELECT 'setting', category, '', CAST(n AS VARCHAR), '' FROM c""")
def configuration_sources(spark, d):
    """Taxonomy of two levels, entity dictionary, personal rules and settings, each from its file, made of the places in use."""
    places = load(spark, d).select("category", F.col("subcategory").alias("slug")).where("category is not null and slug is not null").distinct()
    below = F.array(F.struct(S("z").alias("id"), S("Z").alias("name")))
    subs = F.collect_list(F.struct(F.col("slug").alias("id"), F.upper("slug").alias("name"), F.array(F.concat("slug", "category")).alias("aliases"), below.alias("subcategories")))
    counts = places.groupBy("category").agg(F.count(F.lit(1)).alias("n"), subs.alias("subcategories"))
    taxonomy = counts.agg(F.collect_list(F.struct(F.col("category").alias("id"), F.upper("category").alias("name"), "subcategories")).alias("categories"))
    slugs = places.groupBy("slug").agg(F.min("category").alias("first"))
    banks = F.collect_list(F.struct("slug", F.upper("slug").alias("name"), F.array("first").alias("aliases")))
    entities = slugs.agg(banks.alias("banks"), F.collect_list(F.struct("slug", F.col("slug").alias("name"))).alias("gov"))
    keyword = F.array(F.concat("category", S("1")))
    overlay = counts.agg(F.collect_list(F.struct(keyword.alias("keywords"), "category", S("sub").alias("subcategory"), S("filename").alias("scope"))).alias("priorityRules"))
    settings = counts.agg(F.map_from_entries(F.collect_list(F.struct("category", F.col("n").cast("string")))).alias("m"))
    kind = lambda k, *c: [S(k).alias("kind"), *(x.alias(n) for x, n in zip(c, ("category", "slug", "name", "more"), strict=True))]
    one = files.read_taxonomy(spark, _json_file(taxonomy)).select(*kind("taxonomy", F.col("category"), F.col("slug"), F.col("name"), F.coalesce(F.array_join("aliases", ","), S(""))))
    two = files.read_entities(spark, _json_file(entities)).select(*kind("entity", F.col("domain"), F.col("slug"), F.col("surface"), text_of("ordinal")))
    three = files.read_overlay(spark, _json_file(overlay)).select(*kind("overlay", F.col("category"), F.col("subcategory"), F.col("keywords")[0], F.col("scope")))
    four = files.read_settings(spark, _json_file(settings, "m")).select(*kind("setting", F.col("key"), S(""), F.col("value"), S("")))
    return one.union(two).union(three).union(four)


# -- streams and logs -----------------------------------------------------------------------------


@query("""WITH {reg}, t AS (SELECT id % 4 = 1 AS skipped, length(regexp_replace(regexp_replace(raw_text, '^\\s+', ''), '\\s+$', '')) < 10 AS blocked, row_number() OVER (PARTITION BY id % 4 = 1, checksum ORDER BY path, id) AS rn FROM reg),
s AS (SELECT CASE WHEN skipped THEN 'SKIPPED' WHEN blocked THEN 'BLOCKED' WHEN rn > 1 THEN 'DUPLICATE' ELSE 'MOVED' END AS status FROM t)
SELECT CASE WHEN status = 'MOVED' THEN 'FILE_COMPLETED' ELSE 'FILE_FAILED' END AS type, status, count(*) AS n FROM s GROUP BY 1, 2 UNION ALL SELECT t, NULL, 1 FROM (SELECT unnest(['TASK_STARTED', 'SCAN_STARTED', 'SCAN_COMPLETED', 'TASK_FINISHED', 'REGISTRY_UPDATED', 'DOCUMENTS_UPDATED']) AS t)""")
def stream_events(spark, d):
    """A scan as a stream: files in the cache are skipped, and every event that the scan sends."""
    base = scratch_folder(spark, "stream")
    docs = load(spark, d).select("id", "path", "filename", "raw_text", F.col("id").cast("double").alias("mtime_ms"), F.col("size").cast("long").alias("size"))
    docs.write.parquet(f"{base}/in")  # all files are one batch
    cached = docs.where("id % 4 in (1, 2)").select(F.col("path").alias("original_path"), F.when(F.col("id") % 4 == 2, F.col("mtime_ms") - 1).otherwise(F.col("mtime_ms")).alias("mtime_ms"), "size")
    cached.write.parquet(f"{base}/blocked/writer=earlier/batch=0")
    source = spark.readStream.schema(docs.schema).parquet(f"{base}/in")
    streams.ingest(source, f"{base}/registry", f"{base}/events", f"{base}/checkpoint", blocked_path=f"{base}/blocked").awaitTermination()
    return spark.read.parquet(f"{base}/events").groupBy("type", "status").agg(F.count(F.lit(1)).alias("n"))


@query("""WITH o AS (SELECT *, event_id % 2 = 0 AS early FROM events) SELECT 'INIT' AS frame, event_id FROM (SELECT * FROM o WHERE early ORDER BY ts DESC, event_id DESC LIMIT 300) UNION ALL SELECT 'LOG', event_id FROM o WHERE NOT early""")
def log_frames(spark, d):
    rows = table(spark, d, "events").select("event_id", "ts")
    return streams.log_frames(rows.where("event_id % 2 = 0"), rows.where("event_id % 2 = 1")).select("frame", "event_id")


@query("""WITH e AS (SELECT user_id AS task, ts, event_id, CASE event_id % 5 WHEN 0 THEN 'started' WHEN 1 THEN 'progress' WHEN 2 THEN 'finished' WHEN 3 THEN 'failed' END AS state FROM events WHERE event_id % 5 < 4),
p AS (SELECT *, coalesce(lag(state) OVER (PARTITION BY task ORDER BY ts, event_id), 'idle') AS before FROM e)
SELECT event_id, state, CASE WHEN before IN ('idle', 'finished', 'failed') THEN state = 'started' ELSE state <> 'started' END AS valid FROM p""")
def task_transitions(spark, d):
    """Each task event's state, and whether it may follow the one before it."""
    kind = pick(F.col("event_id"), "TASK_STARTED", "TASK_PROGRESS", "TASK_FINISHED", "TASK_FAILED", "SCAN_STARTED")
    rows = table(spark, d, "events").select(F.col("user_id").alias("task"), "ts", "event_id", kind.alias("type"))
    return streams.task_history(rows).select("event_id", "state", "valid")


@query("SELECT 'CATEGORIES_UPDATED' AS type, CAST(o_orderkey AS VARCHAR) AS key FROM orders WHERE o_orderkey % 7 = 0")
def mutation_events(spark, d):
    return streams.mutation_events("CATEGORIES_UPDATED", table(spark, d, "orders").where("o_orderkey % 7 = 0"), "o_orderkey")
