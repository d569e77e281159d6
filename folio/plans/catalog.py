"""Registered queries of the engine's own operators, each with its SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folio.functions import dates, geometry, markdown, paths, text
from folio.operators import registry_ops as ops
from folio.operators import retrieval, rules, search_index
from folio.plans.query import StructuredQuery
from folio.registry import REGISTRY_SQL, TODAY, load, registry
from folio.session import scratch_folder, spread
from folio.streaming.ingest import ingest

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}



def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql.replace("{reg}", REGISTRY_SQL.strip())
        return f

    return add


def now():
    return F.to_date(F.lit(TODAY))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def worked(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of short rows with much work on each: dealt over all cores, however few its files are."""
    return spread(table(spark, sf_dir, name))


# -- counts, filters ------------------------------------------------------------------------------


@query("WITH {reg} SELECT lower(category) AS category, lower(coalesce(nullif(subcategory, ''), 'general')) AS subcategory, count(*) AS count FROM reg GROUP BY 1, 2")
def category_counts(spark, d):
    return ops.category_counts(load(spark, d))


@query("""WITH {reg}, c AS (SELECT lower(category) AS c, lower(coalesce(nullif(subcategory, ''), 'general')) AS s, count(*) AS n FROM reg GROUP BY 1, 2)
SELECT CAST(sum(n) AS BIGINT) AS documents, count(DISTINCT c) AS categories, count(DISTINCT CASE WHEN s <> 'general' THEN c || '/' || s END) AS subcategories FROM c""")
def registry_totals(spark, d):
    return ops.totals(ops.category_counts(load(spark, d)))


@query("""WITH {reg}, c AS (SELECT lower(category) AS c, lower(coalesce(nullif(subcategory, ''), 'general')) AS s, count(*) AS n FROM reg GROUP BY 1, 2)
SELECT s AS subcategory, CAST(sum(n) AS BIGINT) AS count, count(DISTINCT c) AS categories FROM c GROUP BY s""")
def subcategory_totals(spark, d):
    return ops.subcategory_totals(ops.category_counts(load(spark, d)))


@query("WITH {reg} SELECT id, title, category, subcategory FROM reg WHERE (lower(title) LIKE '%license%' OR lower(filename) LIKE '%license%' OR lower(raw_text) LIKE '%license%') AND lower(subcategory) = 'en'")
def list_filter(spark, d):
    return ops.list_filter(load(spark, d), "LICENSE", subcategory="EN").select("id", "title", "category", "subcategory")


@query("WITH {reg} SELECT id, substr(raw_text, 1, 800) AS raw_text FROM reg WHERE category = 'src1'")
def preview_projection(spark, d):
    return ops.preview(ops.list_filter(load(spark, d), category="src1")).select("id", "raw_text")


@query("WITH {reg} SELECT id FROM reg WHERE length(regexp_replace(regexp_replace(raw_text, '^\\s+', ''), '\\s+$', '')) < 10")
def no_text_guard(spark, d):
    return ops.without_text(load(spark, d)).select("id")


@query("WITH {reg} SELECT id, date FROM reg WHERE date <> '' AND date >= '2023-03-01' AND date <= '2023-04-30'")
def date_bounds(spark, d):
    return ops.in_dates(load(spark, d), "2023-03-01", "2023-04-30").select("id", "date")


@query("""SELECT p_partkey, p_type, (n = '' OR r IN ('general', 'other', 'divers', 'unknown', 'none') OR regexp_matches(n, '^\\d+$') OR regexp_matches(r, '[._-](pdf|jpg|png|txt)$')) AS forbidden FROM (
SELECT p_partkey, p_type, regexp_replace(lower(v), '[^a-z0-9]+', '', 'g') AS n, lower(v) AS r FROM (
SELECT p_partkey, p_type, CASE p_partkey % 6 WHEN 0 THEN 'general' WHEN 1 THEN CAST(p_partkey AS VARCHAR) WHEN 2 THEN 'scan_' || CAST(p_partkey AS VARCHAR) || '.pdf' WHEN 3 THEN '--' ELSE p_type END AS v FROM part))""")
def forbidden_subcategory(spark, d):
    key = F.col("p_partkey").cast("string")
    v = F.when(F.col("p_partkey") % 6 == 0, "general").when(F.col("p_partkey") % 6 == 1, key).when(F.col("p_partkey") % 6 == 2, F.concat(F.lit("scan_"), key, F.lit(".pdf")))
    v = v.when(F.col("p_partkey") % 6 == 3, "--").otherwise(F.col("p_type"))
    return table(spark, d, "part").select("p_partkey", "p_type", text.is_forbidden(v).alias("forbidden"))


@query("""WITH {reg} SELECT id, '/archive/' || lower(trim(category)) || '/' || CASE WHEN id % 7 = 0 THEN 'general' ELSE lower(trim(subcategory)) || '/x' END || '/' ||
CASE WHEN id % 5 = 0 THEN '2024' ELSE substr(date, 1, 4) END || '/' || filename AS target FROM reg""")
def canonical_path(spark, d):
    docs = load(spark, d)
    sub = F.when(F.col("id") % 7 == 0, "2019").otherwise(F.concat("subcategory", F.lit("//x")))
    date = F.when(F.col("id") % 5 == 0, "").otherwise(F.col("date"))
    target = paths.canonical_path(F.lit("/archive"), F.col("path"), F.col("category"), sub, date, now())
    return docs.select("id", target.alias("target"))


@query("WITH {reg} SELECT id, path = '/archive/src1' OR starts_with(lower(path), '/archive/src1/') AS inside FROM reg")
def path_inside(spark, d):
    return load(spark, d).select("id", paths.is_inside(F.col("path"), F.lit("/archive/SRC1")).alias("inside"))


@query("""WITH {reg}, e AS (SELECT id, date_diff('day', DATE '2024-06-30', CAST(date AS DATE) + 250) AS days FROM reg WHERE id % 9 <> 0)
SELECT bucket, count(*) AS n FROM (SELECT CASE WHEN days < 0 THEN 'expired' WHEN days <= 60 THEN 'soon' ELSE 'valid' END AS bucket FROM e UNION ALL SELECT NULL FROM reg WHERE id % 9 = 0) GROUP BY bucket""")
def expiry_buckets(spark, d):
    due = F.date_format(F.date_add(F.to_date("date"), 250), "yyyy-MM-dd")
    expiry = F.when(F.col("id") % 9 != 0, due).otherwise("soon?")
    return load(spark, d).groupBy(dates.expiry_bucket(expiry, now()).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


# -- duplicates and names -------------------------------------------------------------------------


@query("WITH {reg} SELECT id, checksum FROM reg WHERE id % 3 = 0 AND checksum NOT IN (SELECT checksum FROM reg WHERE id % 3 <> 0)")
def dedupe_new(spark, d):
    docs = load(spark, d)
    return ops.split_known(docs.where("id % 3 = 0"), docs.where("id % 3 <> 0"))[0].select("id", "checksum")


@query("WITH {reg} SELECT id, CASE WHEN f <> id THEN f END AS copy_of FROM (SELECT id, CASE WHEN checksum IS NOT NULL THEN first_value(id) OVER (PARTITION BY checksum ORDER BY path, id) END AS f FROM (SELECT id, path, CASE WHEN id % 10 <> 0 THEN checksum END AS checksum FROM reg))")
def dedupe_batch(spark, d):
    """Every tenth row has no content; it copies nothing and stays."""
    docs = load(spark, d).withColumn("checksum", F.when(F.col("id") % 10 != 0, F.col("checksum")))
    return ops.first_of_batch(docs).select("id", "copy_of")


@query("""SELECT id, CASE WHEN n = 1 THEN name ELSE replace(name, '.pdf', '') || '_dup' || CAST(n - 1 AS VARCHAR) || '.pdf' END AS target FROM (
SELECT doc_id AS id, name, row_number() OVER (PARTITION BY lower(name) ORDER BY doc_id) AS n FROM (SELECT doc_id, source || '_' || lang || '.pdf' AS name FROM documents))""")
def name_collisions(spark, d):
    docs = load(spark, d).withColumn("filename", F.concat("category", F.lit("_"), "subcategory", F.lit(".pdf")))
    return ops.collision_names(docs.select("id", "filename")).select("id", "target")


@query("""WITH {reg}, n AS (SELECT id, CASE WHEN id % 10 < 8 THEN checksum END AS checksum FROM reg), t AS (SELECT * FROM n WHERE id % 2 = 0),
f AS (SELECT *, row_number() OVER (PARTITION BY checksum ORDER BY id) AS rn FROM n WHERE id % 2 = 1 AND (checksum IS NULL OR checksum NOT IN (SELECT checksum FROM t WHERE checksum IS NOT NULL)))
SELECT id, checksum FROM t UNION ALL SELECT id, checksum FROM f WHERE rn = 1 OR checksum IS NULL""")
def insert_unique(spark, d):
    """A fifth of the rows has no checksum; they are all new."""
    docs = load(spark, d).withColumn("checksum", F.when(F.col("id") % 10 < 8, F.col("checksum")))
    return ops.insert(docs.where("id % 2 = 0"), docs.where("id % 2 = 1")).select("id", "checksum")


# -- taxonomy -------------------------------------------------------------------------------------

_PUBLIC = [("src1", "en", "English", ["eng"]), ("src1", "fr", "French", ["fra"]), ("src2", "it", "Italian", ["ita"]), ("src3", "en", "English", ["eng"])]
_PRIVATE = [("src1", "fr", "Français", ["fra", "french"]), ("src2", "de", "German", ["deu"])]
_TAXONOMY_SQL = """pub(category, slug, name, aliases) AS (VALUES ('src1', 'en', 'English', ['eng']), ('src1', 'fr', 'French', ['fra']), ('src2', 'it', 'Italian', ['ita']), ('src3', 'en', 'English', ['eng'])),
priv(category, slug, name, aliases) AS (VALUES ('src1', 'fr', 'Français', ['fra', 'french']), ('src2', 'de', 'German', ['deu'])),
merged AS (SELECT category, slug, name, aliases FROM (SELECT *, row_number() OVER (PARTITION BY category, slug ORDER BY p) AS rn FROM (SELECT *, 1 AS p FROM pub UNION ALL SELECT *, 0 AS p FROM priv)) WHERE rn = 1)"""


def _taxonomy(spark):
    kind = "category string, slug string, name string, aliases array<string>"
    return spark.createDataFrame(_PUBLIC, kind), spark.createDataFrame(_PRIVATE, kind)


_ENTRIES_SQL = """pub AS (SELECT p_brand AS category, 's' || p_partkey AS slug, p_name AS name, [p_type] AS aliases FROM part),
priv AS (SELECT p_brand AS category, 's' || p_partkey AS slug, CASE WHEN p_partkey % 6 = 0 THEN p_name ELSE upper(p_name) END AS name, [p_type] AS aliases FROM part WHERE p_partkey % 3 = 0
UNION ALL SELECT p_brand, 'x' || p_partkey, p_name, [] FROM part WHERE p_partkey % 5 = 0),
merged AS (SELECT * FROM priv UNION ALL SELECT * FROM pub WHERE (category, slug) NOT IN (SELECT (category, slug) FROM priv))"""


def _entries(spark, d):
    """Public entries, one a part, and private ones: a third of these again, half of them renamed, and some more."""
    key, part = F.col("p_partkey"), table(spark, d, "part")
    slug = lambda mark: F.concat(F.lit(mark), key.cast("string")).alias("slug")
    brand = F.col("p_brand").alias("category")
    public = part.select(brand, slug("s"), F.col("p_name").alias("name"), F.array("p_type").alias("aliases"))
    renamed = F.when(key % 6 == 0, F.col("p_name")).otherwise(F.upper("p_name"))
    again = part.where(key % 3 == 0).select(brand, slug("s"), renamed.alias("name"), F.array("p_type").alias("aliases"))
    more = part.where(key % 5 == 0).select(brand, slug("x"), F.col("p_name").alias("name"), F.array().cast("array<string>").alias("aliases"))
    return public, again.union(more)


@query(f"WITH {_ENTRIES_SQL} SELECT category, slug, name, array_to_string(aliases, ',') AS aliases FROM merged")
def taxonomy_merge(spark, d):
    return ops.merge_taxonomy(*_entries(spark, d)).withColumn("aliases", F.array_join("aliases", ","))


@query(f"WITH {_ENTRIES_SQL} SELECT category, slug, name FROM (SELECT * FROM merged EXCEPT SELECT * FROM pub)")
def taxonomy_overlay_diff(spark, d):
    public, private = _entries(spark, d)
    return ops.taxonomy_overlay(ops.merge_taxonomy(public, private), public).select("category", "slug", "name")


@query(f"""WITH {{reg}}, {_TAXONOMY_SQL}, c AS (SELECT lower(category) AS category, lower(subcategory) AS slug, count(*) AS n FROM reg GROUP BY 1, 2)
SELECT coalesce(m.category, c.category) AS category, coalesce(m.slug, c.slug) AS subcategory, coalesce(m.name, upper(c.slug[1]) || c.slug[2:]) AS name, coalesce(c.n, 0) AS count, m.name IS NOT NULL AS configured
FROM merged m FULL OUTER JOIN c ON m.category = c.category AND m.slug = c.slug""")
def taxonomy_counts_full_outer(spark, d):
    return ops.counts_with_taxonomy(ops.merge_taxonomy(*_taxonomy(spark)), ops.category_counts(load(spark, d)))


@query("WITH {reg} SELECT subcategory AS slug, array_to_string(list_sort(list(DISTINCT category)), ',') AS owners FROM reg GROUP BY 1 HAVING count(DISTINCT category) > 1")
def ambiguous_owners(spark, d):
    entries = load(spark, d).select("category", F.col("subcategory").alias("slug"))
    return ops.ambiguous_slugs(entries).withColumn("owners", F.array_join("owners", ","))


@query(f"WITH {{reg}}, {_TAXONOMY_SQL} SELECT category, slug FROM merged m WHERE NOT EXISTS (SELECT 1 FROM reg r WHERE lower(r.category) = m.category AND lower(r.subcategory) = m.slug)")
def unused_entries(spark, d):
    return ops.unused_entries(ops.merge_taxonomy(*_taxonomy(spark)), load(spark, d)).select("category", "slug")


@query("WITH {reg} SELECT id, CASE WHEN category = 'src1' AND subcategory = 'en' THEN 'english' WHEN category = 'src2' AND subcategory = 'fr' THEN 'french' ELSE subcategory END AS subcategory FROM reg")
def rename_subcategory(spark, d):
    mapping = spark.createDataFrame([("src1", "EN", "english"), ("SRC2", "fr", "french")], "category string, old string, new string")
    return ops.rename_subcategory(load(spark, d), mapping).select("id", "subcategory")


@query("SELECT key, array_to_string(list_sort(list(DISTINCT slug)), ',') AS slugs FROM (SELECT replace(lower(p_name), ' ', CASE p_partkey % 3 WHEN 0 THEN '_' WHEN 1 THEN '-' ELSE '' END) AS slug, regexp_replace(lower(p_name), '[^a-z0-9]', '', 'g') AS key FROM part) GROUP BY key HAVING count(DISTINCT slug) > 1")
def squeezed_collisions(spark, d):
    joiner = F.when(F.col("p_partkey") % 3 == 0, "_").when(F.col("p_partkey") % 3 == 1, "-").otherwise("")
    slugs = table(spark, d, "part").select(F.replace(F.lower("p_name"), F.lit(" "), joiner).alias("slug"), F.lit("part").alias("category"))
    return ops.squeezed_collisions(slugs).withColumn("slugs", F.array_join("slugs", ","))


@query("""WITH s AS (SELECT DISTINCT lower(p_name) AS s FROM part WHERE length(p_name) >= 4)
SELECT a.s AS a, b.s AS b, round(1 - levenshtein(a.s, b.s) / greatest(length(a.s), length(b.s)), 6) AS similarity FROM s a JOIN s b ON a.s < b.s
WHERE 1 - levenshtein(a.s, b.s) / greatest(length(a.s), length(b.s)) >= 0.82""")
def fuzzy_slugs(spark, d):
    slugs = table(spark, d, "part").select(F.lower("p_name").alias("slug"))
    return ops.similar_slugs(slugs).withColumn("similarity", F.round("similarity", 6))


# -- rules and entities ---------------------------------------------------------------------------


@query("""WITH {reg}, t AS (SELECT id, lower(filename || ' ' || substr(raw_text, 1, 4000)) AS x FROM reg)
SELECT CASE WHEN regexp_matches(x, '(^|[^\\p{L}])apache license($|[^\\p{L}])') THEN 'apache' WHEN regexp_matches(x, '(^|[^\\p{L}])mit license($|[^\\p{L}])') THEN 'mit'
WHEN regexp_matches(x, '(^|[^\\p{L}])gnu general public license($|[^\\p{L}])') THEN 'gpl' WHEN regexp_matches(x, '(^|[^\\p{L}])cc by-nc($|[^\\p{L}])') THEN 'cc_by_nc'
WHEN regexp_matches(x, '(^|[^\\p{L}])all rights reserved($|[^\\p{L}])') THEN 'reserved' END AS subcategory, count(*) AS n FROM t GROUP BY 1""")
def rule_first_match(spark, d):
    rule = rules.first_rule(F.col("raw_text"), F.col("filename"), rules.LICENSE_RULES)
    return load(spark, d).groupBy(rule["subcategory"].alias("subcategory")).agg(F.count(F.lit(1)).alias("n"))


_DICTIONARY = {
    "gov": [{"slug": "the_and", "name": "the and", "aliases": ["of the"]}],
    "health": [{"slug": "copyright", "name": "all rights reserved", "aliases": []}, {"slug": "apache", "name": "Apache License", "aliases": ["version 2.0"]}],
    "banks": [{"slug": "der", "name": "und der", "aliases": ["der die"]}],
}


@query("""WITH {reg}, t AS (SELECT id, lower(raw_text) AS x FROM reg) SELECT id, slug FROM (SELECT id, CASE
WHEN regexp_matches(x, '(^|[^\\p{L}\\p{N}])the and($|[^\\p{L}\\p{N}])') OR regexp_matches(x, '(^|[^\\p{L}\\p{N}])of the($|[^\\p{L}\\p{N}])') THEN 'the_and'
WHEN regexp_matches(x, '(^|[^\\p{L}\\p{N}])all rights reserved($|[^\\p{L}\\p{N}])') THEN 'copyright'
WHEN regexp_matches(x, '(^|[^\\p{L}\\p{N}])apache license($|[^\\p{L}\\p{N}])') OR regexp_matches(x, '(^|[^\\p{L}\\p{N}])version 2\\.0($|[^\\p{L}\\p{N}])') THEN 'apache'
WHEN regexp_matches(x, '(^|[^\\p{L}\\p{N}])und der($|[^\\p{L}\\p{N}])') OR regexp_matches(x, '(^|[^\\p{L}\\p{N}])der die($|[^\\p{L}\\p{N}])') THEN 'der' END AS slug FROM t) WHERE slug IS NOT NULL""")
def entity_match(spark, d):
    found = rules.first_entity(F.lower("raw_text"), _DICTIONARY)
    return load(spark, d).select("id", found["slug"].alias("slug")).where("slug is not null")


@query("""SELECT doc_id AS id, len(list_filter(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+'), lambda w: w = 'apache')) >= 1 AS grounded FROM documents""")
def grounded_slug(spark, d):
    grounded = text.is_grounded(F.lit("apache"), F.col("raw_text"), F.col("filename"))
    return load(spark, d).select("id", grounded.alias("grounded"))


# -- retrieval ------------------------------------------------------------------------------------

_indexes: dict[tuple[str, str], str] = {}


def index(spark: SparkSession, sf_dir: str) -> str:
    """Path of the documents' search index, one per application and folder; built when it is missing or has drifted."""
    key = spark.sparkContext.applicationId, sf_dir
    path = _indexes.setdefault(key, scratch_folder(spark, "index"))
    search_index.ensure(load(spark, sf_dir), path)
    return path


#: the texts alone
_TEXT = {"raw_text": 0.5}


@query("""WITH {reg}, tok AS (SELECT id, regexp_extract_all(lower(raw_text), '[\\p{L}\\p{N}]+') AS r FROM reg),
f AS (SELECT id, len(r) AS len, 0.5 * len(list_filter(r, lambda w: w = 'license')) AS f1, 0.5 * len(list_filter(r, lambda w: w = 'apache')) AS f2, 0.5 * len(list_filter(r, lambda w: w = 'version')) AS f3 FROM tok),
s AS (SELECT count(*) AS n, avg(len) AS av, count(*) FILTER (f1 > 0) AS d1, count(*) FILTER (f2 > 0) AS d2, count(*) FILTER (f3 > 0) AS d3 FROM f)
SELECT id, round(ln(1 + (n - d1 + 0.5) / (d1 + 0.5)) * f1 * 2.2 / (f1 + 1.2 * (0.25 + 0.75 * len / av)) + ln(1 + (n - d2 + 0.5) / (d2 + 0.5)) * f2 * 2.2 / (f2 + 1.2 * (0.25 + 0.75 * len / av))
+ ln(1 + (n - d3 + 0.5) / (d3 + 0.5)) * f3 * 2.2 / (f3 + 1.2 * (0.25 + 0.75 * len / av)), 6) AS score
FROM f, s WHERE f1 > 0 OR f2 > 0 OR f3 > 0 ORDER BY 2 DESC, 1 LIMIT 10""")
def bm25_topk(spark, d):
    hits = search_index.search(spark, index(spark, d), StructuredQuery(keywords=("license", "Apache", "version")), 10, _TEXT)
    return hits.select("id", F.round("score", 6).alias("score"))


@query("""WITH {reg}, col AS (SELECT id, unnest([struct_pack(w := 10.0, x := title), struct_pack(w := 6.0, x := array_to_string(tags, ' ')), struct_pack(w := 2.0, x := category), struct_pack(w := 2.0, x := subcategory),
struct_pack(w := 1.0, x := filename), struct_pack(w := 0.5, x := raw_text)]) AS c FROM reg),
tok AS (SELECT id, CAST(c.w AS DOUBLE) AS w, regexp_extract_all(lower(coalesce(c.x, '')), '[\\p{L}\\p{N}]+') AS r FROM col),
f AS (SELECT id, sum(len(r)) AS len, sum(w * len(list_filter(r, lambda x: x = 'license'))) AS f1, sum(w * len(list_filter(r, lambda x: x = 'apache'))) AS f2, sum(w * len(list_filter(r, lambda x: x = 'src1'))) AS f3 FROM tok GROUP BY id),
s AS (SELECT count(*) AS n, avg(len) AS av, count(*) FILTER (f1 > 0) AS d1, count(*) FILTER (f2 > 0) AS d2, count(*) FILTER (f3 > 0) AS d3 FROM f)
SELECT id, round(ln(1 + (n - d1 + 0.5) / (d1 + 0.5)) * f1 * 2.2 / (f1 + 1.2 * (0.25 + 0.75 * len / av)) + ln(1 + (n - d2 + 0.5) / (d2 + 0.5)) * f2 * 2.2 / (f2 + 1.2 * (0.25 + 0.75 * len / av))
+ ln(1 + (n - d3 + 0.5) / (d3 + 0.5)) * f3 * 2.2 / (f3 + 1.2 * (0.25 + 0.75 * len / av)), 6) AS score
FROM f, s WHERE f1 > 0 OR f2 > 0 OR f3 > 0 ORDER BY 2 DESC, 1 LIMIT 10""")
def bm25_columns_topk(spark, d):
    """Over all indexed columns of the registry by their weights; ``bm25_topk`` reads the texts alone."""
    hits = search_index.search(spark, index(spark, d), StructuredQuery(keywords=("license", "Apache", "src1")), 10)
    return hits.select("id", F.round("score", 6).alias("score"))


@query("""WITH {reg}, tok AS (SELECT id, regexp_extract_all(lower(raw_text), '[\\p{L}\\p{N}]+') AS r FROM reg)
SELECT id FROM tok WHERE (list_contains(r, 'license') OR list_contains(r, 'rights')) AND list_contains(r, 'the') ORDER BY id""")
def fts_facets(spark, d):
    q = StructuredQuery(doc_types=("license", "rights"), keywords=("the",))
    return search_index.search(spark, index(spark, d), q, None, _TEXT).select("id")


@query("""WITH {reg}, tok AS (SELECT id, regexp_extract_all(lower(raw_text), '[\\p{L}\\p{N}]+') AS r FROM reg)
SELECT id FROM tok WHERE list_contains(r, 'license') AND NOT list_contains(r, 'apache') ORDER BY id""")
def fts_not(spark, d):
    q = StructuredQuery(keywords=("license",), not_terms=("apache",))
    return search_index.search(spark, index(spark, d), q, None, _TEXT).select("id")


@query("""WITH {reg} SELECT id FROM reg WHERE regexp_matches(lower(raw_text), '(^|[^\\p{L}\\p{N}])all[^\\p{L}\\p{N}]+rights[^\\p{L}\\p{N}]+reserved($|[^\\p{L}\\p{N}])')""")
def fts_phrase(spark, d):
    q = StructuredQuery(keywords=("all rights reserved",))
    return search_index.search(spark, index(spark, d), q, None, _TEXT).select("id")


@query("""WITH {reg}, tok AS (SELECT id, regexp_extract_all(lower(raw_text), '[\\p{L}\\p{N}]+') AS r FROM reg),
l AS (SELECT id, CASE WHEN list_contains(r, 'license') AND list_contains(r, 'apache') AND list_contains(r, 'zebrawood') AND NOT list_contains(r, 'version') THEN 0
WHEN list_contains(r, 'license') AND list_contains(r, 'apache') AND NOT list_contains(r, 'version') THEN 1 WHEN list_contains(r, 'license') AND list_contains(r, 'apache') THEN 2 WHEN list_contains(r, 'license') THEN 3 END AS rung FROM tok)
SELECT id, rung FROM l WHERE rung = (SELECT min(rung) FROM l)""")
def relax_ladder(spark, d):
    q = StructuredQuery(doc_types=("license",), entities=("apache",), keywords=("zebrawood",), not_terms=("version",))
    return search_index.search(spark, index(spark, d), q, None, _TEXT, relax=True).select("id", "rung")


@query("""WITH {reg}, s AS (SELECT id, date, (CASE WHEN contains(x, 'apache') THEN 1 ELSE 0 END) + (CASE WHEN contains(x, 'license') THEN 1 ELSE 0 END) + (CASE WHEN contains(x, 'reserved') THEN 1 ELSE 0 END) AS score
FROM (SELECT id, date, lower(title || ' ' || category || ' ' || subcategory || ' ' || array_to_string(tags, ' ') || ' ' || raw_text) AS x FROM reg))
SELECT id, score FROM (SELECT * FROM s WHERE score > 0 ORDER BY score DESC, date DESC, id LIMIT 10)""")
def token_scorer(spark, d):
    return retrieval.token_score(load(spark, d), "find the Apache license, reserved")


@query("WITH {reg} SELECT max(id) AS id FROM reg WHERE id % 11 <> 0 GROUP BY substr(date, 1, 7) UNION ALL SELECT id FROM reg WHERE id % 11 = 0")
def period_dedupe(spark, d):
    docs = load(spark, d).withColumn("date", F.when(F.col("id") % 11 == 0, "").otherwise(F.col("date")))
    return retrieval.dedupe_by_period(docs).select("id")


@query("""WITH {reg}, h AS (SELECT id, row_number() OVER (ORDER BY id) AS rank, (id * 37 % 100) / 100.0 AS relevance FROM (SELECT id FROM reg ORDER BY id LIMIT 30))
SELECT id FROM (SELECT * FROM h WHERE relevance >= 0.15 ORDER BY relevance DESC, rank LIMIT 10)""")
def rerank_threshold(spark, d):
    first = load(spark, d).select("id").orderBy("id").limit(retrieval.over_fetch(10))
    hits = first.withColumn("rank", F.row_number().over(Window.orderBy("id")))  # at most over_fetch(10) rows
    score = lambda h: h.withColumn("relevance", F.col("id") * 37 % 100 / 100.0)
    return retrieval.rerank(hits, 10, reranker=score).select("id")


@query("""WITH t AS (SELECT doc_id AS id, lang AS query, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS rank FROM documents), r AS (SELECT * FROM t WHERE rank <= 10),
e AS (SELECT lang AS query, doc_id AS id FROM documents WHERE doc_id % 3 = 0), w AS (SELECT query, count(*) AS wanted FROM e GROUP BY 1),
g AS (SELECT r.query, count(*) AS got, count(e.id) AS hits, min(CASE WHEN e.id IS NOT NULL THEN rank END) AS f FROM r LEFT JOIN e ON r.query = e.query AND r.id = e.id GROUP BY 1)
SELECT w.query, round(hits / got, 6) AS precision, round(hits / wanted, 6) AS recall, round(1 / f, 6) AS reciprocal_rank FROM w JOIN g ON w.query = g.query""")
def eval_metrics(spark, d):
    docs = table(spark, d, "documents").select(F.col("lang").alias("query"), F.col("doc_id").alias("id"))
    rank = F.row_number().over(Window.partitionBy("query").orderBy("id"))
    out = retrieval.evaluate(docs.withColumn("rank", rank).where("rank <= 10"), docs.where("id % 3 = 0"))
    return out.select("query", *(F.round(c, 6).alias(c) for c in ("precision", "recall", "reciprocal_rank")))


@query("""WITH {reg} SELECT term, count(DISTINCT id) AS df, count(*) AS cf FROM (SELECT id, unnest(regexp_extract_all(lower(raw_text), '[\\p{L}\\p{N}]+')) AS term FROM reg) WHERE term IN ('license', 'apache', 'rights', 'the') GROUP BY term""")
def term_statistics(spark, d):
    return search_index.term_statistics(spark, index(spark, d), ["license", "apache", "rights", "the"], ("raw_text",))


# -- quality --------------------------------------------------------------------------------------


@query("""WITH w AS (SELECT doc_id AS id, list_filter(list_distinct(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+')), lambda x: length(x) >= 4) AS a,
list_filter(list_distinct(regexp_extract_all(lower(replace(text, 'th', '')), '[\\p{L}\\p{N}]+')), lambda x: length(x) >= 4) AS b FROM documents)
SELECT id, round(CASE WHEN len(a) > 0 THEN len(list_intersect(a, b)) / len(a) END, 6) AS recall FROM w""")
def content_recall(spark, d):
    """Of whole texts, as a converter that loses a pair of letters would leave them."""
    lossy = F.replace("raw_text", F.lit("th"), F.lit(""))
    return load(spark, d).select("id", F.round(markdown.content_recall(F.col("raw_text"), lossy), 6).alias("recall"))


@query("""WITH c AS (SELECT doc_id AS id, text, regexp_replace(regexp_replace(text, '^\\s+', ''), '\\s+$', '') AS bare FROM documents),
w AS (SELECT id, list_filter(list_distinct(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+')), lambda x: length(x) >= 4) AS a,
list_filter(list_distinct(regexp_extract_all(lower(CASE WHEN length(bare) < 10 THEN '' ELSE replace(bare, chr(0), '') END), '[\\p{L}\\p{N}]+')), lambda x: length(x) >= 4) AS b FROM c)
SELECT id, round(CASE WHEN len(a) > 0 THEN len(list_intersect(a, b)) / len(a) END, 6) AS recall FROM w""")
def content_recall_clean(spark, d):
    """Of whole texts, as ``clean_text`` leaves them."""
    return load(spark, d).select("id", F.round(markdown.content_recall(F.col("raw_text"), text.clean_text(F.col("raw_text"))), 6).alias("recall"))


@query("""WITH w AS (SELECT doc_id AS id, list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '') AS w FROM documents)
SELECT id, round(CASE WHEN len(w) > 0 THEN list_sum(list_transform(w, lambda x: length(x))) / len(w) END, 6) AS mean_length, round(CASE WHEN len(w) > 0 THEN len(list_filter(w, lambda x: length(x) >= 15)) / len(w) END, 6) AS long_share,
round(CASE WHEN len(w) > 0 THEN len(list_filter(w, lambda x: regexp_matches(x, '\\p{Ll}\\p{Lu}'))) / len(w) END, 6) AS seam_share FROM w""")
def fusion_flags(spark, d):
    f = markdown.fusion(F.col("raw_text"))
    return load(spark, d).withColumn("f", f).select("id", *(F.round(f"f.{c}", 6).alias(c) for c in ("mean_length", "long_share", "seam_share")))


@query("""WITH p AS (SELECT doc_id AS id, text, 2 + doc_id % 3 AS pages, list_distinct(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+')) AS w,
list_distinct(list_filter(list_transform(regexp_split_to_array(text, '\\r?\\n'), lambda x: regexp_replace(regexp_replace(x, '^\\s+', ''), '\\s+$', '')), lambda x: x <> '')) AS l FROM documents)
SELECT id FROM p WHERE (length(regexp_replace(regexp_replace(text, '^\\s+', ''), '\\s+$', '')) / pages < 100 AND len(w) / pages < 10) OR (len(l) <= 2 AND coalesce(list_sum(list_transform(l, lambda x: length(x))), 0) <= 200)""")
def thin_text(spark, d):
    return load(spark, d).where(markdown.is_thin(F.col("raw_text"), 2 + F.col("id") % 3)).select("id")


@query("""WITH RECURSIVE l AS (SELECT doc_id AS id, i, ls[i] AS line, regexp_matches(ls[i], '^\\s*\\|.*\\|\\s*$') AS pipe, regexp_matches(ls[i], '^\\s*\\|(?:\\s*:?-+:?\\s*\\|)+\\s*$') AS rule, len(string_split(ls[i], '|')) - 2 AS n
FROM (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS i FROM (SELECT doc_id, regexp_split_to_array('| a | b |' || chr(10) || '| --- | --- |' || chr(10) || '| x |' || chr(10) || lang || chr(10) || '| h |' || chr(10) || text, '\\r?\\n') AS ls FROM documents))),
b AS (SELECT *, sum(CASE WHEN pipe AND NOT coalesce(prev, false) THEN 1 ELSE 0 END) OVER (PARTITION BY id ORDER BY i) AS block FROM (SELECT *, lag(pipe) OVER (PARTITION BY id ORDER BY i) AS prev FROM l)),
r AS (SELECT *, row_number() OVER (PARTITION BY id, block ORDER BY i) AS pos, first_value(n) OVER (PARTITION BY id, block ORDER BY i) AS width, lead(rule) OVER (PARTITION BY id ORDER BY i) AS next_rule FROM b)
SELECT id, CAST(count(*) FILTER (pipe AND pos = 1) AS INTEGER) AS blocks, CAST(count(*) FILTER (pipe AND NOT rule) AS INTEGER) AS rows, CAST(count(*) FILTER (pipe AND pos > 1 AND NOT rule AND n <> width) AS INTEGER) AS ragged,
CAST(count(*) FILTER (pipe AND pos = 1 AND NOT coalesce(next_rule, false)) AS INTEGER) AS headerless, CAST(count(*) FILTER (pipe AND pos = 1 AND n >= 14) AS INTEGER) AS wide FROM r GROUP BY id""")
def table_audit(spark, d):
    body = F.concat(F.lit("| a | b |\n| --- | --- |\n| x |\n"), F.col("subcategory"), F.lit("\n| h |\n"), F.col("raw_text"))
    return load(spark, d).select("id", markdown.table_audit(body).alias("a")).select("id", "a.*")


# -- reconciliation and mutations -----------------------------------------------------------------


@query("WITH {reg} SELECT id, path FROM reg WHERE id % 4 = 0")
def ghost_rows(spark, d):
    docs = load(spark, d)
    return ops.ghosts(docs, docs.where("id % 4 <> 0").select("path")).select("id", "path")


@query("WITH {reg} SELECT path FROM reg WHERE id % 5 = 0")
def orphan_files(spark, d):
    docs = load(spark, d)
    return ops.orphans(docs.select("path"), docs.where("id % 5 <> 0")).select("path")


@query("""WITH {reg}, f AS (SELECT path AS p FROM reg WHERE id % 4 = 1 UNION ALL SELECT '/input/' || filename FROM reg WHERE id % 4 = 2 UNION ALL SELECT upper('/archive/other/' || filename) FROM reg WHERE id % 4 = 3)
SELECT id, CASE id % 4 WHEN 1 THEN path WHEN 2 THEN '/input/' || filename WHEN 3 THEN upper('/archive/other/' || filename) END AS found_path FROM reg""")
def locate_files(spark, d):
    docs = load(spark, d).withColumn("new_path", F.lit("/none").substr(1, 5)).withColumn("original_path", F.col("path"))
    name = F.col("filename")
    at = F.when(F.col("id") % 4 == 1, F.col("path")).when(F.col("id") % 4 == 2, F.concat(F.lit("/input/"), name)).when(F.col("id") % 4 == 3, F.upper(F.concat(F.lit("/archive/other/"), name)))
    files = docs.select(at.alias("path")).where("path is not null")
    return ops.locate(docs, files).select("id", "found_path")


@query("""WITH {reg}, f AS (SELECT id AS fid, checksum, CASE WHEN id % 2 = 0 THEN path ELSE '/moved' || path END AS path FROM reg), k AS (SELECT checksum, min(id) AS id, arg_min(path, id) AS known FROM reg WHERE id % 7 <> 0 GROUP BY 1)
SELECT CASE WHEN k.id IS NULL THEN 'repaired' WHEN f.path = known THEN 'unchanged' ELSE 'updated' END AS action, count(*) AS n FROM f LEFT JOIN k ON f.checksum = k.checksum GROUP BY 1""")
def repair_actions(spark, d):
    docs = load(spark, d)
    files = docs.select("checksum", F.when(F.col("id") % 2 == 0, F.col("path")).otherwise(F.concat(F.lit("/moved"), "path")).alias("path"))
    return ops.repair(files, docs.where("id % 7 <> 0")).groupBy("action").agg(F.count(F.lit(1)).alias("n"))


@query("WITH {reg} SELECT id, CASE WHEN id % 3 = 0 THEN 'New ' || CAST(id AS VARCHAR) ELSE title END AS title, CASE WHEN id % 3 = 0 AND id % 2 = 0 THEN 'moved' ELSE category END AS category FROM reg")
def patch_update(spark, d):
    docs = load(spark, d).select("id", "title", "category")
    patches = docs.where("id % 3 = 0").select("id", F.concat(F.lit("New "), F.col("id").cast("string")).alias("titre"), F.when(F.col("id") % 2 == 0, "moved").alias("categorie"))
    return ops.patch(docs, patches, aliases={"titre": "title", "categorie": "category"})


_BLOCKED_SQL = "SELECT '/raw/' || user_id AS path, value AS mtime, event_id, ts FROM events"


@query(f"SELECT path, event_id FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY ts DESC, event_id DESC) AS rn FROM ({_BLOCKED_SQL})) WHERE rn = 1")
def blocked_upsert(spark, d):
    rows = table(spark, d, "events").select(F.concat(F.lit("/raw/"), F.col("user_id").cast("string")).alias("path"), "event_id", F.struct("ts", "event_id").alias("at"))
    return ops.upsert(rows.where("event_id % 2 = 0"), rows.where("event_id % 2 = 1"), "path", "at").select("path", "event_id")


@query("WITH b AS (SELECT DISTINCT user_id FROM events) SELECT '/raw/' || user_id AS original_path FROM b WHERE user_id % 3 <> 0")
def blocked_prune(spark, d):
    users = table(spark, d, "events").select("user_id").distinct()
    blocked = users.select(F.concat(F.lit("/raw/"), F.col("user_id").cast("string")).alias("original_path"))
    files = users.where("user_id % 3 <> 0").select(F.concat(F.lit("/raw/"), F.col("user_id").cast("string")).alias("path"))
    return ops.prune(blocked, files)


@query("SELECT o_orderkey AS id, o_orderkey % 3 <> 0 AND o_orderkey % 5 <> 0 AS skip FROM orders")
def skip_cache(spark, d):
    return _skipped(table(spark, d, "orders"))


@query("SELECT o_orderkey AS id, o_orderkey % 3 <> 0 AND o_orderkey % 5 <> 0 AS skip FROM orders")
def skip_cache_all(spark, d):
    """The cache holds every path twice; its newest entry counts."""
    orders = table(spark, d, "orders")
    return _skipped(orders, orders.withColumn("o_totalprice", F.col("o_totalprice") - 1))


def _skipped(orders: DataFrame, older: DataFrame | None = None) -> DataFrame:
    name = F.concat(F.lit("/raw/"), F.col("o_orderkey").cast("string"))
    files = orders.select(F.col("o_orderkey").alias("id"), name.alias("path"), F.col("o_totalprice").alias("mtime_ms"), F.col("o_custkey").alias("size"))
    mtime = F.when(F.col("o_orderkey") % 5 == 0, F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice"))
    cached = orders if older is None else orders.unionByName(older)
    blocked = cached.where("o_orderkey % 3 <> 0").select(name.alias("original_path"), mtime.alias("mtime_ms"), F.col("o_custkey").alias("size"))
    return ops.skip_or_retry(files, blocked).select("id", "skip")


@query("SELECT count(*) AS total, count(*) FILTER (o_orderstatus = 'O') AS O, count(*) FILTER (o_orderstatus = 'F') AS F, count(*) FILTER (o_orderstatus = 'P') AS P FROM orders")
def scan_counters(spark, d):
    return ops.outcome_counts(table(spark, d, "orders"), ["O", "F", "P"], "o_orderstatus")


# -- activity -------------------------------------------------------------------------------------


@query("SELECT event_id AS id, ts AS created_at FROM events WHERE user_id % 4 <> 0 ORDER BY ts DESC, event_id DESC LIMIT 25")
def newest_n_rules(spark, d):
    rows = table(spark, d, "events").select(F.col("event_id").alias("id"), F.col("ts").alias("created_at"), F.when(F.col("user_id") % 4 == 0, 0).otherwise(1).alias("enabled"))
    return ops.newest_decisions(rows).select("id", "created_at")


@query("SELECT user_id AS filename, count(*) AS entries, max(ts) AS updated_at, arg_max(event_type, (ts, event_id)) AS status FROM events GROUP BY 1")
def log_sessions(spark, d):
    return ops.log_sessions(table(spark, d, "events").select(F.col("user_id").alias("filename"), "ts", "event_id", F.col("event_type").alias("status")))


@query("SELECT event_id, ts FROM events ORDER BY ts DESC, event_id DESC LIMIT 300")
def recent_logs(spark, d):
    return ops.recent(table(spark, d, "events")).select("event_id", "ts")


@query("SELECT lower(regexp_extract(filename, '\\.([A-Za-z0-9]+)$', 1)) AS ext, count(*) AS files, CAST(sum(size) AS BIGINT) AS bytes FROM (SELECT 'doc_' || doc_id || CASE doc_id % 4 WHEN 0 THEN '.PDF' WHEN 1 THEN '.png' WHEN 2 THEN '.docx' ELSE '' END AS filename, n_chars AS size FROM documents) GROUP BY 1")
def format_breakdown(spark, d):
    kind = F.when(F.col("id") % 4 == 0, ".PDF").when(F.col("id") % 4 == 1, ".png").when(F.col("id") % 4 == 2, ".docx").otherwise("")
    return ops.format_breakdown(load(spark, d).select(F.concat(F.lit("doc_"), F.col("id").cast("string"), kind).alias("filename"), "size"))


@query("SELECT conv_id, turn, role FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS rn FROM conversations) WHERE rn <= 6")
def chat_last_n(spark, d):
    return ops.last_turns(table(spark, d, "conversations")).select("conv_id", "turn", "role")


@query("SELECT user_id AS task, arg_max(event_type, (ts, event_id)) AS state, max(ts) AS ts FROM events GROUP BY 1")
def task_state_last(spark, d):
    return ops.last_states(table(spark, d, "events").select(F.col("user_id").alias("task"), F.col("event_type").alias("state"), "ts", "event_id"))


@query("""WITH RECURSIVE e AS (SELECT user_id AS key, epoch_us(ts) AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
f AS (SELECT key, t, i, t AS shown FROM e WHERE i = 1 UNION ALL SELECT e.key, e.t, e.i, CASE WHEN e.t - f.shown >= 3600000000 THEN e.t ELSE f.shown END FROM f JOIN e ON e.key = f.key AND e.i = f.i + 1)
SELECT DISTINCT key, shown AS shown_us FROM f""")
def message_suppression(spark, d):
    shown = ops.suppressed(table(spark, d, "events").select(F.col("user_id").alias("key"), "ts"), 3600)
    return shown.select("key", F.unix_micros("ts").alias("shown_us"))


@query("SELECT folder, count(*) FILTER (img) AS images, count(*) AS files FROM (SELECT '/in/' || (doc_id % 50) AS folder, doc_id % 50 < 20 OR doc_id % 3 = 0 AS img FROM documents) GROUP BY 1 HAVING count(*) FILTER (img) >= 2 AND bool_and(img)")
def image_bundles(spark, d):
    img = (F.col("id") % 50 < 20) | (F.col("id") % 3 == 0)
    path = F.concat(F.lit("/in/"), (F.col("id") % 50).cast("string"), F.lit("/"), F.col("id").cast("string"), F.when(img, ".png").otherwise(".pdf"))
    return ops.image_bundles(load(spark, d).select(path.alias("path")))


# -- functions ------------------------------------------------------------------------------------


@query("SELECT c_custkey AS id, trim(regexp_replace(lower(trim(c_name)), '[^a-z0-9_-]+', '_', 'g'), '_') AS slug FROM customer")
def slug_normalize(spark, d):
    return table(spark, d, "customer").select(F.col("c_custkey").alias("id"), text.normalize_slug(F.col("c_name")).alias("slug"))


@query("""SELECT id, regexp_replace(CAST(round(b / s, 2) AS VARCHAR), '\\.0$', '') || ' ' || u AS size FROM (SELECT id, b, CASE WHEN b >= 1073741824 THEN 1073741824.0 WHEN b >= 1048576 THEN 1048576.0 WHEN b >= 1024 THEN 1024.0 ELSE 1.0 END AS s,
CASE WHEN b >= 1073741824 THEN 'GB' WHEN b >= 1048576 THEN 'MB' WHEN b >= 1024 THEN 'KB' ELSE 'B' END AS u FROM (SELECT c_custkey AS id, CAST(c_custkey AS BIGINT) * c_custkey * 977 AS b FROM customer))""")
def byte_units(spark, d):
    size = dates.format_bytes(F.col("c_custkey").cast("long") * F.col("c_custkey") * 977)
    return table(spark, d, "customer").select(F.col("c_custkey").alias("id"), size.alias("size"))


@query("""SELECT o_orderkey AS id, strftime(o_orderdate, '%Y-%m-%d') AS date FROM orders""")
def date_extraction(spark, d):
    old = F.year("o_orderdate") < 2000  # only years from 2000 on are dates of documents: older ones are read a century later
    at = F.when(old, F.add_months("o_orderdate", 1200)).otherwise(F.to_date("o_orderdate"))
    shapes = F.when(F.col("o_orderkey") % 3 == 0, F.date_format(at, "yyyyMMdd")).when(F.col("o_orderkey") % 3 == 1, F.date_format(at, "yyyy/MM/dd")).otherwise(F.date_format(at, "dd/MM/yyyy"))
    found = dates.extract_date(F.concat(F.lit("facture du "), shapes, F.lit(" payée")), now())
    back = F.date_format(F.add_months(dates.parse_date(found), -1200), "yyyy-MM-dd")
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.when(old, back).otherwise(found).alias("date"))


@query("""SELECT l_orderkey, l_linenumber, round(CASE WHEN u > 0 THEN i / u ELSE 0 END, 6) AS iou FROM (SELECT l_orderkey, l_linenumber, i, l_quantity * 10 + l_quantity * 10 - i AS u FROM (
SELECT l_orderkey, l_linenumber, l_quantity, greatest(0, least(l_quantity, l_tax * 100 + l_quantity) - greatest(0, l_tax * 100)) * greatest(0, least(10, l_discount * 100 + 10) - greatest(0, l_discount * 100)) AS i FROM lineitem))""")
def box_overlap(spark, d):
    box = lambda x, y: F.struct(x.alias("x"), y.alias("y"), F.col("l_quantity").alias("width"), F.lit(10.0).alias("height"))
    overlap = geometry.iou(box(F.lit(0.0), F.lit(0.0)), box(F.col("l_tax") * 100, F.col("l_discount") * 100))
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.round(overlap, 6).alias("iou"))


@query("WITH {reg} SELECT id, checksum, json_extract_string(to_json({'id': id, 'title': title}), '$.title') AS title FROM reg")
def registry_json(spark, d):
    docs = load(spark, d).select("id", "checksum", "title")
    rows = ops.registry_json(docs)
    return rows.select("id", F.get_json_object("json", "$.checksum").alias("checksum"), F.get_json_object("json", "$.title").alias("title"))


@query("WITH {reg} SELECT id, filename AS target, id IS NOT NULL AS present FROM reg WHERE id % 10 = 0 UNION ALL SELECT -1, NULL, false")
def package_documents(spark, d):
    docs = load(spark, d)
    wanted = docs.where("id % 10 = 0").select("id").unionByName(spark.createDataFrame([(-1,)], "id long"))
    found, missing = ops.package(docs, wanted)
    return found.select("id", "target", F.lit(True).alias("present")).unionByName(missing.select("id", F.lit(None).cast("string").alias("target"), F.lit(False).alias("present")))


# -- without SQL: order inside a string, streams --------------------------------------------------


@query()
def chunked_text(spark, d):
    """Chunks of whole texts: count, longest, and whether they hold all that is not white space."""
    docs = load(spark, d).select("id", "raw_text", markdown.chunk_text(F.col("raw_text")).alias("chunks"))
    bare = lambda c: F.regexp_replace(c, r"\s+", "")
    return docs.select(
        "id", F.size("chunks").alias("n"), F.array_max(F.transform("chunks", F.length)).alias("longest"), (bare(F.array_join("chunks", "")) == bare(F.col("raw_text"))).alias("whole")
    )


@query("""WITH {reg}, t AS (SELECT length(regexp_replace(regexp_replace(raw_text, '^\\s+', ''), '\\s+$', '')) < 10 AS blocked, row_number() OVER (PARTITION BY checksum ORDER BY path, id) AS rn FROM reg)
SELECT CASE WHEN blocked THEN 'BLOCKED' WHEN rn > 1 THEN 'DUPLICATE' ELSE 'MOVED' END AS status, count(*) AS n FROM t GROUP BY 1""")
def stream_ingest(spark, d):
    """The documents as a stream of files into a fresh registry; then how many events had each status."""
    source = f"{d}/documents.parque[t]"  # a pattern, since a stream takes no single file
    stream = registry(spark.readStream.schema(table(spark, d, "documents").schema).parquet(source)).select("id", "path", "filename", "raw_text")
    base = scratch_folder(spark, "stream")
    ingest(stream, f"{base}/registry", f"{base}/events", f"{base}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{base}/events").where("id is not null").groupBy("status").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT event_type, time_bucket(INTERVAL 1 DAY, ts) AS day, count(*) AS n FROM events GROUP BY 1, 2")
def event_windows(spark, d):
    """Extra: events by type and day."""
    window = F.window("ts", "1 day")
    return table(spark, d, "events").groupBy("event_type", window["start"].alias("day")).agg(F.count(F.lit(1)).alias("n"))
