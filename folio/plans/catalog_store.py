"""Registered queries over stored registries: scans, commits and their changes, taxonomies in versions, free names."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import functions as F

from folio.functions import geometry, markdown, paths
from folio.operators import registry_ops as ops
from folio.operators import registry_store as store
from folio.operators import rules
from folio.plans.catalog import SQL, load, now, query, table, worked
from folio.plans.query import StructuredQuery
from folio.session import scratch_folder
from folio.sources import archive, files, versions
from folio.streaming import ingest as streams
from folio.streaming import live_log
from folio.streaming.ordered import suppressed_stream, task_history_stream

#: a text without ten letters between its outer white space is blocked
_BLOCKED = r"length(regexp_replace(regexp_replace(raw_text, '^\s+', ''), '\s+$', '')) < 10"


@query(f"""WITH {{reg}}, a AS (SELECT id, checksum, path, {_BLOCKED} AS blocked FROM reg WHERE id % 2 = 0),
first AS (SELECT id, checksum, CASE WHEN blocked THEN 'BLOCKED' WHEN row_number() OVER (PARTITION BY checksum ORDER BY path, id) > 1 THEN 'DUPLICATE' ELSE 'MOVED' END AS status FROM a),
b AS (SELECT id, checksum, {_BLOCKED} AS blocked, row_number() OVER (PARTITION BY checksum ORDER BY path, id) AS rn FROM reg),
second AS (SELECT id, checksum, CASE WHEN blocked THEN 'BLOCKED' WHEN rn > 1 OR checksum IN (SELECT checksum FROM first WHERE status = 'MOVED') THEN 'DUPLICATE' ELSE 'MOVED' END AS status FROM b)
SELECT 'first' AS scan, id, status FROM first UNION ALL SELECT 'second', id, status FROM second
UNION ALL SELECT 'registry', id, NULL FROM (SELECT id FROM first WHERE status = 'MOVED' UNION ALL SELECT id FROM second WHERE status = 'MOVED')""")
def rescanned_registry(spark, d):
    """Half of the documents, then all of them by another stream with its own checkpoint: what each file became, and what the registry holds."""
    base = scratch_folder(spark, "rescan")
    docs = load(spark, d).select("id", "path", "filename", "raw_text")
    parts = []
    for scan, rows in (("first", docs.where("id % 2 = 0")), ("second", docs)):
        rows.write.parquet(f"{base}/{scan}")
        source = spark.readStream.schema(docs.schema).parquet(f"{base}/{scan}")
        streams.ingest(source, f"{base}/registry", f"{base}/events-{scan}", f"{base}/check-{scan}").awaitTermination()
        told = spark.read.parquet(f"{base}/events-{scan}").where("id is not null")
        parts.append(told.select(F.lit(scan).alias("scan"), "id", "status"))
    kept = streams.registry_rows(spark, f"{base}/registry", "id long")
    return parts[0].union(parts[1]).union(kept.select(F.lit("registry"), "id", F.lit(None).cast("string")))


_STORED = "id long, checksum string, title string, category string, subcategory string"


@query("""WITH {reg}, k AS (SELECT id, category, subcategory, title FROM reg), m AS (SELECT DISTINCT category FROM k WHERE subcategory = 'de' AND id % 3 = 1),
c AS (SELECT id, CASE WHEN id % 3 = 2 THEN 'insert' WHEN id % 21 = 0 THEN 'delete'
WHEN (id % 3 = 1 AND id % 5 = 0 AND coalesce(title, '') <> 'patched') OR (subcategory = 'de' AND category IN (SELECT category FROM m)) THEN 'update' END AS change FROM k)
SELECT CASE change WHEN 'update' THEN 'REGISTRY_UPDATED' ELSE 'DOCUMENTS_UPDATED' END AS type, change, CAST(id AS VARCHAR) AS key FROM c WHERE change IS NOT NULL""")
def registry_events(spark, d):
    """Rows inserted, patched, deleted and renamed in a stored registry, each as a commit; the events follow from the versions."""
    path = scratch_folder(spark, "store")
    checksum = F.when(F.col("id") % 10 < 8, F.concat_ws("-", F.col("id").cast("string"), "checksum"))
    docs = load(spark, d).select("id", checksum.alias("checksum"), "title", "category", "subcategory")
    began = store.insert(docs.where("id % 3 <> 2"), path, _STORED)
    store.insert(docs.where("id % 3 = 2 or checksum is not null"), path, _STORED)  # those with a checksum are there already
    store.delete(docs.where("id % 3 = 0 and id % 7 = 0").select("id"), path, _STORED)
    store.patch(docs.where("id % 3 = 1 and id % 5 = 0").select("id", F.lit("patched").alias("title")), path, _STORED)
    mapping = docs.where("subcategory = 'de' and id % 3 = 1").select("category", F.lit("DE").alias("old"), F.lit("deutsch").alias("new")).distinct()
    store.rename_subcategory(mapping, path, _STORED)
    return store.events_between(spark, path, _STORED, began.version)


@query("""WITH {reg}, p AS (SELECT category, id, path, 'entry' || lower(regexp_replace(title[1:6], '[^A-Za-z]+', '', 'g')) AS slug FROM reg),
e AS (SELECT category || '/' || slug AS entry, bool_or(id % 2 = 0) AS early FROM p GROUP BY 1)
SELECT entry, CASE WHEN early THEN NULL ELSE 'CATEGORIES_UPDATED' END AS told FROM e""")
def auto_created_entries(spark, d):
    """Entries that two batches propose, in the taxonomy that they lead to; those of the second are told as changes."""
    path = scratch_folder(spark, "taxonomy")
    slug = F.concat(F.lit("entry"), F.lower(F.regexp_replace(F.substring("title", 1, 6), "[^A-Za-z]+", "")))
    rows = load(spark, d).select("id", "category", slug.alias("subcategory"), "path")
    first = store.add_entries(rows.where("id % 2 = 0"), path)
    store.add_entries(rows, path)
    told = store.events_between(spark, path, store.TAXONOMY, first.version, kinds=store.TAXONOMY_EVENTS, key="entry")
    entries = versions.rows_of(spark, path, store.TAXONOMY).select("entry")
    return entries.join(told.select(F.col("key").alias("entry"), F.col("type").alias("told")), "entry", "left")


@query("""WITH n AS (SELECT doc_id AS id, CASE WHEN doc_id % 4 = 0 THEN source || '_dup' || (doc_id % 50) ELSE source END || '.pdf' AS name FROM documents)
SELECT count(*) AS files, count(*) AS names, 0 AS occupied, count(DISTINCT lower(name)) AS kept, 0 AS odd FROM n WHERE lower(name) <> 'src1.pdf'
UNION ALL SELECT (SELECT count(*) FROM n WHERE name = 'src1.pdf'), (SELECT count(*) FROM n WHERE name = 'src1.pdf'), 0, 0, 0""")
def free_names(spark, d):
    """Names that clash with each other, with names that look numbered and with files that are there: all unique, none occupied."""
    name = F.concat(F.when(F.col("id") % 4 == 0, F.concat("category", F.lit("_dup"), (F.col("id") % 50).cast("string"))).otherwise(F.col("category")), F.lit(".pdf"))
    docs = load(spark, d).select("id", name.alias("filename"))
    there = docs.where("id % 9 = 0 and id % 4 <> 0").select(F.concat(F.lit("SRC1_DUP"), (F.col("id") + 51).cast("string"), F.lit(".PDF")).alias("name"))
    there = there.union(spark.createDataFrame([("src1.pdf",)], "name string"))
    out = ops.free_names(docs, "filename", "id", there)
    low = F.lower("target")
    joined = out.join(there.select(F.lower("name").alias("__t")).distinct(), low == F.col("__t"), "left")
    ours = F.lower("filename") == "src1.pdf"
    return joined.groupBy(ours.alias("__ours")).agg(
        F.count(F.lit(1)).alias("files"), F.count_distinct(low).alias("names"), F.count("__t").alias("occupied"), F.count_if(F.col("target") == F.col("filename")).alias("kept"),
        F.count_if(~low.rlike(r"^.*(_dup[1-9][0-9]*)?\.pdf$")).alias("odd"),
    ).drop("__ours")


# -- streams --------------------------------------------------------------------------------------


def _replayed(spark, rows, name, run, files=4):
    """``run(stream, base)`` over the rows as a stream: a run and a batch each for parts in order of time, in any order inside; a row from far ahead ends them.

    A part is written by as many tasks as read the rows.
    """
    base = scratch_folder(spark, name)
    span = rows.agg(F.min("ts").alias("a"), F.max("ts").alias("b"))
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    part = F.least(F.floor((micros("ts") - micros("a")) * files / (micros("b") - micros("a") + 1)), F.lit(files - 1))
    dealt = rows.crossJoin(F.broadcast(span)).withColumn("part", part).drop("a", "b")  # one row
    ahead = rows.limit(1).withColumn("ts", F.make_timestamp(*map(F.lit, (2100, 1, 1, 0, 0, 0)))).withColumn(rows.columns[0], F.lit(-1).cast(dict(rows.dtypes)[rows.columns[0]]))
    for one in (*(dealt.where(F.col("part") == k).drop("part") for k in range(files)), ahead.coalesce(1)):
        one.write.mode("append").parquet(f"{base}/in")
        run(spark.readStream.schema(rows.schema).parquet(f"{base}/in"), base)
    return base


def _told(spark, rows, name, stateful):
    """What ``stateful`` makes of the rows as a stream."""
    schemas = []

    def run(stream, base):
        out = stateful(stream)
        schemas.append(out.schema)
        out.writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/check").trigger(availableNow=True).start().awaitTermination()

    base = _replayed(spark, rows, name, run)
    return spark.read.schema(schemas[0]).parquet(f"{base}/out")


@query(SQL["message_suppression"])
def streamed_suppression(spark, d):
    """The messages of ``message_suppression`` as a stream of several batches, with keyed state that goes after its time."""
    rows = table(spark, d, "events").select(F.col("user_id").alias("key"), F.col("ts").cast("timestamp").alias("ts"))
    return _told(spark, rows, "suppression", lambda stream: suppressed_stream(stream, 3600, "1 second", "bigint")).where("key >= 0")


@query(SQL["task_transitions"])
def streamed_tasks(spark, d):
    """The task events of ``task_transitions`` as a stream of several batches."""
    kinds = F.array(*map(F.lit, ("TASK_STARTED", "TASK_PROGRESS", "TASK_FINISHED", "TASK_FAILED", "SCAN_STARTED")))
    kind = F.get(kinds, (F.col("event_id") % 5).cast("int"))
    rows = table(spark, d, "events").select(F.col("user_id").alias("task"), F.col("ts").cast("timestamp").alias("ts"), "event_id", kind.alias("type"))
    out = _told(spark, rows, "tasks", lambda stream: task_history_stream(stream, "1 second", 1e9, "bigint")).where("task >= 0")
    return out.select("event_id", "state", "valid")


@query("""WITH s AS (SELECT *, epoch_us(ts) AS t FROM events), b AS (SELECT min(t) AS a, max(t) AS z FROM s), p AS (SELECT s.*, (t - a) * 4 // (z - a + 1) AS part FROM s, b)
SELECT 'INIT' AS frame, event_id FROM (SELECT event_id FROM p WHERE part = 0 ORDER BY ts DESC, event_id DESC LIMIT 300)
UNION ALL SELECT CASE WHEN event_id % 1000 = 0 THEN 'RELOAD' ELSE 'LOG' END, event_id FROM p WHERE part > 0""")
def live_frames(spark, d):
    """The events as a log that is followed from its first files on, in several runs of one query: the newest so far, then each further one."""
    rows = table(spark, d, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"))
    base = _replayed(spark, rows, "log", lambda source, at: live_log.follow(source, f"{at}/frames", f"{at}/check", 300, F.col("event_id") % 1000 == 0).awaitTermination())
    return live_log.frames(spark, f"{base}/frames").where("event_id >= 0").select("frame", "event_id")


# -- guards, requests, tables, crops ----------------------------------------------------------------


@query("""WITH p AS (SELECT p_partkey AS id, CASE p_partkey % 4 WHEN 0 THEN 'bank' WHEN 1 THEN 'tax' WHEN 2 THEN 'bank' ELSE 'tax' END AS category,
CASE p_partkey % 4 WHEN 0 THEN 'impot' WHEN 1 THEN 'impot' WHEN 2 THEN 'tax' ELSE 'impots' END AS slug FROM part)
SELECT id, CASE id % 4 WHEN 0 THEN 'owned elsewhere : bank/impot -> tax/impot' WHEN 2 THEN 'category name : bank/tax -> bank/general' ELSE 'spelling : tax/impots -> tax/impot' END AS hint FROM p WHERE id % 4 <> 1""")
def kept_hints(spark, d):
    """Placements that a guard changed, kept as hints in two commits."""
    taxonomy = [{"id": "tax", "subcategories": [{"id": "impot", "aliases": []}]}, {"id": "bank", "subcategories": [{"id": "releve", "aliases": []}]}]
    key = F.col("p_partkey")
    category = F.when(key % 2 == 0, "bank").otherwise("tax")
    slug = F.when(key % 4 == 2, "tax").when(key % 4 == 3, "impots").otherwise("impot")
    rows = worked(spark, d, "part").select(key.alias("id"), category.alias("category"), slug.alias("slug"))
    guard = rules.placement_guard(F.col("category"), F.col("slug"), taxonomy, ["tax", "bank"])
    placed = rows.withColumn("g", guard).select("id", "category", "slug", F.col("g.category").alias("to_category"), F.col("g.slug").alias("to_slug"), F.col("g.hint").alias("hint"))
    path = scratch_folder(spark, "hints")
    for half in (0, 1):
        store.keep_hints(placed.where(F.floor(F.col("id") / 8) % 2 == half), path, now().cast("timestamp"))
    return versions.rows_of(spark, path, store.HINTS).select("id", "hint")


@query("""SELECT c_custkey AS id, CASE WHEN c_custkey % 2 = 0 THEN c_name ELSE c_name || '|b' END AS keywords, CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE 'src' || c_custkey % 7 END AS category,
CASE c_custkey % 5 WHEN 0 THEN NULL WHEN 1 THEN 1 WHEN 2 THEN 50 WHEN 3 THEN 1 + c_custkey % 50 ELSE NULL END AS n FROM customer""")
def request_validation(spark, d):
    """Loose requests: non-strings leave term lists, null means absent, strings are trimmed, the limit is bounded."""
    key = F.col("c_custkey")
    terms = F.when(key % 2 == 0, F.to_json(F.array(F.concat(F.lit(" "), "c_name")))).otherwise(F.concat(F.lit('["'), "c_name", F.lit('", 3, null, " b "]')))
    category = F.when(key % 3 == 0, F.when(key % 2 == 0, "null").otherwise('"  "')).otherwise(F.concat(F.lit('" src'), (key % 7).cast("string"), F.lit(' "')))
    limit = F.when(key % 5 == 0, "null").when(key % 5 == 1, "-4").when(key % 5 == 2, "1e3").when(key % 5 == 3, F.concat(F.lit('"'), (1 + key % 50).cast("string"), F.lit('"'))).otherwise('"many"')
    raw = F.concat(F.lit('{"keywords": '), terms, F.lit(', "category": '), category, F.lit(', "limit": '), limit, F.lit("}"))

    def run(frames):
        for frame in frames:
            found = [StructuredQuery.parse(json.loads(x)) for x in frame["raw"]]
            yield pd.DataFrame({"id": frame["id"], "keywords": ["|".join(q.keywords) for q in found], "category": [q.category for q in found], "n": pd.array([q.limit for q in found], "Int64")})

    return worked(spark, d, "customer").select(key.alias("id"), raw.alias("raw")).mapInPandas(run, "id long, keywords string, category string, n long")


@query("""SELECT p_partkey AS id, CASE WHEN p_partkey % 3 < 2 THEN 'sg' END AS found FROM part""")
def accents_count(spark, d):
    """An accent is part of a letter: an entity is found as it is written or as an alias of it is, not by folding."""
    body = F.concat(F.when(F.col("p_partkey") % 3 == 0, "banque générale ").when(F.col("p_partkey") % 3 == 1, "banque generale ").otherwise("banque génerale "), F.col("p_name"))
    entities = {"banks": [{"slug": "sg", "name": "Banque Générale", "aliases": ["banque generale"]}]}
    return worked(spark, d, "part").select(F.col("p_partkey").alias("id"), rules.first_entity(F.lower(body), entities)["slug"].alias("found"))


@query("""SELECT p_partkey AS id, '| h | ' || p_name || ' |' || chr(10) || '| --- | --- |' || chr(10) || '| 1 | 2 |' || chr(10) || CASE WHEN p_partkey % 3 = 0 THEN '| 3 | 4 |' WHEN p_partkey % 3 = 1 THEN chr(10) || '## Part' || chr(10) || '| 3 | 4 | 5 |' ELSE '|3 | 4|' || chr(10) || '| 5 | ' || p_type || ' |' END AS body FROM part""")
def cut_tables(spark, d):
    """A table cut by a heading goes on, one of another width does not, and rows without ends get them."""
    k = F.col("p_partkey") % 3
    tail = F.when(k == 0, "\n## Part\n| 3 | 4 |").when(k == 1, "\n## Part\n| 3 | 4 | 5 |").otherwise(F.concat(F.lit("|3 | 4\n\n| 5 | "), "p_type", F.lit(" |")))
    body = F.concat(F.lit("| h | "), "p_name", F.lit(" |\n| --- | --- |\n| 1 | 2 |\n"), tail)
    return worked(spark, d, "part").select(F.col("p_partkey").alias("id"), markdown.repair_tables(body).alias("body"))


@query("""WITH l AS (SELECT l_orderkey, l_linenumber, 2.0 * l_quantity AS w, l_discount * 400 AS px, l_tax * 100 AS t FROM lineitem),
c AS (SELECT *, [sqrt(px * px + 225), sqrt((px - w) * (px - w) + 225), sqrt((px - w) * (px - w) + 225), sqrt(px * px + 225)] AS c,
[sqrt((px - w / 2) * (px - w / 2) + 225), abs(px - w), sqrt((px - w / 2) * (px - w / 2) + 225), abs(px)] AS e FROM l)
SELECT l_orderkey, l_linenumber, round(least(100, w + t), 6) AS corner_x, round(30 + t * 4, 6) AS edge_y, round(greatest(1, w), 6) AS box_width, round(30 + t * 4, 6) AS box_height,
CASE WHEN list_min(c) < 18 THEN 'c' || (list_position(c, list_min(c)) - 1) WHEN list_min(e) < 18 THEN 'e' || (list_position(e, list_min(e)) - 1) WHEN px < w THEN 'move' ELSE 'none' END AS handle FROM c""")
def crop_handles(spark, d):
    """A corner and an edge of a crop are dragged, its box, and what a pointer at half height takes hold of."""
    w, t = F.col("l_quantity") * 2, F.col("l_tax") * 100
    quad = geometry.full_frame(w, 30)
    edge = geometry.edge_moved(quad, 2, 3.0, t * 4, 100, 90)
    box = geometry.bounds(edge, 100, 90)
    return table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", F.round(geometry.corner_moved(quad, 1, t, -5.0, 100, 60)[1]["x"], 6).alias("corner_x"), F.round(edge[3]["y"], 6).alias("edge_y"),
        F.round(box["width"], 6).alias("box_width"), F.round(box["height"], 6).alias("box_height"), geometry.handle_at(quad, F.col("l_discount") * 400, F.lit(15.0)).alias("handle"),
    )


@query("SELECT 'src=' || source AS folder, 2 AS files FROM documents GROUP BY source")
def walked_files(spark, d):
    """Every file below a root, whatever its ending; marks that a writer leaves are in a dot folder's place."""
    base = f"{scratch_folder(spark, 'walk')}/in"
    rows = load(spark, d).select(F.col("category").alias("src"), "title").repartition(1)
    rows.write.partitionBy("src").parquet(base)
    rows.select("src", F.coalesce("title", F.lit("")).alias("title")).write.mode("append").partitionBy("src").text(base)
    found = files.list_files(spark, base, None).where(paths.basename(F.col("path")).startswith("part-"))
    return found.groupBy(F.regexp_extract("path", "/([^/]*)/[^/]*$", 1).alias("folder")).agg(F.count(F.lit(1)).cast("int").alias("files"))


@query("""WITH p AS (SELECT c_custkey AS id, c_name AS name, c_custkey % 4 AS k FROM customer)
SELECT id, CASE k WHEN 0 THEN 'w' || id WHEN 1 THEN 'all' WHEN 2 THEN 'w' || id END AS slug, CASE k WHEN 1 THEN 'gov' ELSE 'banks' END AS domain FROM p WHERE k < 3""")
def entity_join(spark, d):
    """A dictionary that grows with the table: every customer's name, met in texts by its longest word, and one entity of another domain."""
    key, customers = F.col("c_custkey"), table(spark, d, "customer")
    entries = customers.select(F.lit("banks").alias("domain"), key.alias("entry"), F.concat(F.lit("w"), key.cast("string")).alias("slug"), F.lit(0).alias("ordinal"), F.col("c_name").alias("surface"))
    entries = entries.union(spark.createDataFrame([("gov", 0, "all", 0, "Avis & Taxes (fin.)")], entries.schema))
    body = F.concat(F.when(key % 4 == 1, "x avis & taxes (fin.) y ").otherwise("compte "), F.when(key % 4 == 1, "").when(key % 4 == 3, F.concat("c_name", F.lit("9"))).otherwise(F.col("c_name")), F.lit(", client"))
    return rules.first_by_join(customers.select(key.alias("id"), body.alias("raw_text")), rules.entity_table(entries)).select("id", "slug", "domain")


@query("""SELECT doc_id AS id, 'doc_' || doc_id || '.md' AS name, md5(coalesce(text, '')) AS content FROM documents WHERE doc_id % 10 < 3 UNION ALL SELECT -1, NULL, NULL""")
def package_archive(spark, d):
    """Chosen documents as a zip archive that is read back, and a chosen id that has none."""
    docs = load(spark, d).withColumn("filename", F.concat(F.lit("doc_"), F.col("id").cast("string"), F.lit(".md"))).select("id", "filename", "raw_text")
    wanted = docs.where("id % 10 < 3").select("id").union(spark.createDataFrame([(-1,)], "id long"))
    found, missing = ops.package(docs, wanted)
    path = f"{scratch_folder(spark, 'package')}/package.zip"
    archive.write_archive(found.select(F.col("target").alias("name"), F.col("raw_text").alias("body")), path)
    members = archive.read_archives(spark, path).select(F.regexp_extract("name", "doc_([0-9]+)", 1).cast("long").alias("id"), "name", F.md5("body").alias("content"))
    return members.union(missing.select("id", F.lit(None).cast("string"), F.lit(None).cast("string")))
