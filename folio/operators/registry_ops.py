"""Operators over registry tables: filters, deduplication, counts, mutations, reconciliation, activity."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folio.functions.paths import basename, canonical_path, extension, is_inside
from folio.functions.text import is_forbidden, is_year, natural_key, normalize_slug, path_title, trimmed
from folio.operators.ordering import numbered
from folio.session import staged

# -- filters and projections ---------------------------------------------------------------------


def list_filter(docs: DataFrame, q: str = "", category: str = "", subcategory: str = "", fields: tuple[str, ...] = ("title", "filename", "raw_text")) -> DataFrame:
    """Free text in any field, and exact category and subcategory; all without regard to case."""
    if q:
        hits = [F.lower(F.coalesce(docs[f].cast("string"), F.lit(""))).contains(q.lower()) for f in fields if f in docs.columns]
        docs = docs.where(reduce(lambda a, b: a | b, hits))
    if category:
        docs = docs.where(F.lower("category") == category.lower())
    if subcategory:
        docs = docs.where(F.lower(F.coalesce("subcategory", F.lit(""))) == subcategory.lower())
    return docs


def preview(docs: DataFrame, chars: int = 800) -> DataFrame:
    return docs.withColumn("raw_text", F.substring("raw_text", 1, chars))


def without_text(docs: DataFrame, least: int = 10) -> DataFrame:
    return docs.where(F.length(trimmed(F.coalesce("raw_text", F.lit("")))) < least)


def in_dates(docs: DataFrame, low: str | None, high: str | None) -> DataFrame:
    """Inclusive bounds on ISO dates; with a bound, rows without a date go."""
    if low or high:
        docs = docs.where(F.coalesce("date", F.lit("")) != "")
    if low:
        docs = docs.where(F.col("date") >= low)
    return docs.where(F.col("date") <= high) if high else docs


def contact_filter(docs: DataFrame, contact: str) -> DataFrame:
    """Rows that name a contact in any contact field, without regard to case; an empty contact filters nothing."""
    fields = [c for c in docs.columns if c.startswith("contact_")]
    if not contact or not fields:
        return docs
    return docs.where(reduce(lambda a, b: a | b, [F.lower(F.coalesce(docs[f], F.lit(""))).contains(contact.lower()) for f in fields]))


def lookup(table: DataFrame, column: str, *values) -> DataFrame:
    """Rows by id, checksum or path; the filter reaches the scan."""
    return table.where(F.col(column).isin(*values))


def tag_filter(docs: DataFrame, tag: str) -> DataFrame:
    """A tag that is some row's subcategory filters by subcategory, any other by the tags."""
    own = F.lower(F.coalesce("subcategory", F.lit(""))) == tag.lower()
    is_sub = docs.agg(F.coalesce(F.bool_or(own), F.lit(False)).alias("is_sub"))
    has = F.array_contains(F.transform("tags", F.lower), tag.lower())
    return docs.crossJoin(F.broadcast(is_sub)).where(F.when(F.col("is_sub"), own).otherwise(has)).drop("is_sub")  # one row


# -- duplicates and names ------------------------------------------------------------------------


def split_known(incoming: DataFrame, known: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(new, duplicates)`` of incoming rows by checksum."""
    keys = known.select("checksum")
    return incoming.join(keys, "checksum", "left_anti"), incoming.join(keys, "checksum", "left_semi")


def first_of_batch(incoming: DataFrame, order: str = "path") -> DataFrame:
    """Of equal contents in one batch the first by path; others are duplicates of it (``copy_of``).

    A row without a checksum has no known content and copies nothing.
    """
    first = incoming.groupBy("checksum").agg(F.min_by("id", F.struct(order, "id")).alias("first"), F.count(F.lit(1)).alias("__n"))
    first = first.where("checksum is not null and __n > 1").drop("__n")
    joined = incoming.join(first, "checksum", "left")
    return joined.withColumn("copy_of", F.when(F.col("id") != F.col("first"), F.col("first"))).select(*incoming.columns, "copy_of")


def free_names(docs: DataFrame, name: str, order: str = "id", occupied: DataFrame | None = None, mark: str = "_dup", out: str = "target") -> DataFrame:
    """``docs`` with unique names in ``out``, none of them in ``occupied(name)``; case does not tell names apart.

    The first row of a name that nobody has keeps it. Every other one gets ``mark`` and the smallest number from 1
    that is free: neither an occupied name nor one that a row keeps has it, and the rows of a stem take the free
    numbers in their order. A number after the last mark belongs to one stem only, so two stems never meet. Null
    names stay null. No stem's rows meet in one task: numbers come from ranges of the order.
    """
    columns = docs.columns
    key = F.lower(F.col(name))
    rows = numbered(docs.withColumn("__key", key), ["__key"], [order, name], "__n")
    taken = (occupied.select(F.lower("name").alias("__key")) if occupied is not None else rows.select("__key").limit(0)).where("__key is not null").distinct()
    rows = staged(rows.join(taken.withColumn("__taken", F.lit(True)), "__key", "left"), "names")
    keeps = F.col("__key").isNull() | ((F.col("__n") == 1) & F.col("__taken").isNull())
    stem = F.regexp_replace("__key", r"\.[^./]*$", "")
    ending = F.regexp_extract("__key", r"(\.[^./]*)$", 1)
    moved = rows.where(~keeps).withColumns({"__stem": stem, "__end": ending})
    moved = numbered(moved, ["__stem", "__end"], ["__key", "__n"], "__j")
    # numbers in use, of the stems in question
    used = rows.where(keeps).select("__key").union(taken).where("__key is not null")
    pattern = rf"^(.*){re.escape(mark.lower())}([1-9][0-9]{{0,17}})(\.[^./]*)?$"
    parsed = used.where(F.col("__key").rlike(pattern)).select(
        F.regexp_extract("__key", pattern, 1).alias("__stem"), F.regexp_extract("__key", pattern, 3).alias("__end"), F.regexp_extract("__key", pattern, 2).cast("long").alias("__u")
    )
    parsed = parsed.distinct().join(moved.select("__stem", "__end").distinct(), ["__stem", "__end"], "left_semi")
    # the i-th used number u has u - i free ones before it: it pushes on the requests beyond those
    gaps = numbered(parsed, ["__stem", "__end"], ["__u"], "__i").select("__stem", "__end", (F.col("__u") - F.col("__i")).alias("__j"), F.lit(1).alias("__used"))
    both = moved.withColumn("__used", F.lit(0)).unionByName(gaps, allowMissingColumns=True)
    placed = numbered(both, ["__stem", "__end"], ["__j", "__used"], "__k").where("__used = 0")
    fresh = F.concat(F.regexp_replace(name, r"\.[^./]*$", ""), F.lit(mark), F.col("__k").cast("string"), F.regexp_extract(name, r"(\.[^./]*)$", 1))
    return rows.where(keeps).select(*columns, F.col(name).alias(out)).unionByName(placed.select(*columns, fresh.alias(out)))


def collision_names(docs: DataFrame, name: str = "filename", mark: str = "_dup", occupied: DataFrame | None = None) -> DataFrame:
    """Unique target names: the second file of a name gets ``_dup1``, or the next number that is free, and so on, by id."""
    return free_names(docs, name, "id", occupied, mark)


def without_overwrite(moves: DataFrame, files: DataFrame, at: Column) -> DataFrame:
    """``moves(id, target)`` to ``placed``: a target that a file already has gets a time suffix, and what then meets another move or file a number."""
    taken = files.select(F.lower("path").alias("__t"), F.lit(True).alias("__taken")).distinct()
    stamped = F.concat(F.regexp_replace("target", r"\.[^./]*$", ""), F.lit("_"), F.date_format(at, "yyyyMMddHHmmss"), F.regexp_extract("target", r"(\.[^./]*)$", 1))
    marked = moves.withColumn("__t", F.lower("target")).join(taken, "__t", "left").withColumn("__wanted", F.when(F.col("__taken"), stamped).otherwise(F.col("target")))
    return free_names(marked.drop("__t", "__taken"), "__wanted", "id", files.select(F.col("path").alias("name")), "_", "placed").drop("__wanted")


# -- counts --------------------------------------------------------------------------------------


def category_counts(docs: DataFrame) -> DataFrame:
    sub = F.lower(F.coalesce(F.nullif("subcategory", F.lit("")), F.lit("general")))
    return docs.groupBy(F.lower("category").alias("category"), sub.alias("subcategory")).agg(F.count(F.lit(1)).alias("count"))


def totals(counts: DataFrame) -> DataFrame:
    """Documents, categories and subcategories in use."""
    return counts.agg(
        F.sum("count").alias("documents"),
        F.count_distinct(F.when(F.col("count") > 0, F.col("category"))).alias("categories"),
        F.count_distinct(F.when((F.col("count") > 0) & (F.col("subcategory") != "general"), F.struct("category", "subcategory"))).alias("subcategories"),
    )


def subcategory_totals(counts: DataFrame) -> DataFrame:
    return counts.groupBy("subcategory").agg(F.sum("count").alias("count"), F.count_distinct("category").alias("categories"))


def shown(counts: DataFrame, active: str = "") -> DataFrame:
    return counts.where((F.col("count") > 0) | (F.col("category") == active))


def format_breakdown(files: DataFrame) -> DataFrame:
    return files.groupBy(extension(F.col("filename")).alias("ext")).agg(F.count(F.lit(1)).alias("files"), F.sum("size").alias("bytes"))


def system_stats(docs: DataFrame, files: DataFrame) -> DataFrame:
    """One row: documents, files and their bytes, the registry's bytes of text, formats in use."""
    of_docs = docs.agg(F.count(F.lit(1)).alias("documents"), F.coalesce(F.sum(F.octet_length("raw_text")), F.lit(0)).cast("long").alias("text_bytes"))
    of_files = files.agg(
        F.count(F.lit(1)).alias("files"), F.coalesce(F.sum("size"), F.lit(0)).cast("long").alias("bytes"), F.count_distinct(extension(F.col("filename"))).alias("formats")
    )
    return of_docs.crossJoin(of_files)  # one row each


def learning_totals(blocked: DataFrame, decisions: DataFrame) -> DataFrame:
    """One row: blocked files, decisions, and those of them that are enabled."""
    of_decisions = decisions.agg(F.count(F.lit(1)).alias("decisions"), F.count_if(F.coalesce("enabled", F.lit(1)) != 0).alias("enabled"))
    return blocked.agg(F.count(F.lit(1)).alias("blocked")).crossJoin(of_decisions)  # one row each


def bundle_pages(files: DataFrame) -> DataFrame:
    """``folder, page, path``: the images of each bundle in natural order, which puts ``IMG_2`` before ``IMG_10``."""
    pages = files.withColumn("folder", F.regexp_replace("path", r"/[^/]*$", "")).join(image_bundles(files).select("folder"), "folder", "left_semi")
    own = Window.partitionBy("folder").orderBy(natural_key(basename(F.col("path"))), "path")
    return pages.select("folder", F.row_number().over(own).alias("page"), "path")


def image_bundles(files: DataFrame) -> DataFrame:
    """Folders that hold two images or more and nothing else."""
    image = extension(F.col("path")).isin("png", "jpg", "jpeg", "webp", "bmp", "tiff")
    return (
        files.groupBy(F.regexp_replace("path", r"/[^/]*$", "").alias("folder"))
        .agg(F.count_if(image).alias("images"), F.count(F.lit(1)).alias("files"))
        .where("images >= 2 and images = files")
    )


def outcome_counts(items: DataFrame, outcomes: list[str], column: str = "status") -> DataFrame:
    """One row: how many items had each outcome, and in all."""
    return items.agg(F.count(F.lit(1)).alias("total"), *(F.count_if(F.col(column) == o).alias(o) for o in outcomes))


# -- mutations: each returns the new table -------------------------------------------------------


def first_of_key(rows: DataFrame, key: str, *order) -> DataFrame:
    """The first row of each key; rows without a key are nothing to each other and all stay."""
    own = Window.partitionBy(key, "__alone").orderBy(*order)
    marked = rows.withColumn("__alone", F.when(F.col(key).isNull(), F.monotonically_increasing_id()))
    return marked.withColumn("__rn", F.row_number().over(own)).where("__rn = 1").drop("__rn", "__alone")


def insert(table: DataFrame, rows: DataFrame) -> DataFrame:
    """Rows whose checksum is new, each checksum once (the smallest id's); rows without one are all new."""
    fresh = rows.join(table.select("checksum"), "checksum", "left_anti")
    return table.unionByName(first_of_key(fresh, "checksum", "id"), allowMissingColumns=True)


def patch(table: DataFrame, patches: DataFrame, key: str = "id", aliases: dict[str, str] | None = None, order: str | None = None) -> DataFrame:
    """Non-null fields of a patch replace the row's; ``aliases`` name fields that patches call otherwise.

    Of several patches of one key each field takes its last value by ``order``, without one the largest.
    """
    for theirs, ours in (aliases or {}).items():
        if theirs in patches.columns:
            value = F.coalesce(patches[theirs], patches[ours]) if ours in patches.columns else patches[theirs]
            patches = patches.withColumn(ours, value).drop(theirs)
    last = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col(order))) if order else F.max(c)
    fields = [c for c in patches.columns if c not in (key, order) and c in table.columns]
    named = patches.groupBy(key).agg(F.count(F.lit(1)).alias("__n"), *(last(c).alias(f"__{c}") for c in fields))
    joined = table.join(named, key, "left")
    return joined.select(*(F.coalesce(f"__{c}", c).alias(c) if f"__{c}" in named.columns else F.col(c) for c in table.columns))


def upsert(table: DataFrame, rows: DataFrame, key: str, newest: str) -> DataFrame:
    """The newest row of each key; of equals the incoming one. Rows without a key all stay."""
    both = table.withColumn("__in", F.lit(0)).unionByName(rows.withColumn("__in", F.lit(1)))
    return first_of_key(both, key, F.col(newest).desc(), F.col("__in").desc()).drop("__in")


def delete(table: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    return table.join(keys.select(key), key, "left_anti")


def prune(blocked: DataFrame, files: DataFrame, key: str = "original_path") -> DataFrame:
    """Blocked entries whose file still exists."""
    return blocked.join(files.select(F.col("path").alias(key)), key, "left_semi")


def skip_or_retry(files: DataFrame, blocked: DataFrame) -> DataFrame:
    """``skip``: the cache's newest entry of the path has the same time and size."""
    newest = blocked.groupBy(F.col("original_path").alias("path")).agg(F.max(F.struct("mtime_ms", "size")).alias("e"))
    known = newest.select("path", F.col("e.mtime_ms").alias("__m"), F.col("e.size").alias("__s"), F.lit(True).alias("__k"))
    same = F.col("__k") & F.col("mtime_ms").eqNullSafe(F.col("__m")) & F.col("size").eqNullSafe(F.col("__s"))
    return files.join(known, "path", "left").withColumn("skip", F.coalesce(same, F.lit(False))).drop("__m", "__s", "__k")


# -- reconciliation ------------------------------------------------------------------------------


def ghosts(docs: DataFrame, files: DataFrame) -> DataFrame:
    """Rows without a file."""
    return docs.join(files.select("path"), "path", "left_anti")


def orphans(files: DataFrame, docs: DataFrame, root: str = "/archive") -> DataFrame:
    """Files below ``root`` without a row."""
    return files.where(is_inside(F.col("path"), F.lit(root))).join(docs.select("path"), "path", "left_anti")


def locate(docs: DataFrame, files: DataFrame, input_dir: str = "/input") -> DataFrame:
    """Where a document's file is: new path, original path, input folder, else the archive's file of that name. Rows stay rows."""
    files = files.select("path").distinct()
    exact = lambda c, to: files.select(F.col("path").alias(c), F.col("path").alias(to))
    by_name = files.groupBy(F.lower(basename(F.col("path"))).alias("__name")).agg(F.min("path").alias("__4"))
    return (
        docs.withColumn("__input", F.concat(F.lit(input_dir + "/"), F.col("filename")))
        .withColumn("__name", F.lower("filename"))
        .join(exact("new_path", "__1"), "new_path", "left")
        .join(exact("original_path", "__2"), "original_path", "left")
        .join(exact("__input", "__3"), "__input", "left")
        .join(by_name, "__name", "left")
        .withColumn("found_path", F.coalesce("__1", "__2", "__3", "__4"))
        .drop("__input", "__name", "__1", "__2", "__3", "__4")
    )


def repair(files: DataFrame, docs: DataFrame) -> DataFrame:
    """Archive files against the registry by checksum: ``updated`` (another path), ``unchanged`` or ``repaired`` (no row)."""
    known = docs.groupBy("checksum").agg(F.min("id").alias("id"), F.min_by("path", "id").alias("known_path"))
    action = F.when(F.col("id").isNull(), "repaired").when(F.col("path") == F.col("known_path"), "unchanged").otherwise("updated")
    return files.join(known, "checksum", "left").withColumn("action", action)


def repair_plan(files: DataFrame, docs: DataFrame, today: Column, root: str = "/archive") -> DataFrame:
    """What a repair does with each archive file, by checksum: ``action``, ``text_refreshed`` and the file's ``target``.

    ``files(path, checksum, fresh_text, rule_category, rule_subcategory)`` carry a new extraction and what
    the rules say of it. Without readable text, or with a place that stays generic, a file goes back to the
    inbox (``moved_to_raws``). A known file whose canonical place is another one is ``relocalized``, one
    whose text or place changes ``updated``, any other ``unchanged``; an unknown file is ``repaired``.
    """
    known = first_of_key(docs.where("checksum is not null"), "checksum", "id").select(
        "checksum", F.col("id"), F.col("category").alias("__c"), F.col("subcategory").alias("__s"), F.col("date").alias("__d"), F.col("raw_text").alias("__t")
    )
    rows = files.join(known, "checksum", "left")
    unknown = F.col("id").isNull()
    specific = ~is_generic_place(F.col("rule_category"), F.col("rule_subcategory"))
    reclassify = unknown | is_generic_place(F.col("__c"), F.col("__s"))
    category = F.when(reclassify, F.col("rule_category")).otherwise(F.col("__c"))
    subcategory = F.when(reclassify, F.col("rule_subcategory")).otherwise(F.col("__s"))
    target = canonical_path(F.lit(root), F.col("path"), category, subcategory, F.col("__d"), today)
    empty = F.length(trimmed(F.coalesce("fresh_text", F.lit("")))) < 10
    fresh = ~unknown & needs_text(F.col("__t"), F.col("fresh_text"))
    action = (
        F.when(empty | (reclassify & ~specific), "moved_to_raws")
        .when(unknown, "repaired")
        .when(target != F.col("path"), "relocalized")
        .when(fresh | reclassify, "updated")
        .otherwise("unchanged")
    )
    out = rows.withColumn("action", action).withColumn("text_refreshed", fresh & ~empty).withColumn("target", F.when(F.col("action") != "moved_to_raws", target))
    return out.drop("__c", "__s", "__d", "__t")


def repair_counters(plan: DataFrame) -> DataFrame:
    """One row: files scanned and how many a repair adds, updates, relocates and moves back."""
    return outcome_counts(plan, ["repaired", "updated", "relocalized", "moved_to_raws"], "action").withColumnRenamed("total", "scanned")


def needs_text(stored: Column, fresh: Column, placeholder: str = "[no text]") -> Column:
    """Stored text is missing, too short or a placeholder, or the fresh one is longer than 20 and differs."""
    s, f = F.coalesce(stored, F.lit("")), F.coalesce(fresh, F.lit(""))
    return (F.length(trimmed(s)) < 15) | (s == placeholder) | ((F.length(f) > 20) & (f != s))


def chosen_text(stored: Column, fresh: Column, edited: Column) -> Column:
    """On a second analysis: text edited by hand wins, then a fresh one with substance, then what is stored."""
    return F.when(edited & (F.length(trimmed(stored)) > 0), stored).when(F.length(trimmed(fresh)) >= 10, fresh).otherwise(F.coalesce(stored, F.lit("")))


def is_generic_place(category: Column, subcategory: Column) -> Column:
    sub = F.lower(F.coalesce(subcategory, F.lit("")))
    return sub.isin("", "general", "other", "divers") | (F.lower(F.coalesce(category, F.lit(""))) == "personal")


# -- taxonomy ------------------------------------------------------------------------------------


def merge_taxonomy(public: DataFrame, private: DataFrame) -> DataFrame:
    """Entries ``category, slug, name, aliases`` of both; of the same slug the private one counts."""
    both = public.withColumn("__p", F.lit(1)).unionByName(private.withColumn("__p", F.lit(0)))
    own = Window.partitionBy("category", "slug").orderBy("__p")
    return both.withColumn("__rn", F.row_number().over(own)).where("__rn = 1").drop("__rn", "__p")


def taxonomy_overlay(merged: DataFrame, public: DataFrame) -> DataFrame:
    """What a private file has to hold: merged entries that differ from the public ones."""
    return merged.exceptAll(public.select(*merged.columns))


def counts_with_taxonomy(taxonomy: DataFrame, counts: DataFrame) -> DataFrame:
    """Configured entries with their counts, and entries in use that nothing configures (no ``general``, no years)."""
    named = taxonomy.select(F.lower("category").alias("category"), F.lower("slug").alias("subcategory"), "name")
    used = counts.where((F.col("subcategory") != "general") & ~is_year(F.col("subcategory")))
    return named.join(used, ["category", "subcategory"], "full_outer").select(
        "category",
        "subcategory",
        F.coalesce("name", path_title(F.col("subcategory"))).alias("name"),
        F.coalesce("count", F.lit(0)).cast("long").alias("count"),
        F.col("name").isNotNull().alias("configured"),
    )


def menu_order(entries: DataFrame) -> DataFrame:
    """``position`` of each entry in its category's menu: configured ones by name whatever case or accent, then the injected ones by slug."""
    name = F.collate(F.col("name"), "UNICODE_CI_AI") if hasattr(F, "collate") else F.lower("name")
    own = Window.partitionBy("category").orderBy(F.when(F.col("configured"), 0).otherwise(1), F.when(F.col("configured"), name), "subcategory")
    return entries.withColumn("position", F.row_number().over(own))


def unused_entries(taxonomy: DataFrame, docs: DataFrame) -> DataFrame:
    used = docs.select(F.lower("category").alias("category"), F.lower("subcategory").alias("slug")).distinct()
    return taxonomy.join(used, ["category", "slug"], "left_anti")


def ambiguous_slugs(entries: DataFrame) -> DataFrame:
    """Slugs that more than one category owns."""
    return entries.groupBy("slug").agg(F.array_sort(F.collect_set("category")).alias("owners")).where(F.size("owners") > 1)


def squeezed_collisions(entries: DataFrame) -> DataFrame:
    """Slugs that are one name but for punctuation."""
    key = F.regexp_replace(F.lower("slug"), "[^a-z0-9]", "")
    return entries.groupBy(key.alias("key")).agg(F.array_sort(F.collect_set("slug")).alias("slugs")).where(F.size("slugs") > 1)


def owner_of(current: Column, owners: Column) -> Column:
    """The current category if it is an owner, else a single owner, else null."""
    return F.when(F.array_contains(owners, current), current).when(F.size(owners) == 1, owners[0])


def rename_subcategory(docs: DataFrame, mapping: DataFrame) -> DataFrame:
    """``mapping(category, old, new)`` applied to every row; it is checked for size before it is broadcast by the planner."""
    m = mapping.select(F.lower("category").alias("__c"), F.lower("old").alias("__o"), F.col("new").alias("__n"))
    on = (F.lower(docs["category"]) == F.col("__c")) & (F.lower(docs["subcategory"]) == F.col("__o"))
    return docs.join(m, on, "left").withColumn("subcategory", F.coalesce("__n", "subcategory")).drop("__c", "__o", "__n")


def fold_aliases(entries: DataFrame, merges: DataFrame) -> DataFrame:
    """``merges(category, loser, winner)``: the loser's slug and aliases become aliases of the winner."""
    lost = entries.join(merges.select("category", F.col("loser").alias("slug"), "winner"), ["category", "slug"])
    gained = lost.groupBy("category", F.col("winner").alias("slug")).agg(
        F.flatten(F.collect_list(F.concat(F.array("slug"), F.coalesce("aliases", F.array().cast("array<string>"))))).alias("gained")
    )
    kept = entries.join(merges.select("category", F.col("loser").alias("slug")), ["category", "slug"], "left_anti")
    return kept.join(gained, ["category", "slug"], "left").withColumn(
        "aliases", F.array_sort(F.array_union(F.coalesce("aliases", F.array().cast("array<string>")), F.coalesce("gained", F.array().cast("array<string>"))))
    ).drop("gained")


def similar_slugs(slugs: DataFrame, least: float = 0.82, shortest: int = 4) -> DataFrame:
    """Pairs ``a < b`` of slugs that differ little. Blocked so that no pair of all slugs is formed.

    At this likeness at most ``(1 - least) * length`` edits part two names, so of as many plus one equal
    segments one stays whole somewhere near its place: names meet on length and segment, then compare.
    """
    own = slugs.select("slug").distinct().where(F.length("slug") >= shortest).withColumn("n", F.length("slug"))
    # longer side m decides: edits <= floor((1 - least) * m), segments of m at fixed places, shifted by up to that many
    edits = F.floor((1 - least) * F.col("n") + 1e-9).cast("int")
    long_ = own.withColumn("edits", edits).withColumn("k", F.explode(F.sequence(F.lit(0), F.col("edits"))))
    cut = lambda i: F.floor(F.col("n") * i / (F.col("edits") + 1)).cast("int")
    long_ = long_.withColumn("at", cut(F.col("k"))).withColumn("to", cut(F.col("k") + 1))
    long_ = long_.select(F.col("slug").alias("x"), F.col("n").alias("m"), F.col("k"), F.col("slug").substr(F.col("at") + 1, F.col("to") - F.col("at")).alias("part"), "edits", "at")
    probes = (
        own.withColumn("m", F.explode(F.sequence(F.col("n"), F.ceil(F.col("n") / least).cast("int"))))
        .withColumn("edits", F.floor((1 - least) * F.col("m") + 1e-9).cast("int"))
        .withColumn("k", F.explode(F.sequence(F.lit(0), F.col("edits"))))
    )
    place = lambda i: F.floor(F.col("m") * i / (F.col("edits") + 1)).cast("int")
    probes = (
        probes.withColumn("at", place(F.col("k")))
        .withColumn("len", place(F.col("k") + 1) - F.col("at"))
        .withColumn("start", F.explode(F.sequence(F.greatest(F.col("at") - F.col("edits"), F.lit(0)), F.col("at") + F.col("edits"))))
        .where(F.col("start") + F.col("len") <= F.col("n"))
        .select(F.col("slug").alias("y"), "m", "k", F.col("slug").substr(F.col("start") + 1, F.col("len")).alias("part"))
        .distinct()
    )
    pairs = long_.select("x", "m", "k", "part").join(probes, ["m", "k", "part"]).where("x <> y")
    pairs = pairs.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
    likeness = 1 - F.levenshtein("a", "b") / F.greatest(F.length("a"), F.length("b"))
    return pairs.withColumn("similarity", likeness).where(F.col("similarity") >= least)


def new_entries(resolved: DataFrame) -> DataFrame:
    """Entries that a batch would add: each slug once, proposed by the first path."""
    slug = normalize_slug(F.col("subcategory"))
    rows = resolved.where(~is_forbidden(F.col("subcategory"))).select(F.lower("category").alias("category"), slug.alias("slug"), "path")
    return rows.groupBy("category", "slug").agg(F.min("path").alias("first_path")).withColumn("name", path_title(F.col("slug")))


# -- decisions, logs, chat, tasks ----------------------------------------------------------------


def newest_decisions(decisions: DataFrame, most: int = 25) -> DataFrame:
    """Enabled decisions, newest first."""
    return decisions.where(F.coalesce("enabled", F.lit(1)) != 0).orderBy(F.col("created_at").desc(), F.col("id").desc()).limit(most)


def newest_hints(hints: DataFrame, most: int = 50) -> DataFrame:
    """The newest hints, each text once whatever its case and outer white space."""
    once = hints.groupBy(trimmed(F.lower("hint")).alias("__key")).agg(F.max_by("hint", F.struct("created_at", "id")).alias("hint"), F.max("created_at").alias("created_at"), F.max_by("id", F.struct("created_at", "id")).alias("id"))
    return once.where("__key <> ''").drop("__key").orderBy(F.col("created_at").desc(), F.col("id").desc()).limit(most)


def decision_rules(decisions: DataFrame, most: int = 25) -> DataFrame:
    """Rules on file names learned from decisions, none to a forbidden target."""
    newest = newest_decisions(decisions, most).where(~is_forbidden(F.col("new_subcategory")))
    return newest.select(
        F.explode("rule_keywords").alias("keyword"), F.lit("filename").alias("scope"), F.col("new_category").alias("category"), F.col("new_subcategory").alias("subcategory")
    )


def recent(logs: DataFrame, n: int = 300) -> DataFrame:
    return logs.orderBy(F.col("ts").desc(), F.col("event_id").desc()).limit(n)


def log_sessions(logs: DataFrame) -> DataFrame:
    """Per file: entries, last time, last status, and the last category that was logged, if logs have one."""
    last = F.struct("ts", "event_id")
    named = [F.max_by("category", F.when(F.col("category").isNotNull(), last)).alias("category")] if "category" in logs.columns else []
    return logs.groupBy("filename").agg(
        F.count(F.lit(1)).alias("entries"), F.max("ts").alias("updated_at"), F.max_by("status", last).alias("status"), *named
    )


def last_turns(turns: DataFrame, n: int = 6) -> DataFrame:
    own = Window.partitionBy("conv_id").orderBy(F.col("turn").desc())
    return turns.withColumn("rn", F.row_number().over(own)).where(F.col("rn") <= n).drop("rn")


def last_states(events: DataFrame) -> DataFrame:
    return events.groupBy("task").agg(F.max_by("state", F.struct("ts", "event_id")).alias("state"), F.max("ts").alias("ts"))


def suppressed(messages: DataFrame, seconds: int = 30) -> DataFrame:
    """``key, ts`` of messages shown: the first of a key, then the next one ``seconds`` or more after the last shown.

    Whether a message is shown depends on which one before it was. A gap of ``seconds`` before a message
    settles it whatever came before, so each key falls apart at its gaps into bursts, and only a burst's
    times are walked in order, in batches that Spark sorted. Null times show nothing.
    """
    from folio.functions.bursts import first_shown

    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    rows = messages.select("key", micros.alias("at")).where("at is not null").distinct()
    own = Window.partitionBy("key").orderBy("at")
    gap = F.coalesce(F.col("at") - F.lag("at").over(own) >= seconds * 1_000_000, F.lit(True))
    marked = rows.withColumn("opens", gap)
    shown = marked.sortWithinPartitions("key", "at").mapInArrow(first_shown(seconds * 1_000_000), marked.schema)
    return shown.select("key", F.timestamp_micros("at").alias("ts"))


# -- exports -------------------------------------------------------------------------------------


def registry_json(docs: DataFrame, order: str = "id") -> DataFrame:
    """One JSON document a row and the envelope's counts, for a mirror that is written in parts."""
    return docs.select(order, F.to_json(F.struct(*docs.columns)).alias("json"))


def package(docs: DataFrame, wanted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Documents of the chosen ids with unique names, and the ids that have none."""
    return collision_names(docs.join(wanted, "id", "left_semi"), mark="_"), wanted.join(docs.select("id"), "id", "left_anti")
