"""Path functions: containment, canonical place, file names."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from folio.functions.text import ACCENTED, PLAIN, is_year, stem, trimmed

#: our own list: names that cameras and scanners give
GENERIC_NAME = r"(?i)^(img|image|scan|scanned|photo|dsc|doc|document|file|untitled|page)?[ _-]*\d*(\.[a-z0-9]+)?$"


def is_inside(path: Column, folder: Column) -> Column:
    """Equal to or below a folder; a folder whose name merely begins alike doesn't count."""
    p, d = F.lower(path), F.regexp_replace(F.lower(folder), "/+$", "")
    return (p == d) | p.startswith(F.concat(d, F.lit("/")))


def is_confined(path: Column, roots: tuple[str, ...]) -> Column:
    """Inside one of the folders that callers may name paths in; a path that climbs with ``..`` never is."""
    inside = reduce(lambda a, b: a | b, [is_inside(path, F.lit(r)) for r in roots])
    return F.coalesce(inside & ~path.rlike(r"(^|[/\\])\.\.([/\\]|$)"), F.lit(False))


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, r"[/\\]"), -1)


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))


def folder_of(path: Column) -> Column:
    return F.regexp_replace(path, r"/[^/]*$", "")


def is_generic_name(filename: Column) -> Column:
    return filename.rlike(GENERIC_NAME)


def informed_name(filename: Column, subcategory: Column, title: Column, date: Column) -> Column:
    """``date_Entity_Title.ext`` for a generic file name with a title; any other name stays."""
    entity = F.initcap(F.replace(F.element_at(F.split(subcategory, "/"), -1), F.lit("_"), F.lit(" ")))
    clean = lambda c: F.regexp_replace(F.regexp_replace(F.translate(c, ACCENTED, PLAIN), "[^A-Za-z0-9]+", "_"), "^_+|_+$", "")
    built = F.concat(F.concat_ws("_", date, clean(entity), clean(title)), F.lit("."), extension(filename))
    return F.when(is_generic_name(filename) & (F.coalesce(trimmed(title), F.lit("")) != ""), built).otherwise(filename)


def canonical_path(root: Column, filename: Column, category: Column, subcategory: Column, date: Column, now: Column) -> Column:
    """``root/category/subcategory.../year/file``; the year is the date's, else that of ``now``."""
    cat = F.when(F.coalesce(category, F.lit("")) == "", "other").otherwise(trimmed(F.lower(category)))
    sub = F.when(F.coalesce(subcategory, F.lit("")) == "", "general").otherwise(trimmed(F.lower(subcategory)))
    sub = F.when(is_year(sub), "general").otherwise(sub)
    found = F.regexp_extract(F.coalesce(date, F.lit("")), r"(?<![A-Za-z0-9_])(20\d{2})(?![A-Za-z0-9_])", 1)
    year = F.when(found == "", F.date_format(now, "yyyy")).otherwise(found)
    parts = F.filter(F.split(sub, r"[/\\]+"), lambda p: p != "")
    return F.array_join(F.concat(F.array(root, cat), parts, F.array(year, basename(filename))), "/")


def tree_hint(relative: Column) -> Column:
    """Category and subcategory that a path below the archive suggests."""
    parts = F.split(relative, "/")
    return F.struct(parts[0].alias("category"), F.when(F.size(parts) >= 3, parts[1]).alias("subcategory"))


def title_of(filename: Column) -> Column:
    return trimmed(F.regexp_replace(stem(filename), "[-_]+", " "))


def suffixed(name: Column, n: Column, mark: str = "_dup") -> Column:
    """The n-th file of one name: the first keeps it."""
    return F.when(n == 1, name).otherwise(
        F.concat(F.regexp_replace(name, r"\.[^.]*$", ""), F.lit(mark), (n - 1).cast("string"), F.regexp_extract(name, r"(\.[^.]*)$", 1))
    )
