"""Configuration sources, sinks that replace, names that overwrite nothing, and rules from data."""

import json

from pyspark.sql import functions as F

from folio.functions import markdown, paths
from folio.operators import registry_ops as ops
from folio.operators import rules
from folio.schema import DECISIONS
from folio.sources import files, versions


def test_json_sources(spark, tmp_path):
    def write(name, value):
        (tmp_path / name).write_text(json.dumps(value))
        return str(tmp_path / name)

    overlay = write("o.json", {"priorityRules": [{"keywords": ["AB1"], "category": "bank", "subcategory": "x", "scope": "filename"}, {"keywords": ["z"], "category": "c"}]})
    rows = [r.asDict() for r in files.read_overlay(spark, overlay).orderBy("id").collect()]
    assert [(r["keywords"], r["category"], r["scope"]) for r in rows] == [(["AB1"], "bank", "filename"), (["z"], "c", None)]
    made = rules.overlay_rules(rows)
    assert [(r.priority, r.scope, r.keywords, r.overlay) for r in made] == [(-2, "filename", ("ab1",), True), (-1, "both", ("z",), True)]
    decisions = files.read_decisions(spark, write("d.json", [{"id": 1, "new_category": "c", "rule_keywords": ["k"], "enabled": 0}]))
    assert decisions.schema == DECISIONS and decisions.first()["rule_keywords"] == ["k"]
    assert files.read_hints(spark, write("h.json", [{"id": 3, "hint": "x"}])).first()["hint"] == "x"
    assert {r["key"]: r["value"] for r in files.read_settings(spark, write("s.json", {"a": 1, "b": "t"})).collect()} == {"a": "1", "b": "t"}
    assert files.read_rows(spark, write("r.json", {"rows": [{"v": 1}, {"v": 2}]}), "v: INT", "rows").count() == 2


def test_published_tables_replace_each_other(spark, tmp_path):
    path = str(tmp_path / "out")
    for n in (1, 3):
        versions.publish(spark, path, lambda to, n=n: spark.range(n).write.parquet(to), keep=1)
        assert spark.read.parquet(versions.current(spark, path)).count() == n
    assert len([p for p in (tmp_path / "out").iterdir() if not p.name.startswith("_")]) == 1


def test_nothing_is_overwritten(spark):
    moves = spark.createDataFrame([(1, "/a/x.pdf"), (2, "/a/X.pdf"), (3, "/a/y.pdf"), (4, "/a/noext")], "id long, target string")
    there = spark.createDataFrame([("/a/Y.PDF",), ("/a/noext",), ("/a/noext",)], "path string")
    placed = {r["id"]: r["placed"] for r in ops.without_overwrite(moves, there, F.to_timestamp(F.lit("2024-06-30 01:02:03"))).collect()}
    assert placed == {1: "/a/x.pdf", 2: "/a/X_1.pdf", 3: "/a/y_20240630010203.pdf", 4: "/a/noext_20240630010203"}


def test_confinement(value):
    inside = lambda p: value(paths.is_confined(F.lit(p), ("/archive", "/input")))
    assert [inside(p) for p in ("/archive", "/Input/x", "/archive2/x", "/archive/a/../b", "/archive/a..b")] == [True, True, False, False, True]


def test_catalogue_covers_its_signals(value):
    found = lambda body: (lambda r: (r["category"], r["subcategory"]) if r else None)(value(rules.first_rule(F.lit(body), F.lit("f.pdf"), rules.DEFAULT_RULES)))
    assert found("Checking Account, opening balance") == ("bank", None) and found("form W-2 for 2023") == ("administrative", "impot")
    assert found("Gross pay and net pay") == ("bulletin_salaire", None) and found("Carte Vitale") == ("identity", "carte_vitale")
    assert found("taxe foncière") is None and found("taxe foncière, dgfip") == ("administrative", "impot")
    assert found("Relevé de compte, avis d'impôt") == ("bank", None)
    assert len({r.priority for r in rules.DEFAULT_RULES}) == len(rules.DEFAULT_RULES)


def test_large_dictionaries_and_taxonomies(spark):
    """2,700 surfaces and 150 entries: one plan, no code that grows with them."""
    dictionary = {"banks": [{"slug": f"s{i}", "name": f"Brand {i} & Co", "aliases": [f"b-{i}", "&&"]} for i in range(1350)]}
    taxonomy = [{"id": f"c{i}", "aliases": [], "subcategories": [{"id": f"entry_{i}_name", "aliases": [f"alias{i}x"]}]} for i in range(150)]
    docs = spark.range(200).select("id", F.concat(F.lit("about brand "), F.col("id").cast("string"), F.lit(" & co; x")).alias("t"))
    got = docs.select("id", rules.first_entity(F.col("t"), dictionary)["slug"].alias("s"), rules.placement_guard(F.lit("c1"), F.concat(F.lit("entry_"), F.col("id").cast("string"), F.lit("_name")), taxonomy, [])["category"].alias("c")).collect()
    assert all(r["s"] == f"s{r['id']}" for r in got) and all(r["c"] == (f"c{r['id']}" if r["id"] < 150 else "c1") for r in got)


def test_markup(value):
    assert value(markdown.to_html(F.lit(None).cast("string"))) == "" and value(markdown.to_html(F.lit("# a\nb & c"))) == "<h3>a</h3><br>b &amp; c"
    many = "| c " * 14 + "|\n| x |\n\n" + "| d |"
    assert value(markdown.quote_charts(F.lit(many))).split("\n") == ["> " + "| c " * 14 + "|", "> | x |", "", "| d |"]
