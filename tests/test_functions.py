"""Case tables of the scalar functions."""

import pytest
from pyspark.sql import functions as F

from folio.functions import dates, geometry, markdown, paths, text

W, H = 400, 300


@pytest.mark.parametrize("raw,want", [("2023", True), (" 2023 ", True), ("20233", False), ("abcd", False), (None, False)])
def test_year(value, raw, want):
    assert value(text.is_year(F.lit(raw))) is want


@pytest.mark.parametrize(
    "raw,want",
    [("general", True), ("GENERAL", True), ("other", True), ("divers", True), ("2023", True), ("", True), ("  ", True), (None, True)]
    + [("sfr", False), ("img001.jpg", True), ("12345", True), ("CamScanner 01", True), ("credit_mutuel", False)],
)
def test_forbidden(value, raw, want):
    assert value(text.is_forbidden(F.lit(raw).cast("string"))) is want


@pytest.mark.parametrize(
    "file,cat,sub,date,want",
    [
        ("facture.pdf", "invoices", "sfr", "2024-05-12", "root/invoices/sfr/2024/facture.pdf"),
        ("/in/doc.pdf", "", "", "", "root/other/general/2024/doc.pdf"),
        ("doc.pdf", "invoices", "foo/bar", "2024-01-01", "root/invoices/foo/bar/2024/doc.pdf"),
        ("doc.pdf", "invoices", "2021", "2019-01-01", "root/invoices/general/2024/doc.pdf"),
    ],
)
def test_canonical_path(value, file, cat, sub, date, want):
    date = "2024-02-02" if date == "2019-01-01" else date
    got = paths.canonical_path(F.lit("root"), *(F.lit(x) for x in (file, cat, sub, date)), F.to_date(F.lit("2024-06-30")))
    assert value(got) == want


def test_informed_name(value):
    name = lambda f: value(paths.informed_name(F.lit(f), F.lit("sfr"), F.lit("Facture Mai"), F.lit("2024-05-12")))
    assert "2024-05-12_Sfr_Facture" in name("img001.jpg") and name("contrat_edf.pdf") == "contrat_edf.pdf"


def test_inside(value):
    inside = lambda p, d: value(paths.is_inside(F.lit(p), F.lit(d)))
    assert inside("/a/__archive/x", "/A/__archive") and inside("/a", "/a") and not inside("/a/__archive_old/x", "/a/__archive")


@pytest.mark.parametrize(
    "slug,body,file,want",
    [
        ("veolia", "veolia", "veolia_invoice.pdf", False),
        ("veolia", "Veolia ... VEOLIA", "veolia_invoice.pdf", True),
        ("france_travail", "Contact France Travail", "doc.pdf", True),
        ("facture", "facture facture", "x.pdf", False),
        ("c++", "see c++ here", "x.pdf", True),
        ("ab", "ab ab", "x.pdf", False),
    ],
)
def test_grounded(value, slug, body, file, want):
    assert value(text.is_grounded(F.lit(slug), F.lit(body), F.lit(file))) is want


def test_grounded_denies_names(value):
    assert value(text.is_grounded(F.lit("jane_doe"), F.lit("Jane Doe"), F.lit("x.pdf"), ["Doe"])) is False


def test_strings(value):
    lit = F.lit
    assert value(text.normalize_slug(lit("  Crédit Mutuel! "))) == "cr_dit_mutuel"
    assert value(text.strip_date_tail(lit("sfr_202405"))) == "sfr" and value(text.strip_date_tail(lit("2024"))) == "general"
    assert value(text.title_case(lit("credit_muTuel"))) == "Credit MuTuel"
    assert value(text.path_title(lit("a_b/c"))) == "A B ➔ C"
    assert value(text.sanitize_segment(lit("Société Générale"), "x")) == "societe_generale" and value(text.sanitize_segment(lit("!!"), "x")) == "x"
    assert value(text.clean_text(lit("a\r\nb\n\n\n\nc long enough\x00"))) == "a\nb\n\nc long enough" and value(text.clean_text(lit(" short "))) == ""
    assert value(text.escape_html(lit("<a href=\"x\">'&"))) == "&lt;a href=&quot;x&quot;&gt;&#039;&amp;"
    assert value(text.file_type(lit("a.XLSX"))) == "EXCEL" and value(text.file_type(lit("a"))) is None
    assert value(text.natural_key(lit("IMG_2"))) < value(text.natural_key(lit("IMG_10")))
    assert value(text.edit_similarity(lit("abcd"), lit("abce"))) == 0.75
    assert value(text.rule_keywords(lit("FAC2024-77B_edf.pdf"), lit("La facture EDF 2024"))) == ["fac2024", "77b", "facture", "edf"]


def test_dates(value):
    day = F.to_date(F.lit("2024-06-30"))
    found = lambda s: value(dates.extract_date(F.lit(s), day))
    assert found("paye 01/03/2023") == "2023-03-01" and found("Facture SFR 20240512") == "2024-05-12"
    assert found("le 2022/01/31 et 20230101") == "2023-01-01" and found("rien") == "2024-06-30"
    bucket = lambda s: value(dates.expiry_bucket(F.lit(s), day))
    assert [bucket(s) for s in ("2024-06-29", "2024-06-30", "2024-08-29", "2024-08-30", "x", "")] == ["expired", "soon", "soon", "valid", None, None]
    assert value(dates.reconcile_date(F.lit("2029-03-01"), F.lit("Avis 2023"), day)) == "2023-03-01"
    assert value(dates.reconcile_date(F.lit("2023-03-01"), F.lit("Avis 2021"), day)) == "2023-03-01"
    assert [value(dates.format_bytes(F.lit(n))) for n in (0, 1024, 1536, 1234567)] == ["0 B", "1 KB", "1.5 KB", "1.18 MB"]
    assert str(value(dates.money(F.lit("1 250,50 €")))) == "1250.50" and str(value(dates.money(F.lit("1,250.50 €")))) == "1250.50"


def quad(*points):
    return F.array(*(geometry.point(float(x), float(y)) for x, y in points))


def rows(found):
    return [(p["x"], p["y"]) for p in found]


def test_quads(value):
    full = geometry.full_frame(W, H)
    assert value(geometry.is_full_frame(geometry.rotated(full, H), H, W))
    corner = quad((0, 0), (200, 0), (200, 150), (0, 150))
    assert tuple(value(geometry.bounds(geometry.rotated(corner, H), H, W))) == (150.0, 0.0, 150.0, 200.0)
    start = quad((10, 20), (300, 15), (310, 250), (5, 260))
    q, w, h = start, W, H
    for _ in range(4):
        q, w, h = geometry.rotated(q, h), h, w
    assert rows(value(q)) == rows(value(start))
    assert value(geometry.contains(corner, 10.0, 10.0)) and not value(geometry.contains(corner, 390.0, 10.0))
    assert rows(value(geometry.moved(corner, -50.0, 1000.0, W, H)))[0] == (0.0, 150.0)
    assert rows(value(geometry.corner_moved(corner, 2, 500.0, 10.0, W, H)))[2] == (400.0, 160.0)
    assert rows(value(geometry.edge_moved(corner, 1, 20.0, 9.0, W, H)))[1:3] == [(220.0, 0.0), (220.0, 150.0)]
    handle = lambda x, y: value(geometry.handle_at(corner, float(x), float(y)))
    assert [handle(1, 1), handle(100, 2), handle(100, 75), handle(399, 299)] == ["c0", "e0", "move", "none"]


def test_boxes_and_levels(value):
    box = lambda *v: F.struct(*(F.lit(float(x)).alias(n) for x, n in zip(v, ("x", "y", "width", "height"), strict=True)))
    assert value(geometry.iou(box(0, 0, 10, 10), box(5, 0, 10, 10))) == pytest.approx(1 / 3)
    counts = value(geometry.histogram(F.array(*(F.lit(v) for v in (0, 10, 10, 255)))))
    assert counts[10] == 2 and sum(counts) == 4
    levels = F.array(*(F.lit(v) for v in [20] * 50 + [200] * 50))
    assert tuple(value(geometry.clip_points(geometry.histogram(levels)))) == (20, 200)
    assert value(geometry.leveled(F.array(F.lit(20), F.lit(110), F.lit(250)), F.lit(20), F.lit(200))) == [0, 128, 255]


def test_markdown_tables(value):
    bare = "a\n| x | y |\n| 1 | 2 |\nb"
    fixed = value(markdown.fix_tables(F.lit(bare)))
    assert fixed == "a\n| x | y |\n| --- | --- |\n| 1 | 2 |\nb" and value(markdown.fix_tables(F.lit(fixed))) == fixed
    assert tuple(value(markdown.table_audit(F.lit("| a | b |\n| --- | --- |\n| 1 |\n\n| h |\n| 2 |")))) == (2, 4, 1, 1, 0)
    opened = lambda text: value(markdown.open_header(F.lit(text)))
    assert opened("x\n| a |\n|---|\n| b |\n\n") == "| a |" and opened("| a |\n|---|\n| b |\nx") is None
    assert opened("x\n| a |\n| b |") is None and opened("| a |\n|---|") is None and opened("| a |\n|---|\n| b |\n\n| c |") is None
    handed = lambda *chunks: value(markdown.handed_headers(F.array(*map(F.lit, chunks))))
    assert handed("t\n| a |\n|---|\n| 1 |", "| 2 |\n| 3 |\n", "\n| 4 |\nend", "| 5 |") == [None, "| a |", "| a |", None]
    assert handed("t\n| a |\n| 1 |", "| 2 |", "| 3 |") == [None, None, None]
    assert handed("| a |\n|---|\n| 1 |", "| b |\n|---|\n| 2 |", "| 3 |") == [None, "| a |", "| b |"]
    assert handed("| a |\n|---|\n| 1 |", "text\n| 2 |", "| 3 |") == [None, None, None]
    wide = "|" + " x |" * 14
    assert value(markdown.quote_charts(F.lit(f"{wide}\n| 1 |\nz"))) == f"> {wide}\n> | 1 |\nz"
    assert value(markdown.join_chunks(F.array(F.lit("| a |"), F.lit("| b |"), F.lit("t")))) == "| a |\n| b |\n\nt"


def test_quality(value):
    assert value(markdown.content_recall(F.lit("alpha beta gamma"), F.lit("beta alpha"))) == pytest.approx(2 / 3)
    assert value(markdown.fusion(F.lit("thisIsFusedTextForSure anotherFusedWordHere"))["suspected"])
    assert value(markdown.is_thin(F.lit("scan\nscan"), F.lit(3))) and not value(markdown.is_thin(F.lit("scan"), F.lit(1)))
    got = value(markdown.assess(F.lit("alpha beta gamma delta"), F.lit("alpha �")))
    assert not got["ok"] and got["reasons"] == ["corruption", "content loss"]


@pytest.mark.parametrize(
    "raw,want",
    [
        ('{"titre": "Test", "tags": ["a", "b"', '{"titre": "Test", "tags": ["a", "b"]}'),
        ('```json\n{"a": 1,}\n``` done', '{"a": 1}'),
        ('say {"a": "x \\" y', '{"a": "x \\" y"}'),
        ("nothing", None),
        (None, None),
    ],
)
def test_json_repair(raw, want):
    assert markdown.repaired_json(raw) == want


def test_chunks_and_table_repair():
    body = "\n".join(["word " * 40] * 30) + "\n" + "x" * 3000
    chunks = markdown.chunks_of(body)
    assert max(map(len, chunks)) <= 1400 and "".join("".join(chunks).split()) == "".join(body.split())
    assert markdown.chunks_of("") == [] and markdown.chunks_of(None) == []
    assert markdown.repaired_tables("| a | b |\n| --- | --- |\n\n| 1 | 2 |") == "| a | b |\n| --- | --- |\n| 1 | 2 |"
    assert markdown.repaired_tables("| a |\n| --- | --- |") == "| a |  |\n| --- | --- |"


def test_histogram_counts_whole_levels(spark):
    rows = spark.createDataFrame([([0, 0, 255, None, 256, -1],), ([],), (None,)], "levels array<int>")
    counts = [r["h"] for r in rows.select(geometry.histogram("levels").alias("h")).collect()]
    assert all(len(c) == 256 for c in counts) and counts[0][0] == 2 and counts[0][255] == 1 and [sum(c) for c in counts] == [3, 0, 0]
