"""Markdown tables, chunks and extraction quality.

Line arrays and higher-order functions where a row's lines decide; Arrow-fed functions only where the
order inside a string does (JSON repair, chunking, table repair).
"""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from folio.functions.text import escape_html, trimmed

# What counts as a line of a pipe table, and as its separator.
PIPE_LINE = r"^\s*\|.*\|\s*$"
SEPARATOR = r"^\s*\|(?:\s*:?-+:?\s*\|)+\s*$"


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), r"\r?\n")


def _cells(line: Column) -> Column:
    return F.size(F.split(line, r"\|")) - 2


def fix_tables(text: Column) -> Column:
    """A separator row after a table's first line where there is none."""
    lines = lines_of(text)

    def with_rule(line: Column, i: Column) -> Column:
        opens = line.rlike(PIPE_LINE) & ~F.coalesce(F.get(lines, i - 1).rlike(PIPE_LINE), F.lit(False))
        bare = ~F.coalesce(F.get(lines, i + 1).rlike(SEPARATOR), F.lit(False))
        rule = F.concat(F.lit("|"), F.array_join(F.array_repeat(F.lit(" --- "), _cells(line)), "|"), F.lit("|"))
        return F.when(opens & bare & (_cells(line) > 0), F.array(line, rule)).otherwise(F.array(line))

    return F.array_join(F.flatten(F.transform(lines, with_rule)), "\n")


def table_audit(text: Column) -> Column:
    """``struct(blocks, rows, ragged, headerless, wide)`` over a text's pipe tables.

    A row is ragged if its cells differ in number from its block's first line, a block headerless if its
    second line is no separator, and wide if its header has 14 cells or more.
    """
    zero = F.struct(
        *(F.lit(0).alias(n) for n in ("blocks", "rows", "ragged", "headerless", "wide")), F.lit(0).alias("width"), F.lit(0).alias("at")
    )

    def step(s: Column, line: Column) -> Column:
        pipe, rule = line.rlike(PIPE_LINE), line.rlike(SEPARATOR)
        first, n = pipe & (s["at"] == 0), _cells(line)
        one = lambda c: F.when(c, 1).otherwise(0)
        return F.struct(
            (s["blocks"] + one(first)).alias("blocks"),
            (s["rows"] + one(pipe & ~rule)).alias("rows"),
            (s["ragged"] + one(pipe & ~first & ~rule & (n != s["width"]))).alias("ragged"),
            (s["headerless"] + one(((s["at"] == 1) & ~rule))).alias("headerless"),
            (s["wide"] + one(first & (n >= 14))).alias("wide"),
            F.when(first, n).otherwise(s["width"]).alias("width"),
            F.when(pipe, s["at"] + 1).otherwise(0).alias("at"),
        )

    ended = F.concat(lines_of(text), F.array(F.lit("")))
    return F.aggregate(ended, zero, step, lambda s: F.struct(*(s[n].alias(n) for n in ("blocks", "rows", "ragged", "headerless", "wide"))))


def open_header(text: Column, carried: Column | None = None) -> Column:
    """Header of the table that is still open at the end of a chunk, else null.

    The last line that isn't blank must be a data row, with a header and its separator above it in the same block
    of lines; or the whole chunk is rows that go on with a table whose header was ``carried`` to it.
    """
    lines = lines_of(trimmed(F.coalesce(text, F.lit(""))))
    none, start = F.lit(None).cast("string"), carried if carried is not None else F.lit(None).cast("string")
    zero = F.struct(none.alias("first"), F.lit(0).alias("n"), F.lit(False).alias("ruled"), F.lit(False).alias("data"), start.alias("handed"))

    def step(s: Column, line: Column) -> Column:
        pipe = line.rlike(PIPE_LINE)
        rule = pipe & line.rlike(SEPARATOR)
        n = F.when(pipe, s["n"] + 1).otherwise(0)
        return F.struct(
            F.when(~pipe, none).when(s["n"] == 0, line).otherwise(s["first"]).alias("first"),
            n.alias("n"),
            (pipe & (s["ruled"] | (rule & (s["n"] == 1)))).alias("ruled"),
            (pipe & ~rule).alias("data"),
            F.when(pipe, s["handed"]).alias("handed"),
        )

    end = F.aggregate(lines, zero, step)
    return F.when(end["data"] & end["ruled"] & (end["n"] > 2), end["first"]).when(end["data"] & ~end["ruled"], end["handed"])


def quote_charts(text: Column, cells: int = 14) -> Column:
    """Lines of a table whose header has many cells become a quote."""
    lines = lines_of(text)
    places = F.sequence(F.lit(0), F.size(lines))
    pipe = lambda i: F.coalesce(F.get(lines, i).rlike(PIPE_LINE), F.lit(False))
    opens = F.filter(places, lambda i: pipe(i) & ~pipe(i - 1) & (_cells(F.get(lines, i)) >= cells))
    ends = F.filter(places, lambda i: ~pipe(i))  # the place after the last line is one
    spans = F.transform(opens, lambda i: F.struct(i.alias("first"), F.array_min(F.filter(ends, lambda e: e > i)).alias("end")))
    quoted = lambda line, i: F.when(F.exists(spans, lambda s: (s["first"] <= i) & (i < s["end"])), F.concat(F.lit("> "), line)).otherwise(line)
    return F.array_join(F.transform(lines, quoted), "\n")


def handed_headers(chunks: Column) -> Column:
    """For each chunk that begins with a row the header of the table that the chunks before it leave open, else null."""
    none = F.lit(None).cast("string")
    zero = F.struct(F.array().cast("array<string>").alias("out"), none.alias("header"))

    def step(s: Column, chunk: Column) -> Column:
        handed = F.when(chunk.rlike(r"^\s*\|"), s["header"])
        return F.struct(F.concat(s["out"], F.array(handed)).alias("out"), open_header(chunk, handed).alias("header"))

    return F.aggregate(chunks, zero, step)["out"]


def to_html(text: Column) -> Column:
    """A subset of Markdown as HTML: tables, headings, bold, italic, code, list items, line ends. Anything else is escaped."""
    lines = F.split(escape_html(fix_tables(F.coalesce(text, F.lit("")))), "\n")
    pipe = lambda x: F.coalesce(x.rlike(PIPE_LINE), F.lit(False))

    def row(line: Column, i: Column) -> Column:
        parts = F.split(line, r"\|")
        cells = F.transform(F.slice(parts, 2, F.greatest(F.size(parts) - 2, F.lit(0))), trimmed)
        tagged = lambda t: F.array_join(F.transform(cells, lambda c: F.concat(F.lit(f"<{t}>"), c, F.lit(f"</{t}>"))), "")
        first = ~pipe(F.get(lines, i - 1))
        head = F.concat(F.lit("<table><thead><tr>"), tagged("th"), F.lit("</tr></thead><tbody>"))
        body = F.when(first, head).when(line.rlike(SEPARATOR), "").otherwise(F.concat(F.lit("<tr>"), tagged("td"), F.lit("</tr>")))
        return F.concat(body, F.when(pipe(F.get(lines, i + 1)), "").otherwise("</tbody></table>\n"))

    out = F.array_join(F.transform(lines, lambda x, i: F.when(pipe(x), row(x, i)).otherwise(F.concat(x, F.lit("\n")))), "")
    out = F.regexp_replace(out, "\n$", "")
    for pattern, html in (
        (r"(?m)^### (.*)$", "<h5>$1</h5>"), (r"(?m)^## (.*)$", "<h4>$1</h4>"), (r"(?m)^# (.*)$", "<h3>$1</h3>"), (r"\*\*(.*?)\*\*", "<strong>$1</strong>"),
        (r"\*(.*?)\*", "<em>$1</em>"), (r"`([^`]+)`", "<code>$1</code>"), (r"(?m)^\s*[-*]\s+(.*)$", "<li>$1</li>"), ("\n", "<br>"),
    ):
        out = F.regexp_replace(out, pattern, html)
    return out


def join_chunks(chunks: Column) -> Column:
    """Chunks as one text: a table cut by a chunk's end goes on without a blank line."""

    def add(s: Column, c: Column) -> Column:
        cut = s.rlike(r"\|\s*$") & c.rlike(r"^\s*\|")
        return F.when(s == "", c).otherwise(F.concat(F.regexp_replace(s, r"\s+$", ""), F.when(cut, "\n").otherwise("\n\n"), F.regexp_replace(c, r"^\s+", "")))

    return F.aggregate(chunks, F.lit(""), add)


# -- quality -------------------------------------------------------------------------------------


def _distinct_words(text: Column, least: int = 4) -> Column:
    words = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"([\p{L}\p{N}]+)"), F.lit(1))
    return F.filter(F.array_distinct(words), lambda w: F.length(w) >= least)


def content_recall(raw: Column, markdown: Column) -> Column:
    """Share of the raw text's distinct words that the Markdown keeps; null without any."""
    words = _distinct_words(raw)
    return F.try_divide(F.size(F.array_intersect(words, _distinct_words(markdown))), F.size(words))


def fusion(text: Column) -> Column:
    """``struct(mean_length, long_share, seam_share, suspected)``: words run together by an extraction."""
    words = F.filter(F.split(F.coalesce(text, F.lit("")), r"\s+"), lambda w: w != "")
    n = F.size(words)
    mean = F.try_divide(F.aggregate(words, F.lit(0).cast("long"), lambda s, w: s + F.length(w)), n)
    long_ = F.try_divide(F.size(F.filter(words, lambda w: F.length(w) >= 15)), n)
    seam = F.try_divide(F.size(F.filter(words, lambda w: w.rlike(r"\p{Ll}\p{Lu}"))), n)
    suspected = F.coalesce((mean >= 9) | (long_ >= 0.15) | (seam >= 0.08), F.lit(False))
    return F.struct(mean.alias("mean_length"), long_.alias("long_share"), seam.alias("seam_share"), suspected.alias("suspected"))


def is_thin(text: Column, pages: Column) -> Column:
    """A text layer that says next to nothing, on two pages or more."""
    body = F.coalesce(text, F.lit(""))
    lines = F.array_distinct(F.filter(F.transform(lines_of(body), trimmed), lambda x: x != ""))
    small = (F.length(trimmed(body)) / pages < 100) & (F.size(_distinct_words(body, 1)) / pages < 10)
    same = (F.size(lines) <= 2) & (F.aggregate(lines, F.lit(0), lambda s, x: s + F.length(x)) <= 200)
    return (pages >= 2) & (small | same)


def assess(raw: Column, markdown: Column, least: float = 0.8) -> Column:
    """``struct(ok, reasons)`` of an extraction. Shares and thresholds of noise are ours."""
    body = F.coalesce(markdown, F.lit(""))
    n = F.greatest(F.length(body), F.lit(1))
    audit, recall = table_audit(body), content_recall(raw, body)
    signs = F.length(F.regexp_replace(body, r"[\p{L}\p{N}\s.,;:!?'\"()|-]", ""))
    reasons = F.array_compact(
        F.array(
            F.when(signs / n > 0.3, "noise"),
            F.when(body.contains("\ufffd"), "corruption"),
            F.when(F.exists(lines_of(body), lambda x: x.rlike(r"^\s*\|") & ~x.rlike(r"\|\s*$")), "malformed rows"),
            F.when(audit["ragged"] > 0, "ragged"),
            F.when(audit["headerless"] > 0, "headerless"),
            F.when((recall < least) & ~fusion(raw)["suspected"], "content loss"),
        )
    )
    return F.struct((F.size(reasons) == 0).alias("ok"), reasons.alias("reasons"))


# -- order inside a string -----------------------------------------------------------------------


def repaired_json(text: str | None) -> str | None:
    """The JSON object in a model's answer, closed if it was cut off; null if there is none."""
    body = re.sub(r"```(?:json)?", "", text or "", flags=re.I).strip()
    if "{" not in body:
        return None
    body = body[body.index("{") :]
    bare = lambda s: re.sub(r",\s*([}\]])", r"\1", s)
    end = body.rfind("}")
    try:
        return json.dumps(json.loads(bare(body[: end + 1] if end >= 0 else body)), ensure_ascii=False)
    except ValueError:
        pass
    closers, quoted = [], False
    for m in re.finditer(r'\\.|["{}\[\]]', body, re.S):
        c = m[0]
        if c == '"':
            quoted = not quoted
        elif not quoted and c in "{[":
            closers.append("}" if c == "{" else "]")
        elif not quoted and closers and c == closers[-1]:
            closers.pop()
    try:
        return json.dumps(json.loads(bare(body + '"' * quoted + "".join(reversed(closers)))), ensure_ascii=False)
    except ValueError:
        return None


def chunks_of(text: str | None, size: int = 1400) -> list[str]:
    """Pieces of at most ``size`` characters at line ends; a longer line at white space, else hard."""
    out: list[str] = []
    held = ""
    for line in (text or "").split("\n"):
        while len(line) > size:
            if held:
                out.append(held)
                held = ""
            cut = line.rfind(" ", 1, size + 1)
            cut = cut if cut > 0 else size
            out.append(line[:cut])
            line = line[cut:].lstrip(" ") if line[cut : cut + 1] == " " else line[cut:]
        if held and len(held) + 1 + len(line) > size:
            out.append(held)
            held = line
        else:
            held = f"{held}\n{line}" if held else line
    return [*out, held] if held else out


def repaired_tables(text: str | None) -> str:
    """Rows lose broken ends, tables go on over blank lines and over a heading that cut them, and short headers are filled."""
    lines = (text or "").split("\n")
    rows = [f"|{x.strip().strip('|')}|" if re.match(r"\s*\|", x) and x.count("|") >= 2 and not re.match(PIPE_LINE, x) else x for x in lines]
    out: list[str] = []
    width, gap = 0, []
    for line in rows:
        cells = line.count("|") - 1
        if re.match(PIPE_LINE, line):
            cut = gap and width and all(not g.strip() or g.lstrip().startswith("#") for g in gap)
            if cut and cells == width and not re.match(SEPARATOR, line):
                out += [g for g in gap if g.strip() and not g.lstrip().startswith("#")]
            else:
                out += gap
                if gap or not width:
                    width = 0
            gap = []
            width = width or cells
            out.append(line)
        elif width:
            gap.append(line)
            if line.strip() and not line.lstrip().startswith("#"):
                out, gap, width = out + gap, [], 0
        else:
            out.append(line)
    out += gap
    for i, line in enumerate(out[:-1]):
        if re.match(SEPARATOR, out[i + 1]) and re.match(PIPE_LINE, line):
            short = out[i + 1].count("|") - line.count("|")
            if short > 0:
                out[i] = line.rstrip() + "  |" * short
    return "\n".join(out)


@F.pandas_udf(StringType())
def clean_json(texts: pd.Series) -> pd.Series:
    return texts.map(repaired_json)


@F.pandas_udf(ArrayType(StringType()))
def chunk_text(texts: pd.Series) -> pd.Series:
    return texts.map(chunks_of)


@F.pandas_udf(StringType())
def repair_tables(texts: pd.Series) -> pd.Series:
    return texts.map(repaired_tables)
