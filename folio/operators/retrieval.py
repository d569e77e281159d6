"""Ranked retrieval: BM25 with column weights, facets, exclusions and a relaxation ladder in one plan.

``search`` counts a term's frequency inside a row, on its token arrays: a scan without a shuffle, for tables
that are searched once. ``folio.operators.search_index`` stores the postings and reads a request's terms
only. Either way the collection's figures (documents, mean length, document frequencies, the first rung
with a hit) are one aggregated row.
"""

from __future__ import annotations

import math
import warnings
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folio.functions.dates import parse_date
from folio.functions.text import search_tokens, tokens
from folio.plans.query import FACETS, StructuredQuery, ladder, limit_of, plan_with

#: weights of the indexed columns (fixed values)
WEIGHTS = {
    "title": 10.0, "tags": 6.0, "summary": 3.0, "category": 2.0, "subcategory": 2.0, "original_filename": 1.0, "filename": 1.0,
    "original_path": 1.0, "new_path": 1.0, "registre": 1.0, "raw_text": 0.5,
}
K1, B = 1.2, 0.75
#: columns that a request can filter by
FILTERED = ("category", "subcategory", "date", "file_type")


def indexed(docs: DataFrame, weights: dict[str, float] = WEIGHTS) -> dict[str, float]:
    return {c: w for c, w in weights.items() if c in docs.columns and w > 0}


def _tokens(docs: DataFrame, name: str) -> Column:
    column = docs[name]
    if dict(docs.dtypes)[name].startswith("array"):
        column = F.array_join(column, " ")
    return tokens(F.coalesce(column.cast("string"), F.lit("")))


def postings(docs: DataFrame, key: str = "id", weights: dict[str, float] = WEIGHTS) -> DataFrame:
    """``key, column, pos, term`` of every indexed column."""
    parts = [
        docs.select(key, F.lit(c).alias("column"), F.posexplode(_tokens(docs, c)).alias("pos", "term")) for c in indexed(docs, weights)
    ]
    return reduce(DataFrame.unionByName, parts)


def token_lengths(docs: DataFrame, weights: dict[str, float] = WEIGHTS) -> dict[str, Column]:
    """Number of words of each indexed column of a row."""
    return {c: F.size(_tokens(docs, c)) for c in indexed(docs, weights)}


def _frequency(words: Column, term: list[str]) -> Column:
    """Occurrences of a word, or of words in a row, in a token array."""
    if len(term) == 1:
        return F.size(F.filter(words, lambda w: w == term[0]))
    # words between two blanks each, so that neighbouring phrases share none
    text = F.concat(F.lit(" "), F.array_join(words, "  "), F.lit(" "))
    phrase = " " + "  ".join(term) + " "
    return ((F.length(text) - F.length(F.replace(text, F.lit(phrase), F.lit("")))) / len(phrase)).cast("int")


def _words(term: str) -> list[str]:
    import re

    return re.findall(r"[^\W_]+", term.lower())


def request(query: StructuredQuery, relax: bool = False) -> tuple[list[StructuredQuery], dict[str, list[str]]]:
    """The rungs of a request that have a positive term, and each of their terms as words."""
    rungs = ladder(query) if relax else [query] if not query.is_empty() else []
    terms = {t.lower(): _words(t) for q in rungs for f in (*FACETS, "not_terms") for t in q.facet(f)}
    return rungs, {t: w for t, w in terms.items() if w}


def nothing(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], "id long, score double, rung int")


def search(
    docs: DataFrame, query: StructuredQuery, limit: int | None = 10, weights: dict[str, float] = WEIGHTS, k1: float = K1, b: float = B, relax: bool = False
) -> DataFrame:
    """``id, score, rung`` of the best rows, larger scores better, ties to the smaller id, by a scan of ``docs``.

    ``relax``: of the request's rungs the first with a hit counts for all rows. Collection figures cover
    all of ``docs``; filters apply before the limit. Without a limit all rows come, unordered. Where the
    same table is searched again and again, ``search_index`` keeps its postings.
    """
    rungs, terms = request(query, relax)
    columns = indexed(docs, weights)
    if not terms or not columns:
        return nothing(docs.sparkSession)
    names = {t: f"f{i}" for i, t in enumerate(terms)}
    carried = [c for c in FILTERED if c in docs.columns]
    split = docs.select("id", *carried, *(_tokens(docs, c).alias(f"w_{c}") for c in columns))
    length = reduce(lambda x, y: x + y, (F.size(f"w_{c}") for c in columns))
    counts = [
        reduce(lambda x, y: x + y, (_frequency(F.col(f"w_{c}"), w) * F.lit(weight) for c, weight in columns.items())).alias(names[t])
        for t, w in terms.items()
    ]
    return ranked(split.select("id", *carried, length.alias("len"), *counts), query, rungs, names, limit, k1, b)


def ranked(
    table: DataFrame, query: StructuredQuery, rungs: list[StructuredQuery], names: dict[str, str], limit: int | None, k1: float = K1, b: float = B,
    collection: DataFrame | None = None, frequencies: dict[str, int] | None = None,
) -> DataFrame:
    """Scores of rows ``id, len``, filter columns and a weighted frequency a term (``names``).

    ``collection`` is one row ``n, avg`` if ``table`` lacks the rows without any term, and ``frequencies`` are the
    documents that hold each of ``names`` if it lacks some of those, too.
    """

    def has(term: str) -> Column:
        return F.col(names[term.lower()]) > 0 if term.lower() in names else F.lit(False)

    def matches(q: StructuredQuery) -> Column:
        facets = [reduce(lambda x, y: x | y, map(has, q.facet(f))) for f in FACETS if q.facet(f)]
        found = reduce(lambda x, y: x & y, facets)
        excluded = q.facet("not_terms")
        return found & ~reduce(lambda x, y: x | y, map(has, excluded)) if excluded else found

    def weight(q: StructuredQuery, stats: dict[str, Column]) -> Column:
        parts = []
        for t in dict.fromkeys(t.lower() for f in FACETS for t in q.facet(f)):
            if t in names:
                f, df = F.col(names[t]), stats[names[t]]
                idf = F.log(1 + (stats["n"] - df + 0.5) / (df + 0.5))
                parts.append(idf * f * (k1 + 1) / (f + k1 * (1 - b + b * F.col("len") / stats["avg"])))
        return reduce(lambda x, y: x + y, parts, F.lit(0.0))

    level = F.lit(None).cast("int")
    for i, q in reversed(list(enumerate(rungs))):
        level = F.when(matches(q), F.lit(i)).otherwise(level)
    rows = table.withColumn("level", level)
    inside = reduce(lambda x, y: x & y, [_in_filters(query), F.col("level").isNotNull()])
    whole = [F.count(F.lit(1)).alias("s_n"), F.avg("len").alias("s_avg")] if collection is None else []
    stats = rows.agg(
        *whole, F.min(F.when(inside, F.col("level"))).alias("s_rung"), *((F.count_if(F.col(c) > 0) if frequencies is None else F.lit(frequencies[c])).alias(f"s_{c}") for c in names.values())
    )
    if collection is not None:
        stats = stats.crossJoin(collection.select(F.col("n").alias("s_n"), F.col("avg").alias("s_avg")))  # one row each
    joined = rows.where(F.col("level").isNotNull() & _in_filters(query)).crossJoin(F.broadcast(stats))  # one row
    # a row that meets a stricter rung meets the looser ones; only exclusions can set it apart
    of = {"n": F.col("s_n"), "avg": F.col("s_avg")} | {c: F.col(f"s_{c}") for c in names.values()}
    score = F.lit(None).cast("double")
    for i, q in enumerate(rungs):
        score = F.when(F.col("s_rung") == i, F.when(matches(q), weight(q, of))).otherwise(score)
    found = joined.select("id", score.alias("score"), F.col("s_rung").alias("rung")).where("score is not null")
    return found if limit is None else found.orderBy(F.col("score").desc(), "id").limit(limit)


def _in_filters(query: StructuredQuery) -> Column:
    """Exact category, subcategory and file type, inclusive dates; a bound leaves rows without a date out."""
    ok = F.lit(True)
    if query.file_type:
        ok = ok & (F.upper(F.coalesce("file_type", F.lit(""))) == query.file_type.upper())
    if query.category:
        ok = ok & (F.lower("category") == query.category.lower())
    if query.subcategory:
        ok = ok & (F.lower("subcategory") == query.subcategory.lower())
    if query.date_from or query.date_to:
        ok = ok & (F.coalesce("date", F.lit("")) != "")
    if query.date_from:
        ok = ok & (F.col("date") >= query.date_from)
    if query.date_to:
        ok = ok & (F.col("date") <= query.date_to)
    return ok


def token_score(docs: DataFrame, message: str, limit: int = 10) -> DataFrame:
    """Last resort: how many words of the message a record contains, newest first among equals."""
    spark = docs.sparkSession
    words = spark.range(1).select(search_tokens(F.lit(message)).alias("w")).first()["w"]
    if not words:
        return docs.select("id", F.lit(0).alias("score")).limit(0)
    record = F.lower(F.concat_ws(" ", *(docs[c] for c in ("title", "category", "subcategory", "tags", "summary", "raw_text") if c in docs.columns)))
    score = reduce(lambda x, y: x + y, (F.when(record.contains(w), 1).otherwise(0) for w in words))
    rows = docs.select("id", "date", score.alias("score")).where("score > 0")
    return rows.orderBy(F.col("score").desc(), F.col("date").desc(), "id").limit(limit).select("id", "score")


def dedupe_by_period(docs: DataFrame) -> DataFrame:
    """One row a pay period (month of the date), that of the largest id; rows without a date all stay."""
    period = F.when(parse_date(F.col("date")).isNotNull(), F.substring("date", 1, 7)).otherwise(F.concat(F.lit("no-date-"), F.col("id").cast("string")))
    newest = Window.partitionBy("period").orderBy(F.col("id").desc())
    return docs.withColumn("period", period).withColumn("rn", F.row_number().over(newest)).where("rn = 1").drop("rn", "period")


def rerank(hits: DataFrame, limit: int, least: float = 0.15, reranker: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Candidates (``id, score, rank``) by a reranker's ``relevance``; below ``least`` they go, equals keep their rank.

    ``over_fetch(limit)`` candidates are scored, so their scores fit the driver. Without a reranker the order
    stays, and so it does, with a warning, if the reranker fails at any point or doesn't give each candidate one
    number.
    """
    first = hits.orderBy("rank").limit(over_fetch(limit))
    scores = _relevance(first, reranker) if reranker else None
    if scores is None:
        return first.withColumn("relevance", F.lit(1.0)).orderBy("rank").limit(limit)
    scored = first.join(F.broadcast(hits.sparkSession.createDataFrame(scores, f"id {dict(hits.dtypes)['id']}, relevance double")), "id")
    return scored.where(F.col("relevance") >= least).orderBy(F.col("relevance").desc(), "rank").limit(limit)


def _relevance(candidates: DataFrame, reranker: Callable[[DataFrame], DataFrame]) -> list[tuple] | None:
    """One finite number a candidate, or None if the reranker can't give them."""
    try:
        rows = [(r["id"], r["relevance"]) for r in reranker(candidates).select("id", "relevance").collect()]
        wanted = [r["id"] for r in candidates.select("id").collect()]
        if sorted(i for i, _ in rows) != sorted(wanted) or not all(x is not None and math.isfinite(x) for _, x in rows):
            raise ValueError("not one score a candidate")
        return [(i, float(x)) for i, x in rows]
    except Exception as e:  # noqa: BLE001  a reranker may fail in any way, here or in its tasks; the order found stays
        warnings.warn(f"reranker failed, the order stays: {e}", stacklevel=3)
        return None


def over_fetch(limit: int) -> int:
    return max(3 * limit, 30)


def retrieve(docs: DataFrame, message: str, model=None, known_tags: tuple[str, ...] = (), find: Callable[..., DataFrame] | None = None) -> DataFrame:
    """Message to ranked rows: plan, ladder, limit named in the message; one row a pay period; else the word score.

    ``find(query, limit, relax=True)`` searches; by default a scan of ``docs``.
    """
    query = plan_with(message, model, known_tags)
    limit = limit_of(message, query)
    if query.is_empty():
        return token_score(docs, message, limit)
    find = find or (lambda q, n, relax: search(docs, q, n, relax=relax))
    hits = find(query, over_fetch(limit), relax=True)
    found = dedupe_by_period(docs.join(F.broadcast(hits), "id"))  # at most over_fetch(limit) rows
    best = found.orderBy(F.col("score").desc(), "id").limit(limit).select("id", "score")
    return best if best.take(1) else token_score(docs, message, limit)


def search_documents(
    docs: DataFrame, text: str = "", category: str = "", subcategory: str = "", file_type: str = "", limit: int = 20, find: Callable[..., DataFrame] | None = None
) -> DataFrame:
    """The search tool: ranked by all words of ``text``, or newest first without one; filters hold before the limit."""
    words = tuple(_words(text))
    query = StructuredQuery(keywords=words, category=category or None, subcategory=subcategory or None, file_type=file_type or None)
    if not words:
        return docs.where(_in_filters(query)).select("id", "date", F.lit(0.0).alias("score")).orderBy(F.col("date").desc_nulls_last(), "id").limit(limit).select("id", "score")
    find = find or (lambda q, n: search(docs, q, n))
    return find(query, limit).select("id", "score")


def prepare_dossier(docs: DataFrame, dossier: str, limit: int = 15, model=None, find: Callable[..., DataFrame] | None = None) -> DataFrame:
    """Documents for a dossier, best first, by the engine that answers messages: ``id, title, category, subcategory, date, score``."""
    hits = retrieve(docs, dossier, model, find=find).orderBy(F.col("score").desc(), "id").limit(limit)
    columns = [c for c in ("title", "category", "subcategory", "date") if c in docs.columns]
    return docs.select("id", *columns).join(F.broadcast(hits), "id")  # at most limit rows


def prompt_context(docs: DataFrame, hits: DataFrame, chars: int = 800, most: int = 50) -> DataFrame:
    """The best hits (at most ``most``, the bound of a request's limit) as one text for a prompt, best first."""
    best = hits.orderBy(F.col("score").desc(), "id").limit(most)
    rows = docs.join(F.broadcast(best), "id").select(
        F.struct((-F.col("score")).alias("o"), F.concat_ws("\n", F.concat(F.lit("#"), F.col("id").cast("string"), F.lit(" "), F.col("title")), F.substring("raw_text", 1, chars)).alias("t")).alias("x")
    )
    return rows.agg(F.array_join(F.transform(F.sort_array(F.collect_list("x")), lambda x: x["t"]), "\n\n").alias("context"))


def cited(hits: DataFrame, answer: Column, least: int) -> DataFrame:
    """Hits that an answer names (``#id``); if it names fewer than ``least``, the best others make up the number."""
    named = F.array_contains(F.regexp_extract_all(F.coalesce(answer, F.lit("")), F.lit(r"#(\d+)"), F.lit(1)), F.col("id").cast("string"))
    marked = hits.withColumn("cited", named)
    order = F.row_number().over(Window.orderBy(F.col("cited").desc(), F.col("score").desc(), "id"))  # hits of one request
    return marked.withColumn("place", order).where(F.col("cited") | (F.col("place") <= least))


def with_embedding(docs: DataFrame, embed: Callable[[Column], Column], chars: int = 1000) -> DataFrame:
    """``embedding`` of the first characters by ``embed``, a column function; what it can't embed gets an empty one."""
    found = embed(F.substring(F.coalesce("raw_text", F.lit("")), 1, chars)).cast("array<float>")
    return docs.withColumn("embedding", F.coalesce(found, F.array().cast("array<float>")))


def evaluate(retrieved: DataFrame, expected: DataFrame) -> DataFrame:
    """``query, precision, recall, reciprocal_rank`` from ``retrieved(query, id, rank)`` and ``expected(query, id)``."""
    wanted = expected.groupBy("query").agg(F.count(F.lit(1)).alias("wanted"))
    marks = retrieved.join(expected.withColumn("hit", F.lit(1)), ["query", "id"], "left")
    got = marks.groupBy("query").agg(
        F.count(F.lit(1)).alias("got"), F.count("hit").alias("hits"), F.min(F.when(F.col("hit") == 1, F.col("rank"))).alias("first")
    )
    return wanted.join(got, "query", "full_outer").select(
        "query",
        F.coalesce(F.col("hits") / F.col("got"), F.lit(0.0)).alias("precision"),
        F.when(F.coalesce("wanted", F.lit(0)) == 0, 1.0).otherwise(F.coalesce("hits", F.lit(0)) / F.col("wanted")).alias("recall"),
        F.coalesce(1 / F.col("first"), F.lit(0.0)).alias("reciprocal_rank"),
    )


def regressed(summary: dict[str, float], baseline: dict[str, float], slack: float = 0.001) -> list[str]:
    """Measures that fell below the baseline."""
    return [k for k, v in baseline.items() if summary.get(k, 0.0) < v - slack]
