"""Spelling variants: letter-parity bit masks in three bands, joined on equal bands, then verified (op 12).

A word's mask has a bit a letter, set when the letter stands in it an odd number of times. One inserted, deleted
or replaced letter flips two bits at most, so of three bands one stays equal. Letters are dealt to the bands in
turn by how often they occur, so that no band is emptier than the others. Words meet on an equal band, equal or
neighbouring lengths, and an equal first or last half of the shorter one, since one edit leaves one of the two
alone; a pair counts in the first band and at the first end that it shares, so none is met twice.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folio.llm.common import staged, unstaged

BANDS = 3
BITS = 30
LETTERS = 256
LEAST_LETTERS = 5
LEAST_TIMES = 3
EVERY = 97
#: each link at least doubles the occurrences, which are fewer than 2 to the 63
DOUBLINGS = 6


def word_runs(docs: DataFrame) -> DataFrame:
    """``doc_id, run`` of every maximal run of Latin letters, A-Z in lower case."""
    capitals = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    runs = F.regexp_extract_all(docs["text"].cast("string"), F.lit(r"([A-Za-zÀ-ÿ]+)"), F.lit(1))
    exploded = docs.select(docs["doc_id"].cast("string").alias("doc_id"), F.explode(runs).alias("run"))
    ascii_only = F.octet_length("run") == F.length("run")
    lower = F.when(ascii_only, F.lower("run")).otherwise(F.translate("run", capitals, capitals.lower()))
    return exploded.select("doc_id", lower.alias("run"))


def with_slips(runs: DataFrame, every: int = EVERY) -> DataFrame:
    """``word``: the run, without one letter where ``every`` divides the checksum of the document's id and the run."""
    h = F.crc32(F.concat_ws(":", F.coalesce("doc_id", F.lit("")), "run").cast("binary"))
    at = (F.col("h") % F.length("run")).cast("int")
    cut = F.concat(F.col("run").substr(F.lit(1), at), F.col("run").substr(at + 2, F.length("run")))
    return runs.withColumn("h", h).select(F.when(F.col("h") % every == 0, cut).otherwise(F.col("run")).alias("word"))


def word_counts(docs: DataFrame, least_letters: int = LEAST_LETTERS, least_times: int = LEAST_TIMES, every: int = EVERY) -> DataFrame:
    """``word, n`` of the words that are long and frequent enough; a map task adds up its own first."""
    words = with_slips(word_runs(docs), every).where(F.length("word") >= least_letters)
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least_times)


def letter_places(words: DataFrame) -> list[int]:
    """The place of each letter (code point modulo ``LETTERS``) when the vocabulary's letters are ranked by frequency; ``LETTERS`` rows at most."""
    letters = words.select(F.explode(F.split("word", "")).alias("c")).where("c <> ''")
    rows = letters.groupBy((F.ascii("c") % LETTERS).alias("c")).agg(F.count(F.lit(1)).alias("n")).collect()
    seen = sorted(rows, key=lambda r: (-r["n"], r["c"]))
    rest = sorted(set(range(LETTERS)) - {r["c"] for r in rows})
    places = [0] * LETTERS
    for i, c in enumerate([*(r["c"] for r in seen), *rest]):
        places[c] = i
    return places


def parity_bands(word: Column, places: list[int]) -> list[Column]:
    """``BANDS`` whole numbers of ``BITS`` bits. Two letters may share a bit; an edit then flips fewer."""
    letters = F.split(word, "")

    def band(b: int) -> Column:
        bits = F.array(*(F.lit(1 << (p // BANDS) % BITS if p % BANDS == b else 0) for p in places))
        return F.aggregate(letters, F.lit(0), lambda mask, c: mask.bitwiseXOR(F.get(bits, F.ascii(c) % LETTERS)))

    return [band(b) for b in range(BANDS)]


def near_pairs(words: DataFrame) -> DataFrame:
    """``a, n_a, b, n_b``: pairs of words, each once, that one inserted, deleted or replaced letter parts.

    ``words(word, n)`` are distinct and have two letters or more.
    """
    places = letter_places(words)
    masks = words.select("word", "n", F.length("word").alias("len"), *(m.alias(f"m{b}") for b, m in enumerate(parity_bands(F.col("word"), places))))
    masks = staged(masks, "masks")
    spots = F.explode(F.array(*(F.struct(F.lit(b).alias("band"), F.lit(e).alias("end"), F.col(f"m{b}").alias("value")) for b in range(BANDS) for e in (0, 1))))
    columns = ["word", "n", "len", *(f"m{b}" for b in range(BANDS))]
    keys = ["size", "end", "half", "band", "value"]
    # ``size`` is the shorter word's length: the longer one looks for both that it may meet
    half = F.when(F.col("end") == 0, F.col("word").substr(F.lit(1), F.floor(F.col("size") / 2).cast("int"))).otherwise(
        F.col("word").substr((-F.floor(F.col("size") / 2)).cast("int"), F.col("size"))
    )

    def spread(rows: DataFrame) -> DataFrame:
        return rows.withColumn("spot", spots).select("spot.*", "size", *columns).withColumn("half", half)

    x = spread(masks.withColumn("size", F.col("len"))).alias("x")
    y = spread(masks.withColumn("size", F.explode(F.array(F.col("len"), F.col("len") - 1)))).alias("y")
    on = [F.col(f"x.{k}") == F.col(f"y.{k}") for k in keys]
    apart = [F.col(f"x.m{b}").bitwiseXOR(F.col(f"y.m{b}")) for b in range(BANDS)]
    flips = F.bit_count(apart[0])
    for other in apart[1:]:
        flips = flips + F.bit_count(other)
    once = (F.col("x.len") < F.col("y.len")) | (F.col("x.word") < F.col("y.word"))
    earlier = F.lit(False)
    for b in range(BANDS - 1):
        earlier = earlier | ((F.col("x.band") > b) & (apart[b] == 0))
    start = lambda side: F.col(f"{side}.word").substr(F.lit(1), F.floor(F.col("x.size") / 2).cast("int"))
    earlier = earlier | ((F.col("x.end") == 1) & (start("x") == start("y")))
    met = x.join(y, on).where((flips <= 2) & once & ~earlier & (F.levenshtein("x.word", "y.word", 1) == 1))
    return met.select(F.col("x.word").alias("a"), F.col("x.n").alias("n_a"), F.col("y.word").alias("b"), F.col("y.n").alias("n_b"))


def roots(links: DataFrame) -> DataFrame:
    """``word, root`` of ``links(word, form)``: forms followed to the last, by doubling."""
    now = staged(links.select("word", F.col("form").alias("root")), "roots")
    for _ in range(DOUBLINGS):
        step = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        ahead = now.join(step, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved"))
        last, now = now, staged(ahead, "roots")
        unstaged(last)
        if now.where("moved").isEmpty():
            break
    return now.select("word", "root")


def grouped_variants(words: DataFrame, times: int = 2) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` of ``words(word, n)``, distinct words of two letters or more.

    A word's form is its near word of largest ``n`` (ties: smallest word) if that is ``times`` the word's own.
    Null words are left out; without words there are no rows.
    """
    words = staged(words.where("word is not null").select("word", F.col("n").cast("long").alias("n")), "words")
    pairs = near_pairs(words)
    both = pairs.select(F.explode(F.array(F.struct(F.col("a").alias("word"), F.col("b").alias("near"), F.col("n_b").alias("m")), F.struct(F.col("b").alias("word"), F.col("a").alias("near"), F.col("n_a").alias("m")))).alias("p")).select("p.*")
    best = both.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("m")).alias("m"), "near")).alias("best"))
    taken = -F.col("best.m") >= times * F.col("n")
    out = words.join(best, "word", "left").select(
        "word", F.when(taken, F.col("best.near")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(taken, -F.col("best.m")).alias("form_n")
    )
    out = staged(out, "forms")
    followed = roots(out.where("form is not null"))
    return out.join(followed, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def spelling_variants(docs: DataFrame) -> DataFrame:
    """Variants among the words of ``docs(doc_id, text)``: whole texts, with one letter in ``EVERY`` runs dropped as a slip.

    A null text has no words, a null ``doc_id`` counts as an empty name, repeated rows count again, and other
    columns are not looked at.
    """
    return grouped_variants(word_counts(docs))
