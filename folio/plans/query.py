"""Search requests: validation, heuristic planning, compilation to columns and text, relaxation."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, replace

from folio.functions.text import STOPWORDS

FACETS = ("doc_types", "entities", "keywords")

# Number words that a message may ask with.
NUMBER_WORDS = {
    "deux": 2, "trois": 3, "quatre": 4, "cinq": 5, "six": 6, "sept": 7, "huit": 8, "neuf": 9, "dix": 10,
    "two": 2, "three": 3, "four": 4, "five": 5, "seven": 7, "eight": 8, "nine": 9, "ten": 10,
}
SINGLE_WORDS = ("single", "last", "dernier", "dernière")


@dataclass(frozen=True)
class StructuredQuery:
    """Facets of terms (any of a facet, all facets, none of ``not_terms``), filters and a limit of 1 to 50."""

    doc_types: tuple[str, ...] = ()
    entities: tuple[str, ...] = ()
    keywords: tuple[str, ...] = ()
    not_terms: tuple[str, ...] = ()
    category: str | None = None
    subcategory: str | None = None
    date_from: str | None = None
    date_to: str | None = None
    limit: int | None = None
    file_type: str | None = None

    @classmethod
    def parse(cls, raw: dict) -> StructuredQuery:
        """From loose input: non-strings leave term lists, null means absent, strings are trimmed, the limit is bounded."""
        terms = {
            ours: tuple(t.strip() for t in (raw.get(theirs) or []) if isinstance(t, str))
            for ours, theirs in (("doc_types", "docTypes"), ("entities", "entities"), ("keywords", "keywords"), ("not_terms", "notTerms"))
        }
        texts = {}
        for ours, theirs in (("category", "category"), ("subcategory", "subcategory"), ("date_from", "dateFrom"), ("date_to", "dateTo"), ("file_type", "fileType")):
            value = raw.get(theirs)
            texts[ours] = value.strip() or None if isinstance(value, str) else None
        limit = raw.get("limit")
        try:
            limit = None if limit is None else int(float(limit))
        except (TypeError, ValueError):
            limit = None
        return cls(**terms, **texts, limit=None if limit is None else max(1, min(50, limit)))

    def facet(self, name: str) -> tuple[str, ...]:
        """Terms that hold a letter or digit, trimmed, each once whatever its case."""
        kept: dict[str, str] = {}
        for term in map(str.strip, getattr(self, name)):
            if re.search(r"[^\W_]", term):
                kept.setdefault(term.lower(), term)
        return tuple(kept.values())

    def is_empty(self) -> bool:
        return not any(self.facet(f) for f in FACETS)


def match_text(query: StructuredQuery) -> str | None:
    """The request as a phrase expression, for display; null without a positive term."""

    def any_of(terms):
        return "(" + " OR ".join('"' + t.replace('"', '""') + '"' for t in terms) + ")"

    facets = [any_of(query.facet(f)) for f in FACETS if query.facet(f)]
    if not facets:
        return None
    positive, excluded = " AND ".join(facets), query.facet("not_terms")
    return f"({positive}) NOT {any_of(excluded)}" if excluded else positive


def plan(message: str, known_tags: tuple[str, ...] = ()) -> StructuredQuery:
    """Without a model: years become a range, known tags entities, other words keywords."""
    tags = {t.lower() for t in known_tags}
    entities, keywords, years = [], [], None
    for word in re.split(r"[\s,.;:!?/\\'\"()\[\]]+", message.lower()):
        if re.fullmatch(r"\d{4}", word) and 1950 <= int(word) <= 2100:
            years = word
        elif len(word) > 2 and word not in STOPWORDS:
            (entities if word in tags else keywords).append(word)
    return StructuredQuery(
        entities=tuple(entities),
        keywords=tuple(keywords),
        date_from=f"{years}-01-01" if years else None,
        date_to=f"{years}-12-31" if years else None,
    )


def plan_with(message: str, model: Callable[[str], dict] | None = None, known_tags: tuple[str, ...] = ()) -> StructuredQuery:
    """By a model if one is given and gives something; by the heuristic on an error or an empty plan."""
    if model is not None:
        try:
            found = StructuredQuery.parse(model(message))
            if not found.is_empty():
                return found
        except Exception:  # noqa: BLE001  a model may fail in any way; the search goes on without it
            pass
    return plan(message, known_tags)


def relaxed(query: StructuredQuery) -> StructuredQuery | None:
    """One step looser: without keywords, then exclusions, then entities; then null. Filters stay."""
    for name in ("keywords", "not_terms", "entities"):
        if getattr(query, name):
            return replace(query, **{name: ()})
    return None


def ladder(query: StructuredQuery) -> list[StructuredQuery]:
    """The request and its relaxations, as far as a positive term is left."""
    rungs: list[StructuredQuery] = []
    at: StructuredQuery | None = query
    while at is not None and not at.is_empty():
        rungs.append(at)
        at = relaxed(at)
    return rungs


def requested_count(message: str) -> int | None:
    """A number that the message asks for; articles are none."""
    text = message.lower()
    if m := re.search(r"(?<!\d)(\d{1,2})(?!\d)", text):
        return int(m[1]) or None
    for word in re.findall(r"[^\W\d_]+", text):
        if word in NUMBER_WORDS:
            return NUMBER_WORDS[word]
    return 1 if any(w in re.findall(r"[^\W\d_]+", text) for w in SINGLE_WORDS) else None


def limit_of(message: str, query: StructuredQuery, default: int = 10) -> int:
    return requested_count(message) or query.limit or default
