"""Tokens and string scores as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import vocabulary as V

BETWEEN = r"[^\p{L}\p{N}]+"


def tokens(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), BETWEEN), "")


def normal(text: Column) -> Column:
    """Lower case, anything but letters and digits as single spaces."""
    return F.trim(F.regexp_replace(F.lower(text), BETWEEN, " "))


def any_of(text: Column, words: list[str]) -> Column:
    """Some word is a substring; words of up to three letters must stand alone."""
    found = F.lit(False)
    for w in words:
        found = found | (text.rlike(rf"(^|[^a-z0-9]){w}($|[^a-z0-9])") if len(w) <= 3 else text.contains(w))
    return found


def hits(text: Column, words: list[str]) -> Column:
    total = F.lit(0)
    for w in words:
        total = total + text.contains(w).cast("int")
    return total


def word_count(text: Column) -> Column:
    return F.size(F.array_remove(F.split(F.trim(F.coalesce(text, F.lit(""))), r"\s+"), ""))


def snippet(text: Column, term: str, width: int = 18) -> Column:
    """A window of ``width`` tokens from shortly before the first hit, the hits marked."""
    words = F.split(text, r"\s+")
    at = F.array_position(F.transform(words, lambda w: F.lower(w).contains(term)), True)
    start = F.greatest(F.lit(1), at.cast("int") - F.lit(width // 3))
    shown = F.array_join(F.slice(words, start, width), " ")
    marked = F.regexp_replace(shown, f"(?i)({term})", "<b>$1</b>")
    return F.concat(F.when(start > 1, "…").otherwise(""), marked, F.when(F.size(words) >= start + width, "…").otherwise(""))


def code_mixed(text: Column) -> Column:
    """Text in an Indic script or with a romanised word of one."""
    return text.rlike(V.INDIC) | F.arrays_overlap(tokens(text), F.array(*[F.lit(w) for w in V.ROMANISED_WORDS]))


def recovered_json(text: Column, schema: str) -> Column:
    """JSON as it is, or inside a fence, or between the outermost braces."""
    ticks = "`" * 3
    fenced = F.regexp_extract(text, rf"(?s){ticks}(?:json)?\s*(\{{.*?\}})\s*{ticks}", 1)
    braces = F.regexp_extract(text, r"(?s)(\{.*\})", 1)
    parse = lambda x: F.when(F.length(F.trim(x)) > 0, F.from_json(x, schema, {"mode": "FAILFAST"}))
    good = lambda x: F.get_json_object(x, "$").isNotNull()
    return F.when(good(text), parse(text)).when(good(fenced), parse(fenced)).when(good(braces), parse(braces))


def html_text(html: Column) -> Column:
    """Visible text: scripts, styles, comments and tags out, common entities decoded, blanks single."""
    out = F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->", " ")
    out = F.regexp_replace(out, r"(?s)<[^>]*>", " ")
    for a, b in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return F.trim(F.regexp_replace(out, r"\s+", " "))


def canonical(concepts: Column) -> Column:
    """Lower case, outer punctuation off, synonyms unified, duplicates dropped in order."""
    table = F.create_map(*[F.lit(x) for kv in V.SYNONYMS.items() for x in kv])
    clean = F.transform(concepts, lambda c: F.trim(F.regexp_replace(F.lower(c), r"[.,;:!?\"'()]", "")))
    return F.array_distinct(F.filter(F.transform(clean, lambda c: F.coalesce(F.try_element_at(table, c), c)), lambda c: c != ""))


def ambient(concept: Column) -> Column:
    found = F.lit(False)
    for w in V.AMBIENT:
        found = found | concept.contains(w)
    return found
