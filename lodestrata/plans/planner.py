"""From a sentence to a search plan: dates, types, categories, persons, roles; the plan then compiles
to Column predicates. Plain Python on the driver, as a sentence is one row."""

from __future__ import annotations

import calendar
import re
from dataclasses import dataclass, field
from datetime import date, timedelta

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import vocabulary as V

MONTHS = {m.lower(): k for k, m in enumerate(calendar.month_name) if m} | {m.lower(): k for k, m in enumerate(calendar.month_abbr) if m} | {"sept": 9}
MONTH = r"(" + "|".join(sorted(MONTHS, key=len, reverse=True)) + r")"
OPENERS = re.compile(r"^(?:(?:can you )?(?:please )?(?:find|show|get|search|display|locate|open|retrieve|look for|give me)(?: me)?|where is|where are|do you have|i need|i want)(?: (?:my|the|all|a|some))?\s+", re.I)
CLOSERS = re.compile(r"\s+(?:please|for me)$", re.I)
UNITS = {"b": 1, "kb": 1 << 10, "mb": 1 << 20, "gb": 1 << 30}


@dataclass(frozen=True)
class DateRange:
    start: date | None = None
    end: date | None = None
    day: int | None = None
    month: int | None = None

    def predicate(self, day: Column) -> Column:
        """On a DATE column; null days do not match."""
        if self.start is not None:
            hit = (day >= F.lit(self.start)) & (day <= F.lit(self.end))
        else:
            hit = (F.month(day) == self.month) & ((F.dayofmonth(day) == self.day) if self.day else F.lit(True))
        return F.coalesce(hit, F.lit(False))


@dataclass(frozen=True)
class Roles:
    subjects: tuple[str, ...] = ()
    attributes: tuple[str, ...] = ()
    clothing: tuple[str, ...] = ()
    objects: tuple[str, ...] = ()
    actions: tuple[str, ...] = ()
    scene: tuple[str, ...] = ()
    relationships: tuple[str, ...] = ()
    #: (attribute, noun) pairs.
    bound: tuple[tuple[str, str], ...] = ()

    @property
    def composed(self) -> bool:
        """Two roles or more, or an attribute of something."""
        return bool(self.bound) or sum(map(bool, (self.subjects, self.attributes, self.clothing, self.objects, self.actions, self.scene))) >= 2

    @property
    def visual(self) -> bool:
        seen = self.clothing or self.scene or (self.attributes and (self.subjects or self.objects))
        return bool(self.composed or seen or {"dog", "cat", "animal", "bird"} & set(self.subjects))


@dataclass(frozen=True)
class Plan:
    query: str
    text: str
    when: DateRange | None = None
    file_types: tuple[str, ...] = ()
    categories: tuple[str, ...] = ()
    document_types: tuple[str, ...] = ()
    persons: tuple[str, ...] = ()
    keywords: tuple[str, ...] = ()
    extension: str | None = None
    size: tuple[str, int] | None = None
    expansions: tuple[str, ...] = ()
    roles: Roles = field(default_factory=Roles)
    visual: bool = False
    academic: bool = False
    #: Category that full-text search is narrowed to.
    target: str | None = None

    @property
    def intent(self) -> str:
        return "academic" if self.academic else "visual" if self.visual else "general"

    def filters(self, path: Column, size: Column, day: Column) -> Column:
        """The hard constraints as one predicate for the scan."""
        keep = F.lit(True)
        if self.extension:
            keep = keep & F.lower(path).endswith("." + self.extension)
        if self.size:
            keep = keep & ((size > self.size[1]) if self.size[0] == "gt" else (size < self.size[1]))
        if self.when:
            keep = keep & self.when.predicate(day)
        return keep


def strip_fillers(text: str) -> str:
    return CLOSERS.sub("", OPENERS.sub("", text.strip())).strip()


def _cut(text: str, m: re.Match) -> str:
    return re.sub(r"\s+", " ", text[: m.start()] + " " + text[m.end() :]).strip()


DAY, YEAR = r"(\d{1,2})(?:st|nd|rd|th)?", r"(?:,?\s+(\d{4}))?"
WEEKDAYS = {d.lower(): k for k, d in enumerate(calendar.day_name)}
#: Days that a relative word reaches back from now.
REACHES = {"week": 7, "month": 30, "year": 365}


def _day(year: int, month: int, day: int) -> date | None:
    """None for days that the calendar does not have."""
    return date(year, month, day) if 1 <= day <= calendar.monthrange(year, month)[1] else None


def find_date(text: str, now: date) -> tuple[DateRange | None, str]:
    """The first of: a day range, day month, month day, month with year, relative words. A day that the
    calendar does not have is no match, and the next form is tried. Relative words but 'today', 'yesterday'
    and weekdays reach back 7, 30 or 365 days from now."""
    low = text.lower()
    if m := re.search(rf"\b(?:between|from)\s+{DAY}\s+(?:and|to)\s+{DAY}\s+{MONTH}{YEAR}\b", low):
        year, month = int(m[4] or now.year), MONTHS[m[3]]
        ends = [_day(year, month, d) for d in sorted((int(m[1]), int(m[2])))]
        if all(ends):
            return DateRange(*ends), _cut(text, m)
    for pattern, d, mo in ((rf"\b{DAY}\s+(?:of\s+)?{MONTH}{YEAR}\b", 1, 2), (rf"\b{MONTH}\s+{DAY}(?!\d){YEAR}\b", 2, 1)):
        if m := re.search(pattern, low):
            day = _day(int(m[3] or now.year), MONTHS[m[mo]], int(m[d]))
            if day:
                return DateRange(day, day) if m[3] else DateRange(day=day.day, month=day.month), _cut(text, m)
    if m := re.search(rf"\b(?:in\s+|from\s+|during\s+|of\s+)?{MONTH}(?:\s+|-)(\d{{4}})\b", low):
        year, month = int(m[2]), MONTHS[m[1]]
        return DateRange(date(year, month, 1), date(year, month, calendar.monthrange(year, month)[1])), _cut(text, m)
    if (m := re.search(rf"\b(?:in|from|during|of)\s+{MONTH}\b", low)) and m[1] != "may":
        return DateRange(month=MONTHS[m[1]]), _cut(text, m)
    if m := re.search(rf"\b(?:from\s+)?(?:(today)|(yesterday)|last\s+({'|'.join(WEEKDAYS)})|last\s+({'|'.join(REACHES)}))\b", low):
        if m[4]:
            return DateRange(now - timedelta(REACHES[m[4]]), now), _cut(text, m)
        back = 0 if m[1] else 1 if m[2] else (now.weekday() - WEEKDAYS[m[3]]) % 7 or 7
        return DateRange(now - timedelta(back), now - timedelta(back)), _cut(text, m)
    if m := re.search(r"\b(?:last|past)\s+(\d{1,3})\s+days\b", low):
        return DateRange(now - timedelta(int(m[1])), now), _cut(text, m)
    return None, text


def _has(text: str, words: str) -> re.Match | None:
    return re.search(rf"(?<![a-z0-9]){re.escape(words)}(?:s|es)?(?![a-z0-9+])", text.lower())


def find_persons(text: str, known: dict[str, str]) -> tuple[tuple[str, ...], str]:
    """Known names and aliases (``known`` maps lower-case forms to names), possessives, 'of X' and 'with X'."""
    found: list[str] = []
    for form in sorted(known, key=len, reverse=True):
        if m := re.search(rf"\b{re.escape(form)}(?:'s)?\b", text.lower()):
            found.append(known[form])
            text = _cut(text, m)
    for pattern in (r"\b([A-Z][a-z]+)'s\b", r"\b(?:of|with|by)\s+([A-Z][a-z]+)\b"):
        if m := re.search(pattern, text):
            found.append(m[1])
            text = _cut(text, m)
    return tuple(dict.fromkeys(found)), text


class _Reader:
    """A cursor over words."""

    def __init__(self, words: list[str]):
        self.words, self.at = words, 0

    def peek(self, ahead: int = 0) -> str | None:
        at = self.at + ahead
        return self.words[at] if at < len(self.words) else None

    def take(self) -> str | None:
        word = self.peek()
        self.at += word is not None
        return word


def decompose_roles(text: str) -> Roles:
    """Words of a phrase by role. Subjects count wherever they stand, in all their forms. An action or a
    preposition heads a noun phrase; in it, and before garments and scenes, a word in front of another is
    an attribute of that."""
    words = re.sub(r"[^\w\s-]|_", " ", text.lower()).split()
    out: dict[str, list] = {k: [] for k in ("subjects", "attributes", "clothing", "objects", "actions", "scene", "relationships", "bound")}
    for w in words:
        if w in V.SUBJECTS:
            out["subjects"] += V.SUBJECT_FORMS.get(w, [w])
    reader = _Reader([w for w in words if w not in V.SUBJECTS])
    plain = lambda w: w is not None and w not in V.PREPOSITIONS

    def place(noun: str, mark: str | None, head: str | None) -> None:
        role = "clothing" if noun in V.CLOTHING else "scene" if noun in V.SCENES else "objects"
        if not (mark and head is None and role == "objects" and noun in V.PLAIN_NOUNS):
            out[role].append(noun)
        if mark:
            out["bound"].append((mark, noun))
        if mark or head:
            out["relationships"].append(" ".join(x for x in (head, mark, noun) if x))

    def phrase(head: str) -> None:
        if reader.peek() in V.ARTICLES:
            reader.take()
        mark = None
        if reader.peek() in V.ATTRIBUTES or plain(reader.peek(1)):
            mark = reader.take()
            out["attributes"].append(mark)
        noun = reader.take()
        if noun is not None:
            place(noun, mark, head)
        elif mark and head not in V.ACTIONS:  # "in red"
            out["clothing"].append(mark)
            out["relationships"].append(f"{head} {mark}")

    while (w := reader.take()) is not None:
        if w in V.ARTICLES:
            continue
        if w in V.ACTIONS:
            out["actions"].append(w)
            if reader.peek() in V.PREPOSITIONS:
                out["relationships"].append(f"{w} {reader.take()}")
            phrase(w)
        elif w in V.PREPOSITIONS:
            phrase(w)
        elif w in V.ATTRIBUTES or reader.peek() in V.CLOTHING or reader.peek() in V.SCENES:
            out["attributes"].append(w)
            if plain(reader.peek()) and reader.peek() not in V.ACTIONS:
                place(reader.take(), w, None)
        else:
            place(w, None, None)
    return Roles(**{k: tuple(dict.fromkeys(v)) for k, v in out.items()})


def parse(query: str, now: date, persons: dict[str, str] | None = None) -> Plan:
    text = strip_fillers(query)
    extension = size = None
    if m := re.search(r"\b(?:ext|type):\.?([a-z0-9]+)", text, re.I):
        extension, text = m[1].lower(), _cut(text, m)
    if m := re.search(r"\bsize:([<>])=?\s*(\d+(?:\.\d+)?)\s*(b|kb|mb|gb)?\b", text, re.I):
        size = ("gt" if m[1] == ">" else "lt", int(float(m[2]) * UNITS[(m[3] or "mb").lower()]))
        text = _cut(text, m)
    when, text = find_date(text, now)
    named, text = find_persons(text, persons or {})
    types, rest = [], text
    for kind, words in V.FILE_TYPE_WORDS.items():
        for w in words:
            if m := re.search(rf"(?<![a-z0-9]){re.escape(w)}(?![a-z0-9+])", rest.lower()):
                types.append(kind)
                rest = _cut(rest, m)
                break
    documents = [d for d, (_, words) in V.DOCUMENT_TYPES.items() if any(_has(text, w) for w in words)]
    categories = [V.DOCUMENT_TYPES[d][0] for d in documents] + [c for c, words in V.CATEGORY_WORDS.items() if any(_has(text, w) for w in words)]
    if "image" in types:
        categories.append("Personal Photos")
    elif "Personal Photos" in categories:
        types.append("image")
    low = text.lower().split()
    roles = decompose_roles(text)
    academic = bool(re.search(V.ASSIGNMENT, text)) or any(w in V.ACRONYMS and w != "id" for w in low)
    from ..operators.retrieval import expansion_terms

    shown = any(w in V.VISUAL_TERMS for w in low) or "image" in types
    structured = any(_has(text, w) for w in V.STRUCTURAL_TYPES)
    visual = roles.visual or shown or structured
    keywords = [w for w in re.findall(r"[^\W_]+", rest.lower()) if len(w) > 1 and w not in V.PREPOSITIONS and w not in ("the", "my", "and", "from", "for")]
    unique = lambda x: tuple(dict.fromkeys(x))
    return Plan(query, text, when, unique(types), unique(categories), unique(documents), named, unique(keywords), extension, size, unique(expansion_terms(text)), roles, visual and not academic, academic, "Document" if academic else "Image" if shown else None)
