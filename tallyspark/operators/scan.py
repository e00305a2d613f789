"""From the words of a page to facts: rows, captions, notes, columns, bases, periods, sections.

A page is read in the order in which it is printed, and what a line means depends on the lines above it, so a page is folded by one call of
Python over its words; pages, not words, are what the data grow by. A worker reads the pages of a partition one after another out of a stream of
sorted words, and remembers what a string means by itself (an amount, a date, a section), which doesn't depend on its page. Coordinates are shares of the page.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from itertools import groupby
from operator import itemgetter
from statistics import median

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspark.functions.folding import simplified
from tallyspark.functions.numbers import MONTHS
from tallyspark.functions.text import SECTION_WORDS

#: Shapes of amounts and of note references, words of headers, and distances.
AMOUNT = re.compile(r"^[(\-−–]?\s*[$€£]?[0-9][0-9,]*(?:\.[0-9]+)?\)?$")
DASH = re.compile(r"^[-–—]$")
NOTE = re.compile(r"^[0-9]{1,2}(?:\([a-z]\))?[,.;]?$")
HEADERS = re.compile(r"annual report|interim report|年報|年度報告|statement of|year ended|for the (?:year|period)|as at\b|as of\b|period ended|截至|止年度", re.I)
UNITS = re.compile(r"['’]0{3}|\b(?:thousands?|millions?|billions?)\b|百萬|百万|千元", re.I)
BASES = (("consolidated", re.compile(r"\bconsolidated\b|\bgroup\b|[本][集][團团]", re.I)), ("standalone", re.compile(r"\bstandalone\b|\bcompany\b|[本][公][司]", re.I)))
OF_SCOPE = {"consolidated": "consolidated", "company": "standalone"}
COLUMN_GAP, NEAR_COLUMN, WORD_GAP, NOTE_NEAR, INDENT = 0.035, 0.07, 0.02, 0.03, 0.01
#: Strings whose meaning a worker remembers, and rows of a batch that it returns; results depend on neither.
REMEMBERED, BATCH = 20_000, 10_000
SCHEMA = "doc_id long, page_index int, ordinal int, label string, section string, group_hint string, role string, components string, note string, basis string, period_label string, value double"


@dataclass(slots=True)
class Word:
    x0: float
    x1: float
    y0: float
    y1: float
    text: str
    x: float = field(init=False)
    y: float = field(init=False)

    def __post_init__(self) -> None:
        self.x, self.y = (self.x0 + self.x1) / 2, (self.y0 + self.y1) / 2


@lru_cache(REMEMBERED)
def amount(text: str) -> float | None:
    """A figure; percentages and dashes are none."""
    s = text.strip()
    if not AMOUNT.match(s):
        return None
    value = float(re.sub(r"[^0-9.]", "", s))
    return -value if s[0] in "(-−–" else value


@lru_cache(REMEMBERED)
def noted(text: str) -> bool:
    """A note reference by its shape."""
    return bool(NOTE.match(text))


@lru_cache(REMEMBERED)
def names_notes(text: str) -> bool:
    return text.strip(".").lower() in ("note", "notes", "附註", "附注")


@lru_cache(REMEMBERED)
def bases_in(text: str) -> tuple[str, ...]:
    return tuple(b for b, pattern in BASES if pattern.search(text))


def rows_of(words: list[Word]) -> list[list[Word]]:
    """Words whose heights lie within half a line of a row's mean, left to right; rows from the top."""
    tol = median(w.y1 - w.y0 for w in words) / 2 if words else 0
    rows: list[list[Word]] = []
    means: list[float] = []
    for w in sorted(words, key=lambda w: (w.y0, w.x0)):
        for i, mean in enumerate(means):
            if abs(w.y - mean) <= tol:
                rows[i].append(w)
                means[i] = sum([v.y for v in rows[i]]) / len(rows[i])
                break
        else:
            rows.append([w])
            means.append(w.y)
    return sorted((sorted(r, key=lambda w: w.x0) for r in rows), key=lambda r: min(w.y0 for w in r))


def split_row(row: list[Word], note_x: float | None) -> tuple[list[Word], str | None, list[Word]]:
    """Words of the caption, the note that is cited, words of the figures."""
    label: list[Word] = []
    note, values = None, []
    for i, w in enumerate(row):
        bare, before = noted(w.text), row[i - 1] if i else None
        apart = before is not None and (w.x0 - before.x1 > WORD_GAP or before.text.lower() in ("note", "notes"))
        in_column = note_x is not None and abs(w.x - note_x) <= NOTE_NEAR
        if not values and bare and note is None and (in_column or apart and label and any(amount(v.text) is not None and not noted(v.text) for v in row[i + 1 :])):
            note = w.text.rstrip(",.;")
            if label and label[-1].text.lower() in ("note", "notes"):
                label.pop()
        elif amount(w.text) is not None and not (label and not values and not apart):
            values.append(w)
        elif DASH.match(w.text) and (values or apart):
            values.append(w)
        elif not values:
            label.append(w)
    return label, note, values


def note_column(rows: list[list[Word]]) -> float | None:
    """Where the heading Note stands over two bare numbers and more."""
    heads = [w.x for r in rows for w in r if names_notes(w.text)]
    hits = [(sum(noted(w.text) and abs(w.x - x) <= NOTE_NEAR for r in rows for w in r), -x) for x in heads]
    best = max(hits, default=(0, 0.0))
    return -best[1] if best[0] >= 2 else None


def columns_of(rows: list[tuple]) -> list[float]:
    """Centres of the value columns: clusters of three rows and more that aren't mostly bare notes; a single one is none."""
    marks = sorted((w.x, i, noted(w.text)) for i, (_, _, values) in enumerate(rows) for w in values if amount(w.text) is not None)
    clusters: list[list] = []
    for m in marks:
        if clusters and m[0] - clusters[-1][-1][0] <= COLUMN_GAP:
            clusters[-1].append(m)
        else:
            clusters.append([m])
    good = [c for c in clusters if len({i for _, i, _ in c}) >= 3 and sum(b for _, _, b in c) < max(2, 0.8 * len(c))]
    return [median(x for x, _, _ in c) for c in good] if len(good) >= 2 else []


@lru_cache(REMEMBERED)
def dated(text: str) -> tuple[int, int, int] | None:
    year = re.search(r"(?:19|20)[0-9]{2}", text)
    if not year:
        return None
    low = text.lower()
    month = next((i for i, m in enumerate(MONTHS, 1) if m in low), 0)
    day = re.search(r"\b([0-9]{1,2})(?:st|nd|rd|th)?\s+(?=[a-z])", low)
    return int(year[0]), month, int(day[1]) if day else 0


@lru_cache(REMEMBERED)
def bare(text: str) -> str:
    """A caption without dates, names of bases, the heading Note and signs: nothing of a line that only heads columns."""
    for _, pattern in BASES:
        text = pattern.sub(" ", text)
    return re.sub(r"(?i)\bthe\b|\bnotes?\b|附註|附注|(?:19|20)[0-9]{2}|[\s\-–—/,.()（）:：'’\"]+", "", text)


def phrases(row: list[Word], gap: float = WORD_GAP) -> list[tuple[float, str]]:
    """(centre, text) of the words of a row that stand together."""
    runs: list[list[Word]] = []
    for w in row:
        if runs and w.x0 - runs[-1][-1].x1 <= gap:
            runs[-1].append(w)
        else:
            runs.append([w])
    return [((r[0].x0 + r[-1].x1) / 2, " ".join(w.text for w in r)) for r in runs]


def bases_of(header: list[list[Word]], columns: list[float], scope: str | None) -> list[str]:
    """The basis of each column: of a header row that names both, in equal runs or by the nearest caption; else the page's scope; else consolidated."""
    for row in header:
        marks = sorted((x, b) for x, text in phrases(row) for b in bases_in(text))
        if len({b for _, b in marks}) == 2 and len(marks) == 2:
            if len(columns) % 2 == 0:
                return [marks[2 * i // len(columns)][1] for i in range(len(columns))]
            nearest = [min((abs(x - c), k) for k, (x, _) in enumerate(marks))[1] for c in columns]
            return [marks[max(nearest[: i + 1])][1] for i in range(len(columns))]
    return [OF_SCOPE.get(scope or "", "consolidated")] * len(columns)


def periods_of(header: list[list[Word]], columns: list[float], bases: list[str]) -> list[str]:
    """current, prior, col2 ... of each column by the dates over them, newest first within a basis; by place where dates are missing or alike."""
    best: dict[int, tuple] = {}
    for row in header:
        dates = [(x, d) for x, text in phrases(row) if (d := dated(text))]
        found = {i: min((abs(x - c), d) for x, d in dates)[1] for i, c in enumerate(columns) if any(abs(x - c) <= NEAR_COLUMN for x, _ in dates)}
        best = found if len(found) > len(best) else best
    out = []
    for i, basis in enumerate(bases):
        mine = [k for k, b in enumerate(bases) if b == basis]
        order = sorted({best[k] for k in mine if k in best}, reverse=True)
        rank = order.index(best[i]) if len(order) == len(mine) else mine.index(i)
        out.append(("current", "prior")[rank] if rank < 2 else f"col{rank}")
    return out


class Captions:
    """What the text of a caption says by itself; a worker's readers share it."""

    def __init__(self, fold: dict[str, str]):
        self.fold = fold
        for name in ("section_of", "only_section", "heading", "report", "header", "unit"):
            setattr(self, name, lru_cache(REMEMBERED)(getattr(self, name)))

    def section_of(self, text: str) -> str | None:
        plain = "".join(self.fold.get(c, c) for c in text)
        plain = "".join(c for c in unicodedata.normalize("NFKD", plain) if not unicodedata.combining(c)).lower()
        plain = " ".join(re.sub(r"[^\w\s]", " ", plain).split())
        if ("equity" in plain or "权益" in plain) and ("liabilit" in plain or "负债" in plain):
            return None
        return next((s for s, words in SECTION_WORDS if any(w in plain for w in words)), None)

    def only_section(self, text: str) -> bool:
        rest = " ".join(re.sub(r"[^\w\s]", " ", unicodedata.normalize("NFKD", "".join(self.fold.get(c, c) for c in text)).lower()).split())
        for _, words in SECTION_WORDS:
            for w in words:
                rest = rest.replace(w, " ")
        return self.section_of(text) is not None and not rest.strip()

    def heading(self, text: str) -> bool:
        letters = [c for c in text if c.isalpha() and c.isascii()]
        return text.endswith((":", "：")) or self.only_section(text) or bool(letters) and not any(c.islower() for c in letters)

    def report(self, text: str) -> bool:
        return bool(re.search(r"annual report|interim report|年報|年度報告", text, re.I))

    def header(self, text: str) -> bool:
        return bool(HEADERS.search(text))

    def unit(self, text: str) -> bool:
        return bool(UNITS.search(text))


@dataclass
class Reader:
    """The state of a page while it is read."""

    captions: Captions
    on_face: bool = True
    scope: str | None = None
    chrome: frozenset[str] = frozenset()
    section: str | None = None
    group: str = ""
    group_x: float | None = None
    block: list[int] = field(default_factory=list)
    edges: list[float] = field(default_factory=list)

    def noise(self, text: str, values: list[float]) -> bool:
        if text.casefold() in self.chrome or self.captions.report(text) or not bare(text):
            return True
        dates = bool(values) and all(v == int(v) and (1 <= abs(v) <= 31 or 1990 <= abs(v) <= 2099) for v in values)
        return dates and (self.captions.header(text) or text.isupper() and text.isascii())

    def read(self, words: list[Word]) -> Iterator[tuple]:
        """ordinal, label, section, group_hint, role, components, note, basis, period_label, value of each figure."""
        raw = rows_of(words)
        note_x = note_column(raw)
        rows = [split_row(r, note_x) for r in raw]
        columns = columns_of(rows)
        first = next((i for i, (label, _, values) in enumerate(rows) if label and any(amount(v.text) is not None and not dated(v.text) for v in values)), len(rows))
        header = raw[: first + 1]
        bases = bases_of(header, columns, self.scope)
        periods = periods_of(header, columns, bases)
        ordinal, held = 0, []
        for label, note, values in rows:
            figures = [(w, v, self.column(w.x, columns)) for w in values if (v := amount(w.text)) is not None]
            if any(i is not None for _, _, i in figures):
                figures = [f for f in figures if f[2] is not None]
            text = " ".join(w.text for w in [*held, *label])
            promoted = False
            if figures and not label and not held and not self.on_face and len(self.block) >= 2:
                years = all(v == int(v) and 1990 <= abs(v) <= 2099 for _, v, _ in figures)
                promoted = not years and any(abs(w.x1 - e) <= 0.01 for w, _, _ in figures for e in self.edges)
                text = self.group.rstrip(":：") if promoted else text
            if not figures or not text:
                self.heads(label, " ".join(w.text for w in label))
                wrapped = label and not figures and bare(text) and not self.captions.heading(text) and not self.captions.header(text) and not self.captions.unit(text)
                held = [*held, *label] if wrapped and len(held) < 40 else []
                continue
            held = []
            if self.noise(text, [v for _, v, _ in figures]):
                continue
            head = re.split(r"[:：]", text)[0] if re.search(r"[:：]", text) else ""
            if head and self.captions.section_of(head):
                self.section, self.group = head.strip(), ""
            role = "subtotal" if promoted else "line"
            taken: dict[str, int] = {}
            for _, v, i in sorted(figures, key=lambda f: f[0].x0):
                basis = bases[i] if i is not None else OF_SCOPE.get(self.scope or "", "consolidated")
                k = taken.get(basis, 0)
                taken[basis] = k + 1
                period = periods[i] if i is not None else ("current", "prior")[k] if k < 2 else f"col{k}"
                yield (ordinal, text, self.section, self.group, role, ",".join(map(str, self.block)) if promoted else "", note, basis, period, v)
            ordinal += 1
            if promoted:
                self.block, self.edges = [], []
            elif not self.on_face and self.group_x is not None and label and label[0].x0 > self.group_x + INDENT:
                self.block.append(ordinal - 1)
                self.edges += [w.x1 for w, _, _ in figures]

    def heads(self, label: list[Word], text: str) -> None:
        """A line without figures may head what follows: a section, or a group within one."""
        if not label or self.captions.unit(text) or not self.captions.heading(text):
            return
        if self.captions.section_of(text) or not text.endswith((":", "：")):
            self.section, self.group = text, ""
        else:
            self.group = text
        self.block, self.edges, self.group_x = [], [], min(w.x0 for w in label)

    @staticmethod
    def column(x: float, columns: list[float]) -> int | None:
        """The nearest column, the first of those as near."""
        near, at = 1.0, None
        for i, c in enumerate(columns):
            if abs(x - c) < near:
                near, at = abs(x - c), i
        return at if near <= NEAR_COLUMN else None


_FOUND = pa.schema([(n, {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "double": pa.float64()}[t]) for n, t in (c.split() for c in SCHEMA.split(", "))])


def batch_of(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _FOUND.types, strict=True)], schema=_FOUND)


def listed(c: pa.Array) -> list:
    """A column's values; a word that comes again is decoded once."""
    if pa.types.is_string(c.type):
        c = c.dictionary_encode("encode")
        return [*map(c.dictionary.to_pylist().__getitem__, c.indices.to_numpy().tolist())]
    return c.to_pylist() if c.null_count else c.to_numpy(zero_copy_only=False).tolist()


def sorted_words(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*map(listed, batch.columns), strict=True)


def page_facts(words: DataFrame) -> DataFrame:
    """A row for each figure of a page: ordinal and caption of its line, section, group, role, note, basis, period and value.

    words: doc_id, page_index, x0, x1, y0, y1, text, on_face, scope (consolidated, company or null).
    """
    fold = simplified()
    keys, place = ["doc_id", "page_index"], ["y0", "x0", "x1", "y1", "text"]

    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        captions, found = Captions(fold), []
        for key, page in groupby(sorted_words(batches), itemgetter(0, 1)):
            page = list(page)
            *_, on_face, scope = page[0]
            found += [(*key, *f) for f in Reader(captions, bool(on_face), scope).read([Word(*w[2:7]) for w in page])]
            if len(found) >= BATCH:
                yield batch_of(found)
                found = []
        if found:
            yield batch_of(found)

    typed = words.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("page_index").cast("int").alias("page_index"), *[F.col(c).cast("double").alias(c) for c in ("x0", "x1", "y0", "y1")], "text", "on_face", "scope")
    return typed.repartition(*keys).sortWithinPartitions(*keys, *place, "on_face", "scope").mapInArrow(read, SCHEMA)
