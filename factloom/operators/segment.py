"""Offset-exact evidence units of a text: subject, headings, sentence groups, parts of long groups.

The grouping keeps a state from sentence to sentence, so it runs in Arrow batches.  Every unit of
body text comes from one range of the source, of which it is the text with white space collapsed.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame

# Fixed values of the unit rules.
MERGE_BELOW, GROUP_LEAST, GROUP_MOST, GROUP_SENTENCES = 8, 100, 240, 3
LONG, PART, OVERLAP, PART_LEAST = 400, 300, 60, 8
_HEADING = re.compile(r"(#{1,6})\s+(.+?)\s*")
_END = re.compile(r"[。！？!?；;]\s*")

# White space other than a single blank.
_GAP = re.compile(r"\s(?:\s+|(?<=[^ ]))")
#: Characters of contents, and units, that are Python objects at once; a longer content is on its own.
PIECE, UNITS = 1 << 18, 4_096

Range = tuple[int, int]  # of characters of a body's text


class Body:
    """A range of the source as its text with white space collapsed, and where each stretch between collapsed ones comes from."""

    __slots__ = ("text", "at", "source")

    def __init__(self, content: str, start: int, end: int):
        bare = content[start:end].lstrip()
        start, bare = end - len(bare), bare.rstrip()
        self.text, self.at, self.source, less = " ".join(bare.split()), [0], [start], 0
        for m in _GAP.finditer(bare) if self.text != bare else ():
            less += m.end() - m.start() - 1
            self.at.append(m.end() - less)
            self.source.append(start + m.end())

    def trimmed(self, first: int, end: int) -> Range:
        """The range without a blank at either end; neighbouring blanks are one already."""
        if first < end and self.text[first] == " ":
            first += 1
        if first < end and self.text[end - 1] == " ":
            end -= 1
        return first, end

    def place(self, at: int) -> int:
        """Where in the source a character other than a blank is."""
        k = bisect_right(self.at, at) - 1
        return self.source[k] + at - self.at[k]

    def sentences(self) -> list[Range]:
        out, at = [], 0
        for m in _END.finditer(self.text):
            out.append(self.trimmed(at, m.start() + 1))
            at = m.end()
        out.append(self.trimmed(at, len(self.text)))
        return [(a, b) for a, b in out if a < b]


def paragraphs(content: str) -> tuple[list[tuple[str, int, int]], list[Body]]:
    """Headings (title and range) and paragraphs; a very short paragraph joins its neighbour unless a heading is between."""
    heads: list[tuple[str, int, int]] = []
    spans: list[tuple[int, int, int]] = []  # start, end, headings before
    start, at = None, 0
    for line in [*content.splitlines(keepends=True), ""]:
        bare = line.rstrip("\r\n")
        m = _HEADING.fullmatch(bare.strip())
        if (m or not bare.strip()) and start is not None:
            spans.append((start, at, len(heads)))
            start = None
        if m:
            heads.append((" ".join(m[2].split()), at, at + len(bare)))
        elif bare.strip() and start is None:
            start = at
        at += len(line)
    kept: list[tuple[int, int, int, Body]] = []
    for a, b, before in spans:
        body = Body(content, a, b)
        if body.text and kept and kept[-1][2] == before and (len(body.text) < MERGE_BELOW or len(kept[-1][3].text) < MERGE_BELOW):
            kept[-1] = (kept[-1][0], b, before, Body(content, kept[-1][0], b))
        elif body.text:
            kept.append((a, b, before, body))
    return heads, [x for *_, x in kept]


def groups(body: Body) -> list[Range]:
    """Groups of sentences; one sentence is shared by neighbours, so a last sentence may stand alone again."""
    parts = body.sentences()
    if len(parts) < 2:
        return [(0, len(body.text))]
    out, first = [], 0
    while first < len(parts):
        size, end = 0, first
        while end < len(parts):
            more = parts[end][1] - parts[end][0]
            if size >= GROUP_LEAST and (size + more > GROUP_MOST or end - first >= GROUP_SENTENCES):
                break
            size, end = size + more, end + 1
        out.append((parts[first][0], parts[end - 1][1]))
        first = max(first + 1, end - 1)
    return out


def units(subject: str | None, content: str | None) -> list[tuple[str, str, int, int]]:
    """kind, text, start and end of every unit, in order."""
    content = content or ""
    out = []
    title = " ".join((subject or "").split())
    if title:
        out.append(("subject", title, 0, 0))
    heads, bodies = paragraphs(content)
    out += [("heading", t, a, b) for t, a, b in heads if t]
    for body in bodies:
        for a, b in groups(body):
            pieces = [(a, b)]
            if b - a > LONG:
                cuts = (body.trimmed(k, min(b, k + PART)) for k in range(a, a + max(1, b - a - OVERLAP), PART - OVERLAP))
                pieces = [(x, y) for x, y in cuts if y - x >= PART_LEAST]
            out += [("text", body.text[x:y], body.place(x), body.place(y - 1) + 1) for x, y in pieces]
    return out


def pieces(b: pa.RecordBatch) -> Iterator[list[tuple]]:
    """Rows of all units of a batch of (id, version, subject, content), some records at a time."""
    rows, size = [], 0
    for i, v, s, c in zip(*b.columns):
        text = c.as_py()
        rows += [(i.as_py(), v.as_py(), k, *u) for k, u in enumerate(units(s.as_py(), text))]
        size += len(text or "")
        if size >= PIECE or len(rows) >= UNITS:
            yield rows
            rows, size = [], 0
    yield rows


def segment(memories: DataFrame) -> DataFrame:
    """memories(id, version, subject, content) to a row for each unit: memory_id, memory_version, unit_index, kind, text, start, end."""
    names = ["memory_id", "memory_version", "unit_index", "kind", "text", "start_offset", "end_offset"]
    kinds = [pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.int32(), pa.int32()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for rows in filter(None, pieces(b)):
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*rows), kinds)], names=names)

    given = memories.selectExpr("CAST(id AS BIGINT) AS id", "CAST(version AS INT) AS version", "subject", "content")
    return given.mapInArrow(run, "memory_id long, memory_version int, unit_index int, kind string, text string, start_offset int, end_offset int")
