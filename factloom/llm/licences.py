"""Licence scans by matching statistics over a generalised suffix automaton of licence words.

The words of all notices and phrases (A-Z lower-cased, everything but digits, letters and non-ASCII
characters taken as a separator) go into one suffix automaton: each state stands for strings of
words that occur at the same places.  A text is streamed through it once, in blocks of bounded
size.  After each word the automaton is in the state of the longest run of words, ending there, that
occurs in any notice; the lengths of these runs are the matching statistics.  A phrase stands
wherever the state's run ends with it.  A run that the next word does not continue is a match, if it
is long enough; its places in the notices are those of its state.  For each notice, matches that follow
each other both in the text and in the notice, without large gaps, are chained into spans, and a
span that covers enough of its notice gives the notice's label.

Notices are a parameter of the caller, not data.  Each automaton takes a bounded number of words;
where there are more notices they are dealt to several automata, and a task passes over its texts once
for each.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factloom.llm.common import append_columns, worker_value
from factloom.llm.decontam import _FOLD
from factloom.llm.licence_texts import NOTICES, PHRASES

#: Bytes of a text that are split into words at once.
_BLOCK = 1 << 20

_PLACES = T.ArrayType(T.StructType([T.StructField("label", T.StringType()), T.StructField("word", T.LongType())]))
_SPANS = T.ArrayType(T.StructType([
    T.StructField("label", T.StringType()), T.StructField("notice", T.LongType()),
    T.StructField("first", T.LongType()), T.StructField("end", T.LongType()),
    T.StructField("notice_first", T.LongType()), T.StructField("notice_end", T.LongType()),
    T.StructField("n_matched", T.LongType()), T.StructField("share", T.DoubleType()),
]))


class Match(NamedTuple):
    """Words first to end (excluded) of a text that stand in a notice from word at on."""

    first: int
    end: int
    at: int


class Span(NamedTuple):
    first: int
    end: int
    at: int
    at_end: int
    n_matched: int


def word_blocks(text: str | None) -> Iterator[list[bytes]]:
    """The normalised words of a text in blocks; none of null."""
    line, at = (text or "").encode().translate(_FOLD), 0
    while at < len(line):
        end = line.find(b" ", at + _BLOCK)
        end = len(line) if end < 0 else end
        yield line[at:end].split()
        at = end


class SuffixAutomaton:
    """All runs of words of several sequences, with the places where each occurs."""

    def __init__(self, sequences: Iterable[list[bytes]]):
        self.next: list[dict[bytes, int]] = [{}]
        self.link, self.length = [-1], [0]
        self._ends: list[list[tuple[int, int]]] = [[]]
        for number, words in enumerate(sequences):
            last = 0
            for i, w in enumerate(words):
                last = self._extend(last, w)
                self._ends[last].append((number, i + 1))
        self._below: list[list[int]] = [[] for _ in self.link]
        for state, parent in enumerate(self.link):
            if parent >= 0:
                self._below[parent].append(state)
        self._places: dict[int, list[tuple[int, int]]] = {}

    def _state(self, length: int, edges: dict[bytes, int], link: int) -> int:
        self.next.append(edges)
        self.length.append(length)
        self.link.append(link)
        self._ends.append([])
        return len(self.link) - 1

    def _split(self, parent: int, w: bytes) -> int:
        """The state that w leads to from parent, holding no run longer than parent's and w."""
        to = self.next[parent][w]
        if self.length[to] == self.length[parent] + 1:
            return to
        half = self._state(self.length[parent] + 1, dict(self.next[to]), self.link[to])
        self.link[to] = half
        while parent >= 0 and self.next[parent].get(w) == to:
            self.next[parent][w] = half
            parent = self.link[parent]
        return half

    def _extend(self, last: int, w: bytes) -> int:
        if w in self.next[last]:  # an earlier sequence has this run
            return self._split(last, w)
        new = self._state(self.length[last] + 1, {}, 0)
        while last >= 0 and w not in self.next[last]:
            self.next[last][w] = new
            last = self.link[last]
        if last >= 0:
            self.link[new] = self._split(last, w)
        return new

    def find(self, words: list[bytes]) -> int | None:
        state: int | None = 0
        for w in words:
            state = self.next[state].get(w)
            if state is None:
                return None
        return state

    def places(self, state: int) -> list[tuple[int, int]]:
        """(sequence, end) of every place where the state's runs end."""
        if state not in self._places:
            found, open_ = [], [state]
            while open_:
                at = open_.pop()
                found += self._ends[at]
                open_ += self._below[at]
            self._places[state] = sorted(found)
        return self._places[state]


class Scanner:
    """Notices and phrases in one automaton, and texts run through it."""

    def __init__(self, notices: list[str], phrases: list[str], min_match: int, max_gap: int):
        self.notices = [w for t in notices for w in [[x for b in word_blocks(t) for x in b]]]
        self.min_match, self.max_gap = min_match, max_gap
        split = [[x for b in word_blocks(t) for x in b] for t in phrases]
        self.automaton = SuffixAutomaton([*self.notices, *split])
        self.known = {w for words in [*self.notices, *split] for w in words}
        # the phrases that a state's runs end with, long ones only where the run is long enough
        own: dict[int, list[tuple[int, int]]] = {}
        for number, words in enumerate(split):
            if words:
                own.setdefault(self.automaton.find(words), []).append((len(words), number))
        self.ending: list[list[tuple[int, int]]] = [[] for _ in self.automaton.link]
        for state in sorted(range(1, len(self.automaton.link)), key=self.automaton.length.__getitem__):
            self.ending[state] = self.ending[self.automaton.link[state]] + own.get(state, [])

    def scan(self, text: str | None) -> tuple[int, list[tuple[int, int]], dict[int, list[Match]]]:
        """The number of words, (phrase, first word) of each phrase, and the matches by notice."""
        a, places, matches = self.automaton, [], {}
        follow, link, length, ending, known = a.next, a.link, a.length, self.ending, self.known
        at, state, n = 0, 0, 0  # n: words of the run that ends here

        def close(end: int) -> None:
            if n >= self.min_match:
                for notice, stop in a.places(state):
                    if notice < len(self.notices):
                        matches.setdefault(notice, []).append(Match(end - n, end, stop - n))

        for block in word_blocks(text):
            for at, w in enumerate(block, at):
                if w not in known:
                    if state:
                        close(at)
                        state = n = 0
                    continue
                to = follow[state].get(w)
                if to is None:
                    close(at)
                    while to is None and state:
                        state = link[state]
                        n = length[state]
                        to = follow[state].get(w)
                    to = to or 0
                    n += to > 0
                else:
                    n += 1
                state = to
                for size, phrase in ending[state]:
                    if size <= n:
                        places.append((phrase, at + 1 - size))
            at += bool(block)
        close(at)
        return at, places, matches

    def spans(self, matches: list[Match]) -> list[Span]:
        """The matches of one notice chained: most words first, a match in one span only, in order of the text."""
        matches = sorted(set(matches))
        most, before = [], []
        for k, m in enumerate(matches):
            best, of = m.end - m.first, -1
            for p in range(k - 1, -1, -1):
                q = matches[p]
                if m.first - q.first > self.max_gap + self._longest:
                    break
                trim = max(0, q.end - m.first, q.at + q.end - q.first - m.at)
                gain = m.end - m.first - trim
                if gain > 0 and m.first + trim - q.end <= self.max_gap and most[p] + gain > best:
                    best, of = most[p] + gain, p
            most.append(best)
            before.append(of)
        out, used = [], [False] * len(matches)
        for k in sorted(range(len(matches)), key=lambda k: (-most[k], k)):
            chain, at = [], k
            while at >= 0 and not used[at]:
                chain.append(at)
                at = before[at]
            if not chain:
                continue
            for p in chain:  # what comes before went to a longer chain
                used[p] = True
            first, last = matches[chain[-1]], matches[k]
            n = most[k] - most[chain[-1]] + first.end - first.first
            out.append(Span(first.first, last.end, first.at, last.at + last.end - last.first, n))
        return sorted(out)

    @property
    def _longest(self) -> int:
        return max(map(len, self.notices), default=0)


def _groups(notices: list[tuple[str, str]], most: int) -> list[list[int]]:
    """Numbers of notices in groups of at most ``most`` words (one notice alone may have more)."""
    out, have = [[]], 0
    for k, (_, text) in enumerate(notices):
        n = sum(map(len, word_blocks(text)))
        if out[-1] and have + n > most:
            out.append([])
            have = 0
        out[-1].append(k)
        have += n
    return out


def scan_licences(
    docs: DataFrame,
    *,
    text: str = "text",
    phrases: Iterable[tuple[str, str]] = PHRASES,
    notices: Iterable[tuple[str, str]] = NOTICES,
    min_match: int = 3,
    max_gap: int = 8,
    min_words: int = 5,
    min_share: float = 0.6,
    max_automaton_words: int = 200_000,
) -> DataFrame:
    """docs with n_words, phrase_places (label and first word of every place of a phrase, in order),
    licence_spans (the chained spans of notices), licence_labels (sorted) and licence_score.

    phrases and notices are pairs, (phrase, label) and (label, text).  A match has at least
    ``min_match`` words; chained matches leave at most ``max_gap`` words of the text between them.  A span
    counts if it matches at least ``min_words`` words and ``min_share`` of its notice.  A match is the longest
    run there: where a run of one notice stands inside a longer one of another, the longer counts.
    licence_score is the largest share of a counting span, and 1 where a phrase stands.

    One row comes out for each row that goes in, repeated rows too; columns with those names are
    replaced, others kept.  Texts of any length are taken whole.  A null text counts as empty: no
    words, places, spans or labels, score 0.  Phrases and notices without words are never found, and an empty
    table gives an empty result.
    """
    phrases, notices = list(phrases), list(notices)
    new = {"n_words": T.LongType(), "phrase_places": _PLACES, "licence_spans": _SPANS}
    out = docs.withColumns({"n_words": F.lit(None).cast("long"), "phrase_places": F.lit(None).cast(_PLACES), "licence_spans": F.lit(None).cast(_SPANS)})
    for number, group in enumerate(_groups(notices, max_automaton_words)):
        named = phrases if number == 0 else []  # phrases go into the first automaton
        key = uuid.uuid4().hex

        def factory(group=group, named=named, key=key, number=number):
            scanner = worker_value(key, lambda: Scanner([notices[k][1] for k in group], [p for p, _ in named], min_match, max_gap))

            def compute(batch: pa.RecordBatch) -> list[pa.Array]:
                counts, places, spans = [], [], []
                for i, value in enumerate(batch.column(text)):
                    n, found, matches = scanner.scan(value.as_py())
                    counts.append(n)
                    places.append([{"label": named[p][1], "word": w} for p, w in sorted(found, key=lambda x: (x[1], x[0]))] if number == 0 else batch.column("phrase_places")[i].as_py())
                    have = batch.column("licence_spans")[i].as_py() or []
                    for k, own in sorted(matches.items()):
                        size = len(scanner.notices[k])
                        for s in scanner.spans(own):
                            if s.n_matched >= min_words and s.n_matched >= min_share * size:
                                have.append({"label": notices[group[k]][0], "notice": group[k], "first": s.first, "end": s.end, "notice_first": s.at, "notice_end": s.at_end, "n_matched": s.n_matched, "share": s.n_matched / size})
                    spans.append(have)
                place = pa.list_(pa.struct([("label", pa.string()), ("word", pa.int64())]))
                span = pa.list_(pa.struct([("label", pa.string()), *((x, pa.int64()) for x in ("notice", "first", "end", "notice_first", "notice_end", "n_matched")), ("share", pa.float64())]))
                return [pa.array(counts, pa.int64()), pa.array(places, place), pa.array(spans, span)]

            return compute

        out = append_columns(out, new, factory)
    labels = F.array_sort(F.array_union(F.col("phrase_places.label"), F.col("licence_spans.label")))
    share = F.when(F.size("phrase_places") > 0, 1.0).otherwise(F.coalesce(F.array_max("licence_spans.share"), F.lit(0.0)))
    return out.withColumns({"licence_labels": labels, "licence_score": share})
