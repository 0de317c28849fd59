"""Exact tokenisation through a cache of units that the tokenizer treats one by one.

Both public BPE vocabularies start a new pre-token at a blank or line end that stands alone between
two other characters, and between a Latin letter and a sign other than the apostrophe; neither
normalisation nor merging reaches over these places.  So a text may be cut there, and the ids of the
whole are those of its pieces, one after another.  Everything else (runs of white space, characters
on which engines differ) stays inside a piece.  A text that may hold a special string is encoded
whole.

The tokenizers library encodes each distinct piece; a bounded cache keeps what it gave.
"""

from __future__ import annotations

import re
from array import array
from functools import lru_cache

from factloom.llm.common import worker_value

#: Characters that every engine agrees are not white space.
_SOLID = r"[^\s\x00-\x20\x7f-\xa0\u1680\u180e\u2000-\u200f\u2028-\u202f\u205f-\u2064\u3000\ufeff]"
_LETTER = r"[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]"
#: ASCII signs but the apostrophe, with which contractions begin.
_SIGN = r"[!-&(-/:-@\[-`{-~]"
#: A blank or a line end alone between solid characters.
_CUT = rf"(?:\Z|[ \n]{_SOLID})"
_UNIT = re.compile(
    rf" ?{_LETTER}+(?={_SIGN}|{_CUT})"
    rf"| ?{_SIGN}+(?={_LETTER}|{_CUT})"
    rf"|\n(?={_SOLID})"
    rf"|(?: ?{_SOLID}+|(?:(?!{_SOLID})[\s\S])+{_SOLID}*)(?:(?!{_CUT})(?:(?!{_SOLID})[\s\S])+{_SOLID}*)*"
)
#: What keeps a text from the short way of cutting it at every blank and line end.
_UNSURE = re.compile(r"[\x00-\x09\x0b-\x1f\x7f-\xa0\u1680\u180e\u2000-\u200f\u2028-\u202f\u205f-\u2064\u3000\ufeff]")
_LETTERS = re.compile(rf"({_LETTER}+)({_SIGN}*)")
#: Bytes as the characters that stand for them in byte-level vocabularies.
_PRINTED = [*range(33, 127), *range(161, 173), *range(174, 256)]
_BYTES = {b: b if b in _PRINTED else 256 + [x for x in range(256) if x not in _PRINTED].index(b) for b in range(256)}


def units(text: str) -> list[str]:
    """The pieces of a text; joined they give the text again."""
    return _UNIT.findall(text)


@lru_cache(maxsize=4)
def tokenizer(path: str):
    """The tokenizer of a file, one a worker process."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark gives a task one core
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def _plain(text: str) -> bool:
    """Whether all white space is single blanks and line ends between solid characters."""
    return not (
        text[0] in " \n" or text[-1] in " \n" or "  " in text or "\n\n" in text or " \n" in text or "\n " in text or _UNSURE.search(text)
    )


class _Pieces(dict):
    """The value of each piece met twice or more, a blank (or nothing) in front of it; others are made on demand.

    Most distinct pieces of a corpus come once, so a piece waits in ``young``, which is emptied when
    full, until it comes again.
    """

    def __init__(self, front: str, cache: UnitCache):
        super().__init__()
        self.front, self.cache, self.young = front, cache, {}
        self.mark = front.translate(_BYTES)

    def __missing__(self, piece: str):
        cache, young = self.cache, self.young
        value = young.pop(piece, None)
        if value is not None:
            if len(self) >= cache.most:
                self.clear()
            self[piece] = value
            return value
        if cache.direct and piece.isascii() and piece.isalpha() and self is not cache.whole:
            tokens = cache.merge(piece.lower() if cache.lower else self.mark + piece)
            value = len(tokens) if cache.counts else array(cache.kind, [t.id for t in tokens]).tobytes()
        else:
            value = cache.make(piece, self)
        if len(piece) <= cache.longest:
            if len(young) >= cache.most:
                young.clear()
            young[piece] = value
        return value


class UnitCache:
    """The ids of each piece (as little-endian numbers of ``width`` bytes), or how many there are.

    Words of Latin letters are one pre-token, which the library's model merges as it is; whatever
    else comes is encoded by the library as a text.  At most ``most`` pieces are kept of those after
    a blank, and as many of the others, and as many again of those met once.
    """

    def __init__(self, path: str, counts: bool = False, width: int = 4, most: int = 200_000, longest: int = 48):
        self.tokenizer, self.counts, self.most, self.longest = tokenizer(path), counts, most, longest
        self.kind = {2: "H", 4: "I"}[width]
        self.merge = self.tokenizer.model.tokenize
        lower = self.tokenizer.normalizer is not None
        #: whether the library gives single words what its model gives them; else they are encoded as texts
        self.direct = all(self._merged(w, f, lower) == self._encoded(f + w) for w in ("A", "word", "\u00c9t\u00e9", "Stra\u00dfe", "\u00f1andu") for f in (" ", ""))
        self.lower = lower
        self.marks = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.spaced, self.bare, self.whole = _Pieces(" ", self), _Pieces("", self), _Pieces("", self)
        self.line_end = self._encoded("\n")

    def _value(self, ids: list[int]) -> bytes | int:
        return len(ids) if self.counts else array(self.kind, ids).tobytes()

    def _encoded(self, text: str) -> bytes | int:
        return self._value(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def _merged(self, word: str, front: str, lower: bool) -> bytes | int:
        text = word.lower() if lower else front + word  # a lower-casing tokenizer drops white space
        return self._value([t.id for t in self.merge(text.encode().decode("latin-1").translate(_BYTES))])

    def make(self, piece: str, among: _Pieces) -> bytes | int:
        if among is not self.whole:
            if piece[0] == "\n":  # a line end, and a piece without a blank in front of it
                return self.line_end + self.bare[piece[1:]]
            m = _LETTERS.fullmatch(piece)
            if m:
                if m[2]:
                    return among[m[1]] + self.bare[m[2]]
                return self._merged(piece, among.front, self.lower) if self.direct else self._encoded(among.front + piece)
        return self._encoded(among.front + piece)

    def of_text(self, text: str | None) -> list:
        """The values of a text's pieces, in order."""
        if not text:
            return []
        if any(m in text for m in self.marks):
            return [self._encoded(text)]
        if not _plain(text):
            return list(map(self.whole.__getitem__, units(text)))
        first, *rest = text.replace("\n", " \n").split(" ")
        return [self.bare[first], *map(self.spaced.__getitem__, rest)]

    def of_texts(self, texts: list[str | None]) -> list[list]:
        return [self.of_text(t) for t in texts]


def unit_cache(path: str, counts: bool = False, width: int = 4) -> UnitCache:
    """The cache of a worker process, which serves all tasks of a stage."""
    return worker_value(("units", path, counts, width), lambda: UnitCache(path, counts, width))
