"""Tokens of Java source text and the brackets between them, each in one pass that never goes back."""

from __future__ import annotations

import bisect
import re

#: Words before a parenthesis that the pattern mode takes for no call and no method.
KEYWORDS = {"if", "for", "while", "switch", "catch", "return", "new", "super", "this", "throw", "try", "synchronized"}
KINDS = {"class": "Class", "interface": "Interface", "enum": "Enum", "@interface": "Annotation", "record": "Class"}

#: Possessive repeats: no alternative is tried twice, and a literal or comment that is never closed ends with the line or text.
_TOKEN = re.compile(
    r"""(?P<skip>\s++|//[^\n]*+|/\*(?:[^*]++|\*(?!/))*+(?:\*/|\Z))
    |(?P<literal>\"{3}(?:[^"\\]++|\\.|"(?!""))*+(?:\"{3}|\Z)|"(?:[^"\\\n]++|\\[^\n])*+"?|'(?:[^'\\\n]++|\\[^\n])*+'?|\d[\w.]*+)
    |(?P<word>[\w$]++)
    |(?P<mark>->|::|.)""",
    re.X | re.S,
)
_PAIRS = {")": "(", "}": "{", "]": "["}


class Lines:
    """Line of an offset, from the line starts found once."""

    def __init__(self, text: str):
        self.starts = [0, *(m.end() for m in re.finditer("\n", text))]

    def at(self, offset: int) -> int:
        return bisect.bisect_right(self.starts, offset)


class Tokens:
    """Words, literals and marks of a source, without comments, as lists by token: text, start, end, whether it is a word.

    match: closing token of each opening bracket; around: the innermost bracket that a token stands in (-1: none); commas:
    commas directly within a bracket; angle: the > of each < between which only parts of types stand. A bracket that is
    never closed, or closes nothing, is a fault of the source.
    """

    def __init__(self, source: str):
        self.source = source
        self.text: list[str] = []
        self.start: list[int] = []
        self.end: list[int] = []
        self.word: list[bool] = []
        self.literal: list[bool] = []
        for m in _TOKEN.finditer(source):
            if m.lastgroup != "skip":
                self.text.append(m[0])
                self.start.append(m.start())
                self.end.append(m.end())
                self.word.append(m.lastgroup == "word")
                self.literal.append(m.lastgroup == "literal")
        self.match: dict[int, int] = {}
        self.commas: dict[int, int] = {}
        self.angle: dict[int, int] = {}
        self.around: list[int] = []
        self._brackets()

    def _brackets(self) -> None:
        open_at, angles = [], []
        for i, t in enumerate(self.text):
            if self.literal[i]:
                self.around.append(open_at[-1] if open_at else -1)
                angles.clear()
                continue
            if t in _PAIRS and len(t) == 1:
                if not open_at or self.text[open_at[-1]] != _PAIRS[t]:
                    raise ValueError("a bracket closes nothing")
                self.match[open_at.pop()] = i
            self.around.append(open_at[-1] if open_at else -1)
            if t in ("(", "{", "["):
                open_at.append(i)
                self.commas[i] = 0
            elif t == "," and open_at:
                self.commas[open_at[-1]] += 1
            if t == "<":
                angles.append(i)
            elif t == ">":
                if angles:
                    self.angle[angles.pop()] = i
            elif not (self.word[i] and t != "new" or t in (".", ",", "?", "&", "[", "]", "@")):
                angles.clear()
        if open_at:
            raise ValueError("a bracket is never closed")

    def __len__(self) -> int:
        return len(self.text)

    def at(self, i: int) -> str:
        return self.text[i] if 0 <= i < len(self.text) else ""

    def is_word(self, i: int) -> bool:
        return 0 <= i < len(self.text) and self.word[i]

    def between(self, i: int, j: int) -> str:
        """The source from token i to token j, which belongs to it."""
        return self.source[self.start[i] : self.end[j]] if i <= j else ""
