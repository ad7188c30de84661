"""Pattern mode: what a reader of lines sees in a source, comments and literals included, by a cursor over its words.

It finds types that have nothing between their name and extends, implements or the bracket, and skips what they hold of
other types; of methods those that begin a line, have one word for their type or none, no throws clause and a body; of
fields those that fill a line. The opening bracket's line is where a type or method starts. Every step moves on: a run of
annotations and modifiers that leads to no method is not read again from its later lines.
"""

from __future__ import annotations

import re
from bisect import bisect_left

from .javatokens import KEYWORDS, KINDS, Lines

METHOD_MODIFIERS = {"public", "protected", "private", "static", "final", "abstract", "synchronized", "native", "strictfp"}
FIELD_MODIFIERS = {"public", "protected", "private", "static", "final", "transient", "volatile"}
TYPE_MODIFIERS = {"public", "protected", "private", "static", "final", "abstract", "sealed", "non-sealed"}

_PIECE = re.compile(r"\w+|[^\w\s]", re.A)
_WORD = re.compile(r"\w", re.A)
_NAME = re.compile(r"[^\W\d]\w*", re.A)
#: Marks that may stand in a type of one word, and in the name of what a class extends.
_IN_TYPE, _IN_SUPER = set("<>[].?"), set("$.<>")


class _Text:
    """Pieces of the source (runs of word characters, single marks) and where brackets lie."""

    def __init__(self, source: str):
        self.source, self.lines = source, Lines(source)
        self.text: list[str] = []
        self.start: list[int] = []
        for m in _PIECE.finditer(source):
            self.text.append(m[0])
            self.start.append(m.start())
        self.braces = [i for i, t in enumerate(self.text) if t == "{"]
        self.ends = [i for i, t in enumerate(self.text) if t == ")"]
        self.closing: dict[int, int] = {}  # of curly brackets
        self.arguments: dict[int, int] = {}  # of parentheses
        self._brackets()

    def _brackets(self) -> None:
        curly, round_ = [], []  # round: [opening, commas, whether something stands since the last comma]
        count = lambda r: r[1] + 1 if r[2] else 0
        for i, t in enumerate(self.text):
            if t == "{":
                curly.append(i)
            elif t == "}" and curly:
                self.closing[curly.pop()] = i
            if t == "(":
                round_.append([i, 0, False])
            elif t == ")":
                if round_:
                    done = round_.pop()
                    self.arguments[done[0]] = count(done)
            elif round_:
                round_[-1][1] += t == ","
                round_[-1][2] = t != ","
        self.arguments |= {r[0]: count(r) for r in round_}

    def at(self, i: int) -> str:
        return self.text[i] if 0 <= i < len(self.text) else ""

    def word(self, i: int) -> bool:
        return bool(_WORD.match(self.at(i)))

    def name(self, i: int) -> bool:
        return bool(_NAME.fullmatch(self.at(i)))

    def touches(self, i: int) -> bool:
        """Whether no space stands between this piece and the one before."""
        return 0 < i < len(self.text) and self.start[i] == self.start[i - 1] + len(self.text[i - 1])

    def chunk(self, i: int, marks: set[str]) -> int:
        """The piece after the run, without spaces, of words and these marks that begins at i."""
        j = i
        while j < len(self.text) and (self.text[j] in marks or self.word(j)) and (j == i or self.touches(j)):
            j += 1
        return j

    def written(self, i: int, j: int) -> str:
        """The source of the pieces from i up to j."""
        return self.source[self.start[i] : self.start[j - 1] + len(self.text[j - 1])]

    def first_of_line(self, i: int) -> bool:
        return i == 0 or self.lines.at(self.start[i]) > self.lines.at(self.start[i - 1])

    def next_of(self, places: list[int], i: int) -> int:
        """The first of places from piece i on, or the end."""
        at = bisect_left(places, i)
        return places[at] if at < len(places) else len(self.text)


def _parts(text: str) -> list[str]:
    return [p.strip() for p in text.split(",") if p.strip()]


def _heading(t: _Text, word: str) -> list[tuple[int, bool, str]]:
    """(place, static, name) of the lines "<word> [static] name;"."""
    out = []
    for i, piece in enumerate(t.text):
        if piece != word or not t.first_of_line(i) or t.touches(i + 1):
            continue
        i += 1
        static = word == "import" and t.at(i) == "static" and not t.touches(i + 1)
        i += static
        j = t.chunk(i, {".", "*"} if word == "import" else {"."})
        if j > i and t.at(j) == ";":
            out.append((i, static, t.written(i, j)))
    return out


def _type_at(t: _Text, i: int, least: int) -> dict | None:
    """The type whose keyword is piece i, from the pieces after `least` on."""
    if t.at(i) not in ("class", "interface", "enum") or t.touches(i + 1) or not t.name(i + 1):
        return None
    up, across, j = None, [], i + 2
    if t.at(j) == "extends" and not t.touches(j) and j + 1 < len(t.text) and not t.touches(j + 1):
        after = t.chunk(j + 1, _IN_SUPER)
        if after == j + 1:
            return None
        up, j = t.written(j + 1, after), after
    if t.at(j) == "implements" and not t.touches(j) and not t.touches(j + 1):
        brace = t.next_of(t.braces, j)
        if brace >= len(t.text) or brace == j + 1:
            return None
        across, j = _parts(t.source[t.start[j + 1] : t.start[brace]]), brace
    if t.at(j) != "{":
        return None
    modifiers, back = [], i - 1
    while back > least:
        whole = "non-sealed" if t.at(back) == "sealed" and t.touches(back) and t.at(back - 1) == "-" and t.at(back - 2) == "non" else t.at(back)
        if whole not in TYPE_MODIFIERS:
            break
        modifiers.insert(0, whole)
        back -= 3 if whole == "non-sealed" else 1
    return {"kind": KINDS[t.at(i)], "name": t.at(i + 1), "modifiers": modifiers, "super_class": up, "interfaces": across, "opening": j}


def _fields(t: _Text, opening: int, stop: int) -> list[dict]:
    out, first = [], t.lines.at(opening)
    for n, line in enumerate(t.source[opening + 1 : stop].split("\n")):
        line = line.split("//")[0].strip()
        if not line.endswith(";") or "(" in line or line.startswith("@") or ";" in line[:-1]:
            continue
        left, equals, value = line[:-1].partition("=")
        words = left.split()
        if len(words) < 2 or equals and not value or not _NAME.fullmatch(words[-1]) or set(words[:-2]) - FIELD_MODIFIERS:
            continue
        written = words[-2]
        if (written[0].isalpha() or written[0] == "_") and all(c.isalnum() or c == "_" or c in _IN_TYPE for c in written):
            out.append({"name": words[-1], "type": written, "modifiers": words[:-2], "line": first + n})
    return out


def _method_at(t: _Text, i: int, end: int) -> tuple[dict | None, int]:
    """(method or None, piece to go on from) of the head that begins with piece i, the first of a line."""
    while t.at(i) == "@" and t.touches(i + 1) and i + 1 < end:
        i += 2
        if t.at(i) == "(" and t.touches(i):
            i = t.next_of(t.ends, i) + 1
    modifiers = []
    while i < end and t.at(i) in METHOD_MODIFIERS and t.at(i + 1) != "(" and not t.touches(i + 1):
        modifiers.append(t.at(i))
        i += 1
    returned, name = None, i
    if t.at(i + 1) != "(":
        name = t.chunk(i, _IN_TYPE)
        if name == i or not (t.at(i)[0].isalpha() or t.at(i)[0] == "_"):
            return None, i + 1 if name == i else name
        returned = t.written(i, name)
    if not t.name(name) or t.at(name + 1) != "(":
        return None, max(name, i + 1)
    close = t.next_of(t.ends, name + 2)
    if close >= end or t.at(close + 1) != "{":
        return None, name + 2
    inner = t.source[t.start[name + 1] + 1 : t.start[close]]
    return {"name": t.at(name), "parameters": _parts(inner), "return_type": returned, "modifiers": modifiers, "opening": close + 1}, close + 2


def _methods(t: _Text, opening: int, stop: int) -> list[dict]:
    out, i, begins = [], opening + 1, True
    while i < stop:
        if not (begins or t.first_of_line(i)):
            i += 1
            continue
        begins = False
        method, after = _method_at(t, i, stop)
        if method and method["name"] not in KEYWORDS:
            out.append(method)
        i = after
    return out


def _calls(t: _Text, opening: int, stop: int) -> tuple[list[int], list[dict]]:
    """(pieces, calls) between two pieces: a name before a parenthesis, with the names and dots that lead to it."""
    places, out, least = [], [], opening + 1
    for i in range(opening + 1, stop):
        if t.text[i] != "(" or i - 1 < least or not t.name(i - 1):
            continue
        first = i - 1
        while first - 2 >= least and t.at(first - 1) == "." and t.name(first - 2):
            first -= 2
        least = i + 1
        if t.at(i - 1) not in KEYWORDS:
            places.append(first)
            out.append({"name": t.at(i - 1), "qualifier": "".join(t.text[first : i - 2]) or None, "arg_count": t.arguments[i], "line": t.lines.at(t.start[first])})
    return places, out


def parse_by_pattern(source: str) -> tuple[str, list[str], list[dict]]:
    """(package, imports, types); any text gives a result."""
    t, types, i, least = _Text(source), [], 0, -1
    while i < len(t.text):
        found = _type_at(t, i, least)
        if not found:
            i += 1
            continue
        opening = found.pop("opening")
        stop = t.closing.get(opening, len(t.text))
        end_of = lambda p: t.start[p] if p < len(t.text) else max(len(source) - 1, 0)
        line_of = lambda p: t.lines.at(end_of(p))
        places, calls = _calls(t, opening, stop)
        methods = []
        for m in _methods(t, opening, stop):
            begin = m.pop("opening")
            end = t.closing.get(begin, len(t.text))
            methods.append({**m, "is_constructor": m["name"] == found["name"], "start_line": line_of(begin), "end_line": line_of(end), "calls": calls[bisect_left(places, begin) : bisect_left(places, end)]})
        types.append({**found, "start_line": line_of(opening), "end_line": line_of(stop), "fields": _fields(t, t.start[opening], end_of(stop)), "methods": methods})
        i = least = stop + 1
        least -= 1
    package = _heading(t, "package")
    return package[0][2] if package else "", [("static " if s else "") + name for _, s, name in _heading(t, "import")], types
