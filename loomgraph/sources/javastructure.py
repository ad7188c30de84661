"""Structural parse: declarations and calls by a cursor over tokens, in linear time.

A stack of frames says what stands at the cursor: members of a type, constants of an enum, or code. An anonymous class is
no type; its members belong to the type around it, and calls in it to the methods around it as well. A call is known by a
name before a parenthesis; what it is called on is the postfix expression that ends at the dot before it, whose first token
is kept for every token that may end one.
"""

from __future__ import annotations

import re
from bisect import bisect_left

from .javatokens import KEYWORDS, KINDS, Lines, Tokens

MODIFIERS = {"public", "protected", "private", "static", "final", "abstract", "synchronized", "native", "strictfp", "transient", "volatile", "default", "sealed"}
#: Words that are neither the name of a call nor of a type.
STATEMENTS = (KEYWORDS - {"this", "super"}) | {"else", "do", "assert", "case", "instanceof", "yield"}
#: Characters of a receiver's text that are kept: those of a chain of many calls would else grow with its square.
RECEIVER_MOST = 4096


def bare(text: str) -> str:
    """A written type cleaned by the rule of functions.text.clean_type_name."""
    return re.sub(r"\?.*$", "", re.sub(r"\[\]$", "", re.sub(r"<[^<>]*>", "", text.strip())), flags=re.S).strip()


class _Type:
    def __init__(self, kind: str, name: str, start: int):
        self.kind, self.name, self.start, self.end = kind, name, start, start
        self.modifiers: list[str] = []
        self.super_class: str | None = None
        self.interfaces: list[str] = []
        self.fields: list[tuple[int, dict]] = []
        self.methods: list[tuple[int, int, int, dict]] = []  # first token, body from, body to, method
        self.calls: list[tuple[int, int, dict]] = []  # token of the name, its parenthesis or -1, call


class Structure:
    def __init__(self, source: str):
        self.k = Tokens(source)
        self.lines = Lines(source)
        self.package = ""
        self.imports: list[str] = []
        self.types: list[_Type] = []
        self.first: dict[int, int] = {}  # last token of a postfix expression -> its first token
        self.bodies: set[int] = set()  # opening brackets of anonymous classes
        self._walk()

    # --- declarations ---

    def _head(self, i: int) -> tuple[int, list[str]]:
        """(token after annotations and modifiers, the modifiers)."""
        k, found = self.k, []
        while True:
            if k.at(i) == "@" and k.at(i + 1) != "interface" and k.is_word(i + 1):
                i = self._annotation(i)
            elif k.at(i) == "non" and k.at(i + 1) == "-" and k.at(i + 2) == "sealed":
                found.append("non-sealed")
                i += 3
            elif k.at(i) in MODIFIERS and not (k.at(i) == "sealed" and not k.is_word(i + 1)):
                found.append(k.at(i))
                i += 1
            else:
                return i, found

    def _annotation(self, i: int) -> int:
        """The token after the annotation that begins at i."""
        k = self.k
        i += 2
        while k.at(i) == "." and k.is_word(i + 1):
            i += 2
        return k.match[i] + 1 if k.at(i) == "(" else i

    def _kind_at(self, i: int) -> tuple[str, int] | None:
        """(keyword, token of the name) where a type is declared at i."""
        k = self.k
        if k.at(i) == "@" and k.at(i + 1) == "interface" and k.is_word(i + 2):
            return "@interface", i + 2
        if k.at(i) in ("class", "interface", "enum") and k.is_word(i + 1) and k.at(i - 1) != ".":
            return k.at(i), i + 1
        if k.at(i) == "record" and k.is_word(i + 1) and k.at(i + 2) in ("(", "<") and k.at(i - 1) != ".":
            return "record", i + 1
        return None

    def _type(self, start: int, modifiers: list[str], word: str, name: int) -> int:
        """Declares the type; the token of its opening bracket."""
        k, t = self.k, _Type(KINDS[word], self.k.at(name), start)
        t.modifiers = modifiers
        i, parts = name + 1, {}
        part = None
        while k.at(i) != "{":
            if i >= len(k) or k.at(i) in (";", "}", ")"):
                raise ValueError("a type without a body")
            if k.at(i) in ("extends", "implements", "permits"):
                part = k.at(i)
                parts[part] = [i + 1, i]
                i += 1
                continue
            after = k.angle[i] + 1 if i in k.angle else k.match[i] + 1 if i in k.match else i + 1
            if part:
                parts[part][1] = after - 1
            i = after
        texts = {p: k.between(*r) for p, r in parts.items()}
        several = lambda p: [x.strip() for x in texts.get(p, "").split(",") if x.strip()]
        if word == "interface":
            t.interfaces = several("extends")
        else:
            t.super_class, t.interfaces = texts.get("extends") or None, several("implements")
        t.end = k.match[i]
        self.types.append(t)
        self.stack.append(("constants" if word == "enum" else "members", t, t.end))
        return i

    def _written_type(self, i: int) -> int:
        """The token after the type that begins at i; i where none does."""
        k = self.k
        while True:
            while k.at(i) == "@" and k.is_word(i + 1):
                i = self._annotation(i)
            if not k.is_word(i):
                return i
            i += 1
            if i in k.angle:
                i = k.angle[i] + 1
            while k.at(i) == "[" and k.at(i + 1) == "]":
                i += 2
            while k.at(i) == "." and k.at(i + 1) == ".":
                i += 1
            if k.at(i) != ".":
                return i
            i += 1

    def _parts(self, i: int, end: int) -> list[tuple[int, int]]:
        """First and last token of the parts between the commas that no bracket encloses, from i up to end."""
        k, out, first = self.k, [], i
        while i < end:
            if k.at(i) == "," and not k.literal[i]:
                out.append((first, i - 1))
                first = i + 1
            i = k.angle[i] + 1 if i in k.angle else k.match[i] + 1 if i in k.match else i + 1
        return [p for p in [*out, (first, end - 1)] if p[0] <= p[1]]

    def _statement_end(self, i: int, end: int) -> int:
        """The semicolon that ends what stands at i, or end."""
        k = self.k
        while i < end and k.at(i) != ";":
            i = k.match[i] + 1 if i in k.match else i + 1
        return i

    def _member(self, t: _Type, i: int, end: int) -> int:
        """One member at i; the token to go on from."""
        k, start = self.k, i
        i, modifiers = self._head(i)
        if i >= end:
            return end
        if k.at(i) == "{":
            self.stack.append(("code", t, k.match[i]))
            return i + 1
        if k.at(i) == ";":
            return i + 1
        kind = self._kind_at(i)
        if kind:
            return self._type(start, modifiers, *kind) + 1
        if i in k.angle:
            i = k.angle[i] + 1
        if not k.is_word(i):
            return k.match[i] + 1 if i in k.match else i + 1
        returned, name = None, i
        if k.at(i + 1) != "(":
            if k.at(i + 1) == "{" and k.at(i) == t.name:  # the short constructor of a record
                self.stack.append(("code", t, k.match[i + 1]))
                return i + 2
            name = self._written_type(i)
            returned = k.between(i, name - 1)
            if not k.is_word(name):
                return max(i + 1, min(name, end))
        if k.at(name + 1) == "(":
            return self._method(t, start, end, modifiers, returned, name)
        stop = self._statement_end(name + 1, end)
        for a, _ in self._parts(name, stop):
            if k.is_word(a):
                t.fields.append((a, {"name": k.at(a), "type": returned or "Object", "modifiers": modifiers, "line": self.lines.at(k.start[a])}))
        self.stack.append(("code", t, stop))
        return name + 1

    def _method(self, t: _Type, start: int, end: int, modifiers: list[str], returned: str | None, name: int) -> int:
        k, i = self.k, self.k.match[name + 1] + 1
        parameters = [k.between(a, b) for a, b in self._parts(name + 2, i - 1)]
        while i < end and k.at(i) not in ("{", ";", "default"):
            i = k.match[i] + 1 if k.at(i) in ("(", "[") else i + 1
        body = (i, k.match[i]) if k.at(i) == "{" and i < end else None
        last = body[1] if body else min(self._statement_end(i, end), end - 1)
        method = {"name": k.at(name), "parameters": parameters, "return_type": returned, "modifiers": modifiers, "is_constructor": returned is None or k.at(name) == t.name,
                  "start_line": self.lines.at(k.start[start]), "end_line": self.lines.at(k.start[last])}
        t.methods.append((start, *(body or (0, -1)), method))
        if body:
            self.stack.append(("code", t, body[1]))
            return i + 1
        return last + 1

    # --- code ---

    def _receiver(self, name: int) -> tuple[int, str | None]:
        """(first token, text of the receiver or None) of the call or member named at token `name`."""
        k, dot = self.k, name - 1
        if k.at(dot) == ">" and dot in self.opened:  # type arguments before the name
            dot = self.opened[dot] - 1
        if k.at(dot) != "." or dot == 0:
            return name, None
        last = dot - 1
        first = self.first.get(last, last)
        if k.at(last) == "super" and k.at(last - 1) == "." and last - 2 >= first:
            last -= 2
        return first, k.source[k.start[first] : min(k.end[last], k.start[first] + RECEIVER_MOST)]

    def _take(self, t: _Type, at: int, name: str, qualifier: str | None, opening: int, line_of: int) -> None:
        t.calls.append((at, opening, {"name": name, "qualifier": qualifier, "arg_count": 0, "line": self.lines.at(self.k.start[line_of])}))

    def _skip_angle(self, i: int) -> int:
        """The token after the type arguments at i, whose commas part no arguments of a call."""
        k, end = self.k, self.k.angle[i]
        if k.around[i] >= 0:
            # A comma in them is counted to the bracket around them.
            k.commas[k.around[i]] -= sum(1 for x in range(i, end) if k.at(x) == "," and k.around[x] == k.around[i])
        return end + 1

    def _creation(self, t: _Type, i: int) -> int:
        """new at i; the token to go on from, its parenthesis or bracket."""
        k = self.k
        first = self.first.get(i - 2, i - 2) if k.at(i - 1) == "." and i >= 2 else i
        j = i + 1
        if j in k.angle:
            j = self._skip_angle(j)
        while k.at(j) == "@" and k.is_word(j + 1):
            j = self._annotation(j)
        begin = j
        while k.is_word(j):
            j += 1
            if j in k.angle:
                j = self._skip_angle(j)
            if k.at(j) != ".":
                break
            j += 1
        if j == begin:
            return i + 1
        self.first[j - 1] = first
        if k.at(j) == "(":
            written = k.between(begin, j - 1)
            clean = bare(written)
            simple = clean.split(".")[-1].strip()
            if simple:
                self._take(t, i, simple, clean if "." in clean else written, j, first)
            close = k.match[j]
            self.first[close] = first
            if k.at(close + 1) == "{":
                self.bodies.add(close + 1)
                self.first[k.match[close + 1]] = first
        return j

    def _code(self, t: _Type, i: int) -> int:
        """One token of code at i; the token to go on from."""
        k, text = self.k, self.k.at(i)
        if k.literal[i]:
            self.first[i] = i
            return i + 1
        if text == "@" and k.is_word(i + 1) and k.at(i + 1) != "interface":
            return self._annotation(i)
        if i in k.match:
            close = k.match[i]
            if text == "{" and i in self.bodies:
                self.stack.append(("members", t, close))
            elif text == "(":
                self.first.setdefault(close, i)
            elif i - 1 in self.first:
                self.first.setdefault(close, self.first[i - 1])
            return i + 1
        if text == "." and i + 1 in k.angle and k.is_word(k.angle[i + 1] + 1):
            self.opened[k.angle[i + 1]] = i + 1
            return self._skip_angle(i + 1)
        if not k.word[i]:
            return i + 1
        kind = self._kind_at(i)
        if kind and (kind[0] != "record" or k.at(i - 1) in ("{", "}", ";") or k.at(i - 1) in MODIFIERS):
            start = i
            while k.at(start - 1) in MODIFIERS:
                start -= 1
            return self._type(start, [k.at(x) for x in range(start, i)], *kind) + 1
        if text == "new":
            return self._creation(t, i)
        if text in STATEMENTS:
            return i + 1
        first, qualifier = self._receiver(i)
        self.first[i] = first
        if k.at(i + 1) == "(" and k.at(i - 1) != "case":
            self.first[k.match[i + 1]] = first
            if text == "this":
                self._take(t, i, t.name, f"{self.package}.{t.name}" if self.package else t.name, i + 1, first)
            elif text == "super":
                clean = bare(t.super_class or "")
                self._take(t, i, clean.split(".")[-1].strip() or "super", clean if "." in clean else None, i + 1, first)
            else:
                self._take(t, i, text, qualifier, i + 1, i)
        return i + 1

    # --- the walk ---

    def _walk(self) -> None:
        k = self.k
        self.opened: dict[int, int] = {}  # > of type arguments before a name -> its <
        self.stack: list[tuple[str, _Type | None, int]] = []
        i = self._file_head()
        while i < len(k):
            if self.stack and i >= self.stack[-1][2]:
                mode, _, end = self.stack.pop()
                i = max(i, end + 1) if k.at(end) in ("}", ";") else max(i, end)
                continue
            mode, t, end = self.stack[-1] if self.stack else ("file", None, len(k))
            if mode == "code":
                i = self._code(t, i)
            elif mode == "members":
                i = self._member(t, i, end)
            elif mode == "constants":
                i = self._constant(t, i, end)
            else:
                start = i
                i, modifiers = self._head(i)
                kind = self._kind_at(i)
                i = self._type(start, modifiers, *kind) + 1 if kind else max(start + 1, k.match.get(i, i) + 1)

    def _constant(self, t: _Type, i: int, end: int) -> int:
        """Constants of an enum: arguments are code, a body holds members."""
        k = self.k
        if k.at(i) == ";":
            self.stack[-1] = ("members", t, end)
            return i + 1
        if k.at(i) == "@" and k.is_word(i + 1):
            return self._annotation(i)
        if k.at(i) == "(":
            self.stack.append(("code", t, k.match[i]))
        elif k.at(i) == "{":
            self.stack.append(("members", t, k.match[i]))
        return i + 1

    def _file_head(self) -> int:
        """Package and imports; the token after them."""
        k, i = self.k, 0
        while i < len(k):
            after, _ = self._head(i)
            if k.at(after) == "package" and not self.imports:
                end = self._statement_end(after, len(k))
                self.package = k.between(after + 1, end - 1).strip()
                i = end + 1
            elif k.at(i) == "import":
                end = self._statement_end(i, len(k))
                static = k.at(i + 1) == "static"
                named = k.between(i + 1 + static, end - 1).strip()
                if named:
                    self.imports.append(("static " if static else "") + named)
                i = end + 1
            elif k.at(i) == ";":
                i += 1
            else:
                return i
        return i

    def rows(self) -> list[dict]:
        out, k = [], self.k
        for t in sorted(self.types, key=lambda t: t.start):
            for _, opening, call in t.calls:
                call["arg_count"] = k.commas[opening] + 1 if k.match[opening] > opening + 1 else 0
            calls = sorted(t.calls, key=lambda c: c[0])
            places = [c[0] for c in calls]
            methods = []
            for _, begin, stop, m in sorted(t.methods, key=lambda m: m[0]):
                methods.append({**m, "calls": [c[2] for c in calls[bisect_left(places, begin) : bisect_left(places, stop)]]})
            out.append({"kind": t.kind, "name": t.name, "modifiers": t.modifiers, "super_class": t.super_class, "interfaces": t.interfaces, "start_line": self.lines.at(k.start[t.start]), "end_line": self.lines.at(k.start[t.end]), "fields": [f for _, f in sorted(t.fields, key=lambda f: f[0])], "methods": methods})
        return out


def parse_by_structure(source: str) -> tuple[str, list[str], list[dict]]:
    """(package, imports, types); ValueError where brackets don't match or a type has no body."""
    s = Structure(source)
    return s.package, s.imports, s.rows()
