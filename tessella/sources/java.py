"""Declarations, imports and uses of Java sources.

A member's container is the simple name of the type around it; supertypes are
sorted and distinct.
"""

from __future__ import annotations

from .kotlin import Parsed, Token, lex

# Words of the language (fixed values).
MODIFIERS = {"public", "private", "protected", "static", "final", "abstract", "native", "synchronized", "transient", "volatile", "strictfp", "default", "sealed", "non"}
WORDS = MODIFIERS | {"class", "interface", "enum", "extends", "implements", "permits", "throws", "import", "package", "return", "new", "if", "else", "for", "while", "do", "switch", "case", "try", "catch", "finally", "throw", "void", "int", "long", "short", "byte", "char", "float", "double", "boolean", "this", "super", "null", "true", "false", "instanceof", "break", "continue", "assert"}
_PAIRS = {"(": ")", "[": "]", "{": "}"}


class Reader:
    def __init__(self, text: str):
        every, clean = lex(text)
        self.out = Parsed(clean=clean)
        self.t: list[Token] = [x for x in every if x.kind not in ("comment", "doc")]
        self.match = {}
        stack: list[int] = []
        for i, x in enumerate(self.t):
            if x.kind == "op" and x.text in _PAIRS:
                stack.append(i)
            elif x.kind == "op" and x.text in _PAIRS.values():
                if stack and _PAIRS[self.t[stack[-1]].text] == x.text:
                    self.match[stack.pop()] = i
                else:
                    self.out.clean = False
        self.out.clean &= not stack
        i = self._header()
        self._body(i, len(self.t), None, "file")
        self.out.usages = [(x.text, x.start, x.end) for x in self.t[i:] if x.kind in ("id", "keyword") and x.text not in WORDS]

    def _is(self, i: int, *texts: str) -> bool:
        return i < len(self.t) and self.t[i].text in texts

    def _skip(self, i: int) -> int:
        return self.match.get(i, i) + 1

    def _angles(self, i: int) -> int:
        depth = 0
        while i < len(self.t):
            depth += self._is(i, "<") - self._is(i, ">")
            i += 1
            if depth <= 0:
                break
        return i

    def _until(self, i: int, *texts: str) -> int:
        while i < len(self.t) and not self._is(i, *texts):
            i = self._skip(i) if self.t[i].text in _PAIRS else i + 1
        return i

    def _header(self) -> int:
        i = 0
        while i < len(self.t):
            if self._is(i, "package"):
                end = self._until(i, ";")
                self.out.package = "".join(x.text for x in self.t[i + 1 : end])
            elif self._is(i, "import"):
                end = self._until(i, ";")
                names = [x.text for x in self.t[i + 1 : end]]
                if names[:1] != ["static"] and names:
                    wild = names[-1] == "*"
                    self.out.imports.append(("".join(names[:-2] if wild else names), None, wild))
            else:
                return i
            i = end + 1
        return i

    def _add(self, i: int, kind: str, container: str | None, **more) -> dict:
        t = self.t[i]
        out = {"name": t.text, "start": t.start, "end": t.end, "kind": kind, "container": container, "arity": None, "min_arity": None, "vararg": False, "receiver": None, "type": None, "supertypes": [], "doc": None, "synthetic": False} | more
        self.out.symbols.append(out)
        return out

    def _parameters(self, i: int) -> list[tuple[int, str, bool]]:
        """(token of the name, type, whether it takes the rest) of the parameters between brackets."""
        end, out, j = self.match.get(i, i), [], i + 1
        while j < end:
            stop = j
            while stop < end and not self._is(stop, ","):
                stop = self._angles(stop) if self._is(stop, "<") else self._skip(stop) if self.t[stop].text in _PAIRS else stop + 1
            part = [k for k in range(j, stop) if self.t[k].kind in ("id", "keyword")]
            if part:
                kind = [x.text for x in self.t[j : part[-1]] if x.text not in MODIFIERS]
                out.append((part[-1], "".join(kind), "".join(kind).endswith("...")))
            j = stop + 1
        return out

    def _type_name(self, lo: int, hi: int) -> list[str]:
        """Simple names in a list of types."""
        out, j, last = [], lo, None
        while j < hi:
            if self._is(j, "<"):
                j = self._angles(j)
                continue
            if self._is(j, ","):
                out.append(last)
                last = None
            elif self.t[j].kind == "id":
                last = self.t[j].text
            j += 1
        return [x for x in [*out, last] if x]

    def _body(self, i: int, end: int, container: str | None, kind: str) -> None:
        if kind == "EnumClass":
            while i < end and self.t[i].kind == "id":
                self._add(i, "EnumEntry", container)
                i += 1
                i = self._skip(i) if self._is(i, "(") else i
                i = self._skip(i) if self._is(i, "{") else i
                i += self._is(i, ",")
            i += self._is(i, ";")
        while i < end:
            i = max(self._member(i, end, container), i + 1)

    def _member(self, i: int, end: int, container: str | None) -> int:
        while i < end and (self.t[i].text in MODIFIERS or self._is(i, "@") and not self._is(i + 1, "interface")):
            if self._is(i, "@"):
                i += 2
                while self._is(i, "."):
                    i += 2
                i = self._skip(i) if self._is(i, "(") else i
            else:
                i += 2 if self._is(i, "non") else 1
        if i >= end:
            return i
        i += self._is(i, "@")
        word = self.t[i].text
        named = i + 1 < end and self.t[i + 1].kind == "id"
        if named and (word in ("class", "interface", "enum") or word == "record" and (self._is(i + 2, "(", "<"))):
            return self._type(i, word)
        if word in _PAIRS:
            return self._skip(i)
        if word == ";":
            return i + 1
        i = self._angles(i) if word == "<" else i
        # a method or constructor has brackets before ; = {
        j = i
        while j < end and not self._is(j, "(", ";", "=", "{", "}"):
            j = self._angles(j) if self._is(j, "<") else self._skip(j) if self._is(j, "[") else j + 1
        if self._is(j, "(") and j > i and self.t[j - 1].kind == "id":
            params = self._parameters(j)
            s = self._add(j - 1, "Function", container, arity=min(len(params), 255), min_arity=sum(not v for _, _, v in params), vararg=any(v for _, _, v in params))
            s["type"] = "".join(x.text for x in self.t[i : j - 1]) or None
            k = self._until(self._skip(j), "{", ";")
            return self._skip(k) if self._is(k, "{") else k + 1
        if self._is(j, "{"):  # a record's short constructor, or what is not known
            return self._skip(j)
        names, k = [], i
        while k <= j and k < len(self.t):
            if self._is(k, "<"):
                k = self._angles(k)
                continue
            if self.t[k].kind == "id" and (k + 1 >= len(self.t) or self._is(k + 1, ";", "=", ",", "[")):
                names.append(k)
            k += 1
        stop = self._until(i, ";")
        if names and container:
            first = names[0]
            kind = "".join(x.text for x in self.t[i:first])
            k = first
            while k < stop:
                if self.t[k].kind == "id" and (k == first or self._is(k - 1, ",")):
                    self._add(k, "Property", container, type=kind)
                k += 1
                while k < stop and not self._is(k, ","):
                    k = self._angles(k) if self._is(k, "<") and self.t[k - 1].kind == "id" and self.t[k - 1].text[:1].isupper() else self._skip(k) if self.t[k].text in _PAIRS else k + 1
                k += 1
        return stop + 1

    def _type(self, i: int, word: str) -> int:
        kind = {"interface": "Interface", "enum": "EnumClass"}.get(word, "Class")
        s = self._add(i + 1, kind, self._around)
        j = i + 2
        j = self._angles(j) if self._is(j, "<") else j
        fields = []
        if word == "record" and self._is(j, "("):
            fields = self._parameters(j)
            s["arity"] = s["min_arity"] = len(fields)
            j = self._skip(j)
        supers: set[str] = set()
        while j < len(self.t) and not self._is(j, "{", ";"):
            if self._is(j, "extends", "implements"):
                k = j + 1
                while k < len(self.t) and not self._is(k, "{", "extends", "implements", "permits"):
                    k += 1
                supers |= set(self._type_name(j + 1, k))
                j = k
            else:
                j += 1
        s["supertypes"] = sorted(supers)
        outer, self._around = self._around, s["name"]
        for at, type_, _ in fields:
            self._add(at, "Property", s["name"], type=type_)
            self._add(at, "Function", s["name"], type=type_, arity=0, min_arity=0, synthetic=True)
        end = self._skip(j)
        if self._is(j, "{"):
            self._body(j + 1, end - 1, s["name"], kind)
        self._around = outer
        return end

    _around: str | None = None


def parse(text: str) -> Parsed:
    return Reader(text).out
