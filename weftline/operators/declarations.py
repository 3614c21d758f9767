"""Declarations of Java, JavaScript, TypeScript, Go and Rust sources, by their headers and matching brackets."""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

_SPACE = r"[^\S\n]+|//[^\n]*|/\*.*?(?:\*/|\Z)"
_DQ, _SQ = r'"(?:[^"\\\n]|\\.)*+"', r"'(?:[^'\\\n]|\\.)*+'"
_TEMPLATE = r"`(?:[^`\\$]|\\.|\$(?!\{)|\$\{(?:[^{}`]|`[^`]*+`|\{[^{}]*+\})*+\})*+`|`(?:[^`\\]|\\.)*+`"
_WORD, _REST = r"[\w$]+", r"=>|->|:=|::|\.\.\.|</|/>|."
_STRINGS = {
    "java": rf'"""(?:[^\\]|\\.)*?"""|{_DQ}|{_SQ}',
    "go": rf"{_DQ}|`[^`]*`|'(?:[^'\\\n]|\\[^\n]{{1,9}}?)'",
    "rust": rf"""b?r(?P<h>\#*)".*?"(?P=h)|[bc]?"(?:[^"\\]|\\.)*+"|b?'(?:[^'\\\n]|\\(?:u\{{[^}}]*\}}|x[0-9a-fA-F]{{2}}|.))'|'\w+""",
    "script": rf"{_DQ}|{_SQ}|{_TEMPLATE}",
}
_TOKEN = {k: re.compile(rf"(?P<space>{_SPACE})|(?P<string>{s})|(?P<word>\#?{_WORD})|(?P<nl>\n)|(?P<op>{_REST})" if k == "script" else rf"(?P<space>{_SPACE})|(?P<string>{s})|(?P<word>{_WORD})|(?P<nl>\n)|(?P<op>{_REST})", re.S) for k, s in _STRINGS.items()}
_REGEX = re.compile(r"/(?![*/>])(?:[^/\\\[\n]|\\.|\[(?:[^\]\\\n]|\\.)*+\])++/\w*")
#: Words behind which an expression begins.
_AWAIT = {"return", "typeof", "case", "in", "of", "instanceof", "delete", "void", "throw", "new", "else", "do", "yield", "await", "default"}
_PAIRS = {"(": ")", "[": "]", "{": "}"}
_JAVA_MODIFIERS = {"public", "protected", "private", "static", "final", "abstract", "native", "synchronized", "default", "strictfp", "transient", "volatile", "sealed", "non", "-"}
_RUST_MODIFIERS = {"pub", "async", "const", "unsafe", "extern", "default", "auto"}
_SCRIPT_MODIFIERS = {"public", "protected", "private", "static", "async", "get", "set", "readonly", "override", "abstract", "declare", "accessor"}


class Declaration(NamedTuple):
    kind: str
    depth: int
    name: str | None
    start: int
    end: int


class _Source:
    """Tokens of a text without comments and line breaks; ``broken[i]`` says that a line break stands before token i."""

    def __init__(self, text: str, language: str):
        self.script = language in ("javascript", "typescript")
        self.language = language
        self.t: list[str] = []
        self.kind: list[str] = []
        self.at: list[int] = []
        self.broken: list[bool] = []
        token, p, nl = _TOKEN["script" if self.script else language], 0, True
        if text[:1] == "﻿":
            p = 1
        while p < len(text):
            m = token.match(text, p)
            kind = m.lastgroup if m.lastgroup != "h" else "string"
            if self.script and kind == "op" and text[p] == "/" and self._expects():
                m = _REGEX.match(text, p) or m
                kind = "string" if m.end() > p + 1 and m.re is _REGEX else kind
            if kind == "nl" or kind == "space" and "\n" in m.group():
                nl = True
            elif kind != "space":
                self.t.append(m.group())
                self.kind.append(kind)
                self.at.append(p)
                self.broken.append(nl)
                nl = False
            p = m.end()
        self.n = len(self.t)
        self.close: dict[int, int] = {}
        self.whole = self._match()

    def _expects(self) -> bool:
        """Whether an expression, not an operator, comes next."""
        return not self.t or self.t[-1] in _AWAIT or self.kind[-1] == "op" and self.t[-1] not in (")", "]", "}", "<")

    def _match(self) -> bool:
        stack: list[int] = []
        for i, (x, k) in enumerate(zip(self.t, self.kind)):
            if k != "op":
                continue
            if x in _PAIRS:
                stack.append(i)
            elif x in ")]}":
                if not stack or _PAIRS[self.t[stack[-1]]] != x:
                    return False
                self.close[stack.pop()] = i
        return not stack

    def word(self, i: int) -> bool:
        return 0 <= i < self.n and self.kind[i] == "word"

    def is_(self, i: int, *words: str) -> bool:
        return 0 <= i < self.n and self.kind[i] != "string" and self.t[i] in words

    def end(self, i: int) -> int:
        """Offset behind token i."""
        return self.at[i] + len(self.t[i])

    def angles(self, i: int) -> int:
        """The token behind a ``<...>`` that begins at i; i itself where there is none."""
        if not self.is_(i, "<"):
            return i
        depth, k = 0, i
        while k < self.n:
            if self.is_(k, "<"):
                depth += 1
            elif self.is_(k, ">"):
                depth -= 1
                if not depth:
                    return k + 1
            elif self.is_(k, ";", ")", "}", "]"):
                return i
            k = self.close.get(k, k) + 1
        return i

    def body(self, i: int, types: tuple[str, ...] = ()) -> int | None:
        """The brace that opens the body behind a header at i; None where ``;``, the end of the scope or, in scripts and Go, a line's end comes first.
        A brace behind one of ``types`` is part of a type."""
        k = i
        while k < self.n:
            if self.is_(k, "{"):
                if not self.is_(k - 1, *types):
                    return k
            elif self.is_(k, ";", "}", ")", "]"):
                return None
            elif k > i and self.broken[k] and (self.language == "go" or self.script and self.starts(k) and not self.is_(k, "extends", "implements")):
                return None
            k = self.close.get(k, k) + 1
        return None

    def starts(self, i: int) -> bool:
        """Whether a statement of a script can begin at token i: behind a bracket, a semicolon, or a line break that ends the one before."""
        if i == 0 or self.is_(i - 1, ";", "{", "}", "export", "default", "else", "declare"):
            return True
        if not self.broken[i] or self.is_(i, "in", "instanceof", "of", "as", "satisfies", "{"):
            return False
        before = self.kind[i - 1] != "op" and self.t[i - 1] not in _AWAIT - {"return"} or self.is_(i - 1, ")", "]", "}", ">")
        return before and (self.kind[i] == "word" or self.kind[i] == "string" and self.t[i][0] not in "`" or self.is_(i, "@", "!", "~"))

    def script_end(self, i: int) -> int | None:
        """The last token of a declaration of variables at i; None where it is the head of a loop over members."""
        k = i + 1
        while k < self.n:
            if self.is_(k, ";"):
                return k
            if self.is_(k, ")", "]", "}"):
                return None if self.is_(k, ")") else k - 1
            if k > i + 1 and self.broken[k] and self.starts(k):
                return k - 1
            k = self.close.get(k, k) + 1
        return self.n - 1

    def back(self, i: int, modifiers: set[str]) -> int:
        """The first token of the modifiers and annotations that stand before token i."""
        opens = {v: k for k, v in self.close.items()} if not hasattr(self, "_opens") else self._opens
        self._opens = opens
        while i > 0:
            k = i - 1
            if self.is_(k, *modifiers) or self.language == "rust" and self.kind[k] == "string" and self.is_(k - 1, "extern"):
                i = k
            elif self.is_(k, ")") and self.language == "rust" and self.is_(opens[k] - 1, "pub"):
                i = opens[k]
            elif self.language != "rust":
                k = opens[k] - 1 if self.is_(k, ")") else k
                while self.word(k) and self.is_(k - 1, "."):
                    k -= 2
                if not (self.word(k) and self.is_(k - 1, "@")):
                    return i
                i = k - 1
            else:
                return i
        return i


def _java(s: _Source, i: int, scope: tuple) -> tuple | None:
    x = s.t[i]
    if x in ("class", "interface", "enum", "record") and s.word(i) and s.word(i + 1) and not s.is_(i - 1, ".", "@"):
        b = s.body(i + 2)
        if b is not None and (x in ("class", "interface") or not s.is_(i + 2, "=")):
            kind = f"{x}_declaration" if x in ("class", "interface") else None
            return kind, s.t[i + 1], s.back(i, _JAVA_MODIFIERS), s.close[b], b, "class"
    if s.is_(i, "new"):  # an anonymous class
        k = i + 1
        while s.word(k) or s.is_(k, "."):
            k += 1
        k = s.angles(k)
        if s.is_(k, "(") and s.is_(s.close[k] + 1, "{"):
            return None, None, i, s.close[s.close[k] + 1], s.close[k] + 1, "class"
    if scope[0] == "class" and s.is_(i - 1, "{", "}", ";") and (s.word(i) or s.is_(i, "@", "<")):
        k, words = i, 0
        while k < s.n and not s.is_(k, "("):
            if s.is_(k, "@") and s.word(k + 1) and not s.is_(k + 1, "interface"):
                k += 2
                while s.is_(k, "."):
                    k += 2
                k = s.close[k] + 1 if s.is_(k, "(") else k
                continue
            if s.is_(k, "<"):
                after = s.angles(k)
                if after == k:
                    return None
                k = after
                continue
            if not (s.word(k) or s.is_(k, ".", "[", "]", "-")):
                return None
            words += s.word(k) and s.t[k] not in _JAVA_MODIFIERS
            k += 1
        if k < s.n and words and s.word(k - 1) and (words > 1 or s.t[k - 1] == scope[1]):
            e = s.close[k] + 1
            while e < s.n and not s.is_(e, "{", ";", "}"):
                e = s.close.get(e, e) + 1
            if s.is_(e, "{", ";"):
                kind = "method_declaration" if words > 1 else "constructor_declaration"
                return kind, s.t[k - 1], i, s.close.get(e, e), e if s.is_(e, "{") else None, "block"
    return None


def _script(s: _Source, i: int, scope: tuple) -> tuple | None:
    x = s.t[i]
    if s.word(i) and not s.is_(i - 1, "."):
        if x == "function" and s.word(i + 1):
            first = i - 1 if s.is_(i - 1, "async") and not s.broken[i] else i
            p = s.angles(i + 2)
            b = s.body(s.close[p] + 1, (":", "|", "&", "=>", "<", ",")) if s.is_(p, "(") else None
            if b is not None and s.starts(first):
                return "function_declaration", s.t[i + 1], first, s.close[b], b, "block"
        if x in ("class", "interface") and not s.is_(i + 1, ":", "(", "=", ",", "?"):
            b = s.body(i + 1, ("<", ":", "|", "&", ","))
            if b is not None:
                named = s.word(i + 1) and s.t[i + 1] not in ("extends", "implements")
                abstract = s.is_(i - 1, "abstract")
                first = s.back(i, set())
                if x == "class":
                    kind = "class_declaration" if named and not abstract and s.starts(first) else None
                    return kind, s.t[i + 1] if named else None, first, s.close[b], b, "class"
                if named and s.language == "typescript" and s.starts(i):
                    return "interface_declaration", s.t[i + 1], i, s.close[b], b, "type"
        if x in ("const", "let", "var") and not s.is_(i + 1, "enum") and (s.word(i + 1) or s.is_(i + 1, "{", "[")) and (s.starts(i) or s.is_(i - 1, "(") and s.is_(i - 2, "for")):
            e = s.script_end(i)
            if e is not None:
                k = i + 1
                return "variable_declaration" if x == "var" else "lexical_declaration", s.t[k] if s.word(k) else None, i, e, None, None
    if scope[0] in ("class", "object") and (s.is_(i - 1, "{", "}", ";", ",") or scope[0] == "class" and s.broken[i] and s.starts(i)):
        k = i
        while s.is_(k, "@") and s.word(k + 1):
            k += 2
            while s.is_(k, "."):
                k += 2
            k = s.close[k] + 1 if s.is_(k, "(") else k
        while (s.is_(k, *_SCRIPT_MODIFIERS) and not s.is_(k + 1, "(", "<", "?", "=", ":", ";", ",", "}")) or s.is_(k, "*"):
            k += 1
        name = s.t[k] if k < s.n and s.kind[k] in ("word", "string") else None
        k = s.close[k] + 1 if s.is_(k, "[") else k + 1 if name else s.n
        k += s.is_(k, "?", "!")
        k = s.angles(k)
        if s.is_(k, "("):
            b = s.body(s.close[k] + 1, (":", "|", "&", "=>", "<", ","))
            if b is not None and (b == s.close[k] + 1 or s.is_(s.close[k] + 1, ":")):
                return "method_definition", name and name.strip("\"'"), i, s.close[b], b, "block"
    return None


def _go(s: _Source, i: int, scope: tuple) -> tuple | None:
    x = s.t[i]
    if not s.word(i) or x not in ("func", "type") or not (s.broken[i] or s.is_(i - 1, ";", "{")):
        return None
    if x == "type":
        k = e = i + 1
        while k < s.n and not s.is_(k, ";", "}", ")") and (not s.broken[k] or k == i + 1):
            e = s.close.get(k, k)
            k = e + 1
        name = i + 1 + s.is_(i + 1, "(")
        return ("type_declaration", s.t[name] if s.word(name) else None, i, e, None, None) if e > i + 1 or s.is_(i + 1, "(") else None
    method = s.is_(i + 1, "(")
    k = s.close[i + 1] + 1 if method else i + 1
    if scope[0] is not None or not s.word(k):
        return None
    name, k = s.t[k], k + 1
    k = s.close[k] + 1 if s.is_(k, "[") else k
    if not s.is_(k, "("):
        return None
    e = s.close[k]
    b = s.body(e + 1, ("interface", "struct")) if e + 1 < s.n and not s.broken[e + 1] else None
    if b is None:  # without a body: up to the end of the line
        while e + 1 < s.n and not s.broken[e + 1] and not s.is_(e + 1, ";"):
            e = s.close.get(e + 1, e + 1)
    return "method_declaration" if method else "function_declaration", name, i, e if b is None else s.close[b], b, "block"


def _rust(s: _Source, i: int, scope: tuple) -> tuple | None:
    x = s.t[i]
    if not s.word(i) or x not in ("fn", "impl", "struct", "trait", "enum"):
        return None
    first = s.back(i, _RUST_MODIFIERS)
    if first and not s.is_(first - 1, ";", "{", "}", "]", ")"):
        return None
    if x == "impl":
        b = s.body(i + 1)
        if b is None:
            return None
        k, name = s.angles(i + 1), None
        while k < b and not s.is_(k, "where"):
            if s.is_(k, "<"):
                after = s.angles(k)
                k = after if after > k else k + 1
                continue
            if s.is_(k, "for"):
                name = None
            elif s.word(k) and (name is None or s.is_(k - 1, "::")) and s.t[k] not in ("mut", "dyn", "const"):
                name = s.t[k]
            k += 1
        return "impl_item", name, first, s.close[b], b, "block"
    if not s.word(i + 1):
        return None
    b = s.body(i + 2)
    kind = "function_item" if x == "fn" else f"{x}_item"
    if b is not None:
        return kind, s.t[i + 1], first, s.close[b], b, "block"
    if x == "struct":
        k = i + 2
        while k < s.n and not s.is_(k, ";", "}"):
            k = s.close.get(k, k) + 1
        if s.is_(k, ";"):
            return kind, s.t[i + 1], first, k, None, None
    return None


_FIND = {"java": _java, "javascript": _script, "typescript": _script, "go": _go, "rust": _rust}


def _arrow(s: _Source, first: int, last: int) -> int | None:
    """First token of the arrow function that a declaration of one name is set to."""
    k = first + 2
    while k < last and not s.is_(k, "=", ";"):
        k = s.close.get(k, k) + 1
    k += 1
    a = k + 1 if s.is_(k, "async") else k
    e = s.close[a] + 1 if s.is_(a, "(") else a + 1
    while e < last and s.is_(a, "(") and not s.is_(e, "=>", ";", "="):
        e = s.close.get(e, e) + 1
    return k if e < last and s.is_(e, "=>") else None


def declarations(text: str, language: str, most: int | None, kinds: list[str] | None = None) -> Iterator[Declaration]:
    """Declarations in order, of at most ``most`` characters and outermost first: one that fits is not entered, a longer one is. Without ``most``
    all come out, entered as well; of ``kinds`` only, if given: others are entered. Offsets are in characters. None for a text whose brackets do not match, or a Go text without its package clause.

    The depth is that of a syntax tree as far as braces tell it: 1 at the top, 2 more for each brace around, 1 more behind ``export``."""
    s = _Source(text, language)
    if not s.whole or language == "go" and not s.is_(0, "package"):
        return
    find, scopes, i = _FIND[language], {}, 0
    inside: list[tuple[int, str | None, str | None]] = [(s.n, None, None)]
    while i < s.n:
        while len(inside) > 1 and i >= inside[-1][0]:
            inside.pop()
        found = find(s, i, inside[-1][1:]) if s.kind[i] != "op" or s.t[i] in "@<[*#" else None
        if found:
            kind, name, first, last, brace, scope = found
            if brace is not None:
                scopes[brace] = (scope, name)
            opening, deeper = first, 0
            if kinds is not None and kind in ("lexical_declaration", "variable_declaration") and "arrow_function" in kinds:
                start = _arrow(s, first, last)
                if start is not None:
                    kind, first, last, deeper = "arrow_function", start, last - s.is_(last, ";"), 2
            if kind and (kinds is None or kind in kinds):
                wrapped = s.is_(opening - 1, "export") or s.is_(opening - 1, "default") and s.is_(opening - 2, "export")
                fits = most is not None and s.end(last) - s.at[first] <= most
                if fits or most is None:
                    yield Declaration(kind, 1 + 2 * (len(inside) - 1) + bool(s.script and wrapped) + deeper, name, s.at[first], s.end(last))
                if fits:
                    i = last + 1
                    continue
        if s.is_(i, "{"):
            obj = s.script and s.is_(i - 1, "=", "(", ",", "[", ":", "return", "?", "&", "|", "...", "default")
            inside.append((s.close[i], *scopes.get(i, ("object" if obj else "block", None))))
        i += 1
