"""Packrat parsing-expression grammars over token kinds.

A lexer turns a text into a string with one character for each token, its kind. Grammars are written as text:

    Rule <- expr        "tok" a token by its text     IDENT NUM STR ...  a token by its class
    a b / c * + ? & !   as usual                      @Role  a bracket group whose inside matches the rule Role

Bracket groups are parsed from the innermost outwards: each is replaced by one character that says which of the roles of
its bracket kind its inside matches in full, so rules see flat strings. Results of rules are kept by position within a unit
(the packrat table), and results of whole units (a group, a statement, a line) by their kinds for all files of a worker, so a
shape that was parsed once is looked up afterwards. Full consumption is required everywhere; the furthest failure of a
file is found by descending to the unit that fails.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

EOF, ERR, NL = "\x03", "\x00", "N"
#: Placeholders of groups: the kind of bracket and a bit for each role.
BASES = {"(": 0xF0000, "[": 0xF4000, "{": 0xF8000}
CLOSE = {"(": ")", "[": "]", "{": "}"}
INNER = re.compile(r"[(\[{][^()\[\]{}]*[)\]}]")
MOST_UNITS = 100_000
#: Levels of brackets that are replaced level by level; what is nested deeper is replaced in one pass with a stack, which is slower for flat texts.
ROUNDS = 48
#: Longer units are parsed each time instead of being kept.
LONGEST = 512
#: A long run of list items of one shape parses as three of them do.
RUN = re.compile(r"(,(?:.:)?.)\1{3,}", re.S)
#: Roles that take any tokens: they say nothing of a group.
TRIVIAL = {"Any", "Tree", "Tokens"}

_GRAMMAR = re.compile(r'\s*(?:#[^\n]*|("(?:[^"\\]|\\.)+")|(@\w+)|(\w+)|(<-)|([/*+?&!().]))')


class Units(dict):
    """Results by unit, bounded: emptied when full."""

    def __init__(self, make):
        self.make = make

    def __missing__(self, unit):
        out = self.make(unit)
        if len(unit) <= LONGEST:
            if len(self) >= MOST_UNITS:
                self.clear()
            self[unit] = out
        return out


@dataclass
class Grammar:
    """rules: grammar text. kinds: token text or class -> character. roles: bracket -> names of rules, of which those in ``lined``
    see newlines and those in ``listed`` (role -> rule of its statements) are cut at ``;`` before parsing."""

    rules: str
    kinds: dict[str, str]
    roles: dict[str, list[str]]
    lined: set[str] = field(default_factory=set)
    listed: dict[str, str] = field(default_factory=dict)
    glue: str = ""

    def __post_init__(self) -> None:
        self.furthest = 0
        self.table: dict[str, object] = {}
        self.number: dict[str, int] = {}
        self.parse_text(self.rules)
        semi = re.escape(self.kinds.get(";", ";"))
        ahead = f"(?:{semi}(?=[{re.escape(self.glue)}])[^{semi}]*)*" if self.glue else ""
        self.cut = re.compile(f"[^{semi}]*{ahead}{semi}?")
        self.groups = Units(self.mask)
        self.whole = {r: Units(lambda u, r=r: self.match(r, u)) for r in {*self.table}}

    # reading the grammar
    def parse_text(self, text: str) -> None:
        toks = [m.groups() for m in _GRAMMAR.finditer(text) if any(m.groups())]
        starts = [i for i in range(len(toks) - 1) if toks[i + 1][3]]
        for a, b in zip(starts, [*starts[1:], len(toks)]):
            name = toks[a][2]
            self.number[name] = len(self.number)
            self.table[name] = toks[a + 2 : b]
        bodies = dict(self.table)
        for name, body in bodies.items():
            self.table[name] = self.rule(name, body)

    def rule(self, name: str, toks: list):
        node, end = self.choice(toks, 0)
        if end != len(toks):
            raise ValueError(f"rule {name}: cannot read {toks[end]}")
        if isinstance(node, frozenset):
            node = self.terminal(node)
        k, width = self.number[name], len(self.number) + 1

        def run(s, p, memo):
            key = p * 1024 + k
            got = memo.get(key)
            if got is None:
                memo[key] = got = node(s, p, memo)
            return got

        return run

    def choice(self, toks, i):
        alts = []
        while True:
            node, i = self.sequence(toks, i)
            alts.append(node)
            if i < len(toks) and toks[i][4] == "/":
                i += 1
            else:
                break
        merged = []
        for a in alts:  # terminals beside each other are one set
            if merged and isinstance(a, frozenset) and isinstance(merged[-1], frozenset):
                merged[-1] |= a
            else:
                merged.append(a)
        if len(merged) == 1:
            return merged[0], i
        parts = tuple(self.terminal(m) if isinstance(m, frozenset) else m for m in merged)

        def run(s, p, memo):
            for f in parts:
                q = f(s, p, memo)
                if q >= 0:
                    return q
            return -1

        return run, i

    def sequence(self, toks, i):
        parts = []
        while i < len(toks) and toks[i][4] not in ("/", ")"):
            node, i = self.item(toks, i)
            parts.append(node)
        if len(parts) == 1:
            return parts[0], i
        fs = tuple(self.terminal(m) if isinstance(m, frozenset) else m for m in parts)

        def run(s, p, memo):
            for f in fs:
                p = f(s, p, memo)
                if p < 0:
                    return -1
            return p

        return run, i

    def item(self, toks, i):
        text, role, name, _, op = toks[i]
        if op in ("&", "!"):
            node, i = self.item(toks, i + 1)
            f = self.terminal(node) if isinstance(node, frozenset) else node
            want = op == "&"

            def look(s, p, memo):
                far = self.furthest
                ok = f(s, p, memo) >= 0
                self.furthest = far
                return p if ok == want else -1

            return look, i
        if op == "(":
            node, i = self.choice(toks, i + 1)
            i += 1
        elif op == ".":
            node, i = (lambda s, p, memo: p + 1 if s[p] != EOF else -1), i + 1
        elif text:
            node, i = frozenset(self.kinds[text[1:-1]]), i + 1
        elif role:
            node, i = self.role_set(role[1:]), i + 1
        elif name in self.kinds:
            node, i = frozenset(self.kinds[name]), i + 1
        else:
            if name not in self.number:
                raise ValueError(f"no rule {name}")
            table = self.table
            node, i = (lambda s, p, memo: table[name](s, p, memo)), i + 1
        while i < len(toks) and toks[i][4] in ("*", "+", "?"):
            node = self.repeat(self.terminal(node) if isinstance(node, frozenset) else node, toks[i][4])
            i += 1
        return node, i

    def repeat(self, f, op):
        if op == "?":
            return lambda s, p, memo: q if (q := f(s, p, memo)) >= 0 else p

        def run(s, p, memo):
            if op == "+":
                p = f(s, p, memo)
                if p < 0:
                    return -1
            while True:
                q = f(s, p, memo)
                if q <= p:
                    return p
                p = q

        return run

    def terminal(self, chars: frozenset):
        def run(s, p, memo):
            if s[p] in chars:
                return p + 1
            if p > self.furthest:
                self.furthest = p
            return -1

        return run

    def role_set(self, role: str) -> frozenset:
        out = set()
        for b, names in self.roles.items():
            if role in names:
                bit = 1 << names.index(role)
                out |= {chr(BASES[b] + m) for m in range(1 << len(names)) if m & bit}
        if not out:
            raise ValueError(f"no role {role}")
        return frozenset(out)

    # parsing units
    def match(self, rule: str, unit: str) -> bool:
        return self.reach(rule, unit) is None

    def reach(self, rule: str, unit: str, memo: dict | None = None) -> int | None:
        """None where the rule consumes the unit; otherwise the furthest position that it failed at."""
        self.furthest = 0
        s = unit + EOF
        end = self.table[rule](s, 0, {} if memo is None else memo)
        return None if end == len(unit) else max(self.furthest, end)

    def accepts(self, rule: str, unit: str, memo: dict | None = None) -> bool:
        """Like match; a list of statements is accepted if each of its parts is, and else parsed as a whole."""
        listed = self.listed.get(rule)
        if listed and ERR not in unit:
            parts = self.cut.findall(unit)
            items, last = self.whole[listed], self.whole[rule]
            if all(items[p] for p in parts[:-2]) and last[parts[-2] if len(parts) > 1 else ""]:
                return True
        return ERR not in unit and self.reach(rule, unit, memo) is None

    def mask(self, group: str) -> str:
        """The placeholder of an innermost group."""
        opener = group[0]
        if group[-1] != CLOSE[opener] or ERR in group:
            return ERR
        inner = group[1:-1]
        inner = RUN.sub(r"\1\1\1", inner)
        flat = inner.replace(NL, "")
        lined: dict = {}
        table: dict = {} if flat != inner else lined  # the readings of one string share its table
        bits = sum(1 << k for k, r in enumerate(self.roles[opener]) if (self.accepts(r, inner, lined) if r in self.lined else self.accepts(r, flat, table)))
        return chr(BASES[opener] + bits)

    def flatten(self, kinds: str) -> str:
        groups = self.groups
        for _ in range(ROUNDS):
            kinds, n = INNER.subn(lambda m: groups[m.group()], kinds)
            if not n or ERR in kinds:
                return kinds
        open_groups: list[list[str]] = [[]]
        for c in kinds:
            if c in BASES:
                open_groups.append([c])
            elif c in ")]}" and len(open_groups) > 1:
                group = open_groups.pop()
                open_groups[-1].append(groups["".join(group) + c])
            else:
                open_groups[-1].append(c)
        return "".join("".join(g) for g in open_groups)

    def furthest_failure(self, rule: str, kinds: str) -> int:
        """Index of the token at which a text that is not accepted fails: the first broken bracket or token, else the furthest
        failure of the innermost unit that fails in its place."""
        bad = kinds.find(ERR)
        stack: list[tuple[str, int]] = []
        units: list[tuple[list, list]] = [([], [])]  # characters and the token or inner unit each stands for
        for i, c in enumerate(kinds):
            if i == bad:
                return i
            if c in BASES:
                stack.append((c, i))
                units.append(([], []))
            elif c in ")]}":
                if not stack or CLOSE[stack[-1][0]] != c:
                    return i
                opener, at = stack.pop()
                chars, where = units.pop()
                holder = self.groups[opener + "".join(chars) + c]
                units[-1][0].append(holder)
                units[-1][1].append((at, opener, chars, where))
            else:
                units[-1][0].append(c)
                units[-1][1].append(i)
        if stack:
            return len(kinds)
        self.spots: dict[int, int] = {}
        return self._descend([rule], *units[0], len(kinds))

    def dead(self, opener: str, holder: str) -> bool:
        bits = ord(holder) - BASES[opener]
        return not any(bits >> k & 1 for k, r in enumerate(self.roles[opener]) if r not in TRIVIAL)

    def _descend(self, rules: list[str], chars: list, where: list, after: int) -> int:
        best, spot = -1, after
        for r in rules:
            keep = [k for k, c in enumerate(chars) if r in self.lined or c != NL]
            far = self.reach(r, "".join(chars[k] for k in keep))
            if far is None:
                continue
            if far >= len(keep):
                at = after
            else:
                w = where[keep[far]]
                if isinstance(w, tuple):
                    opener_at, opener, inner, inner_where = w
                    at = opener_at
                    if self.dead(opener, chars[keep[far]]):
                        if opener_at not in self.spots:  # once a group, whichever of its roles are asked for
                            failing = [x for x in self.roles[opener] if x not in TRIVIAL and not self.accepts(x, "".join(c for c in inner if x in self.lined or c != NL))]
                            self.spots[opener_at] = self._descend(failing, inner, inner_where, opener_at + 1)
                        at = max(opener_at, self.spots[opener_at])
                else:
                    at = w
            if at > best:
                best, spot = at, at
        return spot
