"""Problem 3: functions paired with their documentation."""

from __future__ import annotations

import re
import sys
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.llm.grammars import SUFFIXES, language
from weftline.llm.peg import CLOSE, Grammar, Units
from weftline.session import spread

#: Layout that the doc grammars see, where the validity grammars drop it: a line break, a break with blank lines, a comment, a documentation
#: block, a documentation line.
LAYOUT = {"n": "n", "B": "B", "c": "c", "D": "D", "L": "L", **{b: b for b in "()[]{}"}}

SHARED = r"""
Group  <- "(" In* ")" / "[" In* "]" / "{" In* "}"
Round  <- "(" In* ")" / "[" In* "]"
Curly  <- "{" In* "}"
Close  <- ")" / "]" / "}"
In     <- Group / !Close .
S      <- (n / B / c / D / L)*
"""
DOCS = {
    "python": r"""
Documented <- Sign Gap Text
Sign   <- "def" S Name (S "[" In* "]")? S Round S ("->" (Group / !":" !n .)*)? ":"
Name   <- IDENT / "match" / "case" / "type"
Gap    <- (n / c)*
Text   <- STR+ &(n / ";" / c / !.)
""",
    "typescript": r"""
Documented <- D n Notes Head
Notes  <- ("@" Name ("." Name)* Round? n?)*
Name   <- IDENT / SOFT
Mname  <- Name / STR / NUM / PRIVATE / "[" In* "]" / !"if" !"for" !"while" !"switch" !"catch" !"function" !"return" !"with" WORD
Head   <- ("export" "default"?)? ("async"? "function" "*"? Fname / ("const" / "let" / "var") Fname Ann? "=" S Func)
        / Mods Mname "?"? Params? Round Ret? S "{" / Mods Mname ("?" / "!")? Ann? ("=" / ":") S Func
Fname  <- Name
Func   <- "async"? ("function" / (Params? Round Ret? / Name) S "=>")
Params <- "<" (Params / Group / !"<" !">" .)* ">"
Ann    <- ":" (Group / !"=" !";" !"," !Close .)*
Ret    <- ":" S (Curly &(S "{" / S "=>") / (Round / !"{" !"=>" !";" !Close .)*)
Mods   <- (("static" / "async" / "get" / "set" / "*" / "public" / "private" / "protected" / "readonly" / "abstract" / "override") &(Mname / "*"))*
""",
    "java": r"""
Documented <- D n Pre Head
Pre    <- ("@" Name ("." Name)* Round? / Mod / n)*
Name   <- IDENT / SOFT
Mod    <- "public" / "protected" / "private" / "static" / "abstract" / "final" / "native" / "synchronized" / "transient" / "volatile" / "strictfp" / "default"
Targs  <- "<" (Targs / Group / !"<" !">" .)* ">"
Type   <- ("void" / "boolean" / "byte" / "short" / "int" / "long" / "char" / "float" / "double" / !"record" Name Targs? ("." Name Targs?)*) ("[" "]")*
Head   <- (Targs Pre)? (Type Fname &"(" Round ("[" "]")* S Throws? S ("{" / ";" / "default") / Fname &"(" Round S Throws? S "{")
Fname  <- Name
Throws <- "throws" (!"{" !";" .)*
""",
    "go": r"""
Documented <- L (n L)* n Head
Head   <- "func" Round? Fname (S "[" In* "]")? "("
Fname  <- IDENT
""",
    "rust": r"""
Documented <- (L (n L)* / D) (n Attr)* n Head
Attr   <- "#" Round
Head   <- ("pub" Round?)? ("const" / "async" / "unsafe" / "default" / "extern" STR?)* "fn" Fname
Fname  <- IDENT / SOFT
""",
}

ARTICLES = {"a", "an", "the"}
SECTION = re.compile(r"^(#+\s*)?(args|arguments|parameters|params|returns?|yields?|raises|throws|attributes|panics|errors|safety)\s*:?\s*$", re.I)
TAG = re.compile(r"^(@\w+|:\w+[^:\n]*:|-{3,}$|={3,}$|\\(param|return))")
WORDS = re.compile(r"[^\W_]+(?:['’-][^\W_]+)*")
PARTS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[A-Z]|\d+")
QUOTES = re.compile(r"^[rRuU]*(\"\"\"|'''|\"|')(.*)\1$", re.S)


def description(lines: list[str]) -> str:
    """The describing lines of a documentation, without tags, sections of arguments and lines that only carry marks."""
    out, inside = [], False
    for line in lines:
        s = line.strip()
        if not s:
            inside = False
            out.append("")
        elif SECTION.match(s):
            inside = True
        elif TAG.match(s):
            inside = True  # what follows up to a blank line belongs to the tag
        elif not inside:
            out.append(s)
    return "\n".join(out).strip()


def informative(text: str, name: str) -> bool:
    """Whether a description says something: four words or more, no open task, not the function's name again."""
    words = WORDS.findall(text)
    if len(words) < 4 or re.match(r"(TODO|FIXME|XXX)\b", text):
        return False
    own = {p.lower() for p in PARTS.findall(name)} | {name.lower()} | ARTICLES
    return any(p.lower() not in own for w in words for p in [w])


class Extractor:
    """The doc grammar of a language over the tokens of its lexer, offsets kept."""

    def __init__(self, name: str):
        self.name = name
        self.lang = language(name)
        kinds = {k: v for k, v in self.lang.kinds.items() if k not in "()"} | LAYOUT
        self.grammar = Grammar(SHARED + DOCS[name], kinds, {"(": [], "[": [], "{": []})
        # bracket groups are matched once a text, as rules that look for the end of an open bracket would read the rest again for each
        self.behind: dict[int, int] = {}
        for rule, openers in (("Group", "([{"), ("Round", "(["), ("Curly", "{")):
            self.grammar.table[rule] = lambda s, p, memo, openers=openers: self.behind.get(p, -1) if s[p] in openers else -1
        self.kind = Units(self.kind_of)
        k = kinds
        self.start = {"python": k.get("def", ""), "typescript": "D", "java": "D", "go": "L", "rust": "DL"}[name]

    def kind_of(self, tok: str) -> str:
        if tok[:1] == "\n":
            return "B" if "\n" in tok[1:] else "n"
        if tok[:1] == "#" and self.name == "python":
            return "c"
        if tok[:2] == "//":
            return "L" if self.name == "go" or self.name == "rust" and tok[2:3] == "/" and tok[3:4] != "/" else "c"
        if tok[:2] == "/*":
            return "D" if self.name != "go" and tok[2:3] == "*" and len(tok) > 4 and tok[3:4] != "*" else "c"
        return self.lang.classify[tok]

    def match_groups(self, s: str) -> None:
        """Where each bracket group ends: an opener whose first own closer is of another kind is a plain token, as is one without."""
        self.behind = {}
        opened: list[int] = []
        for p, c in enumerate(s):
            if c in CLOSE:
                opened.append(p)
            elif c in ")]}":
                while opened:
                    q = opened.pop()
                    if CLOSE[s[q]] == c:
                        self.behind[q] = p + 1
                        break

    def pairs(self, text: str) -> Iterator[tuple[str, str, int, int, int, int]]:
        """(name, description, start and end of the documentation, start and end of the function) in order."""
        clean = self.lang.clean(text)
        shift = "\n" if self.name == "python" else ""
        toks, kinds, at = [], [], []
        for m in self.lang.token.finditer(shift + clean):
            tok = m.group(1)
            for c in self.kind[tok]:
                toks.append(tok)
                kinds.append(c)
                at.append(m.start(1) - len(shift))
        s = "".join(kinds)
        if not any(c in s for c in self.start):
            return
        s += "\x03"
        self.match_groups(s)
        memo: dict = {}
        run = lambda rule, p: self.grammar.table[rule](s, p, memo)
        p, n = 0, len(s) - 1
        while p < n:
            if s[p] not in self.start:
                p += 1
                continue
            if run("Documented", p) < 0:
                p += 1
                continue
            if self.name == "python":
                head, name_at = p, run("S", p + 1)
                doc = run("Gap", run("Sign", p))
                last = run("Text", doc)
                texts = [QUOTES.match(t) for t in toks[doc:last]]
                lines = "".join(m.group(2) for m in texts).split("\n") if all(texts) else []
                end = self.python_end(s, toks, at, p, len(clean))
                back = p
                while back and toks[back - 1] == "async":
                    back -= 1
                span = (at[doc], at[last - 1] + len(toks[last - 1]), at[back], end)
                after = p + 1
            else:
                doc, last = p, p + 1
                while s[p] == "L" and s[last : last + 2] == "nL":
                    last += 2
                head = last
                while s[head] == "n" or self.name in ("typescript", "java") and s[head] == self.grammar.kinds["@"] or self.name == "rust" and s[head] == self.grammar.kinds["#"]:
                    if s[head] == "n":
                        head += 1
                    elif self.name == "rust":
                        head = run("Attr", head)
                    else:
                        head = run("Notes", head) if self.name == "typescript" else run("Pre", head)
                name_at = self.name_place(s, toks, head, run)
                lines = [x for t in toks[doc:last] if t[:1] == "/" for x in self.unmark(t)]
                if self.name == "go":
                    lines = [x for x in lines if not re.match(r"(go:|nolint)", x)]
                    first = re.sub(r"^\s*" + re.escape(toks[name_at]) + r"\b", "", "\n".join(lines), count=1)
                    lines = first.split("\n")
                span = (at[doc], at[last - 1] + len(toks[last - 1]), at[head], self.brace_end(s, toks, at, name_at, run, len(clean)))
                after = last
            name = toks[name_at].strip("\"'")
            text_out = description(lines)
            if informative(text_out, name):
                yield (name, text_out, *span)
            p = after

    def name_place(self, s, toks, head, run) -> int:
        """The token of the function's name: what the rule for it consumes just before its parameters or its ``=``."""
        k = self.grammar.kinds
        if self.name == "rust":
            return s.index(k["fn"], head) + 1
        if self.name == "go":
            q = head + 1
            return run("Round", q) if s[q] == "(" else q
        if self.name == "java":
            q = run("Pre", head)
            if s[q] == k["<"]:
                q = run("Pre", run("Targs", q))
            t = run("Type", q)
            return t if t >= 0 and run("Name", t) >= 0 and s[t + 1] == "(" else q
        q = head
        while toks[q] in ("export", "default", "async", "function", "const", "let", "var", "*") and not (s[q + 1] in "(" + k["="] + k["<"]):
            q += 1
        if q == head:
            q = run("Mods", head)
        return q

    def unmark(self, tok: str) -> list[str]:
        if tok.startswith("/*"):
            body = tok[3:-2] if tok.endswith("*/") else tok[3:]
            return [re.sub(r"^\s*\*+ ?", "", x) if k else x for k, x in enumerate(body.split("\n"))]
        return [re.sub(r"^/{2,3} ?", "", tok)]

    def python_end(self, s, toks, at, p, n) -> int:
        line = p
        while line and s[line - 1] not in "nB":
            line -= 1
        own = len(toks[line - 1].rpartition("\n")[2].expandtabs(8)) if line else 0
        depth, last, header = 0, p, True
        for q in range(p, len(toks)):
            if s[q] in "([{":
                depth += 1
            elif s[q] in ")]}":
                depth -= 1
            elif s[q] in "nB" and depth <= 0:
                width = len(toks[q].rpartition("\n")[2].expandtabs(8))
                nxt = s[q + 1]
                if nxt not in "nBc\x03" and width <= own and not header:
                    return at[last] + len(toks[last])
                header = False
                continue
            last = q
        return n

    def brace_end(self, s, toks, at, p, run, n) -> int:
        """Behind the body in braces, or behind the first ``;`` or line break outside brackets where there is none."""
        q = p
        while q < len(toks):
            if s[q] == "{":
                e = run("Group", q)
                return at[e - 1] + 1 if e > 0 else n
            if s[q] in "([":
                e = run("Group", q)
                if e < 0:
                    return n
                q = e
            elif toks[q] == ";":
                return at[q] + 1
            else:
                q += 1
        return n


@lru_cache(maxsize=None)
def extractor(name: str) -> Extractor:
    return Extractor("typescript" if name == "javascript" else name)


#: Opening words by which a chunk without suffix and label is read.
GUESS = [("python", r"^\s*(@\w|async def |def |class \w+.*:\s*$)"), ("rust", r"^\s*(///|#\[|pub |fn |impl )"), ("go", r"^\s*(func |type \w+ (struct|interface))|^// \w+ "), ("java", r"^\s*(public|private|protected|static|@Override)\b"), ("typescript", r"^\s*(export|function|async function|const|let|class|/\*\*)")]


def guess(text: str) -> str | None:
    return next((name for name, pattern in GUESS if re.search(pattern, text, re.M)), None)


#: Frames of rules nested in each other; they live on the heap.
NESTING = 100_000_000
PAIRS = "chunk_id long, func_name string, language string, description string, doc_start int, doc_end int, code_start int, code_end int, code string"


def pair_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    sys.setrecursionlimit(NESTING)
    for pdf in batches:
        rows = []
        for cid, text, lang in zip(pdf["id"], pdf["content"], pdf["lang"]):
            lang = lang or guess(text)
            if lang is None:
                continue
            ex = extractor(lang)
            clean = ex.lang.clean(text)
            for name, says, d0, d1, c0, c1 in ex.pairs(text):
                rows.append((cid, name, lang, says, d0, d1, c0, c1, clean[c0:c1]))
        yield pd.DataFrame(rows, columns=[c.split()[0] for c in PAIRS.split(", ")])


def suffix_language(path: Column, label: Column) -> Column:
    """The language of a path's suffix in any case; of a path without one, the label's, if it is one of ours; else null."""
    suffix = F.lower(F.regexp_extract(path, r"(\.[^./]+)$", 1))
    table = F.create_map(*[F.lit(x) for kv in SUFFIXES.items() for x in kv])
    names = F.lower(F.trim(label))
    return F.when(suffix != "", F.try_element_at(table, suffix)).when(names.isin(*sorted(set(SUFFIXES.values()))), names)


def documented_functions(chunks: DataFrame, files: DataFrame) -> DataFrame:
    """One row for each function or method with a documentation that says something, over all chunks but blocks.

    Needs id, file_id, content, chunk_type, language of ``chunks`` and id, path, language of ``files``. A chunk's language is that of
    its file's suffix, else its own label, else its file's, else it is guessed from its opening words. Null and empty contents give no rows, a
    null chunk_type is no block, rows without an id are left out, repeated rows give repeated pairs, empty tables none. Offsets count characters of the
    content without byte-order mark and with LF line ends.

    Plan: only paths and labels of files join the chunks (a hash join built on the small side, split by AQE where one file holds
    many chunks); the grammars run in one Python stage without a further shuffle.
    """
    f = files.select(F.col("id").alias("file_id"), F.col("path"), F.col("language").alias("file_language")).hint("shuffle_hash")
    c = chunks.where((F.col("chunk_type").isNull() | (F.col("chunk_type") != "block")) & (F.length("content") > 0) & F.col("id").isNotNull()).select("id", "file_id", "content", F.col("language").alias("own"))
    ours = sorted(set(SUFFIXES.values()))
    own, other = F.lower(F.trim("own")), F.lower(F.trim("file_language"))
    lang = F.coalesce(suffix_language(F.col("path"), F.lit(None).cast("string")), F.when(own.isin(*ours), own), F.when(other.isin(*ours), other))
    suffix = F.lower(F.regexp_extract(F.coalesce("path", F.lit("")), r"(\.[^./]+)$", 1))
    rows = c.join(f, "file_id", "left").where((suffix == "") | suffix.isin(*SUFFIXES)).select("id", "content", lang.alias("lang"))
    return rows.mapInPandas(pair_rows, PAIRS)
