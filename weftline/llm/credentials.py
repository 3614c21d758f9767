"""Problem 5: credentials in code and configuration, found through encoded layers and masked in place."""

from __future__ import annotations

import base64
import binascii
import re
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.session import spread

FIELDS = ("content", "skeleton_content")

#: Last words of names that hold a credential; those of the second row may also stand in front of ``key``.
WORDS = "password passwords passwd passphrase secret secrets token tokens apikey apikeys credential credentials key_material signer".split()
OF_KEYS = "api secret access signing sign private auth encryption encrypt master account service client session shared license webhook deploy storage admin".split()
SHORT = "pass pwd pw pin".split()
SHORT_TERMS = "|".join(SHORT)
LONG_TERMS = r"passwords?|passwd|passphrase|secrets?|tokens?|apikeys?|credentials?|key[_-]?material|signer|(?:" + "|".join(OF_KEYS) + r")[_-]?keys?"
NAME = rf"(?:(?i:{LONG_TERMS})|(?<![A-Za-z])(?i:{SHORT_TERMS})|(?<=[a-z])(?:Pass|Pwd|Pw))"
#: Behind a name, perhaps quoted or with a type: an assignment and a quoted value.
QUOTED = re.compile(r"""(?P<q1>\\?["'`]?)\]?\)?[ \t]*(?:[?!]?:[ \t]*[&\w\[\]<>'|. ]+?)?[ \t]*(?:=>|:=|===?|=|:)[ \t]*(?:[A-Za-z_.:]+\()?[rRbBuUfF]{0,2}(?P<q>\\?["'`])(?P<v>[^"'`\n]{4,}?)(?P=q)""")
PAIRED = re.compile(rf"""["'`][\w.-]*{NAME}["'`][ \t]*,[ \t]*(?P<q>["'`])(?P<v>[^"'`\n]{{4,}}?)(?P=q)""")
SETTER = re.compile(rf"""\b(?:set|with|add)\w*{NAME}\([ \t]*(?P<q>["'`])(?P<v>[^"'`\n]{{4,}}?)(?P=q)""")
XML = re.compile(rf"""<[\w.:-]*{NAME}(?:\s[^<>\n]*)?>(?P<v>[^<>\n]{{4,}})</""")
BARE = re.compile(r"""(?P<sep>[ \t]*[:=][ \t]*)(?P<v>[^\s"'`][^\s]*)[ \t]*(?:\.\.\.[ \t]*|[#;][^\n]*)?\r?$""", re.M)
LEAD = re.compile(r"[ \t]*(?P<lead>export[ \t]+|-[ \t]+)?[\w.-]*")
FLAG = re.compile(rf"""(?<!-)--[\w-]*{NAME}(?:=|[ \t]+)(?P<v>[^\s"'`]{{4,}})""")
SCHEME = re.compile(r"""\b(?P<s>Bearer|Basic|Token|ApiKey|Digest)[ \t]+(?P<v>[A-Za-z0-9+/._~=!@#$%^&*-]{8,})""")
ADDRESS = re.compile(r"""(?<![a-zA-Z0-9+.-])[a-zA-Z][a-zA-Z0-9+.-]+://[^\s:/@"'`<>]*:(?P<v>[^\s@/"'`]{3,})@""")
#: Literals that stand beside each other or are added: one value in pieces.
PIECES = re.compile(r"""["'`]?\]?[ \t]*(?::[ \t]*[\w<>]+[ \t]*)?(?:=>|:=|=|:)[ \t]*\(?\s*(?P<all>["'][^"'\n]*["'](?:\s*(?:\+|\\\r?\n|\.(?=\s*["'])|)\s*["'][^"'\n]*["'])+)""")
PIECE = re.compile(r"""["'](?P<v>[^"'\n]*)["']""")
#: What a comment says of a password or key.
TOLD = re.compile(r"""\b(?i:(?P<what>pass(?:word|wd|phrase|code)?|pwd|pin|secret|token|credentials?|key))[ \t]+(?P<was>(?i:was|is|used to be|now)[ \t]+)?(?P<v>[^\s"'`,;()\[\]{}<>]{6,})""")
#: A name and a password side by side: behind a login in a comment, or as an option of a command.
WHO = re.compile(r"(?i)\b(?:log-?in|log in|account|credentials?|user(?:name)?)\b")
LOGIN = re.compile(r""":[ \t]*[\w.@-]+[ \t]*/[ \t]*(?P<v>[^\s"'`]{6,})""")
OPTION = re.compile(r"""(?<![\w-])(?:-u|--user)(?:=|[ \t]+)["']?[\w.@-]+:(?P<v>[^\s"'`]{4,})""")
MARKED, QUOTE = re.compile(r"\#|//|--|\*|;"), re.compile("[\"'`]")
JWK = re.compile(r"""["'](?:d|p|q|dp|dq|qi|k)["']\s*:\s*["'](?P<v>[A-Za-z0-9_-]{16,})["']""")
PEM = re.compile(r"-----BEGIN (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----(?P<v>(?:\\[nr]|[\s\"'+]|[A-Za-z0-9+/=:,. -])*?)(?=-----END|\Z|[\"'`])")
#: Forms of tokens that services give out.
ISSUED = re.compile(
    r"\b(?:A[KS]IA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{20,}|github_pat_\w{22,}|glpat-[\w-]{16,}|xox[abeoprs]-[\w-]{10,}|[sr]k_(?:live|test)_\w{10,}|SG\.[\w-]{16,}(?:\.[\w-]{16,})?|AIza[\w-]{30,}"
    r"|npm_[A-Za-z0-9]{30,}|pypi-[\w-]{16,}|dop_v1_[a-f0-9]{40,}|ya29\.[\w-]{20,}|hf_[A-Za-z0-9]{20,}|sk-[A-Za-z0-9-]{20,}|shpat_[a-f0-9]{20,}|EAACEdEose0cBA\w+)"
)
SIGNED = re.compile(r"\beyJ[\w-]{6,}\.eyJ[\w-]{4,}\.[\w-]{10,}")
TRIGGER = re.compile(
    r"Bearer |Basic |Token |ApiKey |Digest |://|PRIVATE KEY|eyJ|A[KS]IA|gh[pousr]_|github_pat|glpat|xox|k_live|k_test|SG\.|AIza|npm_|pypi-|dop_v1|ya29|hf_|sk-|shpat|EAAC|[Kk][Ee][Yy][ \t]|(?<![\w-])-u[ \t=]|--user|[Ll]og-?[Ii]n\b|[\"']kty[\"']"
    r"|(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}|%[0-9a-fA-F]{2}|\\x[0-9a-fA-F]{2}|\\u(?:\{|[0-9a-fA-F]{4})"
)
#: A statement of code; keys of a mapping or a settings file and the exports of a shell are none, though they may be called as a keyword is.
CODE = re.compile(r"^\s*(?:(?:def|class|import|from|function|const|let|var|public|private|protected|func|fn|pub|package|use|return|if|elif|for|while|export(?![ \t]+[\w.-]+=)|async|static|impl|type|struct)\b(?![ \t]*(?::(?:[ \t]|$)|=(?!=)))|try\b(?!:[ \t]+\S)|@\w+\b)|;[ \t]*$|[)\w][ \t]*\{[ \t]*$|=>", re.M)

#: Words that stand where a credential will be.
SAMPLES = {
    "changeme", "changeit", "change-me", "change_me", "password", "passw0rd", "secret", "token", "example", "sample", "test", "testing", "dummy", "default", "none", "null", "nil", "undefined", "true", "false", "todo", "tbd", "fixme",
    "redacted", "placeholder", "replace_me", "replaceme", "replace-me", "set-me", "set_me", "setme", "insert-here", "your-password", "hidden", "masked", "removed", "secure", "foobar", "foo", "bar", "admin", "root", "user", "guest", "empty", "unset", "required", "optional", "string", "xxx", "yyy", "zzz",
    "not-a-secret", "not_a_secret", "fake", "mysecret", "mypassword", "my-secret", "letmein", "qwerty", "password123", "test123", "123456", "12345678", "abc123", "hunter2",
}
REFERENCE = re.compile(
    r"^(?:\$\{|\$\(|\$(?:[A-Z_][A-Z0-9_]*|[a-z_]+)$|\{\{|\{[\w.]+\}$|%(?:\(\w+\))?[sdr%]$|%\w+%$|<[^>]*>?$|&lt;|\[[^\]]*\]$|(?i:ENC\(|vault[:/]|secret[:/]{1,3}|env[:.(]|file:|ref\+|arn:|op://|ssm:|sm://|kms:"
    r"|!(?:vault|secret|env|reference|ref|sub|getatt|importvalue|file)\b|(?:os|process|system|config|settings|self|this)\.|getenv)|@(?:[a-z_]+|[A-Z_]+)$|(?:\.{0,2}/)(?:[a-z0-9_.-]+/)*[a-z0-9_.-]+$|~/)"
)
WORDY = re.compile(r"(?i)^(?:your|my|the|some|insert|enter|replace|change|put|add|set|use|example|sample|dummy|fake|test|placeholder|redacted|todo)[-_ .]?(?:[a-z]+[-_ .]?)*(?:here|me|it|this|value|key|token|password|secret|now|later|\d{0,3})?$")


def grants_nothing(v: str) -> bool:
    """Placeholders, masks, references, sample words and plain settings."""
    low = v.lower().strip("\"'`<>[]{}()")
    if low in SAMPLES or REFERENCE.match(v) or WORDY.match(v) or "${" in v or "{{" in v or "#{" in v:
        return True
    core = re.sub(r"[\W_]", "", v)
    return len(set(core.lower())) < 3 or re.fullmatch(r"[xX*•.\-_#?]+", v) is not None


#: Names of ciphers, digests and encodings, which tell how a value is made and not what it is.
MADE_BY = re.compile(r"(?i)(?:sha|md|utf|base|aes|rsa|dsa|ecdsa|ed|hs|rs|es|ps|crc|blake|des|iso|x)[-_]?\d+(?:[-_/]\w+)*")
#: Words of messages and labels, which a passphrase of words has none of.
TELLING = re.compile(r"(?i)\b(?:a|an|the|is|are|was|be|must|should|can|cannot|not|no|your|my|our|for|of|from|to|in|on|at|with|have|has|enter|please|required|invalid|expired|missing|wrong|empty|again|or|and|if|it|this|password|token|secret|key)\b")


def scrambled(v: str) -> bool:
    """Whether letters of one case are no word: five consonants or more in a row, or hardly a vowel."""
    return len(v) >= 10 and v.isalpha() and (re.search(r"(?i)[bcdfghjklmnpqrstvwxz]{5}", v) is not None or len(re.findall(r"(?i)[aeiouy]", v)) < 0.2 * len(v))


def strong(v: str) -> bool:
    """Whether a value can be a literal credential: one word, long enough, of more than one kind of character or of letters that are no words."""
    if len(v) < 6 or re.search(r"\s", v) or grants_nothing(v):
        return False
    if re.fullmatch(r"[\d.,:_/-]+|(?:sha(?:1|256|384|512)|md5)[-:].*|https?://[^@]*|[\w.-]+\.(?:py|js|ts|go|rs|java|json|ya?ml|pem|crt|key|txt|env|html?)|[A-Z][A-Z0-9]*(?:_[A-Z0-9]+)+", v):
        return False
    if scrambled(v):
        return True
    kinds = sum(bool(re.search(p, v)) for p in (r"[a-z]", r"[A-Z]", r"\d", r"[^\w.\-/]"))
    if kinds < 2:
        return False
    if re.fullmatch(r"[A-Za-z]+(?:[_.-][A-Za-z]+)*", v):
        # letters alone are a name, unless their case changes as often as by chance
        turns = sum(a.islower() != b.islower() for a, b in zip(v, v[1:]))
        return len(v) >= 10 and v.isalpha() and turns >= 0.36 * (len(v) - 1)
    return True


def spoken(name: str, v: str) -> bool:
    """Values that only a password's or PIN's own name makes one: digits, and phrases of four words or more that tell nothing."""
    if not re.search(r"(?i)(?:pass(?:word|wd|phrase|code)?|pwd|pw|pin)s?\W*$", name) or grants_nothing(v):
        return False
    if re.fullmatch(r"\d{4,}", v):
        return v not in "01234567890" and v not in "9876543210"
    return re.fullmatch(r"[^\W\d_]+(?:[ -][^\W\d_]+){3,}[ -]?\d*", v) is not None and not TELLING.search(v)


def in_comment(text: str, at: int, words: re.Pattern | None = None) -> bool:
    """Whether a mark that opens comments stands before a place on its line, with no quote between, and ``words`` before the place, behind any colon."""
    line = text[text.rfind("\n", 0, at) + 1 : at]
    mark = MARKED.search(line)
    return mark is not None and not QUOTE.search(line, mark.end()) and (words is None or words.search(line, line.rfind(":") + 1) is not None)


def told(m: re.Match) -> bool:
    v = m.group("v").rstrip(".:!?")
    if not strong(v) or MADE_BY.fullmatch(v) or not re.search(r"\d", v) or "://" in v:
        return False
    mixed = re.search(r"[a-z]", v) and re.search(r"[A-Z]", v) and not re.fullmatch(r"[a-z]+(?:[A-Z][a-z]*)*\d*", v)
    return bool(m.group("was")) or bool(mixed) or re.search(r"[^\w./:-]", v) is not None or re.fullmatch(r"[A-Za-z]+(?:[-_.][A-Za-z]+)+[-_.]?\d{2,}", v) is not None


def bare_value(v: str) -> bool:
    return strong(v) and not re.search(r"[(){}\[\]]|^[a-z_]\w*\.[a-z_]\w*", v)


@lru_cache(maxsize=1)
def terms():
    """An Aho-Corasick automaton of all names, one for each Python worker."""
    import ahocorasick

    found = ahocorasick.Automaton()
    keys = [f"{w}{x}key{s}" for w in OF_KEYS for x in ("", "_", "-") for s in ("", "s")]
    for w in [*WORDS, *keys, "key-material", "keymaterial"]:
        found.add_word(w, len(w))
    for w in SHORT:
        found.add_word(w, -len(w))
    found.make_automaton()
    return found


def names(text: str) -> list[int]:
    """Ends of the names that hold a credential, in order. Short words count only as words, or as the last one of a camel-case name."""
    low = text.lower()
    if len(low) != len(text):  # a few capitals become two characters
        low = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
    ends = []
    for last, n in terms().iter(low):
        end = last + 1
        if ends and ends[-1] == end or low[end : end + 1].isalnum() or low[end : end + 1] in ("_", "-"):
            continue
        if n < 0:
            start = end + n
            before, word = text[start - 1 : start] if start else "", text[start:end]
            if before.isalpha() and not (before.islower() and word in ("Pass", "Pwd", "Pw")):
                continue
        ends.append(end)
    return ends


def bare_places(text: str, ends: list[int]) -> Iterator[tuple[int, int]]:
    """Spans of unquoted values that stand alone behind a name. Where a text has code too, each line is judged for itself: statements, arguments,
    members of literals, and assignments with blanks of what may be a variable hold no literal."""
    code = None
    for end in ends:
        m = BARE.match(text, end)
        if not m or not bare_value(m.group("v")):
            continue
        start = text.rfind("\n", 0, end) + 1
        lead = LEAD.fullmatch(text, start, end)
        if not lead:
            continue
        v, sep = m.group("v"), m.group("sep")
        if code is None:
            code = CODE.search(text) is not None
        if code and not (lead.group("lead") or "").startswith("export"):
            last = start
            while last and text[last - 1].isspace():
                last -= 1
            before = text[last - 1 : last] if last else ""
            if CODE.search(text[start : m.end()]) or v[-1] in ",;" or before in ("(", "[", ",") or ":" in sep and before == "{" or sep.strip(":=") and re.fullmatch(r"[A-Za-z_$][\w$]*(?:[.:]+\w+)*", v) and "=" in sep:
                continue
        yield m.start("v"), m.end("v")


def der(b: bytes, p: int, end: int) -> list[tuple[int, int, int]] | None:
    """(tag, start, end) of the elements that fill a stretch of DER; None where they don't."""
    out = []
    while p < end:
        if p + 2 > end:
            return None
        tag, n, q = b[p], b[p + 1], p + 2
        if n & 0x80:
            k = n & 0x7F
            if not 1 <= k <= 4 or q + k > end:
                return None
            n, q = int.from_bytes(b[q : q + k], "big"), q + k
        if q + n > end:
            return None
        out.append((tag, q, q + n))
        p = q + n
    return out


#: Object identifiers in DER of password-based encryption, of its older forms, and of data in a key store.
PBES, PBE_OLD, DATA = bytes.fromhex("2a864886f70d0105"), bytes.fromhex("2a864886f70d010c01"), bytes.fromhex("2a864886f70d0107")


def der_key(b: bytes) -> bool:
    """Whether bytes hold a private key by the grammar of its container: PKCS#1, DSA, SEC1, PKCS#8 plain or encrypted and PKCS#12 in DER, or an
    OpenSSH key."""
    if b.startswith(b"openssh-key-v1\x00"):
        return True
    top = der(b, 0, len(b))
    if not top or len(top) != 1 or top[0][0] != 0x30:
        return False
    items = der(b, *top[0][1:])
    if not items:
        return False
    tags = [t for t, _, _ in items]

    def oid(k: int) -> bytes:
        inner = der(b, *items[k][1:]) if items[k][0] == 0x30 else None
        return b[inner[0][1] : inner[0][2]] if inner and inner[0][0] == 6 else b""

    if tags == [0x30, 4]:
        return oid(0).startswith((PBES, PBE_OLD))
    a, z = items[0][1:]
    if tags[0] != 2 or z - a != 1 or b[a] > 3:
        return False
    if tags[:9] == [2] * 9 or tags == [2] * 6 or tags[:2] == [2, 4]:
        return True
    return tags[:3] == [2, 0x30, 4] or tags[:2] == [2, 0x30] and b[a] == 3 and oid(1).startswith(DATA)


def text_of(b: bytes) -> str | None:
    """Bytes as text, where they are printable text at all."""
    if len(b) < 6:
        return None
    try:
        s = b.decode("utf-8")
    except UnicodeDecodeError:
        return None
    return s if sum(c.isprintable() or c in "\n\r\t" for c in s) == len(s) else None


BASE64 = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/]{20,}={0,2}(?![A-Za-z0-9+/_-])|(?<![A-Za-z0-9+/_=-])[A-Za-z0-9_-]{20,}={0,2}(?![A-Za-z0-9+/_-])")
HEX = re.compile(r"(?<![0-9a-zA-Z])(?:0x)?(?P<h>(?:[0-9a-fA-F]{2}){12,})(?![0-9a-zA-Z])")
UNITS = (re.compile(r"%([0-9a-fA-F]{2})"), re.compile(r"\\(?:x([0-9a-fA-F]{2})|u([0-9a-fA-F]{4})|u\{([0-9a-fA-F]{1,6})\})"))


def unfold(text: str, unit: re.Pattern) -> tuple[str, list[int]] | None:
    """The text with its percent or escaped characters opened and where each of its characters begins; None if fewer than two are."""
    out, starts, opened, at = [], [], 0, 0
    for m in unit.finditer(text):
        out.append(text[at : m.start()])
        starts.extend(range(at, m.start()))
        opened += 1
        starts.append(m.start())
        out.append(chr(int(next(g for g in m.groups() if g), 16) % 0x110000))
        at = m.end()
    if opened < 2:
        return None
    out.append(text[at:])
    starts.extend(range(at, len(text) + 1))
    return "".join(out), starts


def layers(text: str) -> Iterator[tuple[int, int, bytes]]:
    """(start, end, what is inside) of every run that is an encoding of bytes."""
    for m in BASE64.finditer(text):
        v = m.group()
        if v.isdigit() or re.fullmatch(r"[A-Za-z]+|[a-z_]+|[0-9a-fA-F]+|[A-Za-z]+(?:[_-][A-Za-z]+)+", v):
            continue
        raw = v.rstrip("=").replace("-", "+").replace("_", "/")
        try:
            yield m.start(), m.end(), base64.b64decode(raw + "=" * (-len(raw) % 4), validate=True)
        except (binascii.Error, ValueError):
            pass
    for m in HEX.finditer(text):
        yield m.start(), m.end(), bytes.fromhex(m.group("h"))


def encoded(text: str) -> Iterator[tuple[int, int, str]]:
    """Spans behind encodings, however many lie one inside the other, as each opened text is shorter than the one it was in. A run of base64 or hex
    that holds a credential is one as a whole;
    of percent and escaped characters only the credential itself."""
    for a, b, inside in layers(text):
        if der_key(inside):
            yield a, b, "private key"
            continue
        inner = text_of(inside)
        if inner and find(inner):
            yield a, b, "encoded"
    for unit in UNITS:
        opened = unfold(text, unit)
        if opened is None:
            continue
        plain, starts = opened
        for a, b, kind in find(plain):
            yield starts[a], starts[b], kind if kind in ("private key", "continued") else "encoded"


def find(text: str) -> list[tuple[int, int, str]]:
    """Sorted (start, end, kind) of the literal credentials of a text, without overlaps: spans of their values, or of the encoded literal around
    them. Kinds: private key, issued token, signed token, address, authorization, named, told in a comment, encoded; and continued, for the further pieces of a split literal."""
    ends = names(text)
    if not ends and not TRIGGER.search(text):
        return []
    out: list[tuple[int, int, str]] = []
    for m in PEM.finditer(text):
        body = re.sub(r"\\[nr]|[\s\"'+]", "", m.group("v"))
        if len(body) >= 16 or not text[m.end("v") :].strip():
            out.append((m.start(), m.end("v"), "private key"))
    for m in ISSUED.finditer(text):
        if "EXAMPLE" not in m.group().upper() and not grants_nothing(m.group()):
            out.append((m.start(), m.end(), "issued token"))
    for m in SIGNED.finditer(text):
        out.append((m.start(), m.end(), "signed token"))
    for m in ADDRESS.finditer(text):
        if not grants_nothing(m.group("v")):
            out.append((m.start("v"), m.end("v"), "address"))
    for m in SCHEME.finditer(text):
        v = m.group("v")
        if m.group("s") == "Basic":
            try:
                inside = text_of(base64.b64decode(v + "=" * (-len(v) % 4)))
            except (binascii.Error, ValueError):
                inside = None
            if inside and ":" in inside and not grants_nothing(inside.split(":", 1)[1] or "***"):
                out.append((m.start("v"), m.end("v"), "authorization"))
        elif strong(v) and (len(v) >= 16 or re.search(r"\d", v)):
            out.append((m.start("v"), m.end("v"), "authorization"))
    for m in (m for pattern in (PAIRED, SETTER, XML) for m in pattern.finditer(text)):
        if strong(m.group("v")) and not m.group("v").startswith("-----"):
            out.append((m.start("v"), m.end("v"), "named"))
    for end in ends:
        m = QUOTED.match(text, end)
        if m and not m.group("v").startswith("-----") and (strong(m.group("v")) or spoken(text[max(0, end - 12) : end], m.group("v"))):
            out.append((m.start("v"), m.end("v"), "named"))
        m = PIECES.match(text, end)
        parts = list(PIECE.finditer(m.group("all"))) if m else []
        if strong("".join(p.group("v") for p in parts)):
            at = m.start("all")
            out += [(at + p.start("v"), at + p.end("v"), "continued" if k else "named") for k, p in enumerate(parts) if p.group("v")]
    for m in TOLD.finditer(text):
        if told(m) and in_comment(text, m.start()):
            out.append((m.start("v"), m.start("v") + len(m.group("v").rstrip(".:!?")), "told"))
    if '"kty"' in text or "'kty'" in text:
        out += [(m.start("v"), m.end("v"), "private key") for m in JWK.finditer(text)]
    for pattern, m in ((p, m) for p in (LOGIN, OPTION) for m in p.finditer(text)):
        if strong(m.group("v")) and (pattern is OPTION or in_comment(text, m.start(), WHO)):
            out.append((m.start("v"), m.end("v"), "authorization"))
    for m in FLAG.finditer(text):
        v = m.group("v").rstrip(".,;)")
        if strong(v):
            out.append((m.start("v"), m.start("v") + len(v), "named"))
    out += [(a, b, "named") for a, b in bare_places(text, ends)]
    out += encoded(text)
    kept: list[tuple[int, int, str]] = []
    for a, b, kind in sorted(out, key=lambda x: (x[0], -x[1])):
        if not kept or a >= kept[-1][1]:
            kept.append((a, b, kind))
        elif b > kept[-1][1]:
            kept[-1] = (kept[-1][0], b, kept[-1][2])
    return kept


def mask(text: str, spans: list[tuple[int, int, str]]) -> str:
    """The text with letters and digits of the spans masked; all other characters, quotes, line ends and escapes stay."""
    out, at = [], 0
    for a, b, kind in spans:
        out.append(text[at:a])
        part = text[a:b]
        if kind == "private key" and part.startswith("-----BEGIN"):
            head = part.index("-----", 10) + 5
            out.append(part[:head])
            part = part[head:]
            out.append(re.sub(r"\\[nr]|[A-Za-z0-9+/=]", lambda m: m.group() if len(m.group()) > 1 else "*", part))
        else:
            out.append("*" * len(part))
        at = b
    out.append(text[at:])
    return "".join(out)


PLACES = "array<struct<line_no:long,start_char:int,end_char:int,kind:string>>"
ROWS = f"chunk_id long, content string, skeleton_content string, content_places {PLACES}, skeleton_places {PLACES}"


def places(text: str, spans: list[tuple[int, int, str]]) -> list[dict]:
    return [{"line_no": text.count("\n", 0, a) + 1, "start_char": a, "end_char": b, "kind": k} for a, b, k in spans]


def scan_rows(only_places: bool):
    """A mapInPandas function: both fields masked, with the places; ``only_places`` leaves the texts out."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = {"chunk_id": pdf["id"], "content": [], "skeleton_content": [], "content_places": [], "skeleton_places": []}
            for field, key in zip(FIELDS, ("content_places", "skeleton_places")):
                for text in pdf[field]:
                    spans = find(text) if text else []
                    out[key].append(places(text, spans) if spans else [])
                    out[field].append(None if only_places else mask(text, spans) if spans else text)
            yield pd.DataFrame(out)

    return run


def redact(chunks: DataFrame, only_places: bool = False) -> DataFrame:
    """(chunk_id, content, skeleton_content, content_places, skeleton_places), one row for each input row: both fields with the values
    of credentials masked character for character, and the places found.

    Needs id, content, skeleton_content. A null field stays null and has no places; an empty one stays empty; repeated rows are masked
    each for itself; an empty table gives no rows. A credential belongs to the line on which its value begins. Texts are scanned whole; nothing is
    shuffled unless the table has fewer splits than there are cores. Rows without an id are left out.
    """
    return spread(chunks.where("id is not null").select("id", *FIELDS)).mapInPandas(scan_rows(only_places), ROWS)


def found_lines(redacted: DataFrame) -> DataFrame:
    """(chunk_id, field_name, line_no): each line of each field on which a credential begins."""
    begins = lambda c: F.filter(c, lambda p: p.kind != "continued")
    return redacted.select("chunk_id", F.explode(F.array(*[F.struct(F.lit(n).alias("field_name"), F.array_distinct(F.transform(begins(c), lambda p: p.line_no)).alias("l")) for c, n in (("content_places", "content"), ("skeleton_places", "skeleton_content"))])).alias("x")).select("chunk_id", "x.field_name", F.explode("x.l").alias("line_no"))
