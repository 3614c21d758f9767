"""Functions on paths and texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from weftline.config import SUFFIX_LANGUAGE


def suffix(path: Column) -> Column:
    """The last suffix of a path with its dot; empty where there is none."""
    return F.regexp_extract(path, r"(\.[^./]+)$", 1)


def language_of(path: Column) -> Column:
    """Language by suffix as written, else ``unknown``; null for a null path."""
    table = F.create_map(*[F.lit(x) for kv in SUFFIX_LANGUAGE.items() for x in kv])
    return F.when(path.isNotNull(), F.coalesce(F.try_element_at(table, suffix(path)), F.lit("unknown")))


def basename(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)$", 1)


def stem(path: Column) -> Column:
    return F.regexp_replace(basename(path), r"(.)\.[^.]*$", "$1")


def lines(text: Column) -> Column:
    """Lines at LF only; a text that ends in LF has an empty last line."""
    return F.split(text, "\n", -1)


def strip(text: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def query_terms(query: Column) -> Column:
    """Words of a query without the marks `` ,.:()`` around them; words of marks alone are dropped."""
    words = F.transform(F.split(query, r"\s+"), lambda w: F.regexp_replace(w, r"^[ ,.:()]+|[ ,.:()]+$", ""))
    return F.filter(words, lambda w: w != "")


def truncate(text: Column, most: int = 200) -> Column:
    return F.when(F.char_length(text) > most, F.concat(F.substring(text, 1, most), F.lit("..."))).otherwise(text)


def human_size(size: Column) -> Column:
    """Bytes with two decimals in steps of 1024, up to TB; null for null."""
    x = size.cast("double")
    fmt = lambda v, unit: F.concat(F.format_string("%.2f", F.bround(v, 2)), F.lit(f" {unit}"))
    out = F.when(x < 1024.0, fmt(x, "B"))
    for k, unit in ((1, "KB"), (2, "MB"), (3, "GB")):
        out = out.when(x < 1024.0 ** (k + 1), fmt(x / 1024.0**k, unit))
    return out.when(x.isNotNull(), fmt(x / 1024.0**4, "TB"))


def embedding_text(language: Column, name: Column, kind: Column, content: Column) -> Column:
    """The text that is embedded for a chunk: labelled language, name where there is one, type, then the content."""
    return F.concat_ws("\n", F.concat(F.lit("Language: "), language), F.concat(F.lit("Name: "), name), F.concat(F.lit("Type: "), kind), content)


#: Words before a parenthesis that call nothing.
NO_CALLS = ["if", "while", "for", "def", "class", "function"]


def called_names(content: Column) -> Column:
    """Distinct identifiers before a parenthesis, by pattern; for languages without a grammar."""
    found = F.regexp_extract_all(content, F.lit(r"([A-Za-z_][A-Za-z0-9_]*)\s*\("), 1)
    return F.array_distinct(F.filter(found, lambda x: ~x.isin(*NO_CALLS)))


def defined_names(content: Column) -> Column:
    """Distinct names behind a word that opens a function, by pattern."""
    return F.array_distinct(F.regexp_extract_all(content, F.lit(r"(?:def|function|func|fn)\s+([A-Za-z_][A-Za-z0-9_]*)"), 1))


def class_names(content: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(content, F.lit(r"(?:class|struct|interface|trait)\s+([A-Za-z_][A-Za-z0-9_]*)"), 1))


def python_headers(content: Column, word: str) -> Column:
    """Distinct names behind ``def`` or ``class`` at the start of a line, for Python that does not parse."""
    return F.array_distinct(F.regexp_extract_all(content, F.lit(rf"(?m)^[ \t]*(?:async[ \t]+)?{word}[ \t]+([A-Za-z_][A-Za-z0-9_]*)"), 1))


def base_names(content: Column) -> Column:
    """Bases of the first class header, by pattern: those in parentheses, or behind ``extends``; of a dotted name the last part, and no ``object``."""
    inside = F.regexp_extract(content, r"class\s+\w+\s*\(([^)]*)\)", 1)
    behind = F.regexp_extract(content, r"class\s+\w+\s+extends\s+([A-Za-z_][\w.]*)", 1)
    names = F.transform(F.split(F.concat_ws(",", inside, behind), ","), lambda x: F.element_at(F.split(strip(x), r"\."), -1))
    return F.array_distinct(F.filter(names, lambda x: (x != "") & (x != "object")))


def generic_skeleton(content: Column) -> Column:
    """First line that is not blank, and ``...`` if more follow; empty for a blank text."""
    full = F.filter(lines(content), lambda x: strip(x) != "")
    return F.when(F.size(full) == 0, F.lit("")).when(F.size(full) == 1, strip(full[0])).otherwise(F.concat(strip(full[0]), F.lit(" ...")))


def iso(ts: Column) -> Column:
    """ISO-8601 with the fraction left out where it is zero."""
    frac = F.date_format(ts, "SSSSSS")
    return F.when(frac == "000000", F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")).otherwise(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"))
