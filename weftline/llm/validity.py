"""Problem 2: source files that do not parse."""

from __future__ import annotations

import re
import sys
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.docpairs import NESTING, suffix_language
from weftline.llm.grammars import WITH_ELEMENTS, language

MARKERS = re.compile(r"^(<{7}|={7}|>{7}|\|{7})( |$)", re.M)
VERDICTS = "file_id long, repository_id long, language string, valid boolean, cause string, fail_char int, fail_line int"


def cause(text: str, at: int, lang: str) -> str:
    """Why a file fails: conflict markers, cut off at the end, another language, or a plain syntax error."""
    if MARKERS.search(text):
        return "conflict"
    others = [x for x in ("python", "javascript", "typescript", "java", "go", "rust") if x != lang and not (x == "javascript" and lang == "typescript")]
    if at >= len(text.rstrip()) - 1:
        return "truncated"
    return "other language" if any(language(x).valid(text) for x in others) else "syntax"


def judge_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    sys.setrecursionlimit(NESTING)  # a chain of a million operators or branches parses
    for pdf in batches:
        valid, why, char, line = [], [], [], []
        for text, lang, jsx in zip(pdf["content"], pdf["lang"], pdf["jsx"]):
            judge = language(lang)
            reason = at = None
            ok = judge.valid(text, jsx)
            if not ok:
                clean = judge.clean(text)
                at = judge.failure(text, jsx)
                reason = cause(clean, at, lang)
            valid.append(ok), why.append(reason), char.append(at)
            line.append(None if at is None else clean.count("\n", 0, at) + 1)
        yield pd.DataFrame(
            {"file_id": pdf["id"], "repository_id": pdf["repository_id"], "language": pdf["lang"], "valid": pd.array(valid, dtype="boolean"), "cause": pd.array(why, dtype="string"), "fail_char": pd.array(char, dtype="Int32"), "fail_line": pd.array(line, dtype="Int32")}
        )


def judge_files(files: DataFrame, sources: DataFrame) -> DataFrame:
    """(file_id, repository_id, language, valid, cause, fail_char, fail_line) of every file that can be judged.

    Needs id, repository_id, path, language of ``files`` and file_id, content of ``sources``. A file's language is that of its suffix in any
    case; without a suffix or path, that of its label; other files and null contents are not judged and give no row. An empty content
    is a valid file but for Java-like rules of Go, which wants a package. fail_char is the furthest failure in the text without byte-order
    mark and with LF line ends. Elements are judged in .jsx and .tsx files only. Repeated rows are judged each; empty tables give no rows.

    Plan: files are cut to their id and language before the join, which hashes that small side; each text is parsed once, where the
    join leaves it, as a whole.
    """
    lang = suffix_language(F.col("path"), F.col("language"))
    jsx = F.lower(F.coalesce("path", F.lit(""))).rlike(f"({'|'.join(x.replace('.', '[.]') for x in WITH_ELEMENTS)})$")
    f = files.select("id", "repository_id", lang.alias("lang"), jsx.alias("jsx")).where("lang is not null").hint("shuffle_hash")
    s = sources.select(F.col("file_id").alias("id"), "content").where(F.col("content").isNotNull())
    return s.join(f, "id").select("id", "repository_id", "lang", "jsx", "content").mapInPandas(judge_rows, VERDICTS)


def rates(judged: DataFrame) -> DataFrame:
    """Files, invalid files and their rate per repository and language."""
    bad = F.sum(F.coalesce(~F.col("valid"), F.lit(False)).cast("long"))
    return judged.groupBy("repository_id", "language").agg(
        F.count("*").alias("files"),
        bad.alias("invalid"),
        F.round(bad / F.count("*"), 6).alias("rate"),
        *[F.sum((F.col("cause") == c).cast("int")).alias(n) for c, n in (("conflict", "conflicts"), ("truncated", "truncated"), ("other language", "other_language"), ("syntax", "syntax"))],
    ).na.fill(0)
