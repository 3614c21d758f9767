"""Problem 6: generated, minified, vendored and data-only source files."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.docpairs import suffix_language
from weftline.session import materialize, spread

#: Directories that tools write to, directories for copies of third-party code, and names that generators give.
GENERATED_DIRS = ["generated", "__generated__", "gen", "autogen", "auto_generated"]
VENDOR_DIRS = ["vendor", "_vendor", "third_party", "third-party", "thirdparty", "external", "deps", "node_modules", "bower_components"]
GENERATED_NAMES = r"(?i)(_pb2(_grpc)?\.pyi?|_pb\.[jt]sx?|\.pb\.\w+|[._]generated\.\w+|\.gen\.\w+|_gen\.go|\.g\.\w+|\.designer\.\w+)$"
MINIFIED_NAMES = r"(?i)\.min\.(js|mjs|cjs|css)$"
#: Suffixes of configuration, documents and other files that are no source; all others are judged.
NO_SOURCE = (
    "json jsonc json5 jsonl ndjson yml yaml xml xsd xsl xslt cfg conf config cnf ini toml env properties props plist editorconfig gitignore gitattributes gitmodules dockerignore npmignore npmrc lock sum mod "
    "txt md markdown rst adoc tex pdf doc docx xls xlsx ppt pptx csv tsv log diff patch ipynb parquet avro orc db sqlite pem crt key svg png jpg jpeg gif ico webp bmp woff woff2 ttf otf eot mp3 mp4 wav zip gz tgz tar jar war class so dll exe bin map"
).split()
#: Suffixes of scripts beside those of a language we know.
SCRIPTS = ["mjs", "cjs", "mts", "cts"]
#: Most libraries or repositories that a rare line occurs in, least containment both ways, least lines of a file that two repositories share.
RARE, RARE_REPOSITORIES, CONTAINED, LEAST_LINES = 2, 8, 0.5, 8
#: A script is minified if less than this share of it is white space outside literals, over lines this long at the mean.
SPACE, MEAN_LINE = 0.09, 90
#: A file is data if this share of its characters, white space and comments apart, is literals and what stands between them, and it has so many literals.
DATA, LITERALS = 0.9, 8

STRONG = re.compile(r"@generated\b|<auto-?generated|^\W*auto-?generated\b(?! files)|\bcode generated\b.*\bdo not edit\b|\bthis (file|code|module|class) (was|is|has been) (automatically |auto-?|machine[- ])?(generated|created|produced)\b", re.I)
MAKER = re.compile(r"\b(auto-?|machine-?|automatically )?(generated|created|produced|output|written) (by|from|of|with)\b|\bauto-?(generated|created)\b|\bcodegen\b", re.I)
BAN = re.compile(r"\b(do not|don't|never) (edit|modify|change|touch)\b(?! (them|it)\b)|\b(changes?|edits?|modifications?)\b.{0,24}\b(lost|overwritten|discarded)\b", re.I)
#: A file that is kept by hand, whatever wrote it first.
HAND = re.compile(r"\b(maintained|edited|written|kept|changed|owned) by hand\b|\bhand-?(written|edited|maintained)\b|\b(no longer|once|formerly|not|never) (auto-?|machine-?|automatically )?(generated|created|produced)\b", re.I)
COMMENT = re.compile(r"^\s*(#|//|/\*|\*|<!--|--|;|[rRuU]?\"\"\"|[rRuU]?''')")
#: What ends a comment of several lines, by what begins it.
CLOSES = {"/*": "*/", "<!--": "-->"} | {p + q: q for p in ("", *"rRuU") for q in ('"""', "'''")}
#: Tokens of any of the languages; those that are told apart: comments and documentation, literals, white space, separators.
TOKENS = re.compile(
    r"""((?:(?<=\n)|\A)[ \t]*(?:[rRuU]?\"{3}.*?(?:\"{3}|\Z)|[rRuU]?'{3}.*?(?:'{3}|\Z))|//[^\n]*|/\*.*?(?:\*/|\Z)|(?<![^\s])\#[ !][^\n]*)"""
    r"""|("[^"\\\n]*(?:\\.[^"\\\n]*)*"|'[^'\\\n]*(?:\\.[^'\\\n]*)*'|`[^`\\]*(?:\\.[^`\\]*)*`|(?<![\w$])[-+]?(?:0[xX][0-9a-fA-F_]+|\d[\d_]*\.?\d*(?:[eE][+-]?\d+)?)\w{0,3}(?![\w$]))"""
    r"""|(\s+)|([,\[\]{}();:&=]+)|[^\W\d][\w$]*|.""",
    re.S,
)


def header_lines(text: str) -> Iterator[str]:
    """Lines of the comments that a text begins with, up to the first line of code, however many; open block comments and docstrings are followed."""
    closes = None
    for line in text.lstrip("\ufeff").split("\n"):
        rest = s = line.strip()
        if closes is None and s and not COMMENT.match(s):
            if s.startswith(("package ", "#!", "use strict", "'use strict'", '"use strict"')):
                continue
            return
        if s:
            yield s
        while rest:
            if closes is None:
                m = COMMENT.match(rest)
                if not m:
                    return
                closes, rest = CLOSES.get(m.group(1)), rest[m.end() :]
                if closes is None:
                    break
            if closes not in rest:
                break
            rest, closes = rest.split(closes, 1)[1].strip(), None


def header_says_generated(text: str) -> bool:
    """Whether a comment before the first line of code says that a tool wrote this very file."""
    says = lambda s: STRONG.search(s) or MAKER.search(s) and BAN.search(s)
    return any(says(s) and (BAN.search(s) or not HAND.search(s)) for s in header_lines(text))


def composition(text: str) -> tuple[float, float, float, int]:
    """(share of white space outside literals and comments, mean length of lines that are not blank, share of literals and separators in what is neither white
    space nor comment, number of literals)."""
    tokens = TOKENS.findall(text)
    comment, literal, space, between = (sum(map(len, x)) for x in zip(*tokens)) if tokens else (0,) * 4
    lines = sum(1 for x in text.split("\n") if x.strip())
    solid = len(text) - comment - space
    bare = len(text) - comment - literal
    return space / max(1, bare), len(text) / max(1, lines), (literal + between) / max(1, solid), sum(1 for t in tokens if t[1])


def trait_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """A mapInPandas function: traits of each text and the hashes of its lines that hold a letter or digit, without white space at their ends."""
    import xxhash

    h = xxhash.xxh64_intdigest
    for pdf in batches:
        rows = []
        for fid, text in zip(pdf["file_id"], pdf["content"]):
            text = text.replace("\r\n", "\n")
            space, mean, data, literals = composition(text)
            lines = {s for x in text.split("\n") if any(map(str.isalnum, s := " ".join(x.split())))}
            rows.append((fid, header_says_generated(text), space < SPACE and mean > MEAN_LINE, data >= DATA and literals >= LITERALS, len(lines), np.array([h(x) for x in lines], dtype=np.uint64).view(np.int64)))
        yield pd.DataFrame(rows, columns=["file_id", "header", "dense", "data", "n_lines", "lines"])


TRAITS = "file_id long, header boolean, dense boolean, data boolean, n_lines int, lines array<long>"


def upstream_copies(traits: DataFrame, upstream: DataFrame) -> DataFrame:
    """(file_id, item_id, of_item, of_file): each file with the published item that it holds most of, exact shares of rare lines.

    The inverted index is that of the items' lines; a line in more than RARE libraries is boilerplate and dropped, however many versions of a library
    hold it; without a column ``library`` each item is one. Files meet items by equal
    hashes only; a hot line is one row of the index, and its hits are added up by (file, item) before they move."""
    items = upstream.select(F.col("item_id").alias("file_id"), "content").where(F.col("content").isNotNull()).mapInPandas(trait_rows, TRAITS)
    index = items.select(F.col("file_id").alias("item_id"), F.explode("lines").alias("h"))
    own = F.concat(F.lit("item "), F.col("item_id").cast("string"))
    library = upstream.select("item_id", (F.coalesce("library", own) if "library" in upstream.columns else own).alias("library")).distinct()
    rare = index.join(library, "item_id").groupBy("h").agg(F.collect_set("item_id").alias("items"), F.collect_set("library").alias("of")).where(F.size("of") <= RARE)
    rare = materialize(rare.select("h", F.explode("items").alias("item_id")), "upstream-lines")
    size = rare.groupBy("item_id").agg(F.count("*").alias("rare_lines"))
    hits = traits.select("file_id", "n_lines", F.explode("lines").alias("h")).join(rare, "h").groupBy("file_id", "n_lines", "item_id").agg(F.count_distinct("h").alias("shared"))
    hits = hits.join(size, "item_id").select("file_id", "item_id", (F.col("shared") / F.col("rare_lines")).alias("of_item"), (F.col("shared") / F.col("n_lines")).alias("of_file"))
    return hits.where((F.col("of_item") >= CONTAINED) & (F.col("of_file") >= CONTAINED)).groupBy("file_id").agg(F.max_by(F.struct("item_id", "of_item", "of_file"), F.struct("of_item", -F.col("item_id"))).alias("x")).select("file_id", "x.*")


def shared_copies(traits: DataFrame, files: DataFrame) -> DataFrame:
    """(file_id, other_repository_id, of_file): files that another repository holds too, with the repository that holds most of each and the exact share of
    its lines.

    The inverted index has a row for each rare line and repository that it occurs in; a line of more than RARE_REPOSITORIES repositories is
    boilerplate there. A file meets at most that many rows a line, so no pairs of files are formed and a hot line costs no more than its
    occurrences. Texts of equal lines are found by one key over all their lines, in however many repositories they lie. Files of fewer than LEAST_LINES
    lines are nobody's copy."""
    home = files.select(F.col("id").alias("file_id"), "repository_id").where("file_id is not null and repository_id is not null")
    own = traits.where(F.col("n_lines") >= LEAST_LINES).dropDuplicates(["file_id"]).select("file_id", "n_lines", "lines", F.xxhash64(F.sort_array("lines")).alias("whole")).join(home, "file_id")
    lines = own.select("file_id", "repository_id", "n_lines", F.explode("lines").alias("h"))
    index = lines.select("h", "repository_id").distinct().groupBy("h").agg(F.collect_list("repository_id").alias("in")).where(F.size("in").between(2, RARE_REPOSITORIES))
    index = materialize(index.select("h", F.explode("in").alias("other")), "repository-lines")
    hits = lines.join(index, "h").where("other <> repository_id").groupBy("file_id", "n_lines", "other").agg(F.count("*").alias("shared"))
    part = hits.select("file_id", "other", (F.col("shared") / F.col("n_lines")).alias("of_file")).where(F.col("of_file") >= CONTAINED)
    keys = own.groupBy("whole").agg(F.min("repository_id").alias("a"), F.max("repository_id").alias("b")).where("a < b")
    same = own.join(keys, "whole").select("file_id", F.when(F.col("repository_id") == F.col("a"), F.col("b")).otherwise(F.col("a")).alias("other"), F.lit(1.0).alias("of_file"))
    best = F.max_by(F.struct("other", "of_file"), F.struct("of_file", -F.col("other"))).alias("x")
    return part.unionByName(same).groupBy("file_id").agg(best).select("file_id", F.col("x.other").alias("other_repository_id"), F.col("x.of_file").alias("of_file"))


def not_handwritten(files: DataFrame, sources: DataFrame, upstream: DataFrame) -> DataFrame:
    """(file_id, repository_id, reason, item_id, other_repository_id, size_bytes) of every source file that no one wrote by hand, with the first reason that
    holds: generated, vendored, minified, data, shared. Of a ``shared`` file two repositories hold most lines without a published item that tells
    whose it is: one of them wrote it, the other has a copy.

    Needs id, repository_id, path, language, size_bytes of ``files``, file_id, content of ``sources`` and item_id, content of ``upstream``, with
    library if it has versions. Files with a suffix of NO_SOURCE, such as configuration, never come out; all others are judged. A file whose content is
    null or missing is judged by its path. Line ends and a byte-order mark change nothing; size_bytes is given as stored, as it may be null
    or wrong. A file is judged once for each of its rows in ``files``, however often its text comes; rows without an id and empty tables give no rows.

    Plan: one Python pass per text writes traits and line hashes; text itself is never shuffled. Paths join by id.
    """
    text = spread(sources.select("file_id", "content").where((F.length("content") > 0) & F.col("file_id").isNotNull()))
    traits = materialize(text.mapInPandas(trait_rows, TRAITS), "file-traits")
    copies, twice = upstream_copies(traits, upstream), shared_copies(traits, files).select(F.col("file_id").alias("twice_id"), "other_repository_id")
    parts = F.split(F.regexp_replace("path", r"[^/]*$", ""), "/")
    lang = suffix_language(F.col("path"), F.col("language"))
    base = F.regexp_extract("path", r"([^/]+)$", 1)
    f = files.select("id", "repository_id", "path", "size_bytes", lang.alias("lang"), parts.alias("dirs"), base.alias("base")).where("id is not null")
    suffix = F.lower(F.regexp_extract("base", r"\.([^.]+)$", 1))
    f = f.where(~suffix.isin(*NO_SOURCE))
    script = F.coalesce(F.col("lang").isin("javascript", "typescript"), F.lit(False)) | suffix.isin(*SCRIPTS)
    # a directory under node_modules and the like may itself be called gen or dist: the outer one decides
    has = lambda names: F.exists("dirs", lambda d: F.lower(d).isin(*names))
    j = f.join(traits.drop("lines", "n_lines").dropDuplicates(["file_id"]).alias("t"), F.col("id") == F.col("t.file_id"), "left").drop("file_id").join(copies, F.col("id") == F.col("file_id"), "left").join(twice, F.col("id") == F.col("twice_id"), "left")
    reason = (
        F.when(F.coalesce("header", F.lit(False)) | F.col("base").rlike(GENERATED_NAMES), "generated")
        .when(has(VENDOR_DIRS) | F.col("item_id").isNotNull(), "vendored")
        .when(has(GENERATED_DIRS), "generated")
        .when(F.col("base").rlike(MINIFIED_NAMES) | (script & F.coalesce("dense", F.lit(False)) & ~F.coalesce("data", F.lit(False))), "minified")
        .when(F.coalesce("data", F.lit(False)), "data")
        .when(F.col("other_repository_id").isNotNull(), "shared")
    )
    return j.select(F.col("id").alias("file_id"), "repository_id", reason.alias("reason"), "item_id", "other_repository_id", "size_bytes").where("reason is not null")
