"""Cutting files into chunks: by structure where a grammar is at hand, else by lines; and skeletons of chunks."""

from __future__ import annotations

import ast
from bisect import bisect_right
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from weftline.config import Settings
from weftline.functions.text import generic_skeleton, lines
from weftline.operators.declarations import declarations

#: Kinds of syntax nodes that make a chunk, by language.
CHUNKABLE = {
    "python": ["function_definition", "class_definition", "decorated_definition"],
    "javascript": ["function_declaration", "class_declaration", "method_definition", "arrow_function"],
    "typescript": ["function_declaration", "class_declaration", "method_definition", "arrow_function"],
    "java": ["method_declaration", "constructor_declaration", "class_declaration"],
    "go": ["function_declaration", "method_declaration"],
    "rust": ["function_item", "impl_item", "trait_item", "struct_item"],
}


def is_chunkable(kind: Column, language: Column) -> Column:
    out = F.lit(False)
    for lang, kinds in CHUNKABLE.items():
        out = out | ((language == lang) & kind.isin(*kinds))
    return F.coalesce(out, F.lit(False))


def line_chunks(texts: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """(file_id, chunk_no, content, start_line, end_line, start_byte, end_byte, chunk_type, total_lines) of a table with file_id and content.

    Chunk k covers the lines from k * step on, as many as a chunk has; every line is in one or two chunks. Bytes are offsets in UTF-8. A null content
    gives no rows, an empty one a single empty chunk. Pure expressions: nothing is shuffled."""
    size, step = settings.chunk_lines, settings.chunk_step
    ls = texts.where(F.col("content").isNotNull()).select("file_id", lines(F.col("content")).alias("l"))
    n = F.size("l")
    # pieces of one step, exploded once; a chunk is its own piece and the first lines of those behind it, so no chunk looks at the lines before it
    cut = F.transform(F.sequence(F.lit(0), n - 1, F.lit(step)), lambda at: F.slice("l", at + 1, F.lit(step)))
    parts = ls.select("file_id", n.alias("n"), cut.alias("p")).select("file_id", "n", "p", F.aggregate("p", F.array(F.lit(0).cast("long")), lambda a, x: F.array_append(a, F.element_at(a, -1) + F.octet_length(F.array_join(x, "\n")) + 1)).alias("b"))
    parts = parts.select("file_id", "n", F.explode(F.transform("p", lambda x, k: F.struct(k.alias("chunk_no"), x.alias("own"), F.flatten(F.slice("p", k + 2, F.lit(-(-(size - step) // step)))).alias("next"), F.get("b", k).alias("start_byte")))).alias("c")).select("file_id", "n", "c.*")
    body = F.array_join(F.concat("own", F.slice("next", F.lit(1), F.lit(size - step))), "\n")
    at = F.col("chunk_no") * step
    out = parts.select("file_id", "chunk_no", body.alias("content"), (at + 1).alias("start_line"), F.least(at + size, F.col("n")).alias("end_line"), "start_byte", F.col("n").alias("total_lines"))
    return out.withColumn("end_byte", F.col("start_byte") + F.octet_length("content")).withColumn("chunk_type", F.lit("block"))


def _walk(node: ast.AST, depth: int, most: int, text: list[str], starts: list[int]) -> Iterator[tuple]:
    for child in ast.iter_child_nodes(node):
        named = isinstance(child, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef))
        if not named:
            yield from _walk(child, depth + (1 if isinstance(child, ast.stmt) else 0), most, text, starts)
            continue
        deco = child.decorator_list
        first = deco[0].lineno if deco else child.lineno
        col = child.col_offset
        body = "\n".join(text[first - 1 : child.end_lineno])[col if not deco else max(0, deco[0].col_offset - 1) :]
        kind = "decorated_definition" if deco else "class_definition" if isinstance(child, ast.ClassDef) else "function_definition"
        if len(body) <= most:
            yield kind, depth, child.name, first, child.end_lineno, starts[first - 1] + col, body
        else:
            yield from _walk(child, depth + 2 + bool(deco), most, text, starts)


def python_chunks(source: str, most: int) -> list[tuple]:
    """(kind, depth, name, start_line, end_line, start_byte, content) of the definitions of a Python source, outermost that fit first; none
    for a source that does not parse."""
    try:
        tree = ast.parse(source)
    except (SyntaxError, ValueError, RecursionError):
        return []
    text = source.split("\n")
    starts, at = [], 0
    for line in text:
        starts.append(at)
        at += len(line.encode("utf-8", "replace")) + 1
    return list(_walk(tree, 1, most, text, starts))


def _offsets(text: str, ends: list[int]) -> dict[int, int]:
    """Byte offsets in UTF-8 of offsets in characters."""
    out, at, byte = {}, 0, 0
    for e in sorted(set(ends)):
        byte += len(text[at:e].encode("utf-8", "replace"))
        out[e], at = byte, e
    return out


def brace_chunks(source: str, language: str, most: int) -> list[tuple]:
    """Rows like those of python_chunks for a Java, JavaScript, TypeScript, Go or Rust source; none where brackets do not match."""
    found = list(declarations(source, language, most, CHUNKABLE[language]))
    at = _offsets(source, [d.start for d in found])
    line = lambda k: source.count("\n", 0, k) + 1
    return [(d.kind, d.depth, d.name, line(d.start), line(d.end), at[d.start], source[d.start : d.end]) for d in found]


def definitions_of(source: str, language: str) -> list[tuple]:
    """(kind, name, start_byte, end_byte, start_row, start_col, end_row, end_col) of all functions and classes of a Python, JavaScript or TypeScript
    source, nested ones too. Rows and columns count from 0, columns in bytes."""
    text, starts, at = source.split("\n"), [], 0
    for x in text:
        starts.append(at)
        at += len(x.encode("utf-8", "replace")) + 1
    if language == "python":
        try:
            nodes = [n for n in ast.walk(ast.parse(source)) if isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef))]
        except (SyntaxError, ValueError, RecursionError):
            return []
        found = [("class" if isinstance(n, ast.ClassDef) else "function", n.name, starts[n.lineno - 1] + n.col_offset, starts[n.end_lineno - 1] + n.end_col_offset) for n in nodes]
    else:
        kinds = {"function_declaration": "function", "class_declaration": "class"}
        own = [d for d in declarations(source, language, None) if d.kind in kinds]
        at = _offsets(source, [x for d in own for x in (d.start, d.end)])
        found = [(kinds[d.kind], d.name, at[d.start], at[d.end]) for d in own]
    point = lambda b: (k := bisect_right(starts, b) - 1, b - starts[k])
    return [(*x, *point(x[2]), *point(x[3])) for x in sorted(found, key=lambda x: (x[2], -x[3]))]


DEFINITIONS = "file_id long, kind string, name string, start_byte long, end_byte long, start_row int, start_col int, end_row int, end_col int"


def definitions(sources: DataFrame) -> DataFrame:
    """Functions and classes of Python, JavaScript and TypeScript files. Needs file_id, content, language."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(f, *x) for f, t, lang in zip(pdf["file_id"], pdf["content"], pdf["lang"]) for x in definitions_of(t, lang)]
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in DEFINITIONS.split(", ")])

    own = sources.select("file_id", "content", F.lower("language").alias("lang"))
    return own.where(F.col("lang").isin("python", "javascript", "typescript") & F.col("content").isNotNull()).mapInPandas(run, DEFINITIONS)


def residual_blocks(source: str, covered: list[tuple[int, int]], size: int) -> list[tuple]:
    """Rows like those of python_chunks for the lines outside the covered ranges, at most ``size`` lines each, blank ends left out."""
    text = source.split("\n")
    inside = [False] * (len(text) + 2)
    for a, b in covered:
        inside[a : b + 1] = [True] * (b + 1 - a)
    starts, at = [], 0
    for line in text:
        starts.append(at)
        at += len(line.encode("utf-8", "replace")) + 1
    out, run = [], []
    for k in range(1, len(text) + 2):
        free = k <= len(text) and not inside[k]
        if free and (run or text[k - 1].strip()):
            run.append(k)
        if run and (not free or len(run) == size):
            while not text[run[-1] - 1].strip():
                run.pop()
            out.append(("block", 0, None, run[0], run[-1], starts[run[0] - 1], "\n".join(text[run[0] - 1 : run[-1]])))
            run = []
    return out


def python_skeleton(content: str) -> str:
    """Signatures with docstrings of a Python text's definitions, members of classes indented; the first line where nothing is defined or parses."""
    first = content.strip().split("\n")[0].strip() if content.strip() else ""
    try:
        tree = ast.parse(content)
    except (SyntaxError, ValueError, RecursionError):
        return first
    text, out = content.split("\n"), []

    def visit(node: ast.AST, pad: str) -> None:
        """Definitions of a node's statements, also those under conditions and handlers; functions are not entered."""
        for child in ast.iter_child_nodes(node):
            if isinstance(child, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
                show(child, pad)
            elif isinstance(child, (ast.stmt, ast.ExceptHandler, ast.match_case)):
                visit(child, pad)

    def show(node: ast.AST, pad: str) -> None:
        doc = ast.get_docstring(node)
        out.append(pad + text[node.lineno - 1].strip())
        if doc:
            out.append(f'{pad}    """{doc}"""')
        if isinstance(node, ast.ClassDef):
            visit(node, pad + "    ")

    visit(tree, "")
    return "\n".join(out) or first


STRUCTURAL = "file_id long, content string, chunk_type string, depth int, name string, start_line int, end_line int, start_byte long, end_byte long"


def structural_chunks(sources: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Chunks of the files of CHUNKABLE's languages by their definitions, of at most twice the chunk size; larger ones are entered. Needs file_id,
    content, language. Python is cut by its grammar, the others by headers and matching brackets; declarations of other kinds are entered.

    Code outside definitions is left out unless ``include_residual`` is set."""
    most = 2 * settings.chunk_size

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for fid, text, lang in zip(pdf["file_id"], pdf["content"], pdf["lang"]):
                found = python_chunks(text, most) if lang == "python" else brace_chunks(text, lang, most)
                if found and settings.include_residual:
                    found += residual_blocks(text, [(x[3], x[4]) for x in found], settings.chunk_lines)
                for kind, depth, name, a, b, byte, body in found:
                    rows.append((fid, body, kind, depth, name, a, b, byte, byte + len(body.encode("utf-8", "replace"))))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in STRUCTURAL.split(", ")])

    own = sources.select("file_id", "content", F.lower("language").alias("lang"))
    return own.where(F.col("lang").isin(*CHUNKABLE) & F.col("content").isNotNull()).mapInPandas(run, STRUCTURAL)


def chunk_files(sources: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Structural chunks where a file has some, line chunks for all others."""
    s = structural_chunks(sources, settings)
    rest = sources.join(s.select("file_id").distinct(), "file_id", "left_anti")
    return s.unionByName(line_chunks(rest, settings), allowMissingColumns=True)


@F.pandas_udf(StringType())
def python_skeleton_udf(content: pd.Series) -> pd.Series:
    return content.map(lambda t: None if t is None else python_skeleton(t))


def skeletons(chunks: DataFrame) -> DataFrame:
    """``chunks`` with skeleton_content filled: by grammar for Python, else the first line. Only Python rows leave the JVM."""
    py = F.lower(F.coalesce("language", F.lit(""))) == "python"
    cols = [c for c in chunks.columns if c != "skeleton_content"]
    a = chunks.where(py).select(*cols, python_skeleton_udf("content").alias("skeleton_content"))
    b = chunks.where(~py).select(*cols, generic_skeleton(F.col("content")).alias("skeleton_content"))
    return a.unionByName(b)
