"""Symbols of chunks, relations between chunks, and walks along them."""

from __future__ import annotations

import ast
import re
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.functions import text as T
from weftline.session import materialize

#: Chunk types whose calls and bases are followed.
CALLERS = ["function_definition", "method_definition", "decorated_definition"]
INHERITORS = ["class_definition"]
#: Rounds of a walk that are folded into one table.
FOLD = 8
SYMBOLS = "chunk_id long, kind string, name string, module string, unparsed string"


def python_symbols(content: str) -> list[tuple[str, str, str | None]] | None:
    """(kind, name, module) of imports, calls, bases, functions and classes of a Python text; None where it does not parse."""
    try:
        tree = ast.parse(content)
    except (SyntaxError, ValueError, RecursionError):
        return None
    out: dict[tuple, None] = {}
    for n in ast.walk(tree):
        if isinstance(n, ast.Import):
            for a in n.names:
                out["import", a.asname or a.name, a.name.split(".")[0]] = None
        elif isinstance(n, ast.ImportFrom):
            for a in n.names:
                out["import", a.name, (n.module or "").split(".")[0]] = None
        elif isinstance(n, ast.Call):
            f = n.func
            name = f.id if isinstance(f, ast.Name) else f.attr if isinstance(f, ast.Attribute) else None
            if name:
                out["call", name, None] = None
        elif isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef)):
            out["function", n.name, None] = None
        elif isinstance(n, ast.ClassDef):
            out["class", n.name, None] = None
            for b in n.bases:
                name = b.id if isinstance(b, ast.Name) else b.attr if isinstance(b, ast.Attribute) else None
                if name:
                    out["base", name, None] = None
    return list(out)


def python_constants(source: str) -> list[str]:
    """Names in capitals that are assigned at module level, in order."""
    try:
        tree = ast.parse(source)
    except (SyntaxError, ValueError, RecursionError):
        return []
    names: dict[str, None] = {}
    for n in tree.body:
        targets = n.targets if isinstance(n, ast.Assign) else [n.target] if isinstance(n, ast.AnnAssign) else []
        for t in targets:
            if isinstance(t, ast.Name) and t.id.isupper():
                names[t.id] = None
    return list(names)


JS_IMPORT = re.compile(r"^\s*import\s+(?:type\s+)?(.+?)\s+from\s+[\"']([^\"']+)[\"']", re.M)


def _script_imports(content: str) -> list[tuple[str, str, str]]:
    out = []
    for what, source in JS_IMPORT.findall(content):
        module = re.sub(r"\.\w+$", "", source.rsplit("/", 1)[-1])
        for part in re.sub(r"[{}]", ",", what).split(","):
            name = re.split(r"\s+as\s+", part.strip())[-1].strip()
            if name and name != "*":
                out.append(("import", name, module))
    return out


def _symbol_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """A mapInPandas function: a row for each symbol, and one with the text itself for a Python text that does not parse."""
    for pdf in batches:
        rows = []
        for cid, text, lang in zip(pdf["id"], pdf["content"], pdf["lang"]):
            found = python_symbols(text) if lang == "python" else _script_imports(text)
            rows += [(cid, None, None, None, text)] if found is None else [(cid, *x, None) for x in found]
        yield pd.DataFrame(rows, columns=["chunk_id", "kind", "name", "module", "unparsed"])


def _tagged(kinds: dict) -> Column:
    """Array of (kind, name) from arrays of names by kind."""

    def tagged(kind: str, names: Column) -> Column:
        return F.transform(names, lambda x: F.struct(F.lit(kind).alias("kind"), x.alias("name")))

    return F.flatten(F.array(*[tagged(k, v) for k, v in kinds.items()]))


def _python_patterns(c: Column) -> Column:
    """Array of (kind, name) for a Python text that does not parse: definitions by their headers at the start of a line, calls and bases by pattern."""
    return _tagged({"call": T.called_names(c), "function": T.python_headers(c, "def"), "class": T.python_headers(c, "class"), "base": T.base_names(c)})


#: Names of a text by pattern, by kind.
PATTERNS = {"call": T.called_names, "function": T.defined_names, "class": T.class_names, "base": T.base_names}


def pattern_symbols(chunks: DataFrame, kinds: list[str] = list(PATTERNS), scope: list[str] = ()) -> DataFrame:
    """(chunk_id, kind, name, scope...): names of the asked ``kinds`` by pattern, for any language. Pure expressions, only those of the kinds."""
    c = F.col("content")
    rows = _tagged({k: PATTERNS[k](c) for k in kinds})
    return chunks.where(c.isNotNull()).select(F.col("id").alias("chunk_id"), *scope, F.explode(rows).alias("s")).select("chunk_id", "s.kind", "s.name", *scope)


def symbols(chunks: DataFrame) -> DataFrame:
    """(chunk_id, kind, name, module) of all chunks: Python by its grammar, imports of scripts by line, the rest by pattern.

    Python that does not parse (blocks of lines, indented methods) gives calls, bases and definitions by pattern, and no imports."""
    lang = F.lower(F.coalesce("language", F.lit("unknown")))
    base = chunks.where(F.col("content").isNotNull()).select("id", "content", lang.alias("lang"))
    parsed = base.where(F.col("lang").isin("python", "javascript", "typescript")).mapInPandas(_symbol_rows, SYMBOLS)
    own = F.array(F.struct("kind", "name"))
    parsed = parsed.select("chunk_id", "module", F.explode(F.when(F.col("unparsed").isNull(), own).otherwise(_python_patterns(F.col("unparsed")))).alias("s")).select("chunk_id", "s.kind", "s.name", "module")
    rest = pattern_symbols(base.where(F.col("lang") != "python")).withColumn("module", F.lit(None).cast("string"))
    return parsed.unionByName(rest).distinct()


def global_symbols(sources: DataFrame) -> DataFrame:
    """(file_id, name): constants in capitals of Python files."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(f, n) for f, t in zip(pdf["file_id"], pdf["content"]) for n in python_constants(t)]
            yield pd.DataFrame(rows, columns=["file_id", "name"])

    return sources.where(F.col("content").isNotNull()).select("file_id", "content").mapInPandas(run, "file_id long, name string")


def _resolve(uses: DataFrame, defs: DataFrame, relation: str) -> DataFrame:
    """Edges from uses to definitions of the same name; within one repository, where both sides say which they are of."""
    on = ["name", *[c for c in ["repository_id"] if c in uses.columns and c in defs.columns]]
    u, d = uses.select(F.col("chunk_id").alias("source_chunk_id"), *on), defs.select(F.col("chunk_id").alias("target_chunk_id"), *on)
    return u.join(d, on).where("source_chunk_id <> target_chunk_id").select("source_chunk_id", "target_chunk_id", F.lit(relation).alias("relation_type"), F.col("name").alias("symbol")).distinct()


def call_relations(syms: DataFrame, chunks: DataFrame, types: list[str] = CALLERS) -> DataFrame:
    """Calls of chunks of ``types`` to the chunks that define a function of that name."""
    who = chunks.where(F.col("chunk_type").isin(*types)).select(F.col("id").alias("chunk_id"))
    return _resolve(syms.where("kind = 'call'").join(who, "chunk_id", "left_semi"), syms.where("kind = 'function'"), "calls")


def inheritance_relations(syms: DataFrame, chunks: DataFrame, types: list[str] = INHERITORS) -> DataFrame:
    who = chunks.where(F.col("chunk_type").isin(*types)).select(F.col("id").alias("chunk_id"))
    return _resolve(syms.where("kind = 'base'").join(who, "chunk_id", "left_semi"), syms.where("kind = 'class'"), "inherits")


def import_relations(syms: DataFrame, modules: DataFrame) -> DataFrame:
    """Imports to the chunks of the module (``modules``: chunk_id, name of its file's stem), or that define the name."""
    imports = syms.where("kind = 'import'")
    scope = [c for c in imports.columns if c == "repository_id"]
    by_module = imports.select("chunk_id", F.col("module").alias("name"), *scope).where(F.col("name").isNotNull() & (F.col("name") != ""))
    defs = syms.where("kind in ('function', 'class')")
    both = _resolve(by_module.distinct(), modules, "imports").unionByName(_resolve(imports.select("chunk_id", "name", *scope), defs, "imports"))
    return both.groupBy("source_chunk_id", "target_chunk_id", "relation_type").agg(F.min("symbol").alias("symbol"))


def relations_of(relations: DataFrame, ids: DataFrame) -> DataFrame:
    """Relations that touch one of the ids at either end: two semi-joins and a distinct union, as an OR would be a nested loop."""
    i = ids.select(F.col(ids.columns[0]).alias("__id")).distinct()
    a = relations.join(i, relations["source_chunk_id"] == i["__id"], "left_semi")
    b = relations.join(i, relations["target_chunk_id"] == i["__id"], "left_semi")
    return a.union(b).distinct()


def incoming(relations: DataFrame, ids: DataFrame) -> DataFrame:
    i = ids.select(F.col(ids.columns[0]).alias("__id")).distinct()
    return relations.join(i, relations["target_chunk_id"] == i["__id"], "left_semi")


def neighbourhood(relations: DataFrame, seeds: DataFrame, hops: int) -> DataFrame:
    """(id, hop): nodes within ``hops`` undirected steps of the seeds, seeds themselves at 0. Stops early when nothing new is met."""
    e = relations.select(F.col("source_chunk_id").alias("a"), F.col("target_chunk_id").alias("b")).where("a is not null and b is not null")
    e = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    seen = seeds.select(F.col(seeds.columns[0]).alias("id")).distinct().withColumn("hop", F.lit(0))
    edge = seen
    for h in range(1, hops + 1):
        edge = edge.join(e, edge["id"] == e["a"]).select(F.col("b").alias("id")).distinct().join(seen, "id", "left_anti").withColumn("hop", F.lit(h))
        edge = materialize(edge, "hop")
        if edge.isEmpty():
            break
        seen = seen.unionByName(edge)
    return seen


def impacted(relations: DataFrame, changed: DataFrame) -> DataFrame:
    """(id): the changed chunks and all that depend on them, over any number of steps. Each round joins only the new frontier and is
    written to the shared folder; the walk ends when a round meets nothing new, so cycles are no matter."""
    e = materialize(relations.select(F.col("source_chunk_id").alias("s"), F.col("target_chunk_id").alias("t")).where("s is not null and t is not null").distinct(), "impact-edges")
    frontier = materialize(changed.select(F.col(changed.columns[0]).alias("id")).where("id is not null").distinct(), "impact")
    rounds = [frontier]
    while not frontier.isEmpty():
        if len(rounds) == FOLD:  # so that a long walk reads few tables a round
            rounds = [materialize(reduce(DataFrame.unionByName, rounds), "impact-seen")]
        seen = reduce(DataFrame.unionByName, rounds)
        frontier = materialize(e.join(frontier, e["t"] == frontier["id"], "left_semi").select(F.col("s").alias("id")).distinct().join(seen, "id", "left_anti"), "impact")
        rounds.append(frontier)
    return reduce(DataFrame.unionByName, rounds)
