"""Search: score all chunks, cut, boost, rerank, drop near copies; then symbols in front and neighbours behind."""

from __future__ import annotations

import difflib
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.config import Settings
from weftline.functions import vectors as V
from weftline.functions.lexical import cover_score
from weftline.operators.graph import neighbourhood
from weftline.session import materialize

Reranker = Callable[[pd.DataFrame, str], Sequence[float]]


@dataclass
class Query:
    """What is searched for, and the filters; empty filters let everything pass."""

    vector: Sequence[float] | None = None
    text: str = ""
    limit: int = 10
    repositories: list[int] = field(default_factory=list)
    languages: list[str] = field(default_factory=list)
    since: str | None = None
    lexical: bool = False
    lexical_weight: float = 0.3
    reranker: Reranker | None = None
    rerank_weight: float = 0.4
    rerank_top: int = 0
    dedup: float | None = 0.97
    hops: int = 1
    strict_filters: bool = True


def clamp(x: float) -> float:
    return max(0.0, min(1.0, x))


def passes(q: Query) -> Column:
    """The filters as one predicate on repository_id, language and created_at; it reaches the scan."""
    out = F.lit(True)
    if q.repositories:
        out = out & F.col("repository_id").isin(*q.repositories)
    if q.languages:
        out = out & F.col("language").isin(*q.languages)
    if q.since:
        out = out & (F.col("created_at") >= F.lit(q.since).cast("timestamp_ntz"))
    return out


def search_base(chunks: DataFrame, files: DataFrame, repositories: DataFrame) -> DataFrame:
    """Chunks with path and repository of their file; chunks of unknown files drop out."""
    f = files.select(F.col("id").alias("file_id"), F.col("path").alias("file_path"), "repository_id")
    r = repositories.select(F.col("id").alias("repository_id"), F.col("name").alias("repository"))
    return chunks.join(f, "file_id").join(r, "repository_id")


def top_scored(base: DataFrame, q: Query) -> DataFrame:
    """(id, vector_score, lexical_score, score, rank): the first stage. The vector part is weighed with 1 - lexical weight even where no
    lexical score is used. Only ids and scores are sorted; payloads join afterwards."""
    lw = clamp(q.lexical_weight)
    v = F.round(V.cosine_to(F.col("embedding"), q.vector), 6) if q.vector is not None else F.lit(None).cast("double")
    terms = [t for t in q.text.lower().split() if t]
    use = q.lexical and bool(terms)
    lex = cover_score(F.col("content"), terms) if use else F.lit(None).cast("double")
    s = base.where(passes(q))
    if q.vector is not None:  # on the JVM: a filter on the score itself would be pushed below the joins and score every row twice
        s = s.where(V.usable(F.col("embedding"), len(q.vector)))
    s = s.select("id", v.alias("vector_score"), lex.alias("lexical_score"))
    s = s.withColumn("score", F.round((1 - lw) * F.coalesce("vector_score", F.lit(0.0)) + lw * F.coalesce("lexical_score", F.lit(0.0)), 6))
    first = F.desc("score") if use else F.desc("vector_score")
    order = [first, F.desc("vector_score"), F.col("id")]
    return s.orderBy(*order).limit(q.limit).withColumn("rank", F.row_number().over(Window.orderBy(*order)))  # at most ``limit`` rows


def boosted(hits: DataFrame, q: Query, st: Settings = Settings()) -> DataFrame:
    """Scores with boosts for top-level chunks, recent edits and matches of the filters, and the reason of the last boost."""
    m = F.col("metadata")
    top = F.coalesce(m["depth"] == st.top_level_depth, F.lit(False))
    recent = F.coalesce(m["recent_edit"], F.lit(False))
    bonus = F.when(top, st.boost_top_level).otherwise(0.0) + F.when(recent, st.boost_recent_edit).otherwise(0.0)
    if q.languages:
        bonus = bonus + F.when(F.col("language").isin(*q.languages), st.filter_match_boost).otherwise(0.0)
    if q.repositories:
        bonus = bonus + F.when(F.coalesce(m["repository_id"].isin(*q.repositories), F.lit(False)), st.filter_match_boost).otherwise(0.0)
    reason = F.when(recent, "recent_edit").when(top, "top_level")
    return hits.withColumn("score", F.round(F.col("score") + bonus, 6)).withColumn("boost_reason", reason)


def finish(q: Query):
    """A mapInPandas function over the few hits, in one task: rerank the head, then drop near copies greedily in score order."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts = list(batches)
        if not parts:
            return
        pdf = pd.concat(parts, ignore_index=True).sort_values(["score", "rank"], ascending=[False, True], kind="stable").reset_index(drop=True)
        if q.reranker is not None and len(pdf):
            n = q.rerank_top or len(pdf)
            rw = clamp(q.rerank_weight)
            try:
                r = list(q.reranker(pdf.iloc[:n], q.text))
                if len(r) == min(n, len(pdf)):
                    pdf.loc[: len(r) - 1, "score"] = ((1 - rw) * pdf["score"].iloc[: len(r)] + rw * np.asarray(r, dtype=float)).round(6)
                    pdf = pdf.sort_values(["score", "rank"], ascending=[False, True], kind="stable").reset_index(drop=True)
            except Exception:  # a reranker that fails leaves the order as it is
                pass
        keep: list[int] = []
        for k in range(len(pdf)):
            text = pdf["content"].iloc[k] or ""
            if q.dedup is None or all(difflib.SequenceMatcher(None, pdf["content"].iloc[j] or "", text).ratio() < q.dedup for j in keep):
                keep.append(k)
        pdf = pdf.iloc[keep[: q.limit]].reset_index(drop=True)
        pdf["rank"] = np.arange(1, len(pdf) + 1, dtype=np.int32)
        yield pdf

    return run


HIT = "id long, content string, skeleton_content string, start_line int, end_line int, chunk_type string, language string, file_path string, repository string, vector_score double, lexical_score double, score double, boost_reason string, rank int"
HIT_COLUMNS = [c.split()[0] for c in HIT.split(", ")]


def search_chunks(base: DataFrame, q: Query, st: Settings = Settings()) -> DataFrame:
    """The ranked hits of a query: first stage, boosts, rerank, removal of near copies, in that order; all after the cut sees at most ``limit`` rows."""
    top = top_scored(base, q)
    hits = boosted(base.drop("embedding").join(F.broadcast(top), "id"), q, st)  # ``limit`` rows
    return hits.select(*HIT_COLUMNS).coalesce(1).mapInPandas(finish(q), HIT)


def symbol_hits(symbols: DataFrame, chunks: DataFrame, files: DataFrame, q: Query, st: Settings = Settings()) -> DataFrame:
    """Chunks of global symbols whose name holds a word of the query, at most ``symbol_cap``, with position. Words are matched literally."""
    words = sorted({w.strip(" ,.:()") for w in q.text.split()} - {""})
    if not words:
        match = F.lit(False)
    else:
        match = F.lit(False)
        for w in words:
            match = match | F.contains(F.lower("name"), F.lit(w.lower()))
    s = symbols.where(match).select("file_id", "chunk_id", "name")
    f = files.select(F.col("id").alias("file_id"), F.col("path").alias("file_path"), "repository_id")
    c = chunks.select(F.col("id").alias("chunk_id"), "content", "skeleton_content", "language", "created_at")
    j = s.join(c, "chunk_id").join(f, "file_id")
    if q.strict_filters:
        j = j.where(passes(q))
    elif q.repositories:
        j = j.where(F.col("repository_id").isin(*q.repositories))
    j = j.orderBy("name", "chunk_id").limit(st.symbol_cap)
    pos = F.row_number().over(Window.orderBy("name", "chunk_id"))
    return j.select(F.col("chunk_id").alias("id"), "content", "skeleton_content", "language", "file_path", F.lit("global").alias("chunk_type"), F.lit(st.symbol_score).alias("score"), F.lit("global_symbol").alias("boost_reason"), pos.alias("rank"))


def neighbour_hits(hits: DataFrame, relations: DataFrame, chunks: DataFrame, files: DataFrame, hops: int) -> DataFrame:
    """Neighbours of the hits in the relation graph, with the skeleton for content where there is one."""
    near = neighbourhood(relations, hits.select("id"), hops).where("hop > 0")
    f = files.select(F.col("id").alias("file_id"), F.col("path").alias("file_path"))
    j = chunks.select("id", "file_id", "content", "skeleton_content", "language", "chunk_type").join(near, "id").join(f, "file_id")
    return j.select("id", F.coalesce("skeleton_content", "content").alias("content"), F.col("content").alias("full_content"), F.col("skeleton_content").isNotNull().alias("skeleton_only"), "language", "chunk_type", "file_path", F.lit("graph_neighbor").alias("relation_type"), F.col("hop").alias("rank"))


def search(base: DataFrame, q: Query, relations: DataFrame, chunks: DataFrame, files: DataFrame, symbols: DataFrame, st: Settings = Settings()) -> DataFrame:
    """All three sections in order: symbols (last found first), hits, neighbours; ``section``, ``position`` and ``id`` give the order, the position of
    a neighbour being its hop. The hits are written once, as the walk from them reads them again."""
    hits = materialize(search_chunks(base, q, st), "hits").withColumns({"section": F.lit(1), "position": F.col("rank")})
    out = symbol_hits(symbols, chunks, files, q, st).withColumns({"section": F.lit(0), "position": -F.col("rank")}).unionByName(hits, allowMissingColumns=True)
    if q.hops > 0:
        near = neighbour_hits(hits, relations, chunks, files, q.hops).withColumns({"section": F.lit(2), "position": F.col("rank")})
        out = out.unionByName(near, allowMissingColumns=True)
    return out.orderBy("section", "position", "id")


BLOCK_Q, BLOCK_B = 1024, 8192


def batch_top_k(queries: DataFrame, base: DataFrame, k: int) -> DataFrame:
    """(query_id, id, score, rank): exact top k of ``base`` (id, embedding) for each of ``queries`` (id, embedding), itself left out.

    Both sides are cut into blocks by hash of the id; every block of queries meets every block of the base in a task of its own, as one
    matrix product, which keeps k rows a query. Rows of another width, null or all zero take no part; a tie goes to the smaller id.
    """
    ok = lambda d: d.where(F.col("embedding").isNotNull() & F.exists("embedding", lambda x: x != 0) & ~F.exists("embedding", lambda x: x.isNull())).select("id", "embedding")
    q, b = ok(queries), ok(base)
    nq, nb = max(1, -(-q.count() // BLOCK_Q)), max(1, -(-b.count() // BLOCK_B))
    part = lambda n: F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
    q = q.select("id", "embedding", part(nq).alias("qb"), F.explode(F.sequence(F.lit(0), F.lit(nb - 1))).alias("bb"))
    b = b.select("id", "embedding", part(nb).alias("bb"), F.explode(F.sequence(F.lit(0), F.lit(nq - 1))).alias("qb"))

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = []
        for width, ql in left.groupby(left["embedding"].map(len)):
            bl = right[right["embedding"].map(len) == width]
            if not len(bl):
                continue
            x, y = (np.stack(d["embedding"].to_numpy()).astype(np.float64) for d in (ql, bl))
            x, y = x / np.linalg.norm(x, axis=1, keepdims=True), y / np.linalg.norm(y, axis=1, keepdims=True)
            s = np.round(x @ y.T, 6)
            qi, bi = ql["id"].to_numpy(), bl["id"].to_numpy()
            s[qi[:, None] == bi[None, :]] = -np.inf
            order = np.lexsort((np.broadcast_to(bi, s.shape), -s), axis=1)[:, :k]
            top = np.take_along_axis(s, order, axis=1)
            good = np.isfinite(top)
            out.append(pd.DataFrame({"query_id": np.repeat(qi, good.sum(axis=1)), "id": bi[order][good], "score": top[good]}))
        return pd.concat(out) if out else pd.DataFrame({"query_id": np.zeros(0, np.int64), "id": np.zeros(0, np.int64), "score": np.zeros(0)})

    best = q.groupBy("qb", "bb").cogroup(b.groupBy("qb", "bb")).applyInPandas(run, "query_id long, id long, score double")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return best.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
