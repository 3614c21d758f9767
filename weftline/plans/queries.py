"""Named queries over the tables of a folder: (spark, folder) -> DataFrame. Every one reads its tables whole."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftline.config import Settings
from weftline.functions import lexical
from weftline.functions import text as T
from weftline.functions import vectors as V
from weftline.operators import chunking, graph, lineage, ranking, store
from weftline.operators.embedding import embed, offline_backend
from weftline.plans.engine import overview_parts
from weftline.session import materialize
from weftline.sources.tables import table
from weftline.streaming.incremental import drain, landing, windowed_activity

S = Settings()
WIDTH = S.embedding_dimension
#: The words of the lexical queries, the repositories and languages that filtered queries ask for.
WORDS, TERMS = ["harbor", "token"], ["harbor", "ledger", "socket"]
REPOS, LANGS, SINCE = [1, 2, 3, 7], ["python", "go"], "2025-03-01 00:00:00"
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def _snapshots(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """What the index knew (files as first stored) and what the disk holds now, under today's paths: a text whose size is no longer the stored one has
    a new hash, files of two extensions moved to another directory, and null texts are gone."""
    files, src = table(spark, d, "files"), table(spark, d, "file_sources")
    old = files.select("repository_id", "path", F.coalesce("fingerprint", F.concat(F.lit("none:"), F.col("id"))).alias("fingerprint"), "content_hash", "modified_at")
    path = F.when(F.col("path").rlike(r"\.(rs|cfg)$"), F.concat(F.lit("moved/"), F.col("path"))).otherwise(F.col("path"))
    now = files.join(src, files["id"] == src["file_id"]).where("content is not null")
    new = now.select("repository_id", path.alias("path"), F.coalesce("fingerprint", F.concat(F.lit("none:"), F.col("id"))).alias("fingerprint"), F.when(F.col("size_bytes") == F.octet_length("content"), F.col("content_hash")).otherwise(F.sha2("content", 256)).alias("content_hash"), "modified_at")
    return old, new


# scans and filters of files


@query
def a03_size_guard(spark, d):
    return table(spark, d, "file_sources").where(F.char_length("content") <= S.max_file_size).select("file_id", F.char_length("content").alias("n_chars"), F.octet_length("content").alias("n_bytes"))


@query
def a04_language_detect(spark, d):
    return table(spark, d, "files").select("id", "path", T.language_of(F.col("path")).alias("detected"))


@query
def a05_supported_files(spark, d):
    f = table(spark, d, "files").withColumn("detected", T.language_of(F.col("path")))
    return f.where("detected <> 'unknown'").groupBy("repository_id", "detected").agg(F.count("*").alias("files"), F.sum("size_bytes").alias("bytes"))


@query
def a07_commits_of_file(spark, d):
    return lineage.commits_of_files(table(spark, d, "file_commits"), table(spark, d, "commits"))


@query
def a10_fingerprints(spark, d):
    return table(spark, d, "file_sources").select("file_id", F.sha1("content").alias("fingerprint"), F.sha2("content", 256).alias("content_hash"))


@query
def a13_files_of_repository(spark, d):
    return table(spark, d, "files").select("repository_id", "path", "id", "content_hash", "modified_at")


@query
def a14_file_by_path(spark, d):
    """The file at each path that a relation names, in every repository that has one there."""
    paths = table(spark, d, "relations").select(F.col("metadata.target_file").alias("path")).where("path is not null").distinct()
    return table(spark, d, "files").join(paths, "path", "left_semi").groupBy("repository_id", "path").agg(F.min("id").alias("file_id"))


@query
def a15_file_by_fingerprint(spark, d):
    return table(spark, d, "files").where("fingerprint is not null").groupBy("repository_id", "fingerprint").agg(F.min("id").alias("file_id"), F.count("*").alias("files"))


@query
def a16_chunks_of_file(spark, d):
    c = table(spark, d, "chunks").groupBy("file_id").agg(F.count("*").alias("chunks"), F.min("id").alias("first_id"), F.max("id").alias("last_id"))
    return c


@query
def a17_payload_of_targets(spark, d):
    ids = table(spark, d, "relations").select(F.col("target_chunk_id").alias("id")).distinct()
    c, f = table(spark, d, "chunks"), table(spark, d, "files").select(F.col("id").alias("file_id"), "path")
    return c.join(ids, "id", "left_semi").join(f, "file_id").select("id", "path", "content", "skeleton_content", "chunk_type", "language")


# changes of the store


@query
def b03_upsert_files(spark, d):
    files, src = table(spark, d, "files"), table(spark, d, "file_sources")
    new = files.join(src, files["id"] == src["file_id"]).where("content is not null").select(
        F.lit(None).cast("long").alias("id"), "repository_id", "path", T.language_of(F.col("path")).alias("language"), F.octet_length("content").alias("size_bytes"), "fingerprint",
        F.when(F.col("size_bytes") == F.octet_length("content"), F.lit(None)).otherwise(F.sha2("content", 256)).alias("content_hash"), "modified_at", F.lit(None).cast("timestamp_ntz").alias("created_at"), F.col("updated_at"),
    )
    out = store.upsert(files, new, ["repository_id", "path"], keep_old=["content_hash", "modified_at", "fingerprint"])
    return out.select("id", "repository_id", "path", "language", "size_bytes", "content_hash", "modified_at")


@query
def b05_delete_files(spark, d):
    gone = table(spark, d, "file_sources").where("content is null").select("file_id")
    return store.delete(table(spark, d, "files"), gone).select("id", "repository_id", "path")


@query
def b09_delete_relations(spark, d):
    blocks = table(spark, d, "chunks").where("chunk_type = 'block'").select("id")
    return store.delete_relations(table(spark, d, "relations"), blocks).select("id", "source_chunk_id", "target_chunk_id", "relation_type")


@query
def b10_latest_commits(spark, d):
    c = table(spark, d, "commits").select("repository_id", "commit_hash", "id", "author", "message", "commit_time", "created_at")
    return store.latest(c, ["repository_id", "commit_hash"], "created_at", "id")


@query
def b12_latest_links(spark, d):
    c = table(spark, d, "file_commits").select("file_id", "commit_id", "id", "change_type", "created_at")
    return store.latest(c, ["file_id", "commit_id"], "created_at", "id")


@query
def b13_latest_relations(spark, d):
    r = table(spark, d, "relations").select("source_chunk_id", "target_chunk_id", "relation_type", "id", F.col("metadata.symbol").alias("symbol"), "created_at")
    return store.latest(r, ["source_chunk_id", "target_chunk_id", "relation_type"], "created_at", "id")


@query
def b15_cascade_delete(spark, d):
    gone = table(spark, d, "files").where("repository_id = 7").select("id")
    after = store.cascade({n: table(spark, d, n) for n in ("files", "chunks", "file_commits", "relations")}, gone)
    out = None
    for n in ("files", "chunks", "file_commits", "relations"):
        row = after[n].select(F.lit(n).alias("table_name"), "id")
        out = row if out is None else out.unionByName(row)
    return out


# filters of chunks


@query
def c01_filter_repositories(spark, d):
    f = table(spark, d, "files").where(F.col("repository_id").isin(*REPOS)).select(F.col("id").alias("file_id"), "repository_id")
    return table(spark, d, "chunks").select("id", "file_id").join(f, "file_id")


@query
def c02_filter_languages(spark, d):
    return table(spark, d, "chunks").where(F.col("language").isin(*LANGS)).select("id", "language", "chunk_type")


@query
def c03_filter_since(spark, d):
    return table(spark, d, "chunks").where(F.col("created_at") >= F.lit(SINCE).cast("timestamp_ntz")).select("id", "created_at")


@query
def c05_symbol_like(spark, d):
    r = table(spark, d, "relations").select("id", F.col("metadata.symbol").alias("symbol"))
    hit = F.lit(False)
    for t in TERMS:
        hit = hit | F.col("symbol").ilike(f"%{t}%")
    return r.where(hit)


@query
def c06_either_endpoint(spark, d):
    classes = table(spark, d, "chunks").where("chunk_type in ('class_definition', 'class_declaration')").select("id")
    return graph.relations_of(table(spark, d, "relations").select("id", "source_chunk_id", "target_chunk_id", "relation_type"), classes)


@query
def c07_incoming(spark, d):
    classes = table(spark, d, "chunks").where("chunk_type in ('class_definition', 'class_declaration')").select("id")
    return graph.incoming(table(spark, d, "relations").select("id", "source_chunk_id", "target_chunk_id", "relation_type", F.col("metadata.symbol").alias("symbol")), classes)


@query
def c14_path_skeletons(spark, d):
    """Skeletons of the files that a relation starts in; empty where a file has none."""
    paths = table(spark, d, "relations").select(F.col("metadata.source_file").alias("path")).where("path is not null").distinct()
    f = table(spark, d, "files").join(paths, "path", "left_semi")
    parts = overview_parts(table(spark, d, "chunks"), f).where("part = 0")
    return f.join(parts, ["repository_id", "path"], "left").select("repository_id", "path", F.coalesce("skeleton", F.lit("")).alias("skeleton"))


@query
def c08_with_skeleton(spark, d):
    return table(spark, d, "chunks").where("skeleton_content is not null").groupBy("file_id").agg(F.count("*").alias("chunks"), F.sum(F.char_length("skeleton_content")).alias("chars"))


# joins


@query
def d01_search_base(spark, d):
    b = ranking.search_base(table(spark, d, "chunks"), table(spark, d, "files"), table(spark, d, "repositories"))
    return b.select("id", "file_path", "repository", "repository_id", "language", "chunk_type", "start_line", "end_line")


@query
def d04_lineage(spark, d):
    return lineage.chunk_lineage(table(spark, d, "chunks"), table(spark, d, "files"), table(spark, d, "file_commits"), table(spark, d, "commits"))


@query
def g08_ordered_lineage(spark, d):
    out = lineage.ordered_lineage(table(spark, d, "chunks"), table(spark, d, "files"), table(spark, d, "file_commits"), table(spark, d, "commits"))
    return out.select("chunk_id", "commit_hash", "change_type", "place")


def _symbols_by_pattern(spark, d, *kinds):
    """Names of the asked kinds, with the repository that they are of; written once, as both sides of a relation read them."""
    home = table(spark, d, "files").select(F.col("id").alias("file_id"), "repository_id")
    c = table(spark, d, "chunks").select("id", "file_id", "content").join(home, "file_id")
    return materialize(graph.pattern_symbols(c, list(kinds), ["repository_id"]), "symbols")


@query
def d07_call_relations(spark, d):
    c = table(spark, d, "chunks")
    return graph.call_relations(_symbols_by_pattern(spark, d, "call", "function"), c, [*graph.CALLERS, "function_declaration", "method_declaration", "function_item"])


@query
def d08_inheritance_relations(spark, d):
    c = table(spark, d, "chunks")
    return graph.inheritance_relations(_symbols_by_pattern(spark, d, "base", "class"), c, ["class_definition", "class_declaration"])


@query
def d06_import_relations(spark, d):
    c = table(spark, d, "chunks")
    f = table(spark, d, "files").select(F.col("id").alias("file_id"), T.stem(F.col("path")).alias("name"), "repository_id")
    modules = c.select(F.col("id").alias("chunk_id"), "file_id").join(f, "file_id").select("chunk_id", "name", "repository_id")
    syms = materialize(graph.symbols(c).join(modules.select("chunk_id", "repository_id"), "chunk_id"), "symbols")
    return graph.import_relations(syms, modules)


@query
def d09_missing_on_disk(spark, d):
    old, new = _snapshots(spark, d)
    return old.select("repository_id", "path").join(new.select("repository_id", "path"), ["repository_id", "path"], "left_anti")


@query
def d11_batch_top_k(spark, d):
    c = table(spark, d, "chunks").where(V.usable(F.col("embedding"), WIDTH)).select("id", "embedding")
    return ranking.batch_top_k(c.where("id % 100 = 0"), c, 5)


@query
def d12_co_changes(spark, d):
    return lineage.co_changes(table(spark, d, "file_commits"))


@query
def d14_latest_commit(spark, d):
    return lineage.latest_commit(table(spark, d, "file_commits"), table(spark, d, "commits"))


# aggregates


@query
def e01_overview(spark, d):
    return overview_parts(table(spark, d, "chunks"), table(spark, d, "files"))


@query
def e04_counts(spark, d):
    """How many rows each repository has in the tables that a search goes over."""
    f = table(spark, d, "files").select(F.col("id").alias("file_id"), "repository_id")
    n = None
    for name, key in (("files", "id"), ("chunks", "file_id"), ("file_commits", "file_id")):
        one = table(spark, d, name).select(F.col(key).alias("file_id")).join(f, "file_id").groupBy("repository_id").agg(F.count("*").alias("total")).withColumn("table_name", F.lit(name))
        n = one if n is None else n.unionByName(one)
    return n


@query
def g09_ordered_overview(spark, d):
    """Place of each file in the overview of its repository."""
    c = table(spark, d, "chunks").where("skeleton_content is not null").select("file_id").distinct()
    f = table(spark, d, "files").join(c, F.col("id") == F.col("file_id"), "left_semi")
    return f.select("repository_id", "path", F.row_number().over(Window.partitionBy("repository_id").orderBy("path")).alias("place"))


@query
def e03_symbol_index(spark, d):
    return graph.pattern_symbols(table(spark, d, "chunks").select("id", "content")).groupBy("kind", "name").agg(F.countDistinct("chunk_id").alias("chunks"), F.min("chunk_id").alias("first_id"))


@query
def e06_files_per_commit(spark, d):
    fc, c = table(spark, d, "file_commits"), table(spark, d, "commits")
    n = fc.groupBy("commit_id").agg(F.countDistinct("file_id").alias("files_changed"))
    return c.join(n, c["id"] == n["commit_id"], "left").select("id", "commit_hash", F.coalesce("files_changed", F.lit(0)).alias("files_changed"))


@query
def e08_mean_reciprocal_rank(spark, d):
    """How high a chunk of the same file stands among each query chunk's neighbours."""
    top = d11_batch_top_k(spark, d)
    f = table(spark, d, "chunks").select("id", "file_id")
    j = top.join(f, "id").join(f.toDF("query_id", "query_file"), "query_id")
    best = j.groupBy("query_id").agg(F.min(F.when(F.col("file_id") == F.col("query_file"), F.col("rank"))).alias("r"))
    return best.agg(F.count("*").alias("queries"), F.round(F.avg(F.coalesce(1 / F.col("r"), F.lit(0.0))), 6).alias("mrr"))


# top k and ranking


def _query_vector(spark, d) -> list[float]:
    c = table(spark, d, "chunks").where(V.usable(F.col("embedding"), WIDTH))
    row = c.agg(F.min_by("embedding", "id").alias("v")).first()
    return list(row["v"]) if row and row["v"] else [1.0] + [0.0] * (WIDTH - 1)


def _base(spark, d):
    return ranking.search_base(table(spark, d, "chunks"), table(spark, d, "files"), table(spark, d, "repositories"))


@query
def g01_topk_vector(spark, d):
    q = ranking.Query(vector=_query_vector(spark, d), limit=20, lexical_weight=0.0)
    return ranking.top_scored(_base(spark, d), q).select("id", "vector_score", "rank")


@query
def g02_topk_hybrid(spark, d):
    q = ranking.Query(vector=_query_vector(spark, d), text=WORDS[0], limit=20, lexical=True)
    return ranking.top_scored(_base(spark, d), q).select("id", "vector_score", "lexical_score", "score", "rank")


@query
def g03_bm25(spark, d):
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("content"))
    return lexical.bm25(docs, ["parser", "index", "lock"])


@query
def n06_filtered_boosts(spark, d):
    q = ranking.Query(vector=_query_vector(spark, d), limit=25, repositories=REPOS, languages=LANGS, since=SINCE)
    base = _base(spark, d)
    hits = base.join(F.broadcast(ranking.top_scored(base, q)), "id")
    return ranking.boosted(hits, q).select("id", "vector_score", "score", "boost_reason", "repository", "file_path")


@query
def n12_search_chunks(spark, d):
    q = ranking.Query(vector=_query_vector(spark, d), text=WORDS[0], limit=20, lexical=True, reranker=lambda hits, text: [1.0 if text in (c or "") else 0.0 for c in hits["content"]])
    return ranking.search_chunks(_base(spark, d), q).select("id", "score", "rank", "boost_reason", "file_path")


@query
def n13_rerank(spark, d):
    """The whole ranking but for the removal of near copies: first stage, boosts, filters' bonus, rerank."""
    q = ranking.Query(vector=_query_vector(spark, d), text=WORDS[0], limit=40, lexical=True, languages=LANGS, dedup=None, reranker=lambda hits, text: [1.0 if text in (c or "") else 0.0 for c in hits["content"]])
    return ranking.search_chunks(_base(spark, d), q).select("id", F.round("score", 4).alias("score"), "rank", "boost_reason", "file_path")


@query
def n16_search_sections(spark, d):
    """Symbols, hits and neighbours of one query, with the symbols that relations name."""
    q = ranking.Query(vector=_query_vector(spark, d), text=f"{WORDS[0]} usage", limit=10, dedup=None)
    c, f, r = table(spark, d, "chunks"), table(spark, d, "files"), table(spark, d, "relations")
    symbols = r.select(F.col("target_chunk_id").alias("chunk_id"), F.col("metadata.symbol").alias("name")).where("name is not null").distinct().join(c.select(F.col("id").alias("chunk_id"), "file_id"), "chunk_id")
    return ranking.search(_base(spark, d), q, r, c, f, symbols).select("section", "position", "id", "file_path", "score", "boost_reason", "relation_type")


@query
def n15_full_search(spark, d):
    q = ranking.Query(vector=_query_vector(spark, d), text="RUN_UUID lookup", limit=10)
    c, f = table(spark, d, "chunks"), table(spark, d, "files")
    src = table(spark, d, "file_sources")
    names = graph.global_symbols(src.join(f.where("lower(path) like '%.py'").select(F.col("id").alias("file_id")), "file_id", "left_semi"))
    symbols = names.join(c.select(F.col("id").alias("chunk_id"), "file_id"), "file_id")
    out = ranking.search(_base(spark, d), q, table(spark, d, "relations"), c, f, symbols)
    return out.select("section", "position", "id", "file_path", "score", "boost_reason", "relation_type")


@query
def o01_context_pack(spark, d):
    """Hits of one query with how many relations touch them and how many commits their file has."""
    q = ranking.Query(vector=_query_vector(spark, d), limit=S.pack_limit, lexical_weight=0.0)
    hits = materialize(ranking.top_scored(_base(spark, d), q).select("id", "vector_score", "rank"), "hits")  # ``limit`` rows, read four times
    rel = graph.relations_of(table(spark, d, "relations").select("id", "source_chunk_id", "target_chunk_id"), hits.select("id"))
    ends = rel.select(F.explode(F.array_distinct(F.array("source_chunk_id", "target_chunk_id"))).alias("id")).groupBy("id").agg(F.count("*").alias("relations"))
    own = table(spark, d, "chunks").join(F.broadcast(hits.select("id")), "id", "left_semi")
    lin = lineage.chunk_lineage(own, table(spark, d, "files"), table(spark, d, "file_commits"), table(spark, d, "commits")).groupBy("chunk_id").agg(F.count("*").alias("commits"))
    j = hits.join(ends, "id", "left").join(lin, hits["id"] == lin["chunk_id"], "left")
    return j.select("id", "vector_score", "rank", F.coalesce("relations", F.lit(0)).alias("relations"), F.coalesce("commits", F.lit(0)).alias("commits"))


@query
def b16_pack_json(spark, d):
    f = table(spark, d, "files")
    c = table(spark, d, "commits").select(F.col("id").alias("commit_id"), "commit_hash")
    n = table(spark, d, "file_commits").join(c, "commit_id").groupBy("file_id").agg(F.array_sort(F.collect_set("commit_hash")).alias("h"))
    j = f.select("id", "path").join(n, f["id"] == n["file_id"])
    return j.select("id", F.to_json(F.struct(F.col("path").alias("path"), F.col("h").alias("commits"))).alias("json"))


# scalar functions


@query
def i09_iso_times(spark, d):
    return table(spark, d, "commits").select("id", T.iso(F.col("commit_time")).alias("iso"))


@query
def i11_path_parts(spark, d):
    p = F.col("path")
    return table(spark, d, "files").select("id", T.basename(p).alias("base"), T.stem(p).alias("stem"), T.suffix(p).alias("suffix"))


@query
def i15_called_names(spark, d):
    return table(spark, d, "chunks").where("content is not null").select("id", F.explode(T.called_names(F.col("content"))).alias("name"))


@query
def i16_base_names(spark, d):
    return table(spark, d, "chunks").where("content is not null").select("id", F.explode(T.base_names(F.col("content"))).alias("name"))


@query
def i19_query_terms(spark, d):
    m = table(spark, d, "commits").where("message is not null")
    return m.select("id", F.explode(F.array_distinct(T.query_terms(F.col("message")))).alias("term"))


@query
def i20_truncated(spark, d):
    return table(spark, d, "documents").select("doc_id", T.truncate(F.col("text"), 200).alias("short"))


@query
def i21_human_sizes(spark, d):
    return table(spark, d, "files").where("size_bytes >= 0").select("id", T.human_size(F.col("size_bytes") * 977).alias("size"))


@query
def i23_embedding_texts(spark, d):
    return table(spark, d, "chunks").select("id", T.embedding_text(F.col("language"), F.col("metadata.name"), F.col("chunk_type"), F.col("content")).alias("text"))


# snapshots


@query
def j01_snapshot_diff(spark, d):
    old, new = _snapshots(spark, d)
    return lineage.snapshot_diff(old, new, ["repository_id", "path"])


@query
def j03_detect_changes(spark, d):
    old, new = _snapshots(spark, d)
    return lineage.detect_changes(old, new, ["repository_id"])


@query
def h03_path_sets(spark, d):
    old, new = (s.select("repository_id", "path") for s in _snapshots(spark, d))
    return old.subtract(new).withColumn("side", F.lit("old")).unionByName(new.subtract(old).withColumn("side", F.lit("new")))


# graph


@query
def k05_two_hops(spark, d):
    seeds = table(spark, d, "chunks").where("id % 100 = 0").select("id")
    return graph.neighbourhood(table(spark, d, "relations"), seeds, 2)


@query
def k06_impact(spark, d):
    changed = table(spark, d, "chunks").where("chunk_type in ('type_declaration', 'impl_item')").select("id")
    return graph.impacted(table(spark, d, "relations"), changed)


@query
def k07_degrees(spark, d):
    r = table(spark, d, "relations").select("source_chunk_id", "target_chunk_id", "relation_type").distinct()
    ends = r.select(F.col("source_chunk_id").alias("id"), F.lit(1).alias("o"), F.lit(0).alias("i"), "relation_type").unionByName(r.select(F.col("target_chunk_id").alias("id"), F.lit(0).alias("o"), F.lit(1).alias("i"), "relation_type"))
    return ends.groupBy("id", "relation_type").agg(F.sum("o").alias("outgoing"), F.sum("i").alias("incoming"))


# chunking


def _texts(spark, d):
    f, s = table(spark, d, "files"), table(spark, d, "file_sources")
    return s.join(f.select(F.col("id").alias("file_id"), T.language_of(F.col("path")).alias("language")), "file_id")


@query
def l02_structural_chunks(spark, d):
    return chunking.structural_chunks(_texts(spark, d))


@query
def l03_chunkable(spark, d):
    return table(spark, d, "chunks").select("id", chunking.is_chunkable(F.col("chunk_type"), F.lower("language")).alias("chunkable"))


@query
def l04_line_chunks(spark, d):
    c = chunking.line_chunks(table(spark, d, "file_sources"))
    return c.select("file_id", "chunk_no", "start_line", "end_line", "start_byte", "end_byte", F.sha2("content", 256).alias("hash"))


@query
def l05_skeletons(spark, d):
    return chunking.skeletons(table(spark, d, "chunks").select("id", "content", "language")).select("id", "skeleton_content")


@query
def l06_generic_skeletons(spark, d):
    return table(spark, d, "chunks").where("content is not null").select("id", T.generic_skeleton(F.col("content")).alias("skeleton"))


@query
def l10_global_symbols(spark, d):
    return graph.global_symbols(_texts(spark, d).where("language = 'python'"))


@query
def m06_embeddings(spark, d):
    text = T.embedding_text(F.col("language"), F.col("metadata.name"), F.col("chunk_type"), F.col("content"))
    return table(spark, d, "chunks").select("id", embed(text, lambda: offline_backend(WIDTH)).alias("embedding"))


# streaming


@query
def s01_event_activity(spark, d):
    """Events by hour and type, as a stream over the table: the windows that are closed, two hours behind the newest event."""
    schema = table(spark, d, "events").schema
    base = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet*").parquet(f"{d}/")
    out = windowed_activity(base.withColumn("ts", F.col("ts").cast("timestamp")), "ts", ["event_type"], "value")
    return drain(out, "activity").select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "event_type", "events", F.round("total", 4).alias("total"))


@query
def s02_commit_activity(spark, d):
    """Commits and authors by repository and week."""
    c = table(spark, d, "commits").where("commit_time is not null")
    return c.groupBy("repository_id", F.date_trunc("week", "commit_time").alias("week")).agg(F.count("*").alias("commits"), F.countDistinct("author").alias("authors"))
