"""The engine as one object: index, update, search, overview, context packs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftline.config import Settings
from weftline.functions.text import embedding_text, stem
from weftline.operators import chunking, graph, lineage, ranking, store
from weftline.operators.embedding import Backend, embed, offline_backend
from weftline.schemas import conform, empty, key
from weftline.session import materialize
from weftline.sources.tables import exists


class Engine:
    """Holds the tables of a store as DataFrames; changes give new states, ``save`` writes them."""

    NAMES = ["repositories", "files", "chunks", "commits", "file_commits", "relations", "global_symbols"]

    def __init__(self, spark: SparkSession, settings: Settings = Settings(), load_backend: Callable[[], Backend] | None = None):
        self.spark, self.settings = spark, settings
        dim = settings.embedding_dimension
        self.load_backend = load_backend or (lambda: offline_backend(dim))
        self.tables: dict[str, DataFrame] = {n: empty(spark, n) for n in self.NAMES}

    @classmethod
    def open(cls, spark: SparkSession, folder: str, **kw) -> Engine:
        e = cls(spark, **kw)
        for n in cls.NAMES:  # a table that is not there is empty; one that cannot be read is an error
            if exists(spark, f"{folder}/{n}.parquet"):
                e.tables[n] = conform(spark.read.parquet(f"{folder}/{n}.parquet"), n)
        return e

    def save(self, folder: str) -> None:
        for n, df in self.tables.items():
            materialize(df, n).write.mode("overwrite").parquet(f"{folder}/{n}.parquet")

    def index(self, repository: str, sources: DataFrame, commits: DataFrame | None = None) -> DataFrame:
        """Take a repository's files (path, language, content, content_hash, fingerprint, modified_at, size_bytes) into the store.

        Files that are gone leave with all that hangs on them. A file that moved (another path, the same fingerprint) keeps its id, chunks and
        commits. Changed files keep their id and commits and are cut, embedded and related anew, unchanged ones are skipped. Returns
        (path, status, previous_path)."""
        t, spark = self.tables, self.spark
        rid = self.repository_id(repository)
        repo = conform(spark.range(1).select(F.lit(rid).alias("id"), F.lit(repository).alias("url"), F.lit(repository.rstrip("/").rsplit("/", 1)[-1]).alias("name"), F.lit(repository).alias("local_path")), "repositories")
        t["repositories"] = store.upsert(t["repositories"], repo, ["url"])
        status = self._take(rid, t["files"].where(F.col("repository_id") == rid), sources)
        if commits is not None:
            self.add_commits(rid, commits)
        self._settle()
        return status

    def update(self, repository: str, sources: DataFrame, changes: DataFrame) -> dict[str, DataFrame]:
        """Index only what changed between two states: ``changes`` (path, previous_path) as ``lineage.detect_changes`` gives them, ``sources`` the
        files of the new state, of which only the changed ones are read.

        Gives ``status`` of the changed paths, ``impacted`` (id): the chunks that hang on changed ones, before or after, over any number of steps,
        and ``files`` (id): the changed files. Relations are found anew, so those of impacted chunks are up to date."""
        t, rid = self.tables, self.repository_id(repository)
        paths = materialize(changes.select("path").unionByName(changes.select(F.col("previous_path").alias("path"))).where("path is not null").distinct(), "changed")
        old = t["files"].where(F.col("repository_id") == rid).join(paths, "path", "left_semi").select(*t["files"].columns)
        was = materialize(t["chunks"].join(old.select(F.col("id").alias("file_id")), "file_id", "left_semi").select("id"), "was")
        before = graph.impacted(t["relations"], was)
        status = self._take(rid, old, sources.join(paths, "path", "left_semi"))
        self._settle()
        files = self.tables["files"].where(F.col("repository_id") == rid).join(paths, "path", "left_semi").select("id")
        now = self.tables["chunks"].join(files.select(F.col("id").alias("file_id")), "file_id", "left_semi").select("id")
        after = graph.impacted(self.tables["relations"], now)
        impacted = before.unionByName(after).distinct().join(self.tables["chunks"].select("id"), "id", "left_semi")
        return {"status": status, "impacted": materialize(impacted, "impacted"), "files": files}

    def repository_id(self, repository: str) -> int:
        return self.spark.range(1).select(F.xxhash64(F.lit(repository))).first()[0]

    def _take(self, rid: int, old: DataFrame, sources: DataFrame) -> DataFrame:
        """Bring ``old`` files of a repository to the state of ``sources``."""
        t = self.tables
        changes = lineage.detect_changes(old, sources.select("path", "fingerprint"))
        # of several copies of a file that is gone, one is the file itself
        moved = changes.where("change_type = 'renamed'").groupBy("previous_path").agg(F.min("path").alias("new_path"))
        moved = materialize(old.select("id", F.col("path").alias("previous_path")).join(moved, "previous_path"), "moved")
        files = store.rename(t["files"], moved)
        mine = store.rename(old, moved)
        diff = lineage.snapshot_diff(mine, sources, ["path"]).join(moved.select(F.col("new_path").alias("path"), "previous_path"), "path", "left")
        diff = materialize(diff.select("path", F.when(F.col("previous_path").isNotNull(), "renamed").otherwise(F.col("status")).alias("status"), "previous_path"), "status")
        at = lambda *kinds: mine.join(diff.where(F.col("status").isin(*kinds)).select("path"), "path", "left_semi").select("id")
        gone, changed = materialize(at("deleted"), "gone"), materialize(at("modified"), "changed-files")
        after = store.cascade({**t, "files": files}, gone)
        inside = store.cascade(after, changed)
        t.update({**inside, "files": after["files"], "file_commits": after["file_commits"]})
        text = sources.join(diff.where("status in ('added', 'modified')").select("path"), "path", "left_semi").withColumn("repository_id", F.lit(rid))
        # a new file at the old path of a moved one cannot have the id that went with that
        known = after["files"].where(F.col("repository_id") == rid).select("path", F.col("id").alias("own"))
        taken = after["files"].select(F.col("id").alias("taken"))
        fresh = text.join(known, "path", "left").withColumn("first", key("repository_id", "path"))
        fresh = fresh.join(taken, F.col("first") == F.col("taken"), "left").withColumn("id", F.coalesce("own", F.when(F.col("taken").isNull(), F.col("first")).otherwise(key("repository_id", "path", "content_hash"))))
        text = materialize(fresh.drop("own", "first", "taken").withColumn("created_at", F.current_timestamp()).withColumn("updated_at", F.current_timestamp()), "texts")
        t["files"] = store.upsert(after["files"], conform(text, "files"), ["repository_id", "path"])
        body = text.select(F.col("id").alias("file_id"), "content", "language")
        new = chunking.chunk_files(body, self.settings).join(body.select("file_id", "language"), "file_id")
        new = chunking.skeletons(new).withColumn("id", key("file_id", "start_line", "end_line", "content")).withColumn("created_at", F.current_timestamp())
        meta = F.struct(F.col("chunk_type").alias("node_type"), F.col("depth"), F.col("chunk_no").alias("chunk_id"), F.col("total_lines"), F.col("name"), F.lit(None).cast("boolean").alias("recent_edit"), F.lit(rid).alias("repository_id"))
        new = new.withColumn("metadata", meta).withColumn("embedding", embed(embedding_text(F.col("language"), F.col("name"), F.col("chunk_type"), F.col("content")), self.load_backend, self.settings.embedding_batch))
        t["chunks"] = materialize(t["chunks"].unionByName(conform(new.dropDuplicates(["id"]), "chunks")), "chunks")
        names = graph.global_symbols(body.where("language = 'python'")).join(text.select(F.col("id").alias("file_id"), F.col("path").alias("file_path")), "file_id")
        sym = names.join(t["chunks"].select(F.col("id").alias("chunk_id"), "file_id"), "file_id").withColumn("id", key("chunk_id", "name"))
        t["global_symbols"] = t["global_symbols"].unionByName(conform(sym, "global_symbols"))
        return diff

    def _settle(self) -> None:
        """Relations anew, and all tables written: else plans grow from run to run."""
        t = self.tables
        for n in ("repositories", "files", "commits", "file_commits", "global_symbols"):
            t[n] = materialize(t[n], n)
        self.relate()

    def relate(self) -> None:
        """Relations anew over all chunks, across the files of each repository."""
        t = self.tables
        c = t["chunks"]
        stems = t["files"].select(F.col("id").alias("file_id"), stem(F.col("path")).alias("name"), F.col("path"), "repository_id")
        modules = materialize(c.select(F.col("id").alias("chunk_id"), "file_id").join(stems, "file_id"), "modules")
        syms = materialize(graph.symbols(c).join(modules.select("chunk_id", "repository_id"), "chunk_id"), "symbols")
        edges = graph.import_relations(syms, modules.select("chunk_id", "name", "repository_id")).unionByName(graph.call_relations(syms, c)).unionByName(graph.inheritance_relations(syms, c))
        at = modules.select("chunk_id", "path")
        edges = edges.join(at.toDF("source_chunk_id", "source_file"), "source_chunk_id").join(at.toDF("target_chunk_id", "target_file"), "target_chunk_id")
        edges = edges.withColumn("metadata", F.struct("symbol", "source_file", "target_file")).withColumn("id", key("source_chunk_id", "target_chunk_id", "relation_type"))
        t["relations"] = materialize(conform(edges.dropDuplicates(["id"]), "relations"), "relations")

    def add_commits(self, rid: int, commits: DataFrame) -> None:
        """Commits (as the git source gives them) and their links to files."""
        t = self.tables
        c = commits.withColumn("repository_id", F.lit(rid)).withColumn("id", key("repository_id", "commit_hash"))
        t["commits"] = store.upsert(t["commits"], conform(c, "commits"), ["repository_id", "commit_hash"])
        links = c.select(F.col("id").alias("commit_id"), F.explode("files_changed").alias("x")).select("commit_id", "x.path", "x.change_type")
        f = t["files"].where(F.col("repository_id") == rid).select(F.col("id").alias("file_id"), "path")
        links = links.join(f, "path").withColumn("id", key("file_id", "commit_id")).dropDuplicates(["id"])
        t["file_commits"] = store.upsert(t["file_commits"], conform(links, "file_commits"), ["file_id", "commit_id"])

    def query_vector(self, text: str) -> list[float]:
        return [float(x) for x in self.load_backend()([text])[0]]

    def base(self) -> DataFrame:
        return ranking.search_base(self.tables["chunks"], self.tables["files"], self.tables["repositories"])

    def search(self, text: str, **options) -> DataFrame:
        q = ranking.Query(vector=self.query_vector(text), text=text, **{"limit": self.settings.search_limit, **options})
        t = self.tables
        return ranking.search(self.base(), q, t["relations"], t["chunks"], t["files"], t["global_symbols"], self.settings)

    def context_pack(self, text: str, relations: bool = True, history: bool = True, **options) -> dict[str, DataFrame]:
        """The hits with their relations and history; empty tables for parts that are switched off."""
        hits = materialize(self.search(text, **{"limit": self.settings.pack_limit, **options}), "pack")
        t, ids = self.tables, hits.select("id").where("id is not null").distinct()
        rel = graph.relations_of(t["relations"], ids) if relations else t["relations"].limit(0)
        own = t["chunks"].join(ids, "id", "left_semi")
        lin = lineage.chunk_lineage(own, t["files"], t["file_commits"], t["commits"])
        return {"chunks": hits, "relations": rel, "lineage": lin if history else lin.limit(0)}

    def overview(self, repository: str | None = None) -> DataFrame:
        """(path, skeleton): skeletons of each file's chunks in order of lines."""
        t = self.tables
        f = t["files"] if repository is None else t["files"].join(t["repositories"].where(F.col("url") == repository).select(F.col("id").alias("repository_id")), "repository_id", "left_semi")
        return overview(t["chunks"], f)

    def skeleton(self, repository: str, path: str) -> DataFrame:
        """(path, skeleton) of one file; no row if it has none."""
        return self.overview(repository).where(F.col("path") == path).select("path", "skeleton")


#: Skeletons that one row of an overview joins at most; a file with more of them has several rows, in order.
PART = 1024


def overview_parts(chunks: DataFrame, files: DataFrame, part: int = PART) -> DataFrame:
    """(repository_id, path, part, skeleton) of the files that have a chunk with a skeleton, in order of line and id: ``part`` of a file counts from
    0 and joins at most that many skeletons, so a file with very many chunks is no single row. Places are counted by a window that holds no
    texts."""
    c = chunks.where("skeleton_content is not null").select("file_id", "start_line", "id", "skeleton_content")
    place = F.row_number().over(Window.partitionBy("file_id").orderBy(F.asc_nulls_last("start_line"), "id")) - 1
    places = c.select("id", "file_id", "start_line").withColumn("place", place).select("id", "place")
    j = c.join(places, "id").join(files.select(F.col("id").alias("file_id"), "repository_id", "path"), "file_id")
    parts = F.sort_array(F.collect_list(F.struct("place", "skeleton_content")))
    j = j.groupBy("repository_id", "path", F.floor(F.col("place") / part).cast("int").alias("part"))
    return j.agg(F.array_join(F.transform(parts, lambda x: x.skeleton_content), "\n").alias("skeleton"))


def overview(chunks: DataFrame, files: DataFrame) -> DataFrame:
    """(repository_id, path, skeleton): a row for each file that has a skeleton, the parts of ``overview_parts`` joined in order."""
    parts = F.sort_array(F.collect_list(F.struct("part", "skeleton")))
    return overview_parts(chunks, files).groupBy("repository_id", "path").agg(F.array_join(F.transform(parts, lambda x: x.skeleton), "\n").alias("skeleton"))
