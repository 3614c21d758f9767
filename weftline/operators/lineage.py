"""Snapshots of files and how they differ, and the history of chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftline.functions.text import iso
from weftline.session import materialize


def snapshot_diff(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """key and status of two snapshots with content_hash and modified_at: added, deleted, modified or unchanged.

    Unchanged means an equal hash and a time equal to the second; a null hash or time on one side only is a change."""
    o, n = old.alias("o"), new.alias("n")
    on = [F.col(f"o.{k}") == F.col(f"n.{k}") for k in key]
    sec = lambda c: F.date_trunc("second", c)
    same = F.col("o.content_hash").eqNullSafe(F.col("n.content_hash")) & sec("o.modified_at").eqNullSafe(sec("n.modified_at"))
    status = F.when(F.col(f"o.{key[-1]}").isNull(), "added").when(F.col(f"n.{key[-1]}").isNull(), "deleted").when(same, "unchanged").otherwise("modified")
    return o.join(n, on, "full_outer").select(*[F.coalesce(f"o.{k}", f"n.{k}").alias(k) for k in key], status.alias("status"))


def detect_changes(old: DataFrame, new: DataFrame, scope: list[str] = (), copies_as_renames: bool = False) -> DataFrame:
    """(scope..., path, change_type, fingerprint, previous_path) of two snapshots with path and fingerprint.

    An added path whose fingerprint a vanished path had is renamed from it (the last such path by name); with ``copies_as_renames`` any old
    path counts. Null fingerprints match nothing. A change comes once, however often its path does."""
    scope = list(scope)
    key = [*scope, "path"]
    gone = old.join(new.select(*key), key, "left_anti")
    fresh = new.join(old.select(*key), key, "left_anti")
    pool = old if copies_as_renames else gone
    by_print = pool.where("fingerprint is not null").groupBy(*scope, "fingerprint").agg(F.max("path").alias("previous_path"))
    added = fresh.join(by_print, [*scope, "fingerprint"], "left")
    added = added.select(*key, F.when(F.col("previous_path").isNull(), "added").otherwise("renamed").alias("change_type"), "fingerprint", "previous_path")
    moved = added.where("previous_path is not null").select(*scope, F.col("previous_path").alias("path"))
    deleted = gone.join(moved, key, "left_anti").select(*key, F.lit("deleted").alias("change_type"), "fingerprint", F.lit(None).cast("string").alias("previous_path"))
    o, n = old.select(*key, F.col("fingerprint").alias("was")), new.select(*key, "fingerprint")
    modified = n.join(o, key).where(~F.col("was").eqNullSafe(F.col("fingerprint"))).select(*key, F.lit("modified").alias("change_type"), "fingerprint", F.lit(None).cast("string").alias("previous_path"))
    return added.unionByName(deleted).unionByName(modified).dropDuplicates([*key, "change_type", "previous_path"])


def chunk_lineage(chunks: DataFrame, files: DataFrame, links: DataFrame, commits: DataFrame) -> DataFrame:
    """(chunk_id, file_path, commit_hash, author, message, committed_at, change_type) of every chunk and commit of its file. Payloads
    of chunks take no part."""
    c = chunks.select(F.col("id").alias("chunk_id"), "file_id")
    f = files.select(F.col("id").alias("file_id"), F.col("path").alias("file_path"))
    k = commits.select(F.col("id").alias("commit_id"), "commit_hash", "author", "message", "commit_time")
    hist = links.select("file_id", "commit_id", "change_type").join(k, "commit_id").join(f, "file_id")
    return c.join(hist, "file_id").select("chunk_id", "file_path", "commit_hash", "author", "message", iso(F.col("commit_time")).alias("committed_at"), "change_type")


def ordered_lineage(chunks: DataFrame, files: DataFrame, links: DataFrame, commits: DataFrame) -> DataFrame:
    """``chunk_lineage`` with the place of each commit in the history of its chunk, newest first; unknown times stand before all others, ties go by
    commit hash and change. Places are counted a file, before the history meets the file's chunks, so a file of many chunks counts once."""
    k = commits.select(F.col("id").alias("commit_id"), "commit_hash", "author", "message", "commit_time")
    f = files.select(F.col("id").alias("file_id"), F.col("path").alias("file_path"))
    w = Window.partitionBy("file_id").orderBy(F.desc_nulls_first("commit_time"), "commit_hash", "link_id")
    hist = links.select(F.col("id").alias("link_id"), "file_id", "commit_id", "change_type").join(k, "commit_id").withColumn("place", F.row_number().over(w)).join(f, "file_id")
    c = chunks.select(F.col("id").alias("chunk_id"), "file_id")
    return c.join(hist, "file_id").select("chunk_id", "file_path", "commit_hash", "author", "message", iso(F.col("commit_time")).alias("committed_at"), "change_type", "place")


def latest_commit(links: DataFrame, commits: DataFrame) -> DataFrame:
    """(file_id, commit_id, commit_time): the newest commit of each file; unknown times come last, ties go to the greater id."""
    j = links.join(commits.select(F.col("id").alias("commit_id"), "commit_time"), "commit_id")
    best = F.max_by(F.struct("commit_id", "commit_time"), F.struct(F.col("commit_time").isNotNull().alias("known"), "commit_time", "commit_id"))
    return j.groupBy("file_id").agg(best.alias("b")).select("file_id", "b.commit_id", "b.commit_time")


def co_changes(links: DataFrame, limit: int = 10) -> DataFrame:
    """(file_id, other_id, together, rank): files that changed in the same commits most often, ``limit`` for each file.

    Links are made distinct first. Files that are in exactly the same commits, such as those of a first import, are one class: pairs are formed
    between classes only, and a list takes the ``limit`` + 1 least files of each, as no more can be in it. The classes are found by sums of hashes of their
    commits, so no file's commits are collected."""
    d = links.select("file_id", "commit_id").where("file_id is not null and commit_id is not null").distinct()
    sums = [F.sum(F.xxhash64("commit_id", F.lit(k)).cast("decimal(38,0)")).alias(f"s{k}") for k in (1, 2)]
    keys = materialize(d.groupBy("file_id").agg(F.count("*").alias("n"), *sums), "co-keys")
    same = ["n", "s1", "s2"]
    files = materialize(keys.join(keys.groupBy(*same).agg(F.min("file_id").alias("rep")), same).select("file_id", "rep", "n"), "co-classes")
    reps = d.join(files.where("file_id = rep").select("file_id"), "file_id", "left_semi")
    pairs = reps.join(reps.select("commit_id", F.col("file_id").alias("other")), "commit_id").where("file_id <> other").groupBy("file_id", "other").agg(F.count("*").alias("together"))
    pairs = pairs.unionByName(files.where("file_id = rep").select("file_id", F.col("file_id").alias("other"), F.col("n").alias("together")))
    ranked = lambda df, who, order, most: df.withColumn("rank", F.row_number().over(Window.partitionBy(who).orderBy(*order))).where(F.col("rank") <= most)
    heads = ranked(files.select(F.col("rep").alias("other"), F.col("file_id").alias("other_id")), "other", ["other_id"], limit + 1).drop("rank")
    lists = ranked(pairs.join(heads, "other"), "file_id", [F.desc("together"), "other_id"], limit + 1).select(F.col("file_id").alias("rep"), "other_id", "together")
    out = files.select("file_id", "rep").join(lists, "rep").where("file_id <> other_id").select("file_id", "other_id", "together")
    return ranked(out, "file_id", [F.desc("together"), "other_id"], limit)


def commits_of_files(links: DataFrame, commits: DataFrame, limit: int = 100) -> DataFrame:
    """(file_id, commit_hash, change_type, rank): the ``limit`` newest commits of each file."""
    j = links.join(commits.select(F.col("id").alias("commit_id"), "commit_hash", "commit_time"), "commit_id")
    w = Window.partitionBy("file_id").orderBy(F.desc_nulls_last("commit_time"), F.desc("commit_id"), "id")
    return j.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit).select("file_id", "commit_hash", "change_type", "rank")
