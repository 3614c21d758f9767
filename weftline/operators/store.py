"""Changes of the store as joins: each returns the table's next state, which the caller writes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def latest(df: DataFrame, key: list[str], *order: str) -> DataFrame:
    """One row for each key, the greatest by ``order``. An aggregate with partial maxima, so a hot key shuffles little."""
    rest = [c for c in df.columns if c not in key]
    best = F.max_by(F.struct(*rest), F.struct(*[F.struct(F.col(c).isNotNull().alias("known"), F.col(c)) for c in order])).alias("row")
    return df.groupBy(*key).agg(best).select(*key, "row.*").select(*df.columns)


def upsert(old: DataFrame, new: DataFrame, key: list[str], keep_old: list[str] = ()) -> DataFrame:
    """``old`` with the rows of ``new``, which win by key; a null in one of ``keep_old`` keeps the old value. Both need one row a key.

    The old row's id stays, so references to it hold."""
    o, n = old.alias("o"), new.alias("n")
    on = [F.col(f"o.{k}") == F.col(f"n.{k}") for k in key]
    has = F.coalesce(*[F.col(f"n.{k}") for k in key]).isNotNull()
    cols = []
    for c in old.columns:
        if c in key or c in keep_old:
            cols.append(F.coalesce(f"n.{c}", f"o.{c}").alias(c))
        elif c in ("id", "created_at"):
            cols.append(F.coalesce(f"o.{c}", f"n.{c}").alias(c))
        else:
            cols.append(F.when(has, F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")).alias(c))
    return o.join(n, on, "full_outer").select(*cols)


def delete(df: DataFrame, ids: DataFrame, column: str = "id") -> DataFrame:
    """Rows whose ``column`` is not among the first column of ``ids``; a null stays."""
    gone = ids.select(F.col(ids.columns[0]).alias("__gone")).distinct()
    return df.join(gone, df[column] == gone["__gone"], "left_anti")


def delete_relations(relations: DataFrame, chunk_ids: DataFrame) -> DataFrame:
    """Without relations that touch one of the chunks at either end."""
    return delete(delete(relations, chunk_ids, "source_chunk_id"), chunk_ids, "target_chunk_id")


def cascade(tables: dict[str, DataFrame], file_ids: DataFrame) -> dict[str, DataFrame]:
    """All tables after the files are deleted: their chunks, commit links and symbols go, then relations of those chunks."""
    f = file_ids.select(F.col(file_ids.columns[0]).alias("file_id")).distinct()
    chunks = tables["chunks"].join(f, "file_id", "left_semi").select("id")
    out = dict(tables)
    out["files"] = delete(tables["files"], f)
    out["chunks"] = delete(tables["chunks"], f, "file_id")
    out["file_commits"] = delete(tables["file_commits"], f, "file_id")
    out["relations"] = delete_relations(tables["relations"], chunks)
    if "global_symbols" in tables:
        out["global_symbols"] = delete(tables["global_symbols"], f, "file_id")
    return out


def rename(files: DataFrame, moves: DataFrame) -> DataFrame:
    """Files with new paths from ``moves`` (id, new_path)."""
    m = moves.select(F.col("id").alias("__id"), "new_path")
    return files.join(m, files["id"] == m["__id"], "left").withColumn("path", F.coalesce("new_path", "path")).select(*files.columns)


def save(df: DataFrame, path: str, by: str | None = None) -> None:
    """Overwrite a table of the store, whole or only the partitions that ``df`` has."""
    w = df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    (w.partitionBy(by) if by else w).parquet(path)


def ranked(df: DataFrame, by: list[str], *order) -> DataFrame:
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order)))
