"""The queries of the ten problems, as the driver calls them: (spark, folder of tables) -> DataFrame."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm import credentials, docpairs, handwritten, language, mix, neardup, neighbours, pack, split, validity


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _alike(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return neardup.similar_sets(table(spark, d, "chunks"), n=3, threshold=0.7, least=25)


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return neardup.all_pairs(*_alike(spark, d)).toDF("chunk_id_a", "chunk_id_b")


def p1_groups(spark: SparkSession, d: str) -> DataFrame:
    return neardup.groups(*_alike(spark, d))


def p2_judged(spark: SparkSession, d: str) -> DataFrame:
    return validity.judge_files(table(spark, d, "files"), table(spark, d, "file_sources"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return p2_judged(spark, d).where("not valid").select("file_id").distinct()


def p2_rates(spark: SparkSession, d: str) -> DataFrame:
    return validity.rates(p2_judged(spark, d))


def p3_pairs(spark: SparkSession, d: str) -> DataFrame:
    return docpairs.documented_functions(table(spark, d, "chunks"), table(spark, d, "files"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return p3_pairs(spark, d).select("chunk_id", "func_name")


def p4_pieces(spark: SparkSession, d: str) -> DataFrame:
    return split.split_oversized(table(spark, d, "chunks"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return p4_pieces(spark, d).where((F.col("piece_no") == 0) & (F.col("pieces") > 1)).select("chunk_id")


def p5_redacted(spark: SparkSession, d: str) -> DataFrame:
    return credentials.redact(table(spark, d, "chunks")).select("chunk_id", "content", "skeleton_content", (F.size("content_places") + F.size("skeleton_places")).alias("places"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return credentials.found_lines(credentials.redact(table(spark, d, "chunks"), only_places=True))


def p6_reasons(spark: SparkSession, d: str) -> DataFrame:
    return handwritten.not_handwritten(table(spark, d, "files"), table(spark, d, "file_sources"), table(spark, d, "upstream_files"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    # a file that two repositories share may be the own work of one of them; only what is published elsewhere counts as third-party code
    return p6_reasons(spark, d).where("reason <> 'shared'").select("file_id").distinct()


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return neighbours.similar_pairs(neighbours.nearest(table(spark, d, "chunks"))).toDF("chunk_id_a", "chunk_id_b")


def p7_neighbours(spark: SparkSession, d: str) -> DataFrame:
    return neighbours.nearest(table(spark, d, "chunks"), asks="id % 100 = 0").withColumn("sim", F.round("sim", 4))


def p8_pack(spark: SparkSession, d: str) -> DataFrame:
    return pack.pack_documents(table(spark, d, "documents"))


def p8_fill(spark: SparkSession, d: str) -> DataFrame:
    return pack.fill_report(p8_pack(spark, d))


def p9_mix(spark: SparkSession, d: str) -> DataFrame:
    return mix.mix_sources(table(spark, d, "documents"), table(spark, d, "mix_targets"))[0]


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    return mix.mix_sources(table(spark, d, "documents"), table(spark, d, "mix_targets"))[1]


def p10_labels(spark: SparkSession, d: str) -> DataFrame:
    return language.label_documents(table(spark, d, "documents")).drop("segments")


def p10_segments(spark: SparkSession, d: str) -> DataFrame:
    out = language.label_documents(table(spark, d, "documents"))
    return out.select("doc_id", F.posexplode("segments").alias("segment_no", "s")).select("doc_id", "segment_no", "s.*")


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return language.mislabelled(language.label_documents(table(spark, d, "documents")))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    fs = [p1_found, p1_groups, p2_found, p2_judged, p2_rates, p3_found, p3_pairs, p4_found, p4_pieces, p5_found, p5_redacted, p6_found, p6_reasons, p7_found, p7_neighbours, p8_pack, p8_fill, p9_mix, p9_shares, p10_found, p10_labels, p10_segments]
    return {f.__name__: f for f in fs}


#: Problem 1 by brute force: distinct runs of three tokens, counted for every pair that shares one.
ALIKE = """t AS (SELECT id, regexp_extract_all(lower(content), '[a-z0-9_]+') AS w FROM chunks WHERE content IS NOT NULL),
s AS (SELECT DISTINCT id, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) AS g FROM t WHERE len(w) >= 25),
n AS (SELECT id, count(*) AS n FROM s GROUP BY id), c AS (SELECT a.id AS a, b.id AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.id < b.id GROUP BY ALL),
p AS (SELECT a, b, k = x.n AND k = y.n AS same FROM c JOIN n x ON x.id = a JOIN n y ON y.id = b WHERE k::DOUBLE / (x.n + y.n - k) >= 0.7::DOUBLE)"""


def oracle_sql() -> dict[str, str]:
    return {
        "p1_found": f"WITH {ALIKE} SELECT a AS chunk_id_a, b AS chunk_id_b FROM p",
        "p1_groups": f"""WITH RECURSIVE {ALIKE}, e AS (SELECT a, b FROM p UNION SELECT b, a FROM p), r AS (SELECT id, id AS root FROM n UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.id),
g AS (SELECT id, min(root) AS root FROM r GROUP BY id), d AS (SELECT b AS id, min(a) AS rep FROM p WHERE same GROUP BY b), l AS (SELECT a AS id, count(*) AS links FROM e GROUP BY a)
SELECT g.id AS chunk_id, coalesce(d.rep, g.id) AS class_id, g.root AS group_id, coalesce(l.links, 0) AS links FROM g LEFT JOIN d ON d.id = g.id LEFT JOIN l ON l.id = g.id""",
        "p4_found": "SELECT id AS chunk_id FROM chunks WHERE length(content) > 1024",
    }
