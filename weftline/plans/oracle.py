"""SQL that must give the same rows as the named queries, over views with the tables' names."""

from __future__ import annotations

from weftline.plans.queries import LANGS, REPOS, SINCE, TERMS, WIDTH, WORDS

_IN = lambda xs: ", ".join(f"'{x}'" if isinstance(x, str) else str(x) for x in xs)

LANGUAGE = """CASE regexp_extract(path, '(\\.[^./]+)$', 1) WHEN '.py' THEN 'python' WHEN '.js' THEN 'javascript' WHEN '.jsx' THEN 'javascript'
 WHEN '.ts' THEN 'typescript' WHEN '.tsx' THEN 'typescript' WHEN '.java' THEN 'java' WHEN '.go' THEN 'go' WHEN '.rs' THEN 'rust' ELSE 'unknown' END"""

SNAPSHOTS = """WITH old AS (SELECT repository_id, path, coalesce(fingerprint, 'none:' || id) AS fingerprint, content_hash, modified_at FROM files),
now AS (SELECT f.*, s.content FROM files f JOIN file_sources s ON s.file_id = f.id WHERE s.content IS NOT NULL),
new AS (SELECT repository_id, CASE WHEN regexp_matches(path, '\\.(rs|cfg)$') THEN 'moved/' || path ELSE path END AS path,
 coalesce(fingerprint, 'none:' || id) AS fingerprint, CASE WHEN size_bytes = strlen(content) THEN content_hash ELSE sha256(content) END AS content_hash, modified_at FROM now)
"""

CALLED = "list_distinct(list_filter(regexp_extract_all(content, '([A-Za-z_][A-Za-z0-9_]*)\\s*\\(', 1), lambda x: x NOT IN ('if', 'while', 'for', 'def', 'class', 'function')))"
DEFINED = "list_distinct(regexp_extract_all(content, '(?:def|function|func|fn)\\s+([A-Za-z_][A-Za-z0-9_]*)', 1))"
CLASSES = "list_distinct(regexp_extract_all(content, '(?:class|struct|interface|trait)\\s+([A-Za-z_][A-Za-z0-9_]*)', 1))"
_STRIP = "regexp_replace({0}, '^\\s+|\\s+$', '', 'g')"
BASES = (
    "list_distinct(list_filter(list_transform(string_split(regexp_extract(content, 'class\\s+\\w+\\s*\\(([^)]*)\\)', 1) || ',' || regexp_extract(content, 'class\\s+\\w+\\s+extends\\s+([A-Za-z_][\\w.]*)', 1), ','), lambda x: "
    + "string_split("
    + _STRIP.format("x")
    + ", '.')[-1]), lambda x: x <> '' AND x <> 'object'))"
)
SYMBOLS = f"""WITH syms AS (
 SELECT id AS chunk_id, 'call' AS kind, unnest({CALLED}) AS name FROM chunks WHERE content IS NOT NULL
 UNION ALL SELECT id, 'function', unnest({DEFINED}) FROM chunks WHERE content IS NOT NULL
 UNION ALL SELECT id, 'class', unnest({CLASSES}) FROM chunks WHERE content IS NOT NULL
 UNION ALL SELECT id, 'base', unnest({BASES}) FROM chunks WHERE content IS NOT NULL),
home AS (SELECT c.id, f.repository_id FROM chunks c JOIN files f ON f.id = c.file_id)
"""

_OK = f"len(embedding) = {WIDTH} AND len(list_filter(embedding, lambda x: x <> 0)) > 0"
_COS = "list_cosine_similarity(embedding::DOUBLE[], (SELECT v FROM qv))"
QV = f"WITH qv AS (SELECT embedding::DOUBLE[] AS v FROM chunks WHERE {_OK} ORDER BY id LIMIT 1), base AS (SELECT c.*, f.repository_id, f.path AS file_path, r.name AS repository FROM chunks c JOIN files f ON f.id = c.file_id JOIN repositories r ON r.id = f.repository_id)"
_TOKENS = "list_filter(string_split_regex(lower({0}), '[^a-z0-9_]+'), lambda x: x <> '')"
_COUNT = lambda col, w: f"len(list_filter({_TOKENS.format(col)}, lambda x: x = '{w}'))"
TOPK = f"""WITH ok AS (SELECT id, file_id, embedding::DOUBLE[] AS e FROM chunks WHERE {_OK}),
pairs AS (SELECT q.id AS query_id, b.id AS id, round(list_cosine_similarity(q.e, b.e), 6) AS score FROM ok q JOIN ok b ON q.id <> b.id WHERE q.id % 100 = 0),
top AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM pairs QUALIFY rank <= 5)
"""

PARTS = "WITH parts AS (SELECT f.repository_id, f.path, c.skeleton_content, row_number() OVER (PARTITION BY c.file_id ORDER BY c.start_line NULLS LAST, c.id) - 1 AS place, ((row_number() OVER (PARTITION BY c.file_id ORDER BY c.start_line NULLS LAST, c.id) - 1) // 1024)::INT AS part FROM chunks c JOIN files f ON f.id = c.file_id WHERE c.skeleton_content IS NOT NULL)"
_EDGES = "SELECT source_chunk_id AS a, target_chunk_id AS b FROM relations UNION SELECT target_chunk_id, source_chunk_id FROM relations"
_BM = ["parser", "index", "lock"]
_ISO = "CASE WHEN microsecond(commit_time) % 1000000 = 0 THEN strftime(commit_time, '%Y-%m-%dT%H:%M:%S') ELSE strftime(commit_time, '%Y-%m-%dT%H:%M:%S.%f') END"


def _bm25() -> str:
    tf = ", ".join(f"{_COUNT('text', w)} AS tf{k}" for k, w in enumerate(sorted(_BM)))
    df = ", ".join(f"sum((tf{k} > 0)::INT) AS df{k}" for k in range(len(_BM)))
    score = " + ".join(f"ln(1 + (n - df{k} + 0.5::DOUBLE) / (df{k} + 0.5::DOUBLE)) * tf{k} * 2.2::DOUBLE / (tf{k} + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * l / avg_l))" for k in range(len(_BM)))
    return f"""WITH per AS (SELECT doc_id AS id, len({_TOKENS.format('text')}) AS l, {tf} FROM documents WHERE text IS NOT NULL),
stats AS (SELECT count(*) AS n, avg(l) AS avg_l, {df} FROM per)
SELECT id, round({score}, 6) AS score FROM per, stats WHERE {score} > 0 AND round({score}, 6) > 0"""


def oracle_sql() -> dict[str, str]:
    return {
        "a03_size_guard": "SELECT file_id, length(content) AS n_chars, strlen(content) AS n_bytes FROM file_sources WHERE length(content) <= 1000000",
        "a04_language_detect": f"SELECT id, path, {LANGUAGE} AS detected FROM files",
        "a05_supported_files": f"SELECT repository_id, detected, count(*) AS files, sum(size_bytes) AS bytes FROM (SELECT *, {LANGUAGE} AS detected FROM files) WHERE detected <> 'unknown' GROUP BY ALL",
        "a07_commits_of_file": """SELECT file_id, commit_hash, change_type, rank FROM (SELECT l.file_id, c.commit_hash, l.change_type,
 row_number() OVER (PARTITION BY l.file_id ORDER BY c.commit_time DESC NULLS LAST, c.id DESC, l.id) AS rank FROM file_commits l JOIN commits c ON c.id = l.commit_id) WHERE rank <= 100""",
        "a10_fingerprints": "SELECT file_id, sha1(content) AS fingerprint, sha256(content) AS content_hash FROM file_sources",
        "a13_files_of_repository": "SELECT repository_id, path, id, content_hash, modified_at FROM files",
        "a15_file_by_fingerprint": "SELECT repository_id, fingerprint, min(id) AS file_id, count(*) AS files FROM files WHERE fingerprint IS NOT NULL GROUP BY ALL",
        "a16_chunks_of_file": "SELECT file_id, count(*) AS chunks, min(id) AS first_id, max(id) AS last_id FROM chunks GROUP BY ALL",
        "a17_payload_of_targets": "SELECT c.id, f.path, c.content, c.skeleton_content, c.chunk_type, c.language FROM chunks c JOIN files f ON f.id = c.file_id WHERE c.id IN (SELECT target_chunk_id FROM relations)",
        "b03_upsert_files": f"""WITH new AS (SELECT f.repository_id, f.path, {LANGUAGE} AS language, strlen(s.content)::INT AS size_bytes, CASE WHEN f.size_bytes = strlen(s.content) THEN NULL ELSE sha256(s.content) END AS content_hash, f.modified_at
 FROM files f JOIN file_sources s ON s.file_id = f.id WHERE s.content IS NOT NULL)
SELECT f.id, f.repository_id, f.path, CASE WHEN n.path IS NULL THEN f.language ELSE n.language END AS language, CASE WHEN n.path IS NULL THEN f.size_bytes ELSE n.size_bytes END AS size_bytes,
 coalesce(n.content_hash, f.content_hash) AS content_hash, coalesce(n.modified_at, f.modified_at) AS modified_at FROM files f LEFT JOIN new n ON n.repository_id = f.repository_id AND n.path = f.path""",
        "b05_delete_files": "SELECT id, repository_id, path FROM files WHERE id NOT IN (SELECT file_id FROM file_sources WHERE content IS NULL)",
        "b09_delete_relations": "WITH b AS (SELECT id FROM chunks WHERE chunk_type = 'block') SELECT id, source_chunk_id, target_chunk_id, relation_type FROM relations WHERE source_chunk_id NOT IN (SELECT id FROM b) AND target_chunk_id NOT IN (SELECT id FROM b)",
        "b10_latest_commits": "SELECT repository_id, commit_hash, id, author, message, commit_time, created_at FROM commits QUALIFY row_number() OVER (PARTITION BY repository_id, commit_hash ORDER BY created_at DESC NULLS LAST, id DESC) = 1",
        "b12_latest_links": "SELECT file_id, commit_id, id, change_type, created_at FROM file_commits QUALIFY row_number() OVER (PARTITION BY file_id, commit_id ORDER BY created_at DESC NULLS LAST, id DESC) = 1",
        "b13_latest_relations": "SELECT source_chunk_id, target_chunk_id, relation_type, id, metadata.symbol AS symbol, created_at FROM relations QUALIFY row_number() OVER (PARTITION BY source_chunk_id, target_chunk_id, relation_type ORDER BY created_at DESC NULLS LAST, id DESC) = 1",
        "b15_cascade_delete": """WITH gf AS (SELECT id FROM files WHERE repository_id = 7), gc AS (SELECT id FROM chunks WHERE file_id IN (SELECT id FROM gf))
SELECT 'files' AS table_name, id FROM files WHERE id NOT IN (SELECT id FROM gf) UNION ALL SELECT 'chunks', id FROM chunks WHERE id NOT IN (SELECT id FROM gc)
UNION ALL SELECT 'file_commits', id FROM file_commits WHERE file_id NOT IN (SELECT id FROM gf)
UNION ALL SELECT 'relations', id FROM relations WHERE source_chunk_id NOT IN (SELECT id FROM gc) AND target_chunk_id NOT IN (SELECT id FROM gc)""",
        "c01_filter_repositories": f"SELECT c.id, c.file_id, f.repository_id FROM chunks c JOIN files f ON f.id = c.file_id WHERE f.repository_id IN ({_IN(REPOS)})",
        "c02_filter_languages": f"SELECT id, language, chunk_type FROM chunks WHERE language IN ({_IN(LANGS)})",
        "c03_filter_since": f"SELECT id, created_at FROM chunks WHERE created_at >= TIMESTAMP '{SINCE}'",
        "c05_symbol_like": "SELECT id, metadata.symbol AS symbol FROM relations WHERE " + " OR ".join(f"metadata.symbol ILIKE '%{t}%'" for t in TERMS),
        "c06_either_endpoint": "WITH k AS (SELECT id FROM chunks WHERE chunk_type IN ('class_definition', 'class_declaration')) SELECT id, source_chunk_id, target_chunk_id, relation_type FROM relations WHERE source_chunk_id IN (SELECT id FROM k) OR target_chunk_id IN (SELECT id FROM k)",
        "c08_with_skeleton": "SELECT file_id, count(*) AS chunks, sum(length(skeleton_content)) AS chars FROM chunks WHERE skeleton_content IS NOT NULL GROUP BY ALL",
        "d01_search_base": "SELECT c.id, f.path AS file_path, r.name AS repository, r.id AS repository_id, c.language, c.chunk_type, c.start_line, c.end_line FROM chunks c JOIN files f ON f.id = c.file_id JOIN repositories r ON r.id = f.repository_id",
        "d04_lineage": f"SELECT c.id AS chunk_id, f.path AS file_path, k.commit_hash, k.author, k.message, {_ISO.replace('commit_time', 'k.commit_time')} AS committed_at, l.change_type FROM chunks c JOIN files f ON f.id = c.file_id JOIN file_commits l ON l.file_id = f.id JOIN commits k ON k.id = l.commit_id",
        "d07_call_relations": SYMBOLS
        + """SELECT DISTINCT u.chunk_id AS source_chunk_id, d.chunk_id AS target_chunk_id, 'calls' AS relation_type, u.name AS symbol FROM syms u JOIN home hu ON hu.id = u.chunk_id JOIN syms d ON d.name = u.name AND d.kind = 'function' JOIN home hd ON hd.id = d.chunk_id AND hd.repository_id = hu.repository_id
WHERE u.kind = 'call' AND u.chunk_id <> d.chunk_id AND u.chunk_id IN (SELECT id FROM chunks WHERE chunk_type IN ('function_definition', 'method_definition', 'decorated_definition', 'function_declaration', 'method_declaration', 'function_item'))""",
        "d08_inheritance_relations": SYMBOLS
        + """SELECT DISTINCT u.chunk_id AS source_chunk_id, d.chunk_id AS target_chunk_id, 'inherits' AS relation_type, u.name AS symbol FROM syms u JOIN home hu ON hu.id = u.chunk_id JOIN syms d ON d.name = u.name AND d.kind = 'class' JOIN home hd ON hd.id = d.chunk_id AND hd.repository_id = hu.repository_id
WHERE u.kind = 'base' AND u.chunk_id <> d.chunk_id AND u.chunk_id IN (SELECT id FROM chunks WHERE chunk_type IN ('class_definition', 'class_declaration'))""",
        "d09_missing_on_disk": SNAPSHOTS + "SELECT repository_id, path FROM old WHERE (repository_id, path) NOT IN (SELECT (repository_id, path) FROM new)",
        "d11_batch_top_k": TOPK + "SELECT query_id, id, score, rank FROM top",
        "d12_co_changes": """WITH l AS (SELECT DISTINCT file_id, commit_id FROM file_commits), p AS (SELECT a.file_id, b.file_id AS other_id, count(*) AS together FROM l a JOIN l b ON a.commit_id = b.commit_id AND a.file_id <> b.file_id GROUP BY ALL)
SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY together DESC, other_id) AS rank FROM p QUALIFY rank <= 10""",
        "d14_latest_commit": "SELECT l.file_id, l.commit_id, c.commit_time FROM file_commits l JOIN commits c ON c.id = l.commit_id QUALIFY row_number() OVER (PARTITION BY l.file_id ORDER BY c.commit_time DESC NULLS LAST, l.commit_id DESC) = 1",
        "e01_overview": f"{PARTS} SELECT repository_id, path, part, string_agg(skeleton_content, chr(10) ORDER BY place) AS skeleton FROM parts GROUP BY ALL",
        "e04_counts": """SELECT repository_id, 'files' AS table_name, count(*) AS total FROM files GROUP BY ALL UNION ALL SELECT f.repository_id, 'chunks', count(*) FROM chunks c JOIN files f ON f.id = c.file_id GROUP BY ALL
UNION ALL SELECT f.repository_id, 'file_commits', count(*) FROM file_commits c JOIN files f ON f.id = c.file_id GROUP BY ALL""",
        "g09_ordered_overview": "SELECT repository_id, path, row_number() OVER (PARTITION BY repository_id ORDER BY path) AS place FROM files WHERE id IN (SELECT file_id FROM chunks WHERE skeleton_content IS NOT NULL)",
        "g08_ordered_lineage": """WITH h AS (SELECT l.file_id, k.commit_hash, l.change_type, row_number() OVER (PARTITION BY l.file_id ORDER BY k.commit_time DESC NULLS FIRST, k.commit_hash, l.id) AS place FROM file_commits l JOIN commits k ON k.id = l.commit_id)
SELECT c.id AS chunk_id, h.commit_hash, h.change_type, h.place FROM chunks c JOIN h ON h.file_id = c.file_id JOIN files f ON f.id = c.file_id""",
        "a14_file_by_path": "SELECT repository_id, path, min(id) AS file_id FROM files WHERE path IN (SELECT metadata.target_file FROM relations WHERE metadata.target_file IS NOT NULL) GROUP BY ALL",
        "c07_incoming": "SELECT id, source_chunk_id, target_chunk_id, relation_type, metadata.symbol AS symbol FROM relations WHERE target_chunk_id IN (SELECT id FROM chunks WHERE chunk_type IN ('class_definition', 'class_declaration'))",
        "c14_path_skeletons": f"""{PARTS}, p AS (SELECT repository_id, path, string_agg(skeleton_content, chr(10) ORDER BY place) AS skeleton FROM parts WHERE part = 0 GROUP BY ALL)
SELECT f.repository_id, f.path, coalesce(p.skeleton, '') AS skeleton FROM files f LEFT JOIN p ON p.repository_id = f.repository_id AND p.path = f.path WHERE f.path IN (SELECT metadata.source_file FROM relations WHERE metadata.source_file IS NOT NULL)""",
        "n13_rerank": f"""{QV}, s AS (SELECT *, round({_COS}, 6) AS vector_score, round(0.1::DOUBLE * coalesce({_COUNT('content', WORDS[0])}, 0), 6) AS lexical_score FROM base WHERE {_OK} AND language IN ({_IN(LANGS)})),
t AS (SELECT *, round(0.7::DOUBLE * vector_score + 0.3::DOUBLE * lexical_score, 6) AS first_score FROM s), h AS (SELECT *, row_number() OVER (ORDER BY first_score DESC, vector_score DESC, id) AS first_rank FROM t QUALIFY first_rank <= 40),
b AS (SELECT *, round(first_score + CASE WHEN metadata.depth = 0 THEN 0.05 ELSE 0 END::DOUBLE + CASE WHEN metadata.recent_edit THEN 0.05 ELSE 0 END::DOUBLE + 0.02::DOUBLE, 6) AS boosted FROM h),
r AS (SELECT *, round(0.6::DOUBLE * boosted + 0.4::DOUBLE * CASE WHEN contains(content, '{WORDS[0]}') THEN 1 ELSE 0 END, 6) AS score FROM b)
SELECT id, round(score, 4) AS score, row_number() OVER (ORDER BY score DESC, first_rank) AS rank, CASE WHEN metadata.recent_edit THEN 'recent_edit' WHEN metadata.depth = 0 THEN 'top_level' END AS boost_reason, file_path FROM r""",
        "n16_search_sections": f"""{QV}, s AS (SELECT *, round({_COS}, 6) AS vector_score FROM base WHERE {_OK}), h AS (SELECT *, row_number() OVER (ORDER BY vector_score DESC, id) AS first_rank FROM s QUALIFY first_rank <= 10),
b AS (SELECT id, file_path, first_rank, round(round(0.7::DOUBLE * vector_score, 6) + CASE WHEN metadata.depth = 0 THEN 0.05 ELSE 0 END::DOUBLE + CASE WHEN metadata.recent_edit THEN 0.05 ELSE 0 END::DOUBLE, 6) AS score, CASE WHEN metadata.recent_edit THEN 'recent_edit' WHEN metadata.depth = 0 THEN 'top_level' END AS boost_reason FROM h),
y AS (SELECT DISTINCT target_chunk_id AS id, metadata.symbol AS name FROM relations WHERE metadata.symbol IS NOT NULL), z AS (SELECT y.id, y.name, f.path FROM y JOIN chunks c ON c.id = y.id JOIN files f ON f.id = c.file_id WHERE contains(lower(y.name), '{WORDS[0]}') OR contains(lower(y.name), 'usage')),
n AS (SELECT DISTINCT e.b AS id FROM ({_EDGES}) e WHERE e.a IN (SELECT id FROM b) AND e.b NOT IN (SELECT id FROM b))
SELECT 0 AS section, -row_number() OVER (ORDER BY name, id) AS position, id, path AS file_path, 1.5::DOUBLE AS score, 'global_symbol' AS boost_reason, NULL::VARCHAR AS relation_type FROM z QUALIFY row_number() OVER (ORDER BY name, id) <= 20
UNION ALL SELECT 1, row_number() OVER (ORDER BY score DESC, first_rank), id, file_path, score, boost_reason, NULL FROM b
UNION ALL SELECT 2, 1, n.id, f.path, NULL, NULL, 'graph_neighbor' FROM n JOIN chunks c ON c.id = n.id JOIN files f ON f.id = c.file_id""",
        "e03_symbol_index": SYMBOLS + "SELECT kind, name, count(DISTINCT chunk_id) AS chunks, min(chunk_id) AS first_id FROM syms GROUP BY ALL",
        "e06_files_per_commit": "SELECT c.id, c.commit_hash, coalesce(n, 0) AS files_changed FROM commits c LEFT JOIN (SELECT commit_id, count(DISTINCT file_id) AS n FROM file_commits GROUP BY ALL) l ON l.commit_id = c.id",
        "e08_mean_reciprocal_rank": TOPK
        + """, best AS (SELECT t.query_id, min(CASE WHEN a.file_id = b.file_id THEN t.rank END) AS r FROM top t JOIN chunks a ON a.id = t.id JOIN chunks b ON b.id = t.query_id GROUP BY ALL)
SELECT count(*) AS queries, round(avg(coalesce(1.0::DOUBLE / r, 0.0)), 6) AS mrr FROM best""",
        "g01_topk_vector": f"{QV}, s AS (SELECT id, round({_COS}, 6) AS vector_score FROM base WHERE {_OK}) SELECT *, row_number() OVER (ORDER BY vector_score DESC, id) AS rank FROM s QUALIFY rank <= 20",
        "g02_topk_hybrid": f"{QV}, s AS (SELECT id, round({_COS}, 6) AS vector_score, round(0.1::DOUBLE * coalesce({_COUNT('content', WORDS[0])}, 0), 6) AS lexical_score FROM base WHERE {_OK}), t AS (SELECT *, round(0.7::DOUBLE * vector_score + 0.3::DOUBLE * lexical_score, 6) AS score FROM s) SELECT *, row_number() OVER (ORDER BY score DESC, vector_score DESC, id) AS rank FROM t QUALIFY rank <= 20",
        "g03_bm25": _bm25(),
        "n06_filtered_boosts": f"""{QV}, s AS (SELECT *, round({_COS}, 6) AS vector_score FROM base WHERE {_OK} AND repository_id IN ({_IN(REPOS)}) AND language IN ({_IN(LANGS)}) AND created_at >= TIMESTAMP '{SINCE}'),
t AS (SELECT * FROM s QUALIFY row_number() OVER (ORDER BY vector_score DESC, id) <= 25)
SELECT id, vector_score, round(round(0.7::DOUBLE * vector_score, 6) + CASE WHEN metadata.depth = 0 THEN 0.05 ELSE 0 END::DOUBLE + CASE WHEN metadata.recent_edit THEN 0.05 ELSE 0 END::DOUBLE + 0.02::DOUBLE
 + CASE WHEN metadata.repository_id IN ({_IN(REPOS)}) THEN 0.02 ELSE 0 END::DOUBLE, 6) AS score, CASE WHEN metadata.recent_edit THEN 'recent_edit' WHEN metadata.depth = 0 THEN 'top_level' END AS boost_reason, repository, file_path FROM t""",
        "o01_context_pack": f"""{QV}, h AS (SELECT id, file_id, round({_COS}, 6) AS vector_score FROM base WHERE {_OK}), t AS (SELECT *, row_number() OVER (ORDER BY vector_score DESC, id) AS rank FROM h QUALIFY rank <= 5)
SELECT id, vector_score, rank, (SELECT count(*) FROM relations r WHERE r.source_chunk_id = t.id OR r.target_chunk_id = t.id) AS relations, (SELECT count(*) FROM file_commits l JOIN commits c ON c.id = l.commit_id WHERE l.file_id = t.file_id) AS commits FROM t""",
        "b16_pack_json": """SELECT f.id, '{"path":"' || f.path || '","commits":[' || string_agg(DISTINCT '"' || c.commit_hash || '"', ',' ORDER BY '"' || c.commit_hash || '"') || ']}' AS json
FROM files f JOIN file_commits l ON l.file_id = f.id JOIN commits c ON c.id = l.commit_id GROUP BY f.id, f.path""",
        "i09_iso_times": f"SELECT id, {_ISO} AS iso FROM commits",
        "i11_path_parts": "SELECT id, regexp_extract(path, '([^/]*)$', 1) AS base, regexp_replace(regexp_extract(path, '([^/]*)$', 1), '(.)\\.[^.]*$', '\\1') AS stem, regexp_extract(path, '(\\.[^./]+)$', 1) AS suffix FROM files",
        "i15_called_names": f"SELECT id, unnest({CALLED}) AS name FROM chunks WHERE content IS NOT NULL",
        "i16_base_names": f"SELECT id, unnest({BASES}) AS name FROM chunks WHERE content IS NOT NULL",
        "i19_query_terms": "SELECT id, unnest(list_distinct(list_filter(list_transform(string_split_regex(message, '\\s+'), lambda w: regexp_replace(w, '^[ ,.:()]+|[ ,.:()]+$', '', 'g')), lambda w: w <> ''))) AS term FROM commits WHERE message IS NOT NULL",
        "i20_truncated": "SELECT doc_id, CASE WHEN length(text) > 200 THEN substring(text, 1, 200) || '...' ELSE text END AS short FROM documents",
        "i21_human_sizes": """WITH s AS (SELECT id, size_bytes * 977 AS n FROM files WHERE size_bytes >= 0), u AS (SELECT id, CASE WHEN n < 1024 THEN n::DOUBLE WHEN n < 1048576 THEN n / 1024.0::DOUBLE WHEN n < 1073741824 THEN n / 1048576.0::DOUBLE ELSE n / 1073741824.0::DOUBLE END AS x,
 CASE WHEN n < 1024 THEN ' B' WHEN n < 1048576 THEN ' KB' WHEN n < 1073741824 THEN ' MB' ELSE ' GB' END AS unit FROM s) SELECT id, printf('%.2f', x) || unit AS size FROM u""",
        "i23_embedding_texts": "SELECT id, concat_ws(chr(10), 'Language: ' || language, 'Name: ' || metadata.name, 'Type: ' || chunk_type, content) AS text FROM chunks",
        "j01_snapshot_diff": SNAPSHOTS
        + """SELECT coalesce(o.repository_id, n.repository_id) AS repository_id, coalesce(o.path, n.path) AS path, CASE WHEN o.path IS NULL THEN 'added' WHEN n.path IS NULL THEN 'deleted'
 WHEN o.content_hash IS NOT DISTINCT FROM n.content_hash AND date_trunc('second', o.modified_at) IS NOT DISTINCT FROM date_trunc('second', n.modified_at) THEN 'unchanged' ELSE 'modified' END AS status
FROM old o FULL JOIN new n ON o.repository_id = n.repository_id AND o.path = n.path""",
        "j03_detect_changes": SNAPSHOTS
        + """, gone AS (SELECT o.* FROM old o ANTI JOIN new n ON o.repository_id = n.repository_id AND o.path = n.path), fresh AS (SELECT n.* FROM new n ANTI JOIN old o ON o.repository_id = n.repository_id AND o.path = n.path),
by_print AS (SELECT repository_id, fingerprint, max(path) AS previous_path FROM gone GROUP BY ALL),
added AS (SELECT f.repository_id, f.path, CASE WHEN b.previous_path IS NULL THEN 'added' ELSE 'renamed' END AS change_type, f.fingerprint, b.previous_path FROM fresh f LEFT JOIN by_print b ON b.repository_id = f.repository_id AND b.fingerprint = f.fingerprint)
SELECT * FROM added
UNION ALL SELECT g.repository_id, g.path, 'deleted', g.fingerprint, NULL FROM gone g ANTI JOIN (SELECT repository_id, previous_path FROM added WHERE previous_path IS NOT NULL) m ON m.repository_id = g.repository_id AND m.previous_path = g.path
UNION ALL SELECT n.repository_id, n.path, 'modified', n.fingerprint, NULL FROM new n JOIN old o ON o.repository_id = n.repository_id AND o.path = n.path WHERE o.fingerprint <> n.fingerprint""",
        "h03_path_sets": SNAPSHOTS + "SELECT *, 'old' AS side FROM (SELECT repository_id, path FROM old EXCEPT SELECT repository_id, path FROM new) UNION ALL SELECT *, 'new' FROM (SELECT repository_id, path FROM new EXCEPT SELECT repository_id, path FROM old)",
        "k05_two_hops": f"""WITH e AS ({_EDGES}), s AS (SELECT id FROM chunks WHERE id % 100 = 0), h1 AS (SELECT DISTINCT b AS id FROM e WHERE a IN (SELECT id FROM s) AND b NOT IN (SELECT id FROM s)),
h2 AS (SELECT DISTINCT b AS id FROM e WHERE a IN (SELECT id FROM h1) AND b NOT IN (SELECT id FROM s) AND b NOT IN (SELECT id FROM h1))
SELECT id, 0 AS hop FROM s UNION ALL SELECT id, 1 FROM h1 UNION ALL SELECT id, 2 FROM h2""",
        "k06_impact": """WITH RECURSIVE r AS (SELECT id FROM chunks WHERE chunk_type IN ('type_declaration', 'impl_item') UNION SELECT e.source_chunk_id FROM relations e JOIN r ON e.target_chunk_id = r.id) SELECT id FROM r""",
        "k07_degrees": """WITH r AS (SELECT DISTINCT source_chunk_id, target_chunk_id, relation_type FROM relations), e AS (SELECT source_chunk_id AS id, 1 AS o, 0 AS i, relation_type FROM r UNION ALL SELECT target_chunk_id, 0, 1, relation_type FROM r)
SELECT id, relation_type, sum(o) AS outgoing, sum(i) AS incoming FROM e GROUP BY ALL""",
        "l03_chunkable": """SELECT id, coalesce(CASE lower(language) WHEN 'python' THEN chunk_type IN ('function_definition', 'class_definition', 'decorated_definition')
 WHEN 'javascript' THEN chunk_type IN ('function_declaration', 'class_declaration', 'method_definition', 'arrow_function')
 WHEN 'typescript' THEN chunk_type IN ('function_declaration', 'class_declaration', 'method_definition', 'arrow_function')
 WHEN 'java' THEN chunk_type IN ('method_declaration', 'constructor_declaration', 'class_declaration') WHEN 'go' THEN chunk_type IN ('function_declaration', 'method_declaration')
 WHEN 'rust' THEN chunk_type IN ('function_item', 'impl_item', 'trait_item', 'struct_item') END, false) AS chunkable FROM chunks""",
        "l04_line_chunks": """WITH l AS (SELECT file_id, string_split(content, chr(10)) AS l FROM file_sources WHERE content IS NOT NULL), p AS (SELECT file_id, l, len(l) AS n, unnest(generate_series(0, len(l) - 1, 7)) AS a0 FROM l),
c AS (SELECT file_id, n, a0, array_to_string(l[a0 + 1 : a0 + 8], chr(10)) AS body, CASE WHEN a0 = 0 THEN 0 ELSE strlen(array_to_string(l[1 : a0], chr(10))) + 1 END AS b FROM p)
SELECT file_id, a0 // 7 AS chunk_no, a0 + 1 AS start_line, least(a0 + 8, n) AS end_line, b AS start_byte, b + strlen(body) AS end_byte, sha256(body) AS hash FROM c""",
        "l06_generic_skeletons": f"""WITH f AS (SELECT id, list_filter(string_split(content, chr(10)), lambda x: {_STRIP.format('x')} <> '') AS l FROM chunks WHERE content IS NOT NULL)
SELECT id, CASE WHEN len(l) = 0 THEN '' WHEN len(l) = 1 THEN {_STRIP.format('l[1]')} ELSE {_STRIP.format('l[1]')} || ' ...' END AS skeleton FROM f""",
        "s01_event_activity": "SELECT date_trunc('hour', ts) AS window_start, event_type, count(*) AS events, round(sum(value), 4) AS total FROM events WHERE date_trunc('hour', ts) + INTERVAL 3 HOUR <= (SELECT max(ts) FROM events) GROUP BY ALL",
        "s02_commit_activity": "SELECT repository_id, date_trunc('week', commit_time)::TIMESTAMP AS week, count(*) AS commits, count(DISTINCT author) AS authors FROM commits WHERE commit_time IS NOT NULL GROUP BY ALL",
    }
