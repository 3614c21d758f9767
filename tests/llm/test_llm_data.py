"""The pN queries over the smallest test tables, whole, against brute force where there is one."""

import ast
import re
import warnings

import numpy as np
import pytest

from weftline.llm.queries import oracle_sql, queries

COLUMNS = {"p1_found": ["chunk_id_a", "chunk_id_b"], "p2_found": ["file_id"], "p3_found": ["chunk_id", "func_name"], "p4_found": ["chunk_id"], "p5_found": ["chunk_id", "field_name", "line_no"], "p6_found": ["file_id"], "p7_found": ["chunk_id_a", "chunk_id_b"], "p10_found": ["doc_id", "lang"]}


@pytest.fixture(scope="module")
def rows(spark, data):
    return lambda name: spark.read.parquet(f"{data}/{name}.parquet").collect()


def run(spark, data, name):
    df = queries()[name](spark, data)
    if name in COLUMNS:
        assert df.columns == COLUMNS[name]
    return df.collect()


def test_p1_equals_brute_force(spark, data, rows):
    sets = {}
    for r in rows("chunks"):
        t = re.findall(r"[a-z0-9_]+", (r.content or "").lower())
        if len(t) >= 25:
            sets[r.id] = set(zip(t, t[1:], t[2:]))
    ids = sorted(sets)
    want = {(a, b) for i, a in enumerate(ids) for b in ids[i + 1 :] if len(sets[a] & sets[b]) >= 0.7 * len(sets[a] | sets[b]) - 1e-12}
    got = [tuple(r) for r in run(spark, data, "p1_found")]
    assert len(got) == len(set(got)) and set(got) == want


def test_p2_python_equals_the_interpreter(spark, data, rows):
    warnings.simplefilter("ignore")
    paths = {r.id: r.path for r in rows("files")}
    want = set()
    for r in rows("file_sources"):
        if r.content is not None and paths[r.file_id].lower().endswith(".py"):
            try:
                ast.parse(r.content.removeprefix("﻿").replace("\r\n", "\n"))
            except SyntaxError:
                want.add(r.file_id)
    got = {r.file_id for r in run(spark, data, "p2_found")}
    assert {i for i in got if paths[i].lower().endswith(".py")} == want


@pytest.mark.parametrize("name", ["p1_found", "p1_groups", "p4_found"])
def test_queries_equal_their_sql(spark, data, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    con.execute(f"create view chunks as select * from '{data}/chunks.parquet'")
    cur = con.execute(oracle_sql()[name])
    at = [x[0] for x in cur.description]
    df = queries()[name](spark, data)
    assert sorted(tuple(r) for r in df.select(*at).collect()) == sorted(cur.fetchall()) and sorted(df.columns) == sorted(at)


def test_p4_equals_lengths(spark, data, rows):
    assert {r.chunk_id for r in run(spark, data, "p4_found")} == {r.id for r in rows("chunks") if r.content and len(r.content) > 1024}
    assert set(oracle_sql()) <= set(queries())


def test_p5_masks_what_it_finds(spark, data, rows):
    found = run(spark, data, "p5_found")
    text = {(r.id, f): r[f] for r in rows("chunks") for f in ("content", "skeleton_content")}
    after = {(r.chunk_id, f): r[f] for r in run(spark, data, "p5_redacted") for f in ("content", "skeleton_content")}
    lines = {(r.chunk_id, r.field_name) for r in found}
    assert found and set(after) == set(text)
    for k, t in text.items():
        assert (after[k] != t) == (k in lines) and (t is None or len(after[k]) == len(t) and after[k].count("\n") == t.count("\n"))


def test_p7_recall(spark, data, rows):
    ok = [r for r in rows("chunks") if r.embedding and len(r.embedding) == 384 and any(r.embedding)]
    ids, x = np.array([r.id for r in ok]), np.array([r.embedding for r in ok], dtype=float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    s = x @ x.T
    np.fill_diagonal(s, -9)
    want = set()
    for k in range(len(ids)):
        for j in np.lexsort((ids, -s[k]))[:5]:
            if s[k, j] >= 0.8:
                want.add((min(ids[k], ids[j]), max(ids[k], ids[j])))
    got = {tuple(r) for r in run(spark, data, "p7_found")}
    assert len(got & want) >= 0.97 * max(1, len(want)) and len(got - want) <= 0.03 * max(1, len(want))


def test_p10_agrees_with_most_labels(spark, data):
    got = [r for r in run(spark, data, "p10_labels") if r.label and r.main_lang]
    assert np.mean([r.label == r.main_lang for r in got]) > 0.85


@pytest.mark.parametrize("name", ["p1_groups", "p2_rates", "p3_found", "p6_found", "p7_neighbours", "p8_fill", "p9_shares", "p10_segments"])
def test_other_queries_run(spark, data, name):
    assert run(spark, data, name)
