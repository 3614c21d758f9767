"""Nearest vectors against brute force."""

import numpy as np

from weftline.llm import neighbours as N

SCHEMA = "id long, embedding array<float>, key string, asks int"


def table(n=600, width=16, seed=0):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((12, width))
    x = centres[rng.integers(0, 12, n)] + 0.6 * rng.standard_normal((n, width))
    x[50:60] = x[40:50] + 0.01 * rng.standard_normal((10, width))
    x[100:112] = x[99]  # copies of one vector, more than a list holds
    return x.astype(np.float32)


def brute(x, ids, k):
    u = x.astype(np.float64) / np.linalg.norm(x.astype(np.float64), axis=1, keepdims=True)
    s = u @ u.T
    np.fill_diagonal(s, -9)
    return {int(ids[i]): [int(ids[j]) for j in np.lexsort((ids, -np.round(s[i], 6)))[:k]] for i in range(len(x))}


def frame(spark, x, extra=()):
    rows = [(k + 1, [float(v) for v in r], "a", 0) for k, r in enumerate(x)] + list(extra)
    return spark.createDataFrame(rows, SCHEMA)


ODD = [(None, [1.0] * 16, None, None), (7001, None, None, None), (7002, [0.0] * 16, None, None), (7003, [1.0] * 8, None, None), (7004, [float("nan")] + [1.0] * 15, None, None), (7005, [None] + [1.0] * 15, None, None)]


def test_recall_against_brute_force_and_odd_rows(spark):
    x = table()
    got = N.nearest(frame(spark, x, [*ODD, (1, [float(v) for v in x[0]], "again", 1)]), k=5, width=16, beam=48, shard=200).collect()
    ids = {r.id for r in got}
    assert ids == set(range(1, 601)) and all(r.nb < 7000 and r.nb != r.id for r in got)
    want = brute(x, np.arange(1, 601), 5)
    lists = {}
    for r in got:
        lists.setdefault(r.id, []).append((r.rank, r.nb))
    assert all(len(v) == 5 for v in lists.values())
    recall = np.mean([len({nb for _, nb in lists[i]} & set(want[i])) / 5 for i in want])
    assert recall >= 0.9


def test_copies_rank_by_id(spark):
    x = table()
    got = {}
    for r in N.nearest(frame(spark, x), k=5, width=16, floor=0.99, shard=200).collect():
        got.setdefault(r.id, {})[r.rank] = r.nb
    assert [got[105][k] for k in range(1, 6)] == [100, 101, 102, 103, 104]
    assert [got[100][k] for k in range(1, 6)] == [101, 102, 103, 104, 106] or [got[100][k] for k in range(1, 6)] == [101, 102, 103, 104, 105]


def test_asking_rows_only(spark):
    x = table()[:300]
    got = N.nearest(frame(spark, x), k=3, asks="id % 100 = 0", width=16, beam=64, shard=100).collect()
    assert {r.id for r in got} == {100, 200, 300}


def recall(lists, want):
    return np.mean([len({r.nb for r in lists[i]} & set(w)) / len(w) for i, w in want.items()])


def by_id(rows):
    out = {}
    for r in rows:
        out.setdefault(r.id, []).append(r)
    return out


def test_recall_of_defaults_over_many_shards(spark):
    """Beam, probes and dimensions as the queries use them, no floor; only the shards are smaller, so that there are 30."""
    rng = np.random.default_rng(1)
    centres = rng.standard_normal((40, 96))
    x = (centres[rng.integers(0, 40, 3000)] + 0.8 * rng.standard_normal((3000, 96))).astype(np.float32)
    want = {i: w for i, w in brute(x, np.arange(1, 3001), 5).items() if i % 100 == 0}
    got = by_id(N.nearest(frame(spark, x), asks="id % 100 = 0", width=96, shard=100).collect())
    assert set(got) == set(want) and recall(got, want) >= 0.95


def test_large_cells_are_refined(spark):
    """Cells above ``split`` are cut by centres of their own, and where these cannot tell rows apart, by hash: all rows still answer."""
    x = table(900)
    want = brute(x, np.arange(1, 901), 5)
    want = {i: w for i, w in want.items() if not 100 <= i <= 113}
    got = by_id(N.nearest(frame(spark, x), width=16, shard=150, split=60).collect())
    assert set(got) == set(range(1, 901)) and all(len(v) == 5 for v in got.values()) and recall(got, want) >= 0.85
    near = np.tile(np.random.default_rng(2).standard_normal(16), (200, 1)).astype(np.float32)
    near[:, 0] += np.arange(200, dtype=np.float32) * 1e-6
    got = by_id(N.nearest(frame(spark, near), width=16, shard=100, split=40).collect())
    assert len(got) == 200 and all(len(v) == 5 for v in got.values())


def test_few_and_no_rows(spark):
    assert N.nearest(frame(spark, table()[:2]), k=5, width=16).count() == 2
    assert N.nearest(spark.createDataFrame([], SCHEMA), k=5, width=16).count() == 0


def on_disk(spark):
    """Bytes of shuffle files and of written steps."""
    from pathlib import Path

    from weftline.session import scratch_dir

    roots = [str(x.getPath()) for x in spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()] + [scratch_dir(spark).removeprefix("file://")]
    return sum(p.stat().st_size for r in roots for p in Path(r).rglob("*") if p.is_file())


def test_disk_follows_the_vectors_where_each_asks_many_shards(spark):
    """Vectors without clusters ask as many shards as they may, so shards are asked by far more rows than they hold: that neither refines
    them nor leaves a copy of the vectors for each shard."""
    x = np.random.default_rng(4).standard_normal((1500, 384)).astype(np.float32)
    df = spark.createDataFrame([(k + 1, [float(v) for v in r], "a", 0) for k, r in enumerate(x)], SCHEMA).localCheckpoint()
    before = on_disk(spark)
    got = by_id(N.nearest(df, shard=100, split=250).collect())
    assert len(got) == 1500
    most = (on_disk(spark) - before) / (1500 * (4 + 2 * 384))
    assert most < 3, most


def test_rounds_give_the_same_rows(spark, monkeypatch):
    x = table()
    found = []
    for at_once in (100, 1):
        monkeypatch.setattr(N, "AT_ONCE", at_once)
        found.append(sorted(map(tuple, N.nearest(frame(spark, x), width=16, shard=60).collect())))
    assert found[0] == found[1] and len({r[0] for r in found[0]}) == 600


def test_asked_cells_stay_few_however_deep():
    """A refined cell is asked in its nearest inner cells, PROBES at most in all, the home first."""
    rng = np.random.default_rng(6)
    low = rng.standard_normal((400, 8)).astype(np.float32)
    centres = N.kmeans(low, 6)
    s = N.Space(np.zeros(8, np.float32), np.eye(8, dtype=np.float32), centres, {c: (6 + 5 * c, N.kmeans(low, 5, seed=c)) for c in range(6)} | {7: (36, low[:3])})
    near = s.cells(low, 4, 0.15)
    assert near.shape == (400, 4) and (near[:, 0] >= 6).all() and not np.isin(near, [*range(6), 7]).any()
    home = N.route(low, centres, 1)[0][:, 0]
    assert all(near[i, 0] in ({*range(6 + 5 * c, 11 + 5 * c)} if c != 0 else {6, 8, 9, 10, 36, 37, 38}) for i, c in enumerate(home))
    assert all(len({*r[r >= 0]}) == (r >= 0).sum() for r in near)
