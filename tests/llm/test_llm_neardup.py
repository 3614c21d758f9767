"""Near duplicates against brute force, the way of oversized buckets, components, and odd tables."""

import random

from pyspark.sql import functions as F

from weftline.llm import neardup as N

SCHEMA = "id long, content string, rep string, bands int, h string"


def corpus(seed=1, groups=12):
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(400)]
    rows, i = [], 0
    for _ in range(groups):
        base = [rng.choice(words) for _ in range(60)]
        for k in range(rng.randint(1, 5)):
            t = list(base)
            for _ in range(k * 2):
                t[rng.randrange(len(t))] = rng.choice(words)
            i += 1
            rows.append((i, " ".join(t), "x", 1, "y"))
    rows += [(900, rows[0][1], None, None, None), (901, rows[0][1].upper(), None, None, None), (902, None, None, None, None), (903, "", None, None, None), (904, "few words", None, None, None), (None, rows[0][1], None, None, None), (900, rows[0][1], None, None, None)]
    return rows


def brute(rows, n=3, least=25, threshold=0.7):
    sets = {}
    for i, t, *_ in rows:
        toks = N.WORD.findall((t or "").lower())
        if i is not None and len(toks) >= least:
            sets[i] = {tuple(toks[k : k + n]) for k in range(len(toks) - n + 1)}
    out = set()
    for a in sets:
        for b in sets:
            if a < b and len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b]) - 1e-9:
                out.add((a, b))
    return out


def pairs_of(df):
    return [(r.a, r.b) for r in df.collect()]


def test_pairs_equal_brute_force(spark):
    rows = corpus()
    members, links = N.similar_sets(spark.createDataFrame(rows, SCHEMA), n=3, threshold=0.7, least=25)
    got = pairs_of(N.all_pairs(members, links))
    assert len(got) == len(set(got))
    assert set(got) == brute(rows)


def test_oversized_buckets_lose_nothing(spark):
    rows = corpus(seed=3, groups=8)
    df = spark.createDataFrame(rows, SCHEMA)
    members, links = N.similar_sets(df, n=3, threshold=0.7, least=25, bucket=1)  # every shared bucket of three goes the exact way
    assert set(pairs_of(N.all_pairs(members, links))) == brute(rows)


def test_one_boilerplate_in_all_texts(spark):
    shared = " ".join(f"s{k}" for k in range(50))
    rows = [(k, shared + f" tail{k} tail{k}b tail{k}c", None, None, None) for k in range(90)]
    members, links = N.similar_sets(spark.createDataFrame(rows, SCHEMA), n=3, threshold=0.7, least=25, bucket=8)
    assert set(pairs_of(N.all_pairs(members, links))) == {(a, b) for a in range(90) for b in range(a + 1, 90)}


def test_groups_hold_links_and_components(spark):
    rows = corpus()
    members, links = N.similar_sets(spark.createDataFrame(rows, SCHEMA), n=3, threshold=0.7, least=25)
    want = brute(rows)
    parent = {r.id: r.id for r in members.collect()}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in want:
        ra, rb = root(a), root(b)
        parent[max(ra, rb)] = min(ra, rb)
    got = {r.chunk_id: (r.group_id, r.links) for r in N.groups(members, links).collect()}
    for i in parent:
        assert got[i] == (root(i), sum(i in p for p in want))


def test_dense_clusters_form_no_pairs(spark):
    """Two clusters of lightly edited copies, some halfway: links of a ball are implied, all others verified, and the counts are those of brute force."""
    rng = random.Random(6)
    base = [f"w{rng.randrange(500)}" for _ in range(120)]
    rows = []
    for k in range(150):
        t = list(base)
        for _ in range(rng.choice([1, 1, 1, 2, 9, 14])):
            t[rng.randrange(len(t))] = f"x{rng.randrange(9999)}"
        rows.append((k, " ".join(t), None, None, None))
    rows += [(200 + k, rows[k][1], None, None, None) for k in range(5)]
    want = brute(rows)
    members, links = N.similar_sets(spark.createDataFrame(rows, SCHEMA), n=3, threshold=0.7, least=25, bucket=8)
    got = pairs_of(N.all_pairs(members, links))
    assert len(got) == len(set(got)) and set(got) == want
    assert links.count() < 0.8 * len(want)
    counts = {r.chunk_id: r.links for r in N.groups(members, links).collect()}
    assert counts == {i: sum(i in p for p in want) for i, *_ in rows}


def test_long_chain_is_one_component(spark):
    chain = spark.range(1, 200).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    got = N.components(chain).collect()
    assert {r.component for r in got} == {1} and len(got) == 200


def test_empty_table(spark):
    members, links = N.similar_sets(spark.createDataFrame([], SCHEMA))
    assert N.all_pairs(members, links).count() == 0 and N.groups(members, links).count() == 0
