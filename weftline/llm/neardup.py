"""Problem 1: near-duplicate records, by minima of universal hashes, banding, verification and connected components."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftline.session import materialize, spread

#: A pair of similarity 0.7 shares one of 32 bands of 5 minima with probability 0.997, one of 0.75 with 0.9999.
BANDS, ROWS = 32, 5
#: Members of a bucket that are paired directly; larger buckets go the exact way, by prefixes of rare shingles.
BUCKET = 64
#: Members of its buckets that each member of an oversized one is compared with to find its ball.
LEADERS = 8
WORD = re.compile(r"[a-z0-9_]+")
PRIME = (1 << 61) - 1


def _family(n: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(2024)
    return rng.integers(1, 1 << 63, n, dtype=np.uint64) | np.uint64(1), rng.integers(0, 1 << 63, n, dtype=np.uint64)


class _Words(dict):
    """64-bit hash of each word, kept for a worker's next rows; emptied when it has grown large."""

    def __missing__(self, word: str) -> int:
        import xxhash

        if len(self) > 500_000:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word)
        return h


def shingles(text: str, n: int, least: int, words: dict) -> np.ndarray | None:
    """Sorted distinct 32-bit hashes of the runs of ``n`` tokens; None for a text of fewer than ``least`` tokens."""
    tokens = WORD.findall(text.lower())
    if len(tokens) < max(least, n):
        return None
    h = np.fromiter(map(words.__getitem__, tokens), dtype=np.uint64, count=len(tokens))
    run = np.zeros(len(tokens) - n + 1, dtype=np.uint64)
    for k in range(n):
        run = (run ^ h[k : len(h) - n + 1 + k]) * np.uint64(0x9E3779B97F4A7C15)
        run ^= run >> np.uint64(29)
    return np.unique((run >> np.uint64(32)).astype(np.uint32))


def sketch_rows(n: int, least: int, bands: int, rows: int):
    """A mapInPandas function: (id, set_key, n_shingles, shingles, signature, bands) of each text that counts."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import xxhash

        a, b = _family(bands * rows)
        mix = _family(rows)[0]
        words = _Words()
        for pdf in batches:
            out = []
            for i, text in zip(pdf["id"], pdf["content"]):
                s = shingles(text, n, least, words) if text else None
                if s is None:
                    continue
                # multiply-shift over 64 bits: 2-universal in its upper half; wide sets in slices, so memory stays flat
                low = np.full(bands * rows, np.iinfo(np.uint64).max, dtype=np.uint64)
                for k in range(0, len(s), 4096):
                    low = np.minimum(low, (s[k : k + 4096, None].astype(np.uint64) * a + b).min(axis=0))
                low >>= np.uint64(32)
                band = (low.reshape(bands, rows) * mix).sum(axis=1, dtype=np.uint64)
                band = (band ^ np.arange(bands, dtype=np.uint64)) * np.uint64(0xC2B2AE3D27D4EB4F)
                out.append((i, xxhash.xxh3_128_digest(s.tobytes()), len(s), s.tobytes(), low.astype(np.uint8).tobytes(), band.astype(np.int64)))
            yield pd.DataFrame(out, columns=["id", "set_key", "n_shingles", "shingles", "signature", "bands"])

    return run


SKETCH = "id long, set_key binary, n_shingles int, shingles binary, signature binary, bands array<long>"


def verify_rows(threshold: float):
    """A mapInPandas function: keeps the pairs of at least ``threshold``. First the signatures: the share of equal minima must
    be within four standard deviations of the threshold; then the sets themselves."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            keep, sims = [], []
            for k, (sa, sb, ga, gb) in enumerate(zip(pdf["sa"], pdf["sb"], pdf["ga"], pdf["gb"])):
                x, y = np.frombuffer(ga, np.uint8), np.frombuffer(gb, np.uint8)
                if (x == y).mean() < threshold - 4 * (threshold * (1 - threshold) / len(x)) ** 0.5:
                    continue
                u, v = np.frombuffer(sa, np.uint32), np.frombuffer(sb, np.uint32)
                both = len(np.intersect1d(u, v, assume_unique=True))
                sim = both / (len(u) + len(v) - both)
                if sim >= threshold:
                    keep.append(k)
                    sims.append(sim)
            yield pd.DataFrame({"a": pdf["a"].to_numpy()[keep], "b": pdf["b"].to_numpy()[keep], "similarity": np.array(sims, dtype=np.float64)})

    return run


def prefix_rows(threshold: float):
    """A mapInPandas function: positions of the rarest shingles of a set, of which a pair at the threshold must share one."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            ids, hs = [], []
            for i, s in zip(pdf["id"], pdf["shingles"]):
                u = np.frombuffer(s, np.uint32)
                ids.append(np.full(len(u), i))
                hs.append(u.astype(np.int64))
            if ids:
                yield pd.DataFrame({"id": np.concatenate(ids), "h": np.concatenate(hs)})

    return run


def verified(pairs: DataFrame, sketches: DataFrame, threshold: float) -> DataFrame:
    """(a, b, similarity) of the pairs (a, b) whose sets are at least ``threshold`` alike."""
    side = sketches.select("id", "shingles", "signature")
    both = pairs.join(side.toDF("a", "sa", "ga"), "a").join(side.toDF("b", "sb", "gb"), "b")
    return both.mapInPandas(verify_rows(threshold), "a long, b long, similarity double").dropDuplicates(["a", "b"])


def balls_of(hot: DataFrame, sizes: DataFrame, sketches: DataFrame, threshold: float) -> DataFrame:
    """(id, ball) of members of oversized buckets that lie close around one of them, the nearest of LEADERS least ids of their buckets: within half the distance
    that ``threshold`` allows. One minus Jaccard similarity is a metric, so any two of a ball are at least ``threshold`` alike: a dense cluster of edited copies
    needs LEADERS checks a member, and none of its pairs is formed."""
    lead = hot.join(sizes.select("h", F.col("a").alias("leader")), "h").select("id", "leader").distinct()
    lead = lead.withColumn("n", F.row_number().over(Window.partitionBy("id").orderBy("leader"))).where(F.col("n") <= LEADERS)
    near = materialize(verified(lead.where("id <> leader").select(F.col("leader").alias("a"), F.col("id").alias("b")), sketches, 1 - (1 - threshold) / 2 + 1e-9), "neardup-checks")
    near = materialize(near.groupBy("b").agg(F.max_by("a", F.struct("similarity", -F.col("a"))).alias("a")), "neardup-near")
    own = near.select(F.col("a").alias("id")).distinct().join(near.select(F.col("b").alias("id")), "id", "left_anti").select("id", F.col("id").alias("ball"))
    return near.select(F.col("b").alias("id"), F.col("a").alias("ball")).unionByName(own)


def hot_pairs(hot: DataFrame, sketches: DataFrame, threshold: float, balls: DataFrame) -> DataFrame:
    """Candidates of different balls among the members of oversized buckets, without pairing a bucket: a pair of at least ``threshold`` must share
    a shingle among the rarest ``n - ceil(threshold * n) + 1`` of both, so members meet under those, within the length filter. Shingles that only
    one ball has bring no one together."""
    members = hot.join(sketches.select("id", "n_shingles", "shingles"), "id")
    flat = members.select("id", "shingles").mapInPandas(prefix_rows(threshold), "id long, h long")
    df = flat.groupBy("h").count()
    # the rank of a shingle in its own set, by frequency then hash: a set is bounded by its text, not by the corpus
    ranked = (
        flat.join(df, "h")
        .groupBy("id")
        .agg(F.sort_array(F.collect_list(F.struct("count", "h"))).alias("s"))
        .select("id", F.size("s").alias("n"), F.explode(F.slice("s", F.lit(1), F.size("s") - F.ceil(F.size("s") * F.lit(threshold) - 1e-9).cast("int") + 1)).alias("x"))
        .select("id", "n", F.col("x.h").alias("h"), F.col("x.count").alias("f"))
        .where("f > 1")
    )
    ranked = materialize(ranked.join(balls, "id", "left").withColumn("ball", F.coalesce("ball", "id")), "neardup-prefix")
    several = ranked.groupBy("h").agg(F.min("ball").alias("x"), F.max("ball").alias("y")).where("x < y").select("h")
    ranked = ranked.join(several, "h")
    l, r = ranked.select(F.col("id").alias("a"), F.col("n").alias("na"), "h", F.col("ball").alias("ball_a")), ranked.select(F.col("id").alias("b"), F.col("n").alias("nb"), "h", F.col("ball").alias("ball_b"))
    return l.join(r, "h").where((F.col("a") < F.col("b")) & (F.col("ball_a") != F.col("ball_b")) & (F.least("na", "nb") >= F.greatest("na", "nb") * threshold - 1e-9)).select("a", "b").distinct()


def similar_sets(
    texts: DataFrame, n: int = 5, threshold: float = 0.8, least: int = 5, bands: int = BANDS, rows: int = ROWS, bucket: int = BUCKET
) -> tuple[DataFrame, DataFrame]:
    """(members, links) of a table with id and content.

    members: (id, rep, ball), one row for each text that counts; texts with equal shingle sets share the least id as their representative, and
    representatives of one ball (null for most) are all linked to each other.
    links: (a, b, similarity), a < b, every other pair of representatives of at least ``threshold`` (exact Jaccard similarity of the
    sets) that meets in a band.

    Null contents and texts of fewer than ``least`` tokens do not count; a row that comes again under its id counts once, and rows without an id do not. Further
    columns are ignored. An empty table gives two empty tables.

    Plan: one Python pass writes sketches. A bucket of two needs no join, as its least and greatest id are the pair; only buckets of
    three and more are joined back to their members. Buckets above ``bucket`` members never emit their pairs: see balls_of and hot_pairs.
    """
    cols = spread(texts.select("id", "content").where(F.col("content").isNotNull() & F.col("id").isNotNull()))
    sketches = materialize(cols.mapInPandas(sketch_rows(n, least, bands, rows), SKETCH), "neardup-sketch")
    keys = sketches.groupBy("set_key").agg(F.min("id").alias("rep"), F.count("*").alias("copies"))
    copies = materialize(keys.where("copies > 1"), "neardup-copies")
    members = sketches.select("id", "set_key").join(copies.select("set_key", "rep"), "set_key", "left").select("id", F.coalesce("rep", "id").alias("rep")).distinct()
    members = materialize(members, "neardup-members")
    extra = members.where("id <> rep").select("id")
    flat = sketches.select("id", F.explode("bands").alias("h")).join(extra, "id", "left_anti")
    sizes = materialize(flat.groupBy("h").agg(F.count("*").alias("k"), F.min("id").alias("a"), F.max("id").alias("b")).where("k > 1"), "neardup-buckets")
    twos = sizes.where("k = 2 and a < b").select("a", "b")
    more = sizes.where("k > 2").select("h", "k")
    inside = materialize(flat.join(more, "h").select("h", "id", "k"), "neardup-inside")
    few = inside.where(F.col("k") <= bucket)
    threes = few.select("h", F.col("id").alias("a")).join(few.select("h", F.col("id").alias("b")), "h").where("a < b").select("a", "b")
    pairs = twos.unionByName(threes)
    over = inside.where(F.col("k") > bucket)
    if over.isEmpty():
        members = members.withColumn("ball", F.lit(None).cast("long"))
    else:
        balls = materialize(balls_of(over, sizes, sketches, threshold), "neardup-balls")
        members = materialize(members.join(balls.toDF("rep", "ball"), "rep", "left").select("id", "rep", "ball"), "neardup-members")
        pairs = pairs.join(balls.toDF("a", "ball_a"), "a", "left").join(balls.toDF("b", "ball_b"), "b", "left").where("ball_a is null or ball_b is null or ball_a <> ball_b").select("a", "b")
        pairs = pairs.unionByName(hot_pairs(over.select("id").distinct(), sketches, threshold, balls))
    pairs = materialize(pairs.distinct(), "neardup-pairs")
    return members, materialize(verified(pairs, sketches, threshold), "neardup-links")


def all_pairs(members: DataFrame, links: DataFrame) -> DataFrame:
    """(a, b), a < b: every pair of members, copies among themselves included. Its size is that of the answer."""
    m1, m2 = members.toDF("x", "rep", "ball"), members.toDF("y", "rep2", "ball2")
    copies = members.groupBy("rep").count().where("count > 1").select("rep")
    same = m1.join(copies, "rep").join(m2.join(copies.toDF("rep2"), "rep2"), F.col("rep") == F.col("rep2")).where("x < y").select("x", "y")
    across = links.join(m1, links["a"] == m1["rep"]).join(m2, links["b"] == m2["rep2"]).select("x", "y")
    inside = m1.join(m2, F.col("ball") == F.col("ball2")).where("rep <> rep2 and x < y").select("x", "y")
    return same.unionByName(across).unionByName(inside).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))


def components(links: DataFrame) -> DataFrame:
    """(node, component) of the graph of ``links`` (a, b): the least node of each connected component.

    Alternates large-star (a node's larger neighbours move to its least neighbour) and small-star (the others do) until the
    edges stay the same; each half is one aggregate of minima, combined before the shuffle, and one equi-join. Every round is
    written to the shared folder, so a lost executor costs no earlier round. A graph without edges has no rows.
    """
    edges = materialize(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "cc-edges")
    before = None
    while True:
        now = edges.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0))).first()
        if before is not None and tuple(now) == before:
            break
        before = tuple(now)
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
        edges = materialize(small.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct(), "cc-edges")
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)


def groups(members: DataFrame, links: DataFrame) -> DataFrame:
    """(chunk_id, class_id, group_id, links): one row for each text that counts, with its class of equal sets, the least id of
    its connected component, and the number of other texts it is linked to."""
    size = members.groupBy("rep", "ball").agg(F.count("*").alias("size"))
    balls = size.where("ball is not null").groupBy("ball").agg(F.sum("size").alias("whole"))
    star = size.where("ball <> rep").select(F.least("rep", "ball").alias("a"), F.greatest("rep", "ball").alias("b"))
    ends = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    linked = ends.join(size.select(F.col("rep").alias("b"), F.col("size").alias("other")), "b").groupBy("a").agg(F.sum("other").alias("across"))
    found = components(links.select("a", "b").unionByName(star)).toDF("rep", "component")
    per = size.join(balls, "ball", "left").join(linked.withColumnRenamed("a", "rep"), "rep", "left").join(found, "rep", "left")
    per = per.select("rep", F.coalesce("component", "rep").alias("group_id"), (F.coalesce("whole", "size") - 1 + F.coalesce("across", F.lit(0))).alias("links"))
    return members.join(per, "rep").select(F.col("id").alias("chunk_id"), F.col("rep").alias("class_id"), "group_id", "links")
