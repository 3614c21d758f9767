"""Problem 7: most similar vectors, by robust-pruned directed graphs over shards of the vector space."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftline.session import discard, materialize

WIDTH = 384
#: Vectors that the projection and the centres of the first level are fitted on, at most about; dimensions of the projected space.
SAMPLE, DIMS = 16384, 96
#: Vectors a shard aims at, centres fitted at one time (more come by refining cells), and most rows of a shard that is not refined.
SHARD, CENTROIDS, SPLIT = 2048, 1024, 16384
#: Shards that a vector asks at most, and how much farther than the nearest centre another may be to be asked.
PROBES, SLACK = 4, 0.15
#: Out-degree of the graph, beam while building, distance relaxation of the pruning, beam of a query, queries that walk together.
DEGREE, BUILD_BEAM, ALPHA, BEAM, GROUP = 32, 48, 1.05, 24, 64
#: Sample rows a centre when a cell is refined, rounds after which a cell is cut by hash.
PER_CENTRE, ROUNDS = 16, 4
#: Entries a vector (of one that is indexed in a shard, of one that asks it) that are shuffled at one time, on average.
AT_ONCE = 2


def kmeans(low: np.ndarray, k: int, rounds: int = 10, seed: int = 3) -> np.ndarray:
    k = max(1, min(k, len(low)))
    centres = low[np.random.default_rng(seed).choice(len(low), k, replace=False)]
    for _ in range(rounds):
        own = ((centres**2).sum(axis=1) - 2 * (low @ centres.T)).argmin(axis=1)
        total = np.zeros_like(centres)
        np.add.at(total, own, low)
        count = np.bincount(own, minlength=k)
        centres = np.where(count[:, None] > 0, total / np.maximum(count, 1)[:, None], centres)
    return centres.astype(np.float32)


def route(low: np.ndarray, centres: np.ndarray, probes: int) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centres of each row, the home first, and their distances."""
    d = (low**2).sum(axis=1)[:, None] + (centres**2).sum(axis=1) - 2 * (low @ centres.T)
    k = min(probes, len(centres))
    top = np.argpartition(d, k - 1, axis=1)[:, :k]
    top = np.take_along_axis(top, np.argsort(np.take_along_axis(d, top, axis=1), axis=1, kind="stable"), axis=1)
    dist = np.sqrt(np.maximum(np.take_along_axis(d, top, axis=1), 0))
    return top, dist


@dataclass
class Space:
    """Projection, the centres of the first level, and of each refined cell the number of its first inner cell and their centres."""

    mean: np.ndarray
    axes: np.ndarray
    centres: np.ndarray
    inner: dict[int, tuple[int, np.ndarray]] = field(default_factory=dict)

    def project(self, unit: np.ndarray) -> np.ndarray:
        return (unit - self.mean) @ self.axes

    def cells(self, low: np.ndarray, probes: int, slack: float) -> np.ndarray:
        """The cells of each row, its home first, then those it asks as well, -1 where there are no more; at most ``probes`` however often
        cells are refined: the nearest of those that lie within the slack or are the nearest inner cell of a cell that does."""
        near, dist = route(low, self.centres, probes)
        near = np.where(dist <= (1 + slack) * dist[:, :1] + 1e-6, near, -1)
        while len(cut := np.intersect1d(near, list(self.inner))):
            wide = np.full((len(low), near.shape[1], probes), -1, dtype=np.int64)
            far = np.full(wide.shape, np.inf)
            wide[:, :, 0], far[:, :, 0] = near, dist
            for c in cut.tolist():
                first, centres = self.inner[c]
                row, col = np.nonzero(near == c)
                k, d = route(low[row], centres, probes)
                wide[row, col, : k.shape[1]], far[row, col, : k.shape[1]] = k + first, d
            far[:, :, 1:][far[:, :, 1:] > (1 + slack) * far[:, :1, :1] + 1e-6] = np.inf
            wide, far = wide.reshape(len(low), -1), far.reshape(len(low), -1)
            far[wide < 0] = np.inf
            home = far[:, 0].copy()
            far[:, 0] = -1
            k = np.argsort(far, axis=1, kind="stable")[:, :probes]
            near, dist = np.take_along_axis(wide, k, axis=1), np.take_along_axis(far, k, axis=1)
            near[np.isinf(dist)] = -1
            dist[:, 0] = home
        return near


def usable(width: int) -> str:
    return f"size(embedding) = {width} and not exists(embedding, x -> x is null or isnan(x) or abs(x) = double('infinity')) and exists(embedding, x -> x <> 0)"


def units(batch: pa.RecordBatch, width: int) -> np.ndarray:
    x = np.asarray(batch.column("embedding").flatten(), dtype=np.float32).reshape(-1, width)
    x = x / np.abs(x).max(axis=1, keepdims=True)  # so that squares neither vanish nor overflow
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def pack16(unit: np.ndarray) -> list[bytes]:
    """Each vector as a scale and 16-bit steps: a cosine of two is off by less than 1e-5."""
    scale = np.abs(unit).max(axis=1) / 32767
    steps = np.rint(unit / scale[:, None]).astype(np.int16)
    return [s.tobytes() + v.tobytes() for s, v in zip(scale.astype(np.float32), steps)]


def unpack16(blobs: list[bytes], width: int) -> np.ndarray:
    raw = np.frombuffer(b"".join(blobs), dtype=np.uint8).reshape(-1, 4 + 2 * width)
    steps = np.ascontiguousarray(raw[:, 4:]).view(np.int16).astype(np.float32)
    unit = steps * np.ascontiguousarray(raw[:, :4]).view(np.float32)
    return unit / np.linalg.norm(unit, axis=1, keepdims=True)


def fit_space(sample: np.ndarray, n: int, shard: int = SHARD, dims: int = DIMS, most: int = CENTROIDS) -> Space:
    """Principal axes and k-means centres of a sample; the number of centres follows the number ``n`` of vectors up to ``most``, beyond which
    cells are refined by samples of their own (see ``refine``)."""
    mean = sample.mean(axis=0)
    _, vectors = np.linalg.eigh(np.cov((sample - mean).T))
    axes = np.ascontiguousarray(vectors[:, ::-1][:, : min(dims, sample.shape[1])]).astype(np.float32)
    low = ((sample - mean) @ axes).astype(np.float32)
    return Space(mean.astype(np.float32), axes, kmeans(low, min(most, -(-n // shard))))


def near_order(low: np.ndarray, leaf: int = GROUP) -> np.ndarray:
    """An order in which rows near each other stand together: halves along the widest axis, down to runs of ``leaf``."""
    out, stack = [], [np.arange(len(low))]
    while stack:
        a = stack.pop()
        if len(a) <= leaf:
            out.append(a)
            continue
        x = low[a]
        a = a[np.argsort(x[:, int(x.var(axis=0).argmax())], kind="stable")]
        half = -(-len(a) // (2 * leaf)) * leaf
        half = half if half < len(a) else leaf
        stack += [a[half:], a[:half]]
    return np.concatenate(out)


class Graph:
    """A directed graph over the vectors of a shard, built in doubling batches by greedy search and robust pruning.

    Searches compare full vectors; pruning compares projected ones. Queries that lie near each other walk together: what one of
    them opens is compared with all, as one matrix product."""

    def __init__(self, unit: np.ndarray, low: np.ndarray, degree: int = DEGREE, beam: int = BUILD_BEAM, alpha: float = ALPHA, seed: int = 5):
        self.unit, self.low = np.ascontiguousarray(unit, dtype=np.float32), low
        self.degree, self.alpha = degree, alpha
        n = len(unit)
        self.out = np.full((n, degree), -1, dtype=np.int32)
        self.met, self.opened = np.zeros(n, dtype=bool), np.zeros(n, dtype=bool)
        order = np.random.default_rng(seed).permutation(n)
        self.entries = first = order[: min(n, 128)]
        near = np.argsort(-(self.unit[first] @ self.unit[first].T), axis=1, kind="stable")[:, : beam + 1]
        self.out[first] = self.prune(first, first[near])
        done = len(first)
        while done < n:
            batch = order[done : done + min(max(done, GROUP), 2048)]
            batch = batch[near_order(low[batch])]
            for a in range(0, len(batch), GROUP):
                part = batch[a : a + GROUP]
                self.out[part] = self.prune(part, self.search(self.unit[part], beam)[0])
            self.link_back(batch)
            done += len(batch)

    def prune(self, points: np.ndarray, near: np.ndarray) -> np.ndarray:
        """Up to ``degree`` of the candidates ``near`` (-1: none): the closest first, each removing those that it is nearer to, by
        the relaxed distance, than the point is."""
        x, p = self.low[near], self.low[points]
        sq = (x**2).sum(axis=2)
        ok = (near >= 0) & (near != points[:, None])
        dp = np.where(ok, sq + (p**2).sum(axis=1)[:, None] - 2 * (x @ p[:, :, None])[..., 0], np.inf)
        between = sq[:, :, None] + sq[:, None, :] - 2 * (x @ x.transpose(0, 2, 1))
        between *= self.alpha**2
        out = np.full((len(near), self.degree), -1, dtype=np.int32)
        rows = np.arange(len(near))
        alive = dp.copy()
        for r in range(self.degree):
            k = alive.argmin(axis=1)
            live = np.isfinite(alive[rows, k])
            if not live.any():
                break
            out[live, r] = near[rows, k][live]
            alive[(between[rows, k] <= dp) | (near == near[rows, k][:, None])] = np.inf
        return out

    def link_back(self, batch: np.ndarray) -> None:
        """Edges back from the new neighbours; where a list overflows, old and nearest new edges are pruned together."""
        to = self.out[batch].ravel()
        src, dst = np.repeat(batch, self.degree)[to >= 0], to[to >= 0]
        o = np.lexsort((((self.low[src] - self.low[dst]) ** 2).sum(axis=1), dst))
        src, dst = src[o], dst[o]
        heads, start, count = np.unique(dst, return_index=True, return_counts=True)
        rank = np.arange(len(dst)) - np.repeat(start, count)
        added = np.full((len(heads), self.degree), -1, dtype=np.int32)
        keep = rank < self.degree
        added[np.repeat(np.arange(len(heads)), count)[keep], rank[keep]] = src[keep]
        both = np.concatenate([self.out[heads], added], axis=1)
        room = (both >= 0).sum(axis=1) <= self.degree
        packed = np.take_along_axis(both, np.argsort(both < 0, axis=1, kind="stable"), axis=1)
        self.out[heads[room]] = packed[room, : self.degree]
        full = np.flatnonzero(~room)
        for a in range(0, len(full), 512):
            part = full[a : a + 512]
            self.out[heads[part]] = self.prune(heads[part], both[part])

    def search(self, q: np.ndarray, beam: int, width: int = 4) -> tuple[np.ndarray, np.ndarray]:
        """Beam search of a group of queries: ids and similarities of the ``beam`` best nodes each has met, best first. A round
        opens the ``width`` best unopened nodes of every query's beam; the search ends when all nodes of all beams are open."""
        ids, sim = np.zeros((len(q), 0), dtype=np.int64), np.zeros((len(q), 0), dtype=np.float32)
        new = self.entries
        self.met[new] = True
        seen = [new]
        while len(new):
            ids = np.concatenate([ids, np.broadcast_to(new, (len(q), len(new)))], axis=1)
            sim = np.concatenate([sim, q @ self.unit[new].T], axis=1)
            if ids.shape[1] > beam:
                k = np.argpartition(-sim, beam - 1, axis=1)[:, :beam]
                ids, sim = np.take_along_axis(ids, k, axis=1), np.take_along_axis(sim, k, axis=1)
            new = new[:0]
            while not len(new):
                left = np.where(self.opened[ids], -np.inf, sim)
                w = min(width, left.shape[1])
                k = np.argpartition(-left, w - 1, axis=1)[:, :w]
                go = np.unique(np.take_along_axis(ids, k, axis=1)[np.isfinite(np.take_along_axis(left, k, axis=1))])
                if not len(go):
                    break
                self.opened[go] = True
                out = self.out[go].ravel()
                out = out[out >= 0]
                new = np.unique(out[~self.met[out]])
                self.met[new] = True
                seen.append(new)
        for x in seen:
            self.met[x] = self.opened[x] = False
        o = np.argsort(-sim, axis=1, kind="stable")
        return np.take_along_axis(ids, o, axis=1), np.take_along_axis(sim, o, axis=1)


def search_shard(space, width: int, beam: int, keep: int, floor: float):
    """An applyInPandas function: builds the graph of a shard and searches it for every row that asks."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        empty = pd.DataFrame({"q": np.zeros(0, np.int64), "nb": np.zeros(0, np.int64), "sim": np.zeros(0)})
        pdf = pdf.sort_values(["id", "indexed"], kind="stable").drop_duplicates(["id", "indexed"])
        own, asks = pdf["indexed"].to_numpy(bool), np.flatnonzero(pdf["asks"].to_numpy(bool))
        ids = pdf["id"].to_numpy(np.int64)
        if not own.any() or not len(asks):
            return empty
        unit = unpack16(pdf["v"].tolist(), width)
        low = space.value.project(unit)
        base_ids = ids[own]
        graph = Graph(unit[own], low[own])
        asks = asks[near_order(low[asks])]
        parts = []
        for a in range(0, len(asks), GROUP):
            rows = asks[a : a + GROUP]
            near, sim = graph.search(unit[rows], beam)
            sim, nb = sim.astype(np.float64), base_ids[near]
            sim[nb == ids[rows][:, None]] = -np.inf
            o = np.lexsort((nb, -sim), axis=1)[:, :keep]
            sim, nb = np.take_along_axis(sim, o, axis=1), np.take_along_axis(nb, o, axis=1)
            good = sim >= floor
            parts.append(pd.DataFrame({"q": np.repeat(ids[rows], good.sum(axis=1)), "nb": nb[good], "sim": sim[good]}))
        return pd.concat(parts, ignore_index=True)

    return run


def key_rows(space, width: int, probes: int, slack: float):
    """A mapInArrow function: id, whether it asks, a 128-bit key of the vector's direction, and the cells it would ask, its home first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        s: Space = space.value
        for b in batches:
            if b.num_rows:
                unit = units(b, width)
                keys = [xxhash.xxh3_128_digest(x.tobytes()) for x in unit]
                cells = [[c for c in row if c >= 0] for row in s.cells(s.project(unit), probes, slack).tolist()]
                yield pa.record_batch([b.column("id"), b.column("asks"), pa.array(keys, pa.binary()), pa.array(cells, pa.list_(pa.int64()))], names=["id", "asks", "key", "cells"])

    return run


def packed_rows(width: int):
    """A mapInArrow function: embeddings as 16-bit steps, so that what is joined, written and shuffled is no longer than that."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                yield pa.record_batch([b.column("id"), b.column("asks"), pa.array(pack16(units(b, width)), pa.binary())], names=["id", "asks", "v"])

    return run


def low_of(b: pa.RecordBatch, s: Space, width: int) -> np.ndarray:
    return s.project(unpack16(b.column("v").to_pylist(), width)).astype(np.float32)


def flags(b: pa.RecordBatch) -> np.ndarray:
    return b.column("asks").to_numpy(zero_copy_only=False).astype(bool)


def cell_sizes(space, width: int, probes: int, slack: float):
    """A mapInArrow function: rows at home in a cell and rows that ask it, summed over a batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s: Space = space.value
        for b in batches:
            if b.num_rows:
                near = s.cells(low_of(b, s, width), probes, slack)
                asked = np.where(flags(b)[:, None], near, -1)
                home, asked = (np.unique(x[x >= 0], return_counts=True) for x in (near[:, 0], asked))
                shard = np.concatenate([home[0], asked[0]])
                zero = [np.zeros(len(x[0]), np.int64) for x in (home, asked)]
                yield pa.record_batch([pa.array(shard, pa.int64()), pa.array(np.concatenate([home[1], zero[1]])), pa.array(np.concatenate([zero[0], asked[1]]))], names=["shard", "home", "asked"])

    return run


def sums(df: DataFrame) -> dict[int, tuple[int, int]]:
    """(shard, home, asked) summed by shard, on the driver: a row for about ``SHARD`` vectors."""
    got = df.groupBy("shard").agg(F.sum("home"), F.sum("asked")).toArrow().to_pydict()
    shard, home, asked = got.values()
    return {k: (h, a) for k, h, a in zip(shard, home, asked)}


def sample_cells(space, take: dict[int, int], width: int, probes: int, slack: float):
    """A mapInArrow function: projected vectors at home in the cells of ``take``, one in as many as it says."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s: Space = space.value
        for b in batches:
            if b.num_rows:
                low = low_of(b, s, width)
                home = s.cells(low, probes, slack)[:, 0]
                every = np.array([take.get(c, 0) for c in home.tolist()], dtype=np.uint64)
                row = np.flatnonzero((every > 0) & (mixed(b, 7) % np.maximum(every, np.uint64(1)) == 0))
                yield pa.record_batch([pa.array(home[row], pa.int64()), pa.array([x.tobytes() for x in low[row]], pa.binary())], names=["shard", "low"])

    return run


def fit_cells(large: dict[int, tuple[int, int]]):
    """An applyInPandas function: centres of the sample of a cell."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        cell = int(pdf["shard"].iloc[0])
        low = np.stack([np.frombuffer(x, dtype=np.float32) for x in pdf["low"]])
        return pd.DataFrame({"shard": [cell], "centres": [np.unique(kmeans(low, large[cell][1]), axis=0).tobytes()]})

    return run


def refine(base: DataFrame, space, sizes: dict[int, tuple[int, int]], width: int, shard: int, split: int, probes: int, slack: float) -> tuple[object, dict[int, tuple[int, int]]]:
    """The space with centres inside those cells that are home to more than ``split`` rows of ``base``, and the sizes of its cells.

    Spark fits them on a bounded sample of each cell (at most CENTROIDS of them, PER_CENTRE rows a centre); only projected samples are shuffled
    and no row moves. Inner cells aim at half of ``split``, as vectors of a dense cell have their neighbours in many small ones. Cells that are
    still too large come again, ROUNDS times at most. All centres together, DIMS numbers for about as many vectors, are known to every task."""
    spark = base.sparkSession
    stuck: set[int] = set()
    for _ in range(ROUNDS):
        large = {c: (n, min(CENTROIDS, -(-n // max(shard, split // 2)))) for c, (n, _) in sizes.items() if n > split and c not in stuck}
        if not large:
            break
        take = {c: max(1, n // (k * PER_CENTRE)) for c, (n, k) in large.items()}
        got = base.mapInArrow(sample_cells(space, take, width, probes, slack), "shard long, low binary").groupBy("shard").applyInPandas(fit_cells(large), "shard long, centres binary").toArrow().to_pydict()
        s: Space = space.value
        inner, first = dict(s.inner), len(s.centres) + sum(len(x) for _, x in s.inner.values())
        for c, x in sorted(zip(got["shard"], got["centres"])):
            centres = np.frombuffer(x, dtype=np.float32).reshape(-1, s.axes.shape[1])
            if len(centres) > 1:
                inner[c] = first, centres
                first += len(centres)
        stuck |= large.keys() - inner.keys()
        space = spark.sparkContext.broadcast(Space(s.mean, s.axes, s.centres, inner))
        sizes = sums(base.mapInArrow(cell_sizes(space, width, probes, slack), "shard long, home long, asked long"))
    return space, sizes


def mixed(b: pa.RecordBatch, seed: int) -> np.ndarray:
    """Hashes of the ids."""
    x = b.column("id").to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64) + np.uint64(seed * 0x9E3779B97F4A7C15 % 2**64)
    for shift, by in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(by)
    return x ^ (x >> np.uint64(31))


def shards_of(space: Space, sizes: dict[int, tuple[int, int]], split: int) -> tuple[np.ndarray, int, int]:
    """Of each cell the number of its first shard, the parts that its vectors are cut to by hash and the parts of those that ask it; how many
    shards there are, and how many entries. Every asking row meets every vector of the cell: it is compared in all parts of the vectors, and where
    more than 2 * ``split`` rows ask, the vectors come once for each part of these."""
    n = len(space.centres) + sum(len(x) for _, x in space.inner.values())
    home, asked = np.array([sizes.get(c, (0, 0)) for c in range(n)], dtype=np.int64).T
    p, t = np.maximum(1, -(-home // split)), np.maximum(1, -(-asked // (2 * split)))
    return np.stack([np.cumsum(p * t) - p * t, p, t], axis=1), int((p * t).sum()), int((home * t + asked * p).sum())


def shard_rows(space, plan, width: int, probes: int, slack: float):
    """A mapInArrow function: the shards that a row is indexed in (of its home) or asks, each as 4 * its number, + 2 if it is indexed there, + 1 if it asks there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s: Space = space.value
        first, p, t = plan.value.T.tolist()
        for b in batches:
            if not b.num_rows:
                continue
            near = s.cells(low_of(b, s, width), probes, slack)
            by_p, by_t, asks = mixed(b, 11).tolist(), mixed(b, 13).tolist(), flags(b).tolist()
            out: list[dict[int, int]] = []
            for cells, hp, ht, ask in zip(near.tolist(), by_p, by_t, asks):
                c = cells[0]
                to = {first[c] + hp % p[c] * t[c] + j: 2 for j in range(t[c])}
                for c in cells if ask else ():
                    for j in range(p[c] if c >= 0 else 0):
                        x = first[c] + j * t[c] + ht % t[c]
                        to[x] = to.get(x, 0) | 1
                out.append(to)
            yield pa.record_batch([b.column("id"), pa.array([[4 * x + y for x, y in o.items()] for o in out], pa.list_(pa.int64())), b.column("v")], names=["id", "shards", "v"])

    return run


def nearest(
    chunks: DataFrame, k: int = 5, asks: str = "true", width: int = WIDTH, beam: int = BEAM, probes: int = PROBES, slack: float = SLACK, floor: float = -1.0, shard: int = SHARD, dims: int = DIMS, split: int = SPLIT
) -> DataFrame:
    """(id, nb, sim, rank): the ``k`` most similar other vectors, of similarity ``floor`` at least, of every row for which ``asks`` holds.

    Needs id and embedding; a row that comes again counts once, rows without an id do not. Usable embeddings have ``width`` finite numbers, not all zero; other rows (null, narrower, with
    nulls or NaN) are neither indexed nor answered. Equal directions are one point: its members come out as each other's
    neighbours of similarity 1, on equal similarity by id, and are indexed once, so copies of one vector load no shard. A table with fewer
    than k + 1 usable rows gives shorter lists; an empty table gives no rows.

    Plan: projection and centres from about SAMPLE vectors on the driver; keys and cells of all vectors in one pass; vectors as 16-bit
    steps are shuffled to shards, one graph a shard. A vector is indexed in its nearest shard and asks those whose centres are nearly as near, ``probes`` at most.
    Cells that the counted pass shows to be home to more than ``split`` vectors are refined by samples of their own before, so shards keep their size at any number of vectors.
    Where that comes to more than AT_ONCE entries a vector, vectors and their shards are written once and the shards are searched
    in rounds, of which each frees its shuffle, so disk stays in proportion to the vectors however many shards each asks.
    """
    spark = chunks.sparkSession
    good = chunks.where(F.expr(usable(width)) & F.col("id").isNotNull())
    many = max(1, -(-chunks.count() // SAMPLE))
    sample = good.where(F.expr(f"pmod(xxhash64(id), {many}) = 0")).select("id", "embedding").mapInArrow(sample_rows(width), "v binary").toArrow()
    if not sample.num_rows:  # no id fell into the sample of a small table
        sample = good.limit(SAMPLE).select("id", "embedding").mapInArrow(sample_rows(width), "v binary").toArrow()
    if not sample.num_rows:
        return spark.createDataFrame([], "id long, nb long, sim double, rank int")
    about = sample.num_rows * many
    space = spark.sparkContext.broadcast(fit_space(unpack16(sample.column("v").to_pylist(), width), about, shard, dims))
    # a class of copies asks if one of its members does; its representative stands for it
    ask = F.coalesce(F.expr(asks), F.lit(False))
    asking = good.select("id", "embedding", ask.alias("asks"))
    keys = materialize(asking.mapInArrow(key_rows(space, width, probes, slack), "id long, asks boolean, key binary, cells array<long>").dropDuplicates(["id", "key"]), "nn-keys", free=True)
    one = keys.groupBy("key").agg(F.min("id").alias("rep"), F.count("*").alias("c"), F.min("cells").alias("cells"), F.max("asks").alias("asks"))
    one = materialize(one, "nn-directions", free=True)
    copies = materialize(keys.join(one.where("c > 1").select("key", "rep"), "key").select("id", "rep"), "nn-copies", free=True)
    wanted = good.where(ask).select("id") if asks != "true" else None
    # embeddings are packed before they are joined, as a join shuffles what it can't broadcast
    rest = asking.mapInArrow(packed_rows(width), "id long, asks boolean, v binary").join(copies.where("id <> rep").select("id"), "id", "left_anti")
    if wanted is not None:
        heads_asking = copies.join(wanted, "id", "left_semi").select(F.col("rep").alias("id")).distinct().withColumn("also", F.lit(True))
        rest = rest.join(heads_asking, "id", "left").select("id", F.coalesce("also", "asks").alias("asks"), "v")
    sizes = sums(one.select(F.posexplode("cells").alias("k", "shard"), "asks").select("shard", F.when(F.col("k") == 0, 1).otherwise(0).alias("home"), F.col("asks").cast("int").alias("asked")))
    base = None
    if max(home for home, _ in sizes.values()) > split:
        rest = base = materialize(rest, "nn-base", free=True)
        space, sizes = refine(base, space, sizes, width, shard, split, probes, slack)
    plan, tasks, rows = shards_of(space.value, sizes, split)
    rounds = max(1, -(-rows // (AT_ONCE * max(1, sum(home for home, _ in sizes.values())))))
    rest = rest.mapInArrow(shard_rows(space, spark.sparkContext.broadcast(plan), width, probes, slack), "id long, shards array<long>, v binary")
    if rounds > 1:
        rest = materialize(rest, "nn-rest", free=True)
        if base is not None:
            discard(base)
    placed = rest.select("id", F.explode("shards").alias("s"), "v").select(F.expr("s div 4").alias("shard"), "id", F.expr("s & 2 = 2").alias("indexed"), F.expr("s & 1 = 1").alias("asks"), "v")
    # about a task for each shard, so that none gets many
    tasks = max(spark.sparkContext.defaultParallelism, min(-(-tasks // rounds), 32768))
    search = search_shard(space, width, beam, k + 1, floor)
    found = None
    for r in range(rounds):
        part = placed.where(F.expr(f"shard % {rounds} = {r}")).repartition(tasks, "shard").groupBy("shard").applyInPandas(search, "q long, nb long, sim double")
        part = materialize(part, "nn-found", free=True)
        found = part if found is None else found.unionByName(part)
    # members of a class beyond its k + 1 least ids are in no list
    by_rep = Window.partitionBy("rep").orderBy("id")
    heads = copies.withColumn("n", F.row_number().over(by_rep)).where(F.col("n") <= k + 1).select("rep", F.col("id").alias("member"))
    lists = found.join(heads, F.col("nb") == F.col("rep"), "left").select("q", F.coalesce("member", "nb").alias("nb"), "sim")
    lists = lists.unionByName(heads.select(F.col("rep").alias("q"), F.col("member").alias("nb"), F.lit(1.0).alias("sim")))
    ranked = lambda df, who, least: df.withColumn("rank", F.row_number().over(Window.partitionBy(who).orderBy(F.desc("sim"), "nb"))).where(F.col("rank") <= least)
    lists = ranked(lists, "q", k + 1).drop("rank")
    members = copies if wanted is None else copies.join(wanted, "id", "left_semi")
    of_copies = lists.join(members, F.col("q") == F.col("rep")).where("id <> nb").select("id", "nb", "sim")
    alone = lists.join(copies.select(F.col("id").alias("c")), F.col("q") == F.col("c"), "left_anti").select(F.col("q").alias("id"), "nb", "sim")
    return ranked(of_copies.unionByName(alone), "id", k).where(F.col("sim") >= floor).select("id", "nb", "sim", "rank")


def sample_rows(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                yield pa.record_batch([pa.array(pack16(units(b, width)), pa.binary())], names=["v"])

    return run


def similar_pairs(lists: DataFrame, least: float = 0.8) -> DataFrame:
    """(a, b), a < b: pairs of similarity ``least`` or more of which one is in the other's list."""
    return lists.where(F.col("sim") >= least).select(F.least("id", "nb").alias("a"), F.greatest("id", "nb").alias("b")).distinct()
