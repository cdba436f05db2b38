"""Greedy welds in tiles. A tile's task welds its points in the weld's order and tells what holds whatever lies beyond its
halo; what it cannot tell goes on to other, larger tiles."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from massif.plans.shared import shuffle_width, stash

BUCKET = 20_000  # points that a task gets in the mean
SHIFT = (0.0, 0.5, 0.25, 0.75)  # of a tile's side, by round
LEAF = 8  # positions in a leaf of a tree


def finite(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows that can be near others, and those whose position is null or not finite, which weld with none."""
    ok = F.lit(True)
    for a in "xyz":
        ok = ok & F.coalesce(F.abs(a) < float("inf"), F.lit(False))
    return df.filter(ok), df.filter(~ok)


def dealt(df: DataFrame, side: float, halo: float, shift: float, rows: int) -> DataFrame:
    """Rows with tile (tx, ty, tz), once for each tile whose halo holds them, in as many tasks as `rows` ask for. A bucket has
    several tiles where they are many, and there are more buckets than tasks, so that full tiles seldom meet in one."""
    for a in "xyz":
        reach = halo * (1 + 1e-9) + F.abs(a) * 1e-15
        lo, hi = (F.floor((e - shift) / side).cast("long") for e in (F.col(a) - reach, F.col(a) + reach))
        df = df.withColumn(f"t{a}", F.explode(F.sequence(lo, hi)))
    n = max(4 * shuffle_width(df.sparkSession), rows // BUCKET)
    return df.withColumn("bucket", F.pmod(F.xxhash64("tx", "ty", "tz"), F.lit(16 * n)).cast("int")).repartition(n, "bucket")


def placed(pdf: pd.DataFrame, side: float, halo: float, shift: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Positions, tiles numbered from 0, whether the tile itself holds the point, and how far it is from the halo's end."""
    at, tile = pdf[["x", "y", "z"]].to_numpy(np.float64), pdf[["tx", "ty", "tz"]].to_numpy(np.int64)
    own = (np.floor((at - shift) / side).astype(np.int64) == tile).all(axis=1)
    low = tile * side + shift
    slack = np.abs(at).max(axis=1, initial=0) * 1e-14 + np.abs(low).max(axis=1, initial=0) * 1e-14
    inside = np.minimum(at - low, low + side - at).min(axis=1, initial=np.inf) + halo - slack
    return at, np.unique(tile, axis=0, return_inverse=True)[1].reshape(-1), own, inside


def sizes(eps: float, turn: int, first: float, halo: float) -> tuple[float, float, float]:
    """Side, halo and shift of the tiles of a round: the first two are of one size, later ones double."""
    scale = eps * 2.0 ** max(0, turn - 1)
    return first * scale, halo * scale, SHIFT[turn % len(SHIFT)] * first * scale


# Nearest first: groups of at most one point of each source


def near_pairs(qa: np.ndarray, qt: np.ndarray, ta: np.ndarray, tt: np.ndarray, r: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(query, target, d2) of the points of one tile within r, in parts, by a grid of cells of side r in each tile."""
    if not len(qa) or not len(ta):
        return
    tiles = int(max(qt.max(), tt.max())) + 1
    low = np.full((tiles, 3), np.inf)
    for a, t in ((qa, qt), (ta, tt)):
        np.minimum.at(low, t, a)
    size = r * (1 + 1e-9)
    qc, tc = (np.floor((a - low[t]) / size).astype(np.int64) + 1 for a, t in ((qa, qt), (ta, tt)))
    d = int(max(qc.max(), tc.max())) + 3
    key = lambda t, c, dx=0, dy=0, dz=0: ((t * d + c[:, 0] + dx) * d + c[:, 1] + dy) * d + c[:, 2] + dz
    order = np.argsort(keys := key(tt, tc), kind="stable")
    keys = keys[order]
    for dx in (-1, 0, 1):
        for dy in (-1, 0, 1):
            lo, hi = np.searchsorted(keys, key(qt, qc, dx, dy, -1)), np.searchsorted(keys, key(qt, qc, dx, dy, 1), "right")
            n = hi - lo
            ends = np.cumsum(n)
            start = 0
            while start < len(n):
                stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + 2_000_000, "right")))
                m = n[start:stop]
                q = np.repeat(np.arange(start, stop), m)
                t = order[np.arange(len(q)) - np.repeat(np.cumsum(m) - m, m) + np.repeat(lo[start:stop], m)]
                e = qa[q] - ta[t]
                d2 = e[:, 0] * e[:, 0] + e[:, 1] * e[:, 1] + e[:, 2] * e[:, 2]
                keep = d2 <= r * r
                yield q[keep], t[keep], d2[keep]
                start = stop


def bits_of(source: np.ndarray) -> np.ndarray:
    """A bit for each source."""
    codes, _ = pd.factorize(source, use_na_sentinel=False)
    return 1 << codes.astype(np.int64) if codes.max(initial=0) < 62 else np.array([1 << int(c) for c in codes], dtype=object)


def compatible_pairs(at: np.ndarray, tile: np.ndarray, mask: np.ndarray, r: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(p, q, d2) of the points of one tile within r whose groups share no source. Of few kinds of groups, each looks only
    among those that it can go with: where most points wait for the same source, pairs don't grow with their density."""
    kinds, kind = np.unique(mask, return_inverse=True)
    found = []
    if len(kinds) <= 64:
        for k, m in enumerate(kinds):
            q, t = np.flatnonzero(kind == k), np.flatnonzero(((kinds & m) == 0)[kind] & (kind > k))
            found += [(q[i], t[j], d2) for i, j, d2 in near_pairs(at[q], tile[q], at[t], tile[t], r)]
    else:
        for i, j, d2 in near_pairs(at, tile, at, tile, r):
            keep = (i < j) & ((mask[i] & mask[j]) == 0)
            found.append((i[keep], j[keep], d2[keep]))
    if not found:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
    return tuple(np.concatenate(c) for c in zip(*found, strict=True))


def multipartite_tiles(side: float, halo: float, shift: float, r: float) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """Points (id, source, x, y, z, gid, size) of a bucket with their groups after all pairs within r: `label`, and `done` if
    no pair that the tile doesn't hold can change them.

    A group is in doubt from the distance on at which a member may have a pair beyond the halo, or once it met, within r, a
    group in doubt that it could go with. Two that are in no doubt are joined for certain; two whose known sources meet are
    certainly not."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        at, tile, own, inside = placed(pdf, side, halo, shift)
        ids, bit = pdf["id"].to_numpy(), bits_of(pdf["source"].to_numpy())
        group = pd.MultiIndex.from_arrays([tile, pdf["gid"].to_numpy()]).factorize()[0]
        n = int(group.max()) + 1
        mask = np.zeros(n, bit.dtype)
        np.bitwise_or.at(mask, group, bit)
        sure = np.full(n, np.inf)  # squared distance up to which all pairs of a group are seen
        np.minimum.at(sure, group, np.where(inside > 0, inside * inside, -1.0))
        size = np.zeros(n, np.int64)
        size[group] = pdf["size"].to_numpy()
        sure[np.bincount(group, minlength=n) < size] = -1.0  # members beyond the halo
        p, q, d2 = compatible_pairs(at, tile, mask[group], r)
        p, q = np.where(ids[p] < ids[q], p, q), np.where(ids[p] < ids[q], q, p)
        order = np.lexsort((ids[q], ids[p], d2))
        root, members, mask, sure = list(range(n)), [[g] for g in range(n)], mask.tolist(), sure.tolist()
        doubt = [False] * n
        for d, a, b in zip(d2[order].tolist(), group[p[order]].tolist(), group[q[order]].tolist(), strict=True):
            a, b = root[a], root[b]
            if a == b or mask[a] & mask[b]:
                continue
            if doubt[a] or doubt[b] or d > sure[a] or d > sure[b]:
                doubt[a] = doubt[b] = True
                continue
            mask[a] |= mask[b]
            sure[a] = min(sure[a], sure[b])
            members[a] += members[b]
            for g in members[b]:
                root[g] = a
        whole = np.array([not x and r * r <= s for x, s in zip(doubt, sure, strict=True)])
        of = np.array(root)[group]
        label = np.full(n, np.iinfo(np.int64).max)
        np.minimum.at(label, of, pdf["gid"].to_numpy())
        told = np.zeros(n, bool)
        told[of[own]] = True
        out = pdf[["id", "source", "x", "y", "z"]].assign(label=label[of], done=whole[of])
        return out[told[of]]

    return run


def copies_first(points: DataFrame) -> DataFrame:
    """Points with their group `gid` after the pairs at distance 0: of one position, the k-th of each source go together."""
    zero = [(F.col(a) + 0.0).alias(f"p{a}") for a in "xyz"]
    k = F.row_number().over(Window.partitionBy("px", "py", "pz", "source").orderBy("id"))
    d = points.select("*", *zero).withColumn("k", k)
    w = Window.partitionBy("px", "py", "pz", "k")
    return d.select("id", "source", "x", "y", "z", F.min("id").over(w).alias("gid"), F.count(F.lit(1)).over(w).alias("size"))


def multipartite_round(groups: DataFrame, rows: int, r: float, turn: int) -> DataFrame:
    """Points with their groups after a round, and `done` of groups that no pair within r can change any more."""
    how = sizes(r, turn, 12.0, 3.0)
    told = dealt(groups, *how, rows * 3).groupBy("bucket").applyInPandas(multipartite_tiles(*how, r), _TOLD.format(dict(groups.dtypes)["source"]))
    told = told.groupBy("id").agg(*[F.first(c).alias(c) for c in ("source", "x", "y", "z")], F.min("label").alias("label"), F.max("done").alias("done"))
    w = Window.partitionBy("label")
    return told.select("id", "source", "x", "y", "z", F.min("id").over(w).alias("gid"), F.count(F.lit(1)).over(w).alias("size"), F.max("done").over(w).alias("done"))


def multipartite(points: DataFrame, eps: float) -> DataFrame:
    """(id, merged): see merge.weld_multipartite. Pairs are taken in stages of growing distance. The first is such that a
    point has about eight within it; whoever is in a group of all sources goes no further, so pairs grow with the points and
    not with their density. A stage goes on, in larger tiles, with those groups that a tile could not tell for certain."""
    points, lone = finite(points.select("id", "source", "x", "y", "z"))
    state = stash(copies_first(points), "weld-copies")
    near = state.groupBy(*[F.floor(F.col(a) / eps).alias(a) for a in "xyz"]).agg(F.count(F.lit(1)).alias("n"))
    rows, pairs = near.agg(F.sum("n"), F.sum(F.col("n") * F.col("n") * 4.19)).first()
    kinds = state.select("source").distinct().count()
    r = min(eps, eps * (8 * rows / pairs) ** (1 / 3)) if rows else eps
    steps = math.ceil(math.log2(eps / r)) if r < eps else 0
    kept, waiting = lone.select("id", F.col("id").alias("merged")), state
    for step in range(steps, -1, -1):
        r = eps / 2**step
        kept = kept.union(waiting.filter(F.col("size") >= kinds).select("id", F.col("gid").alias("merged")))
        rest, waiting, turn = stash(waiting.filter(F.col("size") < kinds), "weld-waiting"), None, 0
        while rows := rest.count():
            told = stash(multipartite_round(rest, rows, r, turn), "weld-told")
            done = told.filter("done").drop("done")
            rest, waiting, turn = told.filter("not done").drop("done"), done if waiting is None else waiting.union(done), turn + 1
        if waiting is None:
            return kept
    return kept.union(waiting.select("id", F.col("gid").alias("merged")))


_TOLD = "id long, source {}, x double, y double, z double, label long, done boolean"


# In the order of ids: a point takes the nearest that is free of every other source


class Tree:
    """A k-d tree over positions of one source, of which points are taken away. Points of one position are a queue in the
    order of ids: first those whose state is in doubt, then those that are free; only its heads ever go."""

    def __init__(self, at: np.ndarray, points: np.ndarray):
        """`points` are the rows of `at` that it holds, in the order of ids."""
        spots, spot = np.unique(at[points] + 0.0, axis=0, return_inverse=True)
        spot = spot.reshape(-1)
        order = np.argsort(spot, kind="stable")
        self.queue = points[order].tolist()
        ends = np.cumsum(np.bincount(spot, minlength=len(spots)))
        self.end = ends.tolist()
        self.doubt = (ends - np.bincount(spot, minlength=len(spots))).tolist()  # heads of the points in doubt, and of the free
        self.free = list(self.doubt)
        self.spot = dict(zip(points.tolist(), spot.tolist(), strict=True))
        self.x, self.y, self.z = spots.T.tolist()
        self.box, self.below, self.up, self.held, self.leaf = [], [], [], [], [0] * len(spots)
        todo = [(np.arange(len(spots)), -1)]
        while todo:
            rows, up = todo.pop()
            node = len(self.box)
            lo, hi = spots[rows].min(axis=0), spots[rows].max(axis=0)
            self.box.append((*lo.tolist(), *hi.tolist()))
            self.up.append(up)
            self.below.append([])
            self.held.append(None)
            if up >= 0:
                self.below[up].append(node)
            if len(rows) <= LEAF:
                self.held[node] = rows.tolist()
                for s in self.held[node]:
                    self.leaf[s] = node
            else:
                half = len(rows) // 2
                cut = np.argpartition(spots[rows, np.argmax(hi - lo)], half)
                todo += [(rows[cut[:half]], node), (rows[cut[half:]], node)]
        self.n_free, self.n_doubt = [0] * len(self.box), [0] * len(self.box)
        for s, (a, b) in enumerate(zip(self.free, self.end, strict=True)):
            self.n_free[self.leaf[s]] += b - a
        for node in range(len(self.box) - 1, 0, -1):
            self.n_free[self.up[node]] += self.n_free[node]

    def count(self, spot: int, free: int, doubt: int) -> None:
        node = self.leaf[spot]
        while node >= 0:
            self.n_free[node] += free
            self.n_doubt[node] += doubt
            node = self.up[node]

    def take(self, point: int) -> None:
        """Away with the head of its queue."""
        s = self.spot[point]
        if self.doubt[s] < self.free[s]:
            self.count(s, 0, -1)
        else:
            self.free[s] += 1
            self.count(s, -1, 0)
        self.doubt[s] += 1

    def put_in_doubt(self, point: int) -> None:
        """The first free one of its queue."""
        s = self.spot[point]
        self.free[s] += 1
        self.count(s, -1, 1)

    def nearest(self, x: float, y: float, z: float, far: float, *, heed: bool) -> tuple[int, bool]:
        """The nearest free point within a squared distance, ties to the first, or -1; and, if heeded, whether one in doubt
        is as near."""
        best, found, dim = far, -1, math.inf
        box, below, held, n_free, n_doubt, queue, xs, ys, zs = self.box, self.below, self.held, self.n_free, self.n_doubt, self.queue, self.x, self.y, self.z

        def off(node: int) -> float:
            a, b, c, d, e, f = box[node]
            u = a - x if x < a else x - d if x > d else 0.0
            v = b - y if y < b else y - e if y > e else 0.0
            w = c - z if z < c else z - f if z > f else 0.0
            return u * u + v * v + w * w

        todo = [(off(0), 0)]
        while todo:
            d, node = todo.pop()
            if d > best or not n_free[node] and not (heed and n_doubt[node] and d < dim):
                continue
            if held[node] is None:
                p, q = below[node]
                u, v = off(p), off(q)
                todo += [(v, q), (u, p)] if u <= v else [(u, p), (v, q)]
                continue
            for s in held[node]:
                first, free = self.doubt[s], self.free[s]
                if first == self.end[s]:
                    continue
                u, v, w = xs[s] - x, ys[s] - y, zs[s] - z
                d = u * u + v * v + w * w
                if d > best:
                    continue
                if heed and first < free and d < dim:
                    dim = d
                if free < self.end[s] and (d < best or found < 0 or queue[free] < found):
                    best, found = d, queue[free]
        return found, dim <= best


def greedy_tile(at: np.ndarray, source: np.ndarray, own: np.ndarray, inside: np.ndarray, eps: float) -> list[tuple[int, int]]:
    """(point, welded to) of the points of a tile, in the order of ids, that hold whatever lies beyond its halo: those whose
    first is the tile's own, with all that it takes. Points within eps of the halo's end may be taken from there, so they
    are in doubt, as is what they would take."""
    trees = {s: Tree(at, np.flatnonzero(source == s)) for s in np.unique(source)}
    doubt, gone = (inside <= eps).tolist(), [False] * len(at)
    mine, kind, out = own.tolist(), source.tolist(), []
    for i, shaky in enumerate(doubt):
        if shaky:
            trees[kind[i]].put_in_doubt(i)
    for i, (x, y, z) in enumerate(at.tolist()):
        if gone[i]:
            continue
        trees[kind[i]].take(i)
        shaky, took, sure = doubt[i], [], True
        for s, tree in trees.items():
            if s == kind[i]:
                continue
            j, dim = tree.nearest(x, y, z, eps * eps, heed=not shaky)
            if shaky or dim:
                sure = False
                if j >= 0:
                    doubt[j] = True
                    tree.put_in_doubt(j)
            elif j >= 0:
                gone[j] = True
                tree.take(j)
                took.append(j)
        if sure and not shaky and mine[i]:
            out += [(j, i) for j in [i, *took]]
    return out


def greedy_tiles(side: float, halo: float, shift: float, eps: float) -> Callable[[pd.DataFrame], pd.DataFrame]:
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id", ignore_index=True)
        at, tile, own, inside = placed(pdf, side, halo, shift)
        ids, source = pdf["id"].to_numpy(), pd.factorize(pdf["source"], use_na_sentinel=False)[0]
        found = []
        order = np.argsort(tile, kind="stable")
        for rows in np.split(order, np.cumsum(np.bincount(tile))[:-1]):
            if own[rows].any():
                pairs = np.array(greedy_tile(at[rows], source[rows], own[rows], inside[rows], eps), np.int64).reshape(-1, 2)
                found.append(ids[rows[pairs]])
        all_found = np.concatenate([np.empty((0, 2), np.int64), *found])
        return pd.DataFrame({"id": all_found[:, 0], "merged": all_found[:, 1]})

    return run


def greedy(points: DataFrame, eps: float) -> DataFrame:
    """(id, merged): see merge.weld_greedy. Each round welds what its tiles can tell; the rest goes on."""
    rest, lone = finite(points.select("id", "source", "x", "y", "z"))
    out, turn, rows = lone.select("id", F.col("id").alias("merged")), 0, None
    rest = stash(rest, "weld-rest")
    while rows := rest.count():
        how = sizes(eps, turn, 4.0, 1.5)
        told = stash(dealt(rest, *how, rows).groupBy("bucket").applyInPandas(greedy_tiles(*how, eps), "id long, merged long"), "weld-told")
        out, rest, turn = out.union(told), stash(rest.join(told.select("id"), "id", "left_anti"), "weld-rest"), turn + 1
    return out
