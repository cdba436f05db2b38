"""Simplification of mask outlines that keeps their topology."""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame


def _deviation(points: np.ndarray, a: np.ndarray, b: np.ndarray) -> float:
    """Largest distance of points to a segment."""
    ab = b - a
    size = float(ab @ ab)
    t = np.clip((points - a) @ ab / size, 0.0, 1.0) if size > 0 else np.zeros(len(points))
    gap = points - (a + t[:, None] * ab)
    return float(np.sqrt((gap * gap).sum(axis=1).max()))


def _turn(a: np.ndarray, b: np.ndarray, p: np.ndarray) -> np.ndarray:
    return (b[0] - a[0]) * (p[..., 1] - a[1]) - (b[1] - a[1]) * (p[..., 0] - a[0])


class _Outlines:
    """Rings of one mask, as vertices linked around each ring."""

    def __init__(self, rings: list[np.ndarray], tolerance: float):
        self.xy, self.tolerance = np.concatenate(rings), tolerance
        n = len(self.xy)
        self.back, self.on, self.left = np.empty(n, np.int64), np.empty(n, np.int64), np.empty(n, np.int64)
        self.ring, self.start = np.empty(n, np.int64), []
        at = 0
        for k, r in enumerate(rings):
            ids = np.arange(at, at + len(r))
            self.back[ids], self.on[ids], self.left[k], self.ring[ids] = np.roll(ids, 1), np.roll(ids, -1), len(r), k
            self.start.append(at)
            at += len(r)
        _, place, uses = np.unique(self.xy, axis=0, return_inverse=True, return_counts=True)
        self.fixed = uses[place.ravel()] > 1  # where outlines touch
        self.gone = np.zeros(n, bool)
        self.by_x = np.argsort(self.xy[:, 0], kind="stable")
        self.xs = self.xy[self.by_x, 0]

    def cost(self, v: int) -> float:
        """Deviation of the original vertices between the neighbours of v from the edge that would replace them."""
        p, q, k = self.back[v], self.on[v], self.ring[v]
        first = self.start[k]
        size = (self.start[k + 1] if k + 1 < len(self.start) else len(self.xy)) - first
        between = first + (p - first + 1 + np.arange((q - p - 1) % size)) % size
        return _deviation(self.xy[between], self.xy[p], self.xy[q])

    def free(self, v: int) -> bool:
        """No other vertex lies in the triangle that goes or comes with v, so no edge can cross the new one."""
        ids = (self.back[v], v, self.on[v])
        a, b, c = self.xy[list(ids)]
        near = self.by_x[np.searchsorted(self.xs, min(a[0], b[0], c[0])) : np.searchsorted(self.xs, max(a[0], b[0], c[0]), side="right")]
        near = near[~self.gone[near] & ~np.isin(near, ids)]
        p = self.xy[near]
        s = np.stack([_turn(a, b, p), _turn(b, c, p), _turn(c, a, p)])
        if _turn(a, b, c) == 0:  # on a line: only vertices on the three points' span matter
            low, high = np.minimum(np.minimum(a, b), c), np.maximum(np.maximum(a, b), c)
            return not ((s == 0).all(axis=0) & ((p >= low) & (p <= high)).all(axis=1)).any()
        return not ((s >= 0).all(axis=0) | (s <= 0).all(axis=0)).any()

    def run(self) -> np.ndarray:
        """Marks of the vertices that stay."""
        heap = [(c, v) for v in np.flatnonzero(~self.fixed).tolist() if (c := self.cost(v)) <= self.tolerance]
        heapq.heapify(heap)
        while heap:
            c, v = heapq.heappop(heap)
            if self.gone[v] or self.left[self.ring[v]] <= 3 or c != self.cost(v) or not self.free(v):
                continue
            p, q = int(self.back[v]), int(self.on[v])
            self.gone[v], self.on[p], self.back[q] = True, q, p
            self.left[self.ring[v]] -= 1
            for x in (p, q):
                if not self.fixed[x] and (new := self.cost(x)) <= self.tolerance:
                    heapq.heappush(heap, (new, x))
        return ~self.gone


def simplify_outlines(rings: DataFrame, tolerance: float, mask: str = "mask") -> DataFrame:
    """`rings` (mask, component, ring, seq, x, y, ...) without the vertices that may go: the cheapest first, as long as no
    original vertex is further than `tolerance` from the edge that replaces it.

    A vertex where outlines touch stays, a ring keeps three vertices, and a vertex stays while another lies in the triangle
    it makes with its neighbours, so outlines neither cross nor swallow each other. Rings don't repeat their first vertex.
    One mask is one task: give islands that are far apart masks of their own."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["component", "ring", "seq"], kind="stable")
        parts = [r[["x", "y"]].to_numpy(float) for _, r in pdf.groupby(["component", "ring"], sort=True)]
        return pdf[_Outlines(parts, tolerance).run()]

    return rings.groupBy(mask).applyInPandas(run, rings.schema)
