"""Connected components of an edge table, without bringing links to the driver."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from massif.plans.shared import stash

LINKS = 2**19  # that one task puts together


def connected_components(edges: DataFrame, *, u: str = "u", v: str = "v") -> DataFrame:
    """(node, component) for every node of `edges`; the component is its smallest node. Nodes are of any type that has an
    order, structs included.

    Each round hooks trees onto smaller neighbouring trees and halves the depth of every tree, so rounds grow with the
    logarithm of the longest chain. A round is stored in the shared folder before the next; the last is one in which no
    node moved. Edges may repeat, point either way or be loops; an edge with a null end is dropped."""
    edges = edges.select(F.col(u).alias("u"), F.col(v).alias("v")).dropna()
    both = stash(edges.union(edges.select("v", "u")).distinct(), "edges")
    parents = both.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("f")).select("node", F.least("node", "f").alias("f"), F.lit(True).alias("moved"))
    parents = stash(parents, "parents")
    while not parents.filter("moved").isEmpty():
        up = parents.select(F.col("node").alias("p"), F.col("f").alias("gf"))
        grand = parents.join(up, F.col("f") == F.col("p")).select("node", "f", "gf")
        near = both.join(grand.select(F.col("node").alias("v"), "gf"), "v").groupBy("u").agg(F.min("gf").alias("m"))
        hooks = near.join(parents, F.col("u") == F.col("node")).select(F.explode(F.array(F.struct("node", F.col("m").alias("f")), F.struct(F.col("f").alias("node"), F.col("m").alias("f")))).alias("h")).select("h.*", F.lit(None).alias("was"))
        lowered = grand.select("node", F.least("f", "gf").alias("f"), F.col("f").alias("was")).union(hooks)
        parents = stash(lowered.groupBy("node").agg(F.min("f").alias("f"), F.max("was").alias("was")).select("node", "f", (F.col("f") < F.col("was")).alias("moved")), "parents")
    return parents.select("node", F.col("f").alias("component"))


def _keys(column: pa.Array) -> list[np.ndarray]:
    """Numbers that order the values of a column as Spark does, the first before the second and so on: nulls are least."""
    there = column.is_valid().to_numpy(zero_copy_only=False)
    out = [] if there.all() else [there]
    if pa.types.is_struct(column.type):
        return out + [k for c in column.flatten() for k in _keys(c)]
    if pa.types.is_floating(column.type):
        return [*out, np.unique(np.where(there, column.to_numpy(zero_copy_only=False), 0.0), return_inverse=True)[1]]  # one NaN, one zero
    if pa.types.is_integer(column.type):
        return [*out, column.fill_null(0).to_numpy()]
    known = column.dictionary_encode()
    rank = np.argsort(pc.sort_indices(known.dictionary).to_numpy())
    return [*out, rank[known.indices.fill_null(0).to_numpy()] if len(rank) else np.zeros(len(column), np.int64)]


def _numbered(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """For each value its place among the different ones, in order, and for each of these a row that has it."""
    keys = _keys(column)
    order = np.lexsort(keys[::-1])
    new = np.zeros(len(order), bool)
    new[:1] = True
    for k in keys:
        new[1:] |= k[order][1:] != k[order][:-1]
    rank = np.empty(len(order), np.int64)
    rank[order] = np.cumsum(new) - 1
    return rank, order[new]


def least_linked(n: int, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """For each of n nodes the least one that links lead to."""
    root = np.arange(n)
    while len(u):
        a, b = root[u], root[v]
        apart = a != b
        u, v, a, b = u[apart], v[apart], a[apart], b[apart]
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while ((up := root[root]) != root).any():
            root = up
    return root


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, component) as far as the links of a run tell; a task has one run or more."""
    def close(run: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(run).combine_chunks()
        node = pa.concat_arrays([t.column(c).combine_chunks() if t.column(c).num_chunks != 1 else t.column(c).chunk(0) for c in ("u", "v")])
        rank, row = _numbered(node)
        least = least_linked(len(row), *np.split(rank, 2))
        return pa.RecordBatch.from_arrays([node.take(pa.array(row)), node.take(pa.array(row[least]))], names=["node", "component"])

    run, rows = [], 0
    for batch in batches:
        run, rows = [*run, batch], rows + batch.num_rows
        if rows >= LINKS:
            yield close(run)
            run, rows = [], 0
    if rows:
        yield close(run)


def chained_components(edges: DataFrame, *, u: str = "u", v: str = "v") -> DataFrame:
    """connected_components() in a few steps however long the chains are, for links whose nodes lie in order along them.

    Few links are put together by one task. Of many, each range of nodes puts its own together: what is left links nodes
    that several ranges have with the least ones there. If that is less than half, it goes on with these, else in rounds."""
    edges = stash(edges.select(F.col(u).alias("u"), F.col(v).alias("v")).dropna(), "links")
    kind = edges.schema["u"].dataType
    out = T.StructType([T.StructField(c, kind) for c in ("node", "component")])
    n = edges.count()
    if n < LINKS:
        return edges.coalesce(1).mapInArrow(_stars, out)
    stars = stash(edges.repartitionByRange(2 * n // LINKS + 1, "u").mapInArrow(_stars, out), "stars")
    shared = stars.groupBy("node").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").select("node")
    core = stash(stars.join(shared, "node").select(F.col("node").alias("u"), F.col("component").alias("v")), "stars-shared")
    found = (chained_components if core.count() < n / 2 else connected_components)(core)
    far = found.select(F.col("node").alias("component"), F.col("component").alias("least"))
    return stars.join(far, "component", "left").groupBy("node").agg(F.min(F.coalesce("least", "component")).alias("component"))
