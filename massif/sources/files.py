"""File sources: tiles by path, raw bytes, and meshes of glTF files."""

from __future__ import annotations

import base64
import json
import struct
import uuid

import numpy as np
import pandas as pd
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from massif.plans.shared import arrow_uri, qualified

MESH = "path string, mesh int, kind string, i long, x double, y double, z double, a long, b long, c long"
_COMPONENTS = {5120: "i1", 5121: "u1", 5122: "<i2", 5123: "<u2", 5125: "<u4", 5126: "<f4"}  # fixed values: glTF component types
_WIDTH = {"SCALAR": 1, "VEC2": 2, "VEC3": 3, "VEC4": 4}


def tile_files(spark: SparkSession, root: str, pattern: str = r"/(\d+)/(\d+)/(\d+)\.[A-Za-z]+$") -> DataFrame:
    """(zoom, x, y, content) of image tiles stored as zoom/x/y.ext; files of other names are left out."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).filter(F.col("path").rlike(pattern))
    return files.select(*[F.regexp_extract("path", pattern, i).cast("long").alias(n) for i, n in enumerate(("zoom", "x", "y"), 1)], "content")


def zoom_range(tiles: DataFrame, low: int, high: int) -> DataFrame:
    return tiles.filter(F.col("zoom").between(low, high))


GOOGLE = r"/(\d+)/(\d+)/(\d+)\.jpe?g$"  # zoom, x, y


def provided(wanted: DataFrame, tiles: DataFrame) -> DataFrame:
    """`wanted` (zoom, x, y) with the content that a provider's table of tiles has for them, null where it has none. Any
    table is a provider; an empty one has no tile."""
    return wanted.join(tiles.select("zoom", "x", "y", "content"), ["zoom", "x", "y"], "left")


def byte_range(spark: SparkSession, path: str, offset: int, length: int) -> DataFrame:
    """(path, bytes) of a range of each file: no more of it is read. Files are listed by Spark and opened by Arrow."""
    def run(frames):
        for pdf in frames:
            out = []
            for name in pdf["path"]:
                fs, at = pafs.FileSystem.from_uri(arrow_uri(name))
                with fs.open_input_file(at) as f:
                    f.seek(min(offset, f.size()))
                    out.append(f.read(length))
            yield pd.DataFrame({"path": pdf["path"], "bytes": out})

    return spark.read.format("binaryFile").load(path).select("path").mapInPandas(run, "path string, bytes binary")


def parse_gltf(content: bytes) -> list[tuple[np.ndarray, np.ndarray]]:
    """(positions, triangles) of the primitives of a .gltf with embedded buffers, or of a .glb: each mesh at every node that
    has it, in the coordinates of the scene; meshes as they are in a file without nodes."""
    chunk = b""
    if content[:4] == b"glTF":
        size = struct.unpack_from("<I", content, 12)[0]
        doc, at = json.loads(content[20 : 20 + size]), 20 + size
        if at < len(content):
            chunk = content[at + 8 : at + 8 + struct.unpack_from("<I", content, at)[0]]
    else:
        doc = json.loads(content)
    buffers = [base64.b64decode(b["uri"].partition(",")[2]) if "uri" in b else chunk for b in doc.get("buffers", [])]

    def accessor(k: int) -> np.ndarray:
        a = doc["accessors"][k]
        view = doc["bufferViews"][a["bufferView"]]
        kind, width = np.dtype(_COMPONENTS[a["componentType"]]), _WIDTH[a["type"]]
        start, stride = view.get("byteOffset", 0) + a.get("byteOffset", 0), view.get("byteStride", kind.itemsize * width)
        raw = buffers[view["buffer"]]
        return np.ndarray((a["count"], width), kind, raw, start, (stride, kind.itemsize)).copy()

    def local(node: dict) -> np.ndarray:
        """A node's matrix: its own, or scaled, then turned, then moved."""
        if "matrix" in node:
            return np.array(node["matrix"], float).reshape(4, 4).T
        x, y, z, w = node.get("rotation", (0, 0, 0, 1))
        turn = np.array([[1 - 2 * (y * y + z * z), 2 * (x * y - z * w), 2 * (x * z + y * w)], [2 * (x * y + z * w), 1 - 2 * (x * x + z * z), 2 * (y * z - x * w)], [2 * (x * z - y * w), 2 * (y * z + x * w), 1 - 2 * (x * x + y * y)]])
        out = np.eye(4)
        out[:3, :3] = turn * np.array(node.get("scale", (1, 1, 1)))
        out[:3, 3] = node.get("translation", (0, 0, 0))
        return out

    nodes = doc.get("nodes", [])
    inner = {c for n in nodes for c in n.get("children", [])}
    work, placed = [(i, np.eye(4)) for i in range(len(nodes)) if i not in inner], []
    while work:
        i, above = work.pop(0)
        world = above @ local(nodes[i])
        if "mesh" in nodes[i]:
            placed.append((nodes[i]["mesh"], world))
        work += [(c, world) for c in nodes[i].get("children", [])]
    out = []
    for k, world in placed or [(k, np.eye(4)) for k in range(len(doc.get("meshes", [])))]:
        for p in doc["meshes"][k]["primitives"]:
            at = accessor(p["attributes"]["POSITION"]).astype(float) @ world[:3, :3].T + world[:3, 3]
            tri = accessor(p["indices"]).reshape(-1, 3) if "indices" in p else np.arange(len(at)).reshape(-1, 3)
            out.append((at, tri.astype(np.int64)))
    return out


def meshes(spark: SparkSession, path: str) -> DataFrame:
    """Vertices and triangles of .gltf and .glb files, a row each (kind is vertex or triangle)."""
    def run(frames):
        for pdf in frames:
            for name, content in zip(pdf["path"], pdf["content"], strict=True):
                for m, (at, tri) in enumerate(parse_gltf(bytes(content))):
                    yield pd.DataFrame({"path": name, "mesh": m, "kind": "vertex", "i": range(len(at)), "x": at[:, 0], "y": at[:, 1], "z": at[:, 2], "a": None, "b": None, "c": None})
                    yield pd.DataFrame({"path": name, "mesh": m, "kind": "triangle", "i": range(len(tri)), "x": None, "y": None, "z": None, "a": tri[:, 0], "b": tri[:, 1], "c": tri[:, 2]})

    files = spark.read.format("binaryFile").load(path).filter(F.col("path").rlike(r"\.(gltf|glb)$"))
    return files.select("path", "content").mapInPandas(run, MESH)


def write_meshes(vertices: DataFrame, triangles: DataFrame, path: str) -> DataFrame:
    """(name, file) of a .gltf for each mesh (name, vid, x, y, z; name, a, b, c) below `path`, which Arrow can write. A mesh
    is written by one task, under a temporary name first."""
    rows = vertices.select("name", F.lit(0).alias("kind"), "vid", "x", "y", "z", *[F.lit(0).cast("long").alias(k) for k in "abc"])
    rows = rows.unionByName(triangles.select("name", F.lit(1).alias("kind"), F.lit(0).cast("long").alias("vid"), *[F.lit(0.0).alias(p) for p in "xyz"], "a", "b", "c"))

    place = arrow_uri(qualified(vertices.sparkSession, path))

    def write(pdf: pd.DataFrame) -> pd.DataFrame:
        v, t = (pdf[pdf["kind"] == k] for k in (0, 1))
        v = v.sort_values("vid")
        tri = np.searchsorted(v["vid"].to_numpy(), t[["a", "b", "c"]].to_numpy())
        name = str(pdf["name"].iloc[0])
        fs, root = pafs.FileSystem.from_uri(place)
        fs.create_dir(root, recursive=True)
        part = f"{root}/.{name}.{uuid.uuid4().hex}"
        with fs.open_output_stream(part, compression=None) as out:
            out.write(gltf_of(v[["x", "y", "z"]].to_numpy(), tri))
        fs.move(part, f"{root}/{name}.gltf")
        return pd.DataFrame({"name": [name], "file": [f"{name}.gltf"]})

    return rows.groupBy("name").applyInPandas(write, "name string, file string")


def gltf_of(positions: np.ndarray, triangles: np.ndarray, node: dict | None = None) -> bytes:
    """A .gltf of one mesh with its buffer embedded, at a node that may have a transform."""
    at, tri = np.asarray(positions, "<f4"), np.asarray(triangles, "<u4")
    raw = at.tobytes() + tri.tobytes()
    return json.dumps({
        "asset": {"version": "2.0"}, "scene": 0, "scenes": [{"nodes": [0]}], "nodes": [{"mesh": 0, **(node or {})}],
        "meshes": [{"primitives": [{"attributes": {"POSITION": 0}, "indices": 1}]}],
        "buffers": [{"byteLength": len(raw), "uri": "data:application/octet-stream;base64," + base64.b64encode(raw).decode()}],
        "bufferViews": [{"buffer": 0, "byteOffset": 0, "byteLength": at.nbytes}, {"buffer": 0, "byteOffset": at.nbytes, "byteLength": tri.nbytes}],
        "accessors": [{"bufferView": 0, "componentType": 5126, "count": len(at), "type": "VEC3", "min": at.min(0).tolist(), "max": at.max(0).tolist()}, {"bufferView": 1, "componentType": 5125, "count": tri.size, "type": "SCALAR"}],
    }).encode()
