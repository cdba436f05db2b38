"""Masks from GeoJSON files."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from massif.sources.store import InvalidData

RING = "path string, epsg int, component int, ring int, is_outer boolean, seq int, x double, y double"


def polygons(node) -> list:
    """The polygons of a GeoJSON object, however it nests them; other geometries have none."""
    if not node:
        return []
    kind = node.get("type")
    if kind == "Polygon":
        return [node["coordinates"]]
    if kind == "MultiPolygon":
        return list(node["coordinates"])
    inner = node.get("features") or node.get("geometries") or [node.get("geometry")]
    return [p for x in inner for p in polygons(x)]


def system(doc: dict) -> int:
    """EPSG code of a document: that of its crs member, else that of longitude and latitude."""
    name = ((doc.get("crs") or {}).get("properties") or {}).get("name", "")
    if not name or name.endswith("CRS84"):
        return 4326
    if not name.rpartition(":")[2].isdigit():
        raise InvalidData(f"unknown reference system {name}")
    return int(name.rpartition(":")[2])


def read_mask(spark: SparkSession, path: str) -> DataFrame:
    """(path, epsg, component, ring, is_outer, seq, x, y): the rings of all polygons of each file, without the repeated
    last corner; components are numbered within a file, which is read as a whole."""
    def run(frames):
        for pdf in frames:
            for name, text in zip(pdf["path"], pdf["content"], strict=True):
                doc = json.loads(bytes(text))
                rows = [
                    (name, system(doc), c, r, r == 0, i, float(p[0]), float(p[1]))
                    for c, rings in enumerate(polygons(doc)) for r, ring in enumerate(rings) for i, p in enumerate(ring[:-1] if ring[0] == ring[-1] else ring)
                ]
                yield pd.DataFrame(rows, columns=[f.split()[0] for f in RING.split(", ")])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, RING)
