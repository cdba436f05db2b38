"""All queries over the reference tables, by name, with their oracles."""

from massif.plans.queries import baking, building, cutting, figures, grown, index, keys, meshes, rasters, serving, shadows, simplifying, solids, spatial, store_merging, surfaces, tables, terrain, textures  # noqa: F401
from massif.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
