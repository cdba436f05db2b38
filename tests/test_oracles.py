"""Registered queries against their oracles on the smallest tables."""

import glob
import os

import duckdb
import pytest

import __spark_entry__

SF = "/root/testdata/sf0.001"
NAMES = [
    "index_status_counts", "key_neighbours", "shifted_point_to_cell", "box_cover", "traverse_refine_pruned", "raster_fold", "reduce_mode", "upscale_bilinear", "lanczos3_down",
    "eps_pairs", "nearest_ancestor_join", "tile_cover_painter", "mesh_boundary_edges", "cut_inside", "cut_outside", "point_in_mask", "simple_merge_actions", "weld_components", "level_targets",
    "vertex_fans", "mesh_components", "reindex_first_use", "dedup_by_normal", "offset_locate", "triangles_overlap", "fixed_point_segments", "grown_nearest_ancestor", "warp_bilinear", "windowed_scaling",
    "raster_store_levels", "mask_cover", "masked_traversal", "cut_mask_outside", "lod_full_build", "triangle_correspondence", "native_read_windows", "terrain_patches", "link_with_hash", "region_texts",
    "clip_box", "clip_polygon_2d", "mesh_bfs", "split_cluster_parts", "mesh_validate", "barycentric_interpolate", "segment_distance", "padded_bounds",
]


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        c.sql(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return c


def plain(v):
    return tuple(map(plain, v)) if isinstance(v, list | tuple) else repr(v + 0.0) if isinstance(v, float) else repr(v)


@pytest.mark.parametrize("name", NAMES)
def test_oracle(spark, duck, name):
    df = __spark_entry__.queries()[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted(tuple(plain(r[c]) for c in cols) for r in df.collect())
    rel = duck.sql(__spark_entry__.oracle_sql()[name])
    want = sorted(tuple(plain(r[rel.columns.index(c)]) for c in cols) for r in rel.fetchall())
    assert sorted(rel.columns) == cols and got == want


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
