"""What the registries offer by name: transforms of pipelines, sources and writers."""

from __future__ import annotations

from cairn.operators import augment, frames, geometry, grid, labels, raster, sampling, visibility
from cairn.plans.registry import SOURCES, TRANSFORMS, WRITERS
from cairn.sources import ingest, sinks

#: Functions from a DataFrame and options to a DataFrame, by module; they are registered under their own names.
_TRANSFORMS = {
    augment: ("shift", "rotate", "scale", "flip", "jitter", "augment_geom", "auto_contrast", "color_translation", "color_jitter", "greyscale", "hue_saturation", "brightness_contrast", "drop_color", "augment_color", "drop_attr", "elastic"),
    grid: ("grid_coord", "displacement", "voxelize", "voxel_reduce", "voxel_centroids", "voxel_sample", "fragments", "thin_non_class", "with_index", "tile_grid", "number_tiles", "absorb_small", "split_large", "chunk"),
    labels: ("filter_classes", "remap", "build_class_map"),
    sampling: ("nested_rank", "keep_fraction", "downsample", "keep_labels", "dropout", "shuffled", "stratified", "serialize", "sphere_crop", "multi_view", "keep_largest", "budget_sample", "terrain_split"),
    geometry: ("column_strata", "height_above_ground", "recenter", "local_geometry"),
    raster: ("flatten_non_ground",),
    visibility: ("surface_visibility", "classify_visibility", "q_regions"),
    ingest: ("ensure_columns", "collect_columns"),
    frames: ("sequence_bounds", "fuse_frames", "sweep_history"),
}
_SOURCES = {"las": ingest.ingest_las, "npy": ingest.ingest_npy, "sweeps": ingest.ingest_sweeps, "sidecar": ingest.ingest_sidecar, "xyz": ingest.read_xyz_text, "segments": ingest.read_segments, "groups": ingest.read_groups, "manifest": ingest.read_manifest, "logs": ingest.parse_logs}
_WRITERS = {"tiles": sinks.write_tiles, "predictions": sinks.write_predictions, "submission": sinks.export_submission, "label_budget": sinks.write_label_budget, "colored": sinks.write_colored}


def register_all() -> None:
    """Fill the registries; names that are there already stay."""
    for module, names in _TRANSFORMS.items():
        for name in names:
            if name not in TRANSFORMS.items:
                TRANSFORMS.register(name, getattr(module, name))
    for registry, table in ((SOURCES, _SOURCES), (WRITERS, _WRITERS)):
        for name, f in table.items():
            if name not in registry.items:
                registry.register(name, f)


register_all()
