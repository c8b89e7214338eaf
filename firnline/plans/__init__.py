"""Named queries over the test tables, each with its SQL statement where one exists."""

import importlib

MODULES = [
    "image_queries", "inventory_queries", "pixel_queries", "spatial_queries", "evaluation_queries",
    "calibration_queries", "change_queries", "io_queries", "gap_queries", "composed_queries",
]


def registry():
    """All registered queries by name."""
    from firnline.plans.registry import QUERIES

    for m in MODULES:
        importlib.import_module(f"firnline.plans.{m}")
    return QUERIES
