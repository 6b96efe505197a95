"""Path and file-name expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

IMAGE_EXTENSIONS = (".jpg", ".jpeg", ".png")
SCAN_EXTENSIONS = (".jpg", ".jpeg", ".png", ".bmp", ".tif", ".tiff")


def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def parent_name(path: Column) -> Column:
    return F.try_element_at(F.split(path, "/"), F.lit(-2))


def suffix(path: Column) -> Column:
    """Last ``.ext`` of the base name with its dot, empty if there is none."""
    return F.regexp_extract(base_name(path), r"^.+?(\.[^.]+)$", 1)


def stem(path: Column) -> Column:
    name = base_name(path)
    return F.substring(name, F.lit(1), F.length(name) - F.length(suffix(path)))


def path_label(path: Column) -> Column:
    """The class of a file is the name of its directory."""
    return parent_name(path)


def path_split(path: Column, marker: str = "Training") -> Column:
    """``train`` where the path contains the marker, else ``test``."""
    return F.when(path.contains(marker), "train").otherwise("test")


def sanitized(path: Column) -> Column:
    """Name that shows which file it was but not whose: hashed stem plus suffix."""
    hashed = F.concat(F.substring(F.sha2(stem(path), 256), 1, 12), suffix(path))
    return F.when(F.coalesce(path, F.lit("")) == "", "unknown").otherwise(hashed)
