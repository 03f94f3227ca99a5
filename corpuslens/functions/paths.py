"""Path functions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..catalog import UNPACK_SEGMENT_MARKER
from . import as_col


def normalize_path(path: Column | str) -> Column:
    """Trim, and resolve empty, ``.`` and ``..`` segments."""
    path = F.trim(as_col(path))
    rooted = path.startswith("/")

    def step(kept: Column, segment: Column) -> Column:
        can_pop = (F.size(kept) > 0) & (F.element_at(kept, -1) != "..")
        return (
            F.when((segment == "") | (segment == "."), kept)
            .when((segment == "..") & can_pop, F.slice(kept, F.lit(1), F.greatest(F.size(kept) - 1, F.lit(0))))
            .when((segment == "..") & rooted, kept)
            .otherwise(F.concat(kept, F.array(segment)))
        )

    # element_at(-1) fails on an empty array, so the fold starts with a guard that is cut off again.
    folded = F.aggregate(F.split(path, "/"), F.array(F.lit("..")), step)
    kept = F.slice(folded, F.lit(2), F.greatest(F.size(folded), F.lit(1)))
    joined = F.array_join(kept, "/")
    plain = F.when(rooted, F.concat(F.lit("/"), joined)).otherwise(joined)
    return F.when(plain == "", F.lit(".")).otherwise(plain)


def base_name(path: Column | str) -> Column:
    return F.element_at(F.split(as_col(path), "/"), -1)


def directory_of(path: Column | str) -> Column:
    """Everything before the last slash; ``/`` for an entry of the root."""
    head = F.regexp_replace(as_col(path), "/[^/]*$", "")
    return F.when(head == "", F.lit("/")).otherwise(head)


def parent_name(path: Column | str, root: Column | str) -> Column:
    """Name of the directory an entry lies in, ``/`` for the scan root."""
    parent = base_name(F.regexp_replace(as_col(path), "/[^/]*$", ""))
    return F.when((parent == "") | (parent == base_name(root)), F.lit("/")).otherwise(parent)


def relative_path(path: Column | str, root: Column | str) -> Column:
    return F.replace(as_col(path), as_col(root), F.lit(""))


def path_prefixes(path: Column | str) -> Column:
    """Every directory above a path such as ``/a/b/c.txt``: ``/a`` and ``/a/b``."""
    segments = F.split(as_col(path), "/")
    depth = F.size(segments) - 2
    return F.when(
        depth >= 1,
        F.transform(
            F.sequence(F.lit(1), F.greatest(depth, F.lit(1))),
            lambda i: F.array_join(F.slice(segments, F.lit(1), i + 1), "/"),
        ),
    ).otherwise(F.array().cast("array<string>"))


def drop_marked_segments(path: Column | str, marker: str = UNPACK_SEGMENT_MARKER) -> Column:
    """Remove path segments that contain the marker."""
    return F.array_join(F.filter(F.split(as_col(path), "/"), lambda s: ~s.contains(marker)), "/")


def subfolders_after(path: Column | str, folder: Column | str) -> Column:
    """Folders between a named folder and the file; empty if the folder is absent or leads the path."""
    segments = F.split(as_col(path), "/")
    name = F.replace(as_col(folder), F.lit("/"), F.lit(""))
    position = F.array_position(segments, name)
    usable = (position > 0) & (segments[0] != as_col(folder))
    count = F.greatest(F.size(segments) - position - 1, F.lit(0)).cast("int")
    return F.when(
        usable, F.slice(segments, F.greatest(position + 1, F.lit(1)).cast("int"), count)
    ).otherwise(F.array().cast("array<string>"))


def replace_last(text: Column | str, target: str, replacement: str) -> Column:
    """Replace the right-most occurrence of a literal text."""
    quoted = replacement.replace("\\", "\\\\").replace("$", "\\$")
    return F.regexp_replace(as_col(text), "(?s)^(.*)" + re.escape(target), "$1" + quoted)
