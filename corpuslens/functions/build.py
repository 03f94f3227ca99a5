"""Build-descriptor functions."""

from __future__ import annotations

import re
from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import any_contained, as_col
from .paths import drop_marked_segments, subfolders_after

PLACEHOLDER = re.compile(r"\$(?:\{(\w+)\}|(\$))")


def module_name(file_name: Column | str, suffix: str = "_prebuilt") -> Column:
    return F.concat(F.translate(as_col(file_name), ".@- ", "____"), F.lit(suffix))


def render_template(template: str, values: Mapping[str, Column | str]) -> Column:
    """Fill ``${name}`` from columns. A name without a column is an error here, not at run time."""
    pieces: list[Column] = []
    position = 0
    for found in PLACEHOLDER.finditer(template):
        pieces.append(F.lit(template[position : found.start()]))
        pieces.append(F.lit("$") if found.group(2) else as_col(values[found.group(1)]).cast("string"))
        position = found.end()
    pieces.append(F.lit(template[position:]))
    return F.concat(*pieces)


def signing_key(shared_user_id: Column | str, package: Column | str) -> Column:
    """Key by shared user id, else by package name, else the platform key."""
    user, package = as_col(shared_user_id), as_col(package)
    by_user = F.lit(None).cast("string")
    for key in ("shared", "networkstack", "media", "bluetooth"):
        by_user = F.when(user.isin(f"android.uid.{key}", f"android.{key}"), F.lit(key)).otherwise(by_user)
    by_package = F.when(any_contained(package, ["networkstack", "cellbroadcast"]), F.lit("networkstack"))
    return F.coalesce(by_user, by_package, F.lit("platform"))


def app_install_path(
    path: Column | str, partition: Column | str, file_name: Column | str, build_format: str = "mk"
) -> Column:
    path = as_col(path)
    out = "" if build_format.lower() == "bp" else "$(TARGET_OUT)"
    folders = subfolders_after(path, partition)
    kept = F.concat(F.lit(f"{out}/"), drop_marked_segments(F.array_join(folders, "/")))
    in_overlay = path.contains("/overlay/") & path.contains("/vendor/")
    return (
        F.when(path.contains("/priv-app/"), F.lit(f"{out}/priv-app/"))
        .when(in_overlay | path.contains("/odm/"), F.lit(f"{out}/odm/overlay/"))
        .when(any_contained(path, ["/vendor/", "/oem/"]), F.lit(f"{out}/odm/app/"))
        .when(path.contains("_apex"), F.lit(f"{out}/app/"))
        .when(F.size(folders) <= 1, F.lit(f"{out}/app/"))
        .otherwise(F.replace(kept, as_col(file_name), F.lit("")))
    )


def library_install_path(
    path: Column | str, partition: Column | str, file_name: Column | str, build_format: str = "mk"
) -> Column:
    """Install path of a shared library; the ``bp`` format has none."""
    if build_format.lower() != "mk":
        return F.lit("")
    path = as_col(path)
    out, abi = "$(TARGET_OUT)", "$(TARGET_ARCH_ABI)/"
    folders = subfolders_after(path, partition)

    def below(folder: str) -> Column:
        owner = F.split(path, folder)[1]
        return F.concat(F.lit(f"{out}{folder}"), owner, F.lit(f"/lib/{abi}"))

    chosen = (
        F.when(path.contains("/app/"), below("/app/"))
        .when(path.contains("/priv-app/"), below("/priv-app/"))
        .when(path.contains("_apex/"), F.lit(f"{out}/system/lib64/"))
        .when(F.size(folders) <= 1, F.lit(f"{out}/"))
        .otherwise(F.concat(F.lit(f"{out}/"), F.array_join(folders, "/")))
    )
    return F.replace(F.replace(chosen, F.lit("//"), F.lit("/")), as_col(file_name), F.lit(""))


def meta_group(partition: Column | str) -> Column:
    """The build-meta group a partition belongs to."""
    lowered = F.lower(as_col(partition))
    return (
        F.when(any_contained(lowered, ["vendor", "oem", "odm"]), F.lit("vendor"))
        .when(lowered.contains("product"), F.lit("product"))
        .when(lowered.contains("system_ext"), F.lit("system_ext"))
        .otherwise(F.lit("system"))
    )
