"""File sources: folder listings, file trees, line files.

Trees are listed by the data source of ``tree``, and files are hashed block by block by the tasks
they are dealt to. Names that begin with a dot or an underscore, empty files and empty folders count
like all others, which Spark's own file sources leave out. The driver opens a few levels of folders at most.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator

import pandas as pd
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..catalog import IMPORT_EXTENSIONS
from ..functions import any_suffix
from ..functions.paths import base_name, normalize_path, parent_name
from .tree import FORMAT, LISTED_DDL, open_folder, register

BLOCK_BYTES = 1 << 20
FOLDERS_KNOWN = 10_000  # folders a task remembers to have made


def _local_path(column: Column) -> Column:
    """The path of a file URI."""
    return F.regexp_replace(column, "^[a-z0-9]+:(//[^/]*)?", "")


def qualified(spark: SparkSession, path: str) -> str:
    """A path with its file system. One without is meant to be in the session's default file system,
    which on a cluster is not the disk of the machine that happens to open it."""
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    return there.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(there).toString()


def read_files(spark: SparkSession, root: str, glob: str | None = None, recursive: bool = True) -> DataFrame:
    """Visible files below a folder with path, size, time and content. Content is read only where it is used."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower())
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return reader.load(root).withColumn("path", _local_path(F.col("path")))


def list_tree(spark: SparkSession, root: str, recursive: bool = True, glob: str | None = None) -> DataFrame:
    """Every file and folder below a folder, as ``(path, is_directory, size, modified)``, listed by tasks."""
    register(spark)
    reader = spark.read.format(FORMAT).option("recursive", str(recursive).lower())
    if glob:
        reader = reader.option("glob", glob)
    return reader.load(qualified(spark, root))


def watch_tree(spark: SparkSession, root: str, log: str, recursive: bool = True, glob: str | None = None) -> DataFrame:
    """A stream of the files of a folder, each once; ``log`` is a folder that belongs to the stream like its checkpoint."""
    register(spark)
    reader = spark.readStream.format(FORMAT).option("recursive", str(recursive).lower()).option("log", qualified(spark, log))
    if glob:
        reader = reader.option("glob", glob)
    return reader.load(qualified(spark, root))


def with_md5(listed: DataFrame, root: str) -> DataFrame:
    """Listed rows with the MD5 of each file, read in blocks, so that the size of a file does not matter."""
    root = qualified(listed.sparkSession, root)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        system, _ = open_folder(root)

        def digest(path: str) -> str:
            total = hashlib.md5()
            # The bytes as they are, also of names that look compressed.
            with system.open_input_stream(path, compression=None) as stream:
                while block := stream.read(BLOCK_BYTES):
                    total.update(block)
            return total.hexdigest()

        for batch in batches:
            md5 = [None if folder else digest(path) for path, folder in zip(batch["path"], batch["is_directory"])]
            yield batch.assign(md5=pd.Series(md5, dtype=object, index=batch.index))

    return listed.mapInPandas(run, f"{LISTED_DDL}, md5 string")


def file_inventory(spark: SparkSession, root: str, partition: Column | str) -> DataFrame:
    """One row per file and per directory of a tree."""
    base = qualified(spark, root).rstrip("/")
    partition = F.lit(partition) if isinstance(partition, str) else partition
    rows = with_md5(list_tree(spark, base).repartition("path"), base)
    rows = rows.withColumn("relative_path", F.expr(f"substring(path, {len(open_folder(base)[1]) + 1})"))
    return rows.select(
        base_name("relative_path").alias("name"),
        parent_name("path", F.lit(open_folder(base)[1])).alias("parent_dir"),
        normalize_path("relative_path").alias("relative_path"),
        "is_directory",
        "size",
        "md5",
        partition.alias("partition_name"),
    )


def _flat_listing(spark: SparkSession, folder: str) -> DataFrame:
    return list_tree(spark, folder, recursive=False).where(~F.col("is_directory"))


def import_candidates(spark: SparkSession, folder: str) -> DataFrame:
    """Archives waiting in an import folder: the allowed extensions of a flat listing."""
    listed = _flat_listing(spark, folder).where(any_suffix(F.col("path"), IMPORT_EXTENSIONS))
    return with_md5(listed.repartition("path"), folder).select(base_name("path").alias("name"), "path", "size", "md5")


def loose_apps(spark: SparkSession, folder: str) -> DataFrame:
    """Apps that lie in a folder by themselves."""
    listed = _flat_listing(spark, folder).where(F.lower("path").endswith(".apk"))
    return with_md5(listed.repartition("path"), folder).select(base_name("path").alias("name"), "size", "md5")


class Writer:
    """Writes files below a folder of one file system; a folder is made once, not once per file."""

    def __init__(self, system: pafs.FileSystem, top: str):
        self._system, self._top, self._made = system, top, set()

    def write(self, name: str, content: bytes) -> None:
        folder = os.path.dirname(f"{self._top}/{name}")
        if folder not in self._made:
            if len(self._made) >= FOLDERS_KNOWN:
                self._made.clear()
            self._system.create_dir(folder, recursive=True)
            self._made.add(folder)
        with self._system.open_output_stream(f"{self._top}/{name}", compression=None) as stream:
            stream.write(content)


def write_files(rows: DataFrame, root: str) -> None:
    """Write rows ``(name, content)`` as files below a folder, by the tasks that hold them."""
    root = qualified(rows.sparkSession, root)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        writer = Writer(*open_folder(root))
        for batch in batches:
            for name, content in zip(batch["name"], batch["content"]):
                writer.write(name, bytes(content))
            yield batch[["name"]]

    rows.select("name", "content").mapInPandas(run, "name string").write.format("noop").mode("overwrite").save()


def line_rows(spark: SparkSession, root: str, glob: str | None = None) -> DataFrame:
    """Lines of small text files with their file and line number.

    Each file is read whole because a later line overrides an earlier one; property files are small.
    """
    # The arguments of text() override options of the same name, so they are given here.
    texts = spark.read.text(root, wholetext=True, recursiveFileLookup=True, pathGlobFilter=glob).select(_local_path(F.col("_metadata.file_path")).alias("file_path"), "value")
    return texts.select("file_path", F.posexplode(F.split("value", "\n")).alias("line_no", "line"))
