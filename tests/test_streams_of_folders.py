"""Streams over tables that are folders of files."""

import pyarrow.parquet as pq
import pytest

from corpuslens.plans import Tables, load_queries
from corpuslens.plans.registry import TABLE_NAMES

FOLDER = "/root/testdata/sf0.001"
STREAMS = ["scan_fanout", "log_window_stream", "scan_progress", "scan_progress_bounded"]


@pytest.fixture(scope="module")
def folders(tmp_path_factory):
    """The tables, each a folder of two files."""
    top = tmp_path_factory.mktemp("folders")
    for name in TABLE_NAMES:
        rows = pq.read_table(f"{FOLDER}/{name}.parquet")
        (top / f"{name}.parquet").mkdir()
        half = rows.num_rows // 2
        pq.write_table(rows.slice(0, half), top / f"{name}.parquet" / "part-0.parquet")
        pq.write_table(rows.slice(half), top / f"{name}.parquet" / "part-1.parquet")
    return str(top)


@pytest.mark.parametrize("name", STREAMS)
def test_a_folder_gives_what_a_file_gives(spark, folders, name):
    build = load_queries()[name]
    of_files, of_folders = (sorted(map(tuple, build(Tables(spark, f)).collect())) for f in (FOLDER, folders))
    assert of_files and of_folders == of_files


def test_nothing_is_queued(spark, folders, tmp_path):
    for name in ("documents", "labels"):
        rows = pq.read_table(f"{FOLDER}/documents.parquet")
        pq.write_table(rows, tmp_path / f"{name}.parquet")
    assert load_queries()["scan_fanout"](Tables(spark, str(tmp_path))).count() == 0
