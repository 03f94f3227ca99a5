"""What single tasks hold and do."""

import random

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import types as T

from corpuslens.operators import scanners as sc
from corpuslens.plans import Tables, load_queries
from corpuslens.sources import files


def test_a_batch_scan_looks_at_some_megabytes_together(spark):
    rng = random.Random(3)
    texts = [None, b"", b"\xff", b"x" * (sc.SLICE_BYTES + 5), *(b"a b\n" * rng.randint(0, 20_000) for _ in range(400))]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array(texts, pa.binary())], names=["id", "content"])
    seen, job = [], sc.TextScanner()

    class Watching(sc.TextScanner):
        def scan_batch(self, contents, **arguments):
            seen.append((len(contents), sum(len(c or b"") for c in contents.to_pylist())))
            return super().scan_batch(contents, **arguments)

    schema = sc.report_schema(job, T.StructField("id", T.LongType()))
    parts = list(sc._whole_batches(Watching(), schema, {})(iter([batch])))
    assert all(size <= sc.SLICE_BYTES or rows == 1 for rows, size in seen) and sum(rows for rows, _ in seen) == len(texts)
    whole, error = job.scan_batch(batch.column(1))
    got = pa.Table.from_batches(parts)
    assert got["id"].to_pylist() == list(range(len(texts))) and got["error"].to_pylist() == error.to_pylist()
    good = [i for i, e in enumerate(error.to_pylist()) if e is None]
    for name in ("n_lines", "n_words"):
        assert [got[name][i].as_py() for i in good] == [whole[name][i].as_py() for i in good]


def test_exact_quantiles_are_not_made_by_one_task(spark):
    found = load_queries()["rollup_estimates"](Tables(spark, "/root/testdata/sf0.001"))
    assert "percentile" not in found._jdf.queryExecution().optimizedPlan().toString().lower()
    rows = sorted((r.attribute, r.share or 0, r.within) for r in found.collect())
    want = [(a, s, True) for a in ("cents", "o_orderkey") for s in (0.5, 0.9, 0.99)] + [(a, 0, True) for a in ("o_custkey", "o_orderkey")]
    assert rows == sorted(want)


def test_a_folder_is_made_once(tmp_path):
    made, real = [], pafs.LocalFileSystem()

    class Counting:
        def create_dir(self, folder, recursive):
            made.append(folder)
            real.create_dir(folder, recursive=recursive)

        def open_output_stream(self, *args, **kwargs):
            return real.open_output_stream(*args, **kwargs)

    writer = files.Writer(Counting(), str(tmp_path / "top"))
    names = [f"{folder}d{i}.txt" for i in range(50) for folder in ("", "a/", "a/.b/")]
    for name in names:
        writer.write(name, name.encode())
    assert len(made) == 3
    assert all((tmp_path / "top" / name).read_bytes() == name.encode() for name in names)
