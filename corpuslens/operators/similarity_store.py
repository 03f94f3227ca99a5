"""Similarity edges kept up to date (D01, D03, J15): only what is new is compared.

A score depends on the two digests and on nothing else, so an edge between digests stays right for good. The store keeps distinct
digests, each with a number, their chunks, edges, and which file has which digest; chunks and edges name digests by
their numbers, since a digest can be long. A step takes the digests of new or changed
files; those not seen before meet the stored postings and each other, what is stored is not compared again.
A file that comes again with another digest moves to it, and digests that no file has any more give no edges.

Each step writes folders of its own; a small file that lists the valid folders is written last, by a move, so a step that dies
leaves no trace and can be run again. ``compact`` puts many steps into one.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import unfold
from ..functions.fuzzy import piecewise_score_of
from ..session import release_finished, stored
from ..sources.files import qualified
from ..sources.tree import open_folder
from .similarity import CELL_ROWS, candidate_pairs, chunk_keys, postings

ENDS_HELD = 1 << 20  # names that a task holds while it names edges


class SimilarityStore:
    """Digests and their edges below a folder. ``keys`` gives the keys two digests must share to be compared, as an
    array of longs, ``score`` the score of two digests; edges have a score above 0. Without a ``score`` every two digests that
    share a key have an edge of score 1."""

    def __init__(
        self, spark: SparkSession, path: str, keys: Callable[[str], Column] = chunk_keys,
        score: Callable[[str, str], Column] | None = piecewise_score_of, cell_rows: int = CELL_ROWS,
    ):
        self.spark, self.path = spark, qualified(spark, path).rstrip("/")
        self._keys, self._score, self._cell_rows = keys, score, cell_rows
        self._system, self._top = open_folder(self.path)

    def _log(self) -> tuple[int, list[str]]:
        """The last version and its valid steps, in order."""
        found = self._system.get_file_info(pafs.FileSelector(f"{self._top}/log", allow_not_found=True))
        version = max((int(f.base_name[:-5]) for f in found if f.base_name.endswith(".json")), default=0)
        if version == 0:
            return 0, []
        with self._system.open_input_stream(f"{self._top}/log/{version:08d}.json", compression=None) as stream:
            return version, json.loads(stream.read())

    def _commit(self, base: int, steps: list[str]) -> None:
        if self._log()[0] != base:
            raise RuntimeError("another step was committed meanwhile")
        self._system.create_dir(f"{self._top}/log", recursive=True)
        fresh = f"{self._top}/log/{uuid.uuid4().hex}.tmp"
        with self._system.open_output_stream(fresh, compression=None) as stream:
            stream.write(json.dumps(steps).encode())
        self._system.move(fresh, f"{self._top}/log/{base + 1:08d}.json")

    def _read(self, name: str, steps: list[str], schema: str) -> DataFrame:
        if not steps:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[f"{self.path}/{step}/{name}" for step in steps])

    def _members(self, steps: list[str]) -> DataFrame:
        """The digest each file has now: that of the latest step."""
        # Ids have the type of the first step.
        kind = self.spark.read.parquet(f"{self.path}/{steps[0]}/members").schema["file_id"].dataType.simpleString()
        rows = self._read("members", steps, f"file_id {kind}, digest string, step long")
        return rows.groupBy("file_id").agg(F.max_by("digest", "step").alias("digest")).where("digest IS NOT NULL")

    def _digests(self, steps: list[str]) -> DataFrame:
        return self._read("digests", steps, "digest string, number long")

    def _postings(self, steps: list[str]) -> DataFrame:
        return postings(self._read("keys", steps, "node long, keys array<long>"), "keys", before=False)

    def _edges(self, steps: list[str]) -> DataFrame:
        return self._read("edges", steps, "src long, dst long, score int")

    def add(self, digests: DataFrame, id_col: str, digest_col: str = "digest") -> None:
        """One step: digests of new or changed files. A null digest takes the file out."""
        base, steps = self._log()
        step = uuid.uuid4().hex
        rows = digests.select(F.col(f"`{id_col}`").alias("file_id"), F.col(f"`{digest_col}`").alias("digest"))
        rows.groupBy("file_id").agg(F.max("digest").alias("digest")).withColumn("step", F.lit(base).cast("long")).write.parquet(f"{self.path}/{step}/members")
        taken = self.spark.read.parquet(f"{self.path}/{step}/members")

        fresh = taken.where("digest IS NOT NULL").select("digest").distinct()
        first = 0
        if steps:
            known = self._digests(steps)
            fresh = fresh.join(known.select("digest"), "digest", "left_anti")
            first = known.agg(F.coalesce(F.max("number") + 1, F.lit(0))).first()[0]
        # Written before they are used, so that the numbers hold still.
        fresh.select("digest", (F.monotonically_increasing_id() + first).alias("number")).write.parquet(f"{self.path}/{step}/digests")
        own = self._digests([step])
        own.select(F.col("number").alias("node"), self._keys("digest").alias("keys")).write.parquet(f"{self.path}/{step}/keys", compression="zstd")

        pairs = candidate_pairs(self._postings([step]), self._cell_rows, self._postings(steps) if steps else None)
        if self._score is None:
            scored = pairs.withColumn("score", F.lit(1))
        else:
            every = self._digests([*steps, step])
            both = pairs.join(every.toDF("a", "src"), "src").join(every.toDF("b", "dst"), "dst").select(
                "src", "dst", F.least("a", "b").alias("low"), F.greatest("a", "b").alias("high")
            )
            # Unfolded, so that the filter does not make a second score of each pair.
            scored = unfold(both, ["src", "dst"], F.array(self._score("low", "high").cast("int")), "score")
        scored.where("score > 0").write.parquet(f"{self.path}/{step}/edges", compression="zstd")
        self._commit(base, [*steps, step])
        release_finished(self.spark)

    def members(self) -> DataFrame:
        """``(file_id, digest)`` of the files as they are now."""
        return self._members(self._log()[1])

    def edges(self, names: DataFrame | None = None) -> DataFrame:
        """``(src, dst, score)`` between digests that files have now, ``src < dst``. ``names`` are rows ``(digest, name)``
        for what to call them; digests without a name are left out."""
        _, steps = self._log()
        if not steps:
            return self.spark.createDataFrame([], "src string, dst string, score int")
        if names is None:
            names = self._alive(steps).withColumn("name", F.col("digest"))
        # Stored, so that Spark knows how small they are before it joins the edges with them.
        ends = stored(names.join(self._digests(steps), "digest").select("number", "name"), "ends")
        # Edges are very many more than their ends: up to some MB of ends go to the edges, beyond that both are dealt out.
        if ends.count() <= ENDS_HELD:
            ends = F.broadcast(ends)
        both = self._edges(steps).join(ends.toDF("src", "a"), "src").join(ends.toDF("dst", "b"), "dst")
        return both.select(F.least("a", "b").alias("src"), F.greatest("a", "b").alias("dst"), "score")

    def _alive(self, steps: list[str]) -> DataFrame:
        return self._members(steps).select("digest").distinct()

    def steps(self) -> list[str]:
        return self._log()[1]

    def compact(self) -> None:
        """One step in place of all: files as they are now, and what their digests need."""
        base, steps = self._log()
        if not steps:
            return
        step = uuid.uuid4().hex
        self._members(steps).withColumn("step", F.lit(base).cast("long")).write.parquet(f"{self.path}/{step}/members")
        alive = self.spark.read.parquet(f"{self.path}/{step}/members").select("digest").distinct()
        self._digests(steps).join(alive, "digest", "left_semi").write.parquet(f"{self.path}/{step}/digests")
        kept = self._digests([step])
        self._read("keys", steps, "node long, keys array<long>").join(kept.select(F.col("number").alias("node")), "node", "left_semi").write.parquet(f"{self.path}/{step}/keys")
        edges = self._edges(steps)
        for end in ("src", "dst"):
            edges = edges.join(kept.select(F.col("number").alias(end)), end, "left_semi")
        edges.select("src", "dst", "score").write.parquet(f"{self.path}/{step}/edges")
        self._commit(base, [step])
