"""A stored index of files by content hash.

The index is a table bucketed and sorted by hash: joins and groupings by hash read it as it lies, without an exchange
on its side, however often they are run. New files are appended to the same buckets.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.files import qualified
from . import inventory

BUCKETS = 200


class HashIndex:
    """The index below a folder, as a table of the session's catalogue.

    The folder belongs to the index; the catalogue entry is made anew in each session that opens it.
    """

    def __init__(self, spark: SparkSession, path: str, table: str, hash_col: str, buckets: int = BUCKETS):
        self.spark, self.path, self.table = spark, qualified(spark, path), table
        self.hash_col, self.buckets = hash_col, buckets

    def add(self, files: DataFrame) -> None:
        """Append files; the first call makes the table. Files are dealt to their buckets first, so each bucket gets one file a call."""
        dealt = files.repartition(self.buckets, self.hash_col)
        writer = dealt.write.mode("append").format("parquet").bucketBy(self.buckets, self.hash_col).sortBy(self.hash_col)
        writer.option("path", self.path).saveAsTable(self.table)

    def open(self, schema: str) -> HashIndex:
        """Enter an index that is there already into this session's catalogue."""
        self.spark.sql(
            f"CREATE TABLE IF NOT EXISTS {self.table} ({schema}) USING parquet CLUSTERED BY (`{self.hash_col}`) "
            f"SORTED BY (`{self.hash_col}`) INTO {self.buckets} BUCKETS LOCATION '{self.path}'"
        )
        return self

    def files(self) -> DataFrame:
        return self.spark.table(self.table)

    def _dealt(self, rows: DataFrame) -> DataFrame:
        # As many partitions as buckets: the index keeps its place and the other side comes to it.
        return rows.repartition(self.buckets, self.hash_col)

    def all_matches(self, wanted: DataFrame) -> DataFrame:
        """All files whose content is asked for, once each."""
        return inventory.files_by_hash(self.files(), self._dealt(wanted.select(self.hash_col).distinct()).hint("merge"), self.hash_col)

    def first_match(self, apps: DataFrame, file_id: str) -> DataFrame:
        """Every app with the first file of its content; null where there is none."""
        firsts = self.files().groupBy(self.hash_col).agg(F.min(file_id).alias(file_id))
        return self._dealt(apps).join(firsts.hint("merge"), self.hash_col, "left")

    def new(self, incoming: DataFrame) -> DataFrame:
        """Incoming rows whose content is not in the index."""
        return self._dealt(incoming).join(self.files().select(self.hash_col).hint("merge"), self.hash_col, "left_anti")

    def duplicates(self, id_col: str) -> DataFrame:
        """Contents with more than one copy."""
        return inventory.duplicate_groups(self.files(), self.hash_col, id_col)
