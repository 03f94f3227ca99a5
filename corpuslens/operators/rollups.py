"""Statistics that merge over imports (A09, A10, A13, A14): partial results are stored, corpus figures are merged from them.

For each owner, such as a firmware, and day the store holds counts, sums and extremes, a HyperLogLog sketch per distinct
count, and a histogram of logarithmic buckets per numeric attribute. All of these merge without loss of what they
promise: distinct counts are off by about 1.04 / sqrt(2 ** ``SKETCH_BITS``) (1.6 %), quantiles by at most ``ACCURACY`` of their
value; counts, sums and extremes are exact. Adding an owner reads its rows only and replaces what was stored for
it, so adding it twice changes nothing.

Nulls are not counted; not-a-number and infinite values are left out of the histograms.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import unfold

ACCURACY = 0.01
SKETCH_BITS = 12
QUANTILES = (0.5, 0.9, 0.99)
_ZERO = 1 << 20  # beyond all buckets of doubles at this accuracy: about 35,000 on each side


def log_bucket(value: Column, accuracy: float = ACCURACY) -> Column:
    """The bucket of a number: neighbours are a fixed ratio apart, buckets rise with the value, zero has its own."""
    ratio = math.log((1 + accuracy) / (1 - accuracy))
    size = F.ceil(F.log(F.abs(value)) / ratio).cast("long") + _ZERO
    return F.when(value == 0, F.lit(0).cast("long")).when(value > 0, size).otherwise(-size)


def bucket_value(bucket: Column, accuracy: float = ACCURACY) -> Column:
    """The number that stands for a bucket: none of its members is further off than the accuracy."""
    step = (1 + accuracy) / (1 - accuracy)
    size = F.pow(F.lit(step), (F.abs(bucket) - _ZERO).cast("double")) * 2 / (1 + step)
    return F.when(bucket == 0, F.lit(0.0)).when(bucket > 0, size).otherwise(-size)


def _long_form(rows: DataFrame, keys: Sequence[str], columns: Sequence[str], kind: str) -> DataFrame:
    values = [F.struct(F.lit(c).alias("attribute"), F.col(f"`{c}`").cast(kind).alias("value")) for c in columns]
    return unfold(rows, list(keys), F.array(*values), "_pair").select(*keys, "_pair.*").where(F.col("value").isNotNull())


class Rollups:
    """Partial statistics below a folder, one partition per owner."""

    def __init__(self, spark: SparkSession, path: str, numeric: Sequence[str] = (), distinct: Sequence[str] = ()):
        self.spark, self.path = spark, path.rstrip("/")
        self.numeric, self.distinct = list(numeric), list(distinct)

    def add(self, rows: DataFrame, owner_col: str, day_col: str | None = None) -> None:
        """Store the statistics of the owners of these rows, in place of what was stored for them."""
        day = F.lit(None).cast("date") if day_col is None else F.to_date(F.col(f"`{day_col}`"))
        keys = ["owner", "day"]
        named = rows.withColumns({"owner": F.col(f"`{owner_col}`").cast("string"), "day": day})
        numbers = _long_form(named, keys, self.numeric, "double") if self.numeric else None
        if numbers is not None:
            value = F.col("value")
            self._write("totals", numbers.groupBy(*keys, "attribute").agg(
                F.count("*").alias("n"), F.sum(value).alias("total"), F.min(value).alias("lowest"), F.max(value).alias("highest")))
            finite = numbers.where(~F.isnan(value) & (F.abs(value) != math.inf))
            self._write("histograms", finite.groupBy(*keys, "attribute", log_bucket(value).alias("bucket")).agg(F.count("*").alias("n")))
        if self.distinct:
            texts = _long_form(named, keys, self.distinct, "string")
            self._write("sketches", texts.groupBy(*keys, "attribute").agg(F.hll_sketch_agg("value", SKETCH_BITS).alias("sketch")))

    def _write(self, name: str, partials: DataFrame) -> None:
        writer = partials.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("owner")
        writer.parquet(f"{self.path}/{name}")

    def _read(self, name: str) -> DataFrame:
        # The owner is text, also where all owners look like numbers.
        rows = self.spark.read.option("basePath", f"{self.path}/{name}").parquet(f"{self.path}/{name}")
        return rows.withColumn("owner", F.col("owner").cast("string"))

    def totals(self, by: Sequence[str] = ()) -> DataFrame:
        """``n``, ``total``, ``mean``, ``lowest``, ``highest`` per attribute, and per owner or day if asked for."""
        merged = self._read("totals").groupBy(*by, "attribute").agg(
            F.sum("n").alias("n"), F.sum("total").alias("total"), F.min("lowest").alias("lowest"), F.max("highest").alias("highest"))
        return merged.withColumn("mean", F.col("total") / F.col("n"))

    def distinct_counts(self, by: Sequence[str] = ()) -> DataFrame:
        """About how many distinct values each attribute has."""
        return self._read("sketches").groupBy(*by, "attribute").agg(F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("distinct_values"))

    def histogram(self, by: Sequence[str] = ()) -> DataFrame:
        """Counts per bucket and the value that stands for it."""
        merged = self._read("histograms").groupBy(*by, "attribute", "bucket").agg(F.sum("n").alias("n"))
        return merged.withColumn("value", bucket_value(F.col("bucket")))

    def quantiles(self, shares: Sequence[float] = QUANTILES, by: Sequence[str] = ()) -> DataFrame:
        """``(attribute, share, value)``: the value at or below which a share of the values lies, within the accuracy.

        An attribute has some ten thousand buckets at most, which one task walks through.
        """
        part = Window.partitionBy(*by, "attribute")
        running = self.histogram(by).withColumns({"upto": F.sum("n").over(part.orderBy("bucket")), "all": F.sum("n").over(part)})
        found = [
            running.where(F.col("upto") >= F.ceil(F.col("all") * F.lit(share))).groupBy(*by, "attribute")
            .agg(F.min_by("value", "bucket").alias("value")).withColumn("share", F.lit(float(share)))
            for share in shares
        ]
        return reduce(DataFrame.unionByName, found).select(*by, "attribute", "share", "value")
