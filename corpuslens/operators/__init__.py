"""DataFrame operators. Each takes DataFrames and returns DataFrames; none collects rows.

Joins carry no broadcast hints: Spark compares the size of a side with
``spark.sql.autoBroadcastJoinThreshold`` (and again at run time with adaptive execution), so a small
lookup is broadcast and a large one is shuffled, with skewed partitions split.
"""
