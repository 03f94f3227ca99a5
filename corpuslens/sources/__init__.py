"""Sources and sinks, all through Spark's own file formats."""
