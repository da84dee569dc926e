"""Analytics over content-addressed history tables, written as Spark jobs."""
