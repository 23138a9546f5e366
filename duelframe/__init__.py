"""duelframe: point-in-time analytics over two-sided events, written as Spark DataFrame jobs."""
