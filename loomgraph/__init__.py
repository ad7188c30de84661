"""Code-graph analytics over many repositories as Spark DataFrame jobs."""
