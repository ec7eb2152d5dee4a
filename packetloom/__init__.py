"""Network-traffic security analytics expressed as Spark DataFrame jobs."""
