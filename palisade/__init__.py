"""Supply-chain analytics expressed as Spark DataFrame jobs."""
