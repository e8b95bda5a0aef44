"""cargofile — regulatory freight filings as Spark DataFrame jobs."""
