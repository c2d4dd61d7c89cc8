"""Page-hit analytics as Spark jobs: admission, enrichment, signing and delivery."""
