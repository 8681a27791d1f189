"""Consolidation of scraped fixture results as Spark DataFrame jobs."""
