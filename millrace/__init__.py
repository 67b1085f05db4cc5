"""Resumable row enrichment and corpus preparation, expressed as Spark jobs."""
