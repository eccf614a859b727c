"""Spark jobs that turn agent conversation transcripts into a deduplicated, evidence-linked, searchable store."""
