"""Ledgerlume: fiscal-document analytics and corpus preparation expressed as Spark jobs."""
